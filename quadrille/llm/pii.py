"""PII: patterns for personal data, and terms that give protected entities away by corpus co-occurrence."""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.llm.common import cut, pieces

KINDS = ("email", "ip", "card", "phone")
#: An email is the run of these up to an @, and the domain from there.
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
#: Its parts take whole runs of digits, so no match can start within one.
IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LETTER_RUN = re.compile(r"[^\W\d_]+")
OPAQUE = re.compile(r"(?<![A-Za-z0-9_+/=-])[A-Za-z0-9_+/=-]{20,}")
#: Words up to so far on either side of an entity can give it away.
REACH = 5
#: A term gives an entity away if it tells at least this share of the entity's information, seen in so many documents.
DISCLOSURE, SUPPORT = 0.6, 3
#: A term that at most so many times SUPPORT documents have is removed; a more common one is generalised.
RARE = 10

SPAN = "array<struct<kind:string,start:int,end:int>>"
CONTEXT = "array<struct<key:string,term:string,start:int,end:int,kind:string,from:int,to:int>>"


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) << (i & 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost, each character seen at most twice."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        m = DOMAIN.match(text, at) if start < at else None
        if m:
            end = m.end()
            yield start, end
        at = text.find("@", m.end() if m else at + 1)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind as listed."""
    found = []
    found += [("email", *span) for span in emails(text)]
    for m in IP.finditer(text):
        if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or "0") <= 255 for x in m.group().split(".")):
            found.append(("ip", *m.span()))
    for m in CARD.finditer(text):
        digits = m.group().replace(" ", "").replace("-", "")
        if 14 <= len(digits) <= 19 and luhn(digits):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in PHONE.finditer(text):
            if 10 <= sum(c.isdigit() for c in m.group()) <= 15:
                found.append(("phone", *m.span()))
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def keys_of(kind: str, text: str) -> tuple[str, str]:
    """The protected entity that a span names, however it is written, and the class that it shares with others:
    an email's domain, an address's network, a card's issuer, a phone's country and area, or any secret."""
    if kind == "email":
        return f"email:{text.lower()}", f"email of {text.lower().rpartition('@')[2]}"
    if kind == "ip":
        return f"ip:{text}", f"ip of {'.'.join(text.split('.')[:2])}"
    if kind == "secret":
        return f"secret:{text}", "secret"
    digits = "".join(c for c in text if c.isdigit())
    return f"{kind}:{digits}", f"{kind} of {digits[:4]}"


def secrets(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Candidates for secrets: opaque words of letters and digits that are part of no other span."""
    found, k = [], 0
    for m in OPAQUE.finditer(text):
        word = m.group()
        while k < len(spans) and spans[k][2] <= m.start():
            k += 1
        inside = k < len(spans) and spans[k][1] < m.end()
        if not inside and any(map(str.isdigit, word)) and any(map(str.isalpha, word)):
            found.append(("secret", *m.span()))
    return found


def context(text: str, spans: list[tuple[str, int, int]], reach: int) -> list[tuple[str, str, int, int, str, int, int]]:
    """(key, term, start, end, kind, from, to) of the `reach` words on either side of each span, however far, that
    overlap no span; both keys of the span in turn. One sweep over words and spans finds them."""
    spans = sorted(spans, key=lambda s: s[1:])
    starts, ends, k, over = [], [], 0, 0
    for m in LETTER_RUN.finditer(text):
        while k < len(spans) and spans[k][1] < m.end():
            over = max(over, spans[k][2])
            k += 1
        if over <= m.start():
            starts.append(m.start())
            ends.append(m.end())
    found = []
    for kind, a, b in spans:
        before, after = bisect_left(starts, a), bisect_left(starts, b)
        near = [*range(max(0, before - reach), before), *range(after, min(len(starts), after + reach))]
        terms = [(text[starts[i] : ends[i]].lower(), starts[i], ends[i]) for i in near]
        found += [(key, *t, kind, a, b) for key in keys_of(kind, text[a:b]) for t in terms]
    return found


def detected(docs: DataFrame, reach: int = REACH) -> DataFrame:
    """docs (doc_id, text) as (doc_id, th, spans, context); th tells rows apart that repeat an id."""
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    names = ("key", "term", "start", "end", "kind", "from", "to")
    near_by = pa.list_(pa.struct([(n, pa.int32() if n in ("start", "end", "from", "to") else pa.string()) for n in names]))

    def run(batches):
        for b in pieces(batches):
            spans, near = [], []
            for t in b.column("text").to_pylist():
                s = base_spans(t or "")
                spans.append(s)
                s = s + secrets(t or "", sorted(s, key=lambda x: x[1:]))
                near.append(context(t, s, reach) if s else [])
            spans = pa.array([[dict(zip(("kind", "start", "end"), x, strict=True)) for x in s] for s in spans], span)
            near = pa.array([[dict(zip(names, x, strict=True)) for x in s] for s in near], near_by)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("th"), spans, near], names=["doc_id", "th", "spans", "context"])

    return docs.mapInArrow(run, f"doc_id long, th long, spans {SPAN}, context {CONTEXT}")


def term_documents(docs: DataFrame) -> DataFrame:
    """(term, df): in how many rows of docs each term stands; tasks sum what they see before it is shuffled."""

    def run(batches):
        seen: Counter = Counter()

        def flush():
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["term", "c"])
            seen.clear()

        for b in pieces(batches):
            for t in b.column("text").to_pylist():
                if t:
                    seen.update(set(LETTER_RUN.findall(t.lower())))
            if len(seen) > 100_000:
                yield from flush()
        if seen:
            yield from flush()

    return docs.select("text").mapInArrow(run, "term string, c long").groupBy("term").agg(F.sum("c").alias("df"))


def disclosing(found: DataFrame, docs: DataFrame, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(key, term, action): terms near an entity, or near those of a class, that tell at least `share` of what there is
    to know of it.

    With p() as shares of all rows, a term tells log p(term, key) / (p(term) p(key)) of the key's -log p(key); pairs in
    fewer than `support` documents are left alone, where equal rows are one. Very rare terms are removed, others
    generalised. All shares are of rows, repeated ones each; pairs come from neighbourhoods of bounded size, and
    are summed before they move.
    """
    n = max(1, found.count())
    near = found.select("row", "doc_id", "th", F.inline("context")).select("row", "doc_id", "th", "key", "term").distinct()
    texts = near.groupBy("key", "term", "doc_id", "th").agg(F.count(F.lit(1)).alias("c"))
    pairs = texts.groupBy("key", "term").agg(F.sum("c").alias("both"), F.count(F.lit(1)).alias("texts")).filter(F.col("texts") >= support)
    keys = near.select("row", "key").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("ef"))
    met = pairs.join(keys, "key").join(term_documents(docs), "term")
    told = F.log(F.col("both") * n / (F.col("df") * F.col("ef")))
    action = F.when(F.col("df") <= RARE * support, "removed").otherwise("general")
    return met.filter(F.col("ef") < n).filter(told >= share * F.log(n / F.col("ef"))).select("key", "term", action.alias("action"))


def spans_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """One row for each row of docs: doc_id, th, base (spans of the patterns), terms (spans that the method adds).

    Patterns: email, ip, card, phone; leftmost, non-overlapping within a kind. Protected entities are what these find
    and secrets, opaque words of 20 or more letters and digits. Added are the disclosing terms within reach of what
    they give away (kinds removed and general), and the secrets that a disclosing term stands by (kind secret); none
    overlaps a base span. Null texts count as empty: no spans. Rows that repeat an id are kept apart by a hash of the
    text; equal rows get equal spans. Texts of any length are swept once. Offsets are in code points. Extra columns
    are not looked at. An empty table gives an empty one.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    found = cut(detected(rows, reach).withColumn("row", F.monotonically_increasing_id()))
    rules = disclosing(found, rows, share, support)
    met = found.filter(F.size("context") > 0).select("row", F.inline("context")).join(rules, ["key", "term"])
    term = F.struct(F.col("action").alias("kind"), "start", "end")
    secret = F.when(F.col("kind") == "secret", F.struct("kind", F.col("from").alias("start"), F.col("to").alias("end")))
    added = met.select("row", F.explode(F.array(term, secret)).alias("s")).filter("s is not null")
    added = added.groupBy("row").agg(F.array_sort(F.collect_set("s")).alias("terms"))
    # a term that is removed for one entity isn't generalised for another as well
    removed = F.transform(F.filter("terms", lambda s: s["kind"] == "removed"), lambda s: s["start"])
    added = added.select("row", F.filter("terms", lambda s: (s["kind"] != "general") | ~F.array_contains(removed, s["start"])).alias("terms"))
    return found.join(added, "row", "left").select("doc_id", "th", F.col("spans").alias("base"), F.coalesce("terms", F.array().cast(SPAN)).alias("terms"))


def sanitised(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, share: float = DISCLOSURE, support: int = SUPPORT) -> DataFrame:
    """(doc_id, text): base spans become [EMAIL], [IP], [CARD], [PHONE], secrets [SECRET], generalised terms [TERM];
    removed ones go.

    A row joins its spans by id and text. Null texts stay null.
    """
    spans = spans_of(docs, id_col, text_col, reach, share, support).select("doc_id", "th", F.concat("base", "terms").alias("spans")).dropDuplicates(["doc_id", "th"])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("th", F.xxhash64("text"))
    met = rows.join(spans, rows["doc_id"].eqNullSafe(spans["doc_id"]) & (rows["th"] == spans["th"]), "left").select(rows["doc_id"], "text", "spans")

    def run(batches):
        for b in batches:
            out = []
            for t, spans in zip(b.column("text").to_pylist(), b.column("spans").to_pylist(), strict=True):
                at, done = 0, []
                for s in sorted(spans or [], key=lambda s: (s["start"], -s["end"])):
                    if s["start"] >= at:
                        name = {"removed": "", "general": "[TERM]"}.get(s["kind"], f"[{s['kind'].upper()}]")
                        done += [t[at : s["start"]], name]
                    at = max(at, s["end"])
                out.append(t if t is None else "".join(done) + t[at:])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(out, pa.string())], names=["doc_id", "text"])

    return met.mapInArrow(run, "doc_id long, text string")


def op4_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = spans_of(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    order = {k: i for i, k in enumerate((*KINDS, "general", "removed", "secret"))}
    rank = F.create_map(*[F.lit(x) for kv in order.items() for x in kv])
    every = F.transform(F.array_sort(F.transform(F.concat("base", "terms"), lambda s: F.struct(s["start"].alias("start"), rank[s["kind"]].alias("r"), s["end"].alias("end"), s["kind"].alias("kind")))), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    def count(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(every).alias("spans"), F.size(F.filter("terms", lambda s: s["kind"] != "secret")).cast("long").alias("n_terms"), F.size(F.filter("terms", lambda s: s["kind"] == "secret")).cast("long").alias("n_secrets"))


QUERIES = {"op4_disclosure": op4_disclosure}
