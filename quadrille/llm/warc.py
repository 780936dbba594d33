"""WARC fixity audit: Merkle trees over records and their ordered offset ranges, compared from the roots down."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrille.llm.common import cut

#: Children of a tree node, and records of one archive file.
FANOUT, FILE_RECORDS = 16, 1000


def records(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", body_col: str = "html") -> DataFrame:
    """(record_id, record): each row as the bytes of one WARC resource record. Null urls and bodies count as empty."""
    body = F.encode(F.coalesce(F.col(body_col), F.lit("")), "UTF-8")
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), F.coalesce(F.col(url_col), F.lit("")), F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return pages.select(F.col(id_col).alias("record_id"), F.concat(F.encode(head, "UTF-8"), body, F.encode(F.lit("\r\n\r\n"), "UTF-8")).alias("record"))


def leaves(recs: DataFrame, per_file: int = FILE_RECORDS) -> DataFrame:
    """(file, at, record_id, length, hash): the digest and the place of each record; only these move.

    A file holds `per_file` ids, each at the place that its id gives it, so what one record loses or gains shifts no
    other. Records of null id are file -1, at a place that their digest gives. Records that repeat an id share a place.
    """
    narrow = recs.select("record_id", F.octet_length("record").cast("long").alias("length"), F.unhex(F.sha2("record", 256)).alias("hash"))
    file = F.coalesce(F.floor(F.col("record_id") / per_file), F.lit(-1)).cast("long")
    at = F.coalesce(F.pmod(F.col("record_id"), F.lit(per_file)), F.pmod(F.xxhash64("hash"), F.lit(per_file))).cast("long")
    return narrow.select(file.alias("file"), at.alias("at"), "record_id", "length", "hash")


def tree(leaf: DataFrame, per_file: int = FILE_RECORDS, fanout: int = FANOUT) -> list[DataFrame]:
    """The levels of each file's tree, places first: (file, at, length, hash).

    A place's hash is that of its records' number, bytes and digests in any order, summed, so that a place of many
    records is a sum of partial sums. A node covers the ordered byte range of its up to `fanout` children; its hash
    is that of their places, lengths and hashes. Levels shrink by the fanout.
    """
    digest = [F.sum(F.xxhash64("hash", F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
    mark = F.concat_ws(":", F.count(F.lit(1)), F.sum("length"), *digest)
    levels = [cut(leaf.groupBy("file", "at").agg(F.sum("length").alias("length"), F.unhex(F.sha2(mark, 256)).alias("hash")))]
    places = per_file
    while places > 1:
        up = levels[-1].groupBy("file", F.floor(F.col("at") / fanout).alias("up")).agg(F.sort_array(F.collect_list(F.struct("at", "length", "hash"))).alias("c"), F.sum("length").alias("length"))
        mark = F.concat_ws("", F.transform("c", lambda c: F.concat_ws(":", c["at"], c["length"], F.hex(c["hash"]))))
        levels.append(cut(up.select("file", F.col("up").alias("at"), "length", F.unhex(F.sha2(mark, 256)).alias("hash"))))
        places = -(-places // fanout)
    return levels


def audit(ours: DataFrame, theirs: DataFrame, per_file: int = FILE_RECORDS, fanout: int = FANOUT) -> DataFrame:
    """Ids whose records differ between two replicas' leaves: record_id, file, at, start, length, ours, theirs, status.

    Roots are compared first; level by level only the children of nodes that differ are read and compared, so a
    sound replica ends at its roots. ours and theirs count the records that the other replica lacks, digest by digest;
    status: missing (theirs is 0), extra (ours is 0) or changed. start: where the id's records begin in our file, or
    in theirs if we have none; length: bytes of our differing records, of theirs if extra. Repeated rows and ids count
    each; null ids give a row for each place of file -1. Two empty replicas have no difference.
    """
    a, b = tree(ours, per_file, fanout), tree(theirs, per_file, fanout)
    bad = None
    for k in range(len(a) - 1, -1, -1):
        one, two = a[k], b[k]
        if bad is not None:
            one, two = (x.withColumn("up", F.floor(F.col("at") / fanout)).join(bad, ["file", "up"], "left_semi") for x in (one, two))
        met = one.select("file", "at", F.col("hash").alias("one")).join(two.select("file", "at", F.col("hash").alias("two")), ["file", "at"], "full")
        bad = cut(met.filter(~F.col("one").eqNullSafe(F.col("two"))).select("file", F.col("at").alias("up")))
    bad = bad.withColumnRenamed("up", "at")
    sides = ours.withColumn("side", F.lit(1)).unionByName(theirs.withColumn("side", F.lit(-1))).join(bad, ["file", "at"], "left_semi")
    left = sides.groupBy("file", "at", "record_id", "length", "hash").agg(F.sum("side").alias("more")).filter("more <> 0")
    more, size = F.col("more"), F.col("more") * F.col("length")
    ids = left.groupBy("file", "at", "record_id").agg(
        F.sum(F.greatest(more, F.lit(0))).alias("ours"), F.sum(F.greatest(-more, F.lit(0))).alias("theirs"), F.sum(F.greatest(size, F.lit(0))).alias("mine"), F.sum(F.greatest(-size, F.lit(0))).alias("other"),
    )
    files = bad.select("file").distinct()
    before = F.coalesce(F.sum("length").over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a file has per_file places at most
    for name, level in (("x", a[0]), ("y", b[0])):
        ids = ids.join(level.join(files, "file", "left_semi").select("file", "at", before.alias(name)), ["file", "at"], "left")
    status = F.when(F.col("theirs") == 0, "missing").when(F.col("ours") == 0, "extra").otherwise("changed")
    return ids.select("record_id", "file", "at", F.coalesce("x", "y").alias("start"), F.when(F.col("ours") > 0, F.col("mine")).otherwise(F.col("other")).alias("length"), "ours", "theirs", status.alias("status"))


def damaged(pages: DataFrame) -> DataFrame:
    """The replica that op8 audits: a copy in which storage has overwritten the first byte of some bodies, lost other
    records, and holds some once more with a body that is one byte longer."""
    mark = F.substring(F.md5(F.col("page_id").cast("string").cast("binary")), 1, 2)
    hit = (mark < "03") & (F.length("html") > 0)
    held = pages.withColumn("html", F.when(hit, F.overlay("html", F.lit("?"), 1, 1)).otherwise(F.col("html"))).filter(F.coalesce(mark != "03", F.lit(True)))
    return held.union(pages.filter(mark == "04").withColumn("html", F.concat(F.coalesce("html", F.lit("")), F.lit("!"))))


def op8_merkle_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = audit(cut(leaves(records(pages))), cut(leaves(records(damaged(pages)))))
    return found.select(F.col("record_id").alias("page_id"), "file", F.col("at").alias("position"), F.col("start").alias("start_byte"), F.col("length").alias("n_bytes"), "ours", "theirs", "status")


QUERIES = {"op8_merkle_audit": op8_merkle_audit}
ORACLES = {
    "op8_merkle_audit": r"""
WITH h AS (
  SELECT page_id, coalesce(html, '') AS html, substr(md5(CAST(page_id AS VARCHAR)), 1, 2) AS mark,
         CAST(floor(page_id / 1000) AS BIGINT) AS file,
         'WARC/1.0' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Target-URI: ' ||
         coalesce(url, '') || chr(13) || chr(10) || 'Content-Length: ' AS head
  FROM pages),
r AS (
  SELECT page_id, file, mark, html,
         strlen(head) + strlen(CAST(strlen(html) AS VARCHAR)) + strlen(html) + 8 AS size,
         strlen(head) + strlen(CAST(strlen(html) + 1 AS VARCHAR)) + strlen(html) + 9 AS longer
  FROM h),
p AS (
  SELECT *, CAST(coalesce(sum(size) OVER (PARTITION BY file ORDER BY page_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start_byte
  FROM r)
SELECT page_id, file, page_id % 1000 AS position, start_byte, CAST(CASE WHEN mark = '04' THEN longer ELSE size END AS BIGINT) AS n_bytes,
       CAST(CASE WHEN mark = '04' THEN 0 ELSE 1 END AS BIGINT) AS ours, CAST(CASE WHEN mark = '03' THEN 0 ELSE 1 END AS BIGINT) AS theirs,
       CASE WHEN mark = '03' THEN 'missing' WHEN mark = '04' THEN 'extra' ELSE 'changed' END AS status
FROM p WHERE mark IN ('03', '04') OR (mark < '03' AND length(html) > 0)"""
}
