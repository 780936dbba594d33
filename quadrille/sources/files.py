"""Readers and writers of the point, line, descriptor and metadata files; every file of a directory is a set."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

NAME = "_metadata.file_name"


def _tokens(text: Column) -> Column:
    return F.filter(F.split(text, r"\s+"), lambda t: t != "")


def _double(t: Column) -> Column:
    return t.try_cast("double")


def read_gcp_text(spark: SparkSession, path: str) -> DataFrame:
    """set_id, point_id, x, y, gx, gy, hgt, corrupt of lines `id x y gx gy hgt`; a bad line stands in corrupt."""
    lines = spark.read.text(path).select(F.col(NAME).alias("set_id"), "value").filter(F.trim("value") != "")
    t = lines.withColumn("t", _tokens(F.col("value")))
    names = ("x", "y", "gx", "gy", "hgt")
    v = t.select("set_id", "value", "t", *[_double(F.get("t", F.lit(i + 1))).alias(c) for i, c in enumerate(names)])
    good = (F.size("t") == 6) & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("gx").isNotNull() & F.col("gy").isNotNull() & F.col("hgt").isNotNull()
    return v.select("set_id", F.when(good, F.col("t")[0]).alias("point_id"), *[F.when(good, F.col(c)).alias(c) for c in names], F.when(~good, F.col("value")).alias("corrupt"))


def write_gcp(points: DataFrame, path: str, append: bool = False, folders: bool = True) -> None:
    """Points as Parquet, a folder for each set; append adds to sets that are there.

    Without folders, for many sets: sets share files, which hold them in order, so that a reader of one skips most.
    """
    rows = points.write.partitionBy("set_id") if folders else points.sortWithinPartitions("set_id").write
    rows.mode("append" if append else "overwrite").parquet(path)


def read_tiepoint_xml(spark: SparkSession, path: str) -> DataFrame:
    """gx, gy, gz, x, y, score: a row for each SimpleTiePoint."""
    point = "struct<`gml:Point`:struct<`gml:coord`:struct<X:double,Y:double,Z:double>>>"
    rows = spark.read.format("xml").option("rowTag", "SimpleTiePoint").schema(f"ground {point}, image {point}, score double").load(path)
    g, i = "ground.`gml:Point`.`gml:coord`", "image.`gml:Point`.`gml:coord`"
    return rows.select(F.col(f"{g}.X").alias("gx"), F.col(f"{g}.Y").alias("gy"), F.col(f"{g}.Z").alias("gz"), F.col(f"{i}.X").alias("x"), F.col(f"{i}.Y").alias("y"), "score")


def write_tiepoint_xml(points: DataFrame, path: str, per_file: int = 20_000) -> None:
    """Points (gx, gy, gz, x, y, score) as files of TiePointSets, `per_file` in each, whatever sets they come from."""

    def text(tag: str, c: str) -> Column:
        return F.coalesce(F.concat(F.lit(f"<{tag}>"), F.col(c).cast("string"), F.lit(f"</{tag}>")), F.lit(""))  # a null has no element

    def coord(tag: str, **named: str) -> Column:
        inner = [text(n, c) for n, c in named.items()]
        return F.concat(F.lit(f"<{tag}><gml:Point><gml:coord>"), *inner, F.lit(f"</gml:coord></gml:Point></{tag}>"))

    point = F.concat(F.lit("<SimpleTiePoint>"), coord("ground", X="gx", Y="gy", Z="gz"), coord("image", X="x", Y="y"), text("score", "score"), F.lit("</SimpleTiePoint>"))

    def documents(batches):
        import pandas as pd

        def whole(lines):
            head = '<?xml version="1.0"?>\n<TiePointSet xmlns:gml="http://www.opengis.net/gml">'
            return pd.DataFrame({"value": ["\n".join([head, *lines, "</TiePointSet>"])]})

        held = []
        for pdf in batches:
            held += pdf["value"].tolist()
            while len(held) >= per_file:
                yield whole(held[:per_file])
                held = held[per_file:]
        if held:
            yield whole(held)

    points.select(point.alias("value")).mapInPandas(documents, "value string").write.option("maxRecordsPerFile", 1).text(path)


def read_tiepoint_header(spark: SparkSession, path: str) -> DataFrame:
    """set_id, master, slave: the image paths that the head of each tie-point file names; null where it names none."""
    t = spark.read.text(path).select(F.col(NAME).alias("set_id"), "value")
    names = {"master": "MasterPath", "slave": "SlavePath"}
    return t.groupBy("set_id").agg(*[F.max(F.nullif(F.trim(F.regexp_extract("value", f"<{tag}>([^<]*)</{tag}>", 1)), F.lit(""))).alias(n) for n, tag in names.items()])


def read_line_features(spark: SparkSession, path: str) -> DataFrame:
    """set_id, id, type, points: records `id type n` and n coordinate lines. A record is one row from the start on."""
    files = spark.read.text(path, wholetext=True).select(F.col(NAME).alias("set_id"), "value")
    record = r"(?m)^[ \t]*\S+[ \t]+[A-Za-z]\S*[ \t]+\d+[ \t]*$(?:\r?\n[ \t]*[-+.\d][-+.\deE]*[ \t]+[-+.\d][-+.\deE]*[ \t]*$)*"
    r = files.select("set_id", F.explode(F.regexp_extract_all("value", F.lit(record), F.lit(0))).alias("r")).withColumn("t", _tokens(F.col("r")))
    n = F.col("t")[2].cast("int")
    pts = F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(_double(F.get("t", 3 + 2 * i)).alias("x"), _double(F.get("t", 4 + 2 * i)).alias("y"))))
    return r.select("set_id", F.col("t")[0].alias("id"), F.col("t")[1].alias("type"), F.coalesce(pts, F.array().cast("array<struct<x:double,y:double>>")).alias("points"))


def write_line_features(features: DataFrame, path: str) -> None:
    """Records as read_line_features reads them, one text row each."""
    lines = F.transform("points", lambda p: F.concat_ws("\t", p["x"].cast("string"), p["y"].cast("string")))
    head = F.concat_ws("\t", "id", "type", F.size("points").cast("string"))
    features.select(F.concat_ws("\n", F.concat(F.array(head), lines)).alias("value")).write.mode("overwrite").text(path)


def read_descriptor_files(spark: SparkSession, path: str, layout: str = "affine", most: int = 128) -> DataFrame:
    """image_id, kp_id, x, y, shape, descr, corrupt. affine: header `d n`, rows `x y a b c` + d values; scale: header
    `n d`, rows `y x scale orientation` + d values. A file whose header or length is wrong, or whose d is over `most`,
    is one row that has its header in corrupt; a value that is no number is null; an empty file gives
    no row.
    """
    t = spark.read.text(path, wholetext=True).select(F.col(NAME).alias("image_id"), _tokens(F.col("value")).alias("t"))
    first, second = F.get("t", F.lit(0)).try_cast("int"), F.get("t", F.lit(1)).try_cast("int")
    lead = 5 if layout == "affine" else 4
    t = t.select("image_id", "t", (first if layout == "affine" else second).alias("d"), (second if layout == "affine" else first).alias("n"))
    wide = F.col("n").cast("long") * (F.col("d") + lead) + 2
    good = F.coalesce(F.col("d").between(0, most) & (F.col("n") > 0) & (F.size("t") == wide), F.lit(False))
    r = t.select("image_id", "t", good.alias("good"), F.when(good, F.col("d")).otherwise(0).alias("d"), F.explode(F.when(good, F.sequence(F.lit(0), F.col("n") - 1)).otherwise(F.array(F.lit(0)))).alias("kp_id"))
    at = 3 + F.col("kp_id") * (F.col("d") + lead)
    v = r.withColumn("v", F.transform(F.slice("t", at, F.col("d") + lead), _double))
    x, y = (0, 1) if layout == "affine" else (1, 0)
    named = {"kp_id": F.col("kp_id"), "x": F.get("v", F.lit(x)), "y": F.get("v", F.lit(y)), "shape": F.slice("v", 3, lead - 2), "descr": F.slice("v", lead + 1, F.size("v"))}
    return v.select("image_id", *[F.when(F.col("good"), c).alias(n) for n, c in named.items()], F.when(~F.col("good"), F.concat_ws(" ", F.slice("t", 1, 2))).alias("corrupt"))


def list_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """path, length, modificationTime of the files below a folder whose names fit; contents are not read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path).select("path", "length", "modificationTime")


def read_keyword_list(spark: SparkSession, path: str, prefixed: bool = False) -> DataFrame:
    """set_id and the map of its `key: value` lines; of a repeated key the greatest value stays.

    prefixed: a file holds many lists, of lines `prefix.key: value`; prefix is a column then, null for keys without one.
    """
    t = spark.read.text(path).select(F.col(NAME).alias("set_id"), F.split("value", ":", 2).alias("p")).filter(F.size("p") == 2)
    k = F.trim(F.col("p")[0])
    names = {"prefix": F.nullif(F.regexp_extract(k, r"^([^.]*)\.", 1), F.lit("")), "k": F.regexp_replace(k, r"^[^.]+\.", "")} if prefixed else {"k": k}
    of = ["set_id", *list(names)[:-1]]
    kv = t.groupBy("set_id", *[c.alias(n) for n, c in names.items()]).agg(F.max(F.trim(F.col("p")[1])).alias("v"))
    return kv.groupBy(*of).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("keys"))
