"""Readers: JSON lines, JSON documents, CSV, line lists, archives, checksum files.

All read through Spark, so any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from relata.functions.variants import is_object, with_variant
from relata.sources.files import file_hashes, file_sizes, numbered_lines


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = True, missing_ok: bool = False, non_empty: bool = False, expected_rows: int | None = None) -> DataFrame:
    """One object per line; blank lines are skipped.  A line that is no object is an error if strict, else a row of nulls."""
    kind = T.StructType.fromDDL(schema)
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], kind)
    rows = spark.read.schema(kind).option("mode", "FAILFAST" if strict else "PERMISSIVE").json(path)
    if non_empty and rows.isEmpty():
        raise ValueError(f"{path} has no rows")
    if expected_rows is not None and (n := rows.count()) != expected_rows:
        raise ValueError(f"{path} has {n} rows; expected {expected_rows}")
    return rows


def json_lines_with_numbers(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Fields and line_number; ``valid`` is false where a line is no JSON object."""
    lines = numbered_lines(spark, path).filter(F.col("line").rlike(r"\S"))
    parsed = lines.withColumn("row", F.from_json("line", T.StructType.fromDDL(schema), {"mode": "PERMISSIVE"}))
    document = F.schema_of_variant(F.try_parse_json("line"))
    return parsed.select("line_number", F.coalesce(F.startswith(document, F.lit("OBJECT")), F.lit(False)).alias("valid"), "row.*")


def json_variant_lines(spark: SparkSession, path: str, expected_rows: int | None = None) -> DataFrame:
    """(path, line_number, line, value) of the lines that are not blank: the line as it was written and its value as a VARIANT.

    With ``expected_rows`` another number of lines is an error, and so is a line that is no object.
    """
    lines = numbered_lines(spark, path).filter(F.col("line").rlike(r"\S")).withColumn("line", F.regexp_replace("line", "\r$", ""))
    rows = with_variant(lines)
    if expected_rows is not None:
        n, others, first = rows.agg(F.count("*"), F.count_if(~is_object(F.col("value"))), F.min(F.when(~is_object(F.col("value")), F.struct("path", "line_number")))).first()
        if n != expected_rows:
            raise ValueError(f"{path} has {n} rows; expected {expected_rows}")
        if others:
            raise ValueError(f"{first['path']}, line {first['line_number']}: no object")
    return rows


def json_document(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One row for each file whose root is an object."""
    reader = spark.read.option("multiLine", True).option("mode", "FAILFAST")
    return (reader.schema(T.StructType.fromDDL(schema)) if schema else reader).json(path)


def csv_table(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header; every field is text."""
    return spark.read.option("header", True).csv(path)


def digit_list(spark: SparkSession, path: str, column: str = "capture_id") -> DataFrame:
    """Identifiers, one a line: trimmed, blank lines dropped.  Anything but digits, or a repeat, is an error."""
    ids = spark.read.text(path).select(F.trim("value").alias(column)).filter(F.col(column) != "")
    bad = ids.filter(~F.col(column).rlike("^[0-9]+$")).limit(1).collect()
    again = ids.groupBy(column).count().filter("count > 1").limit(1).collect()
    if bad or again:
        raise ValueError(f"{path}: {'not an identifier: ' + bad[0][0] if bad else 'repeated: ' + again[0][0]}")
    return ids


def url_list(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    """(capture_id, url): the pattern must match whole lines, its first group is the id; ids and URLs must be unique."""
    urls = spark.read.text(path).select(F.trim("value").alias("url")).filter("url <> ''")
    found = urls.select(F.regexp_extract("url", f"^(?:{pattern})$", 1).alias("capture_id"), "url")
    for bad, what in ((found.filter("capture_id = ''"), "does not fit"), (found.groupBy("capture_id").agg(F.min("url").alias("url"), F.count("*").alias("n")).filter("n > 1"), "has a repeated id")):
        if row := bad.limit(1).collect():
            raise ValueError(f"{path}: {row[0]['url']} {what}")
    return found


def checksum_list(spark: SparkSession, path: str) -> DataFrame:
    """(sha256, path) of lines of digest, two spaces, path."""
    lines = spark.read.text(path).filter(F.trim("value") != "")
    return lines.select(F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", 1).alias("sha256"), F.regexp_extract("value", r"^([0-9a-f]{64})  (.+)$", 2).alias("path"))


def file_table(spark: SparkSession, path: str, recursive: bool = True) -> DataFrame:
    """(path, size_bytes, sha256) of files of any size."""
    return file_hashes(file_sizes(spark, path, recursive))


def checksum_violations(listed: DataFrame, files: DataFrame, root: str) -> DataFrame:
    """Listed files that are not there or differ."""
    own = files.select(F.regexp_replace("path", F.lit(r"^file:/+"), F.lit("/")).alias("full"), F.col("sha256").alias("found"))
    want = listed.withColumn("full", F.concat(F.lit(root.removeprefix("file://").rstrip("/") + "/"), "path"))
    return want.join(own, "full", "left").filter("found is null or found <> sha256").select("path", F.when(F.col("found").isNull(), "missing").otherwise("differs").alias("rule"))


def member_violations(members: DataFrame, first: str = "instances.json", second: str = "image.png") -> DataFrame:
    """(archive, folder, rule) of the folders that hold one of two members without the other."""
    named = members.select("archive", F.regexp_extract("member", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("member", r"([^/]+)$", 1).alias("name"))
    has = named.groupBy("archive", "folder").agg(F.count_if(F.col("name") == first).alias("a"), F.count_if(F.col("name") == second).alias("b"))
    rule = F.when((F.col("a") == 0) & (F.col("b") > 0), F.lit(f"missing {first}")).when((F.col("a") > 0) & (F.col("b") == 0), F.lit(f"missing {second}"))
    return has.select("archive", "folder", rule.alias("rule")).filter("rule is not null")


def archive_frames(members: DataFrame, schema: T.DataType, capture_pattern: str = r"(\d+)\.tar$") -> DataFrame:
    """Frames of archives: folders that hold both members, numbered by name within their capture; ``member_violations`` tells the others.

    Columns: archive, capture_id, frame_index, image_member, instance_member, image, instances.
    """
    split = members.select("archive", "content", "member", F.regexp_extract("member", r"^(.*)/[^/]+$", 1).alias("folder"), F.regexp_extract("member", r"([^/]+)$", 1).alias("name"))
    side = lambda name, prefix: split.filter(F.col("name") == name).select("archive", "folder", F.col("member").alias(f"{prefix}_member"), F.col("content").alias(prefix))
    both = side("instances.json", "instance").join(side("image.png", "image"), ["archive", "folder"])
    from relata.operators.audit import frame_index

    named = both.withColumn("capture_id", F.regexp_extract("archive", capture_pattern, 1))
    return frame_index(named, "archive", ("instance_member",)).select("archive", "capture_id", "frame_index", "image_member", "instance_member", "image", F.from_json(F.col("instance").cast("string"), schema).alias("instances"))
