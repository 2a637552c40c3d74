"""Readers for JSON lines, folders of JSON documents, whole files, keyed tables and plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.schemas import CORRUPT


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def jsonl(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One record a line; blank lines give none, unreadable ones a row with only the corrupt text. A missing path fails."""
    return (
        spark.read.schema(f"{schema}, {CORRUPT} STRING").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)
    )


def documents(spark: SparkSession, path: str, schema: str, pattern: str = "*.json") -> DataFrame:
    """One record a file, with its name; pattern restricts the names."""
    read = spark.read.schema(f"{schema}, {CORRUPT} STRING").option("multiLine", True).option("mode", "PERMISSIVE")
    return read.option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", pattern).json(path).withColumn(
        "file_name", F.col("_metadata.file_name")
    )


def in_name_order(docs: DataFrame) -> DataFrame:
    """Documents in the order of their files' names."""
    return docs.orderBy("file_name")


def verdict_cache(spark: SparkSession, path: str) -> DataFrame:
    """(verdict_key, leak, reason) of a stored cache {key: {leak, reason}}, which may be several files.

    A file that cannot be read is moved aside as *.corrupt and counts as empty; so does a missing path.
    """
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return spark.createDataFrame([], "verdict_key string, leak boolean, reason string")
    text = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    doc = text.select("file", F.from_json("value", "map<string, struct<leak: boolean, reason: string>>", {"mode": "PERMISSIVE"}).alias("m"))
    for r in doc.filter("m is null").select("file").collect():  # as many rows as broken files
        broken = spark._jvm.org.apache.hadoop.fs.Path(r["file"])
        fs.rename(broken, broken.suffix(".corrupt"))
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True) if fs.exists(p) else text.limit(0)
    m = rows.select(F.explode(F.from_json("value", "map<string, struct<leak: boolean, reason: string>>")).alias("verdict_key", "v"))
    return m.select("verdict_key", "v.leak", "v.reason")


def file_hashes(spark: SparkSession, path: str, pattern: str = "*", prefix: int = 16) -> DataFrame:
    """(file_name, sha): the first hexadecimal digits of the content's SHA-256."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    return files.select(F.col("_metadata.file_name").alias("file_name"), F.left(F.sha2("content", 256), F.lit(prefix)).alias("sha"))


def plan_counts(spark: SparkSession, path: str, field: str) -> DataFrame:
    """(category, n) of a JSON plan {field: {category: n}}."""
    text = spark.read.text(path, wholetext=True)
    return text.select(F.explode(F.from_json("value", f"{field} MAP<STRING, INT>")[field]).alias("category", "n"))


def last_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest `order` of each key; by aggregate."""
    others = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.max(F.struct(order, *others)).alias("__l")).select(key, *[F.col(f"__l.{c}").alias(c) for c in (order, *others)])


def checkpoints(names: DataFrame, column: str = "name") -> DataFrame:
    """Names in the order of their trailing number; those without one come first."""
    n = F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(column, r"(\d+)$", 1), F.lit("")), F.lit("9999999999")), F.lit(-1)).cast("bigint")
    return names.withColumn("step", n).orderBy("step", column)
