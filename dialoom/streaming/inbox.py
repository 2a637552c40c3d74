"""An inbox of JSON documents, drained into a state table keyed by id.

A document counts as new when the hash of its bytes differs from the one in state; of several versions of an id the one
written last counts. State is kept in buckets by id. A drain writes the buckets it touches beside the old ones, which stay
current until the write is committed, so a failed or repeated batch changes nothing; then buckets that no reader needs any
more are taken away.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.schemas import CORRUPT, RAW

STATE = "id STRING, content_sha STRING, versions INT, n_messages INT, n_turns INT, corrupt BOOLEAN, bucket INT"
#: Buckets of the state; a batch rewrites those its ids fall into.
BUCKETS = 64


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _committed(spark: SparkSession, path: str) -> dict[int, list[int]]:
    """Buckets of each committed version, latest first."""
    p, fs = _path(spark, path)
    if not fs.exists(p):
        return {}
    found = {}
    for s in fs.listStatus(p):
        name = s.getPath().getName()
        if name.startswith("v") and fs.exists(_path(spark, f"{path}/{name}/_SUCCESS")[0]):
            inside = [x.getPath().getName() for x in fs.listStatus(s.getPath())]
            found[int(name[1:])] = [int(n.split("=")[1]) for n in inside if n.startswith("bucket=")]
    return dict(sorted(found.items(), reverse=True))


def current_version(spark: SparkSession, path: str) -> int:
    """The highest version whose write was committed; -1 before the first."""
    return max(_committed(spark, path), default=-1)


def _current(spark: SparkSession, path: str) -> dict[int, int]:
    """The version in which each bucket is current."""
    at: dict[int, int] = {}
    for v, buckets in _committed(spark, path).items():
        for b in buckets:
            at.setdefault(b, v)
    return at


def read_state(spark: SparkSession, path: str, buckets: list[int] | None = None) -> DataFrame:
    """The current state, or that of some buckets; empty before the first drain."""
    paths = [f"{path}/v{v}/bucket={b}" for b, v in _current(spark, path).items() if buckets is None or b in buckets]
    if not paths:
        return spark.createDataFrame([], STATE)
    rows = spark.read.schema(STATE.removesuffix(", bucket INT")).parquet(*paths)
    return rows.withColumn("bucket", bucket_of("id"))


def bucket_of(c: str):
    return F.pmod(F.xxhash64(c), F.lit(BUCKETS)).cast("int")


def upsert(state: DataFrame, arrived: DataFrame) -> DataFrame:
    """State after documents(id, modified, file_name, content_sha, n_messages, n_turns, corrupt) arrived.

    Of those with one id the last by modified, then file_name, counts. Unchanged content changes nothing.
    """
    new = arrived.groupBy("id").agg(F.max(F.struct("modified", "file_name", "content_sha", "n_messages", "n_turns", "corrupt")).alias("n"))
    j = state.join(new, "id", "full_outer")
    changed = F.col("n").isNotNull() & ~F.col("n.content_sha").eqNullSafe(F.col("content_sha"))
    pick = lambda c: F.when(changed, F.col(f"n.{c}")).otherwise(F.col(c)).alias(c)
    versions = (F.coalesce("versions", F.lit(0)) + changed.cast("int")).alias("versions")
    return j.select("id", pick("content_sha"), versions, pick("n_messages"), pick("n_turns"), pick("corrupt"), bucket_of("id").alias("bucket"))


def documents_of(files: DataFrame) -> DataFrame:
    """Documents of files(path, modificationTime, content); what is no JSON document is kept as corrupt under its file's name."""
    name = F.element_at(F.split("path", "/"), -1)
    doc = F.from_json(F.col("content").cast("string"), f"{RAW}, {CORRUPT} STRING", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT})
    d = files.select(name.alias("file_name"), F.col("modificationTime").alias("modified"), F.left(F.sha2("content", 256), F.lit(16)).alias("content_sha"), doc.alias("d"))
    return d.select(
        F.coalesce("d.id", F.regexp_replace("file_name", r"\.json$", "")).alias("id"), "modified", "file_name", "content_sha",
        F.when(F.col("d.messages").isNull(), 0).otherwise(F.size("d.messages")).alias("n_messages"),
        F.when(F.col("d.turns").isNull(), 0).otherwise(F.size("d.turns")).alias("n_turns"),
        (F.col("d").isNull() | F.col(f"d.{CORRUPT}").isNotNull()).alias("corrupt"),
    )


def _retire(spark: SparkSession, path: str) -> None:
    """Takes away versions of which no bucket is current, but for the one before the latest, which readers may hold."""
    needed = set(_current(spark, path).values())
    done = list(_committed(spark, path))
    for v in done[2:]:
        if v not in needed:
            p, fs = _path(spark, f"{path}/v{v}")
            fs.delete(p, True)


def drain(spark: SparkSession, inbox: str, state: str, checkpoint: str, files_per_batch: int = 1000) -> None:
    """Takes in every document that has landed since the last drain, in micro-batches, and stops."""
    stream = (
        spark.readStream.format("binaryFile").schema("path STRING, modificationTime TIMESTAMP, length BIGINT, content BINARY")
        .option("pathGlobFilter", "*.json").option("maxFilesPerTrigger", files_per_batch).load(inbox)
    )

    def batch(df: DataFrame, _: int) -> None:
        docs = documents_of(df)
        touched = [r[0] for r in docs.select(bucket_of("id")).distinct().collect()]  # at most BUCKETS
        after = upsert(read_state(spark, state, touched), docs)
        after.write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/v{current_version(spark, state) + 1}")
        _retire(spark, state)

    stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
