"""Building blocks for plans that must hold under skew: lineage cuts, salted joins, two-level ranks and prefix sums."""

from __future__ import annotations

import os
import tempfile
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: Rows of one key beyond which a join spreads the key over several tasks.
HOT_ROWS = 200_000
#: Hash buckets a group is divided into before ranking; one task sees about group/BUCKETS rows.
BUCKETS = 1024
#: Rows that may be broadcast when they were counted first.
BROADCAST_ROWS = 500_000


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster; a folder of our own only where none is set, as in tests."""
    sc = spark.sparkContext
    now = sc._jsc.sc().getCheckpointDir()
    if now.isDefined():
        return now.get()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = os.path.join(tempfile.gettempdir(), f"dialoom-{os.getpid()}")
    sc.setCheckpointDir(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Writes df to the shared checkpoint folder and continues from there; survives the loss of executors."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def spread(df: DataFrame, key: str) -> DataFrame:
    """df over all cores by the hash of key, if a file of few row groups would leave most of them idle; else as it is.

    For work per row that costs far more than moving the row. Tables of as many parts as cores are never moved.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() * 2 <= cores else df


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(key, parts) for keys with more than hot_rows rows: at most rows/hot_rows of them, so small by construction."""
    return (
        df.groupBy(key).count().filter((F.col("count") > hot_rows) & F.col(key).isNotNull())
        .select(key, F.ceil(F.col("count") / hot_rows).cast("int").alias("parts"))
    )


def salted_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", hot_rows: int = HOT_ROWS, rows: int | None = None) -> DataFrame:
    """Equi-join on `key` where left may hold hot keys and right has few rows a key.

    Rows of a hot key are spread over ceil(rows/hot_rows) salts; the right rows of that key are copied to each salt.
    how: inner, left, left_semi or left_anti. Null keys match nothing. rows: the size of left where it is known.
    """
    if rows is not None and rows <= hot_rows:
        return left.join(right, key, how)
    hot = [(r[0], r[1]) for r in hot_keys(left, key, hot_rows).collect()]
    if not hot:
        return left.join(right, key, how)
    spark = left.sparkSession
    parts = F.broadcast(spark.createDataFrame(hot, f"{key} {dict(left.dtypes)[key]}, __parts int"))
    row = [c for c in left.columns if c != key]
    lhs = left.join(parts, key, "left").withColumn(
        "__salt", F.pmod(F.xxhash64(*(row or [key])) if row else F.lit(0).cast("bigint"), F.coalesce("__parts", F.lit(1))).cast("int")
    ).drop("__parts")
    rhs = right.join(parts, key, "left").withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__parts", F.lit(1)) - 1))
    ).drop("__parts")
    return lhs.join(rhs, [key, "__salt"], how).drop("__salt")


def counted_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint when `rows`, its counted size, is within the limit; else as it is, for a shuffled join."""
    return F.broadcast(df) if rows <= limit else df


def ranked(df: DataFrame, group: list[str], order: list[Column], into: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds `into`: the 1-based rank of a row within its group in the order of (hash of the order columns, the columns).

    A permuted dense rank: groups of any size are divided into hash buckets, ranked within the bucket, and shifted by the
    rows in the group's earlier buckets, so that no task holds a whole group. The order columns must identify a row.
    """
    return prefix_sum(df, group, order, F.lit(1).cast("bigint"), into, buckets)


def prefix_sum(
    df: DataFrame, group: list[str], order: list[Column], value: Column, into: str, buckets: int = BUCKETS
) -> DataFrame:
    """Adds `into`: the running sum of value (integral) within the group in permuted order, this row included."""
    b = df.withColumn("__h", F.xxhash64(*order)).withColumn("__v", value).withColumn(
        "__b", F.shiftrightunsigned("__h", 64 - (buckets - 1).bit_length()).cast("int")
    )
    sums = b.groupBy(*group, "__b").agg(F.sum("__v").alias("__s"))
    earlier = W.partitionBy(*group) if group else W.partitionBy(F.lit(0))
    # At most `buckets` rows of a group are left here.
    before = F.sum("__s").over(earlier.orderBy("__b").rowsBetween(W.unboundedPreceding, -1))
    names = [f"__g{i}" for i in range(len(group))]
    start = sums.select(
        *[F.col(g).alias(n) for g, n in zip(group, names)], F.col("__b").alias("__b2"), F.coalesce(before, F.lit(0)).alias("__start")
    )
    inner = W.partitionBy(*group, "__b").orderBy("__h", *order).rowsBetween(W.unboundedPreceding, W.currentRow)
    own = b.withColumn("__own", F.sum("__v").over(inner))
    on = reduce(and_, [F.col(g).eqNullSafe(F.col(n)) for g, n in zip(group, names)], F.col("__b") == F.col("__b2"))
    return own.join(start, on, "inner").select(*df.columns, (F.col("__own") + F.col("__start")).alias(into))
