"""Assembly: targets, range allocation along a seeded permutation, nested rungs, numbering, first-wins dedup."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.operators.scale import cut, ranked, salted_join

# Category shares in their order, and the sizes of nested training sets.
MIX = {"howto": 0.30, "factual": 0.20, "emotional": 0.15, "meta": 0.15, "math": 0.10, "smalltalk": 0.10}
LADDER = (125, 250, 500, 1000, 2000, 2500, 5000)


def targets(spark: SparkSession, sizes: dict[str, int], headroom: dict[str, float], extra: int) -> DataFrame:
    """(split, category, target): ceil(ceil(size * share) * headroom) + extra, in doubles."""
    rows = [(s, c, math.ceil(math.ceil(n * f) * headroom[s]) + extra) for s, n in sizes.items() for c, f in MIX.items()]
    return spark.createDataFrame(rows, "split string, category string, target int")


def shuffled(df: DataFrame, by: list[str], key: str, seed: str, into: str = "rn") -> DataFrame:
    """Rank of each row in its group along the order of md5(key | seed), ties by key; the key must be unique in its group.

    Ranks are two-level: rows are counted by the first three digits of the md5, so that a group may be of any size.
    """
    d = df.withColumn("__md5", F.md5(F.concat(F.col(key), F.lit(seed))))
    from pyspark.sql.window import Window as W

    d = d.withColumn("__b", F.left("__md5", F.lit(3)))
    names = [f"__g{i}" for i in range(len(by))]
    sums = d.groupBy(*by, "__b").count()
    start = F.coalesce(F.sum("count").over(W.partitionBy(*by).orderBy("__b").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = sums.select(*[F.col(c).alias(n) for c, n in zip(by, names)], F.col("__b").alias("__b2"), start.alias("__start"))
    own = F.row_number().over(W.partitionBy(*by, "__b").orderBy("__md5", key))
    d = d.withColumn("__own", own)
    on = F.col("__b") == F.col("__b2")
    for c, n in zip(by, names):
        on = on & F.col(c).eqNullSafe(F.col(n))
    return d.join(starts, on).select(*df.columns, (F.col("__own") + F.col("__start")).alias(into))


def range_allocation(pool: DataFrame, wanted: DataFrame, order: list[str]) -> DataFrame:
    """Gives the ranked pool(category, rn, ...) of each category to the splits in consecutive ranges of their targets."""
    from pyspark.sql.window import Window as W

    at = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("split"))
    upto = F.sum("target").over(W.partitionBy("category").orderBy(at).rowsBetween(W.unboundedPreceding, W.currentRow))
    spans = wanted.withColumn("high", upto).withColumn("low", F.col("high") - F.col("target")).select("category", "split", "low", "high")
    # A row a (category, split).
    return pool.join(F.broadcast(spans), "category").filter((F.col("rn") > F.col("low")) & (F.col("rn") <= F.col("high"))).drop("low", "high")


def preceding(pool: DataFrame, group: str, last: int, block: int = 5000) -> DataFrame:
    """Adds max_before and n_before to the ranked pool(id, group, idx, rn): of idx over the last `last` ranks before, and their number.

    The window runs in blocks of ranks, so that no task holds a group; each block also gets the last rows of the one before it.
    """
    from pyspark.sql.window import Window as W

    if last > block:
        raise ValueError("a block must hold the rows before")
    own = F.floor((F.col("rn") - 1) / block)
    # The last rows of a block are copied to the next as context.
    lent = F.when((F.col("rn") - 1) % block >= block - last, F.array(own, own + 1)).otherwise(F.array(own))
    w = W.partitionBy(group, "__block").orderBy("rn").rowsBetween(-last, -1)
    b = pool.withColumn("__block", F.explode(lent)).withColumns({"max_before": F.max("idx").over(w), "n_before": F.count("*").over(w)})
    return b.filter(F.col("__block") == own).drop("__block")


def preceding_list(pool: DataFrame, group: str, value: str, last: int, keep: int, block: int = 5000) -> DataFrame:
    """Adds `before` to the ranked pool(group, value, rn): the last `keep` values of the `last` ranks before; nulls are left out.

    In blocks of ranks as in `preceding`.
    """
    from pyspark.sql.window import Window as W

    if last > block:
        raise ValueError("a block must hold the rows before")
    own = F.floor((F.col("rn") - 1) / block)
    lent = F.when((F.col("rn") - 1) % block >= block - last, F.array(own, own + 1)).otherwise(F.array(own))
    w = W.partitionBy(group, "__block").orderBy("rn").rowsBetween(-last, -1)
    b = pool.withColumn("__block", F.explode(lent)).withColumn("__all", F.collect_list(value).over(w))
    b = b.filter(F.col("__block") == own)
    return b.withColumn("before", F.slice("__all", F.greatest(F.lit(1), F.size("__all") - keep + 1), F.lit(keep))).drop("__block", "__all")


def ordered_fold(keyed: DataFrame) -> DataFrame:
    """(id) of the records that a pass in the order of ids accepts, dropping those of which an accepted one has a key.

    keyed: (id, key), rows without either are left out. A record that comes first on all its keys is accepted whatever else
    there is, and what shares a key with it is dropped; with these gone others come first. So each round settles at least
    the first record of every key, no key is ever in one task, and the rounds are as many as the longest chain of such
    decisions.
    """
    live = cut(keyed.select("id", "key").filter("id is not null and key is not null").distinct())
    accepted = []
    while live.count():
        first = live.groupBy("key").agg(F.min("id").alias("first"))
        at = salted_join(live, first, "key")
        mine = at.groupBy("id").agg(F.bool_and(F.col("id") == F.col("first")).alias("wins"))
        won = cut(mine.filter("wins").select("id"))
        accepted.append(won)
        taken = salted_join(live, won, "id", "left_semi").select("key").distinct()
        hit = salted_join(live, taken, "key", "left_semi").select("id").distinct()
        live = cut(salted_join(live, hit, "id", "left_anti"))
    out = accepted[0] if accepted else live.select("id")
    for a in accepted[1:]:
        out = out.unionByName(a)
    return out.select("id")


def with_size(size: int, sizes: tuple[int, ...] = LADDER) -> tuple[int, ...]:
    """The ladder up to a size of its own, which is its last rung."""
    return (*[n for n in sizes if n < size], size)


def rung_cuts(have: dict[str, int], sizes: tuple[int, ...] = LADDER) -> list[tuple[int, str, int]]:
    """(rung, category, kept): how many of each category the rung of each size keeps; a rung some category cannot fill is left out.

    Each rung extends the one before, category by category in the order of MIX, and is cut to its size.
    """
    kept, out = dict.fromkeys(MIX, 0), []
    for n in sizes:
        want = {c: math.ceil(n * f) for c, f in MIX.items()}
        if any(have.get(c, 0) < w for c, w in want.items()):
            continue
        room = n - sum(kept.values())
        for c in MIX:
            add = min(max(0, want[c] - kept[c]), room)
            kept[c] += add
            room -= add
        out += [(n, c, k) for c, k in kept.items()]
    return out


def ladder(pool: DataFrame, sizes: tuple[int, ...] = LADDER) -> DataFrame:
    """(rung, ...) rows of the ranked pool(category, rn, ...) in each nested rung."""
    have = {r[0]: r[1] for r in pool.groupBy("category").count().filter(F.col("category").isin(*MIX)).collect()}
    cuts = pool.sparkSession.createDataFrame(rung_cuts(have, sizes), "rung int, category string, kept int")
    return pool.join(F.broadcast(cuts), "category").filter(F.col("rn") <= F.col("kept")).drop("kept")


def first_wins(df: DataFrame, key: str, order: str) -> DataFrame:
    """Rows that come first, by `order`, of those with the same key; null keys are one key. By aggregate, so skew-safe."""
    others = [c for c in df.columns if c not in (key, order)]
    return df.groupBy(key).agg(F.min(F.struct(order, *others)).alias("__f")).select(key, *[F.col(f"__f.{c}").alias(c) for c in (order, *others)])


def batches(df: DataFrame, key: str, size: int) -> DataFrame:
    """Adds batch, numbering rows from 0 in runs of `size` along a permutation by key."""
    return ranked(df, [], [F.col(key)], "__rn").withColumn("batch", F.floor((F.col("__rn") - 1) / size)).drop("__rn")
