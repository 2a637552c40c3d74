"""Problem 7: filling fixed-capacity containers.

Documents, as sizes only, are dealt into shards of like number by hash; each shard is packed by Karmarkar-Karp multiway
differencing, which merges the two partial partitions of largest imbalance, largest against smallest sums, until one
partition into near-equal windows is left. Windows that fit and are full stay; items of the others are differenced again,
and the window count rises whenever capacity is exceeded. Only items larger than a container are cut.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.mixing import tokens
from dialoom.llm.records import table

#: Items a shard has on average; what one task packs at a time.
SHARD_ITEMS = 1024
#: A window of at least this share of the capacity stays as it is while others are still repacked.
FULL = 0.97


def difference(sizes: list[int], k: int) -> list[tuple[int, list[int]]]:
    """At most k windows of near-equal sums: (sum, positions of its items), by multiway differencing."""
    heap = [(-s, i, [(s, [i])]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        spare = len(a) + len(b) - k
        if spare <= 0:
            c = a + b
        else:  # only the smallest `spare` sums of either meet: the larger of a with the smaller of b
            own, other = len(a) - spare, len(b) - spare
            met = [(x + y, p + q) for (x, p), (y, q) in zip(a[own:], reversed(b[other:]))]
            c = a[:own] + met + b[:other]
        c.sort(key=lambda z: -z[0])
        n += 1
        heapq.heappush(heap, (-(c[0][0] - (c[-1][0] if len(c) == k else 0)), n, c))
    return heap[0][2] if heap else []


def pack(sizes: list[int], capacity: int, full: float = FULL) -> list[list[int]]:
    """Windows of item positions, none over capacity; every item, of size at most capacity, is in one of them."""
    out: list[list[int]] = []
    left = [i for i, s in enumerate(sizes) if s > 0]
    more = 0
    while left:
        own = [sizes[i] for i in left]
        k = max(1, -(-sum(own) // capacity)) + more
        windows = difference(own, k)
        fits = [w for w in windows if w[0] <= capacity]
        if len(fits) < len(windows):
            fits = [w for w in fits if w[0] >= full * capacity]
        if not fits:
            more += max(1, k // 50)
            continue
        out += [[left[i] for i in w[1]] for w in fits]
        used = {left[i] for w in fits for i in w[1]}
        left, more = [i for i in left if i not in used], 0
    nothing = [i for i, s in enumerate(sizes) if s <= 0]
    if nothing:
        if out:
            out[0] = out[0] + nothing
        else:
            out.append(nothing)
    return out


def _pack_shard(width: int) -> Callable[[tuple, pd.DataFrame], pd.DataFrame]:
    def run(key: tuple, d: pd.DataFrame) -> pd.DataFrame:
        d = d.sort_values(["tokens", "doc_id", "piece"], kind="stable").reset_index(drop=True)
        window = [0] * len(d)
        for n, items in enumerate(pack(d["tokens"].astype(int).tolist(), int(key[1]))):
            for i in items:
                window[i] = n
        d["container"] = [f"s{key[2]:0{width}d}-{n:05d}" for n in window]
        return d[["plan_name", "doc_id", "piece", "pieces", "tokens", "container"]]

    return run


OUT = "plan_name string, doc_id bigint, piece int, pieces int, tokens bigint, container string"


def containers(docs: DataFrame, plans: DataFrame, shard_items: int = SHARD_ITEMS) -> DataFrame:
    """(plan_name, doc_id, piece, pieces, tokens, container) for docs(doc_id, tokens) under plans(plan_name, capacity_tokens).

    A document over the capacity is cut into full containers and a rest, which is packed like a document. Documents of
    size 0 or null take no room and go into the first window of their shard. Plans without a positive capacity are left
    out. Repeated plan rows count once; doc_id must be unique. Nothing is dropped: every token is in one container.
    """
    plans = plans.filter("capacity_tokens > 0").select("plan_name", "capacity_tokens").distinct()
    shards = max(1, -(-docs.count() // shard_items))
    size = F.coalesce("tokens", F.lit(0)).cast("bigint")
    d = docs.select("doc_id", size.alias("size")).crossJoin(F.broadcast(plans))  # a handful of plan rows
    cap = F.col("capacity_tokens")
    d = d.withColumn("pieces", F.greatest(F.lit(1), F.ceil(F.col("size") / cap)).cast("int"))
    d = d.select("*", F.explode(F.sequence(F.lit(1), F.col("pieces"))).alias("piece"))
    d = d.withColumn("tokens", F.least(F.col("size") - (F.col("piece") - 1) * cap, cap))
    full = d.filter(F.col("tokens") == cap).select(
        "plan_name", "doc_id", "piece", "pieces", "tokens", F.format_string("d%d-%d", "doc_id", "piece").alias("container")
    )
    rest = d.filter(F.col("tokens") < cap).withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)))
    packed = rest.groupBy("plan_name", "capacity_tokens", "shard").applyInPandas(_pack_shard(len(str(shards))), OUT)
    return full.unionByName(packed)


def packed_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", tokens(F.col("text")).alias("tokens"))
    return containers(docs, table(spark, sf_dir, "pack_plan"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that had to be cut: larger than the plan's capacity."""
    return packed_documents(spark, sf_dir).filter("pieces > 1").select("plan_name", "doc_id").distinct()


def p7_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document and the container it is in."""
    return packed_documents(spark, sf_dir)


def p7_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, their fullest and the share of all room that is used, by plan."""
    c = packed_documents(spark, sf_dir).groupBy("plan_name", "container").agg(F.sum("tokens").alias("used"))
    plans = table(spark, sf_dir, "pack_plan").distinct()
    return c.join(F.broadcast(plans), "plan_name").groupBy("plan_name", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.max("used").alias("fullest"),
        (F.sum("used") / (F.count("*") * F.col("capacity_tokens"))).alias("fill"),
    )
