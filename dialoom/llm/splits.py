"""Problem 1: splits that keep related records together.

Records are tied by shared keys. Components come from contraction: each round orders the components at random, every
component joins the first it shares a key with, pointers are doubled once, and keys held by one component only are
dropped, so the edges shrink by a constant factor a round. Components of the same size and label profile form a bundle. A
min-cost flow gives the rows of each bundle and label to the splits; whole components follow it, large ones first, and
what rounding leaves over is made up by the smaller ones. Members of a bundle go to their splits in the order of a hash.
"""

from __future__ import annotations

import heapq
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.records import all_records, category_of, split_of, ties
from dialoom.operators.scale import counted_broadcast, cut, ranked, salted_join

SHARES = {"train": 0.8, "validation": 0.1, "test": 0.1}
#: Labels with quotas of their own, commonest first; all others together count as one more.
LABELS = 64


def components(edges: DataFrame) -> DataFrame:
    """(id, component) for every id of edges(id, key); component is the smallest id tied to it.

    Null ids or keys are dropped, repeated edges count once, an empty table gives an empty result.
    """
    edges = edges.select("id", "key").filter(F.col("id").isNotNull() & F.col("key").isNotNull()).distinct()
    live = cut(edges.withColumnRenamed("id", "node"))
    n = edge_rows = live.count()
    ids = live.select(F.col("node").alias("id"), "node").distinct()
    moves: list[DataFrame] = []
    while True:
        # Another order of the nodes each round, so that no chain of ids is in order.
        place = F.struct(F.xxhash64(F.lit(len(moves)), "node").alias("h"), F.col("node").alias("node"))
        keys = live.groupBy("key").agg(F.min(place).alias("to"), F.min("node").alias("lo"), F.max("node").alias("hi"))
        live = cut(salted_join(live, keys.filter("lo <> hi").select("key", "to"), "key", rows=n))
        n = live.count()
        if not n:
            break
        step = live.groupBy("node").agg(F.min("to").alias("to")).select("node", F.col("to.node").alias("to"))
        step = cut(step.filter("to <> node"))
        jump = step.select(F.col("node").alias("to"), F.col("to").alias("further"))
        step = cut(salted_join(step, jump, "to", "left", rows=n).select("node", F.coalesce("further", "to").alias("to")))
        moves.append(step)
        live = salted_join(live.select("node", "key"), step, "node", "left", rows=n)
        live = cut(live.select(F.coalesce("to", "node").alias("node"), "key").distinct())
    out = ids
    for step in moves:
        out = salted_join(out, step, "node", "left", rows=edge_rows).select("id", F.coalesce("to", "node").alias("node"))
    out = cut(out)
    return salted_join(out, out.groupBy("node").agg(F.min("id").alias("component")), "node", rows=edge_rows).select("id", "component")


class Flow:
    """Min-cost flow by successive shortest paths with potentials, one supply after the other.

    A search ends when it reaches the sink, and nodes near the sink come first among equals, so that most supplies see a
    handful of arcs whatever the size of the graph. Nodes are tuples that begin with their distance from the sink.
    """

    SINK = (0,)

    def __init__(self) -> None:
        self.out: dict[tuple, list[int]] = defaultdict(list)
        self.to: list[tuple] = []
        self.room: list[int] = []
        self.cost: list[float] = []
        self.height: dict[tuple, float] = defaultdict(float)

    def arc(self, a: tuple, b: tuple, room: int, cost: float) -> int:
        for x, y, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.out[x].append(len(self.to))
            self.to.append(y)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def send(self, source: tuple, amount: int) -> None:
        """Brings `amount` from source to the sink at least cost; there must be room for it."""
        while amount:
            dist, via, queue = {source: 0.0}, {}, [(0.0, source)]
            while True:
                d, x = heapq.heappop(queue)
                if d > dist[x]:
                    continue
                if x == self.SINK:
                    break
                for e in self.out[x]:
                    if self.room[e]:
                        y = self.to[e]
                        nd = d + max(0.0, self.cost[e] + self.height[x] - self.height[y])
                        if nd < dist.get(y, float("inf")) - 1e-12:
                            dist[y], via[y] = nd, e
                            heapq.heappush(queue, (nd, y))
            for y, dy in dist.items():
                if dy < d:
                    self.height[y] -= d - dy
            path, x = [], self.SINK
            while x != source:
                path.append(via[x])
                x = self.to[via[x] ^ 1]
            push = min(amount, *[self.room[e] for e in path])
            for e in path:
                self.room[e] -= push
                self.room[e ^ 1] += push
            amount -= push


def quotas_by_flow(bundles: list[tuple], shares: dict[str, float]) -> dict[str, dict[str, int]]:
    """Components of each bundle to give to each split; bundles: (name, size, count, [(label, rows a component)]).

    In the flow each bundle and label supplies its rows. A row beyond its split's quota costs 4, one beyond its (split,
    label) quota costs 1, and a row of a component that is large against the split's quota costs a little. Then whole
    components are dealt by largest remainder, large ones first; what a split and label got too much or too little is
    carried over to the bundles that follow, so that even a component of a third of all rows is made up for.
    """
    totals: dict = defaultdict(int)
    for _, _, count, profile in bundles:
        for label, n in profile:
            totals[label] += n * count
    every = sum(totals.values())
    flow, arcs = Flow(), {}
    for k, share in shares.items():
        flow.arc((1, k), flow.SINK, round(share * every), 0)
        flow.arc((1, k), flow.SINK, every, 4)
        for label, n in totals.items():
            flow.arc((2, k, label), (1, k), round(share * n), 0)
            flow.arc((2, k, label), (1, k), every, 1)
    order = sorted(bundles, key=lambda b: (-b[1], b[0]))
    for name, size, count, profile in order:
        for label, n in profile:
            for k, share in shares.items():
                arcs[name, label, k] = flow.arc((3, name, label), (2, k, label), n * count, min(0.5, size / max(1.0, share * every)))
            flow.send((3, name, label), n * count)
    carry: dict = defaultdict(float)
    out = {}
    for name, size, count, profile in order:
        given = {(label, k): flow.room[arcs[name, label, k] ^ 1] for label, _ in profile for k in shares}
        want = {k: sum(max(0.0, given[label, k] + carry[label, k]) for label, _ in profile) for k in shares}
        whole = sum(want.values()) or 1.0
        due = {k: count * v / whole for k, v in want.items()}
        got = {k: int(v) for k, v in due.items()}
        for k in sorted(shares, key=lambda k: got[k] - due[k])[: count - sum(got.values())]:
            got[k] += 1
        for label, n in profile:
            for k in shares:
                carry[label, k] += given[label, k] - got[k] * n
        out[name] = got
    _even_out(out, order[::-1], carry, list(shares))
    return out


def _even_out(out: dict[str, dict[str, int]], smallest_first: list[tuple], carry: dict, splits: list[str]) -> None:
    """Moves small components from splits with too many rows in all to those with too few, of fitting labels first.

    Labels of large components only cannot make up for each other; the split as a whole can, and counts for more.
    """
    labels = sorted({label for label, _ in carry})
    off = {k: sum(carry[label, k] for label in labels) for k in splits}
    for size in sorted({b[1] for b in smallest_first}):
        least = [b for b in smallest_first if b[1] == size]
        while True:
            low, high = max(splits, key=lambda k: off[k]), min(splits, key=lambda k: off[k])
            most = int(min(off[low], -off[high]) // size)
            fit = lambda b: sum(n * (carry[label, low] - carry[label, high]) for label, n in b[3]) / b[1]
            open_ = [b for b in least if out[b[0]][high]]
            if most < 1 or not open_:
                break
            name, _, _, profile = max(open_, key=lambda b: (fit(b), b[0]))
            # A part at a time, so that the labels share the load.
            move = min(out[name][high], max(1, most // max(1, len(open_))))
            out[name][high] -= move
            out[name][low] += move
            off[low] -= move * size
            off[high] += move * size
            for label, n in profile:
                carry[label, low] -= move * n
                carry[label, high] += move * n


def assign_splits(members: DataFrame, shares: dict[str, float] = SHARES) -> DataFrame:
    """(id, component, assigned_split) for members(id, component, label): no component is divided.

    Null labels count as one label of their own. Sizes count distinct ids. An empty table gives an empty result. The
    driver sees at most LABELS labels and a row for each different size and profile: 568 of them for 53,010 ids and
    138 for 5,301, as most components are small and alike.
    """
    members = members.select("id", "component", F.coalesce("label", F.lit("")).alias("label")).distinct()
    by = cut(members.groupBy("component", "label").agg(F.count("*").alias("n")))
    common = [r[0] for r in by.groupBy("label").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "label").limit(LABELS).collect()]
    known = F.when(F.col("label").isin(common), F.col("label")).otherwise("\u0000others")
    comps = by.groupBy("component", known.alias("label")).agg(F.sum("n").alias("n")).groupBy("component").agg(
        F.sum("n").alias("size"), F.sort_array(F.collect_list(F.struct("label", "n"))).alias("profile")
    )
    comps = cut(comps.withColumn("bundle", F.to_json("profile")))
    rows = comps.groupBy("bundle").agg(F.first("size").alias("size"), F.count("*").alias("count"), F.first("profile").alias("profile")).collect()
    quotas = quotas_by_flow([(r["bundle"], r["size"], r["count"], [tuple(x) for x in r["profile"]]) for r in rows], shares)
    spans = []
    for name, given in quotas.items():
        low = 0
        for k, n in given.items():
            spans.append((name, k, low, low + n))
            low += n
    spans_df = members.sparkSession.createDataFrame(spans, "bundle string, assigned_split string, low bigint, high bigint")
    order = ranked(comps.select("component", "bundle"), ["bundle"], [F.col("component")], "rank")
    chosen = order.join(counted_broadcast(spans_df, len(spans)), "bundle").filter((F.col("rank") > F.col("low")) & (F.col("rank") <= F.col("high")))
    return salted_join(members.select("component", "id").distinct(), chosen.select("component", "assigned_split"), "component").select(
        "id", "component", "assigned_split"
    )


def record_components(records: DataFrame) -> DataFrame:
    """(id, component) of all records; a record tied to nothing is its own component."""
    tied = components(ties(records))
    ids = records.select("id").filter(F.col("id").isNotNull()).distinct()
    return ids.join(tied, "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def assigned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, component, assigned_split) of all records, balanced by category."""
    members = cut(record_components(all_records(spark, sf_dir)).withColumn("label", category_of(F.col("id"))))
    return cut(assign_splits(members))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids whose group, given one split, has records that were delivered in more than one."""
    got = assigned(spark, sf_dir)
    s = split_of(F.col("id"))
    mixed = got.groupBy("component").agg(F.min(s).alias("a"), F.max(s).alias("b"), F.max("assigned_split").alias("one")).filter("a <> b and one is not null")
    return salted_join(got, mixed.select("component"), "component", "left_semi").select("id")


def p1_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One split for each id, all of a component in one."""
    return assigned(spark, sf_dir).select("id", "assigned_split")


def p1_split_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and share of each split and category against what was asked for."""
    got = assigned(spark, sf_dir).withColumn("label", category_of(F.col("id"))).groupBy("assigned_split", "label").count()
    target = F.element_at(F.create_map(*[x for k, v in SHARES.items() for x in (F.lit(k), F.lit(v))]), F.col("assigned_split"))
    # A row a label and split.
    whole = got.groupBy("label").agg(F.sum("count").alias("label_rows"))
    return got.join(whole, "label").select(
        "assigned_split", "label", F.col("count").alias("n_rows"),
        (F.col("count") / F.col("label_rows")).alias("share"), target.alias("target_share"),
    )
