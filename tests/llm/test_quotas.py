"""Problems 5, 7 and 8: sampling, packing and mixing."""

import random
from collections import Counter, defaultdict

from dialoom.llm import mixing, packing, queries, sampling

from .helpers import CONV

TARGET = "split string, category string, target_share double, min_rows int, sample_rows bigint"


def test_sampling(spark, folder):
    have = {"howto": 50, "factual": 40, "emotional": 30, "meta": 5, "math": 10, "smalltalk": 0}
    rows = [(f"train_{c}_{i:05d}", None, None, None, None, None, 1) for c, n in have.items() for i in range(n)]
    want = {"howto": 0.1, "factual": 0.1, "emotional": 0.1, "meta": 0.3, "math": 0.2, "smalltalk": 0.2}
    t = [("train", c, s, 4, 100) for c, s in want.items()] + [("test", "math", None, None, None), ("test", "meta", 0.5, 1, 2)]
    d = folder(convs=spark.createDataFrame(rows + rows[:9], CONV), category_targets=spark.createDataFrame(t, TARGET))
    found = {tuple(r) for r in sampling.p5_found(spark, d).collect()}
    assert found == {("train", "meta"), ("train", "math"), ("train", "smalltalk"), ("test", "meta")}
    p = {(r.split, r.category): r for r in sampling.p5_report(spark, d).collect()}
    assert sum(p["train", c].quota for c in want) == 100 and all(p["train", c].quota <= have[c] for c in want)
    # math is short of ten, which its siblings give; meta and smalltalk are short of 45, of which their sibling gives 20.
    assert p["train", "howto"].from_siblings + p["train", "factual"].from_siblings == 10 and p["train", "emotional"].from_siblings == 20
    assert p["train", "howto"].from_cousins + p["train", "factual"].from_cousins == 25
    got = Counter((r.split, r.category) for r in sampling.p5_sample(spark, d).collect())
    assert got == {k: r.quota for k, r in p.items() if r.quota}
    e = folder(convs=spark.createDataFrame([], CONV), category_targets=spark.createDataFrame(t, TARGET))
    assert sampling.p5_sample(spark, e).count() == 0


def test_difference_and_pack():
    r = random.Random(7)
    for _ in range(200):
        sizes = [r.randint(0, 50) for _ in range(r.randint(0, 40))]
        k = r.randint(1, 12)
        windows = packing.difference([s for s in sizes if s], k)
        assert sorted(i for w in windows for i in w[1]) == list(range(len([s for s in sizes if s]))) and len(windows) <= k
        packed = packing.pack(sizes, 50)
        assert sorted(i for w in packed for i in w) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in w) <= 50 for w in packed)
    assert sorted(w[0] for w in packing.difference([8, 7, 6, 5, 4], 2)) == [14, 16]


def test_containers(spark, folder):
    r = random.Random(9)
    texts = ["x" * int(r.paretovariate(1.1) * 20) for _ in range(900)] + [None, "", "é" * 50, "y" * 100, "y" * 200]
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id bigint, text string, tokens int")
    plans = spark.createDataFrame([("p", 100), ("q", 1000), ("p", 100), ("bad", 0), ("none", None)], "plan_name string, capacity_tokens bigint")
    d = folder(documents=docs, pack_plan=plans)
    rows = packing.containers(spark.createDataFrame([(i, len((t or "").encode())) for i, t in enumerate(texts)], "doc_id bigint, tokens bigint"), plans, 128).collect()
    for plan, cap in (("p", 100), ("q", 1000)):
        used, size, seen = defaultdict(int), defaultdict(int), Counter()
        for x in rows:
            if x.plan_name == plan:
                used[x.container] += x.tokens
                size[x.doc_id] += x.tokens
                seen[x.doc_id, x.piece] += 1
        assert max(used.values()) <= cap and max(seen.values()) == 1
        assert dict(size) == {i: len((t or "").encode()) for i, t in enumerate(texts)}
        assert sum(used.values()) / (cap * len(used)) > 0.9
    found = {tuple(x) for x in packing.p7_found(spark, d).collect()}
    assert found == {(p, i) for p, c in (("p", 100), ("q", 1000)) for i, t in enumerate(texts) if len((t or "").encode()) > c}
    assert {x.plan_name for x in packing.p7_fill(spark, d).collect()} == {"p", "q"}
    e = folder(documents=docs.filter("false"), pack_plan=plans)
    assert packing.p7_containers(spark, e).count() == 0


def test_mixing(spark, folder):
    r = random.Random(8)
    texts = [("z" * r.randint(1, 60), r.choice(["a_b", "A-B", " a b", "big", "big", "big", None])) for _ in range(3000)] + [(None, "big"), ("", "a_b")]
    docs = spark.createDataFrame([(i, t, s, 1) for i, (t, s) in enumerate(texts)], "doc_id bigint, text string, source string, copies int")
    size = Counter()
    for t, s in texts:
        size[(s or "").strip().lower().replace("-", "_").replace(" ", "_")] += len(t or "")
    total = size["big"]
    plan = [("m", "a_b", 0.5, 3, total), ("m", "big", 0.4, 1, total), ("m", "gone", 0.1, 2, total), ("n", "a_b", 3.0, 2, total), ("n", "big", None, 1, total)]
    plan_df = spark.createDataFrame(plan, "mix_name string, source string, target_share double, max_repeats int, total_tokens bigint")
    d = folder(documents=docs, mix_plan=plan_df)
    short = {(m, s) for m, s, share, most, t in plan if most * size[s] < (share or 0) * t}
    assert {tuple(x) for x in mixing.p8_found(spark, d).collect()} == short and len(short) == 2
    shares = {(x.mix_name, x.source): x for x in mixing.p8_shares(spark, d).collect()}
    assert abs(shares["m", "a_b"].share - 0.5) < 0.02 and abs(shares["m", "big"].share - 0.4) < 0.02 and shares["m", "gone"].share == 0
    assert shares["n", "a_b"].mixed_tokens == 2 * size["a_b"] and shares["n", "big"].mixed_tokens == 0
    for x in mixing.p8_mix(spark, d).collect():
        due = shares[x.mix_name, x.source].target_share * total / size[x.source]
        assert 1 <= x.copies <= min(due + 1, shares[x.mix_name, x.source].max_repeats)
    e = folder(documents=docs.filter("false"), mix_plan=plan_df)
    assert mixing.p8_mix(spark, e).count() == 0 and mixing.p8_found(spark, e).count() == 4


def test_against_sql(spark, sf):
    from oracle_check import difference, tables

    con = tables(sf)
    for name, sql in queries.ORACLE_SQL.items():
        assert difference(queries.QUERIES[name](spark, sf), con, sql) == ""


def test_every_query_runs(spark, sf):
    for name, f in queries.QUERIES.items():
        df = f(spark, sf)
        assert len(df.columns) == len(set(df.columns)), name
        rows = df.collect()
        if name.endswith("_found"):
            assert len(rows) == len({tuple(r) for r in rows}), name
