"""Metrics, validation, assembly and scale building blocks on small fixtures."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from dialoom.operators import assemble, metrics, scale, validate

V = "model_slug string, scenario_id string, category string, turn int, reply string, passed boolean, syntax_pass boolean, leak_pass boolean, leak_reason string, judge_error boolean, judged_at timestamp, landed_at timestamp"


def verdicts(spark, rows):
    return spark.createDataFrame([("m", s, "math", t, "r", p, True, p, None, p is None, None, None) for s, t, p in rows], V)


def test_aggregate_golden(spark):
    v = verdicts(spark, [("A", 1, True), ("A", 2, True), ("B", 1, True), ("B", 2, False), ("C", 1, True), ("C", 2, None), ("C", 2, None)])
    v = metrics.latest(v)
    a = metrics.adherence(v, [["model_slug"], []]).filter("model_slug is null").collect()[0]
    assert (a.n_rows, a.n_judged, a.n_errors, a.adherence) == (6, 5, 1, 4 / 5)
    r = metrics.robustness(v, ["model_slug"]).collect()[0]
    assert (r.n_scenarios, r.n_clean, r.robustness) == (3, 2, 1 / 2)
    assert metrics.adherence(v.filter("passed is null"), [["model_slug"]]).collect()[0].adherence == 0


def test_latest_ties(spark):
    rows = [("m", "A", "c", 1, "r", p, True, p, None, False, None, None) for p in (True, False, True)] * 2
    assert metrics.latest(spark.createDataFrame(rows, V)).select("passed").collect()[0][0] is True


def test_running_best(spark):
    s = spark.createDataFrame([(1, 0.5), (2, 0.9), (3, 0.65), (4, 0.75)], "k int, x double")
    assert [r.regressed for r in metrics.running_best(s, "k", "x", 0.2).orderBy("k").collect()] == [None, False, True, False]


def test_conversation_issues(spark):
    m = "id int, messages array<struct<role: string, content: string>>"
    df = spark.createDataFrame([
        (1, [("user", "a"), ("assistant", "b")]), (2, [("user", "a")]), (3, [("assistant", "a"), ("user", " ")]), (4, None), (5, []), (6, [(None, None), ("assistant", "b")]),
    ], m)
    got = {r.id: r.i for r in df.select("id", validate.conversation_issues(F.col("messages")).alias("i")).collect()}
    assert got[1] == [] and got[2] == ["odd length", "unanswered"] and got[4] == ["no messages"] == got[5]
    assert got[3] == ["roles do not alternate", "empty content", "unanswered"] and got[6] == ["roles do not alternate", "empty content"]


def test_targets_golden(spark):
    sizes = {"train": 2000, "test": 100, "eval_dev": 120, "eval_final": 80}
    topics = {(r.split, r.category): r.target for r in assemble.targets(spark, sizes, {"train": 1.3, "test": 1.3, "eval_dev": 1.15, "eval_final": 1.15}, 2).collect()}
    plans = {(r.split, r.category): r.target for r in assemble.targets(spark, sizes, {"train": 1.15, "test": 1.15, "eval_dev": 1.05, "eval_final": 1.05}, 0).collect()}
    assert [topics[s, "howto"] for s in sizes] == [782, 41, 44, 30] and [plans[s, "howto"] for s in sizes] == [690, 35, 38, 26]
    assert [topics[s, "math"] for s in sizes] == [262, 15, 16, 12] and [plans[s, "meta"] for s in sizes] == [345, 18, 19, 13]


def test_ladder_golden_and_nested(spark):
    cuts = assemble.rung_cuts(dict.fromkeys(assemble.MIX, 10**6))
    by = {n: [k for r, _, k in cuts if r == n] for n in assemble.LADDER}
    assert by[125] == [38, 25, 19, 19, 13, 11] and by[250] == [75, 50, 38, 38, 25, 24] and by[2000] == [600, 400, 300, 300, 200, 200]
    assert assemble.rung_cuts({"howto": 3}) == []
    pool = spark.createDataFrame([(f"{c}{i}", c) for c in assemble.MIX for i in range(90)], "id string, category string")
    rungs = assemble.ladder(assemble.shuffled(pool, ["category"], "id", "1"), (10, 20, 125)).collect()
    sets = {n: {r.id for r in rungs if r.rung == n} for n in (10, 20, 125)}
    assert {n: len(s) for n, s in sets.items()} == {10: 10, 20: 20, 125: 125} and sets[10] < sets[20] < sets[125]


def test_avoid_list_across_blocks(spark, tmp_path):
    from dialoom.plans import registry

    spark.range(5200).selectExpr("format_string('train_math_%05d', id) as id").write.parquet(f"{tmp_path}/convs.parquet")
    got = {r.id: (r.max_before, r.n_before) for r in registry.avoid_list(spark, str(tmp_path)).collect()}
    ids = sorted((f"train_math_{i:05d}" for i in range(5200)), key=lambda i: hashlib.md5(f"{i}42".encode()).hexdigest())
    idx = [int(i[-5:]) for i in ids]
    assert got == {i: (max(idx[max(0, k - 80) : k], default=None), min(k, 80)) for k, i in enumerate(ids)}


def test_ranked_and_prefix_sum(spark):
    rows = [(g, i, random.Random(i).randint(0, 9)) for g in ("a", "b", None) for i in range(500)]
    df = spark.createDataFrame(rows, "g string, i int, n int")
    for r in (scale.ranked(df, ["g"], [F.col("i")], "k").collect(), ):
        for g in ("a", "b", None):
            assert sorted(x.k for x in r if x.g == g) == list(range(1, 501))
    p = scale.prefix_sum(df, ["g"], [F.col("i")], F.col("n"), "s").collect()
    for g in ("a", "b", None):
        mine = sorted((x.s, x.n) for x in p if x.g == g)
        assert mine[-1][0] == sum(n for _, n in mine)
        assert all(b[0] - b[1] >= 0 for b in mine)
    assert scale.ranked(df.filter("false"), ["g"], [F.col("i")], "k").count() == 0


def test_salted_join_is_a_join(spark):
    left = spark.createDataFrame([("hot", i) for i in range(300)] + [("cold", 1), (None, 2), ("none", 3)], "k string, x int")
    right = spark.createDataFrame([("hot", 10), ("hot", 11), ("cold", 12), (None, 13)], "k string, y int")
    for how in ("inner", "left", "left_semi", "left_anti"):
        a = sorted(map(str, left.join(right, "k", how).collect()))
        assert sorted(map(str, scale.salted_join(left, right, "k", how, hot_rows=50).collect())) == a


def test_first_wins_and_batches(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 1, None), (None, 1, "z"), (None, 0, "w")], "k string, o int, v string")
    assert {(r.k, r.v) for r in assemble.first_wins(df, "k", "o").collect()} == {("a", "y"), ("b", None), (None, "w")}
    b = assemble.batches(spark.range(20).withColumnRenamed("id", "i"), "i", 8).groupBy("batch").count().collect()
    assert sorted(r["count"] for r in b) == [4, 8, 8] and math.isclose(min(r.batch for r in b), 0)


def test_ordered_fold_is_a_pass_in_order(spark):
    r = random.Random(3)
    rows = [(f"r{i:04d}", f"k{r.randint(0, 150)}") for i in range(400) for _ in range(r.randint(1, 3))] + [(f"r{i:04d}", "hot") for i in range(0, 400, 9)]
    rows += [(f"z{i:03d}", f"c{j}") for i in range(12) for j in (i, i + 1)]  # a chain, where every second is accepted
    want, seen = [], set()
    for i in sorted({i for i, _ in rows}):
        keys = {k for j, k in rows if j == i}
        if not keys & seen:
            seen |= keys
            want.append(i)
    df = spark.createDataFrame([*rows, *rows[:5], (None, "a"), ("x", None)], "id string, key string")
    assert sorted(x.id for x in assemble.ordered_fold(df).collect()) == want
    assert assemble.ordered_fold(df.filter("false")).count() == 0


def test_dialogue_and_turn_issues(spark):
    good = [("user", "hi"), ("assistant", "Why?")] * 2
    cases = [
        (good, []), (good[:3], ["needs 4 messages"]), (None, ["needs 4 messages"]),
        ([("user", "is it Paris"), ("assistant", "It is. Why?"), ("assistant", " "), ("assistant", "Is it Paris?")],
         ["message 2 is no user message", "turn 1 breaks the rule", "turn 2 breaks the rule", "turn 2 says the answer Paris", "user turn 1 says the answer Paris"]),
        ([("user", "six"), ("assistant", "Is it six?"), ("user", None), ("assistant", "What?")], ["message 2 is no user message", "user turn 1 says the answer six", "user turn 2 empty"]),
    ]
    df = spark.createDataFrame([(i, m) for i, (m, _) in enumerate(cases)], "i int, m array<struct<role: string, content: string>>")
    answers = F.array(F.lit("six"), F.lit("Paris"))
    got = {r.i: r.x for r in df.select("i", validate.dialogue_issues(F.col("m"), answers, F.lit(2)).alias("x")).collect()}
    assert [got[i] for i in range(len(cases))] == [w for _, w in cases]
    t = spark.createDataFrame([(1, ["a", "b"]), (2, None), (3, ["six", ""])], "i int, t array<string>")
    got = {r.i: r.x for r in t.select("i", validate.turn_list_issues(F.col("t"), answers, F.lit(2)).alias("x")).collect()}
    assert got == {1: [], 2: ["needs 2 turns"], 3: ["user turn 1 says the answer six", "user turn 2 empty"]}


def test_preceding_list_across_blocks(spark):
    df = spark.createDataFrame([("a", f"v{i}", i) for i in range(1, 60)], "g string, v string, rn int")
    got = {r.rn: r.before for r in assemble.preceding_list(df, "g", "v", 8, 5, block=10).collect()}
    assert got == {i: [f"v{j}" for j in range(max(1, i - 8), i)][-5:] for i in range(1, 60)}
    assert assemble.with_size(300, (10, 400)) == (10, 300)


def test_spread_moves_only_tables_of_few_parts(spark):
    few, many = spark.range(100, numPartitions=1), spark.range(100, numPartitions=9)
    assert scale.spread(few, "id").rdd.getNumPartitions() == 4 and scale.spread(many, "id") is many
    assert sorted(r.id for r in scale.spread(few, "id").collect()) == list(range(100))
