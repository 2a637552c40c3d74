"""Problems 1, 2 and 6: ties, splits, overlaps and leaks against brute force."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from dialoom.functions.normalize import match_key
from dialoom.functions.normalize import words as word_column
from dialoom.llm import leakage, overlap, splits
from dialoom.llm.records import tie_keys
from dialoom.operators import scale

from .helpers import CONV, PLAN, edit_in, groups, lcs, words

SAY = "the cat sat on a mat while some dogs ran over hills and rivers to find one red ball under trees near old barns by night".split()


def test_words_and_keys(spark):
    texts = ["Don’t STOP", "app\u00adrox. ５ ｋｇ", "cafe\u0301 caf\u00e9", "我是X 人", "ไม่ได้ok", "", None, "🙃 --"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", word_column(F.col("t")).alias("w"), match_key(F.col("t")).alias("k"))
    got = {r.i: (r.w, r.k) for r in df.collect()}
    assert [got[i][0] for i in range(4)] == [["don", "t", "stop"], ["approx", "5", "kg"], ["café", "café"], ["我", "是", "x", "人"]]
    assert got[4][0][-1] == "ok" and got[5] == ([], None) and got[6] == (None, None) and got[7] == ([], None)
    for i, t in enumerate(texts[:4]):
        assert got[i][0] == words(t)


def test_tie_keys(spark):
    df = spark.createDataFrame(
        [(1, "  Old MAPS!", "What? (secondary: Why, then?)"), (2, "old maps", "why then"), (3, "TBD", "n/a"), (4, None, None), (5, "-", "")], "i int, t string, q string"
    )
    got = {r.i: set(r.k) for r in df.select("i", tie_keys(F.col("t"), F.col("q")).alias("k")).collect()}
    assert got == {1: {"t:oldmaps", "q:what", "q:whythen"}, 2: {"t:oldmaps", "q:whythen"}, 3: set(), 4: set(), 5: set()}


@pytest.mark.parametrize("seed", range(2))
def test_components(spark, seed):
    r = random.Random(seed)
    edges = [(f"i{r.randint(0, 60)}", f"k{r.randint(0, 70)}") for _ in range(80)] + [(f"c{i}", f"x{j}") for i in range(40) for j in (i, i + 1)]
    edges += [(f"h{i}", "hot") for i in range(50)] + edges[:5]
    df = spark.createDataFrame([*edges, (None, "a"), ("z", None)], "id string, key string")
    got = {}
    rows = splits.components(df).collect()
    for x in rows:
        got.setdefault(x.component, set()).add(x.id)
    assert {frozenset(v) for v in got.values()} == groups(edges) and len(rows) == len({x.id for x in rows})
    assert all(min(v) == k for k, v in got.items())


def test_components_empty(spark):
    assert splits.components(spark.createDataFrame([], "id string, key string")).count() == 0


def test_assigned_splits(spark):
    r = random.Random(1)
    rows = [(f"r{i}", f"c{min(i, r.randint(0, 900))}", r.choice(["a", "b", None])) for i in range(2000)] + [(f"g{i}", "giant", "a") for i in range(500)]
    got = splits.assign_splits(spark.createDataFrame(rows, "id string, component string, label string")).collect()
    assert sorted(x.id for x in got) == sorted(i for i, _, _ in rows)
    by = {}
    for x in got:
        assert by.setdefault(x.component, x.assigned_split) == x.assigned_split
    n = Counter(x.assigned_split for x in got)
    for k, share in splits.SHARES.items():
        assert abs(n[k] - share * len(rows)) <= 0.02 * len(rows)
    again = splits.assign_splits(spark.createDataFrame(rows[::-1], "id string, component string, label string"))
    assert {x.id: x.assigned_split for x in again.collect()} == {x.id: x.assigned_split for x in got}
    assert splits.assign_splits(spark.createDataFrame([], "id string, component string, label string")).count() == 0


def test_quotas_beside_a_giant(spark):
    """A component of a third of all rows is whole, and the others make up for it in every split and label."""
    r = random.Random(2)
    rows = [(f"g{i}", "giant", r.choice("abc")) for i in range(1500)]
    while len(rows) < 4500:
        c, size = f"c{len(rows)}", min(40, int(r.paretovariate(1.2)))
        rows += [(f"r{len(rows)}x{j}", c, r.choice("aaabbc") if size < 9 else "d") for j in range(size)]
    got = splits.assign_splits(spark.createDataFrame(rows, "id string, component string, label string")).collect()
    of, label = {x.id: x.assigned_split for x in got}, {i: v for i, _, v in rows}
    assert len(of) == len(rows) and len({of[i] for i, c, _ in rows if c == "giant"}) == 1
    whole, cell = Counter(of.values()), Counter((of[i], label[i]) for i in of)
    for k, share in splits.SHARES.items():
        assert abs(whole[k] - round(share * len(rows))) <= 1  # the rounded quotas need not add up to all rows
        for v, n in Counter(label.values()).items():  # label d has only components of 9 to 40 rows, half of one may be off
            assert abs(cell[k, v] - share * n) <= max(0.02 * n, 40 / 2) + 1


def test_few_labels_have_quotas(spark, monkeypatch):
    monkeypatch.setattr(splits, "LABELS", 2)
    rows = [(f"r{i}", f"c{i // 2}", f"l{i % 7}") for i in range(200)]
    got = splits.assign_splits(spark.createDataFrame(rows, "id string, component string, label string")).collect()
    n = Counter(x.assigned_split for x in got)
    assert n == {"train": 160, "validation": 20, "test": 20}


def test_found_across_splits(spark, folder):
    c = spark.createDataFrame([
        ("train_math_00001", "T", "q1", None, None, None, 1), ("train_math_00002", None, "Q1!", None, None, None, 1), ("train_math_00002", None, "Q1!", None, None, None, 1),
        ("test_math_00003", "unknown", "x (secondary: q2)", None, None, None, 1), ("train_meta_00004", "unknown", "q3", None, None, None, 1),
    ], CONV)
    b = spark.createDataFrame([("eval_dev_math_00001", "t", None, None, None, None, 1), ("eval_final_meta_00001", None, "q2", None, None, None, 1)], PLAN)
    d = folder(convs=c, blueprints=b)
    got = sorted(r.id for r in splits.p1_found(spark, d).collect())
    assert got == ["eval_dev_math_00001", "eval_final_meta_00001", "test_math_00003", "train_math_00001", "train_math_00002"]
    assert splits.p1_splits(spark, d).count() == 6 and splits.p1_split_report(spark, d).count() > 0


def test_lcs_and_myers():
    r = random.Random(0)
    for _ in range(300):
        a, b = ([r.choice("abcd") for _ in range(r.randint(0, 70))] for _ in range(2))
        assert overlap.word_lcs(a, b) == lcs(a, b)
        assert leakage.myers(a[:20], b) == (edit_in(a[:20], b) if a[:20] else 0)


def noisy(r, w, k):
    w = list(w)
    for _ in range(k):
        i = r.randrange(len(w))
        w[i : i + 1] = r.choice([[], [w[i], "zz"], ["yy"]])
    return w


def test_near_pairs_against_brute_force(spark):
    r = random.Random(5)
    base = [[r.choice(SAY) for _ in range(n)] for n in (3, 5, 9, 12, 14, 15, 16, 20, 60, 100)]
    left = [w for w in base] + [noisy(r, w, 1) for w in base if len(w) > 4]
    right = [noisy(r, w, k) for w in base for k in (0, 1, 1, len(w) // 10)] + [w[: len(w) * 4 // 5] for w in base]
    side = lambda k, ws: [(k, i, " ".join(w)) for i, w in enumerate(ws)]
    df = spark.createDataFrame(side(0, left) + side(1, right) + [(0, 900, ""), (1, 901, "")], "side int, class bigint, text string")
    got = {(x.class_a, x.class_b) for x in overlap.near_pairs(df).collect()}
    want = {(i, j) for i, a in enumerate(left) for j, b in enumerate(right) if a and b and lcs(a, b) >= 0.75 * max(len(a), len(b))}
    assert got == want and want


def test_near_pairs_with_scattered_edits(spark):
    """Changed words that stand nowhere else, spread at random, leave few or no common runs of words."""
    r = random.Random(7)
    base = [[f"{r.choice('abcdefgh')}{r.randint(0, 40)}" for _ in range(n)] for n in (48, 100, 200, 400) for _ in range(2)]
    right = []
    for i, w in enumerate(base):
        for share in (0.15, 0.2, 0.25):
            v = list(w)
            for k in r.sample(range(len(w)), int(len(w) * share)):
                v[k] = f"new{i}x{share}x{k}"
            right.append(v)
        right.append([x if k % 4 else f"every{i}x{k}" for k, x in enumerate(w)])
    side = lambda k, ws: [(k, i, " ".join(w)) for i, w in enumerate(ws)]
    df = spark.createDataFrame(side(0, base) + side(1, right), "side int, class bigint, text string")
    got = {(x.class_a, x.class_b) for x in overlap.near_pairs(df).collect()}
    want = {(i, j) for i, a in enumerate(base) for j, b in enumerate(right) if len(a) == len(b) and lcs(a, b) >= 0.75 * len(a)}
    assert got == want and len(want) == len(right)


def changed(r, w, share, mark):
    """w with that share of its words, at random places, replaced by others or by words found nowhere else."""
    v = list(w)
    for k in r.sample(range(len(w)), round(len(w) * share)):
        v[k] = r.choice(SAY) if r.random() < 0.5 else f"{mark}x{k}"
    return v


@pytest.mark.parametrize("limit", [10**6, 0])
def test_recall_in_every_cell(spark, monkeypatch, limit):
    """Texts of 14 to 400 words with 5 to 25 % changed: no pair over the bound is lost, whichever way prefixes are found."""
    r = random.Random(11)
    left, right, cell = [], [], []
    for n in (14, 20, 30, 48, 60, 120, 400):
        for share in (0.05, 0.10, 0.15, 0.20, 0.23, 0.25):
            for i in range(2):
                base = [r.choice(SAY) if r.random() < 0.7 else f"w{r.randint(0, 300)}" for _ in range(n)]
                left.append(base)
                right.append(changed(r, base, share, f"n{n}i{i}"))
                cell.append((n, share))
    side = lambda k, ws: [(k, i, " ".join(w)) for i, w in enumerate(ws)]
    df = spark.createDataFrame(side(0, left) + side(1, right), "side int, class bigint, text string")
    monkeypatch.setattr(overlap.prefixes, "__defaults__", (limit,))
    got = {(x.class_a, x.class_b) for x in overlap.near_pairs(df).collect()}
    common = {(i, j): overlap.word_lcs(a, b) for i, a in enumerate(left) for j, b in enumerate(right)}
    want = {(i, j) for (i, j), n in common.items() if n >= 0.75 * max(len(left[i]), len(right[j]))}
    assert got == want
    assert {cell[i] for i, j in want if i == j} >= {(n, s) for n, s in cell if s <= 0.23}


def test_few_meetings_in_any_pieces(spark, monkeypatch):
    """Of all meetings of two prefixes few are looked at, no pair over the bound is lost, and sizes of pieces and rounds change nothing."""
    r = random.Random(13)
    vocabulary = [f"v{i}" for i in range(150)]
    texts = [[r.choice(vocabulary) for _ in range(r.randint(30, 120))] for _ in range(150)]
    texts += [changed(r, w, 0.2, f"x{i}") for i, w in enumerate(texts)]
    rows = [(k % 2 if k < 150 else 1 - k % 2, k, " ".join(w)) for k, w in enumerate(texts)]
    df = spark.createDataFrame(rows, "side int, class bigint, text string")
    want = {(i, j) for s, i, _ in rows for t, j, _ in rows if s < t and overlap.word_lcs(texts[i], texts[j]) >= 0.75 * max(len(texts[i]), len(texts[j]))}
    sets = df.select("side", "class", overlap.occurrences(F.split("text", " ")).alias("set"))
    both = sets.select("side", F.explode("set").alias("g")).groupBy("g").agg(F.count("*").alias("df"), F.countDistinct("side").alias("n")).filter("n = 2").drop("n")
    d = overlap.prefixes(sets, both).toArrow().to_pandas()
    a, b = (overlap.pa.Table.from_pandas(d[d["side"] == k], preserve_index=False) for k in (0, 1))
    index, entries = overlap._index(a), overlap._entries(b)
    meetings, looked = overlap._meetings, []
    monkeypatch.setattr(overlap, "_meetings", lambda a, b, start, count, e: (looked.append(int(count.sum())), meetings(a, b, start, count, e))[1])
    found = []
    for pieces in ((10**6, 10**6), (7, 5), (1000, 1)):
        monkeypatch.setattr(overlap, "PROBES", pieces[0])
        monkeypatch.setattr(overlap, "MEETINGS", pieces[1] * 100)
        found.append({(int(index["class"][i]), int(entries["class"][j])) for x, y in overlap._meet(index, entries) for i, j in zip(x, y)})
        if len(found) == 1:
            n = [Counter(g for gs in x["gs"].to_pylist() for g in gs) for x in (a, b)]
            assert 0 < sum(looked) < sum(n[0][g] * n[1][g] for g in n[0]) / 2
    assert found[0] == found[1] == found[2] and found[0] >= want and len(want) >= 140
    monkeypatch.undo()
    monkeypatch.setattr(overlap, "TILE", 1000)
    assert {(x.class_a, x.class_b) for x in overlap.near_pairs(df).collect()} == want


def test_overlap_query(spark, folder):
    text = " ".join(SAY)
    m = lambda t: [("user", t), ("assistant", "so?"), (None, None), ("user", None)]
    c = spark.createDataFrame([
        ("train_math_00001", None, "What? (secondary: Where)", None, "s", m(text), 1), ("train_math_00001", None, "What? (secondary: Where)", None, "s", m(text), 1),
        ("train_math_00002", None, None, None, None, m(text.upper() + "!!"), 1), ("train_math_00003", None, None, None, None, None, 1),
        ("test_math_00001", None, "where", None, "s", m("other words here"), 1),
    ], CONV)
    b = spark.createDataFrame([("eval_dev_math_00001", None, "TBD", None, None, [text[:60], None, text[60:]], 1), ("eval_dev_math_00002", None, None, None, None, None, 1)], PLAN)
    d = folder(convs=c, blueprints=b)
    got = {tuple(r) for r in overlap.p2_found(spark, d).collect()}
    assert got == {("eval_dev_math_00001", "train_math_00001"), ("eval_dev_math_00001", "train_math_00002"), ("test_math_00001", "train_math_00001")}
    assert sum(r.n_pairs for r in overlap.p2_report(spark, d).collect()) == 3
    e = folder(convs=c.filter("false"), blueprints=b.filter("false"))
    assert overlap.p2_found(spark, e).count() == 0


def test_leaks_against_brute_force(spark):
    r = random.Random(3)
    texts = [[r.choice(SAY) for _ in range(n)] for n in (8, 10, 12, 25, 40)]
    docs = []
    for w in texts:
        for k in (9, 10, 11, 24):
            i = r.randrange(max(1, len(w) - k))
            docs.append(["pre", *w[i : i + k], "post"])
            docs.append(noisy(r, w[i : i + k], 1))
    items = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(texts)] + [(90, None), (91, ""), (0, " ".join(texts[0]))], "item bigint, text string")
    corpus = spark.createDataFrame([(i, 0, ", ".join(w).upper()) for i, w in enumerate(docs)] + [(99, 0, None), (3, 0, ", ".join(docs[3]).upper())], "doc bigint, pos int, text string")
    for window, errors in ((10, 0), (20, 1)):
        got = {(x.item, x.doc): x.distance for x in leakage.leaked_passages(items, corpus, window, errors).collect()}
        want = {}
        for i, w in enumerate(texts):
            for j, t in enumerate(docs):
                best = min((edit_in(w[k : k + window], t) for k in range(len(w) - window + 1)), default=99)
                if best <= errors:
                    want[i, j] = best
        assert got == want and want


def test_leaks_without_broadcast(spark, monkeypatch):
    items = spark.createDataFrame([(1, " ".join(SAY)), (2, " ".join(SAY[::-1]))], "item bigint, text string")
    corpus = spark.createDataFrame([(i, 0, " ".join(SAY[i : i + 12])) for i in range(30)], "doc bigint, pos int, text string")
    want = sorted(map(str, leakage.leaked_passages(items, corpus).collect()))
    monkeypatch.setattr(leakage, "BROADCAST_ROWS", 0)
    assert sorted(map(str, leakage.leaked_passages(items, corpus).collect())) == want and want


def test_hot_passages_and_texts(spark, monkeypatch):
    """One passage in most messages and one text near most others, with keys split from a hundred rows on."""
    say = " ".join(SAY[:14])
    items = spark.createDataFrame([(i, say if i < 3 else f"{say} {i}") for i in range(6)], "item bigint, text string")
    corpus = spark.createDataFrame([(i, 0, f"m{i} {say}" if i % 4 else f"m{i}") for i in range(1200)], "doc bigint, pos int, text string")
    texts = [(0, i, f"{say} e{i}") for i in range(20)] + [(1, i, f"{say} t{i}") for i in range(400)] + [(1, 900, " ".join(SAY[14:]))]
    df = spark.createDataFrame(texts, "side int, class bigint, text string")
    want = {(i, d) for i in range(6) for d in range(1200) if d % 4}
    for hot in (100, 10**6):
        monkeypatch.setattr(scale.salted_join, "__defaults__", ("inner", hot, None))
        for rows in (0, 10**6):
            monkeypatch.setattr(leakage, "BROADCAST_ROWS", rows)
            assert {(x.item, x.doc) for x in leakage.leaked_passages(items, corpus).collect()} == want
        assert {(x.class_a, x.class_b) for x in overlap.near_pairs(df).collect()} == {(i, j) for i in range(20) for j in range(400)}


def test_leak_query(spark, folder):
    turn = " ".join(SAY[:12])
    c = spark.createDataFrame([
        ("train_math_00001", None, None, None, None, [("user", "hm"), ("assistant", "well, *" + "* ".join(SAY[1:12]) + "?")], 1),
        ("train_math_00002", None, None, None, None, [("user", " ".join(SAY[:9])), ("user", " ".join(SAY[9:12])), (None, None)], 1),
        ("test_math_00003", None, None, None, None, [("user", turn)], 1), ("train_math_00004", None, None, None, None, None, 1),
    ], CONV)
    b = spark.createDataFrame([("eval_dev_math_00001", None, None, None, None, [None, turn, ""], 1), ("eval_dev_math_00002", None, None, None, None, None, 1)], PLAN)
    d = folder(convs=c, blueprints=b)
    assert [tuple(r) for r in leakage.p6_found(spark, d).collect()] == [("eval_dev_math_00001", "train_math_00001")]
    assert leakage.p6_leaked_turns(spark, d).count() == 0
    e = folder(convs=c.filter("false"), blueprints=b.filter("false"))
    assert leakage.p6_found(spark, e).count() == 0


def test_leaked_turns_of_any_length(spark, folder):
    changed = [*SAY[:9], "new", *SAY[10:20]]
    c = spark.createDataFrame([
        ("train_math_00001", None, None, None, None, [("user", " ".join(SAY[:12])), ("assistant", " ".join(SAY[:12]))], 1),
        ("train_math_00002", None, None, None, None, [("user", "so " + " ".join(SAY[1:12]).upper())], 1), ("train_math_00003", None, None, None, None, [("user", " ".join(changed))], 1),
    ], CONV)
    turns = [" ".join(SAY[:12]), " ".join(SAY[:9]), None, " ".join(SAY[2:12]), " ".join([*SAY[:20], "end"])]
    b = spark.createDataFrame([("eval_dev_math_00001", None, None, None, None, turns, 1), ("eval_dev_math_00002", None, None, None, None, [SAY[0]], 1)], PLAN)
    d = folder(convs=c, blueprints=b)
    got = {(r.id, r.turn): (r.n_convs, r.least_distance) for r in leakage.p6_turns(spark, d).collect()}
    assert got == {("eval_dev_math_00001", 1): (2, 0), ("eval_dev_math_00001", 4): (2, 0), ("eval_dev_math_00001", 5): (3, 0)}
    assert {i for i, _ in got} == {r.id_a for r in leakage.p6_found(spark, d).collect()}
