"""Readers, writers and the inbox on a temporary folder."""

import hashlib
import json
import os

from dialoom import schemas
from dialoom.sources import readers, sinks
from dialoom.streaming import inbox


def test_readers(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"id": "x", "turns": ["a"]}\n\n   \nnot json\n')
    rows = readers.jsonl(spark, str(tmp_path / "a.jsonl"), schemas.RAW).collect()
    assert [(r.id, r._corrupt_record) for r in rows] == [("x", None), (None, "not json")]
    os.mkdir(tmp_path / "d")
    (tmp_path / "d/train_1.json").write_text(json.dumps({"id": "t1", "messages": [{"role": "user", "content": "hé"}]}, indent=1))
    (tmp_path / "d/eval_1.json").write_text("{broken")
    d = {r.file_name: r for r in readers.documents(spark, str(tmp_path / "d"), schemas.RAW).collect()}
    assert d["train_1.json"].messages[0].content == "hé" and d["eval_1.json"]._corrupt_record
    assert readers.documents(spark, str(tmp_path / "d"), schemas.RAW, "train_*.json").count() == 1
    assert len(readers.file_hashes(spark, str(tmp_path / "d")).collect()[0].sha) == 16
    (tmp_path / "plan.json").write_text('{"jobs": {"math": 3, "meta": 4}}')
    assert dict(map(tuple, readers.plan_counts(spark, str(tmp_path / "plan.json"), "jobs").collect())) == {"math": 3, "meta": 4}
    names = spark.createDataFrame([("s500",), ("base",), ("s125",)], "name string")
    assert [r.name for r in readers.checkpoints(names).collect()] == ["base", "s125", "s500"]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, 0.5), ("b", 2, None)], "id string, n int, x double")
    p = str(tmp_path / "out")
    sinks.append_new(df, p, "id")
    sinks.append_new(df, p, "id")
    assert spark.read.json(p).count() == 2
    assert not sinks.keep_if_full(df.limit(1), p, 2) and sinks.keep_if_full(df, p, 3)
    sinks.csv(df, str(tmp_path / "csv"))
    sinks.by_key(df, str(tmp_path / "parts"), ["id"])
    assert sinks.markdown(df.orderBy("id"), ("x",)).splitlines()[2:] == ["| a | 1 | 50.0% |", "| b | 2 | - |"]
    assert json.loads(sinks.nested_summary(df, "id").orderBy("id").collect()[0].rows) == [{"n": 1, "x": 0.5}]


def test_inbox_drains_and_resumes(spark, tmp_path):
    box, state, check = (str(tmp_path / x) for x in ("box", "state", "check"))
    os.mkdir(box)
    put = lambda name, doc: open(f"{box}/{name}", "w").write(doc if isinstance(doc, str) else json.dumps(doc))  # noqa: E731, SIM115
    put("a.json", {"id": "a", "turns": ["x"]})
    put("b.json", "{broken")
    inbox.drain(spark, box, state, check)
    got = {r.id: r for r in inbox.read_state(spark, state).collect()}
    assert got["a"].versions == 1 and got["a"].n_turns == 1 and got["b"].corrupt
    inbox.drain(spark, box, state, check)
    put("a2.json", {"id": "a", "turns": ["x"]})  # the same content again
    inbox.drain(spark, box, state, check)
    assert {r.id: r.versions for r in inbox.read_state(spark, state).collect()} == {"a": 1, "b": 1}
    put("a3.json", {"id": "a", "turns": ["x", "y"]})
    inbox.drain(spark, box, state, check)
    assert {r.id: (r.versions, r.n_turns) for r in inbox.read_state(spark, state).collect()} == {"a": (2, 2), "b": (1, 0)}


def test_inbox_keeps_the_version_written_last(spark, tmp_path):
    state, check = str(tmp_path / "state"), str(tmp_path / "check")
    for n, (first, second) in enumerate((("aaa", "bbb"), ("bbb", "aaa"))):
        box = tmp_path / f"box{n}"
        os.mkdir(box)
        for k, text in enumerate((first, second)):
            f = box / f"{1 - k}.json"  # the later file has the smaller name
            f.write_text(json.dumps({"id": f"x{n}", "turns": [text] * (k + 1)}))
            os.utime(f, (1_700_000_000 + k, 1_700_000_000 + k))
        inbox.drain(spark, str(box), state, f"{check}{n}")
        row = inbox.read_state(spark, state).filter(f"id = 'x{n}'").collect()[0]
        assert (row.n_turns, row.versions) == (2, 1)
        last = hashlib.sha256(json.dumps({"id": f"x{n}", "turns": [second] * 2}).encode()).hexdigest()[:16]
        assert row.content_sha == last and sum(r.id == f"x{n}" for r in inbox.read_state(spark, state).collect()) == 1


def test_inbox_retires_old_versions(spark, tmp_path):
    box, state, check = (str(tmp_path / x) for x in ("box", "state", "check"))
    os.mkdir(box)
    for k in range(6):
        for i in range(3):
            with open(f"{box}/{k}-{i}.json", "w") as f:
                json.dump({"id": f"d{i}", "turns": ["t"] * k}, f)
        inbox.drain(spark, box, state, check)
    assert {r.id: (r.versions, r.n_turns) for r in inbox.read_state(spark, state).collect()} == {f"d{i}": (6, 5) for i in range(3)}
    assert len([d for d in os.listdir(state) if d.startswith("v")]) == 2


def test_verdict_cache_and_its_quarantine(spark, tmp_path):
    assert readers.verdict_cache(spark, str(tmp_path / "none")).count() == 0
    d = tmp_path / "cache"
    os.mkdir(d)
    (d / "a.json").write_text(json.dumps({"k1": {"leak": True, "reason": "told"}, "k2": {"leak": False, "reason": ""}}))
    (d / "b.json").write_text("{broken")
    got = {r.verdict_key: (r.leak, r.reason) for r in readers.verdict_cache(spark, str(d)).collect()}
    assert got == {"k1": (True, "told"), "k2": (False, "")}
    assert sorted(x for x in os.listdir(d) if not x.startswith(".")) == ["a.json", "b.json.corrupt"]


def test_metrics_and_card(spark, tmp_path):
    m = spark.createDataFrame([(1, 0.5), (2, float("nan")), (3, float("inf")), (4, None)], "step int, loss double")
    sinks.append_metrics(m, str(tmp_path / "m"))
    sinks.append_metrics(m.limit(1), str(tmp_path / "m"))
    rows = spark.read.schema("step int, loss double, not_finite array<string>").json(str(tmp_path / "m")).collect()
    assert sorted((r.step, r.loss, tuple(r.not_finite)) for r in rows if r.loss or r.step < 4) == [(1, 0.5, ()), (1, 0.5, ()), (2, None, ("loss",)), (3, None, ("loss",))]
    c = spark.createDataFrame([("train_math_00001", "ok", 2, [("user", "a"), ("assistant", "b")]), ("train_math_00002", None, None, None)],
                              "id string, status string, regens int, messages array<struct<role: string, content: string>>")
    assert sinks.dataset_card(c, "T").splitlines()[-1] == "| train | math | 2 | 1 | 2 | 2 |"


def test_command_line(spark, sf, tmp_path, capsys):
    from dialoom.__main__ import main

    assert main(["list"]) == 0 and "category_counts" in capsys.readouterr().out
    assert main(["run", "category_counts", sf, "--out", str(tmp_path / "o"), "--format", "json"]) == 0 and spark.read.json(str(tmp_path / "o")).count() > 0
    assert main(["run", "distinct_categories", sf]) == 0 and main(["card", sf]) == 0 and "| train |" in capsys.readouterr().out
