"""Golden cases of the judge."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from dialoom.functions import judge_text as jt
from dialoom.operators.judge import judged, keyed

RULE = [
    ("", ["<empty response>"]), ("  \n", ["<empty response>"]), (None, ["<empty response>"]), ("What is it?", []), ("Really?!", ["Really?!"]),
    ("Really!?", []), ("No. Why?", ["No."]), ("# Header\nWhat?", ["# Header <no terminator>"]), ("Is it 3.14?", []), ("1. What next?", []),
    ("1. What next? 2. Why?", ["2."]), ("Have you asked Dr. Smith?", []), ("Did J. K. Rowling write it?", []),
    ("The grade was A. Correct?", ["The grade was A."]), ("Do you like cats, etc.?", []),
    ("Do you like cats, etc.", ["Do you like cats, etc‧ <no terminator>"]), ("See https://x.org/a?", ["See https://x‧org/a‧ <no terminator>"]),
    ('What do you think?"', []), ("Is it so? (yes)", ["(yes) <no terminator>"]), ("Это так？", []), ("Это так。", ["Это так。"]), ("...", []),
]
HITS = [
    ("Is it PARIS?", ["Paris"], "Paris", False), ("Is it Parisian?", ["Paris"], None, None), ("six or paris?", ["six", "paris"], "six", True),
    ("é6?", ["6"], "6", True), ("1000 what?", ["1000"], "1000", True), ("x?", ["", "  "], None, None), ("a.b?", ["a.b"], "a.b", True),
    ("a+b (c)?", ["b (c)"], "b (c)", False), (None, ["a"], None, None), ("x?", None, None, None), ("say it?", [None, "say"], "say", True),
]
VERDICTS = [
    ('{"leak": true}', True), ('{"leak": "FALSE"}', False), ('```json\n{"leak": true, "reason": "x"}\n```', True), ('Sure: {"leak": false} ok', False),
    ('{"leak": 1}', None), ('{"leak": null}', None), ("{}", None), ("no", None), (None, None),
]


def test_terminator_rule(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(RULE)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", jt.violations(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(RULE))] == [v for _, v in RULE]


def test_string_hits(spark):
    df = spark.createDataFrame([(i, t, a) for i, (t, a, _, _) in enumerate(HITS)], "i int, t string, a array<string>")
    hit = jt.string_hit(F.col("t"), F.col("a"))
    got = {r.i: (r.h, r.w) for r in df.select("i", hit.alias("h")).withColumn("w", jt.weak(F.col("h"))).collect()}
    assert [got[i] for i in range(len(HITS))] == [(h, w) for _, _, h, w in HITS]


def test_parsed_verdict(spark):
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(VERDICTS)], "i int, t string")
    got = {r.i: r.v for r in df.select("i", jt.parsed_verdict(F.col("t")).alias("v")).collect()}
    assert [got[i] for i in range(len(VERDICTS))] == [v for _, v in VERDICTS]


@pytest.mark.parametrize(("reply", "summary", "answers", "leak", "want"), [
    ("It is so.", "s", ["Paris"], None, (False, None, False)), ("Is it Paris?", "s", ["Paris"], None, (False, False, False)),
    ("Is it?", None, [], None, (True, True, False)), ("Is it?", "s", ["Paris"], True, (False, False, False)),
    ("Is it?", "s", ["Paris"], False, (True, True, False)), ("Is it?", "s", ["Paris"], None, (None, None, True)),
    ("Is it six?", "s", ["six", "is it"], None, (None, None, True)),
])
def test_outcome(spark, reply, summary, answers, leak, want):
    r = spark.createDataFrame([("k", reply, summary, answers)], "verdict_key string, reply string, answer_summary string, expected_answers array<string>")
    v = spark.createDataFrame([] if leak is None else [("k", leak)], "verdict_key string, leak boolean")
    x = judged(r, v).collect()[0]
    assert (x.passed, x.leak_pass, x.judge_error) == want


def test_text_is_stripped_before_it_is_masked(spark):
    df = spark.createDataFrame([(1, "What?\n2. "), (2, " \n1. What?"), (3, "What?\u2028 2. why?")], "i int, t string")
    got = {r.i: r.v for r in df.select("i", jt.violations(F.col("t")).alias("v")).collect()}
    assert got == {1: ["2."], 2: [], 3: ["2."]}


def test_keys_are_those_of_json(spark):
    rows = [["a", 'b"\\ü\n\t', "\x1f\x0b\\u001F\x01\x7f"], ["", None, "x"], []]
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, a array<string>")
    got = {r.i: r.j for r in df.select("i", jt.json_list(F.col("a")).alias("j")).collect()}
    assert got == {i: json.dumps(r, ensure_ascii=False) for i, r in enumerate(rows)}
    key = df.filter("i = 0").select(jt.verdict_key(F.col("a")[0], F.col("a")[1], F.col("a")[2])).collect()[0][0]
    assert key == hashlib.sha256(json.dumps(rows[0], ensure_ascii=False).encode()).hexdigest()


def test_parsed_array(spark):
    cases = [('["a", "b"]', ["a", "b"]), ('```json\n["é"]\n```', ["é"]), ('Here: ["a"] ok', ["a"]), ("[]", []), ("none", None), ('{"a": 1}', None), (None, None)]
    df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "i int, t string")
    got = {r.i: r.a for r in df.select("i", jt.parsed_array(F.col("t")).alias("a")).collect()}
    assert [got[i] for i in range(len(cases))] == [a for _, a in cases]


def test_reasons_and_keys(spark):
    rows = [("It is so.", "s", ["Paris"]), ("Is it Paris?", "s", ["Paris"]), ("Is it?", None, []), ("Is it?", "s", ["Paris"]), ("Is it 6?", None, ["6"]), ("Why?", "s", None)]
    r = keyed(spark.createDataFrame([("q", *x) for x in rows], "core_question string, reply string, answer_summary string, expected_answers array<string>"))
    keys = {x.reply: x.verdict_key for x in r.collect() if x.answer_summary or x.expected_answers}
    assert len(set(keys.values())) == len(keys)
    v = spark.createDataFrame([(keys["Is it?"], True, "told"), (keys["Is it 6?"], False, None), (keys["Is it 6?"], False, None)], "verdict_key string, leak boolean, reason string")
    got = sorted((x.reply, x.passed, x.leak_reason) for x in judged(r, v).collect() if x.answer_summary or x.expected_answers)
    assert got == [("Is it 6?", True, None), ("Is it Paris?", False, "string match: Paris"), ("Is it?", False, "told"), ("It is so.", False, None), ("Why?", None, "no verdict")]
