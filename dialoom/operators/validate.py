"""Structural checks over nested records: arrays of issue names, empty when nothing is wrong."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from dialoom.functions.judge_text import py_strip, string_hit, violations, weak


def _issues(*pairs: tuple[Column, str]) -> Column:
    return F.array_compact(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(name)) for c, name in pairs]))


def conversation_issues(messages: Column) -> Column:
    """Issues of a dialogue that should alternate user and assistant, start with the user and say something each time."""
    n = F.coalesce(F.size(messages), F.lit(0))
    turn = lambda m, i: m["role"] != F.when(i % 2 == 0, "user").otherwise("assistant")
    return _issues(
        (messages.isNull() | (n <= 0), "no messages"),
        (n % 2 == 1, "odd length"),
        (F.exists(F.transform(messages, lambda m, i: F.coalesce(turn(m, i), F.lit(True))), lambda b: b), "roles do not alternate"),
        (F.exists(messages, lambda m: F.trim(F.coalesce(m["content"], F.lit(""))) == ""), "empty content"),
        (F.get(messages, n - 1)["role"] == "user", "unanswered"),
    )


def scenario_issues(turns: Column, answers: Column, required: list[Column], low: int, high: int) -> Column:
    """Issues of a scenario: missing fields, turn count out of range, blank turns, turns that say an answer."""
    missing = [(c.isNull() | (F.trim(c) == ""), f"missing field {i}") for i, c in enumerate(required)]
    n = F.coalesce(F.size(turns), F.lit(0))
    return _issues(
        *missing,
        ((n < low) | (n > high), "turn count"),
        (F.exists(turns, lambda t: F.trim(F.coalesce(t, F.lit(""))) == ""), "blank turn"),
        (F.exists(turns, lambda t: string_hit(t, answers).isNotNull()), "turn says an answer"),
    )


def _user_issues(turns: Column, answers: Column) -> Column:
    """What is wrong with user turns: nothing said, or any expected answer in it, however weak."""
    said = lambda t, i: F.when(
        py_strip(F.coalesce(t, F.lit(""))) == "", F.format_string("user turn %d empty", i + 1)
    ).when(string_hit(t, answers).isNotNull(), F.format_string("user turn %d says the answer %s", i + 1, string_hit(t, answers)))
    return F.array_compact(F.transform(turns, said))


def dialogue_issues(messages: Column, answers: Column, n_turns: Column) -> Column:
    """Issues of a dialogue of n_turns user and as many assistant messages; one of another length has that issue only.

    Assistant messages must keep the terminator rule and hold no strong answer, user messages none at all.
    """
    text = lambda m: F.coalesce(m["content"], F.lit(""))
    want = lambda i: F.when(i % 2 == 0, "user").otherwise("assistant")
    shape = lambda m, i: F.when(
        ~m["role"].eqNullSafe(want(i)) | (py_strip(text(m)) == ""), F.format_string("message %d is no %s message", i, want(i))
    )
    turn = lambda i: (F.floor(i / 2) + 1).cast("int")
    rule = lambda m, i: F.when((m["role"] == "assistant") & (F.size(violations(text(m))) > 0), F.format_string("turn %d breaks the rule", turn(i)))

    def leak(m: Column, i: Column) -> Column:
        hit = string_hit(text(m), answers)
        return F.when((m["role"] == "assistant") & hit.isNotNull() & ~weak(hit), F.format_string("turn %d says the answer %s", turn(i), hit))

    own = F.flatten(F.transform(messages, lambda m, i: F.array(rule(m, i), leak(m, i))))
    users = F.transform(F.filter(messages, lambda m: m["role"] == "user"), lambda m: m["content"])
    every = F.concat(F.array_compact(F.transform(messages, shape)), F.array_compact(own), _user_issues(users, answers))
    wrong = F.array(F.format_string("needs %d messages", n_turns * 2))
    return F.when(F.coalesce(F.size(messages), F.lit(-1)) == n_turns * 2, every).otherwise(wrong)


def turn_list_issues(turns: Column, answers: Column, n_turns: Column) -> Column:
    """Issues of a held-out record with n_turns user turns and no replies."""
    count = F.when(F.coalesce(F.size(turns), F.lit(-1)) == n_turns, F.array().cast("array<string>")).otherwise(F.array(F.format_string("needs %d turns", n_turns)))
    return F.concat(count, _user_issues(F.coalesce(turns, F.array().cast("array<string>")), answers))
