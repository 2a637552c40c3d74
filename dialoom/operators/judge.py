"""The judge: terminator rule, answer matching, and verdicts supplied from outside, three-valued."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dialoom.functions.judge_text import QUESTION, answer_text, string_hit, verdict_key, violations, weak
from dialoom.operators.scale import salted_join


def judged(replies: DataFrame, verdicts: DataFrame | None = None, allowed: str = QUESTION) -> DataFrame:
    """Adds syntax_pass, syntax_violations, hit, leak_pass, leak_reason, passed, judge_error to replies.

    replies: reply, answer_summary, expected_answers, and verdict_key if verdicts(verdict_key, leak, and reason if known) are given. A reply that
    breaks the rule fails with a null leak_pass. A strong hit fails; without anything to leak the reply passes; else the
    verdict decides, and without one passed is null and judge_error true. Only the first hit counts, even if it is weak.
    """
    d = replies.withColumn("syntax_violations", violations(F.col("reply"), allowed))
    d = d.withColumn("syntax_pass", F.size("syntax_violations") == 0).withColumn("hit", string_hit(F.col("reply"), F.col("expected_answers")))
    if verdicts is not None:
        why = F.col("reason") if "reason" in verdicts.columns else F.lit(None).cast("string")
        # Verdict keys are unique, so the join adds no rows; one reply may be given very often.
        known = verdicts.groupBy("verdict_key").agg(F.min(F.struct(F.col("leak").alias("leak"), why.alias("reason"))).alias("__v"))
        d = salted_join(d, known, "verdict_key", "left")
        d = d.select(*[c for c in d.columns if c != "__v"], F.col("__v.leak").alias("__leak"), F.col("__v.reason").alias("__reason"))
    else:
        d = d.withColumns({"__leak": F.lit(None).cast("boolean"), "__reason": F.lit(None).cast("string")})
    nothing = (F.coalesce(F.col("answer_summary"), F.lit("")) == "") & (F.coalesce(F.size("expected_answers"), F.lit(0)) <= 0)
    strong = F.col("hit").isNotNull() & ~weak(F.col("hit"))
    leak_pass = F.when(F.col("syntax_pass"), F.when(strong, False).when(nothing, True).otherwise(~F.col("__leak")))
    reason = F.when(strong, F.concat(F.lit("string match: "), "hit")).when(nothing, "no extractable answer").when(
        F.col("__leak").isNull(), "no verdict").otherwise(F.col("__reason"))
    d = d.withColumns({"leak_pass": leak_pass, "leak_reason": F.when(F.col("syntax_pass"), reason)})
    return d.withColumn("passed", F.when(~F.col("syntax_pass"), False).otherwise(F.col("leak_pass"))).withColumn(
        "judge_error", F.col("passed").isNull()
    ).drop("__leak", "__reason")


def keyed(replies: DataFrame) -> DataFrame:
    """Adds verdict_key to replies(core_question, answer_summary, expected_answers, reply).

    A weak answer that stands in the reply is named in the answer's text, so such replies have keys of their own.
    """
    hit = string_hit(F.col("reply"), F.col("expected_answers"))
    note = F.when(weak(hit), F.concat(F.lit(" (short variant in the reply: "), hit, F.lit(")")))
    answer = F.concat(answer_text(F.col("answer_summary"), F.col("expected_answers")), F.coalesce(note, F.lit("")))
    return replies.withColumn("verdict_key", verdict_key(F.coalesce("core_question", F.lit("")), answer, F.coalesce("reply", F.lit(""))))
