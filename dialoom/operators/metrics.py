"""Metrics over verdict rows. Verdicts may be null (no judgement); such rows count for nothing but judge_errors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CATEGORIES = ("howto", "factual", "emotional", "meta", "math", "smalltalk")
_PAYLOAD = ["landed_at", "judged_at", "passed", "syntax_pass", "leak_pass", "judge_error", "category", "reply", "leak_reason"]


def latest(verdicts: DataFrame) -> DataFrame:
    """One row a (model_slug, scenario_id, turn): the one that landed last; ties by the other columns, nulls last.

    An aggregate with map-side combination, not a window: a key that was delivered very often costs no task its memory.
    """
    return verdicts.groupBy("model_slug", "scenario_id", "turn").agg(F.max(F.struct(*_PAYLOAD)).alias("v")).select(
        "model_slug", "scenario_id", "turn", *[F.col(f"v.{c}").alias(c) for c in _PAYLOAD]
    )


def clean_category(c):
    return F.regexp_replace(F.lower(F.trim(c)), "[^a-z]", "")


def adherence(rows: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Counts and adherence by each of the grouping sets, in one pass; a column not grouped by is null."""
    cols = list(dict.fromkeys(c for s in sets for c in s))
    judged = ~F.coalesce("judge_error", F.lit(False)) & F.col("passed").isNotNull()
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *cols).agg(
        F.count("*").alias("n_rows"), F.count_if(judged).alias("n_judged"), F.count_if(judged & F.col("passed")).alias("n_passed"),
        F.count_if(~judged).alias("n_errors"), F.count_if(judged & ~F.col("syntax_pass")).alias("n_syntax"),
        F.count_if(judged & F.col("syntax_pass") & ~F.col("leak_pass")).alias("n_leak"),
        (F.count_if(judged & F.col("passed")) / F.greatest(F.lit(1), F.count_if(judged))).alias("adherence"),
    )


def scenario_outcomes(rows: DataFrame, by: list[str]) -> DataFrame:
    """by, scenario_id, all_passed, any_error, n_failed; null verdicts are errors."""
    error = F.coalesce("judge_error", F.lit(False)) | F.col("passed").isNull()
    return rows.groupBy(*by, "scenario_id").agg(
        F.bool_and(F.coalesce("passed", F.lit(False))).alias("all_passed"), F.bool_or(error).alias("any_error"),
        F.count_if(~F.coalesce("passed", F.lit(True))).alias("n_failed"),
    )


def robustness(rows: DataFrame, by: list[str]) -> DataFrame:
    """Share of fully judged scenarios without a failing reply."""
    s = scenario_outcomes(rows, by)
    clean, good = F.count_if(~F.col("any_error")), F.count_if(~F.col("any_error") & F.col("all_passed"))
    return s.groupBy(*by).agg(F.count("*").alias("n_scenarios"), clean.alias("n_clean"), good.alias("n_robust"), (good / F.greatest(F.lit(1), clean)).alias("robustness"))


def failure_pivot(rows: DataFrame, by: str) -> DataFrame:
    """Failing share by category as columns; null where nothing was judged."""
    failed = 1.0 - F.col("passed").cast("double")
    return rows.filter("passed is not null").groupBy(by).pivot("category", list(CATEGORIES)).agg(F.avg(failed))


def running_best(series: DataFrame, order: str, value: str, drop: float) -> DataFrame:
    """Adds the best value so far and whether this one fell more than `drop` below it. series: one row a step, small."""
    from pyspark.sql.window import Window as W

    before = W.partitionBy(F.lit(0)).orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    return series.withColumn("best_before", F.max(value).over(before)).withColumn("regressed", F.col(value) < F.col("best_before") - drop)
