"""Writers. Spark's commit protocol makes each write all or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def append_new(df: DataFrame, path: str, key: str) -> None:
    """Appends the rows whose key the target does not hold yet; repeating the call changes nothing."""
    spark = df.sparkSession
    try:
        have = spark.read.schema(df.schema).json(path).select(key)
        df = df.join(have, key, "left_anti")
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.dropDuplicates([key]).write.mode("append").json(path)


def by_key(df: DataFrame, path: str, parts: list[str]) -> None:
    """One table partitioned by a few low-cardinality columns, instead of a file a record."""
    df.write.mode("overwrite").partitionBy(*parts).parquet(path)


def csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def keep_if_full(df: DataFrame, path: str, cap: int) -> bool:
    """Writes unless the target already holds at least cap rows; tells whether it wrote."""
    spark = df.sparkSession
    try:
        if spark.read.schema(df.schema).json(path).count() >= cap:
            return False
    except Exception as e:  # noqa: BLE001
        if "PATH_NOT_FOUND" not in str(e):
            raise
    df.write.mode("overwrite").json(path)
    return True


def nested_summary(rows: DataFrame, by: str) -> DataFrame:
    """One JSON text a group: its rows as an array, in the order of all columns. For metric rows, which are few."""
    others = [c for c in rows.columns if c != by]
    return rows.groupBy(by).agg(F.to_json(F.sort_array(F.collect_list(F.struct(*others)))).alias("rows"))


def markdown(df: DataFrame, percents: tuple[str, ...] = (), limit: int = 1000) -> str:
    """A Markdown table of a small frame, rendered on the driver; more than `limit` rows are an error, not cut off."""
    rows = df.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} rows for a Markdown table")
    show = lambda c, v: "-" if v is None else f"{v:.1%}" if c in percents else str(v)
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join(lines + ["| " + " | ".join(show(c, r[c]) for c in df.columns) + " |" for r in rows]) + "\n"


def append_metrics(rows: DataFrame, path: str) -> None:
    """Appends metric rows, a JSON object a line; what is no finite number is kept as null and marked."""
    numbers = [c for c, kind in rows.dtypes if kind in ("double", "float")]
    odd = F.array_compact(F.array(*[F.when(F.isnan(c) | (F.abs(F.col(c)) == float("inf")), F.lit(c)) for c in numbers], F.lit(None).cast("string")))
    finite = {c: F.when(~F.isnan(c) & (F.abs(F.col(c)) != float("inf")), F.col(c)) for c in numbers}
    rows.withColumn("not_finite", odd).withColumns(finite).write.mode("append").json(path)


def dataset_card(records: DataFrame, title: str) -> str:
    """A Markdown card of records(id, status, regens, messages): counts by split and category, messages and regenerations."""
    part = lambda k: F.regexp_extract("id", r"^(.+)_([a-z]+)_(\d+)$", k)
    n = F.coalesce(F.size(F.coalesce("messages", F.array().cast("array<struct<role: string, content: string>>"))), F.lit(0))
    by = records.groupBy(part(1).alias("split"), part(2).alias("category")).agg(
        F.count("*").alias("records"), F.count_if(F.col("status") == "ok").alias("kept"), F.sum(n).alias("messages"), F.sum(F.coalesce("regens", F.lit(0))).alias("regenerated")
    )
    return f"# {title}\n\n" + markdown(by.orderBy("split", "category"))
