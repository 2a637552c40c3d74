"""The records the operators work on: ids, ties between records, and messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.normalize import match_key

ID = r"^(.+)_([a-z]+)_(\d+)$"
# What stands in for a missing topic or question, as match_key writes it.
STAND_INS = (
    "na", "nan", "none", "null", "nil", "tbd", "tba", "todo", "unknown", "undefined", "unspecified", "missing", "empty",
    "blank", "untitled", "notset", "notavailable", "notapplicable", "notopic", "noquestion", "placeholder", "x", "xx", "xxx",
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_of(i: Column) -> Column:
    return F.regexp_extract(i, ID, 1)


def category_of(i: Column) -> Column:
    return F.regexp_extract(i, ID, 2)


def questions(core_question: Column) -> Column:
    """The core question and the secondary one behind it, each by itself."""
    first = F.regexp_replace(core_question, r"(?is)\(\s*secondary\s*:.*$", "")
    second = F.regexp_extract(core_question, r"(?is)\(\s*secondary\s*:(.*)\)[^)]*$", 1)
    return F.array(first, second)


def tie_keys(topic: Column, core_question: Column) -> Column:
    """Keys that tie records: t:topic and q:question; what is missing or a stand-in gives no key."""
    stand_in = lambda k: k.isin(*STAND_INS)
    keyed = lambda text, kind: F.when(~stand_in(match_key(text)), F.concat(F.lit(kind), match_key(text)))
    q = questions(core_question)
    return F.array_compact(F.array(keyed(topic, "t:"), keyed(q[0], "q:"), keyed(q[1], "q:")))


def ties(records: DataFrame) -> DataFrame:
    """(id, key), distinct, of records with id, topic and core_question; rows of one id are one record."""
    flat = records.select("id", F.explode_outer(tie_keys(F.col("topic"), F.col("core_question"))).alias("key"))
    return flat.filter(F.col("id").isNotNull() & F.col("key").isNotNull()).distinct()


def all_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    cols = ["id", "topic", "core_question"]
    return table(spark, sf_dir, "convs").select(cols).unionAll(table(spark, sf_dir, "blueprints").select(cols))


def messages(convs: DataFrame) -> DataFrame:
    """(id, pos, role, content) of each message; rows of one id are one record, the first by content stands for it."""
    return (
        convs.select("id", F.posexplode("messages").alias("pos", "m"))
        .select("id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
        .filter(F.col("content").isNotNull())
        .groupBy("id", "pos")
        .agg(F.min(F.struct("content", "role")).alias("m"))
        .select("id", "pos", F.col("m.role").alias("role"), F.col("m.content").alias("content"))
    )
