"""Problem 8: mixing sources to target weights.

Each document of a source is due the same number of copies, the source's target over its size and at most max_repeats.
Systematic sampling turns that into whole copies: along a permutation of the source the dues are summed up, one random
offset is added, and a copy is emitted for each whole number that is crossed. The running sums are two-level, so that no
task holds a source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.llm.records import table
from dialoom.operators.assemble import shuffled
from dialoom.operators.scale import cut

SEED = 20240817


def source_key(c: Column) -> Column:
    """A source name without case, outer spaces, and with _ for spaces and hyphens; null when nothing is left."""
    k = F.regexp_replace(F.lower(F.regexp_replace(c, r"(?U)^\s+|\s+$", "")), r"(?U)[\s\-_]+", "_")
    return F.when(k != "", k)


def tokens(text: Column) -> Column:
    """Size in tokens of the byte-level tokenizer: UTF-8 bytes, 0 for null."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("bigint")


def sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", source_key(F.col("source")).alias("source"), tokens(F.col("text")).alias("tokens"))


def rates(plan: DataFrame, docs: DataFrame) -> DataFrame:
    """Adds source_docs, source_tokens, due (copies of each document) and reachable to the plan's rows.

    A row a (mix, source). A source without documents has size 0 and due 0; null shares, totals or repeats count as 0.
    """
    size = docs.groupBy("source").agg(F.count("*").alias("source_docs"), F.sum("tokens").alias("source_tokens"))
    p = plan.withColumn("source_name", F.col("source")).withColumn("source", source_key(F.col("source")))
    p = p.join(size, "source", "left").withColumns({c: F.coalesce(c, F.lit(0).cast("bigint")) for c in ("source_docs", "source_tokens")})
    wish = F.coalesce(F.col("target_share") * F.col("total_tokens"), F.lit(0.0))
    most = F.coalesce("max_repeats", F.lit(0))
    return p.withColumns({
        "wish": wish,
        "due": F.when(F.col("source_tokens") > 0, F.least(wish / F.col("source_tokens"), most.cast("double"))).otherwise(F.lit(0.0)),
        "reachable": most * F.col("source_tokens") >= wish,
    })


def mix(docs: DataFrame, rated: DataFrame, seed: int = SEED) -> DataFrame:
    """(mix_name, doc_id, source, tokens, copies): documents used at least once.

    docs: (doc_id, source, tokens); documents of no source, or of one the plan lacks, are left out. Along the source's
    permutation document r (from 1) gets floor(r * due + u) - floor((r - 1) * due + u) copies, so never more than
    max_repeats, and the total number of copies is within one of what is due.
    """
    placed = shuffled(docs.filter(F.col("source").isNotNull()), ["source"], "doc_id", str(seed), "rank")
    # A row a (mix, source) of the plan, whatever the size of the data.
    r = F.broadcast(rated.select("mix_name", "source", "due"))
    u = F.conv(F.left(F.md5(F.concat_ws("|", "mix_name", "source", F.lit(seed))), F.lit(8)), 16, 10).cast("bigint") / F.lit(2.0**32)
    upto = lambda k: F.floor(k * F.col("due") + u)
    copies = upto(F.col("rank")) - upto(F.col("rank") - 1)
    return placed.join(r, "source").select("mix_name", "doc_id", "source", "tokens", copies.cast("int").alias("copies")).filter("copies > 0")


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The plan's rows with what was emitted for them: copies, mixed_tokens, most_copies; a row a (mix, source)."""
    rated = cut(rates(plan, docs))
    got = mix(docs, rated).groupBy("mix_name", "source").agg(
        F.sum("copies").alias("copies"), F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.max("copies").alias("most_copies")
    )
    zero = {c: F.coalesce(c, F.lit(0)) for c in ("copies", "mixed_tokens", "most_copies")}
    return rated.join(got, ["mix_name", "source"], "left").withColumns(zero)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of mix_plan for which every document was emitted as often as allowed, and still too few tokens."""
    m = mixed(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_plan"))
    in_full = F.col("copies") == F.coalesce("max_repeats", F.lit(0)) * F.col("source_docs")
    return m.filter(in_full & (F.col("mixed_tokens") < F.col("wish"))).select("mix_name", F.col("source_name").alias("source")).distinct()


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Copies of each document in each mix."""
    docs = sized_documents(spark, sf_dir)
    return mix(docs, cut(rates(table(spark, sf_dir, "mix_plan"), docs)))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares reached by source against those asked for."""
    return mixed(sized_documents(spark, sf_dir), table(spark, sf_dir, "mix_plan")).select(
        "mix_name", F.col("source_name").alias("source"), "target_share", "total_tokens", "source_tokens",
        F.col("mixed_tokens").cast("bigint").alias("mixed_tokens"),
        (F.col("mixed_tokens") / F.col("total_tokens")).alias("share"), "most_copies", "max_repeats", "reachable",
    )
