"""Problem 5: a sample that matches target category proportions.

Quotas are allocated top-down over a category tree: each cell first asks for the larger of its minimum and its share; what
a cell cannot give goes to its siblings with rows to spare, what the siblings cannot take to its cousins. Members are drawn
at the leaves by permuted dense rank, so a cell of any size is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from dialoom.llm.records import category_of, split_of, table
from dialoom.operators.assemble import shuffled
from dialoom.operators.scale import cut

#: Seed of the permutation that rows are drawn along.
SEED = "sample"

# The parent of each category in the tree.
PARENTS = {
    "howto": "task", "factual": "task", "math": "task",
    "emotional": "talk", "meta": "talk", "smalltalk": "talk",
}


def allocate(targets: DataFrame, available: DataFrame) -> DataFrame:
    """Adds parent, available, want, own, from_siblings, from_cousins, quota, met to targets(split, category, ...).

    want is the larger of min_rows and target_share * sample_rows. The tables here have a row a cell of the target table,
    whatever the size of the data. A quota is whole rows: ceil(want). Unmet rows go out in proportion to what is spare, by
    cumulative rounding, so that none is lost. Null shares and minima count as 0; cells without rows have 0 available.
    """
    tree = F.create_map(*[x for k, v in PARENTS.items() for x in (F.lit(k), F.lit(v))])
    t = targets.join(available, ["split", "category"], "left").withColumns({
        "parent": F.coalesce(F.try_element_at(tree, F.col("category")), F.lit("other")),
        "available": F.coalesce("available", F.lit(0)).cast("bigint"),
        "want": F.greatest(F.coalesce("min_rows", F.lit(0)).cast("double"), F.coalesce(F.col("target_share") * F.col("sample_rows"), F.lit(0.0))),
    })
    t = t.withColumn("need", F.ceil("want")).withColumn("own", F.least("available", "need"))
    t = t.withColumn("unmet", F.col("need") - F.col("own")).withColumn("spare", F.col("available") - F.col("own"))

    def pass_on(d: DataFrame, over, into: str) -> DataFrame:
        """Gives the unmet rows of each group to its members with rows to spare."""
        running = over.orderBy("category").rowsBetween(W.unboundedPreceding, W.currentRow)
        d = d.withColumn("__spare", F.sum("spare").over(over)).withColumn("__give", F.least(F.sum("unmet").over(over), "__spare"))
        upto = F.when(F.col("__spare") > 0, F.floor(F.sum("spare").over(running) * F.col("__give") / F.col("__spare"))).otherwise(0)
        d = d.withColumn("__upto", upto.cast("bigint"))
        d = d.withColumn(into, F.col("__upto") - F.coalesce(F.lag("__upto").over(over.orderBy("category")), F.lit(0)))
        d = d.withColumn("spare", F.col("spare") - F.col(into))
        # What is left is carried by the group's first row, once.
        left = F.sum("unmet").over(over) - F.col("__give")
        first = F.row_number().over(over.orderBy("category")) == 1
        return d.withColumn("unmet", F.when(first, left).otherwise(F.lit(0))).drop("__spare", "__give", "__upto")

    t = pass_on(t, W.partitionBy("split", "parent"), "from_siblings")
    t = pass_on(t, W.partitionBy("split"), "from_cousins")
    quota = F.col("own") + F.col("from_siblings") + F.col("from_cousins")
    return t.withColumn("quota", quota).withColumn("met", F.col("available") >= F.col("want")).drop("need", "unmet", "spare")


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, split, category), distinct, of convs; the id tells both."""
    ids = table(spark, sf_dir, "convs").select("id").filter(F.col("id").isNotNull()).distinct()
    return ids.select("id", split_of(F.col("id")).alias("split"), category_of(F.col("id")).alias("category"))


def plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    available = cells(spark, sf_dir).groupBy("split", "category").agg(F.count("*").alias("available"))
    return allocate(table(spark, sf_dir, "category_targets"), available)


def draw(members: DataFrame, quotas: DataFrame) -> DataFrame:
    """The rows of members(id, split, category) whose permuted rank within their cell is within the cell's quota."""
    placed = shuffled(members, ["split", "category"], "id", SEED, "rank")
    q = F.broadcast(quotas.select("split", "category", "quota"))  # a row a cell of the target table
    return placed.join(q, ["split", "category"]).filter(F.col("rank") <= F.col("quota")).select(*members.columns)


def drawn(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """The sample drawn, and the quotas it was drawn by."""
    members = cut(cells(spark, sf_dir))
    quotas = cut(allocate(table(spark, sf_dir, "category_targets"), members.groupBy("split", "category").agg(F.count("*").alias("available"))))
    return draw(members, quotas), quotas


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of category_targets of which the sample holds fewer rows than wished: all their own, which are too few."""
    sample, quotas = drawn(spark, sf_dir)
    got = sample.groupBy("split", "category").agg(F.count("*").alias("drawn"))
    short = quotas.join(got, ["split", "category"], "left").filter(F.coalesce("drawn", F.lit(0)) < F.col("want"))
    return short.select("split", "category").distinct()


def p5_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cell's rows, wish and quota, and what it took over."""
    return plan(spark, sf_dir).select("split", "category", "available", "want", "own", "from_siblings", "from_cousins", "quota", "met")


def p5_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample drawn."""
    return drawn(spark, sf_dir)[0]
