"""Problem 6: evaluation texts leaking into training text.

Pigeonhole edit matching over words. A passage of `window` words with at most k edits, cut into k + 1 pieces, holds at
least one piece unchanged. Pieces of all evaluation passages are looked up among the runs of as many words in the corpus;
each passage around a hit is verified with Myers' bit-parallel distance against the words of the corpus around that hit.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.normalize import grams, words
from dialoom.llm.records import split_of, table
from dialoom.operators.scale import BROADCAST_ROWS, cut, salted_join, spread

#: Consecutive words that make a leak.
WINDOW = 10


def myers(pattern: list, text: list) -> int:
    """Least edit distance between pattern and any part of text, by Myers' bit vectors over words."""
    m = len(pattern)
    if not m:
        return 0
    at: dict = {}
    for i, x in enumerate(pattern):
        at[x] = at.get(x, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for x in text:
        eq = at.get(x, 0)
        diag = ((((eq & plus) + plus) ^ plus) | eq | minus) & full
        up, down = (minus | ~(diag | plus)) & full, plus & diag
        if up & top:
            score += 1
        elif down & top:
            score -= 1
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~((eq | minus) | up)) & full, up & (eq | minus)
        best = min(best, score)
    return best


def _verify(window: int, errors: int):
    piece = window // (errors + 1)

    def least(item: list[str], doc: list[str], hits: list) -> int:
        """Least distance of the item's passages with a hit piece, wherever it stands in them, to the words around the hit.

        An item's piece is looked up once, so its other places in the item are found here. hits: (place in item, in doc).
        """
        at: dict = {}
        for i in range(len(item) - piece + 1):
            at.setdefault(tuple(item[i : i + piece]), []).append(i)
        best, seen = errors + 1, set()
        for i, j in hits:
            gram = tuple(item[i : i + piece])
            if tuple(doc[j : j + piece]) != gram:
                continue
            for k in at[gram]:
                for w in range(max(0, k - window + piece), min(k, len(item) - window) + 1):
                    low = j - (k - w) - errors
                    around = tuple(doc[max(0, low) : low + window + 2 * errors])
                    if (w, around) not in seen:
                        seen.add((w, around))
                        best = min(best, myers(item[w : w + window], around))
                        if not best:
                            return 0
        return best

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            places = [sorted((h["i"], h["j"]) for h in hs) for hs in d["hits"]]
            d["distance"] = [least(a.split(" "), b.split(" "), h) for a, b, h in zip(d["item_words"], d["doc_words"], places)]
            yield d.loc[d["distance"] <= errors, ["c", "doc", "pos", "distance"]]

    return run


def leaked_passages(items: DataFrame, corpus: DataFrame, window: int = WINDOW, errors: int = 0) -> DataFrame:
    """(item, doc, pos, distance) of corpus texts holding `window` consecutive words of an item with at most `errors` edits.

    items: (item, text), corpus: (doc, pos, text). Words are compared without case, punctuation, spacing, Unicode form and
    invisible characters. Null or shorter texts leak nothing; repeated rows count once; equal items are searched once.
    With no errors the one piece of a passage is the passage. The pieces are broadcast when there are at most
    BROADCAST_ROWS of them, else joined by shuffle with hot runs salted; so are items that very many texts hold.
    """
    piece = window // (errors + 1)
    iw = items.select("item", words(F.col("text")).alias("w")).filter(F.size("w") >= window)
    iw = cut(iw.select("item", F.array_join("w", " ").alias("t")).distinct())
    classes = cut(iw.select("t").distinct().withColumn("c", F.monotonically_increasing_id()))
    # A piece that an item repeats is looked up once.
    pieces = classes.select("c", F.posexplode(grams(F.split("t", " "), piece)).alias("i", "g"))
    pieces = cut(pieces.groupBy("c", "g").agg(F.min("i").alias("i")))
    spoken = corpus.select("doc", "pos", words(F.col("text")).alias("w"))
    # The outer form, for the other one first computes the runs once more to drop texts without any.
    runs = spoken.select("doc", "pos", F.posexplode_outer(grams(F.col("w"), piece)).alias("j", "g"))
    n = pieces.count()
    hits = runs.join(F.broadcast(pieces), "g") if n <= BROADCAST_ROWS else salted_join(runs, pieces, "g")
    hits = cut(hits.groupBy("doc", "pos", "c").agg(F.collect_set(F.struct("i", "j")).alias("hits")))
    docs = hits.select("doc", "pos").distinct()
    if docs.count() <= BROADCAST_ROWS:
        docs = F.broadcast(docs)
    texts = corpus.join(docs, ["doc", "pos"], "left_semi").select("doc", "pos", F.array_join(words(F.col("text")), " ").alias("doc_words"))
    pairs = salted_join(hits.join(texts.distinct(), ["doc", "pos"]), classes.select("c", F.col("t").alias("item_words")), "c")
    kinds = dict(corpus.dtypes)
    found = pairs.mapInPandas(_verify(window, errors), f"c bigint, doc {kinds['doc']}, pos {kinds['pos']}, distance int")
    found = cut(found.groupBy("c", "doc", "pos").agg(F.min("distance").alias("distance")))
    # An item of one class and a text that many rows deliver are found once for all of them.
    return salted_join(found, iw.join(classes, "t").select("c", "item"), "c").select("item", "doc", "pos", "distance")


def turn_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of each blueprint as an item named (id, turn)."""
    t = table(spark, sf_dir, "blueprints").select("id", F.posexplode("turns").alias("turn", "text"))
    return t.select(F.struct("id", (F.col("turn") + 1).alias("turn")).alias("item"), "text")


def train_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spread(table(spark, sf_dir, "convs").select("id", "messages").filter(split_of(F.col("id")) == "train"), "id")
    return c.select(F.col("id").alias("doc"), F.posexplode("messages").alias("pos", "m")).select("doc", "pos", F.col("m.content").alias("text"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of a blueprint and a train conversation with ten words of a turn, in order, in one message."""
    found = leaked_passages(turn_items(spark, sf_dir), train_messages(spark, sf_dir))
    return found.select(F.col("item.id").alias("id_a"), F.col("doc").alias("id_b")).distinct()


def p6_leaked_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns of which twenty words stand in train conversations with at most one word changed, and how often."""
    found = leaked_passages(turn_items(spark, sf_dir), train_messages(spark, sf_dir), window=20, errors=1)
    return found.groupBy(F.col("item.id").alias("id"), F.col("item.turn").alias("turn")).agg(
        F.countDistinct("doc").alias("n_convs"), F.min("distance").alias("least_distance")
    )


def p6_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Turns with a leak in train conversations, in how many, and the least distance: every turn that p6_found matches (ten
    words as they stand, distance 0) and every one of p6_leaked_turns (twenty words with at most one word changed)."""
    items, corpus = turn_items(spark, sf_dir), train_messages(spark, sf_dir)
    found = leaked_passages(items, corpus).unionByName(leaked_passages(items, corpus, window=20, errors=1))
    return found.groupBy(F.col("item.id").alias("id"), F.col("item.turn").alias("turn")).agg(
        F.countDistinct("doc").alias("n_convs"), F.min("distance").alias("least_distance")
    )
