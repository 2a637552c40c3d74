"""Problem 3: repetition inside a single document.

Document statistics come from SQL: shares of distinct words, pairs, triples and sentences, of words repeated in place, and
size. Gradient-boosted trees, trained here on a bounded sample with exact labels, map them to the share of repeated words.
The trees are flattened into numpy node arrays and score Arrow batches; the shares of distinct n-grams are constrained to
act in one direction only. The score decides, except close to the limit, where the words are counted after all; the exact
share is also the label the trees learn.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dialoom.functions.normalize import UNSPACED, let, runs, words
from dialoom.llm.sentences import message_texts

#: Rows the model is fitted on: a sample by hash of texts up to TRAIN_CHARS characters, and as many made repetitive from it.
TRAIN_ROWS, TRAIN_CHARS = 3000, 4000
#: Score, a modelled share of repeated words, beyond which a document is found; and how close to it the words are counted.
LIMIT, UNSURE = 0.5, 0.15
#: Words a phrase must have to count as repeated, in spaced and unspaced scripts.
PHRASE, PHRASE_UNSPACED = 3, 6
#: What ends a sentence, for the share of distinct ones.
STOPS = ".!?…。！？؟।"
FEATURES = ("distinct_words", "distinct_pairs", "distinct_phrases", "distinct_lines", "in_place", "log_words", "unspaced")
#: Direction in which a feature may move the score: more distinct parts never raise it, more in-place repeats never lower it.
MONOTONE = (0, -1, -1, -1, 1, 0, 0)


def features(docs: DataFrame) -> DataFrame:
    """Adds the statistics to docs(..., text, w), w being the words; all from built-in functions."""
    n = F.size("w")
    ratio = lambda a: let(a, lambda x: F.when(F.size(x) > 0, F.size(F.array_distinct(x)) / F.size(x)).otherwise(F.lit(1.0)))
    unspaced = F.col("text").rlike(rf"[\x{{e00}}-\x{{faff}}&&[{UNSPACED}]]")
    thai = F.regexp_replace("text", r"(?<=[\x{e00}-\x{e7f}]) +", "\n")
    ends = F.translate(F.when(unspaced, thai).otherwise(F.col("text")), STOPS, "\n" * len(STOPS))
    lines = F.filter(F.split(F.regexp_replace(F.lower(ends), r"[^\p{L}\p{M}\n]+", ""), "\n"), lambda s: s != "")
    hashed = F.transform("w", lambda x: F.xxhash64(x))
    d = docs.withColumn("__h", hashed).withColumn("__l", F.transform(lines, lambda s: F.xxhash64(s)))
    same = let(
        F.col("__h"),
        lambda h: F.size(F.filter(F.transform(h, lambda x, i: (i > 0) & (x == F.try_element_at(h, F.greatest(i, F.lit(1))))), lambda b: b)),
    )
    return d.select(
        *docs.columns,
        ratio(F.col("__h")).alias("distinct_words"),
        ratio(runs(F.col("__h"), 2)).alias("distinct_pairs"),
        F.when(unspaced, ratio(runs(F.col("__h"), PHRASE_UNSPACED))).otherwise(ratio(runs(F.col("__h"), PHRASE))).alias("distinct_phrases"),
        ratio(F.col("__l")).alias("distinct_lines"),
        (same / F.greatest(n, F.lit(1))).alias("in_place"),
        F.log1p(n).alias("log_words"),
        unspaced.cast("double").alias("unspaced"),
    )


def repeated_share(w: list[str]) -> float:
    """Share of words that only repeat: those in a phrase that stood before, or repeating the one or two words before.

    Exact and linear in the words. The first time counts as new. No words: 0.
    """
    n = len(w)
    if n < 2:
        return 0.0
    hit = np.zeros(n, dtype=bool)
    single = [len(x) <= 2 and "฀" <= x[0] <= "鿿" and not x[0].isascii() for x in w]
    for k, unspaced in ((PHRASE, False), (PHRASE_UNSPACED, True)):
        seen: set = set()
        for i in range(n - k + 1):
            if any(single[i : i + k]) != unspaced:
                continue
            g = tuple(w[i : i + k])
            if g in seen:
                hit[i : i + k] = True
            else:
                seen.add(g)
    for i in range(1, n):
        if w[i] == w[i - 1]:
            hit[i] = True
        if i > 2 and w[i] == w[i - 2] and w[i - 1] == w[i - 3]:
            hit[i - 1 : i + 1] = True
    return float(hit.mean())


class Trees:
    """Gradient-boosted regression trees: histogram splits, monotone constraints, flat node arrays."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: int = 10) -> None:
        self.rounds, self.depth, self.rate, self.bins, self.least = rounds, depth, rate, bins, least
        self.feature: list[int] = []
        self.cut: list[float] = []
        self.left: list[int] = []
        self.right: list[int] = []
        self.value: list[float] = []
        self.roots: list[int] = []
        self.base = 0.0

    def fit(self, x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...]) -> Trees:
        self.base = float(y.mean()) if len(y) else 0.0
        edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, self.bins + 1)[1:-1])) if len(x) else np.array([]) for f in range(x.shape[1])]
        codes = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1) if len(x) else np.zeros((0, x.shape[1]), int)
        score = np.full(len(y), self.base)
        for _ in range(self.rounds if len(y) else 0):
            gradient = y - score
            self.roots.append(self._grow(codes, edges, gradient, np.arange(len(y)), self.depth, (-np.inf, np.inf), monotone))
            score += self._one(x, self.roots[-1])
        return self.flat()

    def _grow(self, codes, edges, g, rows, depth, bounds, monotone) -> int:
        node = len(self.value)
        mean = float(np.clip(g[rows].mean(), *bounds))
        for a, v in ((self.feature, -1), (self.cut, 0.0), (self.left, -1), (self.right, -1), (self.value, mean * self.rate)):
            a.append(v)
        best = (1e-9, None)
        if depth and len(rows) >= 2 * self.least:
            whole, n = g[rows].sum(), len(rows)
            for f, e in enumerate(edges):
                if not len(e):
                    continue
                size = np.bincount(codes[rows, f], minlength=len(e) + 1).cumsum()[:-1]
                total = np.bincount(codes[rows, f], weights=g[rows], minlength=len(e) + 1).cumsum()[:-1]
                ok = (size >= self.least) & (n - size >= self.least)
                with np.errstate(divide="ignore", invalid="ignore"):
                    lo, hi = total / size, (whole - total) / (n - size)
                    gain = size * lo**2 + (n - size) * hi**2 - whole**2 / n
                if monotone[f]:
                    ok &= (hi - lo) * monotone[f] >= 0
                gain = np.where(ok, gain, -1)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    best = (gain[k], (f, k, float(np.clip(lo[k], *bounds)), float(np.clip(hi[k], *bounds))))
        if best[1]:
            f, k, lo, hi = best[1]
            goes = codes[rows, f] <= k
            mid, (a, b) = (lo + hi) / 2, bounds
            below, above = {1: ((a, mid), (mid, b)), -1: ((mid, b), (a, mid)), 0: (bounds, bounds)}[monotone[f]]
            self.feature[node], self.cut[node] = f, float(edges[f][k])
            self.left[node] = self._grow(codes, edges, g, rows[goes], depth - 1, below, monotone)
            self.right[node] = self._grow(codes, edges, g, rows[~goes], depth - 1, above, monotone)
        return node

    def _one(self, x: np.ndarray, root: int) -> np.ndarray:
        at = np.full(len(x), root)
        f, c, lo, hi, v = (np.asarray(a) for a in (self.feature, self.cut, self.left, self.right, self.value))
        for _ in range(self.depth):
            inner = f[at] >= 0
            goes = x[np.arange(len(x)), np.maximum(f[at], 0)] <= c[at]
            at = np.where(inner, np.where(goes, lo[at], hi[at]), at)
        return v[at]

    def flat(self) -> Trees:
        for name in ("feature", "cut", "left", "right", "value", "roots"):
            setattr(self, name, np.asarray(getattr(self, name)))
        return self

    def predict(self, x: np.ndarray) -> np.ndarray:
        """All rows go down all trees at once: one array of positions, rows by trees."""
        if not len(self.roots) or not len(x):
            return np.full(len(x), self.base)
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            goes = x[rows, np.maximum(f, 0)] <= self.cut[at]
            at = np.where(f >= 0, np.where(goes, self.left[at], self.right[at]), at)
        return self.base + self.value[at].sum(1)


def train(docs: DataFrame, rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS) -> Trees:
    """Fits the trees on a bounded sample of docs(text): `rows` by hash of those up to `chars` long, and as many made repetitive.

    A made text says its own first words, or all of it, again and again after the original; its label, as all labels, is
    the exact share of repeated words. The driver holds at most rows * chars * 22 characters. The same table gives the same model.
    """
    spark = docs.sparkSession
    short = docs.select("text").filter(F.length("text") <= chars)
    picked = short.orderBy(F.xxhash64("text"), "text").limit(rows).toPandas()["text"]
    texts = list(picked)
    for i, t in enumerate(picked):
        parts = t.split(" ")
        some = parts[: 1 + i % 7] if len(parts) > 1 else [t]
        sep = ("\n", " ", ". ")[i % 3]
        texts.append(t + sep + sep.join([" ".join(some) if i % 2 else t] * (1 + i % 9)))
    frame = spark.createDataFrame(pd.DataFrame({"n": range(len(texts)), "text": texts}), "n bigint, text string")
    got = features(frame.withColumn("w0", words(F.col("text"))).withColumn("w", _no_numbers("w0")).drop("w0")).toPandas()
    y = np.array([repeated_share(list(w)) for w in got["w"]])
    return Trees().fit(got[list(FEATURES)].to_numpy(float).reshape(-1, len(FEATURES)), y, MONOTONE)


def _no_numbers(c: str) -> Column:
    return F.filter(F.col(c), lambda w: ~w.rlike(r"^\p{N}+$"))


def _score(model: Trees, keys: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in batches:
            d = d[d["said"] > 1].reset_index(drop=True)
            score = np.clip(model.predict(d[list(FEATURES)].to_numpy(float)), 0, 1)
            close = (np.abs(score - LIMIT) <= UNSURE) & d["joined"].notna().to_numpy()
            share = score.copy()
            share[close] = [repeated_share(t.split(" ")) for t in d["joined"][close]]
            yield d[keys].assign(score=score, found=share > LIMIT)

    return run


def repetition(docs: DataFrame, keys: list[str], model: Trees | None = None) -> DataFrame:
    """keys, score, found: the modelled share of repeated words, and whether more than LIMIT of them repeat.

    docs: keys and text. Null and blank texts, and texts of fewer than two words, cannot repeat and give no row. Repeated
    rows are scored each. Extra columns are ignored.
    """
    model = model or train(docs)
    d = docs.select(*keys, F.coalesce("text", F.lit("")).alias("text"))
    d = d.select(*keys, "text", words(F.col("text")).alias("w0"))
    # Texts of fewer than two words go out in the scoring; a filter here would find the words twice.
    d = features(d.select(*keys, "text", F.size("w0").alias("said"), _no_numbers("w0").alias("w")))
    # Of a text in which a quarter of the words repeats, a tenth of the pairs do, or of the words in place.
    joined = F.when((F.col("distinct_pairs") < 0.9) | (F.col("in_place") > 0.1), F.array_join("w", " ")).alias("joined")
    kinds = dict(docs.dtypes)
    return d.select(*keys, "said", *FEATURES, joined).mapInPandas(_score(model, keys), ", ".join(f"{k} {kinds[k]}" for k in keys) + ", score double, found boolean")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of which, by the trees' score and close to the limit by count, more than half of the words only repeat."""
    return repetition(message_texts(spark, sf_dir), ["id", "pos"]).filter("found").select("id", "pos").distinct()


def p3_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, mean score and found messages by category, over all messages with at least two words."""
    r = repetition(message_texts(spark, sf_dir), ["id", "pos"]).distinct()
    return r.groupBy(F.regexp_extract("id", r"_([a-z]+)_\d+$", 1).alias("category")).agg(
        F.count("*").alias("n_messages"), F.avg("score").alias("mean_score"), F.count_if("found").alias("n_found")
    )
