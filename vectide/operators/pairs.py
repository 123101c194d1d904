"""Labelled pairs of embeddings: negatives, accuracy, and a learned projection."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import vectors as V

#: thresholds tried by ``accuracy``: from -1 in steps of a thousandth
THRESHOLDS = 2000


def negatives(pairs: DataFrame) -> DataFrame:
    """(a, b): all combinations of left and right texts of positive pairs (a, b) that are no positive pair.

    The result itself is the product of the two sides; both are deduplicated first.
    """
    left, right = pairs.select("a").distinct(), pairs.select("b").distinct()
    return left.crossJoin(right).join(pairs.select("a", "b").distinct(), ["a", "b"], "left_anti")


def unordered_negatives(pairs: DataFrame) -> DataFrame:
    """(a, b) with a < b over all texts of either side, without the positive pairs in either order."""
    texts = pairs.select(F.col("a").alias("t")).union(pairs.select(F.col("b").alias("t"))).distinct()
    every = texts.select(F.col("t").alias("a")).join(texts.select(F.col("t").alias("b")), F.col("a") < F.col("b"))
    positive = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    return every.join(positive, ["a", "b"], "left_anti")


def labelled(sentences: DataFrame, labels: DataFrame, per_label: int) -> DataFrame:
    """Pairs (line, a, b, label) with both embeddings, the first ``per_label`` of each label by line; misses are dropped."""
    one = sentences.select(F.col("sentence").alias("a"), F.col("embedding").alias("emb_a"))
    two = sentences.select(F.col("sentence").alias("b"), F.col("embedding").alias("emb_b"))
    both = labels.join(one, "a").join(two, "b")
    place = F.row_number().over(Window.partitionBy("label").orderBy("line"))
    return both.withColumn("place", place).where(F.col("place") <= per_label).drop("place")


def accuracy(scored: DataFrame) -> DataFrame:
    """Best accuracy of (similarity, label 1/-1) over all thresholds, with its 95 % margin.

    A row is right at every threshold on its side, so counting rows per threshold step and
    running sums replaces trying each threshold on each row.
    """
    step = F.least(F.greatest(F.floor((F.col("similarity") + 1) * 1000) + 1, F.lit(0)), F.lit(THRESHOLDS)).cast("int")
    # predicted 1 if similarity > threshold t(i) = -1 + i/1000: true for i < (similarity + 1) * 1000
    above = F.when((F.col("similarity") + 1) * 1000 == F.floor((F.col("similarity") + 1) * 1000), step - 1).otherwise(step)
    per = scored.select(F.greatest(above, F.lit(0)).alias("i"), "label").groupBy("i").agg(F.sum(F.when(F.col("label") > 0, 1).otherwise(0)).alias("pos"), F.sum(F.when(F.col("label") > 0, 0).otherwise(1)).alias("neg"))
    grid = scored.sparkSession.range(THRESHOLDS).select(F.col("id").cast("int").alias("i"))
    after = Window.orderBy("i").rowsBetween(1, Window.unboundedFollowing)
    upto = Window.orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    counts = grid.join(per, "i", "full").select("i", F.coalesce("pos", F.lit(0)).alias("pos"), F.coalesce("neg", F.lit(0)).alias("neg"))
    right = counts.select("i", (F.coalesce(F.sum("pos").over(after), F.lit(0)) + F.coalesce(F.sum("neg").over(upto), F.lit(0))).alias("right"))
    best = right.where(F.col("i") < THRESHOLDS).agg(F.max("right").alias("right"))
    total = scored.agg(F.count(F.lit(1)).alias("n"))
    a = F.col("right") / F.col("n")
    return best.crossJoin(total).select(a.alias("accuracy"), (1.96 * F.sqrt(a * (1 - a) / F.col("n"))).alias("margin"))


def mse(rows: DataFrame) -> DataFrame:
    """Mean squared difference of (prediction, target)."""
    return rows.agg(F.avg((F.col("prediction") - F.col("target")) * (F.col("prediction") - F.col("target"))).alias("mse"))


def split(rows: DataFrame, key: str = "id") -> DataFrame:
    """Rows with a half, ``train`` or ``test``, by the parity of a key."""
    return rows.withColumn("half", F.when(F.pmod(F.col(key), F.lit(2)) == 0, "train").otherwise("test"))


#: labelled pairs that a projection is trained on, and tested on, at most
MOST_PAIRS = 200_000


@dataclass
class Projection:
    matrix: np.ndarray
    accuracy: float
    losses: list[float]


def _best(similarity: np.ndarray, label: np.ndarray) -> float:
    """The best accuracy over the thresholds: pairs above each, of both labels, counted in sorted order."""
    steps = -1 + np.arange(THRESHOLDS) / 1000
    right, wrong = np.sort(similarity[label > 0]), np.sort(similarity[label <= 0])
    hits = len(right) - np.searchsorted(right, steps, side="right") + np.searchsorted(wrong, steps, side="right")
    return float(hits.max() / max(1, len(similarity)))


def train_projection(train: pd.DataFrame, test: pd.DataFrame, rate: float = 0.1, epochs: int = 20, batch: int = 64, dropout: float = 0.1, seed: int = 3) -> Projection:
    """A d x d matrix M for which cos(aM, bM) is near the label (1 or -1), by SGD on the squared error.

    Labelled pairs are a training set of at most MOST_PAIRS rows (more are an error), so this runs
    where it is called. Columns emb_a, emb_b, label. The matrix with the best test accuracy is kept.
    """
    if len(train) > MOST_PAIRS or len(test) > MOST_PAIRS:
        raise ValueError(f"more than {MOST_PAIRS} labelled pairs: take a part of them")
    rng = np.random.default_rng(seed)
    a, b, y = (np.array(train[c].tolist(), float) for c in ("emb_a", "emb_b", "label"))
    ta, tb, ty = (np.array(test[c].tolist(), float) for c in ("emb_a", "emb_b", "label"))
    d = a.shape[1]
    m = rng.uniform(-1, 1, (d, d)) * 0.1 + np.eye(d)

    def cos(u: np.ndarray, v: np.ndarray) -> np.ndarray:
        return (u * v).sum(1) / np.maximum(np.linalg.norm(u, axis=1) * np.linalg.norm(v, axis=1), 1e-8)

    best = Projection(m.copy(), _best(cos(ta @ m, tb @ m), ty), [])
    for _ in range(epochs):
        losses = []
        for rows in np.array_split(rng.permutation(len(a)), max(1, len(a) // batch)):
            keep_a, keep_b = (rng.random((len(rows), d)) >= dropout for _ in range(2))
            x, z = a[rows] * keep_a / (1 - dropout), b[rows] * keep_b / (1 - dropout)
            u, v = x @ m, z @ m
            nu, nv = np.linalg.norm(u, axis=1, keepdims=True) + 1e-8, np.linalg.norm(v, axis=1, keepdims=True) + 1e-8
            c = (u * v).sum(1, keepdims=True) / (nu * nv)
            error = 2 * (c - y[rows, None]) / len(rows)
            losses.append(float(((c[:, 0] - y[rows]) ** 2).mean()))
            du, dv = error * (v / (nu * nv) - c * u / nu**2), error * (u / (nu * nv) - c * v / nv**2)
            m -= rate * (x.T @ du + z.T @ dv)
        best.losses.append(float(np.mean(losses)))
        score = _best(cos(ta @ m, tb @ m), ty)
        if score > best.accuracy:
            best.matrix, best.accuracy = m.copy(), score
    return best


def projected(rows: DataFrame, matrix: np.ndarray) -> DataFrame:
    """Labelled pairs with the similarity of their projected embeddings."""
    m = np.asarray(matrix).tolist()
    return rows.withColumn("similarity", V.cosine_similarity(V.project(F.col("emb_a"), m), V.project(F.col("emb_b"), m)))
