"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the presence of its words, adjacent pairs and pairs that
skip one word, and of the stems of its words (their first 5 to 8 bytes, so that
an unseen inflection of a known word counts), lower-cased, with punctuation as
a separator, hashed to 2**20 weights. FTRL-proximal gives every weight a rate of its own and leaves most of
them exactly zero, so the model travels as a few thousand (bucket, weight)
rows.

Null and empty texts have no features and get the bias alone. Without labelled
rows of both classes every score is the share of toxic rows (0 with none).
Repeated rows are scored alike. Labels of an unknown or missing id, or other than 0 and 1, are left
out; an id labelled twice counts with each label. Texts are read whole, however long. Columns
beyond doc_id and text are not read (``accepted`` carries them); an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm.text import U64, Words, mix, pieces, tidy

BITS = 20
STEMS = (5, 6, 7, 8)
#: at most so many labelled rows of each class train the model, chosen by hash of the id
SAMPLE = 4000


def features(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every word, stem, pair and skip pair."""
    h, doc = words.hashes(lower=True), words.doc
    found, owner = [h], [doc]
    for size in STEMS:
        longer = np.flatnonzero(words.end - words.start > size)
        found.append(mix(words.hashes(lower=True, only=longer, size=size) + U64(size)))
        owner.append(doc[longer])
    for step, salt in ((1, 0x9E37), (2, 0x85EB)):
        same = doc[:-step] == doc[step:]
        found.append(mix(h[:-step][same] * U64(3) + h[step:][same] * U64(5) + U64(salt)))
        owner.append(doc[:-step][same])
    return np.concatenate(owner), (np.concatenate(found) >> U64(64 - BITS)).astype(np.int64)


@dataclass
class Ftrl:
    alpha: float = 0.5
    beta: float = 1.0
    l1: float = 8.0
    l2: float = 1.0
    epochs: int = 6
    batch: int = 4

    def weights(self, z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= self.l1, 0.0, -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def fit(self, docs: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Distinct buckets of each document and its 0/1 label -> non-zero weights and the bias."""
        size = 1 << BITS
        z, n = np.zeros(size + 1), np.zeros(size + 1)
        order = np.random.default_rng(7)
        for _ in range(self.epochs):
            at = order.permutation(len(docs))
            for chosen in np.array_split(at, max(1, len(at) // self.batch)):
                lens = np.array([len(docs[i]) + 1 for i in chosen])
                owner = np.repeat(np.arange(len(chosen)), lens)
                index = np.concatenate([np.append(docs[i], size) for i in chosen])
                used, inverse = np.unique(index, return_inverse=True)
                zu, nu = z[used], n[used]
                w = self.weights(zu, nu)
                raw = np.bincount(owner, w[inverse], len(chosen))
                error = 1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[chosen]
                g = np.bincount(inverse, error[owner], len(used))
                g2 = np.bincount(inverse, (error * error)[owner], len(used))
                z[used] += g - (np.sqrt(nu + g2) - np.sqrt(nu)) / self.alpha * w
                n[used] += g2
        w = self.weights(z, n)
        kept = np.flatnonzero(w[:size])
        return kept, w[kept], float(w[size])


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, params: Ftrl | None = None) -> DataFrame:
    """(bucket, weight) rows, the bias under bucket -1, from at most ``sample`` documents of each class.

    labels: doc_id, toxic. The sample is bounded, so one task trains on it.
    """
    params = params or Ftrl()
    order = (F.xxhash64("doc_id"), F.col("doc_id"))
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1)).select("doc_id", "toxic").distinct()
    chosen = known.where("toxic = 1").orderBy(*order).limit(sample).union(known.where("toxic = 0").orderBy(*order).limit(sample))
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").repartition(1)

    def fit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple[int, np.ndarray, int]] = []
        for piece in pieces(batches):
            owner, bucket = features(Words(piece.column(1), plain=True))
            code = np.unique((owner << BITS) | bucket)
            cut = np.searchsorted(code, np.arange(piece.num_rows + 1) << BITS)
            code &= (1 << BITS) - 1
            found += [(i, code[a:b].copy(), t) for i, a, b, t in zip(piece.column(0).to_pylist(), cut[:-1], cut[1:], piece.column(2).to_pylist(), strict=True)]
        found.sort(key=lambda x: (x[0], len(x[1]), x[2]))
        y = np.array([t for *_, t in found], float)
        if not len(y) or y.min() == y.max():
            bucket, weight, bias = np.zeros(0, int), np.zeros(0), (-30.0 if not len(y) or y[0] == 0 else 30.0)
        else:
            bucket, weight, bias = params.fit([d for _, d, _ in found], y)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(bucket, -1), pa.int64()), pa.array(np.append(weight, bias), pa.float64())], ["bucket", "weight"])

    return rows.mapInArrow(tidy(fit), "bucket long, weight double")


def _scorer(docs: DataFrame, model: DataFrame) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """A maker, for the tasks, of the function text column -> scores.

    The model has at most 2**20 rows and is broadcast by value.
    """
    rows = model.toPandas()
    bias = float(rows.weight[rows.bucket == -1].sum())
    rows = rows[rows.bucket >= 0]
    sent = docs.sparkSession.sparkContext.broadcast((rows.bucket.to_numpy(), rows.weight.to_numpy()))

    def make() -> Callable[[pa.Array], np.ndarray]:
        weights = np.zeros(1 << BITS, np.float32)
        weights[sent.value[0]] = sent.value[1]

        def scores(column: pa.Array) -> np.ndarray:
            owner, bucket = features(Words(column, plain=True))
            w = weights[bucket]
            hit = np.flatnonzero(w)
            code, first = np.unique((owner[hit] << BITS) | bucket[hit], return_index=True)
            raw = np.round(bias + np.bincount(code >> BITS, w[hit][first].astype(np.float64), len(column)), 6)
            return 1 / (1 + np.exp(-np.clip(raw, -40, 40)))

        return scores

    return make


def score(docs: DataFrame, model: DataFrame) -> DataFrame:
    """doc_id and score of every text."""
    make = _scorer(docs, model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for piece in pieces(batches, limit=1 << 20):
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(scores(piece.column(1)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, score double")


def accepted(docs: DataFrame, model: DataFrame, threshold: float) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below ``threshold``."""
    make, at = _scorer(docs, model), docs.columns.index("text")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scores = make()
        for piece in pieces(batches, limit=1 << 20):
            yield piece.filter(pa.array(scores(piece.column(at)) < threshold))

    return docs.mapInArrow(tidy(run), docs.schema)
