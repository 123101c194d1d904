"""Vector expressions (inside Catalyst) and their numpy kernels."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from vectide.types import Metric, aligned

EPSILON = 1.1920929e-7


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def fold(v: Column) -> Column:
    """Sum of an array of doubles."""
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return fold(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def l2(a: Column, b: Column) -> Column:
    """Squared Euclidean distance."""
    return fold(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def l1(a: Column, b: Column) -> Column:
    return fold(F.zip_with(doubles(a), doubles(b), lambda x, y: F.abs(x - y)))


def cosine(a: Column, b: Column) -> Column:
    """1 - dot: both sides are expected to be normalised."""
    return 1 - dot(a, b)


def hamming_codes(a: Column, b: Column) -> Column:
    """Differing bits of two arrays of integer codes."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y)).cast("long")), F.lit(0).cast("long"), lambda s, x: s + x)


DISTANCE = {Metric.L2: l2, Metric.L1: l1, Metric.COSINE: cosine}


def normalize(v: Column) -> Column:
    """Unit length; vectors whose squared norm is below epsilon stay as they are."""
    n2 = dot(v, v)
    return F.when(n2 < EPSILON, doubles(v)).otherwise(F.transform(doubles(v), lambda x: x / F.sqrt(n2)))


def cosine_similarity(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(F.sqrt(dot(a, a)), F.lit(1e-8)) * F.greatest(F.sqrt(dot(b, b)), F.lit(1e-8)))


def pad(v: Column, dim: int) -> Column:
    """Zeros up to the aligned dimension; a longer vector is an error."""
    n = aligned(dim)
    fits = F.assert_true(F.size(v) <= n, F.lit(f"vector longer than {n}"))
    return F.when(fits.isNull(), F.concat(doubles(v), F.array_repeat(F.lit(0.0), n - F.size(v))))


def prepared(v: Column, metric: Metric, dim: int) -> Column:
    """What is stored and searched: padded, and normalised for cosine."""
    return normalize(pad(v, dim)) if metric is Metric.COSINE else pad(v, dim)


def project(v: Column, matrix: Iterable[Iterable[float]]) -> Column:
    """v times a matrix given by rows."""
    columns = np.asarray(matrix, float).T.tolist()
    return F.transform(F.array(*(F.array(*map(F.lit, c)) for c in columns)), lambda c: dot(v, c))


# ---- numpy kernels, one row per vector


def distances(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Rows of x by rows of q, in float64; L2 by one matrix product."""
    x, q = np.asarray(x, np.float64), np.asarray(q, np.float64)
    if metric is Metric.L2:
        return np.maximum((x * x).sum(1)[:, None] + (q * q).sum(1)[None] - 2 * (x @ q.T), 0)
    if metric is Metric.COSINE:
        return 1 - x @ q.T
    if metric is Metric.L1:
        return np.stack([np.abs(x - r).sum(1) for r in q], 1)
    bits = np.ascontiguousarray(x, np.float32).view(np.uint32), np.ascontiguousarray(q, np.float32).view(np.uint32)
    return np.stack([np.bitwise_count(bits[0] ^ r).sum(1) for r in bits[1]], 1).astype(np.float64)


def exact(x: np.ndarray, q: np.ndarray, metric: Metric) -> np.ndarray:
    """Distance of each row of x to the same row of q, without cancellation."""
    x, q = np.asarray(x, np.float64), np.asarray(q, np.float64)
    if metric is Metric.L2:
        return ((x - q) ** 2).sum(1)
    if metric is Metric.L1:
        return np.abs(x - q).sum(1)
    if metric is Metric.COSINE:
        return 1 - (x * q).sum(1)
    return np.bitwise_count(np.ascontiguousarray(x, np.float32).view(np.uint32) ^ np.ascontiguousarray(q, np.float32).view(np.uint32)).sum(1).astype(np.float64)


def unit(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, np.float64)
    n2 = (x * x).sum(-1, keepdims=True)
    return np.where(n2 < EPSILON, x, x / np.sqrt(np.where(n2 < EPSILON, 1, n2)))
