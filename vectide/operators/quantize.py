"""Scalar and product quantization.

The scalar quantizer maps values to 0..255 between two quantiles. The product
quantizer splits vectors into chunks, has up to 256 centres for each, and
replaces a chunk by its nearest centre; distances are looked up per chunk.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.types import chunk_offsets

QUANTILE, LEVELS = 0.99, 255
CENTRES, ITERATIONS = 256, 12


def fit_scalar(vectors: DataFrame, quantile: float = QUANTILE, accuracy: int | None = 10_000) -> DataFrame:
    """One row (offset, alpha): the least value, and the step to the quantile.

    The quantile's rank is right to one in ``accuracy``; None makes it exact, for which one task
    holds all distinct values.
    """
    x = vectors.select(F.explode(V.doubles(F.col("embedding"))).alias("x"))
    top = F.percentile("x", F.lit(quantile)) if accuracy is None else F.percentile_approx("x", F.lit(quantile), accuracy)
    return x.agg(F.min("x").alias("offset"), top.alias("top")).select("offset", ((F.col("top") - F.col("offset")) / LEVELS).alias("alpha"))


def codes(v: Column, offset: Column, alpha: Column) -> Column:
    """Truncated towards 0 and saturated; NaN is 0."""

    def one(x: Column) -> Column:
        y = (x.cast("double") - offset) / alpha
        return F.when(F.isnan(y), F.lit(0)).otherwise(F.least(F.greatest(y, F.lit(0.0)), F.lit(255.0))).cast("smallint")

    return F.transform(v, one)


def encode_scalar(vectors: DataFrame, params: DataFrame) -> DataFrame:
    """Vectors with their codes; params is one row."""
    return vectors.crossJoin(F.broadcast(params)).withColumn("codes", codes(F.col("embedding"), F.col("offset"), F.col("alpha")))


def precomputed(v: Column, offset: Column, alpha: Column) -> Column:
    """Sum of the codes times offset times alpha."""
    return F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double")) * offset * alpha


def l2_codes(a: Column, b: Column) -> Column:
    """Squared distance of two arrays of codes, in whole numbers."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x.cast("int") - y.cast("int")) * (x.cast("int") - y.cast("int"))), F.lit(0).cast("long"), lambda s, x: s + x)


# ---- product quantizer


def centroid(vectors: DataFrame) -> DataFrame:
    """(dim, mean) of every dimension."""
    each = vectors.select(F.posexplode("embedding").alias("dim", "x"))
    return each.groupBy("dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def centred(v: Column, mean: Column) -> Column:
    return F.zip_with(V.doubles(v), V.doubles(mean), lambda x, m: x - m)


def chunked(vectors: DataFrame, dim: int, chunks: int) -> DataFrame:
    """One row per chunk: its number and the slice of the embedding."""
    at = chunk_offsets(dim, chunks)
    parts = F.array(*(F.struct(F.lit(i).alias("chunk"), F.slice("embedding", at[i] + 1, at[i + 1] - at[i]).alias("part")) for i in range(chunks)))
    rest = [c for c in vectors.columns if c != "embedding"]
    return vectors.select(*rest, F.explode(parts).alias("p")).select(*rest, "p.chunk", "p.part")


def encode_product(vectors: DataFrame, codebook: DataFrame, dim: int, chunks: int) -> DataFrame:
    """eid, chunk, center: the first nearest centre of every chunk.

    The codebook (chunk, center, pivot) has at most chunks x 256 rows and goes along with the tasks.
    """
    at = chunk_offsets(dim, chunks)
    rows = codebook.orderBy("chunk", "center").collect()
    centres = [np.array([r["pivot"] for r in rows if r["chunk"] == c], np.float64) for c in range(chunks)]
    names = [np.array([r["center"] for r in rows if r["chunk"] == c]) for c in range(chunks)]
    kind = dict(vectors.dtypes)["eid"]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 2048):
                batch = whole.slice(start, 2048)
                x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1).astype(np.float64)
                found = np.stack([names[c][((x[:, None, at[c] : at[c + 1]] - centres[c][None]) ** 2).sum(2).argmin(1)] for c in range(chunks)], 1)
                take = pa.array(np.repeat(np.arange(batch.num_rows), chunks))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(np.tile(np.arange(chunks, dtype=np.int32), batch.num_rows)), pa.array(found.reshape(-1).astype(np.int32))], ["eid", "chunk", "center"])

    return vectors.select("eid", "embedding").mapInArrow(run, f"eid {kind}, chunk int, center int")


def lookup_table(codebook: DataFrame, query: Sequence[float], dim: int, chunks: int) -> DataFrame:
    """(chunk, center, d): squared distance of a query's chunk to every centre."""
    at = chunk_offsets(dim, chunks)
    parts = F.array(*(F.array(*(F.lit(float(x)) for x in query[at[i] : at[i + 1]])) for i in range(chunks)))
    return codebook.select("chunk", "center", V.l2(F.col("pivot"), F.element_at(parts, F.col("chunk") + 1)).alias("d"))


def asymmetric(coded: DataFrame, table: DataFrame) -> DataFrame:
    """eid and the sum of its chunks' looked-up distances."""
    return coded.join(F.broadcast(table), ["chunk", "center"]).groupBy("eid").agg(F.sum("d").alias("distance"))


def reranked(coded: DataFrame, codebook: DataFrame, vectors: DataFrame, query: Sequence[float], dim: int, chunks: int, candidates: int, k: int, digits: int = 6) -> DataFrame:
    """The k nearest by exact distance among the ``candidates`` nearest by lookup."""
    near = asymmetric(coded, lookup_table(codebook, query, dim, chunks)).withColumn("distance", F.round("distance", digits)).orderBy("distance", "eid").limit(candidates).select("eid")
    exact = F.round(V.l2(F.col("embedding"), F.array(*(F.lit(float(x)) for x in query))), digits)
    return vectors.join(F.broadcast(near), "eid").select("eid", exact.alias("distance")).orderBy("distance", "eid").limit(k)


def train_product(vectors: DataFrame, dim: int, chunks: int, centres: int = CENTRES, iterations: int = ITERATIONS, sample: int = 65536, seed: int = 7) -> DataFrame:
    """A codebook (chunk, center, pivot) by k-means on each chunk of at most ``sample`` vectors, chosen by hash."""
    chosen = vectors.orderBy(F.xxhash64("eid", F.lit(seed)), "eid").limit(sample).select("eid", "embedding")

    def fit(key: tuple, table: pa.Table) -> pa.Table:
        x = np.array(table["part"].to_pylist(), np.float64)
        order = np.argsort(table["eid"].to_numpy())
        x = x[order]
        rng = np.random.default_rng(seed + key[0].as_py())
        c = x[rng.permutation(len(x))[:centres]].copy()
        for _ in range(iterations):
            near = V.distances(x, c, V.Metric.L2).argmin(1)
            n = np.bincount(near, minlength=len(c))
            total = np.stack([np.bincount(near, x[:, d], len(c)) for d in range(x.shape[1])], 1)
            c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
        return pa.table([pa.array([key[0].as_py()] * len(c), pa.int32()), pa.array(np.arange(len(c), dtype=np.int32)), pa.array(list(c.astype(np.float32)), pa.list_(pa.float32()))], names=["chunk", "center", "pivot"])

    return chunked(chosen, dim, chunks).groupBy("chunk").applyInArrow(fit, "chunk int, center int, pivot array<float>")
