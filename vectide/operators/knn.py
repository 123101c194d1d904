"""Exact nearest neighbours and the weighted multi-field merge.

Distances are rounded and ties are broken by id, everywhere: a block keeps every row that
could be among a query's k nearest before it cuts by (distance, id). Rows without a vector
are nobody's neighbour; a vector of another dimension than its query's is an error. Small work
stays in Catalyst expressions; otherwise partitions multiply blocks of vectors with the queries
in numpy, keep k per query and group, and a final window merges the partial lists. Queries are
broadcast in blocks of a fixed number of bytes, each with a scan of its own.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.types import Metric, checked_limit

#: bytes of the queries in one broadcast block; queries and rows multiplied at once; pairs measured at once
QUERY_BYTES, QUERY_BLOCK, ROW_BLOCK, PAIR_BLOCK = 32 << 20, 1024, 4096, 1 << 18


def nearest(vectors: DataFrame, query: Sequence[float], k: int, metric: Metric = Metric.L2, digits: int = 6) -> DataFrame:
    """The k nearest rows of (eid, embedding) to one query: eid, distance."""
    checked_limit(k)
    q = V.unit(np.array(query)) if metric is Metric.COSINE else np.array(query, float)
    stored = V.normalize(F.col("embedding")) if metric is Metric.COSINE else F.col("embedding")
    d = V.DISTANCE[metric](stored, F.array(*(F.lit(float(x)) for x in q)))
    fits = F.assert_true(F.size("embedding") == len(q), F.lit(f"a vector is not of the query's dimension, {len(q)}")).isNull()
    return vectors.where("embedding IS NOT NULL").where(fits).select("eid", F.round(d, digits).alias("distance")).orderBy("distance", "eid").limit(k)


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """The rows' vectors; all of them must be of this dimension."""
    sizes = pc.list_value_length(column).to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes != dim).any():
        raise ValueError(f"a vector has {int(sizes[sizes != dim][0])} dimensions, the queries have {dim}")
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dim)


def partial_top(groups: np.ndarray, x: np.ndarray, place: np.ndarray, q: np.ndarray, k: int, metric: Metric, digits: int) -> tuple[np.ndarray, ...]:
    """(query, row, rounded distance) of the k least of each group and query in a block, by distance, then ``place``.

    A product of matrices gives distances up to a small error. Whatever is not beyond the k-th
    least by more than that and the rounding is measured exactly.
    """
    rows, cols, dist = [], [], []
    for g in np.unique(groups):
        own = np.flatnonzero(groups == g)
        for at in range(0, len(q), QUERY_BLOCK):
            far = V.distances(x[own], q[at : at + QUERY_BLOCK], metric)
            limit = np.partition(far, k - 1, axis=0)[k - 1] if k < len(own) else np.full(far.shape[1], np.inf)
            slack = 2 * 10.0**-digits + 1e-9 * (1 + np.abs(far).max(0, initial=0) + (x[own] ** 2).sum(1).max(initial=0))
            near = far <= limit + slack
            many = near.sum(0)
            cut = np.unique(np.append(np.flatnonzero(np.diff(np.cumsum(many) // PAIR_BLOCK, prepend=0)), [0, len(many)]))
            for a, b in zip(cut[:-1], cut[1:], strict=True):
                c, r = np.nonzero(near[:, a:b].T)
                c, r = c + at + a, own[r]
                d = np.round(np.concatenate([V.exact(x[r[i : i + PAIR_BLOCK]], q[c[i : i + PAIR_BLOCK]], metric) for i in range(0, max(1, len(r)), PAIR_BLOCK)]), digits)
                order = np.lexsort((place[r], d, c))
                c, r, d = c[order], r[order], d[order]
                keep = np.arange(len(c)) - np.searchsorted(c, c) < k
                rows.append(r[keep])
                cols.append(c[keep])
                dist.append(d[keep])
    return np.concatenate(cols or [[]]).astype(int), np.concatenate(rows or [[]]).astype(int), np.concatenate(dist or [[]]).astype(float)


def nearest_batch(vectors: DataFrame, queries: DataFrame, k: int, metric: Metric = Metric.L2, group: Sequence[str] = (), digits: int = 6) -> DataFrame:
    """qid, ``group`` columns, eid, distance, rank: the k nearest of each group of (eid, embedding) to each (qid, embedding).

    Only k rows per query, group and block leave the scan. Queries without a vector find nothing;
    those that have one must agree in dimension.
    """
    checked_limit(k)
    spark = vectors.sparkSession
    rows = queries.where("embedding IS NOT NULL").select("qid", "embedding").orderBy("qid")
    n, dim, widest = rows.agg(F.count(F.lit(1)), F.min(F.size("embedding")), F.max(F.size("embedding"))).first()
    if dim != widest:
        raise ValueError(f"queries have {dim} to {widest} dimensions")
    per_block = max(1, QUERY_BYTES // (8 * max(1, dim or 1)))
    types = dict(vectors.dtypes)
    qtype = dict(queries.dtypes)["qid"]
    fields = ", ".join([f"qid {qtype}", *(f"`{g}` {types[g]}" for g in group), f"eid {types['eid']}", "distance double"])
    parts = []
    for start in range(0, max(n, 1), per_block):
        block = rows.offset(start).limit(per_block).collect() if n > per_block else rows.collect()
        if not block:
            continue
        ids = [r["qid"] for r in block]
        q = np.array([r["embedding"] for r in block], np.float64)
        sent = spark.sparkContext.broadcast((ids, V.unit(q) if metric is Metric.COSINE else q))

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, q = sent.value
            for whole in batches:
                for at in range(0, whole.num_rows, ROW_BLOCK):
                    batch = whole.slice(at, ROW_BLOCK)
                    x = _matrix(batch.column(batch.num_columns - 1), q.shape[1])
                    x = V.unit(x) if metric is Metric.COSINE else x.astype(np.float64)
                    place = np.empty(batch.num_rows, np.int64)
                    place[pc.sort_indices(batch.column(batch.num_columns - 2)).to_numpy()] = np.arange(batch.num_rows)
                    keys = [tuple(r) for r in zip(*(batch.column(i).to_pylist() for i in range(len(group))), strict=True)] if group else [()] * batch.num_rows
                    number = {key: i for i, key in enumerate(dict.fromkeys(keys))}
                    c, r, d = partial_top(np.array([number[key] for key in keys]), x, place, q, k, metric, digits)
                    take = pa.array(r)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([ids[i] for i in c], _arrow(qtype)), *(batch.column(i).take(take) for i in range(batch.num_columns - 1)), pa.array(d)], ["qid", *group, "eid", "distance"]
                    )

        parts.append(vectors.where("embedding IS NOT NULL").select(*group, "eid", "embedding").mapInArrow(run, fields))
    if not parts:
        return spark.createDataFrame([], fields + ", rank long")
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    order = Window.partitionBy("qid", *group).orderBy("distance", "eid")
    return found.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _arrow(name: str) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}[name]


def merge_fields(hits: DataFrame, weights: Mapping[str, float], limit: int) -> DataFrame:
    """The weighted merge of per-field hits (qid, field, eid, distance).

    With weights, distance / largest distance of the query * boost, where boost is
    1 - weight / sum of weights for a weighted field and 1 for others; a largest
    distance of 0 leaves 0. The least ``limit`` of each query stay, by distance and eid.
    """
    value = F.col("distance")
    if weights:
        total = float(sum(weights.values()))
        boost = F.lit(1.0)
        for name, w in weights.items():
            boost = F.when(F.col("field") == name, F.lit(1 - w / total)).otherwise(boost)
        largest = F.max("distance").over(Window.partitionBy("qid"))
        value = F.when(largest == 0, F.lit(0.0)).otherwise(F.col("distance") / largest * boost)
    scored = hits.withColumn("score", value)
    order = Window.partitionBy("qid").orderBy("score", "eid", "field")
    return scored.withColumn("place", F.row_number().over(order).cast("long")).where(F.col("place") <= limit)


def search(vectors: DataFrame, queries: DataFrame, attributes: Sequence[str], weights: Mapping[str, float], limit: int, metric: Metric = Metric.L2, known: Sequence[str] | None = None) -> DataFrame:
    """qid, place, field, eid, score over the chosen fields of (field, eid, embedding).

    ``known``: the collection's fields; asking for another is an error.
    """
    for name in attributes:
        if known is not None and name not in known:
            raise ValueError(f"unknown attribute {name!r}")
    chosen = vectors.where(F.col("field").isin(list(attributes))) if attributes else vectors
    hits = nearest_batch(chosen, queries, limit, metric, group=("field",))
    return merge_fields(hits, weights, limit).select("qid", "place", "field", "eid", "score")


def with_documents(hits: DataFrame, docs: DataFrame, strict: bool = False, how: str = "left") -> DataFrame:
    """Hits with their document; ``strict`` makes a missing one an error."""
    joined = hits.join(docs, "doc_id", how)
    if strict:
        joined = joined.where(F.assert_true(F.col("doc").isNotNull(), F.lit("document missing")).isNull())
    return joined


def recall(found: DataFrame, truth: DataFrame, k: int) -> DataFrame:
    """qid and the share of its k true neighbours that were found."""
    hit = truth.join(found.select("qid", "eid").distinct(), ["qid", "eid"], "left_semi").groupBy("qid").agg(F.count(F.lit(1)).alias("hits"))
    return truth.select("qid").distinct().join(hit, "qid", "left").select("qid", (F.coalesce("hits", F.lit(0)) / k).alias("recall"))


def similarity_filter(vectors: DataFrame, concept: Column, threshold: float = 0.2093) -> DataFrame:
    """Rows not more similar to a concept vector than the threshold."""
    return vectors.where(V.cosine_similarity(F.col("embedding"), concept) <= threshold)
