"""Exact neighbours: ties by id, rows without a vector, vectors of another dimension, against plain Python."""

import numpy as np
import pytest

from vectide.operators import knn
from vectide.types import Metric

SCHEMA = "eid long, embedding array<float>"


@pytest.mark.parametrize("metric", list(Metric))
def test_equal_vectors_come_by_id(spark, metric):
    v = [float(x) for x in range(1, 9)]
    rows = spark.createDataFrame([(i, v) for i in range(500)], SCHEMA).repartition(7)
    queries = spark.createDataFrame([(1, v), (2, v[::-1])], "qid long, embedding array<float>")
    got = knn.nearest_batch(rows, queries, 10, metric).collect()
    assert sorted((r.qid, r.rank, r.eid) for r in got) == [(q, i + 1, i) for q in (1, 2) for i in range(10)]


def test_ties_at_the_edge_and_by_rounding(spark, monkeypatch):
    monkeypatch.setattr(knn, "ROW_BLOCK", 64)
    monkeypatch.setattr(knn, "PAIR_BLOCK", 32)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 3)
    rng = np.random.default_rng(5)
    x = rng.integers(0, 3, (300, 4)).astype(np.float32)
    x[:150] += rng.uniform(0, 2e-8, (150, 4)).astype(np.float32)
    ids = rng.permutation(300)
    rows = spark.createDataFrame([(int(i), [float(y) for y in r]) for i, r in zip(ids, x, strict=True)], SCHEMA).repartition(5)
    q = rng.integers(0, 3, (10, 4)).astype(np.float32)
    queries = spark.createDataFrame([(i, [float(y) for y in r]) for i, r in enumerate(q)], "qid long, embedding array<float>")
    for metric in (Metric.L2, Metric.L1, Metric.HAMMING):
        got = {}
        for r in knn.nearest_batch(rows, queries, 12, metric).collect():
            got.setdefault(r.qid, []).append((r.rank, r.eid, r.distance))
        for i, y in enumerate(q):
            if metric is Metric.HAMMING:
                far = np.bitwise_count(x.view(np.uint32) ^ y.view(np.uint32)).sum(1).astype(float)
            else:
                d = x.astype(float) - y.astype(float)
                far = (d * d).sum(1) if metric is Metric.L2 else np.abs(d).sum(1)
            want = sorted(zip(np.round(far, 6).tolist(), ids.tolist(), strict=True))[:12]
            assert [(d, e) for _, e, d in sorted(got[i])] == want


def test_rows_without_a_vector_and_other_dimensions(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0]), (2, None), (3, [1.0, 1.0])], SCHEMA)
    queries = spark.createDataFrame([(7, [1.0, 1.0]), (8, None)], "qid long, embedding array<float>")
    assert [(r.qid, r.eid) for r in knn.nearest_batch(rows, queries, 5).orderBy("rank").collect()] == [(7, 3), (7, 1)]
    assert [r.eid for r in knn.nearest(rows, [1.0, 1.0], 5).collect()] == [3, 1]
    ragged = rows.union(spark.createDataFrame([(4, [1.0])], SCHEMA))
    for found in (lambda: knn.nearest_batch(ragged, queries, 5), lambda: knn.nearest(ragged, [1.0, 1.0], 5)):
        with pytest.raises(Exception, match="dimension"):
            found().collect()
    with pytest.raises(ValueError, match="dimensions"):
        knn.nearest_batch(rows, queries.union(spark.createDataFrame([(9, [1.0])], "qid long, embedding array<float>")), 5)
    assert knn.nearest_batch(rows.where("eid < 0"), queries, 5).count() == 0


def test_more_queries_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(knn, "QUERY_BYTES", 8 * 2 * 3)
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(40)], SCHEMA)
    queries = spark.createDataFrame([(i, [float(i) + 0.1, 0.0]) for i in range(10)], "qid long, embedding array<float>")
    got = sorted((r.qid, r["rank"], r.eid) for r in knn.nearest_batch(rows, queries, 2).collect())
    assert got == sorted((i, n + 1, e) for i in range(10) for n, e in enumerate((i, i + 1)))
