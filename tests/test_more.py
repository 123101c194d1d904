import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import embed, graph, knn, quantize, store
from vectide.types import GraphParams, Metric, ram_budget, ram_estimate, rows_per_segment


def test_missing_document_is_an_error_when_strict(spark):
    hits = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    docs = spark.createDataFrame([("a", "{}")], "doc_id string, doc string")
    assert knn.with_documents(hits, docs).count() == 2
    assert knn.with_documents(hits, docs, how="inner").count() == 1
    with pytest.raises(Exception, match="document missing"):
        knn.with_documents(hits, docs, strict=True).collect()


def test_graph_survives_writing(spark, tmp_path):
    rng = np.random.default_rng(9)
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(rng.normal(size=(120, 8)).astype(np.float32))], "eid string, embedding array<float>")
    params = GraphParams(degree=8, queue=32, pool=32)
    graph.build(rows, Metric.COSINE, params, 2).write.parquet(str(tmp_path / "g"))
    again = spark.read.parquet(str(tmp_path / "g"))
    q = rows.where("eid = '5'").select(F.lit(0).cast("long").alias("qid"), "embedding")
    top = graph.search(again, q, 3, Metric.COSINE, params).orderBy("rank").collect()
    assert top[0].eid == "5" and top[0].distance == pytest.approx(0, abs=1e-6)


def test_sizes():
    assert rows_per_segment(1024, 768) == 1000 and rows_per_segment(1024, 16) == 16384
    assert ram_budget(0.5) == 0.5 * 2**30 and ram_budget(1) == 0.75 * 2**30
    assert ram_estimate(1000, 128, 4, 64) == pytest.approx(1.1 * (512000 + 614400 + 5000))


def test_pooling_alike_in_numpy_and_in_a_plan(spark):
    rng = np.random.default_rng(1)
    hidden, mask = rng.normal(size=(2, 3, 4)).astype(np.float32), np.array([[1, 1, 0], [1, 1, 1]])
    rows = spark.createDataFrame([(i, h.tolist(), m.tolist()) for i, (h, m) in enumerate(zip(hidden, mask, strict=True))], "id int, hidden array<array<float>>, mask array<int>")
    got = [r.value for r in embed.pooled(rows).orderBy("id", "dim").collect()]
    assert np.allclose(np.reshape(got, (2, 4)), embed.average_pool(hidden, mask), atol=1e-6)


def test_image_tensor_is_square_and_normalised():
    out = embed.image_tensor(np.full((40, 60, 3), 255, np.uint8), 16)
    assert out.shape == (3, 16, 16)
    assert np.allclose(out[:, 0, 0], [(1 - m) / s for m, s in zip(embed.PIXEL_MEAN, embed.PIXEL_STD, strict=True)])
    tall = np.zeros((64, 32, 3), np.uint8)
    tall[:, :16, 0] = 255
    left = embed.image_tensor(tall, 8)[0]
    assert left[:, 0].min() > left[:, -1].max()


def test_latest_prefers_deletion_at_equal_sequence(spark):
    log = spark.createDataFrame([("k", 1, "put"), ("k", 2, "put"), ("k", 2, "del"), ("m", 1, "put")], "key string, seq long, op string")
    assert [r.key for r in store.live(log, ["key"]).collect()] == ["m"]


def test_quantile_sketch_is_near_the_exact_one(spark):
    rng = np.random.default_rng(3)
    rows = spark.createDataFrame([(v.tolist(),) for v in rng.integers(1, 1_000_000, (100, 64)).astype(np.float32)], "embedding array<float>")
    exact, sketch = (quantize.fit_scalar(rows, accuracy=a).first() for a in (None, 10000))
    assert sketch.alpha == pytest.approx(exact.alpha, rel=0.01)
    codes = quantize.encode_scalar(rows, quantize.fit_scalar(rows)).select(F.array_min("codes"), F.array_max("codes")).collect()
    assert all(0 <= a and b <= 255 for a, b in codes)


def test_unknown_models_and_empty_queries(spark):
    rows = spark.createDataFrame([(1, [1.0, 2.0])], "eid long, embedding array<float>")
    none = spark.createDataFrame([], "qid long, embedding array<float>")
    assert knn.nearest_batch(rows, none, 3).count() == 0


def test_guided_walk_and_counters(spark):
    """A walk by codes finds nearly what exact distances find, and measures only what it expands."""
    rng = np.random.default_rng(2)
    x = (rng.normal(size=(12, 16))[rng.integers(0, 12, 1500)] + 0.5 * rng.normal(size=(1500, 16))).astype(np.float32)
    params = GraphParams(degree=16, queue=48, pool=64)
    built = graph.Graph(x, Metric.L2, params).build()
    assert ((built.nbrs >= 0).sum(1) <= 1.3 * 16).all() and ((built.nbrs >= 0).sum(1) > 0).all()
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "eid long, embedding array<float>")
    book = quantize.train_product(rows, 16, 4, centres=64).cache()
    pivots = [np.array([r.pivot for r in book.where(F.col("chunk") == c).orderBy("center").collect()], np.float32) for c in range(4)]
    codes = np.stack([((x[:, None, 4 * c : 4 * c + 4] - pivots[c][None]) ** 2).sum(2).argmin(1) for c in range(4)], 1)
    q = x[::30] + 0.01
    truth = [set(np.argsort(((x - y) ** 2).sum(1))[:10].tolist()) for y in q]
    plain, guided = graph.Counters(), graph.Counters()
    exact, _ = built.search(q, 48, 10, counters=plain)
    coded, dist = built.search(q, 48, 10, lookup=graph.Lookup(codes, pivots), counters=guided)
    assert np.mean([len(t & set(r)) / 10 for t, r in zip(truth, exact.tolist(), strict=True)]) > 0.97
    assert np.mean([len(t & set(r)) / 10 for t, r in zip(truth, coded.tolist(), strict=True)]) > 0.9
    assert np.allclose(dist[0], ((x[coded[0]] - q[0]) ** 2).sum(1), rtol=1e-4) and (np.diff(dist, axis=1) >= 0).all()
    assert guided.measured == guided.expanded < guided.looked_up and plain.looked_up == 0
    hidden = np.zeros(1500, bool)
    hidden[coded[0][:3]] = True
    assert not set(built.search(q[:1], 48, 10, hidden)[0][0].tolist()) & set(coded[0][:3].tolist())


def test_search_walks_on_until_it_is_settled():
    """Vectors without structure: a short queue misses neighbours that twice the queue finds; hidden rows stay hidden."""
    rng = np.random.default_rng(5)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.sqrt((x**2).sum(1, keepdims=True))
    built = graph.Graph(x, Metric.L2, GraphParams(degree=8, queue=12, pool=20)).build()
    q, hidden = x[::30], np.arange(3000) % 3 == 1
    pivots = [x[:32, 8 * c : 8 * c + 8] for c in range(4)]
    codes = np.stack([((x[:, None, 8 * c : 8 * c + 8] - pivots[c][None]) ** 2).sum(2).argmin(1) for c in range(4)], 1)
    for gone in (None, hidden):
        far = ((x[None] - q[:, None]) ** 2).sum(2)
        truth = np.argsort(far if gone is None else np.where(gone, np.inf, far), axis=1)[:, :10]
        for lookup in (None, graph.Lookup(codes, pivots)):
            once, settled = (np.array([len(set(t) & set(r)) for t, r in zip(truth.tolist(), f(q, 12, 10, gone, lookup)[0].tolist(), strict=True)]) for f in (built.search, built.settled))
            assert settled.min() >= 7 > once.min() and settled.mean() > max(9.5, once.mean())
            assert gone is None or not gone[built.settled(q, 12, 10, gone, lookup)[0]].any()
    assert built.settled(q, 12, 10, np.ones(3000, bool))[0].max() == -1


def test_graph_on_disk_by_shard_and_guided_in_a_plan(spark, tmp_path):
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(str(i), v.tolist()) for i, v in enumerate(rng.normal(size=(400, 8)).astype(np.float32))] + [("999", None)], "eid string, embedding array<float>")
    params = GraphParams(degree=12, queue=48, pool=64)
    graph.write(graph.build(rows, params=params, shards=3), str(tmp_path / "g"))
    again = graph.read(str(tmp_path / "g"), spark)
    q = rows.where("eid % 40 = 0 AND embedding IS NOT NULL").select(F.col("eid").cast("long").alias("qid"), "embedding")
    truth = knn.nearest_batch(rows, q, 5)
    book = quantize.train_product(rows.where("embedding IS NOT NULL").select(F.col("eid").cast("long").alias("eid"), "embedding"), 8, 4, centres=32)
    for found in (graph.search(again, q, 5, params=params), graph.search(again, q, 5, params=params, codebook=book)):
        got = [r.recall for r in knn.recall(found.where("rank <= 5"), truth, 5).collect()]
        assert np.mean(got) > 0.9
    assert "shard=1" in {p.name for p in (tmp_path / "g").iterdir()}


def test_too_many_queries_for_one_graph_search(spark, monkeypatch):
    monkeypatch.setattr(graph, "MOST_QUERIES", 3)
    rows = spark.createDataFrame([(i, [float(i)]) for i in range(5)], "eid long, embedding array<float>")
    with pytest.raises(ValueError, match="more than 3 queries"):
        graph.search(graph.build(rows), rows.withColumnRenamed("eid", "qid"), 1)


def test_index_on_disk(spark, tmp_path):
    rng = np.random.default_rng(11)
    rows = spark.createDataFrame([(f"v{i}", v.tolist()) for i, v in enumerate(rng.normal(size=(300, 12)).astype(np.float32))], "eid string, embedding array<float>")
    params = GraphParams(degree=12, queue=48, pool=64)
    graph.build_on_disk(rows, str(tmp_path / "i"), params=params, shards=2)
    q = rows.where("eid IN ('v3', 'v77')").select(F.when(F.col("eid") == "v3", 3).otherwise(77).cast("long").alias("qid"), "embedding")
    found = graph.search_on_disk(spark, str(tmp_path / "i"), q, 5, params=params)
    assert {r.qid: r.eid for r in found.where("rank = 1").collect()} == {3: "v3", 77: "v77"}
    assert [r.recall for r in knn.recall(found, knn.nearest_batch(rows, q, 5), 5).collect()] == [1.0, 1.0]
    assert graph.code_chunks(10**9, 128, 1.0) == 1 and graph.code_chunks(10**7, 128, 1.0) == 80 and graph.code_chunks(10, 1000, 1.0) == 512
