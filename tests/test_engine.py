import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.operators import embed, flatten, graph, knn, pairs
from vectide.operators.store import Engine
from vectide.streaming import ingest
from vectide.types import CollectionSettings, GraphParams, Metric, ModelClass


def test_nearest_of_a_line(spark):
    """Vectors along a line: the far end is nearest to a point beyond it; without it, the next one."""
    rows = spark.createDataFrame([(f"v{i}", [0.5 * i + d for d in range(24)]) for i in range(60)], "eid string, embedding array<float>")
    beyond = [40.0 + d for d in range(24)]
    for metric, far in ((Metric.L2, lambda i: 24 * (40 - 0.5 * i) ** 2), (Metric.L1, lambda i: 24 * (40 - 0.5 * i))):
        assert [(r.eid, r.distance) for r in knn.nearest(rows, beyond, 3, metric).collect()] == [(f"v{i}", pytest.approx(far(i))) for i in (59, 58, 57)]
    from vectide.operators import store

    left = store.without(rows, spark.createDataFrame([("v59",), ("missing",)], "eid string"))
    assert knn.nearest(left, beyond, 1).first().eid == "v58"


def test_weighted_merge(spark):
    x = {"one": ("name", [3.0, 4.0]), "two": ("text", [6.0, 8.0]), "three": ("other", [1.0, 0.0])}
    rows = spark.createDataFrame([(f, e, v) for e, (f, v) in x.items()], "field string, eid string, embedding array<float>")
    q = spark.createDataFrame([(0, [0.0, 0.0])], "qid long, embedding array<float>")
    weights = {"name": 3.0, "text": 1.0}
    far = {e: sum(c * c for c in v) for e, (_, v) in x.items()}
    want = {e: far[e] / max(far.values()) * (1 - weights[f] / 4 if f in weights else 1) for e, (f, _) in x.items()}
    hits = knn.search(rows, q, ["name", "text", "other"], weights, 10, known=["name", "text", "other"]).orderBy("place").collect()
    assert [(h.eid, h.score) for h in hits] == [(e, pytest.approx(want[e])) for e in sorted(want, key=want.get)]
    with pytest.raises(ValueError):
        knn.search(rows, q, ["absent"], {}, 10, known=["name", "text", "other"])


def test_batch_equals_single_and_all_distances_zero(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(300, 12)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "eid long, embedding array<float>").repartition(3)
    q = spark.createDataFrame([(i, x[i].tolist()) for i in (3, 200)], "qid long, embedding array<float>")
    for metric in (Metric.L2, Metric.L1, Metric.COSINE):
        batch = knn.nearest_batch(rows, q, 7, metric)
        for i in (3, 200):
            want = [(r.eid, r.distance) for r in knn.nearest(rows, x[i].tolist(), 7, metric).collect()]
            got = [(r.eid, r.distance) for r in batch.where(F.col("qid") == i).orderBy("rank").collect()]
            assert [e for e, _ in got] == [e for e, _ in want]
            assert np.allclose([d for _, d in got], [d for _, d in want], atol=2e-6)
    same = spark.createDataFrame([("f", "a", [1.0]), ("f", "b", [1.0])], "field string, eid string, embedding array<float>")
    out = knn.search(same, spark.createDataFrame([(0, [1.0])], "qid long, embedding array<float>"), [], {"f": 1}, 5).collect()
    assert [r.score for r in out] == [0.0, 0.0]


def test_flatten():
    assert flatten.flat({"book": {"name": "x", "year": 1999}, "ok": True}) == {"book.name": "x", "book.year": 1999, "ok": True}
    doc = {"head": "H", "parts": [{"text": t, "lang": "en"} for t in ("one", "two")]}
    assert flatten.flat(doc) == {"head": "H", "parts.text": ["one", "two"], "parts.lang": ["en", "en"]}
    assert flatten.flat({"p": [{"x": "one"}]}) == {"p.x": "one"}
    assert flatten.flat({"t": ["a", 1, "b"], "e": [], "o": {}, "n": None}) == {"t": ["a", 1, "b"], "n": None}
    with pytest.raises(ValueError):
        flatten.parse("[1]")


def requests(spark, *bodies):
    return spark.createDataFrame([(str(i), json.dumps(b)) for i, b in enumerate(bodies)], "batch string, body string")


def encode(rows):
    return embed.encode(rows)


def test_engine_life(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), encode)
    settings = CollectionSettings("books", Metric.COSINE, dim=64, model_class=ModelClass.HASHING, model_name="md5-64")
    engine.create(settings)
    with pytest.raises(ValueError):
        engine.create(settings)
    with pytest.raises(KeyError):
        engine.index("unknown", requests(spark, {}))
    engine.index("books", requests(spark, [{"_id": "a", "title": "red fox", "tags": ["quick", 7, "brown"]}, {"_id": "b", "title": "blue whale"}]))
    assert {(r.field, r.eid) for r in engine.vectors("books").collect()} == {("title", "a"), ("title", "b"), ("tags", "a:0"), ("tags", "a:2")}
    q = spark.createDataFrame([(0, "red fox")], "qid long, text string")
    top = engine.search("books", q, ["title"], limit=1).first()
    assert (top.doc_id, json.loads(top.doc)["title"]) == ("a", "red fox")
    engine.index("books", requests(spark, {"_id": "a", "title": "grey frog"}, {"_id": "a", "title": "green frog"}))
    assert json.loads(engine.documents("books").where("doc_id = 'a'").first().doc)["title"] == "green frog"
    assert {(r.field, r.eid) for r in engine.vectors("books").collect()} == {("title", "a"), ("title", "b")}
    engine.delete("books", ["a", "nothing"])
    assert [r.doc_id for r in engine.documents("books").collect()] == ["b"]
    with pytest.raises(ValueError):
        engine.search("books", q, ["tags"])
    engine.compact("books", str(tmp_path / "small"))
    assert Engine(spark, str(tmp_path / "small")).documents("books").count() == 1
    engine.drop("books")
    engine.drop("books")
    assert engine.collections().count() == 0


def test_stream_ends_like_batch(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i, rows in enumerate(([("put", {"_id": "a", "t": "one"}), ("put", {"_id": "b", "t": "two"})], [("del", "a")])):
        body = [json.dumps({"batch": str(i), "op": op, "body": x if isinstance(x, str) else json.dumps(x)}) for op, x in rows]
        (tmp_path / "in" / f"{i}.json").write_text("\n".join(body))
        os.utime(tmp_path / "in" / f"{i}.json", (1_000_000 + i, 1_000_000 + i))
    engine = Engine(spark, str(tmp_path / "db"), encode)
    engine.create(CollectionSettings("s", Metric.L2, dim=64, model_class=ModelClass.HASHING, model_name="md5-64"))
    ingest.start(engine, "s", ingest.requests(spark, str(tmp_path / "in"), 1), str(tmp_path / "ck")).awaitTermination(120)
    assert [r.doc_id for r in engine.documents("s").collect()] == ["b"]


def test_stream_keeps_the_order_of_requests(spark, tmp_path):
    engine = Engine(spark, str(tmp_path / "db"), encode)
    engine.create(CollectionSettings("s", Metric.L2, dim=64, model_class=ModelClass.HASHING, model_name="md5-64"))
    put = lambda i, **x: json.dumps({"_id": i, **x})
    rows = [("b", "put", put("a", t="one"), 1), ("b", "del", "a", 2), ("b", "del", "c", 3), ("b", "put", put("c", t="two"), 4), ("b", "put", put("d", t="old"), 5), ("b", "put", put("d", t="new"), 6)]
    ingest.apply(engine, "s", spark.createDataFrame(rows, ingest.REQUESTS).repartition(3))
    assert {r.doc_id: json.loads(r.doc)["t"] for r in engine.documents("s").collect()} == {"c": "two", "d": "new"}
    assert {r.eid for r in engine.vectors("s").collect()} == {"c", "d"}
    ingest.apply(engine, "s", spark.createDataFrame([("x", "del", "d", None), ("x", "put", put("c", u="three"), None)], ingest.REQUESTS))
    assert {(r.field, r.eid) for r in engine.vectors("s").collect()} == {("u", "c")}


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    def load():
        def fails(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return np.ones((len(texts), 3))

        return fails

    embed.register(ModelClass.HASHING, "fails", load)
    engine = Engine(spark, str(tmp_path / "db"), lambda rows: embed.encode(rows, name="fails"))
    engine.create(CollectionSettings("s", Metric.COSINE, dim=16, model_class=ModelClass.HASHING, model_name="fails"))
    engine.index("s", requests(spark, {"_id": "a", "t": "good"}))
    with pytest.raises(Exception, match="not encoded: no"):
        engine.index("s", requests(spark, {"_id": "a", "t": "bad"}, {"_id": "b", "t": "fine"}))
    assert [(r.doc_id, json.loads(r.doc)["t"]) for r in engine.documents("s").collect()] == [("a", "good")]
    row = engine.vectors("s").first()
    assert len(row.embedding) == 16 and sum(x * x for x in row.embedding) == pytest.approx(1)
    assert engine._commit("one") + 1 == engine._commit("two")
    with pytest.raises(ValueError, match="l2"):
        engine.opened("s", Metric.L2, 16)
    assert engine.opened("s", Metric.COSINE, 16).count() == 1
    with pytest.raises(ValueError, match="dimensions"):
        other = Engine(spark, str(tmp_path / "other"))
        other.create(CollectionSettings("s", Metric.COSINE, dim=32))
        engine.compact("s", str(tmp_path / "other"))
    engine.create(CollectionSettings("wide", Metric.L2, dim=2))
    with pytest.raises(Exception, match="longer than"):
        Engine(spark, str(tmp_path / "db"), lambda rows: embed.encode(rows, name="md5-64")).index("wide", requests(spark, {"_id": "a", "t": "x"}))


def test_encode_errors(spark):
    def load():
        def fails(texts):
            if "bad" in texts:
                raise RuntimeError("no")
            return np.zeros((len(texts), 2))

        return fails

    embed.register(ModelClass.HASHING, "picky", load)
    rows = spark.createDataFrame([("bad",), ("good",)], "value string").coalesce(1)
    out = {r.value: r for r in embed.encode(rows, name="picky", batch=1).collect()}
    assert out["bad"].err_message == "no" and out["bad"].embedding is None and out["good"].embedding == [0.0, 0.0]
    with pytest.raises(KeyError):
        embed.encode(rows, name="missing")
    with pytest.raises(ValueError):
        embed.encode(rows, kind="image_uri")


def test_graph_recall_and_repair(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select(F.col("vec_id").cast("string").alias("eid"), "embedding")
    q = rows.where("eid % 50 = 0").select(F.col("eid").cast("long").alias("qid"), "embedding")
    params = GraphParams(degree=16, queue=64, pool=64)
    built = graph.build(rows, params=params, shards=2).cache()
    assert built.select(F.max(F.size("nbrs"))).first()[0] <= 1.3 * 16

    def recall(found, base):
        truth = knn.nearest_batch(base, q, 10)
        return [r.recall for r in knn.recall(found, truth, 10).collect()]

    got = recall(graph.search(built, q, 10, params=params), rows)
    assert min(got) >= 0.9 and np.mean(got) > 0.95
    gone = rows.where("eid % 5 = 1").select("eid")
    left = rows.where("eid % 5 <> 1")
    assert min(recall(graph.search(built, q, 10, params=params, deleted=gone), left)) >= 0.8
    fixed = graph.consolidate(built, gone, params=params)
    assert fixed.count() == left.count()
    assert np.mean(recall(graph.search(fixed, q, 10, params=params), left)) > 0.9


def test_learned_projection():
    import pandas as pd

    rng = np.random.default_rng(4)
    signal = rng.normal(size=(400, 4))
    y = np.where(rng.random(400) < 0.5, 1, -1)
    a = np.concatenate([signal, 3 * rng.normal(size=(400, 4))], 1)
    b = np.concatenate([signal * y[:, None], 3 * rng.normal(size=(400, 4))], 1)
    rows = pd.DataFrame({"emb_a": list(a), "emb_b": list(b), "label": y})
    best = pairs.train_projection(rows[:200], rows[200:], rate=0.5, epochs=40)
    start = pairs._best((a[200:] * b[200:]).sum(1) / np.linalg.norm(a[200:], axis=1) / np.linalg.norm(b[200:], axis=1), y[200:])
    assert best.losses[-1] < best.losses[0] and best.accuracy > start + 0.05
