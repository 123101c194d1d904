import numpy as np
import pytest
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import quantize
from vectide.types import Metric, aligned, checked_content, checked_id, checked_limit, chunk_offsets, ModelClass


def one(spark, a, b, f):
    return spark.createDataFrame([(a, b)], "a array<float>, b array<float>").select(f(F.col("a"), F.col("b"))).first()[0]


def test_known_distances(spark):
    x = [float(i) for i in (0, 0, 1, 2, 3, 4, 5, 6, 7, 1, 1, 2, 3, 4)]
    assert one(spark, x, x, V.l2) == 0
    a, b = [float(i) for i in range(1, 15)], [float(i) for i in range(15, 29)]
    assert one(spark, a, b, lambda p, q: V.cosine(V.normalize(p), V.normalize(q))) == pytest.approx(0.047009885, abs=1e-6)
    assert one(spark, a, a, lambda p, q: V.cosine(V.normalize(p), V.normalize(q))) == pytest.approx(0, abs=1e-9)
    c, d = [float(i) for i in range(10, 26)], [float(i) for i in range(40, 56)]
    assert one(spark, c, d, V.l2) == 14400
    assert one(spark, c, d, V.l1) == 480


def test_hamming_counts_bits_of_floats():
    a, b = np.zeros((1, 64), np.float32), np.zeros((1, 64), np.float32)
    a.view(np.uint32)[0, 10] = 1
    assert V.exact(a, b, Metric.HAMMING)[0] == 1
    a.view(np.uint32)[0, 63] = 1 << 7
    assert V.distances(a, b, Metric.HAMMING)[0, 0] == 2


@pytest.mark.parametrize("metric", [Metric.L2, Metric.L1, Metric.COSINE])
def test_expressions_equal_kernels(spark, metric):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(20, 8)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist(), w.tolist()) for i, (v, w) in enumerate(zip(x[:-1], x[1:], strict=True))], "i int, a array<float>, b array<float>")
    a, b = (V.normalize(F.col(c)) if metric is Metric.COSINE else F.col(c) for c in "ab")
    got = [r[0] for r in rows.orderBy("i").select(V.DISTANCE[metric](a, b)).collect()]
    p, q = (V.unit(m) if metric is Metric.COSINE else m for m in (x[:-1], x[1:]))
    assert np.allclose(got, V.exact(p, q, metric), atol=1e-9)
    assert np.allclose(np.diag(V.distances(p, q, metric)), got, atol=1e-6)


def test_small_vectors_are_not_normalised(spark):
    assert one(spark, [1e-5, 0.0], [1.0, 0.0], lambda a, b: V.cosine(V.normalize(a), V.normalize(b))) == pytest.approx(1, abs=1e-4)


def test_padding(spark):
    assert aligned(126) == 128 and aligned(16) == 16
    assert one(spark, [1.0] * 5, [], lambda a, _: F.size(V.pad(a, 5))) == 16
    with pytest.raises(Exception, match="longer"):
        one(spark, [1.0] * 17, [], lambda a, _: V.pad(a, 16))


def test_validation():
    assert checked_id("abc\0\0") == "abc"
    with pytest.raises(ValueError):
        checked_id("x" * 17)
    assert checked_limit(1024) == 1024
    for bad in (0, 1025):
        with pytest.raises(ValueError):
            checked_limit(bad)
    with pytest.raises(ValueError):
        checked_content(ModelClass.E5, "image_uri")
    assert chunk_offsets(10, 3) == [0, 4, 7, 10]


def test_scalar_codes_saturate(spark):
    row = spark.createDataFrame([([-1.0, 0.5, 99.0, float("nan")],)], "v array<float>").select(quantize.codes(F.col("v"), F.lit(0.0), F.lit(0.1))).first()[0]
    assert row == [0, 5, 255, 0]


def test_product_quantizer_reranks_well(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(400, 16)).astype(np.float32)
    rows = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "eid long, embedding array<float>")
    book = quantize.train_product(rows, 16, 4, centres=32).cache()
    coded = quantize.encode_product(rows, book, 16, 4)
    got = {r[0] for r in quantize.reranked(coded, book, rows, x[7].tolist(), 16, 4, 80, 10).collect()}
    true = set(np.argsort(((x - x[7]) ** 2).sum(1))[:10].tolist())
    assert len(got & true) >= 8 and 7 in got
