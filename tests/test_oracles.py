"""Every engine query against its SQL, on the smallest tables."""

import duckdb
import numpy as np
import pytest

from vectide.plans import formats  # noqa: F401  registers its queries
from vectide.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def shown(value):
    if isinstance(value, (list, tuple, np.ndarray)):
        return tuple(map(shown, value))
    if isinstance(value, float):
        return round(value, 5) + 0.0
    return value


def rows(found, names):
    at = [found[0].index(n) for n in names]
    return sorted(tuple(repr(shown(r[i])) for i in at) for r in found[1])


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, sql, name):
    df = plans.QUERIES[name](spark, SF)
    got = (df.columns, [tuple(r) for r in df.collect()])
    if name not in plans.ORACLES:
        assert got[1]
        return
    want = sql.sql(plans.ORACLES[name])
    names = sorted(df.columns)
    assert names == sorted(want.columns)
    assert rows(got, names) == rows((want.columns, want.fetchall()), names)


def test_segments_beyond_the_first(spark, tmp_path):
    """The smallest tables fill one segment only; segments begin at the ids at which SQL begins them."""
    spark.range(2100).selectExpr("id AS vec_id", "array(0f) AS embedding", "0 AS label").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = sorted(tuple(r) for r in plans.QUERIES["segment_sizes"](spark, str(tmp_path)).collect())
    want = duckdb.sql(plans.ORACLES["segment_sizes"].replace("embeddings", f"'{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    assert got == sorted(want) == [(0, 1000), (1, 1000), (2, 100)]


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 50
    assert set(entry.oracle_sql()) <= set(entry.queries())
