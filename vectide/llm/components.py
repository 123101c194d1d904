"""Connected components by alternating large and small stars, on DataFrames.

Edges stay distributed; every round is checkpointed to the shared folder. Hub
nodes are handled by partial aggregation and by joins that Spark can split.
Up to ``SMALL`` edges, a fixed bound, one task joins them by union-find instead,
with the same result.
"""

from __future__ import annotations

import gc
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.sources.folders import shared_folder


#: edges that one task may hold (16 bytes each, some 200 in its tables)
SMALL = 250_000


def cut_lineage(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def free_shuffles(spark: SparkSession) -> None:
    """Let Spark delete the shuffle files of finished turns: it does so for those that the driver has forgotten."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def _stars(both: DataFrame, large: bool) -> DataFrame:
    """both: (u, v) pairs to look at from u. Links v (and u) to the least node around u."""
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
    linked = both.join(least, "u")
    if large:
        return linked.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
    return linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(linked.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first())


def _union_find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    parent: dict[int, int] = {}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, b = root(u), root(v)
            if a != b:
                parent[max(a, b)] = min(a, b)
    nodes = list(parent)
    yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "component"])


def components(edges: DataFrame, small: int = SMALL) -> DataFrame:
    """(node, component) of every node with an edge in (a, b), nodes long; a component is its least node."""
    now = cut_lineage(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = _state(now)
    if state[0] <= small:
        return cut_lineage(now.repartition(1).mapInArrow(_union_find, "node long, component long"))
    while state[0]:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        big = _stars(both, True)
        now = cut_lineage(_stars(big.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), False))
        last, state = state, _state(now)
        if state == last:
            break
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(roots)
