"""Mixing sources to target weights along a time-varying curriculum.

Every source has a weight schedule over training time 0..1: its share times a
linear ramp from ``start`` to ``end`` (mean 1). Its integral is the source's
cumulative token demand. A document copy that covers words c..c+size of its
source is trained where the demand reaches its middle: the integral is
inverted there, and documents are range-sorted by that position.

Nulls: a null text has size 0; null sources form one source, sorted last; rows without a
doc_id are ordered by their place in the table. Repeated rows are separate documents; ties of the
order are broken by size. Very long texts count whole. Columns beyond doc_id, source, text
and ``keep`` are not read. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.tables import WORD, stored

WEIGHTS = (5.0, 2.0, 1.0)
#: (start, end) of the ramp for each weight in turn
RAMPS = ((1.4, 0.6), (1.0, 1.0), (0.6, 1.4))
LIMIT = 3.0


def _cycle(rank: Column, values: Sequence[float]) -> Column:
    return F.element_at(F.array(*map(F.lit, map(float, values))), (F.pmod(rank, F.lit(len(values))) + 1).cast("int"))


def targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, ramps: Sequence[tuple[float, float]] = RAMPS, limit: float = LIMIT) -> DataFrame:
    """Per source of (source, source_size): its target words and ramp.

    Shares are proportional to the weights; what exceeds ``limit`` times a
    source's size is shared among the others again. The common level of the
    uncapped sources is the largest of the levels that result from capping the
    sources one by one in order of cap / weight.
    """
    everything = Window.partitionBy()
    ranked = sizes.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1).withColumns(
        {"weight": _cycle(F.col("rank"), weights), "ramp": _cycle(F.col("rank"), [r[0] for r in ramps]) - 1, "cap": limit * F.col("source_size")}
    )
    before = Window.orderBy(F.col("cap") / F.col("weight"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0.0)
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), zero)) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero))
    leveled = ranked.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    return leveled.select("source", "source_size", F.least("cap", F.col("level") * F.col("weight")).alias("target"), "ramp")


def position(share: Column, ramp: Column) -> Column:
    """Time at which a linear ramp 1+ramp .. 1-ramp has given ``share`` of its integral."""
    x = F.least(F.greatest(share, F.lit(0.0)), F.lit(1.0))
    root = ((1 + ramp) - F.sqrt(F.greatest((1 + ramp) * (1 + ramp) - 4 * ramp * x, F.lit(0.0)))) / (2 * ramp)
    return F.when(F.abs(ramp) < 1e-9, x).otherwise(root)


def mix_sources(docs: DataFrame, weights: Sequence[float] = WEIGHTS, ramps: Sequence[tuple[float, float]] = RAMPS, limit: float = LIMIT, keep: Sequence[str] = ()) -> DataFrame:
    """One row per document: how many copies the mix takes, and where the first is trained.

    Columns: doc_id, ``keep``, size, source_size, target, copies, taken, rank_words
    (words of the source before it), ramp, position. Sources are cut into hash
    blocks, so that running sums need no task to hold a whole source.
    """
    # rows without an id are dealt by their place in the table, so that they fill no block
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string"))).cast("binary"))
    sized = stored(docs.select("doc_id", "source", *keep, F.regexp_count(F.coalesce("text", F.lit("")), F.lit(WORD)).cast("long").alias("size"), key.alias("key")))
    blocks = max(1, min(65536, sized.count() // 200))
    sized = sized.withColumn("block", F.floor(F.conv(F.substring("key", 1, 4), 16, 10).cast("long") * blocks / 65536))
    of_block = sized.groupBy("source", "block").agg(F.sum("size").alias("block_size"))
    of_source = targets(of_block.groupBy("source").agg(F.sum("block_size").alias("source_size")), weights, ramps, limit)
    earlier = Window.partitionBy("source").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = of_block.withColumn("block_start", F.coalesce(F.sum("block_size").over(earlier), F.lit(0))).drop("block_size")
    starts = starts.join(of_source.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s").withColumnsRenamed({"source": "s", "block": "b"})
    inside = Window.partitionBy("source", "block").orderBy("key", F.col("size"), *keep).rowsBetween(Window.unboundedPreceding, -1)
    placed = sized.withColumn("rank_words", F.coalesce(F.sum("size").over(inside), F.lit(0)))
    placed = placed.join(starts, F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))).withColumn("rank_words", F.col("rank_words") + F.col("block_start"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0))
    rest = F.col("target") - whole * F.col("source_size")
    more = (F.col("size") > 0) & (F.col("rank_words") + F.col("size") / 2 <= rest)
    copies = F.when(F.col("size") > 0, whole + more.cast("long")).otherwise(F.lit(0)).cast("long")
    middle = (F.col("rank_words") + F.col("size") / 2) / F.greatest("target", F.lit(1.0))
    out = placed.withColumn("copies", copies).withColumn("taken", F.col("copies") * F.col("size"))
    return out.withColumn("position", F.when(F.col("copies") > 0, position(middle, F.col("ramp")))).select(
        "doc_id", *keep, "size", "source_size", "target", "copies", "taken", "rank_words", "ramp", "position"
    )


def copies(mixed: DataFrame) -> DataFrame:
    """One row per copy, numbered from 0, with its own training position."""
    copy = mixed.withColumn("copy", F.explode(F.when(F.col("copies") > 0, F.sequence(F.lit(0), (F.col("copies") - 1).cast("int")))))
    middle = (F.col("copy") * F.col("source_size") + F.col("rank_words") + F.col("size") / 2) / F.greatest("target", F.lit(1.0))
    return copy.withColumn("position", position(middle, F.col("ramp")))


def training_order(mixed: DataFrame, partitions: int | None = None) -> DataFrame:
    """One row per copy, range-sorted by training position: what a trainer reads in order."""
    return by_position(copies(mixed), partitions)


def by_position(df: DataFrame, partitions: int | None = None) -> DataFrame:
    """Range-sorted by position, untaken documents last."""
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("position").asc_nulls_last(), F.col("doc_id")]
    return df.repartitionByRange(n, *order).sortWithinPartitions(*order)
