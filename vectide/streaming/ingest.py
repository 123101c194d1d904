"""Continuous ingest: a stream of requests appended to an engine's logs, and periodic compaction."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from vectide.operators import flatten
from vectide.operators.store import Engine

REQUESTS = "batch string, op string, body string, seq long"


def requests(spark: SparkSession, folder: str, files_per_trigger: int = 16) -> DataFrame:
    """A stream of JSON-lines files: op ``put`` with documents as body, or ``del`` with a doc id; seq orders them."""
    return spark.readStream.schema(REQUESTS).option("maxFilesPerTrigger", files_per_trigger).json(folder)


def apply(engine: Engine, collection: str, rows: DataFrame) -> None:
    """One batch, as one write: of all requests for a document the last counts, put or deletion.

    Requests are ordered by seq; among equal ones (or without) by batch, then as documents lie in
    the body, and a deletion comes before what is put.
    """
    seq = F.col("seq") if "seq" in rows.columns else F.lit(None).cast("long")
    rows = rows.withColumn("request", F.to_json(F.struct(seq.alias("seq"), F.col("batch").alias("batch"))))
    parsed = F.from_json("request", "seq long, batch string")
    puts = flatten.exploded(rows.where("op = 'put'"), "request").select("doc_id", "doc", F.lit("put").alias("op"), parsed.alias("at"), "place")
    dels = rows.where("op = 'del'").select(F.col("body").alias("doc_id"), F.lit(None).cast("string").alias("doc"), "op", parsed.alias("at"), F.lit(-1).cast("long").alias("place"))
    newest = Window.partitionBy("doc_id").orderBy(F.desc("at.seq"), F.desc("op"), F.desc("at.batch"), F.desc("place"))
    last = puts.union(dels).withColumn("newest", F.row_number().over(newest)).where("newest = 1").select("doc_id", "doc", "op")
    engine.write(collection, last)


def start(engine: Engine, collection: str, stream: DataFrame, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Apply every micro-batch to a collection; its rows are visible to the next search."""
    writer = stream.writeStream.foreachBatch(lambda rows, _: apply(engine, collection, rows)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
