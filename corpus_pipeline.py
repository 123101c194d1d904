"""A training corpus from raw documents, in five stages.

Toxic documents go, one document of each near-duplicate group stays, personal
data is replaced by its kind, sources are repeated or thinned to their target
weights, and what is left is packed into sequences. Every stage is written as
Parquet to the shared folder and read back, so a lost executor costs a stage
at most.

Nulls: a null text is an empty document for every stage (scored by the bias,
never a near-duplicate, nothing to redact, size 0 and so not drawn by the mix).
Rows are told apart by a key of their own, not by doc_id: a repeated or missing id
neither drops a text nor hides a copy. Repeated rows are near-duplicates of each other
unless they are empty. Very long texts are read whole. An empty table passes every stage.
Columns beyond those of documents, whatever their names, are carried to the mix and end
at packing.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import mixing, neardup, packing, pii, toxicity
from vectide.llm.tables import discard, documents, keyed, remainder, small_batches, stored
from vectide.llm.text import pieces, tidy

TOXIC = 0.7
SHINGLE, PERCENT = 5, 80


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored below TOXIC; the model learns from the labelled rows outside the held-out third."""
    small_batches(spark)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(remainder(F.col("doc_id"), 3) != 1)
    return toxicity.accepted(docs, toxicity.train(docs, labels), TOXIC)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group the document with the least doc_id (a missing one last); of rows that share it, the first as stored."""
    rows, key = keyed(docs)
    found = neardup.near_duplicates(rows.select(F.col(key).alias("doc_id"), "text"), SHINGLE, PERCENT)
    found = found.select(F.col("doc_id").alias("row"), F.col("component_id").alias("component")).join(rows.select(F.col(key).alias("row"), "doc_id"), "row")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col("row").alias("row")))
    kept = found.groupBy("component").agg(least.alias("least")).select(F.col("least.row").alias(key))
    return rows.join(kept, key, "left_semi").select(docs.columns)


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with every span of personal data replaced by its kind; n_chars follows."""
    names = docs.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=1 << 20):
            columns = dict(zip(names, piece.columns, strict=True))
            texts = columns["text"].to_pylist()
            _, spans = pii.find(columns["text"])
            clean = [pii.redact(t, s) if s else t for t, s in zip(texts, spans, strict=True)]
            columns["text"] = pa.array(clean, pa.string())
            if "n_chars" in columns:
                n = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([len(t) if s else old for t, s, old in zip(clean, spans, n, strict=True)], piece.schema.field("n_chars").type)
            yield pa.RecordBatch.from_arrays([columns[c] for c in names], names)

    return docs.mapInArrow(tidy(run), docs.schema)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it, in no particular order (mixing.training_order sorts copies)."""
    rows, key = keyed(docs)
    mixed = mixing.mix_sources(rows.select("doc_id", "source", "text", key), keep=(key,))
    drawn = mixed.where("copies > 0").select(key, F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias(f"{key}_copy"))
    return rows.join(drawn, key).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their place in a sequence. Workers that other stages use too forget the words."""
    return packing.pack(docs, keep_words=False)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("minhash", drop_near_duplicates),
    ("pii", redact),
    ("mixing", mix),
    ("packing", pack),
]
#: No SQL for learned models, MinHash and tokenizers: tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the table ``documents``."""
    docs, last = documents(spark, sf_dir), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stored(docs)
            if last is not None:
                discard(last)
            last = docs
    return docs
