"""The registered query of each operator: op<N>_<name>(spark, sf_dir) over the whole table."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.llm import language, media, mixing, mixture, neardup, packing, pii, spots, substrings, toxicity
from vectide.llm.tables import documents, remainder
from vectide.llm.text import pieces

TOXIC = 0.7


def op1_jpeg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.digest(media.store(documents(spark, sf_dir)))


def op2_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(documents(spark, sf_dir))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder(F.col("doc_id"), 3) == 1
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(~held)
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC).cast("int").alias("predicted"))


def op4_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(documents(spark, sf_dir), size_words=2, percent=80)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=1 << 20):
            base, spans = pii.find(piece.column(1))
            count = {k: [sum(s[0] == k for s in x) for x in base] for k in pii.KINDS}
            sha = [hashlib.sha256(pii.show(x).encode()).hexdigest() for x in base]
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), *(pa.array(count[k], pa.int64()) for k in pii.KINDS), pa.array(sha), pa.array([pii.show(x) for x in spans])],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    schema = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(documents(spark, sf_dir))


def op7_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    held = remainder(F.col("doc_id"), 5) == 0
    found = language.predict(docs, language.profiles(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op8_spots(spark: SparkSession, sf_dir: str) -> DataFrame:
    def run(ids: tuple, texts: tuple, successors: tuple) -> pa.RecordBatch:
        own, after = [t or "" for t in texts], [t or "" for t in successors]
        half = [len(t) // 2 for t in own]
        edited = [t[: len(t) - h] + s[:h] for t, s, h in zip(own, after, half, strict=True)]
        a, b, c = (spots.fingerprints(pa.array(x, pa.string())) for x in (own, edited, after))
        return pa.RecordBatch.from_arrays(
            [
                pa.array(ids, pa.int64()),
                pa.array([len(t) for t in own], pa.int64()),
                pa.array([hashlib.sha256(t.encode()).hexdigest() for t in edited]),
                pa.array(map(spots.encode, a), pa.string()),
                pa.array(map(spots.encode, b), pa.string()),
                pa.array([spots.jaccard(x, y) for x, y in zip(a, b, strict=True)]),
                pa.array([spots.jaccard(x, y) for x, y in zip(a, c, strict=True)]),
            ],
            ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return spots.with_successors(documents(spark, sf_dir), run, schema)


def op9_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return mixture.score(docs, mixture.train(docs))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(documents(spark, sf_dir))
    return mixing.by_position(mixed.select("doc_id", "size", "source_size", "target", "taken", "copies", "position"))
