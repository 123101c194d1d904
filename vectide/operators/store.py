"""Append-only logs of documents and vectors, and the catalog of collections.

A write appends rows under a name of its own to all logs that it concerns and is then
committed: a file named by the next sequence number, which only one writer can create, takes
the write's name. Rows of a write that was never committed are not seen, so a failed write
leaves nothing half done, and two writers get different numbers. The live view is the last row
per key, by sequence number and then by step within the write, without deletions. Compaction
rewrites a log to its live view.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import flatten as J
from vectide.operators import knn
from vectide.types import CollectionSettings, Metric, ModelClass, checked_limit

VECTOR_KEY = ("collection", "field", "eid")


def latest(log: DataFrame, keys: Sequence[str], order: str = "seq") -> DataFrame:
    """The last row of each key, by sequence number and step (if there is one); among equal ones, deletions last."""
    newest = Window.partitionBy(*keys).orderBy(F.desc(order), *[F.desc("step")] * ("step" in log.columns), F.asc("op"))
    return log.withColumn("newest", F.row_number().over(newest)).where("newest = 1").drop("newest")


def live(log: DataFrame, keys: Sequence[str] = VECTOR_KEY) -> DataFrame:
    return latest(log, keys).where("op <> 'del'")


def without(rows: DataFrame, deleted: DataFrame, key: str = "eid") -> DataFrame:
    """Rows whose key is not among the deleted ones; unknown keys are ignored."""
    return rows.join(deleted.select(key).distinct(), key, "left_anti")


def segments(rows: DataFrame, per_segment: int) -> DataFrame:
    """segment and its number of rows, for rows with a dense ``vid``."""
    return rows.groupBy(F.floor(F.col("vid") / per_segment).alias("segment")).agg(F.count(F.lit(1)).alias("n"))


LOGS = {
    "collections": ("collection string, settings string", ()),
    "documents": ("doc_id string, doc string", ("collection",)),
    "vectors": ("eid string, doc_id string, embedding array<float>", ("collection", "field")),
}
#: in a write, what goes before and what comes after
OLD, NEW = 0, 1


class Engine:
    """Collections under a folder: create, index, search, delete, list, drop.

    ``encode`` turns (text) rows into embeddings; see ``operators.embed``.
    """

    def __init__(self, spark: SparkSession, folder: str, encode=None):
        self.spark, self.folder, self.encode = spark, folder.rstrip("/"), encode

    # -- logs

    def _place(self, *names: str):
        place = self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))
        return place, place.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _commit(self, write: str) -> int:
        """Give a write the next sequence number. Creating the number's file fails for all writers but one."""
        folder, fs = self._place("commits")
        fs.mkdirs(folder)
        seq = max([int(f.getPath().getName()) for f in fs.listStatus(folder) if f.getPath().getName().isdigit()], default=0) + 1
        while True:
            place, fs = self._place("commits", str(seq))
            try:
                out = fs.create(place, False)
            except Exception:
                if not fs.exists(place):
                    raise
                seq += 1
                continue
            out.write(bytearray(write.encode()))
            out.close()
            return seq

    def _commits(self) -> DataFrame:
        """(write, seq) of all committed writes."""
        place, fs = self._place("commits")
        if not fs.exists(place):
            return self.spark.createDataFrame([], "write string, seq long")
        named = self.spark.read.text(f"{self.folder}/commits", wholetext=True).select(F.col("value").alias("write"), F.col("_metadata.file_name").cast("long").alias("seq"))
        return named.where("seq IS NOT NULL")

    def _read(self, table: str, collection: str | None = None) -> DataFrame:
        """A log's committed rows, of one collection if it is given, with their sequence numbers."""
        fields, parts = LOGS[table]
        schema = ", ".join([fields, "write string, step int, op string", *(f"{p} string" for p in parts)])
        place, fs = self._place(table)
        if not fs.exists(place):
            return self.spark.createDataFrame([], f"{schema}, seq long")
        log = self.spark.read.schema(schema).parquet(f"{self.folder}/{table}")
        if collection is not None:
            log = log.where(F.col("collection") == collection)
        return log.join(self._commits(), "write")

    def _append(self, table: str, rows: DataFrame, write: str, op: str, step: int, **parts: str) -> None:
        columns = [c.split()[0] for c in LOGS[table][0].split(", ")]
        for name, value in parts.items():
            rows = rows.withColumn(name, F.lit(value))
        rows = rows.select(*columns, F.lit(write).alias("write"), F.lit(step).alias("step"), F.lit(op).alias("op"), *LOGS[table][1])
        out = rows.write.mode("append")
        (out.partitionBy(*LOGS[table][1]) if LOGS[table][1] else out).parquet(f"{self.folder}/{table}")

    # -- catalog

    def collections(self) -> DataFrame:
        return live(self._read("collections"), ["collection"]).select("collection", "settings")

    def settings(self, name: str) -> CollectionSettings:
        row = self.collections().where(F.col("collection") == name).first()
        if row is None:
            raise KeyError(f"no collection {name!r}")
        raw = json.loads(row["settings"])
        return CollectionSettings(**raw | {"metric": Metric(raw["metric"]), "model_class": ModelClass(raw["model_class"]), "fields": tuple(raw["fields"])})

    def create(self, settings: CollectionSettings) -> None:
        if self.collections().where(F.col("collection") == settings.name).first() is not None:
            raise ValueError(f"collection {settings.name!r} exists")
        write = uuid.uuid4().hex
        self._append("collections", self.spark.createDataFrame([(settings.name, json.dumps(asdict(settings)))], LOGS["collections"][0]), write, "put", NEW)
        self._commit(write)

    def drop(self, name: str) -> None:
        """Forget a collection and its rows; an unknown one is no error."""
        if self.collections().where(F.col("collection") == name).first() is None:
            return
        write = uuid.uuid4().hex
        self._forget(name, self.documents(name).select("doc_id"), write)
        self._append("collections", self.spark.createDataFrame([(name, None)], LOGS["collections"][0]), write, "del", NEW)
        self._commit(write)

    # -- rows

    def documents(self, name: str) -> DataFrame:
        return live(self._read("documents", name), ["doc_id"]).select("doc_id", "doc")

    def vectors(self, name: str) -> DataFrame:
        return live(self._read("vectors", name), ["field", "eid"]).select("field", "eid", "doc_id", "embedding")

    def _forget(self, name: str, ids: DataFrame, write: str) -> None:
        """Deletions of documents (doc_id) and of all their elements, before whatever else the write does."""
        dead = self.documents(name).join(ids, "doc_id", "left_semi").select("doc_id", F.lit(None).cast("string").alias("doc"))
        self._append("documents", dead, write, "del", OLD, collection=name)
        gone = self.vectors(name).join(ids, "doc_id", "left_semi").select("field", "eid", "doc_id", F.lit(None).cast("array<float>").alias("embedding"))
        self._append("vectors", gone, write, "del", OLD, collection=name)

    def index(self, name: str, requests: DataFrame) -> None:
        """Flatten, encode and append the documents of (batch, body) requests.

        A document written again replaces all its elements, also those it no longer has;
        of several with one id in a call, the last of the last request stays.
        """
        newest = Window.partitionBy("doc_id").orderBy(F.desc("request"), F.desc("place"))
        docs = J.exploded(requests).withColumn("newest", F.row_number().over(newest)).where("newest = 1")
        self.write(name, docs.select("doc_id", "doc", F.lit("put").alias("op")))

    def write(self, name: str, rows: DataFrame) -> None:
        """One write of (doc_id, doc, op): documents that are put, with their elements, and ids that go ("del").

        A doc_id comes once. A batch that cannot be encoded, or a vector whose dimension is not the
        collection's, fails the write, and nothing of it is seen.
        """
        settings = self.settings(name)
        write = uuid.uuid4().hex
        # written first, so that the documents are parsed and ids made up once
        self._append("documents", rows.where("op = 'put'"), write, "put", NEW, collection=name)
        stored = self.spark.read.schema(f"{LOGS['documents'][0]}, write string, collection string").parquet(f"{self.folder}/documents").where((F.col("collection") == name) & (F.col("write") == write))
        self._forget(name, stored.select("doc_id").union(rows.where("op = 'del'").select("doc_id")), write)
        elements = J.with_element_ids(J.embeddable(J.flatten(stored.select("doc_id", "doc"))))
        elements = elements.where(F.assert_true(F.octet_length("eid") <= 16, F.lit("element id longer than 16 bytes")).isNull())
        encoded = self.encode(elements)
        if "err_message" in encoded.columns:
            encoded = encoded.where(F.assert_true(F.col("err_message").isNull(), F.concat(F.lit("not encoded: "), "err_message")).isNull())
        ready = encoded.select("field", "eid", "doc_id", V.prepared(F.col("embedding"), settings.metric, settings.dim).cast("array<float>").alias("embedding"))
        self._append("vectors", ready, write, "put", NEW, collection=name)
        self._commit(write)

    def delete(self, name: str, doc_ids: Sequence[str]) -> None:
        """Hide documents and all their elements at once; unknown ids are ignored."""
        write = uuid.uuid4().hex
        self._forget(name, self.spark.createDataFrame([(i,) for i in doc_ids], "doc_id string"), write)
        self._commit(write)

    def search(self, name: str, queries: DataFrame, attributes: Sequence[str] = (), weights: dict[str, float] | None = None, limit: int = 10, documents: bool = True) -> DataFrame:
        """qid, place, eid, doc_id, score (and doc) of queries (qid, embedding) or (qid, text)."""
        checked_limit(limit)
        settings = self.settings(name)
        if "embedding" not in queries.columns:
            queries = self.encode(queries.withColumnRenamed("text", "value"))
        queries = queries.where("embedding IS NOT NULL").withColumn("embedding", V.prepared(F.col("embedding"), settings.metric, settings.dim).cast("array<float>"))
        vectors = self.vectors(name)
        known = [r["field"] for r in vectors.select("field").distinct().collect()] if attributes else None
        hits = knn.search(vectors, queries, attributes, weights or {}, limit, settings.metric, known)
        hits = hits.withColumn("doc_id", F.split_part("eid", F.lit(":"), F.lit(1)))
        return knn.with_documents(hits, self.documents(name)) if documents else hits

    def compact(self, name: str, to: str) -> None:
        """Write the live rows of a collection as logs under another folder, where it must be new or of the same metric and geometry."""
        settings, target = self.settings(name), Engine(self.spark, to, self.encode)
        try:
            there = target.settings(name)
            if (there.metric, there.dim) != (settings.metric, settings.dim):
                raise ValueError(f"collection {name!r} is {there.metric.value} in {there.dim} dimensions there, {settings.metric.value} in {settings.dim} here")
        except KeyError:
            target.create(settings)
        write = uuid.uuid4().hex
        target._append("documents", self.documents(name), write, "put", NEW, collection=name)
        target._append("vectors", self.vectors(name), write, "put", NEW, collection=name)
        target._commit(write)

    def opened(self, name: str, metric: Metric, dim: int) -> DataFrame:
        """The live vectors of a stored collection, which must be of this metric and dimension."""
        settings = self.settings(name)
        if (settings.metric, settings.dim) != (metric, dim):
            raise ValueError(f"collection {name!r} is {settings.metric.value} in {settings.dim} dimensions, not {metric.value} in {dim}")
        return self.vectors(name)
