"""Registered queries over file formats, stored vectors, graphs and streams, with their SQL.

The formats' queries pack the test tables into the bytes of files and read those. Queries on
graphs, whose shape no SQL gives, say of each query vector whether the search found enough.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import vectors as V
from vectide.operators import flatten, graph, knn, quantize
from vectide.plans.queries import CHUNKS, DIM, K, codebook, query, query_vectors, table, vectors
from vectide.sources import binary, text
from vectide.sources.folders import shared_folder
from vectide.types import Metric, chunk_offsets

ROWS = "CAST(len(embedding) AS BIGINT) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 4) AS total, embedding[1] AS first"


def shown(rows: DataFrame) -> DataFrame:
    """dims, total and first of each vector."""
    return rows.select(F.size("embedding").cast("long").alias("dims"), F.round(V.fold(V.doubles(F.col("embedding"))), 4).alias("total"), F.col("embedding")[0].alias("first"))


@query("fvecs_read", f"SELECT {ROWS} FROM embeddings")
def fvecs_read(spark, sf_dir):
    return shown(binary.parse_fvecs(binary.as_files(vectors(spark, sf_dir), binary.packed_vecs)))


@query("matrix_read", f"SELECT {ROWS} FROM embeddings")
def matrix_read(spark, sf_dir):
    return shown(binary.parse_matrix(binary.as_files(vectors(spark, sf_dir), lambda x: b"head" + binary.packed_matrix(x)), "f32", 4))


@query("ivecs_read", "SELECT CAST(place AS INTEGER) AS place, CAST([vec_id, label, vec_id % 7][place + 1] AS INTEGER) AS id FROM embeddings, (SELECT unnest(range(0, 2)) AS place)")
def ivecs_read(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.array("eid", "label", F.col("eid") % 7).alias("embedding"))
    return binary.parse_ivecs(binary.as_files(rows, binary.packed_vecs, "i4"), 2).select("place", "id")


@query("codes_read", "SELECT CAST(1 + vec_id % 255 AS BIGINT) AS a, CAST(label AS BIGINT) AS b FROM embeddings")
def codes_read(spark, sf_dir):
    rows = vectors(spark, sf_dir).select(F.array(1 + F.col("eid") % 255, "label").alias("embedding"))
    return binary.parse_matrix(binary.as_files(rows, binary.packed_matrix, "u4"), "u32").select(F.col("embedding")[0].alias("a"), F.col("embedding")[1].alias("b"))


PIVOTS = "SELECT CAST(c AS INTEGER) AS chunk, CAST(vec_id AS INTEGER) AS center, round(list_sum(CAST(embedding[c * 8 + 1 : c * 8 + 8] AS DOUBLE[])), 4) AS total FROM embeddings, (SELECT unnest(range(0, 8)) AS c) WHERE vec_id < 16"


@query("pivots_read", PIVOTS)
def pivots_read(spark, sf_dir):
    rows = codebook(spark, sf_dir).groupBy("center").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "pivot"))), lambda x: x["pivot"])).alias("embedding"))
    at = chunk_offsets(DIM, CHUNKS)

    def pack(x: np.ndarray) -> bytes:
        return binary.packed_pivots(x, np.zeros(DIM, np.float32), np.array(at))

    # the 16 rows of the codebook, in order, are one file
    whole = rows.repartition(1).sortWithinPartitions("center")
    found = binary.parse_pivots(binary.as_files(whole, pack))
    return found.select("chunk", "center", F.round(V.fold(V.doubles(F.col("pivot"))), 4).alias("total"))


@query("tsv_read", f"SELECT CAST(vec_id AS VARCHAR) AS path, {ROWS} FROM embeddings WHERE vec_id % 5 <> 2")
def tsv_read(spark, sf_dir):
    bad = F.when(F.col("eid") % 5 == 2, F.lit("not a vector")).otherwise(F.to_json("embedding"))
    lines = vectors(spark, sf_dir).select(F.concat_ws("\t", F.col("eid").cast("string"), bad).alias("value"))
    found = text.parse_tsv_vectors(lines)
    return found.select("path", F.size("embedding").cast("long").alias("dims"), F.round(V.fold(V.doubles(F.col("embedding"))), 4).alias("total"), F.col("embedding")[0].alias("first"))


@query("pair_labels_read", "SELECT item_id AS line, CAST(item_id AS VARCHAR) AS a, text AS b, CAST(1 - item_id % 3 AS INTEGER) AS label FROM benchmark WHERE item_id % 3 < 2")
def pair_labels_read(spark, sf_dir):
    name = F.element_at(F.array(F.lit("entailment"), F.lit("contradiction"), F.lit("neutral")), (F.col("item_id") % 3 + 1).cast("int"))
    lines = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("line"), F.concat_ws("\t", name, *(F.lit(x) for x in "1234"), F.col("item_id").cast("string"), "text").alias("value"))
    return text.parse_pair_labels(lines)


@query("documents_exploded", """WITH r AS (SELECT CAST(vec_id AS VARCHAR) AS request, label FROM embeddings)
    SELECT request, 0::BIGINT AS place, 'd' || request AS doc_id FROM r
    UNION ALL SELECT request, 1::BIGINT, upper(substr(md5(request || chr(31) || '1'), 1, 16)) FROM r""")
def documents_exploded(spark, sf_dir):
    eid = F.col("eid").cast("string")
    body = F.concat(F.lit('[{"_id": "d'), eid, F.lit('"}, {"label": '), F.col("label").cast("string"), F.lit("}]"))
    return flatten.exploded(vectors(spark, sf_dir).select(eid.alias("batch"), body.alias("body"))).select("request", "place", "doc_id")


SHORT = "CAST(embedding[1:50] AS DOUBLE[])"


@query("prepared_vectors", f"""WITH s AS (SELECT vec_id, {SHORT} AS v, list_sum(list_transform({SHORT}, lambda x: x * x)) AS n2 FROM embeddings)
    SELECT vec_id AS eid, 64::BIGINT AS dims, round(list_sum(v) / sqrt(n2), 6) AS total, round(v[50] / sqrt(n2), 6) AS last, 0.0::DOUBLE AS filled FROM s""")
def prepared_vectors(spark, sf_dir):
    p = V.prepared(F.slice("embedding", 1, 50), Metric.COSINE, 50)
    rows = vectors(spark, sf_dir).select("eid", p.alias("p"))
    return rows.select("eid", F.size("p").cast("long").alias("dims"), F.round(V.fold(F.col("p")), 6).alias("total"), F.round(F.col("p")[49], 6).alias("last"), V.fold(F.slice("p", 51, 14)).alias("filled"))


# ---- graphs


def enough(found: DataFrame, truth: DataFrame, least: float) -> DataFrame:
    """qid, and whether at least this share of its K true neighbours was found."""
    return knn.recall(found.withColumn("eid", F.col("eid").cast("long")), truth, K).select("qid", (F.col("recall") >= least).alias("enough"))


ALL_ENOUGH = "SELECT vec_id AS qid, true AS enough FROM embeddings WHERE vec_id % 100 = 0"


@query("graph_recall", ALL_ENOUGH)
def graph_recall(spark, sf_dir):
    """Every query vector finds nine of its ten nearest."""
    v, q = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    return enough(graph.search(graph.build(v), q, K), knn.nearest_batch(v, q, K), 0.9)


@query("graph_recall_deleted", ALL_ENOUGH)
def graph_recall_deleted(spark, sf_dir):
    """The same among the vectors left, with a third deleted but still walked through."""
    v, q = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    gone, left = v.where("eid % 3 = 1").select("eid"), v.where("eid % 3 <> 1")
    return enough(graph.search(graph.build(v), q, K, deleted=gone), knn.nearest_batch(left, q, K), 0.9)


@query("graph_recall_consolidated", ALL_ENOUGH)
def graph_recall_consolidated(spark, sf_dir):
    """The same in the graph without the deleted third, repaired."""
    v, q = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    gone, left = v.where("eid % 3 = 1").select("eid"), v.where("eid % 3 <> 1")
    return enough(graph.search(graph.consolidate(graph.build(v), gone), q, K), knn.nearest_batch(left, q, K), 0.9)


@query("graph_recall_guided", ALL_ENOUGH)
def graph_recall_guided(spark, sf_dir):
    """The same with a walk guided by a product quantizer's codes."""
    v, q = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    book = quantize.train_product(v.select("eid", "embedding"), DIM, CHUNKS)
    return enough(graph.search(graph.build(v), q, K, codebook=book), knn.nearest_batch(v, q, K), 0.8)


@query("graph_edges", "SELECT vec_id AS eid, true AS linked, true AS within FROM embeddings")
def graph_edges(spark, sf_dir):
    """Every vector has neighbours, all of them in its shard, and no more than the slack allows."""
    built = graph.build(vectors(spark, sf_dir), shards=3)
    n = built.groupBy("shard").agg(F.count(F.lit(1)).alias("n"))
    fits = (F.size("nbrs") <= int(1.3 * 64)) & F.forall("nbrs", lambda x: (x >= 0) & (x < F.col("n"))) & ~F.array_contains("nbrs", F.col("vid")) & (F.size("nbrs") == F.size(F.array_distinct("nbrs")))
    return built.join(n, "shard").select(F.col("eid").cast("long").alias("eid"), (F.size("nbrs") > 0).alias("linked"), fits.alias("within"))


# ---- streams


@query("stream_latest", """WITH e AS (SELECT user_id, event_id, event_type FROM events)
    SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type, count(*) AS events FROM e GROUP BY user_id""")
def stream_latest(spark, sf_dir):
    """The last event of each user, from a stream that is written batch by batch and then read as a log."""
    folder = shared_folder(spark)
    name = f"{folder}/stream-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    stream = spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(f"{sf_dir}/events.parquet*").select("user_id", "event_id", "event_type")
    stream.writeStream.format("parquet").option("path", name).option("checkpointLocation", f"{name}-state").trigger(availableNow=True).start().awaitTermination()
    log = spark.read.schema("user_id long, event_id long, event_type string").parquet(name)
    last = Window.partitionBy("user_id").orderBy(F.desc("event_id"))
    rows = log.withColumns({"n": F.row_number().over(last), "events": F.count(F.lit(1)).over(Window.partitionBy("user_id"))})
    return rows.where("n = 1").select("user_id", "event_id", "event_type", "events")
