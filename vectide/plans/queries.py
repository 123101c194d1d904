"""The registered queries of the vector engine, each beside its DuckDB equivalent.

All run over whole tables. Batch searches take as queries every vector whose id
is divisible by 100. Fields, documents and adjacency are derived from the
tables by rules that SQL can state as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vectide.functions import strings as S
from vectide.functions import vectors as V
from vectide.operators import embed, flatten, graph, knn, pairs, quantize, store
from vectide.plans import models
from vectide.types import GraphParams, Metric, chunk_offsets, rows_per_segment

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
K, DIM, CHUNKS, CODEBOOK = 10, 64, 8, 16


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """eid, embedding, label, field."""
    field = F.element_at(F.array(F.lit("title"), F.lit("paragraph"), F.lit("body")), (F.pmod("label", F.lit(3)) + 1).cast("int"))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("eid"), "embedding", "label", field.alias("field"))


def query_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vectors(spark, sf_dir).where("eid % 100 = 0").select(F.col("eid").alias("qid"), "embedding")


def first_vector(spark: SparkSession, sf_dir: str) -> list[float]:
    row = table(spark, sf_dir, "embeddings").where("vec_id = 0").select("embedding").first()
    return list(row[0]) if row else [0.0] * DIM


# SQL pieces
VEC = "vecs AS (SELECT vec_id AS eid, embedding, label, ['title', 'paragraph', 'body'][label % 3 + 1] AS field FROM embeddings)"
QRY = "qs AS (SELECT vec_id AS qid, embedding FROM embeddings WHERE vec_id % 100 = 0)"
UNIT = "vecs AS (SELECT eid0 AS eid, CASE WHEN n2 < 1.1920929e-7 THEN v ELSE list_transform(v, lambda x: x / sqrt(n2)) END AS embedding FROM (SELECT vec_id AS eid0, CAST(embedding AS DOUBLE[]) AS v, list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)) AS n2 FROM (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings)))"


def sql_pair(expression: str, a: str, b: str) -> str:
    """list_sum over pairs p[1], p[2] of two arrays."""
    return f"list_sum(list_transform(list_zip(CAST({a} AS DOUBLE[]), CAST({b} AS DOUBLE[])), lambda p: {expression}))"


L2 = "(p[1] - p[2]) * (p[1] - p[2])"
L1 = "abs(p[1] - p[2])"
DOT = "p[1] * p[2]"


# ---- scans and logs


@query("scan_documents", "SELECT doc_id, lang, source, n_chars, md5(text) AS digest FROM documents")
def scan_documents(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars", F.md5(F.col("text").cast("binary")).alias("digest"))


@query("scan_vectors", f"WITH {VEC} SELECT field, count(*) AS n, CAST(sum(len(embedding)) AS BIGINT) AS components FROM vecs GROUP BY field")
def scan_vectors(spark, sf_dir):
    return vectors(spark, sf_dir).groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("embedding")).alias("components"))


CONVERSATIONS = """convs AS (
  SELECT 'c' || conv_id AS doc_id, count(*) AS turns,
         list({'role': role, 'text': text} ORDER BY turn) AS said
  FROM conversations GROUP BY conv_id)"""


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One nested JSON document per conversation."""
    turns = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("said"), F.count(F.lit(1)).alias("n"))
    said = F.transform("said", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    name = F.concat(F.lit("c"), "conv_id")
    return turns.select(name.alias("batch"), F.to_json(F.struct(name.alias("_id"), F.struct(F.col("n").alias("turns")).alias("meta"), said.alias("said"))).alias("body"))


FLAT = f"""WITH {CONVERSATIONS}, rows AS (
  SELECT doc_id, '_id' AS field, 0 AS idx, 1 AS n, 'string' AS kind, doc_id AS value FROM convs
  UNION ALL SELECT doc_id, 'meta.turns', 0, 1, 'number', CAST(turns AS VARCHAR) FROM convs
  UNION ALL SELECT doc_id, 'said.role', i - 1, turns, 'string', said[i].role FROM (SELECT *, unnest(range(1, turns + 1)) AS i FROM convs)
  UNION ALL SELECT doc_id, 'said.text', i - 1, turns, 'string', said[i].text FROM (SELECT *, unnest(range(1, turns + 1)) AS i FROM convs)
), strings AS (SELECT * FROM rows WHERE field <> '_id' AND kind = 'string'),
elements AS (SELECT *, CASE WHEN n = 1 THEN doc_id ELSE doc_id || ':' || idx END AS eid FROM strings)
"""


@query("scan_json_docs", f"WITH {CONVERSATIONS} SELECT doc_id FROM convs")
def scan_json_docs(spark, sf_dir):
    return flatten.exploded(conversation_requests(spark, sf_dir)).select("doc_id")


@query("json_flatten", FLAT + "SELECT doc_id, field, CAST(idx AS BIGINT) AS idx, CAST(n AS BIGINT) AS n, kind, value FROM rows")
def json_flatten(spark, sf_dir):
    return flatten.flatten(flatten.exploded(conversation_requests(spark, sf_dir)))


@query("json_flatten_props", "SELECT CAST(event_id AS VARCHAR) AS doc_id, 'k' AS field, CAST(0 AS BIGINT) AS idx, CAST(1 AS BIGINT) AS n, 'number' AS kind, CAST(json_extract(props, '$.k') AS VARCHAR) AS value FROM events WHERE props IS NOT NULL")
def json_flatten_props(spark, sf_dir):
    return flatten.flatten(table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.col("props").alias("doc")))


@query("embeddable_fields", FLAT + "SELECT field, count(*) AS n, CAST(sum(idx) AS BIGINT) AS positions FROM strings GROUP BY field")
def embeddable_fields(spark, sf_dir):
    rows = flatten.embeddable(json_flatten(spark, sf_dir))
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("n"), F.sum("idx").alias("positions"))


@query("element_ids", FLAT + "SELECT field, eid FROM elements")
def element_ids(spark, sf_dir):
    return flatten.with_element_ids(flatten.embeddable(json_flatten(spark, sf_dir))).select("field", "eid")


@query("hit_doc_id", FLAT + "SELECT eid, split_part(eid, ':', 1) AS doc FROM elements")
def hit_doc_id(spark, sf_dir):
    return element_ids(spark, sf_dir).select("eid", S.document_id(F.col("eid")).alias("doc"))


@query("embed_batches", FLAT + "SELECT field, count(*) AS texts, CAST(sum(length(value)) AS BIGINT) AS chars FROM elements GROUP BY field")
def embed_batches(spark, sf_dir):
    rows = embed.batches(flatten.embeddable(json_flatten(spark, sf_dir)))
    return rows.select("field", "texts", "chars")


@query("generated_ids", "SELECT page_id, upper(substr(md5(url || chr(31) || CAST(page_id AS VARCHAR)), 1, 16)) AS id FROM pages")
def generated_ids(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.generated_id(F.col("url"), F.col("page_id").cast("string")).alias("id"))


LOG = """log AS (
  SELECT vec_id % 150 AS key, vec_id AS seq, CASE WHEN vec_id % 7 = 3 THEN 'del' ELSE 'put' END AS op, label FROM embeddings
), last AS (SELECT * FROM log QUALIFY row_number() OVER (PARTITION BY key ORDER BY seq DESC) = 1)"""


def vector_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    op = F.when(F.col("vec_id") % 7 == 3, "del").otherwise("put")
    return table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 150).alias("key"), F.col("vec_id").alias("seq"), op.alias("op"), "label")


@query("upsert_latest", f"WITH {LOG} SELECT key, seq, op, label FROM last")
def upsert_latest(spark, sf_dir):
    return store.latest(vector_log(spark, sf_dir), ["key"])


@query("vector_upsert", f"WITH {LOG} SELECT key, seq, label FROM last WHERE op = 'put'")
def vector_upsert(spark, sf_dir):
    return store.live(vector_log(spark, sf_dir), ["key"]).select("key", "seq", "label")


@query("doc_upsert", "SELECT source AS key, max(doc_id) AS seq, arg_max(n_chars, doc_id) AS n_chars FROM documents GROUP BY source")
def doc_upsert(spark, sf_dir):
    log = table(spark, sf_dir, "documents").select(F.col("source").alias("key"), F.col("doc_id").alias("seq"), F.lit("put").alias("op"), "n_chars")
    return store.live(log, ["key"]).select("key", "seq", "n_chars")


@query("catalog_list", f"WITH {VEC} SELECT field AS collection, 'l2' AS metric, CAST(64 AS INTEGER) AS dim, count(*) AS n FROM vecs GROUP BY field")
def catalog_list(spark, sf_dir):
    rows = vectors(spark, sf_dir).groupBy(F.col("field").alias("collection")).agg(F.max(F.size("embedding")).alias("dim"), F.count(F.lit(1)).alias("n"))
    return rows.select("collection", F.lit(Metric.L2.value).alias("metric"), "dim", "n")


@query("segment_sizes", "SELECT vec_id // 1000 AS segment, count(*) AS n FROM embeddings GROUP BY 1")
def segment_sizes(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"))
    return store.segments(rows, rows_per_segment(256, DIM, kilobyte=1000))


@query("anti_join_deletes", "SELECT vec_id AS eid FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)")
def anti_join_deletes(spark, sf_dir):
    gone = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("eid"))
    return store.without(vectors(spark, sf_dir).select("eid"), gone)


# ---- scalar functions


@query("md5_check", "SELECT page_id, md5(html) AS digest, md5(html) = md5(url) AS same FROM pages")
def md5_check(spark, sf_dir):
    html, url = (F.md5(F.col(c).cast("binary")) for c in ("html", "url"))
    return table(spark, sf_dir, "pages").select("page_id", html.alias("digest"), (html == url).alias("same"))


@query("normalize", f"WITH {UNIT} SELECT eid, round(list_sum(list_transform(embedding, lambda x: x * x)), 6) AS n2, round(embedding[1], 6) AS first FROM vecs")
def normalize(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("eid", V.normalize(F.col("embedding")).alias("v"))
    return rows.select("eid", F.round(V.dot(F.col("v"), F.col("v")), 6).alias("n2"), F.round(F.element_at("v", 1), 6).alias("first"))


@query("cosine_similarity", f"WITH pairs AS (SELECT a.vec_id AS eid, a.embedding AS x, b.embedding AS y FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1) SELECT eid, round({sql_pair(DOT, 'x', 'y')} / (greatest(sqrt({sql_pair(DOT, 'x', 'x')}), 1e-8) * greatest(sqrt({sql_pair(DOT, 'y', 'y')}), 1e-8)), 6) AS similarity FROM pairs")
def cosine_similarity(spark, sf_dir):
    v = vectors(spark, sf_dir)
    after = v.select((F.col("eid") - 1).alias("eid"), F.col("embedding").alias("y"))
    return v.join(after, "eid").select("eid", F.round(V.cosine_similarity(F.col("embedding"), F.col("y")), 6).alias("similarity"))


@query("pad_dims", "SELECT vec_id AS eid, CAST(80 AS INTEGER) AS dims, round(list_sum(CAST(embedding AS DOUBLE[])), 6) AS total FROM embeddings")
def pad_dims(spark, sf_dir):
    rows = vectors(spark, sf_dir).select("eid", V.pad(F.col("embedding"), 70).alias("v"))
    return rows.select("eid", F.size("v").alias("dims"), F.round(V.fold(F.col("v")), 6).alias("total"))


@query("project_embedding", "SELECT vec_id AS eid, round(list_sum(CAST(embedding[1:32] AS DOUBLE[])), 6) AS a, round(list_sum(CAST(embedding[33:64] AS DOUBLE[])), 6) AS b FROM embeddings")
def project_embedding(spark, sf_dir):
    matrix = [[1.0, 0.0] if i < 32 else [0.0, 1.0] for i in range(DIM)]
    rows = vectors(spark, sf_dir).select("eid", V.project(F.col("embedding"), matrix).alias("v"))
    return rows.select("eid", *(F.round(F.element_at("v", i + 1), 6).alias(n) for i, n in enumerate("ab")))


@query("hamming_codes", "SELECT a.vec_id AS eid, CAST(list_sum(list_transform(range(1, 65), lambda i: bit_count(xor(CAST(trunc(abs(CAST(a.embedding[i] AS DOUBLE)) * 1000) AS INTEGER), CAST(trunc(abs(CAST(b.embedding[i] AS DOUBLE)) * 1000) AS INTEGER))))) AS BIGINT) AS bits FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def hamming_codes(spark, sf_dir):
    v = vectors(spark, sf_dir).select("eid", F.transform("embedding", lambda x: (F.abs(x.cast("double")) * 1000).cast("int")).alias("codes"))
    after = v.select((F.col("eid") - 1).alias("eid"), F.col("codes").alias("y"))
    return v.join(after, "eid").select("eid", V.hamming_codes(F.col("codes"), F.col("y")).alias("bits"))


@query("clip_pixel_norm", "SELECT event_id, round(((event_id % 256) / 255.0::DOUBLE - 0.48145466) / 0.26862954, 6) AS r, round(((event_id % 256) / 255.0::DOUBLE - 0.4578275) / 0.26130258, 6) AS g, round(((event_id % 256) / 255.0::DOUBLE - 0.40821073) / 0.27577711, 6) AS b FROM events")
def clip_pixel_norm(spark, sf_dir):
    pixel = (F.col("event_id") % 256).cast("double")
    return table(spark, sf_dir, "events").select("event_id", *(F.round(embed.pixel_norm(pixel, i), 6).alias(c) for i, c in enumerate("rgb")))


@query("eid_validate", "SELECT page_id, CASE WHEN strlen(substr(url, 8)) <= 16 THEN substr(url, 8) END AS eid FROM pages")
def eid_validate(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", S.canonical_id(F.expr("substring(url, 8)")).alias("eid"))


@query("clip_text_clean", r"SELECT conv_id, turn, lower(trim(regexp_replace(text, '[\x20\x09-\x0D]+', ' ', 'g'))) AS clean FROM conversations")
def clip_text_clean(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", S.clean_text(F.col("text")).alias("clean"))


TOKENS = "toks AS (SELECT conv_id, turn, list_transform(string_split(text, ' '), lambda w: length(w)) AS ids FROM conversations WHERE text IS NOT NULL)"


def token_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = F.transform(F.split("text", " "), F.length)
    return table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", ids.alias("ids"))


@query("pad_tokens", f"WITH {TOKENS}, full_ids AS (SELECT *, list_concat([49406], list_concat(ids[1:75], [49407])) AS f FROM toks) SELECT conv_id, turn, CAST(77 AS INTEGER) AS n, CAST(list_sum(f) AS BIGINT) AS total, CAST(len(f) AS INTEGER) AS used FROM full_ids")
def pad_tokens(spark, sf_dir):
    rows = token_rows(spark, sf_dir).select("conv_id", "turn", S.pad_tokens(F.col("ids"), 77, 49406, 49407).alias("f"))
    return rows.select("conv_id", "turn", F.size("f").alias("n"), F.aggregate("f", F.lit(0).cast("long"), lambda s, x: s + x).alias("total"), F.array_position("f", 49407).cast("int").alias("used"))


@query("ctx_len", f"WITH {TOKENS} SELECT conv_id, turn, CAST(len(list_filter(ids, lambda x: x > 0)) - 1 AS INTEGER) AS n FROM toks")
def ctx_len(spark, sf_dir):
    mask = F.transform("ids", lambda x: (x > 0).cast("int"))
    return token_rows(spark, sf_dir).select("conv_id", "turn", S.context_length(mask).alias("n"))


@query("boosts", "WITH w AS (SELECT event_type, sum(value) AS v FROM events GROUP BY event_type) SELECT event_type AS field, round(1 - v / sum(v) OVER (), 6) AS boost FROM w")
def boosts(spark, sf_dir):
    w = table(spark, sf_dir, "events").groupBy("event_type").agg(F.sum("value").alias("v"))
    m = w.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("event_type", "v")))).alias("m"))
    return m.select(F.explode(S.boosts(F.col("m"))).alias("field", "boost")).select("field", F.round("boost", 6).alias("boost"))


# ---- nearest neighbours


def one_query(metric: Metric) -> Query:
    return lambda spark, sf_dir: knn.nearest(vectors(spark, sf_dir), first_vector(spark, sf_dir), K, metric)


def one_sql(expression: str, cte: str, outer: str = "{}") -> str:
    d = f"round({outer.format(sql_pair(expression, 'v.embedding', 'q.embedding'))}, 6)"
    return f"WITH {cte} SELECT v.eid, {d} AS distance FROM vecs v, (SELECT embedding FROM vecs WHERE eid = 0) q ORDER BY distance, eid LIMIT 10"


query("knn_l2", one_sql(L2, VEC))(one_query(Metric.L2))
query("knn_l1", one_sql(L1, VEC))(one_query(Metric.L1))
query("knn_cosine", one_sql(DOT, UNIT, "1 - {}"))(one_query(Metric.COSINE))


def batch_sql(group: str) -> str:
    over = "PARTITION BY qid" + (f", {group}" if group else "")
    keep = f"{group}, " if group else ""
    return f"""WITH {VEC}, {QRY}, far AS (SELECT qid, {keep}eid, round({sql_pair(L2, 'vecs.embedding', 'qs.embedding')}, 6) AS distance FROM vecs, qs),
    ranked AS (SELECT *, row_number() OVER ({over} ORDER BY distance, eid) AS rank FROM far)
    SELECT qid, {keep}eid, distance, rank FROM ranked WHERE rank <= 10"""


@query("knn_batch", batch_sql(""))
def knn_batch(spark, sf_dir):
    return knn.nearest_batch(vectors(spark, sf_dir), query_vectors(spark, sf_dir), K)


@query("search_multi_field", batch_sql("field"))
def search_multi_field(spark, sf_dir):
    return knn.nearest_batch(vectors(spark, sf_dir), query_vectors(spark, sf_dir), K, group=("field",))


def merged_sql(fields: str, boost: str) -> str:
    return f"""WITH {VEC}, {QRY}, far AS (SELECT qid, field, eid, round({sql_pair(L2, 'vecs.embedding', 'qs.embedding')}, 6) AS distance FROM vecs, qs WHERE field IN ({fields})),
    hits AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY qid, field ORDER BY distance, eid) <= 10),
    scored AS (SELECT *, CASE WHEN max(distance) OVER (PARTITION BY qid) = 0 THEN 0 ELSE distance / max(distance) OVER (PARTITION BY qid) * {boost} END AS score FROM hits),
    placed AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score, eid, field) AS place FROM scored)"""


WEIGHTS = {"paragraph": 4.0, "title": 1.0}
BOOST = "CASE field WHEN 'paragraph' THEN 1 - 4.0::DOUBLE / 5 WHEN 'title' THEN 1 - 1.0::DOUBLE / 5 ELSE 1.0 END"


def weighted(spark: SparkSession, sf_dir: str, attributes: tuple[str, ...]) -> DataFrame:
    return knn.search(vectors(spark, sf_dir), query_vectors(spark, sf_dir), attributes, WEIGHTS, K, known=("title", "paragraph", "body"))


@query("search_weighted", merged_sql("'title', 'paragraph', 'body'", BOOST) + " SELECT qid, place, field, eid, round(score, 6) AS score FROM placed WHERE place <= 10")
def search_weighted(spark, sf_dir):
    return weighted(spark, sf_dir, ()).withColumn("score", F.round("score", 6))


@query("search_attributes", merged_sql("'title', 'paragraph'", BOOST) + " SELECT qid, place, field, eid, round(score, 6) AS score FROM placed WHERE place <= 10")
def search_attributes(spark, sf_dir):
    return weighted(spark, sf_dir, ("title", "paragraph")).withColumn("score", F.round("score", 6))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(F.col("text").cast("binary")).alias("doc"))


DOC_SQL = " SELECT qid, place, eid AS doc_id, round(score, 6) AS score, md5(text) AS doc FROM placed {} JOIN documents ON doc_id = eid WHERE place <= 10"


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search_weighted(spark, sf_dir).select("qid", "place", F.col("eid").alias("doc_id"), "score")


@query("search_with_docs", merged_sql("'title', 'paragraph', 'body'", BOOST) + DOC_SQL.format("LEFT"))
def search_with_docs(spark, sf_dir):
    return knn.with_documents(hits(spark, sf_dir), documents(spark, sf_dir))


@query("search_with_docs_inner", merged_sql("'title', 'paragraph', 'body'", BOOST) + DOC_SQL.format(""))
def search_with_docs_inner(spark, sf_dir):
    return knn.with_documents(hits(spark, sf_dir), documents(spark, sf_dir), how="inner")


@query("search_after_delete", f"""WITH vecs AS (SELECT vec_id AS eid, embedding FROM embeddings WHERE vec_id % 3 <> 1), {QRY},
    far AS (SELECT qid, eid, round({sql_pair(L2, 'vecs.embedding', 'qs.embedding')}, 6) AS distance FROM vecs, qs)
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, eid) AS rank FROM far QUALIFY rank <= 10""")
def search_after_delete(spark, sf_dir):
    gone = vectors(spark, sf_dir).where("eid % 3 = 1").select("eid")
    return knn.nearest_batch(store.without(vectors(spark, sf_dir).select("eid", "embedding"), gone), query_vectors(spark, sf_dir), K)


@query("concept_filter", f"WITH c AS (SELECT embedding AS e FROM embeddings WHERE vec_id = 0) SELECT vec_id AS eid FROM embeddings, c WHERE {sql_pair(DOT, 'embedding', 'e')} / (greatest(sqrt({sql_pair(DOT, 'embedding', 'embedding')}), 1e-8) * greatest(sqrt({sql_pair(DOT, 'e', 'e')}), 1e-8)) <= 0.2093")
def concept_filter(spark, sf_dir):
    concept = F.array(*(F.lit(float(x)) for x in first_vector(spark, sf_dir)))
    return knn.similarity_filter(vectors(spark, sf_dir), concept).select("eid")


@query("recall_at_k", f"""WITH {VEC}, {QRY}, far AS (SELECT qid, eid, round({sql_pair(L2, 'vecs.embedding', 'qs.embedding')}, 6) AS distance FROM vecs, qs),
    truth AS (SELECT * FROM far QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, eid) <= 10),
    found AS (SELECT * FROM far WHERE eid % 4 <> 1 QUALIFY row_number() OVER (PARTITION BY qid ORDER BY distance, eid) <= 10)
    SELECT qid, round(count(f.eid) / 10.0::DOUBLE, 6) AS recall FROM truth t LEFT JOIN found f USING (qid, eid) GROUP BY qid""")
def recall_at_k(spark, sf_dir):
    v, q = vectors(spark, sf_dir), query_vectors(spark, sf_dir)
    return knn.recall(knn.nearest_batch(v.where("eid % 4 <> 1"), q, K), knn.nearest_batch(v, q, K), K).select("qid", F.round("recall", 6).alias("recall"))


#: the bits of a 32-bit float as a whole number: sign, exponent and fraction (no subnormal numbers occur)
BITS = "CASE WHEN x = 0 THEN 0::BIGINT ELSE (CASE WHEN x < 0 THEN 2147483648 ELSE 0 END) + (CAST(floor(log2(abs(x::DOUBLE))) AS BIGINT) + 127) * 8388608 + CAST((abs(x::DOUBLE) / pow(2, floor(log2(abs(x::DOUBLE)))) - 1) * 8388608 AS BIGINT) END"


@query("hamming_bits", f"""WITH b AS (SELECT vec_id, list_transform(embedding, lambda x: {BITS}) AS bits FROM embeddings), {VEC}, {QRY},
    far AS (SELECT q.qid, v.eid, CAST(list_sum(list_transform(range(1, len(a.bits) + 1), lambda i: bit_count(xor(a.bits[i], c.bits[i])))) AS DOUBLE) AS distance FROM vecs v JOIN b a ON a.vec_id = v.eid, qs q JOIN b c ON c.vec_id = q.qid)
    SELECT *, row_number() OVER (PARTITION BY qid ORDER BY distance, eid) AS rank FROM far QUALIFY rank <= 10""")
def hamming_bits(spark, sf_dir):
    return knn.nearest_batch(vectors(spark, sf_dir), query_vectors(spark, sf_dir), K, Metric.HAMMING)


# ---- quantization

FIT = "fit AS (SELECT min(x) AS off, (quantile_cont(x, 0.99) - min(x)) / 255 AS alpha FROM (SELECT CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings))"
CODE = "list_transform(embedding, lambda x: CAST(trunc(least(greatest((CAST(x AS DOUBLE) - off) / alpha, 0.0), 255.0)) AS INTEGER))"
CODED = f"{FIT}, coded AS (SELECT vec_id AS eid, off, alpha, {CODE} AS codes FROM embeddings, fit)"


def coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir).select("eid", "embedding")
    return quantize.encode_scalar(v, quantize.fit_scalar(v, accuracy=None))


@query("sq_params", f"WITH {FIT} SELECT round(off, 6) AS off, round(alpha, 6) AS alpha FROM fit")
def sq_params(spark, sf_dir):
    return quantize.fit_scalar(vectors(spark, sf_dir), accuracy=None).select(F.round("offset", 6).alias("off"), F.round("alpha", 6).alias("alpha"))


@query("sq_encode", f"WITH {CODED} SELECT eid, CAST(list_sum(codes) AS BIGINT) AS total, CAST(list_max(codes) AS INTEGER) AS most FROM coded")
def sq_encode(spark, sf_dir):
    total = F.aggregate("codes", F.lit(0).cast("long"), lambda s, x: s + x)
    return coded(spark, sf_dir).select("eid", total.alias("total"), F.array_max("codes").cast("int").alias("most"))


@query("sq_precompute", f"WITH {CODED} SELECT eid, round(list_sum(codes) * off * alpha, 6) AS value FROM coded")
def sq_precompute(spark, sf_dir):
    return coded(spark, sf_dir).select("eid", F.round(quantize.precomputed(F.col("codes"), F.col("offset"), F.col("alpha")), 6).alias("value"))


@query("knn_l2_u8", f"WITH {CODED} SELECT c.eid, CAST(list_sum(list_transform(list_zip(c.codes, q.codes), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS distance FROM coded c, (SELECT codes FROM coded WHERE eid = 0) q ORDER BY distance, eid LIMIT 10")
def knn_l2_u8(spark, sf_dir):
    rows = coded(spark, sf_dir).select("eid", "codes")
    one = rows.where("eid = 0").select(F.col("codes").alias("q")).limit(1)
    return rows.crossJoin(F.broadcast(one)).select("eid", quantize.l2_codes(F.col("codes"), F.col("q")).alias("distance")).orderBy("distance", "eid").limit(K)


@query("centroid", "SELECT CAST(dim AS INTEGER) AS dim, round(avg(x), 6) AS mean FROM (SELECT unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim")
def centroid(spark, sf_dir):
    return quantize.centroid(vectors(spark, sf_dir)).select("dim", F.round("mean", 6).alias("mean"))


MEANS = "means AS (SELECT list(m ORDER BY dim) AS mean FROM (SELECT dim, avg(x) AS m FROM (SELECT unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings) GROUP BY dim))"


@query("pq_center", f"WITH {MEANS} SELECT vec_id AS eid, round({sql_pair(L2, 'embedding', 'mean')}, 6) AS norm FROM embeddings, means")
def pq_center(spark, sf_dir):
    v = vectors(spark, sf_dir)
    mean = quantize.centroid(v).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "mean"))), lambda s: s["mean"]).alias("mean"))
    c = quantize.centred(F.col("embedding"), F.col("mean"))
    return v.crossJoin(F.broadcast(mean)).select("eid", F.round(V.dot(c, c), 6).alias("norm"))


@query("entry_point", f"WITH {MEANS} SELECT vec_id AS eid, round({sql_pair(L2, 'embedding', 'mean')}, 6) AS distance FROM embeddings, means ORDER BY distance, eid LIMIT 1")
def entry_point(spark, sf_dir):
    return graph.entry_point(vectors(spark, sf_dir))


@query("pq_layout", "SELECT CAST(i AS INTEGER) AS chunk, CAST(i * 9 + least(i, 1) AS INTEGER) AS first, CAST(CASE WHEN i < 1 THEN 10 ELSE 9 END AS INTEGER) AS size FROM (SELECT unnest(range(0, 7)) AS i)")
def pq_layout(spark, sf_dir):
    at = chunk_offsets(DIM, 7)
    return spark.createDataFrame([(i, at[i], at[i + 1] - at[i]) for i in range(7)], "chunk int, first int, size int")


BOOK = "book AS (SELECT CAST(c AS INTEGER) AS chunk, CAST(vec_id AS INTEGER) AS center, embedding[c * 8 + 1 : c * 8 + 8] AS piv FROM embeddings, (SELECT unnest(range(0, 8)) AS c) WHERE vec_id < 16)"
PQ = f"{BOOK}, parts AS (SELECT vec_id AS eid, CAST(c AS INTEGER) AS chunk, embedding[c * 8 + 1 : c * 8 + 8] AS part FROM embeddings, (SELECT unnest(range(0, 8)) AS c)), codes AS (SELECT eid, chunk, arg_min(center, (round({sql_pair(L2, 'part', 'piv')}, 12), center)) AS center FROM parts JOIN book USING (chunk) GROUP BY eid, chunk)"
ADC = f"{PQ}, lut AS (SELECT chunk, center, {sql_pair(L2, 'piv', 'part')} AS d FROM book JOIN parts USING (chunk) WHERE eid = 0), adc AS (SELECT codes.eid, round(sum(d), 6) AS distance FROM codes JOIN lut USING (chunk, center) GROUP BY codes.eid)"


def codebook(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slices of the first 16 vectors: a fixed codebook that SQL can name."""
    first = vectors(spark, sf_dir).where(F.col("eid") < CODEBOOK).select(F.col("eid").cast("int").alias("center"), "embedding")
    return quantize.chunked(first, DIM, CHUNKS).withColumnRenamed("part", "pivot")


@query("pq_encode", f"WITH {PQ} SELECT eid, chunk, center FROM codes")
def pq_encode(spark, sf_dir):
    return quantize.encode_product(vectors(spark, sf_dir), codebook(spark, sf_dir), DIM, CHUNKS)


@query("pq_adc", f"WITH {ADC} SELECT eid, distance FROM adc")
def pq_adc(spark, sf_dir):
    lut = quantize.lookup_table(codebook(spark, sf_dir), first_vector(spark, sf_dir), DIM, CHUNKS)
    return quantize.asymmetric(pq_encode(spark, sf_dir), lut).select("eid", F.round("distance", 6).alias("distance"))


@query("pq_rerank", f"WITH {ADC}, near AS (SELECT eid FROM adc ORDER BY distance, eid LIMIT 100) SELECT eid, round({sql_pair(L2, 'v.embedding', 'q.embedding')}, 6) AS distance FROM near JOIN embeddings v ON v.vec_id = eid, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY distance, eid LIMIT 10")
def pq_rerank(spark, sf_dir):
    return quantize.reranked(pq_encode(spark, sf_dir), codebook(spark, sf_dir), vectors(spark, sf_dir).select("eid", "embedding"), first_vector(spark, sf_dir), DIM, CHUNKS, 100, K)


@query("pq_train")
def pq_train(spark, sf_dir):
    return quantize.train_product(vectors(spark, sf_dir), DIM, CHUNKS)


# ---- graphs

ADJ = "adj AS (SELECT vec_id AS vid, list_filter([lead(vec_id, 1) OVER w, lead(vec_id, 2) OVER w, lag(vec_id, 1) OVER w], lambda x: x IS NOT NULL) AS nbrs FROM embeddings WINDOW w AS (PARTITION BY label ORDER BY vec_id)), dead AS (SELECT vec_id AS vid FROM embeddings WHERE vec_id % 10 = 3)"


def adjacency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed graph: each vector with the two after and the one before it of its label."""
    w = Window.partitionBy("label").orderBy("vec_id")
    near = F.array(F.lead("vec_id", 1).over(w), F.lead("vec_id", 2).over(w), F.lag("vec_id", 1).over(w))
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("vid"), F.filter(near, lambda x: x.isNotNull()).alias("nbrs"))


def dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").where("vec_id % 10 = 3").select(F.col("vec_id").alias("vid"))


@query("degree_stats", f"WITH {ADJ} SELECT CAST(max(len(nbrs)) AS BIGINT) AS most, avg(len(nbrs)) AS mean, CAST(min(len(nbrs)) AS BIGINT) AS least, count(*) FILTER (len(nbrs) < 2) AS thin FROM adj")
def degree_stats(spark, sf_dir):
    return graph.degree_stats(adjacency(spark, sf_dir))


EDGES = "edges AS (SELECT vid, unnest(nbrs) AS nbr FROM adj)"


@query("nodes_to_repair", f"WITH {ADJ}, {EDGES} SELECT DISTINCT vid FROM edges WHERE nbr IN (SELECT vid FROM dead) AND vid NOT IN (SELECT vid FROM dead)")
def nodes_to_repair(spark, sf_dir):
    return graph.to_repair(adjacency(spark, sf_dir), dead(spark, sf_dir))


@query("prune_deleted_edges", f"WITH {ADJ}, {EDGES} SELECT DISTINCT vid, nbr FROM edges WHERE vid <> nbr AND nbr NOT IN (SELECT vid FROM dead) AND vid NOT IN (SELECT vid FROM dead)")
def prune_deleted_edges(spark, sf_dir):
    return graph.pruned_edges(adjacency(spark, sf_dir), dead(spark, sf_dir))


@query("hot_nodes", f"WITH {ADJ}, {EDGES} SELECT nbr AS vid, count(*) AS visits FROM edges GROUP BY nbr ORDER BY visits DESC, vid LIMIT 20")
def hot_nodes(spark, sf_dir):
    return graph.hot_nodes(adjacency(spark, sf_dir).select(F.explode("nbrs").alias("vid")), 20)




@query("graph_build")
def graph_build(spark, sf_dir):
    return graph.build(vectors(spark, sf_dir)).select("shard", "vid", "eid", "nbrs")


@query("graph_search")
def graph_search(spark, sf_dir):
    return graph.search(graph.build(vectors(spark, sf_dir)), query_vectors(spark, sf_dir), K)


@query("graph_consolidate")
def graph_consolidate(spark, sf_dir):
    gone = dead(spark, sf_dir).select(F.col("vid").alias("eid"))
    return graph.consolidate(graph.build(vectors(spark, sf_dir)), gone).select("shard", "vid", "eid", "nbrs")


# ---- pairs and encoding

PAIRS = "pos AS (SELECT DISTINCT b.item_id % 20 AS a, 1000 + b.item_id // 20 AS b FROM benchmark b)"


def positive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select((F.col("item_id") % 20).alias("a"), (1000 + F.floor(F.col("item_id") / 20)).alias("b")).where("(a + b) % 3 <> 0")


@query("negative_pairs", f"WITH {PAIRS}, p AS (SELECT * FROM pos WHERE (a + b) % 3 <> 0) SELECT x.a, y.b FROM (SELECT DISTINCT a FROM p) x, (SELECT DISTINCT b FROM p) y EXCEPT SELECT a, b FROM p")
def negative_pairs(spark, sf_dir):
    return pairs.negatives(positive(spark, sf_dir))


@query("negative_pairs_unordered", f"WITH {PAIRS}, p AS (SELECT * FROM pos WHERE (a + b) % 3 <> 0), t AS (SELECT a AS t FROM p UNION SELECT b FROM p) SELECT x.t AS a, y.t AS b FROM t x JOIN t y ON x.t < y.t EXCEPT SELECT least(a, b), greatest(a, b) FROM p")
def negative_pairs_unordered(spark, sf_dir):
    return pairs.unordered_negatives(positive(spark, sf_dir))


@query("labelled_pairs", "WITH l AS (SELECT e.vec_id AS line, e.vec_id AS a, e.vec_id + 1 AS b, CASE WHEN e.label = f.label THEN 1 ELSE 0 END AS label FROM embeddings e JOIN embeddings f ON f.vec_id = e.vec_id + 1) SELECT line, a, b, CAST(label AS INTEGER) AS label FROM l QUALIFY row_number() OVER (PARTITION BY label ORDER BY line) <= 1000")
def labelled_pairs(spark, sf_dir):
    v = vectors(spark, sf_dir)
    sentences = v.select(F.col("eid").alias("sentence"), "embedding")
    after = v.select((F.col("eid") - 1).alias("eid"), F.col("label").alias("other"))
    labels = v.join(after, "eid").select(F.col("eid").alias("line"), F.col("eid").alias("a"), (F.col("eid") + 1).alias("b"), (F.col("label") == F.col("other")).cast("int").alias("label"))
    return pairs.labelled(sentences, labels, 1000).select("line", "a", "b", "label")


SIM = f"s AS (SELECT round({sql_pair(DOT, 'a.embedding', 'b.embedding')}, 6) AS similarity, CASE WHEN a.label = b.label THEN 1 ELSE -1 END AS label FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1)"


def similarities(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    after = v.select((F.col("eid") - 1).alias("eid"), F.col("embedding").alias("y"), F.col("label").alias("other"))
    label = F.when(F.col("label") == F.col("other"), 1).otherwise(-1)
    return v.join(after, "eid").select(F.round(V.dot(F.col("embedding"), F.col("y")), 6).alias("similarity"), label.alias("label"))


@query("threshold_accuracy", f"WITH {SIM}, t AS (SELECT i FROM (SELECT unnest(range(0, 2000)) AS i)), r AS (SELECT i, avg(CAST(((similarity + 1) * 1000 > i) = (label > 0) AS INTEGER)) AS acc, count(*) AS n FROM s, t GROUP BY i) SELECT round(max(acc), 6) AS accuracy, round(1.96 * sqrt(max(acc) * (1 - max(acc)) / max(n)), 6) AS margin FROM r")
def threshold_accuracy(spark, sf_dir):
    return pairs.accuracy(similarities(spark, sf_dir)).select(F.round("accuracy", 6).alias("accuracy"), F.round("margin", 6).alias("margin"))


@query("mse", f"WITH {SIM} SELECT round(avg((similarity - label) * (similarity - label)), 6) AS mse FROM s")
def mse(spark, sf_dir):
    rows = similarities(spark, sf_dir).select(F.col("similarity").alias("prediction"), F.col("label").alias("target"))
    return pairs.mse(rows).select(F.round("mse", 6).alias("mse"))


@query("split_counts", "SELECT CASE WHEN doc_id % 2 = 0 THEN 'train' ELSE 'test' END AS half, count(*) AS n FROM labels GROUP BY 1")
def split_counts(spark, sf_dir):
    return pairs.split(table(spark, sf_dir, "labels"), "doc_id").groupBy("half").agg(F.count(F.lit(1)).alias("n"))


@query("avg_pool", "WITH m AS (SELECT vec_id, embedding, vec_id // 4 AS id, CASE WHEN vec_id % 4 = 3 THEN 0 ELSE 1 END AS m FROM embeddings), e AS (SELECT id, m, unnest(range(0, 64)) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM m) SELECT id, CAST(dim AS INTEGER) AS dim, round(sum(x * m) / sum(m), 6) AS value FROM e GROUP BY id, dim")
def avg_pool(spark, sf_dir):
    v = vectors(spark, sf_dir).select(F.floor(F.col("eid") / 4).alias("id"), "eid", "embedding")
    listed = v.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("eid", "embedding"))).alias("t"))
    rows = listed.select("id", F.transform("t", lambda s: s["embedding"]).alias("hidden"), F.transform("t", lambda s: F.when(s["eid"] % 4 == 3, 0).otherwise(1)).alias("mask"))
    return embed.pooled(rows).select("id", "dim", F.round("value", 6).alias("value"))


@query("encode_hashing", r"""WITH words AS (SELECT conv_id, turn, unnest(regexp_extract_all(lower(text), '[^\x20\x09-\x0D]+')) AS w FROM conversations WHERE text IS NOT NULL),
    counts AS (SELECT conv_id, turn, CAST('0x' || substr(md5(w), 1, 4) AS INTEGER) % 64 AS dim, count(*) AS n FROM words GROUP BY 1, 2, 3)
    SELECT conv_id, turn, dim, round(CAST(CAST(n / sqrt(sum(n * n) OVER (PARTITION BY conv_id, turn)) AS FLOAT) AS DOUBLE), 6) AS value FROM counts""")
def encode_hashing(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.col("text").alias("value"))
    found = embed.encode(rows).select("conv_id", "turn", F.posexplode("embedding").alias("dim", "x"))
    return found.where("x > 0").select("conv_id", "turn", "dim", F.round(F.col("x").cast("double"), 6).alias("value"))


@query("encode")
def encode(spark, sf_dir):
    rows = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("id"), F.lit("passage: ").alias("instruction"), F.col("text").alias("value"))
    return embed.encode(rows).select("id", "embedding", "err_message")


def catalog_sql() -> str:
    value = lambda x: "NULL" if x is None else f"'{x}'" if isinstance(x, str) else str(x)
    rows = ", ".join(f"({', '.join(map(value, r))})" for r in models.rows())
    return f"SELECT model_class, model_name, CAST(image_size AS INTEGER) AS image_size, CAST(dims AS INTEGER) AS dims FROM (VALUES {rows}) t(model_class, model_name, image_size, dims)"


@query("model_catalog", catalog_sql())
def model_catalog(spark, sf_dir):
    return models.catalog(spark)
