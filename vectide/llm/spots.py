"""SpotSigs document fingerprints.

Every occurrence of an anchor (a common word) starts a signature: the chain of
the next content words at a fixed spacing. Content words are all words but the
anchors. The fingerprint is the set of a text's distinct signatures; two texts
are alike by the Jaccard similarity of their sets.

Words are lower-cased (A-Z) runs of letters and digits. A text without an
anchor uses every word as one. A chain that the text's end cuts short still
counts. A text without words has the empty fingerprint, like only itself:
likeness 1 to another empty one, 0 to any other. Null texts count as empty. Repeated rows
are documents of their own. Very long texts are read whole, one at a time. Columns beyond
doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.tables import groups_for
from vectide.llm.text import U64, Words, mix, pieces

#: Common words of English, German, French and Spanish; a parameter of every function here.
ANCHORS = (
    "the a an is was are be to of in and that it "
    "der die das ist und zu ein eine den "
    "le la les un une est et de des "
    "el los las una es y que en"
).split()
CHAIN, SPACING = 2, 2
#: ranges of documents that a query is cut into at most
MOST_PARTS = 20_000


def _anchor_hashes(anchors: Iterable[str]) -> np.ndarray:
    return np.unique(Words(pa.array([" ".join(anchors)])).hashes(lower=True))


def fingerprints(column: pa.Array, anchors: Iterable[str] = ANCHORS, chain: int = CHAIN, spacing: int = SPACING) -> list[np.ndarray]:
    """Sorted distinct 32-bit signatures of each text."""
    words = Words(column, plain=True)
    n = len(words.off) - 1
    h, doc = words.hashes(lower=True), words.doc
    known = _anchor_hashes(anchors)
    at = np.minimum(np.searchsorted(known, h), len(known) - 1)
    anchor = known[at] == h
    bare = np.bincount(doc[anchor], minlength=n) == 0
    content = ~anchor | bare[doc]
    spot = anchor | bare[doc]
    after = np.cumsum(content)  # content words up to and with each word = place of the next one
    where = np.flatnonzero(content)
    owner = np.append(doc[where], -1)
    hashes = np.append(h[where], U64(0))
    spots = np.flatnonzero(spot)
    first = after[spots] - bare[doc[spots]]  # a bare text's spot starts with its own word
    sig = np.where(bare[doc[spots]], U64(1), h[spots])
    found = np.zeros(len(spots), bool)
    for i in range(chain):
        nxt = np.minimum(first + i * spacing, len(where))
        there = owner[nxt] == doc[spots]
        found |= there
        sig = mix(sig * U64(3) + np.where(there, hashes[nxt], U64(i + 1)))
    # an anchor with nothing after it is a signature of its own only where the text has no other
    alone = np.bincount(doc[spots][found], minlength=n) == 0
    use = found | alone[doc[spots]]
    code = np.unique((doc[spots][use].astype(U64) << U64(32)) | (sig[use] >> U64(32)))
    cut = np.searchsorted(code >> U64(32), np.arange(n + 1).astype(U64))
    low = (code & U64(0xFFFFFFFF)).astype(np.uint32)
    return [low[a:b] for a, b in zip(cut[:-1], cut[1:], strict=True)]


def encode(signatures: np.ndarray) -> str:
    return base64.b64encode(signatures.astype(">u4").tobytes()).decode()


def jaccard(a: np.ndarray, b: np.ndarray, least: float = 0.0) -> float:
    """Jaccard similarity of two sorted sets; 0 if their sizes alone keep it below ``least``."""
    if not len(a) and not len(b):
        return 1.0
    small, large = sorted((len(a), len(b)))
    if not small or small < least * large:
        return 0.0
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / (len(a) + len(b) - both)


def similar(docs: DataFrame, threshold: float = 0.8, **options) -> DataFrame:
    """(a, b, similarity): pairs of distinct fingerprints at or above ``threshold``.

    Texts with equal fingerprints form one class, named by its smallest doc_id, and pairs
    are between classes. Sets are partitioned by length: lengths in one bucket and the next
    can be alike, others cannot. In a bucket an inverted index over each set's rarest
    signatures (prefix filter: sets alike by t share one of their n - ceil(t n) + 1 rarest)
    gives the candidates, and sizes prune them before Jaccard is computed.
    """

    def sign(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            sets = fingerprints(piece.column(1), **options)
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([s.astype(np.int64) for s in sets], pa.list_(pa.int64()))], ["doc_id", "sigs"])

    sets = docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, sigs array<long>")
    classes = sets.groupBy("sigs").agg(F.min("doc_id").alias("doc_id")).where(F.size("sigs") > 0)
    n = F.size("sigs")
    bucket = F.floor(F.log(n) / F.log(F.lit(1 / threshold))).cast("long")
    sig = classes.select("doc_id", n.alias("n"), bucket.alias("bucket"), F.explode("sigs").alias("sig"))
    freq = sig.groupBy("sig").agg(F.count(F.lit(1)).alias("freq"))
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("freq", "sig"))
    prefix = sig.join(freq, "sig").withColumn("rank", rank).where(F.col("rank") <= F.col("n") - F.ceil(F.col("n") * threshold - 1e-9) + 1)
    left = prefix.select("sig", F.col("doc_id").alias("a"), F.col("n").alias("na"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"), F.col("bucket").alias("ba"))
    right = prefix.select("sig", F.col("doc_id").alias("b"), F.col("n").alias("nb"), "bucket")
    once = (F.col("ba") < F.col("bucket")) | (F.col("a") < F.col("b"))
    pairs = left.join(right, ["sig", "bucket"]).where(once & (F.col("a") != F.col("b")) & (F.least("na", "nb") >= threshold * F.greatest("na", "nb"))).select("a", "b").distinct()
    a, b = (classes.select(F.col("doc_id").alias(x), F.col("sigs").alias(f"s{x}")) for x in "ab")
    both = F.size(F.array_intersect("sa", "sb"))
    likeness = both / (F.size("sa") + F.size("sb") - both)
    return pairs.join(a, "a").join(b, "b").select("a", "b", likeness.alias("similarity")).where(F.col("similarity") >= threshold)


def _dealer(bounds: np.ndarray, null_parts: int):
    """A column function: the part of (doc_id, hash of the text), by descending doc_id; rows without an id come last, by hash."""

    @F.arrow_udf("int")
    def part(ids: pa.Array, hashes: pa.Array) -> pa.Array:
        none = ids.is_null().to_numpy(zero_copy_only=False)
        own = len(bounds) - np.searchsorted(bounds, ids.fill_null(0).to_numpy().astype(np.int64))
        share = (hashes.to_numpy().astype(np.float64) + 2.0**63) / 2.0**64 * null_parts
        own = np.where(none, len(bounds) + 1 + np.minimum(share.astype(np.int64), null_parts - 1), own)
        return pa.array(own.astype(np.int32))

    return part


def neighbours(docs: DataFrame, part_bytes: int = 4 << 20) -> DataFrame:
    """(part, doc_id, h, text, ghost): documents dealt to parts by descending doc_id.

    Rows without an id come last, by the hash h of their text, in parts of their own. Each part
    also holds, as a ghost, the first document of the part after it, so that inside a part every
    document's successor is the row below. Parts are ranges of doc_id; their bounds, MOST_PARTS
    numbers at most, reach the driver and the tasks, where they are searched. Beyond
    that number parts grow; a task streams its parts.
    """
    docs = docs.select("doc_id", F.xxhash64("text").alias("h"), "text")
    parts = min(MOST_PARTS, groups_for(docs, part_bytes, 50, 48))
    rows, nulls = docs.select(F.count(F.lit(1)), F.count_if(F.col("doc_id").isNull())).first()
    marks = docs.where("doc_id IS NOT NULL").agg(F.percentile_approx("doc_id", [i / parts for i in range(1, parts)] or [0.5], 20 * parts)).first()[0] or []
    part = _dealer(np.unique(np.array(marks, np.int64)), max(1, math.ceil(parts * nulls / max(1, rows))))
    dealt = docs.withColumn("part", part("doc_id", "h"))
    own_first = F.min(F.struct((-F.col("doc_id")).alias("id"), F.when(F.col("doc_id").isNull(), F.col("h")).otherwise(F.lit(0)).alias("h")))
    first = {r["part"]: (r["first"]["id"], r["first"]["h"]) for r in docs.select("doc_id", "h").withColumn("part", part("doc_id", "h")).groupBy("part").agg(own_first.alias("first")).collect()}
    order = sorted(first)
    if not order:
        return dealt.withColumn("ghost", F.lit(False)).select("part", "doc_id", "h", "text", "ghost")
    before = dict(zip(order, [order[-1], *order[:-1]], strict=True))
    table = docs.sparkSession.createDataFrame([(p, None if first[p][0] is None else -first[p][0], first[p][1], before[p]) for p in order], "p int, first long, first_h long, before int")
    is_first = (F.col("part") == F.col("p")) & F.col("doc_id").eqNullSafe(F.col("first")) & (F.col("doc_id").isNotNull() | (F.col("h") == F.col("first_h")))
    ghosts = dealt.join(F.broadcast(table), is_first).select(F.col("before").alias("part"), "doc_id", "h", "text")
    n = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(parts, MOST_PARTS))
    both = dealt.select("part", "doc_id", "h", "text", F.lit(False).alias("ghost")).union(ghosts.withColumn("ghost", F.lit(True)))
    by_hash = F.when(F.col("doc_id").isNull(), F.col("h"))
    return both.repartition(n, "part").sortWithinPartitions("part", "ghost", F.desc_nulls_last("doc_id"), by_hash, "text")


def with_successors(docs: DataFrame, run, schema: str) -> DataFrame:
    """Apply ``run(doc_ids, texts, successor texts)`` -> RecordBatch to all documents by descending id.

    The successor of the last document is the first one. Among equal ids texts order
    ascending; rows without an id come last, ordered by a hash of their text; a lone document
    succeeds itself.
    """

    def stream(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        size, last = 0, None
        for batch in pieces(batches, limit=1 << 20):
            for part, doc_id, text, ghost in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if last is not None and not last[3] and last[0] == part:
                    out.append((last[1], last[2], text))
                    size += len(last[2] or "") + 64
                    if size > 1 << 20:
                        yield run(*zip(*out, strict=True))
                        out, size = [], 0
                last = (part, doc_id, text, ghost)
        if out:
            yield run(*zip(*out, strict=True))

    return neighbours(docs).select("part", "doc_id", "text", "ghost").mapInArrow(stream, schema)
