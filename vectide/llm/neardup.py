"""MinHash near-duplicates by an inverted join over signature coordinates.

A document's shingles give a signature of ``COORDINATES`` values, each joined of
ROWS minimal hashes, and each (coordinate, value) is a token. Documents alike by
0.8 share at least ``MATCHES`` tokens, except with a probability of 3e-8. So:

* prefix merging: with all tokens in one order, such documents share one of the
  first COORDINATES - MATCHES + 1 tokens of each. The order is by how often a
  token's hash bucket occurs in the whole table, rarest first, so the prefix
  leaves out a document's most common tokens. Documents are posted under their
  prefix;
* skip merging: a posting list is not expanded into pairs. Its members are
  compared with a leader (the least member, then one drawn by hash for every
  list), and members whose component the leader already shares are skipped.
  Once leaders find little more, all members in different components are
  compared, in blocks inside the tasks, each pair in one of its lists;
* pairs of fitting size with MATCHES equal coordinates are confirmed on the full
  sets of shingles, as words.

Documents with equal sets form one class and take part once. A class is known by a
128-bit cryptographic digest of all its shingles. Hashes only find candidates.

Null and empty texts, and texts without a word, have no shingle and no link. A null
doc_id joins the class of its set, if that has another member, and is else its
own component. A doc_id stands for one node: rows that repeat it are one node, whatever
their texts. Ties (several least members) cannot occur, as a class has its least doc_id.
Very long texts are read whole, one at a time. An empty table gives no rows; columns
beyond doc_id and text are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vectide.llm.components import components, cut_lineage, free_shuffles
from vectide.llm.tables import discard, stored, summed
from vectide.llm.text import U64, Words, mix, pieces, spans, tidy

#: a coordinate joins so many minimal hashes; signatures of alike documents share so many coordinates
ROWS, COORDINATES, MATCHES = 2, 32, 6
#: token counts that order the prefixes: at most so many hash buckets of one byte
MOST_BITS = 24
#: bits that tell which texts a confirmation needs, by their number; beyond the most, other texts travel too
LEAST_WANTED, MOST_WANTED = 20, 27
#: members of a leader that are compared in one group
GROUP = 256
#: turns with leaders at most, before all pairs left are compared
TURNS = 6
#: links, two numbers each, that are kept in one file
LINKS = 1 << 20
#: members of a list that are compared in one task, and candidate pairs per member that make a list a cloud
BLOCK, DENSE = 1024, 4
_XOR = mix(np.arange(1, ROWS * COORDINATES + 1, dtype=U64) * U64(0xA0761D6478BD642F))
_ODD = mix(_XOR) | U64(1)


def shingles(text: bytes, size: int) -> list[bytes]:
    """The text's runs of ``size`` words in order (all its words, if fewer), A-Z as a-z, words joined by a space."""
    words = text.lower().split()
    if len(words) < size:
        return [b" ".join(words)] if words else []
    return list(map(b" ".join, zip(*(words[i:] for i in range(size)), strict=False)))


def shingle_sets(column: pa.Array, size: int) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Each text's sorted distinct shingle hashes, the number of its distinct shingles, and 128 bits of a digest of them.

    The digest takes the shingles themselves, in order of their hashes (should two share
    one, in their own order), so that equal sets and only those have equal digests.
    """
    words = Words(column)
    hashes = spans(words.hashes(lower=True), size)
    n = len(words.off) - 1
    sets, count, key = [], np.zeros(n, np.int64), np.zeros((2, n), U64)
    for i, (a, b) in enumerate(zip(words.word_off[:-1].tolist(), words.word_off[1:].tolist(), strict=True)):
        found = shingles(words.data[words.off[i] : words.off[i + 1]].tobytes(), size)
        if b - a >= size:
            own, first = np.unique(hashes[a : b - size + 1], return_index=True)
        else:
            own, first = np.array([int.from_bytes(blake2b(x, digest_size=8).digest(), "little") for x in found], U64), np.arange(len(found))
        different = set(found)
        ordered = map(found.__getitem__, first.tolist()) if len(different) == len(own) else sorted(different)
        sets.append(own)
        count[i] = len(different)
        key[:, i] = np.frombuffer(blake2b(b"\n".join(ordered), digest_size=16).digest(), "<u8")
    return sets, count, key


def signature(sets: list[np.ndarray]) -> np.ndarray:
    """Signatures (sets x coordinates) of non-empty sets."""
    flat = np.concatenate(sets)
    first = np.cumsum([0, *map(len, sets)])[:-1]
    found = np.empty((len(sets), COORDINATES), np.int32)
    for j in range(COORDINATES):
        value = np.zeros(len(sets), U64)
        for i in range(j * ROWS, (j + 1) * ROWS):
            y = (flat ^ _XOR[i]) * _ODD[i]
            y ^= y >> U64(32)
            value = mix(value * U64(3) + np.minimum.reduceat(y, first))
        found[:, j] = (value >> U64(32)).astype(np.uint32).view(np.int32)
    return found


def signed(docs: DataFrame, size: int) -> DataFrame:
    """doc_id, n_shingles, the key of its set (k1, k2) and the signature (empty without shingles)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=1 << 20):
            sets, n, key = shingle_sets(piece.column(1), size)
            some = np.flatnonzero(n)
            found = np.zeros((len(n), COORDINATES), np.int32)
            if len(some):
                found[some] = signature([sets[i] for i in some])
            offsets = np.cumsum([0, *np.where(n > 0, COORDINATES, 0)]).astype(np.int32)
            listed = pa.ListArray.from_arrays(pa.array(offsets), pa.array(found[some].reshape(-1)))
            yield pa.RecordBatch.from_arrays(
                [piece.column(0), pa.array(n), *(pa.array(k.view(np.int64)) for k in key), listed],
                ["doc_id", "n_shingles", "k1", "k2", "sig"],
            )

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "doc_id long, n_shingles long, k1 long, k2 long, sig array<int>")


def _tokens(column: pa.Array) -> np.ndarray:
    """(coordinate, value) of each signature as one number: classes x coordinates."""
    values = column.flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES).view(np.uint32).astype(U64)
    return values | (np.arange(COORDINATES, dtype=U64) << U64(32))


def _bucket(tokens: np.ndarray, bits: int) -> np.ndarray:
    return (mix(tokens) >> U64(64 - bits)).astype(np.int64)


def _frequencies(classes: DataFrame, bits: int) -> np.ndarray:
    """How often each hash bucket of tokens occurs in all signatures: 8 times the binary logarithm of the count.

    Tasks emit their counts packed, by blocks, which are added on the executors; the
    sums, of 2**bits bytes at most, come to the driver.
    """
    block = 1 << min(bits, 14)

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray]]:
        total = np.zeros(1 << bits, np.int32)
        for batch in batches:
            np.add.at(total, _bucket(_tokens(batch.column(0)), bits).reshape(-1), 1)
        for a in range(0, 1 << bits, block):
            yield a // block, total[a : a + block]

    def level(_: int, total: np.ndarray) -> bytes:
        return np.minimum(np.round(8 * np.log2(total + 1.0)), 255).astype(np.uint8).tobytes()

    out = np.zeros(1 << bits, np.uint8)
    for k, counts in summed(classes.select("sig"), count, block, level):
        out[k * block : (k + 1) * block] = np.frombuffer(counts, np.uint8)
    return out


def _postings(classes: DataFrame, n: int) -> DataFrame:
    """(token, cls, n, mask): each class under the tokens of its prefix; mask has a bit for each coordinate of it."""
    bits = min(MOST_BITS, max(12, (n * COORDINATES).bit_length()))
    sent = classes.sparkSession.sparkContext.broadcast(_frequencies(classes, bits))
    prefix = COORDINATES - MATCHES + 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = sent.value
        for whole in batches:
            for at in range(0, whole.num_rows, 2048):
                batch = whole.slice(at, 2048)
                tokens = _tokens(batch.column(2))
                order = (count[_bucket(tokens, bits)].astype(U64) << U64(56)) | (mix(tokens) >> U64(8))
                first = np.argpartition(order, prefix - 1, axis=1)[:, :prefix]
                take = pa.array(np.repeat(np.arange(batch.num_rows), prefix))
                chosen = np.take_along_axis(tokens, first, 1).reshape(-1).view(np.int64)
                mask = (1 << first.astype(np.int64)).sum(1)
                columns = [pa.array(chosen), batch.column(0).take(take), batch.column(1).take(take), pa.array(np.repeat(mask, prefix))]
                yield pa.RecordBatch.from_arrays(columns, ["token", "cls", "n", "mask"])

    return classes.select("cls", "n", "sig").mapInArrow(tidy(run), "token long, cls long, n long, mask long")


def _still_open(lists: DataFrame, label: DataFrame | None, order: Column) -> tuple[DataFrame, int]:
    """The posting lists whose members lie in different components by now, and their size.

    Members come with what is known of their list: its leader, the least by ``order``; salts,
    so many bits of a member's hash as cut the leader's members into groups of about GROUP; and
    the list's blocks. That is written before it is joined to the members, so that Spark can
    split the join on a frequent token.
    """
    members = ["token", "cls", "n", "mask"]
    if label is None:
        now = stored(lists.withColumn("component", F.col("cls")))
    else:
        now = stored(lists.select(*members).join(label, F.col("cls") == F.col("node"), "left").select(*members, F.coalesce("component", "cls").alias("component")))
    size = F.count(F.lit(1))
    tokens = now.groupBy("token").agg(
        F.min("component").alias("x"),
        F.max("component").alias("y"),
        F.min(F.struct(order.alias("o"), "cls", "n", "component")).alias("lead"),
        F.greatest(F.ceil(F.log2(size / GROUP)), F.lit(0)).cast("int").alias("salts"),
        F.ceil(size / BLOCK).cast("int").alias("blocks"),
    )
    tokens = stored(tokens.where("x <> y").drop("x", "y"))
    kept = stored(now.join(tokens, "token"))
    discard(now)
    discard(tokens)
    return kept, kept.count()


def _led(posted: DataFrame) -> DataFrame:
    """(a, b, na, nb, salts): each member of a list with the list's leader, where their components differ."""
    return posted.where("component <> lead.component").select(F.col("lead.cls").alias("a"), F.col("cls").alias("b"), F.col("lead.n").alias("na"), F.col("n").alias("nb"), "salts")


def _blocks(posted: DataFrame) -> DataFrame:
    """Members of lists dealt to blocks of about BLOCK, a row for each pair of blocks (i <= j) that needs the member."""
    own = F.pmod(F.xxhash64("cls", F.lit(99)), F.col("blocks")).cast("int")
    dealt = posted.withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    return dealt.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other")}).drop("other")


def _candidates(table: pa.Table, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (x, y) of one list's blocks whose members lie in different components, fit in size and agree
    in MATCHES coordinates, each pair in the list of the lowest coordinate that both prefixes share only."""
    i, j = table["i"][0].as_py(), table["j"][0].as_py()
    own, cls, n, mask, comp = (table[c].to_numpy() for c in ("own", "cls", "n", "mask", "component"))
    sig = table["sig"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, COORDINATES)
    here = int(table["token"][0].as_py()) >> 32 & 0xFFFFFFFF
    left, right = np.flatnonzero(own == i), np.flatnonzero(own == j)
    weight = 1 << np.arange(COORDINATES, dtype=np.int64)
    xs, ys = [], []
    for at in range(0, len(left), 64):
        a = left[at : at + 64]
        fits = (comp[a][:, None] != comp[right]) & (100 * np.minimum(n[a][:, None], n[right]) >= percent * np.maximum(n[a][:, None], n[right]))
        if i == j:
            fits &= cls[a][:, None] < cls[right]
        p, q = np.nonzero(fits)
        p, q = a[p], right[q]
        same = sig[p] == sig[q]
        keep = same.sum(1) >= MATCHES
        p, q, same = p[keep], q[keep], same[keep]
        shared = (same @ weight) & mask[p] & mask[q]
        first = (shared & -shared) == (1 << here)
        xs.append(p[first])
        ys.append(q[first])
    return np.concatenate(xs or [[]]).astype(int), np.concatenate(ys or [[]]).astype(int)


def _residual(posted: DataFrame, classes: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Links that join all members of a list which links of its members can join.

    Candidates are found inside the tasks. Lists with few of them emit pairs, confirmed like
    the leaders'. A list with many, a cloud of documents around the threshold, gets its
    members' texts instead, and its tasks emit links alone: of each block those that join
    members not yet joined.
    """
    rows = _blocks(posted.join(classes.select("cls", "sig"), "cls"))
    columns = ["token", "i", "j", "own", "cls", "n", "mask", "component", "sig", "blocks"]
    #: a member's pairs in a block, at most DENSE * 2 * BLOCK, are confirmed in groups too
    more = max(0, int(np.ceil(np.log2(BLOCK / GROUP))))

    def sparse(key: tuple, table: pa.Table) -> pa.Table:
        x, y = _candidates(table, percent)
        cls = table["cls"].to_numpy()
        many = len(x) > DENSE * table.num_rows
        a, b = ([None], [None]) if many else (cls[x], cls[y])
        salts = more + int(table["blocks"][0].as_py()).bit_length() - 1
        return pa.table([pa.array([key[0].as_py()] * len(a), pa.int64()), pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([salts] * len(a), pa.int32())], names=["token", "a", "b", "salts"])

    found = stored(rows.select(*columns).groupBy("token", "i", "j").applyInArrow(sparse, "token long, a long, b long, salts int"))
    links = _confirmed(found.where("a IS NOT NULL").select("a", "b", "salts"), docs, size, percent)
    clouds = found.where("a IS NULL").select("token").distinct()
    if clouds.isEmpty():
        return links
    members = rows.select(*columns).join(clouds, "token", "left_semi")
    texts = _texts(docs, members.select("cls"))

    def dense(key: tuple, table: pa.Table) -> pa.Table:
        import zstandard

        x, y = _candidates(table, percent)
        inflate = zstandard.ZstdDecompressor().decompress
        number = Numbers()
        sets = [number.all(shingles(inflate(p), size)) for p in table["packed"].to_pylist()]
        root = list(range(len(sets)))
        links = []
        for p, q in zip(x.tolist(), y.tolist(), strict=True):
            at, to = _root(root, p), _root(root, q)
            if at != to:
                both = len(np.intersect1d(sets[p], sets[q], assume_unique=True))
                if 100 * both >= percent * (len(sets[p]) + len(sets[q]) - both):
                    root[at] = to
                    links.append((p, q))
        cls = table["cls"].to_numpy()
        hit = np.array(links, int).reshape(-1, 2)
        return pa.table([pa.array(cls[hit[:, 0]]), pa.array(cls[hit[:, 1]])], names=["a", "b"])

    return links.union(members.join(texts.dropDuplicates(["cls"]), "cls").select(*columns, "packed").groupBy("token", "i", "j").applyInArrow(dense, "a long, b long"))


class Numbers(dict):
    """Numbers for shingles, each its own."""

    def __missing__(self, key: bytes) -> int:
        number = self[key] = len(self)
        return number

    def all(self, found: list[bytes]) -> np.ndarray:
        return np.unique(np.fromiter(map(self.__getitem__, found), np.int64, len(found)))


def _root(root: list[int], x: int) -> int:
    while root[x] != x:
        root[x] = root[root[x]]
        x = root[x]
    return x


def _matching(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs of fitting sizes whose signatures agree in MATCHES coordinates."""
    fits = pairs.where(100 * F.least("na", "nb") >= percent * F.greatest("na", "nb")).groupBy("a", "b").agg(F.max("salts").alias("salts"))
    of = {x: classes.select(F.col("cls").alias(x), F.col("sig").alias(f"s{x}")) for x in "ab"}
    agree = F.aggregate(F.zip_with("sa", "sb", lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
    return fits.join(of["b"], "b").join(of["a"], "a").where(agree >= MATCHES).select("a", "b", "salts")


def _wanted(ids: DataFrame, bits: int) -> np.ndarray:
    """2**bits bits, packed: those set that the hash of an id in any column points to."""

    def mark(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        own = np.zeros(1 << bits >> 3, np.uint8)
        for batch in batches:
            for column in batch.columns:
                at = _bit(column, bits)
                np.bitwise_or.at(own, at >> 3, np.left_shift(1, at & 7).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([zstandard.ZstdCompressor(level=1).compress(own.tobytes())])], ["bits"])

    import zstandard

    total = np.zeros(1 << bits >> 3, np.uint8)
    for r in ids.coalesce(16).mapInArrow(mark, "bits binary").collect():
        total |= np.frombuffer(zstandard.ZstdDecompressor().decompress(bytes(r["bits"])), np.uint8)
    return total


def _bit(ids: pa.Array, bits: int) -> np.ndarray:
    return (mix(ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(U64)) >> U64(64 - bits)).astype(np.int64)


def _texts(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """cls, and the text compressed, of the documents with these ids, in all columns (and a few others)."""
    bits = min(MOST_WANTED, max(LEAST_WANTED, (16 * len(ids.columns) * ids.count()).bit_length()))
    sent = docs.sparkSession.sparkContext.broadcast(_wanted(ids, bits))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        deflate = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            at = _bit(batch.column(0), bits)
            part = batch.filter(pa.array((sent.value[at >> 3] >> (at & 7).astype(np.uint8) & 1).astype(bool)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([deflate((t or "").encode()) for t in part.column(1).to_pylist()], pa.binary())], ["cls", "packed"])

    return docs.select("doc_id", "text").mapInArrow(tidy(run), "cls long, packed binary")


def _confirmed(matched: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (a, b, salts) whose sets are alike by percent/100, shingle by shingle; many b may share a, the leader."""
    salt = F.expr("xxhash64(b) & (shiftleft(1L, salts) - 1)")
    dealt = matched.withColumn("salt", salt)
    asked = dealt.select(F.col("b").alias("cls"), "a", "salts", "salt", F.lit(True).alias("member"))
    asked = asked.union(dealt.select(F.col("a").alias("cls"), "a", "salts", "salt", F.lit(False).alias("member")).distinct())
    texts = _texts(docs, matched.select("a", "b"))
    rows = asked.join(texts, "cls").select("a", "salts", "salt", "member", "cls", "packed")
    rows = rows.repartition("a", "salts", "salt").sortWithinPartitions("a", "salts", "salt", "member")

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        inflate = zstandard.ZstdDecompressor().decompress
        lead: set[bytes] = set()
        for batch in batches:
            links = []
            a, _, _, member, cls = (c.to_pylist() for c in batch.columns[:5])
            for x, m, y, packed in zip(a, member, cls, batch.column(5), strict=True):
                own = set(shingles(inflate(packed.as_py()), size))
                if not m:
                    lead = own
                    continue
                both = len(lead & own)
                if 100 * both >= percent * (len(lead) + len(own) - both):
                    links.append((x, y))
            yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in links], pa.int64()), pa.array([y for _, y in links], pa.int64())], ["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def near_duplicates(docs: DataFrame, size_words: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id and kept for every document."""
    spark = docs.sparkSession
    of_docs = stored(signed(docs, size_words))
    named = of_docs.where("n_shingles > 0 AND doc_id IS NOT NULL")
    classes = stored(named.groupBy("k1", "k2").agg(F.min("doc_id").alias("cls"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig")))
    lists = _postings(classes, classes.count())
    found = spark.createDataFrame([], "a long, b long")
    label: DataFrame | None = None
    linked = total = 0
    for turn in range(TURNS + 1):
        order = F.xxhash64("cls", "token", F.lit(turn)) if turn else F.col("cls")
        last, (lists, size) = lists, _still_open(lists, label, order)
        if turn:
            discard(last)
        if not size:
            break
        everything = turn == TURNS or turn > 0 and 20 * linked < size
        if everything:
            links = cut_lineage(_residual(lists, classes, docs, size_words, percent))
        else:
            matched = cut_lineage(_matching(_led(lists), classes, percent))
            links = cut_lineage(_confirmed(matched, docs, size_words, percent))
        linked = links.count()
        if linked:
            total += linked
            found = cut_lineage(found.union(links).coalesce(1 + total // LINKS))
            label = components(found)
        free_shuffles(spark)
        if everything:
            break
    if label is None:
        label = spark.createDataFrame([], "node long, component long")
    of_class = classes.select("k1", "k2", "cls").join(label, F.col("cls") == F.col("node"), "left").select("k1", "k2", F.coalesce("component", "cls").alias("class_component"))
    out = of_docs.select("doc_id", "n_shingles", "k1", "k2").join(of_class, ["k1", "k2"], "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("class_component"))
    return out.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
