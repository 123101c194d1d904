"""Substring dedup with a log-structured fingerprint index.

A window is ``size`` consecutive words of one document. A window whose words
also start anywhere else, in the same document or another, is a repeat, and
every word that a repeat covers is removed. Windows are judged on the input.

Documents are dealt to hash groups. A group posts the distinct hashes of its
windows to hash buckets, as sorted runs. In a bucket the runs of batch after
batch are merge-joined with the historical runs, which are compacted by tiers;
the flags "seen again" go back to the groups as bits in the order of their
runs. Found windows are verified: a second round posts a cryptographic digest of
the words of the flagged windows only, and a window counts if that repeats as well.

A common passage is posted once by each group that holds it, whatever the
number of its copies. Runs of earlier tables, of both rounds, may be given as
``history``: their windows count as seen.

Null and empty texts have no words. Repeated rows, with or without an id, are
documents of their own, so their windows are repeats. A text of any length is one
document of one group. An empty table gives no rows; columns beyond doc_id and text are
not read. ``docs`` must be a table or read back from one: its rows are dealt anew
in each round and must come in the same partitions.
"""

from __future__ import annotations

import hashlib
import math
from hashlib import blake2b
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.llm import runs
from vectide.llm.tables import grouped, groups_for
from vectide.llm.text import U64, Words, spans

SIZE = 35
#: bits of the hash that finds windows, and of the digest that verifies them
FIND_BITS, VERIFY_BITS = 56, 64


class Windows:
    """Window starts of a group of texts and their hashes."""

    def __init__(self, column: pa.ChunkedArray, size: int):
        self.words = Words(column)
        self.size = size
        start = np.zeros(len(self.words) + 1, np.int64)
        lens = self.words.counts
        off = self.words.word_off
        some = lens >= size
        np.add.at(start, off[:-1][some], 1)
        np.add.at(start, off[1:][some] - size + 1, -1)
        self.start = np.flatnonzero(np.cumsum(start[:-1]))

    def hashes(self) -> np.ndarray:
        return spans(self.words.hashes(), self.size)[self.start] >> U64(64 - FIND_BITS)

    def digests(self, only: np.ndarray) -> np.ndarray:
        """Of the words of each chosen window, joined by one space: the first bits of their BLAKE2b digest."""
        start, off = self.start[only], self.words.off
        out = np.zeros(len(start), U64)
        cut = np.searchsorted(start, self.words.word_off)
        for i in np.flatnonzero(np.diff(cut)).tolist():
            words = self.words.data[off[i] : off[i + 1]].tobytes().split()
            text = b" ".join(words)
            at = np.cumsum([0, *map(len, words)]) + np.arange(len(words) + 1)
            first = start[cut[i] : cut[i + 1]] - self.words.word_off[i]
            found = [blake2b(text[a:b], digest_size=VERIFY_BITS // 8).digest() for a, b in zip(at[first].tolist(), (at[first + self.size] - 1).tolist(), strict=True)]
            out[cut[i] : cut[i + 1]] = np.frombuffer(b"".join(found), "<u8")
        return out


def _flagged(keys: np.ndarray, answers: dict[int, bytes], bucket_bits: int, key_bits: int) -> np.ndarray:
    """The sorted distinct keys of a group that its answers call repeats."""
    cuts = runs.bucket_cuts(keys, bucket_bits, key_bits)
    hit = np.zeros(len(keys), bool)
    for b in np.flatnonzero(np.diff(cuts)):
        hit[cuts[b] : cuts[b + 1]] = runs.unbits(answers[int(b)], int(cuts[b + 1] - cuts[b]))
    return keys[hit]


def _among(h: np.ndarray, sorted_keys: np.ndarray) -> np.ndarray:
    if not len(sorted_keys):
        return np.zeros(len(h), bool)
    return sorted_keys[np.minimum(np.searchsorted(sorted_keys, h), len(sorted_keys) - 1)] == h


def _answers(table: pa.Table, phase: int) -> dict[int, bytes]:
    if not table.num_rows:
        return {}
    return {b: a for b, a, p in zip(table["bucket"].to_pylist(), table["answer"].to_pylist(), table["phase"].to_pylist(), strict=True) if p == phase}


def _posted(g: int, h: np.ndarray, bucket_bits: int, key_bits: int) -> pa.Table:
    keys, n = np.unique(h, return_counts=True)
    return runs.posts(g, keys, n > 1, bucket_bits, key_bits, runs.bits)


def _merge(phase: int):
    """The bucket's work: runs in, flags per run out. Rows of group -1 are historical runs."""

    def merge(key: tuple, table: pa.Table) -> pa.Table:
        g, keys, extra = (table[c].to_pylist() for c in ("g", "keys", "extra"))
        order = sorted(range(len(g)), key=lambda i: g[i])
        index = runs.RunIndex()
        for k, again in runs.batches_of((keys[i] for i in order), (extra[i] for i in order)):
            index.ingest(k, again)
        known, again = index.compact()
        mine = [i for i in order if g[i] >= 0]
        out = []
        for i in mine:
            out.append(runs.bits(again[np.searchsorted(known, runs.unpack(keys[i]))]))
        n = len(mine)
        return pa.table(
            [pa.array([g[i] for i in mine], pa.int64()), pa.array([key[0].as_py()] * n, pa.int32()), pa.array([phase] * n, pa.int32()), pa.array(out, pa.binary())],
            names=["g", "bucket", "phase", "answer"],
        )

    return merge


ANSWER = "g long, bucket int, phase int, answer binary"


RUN = f"{runs.POST}, phase int"


def index_run(docs: DataFrame, size: int = SIZE, bucket_bits: int = 8, history: DataFrame | None = None) -> DataFrame:
    """Compacted runs per bucket of a table's windows (and of ``history``), to be kept as later tables' history.

    Phase 1 has the hashes, phase 2 the digests.
    """
    dealt = grouped(docs, groups_for(docs))

    def post(key: tuple, table: pa.Table) -> pa.Table:
        windows, g = Windows(table["text"], size), key[0].as_py()
        both = (_posted(g, windows.hashes(), bucket_bits, FIND_BITS), _posted(g, windows.digests(np.arange(len(windows.start))), bucket_bits, VERIFY_BITS))
        return pa.concat_tables([t.append_column("phase", pa.array([i + 1] * t.num_rows, pa.int32())) for i, t in enumerate(both)])

    posted = dealt.groupBy("g").applyInArrow(post, RUN)
    if history is not None:
        posted = posted.unionByName(history)

    def compact(key: tuple, table: pa.Table) -> pa.Table:
        index = runs.RunIndex()
        for k, again in runs.batches_of(table["keys"].to_pylist(), table["extra"].to_pylist()):
            index.ingest(k, again)
        known, again = index.compact()
        bucket, phase = (pa.array([k.as_py()], pa.int32()) for k in key)
        return pa.table([pa.array([-1], pa.int64()), bucket, pa.array([runs.pack(known)], pa.binary()), pa.array([runs.bits(again)], pa.binary()), phase], names=["g", "bucket", "keys", "extra", "phase"])

    return posted.groupBy("bucket", "phase").applyInArrow(compact, RUN)


def remove_repeats(docs: DataFrame, size: int = SIZE, history: DataFrame | None = None, bucket_bits: int | None = None, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and the kept text) of every document.

    ``history``: runs from ``index_run`` with the same size and bucket_bits.
    """
    groups = groups_for(docs)
    bits = bucket_bits or max(8, math.ceil(math.log2(groups)))
    dealt = grouped(docs, groups)

    def earlier(posted: DataFrame, phase: int) -> DataFrame:
        return posted if history is None else posted.unionByName(history.where(F.col("phase") == phase).drop("phase"))

    def find(key: tuple, table: pa.Table) -> pa.Table:
        return _posted(key[0].as_py(), Windows(table["text"], size).hashes(), bits, FIND_BITS)

    def found(table: pa.Table, answers: pa.Table) -> tuple[Windows, np.ndarray]:
        windows = Windows(table["text"], size)
        h = windows.hashes()
        return windows, np.flatnonzero(_among(h, _flagged(np.unique(h), _answers(answers, 1), bits, FIND_BITS)))

    def verify(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        windows, hit = found(table, answers)
        return _posted(key[0].as_py(), windows.digests(hit), bits, VERIFY_BITS)

    def finish(key: tuple, table: pa.Table, answers: pa.Table) -> pa.Table:
        windows, hit = found(table, answers)
        h = windows.digests(hit)
        hit = hit[_among(h, _flagged(np.unique(h), _answers(answers, 2), bits, VERIFY_BITS))]
        edge = np.zeros(len(windows.words) + 1, np.int32)
        np.add.at(edge, windows.start[hit], 1)
        np.add.at(edge, windows.start[hit] + size, -1)
        keep = np.cumsum(edge[:-1]) == 0
        off = windows.words.word_off
        data, at = windows.words.data.tobytes(), windows.words.off.tolist()
        sha, texts, removed = [], [], []
        for i, (a, b) in enumerate(zip(off[:-1].tolist(), off[1:].tolist(), strict=True)):
            words = data[at[i] : at[i + 1]].split()
            mine = keep[a:b]
            gone = b - a - int(mine.sum())
            kept = b" ".join(compress(words, mine.tolist()) if gone else words)
            removed.append(gone)
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode())
        columns = [table["doc_id"], pa.array(windows.words.counts), pa.array(removed, pa.int64()), pa.array(sha, pa.string())]
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        return pa.table([*columns, pa.array(texts, pa.string())] if with_text else columns, names=[*names, "text"] if with_text else names)

    answers = earlier(dealt.groupBy("g").applyInArrow(find, runs.POST), 1).groupBy("bucket").applyInArrow(_merge(1), ANSWER)
    again = dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(verify, runs.POST)
    answers = answers.union(earlier(again, 2).groupBy("bucket").applyInArrow(_merge(2), ANSWER))
    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", text string" * with_text
    return dealt.groupBy("g").cogroup(answers.groupBy("g")).applyInArrow(finish, schema)
