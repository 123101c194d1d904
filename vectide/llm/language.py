"""Language identification by rank-order profiles.

A language's profile lists its most frequent letter n-grams (one to three code
points, lower-cased, every run of other characters one space) in order of frequency. A
document's own n-grams are all ranked the same way, and the language whose profile
has the smallest out-of-place distance wins: the sum over the document's ``length`` most
frequent n-grams of the difference between the two ranks, at most the profile's length.
An n-gram of no profile costs every language that much; it is left out of the sums, but
keeps its place among the ranks. Equally frequent n-grams of a document are ranked by their
frequency in all profiles, those of no profile last.

Null texts and texts without a letter (Unicode class L) are ``und`` with score 0, as is every
text when no language was learned. Ties go to the language that sorts first. Repeated
rows get equal results. Very long texts are read whole, one at a time. Columns beyond
doc_id, text and lang are not read; an empty table gives no rows.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.text import U64, pieces

#: profile length, and at most so many labelled documents per language, chosen by hash of the id
PROFILE, SAMPLE = 400, 3000
UNKNOWN = "und"
#: ids of sampled documents that may be broadcast
FEW = 1 << 20
#: bits of a code point, plus one; an n-gram is up to three of them
POINT = 21


@lru_cache(maxsize=1)
def letters() -> np.ndarray:
    """Which code points are letters."""
    return np.array([unicodedata.category(chr(c))[0] == "L" for c in range(sys.maxunicode + 1)])


def streams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(text, code point) of all texts' letters in a row, a space before and after each run of them."""
    low = [(t or "").lower() for t in texts]
    points = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    letter = letters()[points]
    begins = letter.copy()
    begins[1:] &= ~(letter[:-1] & (owner[1:] == owner[:-1]))
    first = np.zeros(len(points), bool)  # a text's first run has a space before it, the others share the one between
    first[begins] = np.diff(owner[begins], prepend=-1) != 0
    ends = letter.copy()
    ends[:-1] &= ~(letter[1:] & (owner[1:] == owner[:-1]))
    index = np.flatnonzero(letter)
    size = 1 + first[index] + ends[index].astype(np.int64)
    at = np.cumsum(size) - size + first[index]
    stream = np.full(int(size.sum()), 32, np.uint32)
    stream[at] = points[index]
    return np.repeat(owner[index], size), stream


def grams(owner: np.ndarray, values: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, n-gram) of a stream of values 1 .. 2**bits - 1; 1 is the space, which is no n-gram of its own."""
    v = values.astype(U64)
    two = (v[:-1] << U64(bits)) | v[1:]
    three = (two[:-1] << U64(bits)) | v[2:]
    one, same2, same3 = v != 1, owner[:-1] == owner[1:], owner[:-2] == owner[2:]
    return np.concatenate([owner[one], owner[:-1][same2], owner[:-2][same3]]), np.concatenate([v[one], two[same2], three[same3]])


def counted(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, n-gram as code points, count) of all distinct n-grams of each text."""
    owner, points = streams(texts)
    if not len(points):
        return np.zeros(0, np.int64), np.zeros(0, U64), np.zeros(0, np.int64)
    alphabet = np.unique(np.append(points, np.uint32(32)))
    alphabet = np.append(np.uint32(32), alphabet[alphabet != 32])  # the space is number 1
    number = np.zeros(int(alphabet.max()) + 1, np.uint32)
    number[alphabet] = np.arange(1, len(alphabet) + 1)
    bits = int(len(alphabet)).bit_length()
    if 3 * bits + len(texts).bit_length() > 63:
        half = len(texts) // 2
        a, b = counted(texts[:half]), counted(texts[half:])
        return np.concatenate([a[0], b[0] + half]), np.concatenate([a[1], b[1]]), np.concatenate([a[2], b[2]])
    text, gram = grams(owner, number[points], bits)
    found = pc.value_counts(pa.array((text.astype(U64) << U64(3 * bits)) | gram))
    key, n = found.field(0).to_numpy(), found.field(1).to_numpy()
    whole, mask = np.zeros(len(key), U64), U64((1 << bits) - 1)
    spelled = np.append(np.uint32(0), alphabet + np.uint32(1)).astype(U64)  # 0: no letter there
    for place in (2, 1, 0):
        whole = (whole << U64(POINT)) | spelled[(key >> U64(bits * place)) & mask]
    return (key >> U64(3 * bits)).astype(np.int64), whole, n


def profiles(docs: DataFrame, sample: int = SAMPLE, length: int = PROFILE) -> DataFrame:
    """(lang, code, n, rank) from docs with text and lang, at most ``length`` n-grams per language."""
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    known = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    ids = known.select("lang", "doc_id").withColumn("at", F.row_number().over(order)).where(F.col("at") <= sample).select("doc_id").distinct()
    # a sample for each language: broadcast if there are not too many languages for that
    chosen = known.join(F.broadcast(ids) if ids.count() <= FEW else ids, "doc_id").select("lang", "text")

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches):
            names = piece.column(0).to_pylist()
            langs = sorted(set(names))
            of = np.array([langs.index(x) for x in names])
            text, code, n = counted(piece.column(1).to_pylist())
            for i, lang in enumerate(langs):
                mine = of[text] == i
                keys, back = np.unique(code[mine], return_inverse=True)
                total = np.bincount(back, n[mine], len(keys)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys), pa.string()), pa.array(keys.astype(np.int64)), pa.array(total)], ["lang", "code", "n"])

    total = chosen.mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return total.withColumn("rank", rank).where(F.col("rank") <= length)


def predict(docs: DataFrame, profile: DataFrame, length: int = PROFILE) -> DataFrame:
    """doc_id, lang_pred and score for every document.

    The profiles have ``length`` rows per language and travel with the tasks. The score
    is the runner-up's share of the two smallest distances (0.5: undecided, 1: certain).
    """
    rows = profile.toPandas().sort_values(["lang", "rank"])
    langs = sorted(rows.lang.unique())
    total = rows.groupby("code").n.sum().reset_index().sort_values(["n", "code"], ascending=[False, True]).code.to_numpy(np.int64)
    order = np.argsort(total)
    codes, place = total[order].view(U64), order  # sorted codes, and where each stands by frequency
    ranks = np.full((len(langs), len(total)), 2 * length, np.int32)  # so far off that an n-gram missing in a profile costs most
    number = {c: i for i, c in enumerate(total.tolist())}
    ranks[[langs.index(x) for x in rows.lang], [number[c] for c in rows.code]] = rows["rank"].to_numpy() - 1

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array([*langs, UNKNOWN], object)
        for piece in pieces(batches, limit=512 << 10):
            best, score = np.full(piece.num_rows, -1), np.zeros(piece.num_rows)
            if langs:
                text, code, n = counted(piece.column(1).to_pylist())
                at = np.minimum(np.searchsorted(codes, code), len(codes) - 1)
                known = np.where(codes[at] == code, place[at], len(codes))
                some = np.unique(text)
                best[some], score[some] = (x[some] for x in nearest(text, known, n, piece.num_rows, ranks, length))
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double")


def nearest(text: np.ndarray, known: np.ndarray, n: np.ndarray, texts: int, ranks: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The nearest profile and the score of each text from its distinct n-grams and their counts.

    ``known``: an n-gram's place among those of all profiles, by frequency; beyond the last for others.
    """
    none = ranks.shape[1]
    width = int(none).bit_length()
    rare = n.astype(U64) ^ U64((1 << 32) - 1)  # a text has fewer n-grams than that
    key = np.sort((text.astype(U64) << U64(32 + width)) | (rare << U64(width)) | known.astype(U64))
    text, known = (key >> U64(32 + width)).astype(np.int64), (key & U64((1 << width) - 1)).astype(np.int64)
    first = np.searchsorted(text, np.arange(texts))
    rank = np.arange(len(text)) - first[text]
    use = (rank < length) & (known < none)
    text, known, rank = text[use], known[use], rank[use]
    far = np.stack([np.bincount(text, np.minimum(np.abs(rank - r[known]), length), texts) for r in ranks])
    order = np.argsort(far, axis=0, kind="stable")
    least = np.take_along_axis(far, order[:1], 0)[0]
    # what n-grams of no profile cost is the same for all and left out of the score too
    second = np.take_along_axis(far, order[1:2], 0)[0] if len(ranks) > 1 else least + 1
    total = least + second
    return order[0], np.where(total > 0, second / np.where(total > 0, total, 1), 0.5)
