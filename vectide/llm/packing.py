"""Packing documents into training sequences by cutting-stock column generation.

A document's ids (with an end id) are cut at every ``capacity`` ids; the
pieces' lengths form a histogram of at most a few hundred classes: exact below
2 * EXACT ids, and beyond rounded up by less than 1 in EXACT, and by less than
``UNIT`` ids. A linear program over patterns (how many pieces of each
class share a sequence) is solved by column generation: a knapsack dynamic
program over the dual prices finds the next pattern. Patterns are rounded down
and the few pieces left are packed greedily. Pieces are ranked within their
class, and ranks map to patterns, copies and places.

Only the histogram reaches the driver: its size does not depend on the data.
Null and empty texts are one piece, the end id. Repeated rows and rows without an id are packed
each. A very long text is encoded whole and gives as many pieces as it takes. Columns beyond
doc_id and text are not read. An empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vectide.llm.tables import stored
from vectide.llm.text import pieces, tidy
from vectide.llm.tokens import default_tokenizer, tokenizer

CAPACITY, UNIT, END_ID = 4096, 16, 2
#: lengths from EXACT * 2, 4, 8 ... ids are rounded up to multiples of 2, 4, 8 ... (of UNIT at most)
EXACT = 64


def knapsack(price: np.ndarray, width: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items that fits: its value and the count of each item."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    many = np.ones(capacity + 1, np.int64)
    # an item is of use if no narrower one is worth as much
    useful = np.flatnonzero(price > np.maximum.accumulate(np.append(0, price[:-1])) + 1e-12)
    for i in useful[np.argsort(-price[useful] / width[useful], kind="stable")]:
        n = 1
        while (w := n * int(width[i])) <= capacity:  # n copies at once, n = 1, 2, 4, ...: together any number
            value = best[:-w] + n * price[i]
            better = np.flatnonzero(value > best[w:] + 1e-12)
            if n == 1 and not len(better):
                break
            best[w + better] = value[better]
            took[w + better], many[w + better] = i, n
            n *= 2
    count = np.zeros(len(width), np.int64)
    c = capacity
    while c > 0 and took[c] >= 0:
        i, n = took[c], many[c]
        count[i] += n
        c -= n * width[i]
    return float(best[capacity]), count


def patterns(demand: np.ndarray, width: np.ndarray, capacity: int, gap: float = 1e-4, most: int = 5000) -> tuple[np.ndarray, np.ndarray]:
    """Columns (one pattern each) and how often the linear program uses them.

    Revised simplex: the basis inverse is updated by each new column. It ends when
    no pattern's dual value exceeds 1 + gap, which bounds the distance to the optimum.
    """
    m = len(width)
    columns = np.diag(capacity // width).astype(float)
    inverse = np.diag(1 / np.diag(columns))
    x = inverse @ demand
    for _ in range(most):
        price = np.maximum(inverse.sum(0), 0)
        value, column = knapsack(price, width, capacity)
        if value <= 1 + gap:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        t = ratio[out]
        x = np.maximum(x - t * step, 0)
        x[out] = t
        pivot = inverse[out] / step[out]
        inverse -= np.outer(step, pivot)
        inverse[out] = pivot
        columns[:, out] = column
    return columns.astype(np.int64), x


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, np.ndarray]]:
    """(copies, pieces of each class in order of width) for a histogram width -> pieces."""
    if not counts:
        return []
    width = np.array(sorted(counts))
    demand = np.array([counts[int(w)] for w in width])
    columns, x = patterns(demand.astype(float), width, capacity)
    left = demand.copy()
    out = []
    for i in np.argsort(-x):
        column = columns[:, i]
        fits = int(min([int(x[i] + 1e-6), *(left[column > 0] // column[column > 0])]))
        if fits > 0:
            out.append((fits, column))
            left = left - fits * column
    while left.any():
        column, room = np.zeros(len(width), np.int64), capacity
        for i in range(len(width) - 1, -1, -1):
            column[i] = min(left[i], room // width[i])
            room -= column[i] * width[i]
        fits = int((left[column > 0] // column[column > 0]).min())
        out.append((fits, column))
        left = left - fits * column
    return out


class Places:
    """Where the piece of a class with a rank goes: its sequence, by the plan."""

    def __init__(self, counts: dict[int, int], capacity: int):
        width = sorted(counts)
        bounds: dict[int, list[tuple[int, int, int]]] = {w: [] for w in width}
        self.sequences = 0
        seen = dict.fromkeys(width, 0)
        for copies, column in plan(counts, capacity):
            for w, n in zip(width, column.tolist(), strict=True):
                if n:
                    bounds[w].append((seen[w], self.sequences, n))
                    seen[w] += n * copies
            self.sequences += copies
        self.table = {w: np.array(b, np.int64) for w, b in bounds.items()}

    def __call__(self, width: np.ndarray, rank: np.ndarray) -> np.ndarray:
        out = np.zeros(len(width), np.int64)
        for w in np.unique(width):
            mine = width == w
            table = self.table[int(w)]
            row = table[np.searchsorted(table[:, 0], rank[mine], side="right") - 1]
            out[mine] = row[:, 1] + (rank[mine] - row[:, 0]) // row[:, 2]
        return out


def cut(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens (and ids).

    With ``keep_words`` workers keep their tokenizer and table of words (some 60 MB) for their next tasks.
    """
    path = path or default_tokenizer()

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokenizer(path)
        for piece in pieces(batches):
            ids, off = encoder.encode(piece.column(1))
            names, start, length, crc, total, kept = [], [], [], [], [], []
            for i, (doc_id, a, b) in enumerate(zip(piece.column(0).to_pylist(), off[:-1].tolist(), off[1:].tolist(), strict=True)):
                own = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                raw = memoryview(own.tobytes())
                for at in range(0, len(own), capacity):
                    n = min(capacity, len(own) - at)
                    names.append(doc_id)
                    start.append(at)
                    length.append(n)
                    crc.append(zlib.crc32(raw[4 * at : 4 * (at + n)]))
                    total.append(len(own))
                    if with_ids:
                        kept.append(own[at : at + n].astype(np.int32))
            columns = [pa.array(c, pa.int64()) for c in (names, start, length, crc, total)]
            fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:
                columns.append(pa.array(kept, pa.list_(pa.int32())))
                fields.append("ids")
            yield pa.RecordBatch.from_arrays(columns, fields)
        if not keep_words:
            tokenizer.cache_clear()

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(tidy(run), schema)


def class_width(length: Column, capacity: int = CAPACITY, unit: int = UNIT) -> Column:
    """What a piece is charged in the plan: its length, rounded up if long."""
    step, size = F.lit(1), 2
    while size <= unit:
        step = F.when(length >= EXACT * size, size).otherwise(step)
        size *= 2
    return F.least(F.ceil(length / step) * step, F.lit(capacity)).cast("int")


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, unit: int = UNIT, end_id: int = END_ID, with_ids: bool = False, keep_words: bool = True) -> DataFrame:
    """The pieces of ``cut`` with their sequence_id and offset in it."""
    width = class_width(F.col("length"), capacity, unit)
    # each piece has a number of its own, so that neither equal rows nor rows without an id fill a block
    cuts = stored(cut(docs, path, capacity, end_id, with_ids, keep_words).withColumns({"width": width, "piece": F.monotonically_increasing_id()}))
    blocks = max(1, min(100_000, cuts.count() // 2000))
    cuts = cuts.withColumn("block", F.pmod(F.xxhash64("piece"), F.lit(blocks)).cast("int"))
    counted = cuts.groupBy("block", "width").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["width"]: r["n"] for r in counted.groupBy("width").agg(F.sum("n").alias("n")).collect()}
    places = Places(histogram, capacity)
    before = Window.partitionBy("width").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counted.select("block", "width", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("block", "width").orderBy("piece")
    ranked = cuts.withColumn("rank", F.row_number().over(inside) - 1).join(starts, ["block", "width"]).withColumn("rank", F.col("rank") + F.col("before")).drop("before", "block", "piece")

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = places(batch.column(names.index("width")).to_numpy(), batch.column(names.index("rank")).to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(at)], [*names, "sequence_id"])

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in ranked.schema.fields)
    placed = ranked.mapInArrow(tidy(place), f"{fields}, sequence_id long")
    earlier = Window.partitionBy("sequence_id").orderBy(F.desc("width"), "rank").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("width", "rank")
