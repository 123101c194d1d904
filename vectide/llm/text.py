"""Vectorised word scanning over Arrow string columns.

A word is a maximal run of bytes other than space and TAB..CR. The separators
are ASCII, so scanning UTF-8 bytes finds the same words as scanning code
points. Null texts count as empty throughout.
"""

from __future__ import annotations

import contextlib
import ctypes
import functools
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U64 = np.uint64
SEPARATORS = (9, 10, 11, 12, 13, 32)
_IS_SEP = np.zeros(256, bool)
_IS_SEP[list(SEPARATORS)] = True
#: anything but ASCII letters and digits and the bytes of longer characters
_IS_PUNCT = np.ones(256, bool)
_IS_PUNCT[48:58] = _IS_PUNCT[65:91] = _IS_PUNCT[97:123] = _IS_PUNCT[128:] = False
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

_MUL = U64(0x9E3779B97F4A7C15)
#: masks of the first 0..8 bytes of a little-endian number
MASK = np.array([(1 << 8 * i) - 1 for i in range(9)], U64)


def mix(h: np.ndarray) -> np.ndarray:
    """Finalise 64-bit hashes so that every output bit depends on every input bit."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def numbered(h: np.ndarray, bits: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct values of so many bits, where each first is, and the way back.

    Places are sorted along in the low bits; values that differ there alone, hardly ever met, are sorted in full.
    """
    low = U64(len(h).bit_length())
    value = h << U64(64 - bits)
    key = np.sort((value >> low << low) | np.arange(len(h), dtype=U64))
    order = (key & ((U64(1) << low) - U64(1))).astype(np.int64)
    value = value[order]
    if (value[1:] < value[:-1]).any():
        order = np.argsort(h, kind="stable")
        value = h[order] << U64(64 - bits)
    new = np.ones(len(h), bool)
    new[1:] = value[1:] != value[:-1]
    back = np.empty(len(h), np.int64)
    back[order] = np.cumsum(new) - 1
    return value[new] >> U64(64 - bits), order[new], back


def eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place on as one number; zeros follow the last byte."""
    filled = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", filled, strides=(1,))


def slices(data: np.ndarray, start: np.ndarray, size: np.ndarray, seed: int = 0) -> np.ndarray:
    """A 64-bit hash of data[start:start + size] for each pair.

    Each eight bytes are mixed with their place and the results added, so no algebra of the
    bytes carries over. Equal hashes are a strong hint only: what must be exact compares bytes.
    """
    all_eights = eights(data)
    salt = U64((seed * 0xD6E8FEB86659FD93 + 0x5851F42D4C957F2D) & 0xFFFFFFFFFFFFFFFF)
    total = mix((all_eights[start] & MASK[np.minimum(size, 8)]) + salt)
    long = np.flatnonzero(size > 8)
    if len(long):
        more = (size[long] + 7) // 8 - 1
        group, place = ragged(more)
        at = start[long][group] + 8 * (place + 1)
        left = np.minimum(size[long][group] - 8 * (place + 1), 8)
        part = mix((all_eights[at] & MASK[left]) + mix(salt + (place + 1).astype(U64) * _MUL))
        total[long] += np.add.reduceat(part, np.cumsum(more) - more)
    return mix(total + size.astype(U64) * _MUL)


def spans(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of every ``size`` values in a row, by joining halves: len(h) - size + 1 of them."""
    n = max(0, len(h) - size + 1)
    out, at, width = None, 0, 1
    while at < size:
        if size & width:
            part = h[at : at + n]
            out = part if out is None else mix(out * _MUL + (part ^ U64(width)))
            at += width
        if at < size:
            h = mix(h[: max(0, len(h) - width)] * _MUL + (h[width:] ^ U64(width)))
            width *= 2
    return out


class Words:
    """Words of a batch of texts: byte ranges, and each text's range of words.

    With ``plain``, punctuation separates words too.
    """

    def __init__(self, column: pa.Array | pa.ChunkedArray, plain: bool = False):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        if not pa.types.is_large_string(column.type):
            column = column.cast(pa.large_string())
        if column.null_count:
            column = column.fill_null("")
        _, offsets, data = column.buffers()
        n = len(column)
        off = np.frombuffer(offsets, np.int64, n + 1, column.offset * 8) if n else np.zeros(1, np.int64)
        self.data = np.frombuffer(data, np.uint8)[off[0] : off[-1]] if data is not None and n else np.zeros(0, np.uint8)
        self.off = off - off[0]
        inside = ~(_IS_PUNCT if plain else _IS_SEP)[self.data]
        first = inside.copy()
        first[1:] &= ~inside[:-1]
        last = inside.copy()
        last[:-1] &= ~inside[1:]
        edge = self.off[:-1][np.diff(self.off) > 0]
        first[edge] = inside[edge]
        last[edge[1:] - 1] = inside[edge[1:] - 1]
        self.start = np.flatnonzero(first)
        self.end = np.flatnonzero(last) + 1
        #: words of text i are word_off[i] .. word_off[i + 1]
        self.word_off = np.searchsorted(self.start, self.off)

    def __len__(self) -> int:
        return len(self.start)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.word_off)

    @property
    def doc(self) -> np.ndarray:
        """Index of the text of each word."""
        return np.repeat(np.arange(len(self.off) - 1), self.counts)

    def hashes(self, lower: bool = False, seed: int = 0, only: np.ndarray | None = None, size: int = 0) -> np.ndarray:
        """One 64-bit hash per word; with lower, A-Z count as a-z. With ``only``, of the first ``size`` bytes of those words."""
        data = LOWER[self.data] if lower else self.data
        if only is None:
            return slices(data, self.start, self.end - self.start, seed)
        return slices(data, self.start[only], np.full(len(only), size), seed)

    def word(self, i: int) -> bytes:
        return self.data[self.start[i] : self.end[i]].tobytes()


def pieces(batches: Iterable[pa.RecordBatch], text: str = "text", limit: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that each piece holds about ``limit`` text bytes (or one longer text)."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        cut = np.cumsum(_lengths(batch, text)) // limit
        at = [0, *(np.flatnonzero(np.diff(cut)) + 1).tolist(), n]
        for a, b in zip(at[:-1], at[1:], strict=True):
            if b > a:
                yield batch.slice(a, b - a)


def tidy(run: Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which a worker gives back what memory its arrays took: workers wait for their next task for long."""

    @functools.wraps(run)
    def whole(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        with contextlib.suppress(OSError, AttributeError):  # only some C libraries can
            ctypes.CDLL(None).malloc_trim(0)

    return whole


def _lengths(batch: pa.RecordBatch, text: str) -> np.ndarray:
    return pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text))), 0).to_numpy(zero_copy_only=False).astype(np.int64)


def ragged(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For groups of these sizes: each element's group and its place in the group."""
    counts = np.asarray(counts, np.int64)
    group = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return group, np.arange(len(group)) - first[group]


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of values[offsets[i]:offsets[i+1]] (zero for empty ranges)."""
    total = np.concatenate([[0], np.cumsum(values)])
    return total[offsets[1:]] - total[offsets[:-1]]
