"""Sorted immutable runs of hashes, packed, and a log-structured index over them.

Groups of documents post their distinct hashes to hash buckets as sorted runs.
A bucket merge-joins the runs of each new batch with its historical runs and
compacts runs of similar size. Answers go back by group in the order of the
run, so no hash travels twice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from vectide.llm.text import U64

POST = "g long, bucket int, keys binary, extra binary"


def pack(keys: np.ndarray) -> bytes:
    """Sorted 64-bit keys as byte planes of their differences."""
    if not len(keys):
        return b""
    step = np.diff(keys, prepend=U64(0))
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    planes = step.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T
    return bytes([width]) + np.ascontiguousarray(planes).tobytes()


def unpack(raw: bytes) -> np.ndarray:
    if not raw:
        return np.zeros(0, U64)
    width = raw[0]
    planes = np.frombuffer(raw, np.uint8, offset=1).reshape(width, -1)
    step = np.zeros((planes.shape[1], 8), np.uint8)
    step[:, :width] = planes.T
    return np.cumsum(step.view("<u8").reshape(-1), dtype=U64)


def bucket_cuts(keys: np.ndarray, bucket_bits: int, key_bits: int) -> np.ndarray:
    """Where each bucket (the top bits) starts in sorted keys of ``key_bits`` bits."""
    bounds = np.arange((1 << bucket_bits) + 1, dtype=np.float64) * 2.0 ** (key_bits - bucket_bits)
    cuts = np.searchsorted(keys, bounds[:-1].astype(U64))
    return np.append(cuts, len(keys))


def posts(g: int, keys: np.ndarray, extra: np.ndarray, bucket_bits: int, key_bits: int, pack_extra) -> pa.Table:
    """Rows of POST for the sorted distinct keys of group g."""
    cuts = bucket_cuts(keys, bucket_bits, key_bits)
    low = keys & U64((1 << (key_bits - bucket_bits)) - 1)
    used = np.flatnonzero(np.diff(cuts))
    return pa.table(
        [
            pa.array(np.full(len(used), g)),
            pa.array(used.astype(np.int32)),
            pa.array([pack(low[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
            pa.array([pack_extra(extra[cuts[b] : cuts[b + 1]]) for b in used], pa.binary()),
        ],
        names=["g", "bucket", "keys", "extra"],
    )


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def unbits(raw: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(raw, np.uint8), count=n).astype(bool)


class RunIndex:
    """Which keys were seen twice: runs of (sorted keys, seen again), merged by size tiers."""

    #: so many runs of a tier are compacted into one of the next
    FAN = 4

    def __init__(self) -> None:
        self.tiers: list[list[tuple[np.ndarray, np.ndarray]]] = []

    def ingest(self, keys: np.ndarray, again: np.ndarray) -> None:
        """Merge-join a sorted batch with every run; what no run holds becomes a run."""
        new = np.ones(len(keys), bool)
        for tier in self.tiers:
            for old, seen in tier:
                at = np.minimum(np.searchsorted(old, keys), len(old) - 1)
                hit = old[at] == keys
                seen[at[hit]] = True
                new &= ~hit
        self._put(0, keys[new], again[new])

    def _put(self, level: int, keys: np.ndarray, again: np.ndarray) -> None:
        if not len(keys):
            return
        while len(self.tiers) <= level:
            self.tiers.append([])
        self.tiers[level].append((keys, again.copy()))
        if len(self.tiers[level]) >= self.FAN:
            runs, self.tiers[level] = self.tiers[level], []
            self._put(level + 1, *merged(runs))

    def compact(self) -> tuple[np.ndarray, np.ndarray]:
        return merged([r for tier in self.tiers for r in tier])


def merged(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One sorted run of runs without common keys."""
    if not runs:
        return np.zeros(0, U64), np.zeros(0, bool)
    keys, again = (np.concatenate(x) for x in zip(*runs, strict=True))
    order = np.argsort(keys, kind="stable")
    return keys[order], again[order]


def batches_of(keys: Iterable[bytes], again: Iterable[bytes], size: int = 1 << 16) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Posted runs gathered to batches of about ``size`` keys, each sorted, equal keys joined."""
    hold: list[tuple[np.ndarray, np.ndarray]] = []
    n = 0

    def joined() -> tuple[np.ndarray, np.ndarray]:
        k, a = (np.concatenate(x) for x in zip(*hold, strict=True))
        order = np.argsort(k, kind="stable")
        k, a = k[order], a[order]
        first = np.ones(len(k), bool)
        first[1:] = k[1:] != k[:-1]
        where = np.flatnonzero(first)
        return k[where], np.logical_or.reduceat(a, where) | (np.diff(where, append=len(k)) > 1)

    for raw, flag in zip(keys, again, strict=True):
        k = unpack(raw)
        hold.append((k, unbits(flag, len(k))))
        n += len(k)
        if n >= size:
            yield joined()
            hold, n = [], 0
    if hold:
        yield joined()
