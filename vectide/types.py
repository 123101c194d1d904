"""Settings, ids and request validation shared by the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

ALIGNMENT = 16
MAX_LIMIT = 1024
MAX_ID_BYTES = 16
LEAST_SEGMENT_ROWS = 1000


class Metric(str, Enum):
    L2 = "l2"
    L1 = "l1"
    COSINE = "cosine"
    HAMMING = "hamming"


class ModelClass(str, Enum):
    CLIP = "clip"
    INSTRUCTOR = "instructor"
    E5 = "e5"
    HASHING = "hashing"


#: what each class of model can encode
CONTENT = {
    ModelClass.CLIP: {"text", "image_uri"},
    ModelClass.INSTRUCTOR: {"text"},
    ModelClass.E5: {"text"},
    ModelClass.HASHING: {"text"},
}


@dataclass(frozen=True)
class CollectionSettings:
    """A collection's metric and geometry do not change after it is created."""

    name: str
    metric: Metric
    dim: int = 768
    segment_kb: int = 1024
    model_class: ModelClass = ModelClass.CLIP
    model_name: str = "VIT_L_14_336_OPENAI"
    index_type: str = "flat"
    fields: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class GraphParams:
    degree: int = 64
    queue: int = 100
    pool: int = 140
    alpha: float = 1.2
    slack: float = 1.3


def aligned(dim: int) -> int:
    """``dim`` rounded up to the vector alignment."""
    return -(-dim // ALIGNMENT) * ALIGNMENT


def rows_per_segment(segment_kb: int, dim: int, kilobyte: int = 1024) -> int:
    """Vectors of a segment; the index in memory counts 1,000 bytes as a kilobyte, the stored one 1,024."""
    return max(LEAST_SEGMENT_ROWS, segment_kb * kilobyte // (aligned(dim) * 4))


def checked_id(text: str) -> str:
    """An external id without trailing NULs; longer than 16 bytes is an error."""
    if len(text.encode()) > MAX_ID_BYTES:
        raise ValueError(f"id {text!r} is longer than {MAX_ID_BYTES} bytes")
    return text.rstrip("\0")


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= MAX_LIMIT:
        raise ValueError(f"limit must be 1 to {MAX_LIMIT}, not {limit}")
    return limit


def checked_content(model_class: ModelClass, kind: str) -> None:
    if kind not in CONTENT[model_class]:
        raise ValueError(f"{model_class.value} models do not encode {kind}")


def chunk_offsets(dim: int, chunks: int) -> list[int]:
    """Where each of ``chunks`` contiguous chunks of ``dim`` dimensions starts; earlier ones take the remainder."""
    small, more = divmod(dim, chunks)
    sizes = [small + (i < more) for i in range(chunks)]
    return [sum(sizes[:i]) for i in range(chunks + 1)]


def ram_estimate(n: int, dim: int, item_bytes: int, degree: int) -> float:
    """Bytes an in-memory graph of ``n`` vectors needs."""
    return 1.1 * (n * dim * item_bytes + n * degree * 8 * 1.2 + n + 4 * n)


def ram_budget(gigabytes: float, cached: float = 0.25, least: float = 0.25) -> float:
    """Bytes for an index when so many gigabytes may be used: a share is kept for cached nodes if enough is left."""
    left = gigabytes - cached
    return (left if left > least else gigabytes) * 2**30
