"""Media columns: texts stored as progressive JPEGs and read back.

``store`` gives each text's bytes, filled with zero bytes to a positive
multiple of 64, as a lossless progressive JPEG (see ``jpeg``). ``read`` decodes
a column of JPEGs. Null texts count as empty, null media gives nulls. Equal texts give equal
media, row by row, with or without an id. A very long text becomes one tall image. Columns
beyond doc_id and text are not read; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vectide.llm import jpeg
from vectide.llm.text import pieces


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (the JPEG) of every text."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for piece in pieces(batches, limit=512 << 10):
            raw = [(t or "").encode() for t in piece.column(1).to_pylist()]
            filled = [r.ljust(max(1, -(-len(r) // 64)) * 64, b"\0") for r in raw]
            yield pa.RecordBatch.from_arrays([piece.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array(jpeg.encode(filled), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, media binary")


def _read(batch: pa.RecordBatch, size: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, jpeg.Reader]]:
    """Rows with media, about ``size`` bytes at a time, decoded."""
    for piece in pieces([batch], "media", size):
        yield piece, jpeg.Reader(piece.column(piece.schema.get_field_index("media")).to_pylist())


def features(reader: jpeg.Reader) -> list[str]:
    """Of each stored image: its size, and mean and spread of each colour over the full-resolution RGB."""
    tiles = reader.tiles(reader.samples()).reshape(3, -1, 256)
    units = np.array([i.shape.blocks // 6 for i in reader.images])
    first = np.cumsum(units) - units
    total = np.add.reduceat(tiles.sum(2, dtype=np.int32).T.astype(np.int64), first)
    wide = tiles.astype(np.float32)
    square = np.add.reduceat(np.einsum("cni,cni->nc", wide, wide).astype(np.float64), first)
    n = (units * 256)[:, None]
    mean = total / n
    spread = np.sqrt(np.maximum(square / n - mean * mean, 0))
    return [f"{i.shape.width}x{i.shape.height}:" + ",".join(f"{m:.2f}/{s:.2f}" for m, s in zip(a, b, strict=True)) for i, a, b in zip(reader.images, mean, spread, strict=True)]


def digest(media: DataFrame) -> DataFrame:
    """What the stored JPEGs hold, read back: payload and media digests and features."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece, reader in _read(batch):
                held = [reader.payload(i) for i in range(piece.num_rows)]
                blobs = piece.column(2).to_pylist()
                columns = [
                    pa.array([len(p) for p in held], pa.int64()),
                    pa.array([hashlib.sha256(p).hexdigest() for p in held]),
                    pa.array([zlib.crc32(p[-64:]) for p in held], pa.int64()),
                    pa.array([len(b) for b in blobs], pa.int64()),
                    pa.array([hashlib.sha256(b).hexdigest() for b in blobs]),
                    pa.array(features(reader)),
                ]
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), *columns], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.mapInArrow(run, schema)


def tensors(media: DataFrame) -> DataFrame:
    """doc_id, height, width and rgb (bytes, row by row, three a pixel) of every JPEG in ``media``."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            full = batch.filter(batch.column(1).is_valid())
            for piece, reader in _read(full, 128 << 10):
                samples = reader.samples()
                images = [reader.rgb(i, samples) for i in range(piece.num_rows)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), *(pa.array([x.shape[d] for x in images], pa.int32()) for d in (0, 1)), pa.array([x.tobytes() for x in images], pa.binary())], ["doc_id", "height", "width", "rgb"]
                )
            none = batch.filter(batch.column(1).is_null())
            if none.num_rows:
                n = none.num_rows
                yield pa.RecordBatch.from_arrays([none.column(0), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], ["doc_id", "height", "width", "rgb"])

    return media.select("doc_id", "media").mapInArrow(run, "doc_id long, height int, width int, rgb binary")
