"""Binary vector files: fvecs, ivecs and headed matrices, as DataFrames.

Files are read as ``binaryFile`` rows, one task per file; tables larger than a
file should come as many files.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPES = {"f32": (np.dtype("<f4"), "float"), "u32": (np.dtype("<u4"), "long"), "u64": (np.dtype("<u8"), "long"), "u8": (np.dtype("u1"), "smallint")}


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def vecs(raw: bytes, kind: np.dtype) -> np.ndarray:
    """Rows of [u32 dimension][values], all of one dimension."""
    if not raw:
        return np.zeros((0, 0), kind)
    dim = int(np.frombuffer(raw, "<u4", 1)[0])
    width = 4 + dim * kind.itemsize
    if len(raw) % width:
        raise ValueError("not a whole number of vectors of one dimension")
    rows = np.frombuffer(raw, np.uint8).reshape(-1, width)
    if (rows[:, :4] != rows[0, :4]).any():
        raise ValueError("vectors of several dimensions")
    return np.ascontiguousarray(rows[:, 4:]).view(kind)


def matrix(raw: bytes, kind: np.dtype, offset: int = 0) -> np.ndarray:
    """[u32 rows][u32 columns][values], at an offset."""
    n, d = np.frombuffer(raw, "<u4", 2, offset)
    return np.frombuffer(raw, kind, int(n) * int(d), offset + 8).reshape(int(n), int(d))


def _rows(files: DataFrame, parse, sql: str, arrow: pa.DataType) -> DataFrame:
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                m = parse(raw)
                for a in range(0, len(m), 4096):
                    part = m[a : a + 4096]
                    values = pa.ListArray.from_arrays(pa.array(np.arange(len(part) + 1, dtype=np.int32) * m.shape[1]), pa.array(part.reshape(-1)).cast(arrow))
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), pa.array(np.arange(a, a + len(part))), values], ["path", "id", "embedding"])

    return files.mapInArrow(run, f"path string, id long, embedding array<{sql}>")


def packed_vecs(x: np.ndarray) -> bytes:
    """Rows as ``vecs`` reads them."""
    head = np.full((len(x), 1), x.shape[1], "<u4").view(np.uint8)
    return np.concatenate([head, np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1)], 1).tobytes()


def as_files(rows: DataFrame, pack, kind: str = "f4") -> DataFrame:
    """(path, content): the vectors of column embedding, packed to the bytes of a file for every batch that a task holds."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task = TaskContext.get().partitionId()
        for i, batch in enumerate(batches):
            if batch.num_rows:
                x = batch.column(0).flatten().to_numpy(zero_copy_only=False).astype(f"<{kind}").reshape(batch.num_rows, -1)
                yield pa.RecordBatch.from_arrays([pa.array([f"part-{task}-{i}"]), pa.array([pack(x)], pa.binary())], ["path", "content"])

    return rows.select("embedding").mapInArrow(run, "path string, content binary")


def read_fvecs(spark: SparkSession, path: str) -> DataFrame:
    """path, id (ordinal in the file), embedding."""
    return parse_fvecs(_files(spark, path))


def parse_fvecs(files: DataFrame) -> DataFrame:
    return _rows(files, lambda raw: vecs(raw, np.dtype("<f4")), "float", pa.float32())


def read_ivecs(spark: SparkSession, path: str, k: int | None = None) -> DataFrame:
    """query_id, place, id: the first k true neighbours of each query."""
    return parse_ivecs(_files(spark, path), k)


def parse_ivecs(files: DataFrame, k: int | None = None) -> DataFrame:
    rows = _rows(files, lambda raw: vecs(raw, np.dtype("<i4")), "int", pa.int32())
    out = rows.select(F.col("id").alias("query_id"), F.posexplode("embedding").alias("place", "id"))
    return out.where(F.col("place") < k) if k is not None else out


def read_matrix(spark: SparkSession, path: str, kind: str = "f32", offset: int = 0) -> DataFrame:
    """path, id (row in the file), embedding of matrices that begin at an offset."""
    return parse_matrix(_files(spark, path), kind, offset)


def parse_matrix(files: DataFrame, kind: str = "f32", offset: int = 0) -> DataFrame:
    dtype, sql = TYPES[kind]
    arrow = {"float": pa.float32(), "long": pa.int64(), "smallint": pa.int16()}[sql]
    return _rows(files, lambda raw: matrix(raw, dtype, offset), sql, arrow)


def pivots(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(centres x dims, centroid, chunk offsets) of a product quantizer: places of three matrices, as u64, then those."""
    at = matrix(raw, np.dtype("<u8")).reshape(-1)
    centres = matrix(raw, np.dtype("<f4"), int(at[0]))
    centroid, offsets = matrix(raw, np.dtype("<f4"), int(at[1])).reshape(-1), matrix(raw, np.dtype("<u4"), int(at[2])).reshape(-1)
    if len(centroid) != centres.shape[1] or offsets[-1] != centres.shape[1]:
        raise ValueError(f"centres have {centres.shape[1]} dimensions, the centroid {len(centroid)}, the chunks {int(offsets[-1])}")
    return centres, centroid, offsets


def read_pivots(spark: SparkSession, path: str) -> DataFrame:
    """chunk, center, pivot: the codebook in a file of pivots; centred, as its writer took the centroid off."""
    return parse_pivots(_files(spark, path))


def parse_pivots(files: DataFrame) -> DataFrame:

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                centres, _, offsets = pivots(raw)
                for c, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                    n = len(centres)
                    yield pa.RecordBatch.from_arrays([pa.array([c] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(list(centres[:, a:b]), pa.list_(pa.float32()))], ["chunk", "center", "pivot"])

    return files.select("content").mapInArrow(run, "chunk int, center int, pivot array<float>")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """path, id, embedding (a code for each chunk) of files [u32 rows][u32 chunks][u32 codes]."""
    return read_matrix(spark, path, "u32")


def packed_matrix(x: np.ndarray) -> bytes:
    return np.array(x.shape, "<u4").tobytes() + np.ascontiguousarray(x).tobytes()


def packed_pivots(centres: np.ndarray, centroid: np.ndarray, offsets: np.ndarray) -> bytes:
    """What ``pivots`` reads."""
    parts = [packed_matrix(centres.astype("<f4")), packed_matrix(centroid.astype("<f4")[:, None]), packed_matrix(np.asarray(offsets, "<u4")[:, None])]
    head = 8 + 8 * len(parts)
    places = np.array([head + sum(map(len, parts[:i])) for i in range(len(parts))], "<u8")
    return packed_matrix(places[:, None]) + b"".join(parts)


def write_codes(coded: DataFrame, path: str, chunks: int) -> DataFrame:
    """Codes (eid, chunk, center) as files of bytes, one for each partition of eids, with the eids in it: part, eids, content.

    The rows are written as Parquet; ``content`` is in the format of ``read_codes``.
    """
    rows = coded.groupBy("eid").agg(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "center"))), lambda x: x["center"]).alias("codes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(1).flatten().to_numpy().reshape(-1, chunks).astype("<u4")
            yield pa.RecordBatch.from_arrays([pa.array([batch.column(0).cast(pa.string()).to_pylist()], pa.list_(pa.string())), pa.array([packed_matrix(codes)], pa.binary())], ["eids", "content"])

    out = rows.mapInArrow(run, "eids array<string>, content binary")
    out.write.parquet(path)
    return coded.sparkSession.read.schema(out.schema).parquet(path)


def read_bundle(spark: SparkSession, folder: str, name: str = "sift", k: int = 10) -> dict[str, DataFrame]:
    """Base and query vectors and true neighbours of a benchmark folder."""
    return {
        "base": read_fvecs(spark, f"{folder}/{name}_base.fvecs"),
        "query": read_fvecs(spark, f"{folder}/{name}_query.fvecs"),
        "truth": read_ivecs(spark, f"{folder}/{name}_groundtruth.ivecs", k),
    }
