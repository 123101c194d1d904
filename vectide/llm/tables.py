"""Reading input tables and writing intermediate ones where all executors see them."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vectide.sources.folders import shared_folder

WORD = r"[^\x20\x09-\x0D]+"


#: bytes of the batches in which rows travel to Python
BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", "4m"


def small_batches(spark: SparkSession) -> None:
    """Rows travel to Python in batches of a few megabytes, whatever the length of the texts, unless the session says otherwise."""
    if spark.conf.get(BATCH_BYTES[0], None) is None:
        spark.conf.set(*BATCH_BYTES)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """``df``, written once to the shared folder and read back: lineage ends here and survives lost executors.

    The table is deleted by ``discard``, or when the application ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/stored-{uuid.uuid4().hex}"
    df.write.parquet(path)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(place)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a number of their own each, written so that it lasts, and the name of its column, which no other has."""
    small_batches(docs.sparkSession)
    name = "row"
    while name in (low := {c.lower() for c in docs.columns}) or any(c.startswith(f"{name}_") for c in low):
        name += "x"
    return stored(docs.withColumn(name, F.monotonically_increasing_id())), name


def discard(df: DataFrame) -> None:
    """Delete what ``stored`` wrote for this DataFrame, once nothing reads it any more."""
    spark = df.sparkSession
    place = spark._jvm.org.apache.hadoop.fs.Path(df.stored_at)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def remainder(doc_id: Column, by: int) -> Column:
    """crc32 of the id as text, modulo ``by`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % by


def groups_for(docs: DataFrame, group_bytes: int = 6 << 20, least_docs: int = 50, spread: int = 512) -> int:
    """How many hash groups keep each near ``group_bytes`` of text, from one pass over the sizes."""
    n, size = docs.select(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    return int(max(1, size // group_bytes, min(spread, n // least_docs)))


def grouped(docs: DataFrame, groups: int) -> DataFrame:
    """doc_id and text, dealt to ``groups`` hash groups of documents (column g) that stay together.

    Repeated rows are dealt by the partition that they come from as well, so they fill no group;
    ``docs`` must therefore be a table or read back from one, with the same partitions each time.
    """
    key = F.pmod(F.xxhash64("doc_id", "text", F.spark_partition_id()), F.lit(groups))
    parts = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), min(groups // 2, 20000), 1)
    return docs.select(key.alias("g"), "doc_id", "text").repartition(parts, "g")


#: blocks that one task adds up
FAN = 64


def summed(rows: DataFrame, count: Callable[[Iterable[pa.RecordBatch]], Iterator[tuple[int, np.ndarray]]], size: int, shown: Callable[[int, np.ndarray], bytes]) -> Iterator[tuple[int, bytes]]:
    """Sums of the blocks (number, ``size`` integers) that ``count`` yields in the tasks, each as ``shown`` gives it.

    Blocks travel packed. FAN tasks' blocks of a number are added at a time, in as many rounds
    as it takes, so that no task holds more than those. The last sums come to the driver.
    """
    import zstandard

    def packed(block: np.ndarray) -> bytes:
        kind = np.min_scalar_type(int(block.max(initial=0)))
        return bytes([kind.itemsize]) + zstandard.ZstdCompressor(level=1).compress(block.astype(kind).tobytes())

    def unpacked(raw: bytes) -> np.ndarray:
        return np.frombuffer(zstandard.ZstdDecompressor().decompress(raw[1:]), f"<u{raw[0]}").astype(np.uint64)

    def emit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        for number, block in count(batches):
            if block.any():
                yield pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), pa.array([task], pa.int32()), pa.array([packed(block)], pa.binary())], ["number", "task", "counts"])

    def add(key: tuple, table: pa.Table) -> pa.Table:
        total = np.zeros(size, np.uint64)
        for raw in table["counts"].to_pylist():
            total += unpacked(raw)
        return pa.table([pa.array([k.as_py()], pa.int32()) for k in key] + [pa.array([packed(total)], pa.binary())], names=["number", "task", "counts"])

    schema = "number int, task int, counts binary"
    tasks = rows.rdd.getNumPartitions()
    parts = rows.mapInArrow(emit, schema)
    while tasks > 1:
        parts = parts.withColumn("task", F.floor(F.col("task") / FAN).cast("int")).groupBy("number", "task").applyInArrow(add, schema)
        tasks = -(-tasks // FAN)

    def show(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([shown(k, unpacked(x)) for k, x in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)], pa.binary())], ["number", "shown"])

    for r in parts.mapInArrow(show, "number int, shown binary").collect():
        yield r["number"], bytes(r["shown"])
