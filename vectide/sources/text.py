"""Text sources: vectors as TSV lines, labelled pairs, image files, model lists."""

from __future__ import annotations

import hashlib
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File endings, label names and the default model, as the formats have them.
IMAGE_NAMES = r"\.(png|jpg|jpeg|JPG|JPEG|webp)$"
LABELS = {"entailment": 1, "contradiction": 0}


def read_tsv_vectors(spark: SparkSession, path: str, limit: int | None = None) -> DataFrame:
    """path, embedding from (gzipped) lines ``path TAB json array``; blank and unreadable lines are left out."""
    rows = parse_tsv_vectors(spark.read.text(path))
    return rows.limit(limit) if limit is not None else rows


def parse_tsv_vectors(lines: DataFrame) -> DataFrame:
    cut = F.split("value", "\t", 2)
    rows = lines.select(cut[0].alias("path"), F.from_json(F.get(cut, F.lit(1)), "array<float>").alias("embedding"))
    return rows.where(F.col("embedding").isNotNull())


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """path, content of all image files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").rlike(IMAGE_NAMES)).select("path", "content")


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    """sentence, embedding from JSON lines after a header line."""
    rows = spark.read.schema("sentence string, embeddings array<float>").json(path)
    return rows.where("sentence IS NOT NULL").select("sentence", F.col("embeddings").alias("embedding"))


def read_pair_labels(spark: SparkSession, path: str) -> DataFrame:
    """line, a, b, label (1 or 0) from TSV: label in column 0, sentences in columns 5 and 6; other labels are left out."""
    return parse_pair_labels(spark.read.text(path).withColumn("line", F.monotonically_increasing_id()))


def parse_pair_labels(lines: DataFrame) -> DataFrame:
    """The same from (line, value)."""
    cells = F.split("value", "\t")
    label = F.create_map(*(x for k, v in LABELS.items() for x in (F.lit(k), F.lit(v))))
    return lines.select("line", F.get(cells, F.lit(5)).alias("a"), F.get(cells, F.lit(6)).alias("b"), F.element_at(label, cells[0]).alias("label")).where("label IS NOT NULL")


def write_sentences(rows: DataFrame, path: str) -> None:
    """(sentence, embedding) as JSON lines, a header line first in every file, as ``read_sentences`` takes them."""
    body = F.to_json(F.struct("sentence", F.col("embedding").alias("embeddings")))

    def run(batches):
        import pyarrow as pa

        yield pa.RecordBatch.from_arrays([pa.array(['{"record": "sentences"}'])], ["value"])
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0)], ["value"])

    rows.select(body.alias("value")).mapInArrow(run, "value string").write.text(path)


def models(text: str | None) -> list[dict[str, object]]:
    """Models of a YAML list of flat mappings (name and class required); without one, the default."""
    if text is None:
        return [{"name": "VIT_L_14_336_OPENAI", "class": "CLIP"}]
    out: list[dict[str, object]] = []
    for raw in text.splitlines():
        line = raw.split("#")[0].rstrip()
        if not line.strip() or line.strip() == "---" or line.rstrip().endswith(":"):
            continue
        if line.lstrip().startswith("- "):
            out.append({})
            line = line.lstrip()[2:]
        key, _, value = line.strip().partition(":")
        value = value.strip().strip("\"'")
        out[-1][key.strip()] = int(value) if value.isdigit() else {"true": True, "false": False}.get(value.lower(), value)
    for m in out:
        if not {"name", "class"} <= set(m):
            raise ValueError("a model needs a name and a class")
    return out


AGENT = "vectide"


def fetched(uri: str, timeout: float = 30.0) -> bytes:
    """The bytes behind an http(s) address."""
    from urllib.request import Request, urlopen

    if not uri.startswith(("http://", "https://")):
        raise ValueError(f"not an http address: {uri}")
    with urlopen(Request(uri, headers={"User-Agent": AGENT}), timeout=timeout) as answer:
        return answer.read()


def fetch_images(uris: DataFrame, timeout: float = 30.0) -> DataFrame:
    """uri, content, err_message: each address once, in the tasks; a failure is told in its row."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                try:
                    content, error = fetched(uri, timeout), None
                except Exception as problem:  # reported per row
                    content, error = None, str(problem)
                yield pa.RecordBatch.from_arrays([pa.array([uri]), pa.array([content], pa.binary()), pa.array([error], pa.string())], ["uri", "content", "err_message"])

    return uris.select("uri").distinct().mapInArrow(run, "uri string, content binary, err_message string")


def download(uri: str, path: str, md5: str, timeout: float = 60.0, block: int = 1 << 20) -> str:
    """Bring a file whose MD5 is known to a path. A ``.part`` file left by an earlier try is resumed.

    A server that answers 416 has nothing beyond the part; one that ignores the range sends the whole
    file again. A wrong digest is an error and leaves nothing.
    """
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    if Path(path).exists() and verified(path, md5):
        return path
    part = Path(f"{path}.part")
    have = part.stat().st_size if part.exists() else 0
    headers = {"User-Agent": AGENT} | ({"Range": f"bytes={have}-"} if have else {})
    try:
        with urlopen(Request(uri, headers=headers), timeout=timeout) as answer, part.open("ab" if answer.status == 206 else "wb") as out:
            while got := answer.read(block):
                out.write(got)
    except HTTPError as error:
        if error.code != 416 or not have:
            raise
    if not verified(str(part), md5):
        part.unlink()
        raise ValueError(f"{uri} has another MD5 than {md5}")
    part.rename(path)
    return path


def verified(path: str, md5: str) -> bool:
    """Whether a file has this MD5."""
    digest = hashlib.md5()
    with Path(path).open("rb") as f:
        while block := f.read(1 << 20):
            digest.update(block)
    return digest.hexdigest() == md5.lower()
