"""JSON documents to (document, field, element) rows.

Nested keys join with dots; arrays add no index to the key. Values that reach
one key are numbered in order; a key with one value is a scalar, whatever it
came from. Empty objects and arrays vanish, null is a value.
"""

from __future__ import annotations

import json
from collections.abc import Iterable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.functions.strings import element_id

SCHEMA = "doc_id string, field string, idx long, n long, kind string, value string"


def walk(value: Any, path: str = "") -> Iterator[tuple[str, Any]]:
    """(dotted key, leaf) in document order."""
    if isinstance(value, dict):
        for key, inner in value.items():
            yield from walk(inner, f"{path}.{key}" if path else key)
    elif isinstance(value, list):
        for inner in value:
            yield from walk(inner, path)
    else:
        yield path, value


def flat(document: dict[str, Any]) -> dict[str, Any]:
    """The flattened document: scalars, or arrays where a key has several values."""
    out: dict[str, list[Any]] = {}
    for key, leaf in walk(document):
        out.setdefault(key, []).append(leaf)
    return {k: v[0] if len(v) == 1 else v for k, v in out.items()}


def kind(value: Any) -> str:
    if value is None:
        return "null"
    return {bool: "bool", int: "number", float: "number", str: "string"}[type(value)]


def parse(text: str) -> list[dict[str, Any]]:
    """An object, or an array of objects; anything else is an error."""
    found = json.loads(text)
    many = found if isinstance(found, list) else [found]
    if not all(isinstance(x, dict) for x in many):
        raise ValueError("a document must be a JSON object or an array of objects")
    return many


def flatten(docs: DataFrame) -> DataFrame:
    """Rows of SCHEMA from (doc_id, doc), doc one JSON object. Null documents give no rows."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "field", "idx", "n", "kind", "value"]
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for field, value in flat(parse(text)[0]).items() if text is not None else ():
                    many = value if isinstance(value, list) else [value]
                    rows += [(doc_id, field, i, len(many), kind(v), v if isinstance(v, str) else json.dumps(v)) for i, v in enumerate(many)]
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 6
            kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names)

    return docs.select(F.col("doc_id").cast("string"), "doc").mapInArrow(run, SCHEMA)


def exploded(requests: DataFrame, batch: str = "batch") -> DataFrame:
    """(doc_id, doc, request, place) from requests (``batch``, body) that hold an object or an array of objects each.

    A document's id is its string ``_id``; without one it gets one that depends on the
    request and its place. An ``_id`` of another type is an error.
    """
    from hashlib import md5

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, docs, request, place = [], [], [], []
            for name, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for i, doc in enumerate(parse(body)):
                    own = doc.get("_id")
                    if own is not None and not isinstance(own, str):
                        raise ValueError("_id must be a string")
                    ids.append(own or md5(f"{name}\x1f{i}".encode()).hexdigest()[:16].upper())
                    docs.append(json.dumps(doc, ensure_ascii=False))
                    request.append(name)
                    place.append(i)
            columns = [pa.array(ids, pa.string()), pa.array(docs, pa.string()), pa.array(request, pa.string()), pa.array(place, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "doc", "request", "place"])

    return requests.select(F.col(batch).cast("string"), "body").mapInArrow(run, "doc_id string, doc string, request string, place long")


def embeddable(flat_rows: DataFrame) -> DataFrame:
    """The string elements of every field but ``_id``; indices count all elements."""
    return flat_rows.where("field <> '_id' AND kind = 'string'").select("doc_id", "field", "idx", "n", "value")


def with_element_ids(rows: DataFrame) -> DataFrame:
    return rows.withColumn("eid", element_id(F.col("doc_id"), F.col("idx"), F.col("n") == 1))
