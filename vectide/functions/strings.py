"""String, id and token expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from vectide.types import MAX_ID_BYTES


def canonical_id(text: Column) -> Column:
    """Without trailing NULs, or null if longer than 16 bytes."""
    return F.when(F.octet_length(text) <= MAX_ID_BYTES, F.regexp_replace(text, "\\x00+$", ""))


def element_id(doc_id: Column, index: Column, scalar: Column) -> Column:
    """A scalar field's id is the document's; array elements add their index."""
    return F.when(scalar, doc_id).otherwise(F.concat_ws(":", doc_id, index.cast("string")))


def document_id(element: Column) -> Column:
    return F.split_part(element, F.lit(":"), F.lit(1))


def generated_id(*parts: Column) -> Column:
    """16 characters of 0-9A-F that depend on the parts alone, so that a retried task names a document alike."""
    return F.upper(F.substring(F.md5(F.concat_ws("\x1f", *parts).cast("binary")), 1, 16))


def clean_text(text: Column) -> Column:
    """Trimmed, with runs of white space as one space, lower-cased."""
    return F.lower(F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")))


def pad_tokens(ids: Column, length: int, start: int, end: int, pad: int = 0) -> Column:
    """start, at most length - 2 ids, end, then padding up to length."""
    body = F.slice(ids, 1, length - 2)
    full = F.concat(F.array(F.lit(start)), body, F.array(F.lit(end)))
    return F.concat(full, F.array_repeat(F.lit(pad), F.lit(length) - F.size(full)))


def context_length(mask: Column) -> Column:
    """Tokens of an instruction: those in the mask, without the last."""
    return F.aggregate(mask, F.lit(0), lambda s, x: s + x) - 1


def boosts(weights: Column) -> Column:
    """field -> 1 - weight / sum of weights."""
    total = F.aggregate(F.map_values(weights), F.lit(0.0), lambda s, x: s + x)
    return F.transform_values(weights, lambda _, w: 1 - w / total)
