"""Encoding: a registry of embedders, the encode operator, pooling.

An embedder is registered under (class, name) as a function that a task calls
once to load it; what it returns maps a list of inputs to vectors.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectide.types import ModelClass, checked_content

Encode = Callable[[Sequence[str]], np.ndarray]
_loaders: dict[tuple[ModelClass, str], Callable[[], Encode]] = {}

# Mean and deviation of the colours that image models were trained with.
PIXEL_MEAN = (0.48145466, 0.4578275, 0.40821073)
PIXEL_STD = (0.26862954, 0.26130258, 0.27577711)


def register(model_class: ModelClass, name: str, load: Callable[[], Encode]) -> None:
    _loaders[model_class, name] = load


def loader(model_class: ModelClass, name: str) -> Callable[[], Encode]:
    """What loads a model; an unknown one is an error."""
    try:
        return _loaders[model_class, name]
    except KeyError:
        raise KeyError(f"no model {name!r} of class {model_class.value}") from None


def hashing(dim: int = 64) -> Encode:
    """Counts of lower-cased words by md5 bucket, in unit length: deterministic, for tests and baselines."""

    def encode(texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), dim), np.float64)
        for i, text in enumerate(texts):
            for word in re.findall(r"[^\x20\x09-\x0D]+", (text or "").lower()):
                out[i, int(hashlib.md5(word.encode()).hexdigest()[:4], 16) % dim] += 1
        n = np.sqrt((out * out).sum(1, keepdims=True))
        return out / np.where(n > 0, n, 1)

    return encode


register(ModelClass.HASHING, "md5-64", hashing)


def average_pool(hidden: np.ndarray, mask: np.ndarray) -> np.ndarray:
    """Mean over the unmasked tokens (rows x tokens x dims)."""
    m = mask[:, :, None].astype(np.float64)
    return (hidden * m).sum(1) / m.sum(1)


def pooled(tokens: DataFrame) -> DataFrame:
    """The same on rows (id, hidden array of arrays, mask array): id, dim, value."""
    each = tokens.select("id", F.posexplode("hidden").alias("t", "h"), "mask").select("id", F.posexplode("h").alias("dim", "x"), F.element_at("mask", F.col("t") + 1).alias("m"))
    return each.groupBy("id", "dim").agg((F.sum(F.col("x").cast("double") * F.col("m")) / F.sum("m")).alias("value"))


def encode(rows: DataFrame, model_class: ModelClass = ModelClass.HASHING, name: str = "md5-64", kind: str = "text", batch: int = 256) -> DataFrame:
    """Rows (with ``value``, and ``instruction`` if there is one) plus embedding and err_message.

    A batch that fails gives its rows an error and no embedding; others go on. A wrong kind
    of content or an unknown model fails the call. Instructions go before the texts, or to the model
    beside them if it takes them so.
    """
    checked_content(model_class, kind)
    load = loader(model_class, name)
    names = rows.columns
    prefix = "instruction" in names

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load()
        for whole in batches:
            for at in range(0, whole.num_rows, batch):
                part = whole.slice(at, batch)
                texts = part.column(names.index("value")).to_pylist()
                told = None
                if prefix:
                    given = [i or "" for i in part.column(names.index("instruction")).to_pylist()]
                    if getattr(model, "takes_instructions", False):
                        told = given
                    else:
                        texts = [i + (t or "") for i, t in zip(given, texts, strict=True)]
                try:
                    got = model(texts, told) if told is not None else model(texts)
                    if len(got) != len(texts):
                        raise ValueError(f"{len(got)} vectors for {len(texts)} texts")
                    found, errors = pa.array(list(np.asarray(got, np.float32)), pa.list_(pa.float32())), pa.nulls(part.num_rows, pa.string())
                except Exception as error:  # reported per row
                    found, errors = pa.nulls(part.num_rows, pa.list_(pa.float32())), pa.array([str(error)] * part.num_rows)
                yield pa.RecordBatch.from_arrays([*part.columns, found, errors], [*names, "embedding", "err_message"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, f"{fields}, embedding array<float>, err_message string")


def batches(rows: DataFrame) -> DataFrame:
    """field, texts and characters per field: what one encode call per field holds."""
    return rows.groupBy("field").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("value")).alias("chars"))


def pixel_norm(pixel, channel: int):
    """A 0..255 pixel column as image models take it."""
    return (pixel / 255.0 - PIXEL_MEAN[channel]) / PIXEL_STD[channel]


def image_tensor(rgb: np.ndarray, size: int) -> np.ndarray:
    """Height x width x 3 bytes, scaled so that the short side is ``size``, centre-cropped, normalised: 3 x size x size."""
    h, w, _ = rgb.shape
    scale = size / min(h, w)
    nh, nw = max(size, round(h * scale)), max(size, round(w * scale))
    y = np.clip((np.arange(nh) + 0.5) / scale - 0.5, 0, h - 1)
    x = np.clip((np.arange(nw) + 0.5) / scale - 0.5, 0, w - 1)
    y0, x0 = np.floor(y).astype(int), np.floor(x).astype(int)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[:, None, None], (x - x0)[None, :, None]
    p = rgb.astype(np.float64)
    big = (p[y0][:, x0] * (1 - fx) + p[y0][:, x1] * fx) * (1 - fy) + (p[y1][:, x0] * (1 - fx) + p[y1][:, x1] * fx) * fy
    top, left = (nh - size) // 2, (nw - size) // 2
    crop = big[top : top + size, left : left + size] / 255.0
    return ((crop - PIXEL_MEAN) / PIXEL_STD).transpose(2, 0, 1).astype(np.float32)
