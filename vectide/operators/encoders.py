"""Adapters for published encoders in ONNX form: what goes into a session and what is taken from its outputs.

Weights are not part of this repository; every loader takes paths, and a session can be handed in.
A loader is called once by a task; what it returns maps inputs to vectors (see ``embed.register``).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from pathlib import Path
from typing import Any, Protocol

import numpy as np

from vectide.operators.embed import average_pool, image_tensor

# Fixed values of the published models: tokens of a text, first and last token, dimensions kept.
CLIP_CONTEXT, CLIP_START, CLIP_END = 77, 49406, 49407
INSTRUCTOR_DIM = 768
#: execution providers of a device, as the runtime names them
PROVIDERS = {
    "cpu": ("CPUExecutionProvider",),
    "cuda": ("CUDAExecutionProvider", "CPUExecutionProvider"),
    "tensorrt": ("TensorrtExecutionProvider", "CUDAExecutionProvider", "CPUExecutionProvider"),
}


class Session(Protocol):
    def run(self, outputs: None, feed: dict[str, np.ndarray]) -> list[np.ndarray]: ...

    def get_inputs(self) -> list[Any]: ...


def providers(device: str) -> list[str]:
    """The execution providers to offer for a device; an unknown one is an error."""
    if device not in PROVIDERS:
        raise ValueError(f"unknown device {device!r}: one of {', '.join(PROVIDERS)}")
    return list(PROVIDERS[device])


def opened(path: str, device: str = "cpu", threads: int = 1) -> Session:
    """A session over model weights; a task uses one thread unless told otherwise."""
    import onnxruntime

    offered = providers(device)
    if not Path(path).exists():
        raise FileNotFoundError(f"model weights missing: {path}")
    options = onnxruntime.SessionOptions()
    options.intra_op_num_threads = threads
    return onnxruntime.InferenceSession(path, options, providers=[p for p in offered if p in onnxruntime.get_available_providers()])


def _run(session: Session, values: Sequence[np.ndarray]) -> np.ndarray:
    """The last output, inputs given in the order in which the session names them."""
    names = [i.name for i in session.get_inputs()]
    if len(names) != len(values):
        raise ValueError(f"the model takes {len(names)} inputs, not {len(values)}")
    return session.run(None, dict(zip(names, values, strict=True)))[-1]


def filled(rows: Sequence[Sequence[int]], width: int | None = None, kind: type = np.int64) -> np.ndarray:
    """Rows of different lengths as one array, with zeros after them."""
    out = np.zeros((len(rows), width or max(map(len, rows), default=0)), kind)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


# ---- image and text models


class ClipTokens:
    """Texts as start, at most CONTEXT - 2 tokens and end, with zeros after them; and back."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()

    def ids(self, texts: Sequence[str]) -> list[list[int]]:
        clean = [" ".join((t or "").split()).lower() for t in texts]
        return [e.ids for e in self.tokenizer.encode_batch(clean, add_special_tokens=False)]

    def encode(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """ids and mask, texts x CONTEXT."""
        rows = [[CLIP_START, *ids[: CLIP_CONTEXT - 2], CLIP_END] for ids in self.ids(texts)]
        return filled(rows, CLIP_CONTEXT, np.int32), filled([[1] * len(r) for r in rows], CLIP_CONTEXT, np.int32)

    def decode(self, ids: Sequence[int]) -> str:
        """The text of tokens, without padding and marks; its words end in one space each."""
        kept = [int(i) for i in ids if int(i) not in (CLIP_START, CLIP_END)]
        while kept and not kept[-1]:
            kept.pop()
        return "".join(self.tokenizer.id_to_token(i) for i in kept).replace("</w>", " ") if kept else ""


def clip_text(model: str, tokens: str, device: str = "cpu", session: Session | None = None) -> Callable[[], Callable[[Sequence[str]], np.ndarray]]:
    """Loader of a text tower: CONTEXT ids and mask in, a vector per text out."""

    def load() -> Callable[[Sequence[str]], np.ndarray]:
        run, tokenizer = session or opened(model, device), ClipTokens(tokens)
        return lambda texts: np.asarray(_run(run, tokenizer.encode(texts)), np.float32)

    return load


def clip_images(model: str, size: int, decode: Callable[[bytes], np.ndarray], device: str = "cpu", session: Session | None = None) -> Callable[[], Callable[[Sequence[bytes]], np.ndarray]]:
    """Loader of an image tower: encoded images, which ``decode`` turns into height x width x 3 bytes, in; a vector each out."""

    def load() -> Callable[[Sequence[bytes]], np.ndarray]:
        run = session or opened(model, device)
        return lambda images: np.asarray(_run(run, [np.stack([image_tensor(decode(x), size) for x in images])]), np.float32)

    return load


# ---- text models


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def instructor_inputs(tokenizer, instructions: Sequence[str], texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, mask and context lengths: instruction and text as one string, and the instruction's tokens but its end.

    Zeros among the ids are padding and left out. A single row comes twice, as exported models fail on one.
    """
    if len(instructions) != len(texts):
        raise ValueError(f"{len(instructions)} instructions for {len(texts)} texts")
    context = [sum(e.attention_mask) - 1 for e in tokenizer.encode_batch(list(instructions))]
    both = tokenizer.encode_batch([(i or "") + (t or "") for i, t in zip(instructions, texts, strict=True)])
    ids, mask = [[x for x in e.ids if x] for e in both], [[x for x in e.attention_mask if x] for e in both]
    if len(ids) == 1:
        ids, mask, context = ids * 2, mask * 2, context * 2
    return filled(ids), filled(mask), np.array(context, np.int64)


def instructor(model: str, tokens: str, device: str = "cpu", session: Session | None = None, dim: int = INSTRUCTOR_DIM) -> Callable[[], Callable[..., np.ndarray]]:
    """Loader of an instruction-following model: called with texts and their instructions."""

    def load() -> Callable[..., np.ndarray]:
        run, tokenizer = session or opened(model, device), _tokenizer(tokens)

        def encode(texts: Sequence[str], instructions: Sequence[str] | None = None) -> np.ndarray:
            out = np.asarray(_run(run, instructor_inputs(tokenizer, [""] * len(texts) if instructions is None else instructions, texts)), np.float32)
            return out[: len(texts), :dim]

        encode.takes_instructions = True
        return encode

    return load


def e5_inputs(tokenizer, texts: Sequence[str], most: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, mask and type ids, each row filled up to the longest of the batch and cut at ``most``."""
    found = tokenizer.encode_batch([t or "" for t in texts])
    return filled([e.ids[:most] for e in found]), filled([e.attention_mask[:most] for e in found]), filled([e.type_ids[:most] for e in found])


def e5(model: str, tokens: str, device: str = "cpu", session: Session | None = None, most: int = 512) -> Callable[[], Callable[[Sequence[str]], np.ndarray]]:
    """Loader of a model whose hidden states are averaged over the unmasked tokens; not normalised, no prefix added."""

    def load() -> Callable[[Sequence[str]], np.ndarray]:
        run, tokenizer = session or opened(model, device), _tokenizer(tokens)
        takes = len(run.get_inputs())

        def encode(texts: Sequence[str]) -> np.ndarray:
            feed = e5_inputs(tokenizer, texts, most)
            return average_pool(np.asarray(_run(run, feed[:takes])), feed[1]).astype(np.float32)

        return encode

    return load


def initialised(loads: dict[str, Callable[[], object]]) -> dict[str, str | None]:
    """What went wrong with each model's loading, None where nothing did; one failure does not keep others from loading."""
    out: dict[str, str | None] = {}
    for name, load in loads.items():
        try:
            load()
            out[name] = None
        except Exception as error:  # reported by model
            out[name] = str(error)
    return out
