"""What encoders put into a session and take from it, with sessions that show what they were given."""

import numpy as np
import pytest

from vectide.operators import embed, encoders
from vectide.types import ModelClass


def tokenizer_file():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Input:
    def __init__(self, name):
        self.name = name


class Shown:
    """Keeps its feed; gives hidden states whose every dimension is the token's place, or a vector a row."""

    def __init__(self, *names, dim=4, hidden=False):
        self.names, self.dim, self.hidden, self.feed = names, dim, hidden, None

    def get_inputs(self):
        return [Input(n) for n in self.names]

    def run(self, outputs, feed):
        self.feed = feed
        first = feed[self.names[0]]
        if self.hidden:
            return [np.zeros(1), np.tile(np.arange(first.shape[1], dtype=np.float32)[None, :, None], (len(first), 1, self.dim))]
        return [np.arange(len(first) * self.dim, dtype=np.float32).reshape(len(first), -1)]


def test_clip_tokens_are_marked_cut_and_filled():
    own = encoders.ClipTokens(tokenizer_file())
    ids, mask = own.encode(["A  photo\nof a CAT", "word " * 200, "", None])
    assert ids.shape == mask.shape == (4, 77)
    assert (ids[:, 0] == encoders.CLIP_START).all() and ids[1, 76] == encoders.CLIP_END and mask.sum(1).tolist() == [7, 77, 2, 2]
    assert own.decode(ids[0]) == "a photo of a cat " and own.decode(ids[2]) == ""
    assert (ids[0] == own.encode(["a photo of a cat"])[0][0]).all()


def test_text_and_image_towers():
    session = Shown("ids", "mask")
    out = encoders.clip_text("", tokenizer_file(), session=session)()(["one", "two", "three"])
    assert out.shape == (3, 4) and session.feed["ids"].dtype == np.int32 and session.feed["mask"].sum(1).tolist() == [3, 3, 3]
    seen = Shown("pixels", dim=2)
    decode = lambda raw: np.full((40, 30, 3), raw[0], np.uint8)
    assert encoders.clip_images("", 16, decode, session=seen)()([b"\x00", b"\xff"]).shape == (2, 2)
    assert seen.feed["pixels"].shape == (2, 3, 16, 16) and seen.feed["pixels"][1].min() > seen.feed["pixels"][0].max()
    with pytest.raises(ValueError, match="2 inputs, not 1"):
        encoders.clip_images("", 16, decode, session=Shown("a", "b"))()([b"x"])


def test_instructor_gives_context_lengths_and_doubles_single_rows():
    own = encoders._tokenizer(tokenizer_file())
    ids, mask, context = encoders.instructor_inputs(own, ["represent the text: ", "x: "], ["a red fox", "b"])
    assert ids.shape == mask.shape and context.tolist() == [len(own.encode("represent the text: ").ids) - 1, len(own.encode("x: ").ids) - 1]
    assert ids[1].tolist().count(0) == ids.shape[1] - len(own.encode("x: b").ids)
    session = Shown("ids", "mask", "context", dim=6)
    encode = encoders.instructor("", tokenizer_file(), session=session, dim=5)()
    assert encode(["only"], ["say: "]).shape == (1, 5) and len(session.feed["ids"]) == 2
    with pytest.raises(ValueError, match="1 instructions for 2 texts"):
        encode(["a", "b"], ["c"])


def test_e5_averages_unmasked_states():
    session = Shown("ids", "mask", "types", hidden=True)
    out = encoders.e5("", tokenizer_file(), session=session)()(["one two three four", "one"])
    lens = session.feed["mask"].sum(1)
    assert np.allclose(out[:, 0], (lens - 1) / 2) and (session.feed["types"] == 0).all()
    two = Shown("ids", "mask", hidden=True)
    assert encoders.e5("", tokenizer_file(), session=two, most=3)()(["a b c d e f"]).shape == (1, 4) and two.feed["ids"].shape == (1, 3)


def test_devices_missing_weights_and_results_by_model(tmp_path):
    assert encoders.providers("cuda")[-1] == "CPUExecutionProvider"
    with pytest.raises(ValueError, match="unknown device"):
        encoders.providers("abacus")
    with pytest.raises(FileNotFoundError):
        encoders.opened(str(tmp_path / "none.onnx"))
    got = encoders.initialised({"fine": lambda: 1, "gone": encoders.e5(str(tmp_path / "none.onnx"), tokenizer_file())})
    assert got["fine"] is None and "weights missing" in got["gone"]


def test_encode_passes_instructions_to_models_that_take_them(spark):
    def load():
        def encode(texts, instructions=None):
            return np.array([[len(t), len(i)] for t, i in zip(texts, instructions, strict=True)])

        encode.takes_instructions = True
        return encode

    embed.register(ModelClass.INSTRUCTOR, "lengths", load)
    embed.register(ModelClass.E5, "short", lambda: lambda texts: np.zeros((len(texts) - 1, 2)))
    rows = spark.createDataFrame([("abc", "to: "), ("d", None)], "value string, instruction string").coalesce(1)
    assert [r.embedding for r in embed.encode(rows, ModelClass.INSTRUCTOR, "lengths").collect()] == [[3.0, 4.0], [1.0, 0.0]]
    assert {r.err_message for r in embed.encode(rows, ModelClass.E5, "short").collect()} == {"1 vectors for 2 texts"}
