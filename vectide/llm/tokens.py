"""Token ids of whole texts by a public tokenizer, a word at a time.

For a tokenizer whose normaliser and pre-tokenizer never join text across
white space (the word BPE: NFC, white space dropped, lower case), a text's ids
are those of its white-space separated words in a row. Words repeat, so each
worker keeps the ids of words it has met in a table of fixed size, with the words' bytes,
which are compared, and encodes only the others. Texts that hold an added token's string
are encoded whole.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa

from vectide.llm.text import MASK, U64, Words, eights, mix, ragged

#: slots of the table of words, bytes of the longest word in it, and ids kept before it is emptied
SLOT_BITS, LONGEST, KEPT_IDS = 20, 16, 6 << 20
_MUL = U64(0x9E3779B97F4A7C15)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordTokenizer:
    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.clear()

    def clear(self) -> None:
        """Forget all words."""
        #: a word's first and next eight bytes and its size (0: no word), where its ids begin, and how many it has
        self.low, self.high = np.zeros(1 << SLOT_BITS, U64), np.zeros(1 << SLOT_BITS, U64)
        self.size = np.zeros(1 << SLOT_BITS, np.uint8)
        self.first, self.count = np.zeros(1 << SLOT_BITS, np.int32), np.zeros(1 << SLOT_BITS, np.int32)
        self.ids = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and each text's range in them (n + 1 offsets)."""
        words = Words(column)
        n = len(words.off) - 1
        if not len(words):
            return np.zeros(0, np.uint32), np.zeros(n + 1, np.int64)
        if len(self.ids) > KEPT_IDS:
            self.clear()
        size = words.end - words.start
        every = eights(words.data)
        low = every[words.start] & MASK[np.minimum(size, 8)]
        high = every[np.minimum(words.start + 8, len(words.data))] & MASK[np.clip(size - 8, 0, 8)]
        h = mix(low + mix(high + size.astype(U64) * _MUL))
        one = (h >> U64(64 - SLOT_BITS)).astype(np.int64)
        slot, hit = one.copy(), self._holds(one, low, high, size)
        rest = np.flatnonzero(~hit)
        slot[rest] = self._second(h[rest])
        hit[rest] = self._holds(slot[rest], low[rest], high[rest], size[rest])
        first, count = self.first[slot].astype(np.int64), self.count[slot].astype(np.int64)
        miss = np.flatnonzero(~hit)
        if len(miss):
            raw, new = words.data.tobytes(), {}
            number = np.array([new.setdefault(raw[a:b], len(new)) for a, b in zip(words.start[miss].tolist(), words.end[miss].tolist(), strict=True)])
            ids, lens = self._words([w.decode() for w in new])
            starts = len(self.ids) + np.cumsum(lens) - lens
            self.ids = np.concatenate([self.ids, ids])
            first[miss], count[miss] = starts[number], lens[number]
            at = np.empty(len(new), np.int64)
            at[number[::-1]] = miss[::-1]
            at = at[size[at] <= LONGEST]
            into = np.where(self.size[one[at]] == 0, one[at], self._second(h[at]))
            # of words that fall on one slot the last stays, in all of these
            self.low[into], self.high[into], self.size[into] = low[at], high[at], size[at]
            self.first[into], self.count[into] = first[at], count[at]
        ids = self.ids
        group, place = ragged(count)
        out = ids[first[group] + place]
        return self._whole(column, words, out, np.concatenate([[0], np.cumsum(count)])[words.word_off])

    def _second(self, h: np.ndarray) -> np.ndarray:
        return ((h * _MUL) >> U64(64 - SLOT_BITS)).astype(np.int64)

    def _holds(self, slot: np.ndarray, low: np.ndarray, high: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether a slot holds the word of these bytes."""
        return (self.size[slot] == size) & (self.low[slot] == low) & (self.high[slot] == high)

    def _words(self, text: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these words in a row, and how many each has.

        Words are encoded in long lines. Token offsets tell the words apart.
        """
        lens = np.zeros(len(text), np.int64)
        out: list[np.ndarray] = []
        for a in range(0, len(text), 256):
            part = text[a : a + 256]
            encoded = self.tokenizer.encode(" ".join(part), add_special_tokens=False)
            ends = np.cumsum([len(w) + 1 for w in part])
            offsets = np.array(encoded.offsets, np.int64).reshape(-1, 2)
            lens[a : a + len(part)] = np.bincount(np.searchsorted(ends, offsets[:, 0], side="right"), minlength=len(part))
            out.append(np.array(encoded.ids, np.uint32))
        return np.concatenate(out), lens

    def _whole(self, column: pa.Array, words: Words, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        data = words.data.tobytes()
        odd = set()
        for s in self.special:
            at = data.find(s)
            while at >= 0:
                odd.add(int(np.searchsorted(words.off, at, side="right")) - 1)
                at = data.find(s, at + 1)
        if not odd:
            return ids, off
        parts = [ids[a:b] for a, b in zip(off[:-1], off[1:], strict=True)]
        for i in odd:
            parts[i] = self._encode([column[i].as_py()])[0]
        return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    """One per worker process."""
    return WordTokenizer(path)
