"""Personal data: fixed patterns, and a linear-chain CRF that adds what they miss.

Kinds are email, ip, card and phone. The patterns give the base spans. The CRF
labels the words of whole texts by their shapes; words it labels with a kind, joined when
adjacent, are added as spans where they do not overlap a base span and could be
of that kind (an address has its sign, a number its digits). It was
trained from the small labelled table ``EXAMPLES`` and is decoded by Viterbi,
many word sequences at a time. Long stretches of plain words, which are surely
of no kind by the model's own weights, are cut out first (see ``sequences``).

Positions are code points, ends exclusive. Null and empty texts have no spans. Overlapping
spans of different kinds all stay, ties by the order of the kinds. Texts are read whole; a long
stretch of numbers is decoded with few others at a time. Repeated rows have equal spans. The
functions take a column of texts, so other columns and their names do not matter; an empty one
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np
import pyarrow as pa

KINDS = ("email", "ip", "card", "phone")
LABELS = ("O", *KINDS)

# Equivalent to the plain patterns: a match can't start inside a run of digits or
# local-part characters, since one starting at the run's beginning would have failed alike.
_AT = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = int(d) << (i & 1)
        total += x - 9 if x > 9 else x
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) by start, then kind as listed."""
    found = []
    if "@" in text:
        done = 0
        for m in _AT.finditer(text):
            start = m.start()
            while start > done and text[start - 1] in _LOCAL_CHARS:
                start -= 1
            if start < m.start():
                found.append(("email", start, m.end()))
                done = m.end()
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            found.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            found.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m[0])) <= 15:
                found.append(("phone", *m.span()))
    return ordered(found)


def ordered(spans: Iterable[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


def show(spans: Iterable[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


#: The labelled table: words, and the kind that the words in braces have.
EXAMPLES = (
    "please write to {email jane dot roe at mail dot example dot com} before noon",
    "contact {email sam at post dot example dot org} for the notes",
    "send it to {email lee (at) mail dot example dot net} soon",
    "ask {email kim [at] site dot example dot com} or wait here",
    "reach me on {email m.ito (at) example.org} any day",
    "mail {email pat at example.com} with the list",
    "we met at noon and looked at the dot on the page",
    "she was at home at ten and he was at work",
    "the dot at the end is a full stop",
    "call {phone (555) 013-2244} after nine",
    "call {phone (212) 555-0199} or come by",
    "my number is {phone 555-013-2244} at work",
    "ring {phone 212-555-0147} and ask for her",
    "phone {phone 0555 013 2244} until five",
    "tel {phone 212.555.0133} in the office",
    "her line {phone 020 7946 0018} is busy",
    "fax {phone 030-555-01234} or letter",
    "the host {ip 10.1.2.3:8080} did not answer",
    "logs from {ip 192.168.0.12/24} were kept",
    "server {ip 172.16.4.20:22} went down",
    "node {ip fe80::1c2d:3aff:fe4b:5566} joined",
    "see {ip 2001:db8::ff00:42:8329} in the trace",
    "paid with {card 4111.1111.1111.1111} last week",
    "card {card 5500/0000/0000/0004} was used",
    "charge {card 4012_8888_8888_1881} for it",
    "the card {card xxxx-xxxx-xxxx-4242} is on file",
    "in 1999 there were 2500 people and 30 houses",
    "the code abc123def456 is not a number to call",
    "hash 9f86d081884c7d659a2feaa0c55ad015 was logged",
    "order 20240131 shipped on 2024-01-31 at 10:30",
    "version 1.2.3 costs 49.99 or 1,299,000 in all",
    "item 100234567 and item 100234568 are sold",
    "between 2019-05-01 and 2021-12-31 it rained",
    "pages 1234567 to 1234599 are missing",
    "key sk4eC39HqLyjWDarjtT1zdp7dc is secret",
    "number 2123465659789240 is in the list",
    "total 12345678901234 of 98765432109876",
    "at 12:45:30 the run 00012345 ended",
    "isbn 978-3-16-148410-0 was out of print",
    "a ratio of 3.14159265 to 2.71828182 was found",
    "appelez le {phone 06 12 34 56 78} avant midi",
    "tel {phone 55 13 22 44} or come by",
    "dial {phone 00 33 6 12 34 56 78} from abroad",
    "fax {phone 01 - 44 - 55 - 66 - 77} or letter",
    "ring {phone 5 5 5 0 1 3 2} and ask",
    "numéro {phone (06) 12 34 56 78} le soir",
    "the host {ip dead:beef::1} is down",
    "a route to {ip ::1} was lost",
    "see {ip fe80::1} now",
    "peer {ip fd00:a:b::c} joined again",
    "the prefix {ip cafe:babe::} is ours",
    "try {phone (212) 555-0133} 4532132264650870 and wait",
    "they met on 12 05 2024 and on 3 6 2025 again",
    "between 10 and 12 of 20 houses had 2 or 3 rooms",
    "lines 1 2 3 4 5 6 7 8 9 10 11 12 13 14 were cut",
    "a::b and std::vector are names in the code",
)
_MARKED = re.compile(r"\{(\w+) ([^}]*)\}|(\S+)")
_JOINS = {"at", "(at)", "[at]", "dot", "(dot)", "[dot]"}
_OBFUSCATED = {"(at)", "[at]", "(dot)", "[dot]"}
_TRIM = ".,;:!?\"'*%&$#|"


def shape(word: str) -> str:
    """Letters a, digits 0, others themselves; runs of three or more shown as two and +."""
    out = re.sub(r"[^\W\d_]", "a", re.sub(r"[0-9]", "0", word))
    return re.sub(r"(.)\1\1+", r"\1\1+", out)[:24]


def word_features(words: list[str]) -> list[list[str]]:
    """Feature names of each word: its own shape and size, and its neighbours' shapes."""
    shapes = [shape(w) for w in words]
    small = [w.lower() if w.lower() in _JOINS else ("a" if s.strip("a+") == "" else s) for w, s in zip(words, shapes, strict=True)]
    out = []
    for i, w in enumerate(words):
        digits = sum(c.isdigit() for c in w)
        left = small[i - 1] if i else "<"
        right = small[i + 1] if i + 1 < len(words) else ">"
        out.append(["b", f"s={shapes[i]}", f"w={small[i]}", f"l={left}", f"r={right}", f"d={min(digits, 20)}/{min(len(w), 24) // 3}", f"ld={left}|{small[i]}", f"rd={small[i]}|{right}"])
    return out


class Crf:
    """Linear-chain conditional random field over named features."""

    def __init__(self, names: dict[str, int], emit: np.ndarray, move: np.ndarray):
        self.names, self.emit, self.move = names, emit, move

    @classmethod
    def train(cls, rows: list[tuple[list[list[str]], list[int]]], steps: int = 150, l2: float = 0.02, rate: float = 0.5) -> Crf:
        """Adagrad on the penalised log likelihood of labelled word sequences."""
        names: dict[str, int] = {}
        coded = [([[names.setdefault(f, len(names)) for f in w] for w in words], labels) for words, labels in rows]
        k = len(LABELS)
        emit, move = np.zeros((len(names), k)), np.zeros((k, k))
        ge, gm = np.full_like(emit, 1e-3), np.full_like(move, 1e-3)
        n = max(len(w) for w, _ in coded)
        lens = np.array([len(w) for w, _ in coded])
        owner = np.array([(i, t, f) for i, (words, _) in enumerate(coded) for t, w in enumerate(words) for f in w])
        gold = np.zeros((len(coded), n, k))
        pairs = np.zeros((k, k))
        for i, (_, labels) in enumerate(coded):
            gold[i, np.arange(len(labels)), labels] = 1
            np.add.at(pairs, (labels[:-1], labels[1:]), 1)
        for _ in range(steps):
            score = np.zeros((len(coded), n, k))
            np.add.at(score, (owner[:, 0], owner[:, 1]), emit[owner[:, 2]])
            m = np.exp(move)
            e = np.exp(score)
            a, b, scale = np.zeros_like(e), np.ones_like(e), np.ones((len(coded), n))
            a[:, 0] = e[:, 0]
            for t in range(n):
                if t:
                    a[:, t] = (a[:, t - 1] @ m) * e[:, t]
                scale[:, t] = a[:, t].sum(1)
                a[:, t] /= scale[:, t, None]
            mid = np.zeros((k, k))
            for t in range(n - 2, -1, -1):
                live = (t + 1 < lens)[:, None]
                nxt = np.where(live, b[:, t + 1] * e[:, t + 1] / scale[:, t + 1, None], 0)
                b[:, t] = np.where(live, nxt @ m.T, 1)
                mid += np.einsum("ia,ib->ab", a[:, t], nxt) * m
            p = a * b
            p /= p.sum(2, keepdims=True)
            p *= (np.arange(n) < lens[:, None])[:, :, None]
            g = np.zeros_like(emit)
            np.add.at(g, owner[:, 2], (gold - p)[owner[:, 0], owner[:, 1]])
            g -= l2 * emit
            h = pairs - mid - l2 * move
            ge += g * g
            gm += h * h
            emit += rate * g / np.sqrt(ge)
            move += rate * h / np.sqrt(gm)
        return cls(names, emit, move)

    def decode(self, sequences: list[list[list[str]]]) -> list[np.ndarray]:
        """The likeliest labels of each sequence, all sequences in step."""
        if not sequences:
            return []
        lens = np.array([len(s) for s in sequences])
        n, k = int(lens.max()), len(LABELS)
        score = np.zeros((len(sequences), n, k))
        at = [(i, t, f) for i, words in enumerate(sequences) for t, w in enumerate(words) for x in w if (f := self.names.get(x)) is not None]
        i, t, f = np.array(at).T
        np.add.at(score, (i, t), self.emit[f])
        back = np.zeros((len(sequences), n, k), np.int8)
        best = score[:, 0]
        ends = np.where((lens == 1)[:, None], best, 0)
        for t in range(1, n):
            ways = best[:, :, None] + self.move
            back[:, t] = ways.argmax(1)
            best = ways.max(1) + score[:, t]
            ends = np.where((lens == t + 1)[:, None], best, ends)
        label = ends.argmax(1)
        path = np.zeros((len(sequences), n), int)
        for t in range(n - 1, -1, -1):
            label = np.where(t == lens - 1, ends.argmax(1), label)
            path[:, t] = label
            label = np.where(t < lens, back[np.arange(len(sequences)), t, label], label)
        return [p[:m] for p, m in zip(path, lens, strict=True)]


def labelled(example: str) -> tuple[list[list[str]], list[int]]:
    words, labels = [], []
    for kind, inner, plain in _MARKED.findall(example):
        for w in inner.split() if kind else [plain]:
            words.append(w)
            labels.append(LABELS.index(kind) if kind else 0)
    return word_features(words), labels


@lru_cache(maxsize=1)
def model() -> Crf:
    return Crf.train([labelled(x) for x in EXAMPLES])


def plain(word: str) -> bool:
    """Whether a trimmed word is letters alone and says no sign."""
    return word.isalpha() and not (len(word) < 4 and word.lower() in _JOINS)


@lru_cache(maxsize=1)
def reach() -> int:
    """So many plain words among plain words are sure to hold one that the best labelling calls O, whatever stands around them.

    The bound takes, for each label, the class of plain words that is best for it, and any labels on both
    sides, or none. MOST is returned if none so small holds, or if leaving O among plain words could pay.
    """
    crf = model()
    gain = np.full(len(LABELS), -np.inf)
    for n in range(1, 25):
        for left in ([], ["word"]):
            for right in ([], ["word"]):
                own = word_features([*left, "x" * n, *right])[len(left)]
                score = sum(crf.emit[crf.names[f]] for f in own if f in crf.names)
                gain = np.maximum(gain, score - score[0])
    move, gain = crf.move, gain[1:]
    before = np.concatenate([move[:, 1:] - move[:, :1], np.zeros((1, len(gain)))])  # by the label before, or none
    after = np.concatenate([move[1:] - move[0], np.zeros((len(gain), 1))], 1)
    best, pays = before + gain, False
    for n in range(1, MOST):
        ends = (best[:, :, None] + after[None]).max(1)
        pays |= ends[0, 0] >= 0
        if (ends < 0).all():
            return MOST if pays else n
        best = (best[:, :, None] + move[1:, 1:][None] - move[0, 0]).max(1) + gain
    return MOST


#: plain words that surround others in what the model decodes, at most
MOST = 40
_WORD = re.compile(r"\S+")


def sequences(text: str) -> list[list[tuple[str, int, int]]]:
    """All words that are not plain, with the plain ones around them, as (trimmed word, start, end).

    Twice ``reach`` plain words on each side make the labels those of the whole text: the best labellings
    of the whole and of the stretch both pass O somewhere in the first half and in the second, and
    so stay O between; there they meet. Plain words farther off are O.
    """
    cores = [w.strip(_TRIM) for w in text.split()]
    odd = [i for i, w in enumerate(cores) if w and not plain(w)]
    if not odd:
        return []
    at = [m.span() for m in _WORD.finditer(text)]
    around, stretches = 2 * reach() + 1, []
    for i in odd:
        if stretches and i - around <= stretches[-1][1]:
            stretches[-1][1] = i + around
        else:
            stretches.append([i - around, i + around])
    out = []
    for first, last in stretches:
        words = []
        for i in range(max(0, first), min(len(cores), last + 1)):
            w, (start, end) = cores[i], at[i]
            if not w:
                continue
            whole = text[start:end]
            place = whole.index(w)
            if "::" in whole:  # an address may begin or end so
                left = "::" * whole[:place].endswith("::")
                w = left + w + "::" * whole[place + len(w) :].startswith("::")
                place -= len(left)
            words.append((w, start + place, start + place + len(w)))
        out.append(words)
    return out


def _plausible(kind: str, span: str) -> bool:
    digits = _digits(span)
    if kind == "email":
        low = span.lower()
        return ("at" in re.split(r"[\s()\[\]]+", low)) and ("dot" in low or re.search(r"\.[a-z]{2,}\s*$", low) is not None)
    if kind == "ip":
        return "." in span or span.count(":") >= 2
    if kind == "card":
        return len(digits) >= 4
    return 7 <= len(digits) <= 15


def added_spans(texts: list[str], base: list[list[tuple[str, int, int]]]) -> list[list[tuple[str, int, int]]]:
    """What the CRF finds in each text beside its base spans."""
    crf = model()
    runs = sorted(((i, s) for i, t in enumerate(texts) for s in sequences(t)), key=lambda r: len(r[1]))
    out: list[list[tuple[str, int, int]]] = [[] for _ in texts]
    # so many at once that a long stretch of numbers does not stretch hundreds of others
    sizes = np.maximum.accumulate([len(s) for _, s in runs]) if runs else np.zeros(0, int)
    at = 0
    while at < len(runs):
        n = int(max(1, min(512, (1 << 16) // sizes[min(at + 511, len(runs) - 1)])))
        part = runs[at : at + n]
        at += n
        for (i, words), labels in zip(part, crf.decode([word_features([w for w, *_ in s]) for _, s in part]), strict=True):
            j = 0
            while j < len(words):
                end = j + 1
                while end < len(words) and labels[end] == labels[j]:
                    end += 1
                if labels[j]:
                    kind, x, y = LABELS[labels[j]], words[j][1], words[end - 1][2]
                    if _plausible(kind, texts[i][x:y]) and all(y <= s or e <= x for _, s, e in base[i]):
                        out[i].append((kind, x, y))
                j = end
    return out


def find(column: pa.Array) -> tuple[list[list[tuple[str, int, int]]], list[list[tuple[str, int, int]]]]:
    """Base spans and all spans of each text."""
    texts = [t or "" for t in column.to_pylist()]
    base = [base_spans(t) for t in texts]
    more = added_spans(texts, base)
    return base, [ordered([*b, *m]) for b, m in zip(base, more, strict=True)]


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every span replaced by its kind in angle brackets; overlapping spans merge."""
    out, at = [], 0
    for kind, a, b in spans:
        if a < at:
            at = max(at, b)
            continue
        out += [text[at:a], f"<{kind.upper()}>"]
        at = b
    return "".join([*out, text[at:]])
