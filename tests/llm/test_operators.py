"""The operators and their queries against brute force, on small tables with odd rows."""

import base64
import collections
import hashlib
import math
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from vectide.llm import queries as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, rank string"


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def odd_texts():
    """Null, empty, blank, one word, copies, near copies, shared passages, personal data, a very long text."""
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    prose = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, base = prose(60), prose(200).split()
    texts = [None, "", "  \t\n ", "one", "One", "ONE ", "two words", "Two  words", "é", "Ünï cödé wörds here", "no letters 123 456"]
    for i in range(12):
        near = list(base)
        for _ in range(i):
            near[rng.randrange(len(near))] = "changed"
        texts.append(" ".join(near))
    texts += [prose(50) + " " + passage + " " + prose(30) for _ in range(3)]
    texts += [passage, passage + " " + passage, prose(20000), "x" * 5000, "1" * 3000 + ".2.3.4"]
    texts += ["mail jo.doe+a@ex-ample.co.uk now", "a@b", "call +1 (555) 013-2244, ip 10.0.0.255 or 10.0.0.256", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "a@b.c@d.e 1.2.3.4.5 +12"]
    texts += [prose(rng.randint(1, 120)) for _ in range(80)]
    return texts


@pytest.fixture(scope="module")
def docs():
    texts = odd_texts()
    rows = [(i * 3, t, [None, "aa", "bb"][i % 3], [None, "s1", "s2", "s3"][i % 4], len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def folder(spark, docs, tmp_path_factory):
    path = tmp_path_factory.mktemp("odd")
    spark.createDataFrame(docs, SCHEMA).repartition(3).write.parquet(f"{path}/documents.parquet")
    labels = [(r[0], 1, int("changed" in (r[1] or ""))) for r in docs]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def empty(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("empty")
    spark.createDataFrame([], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


@pytest.fixture(scope="module")
def repeated(spark, docs, tmp_path_factory):
    """Every row twice, and rows without an id."""
    path = tmp_path_factory.mktemp("twice")
    rows = docs[:30] + docs[:30] + [(None, "no id at all", "aa", "s1", 12, "c", "c"), (None, None, None, None, None, None, None)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return str(path)


OPS = sorted(n for n in vars(q) if re.match(r"op\d+_", n))


@pytest.mark.parametrize("name", OPS)
def test_empty_table(spark, empty, name):
    assert getattr(q, name)(spark, empty).collect() == []


@pytest.mark.parametrize("name", OPS)
def test_repeated_rows_and_missing_ids(spark, repeated, name):
    rows = getattr(q, name)(spark, repeated).collect()
    pieces = collections.Counter(r.doc_id for r in rows)
    if name != "op6_packing":
        assert len(rows) == 62 and pieces[None] == 2
    same = collections.defaultdict(set)
    for r in rows:
        if r.doc_id is not None and name not in ("op6_packing", "op10_mixing", "op8_spots"):
            same[r.doc_id].add(tuple(r))
    assert all(len(v) == 1 for v in same.values())


def test_media_round_trip(spark, folder, docs):
    rows = {r.doc_id: r for r in q.op1_jpeg(spark, folder).collect()}
    assert len(rows) == len(docs)
    for i, text, *_ in docs:
        raw = (text or "").encode()
        full = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(full), hashlib.sha256(full).hexdigest(), zlib.crc32(full[-64:]))


def test_stored_tensors_are_what_features_are_computed_from(spark):
    """Height x width x 3 of each stored image; mean and spread over whole 16-pixel tiles are the features."""
    import numpy as np

    from vectide.llm import media

    rows = spark.createDataFrame([(1, "short"), (2, "some longer text " * 40), (3, None), (4, "short")], "doc_id long, text string")
    stored = media.store(rows)
    shown = {r.doc_id: r for r in media.digest(stored).collect()}
    for r in media.tensors(stored.union(spark.createDataFrame([(9, 0, None)], stored.schema))).collect():
        if r.doc_id == 9:
            assert r.height is r.width is r.rgb is None
            continue
        x = np.frombuffer(bytes(r.rgb), np.uint8).reshape(r.height, r.width, 3)
        assert shown[r.doc_id].feature.split(":")[0] == f"{r.width}x{r.height}"
        if r.height % 16 == r.width % 16 == 0:
            want = ",".join(f"{m:.2f}/{s:.2f}" for m, s in zip(x.mean((0, 1), dtype=float), x.std((0, 1), dtype=float), strict=True))
            assert shown[r.doc_id].feature.split(":")[1] == want
    assert shown[1].media_sha256 == shown[4].media_sha256


def test_substrings(spark, folder, docs):
    size = 35
    words = {i: WORD.findall(t or "") for i, t, *_ in docs}
    seen = collections.Counter(tuple(w[i : i + size]) for w in words.values() for i in range(len(w) - size + 1))
    rows = {r.doc_id: r for r in q.op2_substrings(spark, folder).collect()}
    for d, w in words.items():
        gone = [False] * len(w)
        for i in range(len(w) - size + 1):
            if seen[tuple(w[i : i + size])] > 1:
                gone[i : i + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        r = rows[d]
        assert (r.n_words, r.n_removed, r.kept_sha256) == (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    assert sum(r.n_removed for r in rows.values()) > 500


def test_substring_history(spark, docs):
    from vectide.llm import substrings

    old = spark.createDataFrame([(1, docs[25][1])], "doc_id long, text string")
    new = spark.createDataFrame([(2, docs[26][1]), (3, "fresh words only")], "doc_id long, text string")
    run = substrings.index_run(old)
    rows = {r.doc_id: r for r in substrings.remove_repeats(new, history=run, with_text=True).collect()}
    alone = {r.doc_id: r for r in substrings.remove_repeats(new).collect()}
    assert rows[2].n_removed > 0 and alone[2].n_removed == 0 and rows[3].text == "fresh words only"


def thue_morse(k):
    """Two unlike words of 2**k letters whose polynomial hashes modulo 2**64 agree in any odd base, for k >= 10."""
    word = "a"
    for _ in range(k):
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


def with_equal_hashes(monkeypatch):
    """Every word hash is one of four, so that only comparing words tells them apart."""
    import numpy as np

    from vectide.llm import text

    monkeypatch.setattr(text, "slices", lambda data, start, size, seed=0: (size % 4).astype(np.uint64))


@pytest.mark.parametrize("k", [10, 11, 12])
def test_words_of_alike_structure_are_told_apart(spark, tmp_path, k):
    import pyarrow as pa

    from vectide.llm import substrings
    from vectide.llm.tokens import WordTokenizer, default_tokenizer

    one, two = thue_morse(k)
    rest = " ".join(f"w{i}" for i in range(34))
    docs = spark.createDataFrame([(1, f"{rest} {one}"), (2, f"{rest} {two}")], "doc_id long, text string")
    assert [r.n_removed for r in substrings.remove_repeats(docs).collect()] == [0, 0]
    history = substrings.index_run(docs.where("doc_id = 1"))
    assert [r.n_removed for r in substrings.remove_repeats(docs, history=history).orderBy("doc_id").collect()] == [35, 0]
    spark.createDataFrame([(1, f"{one} x"), (2, f"{two} x"), (3, f"{one} x")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    assert {r.doc_id: r.component_id for r in q.op4_minhash(spark, str(tmp_path)).collect()} == {1: 1, 2: 2, 3: 1}
    own = WordTokenizer(default_tokenizer())
    for _ in range(2):
        ids, off = own.encode(pa.array([one, two]))
        for i, t in enumerate((one, two)):
            assert ids[off[i] : off[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_near_duplicates_compare_shingles_not_hashes(monkeypatch):
    import pyarrow as pa

    from vectide.llm import neardup

    with_equal_hashes(monkeypatch)
    _, count, key = neardup.shingle_sets(pa.array(["aa bb cc", "bb cc dd", "cc bb aa bb cc", "aa bb cc", "AA bb cc bb", "", None, "one"]), 2)
    assert count.tolist() == [2, 2, 4, 2, 3, 0, 0, 1]
    keys = [tuple(x) for x in key.T.tolist()]
    assert keys[0] == keys[3] and len(set(keys)) == 6


def test_substring_windows_compare_words_not_hashes(monkeypatch):
    import numpy as np
    import pyarrow as pa

    from vectide.llm import substrings

    with_equal_hashes(monkeypatch)
    windows = substrings.Windows(pa.chunked_array([pa.array(["aa bb cc dd", "", "aa  bb\tcc ee", None])]), 3)
    assert len(set(windows.hashes().tolist())) == 1
    a, b, c, d = windows.digests(np.arange(4)).tolist()
    assert a == c and len({a, b, d}) == 3


def shingles(text, size):
    w = WORD.findall(lower(text or ""))
    if len(w) < size:
        return frozenset([tuple(w)]) if w else frozenset()
    return frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1))


def near_groups(docs, size, percent=80):
    sets = {i: shingles(t, size) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def test_minhash(spark, folder, docs):
    want = near_groups([r[:2] for r in docs], 2)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in q.op4_minhash(spark, folder).collect()}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 8


@pytest.mark.parametrize("dense", [-1, 10**9])
def test_minhash_clouds(spark, monkeypatch, dense):
    """Documents around the threshold, which leaders alone do not join; small blocks, with and without clouds."""
    from vectide.llm import neardup

    rng = random.Random(8)
    base = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.randint(0, 9)):
            words[rng.randrange(60)] = f"x{rng.randrange(1000)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(neardup, "DENSE", dense)
    monkeypatch.setattr(neardup, "BLOCK", 16)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()}
    assert got == near_groups(rows, 2)


def test_components_distributed_and_in_one_task(spark):
    from vectide.llm.components import components

    rng = random.Random(3)
    edges = [(rng.randrange(200), rng.randrange(200)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(30)]
    rows = spark.createDataFrame(edges, "a long, b long")
    assert sorted(map(tuple, components(rows).collect())) == sorted(map(tuple, components(rows, small=0).collect()))


def test_pii_base_spans(spark, folder, docs):
    def plain(t):
        out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
        out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(len(x.lstrip("0")) < 4 and int(x.lstrip("0") or 0) <= 255 for x in m[0].split("."))]
        for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t):
            d = [int(c) for c in m[0] if c.isdigit()]
            if 14 <= len(d) <= 19 and sum(x if i % 2 == 0 else (2 * x - 9 if x > 4 else 2 * x) for i, x in enumerate(d[::-1])) % 10 == 0:
                out.append(("card", *m.span()))
        out += [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= sum(c.isdigit() for c in m[0]) <= 15]
        kinds = ("email", "ip", "card", "phone")
        return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(out, key=lambda s: (s[1], kinds.index(s[0]))))

    rows = {r.doc_id: r for r in q.op5_pii(spark, folder).collect()}
    for i, t, *_ in docs:
        base = plain(t or "")
        assert rows[i].base_sha256 == hashlib.sha256(base.encode()).hexdigest()
        assert set(filter(None, base.split(","))) <= set(rows[i].spans.split(","))
    assert sum(r.n_email + r.n_ip + r.n_card + r.n_phone for r in rows.values()) >= 5


def test_pii_model_adds_what_patterns_miss():
    import pyarrow as pa

    from vectide.llm import pii

    texts = ["please ask lee (at) mail dot example dot com for it", "you can call (415) 555-0132 at noon", "he looked at the dot on page 12"]
    _, spans = pii.find(pa.array(texts))
    assert [k for k, *_ in spans[0]] == ["email"] and [k for k, *_ in spans[1]] == ["phone"] and spans[2] == []
    assert pii.redact(texts[1], spans[1]) == "you can call <PHONE> at noon"


def test_pii_finds_numbers_in_pairs_and_addresses_of_few_digits():
    import pyarrow as pa

    from vectide.llm import pii

    texts = {
        "appelez le 06 12 34 56 78 demain": "appelez le <PHONE> demain",
        "tel 55 13 22 44": "tel <PHONE>",
        "call 5 5 5 0 1 3 2 2 tonight": "call <PHONE> tonight",
        "fax 01 - 44 - 55 - 66 - 77 or come": "fax <PHONE> or come",
        "the host dead:beef::1 is down": "the host <IP> is down",
        "we saw ::1 in it": "we saw <IP> in it",
        "there were 12 or 15 of 20 people": None,
        "they left at 10 20 30 as ever": None,
        "std::vector and a::b are fast": None,
    }
    for text, spans in zip(texts, pii.find(pa.array(list(texts)))[1], strict=True):
        assert pii.redact(text, spans) == (texts[text] or text)
    many = "sum " + "12 34 words " * 3 + "7 " * 5000
    assert pii.find(pa.array([many, "tel 55 13 22 44"]))[1][1] == [("phone", 4, 15)]


def test_packing(spark, folder, docs):
    from tokenizers import Tokenizer

    from vectide.llm.tokens import default_tokenizer

    tokenizer = Tokenizer.from_file(default_tokenizer())
    own, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in q.op6_packing(spark, folder).collect():
        own[r.doc_id].append(r)
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, t, *_ in docs:
        ids = [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2]
        at = 0
        for r in sorted(own[i], key=lambda r: r.start):
            raw = b"".join(x.to_bytes(4, "little") for x in ids[at : at + r.length])
            assert (r.start, r.doc_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(raw))
            at += r.length
        assert at == len(ids)
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096


def test_short_documents_are_packed_with_little_padding(spark):
    from vectide.llm import packing

    texts = {"empty": [""] * 5000, "short": [" ".join(["the cat sat on a mat"] * (1 + i % 4)) for i in range(3000)]}
    for rows in texts.values():
        docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
        placed = packing.pack(docs, capacity=1024).collect()
        ids, sequences = sum(r.length for r in placed), {r.sequence_id for r in placed}
        assert len(placed) == len(rows) and len(sequences) <= ids / 1024 * 1.02 + 1


def test_classes_cover_lengths_closely(spark):
    from pyspark.sql import functions as F

    from vectide.llm import packing

    for capacity in (4096, 1000):
        for r in spark.range(1, capacity + 1).select("id", packing.class_width(F.col("id"), capacity).alias("width")).collect():
            assert r.id <= r.width <= min(capacity, r.id + min(15, r.id // packing.EXACT))


def test_knapsack_is_the_best():
    import numpy as np

    from vectide.llm import packing

    rng = np.random.default_rng(3)
    for _ in range(20):
        width = np.sort(rng.choice(np.arange(1, 120), 25, replace=False))
        price = width / 200 * rng.uniform(0.7, 1.3, 25)
        best = [0.0]
        for c in range(1, 201):
            best.append(max([best[-1], *(p + best[c - w] for p, w in zip(price, width, strict=True) if w <= c)]))
        value, count = packing.knapsack(price, width, 200)
        assert abs(value - best[200]) < 1e-9 and abs(count @ price - value) < 1e-9 and count @ width <= 200


def test_column_generation_is_near_the_bound():
    from vectide.llm import packing

    rng = random.Random(2)
    counts = collections.Counter(min(256, int(rng.lognormvariate(3, 1)) + 1) for _ in range(20000))
    plan = packing.plan(dict(counts), 256)
    width = sorted(counts)
    made = collections.Counter()
    for copies, column in plan:
        assert sum(w * int(n) for w, n in zip(width, column, strict=True)) <= 256
        for w, n in zip(width, column.tolist(), strict=True):
            made[w] += copies * n
    assert made == counts
    least = math.ceil(sum(w * n for w, n in counts.items()) / 256)
    assert sum(c for c, _ in plan) <= 1.02 * least + 5


def test_words_beyond_the_table_are_encoded_too(monkeypatch):
    import pyarrow as pa

    from vectide.llm import tokens

    monkeypatch.setattr(tokens, "SLOT_BITS", 5)
    monkeypatch.setattr(tokens, "KEPT_IDS", 900)
    own = tokens.WordTokenizer(tokens.default_tokenizer())
    rng = random.Random(5)
    sizes = []
    for _ in range(40):
        texts = [" ".join("".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 24 if rng.random() < 0.3 else 4))) for _ in range(rng.randint(0, 30))) for _ in range(6)]
        ids, off = own.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids
        sizes.append(len(own.ids))
    assert max(sizes) < 3000 and (own.size <= tokens.LONGEST).all() and own.size.any()


def test_special_strings_are_encoded_as_the_tokenizer_does():
    import pyarrow as pa

    from vectide.llm.tokens import WordTokenizer, default_tokenizer

    own = WordTokenizer(default_tokenizer())
    texts = ["a <|endoftext|> b", "don't  stop now", "ΣΑΣ é", "x<|startoftext|>y z"]
    for _ in range(2):
        ids, off = own.encode(pa.array(texts))
        for i, t in enumerate(texts):
            assert ids[off[i] : off[i + 1]].tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


def test_spots(spark, folder, docs):
    by_id = sorted(((i, t or "") for i, t, *_ in docs), reverse=True)
    rows = {r.doc_id: r for r in q.op8_spots(spark, folder).collect()}
    for (i, t), (j, after) in zip(by_id, by_id[1:] + by_id[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + after[:half]
        r = rows[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
        if t == after:
            assert r.near_next == 1 and r.fingerprint == rows[j].fingerprint
    long = [r for r in rows.values() if r.n_chars > 300]
    assert sum(r.near_edited for r in long) > sum(r.near_next for r in long)


def plain_spots(text):
    """The signatures' words by the definition: (anchor, next content words), or of every word in a text without anchors."""
    from vectide.llm import spots

    words = re.findall("[A-Za-z0-9\u0080-\U0010ffff]+", lower(text or ""))
    content = [i for i, w in enumerate(words) if w not in spots.ANCHORS]
    anchors = [i for i, w in enumerate(words) if w in spots.ANCHORS]
    bare = not anchors
    found, alone = set(), set()
    for i in range(len(words)) if bare else anchors:
        after = [j for j in content if j >= i] if bare else [j for j in content if j > i]
        chain = tuple(words[after[k * spots.SPACING]] if k * spots.SPACING < len(after) else None for k in range(spots.CHAIN))
        (found if any(chain) else alone).add((None if bare else words[i], chain))
    return found or alone


def test_spots_against_plain_signatures(spark, folder, docs):
    def likeness(a, b):
        return 1.0 if not a and not b else len(a & b) / len(a | b)

    by_id = sorted(((i, t or "") for i, t, *_ in docs if len(t or "") < 20000), reverse=True)
    sets = {i: plain_spots(t) for i, t in by_id}
    rows = {r.doc_id: r for r in q.op8_spots(spark, folder).collect()}
    following = dict(zip([i for i, *_ in sorted(docs, reverse=True)], [i for i, *_ in sorted(docs, reverse=True)][1:], strict=False))
    texts = {i: t or "" for i, t, *_ in docs}
    for i, t in by_id:
        r = rows[i]
        assert len(base64.b64decode(r.fingerprint)) == 4 * len(sets[i])
        j = following.get(i)
        if j in sets:
            half = len(t) // 2
            assert r.near_next == pytest.approx(likeness(sets[i], sets[j]))
            assert r.near_edited == pytest.approx(likeness(sets[i], plain_spots(t[: len(t) - half] + texts[j][:half])))
    same = collections.defaultdict(set)
    for i in sets:
        same[frozenset(sets[i])].add(rows[i].fingerprint)
    assert all(len(v) == 1 for v in same.values()) and len(same) == len({rows[i].fingerprint for i in sets})


def test_spots_cut_into_many_parts(spark, monkeypatch):
    """Parts, rows without an id and repeated ids: every row once, each followed by the next in order."""
    from vectide.llm import spots

    rng = random.Random(6)
    rows = [(i, f"t{i}") for i in rng.sample(range(-500, 5000), 300)] + [(None, f"n{i}") for i in range(60)] + [(7000, "b"), (7000, "a")]
    monkeypatch.setattr(spots, "groups_for", lambda *a: 40)
    import pyarrow as pa

    got = spots.with_successors(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), lambda i, t, s: pa.RecordBatch.from_arrays([pa.array(i, pa.int64()), pa.array(t), pa.array(s)], ["i", "t", "s"]), "i long, t string, s string").collect()
    assert sorted((r.i is None, r.i, r.t) for r in got if r.i is not None) == sorted((False, i, t) for i, t in rows if i is not None) and len(got) == len(rows)
    after = {r.t: r.s for r in got}
    known = sorted(((-i, t) for i, t in rows if i is not None))
    at = [t for _, t in known]
    assert all(after[a] == b for a, b in zip(at, at[1:], strict=False)) and after[at[-1]].startswith("n")
    seen, t = [], at[-1]
    for _ in range(60):
        t = after[t]
        seen.append(t)
    assert sorted(seen) == sorted(f"n{i}" for i in range(60)) and after[t] == at[0]


def test_language_against_plain_ranks(spark, tmp_path):
    """Profiles, out-of-place distances and scores by their definition, over 200 documents."""
    import unicodedata

    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text", "lang", F.lit("x").alias("rank")).collect()
    rows = [tuple(r) for r in rows][:200] + [(100001, "ΑΒΓ δεζ αβγ", "el", "x"), (100002, "αβγ δεζ", "el", "x"), (100003, "123", "el", "x"), (100005, "βγ", "el", "x")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, rank string").write.parquet(str(tmp_path / "documents.parquet"))

    def grams(text):
        runs = "".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split()
        whole = f" {' '.join(runs)} " if runs else ""
        found = collections.Counter(whole[i : i + k] for k in (1, 2, 3) for i in range(len(whole) - k + 1))
        del found[" "]
        return found

    held = {i: zlib.crc32(str(i).encode()) % 5 == 0 for i, *_ in rows}
    each = {i: grams(t) for i, t, *_ in rows}
    total = collections.defaultdict(collections.Counter)
    for i, t, lang, _ in rows:
        if not held[i] and t is not None and lang is not None:
            total[lang].update(each[i])
    spelled = lambda g: [ord(c) for c in g]
    code = lambda g: [0] * (3 - len(g)) + [x + 1 for x in spelled(g)]
    profile = {k: {g: r for r, g in enumerate(sorted(c, key=lambda g: (-c[g], code(g)))[:400])} for k, c in total.items()}
    over_all = collections.Counter()
    for k, p in profile.items():
        over_all.update({g: total[k][g] for g in p})
    common = {g: r for r, g in enumerate(sorted(over_all, key=lambda g: (-over_all[g], code(g))))}
    for r in q.op7_language(spark, str(tmp_path)).collect():
        own = each[r.doc_id]
        if not own:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        ranked = sorted(own, key=lambda g: (-own[g], common.get(g, len(common))))[:400]
        far = {k: sum(min(abs(at - p.get(g, 10**9)), 400) for at, g in enumerate(ranked) if g in common) for k, p in profile.items()}
        best = sorted(far, key=lambda k: (far[k], k))
        assert r.lang_pred == best[0]
        a, b = far[best[0]], far[best[1]]
        assert r.score == pytest.approx(b / (a + b) if a + b else 0.5)


def test_spot_join_equals_all_pairs(spark, docs):
    import itertools

    import pyarrow as pa

    from vectide.llm import spots

    rows = [(i, t) for i, t, *_ in docs]
    sets = {i: s for (i, _), s in zip(rows, spots.fingerprints(pa.array([t for _, t in rows], pa.string())), strict=True)}
    first = {}
    for i, s in sorted(sets.items()):
        first.setdefault(s.tobytes(), i)
    want = {(a, b) for a, b in itertools.combinations(sorted(i for i in first.values() if len(sets[i])), 2) if spots.jaccard(sets[a], sets[b]) >= 0.5}
    got = {tuple(sorted((r.a, r.b))) for r in spots.similar(spark.createDataFrame(rows, "doc_id long, text string"), 0.5).collect()}
    assert got == want and want


def test_mixture_base(spark, folder, docs):
    words = {i: [*WORD.findall(lower(t or "")), None] for i, t, *_ in docs}
    train = [i for i in words if zlib.crc32(str(i).encode()) % 5 != 1]
    count = collections.Counter(w for i in train for w in words[i])
    total, kinds = sum(count.values()), len(count)
    rows = {r.doc_id: r for r in q.op9_mixture(spark, folder).collect()}
    for i, w in words.items():
        base = sum(math.log10((count[x] + 0.5) / (total + 0.5 * (kinds + 1))) for x in w)
        r = rows[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (i not in train, len(w), sum(count[x] > 0 for x in w), total)
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score < 0


def test_mixture_bits_are_a_distribution():
    import numpy as np
    import pyarrow as pa

    from vectide.llm import mixture
    from vectide.llm.text import Words

    code = mixture.Code.of(np.arange(1, 257))
    model = mixture.Model.of(code, 16, [])
    one = [bytes([b]).decode("latin-1") for b in range(33, 127) if not 65 <= b <= 90]
    words = Words(pa.array([" ".join(one)]))
    scores = model.word_scores(words, np.arange(len(words)))
    assert 0 < (10.0**scores).sum() <= 1 + 1e-9
    kraft = (0.5 ** code.size).sum()
    assert kraft == pytest.approx(1)


def test_mixture_sees_the_order_of_words(spark):
    from vectide.llm import mixture

    line = "the quick brown fox jumps over the lazy dog while seven old wizards keep watch"
    rows = [(i, line) for i in range(40)] + [(1000, line), (1001, " ".join(sorted(line.split(), key=lambda w: w[::-1])))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    scores = {r.doc_id: r.score for r in mixture.score(docs, mixture.train(docs.where("doc_id < 1000"))).collect()}
    assert scores[1000] - scores[1001] > 5


def plain_probability(model, node, slots):
    """Of a one, in plain floats."""
    weights = model.weights[4 * int(model.known[3][slots[3]]) + int(model.known[2][slots[2]])]
    x = sum(float(w) * float(model.guess[k][s]) for k, (w, s) in enumerate(zip(weights, slots, strict=True)))
    at = min(max(x + 12, 0), 23.999)
    low = int(at)
    refined = float(model.refine[node][low]) * (1 - (at - low)) + float(model.refine[node][low + 1]) * (at - low)
    return min(max((1 / (1 + math.exp(-x)) + refined) / 2, 1e-5), 1 - 1e-5)


def test_mixture_against_a_plain_predictor():
    """Counts and scores of whole spellings, symbol by symbol, against those shared by distinct words and heads."""
    import numpy as np
    import pyarrow as pa

    from vectide.llm import mixture
    from vectide.llm.text import Words

    words = Words(pa.array(["Ab c the abacus", "", None, "x theory c the", "c abacus the"]))
    learner = mixture.Learner(mixture.Code.of(np.arange(1, 257)), 16)
    learner.read(words)
    every = mixture.Spelling.of(words, np.arange(len(words)), *mixture.tails(words))
    want, place, met, last = collections.Counter(), collections.Counter(), set(), None
    names = [words.word(i).lower() for i in range(len(words))] + [None] * 5
    per_word = collections.defaultdict(list)
    sizes = learner.code.size[every.symbol]
    events = [(w, n, b, tuple(s)) for word, node, bit, slots in every.events(learner.code, 16) for w, n, b, *s in zip(word.tolist(), node.tolist(), bit.tolist(), *(x.tolist() for x in slots), strict=True)]
    at = 0
    for symbol, size in zip(every.symbol.tolist(), sizes.tolist(), strict=True):
        word = events[at][0]
        if word != last and last is not None:
            met.add(names[last])
        last = word
        for w, _, bit, slots in events[at : at + size]:
            if place[w] < mixture.HEAD or names[w] not in met:
                want.update((k, s, bit) for k, s in enumerate(slots))
        per_word[word] += events[at : at + size]
        place[word] += 1
        at += size
        assert symbol == mixture.END or place[word] <= len(names[word]) + 1
    got = {(int(k), int(s), int(b)): int(learner.counts[k, s, b]) for k, s, b in np.argwhere(learner.counts)}
    assert got == want
    blocks = [(k, mixture.shown(b) if k < mixture.TABLES * (1 << 16) // mixture.BLOCK else b.tobytes()) for k, b in ((k, b.astype(np.uint64)) for k, b in learner.blocks())]
    model = mixture.Model.of(learner.code, 16, blocks)
    _, first, back = mixture.hashed(words)
    plain = [sum(math.log10(p if bit else 1 - p) for _, node, bit, slots in per_word[w] for p in [plain_probability(model, node, slots)]) for w in range(len(words) + 5)]
    assert np.allclose(model.text_scores(words, first, back), plain, rtol=1e-4)


def test_mixture_reads_texts_without_new_words(spark, tmp_path):
    """Stretches whose words were all met before, texts of one-letter words alone, and chunks that end with the last symbol."""
    import numpy as np
    import pyarrow as pa

    from vectide.llm import mixture
    from vectide.llm.text import Words

    learner = mixture.Learner(mixture.Code.of(np.arange(1, 257)), 16)
    for text in ("the abacus", "the abacus", "a b", ""):
        learner.read(Words(pa.array([text])))
    spelling = mixture.Spelling.of(Words(pa.array(["abacus"])), np.arange(1))
    whole = sum(len(bit) for _, _, bit, _ in spelling.events(learner.code, 16))
    assert whole == learner.code.size[spelling.symbol].sum()
    for chunk in (whole, whole // 3, 1):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(mixture, "CHUNK", chunk)
            assert sum(len(bit) for _, _, bit, _ in spelling.events(learner.code, 16)) == whole
    spark.createDataFrame([(i, "a b") for i in range(20)], "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    assert all(r.score < 0 and r.n_known == 3 for r in mixture.score(docs, mixture.train(docs)).collect())


def test_mixture_learns_online():
    import numpy as np
    import pyarrow as pa

    from vectide.llm import mixture
    from vectide.llm.text import Words

    rng = random.Random(4)
    letters = "aaaabbbccd"
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(300)) for _ in range(40)]
    learner = mixture.Learner(mixture.Code.of(np.arange(1, 257)), 18)
    before = learner.weights.copy()
    for i in range(0, 40, 10):
        learner.read(Words(pa.array(texts[i : i + 10])))
    assert (learner.weights != before).any() and learner.steps.sum() > 10000 and learner.seen.sum() == pytest.approx(learner.steps.sum(), rel=1e-3)
    blocks = [(k, mixture.shown(b) if k < mixture.TABLES * (1 << 18) // mixture.BLOCK else b.tobytes()) for k, b in ((k, b.astype(np.uint64)) for k, b in learner.blocks())]
    model = mixture.Model.of(learner.code, 18, blocks)
    fresh = Words(pa.array(["".join(rng.choice(letters) for _ in range(8)) for _ in range(500)]))
    bits = -model.word_scores(fresh, np.arange(500))[:500].mean() / math.log10(2) / 9
    plain = -mixture.Model.of(learner.code, 18, []).word_scores(fresh, np.arange(500))[:500].mean() / math.log10(2) / 9
    assert bits < 2.4 < plain


def plain_word_events(lexicon, texts):
    """Of each text: its symbols with (node, bit, slots) of each bit, word by word; None is a slot of no use. OTHER and END have no word."""
    import numpy as np
    import pyarrow as pa

    from vectide.llm import wordbits
    from vectide.llm.text import Words, mix

    def hash_of(word):
        return int(Words(pa.array([word])).hashes(lower=True)[0])

    known, whole = {int(k): i for i, k in enumerate(lexicon.keys)}, (1 << 64) - 1
    for text in texts:
        names = (text or "").split()
        hashes = [hash_of(w) for w in names]
        symbols = [known.get(h, lexicon.other) for h in hashes] + [lexicon.end]
        out = []
        for i, symbol in enumerate(symbols):
            near = [j for j in range(i - 1) if symbols[j] < lexicon.other and lexicon.size[symbols[j]] <= wordbits.NEAR]
            sources = [i - 1 if i else None, near[-1] if near else None]
            bits = []
            for place in range(lexicon.size[symbol]):
                node, slots = int(lexicon.node[lexicon.first[symbol] + place]), []
                for k, at in enumerate(sources):
                    context = int(mix(np.array([((0 if at is None else hashes[at]) * int(wordbits._MUL) + k + 1) & whole], np.uint64))[0])
                    deep = lexicon.deep[lexicon.end if at is None else symbols[at]]
                    slots.append((((context + node * int(wordbits._SALT)) * int(wordbits._MUL)) & whole) >> (64 - lexicon.bits) if place < deep else None)
                bits.append((node, int(lexicon.bit[lexicon.first[symbol] + place]), slots))
            out.append((symbol, names[i] if i < len(names) else None, bits))
        yield out


def plain_bit(model, node, slots):
    """Probability of a one by the logistic mix of all three guesses, in plain floats."""
    states, guesses = [0, 0], [float(model.guess[node]), 0.0, 0.0]
    for k, slot in enumerate(slots):
        if slot is not None:
            both = int(model.tables[k][slot])
            guesses[k + 1], states[k] = (both >> 8) / 8, both & 255
    x = sum(g * float(w) for g, w in zip(guesses, model.weights[states[0] * 16 + states[1]], strict=True))
    return min(max(1 / (1 + math.exp(-x)), 1e-5), 1 - 1e-5)


@pytest.mark.parametrize("bits", [4, 16])
def test_mixture_counts_words_as_often_as_they_occur(monkeypatch, bits):
    import numpy as np
    import pyarrow as pa

    from vectide.llm import mixture, wordbits
    from vectide.llm.text import Words

    monkeypatch.setattr(wordbits, "LEAST_BITS", bits)
    monkeypatch.setattr(wordbits, "MOST_BITS", bits)
    texts = ["the cat and the dog and the cat saw a bird", None, "", "The cat", "a dog saw the owl and a cat"]
    words = Words(pa.array(texts))
    keys, _, back = mixture.hashed(words)
    times = np.bincount(back)
    often = times > 1
    lexicon = wordbits.Lexicon.of(keys[often], times[often] * 5, int(times[~often].sum()), len(texts), mixture.Code.of)
    assert (lexicon.deep < 1 << 30).all() == (bits == 4)
    learner = wordbits.WordLearner(lexicon)
    for _ in range(3):
        learner.read(wordbits.Stream(lexicon, words, words.hashes(lower=True)))
    nodes, slots = collections.Counter(), collections.Counter()
    for text in plain_word_events(lexicon, texts):
        for _, _, events in text:
            for node, bit, of in events:
                nodes[node, bit] += 3
                slots.update({(k, s, bit): 3 for k, s in enumerate(of) if s is not None})
    assert {(int(i), int(b)): int(learner.nodes[i, b]) for i, b in np.argwhere(learner.nodes)} == nodes
    assert {(int(k), int(s), int(b)): int(learner.counts[k, s, b]) for k, s, b in np.argwhere(learner.counts)} == slots
    assert (learner.weights != wordbits.first_weights()).any()


def test_mixture_score_is_mixed_bits_alone(spark, tmp_path):
    """nothing is added to the mixed bits, and the bits of all symbols after a word are a distribution."""
    import numpy as np
    import pyarrow as pa

    from vectide.llm import mixture
    from vectide.llm.text import Words

    texts = ["the cat and the dog", None, "the dog saw Unheardof things", "", "the cat and the dog", "a cat and a dog saw the cat", "qux the cat"] * 9
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "t"))
    docs = spark.read.parquet(str(tmp_path / "t"))
    model = mixture.train(docs)
    got = {r.doc_id: r.score for r in mixture.score(docs, model).collect()}
    lexicon = model.words.lexicon
    odd = ["the zebra dog", "zebra"]
    for text, i in [*((t, i) for i, t in enumerate(texts[:7])), *((t, None) for t in odd)]:
        words = Words(pa.array([text], pa.string()))
        _, first, back = mixture.hashed(words)
        spelled = model.spelling.text_scores(words, first, back)
        want = 0.0
        for at, (symbol, _, events) in enumerate(next(plain_word_events(lexicon, [text]))):
            want += sum(math.log10(p if bit else 1 - p) for node, bit, slots in events for p in [plain_bit(model.words, node, slots)])
            want += spelled[at] if symbol == lexicon.other else 0
        if i is None:
            assert model.scores(words, words.hashes(lower=True))[0] == pytest.approx(want, rel=1e-4)
        else:
            assert got[i] == pytest.approx(want, rel=1e-4)
    children = collections.defaultdict(float)
    names = ["the", "cat", "and", "dog", "saw", "a", "things", "Unheardof", "qux"]
    for name in [*names, "zebra", None]:
        symbol, _, events = next(plain_word_events(lexicon, [f"the {name}" if name else "the"]))[1]
        children[symbol] = math.prod(p if bit else 1 - p for node, bit, slots in events for p in [plain_bit(model.words, node, slots)])
    assert len(children) == len(lexicon.size) and sum(children.values()) == pytest.approx(1)
    assert np.isfinite(list(got.values())).all()


def test_mixture_handles_only_what_differs(monkeypatch):
    """Tokens alike in all contexts are scored once, words are hashed once, and a block's events take little memory."""
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    from vectide.llm import mixture, wordbits
    from vectide.llm.text import Words

    rng = random.Random(9)
    text = " ".join("".join(rng.choice("abcdef") for _ in range(rng.randint(1, 9))) for _ in range(400))
    words = Words(pa.array([text]))
    keys, _, back = mixture.hashed(words)
    times = np.bincount(back)
    lexicon = wordbits.Lexicon.of(keys[times > 1], times[times > 1], int((times == 1).sum()), 1, mixture.Code.of)
    code = mixture.Code.of(np.arange(1, 257))
    learner = wordbits.WordLearner(lexicon)
    learner.read(wordbits.Stream(lexicon, words, words.hashes(lower=True)))
    model = wordbits.WordModel.blank(lexicon)
    model.learn_nodes(learner.nodes)
    model.tables[:, :-1] = [wordbits.packed(x[:-1]) for x in learner.counts]
    both = mixture.Mixture(model, mixture.Model.of(code, 16, []))

    handled, hashings, events, hashes = [], [], wordbits.Stream.events, Words.hashes

    def counted(self, *args):
        for chunk in events(self, *args):
            handled.append(len(chunk[2]))
            yield chunk

    monkeypatch.setattr(wordbits.Stream, "events", counted)
    monkeypatch.setattr(Words, "hashes", lambda self, *a, **b: (hashings.append(1), hashes(self, *a, **b))[1])

    def scored(texts):
        handled.clear(), hashings.clear()
        words = Words(pa.array(texts))
        return both.scores(words, words.hashes(lower=True)), sum(handled), len(hashings)

    one, n, _ = scored([text])
    many, m, hashed = scored([text, "", None, *[text] * 19])
    assert np.allclose(np.delete(many, (1, 2)), one[0], rtol=1e-6) and many[1] == many[2] < 0
    assert m <= n + lexicon.size[lexicon.end] and hashed == 1

    fresh = Words(pa.array([" ".join("".join(rng.choice("abcdefgh") for _ in range(8)) for _ in range(20000))]))
    learner = mixture.Learner(code, 16)
    tracemalloc.start()
    try:
        learner.read(fresh, np.arange(len(fresh)))
        assert tracemalloc.get_traced_memory()[1] < 60 << 20
    finally:
        tracemalloc.stop()


def test_mixture_finds_words_and_states():
    import numpy as np

    from vectide.llm import mixture, wordbits

    rng = np.random.default_rng(3)
    top = (1 << 64) - 1
    near = [0, 1, 2, 1 << 40, (1 << 40) + 1, *range(top - 70, top + 1), *((7 << 60) + i for i in range(90))]
    for keys in ([], [0], [top], near, [*near, *rng.integers(0, top, 5000, np.uint64, True).tolist()]):
        keys = np.unique(np.array(keys, np.uint64))
        lexicon = wordbits.Lexicon.of(keys, np.ones(len(keys), np.int64), 1, 1, mixture.Code.of)
        asked = rng.permutation(np.concatenate([keys, keys + np.uint64(1), keys - np.uint64(1), rng.integers(0, top, 1000, np.uint64, True)]))
        place = {k: i for i, k in enumerate(keys.tolist())}
        assert lexicon.symbols(asked).tolist() == [place.get(h, lexicon.other) for h in asked.tolist()]
    pairs = [(z, o) for z in range(140) for o in range(140)] + [(1 << 24, 0), ((1 << 31) - 1, 1), (0, (1 << 31) - 1)]
    want = [min((z + o).bit_length(), 7) * 2 + (z > 0 and o > 0) for z, o in pairs]
    assert wordbits.state_of(*wordbits.some_of(np.array(pairs, np.int32).reshape(-1))).tolist() == want


def test_mixture_beats_the_base_at_scale(spark):
    sf = "/root/testdata/sf0.1"
    size = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", F.octet_length("text").alias("bytes"))
    rows = {r.held_out: r for r in q.op9_mixture(spark, sf).join(size, "doc_id").groupBy("held_out").agg(F.sum("score").alias("score"), F.sum("base_score").alias("base"), F.sum("bytes").alias("bytes")).collect()}
    assert rows[False].score > rows[False].base
    assert -rows[True].score / math.log10(2) / rows[True].bytes < 2.15


def test_mixing(spark, folder, docs):
    rows = q.op10_mixing(spark, folder).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in docs}
    source = {r[0]: r[3] for r in docs}
    per = collections.Counter()
    for i, s in source.items():
        per[s] += size[i]
    names = sorted((s for s in per if s is not None)) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while True:
        rest = sum(per.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * per[s]]
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3 * per[s]
            free.discard(s)
    taken = collections.Counter()
    for r in rows:
        assert (r.size, r.source_size) == (size[r.doc_id], per[source[r.doc_id]])
        assert r.target == pytest.approx(target[source[r.doc_id]]) and r.taken <= 3 * r.size
        taken[source[r.doc_id]] += r.taken
    for s in names:
        largest = max(size[i] for i in source if source[i] == s)
        assert abs(taken[s] - target[s]) <= largest


def test_training_order_follows_the_schedule(spark):
    from vectide.llm import mixing

    rows = spark.createDataFrame([(i, "w " * 5, s) for i, s in enumerate("a" * 300 + "b" * 300 + "c" * 300)], "doc_id long, text string, source string")
    order = mixing.training_order(mixing.mix_sources(rows), 4).collect()
    assert [r.position for r in order] == sorted(r.position for r in order)
    early, late = order[: len(order) // 2], order[len(order) // 2 :]
    ids = lambda part, low, high: sum(low <= r.doc_id < high for r in part)
    assert ids(early, 0, 300) > 1.2 * ids(late, 0, 300) and ids(early, 600, 900) < ids(late, 600, 900)


def test_toxicity_and_language_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    hits = collections.Counter((labels[r.doc_id], r.predicted) for r in q.op3_toxicity(spark, sf).collect() if r.held_out and r.doc_id in labels)
    assert hits[1, 1] / (hits[1, 1] + hits[1, 0]) > 0.7 and hits[1, 1] / (hits[1, 1] + hits[0, 1]) > 0.95
    lang = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()}
    right = [r.lang_pred == lang[r.doc_id] for r in q.op7_language(spark, sf).collect() if r.held_out]
    assert sum(right) / len(right) > 0.98


def test_ftrl_against_plain_updates():
    """Weights after each batch of documents, coordinate by coordinate."""
    import numpy as np

    from vectide.llm import toxicity

    rng = np.random.default_rng(3)
    docs = [np.unique(rng.integers(0, 30, rng.integers(1, 12))) for _ in range(60)]
    y = np.array([float((d < 6).any()) for d in docs])
    params = toxicity.Ftrl(l1=0.4, epochs=3)
    bucket, weight, bias = params.fit(docs, y)
    size = 1 << toxicity.BITS
    z, n = collections.Counter(), collections.Counter()

    def w(i):
        return 0.0 if abs(z[i]) <= params.l1 else -(z[i] - math.copysign(params.l1, z[i])) / ((params.beta + math.sqrt(n[i])) / params.alpha + params.l2)

    order = np.random.default_rng(7)
    for _ in range(params.epochs):
        for chosen in np.array_split(order.permutation(len(docs)), len(docs) // params.batch):
            gradient, square = collections.Counter(), collections.Counter()
            for i in chosen:
                own = [*docs[i].tolist(), size]
                error = 1 / (1 + math.exp(-sum(map(w, own)))) - y[i]
                for f in own:
                    gradient[f] += error
                    square[f] += error * error
            old = {f: w(f) for f in gradient}
            for f in gradient:
                z[f] += gradient[f] - (math.sqrt(n[f] + square[f]) - math.sqrt(n[f])) / params.alpha * old[f]
                n[f] += square[f]
    want = {f: w(f) for f in range(30) if w(f)}
    assert dict(zip(bucket.tolist(), weight.tolist(), strict=True)) == pytest.approx(want) and bias == pytest.approx(w(size))
    assert 0 < len(want) < 30 and all(want.get(f, 0) >= 0 for f in range(6))


def test_toxicity_features_are_grams_skips_and_stems():
    import pyarrow as pa

    from vectide.llm import toxicity
    from vectide.llm.text import Words

    def found(*texts):
        owner, bucket = toxicity.features(Words(pa.array(texts), plain=True))
        return [set(bucket[owner == i].tolist()) for i in range(len(texts))]

    a, b, c, d = found("one two three", "ONE, two! three", "one x three", "")
    assert a == b and len(a) == 3 + 2 + 1 and d == set() and len(a & c) == 3  # both words and the pair that skips one
    long, short = found("abcdefghij", "abcdefgxyz")
    assert len(long & short) == 3 and len(long) == 5  # stems of 5, 6 and 7 bytes


def test_viterbi_finds_the_best_labels():
    """Against all label sequences, of short rows of words in one batch."""
    import itertools

    import numpy as np

    from vectide.llm import pii

    crf = pii.model()
    texts = ["call (555) 013-2244 now", "mail jo at x dot org", "ok", "10.1.2.3:80 is up"]
    rows = [pii.word_features(t.split()) for t in texts]
    for row, got in zip(rows, crf.decode(rows), strict=True):
        score = np.array([[sum(crf.emit[crf.names[f], k] for f in w if f in crf.names) for k in range(5)] for w in row])
        value = lambda path, s=score: sum(s[t, k] for t, k in enumerate(path)) + sum(crf.move[a, b] for a, b in zip(path, path[1:], strict=False))
        assert tuple(got.tolist()) == max(itertools.product(range(5), repeat=len(row)), key=value)


def test_stretches_are_labelled_as_whole_texts():
    """Plain words far from others are O, and the rest has the labels that decoding whole texts gives."""
    from vectide.llm import pii

    assert 1 <= pii.reach() < pii.MOST
    rng = random.Random(12)
    some = ["at", "dot", "(555)", "013-2244", "10.1.2.3:80", "06", "12", "34", "x.com", "(at)", "4111.1111.1111.1111", "a-b", "it's", "2024", "fe80::1"]
    crf = pii.model()
    for _ in range(150):
        rate = rng.choice([0.02, 0.1, 0.4])
        words = [rng.choice(some) if rng.random() < rate else "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 16))) for _ in range(rng.randint(1, 150))]
        text = " ".join(words)
        (whole,) = crf.decode([pii.word_features(words)])
        at = {}
        place = 0
        for w, label in zip(words, whole.tolist(), strict=True):
            at[place] = label
            place += len(w) + 1
        seen = set()
        parts = pii.sequences(text)
        for part, labels in zip(parts, crf.decode([pii.word_features([w for w, *_ in p]) for p in parts]), strict=True):
            around = 2 * pii.reach()
            odd = [i for i, (w, *_) in enumerate(part) if not pii.plain(w)]
            for i, ((_, start, _), label) in enumerate(zip(part, labels.tolist(), strict=True)):
                seen.add(start)
                if odd[0] - around // 2 <= i <= odd[-1] + around // 2:
                    assert at[start] == label, (text, start)
        assert all(label == 0 for start, label in at.items() if start not in seen)


def test_spans_of_unseen_rows_of_the_labelled_kinds():
    """Sentences like the labelled ones but of other words: what is found and what is left alone."""
    import pyarrow as pa

    from vectide.llm import pii

    private = {
        "write to {email tom dot gray at post dot sample dot org} today": "email",
        "send that to {email ana (at) site dot sample dot com} later": "email",
        "call me under {phone (646) 555-0171} at night": "phone",
        "his number is {phone 555-014-9921} for now": "phone",
        "please dial {phone 06 98 76 54 32} demain": "phone",
        "the server {ip 10.20.30.40:9090} is slow": "ip",
        "we reached {ip 2001:db8::beef:12:7} twice": "ip",
        "billed to {card 4111.1111.1111.1111} in may": "card",
    }
    clean = ["in 2004 there were 1200 people", "it shipped on 2023-04-05 at 11:45", "the dot on the page was at home", "version 3.2.1 costs 19.99", "commit 4f2a9c81d7e6b3a0 was merged", "item 200456789 and item 200456790 sold"]
    hit = 0
    for text, kind in private.items():
        start = text.index("{")
        inner = re.search(r"\{\w+ ([^}]*)\}", text)[1]
        plain = re.sub(r"\{\w+ ([^}]*)\}", r"\1", text)
        spans = pii.find(pa.array([plain]))[1][0]
        hit += any(k == kind and a < start + len(inner) and b > start for k, a, b in spans)
    assert hit >= 7 and pii.find(pa.array(clean))[1] == [[] for _ in clean]


def test_scores_ignore_labels_and_order(spark, folder, docs):
    rows = {r.doc_id: r for r in q.op7_language(spark, folder).collect()}
    assert rows[0].lang_pred == "und" and rows[3].lang_pred == "und"
    scores = {r.doc_id: r.score for r in q.op3_toxicity(spark, folder).collect()}
    assert all(0 <= s <= 1 for s in scores.values())
    assert scores[docs[3][0]] == scores[docs[4][0]] == scores[docs[5][0]]


def test_progressive_reader_handles_other_shapes():
    import numpy as np

    from vectide.llm import jpeg

    rng = np.random.default_rng(1)
    payloads = [rng.integers(0, 256, 64 * n, dtype=np.uint8).tobytes() for n in (1, 6, 7, 30)] + [bytes([128]) * 640, bytes([127, 129] * 320)]
    reader = jpeg.Reader(jpeg.encode(payloads))
    samples = reader.samples()
    for i, p in enumerate(payloads):
        assert reader.payload(i) == p
        assert reader.rgb(i, samples).shape == (reader.images[i].shape.height, reader.images[i].shape.width, 3)


@pytest.mark.parametrize("name", ["op2_substrings", "op4_minhash", "op10_mixing"])
def test_oracle(spark, name):
    import duckdb

    from vectide.llm.sql import ORACLES

    sf = "/root/testdata/sf0.001"
    c = duckdb.connect()
    c.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    rounded = lambda row: tuple(round(x, 4) if isinstance(x, float) else x for x in row)
    df = getattr(q, name)(spark, sf)
    found = c.sql(ORACLES[name])
    assert sorted(found.columns) == sorted(df.columns)
    want = found.select(", ".join(df.columns)).fetchall()
    assert sorted(map(rounded, map(tuple, df.collect()))) == sorted(map(rounded, want)) and want
