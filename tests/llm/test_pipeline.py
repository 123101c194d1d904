import collections
import hashlib
import re
import zlib

import corpus_pipeline as pipeline
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.test_operators import near_groups

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_copies(rows):
    """How often the mix draws each (doc_id, source, text), by the definition: targets, then documents in the order of a digest of the id."""
    size = {d: len(WORD.findall(t or "")) for d, _, t in rows}
    per = collections.Counter()
    for d, s, _ in rows:
        per[s] += size[d]
    names = sorted(s for s in per if s is not None) + [None] * (None in per)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free = {}, set(names)
    while free:
        rest = sum(per.values()) - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * per[s]]
        target |= {s: 3 * per[s] for s in over} if over else share
        free -= set(over) if over else free
    copies = {}
    for s in names:
        before, whole = 0, int(target[s] // per[s]) if per[s] else 0
        for d in sorted((d for d, x, _ in rows if x == s), key=lambda d: (hashlib.md5(str(d).encode()).hexdigest(), size[d])):
            more = before + size[d] / 2 <= target[s] - whole * per[s]
            copies[d] = whole + more if size[d] else 0
            before += size[d]
    return copies


def test_stages(spark):
    """Each stage against a plain version, on what the stage before has kept."""
    from tokenizers import Tokenizer

    from vectide.llm import pii, toxicity
    from vectide.llm.tokens import default_tokenizer

    sf = "/root/testdata/sf0.001"
    docs = pipeline.documents(spark, sf)
    stages = dict(pipeline.STAGES)
    assert list(stages) == ["toxicity", "minhash", "pii", "mixing", "packing"]

    clean = pipeline.stored(stages["toxicity"](spark, docs, sf))
    labels = spark.read.parquet(f"{sf}/labels.parquet").where(pipeline.remainder(F.col("doc_id"), 3) != 1)
    model = {r.bucket: r.weight for r in toxicity.train(docs, labels).collect()}
    raw = {}
    for r in docs.collect():
        _, found = toxicity.features(toxicity.Words(pa.array([r.text or ""]), plain=True))
        raw[r.doc_id] = model[-1] + sum(model.get(b, 0.0) for b in set(found.tolist()))
    assert clean.columns == docs.columns and 0.5 * docs.count() < clean.count() <= docs.count()
    at_least = 0.8472979  # the logarithm of 0.7 / 0.3
    assert {r.doc_id for r in clean.collect()} == {d for d, x in raw.items() if round(x, 6) < at_least}

    rows = [(r.doc_id, r.text) for r in clean.collect()]
    kept = pipeline.stored(stages["minhash"](spark, clean, sf))
    want = {c for _, c in near_groups(rows, 5).values()}
    assert {r.doc_id for r in kept.collect()} == want and kept.columns == docs.columns

    redacted = pipeline.stored(stages["pii"](spark, kept, sf))
    texts = {r.doc_id: r for r in redacted.collect()}
    for r in kept.collect():
        spans = pii.find(pa.array([r.text], pa.string()))[1][0]
        assert texts[r.doc_id].text == (pii.redact(r.text, spans) if spans else r.text)
    assert set(texts) == want and not any("@mail" in (r.text or "") for r in texts.values())
    assert all(r.n_chars == len(r.text) for r in texts.values() if "<EMAIL>" in (r.text or ""))

    mixed = pipeline.stored(stages["mixing"](spark, redacted, sf))
    copies = collections.Counter(r.doc_id for r in mixed.collect())
    drawn = plain_copies([(r.doc_id, r.source, r.text) for r in texts.values()])
    assert mixed.columns == docs.columns and copies == collections.Counter({d: n for d, n in drawn.items() if n}) and max(copies.values()) <= 3

    packed = stages["packing"](spark, mixed, sf).collect()
    tokenizer = Tokenizer.from_file(default_tokenizer())
    pieces, sequences = collections.Counter(), collections.defaultdict(list)
    for r in packed:
        pieces[r.doc_id, r.start, r.length, r.ids_crc32] += 1
        sequences[r.sequence_id].append((r.offset, r.length))
    expected = collections.Counter()
    for d, n in copies.items():
        ids = [*tokenizer.encode(texts[d].text or "", add_special_tokens=False).ids, 2]
        for at in range(0, len(ids), 4096):
            part = ids[at : at + 4096]
            expected[d, at, len(part), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in part))] += n
    assert pieces == expected
    for parts in sequences.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= 4096
    whole = pipeline.run(spark, sf)
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in whole.collect()) == expected


def test_repeated_and_missing_ids_in_near_duplicates(spark):
    """Rows are told apart: an id's other text stays, a copy without an id goes, the least id stays."""
    body = " ".join(f"w{i}" for i in range(40))
    other = " ".join(f"v{i}" for i in range(40))
    rows = [(5, body, "x"), (5, other, "x"), (None, body + " more", "x"), (3, body, "x"), (None, "all alone here", "x"), (9, None, "x"), (9, None, "x"), (7, other, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, row string").repartition(3)
    kept = pipeline.drop_near_duplicates(spark, docs, "")
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, (r.text or "")[:5]) for r in kept.collect()) == [(0, "all a"), (3, "w0 w1"), (5, "v0 v1"), (9, ""), (9, "")]


def test_columns_that_clash_with_names_inside(spark):
    rows = [(i, f"some words number {i}", "en", "s", 10, 1, "k", 2.0) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, copies int, row string, row_copy double")
    mixed = pipeline.mix(spark, docs, "")
    assert mixed.columns == docs.columns and 25 <= mixed.count() <= 35 and {r.copies for r in mixed.collect()} == {1}


def test_odd_rows_pass_every_stage(spark, tmp_path):
    rows = [(1, None, None, None, None, 5), (None, "no id", "en", None, 5, 5), (2, "", "en", "s", 0, 5), (3, "mail a@b.co", "en", "s", 11, 5), (3, "mail a@b.co", "en", "s", 11, 5)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, score long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = pipeline.documents(spark, str(tmp_path))
    for name, stage in pipeline.STAGES[:-1]:
        docs = pipeline.stored(stage(spark, docs, str(tmp_path)))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "score"], name
    assert pipeline.run(spark, str(tmp_path)).count() >= 1
