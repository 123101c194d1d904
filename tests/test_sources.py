import gzip
import hashlib
import threading
from http.server import BaseHTTPRequestHandler, ThreadingHTTPServer

import numpy as np
import pytest

from vectide.sources import binary, text


def test_vecs(spark, tmp_path):
    x = np.arange(12, dtype="<f4").reshape(3, 4)
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.uint32(4).tobytes() + r.tobytes() for r in x))
    t = np.array([[3, 1, 2], [5, 4, 0]], "<i4")
    (tmp_path / "t.ivecs").write_bytes(b"".join(np.uint32(3).tobytes() + r.tobytes() for r in t))
    rows = binary.read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("id").collect()
    assert [r.embedding for r in rows] == x.tolist()
    got = binary.read_ivecs(spark, str(tmp_path / "t.ivecs"), 2).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.id) for r in got] == [(0, 3), (0, 1), (1, 5), (1, 4)]
    with pytest.raises(ValueError):
        binary.vecs(b"\x04\0\0\0abc", np.dtype("<f4"))


@pytest.mark.parametrize("kind", ["f32", "u32", "u64", "u8"])
def test_matrix(spark, tmp_path, kind):
    x = np.arange(6).reshape(2, 3).astype(binary.TYPES[kind][0])
    (tmp_path / "m.bin").write_bytes(b"skip" + np.array([2, 3], "<u4").tobytes() + x.tobytes())
    rows = binary.read_matrix(spark, str(tmp_path / "m.bin"), kind, 4).orderBy("id").collect()
    assert [r.embedding for r in rows] == x.tolist()


def test_text_sources(spark, tmp_path):
    with gzip.open(tmp_path / "v.tsv.gz", "wt") as f:
        f.write("a\t[1.0, 2.0]\n\nb\tnot json\nc\t[3.0]\n")
    rows = text.read_tsv_vectors(spark, str(tmp_path / "v.tsv.gz")).orderBy("path").collect()
    assert [(r.path, r.embedding) for r in rows] == [("a", [1.0, 2.0]), ("c", [3.0])]
    line = "\t".join(["entailment", *"1234", "s1", "s2"])
    (tmp_path / "l.tsv").write_text(f"{line}\nneutral\t1\t2\t3\t4\tx\ty\n")
    assert [(r.a, r.b, r.label) for r in text.read_pair_labels(spark, str(tmp_path / "l.tsv")).collect()] == [("s1", "s2", 1)]
    (tmp_path / "e.json").write_text('"record"\n{"sentence": "s1", "embeddings": [1.0]}\n')
    assert [r.sentence for r in text.read_sentences(spark, str(tmp_path / "e.json")).collect()] == ["s1"]
    (tmp_path / "img").mkdir()
    for name in ("a.png", "b.txt", "c.JPEG"):
        (tmp_path / "img" / name).write_bytes(b"x")
    assert text.read_images(spark, str(tmp_path / "img")).count() == 2


def test_models_and_downloads(tmp_path):
    assert text.models("models:\n- name: x\n  class: E5\n  num_threads: 4\n") == [{"name": "x", "class": "E5", "num_threads": 4}]
    assert text.models(None)[0]["class"] == "CLIP"
    with pytest.raises(ValueError):
        text.models("- name: x\n")


class Server(BaseHTTPRequestHandler):
    """Serves BODY, from a place on if asked; nothing is left beyond its end."""

    BODY, asked = b"abcdefghij" * 1000, []

    def do_GET(self):
        Server.asked.append((self.path, self.headers["Range"], self.headers["User-Agent"]))
        start = int(self.headers["Range"][6:-1]) if self.headers["Range"] and self.path != "/whole" else 0
        if self.path == "/missing" or start >= len(self.BODY):
            self.send_error(404 if self.path == "/missing" else 416)
            return
        self.send_response(206 if start else 200)
        self.end_headers()
        self.wfile.write(self.BODY[start:])

    def log_message(self, *_):
        pass


@pytest.fixture
def server():
    own = ThreadingHTTPServer(("127.0.0.1", 0), Server)
    threading.Thread(target=own.serve_forever, daemon=True).start()
    Server.asked.clear()
    yield f"http://127.0.0.1:{own.server_port}"
    own.shutdown()
    own.server_close()


def test_download_is_resumed_and_checked(server, tmp_path):
    digest = hashlib.md5(Server.BODY).hexdigest()
    path = str(tmp_path / "m.bin")
    assert text.download(f"{server}/a", path, digest) == path and text.verified(path, digest)
    text.download(f"{server}/a", path, digest)
    assert len(Server.asked) == 1 and Server.asked[0][1:] == (None, text.AGENT)
    for start, place in ((4000, "/a"), (len(Server.BODY), "/a"), (4000, "/whole")):
        (tmp_path / "p.bin.part").write_bytes(Server.BODY[:start])
        again = text.download(f"{server}{place}", str(tmp_path / "p.bin"), digest)
        assert text.verified(again, digest) and Server.asked[-1][1] == f"bytes={start}-"
        (tmp_path / "p.bin").unlink()
    with pytest.raises(ValueError, match="MD5"):
        text.download(f"{server}/a", str(tmp_path / "w.bin"), "0" * 32)
    assert not list(tmp_path.glob("w.bin*"))


def test_images_by_address(spark, server):
    rows = spark.createDataFrame([(f"{server}/a",), (f"{server}/missing",), ("file:///etc/hosts",)], "uri string")
    got = {r.uri: r for r in text.fetch_images(rows).collect()}
    assert bytes(got[f"{server}/a"].content) == Server.BODY and got[f"{server}/a"].err_message is None
    assert "404" in got[f"{server}/missing"].err_message and "not an http" in got["file:///etc/hosts"].err_message


def test_quantizer_files(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres, centroid, offsets = rng.normal(size=(8, 5)).astype("<f4"), rng.normal(size=5).astype("<f4"), [0, 3, 5]
    raw = binary.packed_pivots(centres, centroid, offsets)
    for x, y in zip(binary.pivots(raw), (centres, centroid, offsets), strict=True):
        assert (x == np.asarray(y)).all()
    with pytest.raises(ValueError):
        binary.pivots(binary.packed_pivots(centres, centroid[:4], offsets))
    (tmp_path / "pivots.bin").write_bytes(raw)
    book = {(r.chunk, r.center): r.pivot for r in binary.read_pivots(spark, str(tmp_path / "pivots.bin")).collect()}
    assert len(book) == 16 and book[1, 7] == centres[7, 3:].tolist()
    coded = spark.createDataFrame([(i, c, (7 * i + c) % 8) for i in range(30) for c in range(2)], "eid long, chunk int, center int")
    parts = binary.write_codes(coded.repartition(4), str(tmp_path / "codes"), 2).collect()
    found = {}
    for i, r in enumerate(parts):
        (tmp_path / f"{i}.bin").write_bytes(bytes(r.content))
        codes = {x.id: x.embedding for x in binary.read_codes(spark, str(tmp_path / f"{i}.bin")).collect()}
        found |= {int(e): codes[k] for k, e in enumerate(r.eids)}
    assert found == {i: [(7 * i + c) % 8 for c in range(2)] for i in range(30)}


def test_sentences_are_written_as_they_are_read(spark, tmp_path):
    rows = spark.createDataFrame([("one", [1.0, 2.0]), ("two \"x\"", [3.0])], "sentence string, embedding array<float>")
    text.write_sentences(rows.repartition(2), str(tmp_path / "s"))
    assert sorted(map(tuple, text.read_sentences(spark, str(tmp_path / "s")).collect())) == sorted(map(tuple, rows.collect()))
