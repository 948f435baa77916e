"""Token packing, whitening and product codes against brute force, and on the odd cases they name."""

import hashlib
import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import anchors, harmonic, queries, whitening

public_tokenizers = pytest.importorskip("public_tokenizers")
SF = "/root/testdata/sf0.001"
VOCABULARY = public_tokenizers.path("word_bpe_49k.json")
VECTORS = "vec_id long, embedding array<double>, label int, x long, `code` string, n long"
NAN, INF = float("nan"), float("inf")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(VOCABULARY)


def vectors(spark, rows):
    """Vectors from (id, embedding, label); further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, v, la, 5, "c", 6) for i, v, la in rows], VECTORS)


def check_packing(texts, pieces, tokenizer, capacity=2048):
    """Every id once, in order, in gapless sequences; the share of padding."""
    want = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [1] for i, t in texts.items()}
    parts, places = {}, {}
    for p in pieces:
        assert p.length == len(p.ids) // 4 and p.doc_tokens == len(want[p.doc_id])
        parts.setdefault(p.doc_id, []).append((p.start, p.ids))
        places.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert set(parts) == set(want)
    for i, found in parts.items():
        found.sort()
        starts = [s for s, _ in found]
        assert starts == [0, *np.cumsum([len(b) // 4 for _, b in found])[:-1].tolist()]
        assert np.frombuffer(b"".join(b for _, b in found), "<u4").tolist() == want[i]
    padding = 0
    for found in places.values():
        found.sort()
        assert [o for o, _ in found] == [0, *np.cumsum([n for _, n in found])[:-1].tolist()]
        total = sum(n for _, n in found)
        assert 0 < total <= capacity
        padding += 0 if total & (total - 1) == 0 else capacity - total
    return padding / (padding + sum(map(len, want.values())))


def test_harmonic_packing(spark, tokenizer):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    pieces = harmonic.pack_tokens(docs.repartition(3, "doc_id").sortWithinPartitions("doc_id"), VOCABULARY).collect()
    assert check_packing({r.doc_id: r.text for r in docs.collect()}, pieces, tokenizer) < 0.005
    assert max(p.length for p in pieces) == 2048


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_agrees_with_the_tokenizer(name):
    """Words of any characters, special tokens among them, and a tokenizer of other rules."""
    from tokenizers import Tokenizer

    path, rnd = public_tokenizers.path(name), random.Random(1)
    texts = ["it's Foo'S 'sam don't", "<|endoftext|>A<|x <|startoftext|>É <|ENDOFTEXT|>", "a\x1cb\x85c\xa0d", "é \u0301x A\u030a", "ΑΣ ΣΑΣ. ǅ İI ﬁ",
             "\u2003 b\u3000c 1234 5.6,7 ½ ²", *(f"a{chr(c)}b" for c in range(0x3001) if chr(c).isspace()), "w" * 200, None, "", " \n"]
    for alphabet in ("aZéÀß!.,&(<|>×÷ÿ$ ^`_~", "aAbé'\u0301 \t\n.,<|>12ßΣİ\x1c\u3000st"):
        texts += ["".join(rnd.choice(alphabet) for _ in range(rnd.randint(1, 50))) for _ in range(500)]
    plain = Tokenizer.from_file(path)
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    encoder = harmonic.Encoder(path)
    assert encoder.apart == (name == "word_bpe_49k.json")
    for _ in range(2):  # from the tokenizer, then from the table
        assert [np.frombuffer(b, "<u4").tolist() for b in encoder.encode(texts)] == want


def test_harmonic_query(spark):
    pieces = {(r.doc_id, r.start): r for r in harmonic.pack_tokens(spark.read.parquet(f"{SF}/documents.parquet"), VOCABULARY).collect()}
    got = queries.op11_harmonic(spark, SF).collect()
    assert len(got) == len(pieces)
    assert all(r.ids_crc32 == zlib.crc32(pieces[r.doc_id, r.start].ids) for r in got)


@pytest.mark.parametrize("capacity, least_cut", [(64, 8), (64, 1), (16, 16)])
def test_harmonic_odd(spark, tokenizer, capacity, least_cut):
    texts = {1: None, 2: "", 3: " \n\t ", 4: "one", 5: "x" * 5000, 6: "it's <|endoftext|> a\x1cb\x85c\xa0d é ΑΣ. " * 3,
             7: "word " * 9000, 8: "tail", None: "without an id"}
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in texts.items()], "doc_id long, text string, start long, ids string")
    pieces = harmonic.pack_tokens(docs.coalesce(1), VOCABULARY, capacity, least_cut).collect()
    padding = check_packing(texts, pieces, tokenizer, capacity)
    assert least_cut > 1 or padding == 0
    for p in pieces:
        assert p.length <= capacity
    assert harmonic.pack_tokens(docs.limit(0), VOCABULARY).count() == 0
    twice = harmonic.pack_tokens(docs.filter("doc_id = 4").union(docs.filter("doc_id = 4")).coalesce(1), VOCABULARY)
    assert twice.agg(F.sum("length")).first()[0] == 2 * len(tokenizer.encode("one").ids + [1])


def test_harmonic_bins_hold_a_fixed_count():
    packer, out = harmonic.Packer(64, 64, 10), []
    for i in range(13):
        out += packer.add(i, bytes(4 * 20))  # class 3
    assert [r[3] for r in out] == sorted([10, 11, 12, 13] * 3)
    rest = packer.finish()
    assert [(len(r[2]) // 4, r[3]) for r in rest] == [(16, 14), (4, 15)]


def test_harmonic_sequences(spark):
    pieces = harmonic.pack_tokens(spark.read.parquet(f"{SF}/documents.parquet"), VOCABULARY)
    held = harmonic.sequences(pieces).collect()
    by = {}
    for p in pieces.collect():
        by.setdefault(p.sequence_id, []).append((p.offset, p.ids))
    assert {r.sequence_id: bytes(r.ids) for r in held} == {k: b"".join(i for _, i in sorted(v)) for k, v in by.items()}


def test_harmonic_refuses_other_capacities(spark):
    with pytest.raises(ValueError):
        harmonic.pack_tokens(spark.read.parquet(f"{SF}/documents.parquet"), VOCABULARY, capacity=1000)


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["random", "equal", "two", "graded", "zero", "ones"])
def test_spectrum(n, kind):
    rng = np.random.default_rng(n)
    q = np.linalg.qr(rng.standard_normal((n, n)))[0]
    values = {"random": rng.random(n), "equal": np.full(n, 3.0), "two": np.repeat([5.0, 1.0], [n // 2, n - n // 2]),
              "graded": 10.0 ** -np.linspace(0, 14, n), "zero": np.zeros(n), "ones": None}[kind]
    a = np.ones((n, n)) if values is None else (q * values) @ q.T
    a = (a + a.T) / 2
    w, v = whitening.spectrum(a)
    scale = max(np.abs(a).max(), 1e-300)
    assert np.abs(w - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-13 * n * scale
    assert np.abs(a @ v - v * w).max() <= 1e-13 * n * scale and np.abs(v.T @ v - np.eye(n)).max() < 1e-13


def test_polar_is_the_sign():
    a = np.diag([3.0, 1e-9, -2.0, -1e-12])
    assert np.allclose(whitening.polar(a), np.diag([1, 1, -1, -1]), atol=1e-12)


def test_whitening(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    raw = {r.vec_id: r.embedding for r in table.collect()}
    x = np.array([[math.floor(1024 * c) + 100_000 for c in raw[i]] for i in sorted(raw)])
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    got = queries.op12_whitening(spark, SF).collect()
    assert len(got) == 8 * n and len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9
    at = {i: k for k, i in enumerate(sorted(raw))}
    want = y @ u[:, :8] / np.sqrt(e[:8])
    found = np.zeros_like(want)
    for r in got:
        found[at[r.vec_id], r.component - 1] = r.whitened
        assert r.n == n and r.deviation == int(((n * x[at[r.vec_id]].astype(object) - s) ** 2).sum())
        assert abs(r.explained / (e[r.component - 1] / e.sum()) - 1) < 1e-9
    signs = np.sign((want * found).sum(0))
    assert np.abs(found * signs - want).max() < 1e-8


def test_whitening_odd(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, None, 2.0], 1), (4, [NAN, 0.0, 1.0], 2), (5, [INF, 0.0, 1.0], 2), (6, [1.0, 2.0], 3),
            (7, [1.0, 0.5, 2.0], 1), (7, [1.0, 0.5, 2.0], 1), (None, [-1.0, 0.5, 3.0], None), (9, [0.25, 0.5, -4.0], 2), (10, [1e300, 0.0, 0.0], 1)]
    got = whitening.whiten(vectors(spark, rows)).collect()
    assert sorted((r.vec_id or 0, r.component) for r in got) == sorted((i, c) for i in (0, 7, 7, 9) for c in (1, 2, 3))
    assert all(r.n == 4 and math.isfinite(r.whitened) for r in got) and got[0].identity_error < 1e-9
    assert {r.whitened for r in got if r.component == 3} == {0.0}  # the second entry never varies
    one = whitening.whiten(vectors(spark, rows[6:7])).collect()
    assert [(r.component, r.deviation, r.whitened, r.explained, r.identity_error) for r in one] == [(c, 0, 0, 0, 0) for c in (1, 2, 3)]
    assert whitening.whiten(vectors(spark, [])).count() == 0


def test_whitening_of_far_vectors_is_exact(spark):
    """Deviations beyond 64 bits, and a mean far from the spread."""
    rng = np.random.default_rng(3)
    raw = [[float(c) for c in 1e9 + rng.integers(0, 10**6, 4)] for _ in range(50)] + [[0.0] * 4]
    got = whitening.whiten(vectors(spark, [(i, v, 0) for i, v in enumerate(raw)]), components=2, scale=1024).collect()
    x = np.array([[int(c * 1024) + 100_000 for c in v] for v in raw], object)
    want = ((len(x) * x - x.sum(0)) ** 2).sum(1)
    assert {(r.vec_id, int(r.deviation)) for r in got} == set(enumerate(want.tolist()))


def brute_codes(rows, parts, entries, rounds, scale=256):
    """Plain rounds over ``(vec_id, embedding)``, in rising ids."""
    x = np.array([[math.floor(scale * c) for c in v] for _, v in rows])
    x = x.reshape(len(x), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()
    for i in range(rounds + 1):
        far = ((x[:, :, None] - books[None]) ** 2).sum(3)
        best = far.argmin(2)
        if i < rounds:
            for p in range(parts):
                for e in range(books.shape[1]):
                    mine = x[best[:, p] == e, p]
                    if len(mine):
                        books[p, e] = mine.sum(0) // len(mine)
    return ["".join(f"{c:02x}" for c in row) for row in best], far.min(2).sum(1).tolist(), books


def test_codes(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").orderBy("vec_id").collect()
    codes, errors, books = brute_codes([(r.vec_id, r.embedding) for r in table], 16, 64, 2)
    labels = {}
    for r, e in zip(table, errors):
        labels[r.label] = labels.get(r.label, 0) + e
    sha = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    got = queries.op13_codes(spark, SF).collect()
    assert {tuple(r) for r in got} == {(r.vec_id, c, e, labels[r.label], sha) for r, c, e in zip(table, codes, errors)}


@pytest.mark.parametrize("leaf, block", [(4, 64), (2, 1000)])
def test_codes_with_ties_and_copies(spark, monkeypatch, leaf, block):
    monkeypatch.setattr(anchors, "LEAF_POINTS", leaf)
    monkeypatch.setattr(anchors, "BLOCK_ROWS", block)
    rng = np.random.default_rng(4)
    rows = [(i, [float(c) for c in rng.integers(-3, 4, 4) / 256], i % 3 or None) for i in range(300)]
    rows += [(1000 + i, rows[0][1], None) for i in range(200)]
    codes, errors, books = brute_codes([r[:2] for r in rows], 2, 40, 3)
    got, found = anchors.encode(vectors(spark, rows), parts=2, entries=40, rounds=3)
    assert {(r.vec_id, r.code, r.error) for r in got.collect()} == {(r[0], c, e) for r, c, e in zip(rows, codes, errors)}
    assert (found == books).all()
    total = sum(e for r, e in zip(rows, errors) if r[2] is None)
    described = anchors.describe_codes(vectors(spark, rows), parts=2, entries=40, rounds=3).collect()
    assert {r.label_error for r in described if r.vec_id >= 1000} == {total}


def test_codes_odd(spark):
    rows = [(1, None, 1), (2, [], 1), (3, [1.0, None], 1), (4, [NAN, 0.0], 2), (5, [INF, 0.0], 2), (6, [1.0], 3),
            (7, [1.0, 0.5], 1), (7, [1.0, 0.5], 1), (None, [-1.0, 0.5], None), (9, [0.25, -0.5], 2), (10, [1e300, 0.0], 1)]
    got, books = anchors.encode(vectors(spark, rows), parts=2, entries=2, rounds=0)
    assert books.tolist() == [[[256], [256]], [[128], [128]]]
    assert sorted((r.vec_id or 0, r.code, r.error) for r in got.collect()) == [
        (0, "0000", 512 ** 2), (7, "0000", 0), (7, "0000", 0), (9, "0000", 192 ** 2 + 256 ** 2)]
    assert anchors.describe_codes(vectors(spark, [])).count() == 0
    with pytest.raises(ValueError):
        anchors.encode(vectors(spark, rows), parts=3)


@pytest.mark.parametrize("n, spread", [(1, 5), (7, 2), (500, 1), (900, 40), (300, 10**6)])
def test_trees_agree_with_plain_distances(monkeypatch, n, spread):
    monkeypatch.setattr(anchors, "LEAF_POINTS", 8)
    rng = np.random.default_rng(n)
    p = rng.integers(-spread, spread + 1, (n, 4))
    e = p[rng.integers(0, n, min(64, n))]
    count, sums, entry, far = anchors.Tree(p).assign(e)
    where = anchors.Tree(p).where
    d = ((p[:, None] - e[None]) ** 2).sum(2)
    assert (entry[where] == d.argmin(1)).all() and (far[where] == d.min(1)).all()
    assert (count == np.bincount(d.argmin(1), minlength=len(e))).all()
    assert (sums == [p[d.argmin(1) == i].sum(0) for i in range(len(e))]).all()
