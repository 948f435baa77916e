"""Each operator against a brute-force version, and on the odd cases its docstring names."""

import hashlib
import math
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import (
    chunks, collisions, language, licenses, metric_tree, mixing, near_dup, packing, quality, queries, repeats)
from tidemark.llm import text as T

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, key long, row string, `id` long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


def rows(spark, texts):
    """Documents from (id, text, lang, source); further columns have names that operators use themselves."""
    return spark.createDataFrame([(i, t, la, s, 7, 1, "x", 2) for i, t, la, s in texts], DOCS)


ODD = [(1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", "en", None), (4, "one", "de", "a"), (4, "one", "de", "a"),
       (None, "one two three four five six", "en", "a"), (None, None, None, "b"), (5, "%% 12", "en", "b"),
       (6, "long word " * 30_000, "en", "a"), (7, "é ü ñ " * 200, "fr", "c"), (8, "é ü ñ " * 200, "fr", "c")]


@pytest.fixture(scope="module")
def odd(spark):
    return rows(spark, ODD)


@pytest.fixture(scope="module")
def none(spark):
    return rows(spark, [])


def words(text):
    return WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))


def shingles(text, k):
    w = words(text)
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set()


def components(texts, k, percent):
    sets = {i: shingles(t, k) for i, t in texts}
    ids, least = sorted(sets), {i: i for i in sets}
    for x in range(len(ids)):
        for y in range(x):
            a, b = sets[ids[x]], sets[ids[y]]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                p, q = least[ids[x]], least[ids[y]]
                least = {i: min(p, q) if c in (p, q) else c for i, c in least.items()}
    return {i: (len(sets[i]), least[i]) for i in ids}


def test_words_are_those_of_the_pattern():
    texts = ["a bc\x0bd  e", "", "é\x85ü x", " lead", "trail ", "\x1c\x1f one"]
    data, offsets = T.bytes_of(__import__("pyarrow").array(texts))
    starts, ends, first = T.words(data, offsets)
    found = [data[a:b].tobytes().decode() for a, b in zip(starts, ends)]
    assert [found[a:b] for a, b in zip(first, first[1:])] == [WORD.findall(t) for t in texts]


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(documents, k, percent):
    want = components([(r.doc_id, r.text) for r in documents.collect()], k, percent)
    got = near_dup.near_duplicates(documents, k, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)


def test_near_duplicates_of_a_chain(spark):
    """Links that no bucket's least id takes part in are found, and chains are one component."""
    base = [f"w{i}" for i in range(60)]
    texts = [(i, " ".join(base[:40 + 0] [i:] + base[40:40 + i]), "en", "a") for i in range(12)]
    want = components([(i, t) for i, t, _, _ in texts], 3, 85)
    got = near_dup.near_duplicates(rows(spark, texts), 3, 85).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want


def test_near_duplicates_odd(odd, none):
    got = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in near_dup.near_duplicates(odd, 3, 85).collect()}
    assert {(1, 0, 1, True), (2, 0, 2, True), (4, 1, 4, True), (7, 3, 7, True), (8, 3, 7, False), (None, 4, None, True)} <= got
    assert near_dup.near_duplicates(none).count() == 0
    kept = near_dup.drop_near_duplicates(odd, 3, 85)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 0, 1, 2, 3, 4, 5, 6, 7]


def test_rows_of_one_id_and_other_texts_stay(spark):
    """Id 1 holds two unrelated texts, one of them near 5; id 5 a further one; equal rows come twice."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    data = [(1, a, "en", "s"), (1, b, "en", "s"), (1, b, "en", "s"), (5, a + " end", "en", "s"), (5, c, "en", "s"), (7, c, "en", "s"), (8, None, "en", "s"),
            (8, "", "en", "s"), (None, a, "en", "s"), (None, a, "en", "s")]
    left = near_dup.drop_near_duplicates(rows(spark, data), 5, 80)
    got = sorted(((r.doc_id or 0), r.text or "") for r in left.collect())
    texts = [t for _, t in got]
    assert [texts.count(t) for t in (a, b, c)] == [3, 1, 1] or [texts.count(t) for t in (a, a + " end", b, c)] == [2, 1, 1, 1]
    assert [i for i, _ in got if i in (0, 8)] == [0, 0, 8, 8]


def test_joint_estimate():
    rng = np.random.default_rng(1)
    common, a, b = (rng.integers(1, 2**63, n).astype(np.uint64) for n in (800, 100, 100))
    x, y = np.concatenate([common, a]), np.concatenate([common, b])
    r, s = near_dup.registers(x), near_dup.registers(y)
    assert abs(near_dup.joint_estimate(r[None], s[None], np.array([900.0]), np.array([900.0]))[0] - 0.8) < 0.15
    assert (near_dup.merge(r, s) == near_dup.registers(np.union1d(x, y))).all()


def brute_repeats(texts, length):
    raws = [(t or "").encode() for t in texts]
    seen = {}
    for raw in raws:
        for i in range(len(raw) - length + 1):
            seen[raw[i:i + length]] = seen.get(raw[i:i + length], 0) + 1
    out = []
    for raw in raws:
        gone = bytearray(len(raw))
        for i in range(len(raw) - length + 1):
            if seen[raw[i:i + length]] > 1:
                gone[i:i + length] = b"\1" * length
        kept = bytes(c for c, g in zip(raw, gone) if not g)
        out.append((len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("group", [16_384, 2])
def test_repeats(documents, monkeypatch, group):
    """Also where every gram has too many contexts for one task."""
    monkeypatch.setattr(repeats, "GROUP", group)
    docs = documents.orderBy("doc_id").limit(120)
    data = docs.collect()
    got = {r.doc_id: tuple(r)[1:5] for r in repeats.describe_repeats(docs, 400).collect()}
    assert [got[r.doc_id] for r in data] == brute_repeats([r.text for r in data], 400)


def test_repeats_odd(spark, none):
    texts = [None, "", "ab" * 40, "ab" * 40, "x" * 25, "q" + "é" * 30, "é" * 30, "0123456789abcdefghij", "z0123456789abcdefghijy"]
    docs = rows(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    found = repeats.describe_repeats(docs, 20).collect()
    got = {r.doc_id: tuple(r)[1:5] for r in found}
    assert [got[i] for i in range(len(texts))] == brute_repeats(texts, 20)
    left = repeats.remove_repeats(docs, 20)
    assert {r.doc_id: r.text for r in left.collect()} == {r.doc_id: r.text for r in found}
    assert left.columns == docs.columns
    assert {r.doc_id: r.text for r in left.collect()} == {0: None, 1: "", 2: "", 3: "", 4: "", 5: "q", 6: "", 7: "", 8: "zy"}
    assert repeats.describe_repeats(none).count() == 0


def test_repeats_of_null_ids_copies_and_long_texts(odd):
    """The two long texts of one letter pattern go whole, as do the equal ones; null ids count as others do."""
    got = sorted((r.doc_id or 0, r.n_bytes, r.n_removed, r.n_spans, r.text) for r in repeats.describe_repeats(odd, 30).collect())
    assert [(i, n, gone) for i, n, gone, _, _ in got] == sorted(
        (i or 0, len((t or "").encode()), len(t.encode()) if t and len(t) > 100 else 0) for i, t, _, _ in ODD)
    assert [g[4] for g in got if g[0] == 6] == [""]


def test_suffix_sort():
    parts = [b"banana", b"ban", b"", b"band", b"apple", b"banana"]
    s, group = repeats.Strings(parts), np.zeros(6, int)
    order = s.sort(group)
    assert [parts[i] for i in order] == sorted(parts)
    assert s.neighbours(order, group).tolist() == [-1, 0, 0, 3, 6, 3]


def test_chunks(spark, none):
    rng = np.random.default_rng(3)
    word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), 6)) for _ in range(n))
    passage = word(80)
    texts = [word(60) + " " + passage + " " + word(60), word(33) + " " + passage + " " + word(9), word(100), None, "", "short", "short"]
    docs = rows(spark, [(i, t, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in chunks.describe_chunks(docs).collect()}
    assert got[0].n_removed == got[2].n_removed == got[3].n_bytes == got[5].n_removed == 0
    assert got[1].n_spans == 1 and 300 < got[1].n_removed <= len(passage) + 2
    left = chunks.remove_chunks(docs)
    assert left.columns == docs.columns
    for r in left.collect():
        raw = texts[r.doc_id]
        assert len((r.text or "").encode()) == got[r.doc_id].n_bytes - got[r.doc_id].n_removed and (raw is None) == (r.text is None)
        if raw and r.doc_id == 1:
            assert hashlib.sha256(r.text.encode()).hexdigest() == got[1].kept_sha256 and raw.startswith(r.text[:150])
    assert chunks.describe_chunks(none).count() == 0


def test_chunks_find_short_passages_and_short_copies(spark):
    """Passages of 51 words in other surroundings, and whole copies of texts under a run."""
    found = 0
    for seed in range(4):
        rng = np.random.default_rng(seed)
        word = lambda n: " ".join("".join(rng.choice(list("abcdefghij"), rng.integers(2, 10))) for _ in range(n))
        passages = [word(51) for _ in range(25)]
        texts = [t for p in passages for t in (f"{word(40)} {p} {word(40)}", f"{word(40)} {p} {word(40)}")]
        texts += ["A copy of 30 bytes, or so few.", "A copy of 30 bytes, or so few.", "One of 30 bytes, or so few."]
        docs = rows(spark, [(i, t, None, None) for i, t in enumerate(texts)])
        got = {r.doc_id: r for r in chunks.describe_chunks(docs).collect()}
        gone = [got[2 * i + 1].n_removed / len(p) for i, p in enumerate(passages)]
        assert all(got[2 * i].n_removed == 0 for i in range(25)) and max(gone) < 1.02
        assert [got[i].n_removed for i in (50, 51, 52)] == [0, 30, 0]
        assert sum(g == 0 for g in gone) <= 1
        found += sum(gone) / 100
    assert found > 0.75


def test_chunk_ends_cover_the_text():
    data = np.random.default_rng(5).integers(0, 256, 5000).astype(np.uint8)
    ends = chunks.chunk_ends(data, np.array([0, 5000]))[0]
    sizes = np.diff([0, *ends])
    assert ends[-1] == 5000 and sizes.max() <= chunks.MOST and sizes[:-1].min() >= chunks.LEAST
    moved = chunks.chunk_ends(np.concatenate([data[:7], data]), np.array([0, 5007]))[0]
    assert len(set(ends) & {e - 7 for e in moved}) > len(ends) / 2


def check_mix(data, got):
    sizes = [(r.doc_id, r.source, len(WORD.findall(r.text or ""))) for r in data]
    sources = sorted({s for _, s, _ in sizes}, key=lambda s: (s is None, s or ""))
    total = {s: sum(n for _, x, n in sizes if x == s) for s in sources}
    weight, goal, rest, open_ = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}, {}, sum(total.values()), set(sources)
    while True:
        level = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if level[s] >= 3 * total[s]}
        if not over:
            break
        goal.update({s: 3.0 * total[s] for s in over})
        rest, open_ = rest - sum(3 * total[s] for s in over), open_ - over
        if not open_:
            break
    goal.update({s: level[s] for s in open_})
    key = lambda r: tuple((x is None, x or 0) for x in r)
    assert sorted([(r.doc_id, r.size) for r in got], key=key) == sorted([(i, n) for i, _, n in sizes], key=key)
    for s in sources:
        own = [r for r in got if r.source == s]
        assert all(abs(r.target - goal[s]) < 1e-6 and r.source_size == total[s] and 0 <= r.taken <= 3 * r.size for r in own)
        assert sum(r.taken for r in own) == math.floor(goal[s] + 1e-9)


def test_mixing(documents, odd, none, monkeypatch):
    monkeypatch.setattr(mixing, "CHUNK_ROWS", 16)
    for docs in (documents, odd):
        found, pieces = mixing.mix(docs, block_words=16)
        got = found.collect()
        check_mix(docs.collect(), got)
        assert sorted(map(str, found.collect())) == sorted(map(str, mixing.mix(docs, block_words=16)[0].collect()))
        assert pieces.agg(F.sum("words")).first()[0] == sum(r.taken for r in got)
    assert mixing.mix(none)[0].count() == 0 and mixing.mix_rows(none).columns == none.columns


def test_schedule_is_even(documents):
    """After any number of slots each source has had its share, but for a few."""
    _, pieces = mixing.mix(documents, block_words=16)
    first = pieces.join(documents.select("doc_id", "source"), "doc_id").select("slot", "source").distinct().toPandas()
    half = first[first.slot < len(first) / 2].source.value_counts()  # what the points left short comes at the end
    assert ((first.source.value_counts() / 2 - half).abs() < 12).all()


def check_packing(docs, got, capacity):
    bins = {}
    for r in got:
        if r.bin is not None:
            bins.setdefault(r.bin, []).append(r)
    for held in bins.values():
        assert sum(r.words for r in held) <= capacity
        assert sorted(r.place for r in held) == [sum(x.words for x in sorted(held, key=lambda x: x.place)[:i]) for i in range(len(held))]
        named = [r.source for r in held if r.source is not None]
        assert len(named) == len(set(named))
    assert sum(r.words for r in got) == sum(len(WORD.findall(r.text or "")) for r in docs)
    return bins


def test_packing(documents, odd, none):
    docs = documents.collect()
    bins = check_packing(docs, packing.pack(documents, capacity=2048).collect(), 2048)
    text = {r.doc_id: " ".join((r.text or "").lower().split()) for r in docs}
    assert all(len({text[r.doc_id] for r in held}) == len(held) for held in bins.values() if len({r.doc_id for r in held}) > 1)
    got = packing.pack(odd, capacity=100).collect()
    check_packing(odd.collect(), got, 100)
    assert {(r.doc_id, r.words, r.bin) for r in got if r.size == 0} == {(1, 0, None), (2, 0, None), (3, 0, None), (None, 0, None)}
    assert packing.pack(none).count() == 0


def test_best_fit_goes_on_to_a_compatible_bin():
    bins = packing.Bins(10)
    assert [bins.place(7, 1, 0), bins.place(6, 2, 0)] == [(0, 0), (1, 0)]
    assert bins.place(3, 1, 0) == (1, 6)  # the tighter bin has the source
    assert bins.place(3, 4, 8) == (0, 7)
    assert bins.place(1, 2, 0) == (2, 0)


def vectors(spark, more=()):
    data = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    data += [(100_000, data[0][1]), (100_050, data[0][1]), (100_100, None), (100_150, [1.0, None]), (100_200, [float("nan")] * 64),
             (None, data[1][1]), (100_250, [1.0, 2.0]), (100_300, [1.0, 2.0]), (100_350, [])] + list(more)
    return data, spark.createDataFrame([(i, v, 0, 1) for i, v in data], "vec_id long, embedding array<float>, label int, tree long")


def brute(data, every, k, score, zero):
    ok = [(i, np.array(v, np.float64)) for i, v in data if i is not None and v is not None and all(
        x is not None and math.isfinite(x) for x in v) and (zero or any(v))]
    out = {}
    for q, x in ok:
        if q % every == 0:
            found = sorted((score(x, y), i) for i, y in ok if i != q and len(x) == len(y))[:k]
            if found:
                out[q] = found
    return out


def test_top_products(spark, monkeypatch):
    monkeypatch.setattr(metric_tree, "TREE_ROWS", 100)
    monkeypatch.setattr(metric_tree, "PAGE", 8)
    data, frame = vectors(spark, [(200_000 + i, [0.5] * 64) for i in range(30)])
    cut = lambda x: np.floor(np.float64(x) * 256).astype(np.int64)
    want = brute(data, 50, 5, lambda x, y: -int(cut(x) @ cut(y)), True)
    got = metric_tree.top_products(frame, F.col("vec_id") % 50 == 0).collect()
    assert {q: [(-r.score, r.vec_id) for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}} == want
    assert metric_tree.top_products(frame.filter("false"), F.lit(True)).count() == 0


@pytest.mark.parametrize("spread, size", [(1, 64), (1, 2 ** 28), (0.01, 64), (0, 3)])
def test_tree_takes_many_queries_at_once(spread, size):
    """Own ids, ties and equal rows; products beyond 2**53; clusters, of which most leaves are left out."""
    random = np.random.default_rng(1)
    middles = random.integers(-size, size, (12, 8))
    rows = middles[random.integers(0, 12, 1500)] + (random.integers(-size, size, (1500, 8)) * spread).astype(np.int64)
    ids = np.arange(1500) // 2 * 2 + 10  # each id twice
    tree = metric_tree.Tree(ids, rows)
    own = ids[::30]
    query, score, id_ = tree.search(rows[::30], own, 5)
    for at, (v, o) in enumerate(zip(rows[::30], own)):
        want = sorted((-int(s), int(i)) for s, i in zip(rows @ v, ids) if i != o)[:5]
        assert sorted((-s, i) for s, i in zip(score[query == at].tolist(), id_[query == at].tolist())) == want


def test_nearest_recall(spark, monkeypatch):
    monkeypatch.setattr(collisions, "BLOCK_ROWS", 200)
    data, frame = vectors(spark, [(300_000, [0.0] * 64)])
    want = brute(data, 100, 10, lambda x, y: float(np.sqrt(((x - y) ** 2).sum())), False)
    got = collisions.nearest(frame, F.col("vec_id") % 100 == 0).collect()
    by = {q: [r for r in sorted(got, key=lambda r: r.rank) if r.query_id == q] for q in {r.query_id for r in got}}
    assert set(by) == set(want) and all(len(by[q]) == len(want[q]) for q in want)
    assert sum(len({r.vec_id for r in by[q]} & {i for _, i in want[q]}) for q in want) >= 0.9 * sum(map(len, want.values()))
    place = dict(data)
    assert all(abs(r.score - np.linalg.norm(np.float64(place[r.query_id]) - np.float64(place[r.vec_id]))) < 1e-9 for r in got)
    assert collisions.nearest(frame.filter("false"), F.lit(True)).count() == 0


def test_nearest_of_2000(spark):
    """Recall on the middle table, and how many rows are verified for it."""
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = sorted((r.vec_id, np.array(r.embedding, float)) for r in table.collect())
    ids, x = np.array([i for i, _ in data]), np.array([v for _, v in data])
    block, found, total = collisions.Block(ids, x), 0, 0
    got = {}
    for r in collisions.nearest(table, F.col("vec_id") % 100 == 0).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    for i in np.flatnonzero(ids % 100 == 0):
        far = np.sqrt(((x - x[i]) ** 2).sum(1))
        far[i] = np.inf
        want = set(ids[np.argsort(far, kind="stable")[:10]].tolist())
        found, total = found + len(want & got[ids[i]]), total + 10
        block.widen(x[i], ids[i], 10)
    assert set(got) == set(ids[ids % 100 == 0].tolist())
    assert found >= 0.9 * total
    assert block.verified < 0.1 * len(ids) * len(got)


@pytest.mark.parametrize("rows", [5, 1000])
def test_nearest_ties_and_copies(spark, monkeypatch, rows):
    """Copies in all blocks: the least ids, in order, however the rows are dealt."""
    monkeypatch.setattr(collisions, "BLOCK_ROWS", rows)
    monkeypatch.setattr(collisions, "QUERY_ROWS", 2)
    near, far = [1.0, 0.0, 0.0], [-5.0, 1.0, 2.0]
    data = [(i, near) for i in range(100, 160)] + [(7, far), (7, far), (8, [1.0, 2.0]), (9, None), (10, [0.0, 0.0, 0.0]), (None, near),
                                                  (11, [float("nan"), 1.0, 1.0]), (12, [1.0, None, 2.0]), (13, [])]
    frame = spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("number", F.lit("x"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in collisions.nearest(frame, F.col("vec_id").isin(7, 8, 120, 159), 3).collect())
    apart = float(np.sqrt(36 + 1 + 4))
    assert got == [(7, 1, 100, apart), (7, 2, 101, apart), (7, 3, 102, apart), (120, 1, 100, 0), (120, 2, 101, 0), (120, 3, 102, 0),
                   (159, 1, 100, 0), (159, 2, 101, 0), (159, 3, 102, 0)]


def test_quality(spark, odd, none):
    got = queries.op1_quality(spark, "/root/testdata/sf0.01").collect()
    label = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.5) for r in got)
    held = [r for r in got if r.held_out and r.doc_id in label]
    assert sum(r.predicted == label[r.doc_id] for r in held) > 0.94 * len(held)
    labels = spark.createDataFrame([(4, 1, 0), (4, 0, 0), (7, 0, 0), (None, 1, 0), (9, None, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.score_quality(odd, labels, F.lit(True)).collect()) == len(ODD)
    assert {r.score for r in quality.score_quality(odd, labels.filter("false"), F.lit(True)).collect()} == {0.5}
    assert quality.score_quality(none, labels, F.lit(True)).count() == 0


def test_language(spark, odd, none):
    got = queries.op6_language(spark, "/root/testdata/sf0.01").collect()
    lang = {r.doc_id: r.lang for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == lang[r.doc_id] for r in held) > 0.97 * len(held) and all(0 <= r.score <= 1 for r in got)
    found = language.identify(odd, language.train(odd)).collect()
    assert {(r.doc_id, r.lang_pred, r.score) for r in found if r.lang_pred == "und"} == {
        (1, "und", 0.0), (2, "und", 0.0), (3, "und", 0.0), (5, "und", 0.0), (None, "und", 0.0)}
    assert language.train(none)["langs"] == [] and language.identify(none, language.train(none)).count() == 0
    left = language.identify_rows(odd, language.train(odd))
    assert left.columns == odd.columns and {r.doc_id for r in left.collect()} <= {None, 4, 6, 7, 8}


@pytest.mark.parametrize("n", range(2, 40))
def test_codewords_are_apart(n):
    codes = language.codewords(n)
    apart = (codes[:, None] != codes[None]).sum(2)[~np.eye(n, dtype=bool)].min()
    assert len(codes) == n and apart >= codes.shape[1] / 2


def test_licences(spark, none):
    texts = [(1, "Some prose.\nLicensed under the Apache License, Version 2.0.\nmore", None, None), (2, "Released under the MIT License.", None, None),
             (3, "the house is under the tree, version 3", None, None), (4, None, None, None), (5, "", None, None),
             (6, "This work is licensed under the GNU General Public License, version 3.\nAll rights reserved.", None, None)]
    docs = rows(spark, texts * 2)
    got = {(r.doc_id, r.n_paragraphs, tuple((x.paragraph, x.family) for x in r.licences)) for r in licenses.scan(docs).collect()}
    assert got == {(1, 3, ((1, "apache-2.0"),)), (2, 1, ((0, "mit"),)), (3, 1, ()), (4, 0, ()), (5, 1, ()),
                   (6, 2, ((0, "gpl-3.0"), (1, "proprietary")))}
    assert licenses.scan(none).count() == 0


def test_licences_over_lines_and_side_by_side(spark):
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following "
           "conditions\nare met:")
    gpl = ("# This program is free software; you can redistribute it and/or modify\n# it under the terms of the GNU General Public License as "
           "published by\n# the Free Software Foundation; either version 2 of the License, or\n# (at your option) any later version.")
    apache = (' * you may not use this file except in compliance\n * with the License. You may obtain a copy of the License\n * at\n'
              ' * http://www.apache.org/licenses/LICENSE-2.0')
    by_sa = "This work is licensed under a Creative Commons\r\nAttribution-ShareAlike 4.0\r\nInternational License."
    texts = [(bsd, {"bsd"}), (gpl, {"gpl-2.0"}), (apache, {"apache-2.0"}), (by_sa, {"cc-by-sa"}),
             (gpl.replace("; either version 2", ", either version 3"), {"gpl-3.0"}),
             ("Licensed under the Apache License, Version 2.0. Released under the MIT License.", {"apache-2.0", "mit"}),
             (f"Some prose.\n\n{gpl}\n\n{bsd}\nReleased under the MIT License.", {"gpl-2.0", "bsd", "mit"}),
             ("Released under the MIT License, Licensed under CC BY-SA 4.0. All rights reserved.", {"mit", "cc-by-sa", "proprietary"}),
             ("The house is under the\ntree of the license,\nversion 3 of the day.", set()),
             ("This work is licensed under the GNU General Public License,\nversion 2.", {"gpl-2.0"}),
             ("The work. " + "x" * 168 + " work\nThis work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"}),
             ("The work\n" + "x " * 85 + "\nThis work is licensed under the GNU General Public License, version 3.", {"gpl-3.0"})]
    docs = rows(spark, [(i, t, None, None) for i, (t, _) in enumerate(texts)])
    got = {r.doc_id: [x.family for x in r.licences] for r in licenses.scan(docs).collect()}
    assert [(set(got[i]), len(got[i])) for i in range(len(texts))] == [(want, len(want)) for _, want in texts]


def test_licences_are_decided_by_the_classifier(spark):
    prose = "the river runs along the old road and the people of the town walk there in the evening " * 3
    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction")
    texts = [("This project uses the MIT license.", {"mit"}), ("Licensed under the terms of the Apache Licence 2.0.", {"apache-2.0"}),
             ("It is under the GNU Lesser General Public License.", {"lgpl"}), ("# SPDX-License-Identifier: MPL-2.0", {"mpl-2.0"}),
             ("SPDX-License-Identifier: GPL-2.0-only", {"gpl-2.0"}), ("Available under the ISC License", {"isc"}),
             ('THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\nIMPLIED, INCLUDING', {"mit"}),
             ("\n".join(f"# {w}" + " " * 100 for w in mit.split()), {"mit"}),  # a word a line, 3,000 characters
             (f"{prose}\n\n{mit}\n\n{prose}", {"mit"}), (f"{prose} Released under the MIT License. {prose}", {"mit"}),
             ("This code is not released under the MIT License.", set()), ("The MIT License does not apply here.", set()),
             ("This is not licensed under the GNU General Public License, version 3.", set()),
             ("She had a driving licence and permission to leave.", set()), ("Released under the MIT\n\nLicense", set()),
             (None, set()), ("", set()), ("word " * 50_000 + "Released under the MIT License.", {"mit"})]
    docs = rows(spark, [(None if i == 0 else i, t, None, None) for i, (t, _) in enumerate(texts)])
    got = {r.doc_id or 0: [(x.paragraph, x.family) for x in r.licences] for r in licenses.scan(docs).collect()}
    assert {i: {f for _, f in found} for i, found in got.items()} == {i: want for i, (_, want) in enumerate(texts)}
    assert all(len(found) == len({f for _, f in found}) for found in got.values())
    assert got[8][0][0] == 2 and got[17][0][0] == 0


def test_licences_unknown_class_is_calibrated(spark, documents):
    scanner = licenses.Scanner(documents)
    assert licenses.LEAST_PROBABILITY <= scanner.threshold < 1
    scanner.threshold = 0.0  # every family of every window is likely: only the templates decide
    one = spark.createDataFrame([("not released under the mit license",)], "text string")
    words = licenses._words(F.col("text"))
    found = one.select(F.transform(scanner.likely(words), lambda f: f["p"]).alias("p"), F.size(scanner._confirmed(scanner._known(words))).alias("n")).first()
    assert len(found.p) == len(scanner.families) and max(found.p) < licenses.LEAST_PROBABILITY and found.n > 0
