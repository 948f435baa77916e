"""The stages on their own input, and odd rows through all of them."""

import corpus_pipeline as P
from test_operators import ODD, WORD, components, rows

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, before = docs.columns, docs
    for name, stage in P.STAGES[:-1]:
        after = stage(spark, before, SF).persist()
        assert after.columns == columns, name
        had, has = ([(r.doc_id, r.text) for r in x.collect()] for x in (before, after))
        if name == "language":
            assert {i for i, t in had if t and any(c.isalpha() for c in t)} >= {i for i, _ in has} and len(has) > 0.97 * len(had)
        if name == "near_duplicates":
            assert {i for i, _ in has} == {c for _, c in components(had, 5, 80).values()} and len(has) == len({i for i, _ in has})
        if name == "repeats":
            assert {i for i, _ in had} == {i for i, _ in has} and all(len(t) <= len(dict(had)[i]) for i, t in has)
        if name == "mixing":
            assert {i for i, _ in has} <= {i for i, _ in had} and all(dict(had)[i] == t for i, t in has)
        before = after
    packed = P.STAGES[-1][1](spark, before, SF).collect()
    assert sum(r.words for r in packed) == sum(len(WORD.findall(r.text or "")) for r in before.collect())


def test_odd_rows(spark):
    for data in (ODD, []):
        docs = rows(spark, data)
        for _, stage in P.STAGES:
            docs = stage(spark, docs, SF)
            docs.collect()


def test_mixing_stage_meets_targets(spark):
    """Sources of one long document, of mostly one, of many short ones, and of rows alike but for their text."""
    text = lambda n, w="w": " ".join(f"{w}{i}" for i in range(n))
    data = [(i, text(100, f"a{i}x"), "en", "a") for i in range(40)] + [(100 + i, text(100, f"b{i}x"), "en", "b") for i in range(40)]
    data += [(200, text(4000), "en", "c")]
    data += [(300, text(3600), "en", "f"), *((301 + i, text(40, f"f{i}x"), "en", "f") for i in range(10))]
    data += [(None, text(100, f"n{i}x"), "en", "i") for i in range(40)]
    docs = rows(spark, data).persist()
    mixed = P.mixing.mix(docs)[0].select("source", "target").distinct().collect()
    target = {r.source: r.target for r in mixed}
    got = P.mix_sources(spark, docs, SF).collect()
    own = {s: sum(len(WORD.findall(r.text)) for r in got if r.source == s) for s in target}
    assert all(abs(own[s] - t) <= 0.125 * t for s, t in target.items()), (own, target)
    assert own["c"] == int(target["c"]) and all(r.n_chars == len(r.text) for r in got)
    whole = {t for _, t, _, _ in data}
    assert all(any(w.startswith(r.text) for w in whole) for r in got)
    assert 0 < len({r.text for r in got if r.source == "i"}) < 40
