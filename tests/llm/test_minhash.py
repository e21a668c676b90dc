"""Near-duplicate groups against a comparison of all pairs."""

from __future__ import annotations

import random

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from seqlake.llm import graph, minhash, words
from seqlake.llm.queries import op8_minhash
from tests.conftest import MEDIUM
from tests.llm import brute

SCHEMA = "doc_id long, text string, component_id string, hash int"


def result(df) -> dict:
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect()}


def test_query_equals_all_pairs(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    out = op8_minhash(spark, MEDIUM).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out} == brute.near(rows)
    assert len(out) == len(rows) and all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out)


def edited(rng, base: list[str], n: int) -> str:
    w = base[:]
    for i in rng.sample(range(len(w)), n):
        w[i] = f"z{rng.randrange(10**6)}"
    return " ".join(w)


@pytest.mark.parametrize("bucket, meetings", [(4, 64), (1024, 0), (1024, 10**6)])
def test_large_groups_in_blocks(spark, monkeypatch, bucket, meetings):
    """Groups far larger than a block and a bucket, chains at the threshold, copies of all kinds, by rare shingles and in blocks."""
    monkeypatch.setattr(minhash, "BUCKET", bucket)
    monkeypatch.setattr(minhash, "MEETINGS", meetings)
    rng = random.Random(4)
    docs = []
    for g in range(3):
        base = [f"w{rng.randrange(500)}" for _ in range(120)]
        docs += [edited(rng, base, rng.choice([0, 1, 2, 3])) for _ in range(40)]
    chain = [f"c{i}" for i in range(400)]
    docs += [" ".join(chain[i * 8 : i * 8 + 100]) for i in range(30)]
    rng.shuffle(docs)
    rows = list(enumerate(docs, 5))
    out = minhash.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), block=7)
    assert result(out) == brute.near(rows)


def test_odd_rows(spark):
    long = " ".join(f"word{i % 900}x{i}" for i in range(30_000))
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one TWO"), (6, "one two three"), (7, "A b c d e"), (8, "a B c d e"), (-9, "É a b c d e f"), (10, "é a b c d e f"), (11, long), (12, long + " more"), (13, "a b c d e f")]
    out = minhash.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA))
    assert result(out) == brute.near(rows)
    twice = minhash.near_duplicates(spark.createDataFrame([(i, t, "x", 1) for i, t in (rows[3], rows[3], rows[4], (None, "one two"))], SCHEMA)).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0, r["kept"]) for r in twice) == [(0, 0, True), (4, 4, True), (4, 4, True), (5, 4, False)]
    both = minhash.near_duplicates(spark.createDataFrame([(7, "a b c", "x", 1), (7, "d e f", "x", 1), (3, "A b c", "x", 1), (9, "d e F", "x", 1)], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in both) == [(3, 3), (7, 3), (7, 7), (9, 7)]


def test_unique_rows(spark):
    """One row of each group; rows without an id stay, repeated rows stay once, whatever the other columns are called."""
    rows = [(4, "One two", "x", 1), (4, "One two", "x", 1), (5, "one TWO", "x", 1), (None, "one two", "x", 1), (None, "one two", "y", 2), (6, None, "x", 1), (6, None, "x", 1), (8, "other words", "x", 1)]
    d = spark.createDataFrame(rows, SCHEMA)
    out = minhash.unique(d)
    assert out.columns == d.columns
    assert sorted(map(str, map(tuple, out.collect()))) == sorted(map(str, [rows[0], rows[3], rows[4], rows[5], rows[7]]))
    assert minhash.unique(d.limit(0)).count() == 0


def signatures(spark, rng, n: int, same_bands: int, near: bool):
    """Representatives that share ``same_bands`` bands; with ``near`` most of their signature too."""
    base = rng.integers(0, 256, 144, dtype=np.uint8)
    rows = []
    for i in range(n):
        sketch = rng.integers(0, 256, 144, dtype=np.uint8)
        if near:
            sketch = np.where(rng.random(144) < 0.95, base, sketch)
        bands = [b if b < same_bands else int(rng.integers(1, 1 << 60)) for b in range(24)]
        rows.append((i, bands, bytearray(sketch.astype(np.uint8).tobytes())))
    return spark.createDataFrame(rows, "doc_id long, bands array<long>, sketch binary")


def test_a_band_that_unlike_texts_share(spark):
    """10,000 representatives in one bucket: unlike ones give no link, like ones a link each, and a pair among unlike ones is found."""
    rng = np.random.default_rng(3)
    unlike = signatures(spark, rng, 10_000, 1, False)
    assert minhash.candidates(unlike, 85).count() == 0
    like = signatures(spark, rng, 3000, 24, True)
    n = {tuple(sorted(r)) for r in minhash.candidates(like, 85).collect()}
    assert brute.components(n, range(3000)) == dict.fromkeys(range(3000), 0) and len(n) < 10_000
    pair = unlike.where("doc_id = 77").selectExpr("cast(20000 as long) as doc_id", "transform(bands, (b, i) -> if(i % 3 = 0, b, b + 1)) as bands", "sketch")
    assert [tuple(sorted(r)) for r in minhash.candidates(unlike.union(pair), 85).distinct().collect()] == [(77, 20000)]


def test_a_template_gives_few_meetings(spark):
    """A component of texts that share most of a template but no pair of which holds: as many meetings as there are members at most; those that hold are found."""
    rng = random.Random(5)
    frame = [f"t{i}" for i in range(80)]
    texts = [" ".join(frame[:40] + [f"x{i}y{j}" for j in range(12)] + frame[40:]) for i in range(400)]
    texts += [texts[0] + " more", texts[7].replace("t79", "end")]
    rows = list(enumerate(texts))
    d = spark.createDataFrame(rows, "doc_id long, text string")
    placed = spark.createDataFrame([(i, 0, i) for i, _ in rows], "id long, component long, class long")
    met = {tuple(r) for r in minhash.rare_meetings(minhash.rare_shingles(placed, d, 85), 85).collect()}
    assert {(0, 400), (7, 401)} <= met and len(met) < 410
    held = {tuple(r) for r in minhash.direct(spark.createDataFrame(sorted(met), "a long, b long"), d, 85).collect()}
    assert held == {(0, 400), (7, 401)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=12, unique=True), min_size=2, max_size=8), st.sampled_from([50, 85]))
def test_rarest_shingles_meet(sets, percent):
    """The rule of the prefix filter, for any order of the shingles."""
    count: dict = {}
    for s in sets:
        for x in s:
            count[x] = count.get(x, 0) + 1
    rare = [set(sorted(s, key=lambda x: (count[x], x))[: len(s) - -(-len(s) * percent // 100) + 1]) for s in sets]
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len({*a} & {*sets[j]}) >= percent * len({*a} | {*sets[j]}):
                assert rare[i] & rare[j]


def test_odd_ids(spark):
    assert minhash.near_duplicates(spark.createDataFrame([(None, "a b", "x", 1), (None, None, "x", 1)], SCHEMA)).where("kept and component_id is null").count() == 2


def test_empty_table(spark):
    assert minhash.near_duplicates(spark.createDataFrame([], SCHEMA)).count() == 0


def test_components(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, i) for i in range(2001, 2100)] + [(7, 7)]
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame([*edges, (None, 3), (3, None)], "a long, b long")).collect()}
    ids = {x for e in edges if e[0] != e[1] for x in e}
    assert got == brute.components([e for e in edges if e[0] != e[1]], ids)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet="abAB \t\né", max_size=40)), max_size=6))
def test_shingles(texts):
    raw = [None if t is None else t.encode() for t in texts]
    values, n, h, w = words.shingle_sets(raw)
    assert n.tolist() == [len(brute.shingles(t)) for t in texts]
    assert len(values) == n.sum() and len(h) == w.sum()
    parts = np.split(values, np.cumsum(n)[:-1]) if len(texts) else []
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert len({*parts[i].tolist()} & {*parts[j].tolist()}) == len(brute.shingles(a) & brute.shingles(b))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 12), min_size=1, max_size=12, unique=True), min_size=1, max_size=10), st.sampled_from([50, 80, 85]))
def test_confirm(sets, percent):
    arrays = [np.sort(np.array(s, np.uint64)) for s in sets]
    links = minhash.confirm(arrays, list(range(len(sets))), percent, minhash.Forest())
    want = [(i, j) for i in range(len(sets)) for j in range(i) if 100 * len({*sets[i]} & {*sets[j]}) >= percent * len({*sets[i]} | {*sets[j]})]
    assert brute.components(links, range(len(sets))) == brute.components(want, range(len(sets)))
    assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(x)) for x in want}
