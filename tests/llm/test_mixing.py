"""Mixtures against their targets, and the splitting tree's exact quotas."""

from __future__ import annotations

import re

import numpy as np
from hypothesis import given, settings, strategies as st

from seqlake.llm import mixing
from seqlake.llm.queries import op9_mixing
from tests.conftest import MEDIUM
from tests.llm import brute

SCHEMA = "doc_id long, text string, source string, lang string, target int"


def words(t) -> int:
    return len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode()))


def check(docs, out, slack: float):
    by = {r["doc_id"]: r for r in out}
    assert len(by) == len(docs) == len(out)
    size: dict = {}
    for i, t, s in docs:
        size[s] = size.get(s, 0) + words(t)
    want = brute.targets(size)
    got = dict.fromkeys(size, 0)
    for i, t, s in docs:
        r = by[i]
        n = words(t)
        assert (r["size"], r["source_size"]) == (n, size[s]) and abs(r["target"] - want[s]) < 1e-5 * max(1, want[s])
        assert 0 <= r["taken"] <= 3 * n and (n == 0 or r["taken"] % n == 0)
        got[s] += r["taken"]
    for s in size:
        assert abs(got[s] - want[s]) <= slack * want[s], (s, got[s], want[s])


def test_query_meets_targets(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text", "source").collect()]
    out = op9_mixing(spark, MEDIUM).collect()
    check(docs, out, 0.02)
    again = op9_mixing(spark, MEDIUM).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, again))


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.one_of(st.none(), st.text(max_size=2)), st.integers(0, 10_000), max_size=8))
def test_targets(sizes):
    t = mixing.targets(sizes)
    assert t.keys() == sizes.keys() and all(0 <= v <= 3 * sizes[s] + 1e-6 for s, v in t.items())
    total = sum(sizes.values())
    assert abs(sum(t.values()) - total) < 1e-6 * max(1, total)
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    free = [(t[s] / (i % 3 + 1)) for i, s in enumerate(order) if t[s] < 3 * sizes[s] - 1e-6]
    assert not free or max(free) - min(free) < 1e-6 * max(1, max(free))


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 300), min_size=1, max_size=6), st.integers(1, 9), st.integers(0, 99))
def test_splitting_tree(blocks, shards, seed):
    q = mixing.split_quotas(np.array(blocks), shards, seed)
    assert q.sum(1).tolist() == blocks and (q >= 0).all()
    total = q.sum(0)
    assert total.max() - total.min() <= int(np.ceil(np.log2(shards))) + 1
    assert (q == mixing.split_quotas(np.array(blocks), shards, seed)).all()


def test_odd_rows(spark):
    docs = [(1, None, "a"), (2, "", "a"), (3, " \t", "b"), (4, "one two", None), (5, "x " * 5000, "Ü"), *[(10 + i, f"w{i} " * (i % 7), ("a", "b", None, "z'\"\\", "")[i % 5]) for i in range(200)]]
    df = spark.createDataFrame([(*d, "en", 7) for d in docs], SCHEMA)
    check(docs, mixing.taken(df).collect(), 0.35)
    rows = mixing.mix(df, shards=5, blocks=32).collect()
    count: dict = {}
    for r in rows:
        count[r["doc_id"]] = count.get(r["doc_id"], 0) + 1
    for r in mixing.taken(df).where("size > 0").collect():
        assert count.get(r["doc_id"], 0) * r["size"] == r["taken"]
    assert {r["_shard"] for r in rows} <= set(range(5)) and set(df.columns) <= set(rows[0].asDict())
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(df.repartition(3), shards=5, blocks=32).collect()))


def test_empty_and_wordless_tables(spark):
    assert mixing.taken(spark.createDataFrame([], SCHEMA)).count() == 0
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
    out = mixing.taken(spark.createDataFrame([(1, None, None, None, None), (2, "", "a", None, None)], SCHEMA)).collect()
    assert sorted((r["doc_id"], r["size"], r["source_size"], r["target"], r["taken"]) for r in out) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]


def test_a_long_document_at_the_cut_is_left_out(spark):
    """Sources of short documents and one that is longer than what the cut leaves, wherever it lies."""
    docs = [(1000 * k + i, "w " * (6000 if i == 0 else 20 + i % 7), f"s{k}") for k in range(9) for i in range(600)]
    df = spark.createDataFrame([(*d, "en", 7) for d in docs], SCHEMA)
    check(docs, mixing.taken(df).collect(), 0.005)


def test_splits_are_hypergeometric():
    """Over many seeds a shard's share of a source has the mean and the variance of drawing without replacement; rounded expectations, or draws with replacement, have not."""
    blocks, shards = np.array([60, 30, 10]), 4
    q = np.array([mixing.split_quotas(blocks, shards, seed) for seed in range(4000)])
    total, take = blocks.sum(), 25
    for i, n in enumerate(blocks):
        mean, var = take * n / total, take * n / total * (1 - n / total) * (total - take) / (total - 1)
        for k in range(shards):
            assert abs(q[:, i, k].mean() - mean) < 0.12 and abs(q[:, i, k].var() / var - 1) < 0.12
    pair = np.cov(q[:, 0, 0], q[:, 1, 0])[0, 1]
    assert abs(pair + take * 0.6 * 0.3 * (total - take) / (total - 1)) < 0.5


def test_the_result_comes_from_the_tree(spark, monkeypatch):
    """Every shard holds as many blocks of a source as the tree gave it, and blocks that it deals to no shard are not taken."""
    docs = [(i, "w " * (1 + i % 9), "ab"[i % 3 == 0]) for i in range(900)]
    df = spark.createDataFrame([(*d, "en", 7) for d in docs], SCHEMA)
    plan = mixing.Plan(df, shards=6, blocks=40)
    place = {r["doc_id"]: r["_place"] for r in mixing.sized(df, plan.seed).collect()}
    rows = mixing.mix(df, plan=plan).collect()
    held: dict = {}
    for r in rows:
        s, at = r["source"], place[r["doc_id"]] * 40 >> mixing.PLACE_BITS
        if r["_copy"] < plan.passes[s] or place[r["doc_id"]] < plan.cut[s]:
            assert held.setdefault((s, r["_copy"], at), r["_shard"]) == r["_shard"]  # a block is one shard's
    quota = mixing.split_quotas(np.array([plan.passes[s] * 40 + plan.partial[s] for s in "ab"]), 6, plan.seed)
    for i, s in enumerate("ab"):
        assert np.bincount(plan.shard[s], minlength=6).tolist() == quota[i].tolist()
        assert all(sum(k == (s, shard) for k in ((x[0], v) for x, v in held.items())) <= quota[i][shard] for shard in range(6))
    whole = sum(r["taken"] for r in mixing.taken(df, 6, 40).collect())
    real = mixing.split_quotas

    def less(blocks, shards, seed):
        q = real(blocks, shards, seed)
        q[:, 3] = 0
        return q

    monkeypatch.setattr(mixing, "split_quotas", less)
    assert 0.6 * whole < sum(r["taken"] for r in mixing.taken(df, 6, 40).collect()) < 0.95 * whole


def test_repeated_ids_and_clashing_columns(spark):
    rows = [(1, "a b c", "x", 5), (1, "a b c", "x", 6), (1, "a b c d", "x", 7), (1, "q", "y", 8), (None, "n n", "x", 9), (None, "n n", None, 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, _place int")
    out = mixing.taken(df).collect()
    assert sorted(r["size"] for r in out) == [1, 2, 2, 3, 3, 4]
    pair = [r["taken"] for r in out if (r["doc_id"], r["size"]) == (1, 3)]
    assert pair[0] == pair[1] and pair[0] % 3 == 0
    mixed = mixing.mix(df)
    assert set(df.columns) <= set(mixed.columns) and {r["_place"] for r in mixed.collect()} <= {5, 6, 7, 8, 9}


def test_written_shards_are_whole_and_shuffled(spark, tmp_path):
    df = spark.createDataFrame([(i, "w " * 5, f"s{i % 4}", "en", i) for i in range(2000)], SCHEMA)
    plan = mixing.Plan(df, shards=5)
    mixing.shuffled(mixing.mix(df, plan=plan), plan.shards).write.parquet(str(tmp_path / "mix"))
    from pyspark.sql import functions as F

    rows = spark.read.parquet(str(tmp_path / "mix")).select("_shard", "doc_id", F.input_file_name().alias("f")).collect()
    files: dict = {}
    for r in rows:
        files.setdefault(r["_shard"], set()).add(r["f"])
    assert sorted(files) == [0, 1, 2, 3, 4] and all(len(f) == 1 for f in files.values())
    first = [r["doc_id"] for r in rows if r["_shard"] == 0]
    assert abs(np.corrcoef(range(len(first)), first)[0, 1]) < 0.2 and len({i % 4 for i in first[:40]}) == 4
