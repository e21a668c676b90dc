"""Chunked computations give the same for any chunk width."""

from __future__ import annotations

import random

import pytest

from seqlake.operators import chunks, tables as T, variants as V


@pytest.mark.parametrize("width", [1, 7, 50, 1 << 20])
def test_along_a_sequence(spark, width):
    rng = random.Random(6)
    loci = [(c, p, rng.choice("AAC")) for c in ("x", "y") for p in sorted(rng.sample(range(200), 120))]
    d = spark.createDataFrame(loci, "chr string, pos long, ref string")
    base = {(c, p): r for c, p, r in loci}

    def run(c, p):
        lo = hi = p
        while base.get((c, lo - 1)) == base[c, p]:
            lo -= 1
        while base.get((c, hi + 1)) == base[c, p]:
            hi += 1
        return hi - lo + 1

    assert {(r["chr"], r["pos"]): r["run"] for r in V.homopolymer_runs(d, width).collect()} == {k: run(*k) for k in base}
    want = {(c, p): "".join(base.get((c, p + i), "-") for i in range(-3, 4)) for c, p in base}
    assert {(r["chr"], r["pos"]): r["context"] for r in V.context(d, 3, width).collect()} == want

    spans = [(c, b, b + rng.randrange(30)) for c in ("x", "y") for b in rng.sample(range(300), 25)]
    out = T.fragments(spark.createDataFrame(spans, "chr string, beg long, en long"), width).collect()
    covered = {(r["chr"], p): r["n"] for r in out for p in range(r["beg"], r["en"] + 1)}
    want = {(c, p): n for c in ("x", "y") for p in range(340) if (n := sum(k == c and b <= p <= e for k, b, e in spans))}
    assert covered == want and sum(r["en"] - r["beg"] + 1 for r in out) == len(want)


def test_halo(spark):
    d = chunks.haloed(spark.createDataFrame([(9,), (10,), (15,)], "pos long"), "pos", 2, 10)
    assert sorted((r["pos"], r["_chunk"], r["_own"]) for r in d.collect()) == [(9, 0, True), (9, 1, False), (10, 0, False), (10, 1, True), (15, 1, True)]
