"""Reads: trims and clips with known results, and kernels against plain loops."""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import functions as F

from seqlake.functions import cigar as C, qual as Q, seq as S, stats
from seqlake.operators import local, reads as R

READ = "rec_no long, id string, seq string, qual string"
#: Eight reads of thirty bases with an adapter at the end, whole, in part or inside; qualities of offset 64.
ADAPTER = "AGTCCCGTAC"
CLIPPED = [
    ("ATATGCTACGTTTGTGACCTAGTCCCGTAC", "hhhhh]]hhhhhhhhhhhhh]hhffgffaa", 20),
    ("ATGTTCGTATATGAGCAGTCCCGTACAAAA", "hhbhh^^hhhhhhhhhhhhh]hhfffffaa", 16),
    ("TATAGCCTCTAGCTTGACTCTAGCTAGTCC", "hhhh]]hhhhhhhhhhhhh]hhfffffaaa", 25),
    ("ATCTATCTTAGTCATCTTATCTACTATCAG", "hhhhhdchhhhhhhhhhh]hhfggfaabbA", 28),
    ("ATATACTTATCTACTTATCTATCTTAAAGT", "hhhhh]bhddhhhhhhhhhh]hhffffgaA", 27),
    ("AGTCCTTGGTCTTATCTACTTATCTATCTT", "hhhhh]bhddhhhhhhhhhh]hhffffgaA", 29),
    ("AGTCCATTACCTTATCTACTTATCTATCTT", "hhhhh]bhddhhhhhhhhhh]hhffffgaA", 29),
    ("AAAAAAAAAAAAAAAAAAAAAAAAAAAAAT", "hhhhh]bhddhhhhhhhhhh]hhffffgaA", 29),
]


def frame(spark, rows):
    return spark.createDataFrame([(i, f"@r{i}", s, q) for i, (s, q) in enumerate(rows)], READ)


def test_clip_and_trim_of_known_reads(spark):
    d = frame(spark, [r[:2] for r in CLIPPED])
    found = R.profile(d, spark.createDataFrame([("clip me", ADAPTER)], "id string, seq string"))
    assert (found.sampled, found.phred) == (8, 64)
    assert found.adapters == [R.Adapter("clip me", ADAPTER, "e", 1)]
    out = {r["rec_no"]: r for r in R.trim_reads(d, found.adapters, phred=64).collect()}
    assert {i: (r["seq"], r["qual"]) for i, r in out.items()} == {i: (s[:n], q[:n]) for i, (s, q, n) in enumerate(CLIPPED)}
    row = R.trim_summary(R.clip_adapters(d, found.adapters)).first()
    assert (row["clip_end_n"], row["clip_end_mean"], round(row["clip_end_sd"], 2)) == (5, 6.8, 5.07)


def test_adapter_at_the_start(spark):
    a = "CATGATTGATGGTGCCTACAG"
    d = frame(spark, [(a + "ACGT" * 10, "h" * 61)] * 4)
    found = R.profile(d, spark.createDataFrame([("three_3p_", a)], "id string, seq string"))
    assert found.adapters[0].end == "e"  # the name decides
    found = R.profile(d, spark.createDataFrame([("any", a)], "id string, seq string"))
    assert found.adapters[0].end == "b"
    assert {r["seq"] for r in R.clip_adapters(d, found.adapters).collect()} == {"ACGT" * 10}


def plain_clip(seq: str, adapters, percent: float) -> tuple[int, int]:
    best = {"b": (10**9, 0), "e": (10**9, 0)}
    for a in adapters:
        for off in range(max(1, a.least), len(seq) + 1):
            n = min(off, len(a.seq))
            x, y = (a.seq[:n], seq[len(seq) - off :][:n]) if a.end == "e" else (a.seq[len(a.seq) - n :], seq[off - n : off])
            d = sum(p != q for p, q in zip(x, y))
            if d <= percent * n // 100:
                score = 1000 * (d * d + 1) // n
                if score <= best[a.end][0]:
                    best[a.end] = (score, off)
                if d == 0 and n == len(a.seq):
                    break
    return best["b"][1], best["e"][1]


def test_clip_kernel_against_a_loop(spark):
    rng = random.Random(5)
    adapters = [R.Adapter("a", "ACGTAC", "e", 2), R.Adapter("b", "TTGA", "b", 1), R.Adapter("c", "ACGTT", "e", 1), R.Adapter("d", "GGTTGA", "b", 3)]
    rows = ["".join(rng.choice("ACGT") for _ in range(rng.randrange(0, 25))) for _ in range(300)] + ["", "A", "ACGTAC", "TTGA"]
    d = frame(spark, [(s, "h" * len(s)) for s in rows])
    out = {r["rec_no"]: (r["clip_start"], r["clip_end"]) for r in R.clip_adapters(d, adapters, 25.0).collect()}
    assert out == {i: plain_clip(s, adapters, 25.0) for i, s in enumerate(rows)}


def test_filters(spark):
    rows = [("", ""), ("ACG", "hhh"), ("ACGTNNNN" * 3, "h" * 24), ("A" * 24, "h" * 24), ("ACAC" * 6, "h" * 24), ("ACGTCATGGTCATTGACCATGCAA", "#" * 24), ("ACGTCATGGTCATTGACCATGCAA", "h" * 24)]
    f = R.Filters(min_length=19, max_n=2, homopolymer=0.9, low_complexity=0.9, min_mean_quality=20)
    d = R.filtered(frame(spark, rows), f, "why")
    assert [r["why"] for r in d.orderBy("rec_no").collect()] == ["empty", "short", "ns", "homopolymer", "complexity", "quality", None]
    assert R.filtered(frame(spark, rows), f).count() == 1


def test_first_seen(spark):
    rows = [("ACGTACGTAA", "h" * 10), ("TTTTTTTTTT", "h" * 10), ("ACGTACGTCC", "h" * 10), ("TTTTTTTTTA", "h" * 10)]
    assert [r["rec_no"] for r in R.first_seen(frame(spark, rows), 8).orderBy("rec_no").collect()] == [0, 1]
    assert [r["rec_no"] for r in R.first_seen(frame(spark, rows), 10).orderBy("rec_no").collect()] == [0, 1, 2, 3]
    counts = {r["prefix"]: r["n"] for r in R.duplicate_counts(frame(spark, rows), 8).collect()}
    assert counts == {"ACGTACGT": 2, "TTTTTTTT": 2}


def test_windowed_quality_trim(spark):
    rng = np.random.default_rng(2)
    rows = [("A" * n, "".join(chr(33 + x) for x in rng.integers(0, 15, n))) for n in (1, 5, 30, 40, 0)]
    d = R.trim_quality(frame(spark, rows), 7, 33, 1)
    for r in d.collect():
        q = rows[r["rec_no"]][1]
        good = [i for i, c in enumerate(q) if ord(c) - 33 >= 7]
        assert r["qual"] == (q[good[0] : good[-1] + 1] if good else "")
    assert R.trim_quality(frame(spark, rows), 7, 33, 5).where("length(qual) > 40").count() == 0


def test_sample_keeps_mates_together(spark):
    d = frame(spark, [("ACGT", "hhhh")] * 1000)
    some = {r["rec_no"] for r in R.sample(d, percent=20, seed=3).collect()}
    assert 130 < len(some) < 270 and some == {r["rec_no"] for r in R.sample(d.repartition(5), percent=20, seed=3).collect()}
    assert R.sample(d, count=17, skip=900).where("rec_no >= 900").count() == 17


def test_skewed_cycles(spark):
    rows = [("A" * 3 + "ACGT"[i % 4] + "ACGT"[i // 4 % 4] + "ACGT"[i % 4], "h" * 6) for i in range(16)]
    out = R.skewed_cycles(frame(spark, rows)).where("not from_end").collect()
    assert sorted(r["cycle"] for r in out) == [0, 1, 2]


def test_signatures(spark):
    d = frame(spark, [("ACGTACGGTTACGTACGGTT", "h" * 20), ("ACGTACGGTTACGTACGGTA", "h" * 20)])
    top, q = R.signature(d, k=5, top=10)
    back = R.signature(d.withColumn("seq", S.revcomp(F.col("seq"))), k=5, top=10)[0]
    assert R.compare_signatures(top, top).first()["similarity"] == 1.0
    assert 0.5 < R.compare_signatures(top, back).first()["similarity"] <= 1.0
    assert q.first()["q"][0] >= 1


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_scalar_functions(spark):
    L = F.lit
    r = one(
        spark, rc=S.revcomp(L("ACGTNac")), hd=S.hamming(L("ACG"), L("ATGA"), 5), gc=S.gc_percent(L("GGCA")), pack=S.pack2(L("ACGT")), name=S.read_name(L("@m:1:2:3 x"), 2), code=S.header_barcode(L("@a 1:N:0:ACGT+TT")),
        field=S.replace_field(L("a\tb\tc"), 2, L("X")), chrom=S.strip_chr(L("Chr7")), idx=S.base_index(L("g")), mask=Q.masked(L("ACGT"), L("I#I#"), 10), adj=Q.adjust(L("II"), add=-5, most=38, by_cycle={1: -3, -1: 2}), mean=Q.mean(L("!I")),
        ops=C.total(L("3S10M2I4D5M"), "ID"), span=C.reference_span(L("3S10M2I4D5M")), qlen=C.query_length(L("3S10M2I4D5M")), plain=C.plain(L("3S10M2I4D5M")), rms=Q.rms(L(1000), L(10)), phred=Q.to_phred(L(0.01)),
    )
    assert r.asDict() == {
        "rc": "gtNACGT", "hd": 3, "gc": 75.0, "pack": 27, "name": "2:3", "code": "ACGT+TT", "field": "a\tX\tc", "chrom": "7", "idx": 2, "mask": "ANGN", "adj": "AF", "mean": 20.0,
        "ops": 6, "span": 19, "qlen": 20, "plain": "20M", "rms": 10, "phred": 20.0,
    }


def test_distributions(spark):
    import math
    from statistics import NormalDist

    ks, mus = [0, 1, 5, 25, 60], [0.5, 3.0, 20.0]
    d = spark.createDataFrame([(k, m) for k in ks for m in mus], "k int, mu double").select("k", "mu", stats.poisson_pmf(F.col("k"), F.col("mu")).alias("p"))
    for k, m, p in d.collect():
        assert math.isclose(p, math.exp(-m + k * math.log(m) - math.lgamma(k + 1)), rel_tol=1e-9)
    ps = [0.001, 0.02, 0.3, 0.5, 0.9, 0.999]
    n = NormalDist()
    for p, x, back in spark.createDataFrame([(p,) for p in ps], "p double").select("p", stats.qnorm(F.col("p")).alias("x"), stats.pnorm(stats.qnorm(F.col("p"))).alias("b")).collect():
        assert math.isclose(x, n.inv_cdf(p), abs_tol=1e-7) and math.isclose(back, p, abs_tol=1e-6)
    assert [one(spark, c=stats.clip_length(F.lit(c), F.lit(1000), F.lit(20)))["c"] for c in (1000, 100, 1)] == [1, 2, 8]


def plain_sw(a, b, match=3, mismatch=-3, gap=-2) -> int:
    h = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i][j] = max(0, h[i - 1][j - 1] + (match if x == y else mismatch), h[i - 1][j] + gap, h[i][j - 1] + gap)
    return max(map(max, h))


def test_local_alignment(spark):
    rng = random.Random(1)
    for _ in range(100):
        a, b = ("".join(rng.choice("ACGT") for _ in range(rng.randrange(15))) for _ in range(2))
        assert local.smith_waterman(a, b)[0] == plain_sw(a, b)
    ad = "GATTACAGATTACA"
    d = frame(spark, [("ACGTTGCA" * 10 + ad + "TTGCCATG" * 10, "h" * 174), ("ACGT" * 5, "h" * 20)])
    out = local.split_reads(d, ad, 50).orderBy("rec_no", "part").collect()
    assert len(out) == 2 and {r["rec_no"] for r in out} == {0} and all(len(r["seq"]) == len(r["qual"]) >= 75 for r in out)
