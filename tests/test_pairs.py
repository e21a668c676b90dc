"""Pairs: overlaps against loops, demultiplexing rules."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from seqlake.operators import pairs as P

COMP = str.maketrans("ACGT", "TGCA")


def rc(s: str) -> str:
    return s.translate(COMP)[::-1]


def plain_overlap(a: str, b: str, least: int, percent: int) -> int:
    best, at = 1 << 60, -1
    for o in range(least, min(len(a), len(b)) + 1):
        d = sum(x != y for x, y in zip(a[len(a) - o :], b[:o]))
        if d <= percent * o // 100 and 1000 * (d * d + 1) // o < best:
            best, at = 1000 * (d * d + 1) // o, o
    return at


def made(rng, n: int):
    out = []
    for i in range(n):
        whole = "".join(rng.choice("ACGT") for _ in range(60))
        k = rng.randrange(5, 40)
        a, b = whole[:40], whole[40 - k : 40 - k + rng.randrange(20, 41)]
        b = "".join(rng.choice("ACGT") if rng.random() < 0.04 else c for c in b)
        q = lambda s: "".join(chr(33 + rng.randrange(2, 41)) for _ in s)
        out.append((i, a, q(a), rc(b), q(b)))
    return out


def test_merge_against_a_loop(spark):
    rows = made(random.Random(7), 200)
    d = spark.createDataFrame(rows, "rec_no long, s1 string, q1 string, s2 string, q2 string")
    out = {r["rec_no"]: r for r in P.join_pairs(d).collect()}
    native = {r["rec_no"]: r["o"] for r in d.select("rec_no", P.overlap(F.col("s1"), F.col("s2"))["len"].alias("o")).collect()}
    hit = 0
    for i, a, qa, s2, q2 in rows:
        b, qb, r = rc(s2), q2[::-1], out[i]
        o = plain_overlap(a, b, 6, 8)
        assert (native[i] or -1) == o and r["joined"] == (o > 0)
        if o <= 0:
            continue
        hit += 1
        seq, qual = a[: len(a) - o], qa[: len(a) - o]
        for x, y, p, q in zip(a[len(a) - o :], b[:o], qa[len(a) - o :], qb[:o]):
            hi, lo = max(p, q), min(p, q)
            seq += x if x == y or p > q else y
            qual += hi if x == y else chr(33 + min(ord(hi), max(ord(hi) - ord(lo), 3)))
        assert (r["overlap"], r["seq"], r["qual"]) == (o, seq + b[o:], qual + qb[o:])
    assert hit > 50


def test_short_inserts(spark):
    """Without ``compat`` an insert inside the longer read is found at its place."""
    rng = random.Random(9)
    ins = "".join(rng.choice("ACGT") for _ in range(30))
    long = "".join(rng.choice("ACGT") for _ in range(7)) + ins + "".join(rng.choice("ACGT") for _ in range(5))
    rows = [(0, long, "I" * 42, rc(ins), "I" * 30), (1, ins, "I" * 30, rc(long), "I" * 42)]
    d = spark.createDataFrame(rows, "rec_no long, s1 string, q1 string, s2 string, q2 string")
    out = {r["rec_no"]: r["seq"] for r in P.join_pairs(d, extend=True, compat=False).collect()}
    assert out == {0: ins, 1: ins}
    assert {r["joined"] for r in P.join_pairs(d).collect()} == {False}


def test_summary(spark):
    d = spark.createDataFrame([(True, 10), (True, 20), (False, 0)], "joined boolean, overlap int")
    r = P.join_summary(d).first()
    assert (r["pairs"], r["joined"], r["mean"], round(r["sd"], 4)) == (3, 2, 15.0, 7.0711)


def test_zip_needs_equal_files(spark):
    a = spark.createDataFrame([(0, "@a 1", "A", "I"), (1, "@b 1", "C", "I")], "rec_no long, id string, seq string, qual string")
    b = a.withColumn("id", F.replace("id", F.lit(" 1"), F.lit(" 2")))
    both = P.zip_mates(a, b)
    assert both.count() == 2 and P.verify_ids(both, " ", 1).count() == 2
    with pytest.raises(Exception, match="different numbers"):
        P.zip_mates(a, b.where("rec_no = 0")).collect()
    with pytest.raises(Exception, match="out of step"):
        P.verify_ids(P.zip_mates(a, b.withColumn("id", F.lit("@z 2"))), " ", 1).collect()


def test_demultiplexing(spark):
    codes = spark.createDataFrame([("one", "ACGTAC"), ("two", "TTGCAA"), ("three", "TTGCCC")], "bid string, bc string")
    seqs = ["ACGTACGGG", "ACGTAAGGG", "TTGCAAGGG", "TTGCACGGG", "GGGGGGGGG", "ACG", ""]
    d = spark.createDataFrame([(i, s, "I" * len(s)) for i, s in enumerate(seqs)], "rec_no long, seq string, qual string")
    out = {r["rec_no"]: r["barcode"] for r in P.assign(d, codes).collect()}
    assert out == {0: "one", 1: "one", 2: "two", 3: None, 4: None, 5: None, 6: None}
    counts = {r["barcode"]: r["n"] for r in P.assign_counts(P.assign(d, codes)).collect()}
    assert counts == {"one": 2, "two": 1, "unmatched": 4, "total": 7}
    cut = P.trim_barcode(P.assign(d, codes), codes.select("bid", "bc"))
    assert {r["seq"] for r in cut.where("rec_no < 3").collect()} == {"GGG"}
    empty = P.assign(d, codes.limit(0))
    assert empty.where("barcode is not null").count() == 0
    dual = spark.createDataFrame([("x", "ACGT", "GGTT"), ("y", "ACGT", "CCAA")], "bid string, bc string, bc2 string")
    two = spark.createDataFrame([(0, "ACGT", "IIII", "GGTT"), (1, "ACGT", "IIII", "CCAT"), (2, "TTTT", "IIII", "CCAA")], "rec_no long, seq string, qual string, seq2 string")
    assert {r["rec_no"]: r["barcode"] for r in P.assign_dual(two, dual).collect()} == {0: "x", 1: "y", 2: None}


def test_discovery_and_profile(spark):
    rows = ["ACGTAC"] * 50 + ["TTGCAA"] * 40 + ["GGGGGG"] * 3 + ["ACNTAC"] * 60
    d = spark.createDataFrame([(i, s + "TTT", "I" * 9) for i, s in enumerate(rows)], "rec_no long, seq string, qual string")
    assert {r["bc"] for r in P.discover_barcodes(d, 6).collect()} == {"ACGTAC", "TTGCAA"}
    codes = spark.createDataFrame([("g1", "ACGTAC"), ("g1", "TTGCAA"), ("g2", "CCCCCC"), ("g2", "GGGGGG")], "grp string, bc string")
    best = P.barcode_profile(d, codes).first()
    assert (best["grp"], best["at_start"], best["at_end"]) == ("g1", 90, 0)


def test_known_species(spark):
    s = spark.createDataFrame([("ACGTA", 5), ("ACGT", 7), ("ACGTACC", 1), ("GG", 2)], "seq string, n long")
    known = spark.createDataFrame([("ACGT",), ("ACGTA",)], "seq string")
    assert {r["seq"]: r["n"] for r in P.match_known(s, known).collect()} == {"ACGTA": 6, "ACGT": 7}
