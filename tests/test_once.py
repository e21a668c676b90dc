"""What a query computes of a read or a locus, it computes once."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from seqlake.functions import qual as Q
from seqlake.operators import variants as V
from seqlake.plans import catalogue, more  # isort: skip
from seqlake.plans import calling  # after what it needs
from tests.conftest import SMALL


def optimized(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_reads_are_made_once(spark):
    # The filter's lambdas had the digests inside, and made them for each base of a read.
    plan = optimized(more.signature_filter(spark, SMALL))
    assert plan.count("md5(") == 4 and "md5(" not in "".join(x for x in plan.splitlines() if "Filter" in x)
    assert optimized(catalogue._reads(spark, SMALL).where("seq like 'A%' and qual like 'J%'")).count("md5(") == 4


def test_adjust_decodes_once(spark):
    d = spark.createDataFrame([("+5J#",), ("",), ("I",)], "qual string")
    plan = optimized(d.select(Q.adjust(F.col("qual"), 3, 38, by_cycle={2: -5, -1: -9}).alias("q")))
    assert plan.count("ascii(") == 1
    assert [r[0] for r in d.select(Q.adjust(F.col("qual"), 3, 38, by_cycle={2: -5, -1: -9})).collect()] == [".3G!", "", "C"]


def test_loci_are_walked_once(spark):
    for df in (calling.variant_rows(spark, SMALL), calling.variant_scaled_deletions(spark, SMALL)):
        assert optimized(df).count("FlatMapCoGroupsInPandas") == 1


def test_skimmed_reads_are_those_of_rows():
    rng = random.Random(4)
    part = lambda: rng.choice(["^" + rng.choice("I^$+~"), ".", ",", "a", "G", "*", ">", "$", "+2AC", "-1n", "+12ACGTACGTACGT", "-", "+"])
    for _ in range(200):
        a, b = V.Walker(), V.Walker()
        for pos in range(1, 12):
            bases = "".join(part() for _ in range(rng.randrange(12))) + rng.choice(["", "", "^"])
            a.row(pos, "A", bases, "I" * 12)
            b.skim(pos, bases)
        assert (a.reads, a.left, a.before, a.ended, a.total) == (b.reads, b.left, b.before, b.ended, b.total)


def test_scaled_deletions_of_several_loci(spark):
    rows = [("x", 4, "-", 2, 0, 60), ("x", 5, "*", 2, 2, 40), ("x", 5, "-", 1, 1, 50), ("x", 6, "A", 1, 1, 9), ("y", 4, "-", 1, 0, 30)]
    out = V.scale_deletions(spark.createDataFrame(rows, "chr string, pos int, base string, fwd int, rev int, qual long"))
    assert sorted(map(tuple, out.select("chr", "pos", "base", "qual").collect())) == [("x", 4, "-", 20), ("x", 5, "*", 40), ("x", 5, "-", 50), ("x", 6, "A", 9), ("y", 4, "-", 30)]
