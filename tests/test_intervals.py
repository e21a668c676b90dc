"""Interval joins and matrices on tables that small files hold, against brute force."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from seqlake.operators import alignments as A, tables as T


def test_rows_in_bins_are_not_broadcast(spark, tmp_path):
    spark.range(50_000).selectExpr("id % 10 as chr", "id % 2000 as pos", "id as pid").write.parquet(f"{tmp_path}/p")
    spark.range(100_000).selectExpr("id % 10 as chr", "id as beg", "id + 30 as en", "id as iid").write.parquet(f"{tmp_path}/i")
    points, intervals = spark.read.parquet(f"{tmp_path}/p"), spark.read.parquet(f"{tmp_path}/i")
    ranges = points.selectExpr("chr", "pos as b_beg", "pos + 20 as b_en", "pid")
    built = lambda d: [re.search("Build(Left|Right)", x)[1] for x in d._jdf.queryExecution().executedPlan().toString().splitlines() if "BroadcastHashJoin" in x]
    assert built(T.points_in(points, intervals)) == ["Right"]
    # The first join has the first side's rows in bins, the second the other's.
    assert built(T.overlaps(ranges.selectExpr("chr", "b_beg as beg", "b_en as en", "pid as aid"), intervals.selectExpr("chr", "beg as b_beg", "en as b_en", "iid as bid"))) == ["Right", "Left"]


def test_intervals_of_any_size(spark):
    rng = random.Random(3)
    at = lambda: (rng.choice("xy"), rng.randrange(-20, 5000))
    spans = [(c, b, b + rng.choice([0, 1, 30, 200, 3000, 1 << 36]), i) for i, (c, b) in enumerate(at() for _ in range(120))]
    points = [(*at(), i) for i in range(150)]
    i, p = spark.createDataFrame(spans, "chr string, beg long, en long, iid long"), spark.createDataFrame(points, "chr string, pos long, pid long")
    want = {(pid, iid) for c, pos, pid in points for k, b, e, iid in spans if c == k and b <= pos <= e}
    got = [(r["pid"], r["iid"]) for r in T.points_in(p, i).collect()]
    assert len(got) == len(want) and {*got} == want
    both = T.overlaps(i, i.selectExpr("chr", "beg as b_beg", "en as b_en", "iid as bid"))
    pairs = [(r["iid"], r["bid"]) for r in both.collect()]
    want_pairs = {(x[3], y[3]) for x in spans for y in spans if x[0] == y[0] and x[1] <= y[2] and x[2] >= y[1]}
    assert len(pairs) == len(want_pairs) and {*pairs} == want_pairs
    found = {r["pid"]: r["rows"] for r in T.IntervalIndex.build(i, "iid").lookup(p).collect()}
    assert found == {pid: sorted(x[1] for x in want if x[0] == pid) for pid in {x[0] for x in want}}


def test_amplicon_ends(spark):
    rng = random.Random(5)
    row = lambda: (rng.choice("xy"), rng.randrange(-14, 26), rng.randrange(-14, 26))
    reads, amplicons = [(*row(), i) for i in range(600)], [row() for _ in range(60)]
    a = spark.createDataFrame(amplicons, "chr string, beg long, en long")
    out = T.at_amplicon_ends(spark.createDataFrame(reads, "chr string, beg long, en long, rid long"), a)
    want = {i: any(c == k and abs(b - x) <= 1 and abs(e - y) <= 1 for k, x, y in amplicons) for c, b, e, i in reads}
    assert {r["rid"]: r["amplicon"] for r in out.collect()} == want and out.columns == ["chr", "beg", "en", "rid", "amplicon"]
    assert "Expand" not in (plan := out._jdf.queryExecution().optimizedPlan().toString()) and "inline" not in plan and "bit_or" in plan


def test_samples_by_one_shuffle(spark):
    calls = [("x", 1, "A", 3.0), ("x", 1, "A", 5.0), ("x", 1, "N", None), ("x", 2, "R", 1.0), ("x", 2, "Q", 9.0)]
    m = T.sample_matrix(spark.createDataFrame(calls, "chr string, pos long, sample string, value double"), ["A", "N", "R"])
    assert sorted(map(tuple, m.collect())) == [("x", 1, 5.0, None, None), ("x", 2, None, None, 1.0)]
    assert m._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [") == 1


def test_insert_sizes_of_many_long_pairs(spark):
    # A sum whose square, and squares whose sum, leave 64 bits.
    d = spark.range(4000).select(F.lit(3).alias("flag"), (F.col("id") % 5 * 100_000_000 + 1_500_000_000).cast("int").alias("tlen"))
    r = A.insert_sizes(d, 0.0, 1.0).first()
    assert r["median"] == 1_700_000_000 and r["mean"] == pytest.approx(1_700_000_000) and r["sd"] == pytest.approx(141_421_356.2373 * (4000 / 3999) ** 0.5)
    assert [*A.insert_sizes(d.where("false")).first()] == [None] * 5
    assert A.insert_sizes(d.limit(1)).first()["sd"] is None


def test_frequent_keys_are_dealt_out(spark):
    a = spark.range(900).selectExpr("case when id < 600 then 'x' when id < 890 then 'y' else 'z' end as k", "id % 500 as i")
    b = spark.range(300).selectExpr("case when id < 200 then 'x' when id < 290 then 'w' else 'z' end as k", "id as j")
    want = sorted(map(tuple, a.join(b, "k").collect()))
    assert sorted(map(tuple, T.join_dealt(a, b, 50).collect())) == want
    out = T.join_many([T.keyed(spark.range(9000).selectExpr("concat('x', id % 1) as k", "id as i"), "k"), T.keyed(spark.range(4000).selectExpr("concat('x', id % 1) as k", "id as j"), "k")])
    per = [r["n"] for r in out.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert sum(per) == 36_000_000 and len(per) > 1
