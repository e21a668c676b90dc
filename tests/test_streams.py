"""Streams give what the batch operators give."""

from __future__ import annotations

from datetime import datetime, timedelta

from seqlake.streaming import streams

START = datetime(2024, 1, 1)


def source(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).repartition(3).write.mode("append").parquet(path)
    return streams.read_stream(spark, path, schema, 1)


def result(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).start()
    try:
        q.processAllAvailable()
    finally:
        q.stop()
    return [r.asDict() for r in df.sparkSession.table(name).collect()]


def test_first_seen(spark, tmp_path):
    rows = [(i, s, START + timedelta(seconds=i)) for i, s in enumerate(["ACGTA", "ACGTC", "TTTTT", "ACGTG", "TTTTA"])]
    out = result(streams.first_seen(source(spark, str(tmp_path / "r"), rows, "rec_no long, seq string, ts timestamp"), 4, "ts", "1 hour"), "first_seen", "append")
    assert sorted(r["seq"][:4] for r in out) == ["ACGT", "TTTT"]


def test_running_counts_and_union(spark, tmp_path):
    a = source(spark, str(tmp_path / "a"), [("x",), ("y",)], "k string")
    b = source(spark, str(tmp_path / "b"), [("x",)], "k string")
    out = result(streams.running_counts(streams.merged(a, b), "k"), "counts", "complete")
    assert {r["k"]: r["n"] for r in out} == {"x": 2, "y": 1}


def test_running_moments(spark, tmp_path):
    rows = [("f", float(v)) for v in range(10)] + [("g", 5.0)]
    out = result(streams.running_moments(source(spark, str(tmp_path / "m"), rows, "file string, mean_quality double")), "moments", "update")
    last = {f: max((r for r in out if r["file"] == f), key=lambda r: r["n"]) for f in "fg"}
    assert last["f"]["n"] == 10 and last["f"]["mean"] == 4.5 and round(last["f"]["sd"], 4) == 3.0277 and last["g"]["sd"] == 0.0


def test_tumbling(spark, tmp_path):
    rows = [(START + timedelta(minutes=20 * i), "a", 1.0) for i in range(6)]
    out = result(streams.tumbling(source(spark, str(tmp_path / "t"), rows, "ts timestamp, event_type string, value double"), late="10 minutes"), "tumbling", "complete")
    assert sorted((r["start"].hour, r["n"]) for r in out) == [(0, 3), (1, 3)]
