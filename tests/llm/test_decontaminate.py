"""Benchmark leaks against trying every window of every document."""

from __future__ import annotations

import random

from seqlake.llm import decontaminate
from seqlake.llm.queries import op4_decontaminate
from tests.conftest import MEDIUM
from tests.llm import brute

DOCS, ITEMS = "doc_id long, text string, k int, size string", "item_id long, text string, doc_id long, h string"


def frames(spark, docs, items):
    return spark.createDataFrame([(*d, 1, "x") for d in docs], DOCS), spark.createDataFrame([(*i, 0, "x") for i in items], ITEMS)


def result(df) -> dict:
    return {(r["doc_id"], r["item_id"]): round(r["similarity"], 9) for r in df.collect()}


def rounded(x: dict) -> dict:
    return {k: round(v, 9) for k, v in x.items()}


def test_query_equals_all_windows(spark):
    read = lambda t, i: [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/{t}.parquet").select(i, "text").collect()]
    want = brute.leaks(read("documents", "doc_id"), read("benchmark", "item_id"))
    assert want and result(op4_decontaminate(spark, MEDIUM)) == rounded(want)


def test_edited_passages(spark):
    """Words replaced, dropped and put in, around the threshold; items of one to sixty words; shared and repeated shingles."""
    rng = random.Random(8)
    vocab = [f"w{i}" for i in range(60)]
    items = [(n, " ".join(rng.choice(vocab) for _ in range(n))) for n in (1, 3, 4, 5, 6, 12, 30, 45, 60)] + [(100, "echo " * 20), (101, "Don't stop - now!"), (102, None), (103, "... --")]
    docs = []
    for i in range(120):
        w = (rng.choice(items)[1] or "").split()
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4])):
            at = rng.randrange(len(w) + 1)
            kind = rng.randrange(3)
            w = w[:at] + ([] if kind == 0 else ["new"]) + w[at + (kind != 1) :]
        fill = [f"f{rng.randrange(1000)}" for _ in range(rng.randrange(40))]
        docs.append((i, " ".join(fill[: len(fill) // 2] + w + fill[len(fill) // 2 :])))
    docs += [(500, None), (501, ""), (502, "echo " * 3000), (503, "DON'T  STOP, now")]
    d, i = frames(spark, docs, items)
    want = brute.leaks(docs, items)
    assert len(want) > 60 and result(decontaminate.leaks(d, i)) == rounded(want)
    dirty = {k for k, _ in want}
    kept = decontaminate.clean(d, i)
    assert kept.columns == d.columns and {r["doc_id"] for r in kept.collect()} == {k for k, _ in docs} - dirty


def test_repeated_rows_and_nulls(spark):
    d, i = frames(spark, [(1, "a b c d e f g"), (1, "a b c d e f g"), (None, "a b c d e f g"), (2, "x y"), (3, "no"), (3, "a b c d e f g"), (3, "x")], [(5, "a b c d e f"), (5, "a b c d e f"), (None, "q r s t u v")])
    assert result(decontaminate.leaks(d, i)) == {(1, 5): 1.0, (3, 5): 1.0}
    kept = sorted((r["doc_id"] or 0) for r in decontaminate.clean(d, i).collect())
    assert kept == [0, 2]  # a row without an id can't be named by a leak, and stays


def test_empty_tables(spark):
    for docs, items in (([], [(1, "a b c d e")]), ([(1, "a b c d e")], []), ([], [])):
        d, i = frames(spark, docs, items)
        assert decontaminate.leaks(d, i).count() == 0
        assert decontaminate.clean(d, i).count() == len(docs)


def test_reordered_and_shortened_passages(spark):
    """Halves, sentences and lines in another order, and documents that are shorter than the item."""
    rng = random.Random(4)
    text = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    items = [(n, text(n)) for n in (40, 60, 100, 150)]
    docs = []
    for n, w in items:
        for parts in (2, 2, 3, 4):
            cuts = [0, *sorted(rng.sample(range(1, n), parts - 1)), n]
            pieces = [w[a:b] for a, b in zip(cuts, cuts[1:])]
            rng.shuffle(pieces)
            docs.append([*text(rng.randrange(30)), *sum(pieces, []), *text(rng.randrange(30))])
        docs.append(w[n // 2 :] + w[: n // 2])
        docs += [w[lost // 2 : n - lost + lost // 2] for lost in (1, 3, n // 10, n // 5, n // 4)]
        docs += [w[:7] + w[9:], w[n // 2 + 3 :] + w[: n // 2]]
    docs = [(i, " ".join(w)) for i, w in enumerate(docs)]
    items = [(i, " ".join(w)) for i, w in items]
    long, short = brute.leaks(docs, items), brute.short_leaks(docs, items)
    d, i = frames(spark, docs, items)
    assert len(long) > 5 and len(short) > 10 and result(decontaminate.leaks(d, i)) == rounded(long | short)


def test_the_index_selects(spark):
    """Of 1,000 items and 300 windows of one size, unlike each other, few pairs meet and none is within the radius; every pair within it meets."""
    from pyspark.sql import functions as F

    rng = random.Random(9)
    text = lambda: [f"w{rng.randrange(10**6)}" for _ in range(50)]
    items = [text() for _ in range(1000)]
    near = [[w if i % 25 != k % 25 else "x" for i, w in enumerate(t)] for k, t in enumerate(items[:40])]
    frame = lambda rows, name: spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(rows)], f"{name} long, text string")
    b = decontaminate.items(frame(items, "item_id")).select("item_id", "size", decontaminate.fingerprint(F.col("sh")).alias("ifp"))
    w = decontaminate.items(frame([text() for _ in range(300)], "item_id")).select(F.col("item_id").alias("doc_id"), "size", decontaminate.fingerprint(F.col("sh")).alias("fp"))
    met = decontaminate.meetings(w, b).withColumn("d", decontaminate.distance(F.col("fp"), F.col("ifp")))
    n, within, pairs = met.agg(F.count("*"), F.count_if(F.col("d") <= decontaminate.RADIUS), F.count_distinct("doc_id", "item_id")).first()
    assert pairs <= n < 0.33 * 300 * 1000 and within == 0
    w = decontaminate.items(frame(near, "item_id")).select(F.col("item_id").alias("doc_id"), "size", decontaminate.fingerprint(F.col("sh")).alias("fp"))
    all_pairs = w.join(b, "size").where(decontaminate.distance(F.col("fp"), F.col("ifp")) <= decontaminate.RADIUS)
    found = decontaminate.meetings(w, b).where(decontaminate.distance(F.col("fp"), F.col("ifp")) <= decontaminate.RADIUS).select("doc_id", "item_id").distinct()
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, all_pairs.select("doc_id", "item_id").collect())) and found.where("doc_id = item_id").count() >= 20


def test_fingerprints_are_majorities(spark):
    """Bit by bit against counting, for shingles that repeat."""
    from pyspark.sql import functions as F

    d = spark.createDataFrame([([5, 7, 7, 9, -3],), ([1],), ([2, 2, 3, 3],), ([*range(300)],)], "s array<bigint>")
    word = lambda k: F.transform("s", lambda h: F.xxhash64(h, F.lit(k)))
    for r in d.select("s", decontaminate.fingerprint(F.col("s")).alias("fp"), F.array(*[word(k) for k in range(decontaminate.WORDS)]).alias("h")).collect():
        for fp, h in zip(r["fp"], r["h"]):
            assert fp == sum(1 << j for j in range(decontaminate.BITS) if 2 * sum(x >> j & 1 for x in h) > len(h))


def test_recall_at_the_threshold(spark):
    """Windows of similarity just above 0.8, all of which brute force finds."""
    rng = random.Random(12)
    items = [(i, [f"v{rng.randrange(3000)}" for _ in range(90)]) for i in range(20)]
    docs = []
    for n in range(300):
        w = list(items[n % 20][1])
        w[rng.randrange(5, 85)] = "zz"
        w[3 if n % 2 else -4] = "yy"
        docs.append((n, " ".join(["pre"] * (n % 9) + w + ["post"] * (n % 7))))
    items = [(i, " ".join(w)) for i, w in items]
    d, i = frames(spark, docs, items)
    want, got = rounded(brute.leaks(docs, items)), result(decontaminate.leaks(d, i))
    assert len(want) >= 250 and min(want.values()) < 0.84 and len(got) >= len(want) - 1
    # A document's best window can be lost where another one of its windows is found.
    assert got.keys() <= want.keys() and sum(got[k] != want[k] for k in got) <= 1
