"""Benchmark passages in documents: SimHash of item-sized windows, Hamming blocks, exact verification.

Everything here is DataFrame expressions. Words are runs of letters and digits of the
lower-cased text; shingles are five words (an item of fewer words is one shingle).

1. A window can only be similar to an item if most shingles are common. Of an item's i and a
   window's m shingles, similarity s needs (i + m) s / (1 + s) common ones, whatever their
   order. Positions whose shingle occurs in an item of that size are found first, and every
   start whose window has so many of them is taken, so none is lost. A document shorter than
   the item is one window, the whole document.
2. Each window gets a SimHash of 252 bits of its shingles with multiplicity. Cut into 20 blocks,
   two fingerprints within distance 59 differ by at most two bits in some block; items are
   entered under every value within two bits of each block, so an equi-join on (size, block,
   value) returns every pair within the radius. Two unrelated fingerprints of one size meet in
   0.29 blocks on average, and what meets is measured before anything is shuffled again.
3. Pairs are verified by the weighted Jaccard similarity of shingle multisets.

At similarity 0.8 the expected distance is 38 with a deviation of 5.7, so the radius leaves out
about three in ten thousand such windows, ever fewer above it, and an exact passage never.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from seqlake.llm.shared import table

SIZE = 5
#: Words of a fingerprint, bits of each, widths of the blocks of one, bits by which a block may differ, and the distance within which no pair is lost.
WORDS, BITS, WIDTHS, BLOCK_RADIUS = 4, 63, (13, 13, 13, 12, 12), 2
RADIUS = WORDS * len(WIDTHS) * (BLOCK_RADIUS + 1) - 1
#: Counters of a SimHash share a long in lanes of this many bits, so an item has fewer shingles than 2**LANE.
LANE = 21
#: A side of a join is broadcast up to so many rows (or numbers in its arrays), shuffled beyond.
BROADCAST_ROWS = 200_000


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits, in order; null gives none."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def shingles(w: Column, size: int) -> Column:
    """Hash of every run of ``size`` words, by position."""
    return F.when(F.size(w) >= size, F.transform(F.slice(w, 1, F.greatest(F.size(w) - (size - 1), F.lit(1))), lambda x, i: F.xxhash64(x, *[F.get(w, i + k) for k in range(1, size)]))).otherwise(F.array().cast("array<bigint>"))


def fingerprint(s: Column) -> Column:
    """SimHash of an array of hashes: WORDS longs of BITS bits each."""
    lane, ones = (1 << LANE) - 1, sum(1 << LANE * k for k in range(BITS // LANE))
    shift = lambda name, x, n: F.call_function(name, x, n.cast("int"))

    def word(k: int) -> Column:
        def bits(mixed: Column) -> Column:
            sums = F.transform(F.sequence(F.lit(0), F.lit(LANE - 1)), lambda j: F.aggregate(mixed, F.lit(0).cast("long"), lambda a, h: a + shift("shiftrightunsigned", h, j).bitwiseAND(F.lit(ones))))
            most = lambda v, n: F.when(2 * F.shiftrightunsigned(v, LANE * n).bitwiseAND(F.lit(lane)) > F.size(mixed), F.lit(1 << LANE * n)).otherwise(F.lit(0)).cast("long")
            return F.aggregate(F.transform(sums, lambda v, j: shift("shiftleft", most(v, 0) + most(v, 1) + most(v, 2), j)), F.lit(0).cast("long"), lambda a, v: a.bitwiseOR(v))

        return F.get(F.transform(F.array(F.transform(s, lambda h: F.xxhash64(h, F.lit(k)))), bits), 0)  # a lambda's argument is computed once

    return F.array(*[word(k) for k in range(WORDS)])


def distance(a: Column, b: Column) -> Column:
    """Differing bits of two fingerprints."""
    return sum((F.bit_count(F.get(a, k).bitwiseXOR(F.get(b, k))) for k in range(1, WORDS)), F.bit_count(F.get(a, 0).bitwiseXOR(F.get(b, 0))))


def blocks(fp: Column) -> Column:
    """The blocks of a fingerprint, as (block, value)."""
    out = []
    for k in range(WORDS):
        at = 0
        for w in WIDTHS:
            out.append(F.struct(F.lit(len(out)).alias("block"), F.shiftrightunsigned(F.get(fp, k), at).bitwiseAND(F.lit((1 << w) - 1)).alias("value")))
            at += w
    return F.array(*out)


def _masks(width: int) -> Column:
    """All values of ``width`` bits of which at most BLOCK_RADIUS are set."""
    return F.array(*[F.lit(m).cast("long") for m in range(1 << width) if m.bit_count() <= BLOCK_RADIUS])


#: Entries of an item: the values near each of its blocks.
ENTRIES = WORDS * sum(1 + w + w * (w - 1) // 2 for w in WIDTHS)


def meetings(windows: DataFrame, entries: DataFrame, small: bool = False) -> DataFrame:
    """(windows' columns, item_id) of every pair of a window (size, fp) and an item (item_id, size, ifp) of its size, once for each block in which they differ by at most BLOCK_RADIUS bits."""
    wide = F.get(F.array(*[F.lit(w) for w in WIDTHS * WORDS]), F.col("block"))
    masks = F.lit(None)
    for w in {*WIDTHS}:
        masks = F.when(wide == w, _masks(w)).otherwise(masks)
    keys = entries.select("item_id", "size", "ifp", F.inline(blocks(F.col("ifp")))).select("item_id", "size", "ifp", "block", "value", F.explode(masks).alias("mask"))
    keys = keys.select("item_id", "size", "ifp", "block", F.col("value").bitwiseXOR(F.col("mask")).alias("value"))
    probe = windows.select("*", F.inline(blocks(F.col("fp"))))
    return probe.join(F.broadcast(keys) if small else keys, ["size", "block", "value"]).drop("block", "value")


def similarity(a: Column, b: Column) -> Column:
    """Weighted Jaccard similarity of two multisets of hashes: sum of minima over sum of maxima of their counts."""
    both = F.aggregate(
        F.array_distinct(a), F.lit(0).cast("long"),
        lambda s, h: s + F.least(F.size(F.filter(a, lambda x: x == h)), F.size(F.filter(b, lambda x: x == h))),
    )
    return F.try_divide(both.cast("double"), (F.size(a) + F.size(b)).cast("double") - both)


def items(benchmark: DataFrame) -> DataFrame:
    """(item_id, size in words, k words of a shingle, its shingles) of the items that have words."""
    b = benchmark.select(benchmark["item_id"].cast("long").alias("item_id"), words(benchmark["text"].cast("string")).alias("w")).where(F.size("w") > 0)
    k = F.least(F.size("w"), F.lit(SIZE))
    parts = F.when(k == SIZE, shingles(F.col("w"), SIZE))
    for n in range(1, SIZE):
        parts = parts.when(k == n, shingles(F.col("w"), n))
    return b.select("item_id", F.size("w").alias("size"), k.alias("k"), parts.alias("sh")).distinct()


def leaks(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """(doc_id, item_id, position, similarity) of every document and item with a window of at least ``least``, the best window of each.

    A window has as many words as the item, or all words of a document that has fewer.
    docs: doc_id, text; benchmark: item_id, text; other columns are not read. Null and empty
    texts on either side match nothing. A tie goes to the first position. Rows that repeat a
    doc_id or item_id give one result, whichever of their texts has the best window; a row
    whose id is null has none. An empty table on either side gives none.
    """
    item = table(items(benchmark), "items")
    n_items, n_shingles, longest, sizes = item.agg(F.count("*"), F.coalesce(F.sum(F.size("sh")), F.lit(0)), F.coalesce(F.max(F.size("sh")), F.lit(0)), F.collect_set("k")).first()
    if longest >= 1 << LANE:
        raise ValueError(f"an item of {longest} shingles; the most is {(1 << LANE) - 1}")
    hint = F.broadcast if n_shingles <= BROADCAST_ROWS else (lambda d: d)  # sides of at most a row, or a number, for each shingle
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), words(docs["text"].cast("string")).alias("w"))
    known = item.select("k", F.explode("sh").alias("h")).distinct()
    hits = None
    for k in sorted(sizes or [SIZE]):
        at = d.select("doc_id", F.size("w").alias("words"), F.posexplode(shingles(F.col("w"), k)).alias("p", "h")).join(hint(known.where(F.col("k") == k).select("h")), "h", "left_semi").withColumn("k", F.lit(k))
        hits = at if hits is None else hits.union(at)
    hits = table(hits.select("doc_id", "words", "p", "h", "k"), "hits")
    # Positions of shingles that any item of a size has, by document and number of its words: repeated rows add none.
    place = item.select("size", "k", F.explode("sh").alias("h")).distinct()
    near = hits.join(hint(place), ["k", "h"]).groupBy("doc_id", "words", "size", "k").agg(F.array_sort(F.collect_set("p")).alias("at"))
    full = F.col("size") - F.col("k") + 1
    near = near.withColumn("need", F.ceil((full + F.least(full, F.col("words") - F.col("k") + 1)) * F.lit(least / (1 + least)) - 1e-9).cast("int"))
    near = near.where(F.size("at") >= F.col("need")).withColumn("full", full).withColumn("last", F.greatest(F.col("words") - F.col("size"), F.lit(0)))
    # The starts of windows with positions i to i + need - 1 in them that have not position i - 1.
    runs = F.transform(F.slice("at", 1, F.size("at") - F.col("need") + 1), lambda p, i: F.struct(
        F.greatest(F.get("at", i + F.col("need") - 1) - F.col("full") + 1, F.coalesce(F.get("at", i - 1) + 1, F.lit(0)), F.lit(0)).alias("lo"),
        F.least(p, F.col("last")).alias("hi"),
    ))
    window = near.select("doc_id", "words", "size", "k", F.explode(F.filter(runs, lambda r: r["lo"] <= r["hi"])).alias("r"))
    window = table(window.select("doc_id", "words", "size", "k", F.explode(F.sequence("r.lo", "r.hi")).alias("start")), "windows")
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    cut = texts.join(window.groupBy("doc_id").agg(F.collect_set(F.struct("words", "size", "k", "start")).alias("of")), "doc_id").dropDuplicates(["doc_id", "text"]).withColumn("w", words(F.col("text"))).select("doc_id", "w", F.explode("of").alias("x")).select("doc_id", "x.*", "w")
    cut = cut.where(F.size("w") == F.col("words")).withColumn("w", F.slice("w", F.col("start") + 1, F.col("size")))
    sh = None
    for k in range(1, SIZE + 1):
        sh = (F if sh is None else sh).when(F.col("k") == k, shingles(F.col("w"), k))
    cut = table(cut.select("doc_id", "size", "start", sh.alias("sh")).withColumn("fp", fingerprint(F.col("sh"))), "fingerprints")
    entry = item.select("item_id", "size", F.col("sh").alias("ish")).withColumn("ifp", fingerprint(F.col("ish")))
    entry = table(entry, "entries")
    met = meetings(cut.drop("sh"), entry.select("item_id", "size", "ifp"), n_items * ENTRIES <= BROADCAST_ROWS)
    pairs = met.where(distance(F.col("fp"), F.col("ifp")) <= RADIUS).select("doc_id", "size", "start", "item_id").distinct()
    checked = pairs.join(hint(entry.select("item_id", "size", "ish")), ["item_id", "size"]).join(cut.select("doc_id", "size", "start", "sh"), ["doc_id", "size", "start"])
    checked = checked.withColumn("similarity", similarity(F.col("sh"), F.col("ish"))).where(F.col("similarity") >= least)
    best = F.max_by(F.struct("start", "similarity"), F.struct("similarity", -F.col("start")))
    return checked.groupBy("doc_id", "item_id").agg(best.alias("b")).select("doc_id", "item_id", F.col("b.start").cast("long").alias("position"), F.col("b.similarity").alias("similarity"))


def clean(docs: DataFrame, benchmark: DataFrame, least: float = 0.8) -> DataFrame:
    """The rows of ``docs`` without any leak, all columns as they were."""
    return docs.join(leaks(docs, benchmark, least).select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)
