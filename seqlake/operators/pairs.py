"""Mates: zipping files, overlaps, merging, demultiplexing."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqlake.functions import qual as Q, seq as S


def zip_mates(*files: DataFrame, fields: tuple[str, ...] = ("id", "seq", "qual")) -> DataFrame:
    """Record N of every side in one row: rec_no and a struct r1, r2, ... of each; a missing mate fails the run.

    Where a side has several files (column ``file``), the n-th file by name of one side meets
    the n-th of the others, and ``lane`` is n.
    """
    out, on = None, ["rec_no"]
    if all("file" in f.columns for f in files):
        on = ["lane", "rec_no"]
        lanes = [f.select("file").distinct().withColumn("lane", F.row_number().over(Window.orderBy("file"))) for f in files]  # a row a file
        files = tuple(f.join(n, "file") for f, n in zip(files, lanes))
    for i, f in enumerate(files, 1):
        d = f.select(*on, F.struct(*[c for c in fields if c in f.columns]).alias(f"r{i}"))
        out = d if out is None else out.join(d, on, "full")
    whole = F.assert_true(F.expr(" and ".join(f"r{i} is not null" for i in range(1, len(files) + 1))), "files have different numbers of records")
    return out.where(whole.isNull())


def verify_ids(pairs: DataFrame, upto: str, every: int = 100) -> DataFrame:
    """Fails the run where every n-th pair's names differ before the character ``upto``."""
    a, b = (F.substring_index(F.col(f"{r}.id"), upto, 1) for r in ("r1", "r2"))
    return pairs.where(F.assert_true((F.col("rec_no") % every != 0) | (a == b), "mates out of step").isNull())


_REVERSED = bytes.maketrans(b"ACGTacgt", b"TGCAtgca")
_NONE = np.int64(1 << 60)


def _grid(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(rows of bytes from the left, their lengths)."""
    n = np.array([len(r) for r in raw], np.int64)
    grid = np.zeros((len(raw), max(1, int(n.max(initial=1)))), np.uint8)
    grid[np.arange(grid.shape[1]) < n[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return grid, n


def _window(grid: np.ndarray, start: np.ndarray, width: int) -> np.ndarray:
    """``width`` bytes of each row from its own start."""
    return np.take_along_axis(grid, np.clip(start[:, None] + np.arange(width), 0, grid.shape[1] - 1), 1)


def best_overlaps(a: np.ndarray, la: np.ndarray, b: np.ndarray, lb: np.ndarray, least: int, percent: int, extend: bool = False, compat: bool = True):
    """(score, overlap, shift) for rows of two grids: a's end on b's start, mismatches at most ``percent``.

    The score is 1000 (d^2 + 1) / compared, the lowest wins, and of equal ones the shortest.
    With ``extend`` the shorter read, if not wholly overlapped, is tried inside the longer one at
    every shift; ``compat`` counts shifts from 0 and has a longer a's part begin one base before it.
    """
    n = np.minimum(la, lb)
    score, at, shift = np.full(len(n), _NONE), np.zeros(len(n), np.int64), np.zeros(len(n), np.int64)

    def offer(rows: np.ndarray, d: np.ndarray, size: np.ndarray, by: int) -> None:
        s = 1000 * (d * d + 1) // np.maximum(size, 1)
        win = rows & (d <= percent * size // 100) & (s < score)
        score[win], at[win], shift[win] = s[win], size[win], by

    for o in range(least, int(n.max(initial=0)) + 1):
        rows = n >= o
        offer(rows, (_window(a, la - o, o) != b[:, :o]).sum(1), np.full(len(n), o), 0)
    if extend:
        longer, open_ = la > lb, (at < n) & (la != lb)
        for i in range(int(np.abs(la - lb)[open_].max(initial=0))):
            rows = open_ & (i < np.abs(la - lb))
            by = i if compat else i + 1
            width = int(n[rows].max(initial=0))
            x = _window(a, np.where(longer, la - n - i - 1, 0), width)  # shift i of compat and i + 1 of the other begin at one base
            y = _window(b, np.where(longer, 0, by), width)
            offer(rows, ((x != y) & (np.arange(width) < n[:, None])).sum(1), n, by)
    return score, at, shift


def overlap_kernel(least: int = 6, percent: int = 8):
    """A pandas function (s1, s2) -> (score, len) of the best overlap, a batch of pairs at a time; nulls where there is none."""

    def run(s1: pd.Series, s2: pd.Series) -> pd.DataFrame:
        a, la = _grid([x.encode() for x in s1.fillna("")])
        b, lb = _grid([x.encode().translate(_REVERSED)[::-1] for x in s2.fillna("")])
        score, at, _ = best_overlaps(a, la, b, lb, least, percent)
        none = at == 0
        return pd.DataFrame({"score": pd.array(np.where(none, 0, score), "Int64"), "len": pd.array(at, "Int32")}).mask(none[:, None].repeat(2, 1), pd.NA)

    return F.pandas_udf(run, "score long, len int")


def overlap(s1: Column, s2: Column, least: int = 6, percent: int = 8) -> Column:
    """(score, len) of the best overlap of s1's end with the start of reversed s2, of nulls where there is none; of equal scores the shortest."""
    return overlap_kernel(least, percent)(s1, s2)


def merge_kernel(least: int = 6, percent: int = 8, extend: bool = False, reverse: bool = True, compat: bool = True):
    """A pandas function (s1, q1, s2, q2) -> (joined, overlap, seq, qual), a batch of pairs at a time.

    Where reads agree the better score stays, where not the better base does, with a score of
    what it is better by, at least 3. With ``extend`` the shorter read may lie inside the longer.
    ``compat`` does that as the classic program does: shifts start at 0, a longer first read is
    taken one base further left, and what a longer second read has after the overlap is kept.
    """

    def run(s1: pd.Series, q1: pd.Series, s2: pd.Series, q2: pd.Series) -> pd.DataFrame:
        turn = (lambda x, table: x.translate(table)[::-1]) if reverse else (lambda x, table: x)
        identity = bytes(range(256))
        a, la = _grid([x.encode() for x in s1.fillna("")])
        b, lb = _grid([turn(x.encode(), _REVERSED) for x in s2.fillna("")])
        qa, _ = _grid([x.encode("latin-1") for x in q1.fillna("")])
        qb, _ = _grid([turn(x.encode("latin-1"), identity) for x in q2.fillna("")])
        _, o, ext = best_overlaps(a, la, b, lb, least, percent, extend, compat)
        joined = o > 0
        # The parts of both reads that are put together: their starts and lengths.
        inside, longer = ext > 0, la > lb
        a0 = np.where(inside & longer, la - o - ext - compat, 0)
        na = np.where(inside & longer, o, la)
        b0 = np.where(inside & ~longer, ext, 0)
        nb = np.where(inside & ~longer, lb - ext if compat else o, lb)
        size = np.where(joined, na - o + nb, 0)
        p = np.arange(int(size.max(initial=0)))[None, :]
        in_a, k = p < na[:, None], p - (na - o)[:, None]
        in_b = (k >= 0) & (k < nb[:, None])
        pick = lambda grid, at: np.take_along_axis(grid, np.clip(at, 0, grid.shape[1] - 1), 1)
        x, y = pick(a, a0[:, None] + p), pick(b, b0[:, None] + k)
        u, v = pick(qa, a0[:, None] + p).astype(np.int64), pick(qb, b0[:, None] + k).astype(np.int64)
        both, same, best = in_a & in_b, x == y, np.maximum(u, v)
        base = np.where(both, np.where(same | (u > v), x, y), np.where(in_a, x, y)).astype(np.uint8)
        qual = np.where(both, np.where(same, best, 33 + np.minimum(best, np.maximum(np.abs(u - v), 3))), np.where(in_a, u, v)).astype(np.uint8)
        text = lambda grid, code: [grid[i, :n].tobytes().decode(code) if j else None for i, (n, j) in enumerate(zip(size.tolist(), joined.tolist()))]
        return pd.DataFrame({"joined": joined, "overlap": np.where(joined, o + ext, 0), "seq": text(base, "utf-8"), "qual": text(qual, "latin-1")})

    return F.pandas_udf(run, "joined boolean, overlap int, seq string, qual string")


def join_pairs(pairs: DataFrame, **options) -> DataFrame:
    """Pairs (s1, q1, s2, q2) with joined, overlap, seq, qual."""
    d = pairs.withColumn("_m", merge_kernel(**options)("s1", "q1", "s2", "q2"))
    return d.select(*pairs.columns, "_m.*")


def join_summary(joined: DataFrame) -> DataFrame:
    """One row: pairs, joined, mean and deviation of the overlaps."""
    o = F.when(F.col("joined"), F.col("overlap"))
    return joined.agg(F.count("*").alias("pairs"), F.count(o).alias("joined"), F.coalesce(F.avg(o), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_samp(o), F.lit(0.0)).alias("sd"))


def assign(reads: DataFrame, barcodes: DataFrame, mismatch: int = 1, distance: int = 2, end: str = "b", quality: int = 0, shifted: bool = False) -> DataFrame:
    """``reads`` with barcode (null: unmatched), best and next distance.

    The nearest barcode (bid, bc) wins if it is within ``mismatch``, alone, and the next is at least ``distance`` further.
    Distances to all barcodes are an array of the row, so nothing is multiplied or shuffled;
    the list is checked to be of at most 6000 and becomes a literal of the plan.
    """
    listed = barcodes.select("bid", "bc").orderBy("bid").limit(6001).collect()
    if len(listed) > 6000:
        raise ValueError("more than 6000 barcodes")
    if not listed:
        return reads.withColumns({"barcode": F.lit(None).cast("string"), "best": F.lit(None).cast("int"), "next": F.lit(None).cast("int")})
    seq = Q.masked(F.col("seq"), F.col("qual"), quality) if quality else F.col("seq")
    codes = F.array(*[F.struct(F.lit(r["bid"]).alias("bid"), F.lit(r["bc"]).alias("bc")) for r in listed])

    def far(x):
        n = F.length(x["bc"])
        lag = 1 if shifted else 0
        part = F.substr(seq, F.lit(1 + lag), n) if end == "b" else F.when(F.length(seq) >= n + lag, F.substr(seq, F.length(seq) - n - lag + 1, n)).otherwise("")
        return F.struct(S.hamming(part, x["bc"], n).alias("d"), x["bid"].alias("bid"))

    d = reads.withColumn("_d", F.array_sort(F.transform(codes, far)))
    best, after = F.get("_d", 0), F.get("_d", 1)
    ok = (best["d"] <= mismatch) & (after["d"].isNull() | (after["d"] > best["d"])) & ((best["d"] == 0) | after["d"].isNull() | (after["d"] - best["d"] >= distance))
    return d.withColumns({"barcode": F.when(ok, best["bid"]), "best": best["d"], "next": after["d"]}).drop("_d")


def assign_dual(reads: DataFrame, barcodes: DataFrame, mismatch: int = 1, distance: int = 2) -> DataFrame:
    """As ``assign`` over two index reads seq, seq2 and barcodes bc, bc2: distances are added."""
    both = reads.withColumn("_seq", F.col("seq")).withColumn("_q", F.col("qual"))
    n1 = barcodes.agg(F.max(F.length("bc"))).first()[0] or 0
    joined = both.withColumn("seq", F.concat(F.rpad(F.substring("seq", 1, n1), n1, "."), F.col("seq2")))
    out = assign(joined, barcodes.select("bid", F.concat(F.rpad("bc", n1, "."), F.col("bc2")).alias("bc")), mismatch, distance)
    return out.withColumn("seq", F.col("_seq")).withColumn("qual", F.col("_q")).drop("_seq", "_q")


def trim_barcode(assigned: DataFrame, barcodes: DataFrame, end: str = "b") -> DataFrame:
    """The barcode's bases cut off where one was found."""
    n = F.coalesce(F.length("bc"), F.lit(0))
    d = assigned.join(barcodes.select(F.col("bid").alias("barcode"), "bc"), "barcode", "left")
    keep = F.greatest(F.length("seq") - n, F.lit(0))
    first = n + 1 if end == "b" else F.lit(1)
    return d.withColumns({c: F.substr(F.col(c), first, keep) for c in ("seq", "qual")}).drop("bc")


def assign_counts(assigned: DataFrame) -> DataFrame:
    """(barcode, n): each barcode, ``unmatched``, ``total``."""
    name = F.coalesce(F.col("barcode").cast("string"), F.lit("unmatched"))
    return assigned.rollup(name.alias("barcode")).agg(F.count("*").alias("n")).withColumn("barcode", F.coalesce("barcode", F.lit("total")))


def discover_barcodes(reads: DataFrame, length: int, sample: int = 100_000, share: float = 0.1) -> DataFrame:
    """(bc, n): prefixes of at least ``share`` of the second most frequent one's count, among the first records."""
    c = reads.where(F.col("rec_no") < sample).groupBy(F.substring("seq", 1, length).alias("bc")).agg(F.count("*").alias("n")).where(~F.col("bc").contains("N"))
    second = c.orderBy(F.desc("n"), "bc").limit(2).agg(F.min("n").alias("m"))
    return c.crossJoin(F.broadcast(second)).where(F.col("n") >= F.col("m") * share).select("bc", "n")


def barcode_profile(reads: DataFrame, barcodes: DataFrame, sample: int = 200_000) -> DataFrame:
    """(grp, at_start, at_end, score): how often a group's barcodes begin or end the first reads, best group first."""
    head = reads.where(F.col("rec_no") < sample).select(F.upper("seq").alias("seq"))
    b = barcodes.select("grp", F.upper("bc").alias("bc"))
    starts = head.withColumn("len", F.explode(F.array(*[F.lit(r[0]) for r in b.select(F.length("bc")).distinct().collect()])))
    counts = starts.groupBy(F.substr(F.col("seq"), F.lit(1), F.col("len")).alias("s")).agg(F.count("*").alias("n")), starts.groupBy(F.right(F.col("seq"), F.col("len")).alias("s")).agg(F.count("*").alias("n"))
    at = [c.join(b, c["s"] == b["bc"]).groupBy("grp", "bc").agg(F.sum("n").alias(x)) for c, x in zip(counts, ("at_start", "at_end"))]
    x = at[0].join(at[1], ["grp", "bc"], "full").na.fill(0)
    g = x.groupBy("grp").agg(F.sum("at_start").alias("at_start"), F.sum("at_end").alias("at_end"), F.sum(F.greatest("at_start", "at_end") * F.log(F.length("bc"))).alias("score"))
    return g.orderBy(F.desc("score"), "grp")


def match_known(species: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """Counts (seq, n) summed on known sequences (seq) that equal them, or equal them without up to ``most`` last bases (the least number)."""
    d = species.withColumn("cut", F.explode(F.sequence(F.lit(0), F.lit(most)))).withColumn("key", F.expr("substring(seq, 1, length(seq) - cut)"))
    hit = d.join(known.select(F.col("seq").alias("key")), "key").groupBy("seq").agg(F.min_by(F.struct("key", "n"), "cut").alias("m"))
    return hit.groupBy(F.col("m.key").alias("seq")).agg(F.sum("m.n").alias("n"))


def species_summary(reads: DataFrame) -> DataFrame:
    """(seq, n, log10, normal): counts of equal sequences, their logarithm, and counts over their upper quartile."""
    c = reads.groupBy("seq").agg(F.count("*").alias("n"))
    return c.crossJoin(F.broadcast(c.agg(F.percentile("n", 0.75).alias("uq")))).select("seq", "n", F.log10("n").alias("log10"), (F.col("n") / F.col("uq")).alias("normal"))


def barcode_counts(reads: DataFrame, barcodes: DataFrame, sample: int = 200_000) -> DataFrame:
    """(bid, bc, grp, at_start, at_end, shift_start, shift_end, dual) among the first reads, in any case of letters.

    At a start or an end the barcode's bases stand first or last, shifted: one base further in. ``dual``
    counts reads that begin with bc and end with bc2, where barcodes have one. The lengths of
    the list, of which there are few, decide what is cut from a read.
    """
    head = reads.where(F.col("rec_no") < sample).select(F.upper("seq").alias("seq"))
    b = barcodes.select("bid", F.upper("bc").alias("bc"), *[F.upper(c).alias(c) if c == "bc2" else F.col(c) for c in ("bc2", "grp") if c in barcodes.columns])
    lengths = [r[0] for r in b.select(F.length("bc")).distinct().collect()]
    places = {"at_start": lambda n: F.substring("seq", 1, n), "at_end": lambda n: F.right("seq", F.lit(n)), "shift_start": lambda n: F.substring("seq", 2, n), "shift_end": lambda n: F.when(F.length("seq") > n, F.substr("seq", F.length("seq") - n, F.lit(n)))}
    cuts = F.array(*[F.struct(F.lit(p).alias("place"), f(n).alias("s")) for p, f in places.items() for n in lengths])
    seen = head.select(F.inline(cuts)).groupBy("place", "s").agg(F.count("*").alias("n"))
    x = b.join(seen, b["bc"] == seen["s"], "left").groupBy(*b.columns).agg(*[F.coalesce(F.sum(F.when(F.col("place") == p, F.col("n"))), F.lit(0)).alias(p) for p in places])
    if "bc2" not in b.columns:
        return x.withColumn("dual", F.lit(0).cast("long"))
    pairs = b.select("bc", "bc2").where("bc2 is not null").select(F.length("bc").alias("n"), F.length("bc2").alias("m")).distinct().collect()
    if not pairs:
        return x.withColumn("dual", F.lit(0).cast("long"))
    both = head.select(F.inline(F.array(*[F.struct(F.substring("seq", 1, r["n"]).alias("bc"), F.right("seq", F.lit(r["m"])).alias("bc2")) for r in pairs]))).groupBy("bc", "bc2").agg(F.count("*").alias("dual"))
    return x.join(both, ["bc", "bc2"], "left").withColumn("dual", F.coalesce("dual", F.lit(0)))


def select_barcodes(counts: DataFrame, factor: float = 20.0) -> DataFrame:
    """(bid, bc, grp, end, shifted, n) of the best group's barcodes that are seen at least 1 / ``factor`` as often as its mean.

    Groups are compared by the sums of max(start, end) ln(length). The side with more counts
    over the group is the end; barcodes are read shifted where counts one base further in are at least
    1.2 times those at the edge.
    """
    most = F.greatest(*[F.col(c) for c in ("at_start", "at_end", "shift_start", "shift_end")])
    g = counts.groupBy("grp").agg(F.sum(F.greatest("at_start", "at_end") * F.log(F.length("bc"))).alias("score"), *[F.sum(c).alias(f"g_{c}") for c in ("at_start", "at_end", "shift_start", "shift_end")], F.avg(most).alias("mean"))
    best = g.orderBy(F.desc("score"), "grp").limit(1)
    end = F.greatest("g_at_end", "g_shift_end") > F.greatest("g_at_start", "g_shift_start")
    shifted = F.when(end, F.col("g_shift_end") >= 1.2 * F.col("g_at_end")).otherwise(F.col("g_shift_start") >= 1.2 * F.col("g_at_start"))
    best = best.select("grp", "mean", F.when(end, "e").otherwise("b").alias("end"), (shifted & (F.greatest("g_shift_start", "g_shift_end") > 0)).alias("shifted"))
    n = F.when(F.col("end") == "e", F.when(F.col("shifted"), F.col("shift_end")).otherwise(F.col("at_end"))).otherwise(F.when(F.col("shifted"), F.col("shift_start")).otherwise(F.col("at_start")))
    return counts.join(best, "grp").withColumn("n", n).where((F.col("n") > 0) & (F.col("n") >= F.col("mean") / factor)).select("bid", "bc", "grp", "end", "shifted", "n")


def list_end(counts: DataFrame) -> DataFrame:
    """One row for a given list of barcodes: the end at which its counts are greater, and whether any pair of ends is dual often enough (a thousandth of the counts)."""
    return counts.agg(F.when(F.sum("at_end") > F.sum("at_start"), "e").otherwise("b").alias("end"), (F.sum("dual") * 1000 >= F.greatest(F.sum("at_start"), F.sum("at_end"))).alias("dual"), F.sum("at_start").alias("at_start"), F.sum("at_end").alias("at_end"))


def annotated(species: DataFrame, patterns: DataFrame) -> DataFrame:
    """Sequences (seq, ...) with ``name``: that of an equal pattern (name, seq), else of the first by name that the sequence holds, else null.

    The patterns are a list of at most 1000 and become a literal of the plan.
    """
    listed = patterns.select("name", "seq").orderBy("name", "seq").limit(1001).collect()
    if len(listed) > 1000:
        raise ValueError("more than 1000 patterns")
    if not listed:
        return species.withColumn("name", F.lit(None).cast("string"))
    known = F.array(*[F.struct(F.lit(r["name"]).alias("name"), F.lit(r["seq"]).alias("seq")) for r in listed])
    equal, inside = F.filter(known, lambda p: p["seq"] == F.col("seq")), F.filter(known, lambda p: F.contains(F.col("seq"), p["seq"]))
    return species.withColumn("name", F.coalesce(F.get(equal, 0)["name"], F.get(inside, 0)["name"]))
