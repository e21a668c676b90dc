"""Reads: trimming, filters, duplicates, profiles and statistics.

A read is a row of rec_no, seq and qual (id besides, where it came from a file). A template
of several mates is a row of the mates' columns, so its filters are plain conditions.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from seqlake.functions import qual as Q, seq as S
from seqlake.functions.stats import clip_length
from seqlake.operators import chunks


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row.

    A generator of one row keeps the optimiser from writing an expression into every place that
    uses it, which for chained trims would grow the plan without bound.
    """
    kept = [c for c in df.columns if c not in columns]
    return df.select(*kept, F.inline(F.array(F.struct(*[v.alias(c) for c, v in columns.items()]))))


def cut(df: DataFrame, start: Column, end: Column) -> DataFrame:
    """Both strings without their first ``start`` and last ``end`` characters."""
    keep = F.greatest(F.length("seq") - start - end, F.lit(0))
    order = df.columns
    return once(df, **{c: F.substr(F.col(c), start + 1, keep) for c in ("seq", "qual")}).select(*order)


def trim_n(df: DataFrame) -> DataFrame:
    start = S.n_run_start(F.col("seq"))
    end = F.when(start == F.length("seq"), 0).otherwise(S.n_run_end(F.col("seq")))
    return cut(df, start, end)


def trim_quality(df: DataFrame, least: int = 7, phred: int = 33, width: int = 1) -> DataFrame:
    d = once(df, _t=Q.trims(F.col("qual"), least, phred, width))
    return cut(d, F.col("_t.start"), F.col("_t.end")).drop("_t")


def cut_length(df: DataFrame, most: int) -> DataFrame:
    return df.withColumns({c: F.substring(c, 1, most) for c in ("seq", "qual")})


@dataclass(frozen=True)
class Filters:
    """Limits of a read; None: not tested. Percentages are of the read's length."""

    min_length: int = 19
    min_mean_quality: float | None = None
    max_n: int | None = None
    max_n_percent: float | None = None
    quality_at_least: tuple[int, int] | None = None  # (bases, score)
    homopolymer: float | None = None
    low_complexity: float | None = None
    purity: bool = False
    phred: int = 33


def reject_reason(f: Filters, seq: Column | None = None, qual: Column | None = None, name: Column | None = None) -> Column:
    """The first limit that a read breaks, or null."""
    seq = F.col("seq") if seq is None else seq
    qual = F.col("qual") if qual is None else qual
    n = F.length(seq)
    ns = n - F.length(F.replace(seq, F.lit("N"), F.lit("")))
    out = F.when(n == 0, "empty").when(n < f.min_length, "short")
    if f.purity and name is not None:
        out = out.when(name.rlike(" [0-9]+:Y:"), "purity")
    if f.homopolymer is not None:
        out = out.when(S.homopolymer_score(seq) >= F.floor(f.homopolymer * (n - 1)), "homopolymer")
    if f.low_complexity is not None:
        out = out.when(S.low_complexity_score(seq) >= F.floor(f.low_complexity * (n - 1)), "complexity")
    if f.min_mean_quality is not None:
        out = out.when(Q.mean(qual, f.phred) < f.min_mean_quality, "quality")
    if f.max_n is not None:
        out = out.when(ns > f.max_n, "ns")
    if f.max_n_percent is not None:
        out = out.when(ns * 100 > n * f.max_n_percent, "ns")
    if f.quality_at_least is not None:
        need, score = f.quality_at_least
        out = out.when(S.count_where(Q.scores(qual, f.phred), lambda x: x >= score) < need, "quality")
    return out


@dataclass(frozen=True)
class MateLimits:
    """What a template of mates must pass: the least length of each mate, and that of a mate that nothing was cut from."""

    min_length: tuple[int, ...] = (19, 19)
    keep_length: int | None = None
    low_complexity: float | None = None
    homopolymer: float | None = None


def template_reason(f: MateLimits, seqs: list[Column], trimmed: list[Column], quals: list[Column] | None = None, mean_quality: tuple[float | None, ...] = ()) -> Column:
    """The first limit that a template of mates breaks, or null: one mate's failure is the template's.

    ``trimmed`` are the bases cut from each mate. Scores of repeats are pooled over the mates.
    """
    out = None
    for i, (s, t) in enumerate(zip(seqs, trimmed)):
        least = F.lit(f.min_length[min(i, len(f.min_length) - 1)])
        if f.keep_length is not None:
            least = F.when(t == 0, f.keep_length).otherwise(least)
        short = F.length(s) < least
        out = F.when(short, f"short{i + 1}") if out is None else out.when(short, f"short{i + 1}")
    steps = sum((F.greatest(F.length(s) - 1, F.lit(0)) for s in seqs[1:]), F.greatest(F.length(seqs[0]) - 1, F.lit(0)))
    for limit, score, name in ((f.homopolymer, S.homopolymer_score, "homopolymer"), (f.low_complexity, S.low_complexity_score, "complexity")):
        if limit is not None:
            out = out.when(sum((score(s) for s in seqs[1:]), score(seqs[0])) >= F.floor(limit * steps), name)
    for i, (q, least) in enumerate(zip(quals or [], mean_quality)):
        if least is not None:
            out = out.when(Q.mean(q) < least, f"quality{i + 1}")
    return out


def without_index_lanes(df: DataFrame, least: float = 11.0) -> DataFrame:
    """Reads (file, seq) of the files whose mean read length is at least ``least``: shorter ones are barcode lanes."""
    lanes = df.groupBy("file").agg(F.avg(F.length("seq")).alias("_mean")).where(F.col("_mean") < least).select("file")
    return df.join(lanes, "file", "left_anti").select(*df.columns)


def filtered(df: DataFrame, f: Filters, reason: str | None = None) -> DataFrame:
    """Reads within the limits; with ``reason`` all reads, and that column says why one is to go."""
    why = reject_reason(f, name=F.col("id") if "id" in df.columns else None)
    return df.withColumn(reason, why) if reason else df.where(why.isNull())


def first_seen(df: DataFrame, first: int, order: tuple[str, ...] | None = None) -> DataFrame:
    """Of reads with equal first bases, the one that comes first: by file and rec_no, as rec_no counts within a file.

    A minimum and a join on it, both partial on the map side, so a very frequent prefix is not gathered.
    """
    order = order or tuple(c for c in ("file", "rec_no") if c in df.columns)
    key = F.substring("seq", 1, first)
    least = df.groupBy(key.alias("_k")).agg(F.min(F.struct(*order)).alias("_o"))
    return df.withColumns({"_k": key, "_o": F.struct(*order)}).join(least, ["_k", "_o"], "left_semi").drop("_k", "_o")


def duplicate_counts(df: DataFrame, first: int = 35) -> DataFrame:
    """(prefix, n) of prefixes seen more than once."""
    return df.groupBy(F.substring("seq", 1, first).alias("prefix")).agg(F.count("*").alias("n")).where("n > 1")


def by_cycle(df: DataFrame) -> DataFrame:
    """(cycle, base, q, n): counts of every base and quality at every position.

    The exploded rows meet a map-side sum at once, so what is shuffled is at most cycles x bases x scores a task.
    """
    at = F.posexplode(F.arrays_zip(S.bases(F.col("seq")).alias("b"), Q.scores(F.col("qual")).alias("q")))
    return df.select(at.alias("cycle", "x")).groupBy((F.col("cycle") + 1).alias("cycle"), F.col("x.b").alias("base"), F.col("x.q").alias("q")).agg(F.count("*").alias("n"))


def cycle_quality(df: DataFrame) -> DataFrame:
    """Per position: count, least, greatest, sum, mean, quartiles, whiskers within 1.5 interquartile ranges, and bases."""
    c = by_cycle(df)
    quart = F.percentile("q", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("n"))
    base = [F.sum(F.when(F.col("base") == b, F.col("n")).otherwise(0)).alias(f"n_{b.lower()}") for b in "ACGTN"]
    g = c.groupBy("cycle").agg(F.sum("n").alias("n"), F.min("q").alias("q_min"), F.max("q").alias("q_max"), F.sum(F.col("q") * F.col("n")).alias("q_sum"), quart.alias("quart"), *base)
    g = g.select("cycle", "n", "q_min", "q_max", "q_sum", (F.col("q_sum") / F.col("n")).alias("q_mean"), *[F.get("quart", i).alias(x) for i, x in enumerate(("q1", "median", "q3"))], *[f"n_{b.lower()}" for b in "ACGTN"])
    edge = c.join(g.select("cycle", "q1", "q3"), "cycle").where("q >= q1 - 1.5 * (q3 - q1) and q <= q3 + 1.5 * (q3 - q1)").groupBy("cycle").agg(F.min("q").alias("whisker_low"), F.max("q").alias("whisker_high"))
    return g.join(edge, "cycle")


def quality_breakdown(df: DataFrame) -> DataFrame:
    return by_cycle(df).groupBy("cycle", "q").agg(F.sum("n").alias("n"))


def length_histogram(df: DataFrame) -> DataFrame:
    return df.groupBy(F.length("seq").alias("length")).agg(F.count("*").alias("n"))


def gc_distribution(df: DataFrame, first: int = 100) -> DataFrame:
    """(percent, n): each read is spread evenly over the percents that its GC count can round to.

    For a read of n bases a count c claims the percents from round(100 (c - 0.5) / n) to
    round(100 (c + 0.5) / n), each with a share that all counts claiming it have.
    """
    part = F.substring("seq", 1, first)
    reads = df.select(F.length(part).alias("len"), F.length(F.regexp_replace(F.upper(part), "[^GC]", "")).alias("gc")).where("len > 0").groupBy("len", "gc").agg(F.count("*").alias("reads"))
    low = F.greatest(F.floor(100 * (F.col("c") - 0.5) / F.col("len") + 0.5), F.lit(0)).cast("int")
    high = F.least(F.floor(100 * (F.col("c") + 0.5) / F.col("len") + 0.5), F.lit(100)).cast("int")
    model = reads.select("len").distinct().withColumn("c", F.explode(F.sequence(F.lit(0), F.col("len")))).withColumn("percent", F.explode(F.sequence(low, high)))
    claims = model.groupBy("len", "percent").agg(F.count("*").alias("claims"))
    share = model.join(claims, ["len", "percent"]).withColumnRenamed("c", "gc")
    return reads.join(share, ["len", "gc"]).groupBy("percent").agg(F.sum(F.col("reads") / F.col("claims")).alias("n"))


def summary(df: DataFrame, cycles: int = 35) -> DataFrame:
    """One row: reads, lengths, bases, and quality and composition of the first cycles."""
    q = F.slice(Q.scores(F.col("qual")), 1, cycles)
    one = df.select(F.length("seq").alias("len"), F.aggregate(q, F.lit(0), lambda a, x: a + x).alias("qs"), F.aggregate(q, F.lit(0), lambda a, x: a + x * x).alias("qq"), F.size(q).alias("qn"), F.array_min(q).alias("qmin"), F.array_max(q).alias("qmax"), *[(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit("")))).alias(b) for b in "ACGTN"])
    s, n = F.sum("qs").cast("double"), F.sum("qn").cast("double")
    return one.agg(
        F.count("*").alias("reads"), F.min("len").cast("long").alias("len_min"), F.max("len").cast("long").alias("len_max"), F.avg("len").alias("len_mean"), F.coalesce(F.stddev_samp("len"), F.lit(0.0)).alias("len_sd"), F.sum("len").alias("bases"),
        F.min("qmin").cast("long").alias("q_min"), F.max("qmax").cast("long").alias("q_max"), (s / n).alias("q_mean"), F.sqrt((F.sum("qq") - s * s / n) / (n - 1)).alias("q_sd"), *[(100.0 * F.sum(b) / F.sum("len")).alias(f"pct_{b.lower()}") for b in "ACGTN"],
    )


def phred_offset(df: DataFrame, first: int = 10_000) -> DataFrame:
    """One row: the least quality character of the first records, and the offset it means."""
    least = F.min(F.array_min(Q.scores(F.col("qual"), 0)))
    return df.where(F.col("rec_no") < first).agg(least.cast("long").alias("least")).withColumn("phred", F.when(F.col("least") < 64, 33).otherwise(64).cast("long"))


def skewed_cycles(df: DataFrame, percent: float = 2.0) -> DataFrame:
    """(from_end, cycle, base, share): positions where a base is rarer than ``percent``, an unbroken run from either end."""
    b = F.posexplode(S.bases(F.col("seq")))
    sides = df.select(F.lit(False).alias("from_end"), b.alias("cycle", "base")).union(df.select(F.lit(True), F.posexplode(S.bases(F.reverse("seq")))))
    c = sides.groupBy("from_end", "cycle").agg(F.count("*").alias("n"), *[F.sum((F.col("base") == x).cast("long")).alias(x) for x in "ACGT"])
    least = F.array_min(F.array(*[F.struct((100.0 * F.col(x) / F.col("n")).alias("share"), F.lit(x).alias("base")) for x in "ACGT"]))
    skew = c.withColumn("least", least).where(F.col("least.share") < percent)
    run = skew.withColumn("k", F.row_number().over(Window.partitionBy("from_end").orderBy("cycle")) - 1).where("k = cycle")
    return run.select("from_end", "cycle", "least.base", "least.share")


@dataclass(frozen=True)
class Adapter:
    """An adapter that a profile has found: where it is clipped, and how many bases must match."""

    id: str
    seq: str
    end: str = "e"
    least: int = 1


@dataclass
class Profile:
    """What the first records of a file say: the only result that comes to the driver."""

    sampled: int = 0
    phred: int = 33
    adapters: list[Adapter] = field(default_factory=list)


def adapter_counts(df: DataFrame, adapters: DataFrame, scan: int = 15) -> DataFrame:
    """(id, seq, at_end, at_end_exact, at_start, at_start_exact) over the reads of ``df``.

    At the end: the adapter's first ``scan`` bases occur past the read's first. At the start: the
    read's first bases occur in the adapter, or a shorter adapter begins the read.
    ``adapters`` is a list that a user gives, read against every read; its size is checked.
    """
    if adapters.limit(1001).count() > 1000:
        raise ValueError("more than 1000 adapters")
    x = df.select("seq").crossJoin(F.broadcast(adapters.select(F.col("id").alias("a_id"), F.col("seq").alias("a_seq"))))
    end = F.expr(f"locate(substring(a_seq, 1, {scan}), seq, 2)") - 1
    start = F.when(F.length("a_seq") >= scan, F.expr(f"locate(substring(seq, 1, {scan}), a_seq)") - 1).otherwise(F.when(F.expr("startswith(seq, a_seq)"), 0).otherwise(-1))
    used = F.when(F.length("a_seq") >= scan, scan).otherwise(F.length("a_seq"))
    return x.groupBy("a_id", "a_seq").agg(
        F.count_if(end > 0).alias("at_end"), F.count_if((end > 0) & (end == F.length("seq") - scan)).alias("at_end_exact"),
        F.count_if(start >= 0).alias("at_start"), F.count_if((start >= 0) & (start == F.length("a_seq") - used)).alias("at_start_exact"), F.count("*").alias("sampled"),
    ).withColumnsRenamed({"a_id": "id", "a_seq": "seq"})


def adapter_ends(counts: DataFrame, min_percent: float = 0.25, least: int = 1, scale: float = 2.2) -> DataFrame:
    """(id, seq, end, n, clip): adapters over the threshold, the side they are on (a name in _3p or _5p decides), bases to match."""
    over = F.floor(F.col("sampled") * min_percent / 100)
    side = F.when(F.col("at_end") + 10 * F.col("at_end_exact") >= F.col("at_start") + 10 * F.col("at_start_exact"), "e").otherwise("b")
    side = F.when(F.col("id").rlike("_3p(_|$)"), "e").when(F.col("id").rlike("_5p(_|$)"), "b").otherwise(side)
    d = counts.where((F.col("at_end") > over) | (F.col("at_start") > over)).withColumn("end", side)
    n = F.when(F.col("end") == "e", F.col("at_end")).otherwise(F.col("at_start"))
    return d.withColumn("n", n).withColumn("clip", clip_length(F.greatest("n", F.lit(1)), F.col("sampled"), F.length("seq"), least, scale)).select("id", "seq", "end", "n", "clip")


def profile(df: DataFrame, adapters: DataFrame, sample: int = 300_000, min_percent: float = 0.25, least: int = 1, scale: float = 2.2) -> Profile:
    """The profile of the first ``sample`` records: one small job, a row for each adapter found."""
    head = df.where(F.col("rec_no") < sample)
    rows = adapter_ends(adapter_counts(head, adapters), min_percent, least, scale).orderBy("id", "seq").collect()
    return Profile(head.count(), phred_offset(df).first()["phred"] or 33, [Adapter(r["id"], r["seq"], r["end"], r["clip"]) for r in rows])


def _offsets(reads: np.ndarray, n: np.ndarray, adapter: np.ndarray, a: Adapter, percent: float, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """(score, offset) of one adapter for reads of bytes, padded: score is 1000 (d^2 + 1) / compared, later offsets win ties, a whole exact match ends the search."""
    most = int(n.max(initial=0)) if inside < 0 else len(adapter) + inside
    best, at = np.full(len(reads), np.iinfo(np.int64).max), np.zeros(len(reads), np.int64)
    done = np.zeros(len(reads), bool)
    for off in range(max(1, a.least), most + 1):
        size = min(off, len(adapter))
        ok = (n >= off) & ~done
        if not ok.any():
            break
        if a.end == "e":
            place = np.maximum(n - off, 0)[:, None] + np.arange(size)
            other = adapter[:size]
        else:
            place = np.broadcast_to(np.arange(off - size, off), (len(reads), size))
            other = adapter[len(adapter) - size :]
        d = (np.take_along_axis(reads, np.minimum(place, reads.shape[1] - 1), 1) != other).sum(1)
        fits = ok & (d <= int(percent * size) // 100)
        score = (1000 * (d * d + 1)) // size
        win = fits & (score <= best)
        best[win], at[win] = score[win], off
        done |= fits & (d == 0) & (size == len(adapter))
    return best, at


def clip_kernel(adapters: list[Adapter], percent: float = 10.0, inside: int = -1):
    """A pandas function seq -> (start, end): bases to clip, over all adapters; of equal scores the later adapter's.

    An adapter may lie up to ``inside`` bases away from the read's end, anywhere if that is negative.
    """
    bytes_of = [np.frombuffer(a.seq.encode(), np.uint8) for a in adapters]

    def run(seqs: pd.Series) -> pd.DataFrame:
        raw = [(s or "").encode() for s in seqs]
        n = np.array([len(r) for r in raw], np.int64)
        grid = np.zeros((len(raw), max(1, int(n.max(initial=1)))), np.uint8)
        for i, r in enumerate(raw):
            grid[i, : len(r)] = np.frombuffer(r, np.uint8)
        out = {}
        for side, name in (("b", "start"), ("e", "end")):
            best, at = np.full(len(raw), np.iinfo(np.int64).max), np.zeros(len(raw), np.int32)
            for a, b in zip(adapters, bytes_of):
                if a.end == side:
                    score, off = _offsets(grid, n, b, a, percent, inside)
                    win = (score <= best) & (off > 0)
                    best[win], at[win] = score[win], off[win]
            out[name] = at
        return pd.DataFrame(out)

    return F.pandas_udf(run, "start int, end int")


def only_clipped(clipped: DataFrame) -> DataFrame:
    """Of reads with clip_start and clip_end those that an adapter was found in."""
    return clipped.where((F.col("clip_start") > 0) | (F.col("clip_end") > 0))


def clip_adapters(df: DataFrame, adapters: list[Adapter], percent: float = 10.0) -> DataFrame:
    """Reads without adapters, and clip_start, clip_end."""
    if not adapters:
        return df.withColumn("clip_start", F.lit(0)).withColumn("clip_end", F.lit(0))
    d = df.withColumn("_c", clip_kernel(adapters, percent)("seq"))
    d = once(d, clip_start=F.col("_c.start"), clip_end=F.col("_c.end")).drop("_c")
    return cut(d, F.col("clip_start"), F.col("clip_end"))


def trim_reads(df: DataFrame, adapters: list[Adapter] | None = None, least: int = 7, phred: int = 33, width: int = 1, percent: float = 10.0) -> DataFrame:
    """Reads without N runs, bad ends and adapters, and trim_start, trim_end: what went at either end.

    Qualities are judged on what the N runs leave, adapters on the whole read, and of both the longer cut counts.
    """
    run = S.n_run_start(F.col("seq"))
    d = once(df, _s=run, _e=F.when(run == F.length("seq"), 0).otherwise(S.n_run_end(F.col("seq"))))
    inner = F.substr(F.col("qual"), F.col("_s") + 1, F.length("qual") - F.col("_s") - F.col("_e"))
    d = once(d, _t=Q.trims(inner, least, phred, width))
    start, end = F.col("_s") + F.col("_t.start"), F.col("_e") + F.col("_t.end")
    if adapters:
        d = d.withColumn("_c", clip_kernel(adapters, percent)("seq"))
        start, end = F.greatest(start, F.col("_c.start")), F.greatest(end, F.col("_c.end"))
    d = once(d, trim_start=start, trim_end=end).drop("_s", "_e", "_t", "_c")
    return cut(d, F.col("trim_start"), F.col("trim_end"))


def trim_summary(clipped: DataFrame) -> DataFrame:
    """One row: count, mean and deviation of what was clipped at either end."""
    out = []
    for c in ("clip_start", "clip_end"):
        v = F.when(F.col(c) > 0, F.col(c))
        out += [F.count(v).alias(f"{c}_n"), F.coalesce(F.avg(v), F.lit(0.0)).alias(f"{c}_mean"), F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{c}_sd")]
    return clipped.agg(*out)


def sample(df: DataFrame, count: int | None = None, percent: float | None = None, seed: int = 1, skip: int = 0) -> DataFrame:
    """Records chosen by a hash of rec_no, so mates stay together and runs agree; ``skip`` leaves out the first."""
    d = df.where(F.col("rec_no") >= skip)
    h = F.pmod(F.xxhash64("rec_no", F.lit(seed)), F.lit(1 << 40))
    if count is not None:
        return d.orderBy(h, "rec_no").limit(count)
    return d.where(h < int((percent or 0) / 100 * (1 << 40)))


def running_quality(df: DataFrame, first_bases: int = 20_000, least: float = 18.0, width: int = 1 << 16) -> DataFrame:
    """Flags junk while a sample is taken: below ``least`` or more than one N at first, later below mean - 3 deviations too.

    The running moments are those of the rows before, by file (column ``file``) and rec_no, summed in chunks of ``width`` records.
    """
    d = df.withColumns({"_m": Q.mean(F.col("qual")), "_len": F.length("seq")}).withColumns({"_one": F.col("_m").isNotNull().cast("int"), "_mm": F.col("_m") * F.col("_m")})
    d = chunks.running_sum(d, "file", "rec_no", "_one", "_len", "_m", "_mm", width=width)
    n, b, s, ss = (F.col(f"{c}_sum") - F.coalesce(c, F.lit(0)) for c in ("_one", "_len", "_m", "_mm"))
    sd = F.sqrt(F.greatest(F.try_divide(ss - F.try_divide(s * s, n), n - 1), F.lit(0.0)))
    ns = F.length("seq") - F.length(F.replace("seq", F.lit("N"), F.lit("")))
    early = (F.col("_m") < least) | (ns > 1)
    late = F.col("_m") < F.least(F.lit(least), F.try_divide(s, n) - 3 * F.coalesce(sd, F.lit(0.0)))
    d = d.withColumn("junk", F.when(b < first_bases, early).otherwise(late))
    return d.select(*df.columns, "junk")


def kmer_counts(df: DataFrame, k: int) -> DataFrame:
    return df.select(F.explode(S.kmers(F.col("seq"), k)).alias("kmer")).where(~F.col("kmer").contains("N")).groupBy("kmer").agg(F.count("*").alias("n"))


def signature(df: DataFrame, k: int = 9, top: int = 100, quantiles: int = 10) -> tuple[DataFrame, DataFrame]:
    """A k-mer signature: the top k-mers with their level (share of the mean count), and quantiles of all counts."""
    c = kmer_counts(df, k)
    mean = c.agg(F.avg("n").alias("mean"))
    lead = c.orderBy(F.desc("n"), "kmer").limit(top).crossJoin(F.broadcast(mean)).select("kmer", (F.col("n") / F.col("mean")).alias("level"))
    return lead, c.agg(F.percentile("n", F.array(*[F.lit(i / quantiles) for i in range(quantiles + 1)])).alias("q"))


def compare_signatures(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the share of levels that two signatures' k-mers, or their reverse complements, have in common."""
    canon = lambda d: d.select(F.least("kmer", S.revcomp(F.col("kmer"))).alias("kmer"), "level").groupBy("kmer").agg(F.sum("level").alias("level"))
    x = canon(a).withColumnRenamed("level", "x").join(canon(b).withColumnRenamed("level", "y"), "kmer", "full")
    x = x.na.fill(0.0, ["x", "y"])
    return x.agg(F.try_divide(F.sum(F.least("x", "y")), F.sum(F.greatest("x", "y"))).alias("similarity"))


def quantile_distance(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the mean relative difference of two signatures' quantiles (arrays ``q`` of equal length), each scaled by its own greatest."""
    x = a.select(F.col("q").alias("x")).crossJoin(b.select(F.col("q").alias("y")))  # one row each
    scaled = lambda c: F.transform(c, lambda v: v / F.array_max(c))
    d = F.zip_with(scaled(F.col("x")), scaled(F.col("y")), lambda p, q: F.abs(p - q))
    return x.select(F.try_divide(F.aggregate(d, F.lit(0.0), lambda s, v: s + v), F.size(d).cast("double")).alias("distance"))
