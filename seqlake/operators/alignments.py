"""Alignments: statistics, coverage, mates, competing mappings."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from seqlake.functions import cigar as C, qual as Q, seq as S

FLAG = lambda bit: F.col("flag").bitwiseAND(F.lit(bit)) != 0


def summary(a: DataFrame) -> DataFrame:
    """One row over alignments (flag, pos, mapq, cigar, seq, qual, nm): counts, strands, moments, rates, composition."""
    mapped = ~FLAG(4) & (F.col("pos") > 0)
    m = lambda c: F.when(mapped, c)
    bases = F.sum(m(F.length("seq")))
    ins, dels = C.total(F.col("cigar"), "I"), C.total(F.col("cigar"), "D")
    return a.agg(
        F.count("*").alias("reads"), F.count_if(mapped).alias("mapped"), F.count_if(FLAG(256)).alias("secondary"), F.count_if(mapped & FLAG(16)).alias("reverse"), F.count_if(mapped & ~FLAG(16)).alias("forward"),
        bases.alias("bases"), F.max(m(F.length("seq"))).alias("len_max"), F.avg(m(F.length("seq"))).alias("len_mean"), F.avg(m(F.col("mapq"))).alias("mapq_mean"), F.stddev_samp(m(F.col("mapq"))).alias("mapq_sd"), F.percentile(m(F.col("mapq")), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("mapq_quartiles"),
        F.try_divide(F.sum(m(F.greatest(F.coalesce("nm", F.lit(0)) - ins - dels, F.lit(0)))), bases).alias("snp_rate"), F.try_divide(F.sum(m(ins)), bases).alias("ins_rate"), F.try_divide(F.sum(m(dels)), bases).alias("del_rate"),
        F.try_divide(F.count_if(mapped & (F.coalesce("nm", F.lit(0)) > 0)), F.count_if(mapped)).alias("mismatched"), F.try_divide(F.sum(m(Q.total(F.col("qual")))), bases).alias("q_mean"),
        *[F.try_divide(100 * F.sum(m(F.length("seq") - F.length(F.replace("seq", F.lit(b), F.lit(""))))), bases).alias(f"pct_{b.lower()}") for b in "ACGTN"],
    )


def insert_sizes(a: DataFrame, low: float = 0.1, high: float = 0.9) -> DataFrame:
    """One row over proper pairs: quartiles, and mean and deviation between two percentiles."""
    d = a.where((F.col("tlen") > 0) & ~FLAG(4)).groupBy("tlen").agg(F.count("*").alias("n"))
    q = d.agg(F.percentile("tlen", F.array(*[F.lit(p) for p in (0.25, 0.5, 0.75, low, high)]), F.col("n")).alias("q"))
    x = d.crossJoin(F.broadcast(q))
    w = F.when((F.col("tlen") >= F.get("q", 3)) & (F.col("tlen") <= F.get("q", 4)), F.col("n")).otherwise(0)
    off = F.col("tlen") - F.get("q", 1)  # from the median, as a double: squares of whole lengths leave 64 bits
    n, s, ss = F.sum(w).cast("double"), F.sum(w * off), F.sum(w * off * off)
    first = lambda i: F.first(F.get("q", i))
    v = F.try_divide(ss - F.try_divide(s * s, n), n - 1)
    return x.agg(first(0).alias("q1"), first(1).alias("median"), first(2).alias("q3"), (first(1) + F.try_divide(s, n)).alias("mean"), F.sqrt(F.when(v < 0, 0.0).otherwise(v)).alias("sd"))


def multi_mapping(a: DataFrame) -> DataFrame:
    """One row: names, ambiguous ones, singletons, most mappings of one."""
    n = a.where(~FLAG(4)).groupBy(S.read_name(F.col("qname"), 0).alias("name")).agg(F.count("*").alias("n"))
    return n.agg(F.count("*").alias("names"), F.count_if(F.col("n") > 1).alias("ambiguous"), F.count_if(F.col("n") == 1).alias("single"), F.max("n").alias("most"))


def coverage(a: DataFrame, contigs: DataFrame, bins: int = 30) -> DataFrame:
    """(rname, bases, share, signature) by contig (name, length): a character a bin, '0' + log2(1 + reads)."""
    d = a.where(~FLAG(4) & (F.col("pos") > 0)).join(contigs.withColumnRenamed("name", "rname"), "rname")
    b = F.least(F.floor((F.col("pos") - 1) * bins / F.col("length")), F.lit(bins - 1)).cast("int")
    g = d.groupBy("rname", b.alias("bin")).agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"))
    g = g.groupBy("rname").agg(F.sum("bases").alias("bases"), F.map_from_entries(F.collect_list(F.struct("bin", "n"))).alias("m"))
    total = g.agg(F.sum("bases").alias("total"))
    sig = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(bins - 1)), lambda i: F.char(48 + F.floor(F.log2(1 + F.coalesce(F.try_element_at("m", i), F.lit(0)))).cast("int"))), "")
    return g.crossJoin(F.broadcast(total)).select("rname", "bases", (100.0 * F.col("bases") / F.col("total")).alias("share"), sig.alias("signature"))


def position_skew(a: DataFrame, contigs: DataFrame) -> DataFrame:
    """(rname, skewness, covered, cv): population skewness of mapped positions with one point at either end, covered share and spread."""
    ends = contigs.select(F.col("name").alias("rname"), F.lit(1).alias("pos")).union(contigs.select("name", F.col("length").cast("int")))
    d = a.where(~FLAG(4) & (F.col("pos") > 0))
    skew = d.select("rname", "pos").union(ends).groupBy("rname").agg(F.skewness("pos").alias("skewness"))
    depth = d.groupBy("rname", "pos").agg(F.count("*").alias("n")).groupBy("rname").agg(F.count("*").alias("positions"), F.try_divide(F.stddev_pop("n"), F.avg("n")).alias("cv"))
    return skew.join(depth, "rname", "left").join(contigs.withColumnRenamed("name", "rname"), "rname").select("rname", "skewness", (F.coalesce("positions", F.lit(0)) * 100.0 / F.col("length")).alias("covered"), "cv")


def discordant(a: DataFrame, far: int = 1000) -> DataFrame:
    other = ~F.col("rnext").isin("=", "*")
    return a.agg(F.count_if(FLAG(1) & ~FLAG(4) & other & (F.col("rnext") != F.col("rname"))).alias("discordant"), F.count_if(FLAG(1) & ~FLAG(4) & ~other & (F.abs("tlen") > far)).alias("distant"))


def ambiguity(a: DataFrame) -> DataFrame:
    """(rname, unique, ambiguous): reads by reference, ambiguous where their name has several mappings."""
    g = a.where(~FLAG(4)).groupBy("qname", "rname").agg(F.count("*").alias("c"))
    n = g.groupBy("qname").agg(F.sum("c").alias("n"))
    g = g.join(n, "qname").groupBy("rname")
    return g.agg(F.coalesce(F.sum(F.when(F.col("n") == 1, F.col("c"))), F.lit(0)).alias("unique"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("c"))), F.lit(0)).alias("ambiguous"))


def best_mapping(a: DataFrame, filters: DataFrame) -> DataFrame:
    """``a`` with ``keep``: false where a competing mapping of the same name has a higher quality, or the same with fewer mismatches."""
    best = filters.groupBy("qname").agg(F.max(F.struct("mapq", -F.coalesce("nm", F.lit(0)))).alias("b"))
    own = F.struct("mapq", -F.coalesce("nm", F.lit(0)))
    return a.join(best, "qname", "left").withColumn("keep", F.col("b").isNull() | (own >= F.col("b"))).drop("b")


def mates(a: DataFrame) -> DataFrame:
    """Reads and mates by name: (name, r1, r2, n) with seq and qual turned to their sequenced direction."""
    turn = lambda c, f: F.when(FLAG(16), f).otherwise(c)
    read = F.struct(turn(F.col("seq"), S.revcomp(F.col("seq"))).alias("seq"), turn(F.col("qual"), F.reverse("qual")).alias("qual"))
    d = a.where(~FLAG(256)).withColumn("name", S.read_name(F.col("qname"), 0))
    return d.groupBy("name").agg(F.min(F.when(~FLAG(128), read)).alias("r1"), F.min(F.when(FLAG(128), read)).alias("r2"), F.count("*").alias("n"))


def nearest_mates(a: DataFrame, insert: float) -> DataFrame:
    """(qname, rname, p1, p2, off): first and second reads' mappings on one reference paired nearest to the usual insert, each used once.

    The nearest pair of a name is taken, then the nearest of what it leaves, and so on: in each
    round a pair is taken that is the nearest for both of its mappings. A name has few mappings, so
    its pairs are made in its own row.
    """

    def pick(ones: pd.Series, twos: pd.Series) -> pd.Series:
        out = []
        for x, y in zip(ones, twos):
            ranked = sorted((abs(abs(q - p) - insert), p, q, i, j) for i, p in enumerate(x) for j, q in enumerate(y))
            used, found = (set(), set()), []
            for off, p, q, i, j in ranked:
                if i not in used[0] and j not in used[1]:
                    used[0].add(i), used[1].add(j)
                    found.append({"p1": int(p), "p2": int(q), "off": float(off)})
            out.append(found)
        return pd.Series(out)

    side = lambda bit: F.sort_array(F.collect_list(F.when(FLAG(bit), F.col("pos"))))
    g = a.groupBy("qname", "rname").agg(side(64).alias("x"), side(128).alias("y")).where("size(x) > 0 and size(y) > 0")
    kernel = F.pandas_udf(pick, "array<struct<p1: int, p2: int, off: double>>")
    return g.select("qname", "rname", F.inline(kernel("x", "y")))


def expand_alternatives(a: DataFrame) -> DataFrame:
    """A row for every alternative of ``xa``, with flag, strand, sequence and CIGAR turned to it."""
    d = a.withColumn("x", F.explode(C.alternatives(F.col("xa"))))
    flip = FLAG(16) != F.col("x.reverse")
    flag = F.when(F.col("x.reverse"), F.col("flag").bitwiseOR(F.lit(16))).otherwise(F.col("flag").bitwiseAND(F.lit(~16))).bitwiseOR(F.lit(256))
    new = d.select(*[c for c in a.columns if c not in ("flag", "rname", "pos", "cigar", "nm", "seq", "qual", "xa")], flag.alias("flag"), F.col("x.rname").alias("rname"), F.col("x.pos").alias("pos"), F.col("x.cigar").alias("cigar"), F.col("x.nm").alias("nm"), F.when(flip, S.revcomp(F.col("seq"))).otherwise(F.col("seq")).alias("seq"), F.when(flip, F.reverse("qual")).otherwise(F.col("qual")).alias("qual"))
    return new


def flagstat(a: DataFrame) -> DataFrame:
    names = {"total": F.lit(True), "secondary": FLAG(256), "duplicates": FLAG(1024), "mapped": ~FLAG(4), "paired": FLAG(1), "read1": FLAG(64), "read2": FLAG(128), "proper": FLAG(2) & ~FLAG(4), "singletons": FLAG(8) & ~FLAG(4) & FLAG(1)}
    return a.agg(*[F.count_if(c).alias(n) for n, c in names.items()])


def _shown(a: DataFrame, deletions: bool) -> DataFrame:
    """Every base that a mapped read shows: its columns, at (the position), base, q, run (of its operation), k (in that), then (the next operation), span, deleted, and order among reads.

    CIGARs are walked once a read.
    """
    ops = C.operations(F.col("cigar"))
    consumes = lambda x, kinds: F.when(F.lit(kinds).contains(x["op"]), x["len"]).otherwise(0)
    step = lambda s, x: F.struct(
        (s["r"] + consumes(x, "MDN=X")).alias("r"), (s["q"] + consumes(x, "MIS=X")).alias("q"),
        F.concat(s["out"], F.array(F.struct(s["r"].alias("r"), s["q"].alias("q"), x["len"].alias("len"), x["op"].alias("op")))).alias("out"),
    )
    zero = F.struct(F.lit(0).alias("r"), F.lit(0).alias("q"), F.array().cast("array<struct<r:int,q:int,len:int,op:string>>").alias("out"))
    d = a.where(~FLAG(4) & (F.col("pos") > 0)).withColumn("ops", F.aggregate(ops, zero, step, lambda s: s["out"])).withColumn("span", C.reference_span(F.col("cigar")))
    d = d.select("*", F.posexplode("ops").alias("i", "run")).where(F.col("run.op").isin(["M", "=", "X", "D"] if deletions else ["M", "=", "X"]) & (F.col("run.len") > 0))
    d = d.withColumn("then", F.get("ops", F.col("i") + 1)).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("run.len") - 1)))
    deleted = F.col("run.op") == "D"
    at = F.when(deleted, F.col("run.q") + 1).otherwise(F.col("run.q") + F.col("k") + 1)
    base = F.substr(F.col("seq"), at, F.lit(1))
    return d.select("*", (F.col("pos") + F.col("run.r") + F.col("k")).alias("at"), base.alias("base"), F.substr(F.col("qual"), at, F.lit(1)).alias("q"), F.struct("pos", "qname", "flag", F.xxhash64("seq", "qual", "cigar")).alias("order"), deleted.alias("deleted"))


def base_sums(a: DataFrame) -> DataFrame:
    """(rname, pos, base, n, reverse, qual) from alignments: sums by base, which no depth makes long, where ``pileup`` has a string for each position."""
    p = _shown(a, False)
    return p.groupBy("rname", "at", F.upper("base").alias("base")).agg(F.count("*").alias("n"), F.count_if(FLAG(16)).alias("reverse"), F.sum(F.ascii("q") - 33).alias("qual")).withColumnRenamed("at", "pos")


def pileup(a: DataFrame, marks: bool = False, reference: DataFrame | None = None) -> DataFrame:
    """(rname, pos, depth, bases, quals) from alignments: matched bases, lower case on the reverse strand, in order of the reads' starts.

    With ``marks`` the bases are those of a pileup file: ``^`` and a mapping quality at a read's
    first base, ``$`` after its last, ``*`` where bases are deleted, ``+`` and ``-`` with
    length and sequence (N where it is not known) after the base before. With ``reference`` (rname, pos, ref)
    bases that agree are ``.`` and ``,``, and the rows have ref.
    (rname, pos) is the shuffle key, so a contig is not one task.
    """
    d = _shown(a, marks)
    strand = lambda c: F.when(FLAG(16), F.lower(c)).otherwise(F.upper(c))
    shown = strand(F.col("base"))
    if reference is not None:
        d = d.join(reference.select("rname", F.col("pos").alias("at"), "ref"), ["rname", "at"], "left")
        shown = F.when(F.upper("base") == F.upper("ref"), F.when(FLAG(16), ",").otherwise(".")).otherwise(shown)
    if marks:
        place = F.col("run.r") + F.col("k")
        last = F.col("k") == F.col("run.len") - 1
        grown = F.concat(F.lit("+"), F.col("then.len").cast("string"), strand(F.substr(F.col("seq"), F.col("then.q") + 1, F.col("then.len"))))
        lost = F.concat(F.lit("-"), F.col("then.len").cast("string"), strand(F.repeat(F.lit("N"), F.col("then.len"))))
        after = F.when(last & (F.col("then.op") == "I"), grown).when(last & (F.col("then.op") == "D"), lost).otherwise("")
        first = F.when(place == 0, F.concat(F.lit("^"), F.char(F.least("mapq", F.lit(93)) + 33))).otherwise("")
        shown = F.concat(first, F.when(F.col("deleted"), "*").otherwise(shown), after, F.when(place == F.col("span") - 1, "$").otherwise(""))
    key = ["rname", "at"] + (["ref"] if reference is not None else [])
    g = d.select(*key, "order", shown.alias("b"), "q").groupBy(*key).agg(F.sort_array(F.collect_list(F.struct("order", "b", "q"))).alias("x"))
    return g.select("rname", F.col("at").alias("pos"), *key[2:], F.size("x").alias("depth"), F.array_join(F.transform("x", lambda y: y["b"]), "").alias("bases"), F.array_join(F.transform("x", lambda y: y["q"]), "").alias("quals"))


def index_stats(a: DataFrame, contigs: DataFrame) -> DataFrame:
    """(rname, length, mapped, unmapped) of every contig (name, length), and ``*`` for reads without a place."""
    placed = F.when(F.col("rname").isNull() | (F.col("rname") == "*"), "*").otherwise(F.col("rname"))
    n = a.groupBy(placed.alias("rname")).agg(F.count_if(~FLAG(4)).alias("mapped"), F.count_if(FLAG(4)).alias("unmapped"))
    c = contigs.select(F.col("name").alias("rname"), F.col("length").cast("long").alias("length"))
    d = c.join(n, "rname", "full").where(F.col("length").isNotNull() | (F.col("rname") == "*"))
    return d.select("rname", F.coalesce("length", F.lit(0)).alias("length"), F.coalesce("mapped", F.lit(0)).alias("mapped"), F.coalesce("unmapped", F.lit(0)).alias("unmapped"))


def proper_pairs(pairs: DataFrame, contigs: DataFrame, most: int, least: int = 0) -> DataFrame:
    """Pairs (qname, rname, p1, p2, len1, len2, reverse1, reverse2) that are proper, the best of each name.

    A pair is proper where both reads lie wholly within their reference, face each other, and
    span ``least`` to ``most`` bases. Of a name's proper pairs the one with the fewest mismatches (nm) is
    kept, then the shortest span and the first place.
    """
    d = pairs.join(contigs.select(F.col("name").alias("rname"), "length"), "rname")
    end1, end2 = F.col("p1") + F.col("len1") - 1, F.col("p2") + F.col("len2") - 1
    inside = (F.least("p1", "p2") >= 1) & (F.greatest(end1, end2) <= F.col("length"))
    facing = F.when(F.col("p1") <= F.col("p2"), ~F.col("reverse1") & F.col("reverse2")).otherwise(F.col("reverse1") & ~F.col("reverse2"))
    d = d.withColumn("span", F.greatest(end1, end2) - F.least("p1", "p2") + 1).where(inside & facing & F.col("span").between(least, most))
    best = d.groupBy("qname").agg(F.min(F.struct("nm", "span", "rname", "p1", "p2")).alias("_b"))
    return d.withColumn("_b", F.struct("nm", "span", "rname", "p1", "p2")).join(best, ["qname", "_b"], "left_semi").drop("_b", "length")


def merged(*files: DataFrame) -> DataFrame:
    """Alignments of several files in order of place."""
    from functools import reduce

    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), files).orderBy("rname", "pos", "qname")


def by_natural_name(a: DataFrame) -> DataFrame:
    """Alignments in order of names as numbers and text: r2 before r10. Runs of digits are compared by value."""
    part = F.regexp_extract_all("qname", F.lit(r"(\d+|\D+)"), F.lit(1))
    key = F.transform(part, lambda x: F.when(x.rlike(r"^\d+$"), F.lpad(F.regexp_replace(x, "^0+(?=.)", ""), 24, "0")).otherwise(x))
    return a.orderBy(key, "flag")
