"""CIGAR strings and alternative alignments."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def operations(cigar: Column) -> Column:
    """Array of (len, op)."""
    return F.transform(F.regexp_extract_all(cigar, F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.regexp_extract(x, r"^\d+", 0).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def total(cigar: Column, ops: str) -> Column:
    """Sum of the lengths of the named operations."""
    return F.aggregate(F.filter(operations(cigar), lambda x: F.lit(ops).contains(x["op"])), F.lit(0), lambda a, x: a + x["len"])


def reference_span(cigar: Column) -> Column:
    return total(cigar, "MDN=X")


def query_length(cigar: Column) -> Column:
    return total(cigar, "MIS=X")


def plain(cigar: Column) -> Column:
    """Insertions and clips as matches, deletions left out, all matches as one run."""
    n = total(cigar, "MIS=X")
    return F.when(n > 0, F.concat(n.cast("string"), F.lit("M"))).otherwise(F.lit("*"))


def alternatives(xa: Column) -> Column:
    """``chr,+pos,cigar,nm;`` as an array of (rname, pos, reverse, cigar, nm)."""
    part = F.filter(F.split(xa, ";"), lambda x: x != "")

    def one(x):
        f = F.split(x, ",")
        pos = F.get(f, 1)
        return F.struct(F.get(f, 0).alias("rname"), F.abs(pos.cast("int")).alias("pos"), pos.startswith("-").alias("reverse"), F.get(f, 2).alias("cigar"), F.get(f, 3).cast("int").alias("nm"))

    return F.transform(part, one)
