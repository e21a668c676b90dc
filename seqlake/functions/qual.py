"""Quality strings: offset 33 or 64, decoded lazily."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from seqlake.functions.seq import upto


def scores(qual: Column, phred: int = 33) -> Column:
    return F.transform(upto(F.length(qual)), lambda i: F.ascii(F.substr(qual, i, F.lit(1))) - phred)


def total(qual: Column, phred: int = 33) -> Column:
    return F.aggregate(scores(qual, phred), F.lit(0), lambda a, x: a + x)


def mean(qual: Column, phred: int = 33) -> Column:
    return F.try_divide(total(qual, phred).cast("double"), F.length(qual).cast("double"))


def window_mean(q: Column, i: Column, width: int) -> Column:
    """Integer mean of the scores around index i (from 0); a window over a quarter of the read shrinks to that."""
    n = F.size(q)
    w = F.when(F.lit(width) > n / 4, F.floor(n / 4).cast("int")).otherwise(F.lit(width))
    lo, hi = F.greatest(i - F.floor(w / 2).cast("int"), F.lit(0)), F.least(i + F.floor(w / 2).cast("int"), n - 1)
    return F.floor(F.aggregate(F.slice(q, lo + 1, hi - lo + 1), F.lit(0), lambda a, x: a + x) / (hi - lo + 1))


def trims(qual: Column, least: int, phred: int = 33, width: int = 1) -> Column:
    """(start, end): bases below ``least`` at both ends; the end stops at what the start took.

    The ends stand for the first and the last base that is good: one pass each, no loop.
    """
    q = scores(qual, phred)
    bad = lambda x, i: (window_mean(q, i, width) < least) | (x < least) if width > 1 else x < least
    good = F.transform(q, lambda x, i: ~bad(x, i))
    n = F.size(q)
    at = F.array_position(good, F.lit(True)).cast("int")
    first = F.when(at > 0, at - 1).otherwise(n)
    last = F.when(at > 0, F.array_position(F.reverse(good), F.lit(True)).cast("int") - 1).otherwise(F.lit(0))
    return F.struct(first.alias("start"), last.alias("end"))


def adjust(qual: Column, add: int = 0, most: int | None = None, phred: int = 33, by_cycle: dict[int, int] | None = None) -> Column:
    """Scores shifted, by cycle too (negative: from the end), and capped; as a quality string."""
    q = scores(qual, phred)

    def one(x, i):
        for cycle, d in (by_cycle or {}).items():
            x = x + F.when(i == (cycle - 1 if cycle > 0 else F.length(qual) + cycle), d).otherwise(0)
        x = F.greatest(x + add, F.lit(0))
        return F.least(x, F.lit(most)) if most is not None else x

    return F.array_join(F.transform(q, lambda x, i: F.char(one(x, i) + phred)), "")


def masked(seq: Column, qual: Column, least: int, phred: int = 33) -> Column:
    """Bases of a score below ``least`` become N."""
    return F.array_join(F.transform(scores(qual, phred), lambda x, i: F.when(x < least, "N").otherwise(F.substr(seq, i + 1, F.lit(1)))), "")


def to_probability(q: Column) -> Column:
    return F.pow(F.lit(10.0), -q / 10)


def to_phred(p: Column) -> Column:
    return -10 * F.log10(p)


def rms(sum_of_squares: Column, depth: Column) -> Column:
    """Integer root of the integer mean of squares."""
    return F.floor(F.sqrt(F.floor(sum_of_squares / depth))).cast("int")
