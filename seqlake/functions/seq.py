"""Sequence expressions: everything is a Column of built-in functions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def bases(seq: Column) -> Column:
    """The bases of a read, one string each."""
    return F.filter(F.split(seq, ""), lambda x: x != "")


def upto(n: Column | int, start: int = 1) -> Column:
    """start .. n, or nothing if n is less."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n >= start, F.sequence(F.lit(start), n)).otherwise(F.array().cast("array<int>"))


def count_where(items: Column, test) -> Column:
    return F.aggregate(items, F.lit(0), lambda a, i: a + test(i).cast("int"))


def hamming(a: Column, b: Column, n: Column | int) -> Column:
    """Differing characters over the first n; past the end of either string all are different."""
    n = F.lit(n) if isinstance(n, int) else n
    both = F.least(F.length(a), F.length(b), n)
    return count_where(upto(both), lambda i: F.substr(a, i, F.lit(1)) != F.substr(b, i, F.lit(1))) + (n - both)


def revcomp(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGTacgt", "TGCAtgca"))


def base_index(base: Column) -> Column:
    """A, C, G, T as 0..3, all else 4."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in zip("ACGT", range(4)) for x in p]), F.upper(base)), F.lit(4))


def n_run_start(seq: Column) -> Column:
    return F.length(F.regexp_extract(seq, "^N*", 0))


def n_run_end(seq: Column) -> Column:
    return F.length(F.regexp_extract(seq, "N*$", 0))


def homopolymer_score(seq: Column) -> Column:
    """Positions that equal the one before; N equals all."""
    at = lambda i: F.substr(seq, i, F.lit(1))
    return count_where(upto(F.length(seq), 2), lambda i: (at(i) == "N") | (at(i) == at(i - 1)))


def low_complexity_score(seq: Column) -> Column:
    """Positions that continue a repeat of period 1, 2, 3 or 4; N continues all."""
    at = lambda i, n: F.substr(seq, i, F.lit(n))
    repeat = lambda i, p: (i > 2 * p - 1) & (at(i - p + 1, p) == at(i - 2 * p + 1, p))
    return count_where(upto(F.length(seq), 2), lambda i: (at(i, 1) == "N") | repeat(i, 1) | repeat(i, 2) | repeat(i, 3) | repeat(i, 4))


def gc_percent(seq: Column, first: int = 100) -> Column:
    """Share of G and C among the first bases, in percent."""
    part = F.substring(seq, 1, first)
    return F.try_divide(F.lit(100.0) * F.length(F.regexp_replace(F.upper(part), "[^GC]", "")), F.length(part).cast("double"))


def kmers(seq: Column, k: int) -> Column:
    """All runs of k bases, in order."""
    return F.transform(upto(F.length(seq) - (k - 1)), lambda i: F.substr(seq, i, F.lit(k)))


def pack2(kmer: Column) -> Column:
    """A k-mer of ACGT with two bits a base, as a number (k up to 16)."""
    return F.conv(F.translate(kmer, "ACGT", "0123"), 4, 10).cast("long")


def read_name(name: Column, parts: int = 2) -> Column:
    """Without what follows a space, and without the first ``parts`` colon-separated fields (instrument, run)."""
    short = F.substring_index(name, " ", 1)
    return F.when(F.size(F.split(short, ":")) > parts, F.array_join(F.slice(F.split(short, ":"), parts + 1, 1 << 20), ":")).otherwise(short)


def header_barcode(name: Column) -> Column:
    """What follows the last colon after the first space."""
    return F.regexp_extract(name, " .*:([^:]*)$", 1)


def header_barcodes(name: Column) -> Column:
    """(bc, bc2, qual, qual2) of a read name: its barcode, of two joined by + both, with made-up qualities."""
    b = F.split(header_barcode(name), r"\+")
    one, two = F.get(b, 0), F.get(b, 1)
    return F.struct(one.alias("bc"), two.alias("bc2"), F.repeat(F.lit("h"), F.length(one)).alias("qual"), F.repeat(F.lit("h"), F.length(two)).alias("qual2"))


def unpack2(code: Column, k: int) -> Column:
    """The k-mer that ``pack2`` gave a number."""
    return F.translate(F.lpad(F.conv(code.cast("string"), 10, 4), k, "0"), "0123", "ACGT")


def pack2_revcomp(code: Column, k: int) -> Column:
    """The packed number of the reverse complement of a packed k-mer."""
    return pack2(revcomp(unpack2(code, k)))


def instrument_name(machine: Column, run: Column, lane: Column, tile: Column, x: Column, y: Column, mate: Column, passed: Column) -> Column:
    """A read name of the fields that a sequencer gives: machine:run:lane:tile:x:y mate:filter."""
    return F.concat(F.lit("@"), F.concat_ws(":", machine, run, lane, tile, x, y), F.lit(" "), mate.cast("string"), F.lit(":"), F.when(passed, "N").otherwise("Y"))


def replace_field(row: Column, n: int, value: Column, sep: str = "\t") -> Column:
    """The n-th (from 1) field of a delimited row replaced."""
    return F.array_join(F.transform(F.split(row, sep), lambda x, i: F.when(i == n - 1, value).otherwise(x)), sep)


def strip_chr(name: Column) -> Column:
    return F.regexp_replace(name, "(?i)^chr", "")


def genotype_distance(found: Column, het: Column, indel: Column) -> Column:
    """0 absent, 1 heterozygous, 2 homozygous, 3 insertion or deletion."""
    return F.when(~F.coalesce(found, F.lit(False)), 0).when(indel, 3).when(het, 1).otherwise(2)
