"""The helpers as SQL functions of a session: expressions and tables that Catalyst writes into the query."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name(arguments): what it returns, and the expression or query.
FUNCTIONS = {
    "revcomp(s string)": ("string", "reverse(translate(s, 'ACGTacgt', 'TGCAtgca'))"),
    "hamming(a string, b string)": ("int", "aggregate(sequence(1, greatest(length(a), length(b), 1)), 0, (n, i) -> n + cast(substring(a, i, 1) <> substring(b, i, 1) as int))"),
    "mean_phred(q string)": ("double", "aggregate(sequence(1, greatest(length(q), 1)), 0D, (n, i) -> n + ascii(substring(q, i, 1)) - 33) / nullif(length(q), 0)"),
    "poisson_pmf(k int, mu double)": ("double", "if(k < 0, 0D, exp(-mu + k * ln(mu) - aggregate(sequence(1, greatest(k, 1)), 0D, (n, i) -> n + ln(i))))"),
    "gc_percent(s string)": ("double", "100D * length(regexp_replace(upper(s), '[^GC]', '')) / nullif(length(s), 0)"),
    "kmers(s string, k int)": ("table (at int, kmer string)", "select i, substring(s, i, k) from explode(sequence(1, greatest(length(s) - k + 1, 1))) t(i) where length(s) >= k"),
    "fragments_of(beg bigint, en bigint, width bigint)": ("table (bin bigint, lo bigint, hi bigint)", "select b, greatest(beg, b * width), least(en, b * width + width - 1) from explode(sequence(beg div width, en div width)) t(b)"),
    "parts_at(s string, adapter string, shortest int)": ("table (part int, piece string)", "select i, p from posexplode(filter(split(s, adapter), x -> length(x) >= shortest)) t(i, p)"),
}


def register(spark: SparkSession) -> None:
    """Makes FUNCTIONS temporary functions of the session; doing so again changes nothing."""
    for name, (kind, body) in FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {name} returns {kind} return {body}")
