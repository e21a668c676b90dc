"""Connected components by alternating large-star and small-star (Kiveris et al., 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqlake.llm.shared import table


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges (u, v), u > v.

    The minima are written as a table, so that both sides of the join come straight from an
    exchange and a vertex with very many neighbours is split by the skew join of adaptive execution.
    """
    around = edges.union(edges.select("v", "u").toDF("u", "v")) if large else edges
    least = table(around.groupBy("u").agg(F.min("v").alias("m")), "star").withColumn("m", F.least("m", "u"))
    joined = around.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", "m").toDF("u", "v"))
    return out.where("u > v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every vertex of the undirected edges (a, b): component is the smallest id reachable.

    Loops, repeated edges and nulls are ignored. Each half round is a table in the shared
    folder; the rounds end when one leaves the edges as they were (their count and the sum
    of their hashes), which takes about log2 of the largest component's size.
    """
    mark = F.struct(F.count("*").alias("n"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0)).alias("h"))
    e = table(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u > v").distinct(), "edges")
    before = None
    while True:
        e = table(_star(table(_star(e, True), "large"), False), "small")
        now = e.agg(mark.alias("m")).first()["m"]
        if now["n"] == 0 or now == before:
            break
        before = now
    return e.select(F.col("u").alias("id"), F.col("v").alias("component")).union(e.select("v", "v").distinct())
