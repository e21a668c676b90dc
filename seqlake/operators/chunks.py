"""Order-dependent computations along a sequence, in chunks of positions: no task holds a whole contig.

What a chunk needs from those before it is a few values, kept in a table of a row a chunk.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

#: Positions of a chunk.
WIDTH = 1 << 20


def chunk_of(at: str, width: int = WIDTH) -> Column:
    return F.floor(F.col(at) / width).cast("long")


def haloed(df: DataFrame, at: str, halo: int, width: int = WIDTH) -> DataFrame:
    """Rows with _chunk and _own: each in its chunk, and, not its own, in all others that it is within ``halo`` of."""
    near = F.sequence(F.floor((F.col(at) - halo) / width).cast("long"), F.floor((F.col(at) + halo) / width).cast("long"))
    return df.withColumn("_chunk", F.explode(near)).withColumn("_own", F.col("_chunk") == chunk_of(at, width))


def running_sum(df: DataFrame, part: str, at: str, *values: str, width: int = WIDTH) -> DataFrame:
    """``df`` (one row for each part and position) with the running sum of each value, <value>_sum, and next, the position that follows."""
    d = df.withColumn("_chunk", chunk_of(at, width))
    w = Window.partitionBy(part, "_chunk").orderBy(at)
    c = d.groupBy(part, "_chunk").agg(*[F.sum(v).alias(f"_{v}_s") for v in values], F.min(at).alias("_first"))
    along = Window.partitionBy(part).orderBy("_chunk")
    before = [F.coalesce(F.sum(f"_{v}_s").over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(f"_{v}_before") for v in values]
    c = c.select(part, "_chunk", *before, F.lead("_first").over(along).alias("_then"))
    d = d.withColumns({f"{v}_sum": F.sum(v).over(w) for v in values}).withColumn("_next", F.lead(at).over(w)).join(c, [part, "_chunk"])
    d = d.withColumns({f"{v}_sum": F.coalesce(f"{v}_sum", F.lit(0)) + F.col(f"_{v}_before") for v in values}).withColumn("next", F.coalesce("_next", "_then"))
    return d.drop("_chunk", "_next", "_then", *[f"_{v}_before" for v in values])


def runs(df: DataFrame, part: str, at: str, value: str, width: int = WIDTH) -> DataFrame:
    """``df`` (one row for each part and position) with run: the length of the stretch of adjacent positions of equal value that holds it."""
    d = df.withColumn("_chunk", chunk_of(at, width))
    w = Window.partitionBy(part, "_chunk").orderBy(at)
    edge = F.struct(F.col(at).alias("at"), F.col(value).alias("value"))
    follows = lambda a, b: (a["at"] + 1 == b["at"]) & a["value"].eqNullSafe(b["value"])
    d = d.withColumn("_e", edge).withColumn("_l", F.lag("_e").over(w))
    d = d.withColumn("_new", F.when(F.col("_l").isNotNull(), (~follows(F.col("_l"), F.col("_e"))).cast("int")))  # null: the chunk's first
    c = d.groupBy(part, "_chunk").agg(F.coalesce(F.sum("_new"), F.lit(0)).alias("_n"), F.min("_e").alias("_first"), F.max("_e").alias("_last"))
    along = Window.partitionBy(part).orderBy("_chunk")
    c = c.withColumn("_l", F.lag("_last").over(along)).withColumn("_open", F.when(F.col("_l").isNotNull() & follows(F.col("_l"), F.col("_first")), 0).otherwise(1))
    c = c.select(part, "_chunk", "_open", F.coalesce(F.sum(F.col("_n") + F.col("_open")).over(along.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    d = d.drop("_e", "_l").join(c, [part, "_chunk"]).withColumn("_new", F.coalesce("_new", "_open"))
    d = d.withColumn("_run", F.sum("_new").over(w) + F.col("_before"))
    return d.withColumn("run", F.count("*").over(Window.partitionBy(part, "_run"))).drop("_chunk", "_new", "_open", "_before", "_run")
