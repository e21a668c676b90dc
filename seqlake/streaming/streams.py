"""The transforms on unbounded reads. Stateless ones (trims, filters, clips, assignments) are those of ``operators``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType


def read_stream(spark: SparkSession, path: str, schema: str | StructType, files_per_batch: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def first_seen(df: DataFrame, first: int, time: str, horizon: str) -> DataFrame:
    """Reads whose first bases have not been seen within the horizon; later copies can differ from the batch result."""
    return df.withColumn("_k", F.substring("seq", 1, first)).withWatermark(time, horizon).dropDuplicatesWithinWatermark(["_k"]).drop("_k")


def running_counts(df: DataFrame, key: str) -> DataFrame:
    """Counts by key, for complete or update mode."""
    return df.groupBy(key).agg(F.count("*").alias("n"))


def merged(*streams: DataFrame) -> DataFrame:
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out


def running_moments(df: DataFrame) -> DataFrame:
    """By file: n, mean and deviation of all reads' mean qualities so far (columns file, mean_quality), kept as state."""
    import pandas as pd

    def step(key, frames, state):
        n, s, ss = state.get if state.exists else (0, 0.0, 0.0)
        for f in frames:
            v = f["mean_quality"].dropna()
            n, s, ss = n + len(v), s + float(v.sum()), ss + float((v * v).sum())
        state.update((n, s, ss))
        mean = s / n if n else 0.0
        yield pd.DataFrame({"file": [key[0]], "n": [n], "mean": [mean], "sd": [max(0.0, (ss - n * mean * mean) / (n - 1)) ** 0.5 if n > 1 else 0.0]})

    return df.groupBy("file").applyInPandasWithState(step, "file string, n long, mean double, sd double", "n long, s double, ss double", "update", "NoTimeout")


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """Events (ts, event_type, value) by window and type: count and sum. Beyond what the batch operators offer."""
    d = events.withWatermark("ts", late) if late else events
    return d.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
