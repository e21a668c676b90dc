"""Bounded, repeatable samples of labelled rows for fitting a classifier."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def labelled_sample(rows: DataFrame, label: str, per_label: int) -> DataFrame:
    """About ``per_label`` rows of each label (all of a rarer one), chosen by a hash of doc_id.

    The number of labels is taken to be small (languages, classes): their counts come to the driver.
    """
    counts = {r[0]: r[1] for r in rows.groupBy(label).count().collect()}
    keep = F.lit(False)
    spread = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("sample")), F.lit(1 << 30))
    for value, n in sorted(counts.items(), key=lambda x: str(x[0])):
        keep = keep | ((F.col(label) == F.lit(value)) & (spread < int(min(1.0, per_label / n) * (1 << 30))))
    return rows.where(keep) if counts else rows.limit(0)
