"""Writers of sequence files and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def fastq_text(df: DataFrame) -> DataFrame:
    com = F.col("com") if "com" in df.columns else F.lit("+")
    return df.select(F.concat_ws("\n", "id", "seq", com, "qual").alias("value"))


def write_fastq(df: DataFrame, path: str, ordered: bool = True, gzip: bool = False) -> None:
    """Records as text, in order of rec_no if wanted."""
    d = df.orderBy("rec_no") if ordered and "rec_no" in df.columns else df
    fastq_text(d).write.text(path, compression="gzip" if gzip else None)


def write_by(df: DataFrame, path: str, column: str) -> None:
    """Records in a folder for each value of a column (a barcode, an outcome); unmatched ones under their own name."""
    d = df.withColumn(column, F.coalesce(F.col(column).cast("string"), F.lit("unmatched")))
    d.select(column, F.concat_ws("\n", "id", "seq", F.lit("+"), "qual").alias("value")).write.partitionBy(column).text(path)


def fasta_text(df: DataFrame) -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.expr("substring(id, 2)"), F.lit("\n"), "seq").alias("value"))


def interleaved(a: DataFrame, b: DataFrame, most: int | None = None) -> DataFrame:
    """Records of two files in turn, at most ``most`` of each."""
    d = a.withColumn("mate", F.lit(1)).unionByName(b.withColumn("mate", F.lit(2)))
    return (d.where(F.col("rec_no") < most) if most is not None else d).orderBy("rec_no", "mate")


def report(row: DataFrame) -> DataFrame:
    """A row of statistics as (metric, value)."""
    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for c in row.columns])
    return row.select(F.inline(pairs))


def write_table(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated text; Spark's commit makes it visible at once."""
    flat = [F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes]
    df.select(*flat).write.csv(path, sep="\t", header=header, quote="")


def write_named(df: DataFrame, template: str, column: str, names: list[str]) -> dict[str, str]:
    """Records of each named value of a column under ``template`` with % replaced by the value; ``n/a`` writes none. Returns the paths by value."""
    if template == "n/a":
        return {}
    out = {v: template.replace("%", v) for v in names}
    for v, path in out.items():
        fastq_text(df.where(F.col(column) == v)).write.text(path)
    return out


def write_outcomes(df: DataFrame, column: str, outputs: dict[str, str]) -> None:
    """Records by outcome (joined, unjoined mates, ...) to an explicit list of paths; outcomes without one are not written."""
    for value, path in outputs.items():
        fastq_text(df.where(F.col(column) == value)).write.text(path)


def write_good_bad(df: DataFrame, good: str, bad: str, keep: str = "keep") -> None:
    """Alignments as two Parquet tables by a flag; a null flag is bad."""
    d = df.drop(keep)
    d.where(df[keep]).write.parquet(good)
    d.where(~F.coalesce(df[keep], F.lit(False))).write.parquet(bad)
