"""Local alignment of short sequences, and splitting of long reads at adapter copies."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F


def smith_waterman(a: str, b: str, match: int = 3, mismatch: int = -3, gap: int = -2) -> tuple[int, int, int, int, int]:
    """(score, begin and end in a, begin and end in b), ends exclusive; rows are computed with numpy, gaps by a running maximum."""
    if not a or not b:
        return 0, 0, 0, 0, 0
    x, y = np.frombuffer(a.encode(), np.uint8), np.frombuffer(b.encode(), np.uint8)
    h = np.zeros((len(x) + 1, len(y) + 1), np.int64)
    step = np.arange(len(y) + 1) * gap
    for i in range(1, len(x) + 1):
        row = np.maximum(0, np.maximum(h[i - 1, :-1] + np.where(y == x[i - 1], match, mismatch), h[i - 1, 1:] + gap))
        row = np.concatenate(([0], row))
        h[i] = np.maximum(row, np.maximum.accumulate(row - step) + step)
    i, j = np.unravel_index(int(h.argmax()), h.shape)
    score, ei, ej = int(h[i, j]), int(i), int(j)
    while i and j and h[i, j] > 0:
        if h[i, j] == h[i - 1, j - 1] + (match if x[i - 1] == y[j - 1] else mismatch):
            i, j = i - 1, j - 1
        elif h[i, j] == h[i - 1, j] + gap:
            i -= 1
        else:
            j -= 1
    return score, int(i), ei, int(j), ej


def _padded(texts: list[str], fill: int) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    n = np.array([len(r) for r in raw], np.int64)
    grid = np.full((len(raw), int(n.max(initial=0))), fill, np.uint8)
    grid[np.arange(grid.shape[1]) < n[:, None]] = np.frombuffer(b"".join(raw), np.uint8)
    return grid, n


def align_batch(a: list[str], b: list[str], match: int = 3, mismatch: int = -3, gap: int = -2) -> np.ndarray:
    """``smith_waterman`` of many pairs, a row each: all pairs advance along their first sequences together.

    Each cell carries where its path began, so nothing is traced back and only one row of each matrix is kept.
    """
    x, lx = _padded(a, 0)
    y, ly = _padded(b, 1)
    n, width = len(a), y.shape[1] + 1
    cols = np.arange(width)
    step, beyond = cols * gap, cols[None, 1:] > ly[:, None]
    h, origin = np.zeros((n, width), np.int64), np.broadcast_to(cols, (n, width)).copy()
    out = np.zeros((n, 5), np.int64)
    for i in range(1, x.shape[1] + 1):
        own = i * width + cols
        diagonal = h[:, :-1] + np.where(y == x[:, i - 1 : i], match, mismatch)
        down = h[:, 1:] + gap
        row, start = np.zeros((n, width), np.int64), np.broadcast_to(own, (n, width)).copy()
        row[:, 1:] = np.where(beyond, 0, np.maximum(0, np.maximum(diagonal, down)))
        start[:, 1:] = np.where(row[:, 1:] == 0, own[1:], np.where(diagonal >= down, origin[:, :-1], origin[:, 1:]))
        reach = np.maximum.accumulate(row - step, axis=1)
        source = np.maximum.accumulate(np.where(row - step == reach, cols, 0), axis=1)
        across = (reach + step > row) & np.concatenate((np.zeros((n, 1), bool), ~beyond), 1)
        start = np.where(across, np.take_along_axis(start, source, 1), start)
        h, origin = np.where(across, reach + step, row), start
        at = h.argmax(1)
        top = h[np.arange(n), at]
        win = (lx >= i) & (top > out[:, 0])
        first = origin[np.arange(n), at]
        out[win] = np.stack((top, first // width, np.full(n, i), first % width, at), 1)[win]
    return out


def align(a: Column, b: Column) -> Column:
    """(score, a_begin, a_end, b_begin, b_end) of two columns, a batch at a time."""

    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(align_batch(x.fillna("").tolist(), y.fillna("").tolist()), columns=["score", "a_begin", "a_end", "b_begin", "b_end"])

    return F.pandas_udf(run, "score int, a_begin int, a_end int, b_begin int, b_end int")(a, b)


def cut_points(reads: list[str], adapter: str, share: float = 1.8) -> list[list[tuple[int, int]]]:
    """Of each read the stretches that align with the adapter at a score of at least ``share`` of its length, without overlap.

    The best of every read is found and struck out, and reads that had one are gone over again.
    """
    found: list[list] = [[] for _ in reads]
    todo, texts = list(range(len(reads))), list(reads)
    while todo:
        best = align_batch([texts[i] for i in todo], [adapter] * len(todo))
        again = []
        for i, (score, lo, hi, _, _) in zip(todo, best.tolist()):
            if score >= share * len(adapter) and hi > lo:
                found[i].append((lo, hi))
                texts[i] = texts[i][:lo] + "." * (hi - lo) + texts[i][hi:]
                again.append(i)
        todo = again
    return [sorted(f) for f in found]


def split_reads(df: DataFrame, adapter: str, least: int = 50) -> DataFrame:
    """Reads (rec_no, seq, qual) cut at adapter copies: rec_no, part, seq, qual of parts of at least ``least`` bases."""

    def run(seq: pd.Series) -> pd.Series:
        texts, out = seq.fillna("").tolist(), []
        for s, cuts in zip(texts, cut_points(texts, adapter)):
            at, parts = 0, []
            for lo, hi in [*cuts, (len(s), len(s))]:
                if lo - at >= least:
                    parts.append({"begin": at, "len": lo - at})
                at = hi
            out.append(parts)
        return pd.Series(out)

    d = df.select("*", F.posexplode(F.pandas_udf(run, "array<struct<begin: int, len: int>>")("seq")).alias("part", "p"))
    return d.select("rec_no", "part", *[F.substr(F.col(c), F.col("p.begin") + 1, F.col("p.len")).alias(c) for c in ("seq", "qual")])


def part_summary(parts: DataFrame) -> DataFrame:
    """One row over parts of split reads (rec_no, part, seq): reads, parts, lengths, and quartiles of the parts of a read."""
    per = parts.groupBy("rec_no").agg(F.count("*").alias("n"), F.sum(F.length("seq")).alias("bases"), F.min(F.length("seq")).alias("short"), F.max(F.length("seq")).alias("long"))
    q = F.percentile("n", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    return per.agg(F.count("*").alias("reads"), F.sum("n").alias("parts"), F.sum("bases").alias("bases"), F.min("short").alias("len_min"), F.max("long").alias("len_max"), F.get(q, 0).alias("q1"), F.get(q, 1).alias("median"), F.get(q, 2).alias("q3"))
