"""Document classes by supervised subword embeddings (Joulin et al., 2017), trained with numpy.

A word's features are itself and its character 3- to 5-grams (of UTF-8 bytes, with word ends), hashed
to BUCKETS vectors; a word equal to the one before has the feature AGAIN besides. A document is the mean of all its features' vectors; a softmax over two
classes reads it. Training is stochastic gradient descent with a falling rate.

The output is linear in the mean, so when scoring each distinct word needs only the sum of
its features' margins, which is kept for the next documents.
"""

from __future__ import annotations

import zlib
from collections import Counter
from itertools import islice
from operator import eq

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seqlake.llm.sampling import labelled_sample
from seqlake.llm.shared import ship
from seqlake.llm.words import batches, mix

BUCKETS, DIM, GRAMS = 1 << 16, 12, (3, 4, 5)
#: The bucket of a word that repeats the one before, and as how many features it counts.
AGAIN, WEIGHT_AGAIN = 0, 8
#: The bound of the training sample: rows of each class.
PER_CLASS = 800
#: Words whose margins a worker keeps.
KEPT_WORDS = 400_000


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the words and of their character n-grams, word after word, and their number by word."""
    raw = [f"<{w}>".encode("utf-8", "surrogatepass") for w in words]
    size = np.fromiter(map(len, raw), np.int64, len(raw))
    data = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    starts = np.cumsum(size) - size
    left = np.repeat(starts + size, size) - np.arange(len(data))  # bytes to the word's end
    word = np.repeat(np.arange(len(raw)), size)
    place = (np.repeat(size, size) - left).astype(np.uint64)  # in the word: what else is in the call has no part in a word's buckets
    whole = np.add.reduceat(mix(data + (place << np.uint64(8))), starts) if len(raw) else np.zeros(0, np.uint64)
    keys, owner = [mix(whole + size.astype(np.uint64))], [np.arange(len(raw))]
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        h = np.full(len(at), n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + data[at + k]
        keys.append(mix(h))
        owner.append(word[at])
    own = np.concatenate(owner)
    order = np.argsort(own, kind="stable")
    return (np.concatenate(keys)[order] >> np.uint64(64 - 16)).astype(np.int64), np.bincount(own, minlength=len(raw))


def again(words: list[str]) -> int:
    """How many words equal the one before; each has one more feature, AGAIN."""
    return sum(map(eq, words, islice(words, 1, None)))


def bags(texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of each whole text: its distinct buckets and their counts."""
    split = [(t or "").split() for t in texts]
    distinct = list({w for s in split for w in s})
    flat, n = features(distinct)
    ends = np.cumsum(n)
    at = {w: (int(e - k), int(e)) for w, e, k in zip(distinct, ends, n)}
    out = []
    for s in split:
        total = np.zeros(BUCKETS)
        if s:
            many = Counter(s)
            where = [at[w] for w in many]
            keys = np.concatenate([flat[lo:hi] for lo, hi in where])
            total = np.bincount(keys, np.repeat(list(many.values()), [hi - lo for lo, hi in where]), BUCKETS)
        total[AGAIN] += again(s) * WEIGHT_AGAIN
        keys = np.flatnonzero(total)
        out.append((keys, total[keys].astype(np.float32)))
    return out


def fit(texts: list[str | None], y: np.ndarray, epochs: int = 10, batch: int = 16, rate: float = 0.6, seed: int = 3) -> dict:
    """Embeddings, softmax weights and bias of classes 0 and 1; both classes weigh alike."""
    bag = bags(texts)
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    w, b = rng.normal(0, 0.5, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    share = np.bincount(y, minlength=2)
    weight = (len(y) / (2 * np.maximum(share, 1)))[y].astype(np.float32)
    usable = np.array([i for i, (k, _) in enumerate(bag) if len(k)])
    for epoch in range(epochs if len(usable) else 0):
        lr = rate * (1 - epoch / epochs)
        order = rng.permutation(usable)
        for lo in range(0, len(order), batch):
            rows = order[lo : lo + batch]
            keys = np.concatenate([bag[i][0] for i in rows])
            part = np.concatenate([bag[i][1] / bag[i][1].sum() for i in rows])
            sizes = np.array([len(bag[i][0]) for i in rows])
            starts = np.cumsum(sizes) - sizes
            h = np.add.reduceat(emb[keys] * part[:, None], starts)
            z = h @ w + b
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            p[np.arange(len(rows)), y[rows]] -= 1
            dz = p * weight[rows, None]
            dh = dz @ w.T
            w -= lr * 0.1 * (h.T @ dz)
            b -= lr * 0.02 * dz.sum(0)
            step = np.repeat(dh, sizes, axis=0) * (part[:, None] * lr * 40)
            order_k = np.argsort(keys, kind="stable")
            ks = keys[order_k]
            cut = np.flatnonzero(np.concatenate(([True], ks[1:] != ks[:-1])))
            emb[ks[cut]] -= np.add.reduceat(step[order_k], cut)
    return {"emb": emb, "w": w, "b": b}


def margins(model: dict) -> tuple[np.ndarray, float]:
    """Each bucket's share of the logit of class 1 against class 0, and the bias."""
    d = model["w"][:, 1] - model["w"][:, 0]
    return (model["emb"] @ d).astype(np.float32), float(model["b"][1] - model["b"][0])


def train(rows: DataFrame, learn: Column, per_class: int = PER_CLASS) -> tuple[np.ndarray, float]:
    """Margins from ``rows`` (doc_id, text, label 0 or 1) where ``learn`` holds; about ``per_class`` rows of each class."""
    got = labelled_sample(rows.where(learn & F.col("label").isin(0, 1)).select("doc_id", "text", "label"), "label", per_class).select("doc_id", "label", "text").collect()
    got.sort(key=lambda r: (r[0], r[1], r[2] or ""))
    return margins(fit([r[2] for r in got], np.array([r[1] for r in got], np.int64)))


_KNOWN: dict = {}


def _apply(margin, bias: float, mark: str):
    def run(frames):
        import pyarrow as pa

        values = np.asarray(margin.value)
        if _KNOWN.get("") != mark:
            _KNOWN.clear()
            _KNOWN[""] = mark
        for b in frames:
            for lo, hi in batches(b.column(1)):
                split = [(t or "").split() for t in b.column(1).slice(lo, hi - lo).to_pylist()]
                new = list({w for s in split for w in s if w not in _KNOWN})
                if len(_KNOWN) + len(new) > KEPT_WORDS:
                    _KNOWN.clear()
                    _KNOWN[""] = mark
                    new = list({w for s in split for w in s})
                if new:
                    flat, n = features(new)
                    sums = np.add.reduceat(values[flat], np.cumsum(n) - n)
                    _KNOWN.update(zip(new, zip(sums.tolist(), n.tolist())))
                score = np.empty(len(split))
                for i, s in enumerate(split):
                    r = again(s) * WEIGHT_AGAIN
                    total, count = r * float(values[AGAIN]), float(r)
                    for w, n in Counter(s).items():
                        v, k = _KNOWN[w]
                        total += n * v
                        count += n * k
                    z = bias + (total / count if count else 0.0)
                    score[i] = 1 / (1 + np.exp(-max(-60.0, min(60.0, z))))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(score, pa.float64())], ["doc_id", "score"])

    return run


def score(docs: DataFrame, margin: np.ndarray, bias: float) -> DataFrame:
    """(doc_id, score) of every row, score in 0..1, higher where class 1 is likelier.

    A null or empty text has the score of the bias alone. Only doc_id and text are read;
    repeated rows give repeated results.
    """
    spark = docs.sparkSession
    ship(spark)
    mark = f"{zlib.crc32(margin.tobytes())}/{bias}"
    sent = spark.sparkContext.broadcast(margin)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(_apply(sent, bias, mark), "doc_id long, score double")
