"""Language of a text by a byte convolutional network, trained and applied with numpy.

Bytes are embedded, filters of widths 2, 3 and 4 slide over fixed windows of 256 bytes, each
filter's maximum over the window goes through a rectifier, and a softmax gives the window's
languages. A text's probability is the mean over its windows, weighted by their bytes, so
the whole text counts.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seqlake.llm.sampling import labelled_sample
from seqlake.llm.shared import settled, ship
from seqlake.llm.words import batches

WINDOW, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 16, 8
STEP = WINDOW - max(WIDTHS) + 1
#: The bound of the training sample: rows of each language, and windows, spread evenly, of each row.
PER_LANGUAGE, PER_ROW = 300, 5
#: A word character that is neither digit nor underscore: a letter, or a numeral of another kind.
_LETTERLIKE = re.compile(r"[^\W\d_]")


def has_letter(text: str) -> bool:
    """Whether a text has a character of a letter category (L*); numerals such as a half or a Roman eight are none."""
    return any(m[0].isalpha() for m in _LETTERLIKE.finditer(text))


def windows(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(windows x WINDOW) bytes that cover every filter position of ``data``, zero-padded, and the bytes each adds."""
    n = max(1, -(-(len(data) - WINDOW + STEP) // STEP))
    buf = np.zeros((n - 1) * STEP + WINDOW, np.uint8)
    buf[: len(data)] = np.frombuffer(data, np.uint8)
    w = np.lib.stride_tricks.as_strided(buf, (n, WINDOW), (STEP, 1))
    weight = np.full(n, STEP, np.float32)
    weight[-1] = max(1, len(data) - (n - 1) * STEP)
    return w, weight


def _start(classes: int, rng) -> dict:
    k = max(WIDTHS) * DIM
    w1 = rng.normal(0, 0.3, (k, FILTERS * len(WIDTHS))).astype(np.float32)
    for i, width in enumerate(WIDTHS):
        w1[width * DIM :, i * FILTERS : (i + 1) * FILTERS] = 0
    return {"emb": rng.normal(0, 0.5, (256, DIM)).astype(np.float32), "w1": w1, "b1": np.zeros(w1.shape[1], np.float32), "w2": rng.normal(0, 0.1, (w1.shape[1], classes)).astype(np.float32), "b2": np.zeros(classes, np.float32)}


def _columns(model: dict, x: np.ndarray) -> np.ndarray:
    e = model["emb"][x].reshape(len(x), -1)
    return np.ascontiguousarray(np.lib.stride_tricks.as_strided(e, (len(x), STEP, max(WIDTHS) * DIM), (e.strides[0], DIM * 4, 4)))


def probabilities(model: dict, x: np.ndarray) -> np.ndarray:
    """Softmax of each window, computed 128 windows at a time."""
    out = []
    for lo in range(0, len(x), 128):
        z = (_columns(model, x[lo : lo + 128]) @ model["w1"]).max(1) + model["b1"]
        z = np.maximum(z, 0) @ model["w2"] + model["b2"]
        z = np.exp(z - z.max(1, keepdims=True))
        out.append(z / z.sum(1, keepdims=True))
    return np.concatenate(out)


def fit(x: np.ndarray, y: np.ndarray, classes: int, epochs: int = 6, steps: int = 400, batch: int = 64, rate: float = 0.004, seed: int = 7) -> dict:
    """Adam on the cross-entropy of windows ``x`` with classes ``y``; classes weigh alike. Few windows are gone over until there are ``steps`` steps."""
    epochs = max(epochs, -(-steps // -(-len(x) // batch)))
    rng = np.random.default_rng(seed)
    model = _start(classes, rng)
    mask = (model["w1"] != 0).astype(np.float32)
    m, v = ({k: np.zeros_like(a) for k, a in model.items()} for _ in range(2))
    share = np.bincount(y, minlength=classes).astype(np.float32)
    weight = (len(y) / (classes * np.maximum(share, 1)))[y].astype(np.float32)
    step = 0
    for epoch in range(epochs):
        order = rng.permutation(len(x))
        for lo in range(0, len(x), batch):
            i = order[lo : lo + batch]
            cols = _columns(model, x[i])
            conv = cols @ model["w1"]
            top = conv.argmax(1)
            pool = np.take_along_axis(conv, top[:, None, :], 1)[:, 0] + model["b1"]
            act = np.maximum(pool, 0)
            z = act @ model["w2"] + model["b2"]
            z = np.exp(z - z.max(1, keepdims=True))
            p = z / z.sum(1, keepdims=True)
            p[np.arange(len(i)), y[i]] -= 1
            dz = p * weight[i, None] / len(i)
            dpool = (dz @ model["w2"].T) * (pool > 0)
            at = cols[np.arange(len(i))[:, None], top]  # windows x filters x inputs
            g = {"w2": act.T @ dz, "b2": dz.sum(0), "b1": dpool.sum(0), "w1": np.einsum("bf,bfk->kf", dpool, at, optimize=True) * mask}
            de = (dpool[:, :, None] * model["w1"].T[None]).reshape(len(i), -1, max(WIDTHS), DIM)
            where = x[i][np.arange(len(i))[:, None, None], top[:, :, None] + np.arange(max(WIDTHS))]
            g["emb"] = np.zeros_like(model["emb"])
            np.add.at(g["emb"], where.ravel(), de.reshape(-1, DIM))
            step += 1
            lr = rate * (1 - epoch / epochs / 1.2)
            for k in model:
                m[k] += 0.1 * (g[k] - m[k])
                v[k] += 0.01 * (g[k] * g[k] - v[k])
                model[k] -= lr * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)
    return model


def _sampled(frames):
    import pyarrow as pa

    for b in frames:
        lang, data = [], []
        for name, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            w, _ = windows(text.encode())
            for k in np.unique(np.linspace(0, len(w) - 1, PER_ROW).astype(int)):
                lang.append(name)
                data.append(w[k].tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(data, pa.binary())], ["lang", "window"])


def train(docs: DataFrame, learn: Column, per_language: int = PER_LANGUAGE) -> tuple[list[str], dict | None]:
    """(languages, weights) from the rows of ``docs`` (doc_id, text, lang) where ``learn`` holds and lang is not null.

    At most about ``per_language`` rows of each language are used, PER_ROW windows of each.
    Without any such row there are no languages and no weights.
    """
    ship(docs.sparkSession)
    rows = docs.where(learn & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    got = labelled_sample(rows, "lang", per_language).select("lang", "text").mapInArrow(_sampled, "lang string, window binary").collect()
    got.sort(key=lambda r: (r[0], bytes(r[1])))
    names = sorted({r[0] for r in got})
    if not names:
        return [], None
    x = np.frombuffer(b"".join(bytes(r[1]) for r in got), np.uint8).reshape(-1, WINDOW)
    y = np.array([names.index(r[0]) for r in got])
    return names, fit(x, y, len(names))


#: Bytes of a text that are taken at a time, and windows that are scored together.
PART, TOGETHER = 1 << 22, 4096


def classify(texts: list[str | None], names: list[str], model: dict | None) -> tuple[list[str], np.ndarray]:
    """(language, score) of each whole text; texts without a letter are ``und``."""
    pred: list = ["und"] * len(texts)
    total = np.zeros((len(texts), max(1, len(names))))
    held: list = []
    rows = 0

    def flush() -> None:
        p, at = probabilities(model, np.concatenate([w for _, w, _ in held])), 0
        for i, w, weight in held:
            total[i] += (p[at : at + len(w)] * weight[:, None]).sum(0)
            at += len(w)
        held.clear()

    for i, text in enumerate(texts):
        if not names or text is None or not has_letter(text):
            continue
        data = text.encode("utf-8", "surrogatepass")
        pred[i] = ""
        for lo in range(0, len(data), PART):
            w, weight = windows(data[lo : lo + PART])
            held.append((i, w, weight))
            rows += len(w)
            if rows >= TOGETHER:
                flush()
                rows = 0
    if held:
        flush()
    score = np.zeros(len(texts))
    for i in [i for i, p in enumerate(pred) if p == ""]:
        q = total[i] / total[i].sum()
        pred[i], score[i] = names[int(q.argmax())], min(1.0, float(q.max()))
    return pred, score


def _apply(names: list[str], model: dict | None):
    def run(frames):
        import pyarrow as pa

        for b in frames:
            for lo, hi in batches(b.column(1)):
                pred, score = classify(b.column(1).slice(lo, hi - lo).to_pylist(), names, model)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def _keep(at: int, names: list[str], model: dict | None, least: float):
    def run(frames):
        import pyarrow as pa

        for b in frames:
            for lo, hi in batches(b.column(at)):
                part = b.slice(lo, hi - lo)
                texts = part.column(at).to_pylist()
                if names:
                    stays = [p != "und" and s >= least for p, s in zip(*classify(texts, names, model))]
                else:
                    stays = [t is not None and has_letter(t) for t in texts]
                yield part.filter(pa.array(stays, pa.bool_()))

    return run


def determined(rows: DataFrame, names: list[str], model: dict | None, least: float = 0.0) -> DataFrame:
    """The rows whose language is determined with a score of at least ``least``; all columns as they were.

    Without a model (no labelled rows to learn from) no text can be told from another, so all
    rows with a letter stay.
    """
    ship(rows.sparkSession)
    return rows.mapInArrow(settled(_keep(rows.columns.index("text"), names, model, least)), rows.schema)


def predict(docs: DataFrame, names: list[str], model: dict | None) -> DataFrame:
    """(doc_id, lang_pred, score) of every row: ``und`` and 0 for a null text, one without a letter, or no languages.

    Only doc_id and text are read; repeated rows give repeated results, an empty table an empty one.
    """
    ship(docs.sparkSession)
    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).mapInArrow(settled(_apply(names, model)), "doc_id long, lang_pred string, score double")
