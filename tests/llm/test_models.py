"""Trained models on held-out rows: language, quality, licences."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest

from seqlake.llm import langid, licenses, subword
from seqlake.llm.queries import op5_quality, op6_licenses, op7_langid
from tests.conftest import MEDIUM, SMALL


def rest(i: int, n: int) -> int:
    return zlib.crc32(str(i).encode()) % n


def test_language_of_held_out_rows(spark):
    true = {r[0]: r[1] for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "lang").collect()}
    out = op7_langid(spark, MEDIUM).collect()
    assert len(out) == len(true)
    assert all(r["held_out"] == (rest(r["doc_id"], 4) == 2) and 0 <= r["score"] <= 1 for r in out)
    held = [r for r in out if r["held_out"] and r["lang_pred"] != "und"]
    assert sum(r["lang_pred"] == true[r["doc_id"]] for r in held) > 0.93 * len(held)


def test_language_of_odd_rows(spark):
    docs = [(i, ("the cat and the dog went home with the men " if i % 2 else "der Hund und die Katze gehen nach Hause mit den ") * (1 + i % 3), "en" if i % 2 else "de", "x", 1) for i in range(60)]
    odd = [(100, None, "en", None, 0), (101, "", "en", None, 0), (102, " 12 _ \U0001f600 --", None, None, 0), (103, "a", None, None, 0), (104, "the dog and the men " * 60_000, None, None, 0), (None, "the dog and the men went home", None, None, 0), (1, docs[1][1], "en", "x", 1)]
    df = spark.createDataFrame([*docs, *odd], "doc_id long, text string, lang string, lang_pred string, score int")
    from pyspark.sql import functions as F

    names, model = langid.train(df, F.lit(True))
    assert names == ["de", "en"]
    got: dict = {}
    for r in langid.predict(df, names, model).collect():
        got.setdefault(r["doc_id"], []).append((r["lang_pred"], r["score"]))
    assert len(got[1]) == 2 and got[1][0] == got[1][1]
    assert [got[i] for i in (100, 101, 102)] == [[("und", 0.0)]] * 3
    assert got[103][0][0] in names and got[104][0][0] == "en" and got[None][0][0] == "en"
    kept = langid.determined(df, names, model)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {*got} - {100, 101, 102}
    names, model = langid.train(df.limit(0), F.lit(True))
    assert (names, model) == ([], None)
    assert {r["doc_id"] for r in langid.determined(df, names, model).collect()} == {*got} - {100, 101, 102}
    assert {r["lang_pred"] for r in langid.predict(df, names, model).collect()} == {"und"}
    assert langid.predict(df.limit(0), ["de"], None).count() == 0


def test_windows_cover_every_byte():
    for n in (0, 1, 255, 256, 257, 508, 509, 2000):
        data = bytes(np.random.default_rng(n).integers(1, 256, n, dtype=np.uint8))
        w, weight = langid.windows(data)
        back = b"".join(bytes(x[: langid.STEP]) for x in w[:-1]) + bytes(w[-1])
        assert back.rstrip(b"\0") == data.rstrip(b"\0") and weight.sum() == max(1, n)


def test_letters():
    """Letters are the categories L*; numerals and marks are none."""
    assert not any(map(langid.has_letter, ("", "12 _", "\u00bd", "\u00b2  3", "\u2167", "\u0301", "\U0001f600")))
    assert all(map(langid.has_letter, ("a", "1\u00e9", "\u2167x", "\u4e2d", "\u00aa")))
    names, model = ["aa", "bb"], langid._start(2, np.random.default_rng(0))
    pred, score = langid.classify(["\u00bd", "\u00b2  3", "\u2167", None, "a"], names, model)
    assert pred[:4] == ["und"] * 4 and score[:4].tolist() == [0.0] * 4 and pred[4] in names


def test_probabilities_are_a_plain_convolution():
    """Every filter at every position of a window, its maximum, rectifier and softmax, by loops; a text's is its windows' mean by bytes."""
    model = langid._start(3, np.random.default_rng(1))
    text = "\u00e9 plain text, " * 60
    x, weight = langid.windows(text.encode())
    total = np.zeros(3)
    for w, k in zip(x, weight):
        act = []
        for f in range(langid.FILTERS * len(langid.WIDTHS)):
            width = langid.WIDTHS[f // langid.FILTERS]
            at = [sum(float(model["emb"][w[p + j]] @ model["w1"][j * langid.DIM : (j + 1) * langid.DIM, f]) for j in range(width)) for p in range(langid.STEP)]
            act.append(max(0.0, max(at) + float(model["b1"][f])))
        z = np.array(act) @ model["w2"] + model["b2"]
        total += k * np.exp(z - z.max()) / np.exp(z - z.max()).sum()
    pred, score = langid.classify([text], ["a", "b", "c"], model)
    want = total / weight.sum()
    assert pred == ["abc"[int(want.argmax())]] and abs(score[0] - want.max()) < 1e-5


def auc(score: list, label: list) -> float:
    order = np.argsort(score, kind="stable")
    y = np.array(label)[order]
    rank = np.arange(1, len(y) + 1)
    pos = y.sum()
    return float((rank[y == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(y) - pos)))


def test_quality_of_held_out_rows(spark):
    label = {r[0]: r[1] for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").select("doc_id", "quality").collect()}
    out = op5_quality(spark, MEDIUM).collect()
    assert len(out) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()
    assert all(r["held_out"] == (rest(r["doc_id"], 3) == 1) and 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in out)
    held = [r for r in out if r["held_out"] and label.get(r["doc_id"]) is not None]
    assert auc([r["score"] for r in held], [label[r["doc_id"]] for r in held]) > 0.8


def test_quality_of_odd_rows(spark):
    from pyspark.sql import functions as F

    rows = [(i, "good words here now" if i % 2 else "bad junk junk junk", i % 2, "x") for i in range(80)]
    df = spark.createDataFrame([*rows, (100, None, 1, "x"), (101, "", None, "x"), (102, "good here " * 200_000, None, "x"), (None, "junk junk bad", None, "x"), (1, rows[1][1], 1, "x")], "doc_id long, text string, label int, score string")
    margin, bias = subword.train(df, F.lit(True))
    got: dict = {}
    for r in subword.score(df, margin, bias).collect():
        got.setdefault(r["doc_id"], []).append(r["score"])
    assert len(got[1]) == 2 and got[1][0] == got[1][1] > 0.5 > got[2][0] and got[102][0] > 0.5 > got[None][0]
    assert got[100] == got[101] == [pytest.approx(1 / (1 + np.exp(-bias)))]
    margin, bias = subword.train(df.limit(0), F.lit(True))
    assert subword.score(df.limit(0), margin, bias).count() == 0 and 0 <= subword.score(df, margin, bias).first()["score"] <= 1


def test_quality_query_against_a_dense_model(spark):
    """The query's scores are those of a model fitted to the learning fold alone, applied to the mean of each text's features."""
    docs = {r[0]: r[1] for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()}
    labels = sorted((r[0], r[1], docs[r[0]]) for r in spark.read.parquet(f"{SMALL}/labels.parquet").select("doc_id", "quality").collect() if r[0] in docs and rest(r[0], 3) != 1 and r[1] in (0, 1))
    model = subword.fit([t for _, _, t in labels], np.array([y for _, y, _ in labels]))
    for r in op5_quality(spark, SMALL).collect():
        (keys, n), = subword.bags([docs[r["doc_id"]]])
        h = (model["emb"][keys] * (n / n.sum())[:, None]).sum(0) if len(keys) else np.zeros(subword.DIM)
        z = h @ model["w"] + model["b"]
        assert r["score"] == pytest.approx(float(1 / (1 + np.exp(z[0] - z[1]))), abs=1e-4)


def test_features_of_a_word_depend_on_it_alone():
    """A longer word in the same call changes no bucket, so training, scoring and every batch read the same features."""
    words = ["a", "ab", "word", "\u00fcn\u00efcode"]
    alone = [subword.features([w])[0].tolist() for w in words]
    flat, n = subword.features([*words, "x" * 300])
    assert [x.tolist() for x in np.split(flat, np.cumsum(n))[: len(words)]] == alone
    assert subword.features([])[0].tolist() == []


def test_scores_equal_the_model():
    """What scoring sums by distinct word is the mean embedding's softmax."""
    texts = ["one two two three", "Ünïcode words, words again again", "a", "x " * 300]
    model = subword.fit(texts * 4, np.array([0, 1, 0, 1] * 4), epochs=3)
    margin, bias = subword.margins(model)
    for t, (keys, n) in zip(texts, subword.bags(texts)):
        h = (model["emb"][keys] * (n / n.sum())[:, None]).sum(0)
        z = h @ model["w"] + model["b"]
        assert margin[keys] @ (n / n.sum()) + bias == pytest.approx(float(z[1] - z[0]), abs=1e-4)


@pytest.fixture(scope="module")
def model():
    prose = ["The weather was fine and the children played outside.", "Prices rose by two percent in the last quarter."]
    return licenses.fit([sorted(licenses.grams_of(licenses.words_of(t)) & {*licenses.vocabulary()}) for t in prose] * 700)


def plain_scan(docs, m) -> dict:
    """Family and probability of every paragraph and line of a known family, by dense arithmetic; a paragraph of several lines where a template agrees better with it than with its lines."""
    out = {}
    k = len(m["names"]) - 1
    listed = licenses.templates()
    for i, t in docs:
        for p, text in enumerate(re.split(r"\n[^\S\n]*\n", t or "")):
            lines = text.split("\n")
            found = {}
            for at, u in [(None, text), *(enumerate(lines) if len(lines) > 1 else ())]:
                w = licenses.words_of(u)
                x = [m["vocab"][g] for g in licenses.grams_of(w) if g in m["vocab"]]
                if not x:
                    continue
                z = (m["w"][x].sum(0) / len(x) ** 0.5 + m["b"]) / m["temperature"]
                e = np.exp(z - z.max())
                e /= e.sum()
                j = int(e[:k].argmax())
                if e[j] >= m["least"] and e[j] >= e[k]:
                    have = {" ".join(w[n : n + 3]) for n in range(len(w) - 2)}
                    overlap = max((len(tri & have) / len(tri) for f, tri in listed if f == m["names"][j]), default=0.0)
                    found[at] = (m["names"][j], float(e[j]), overlap)
            whole = found.pop(None, None)
            if whole and whole[2] > max((v[2] for v in found.values()), default=-1):
                found = {None: whole}
            out |= {(i, p, at): v for at, v in found.items()}
    return out


def test_licences_against_dense_arithmetic(spark, model):
    docs = [(i, f"Some prose.\n{t}\nMore prose.") for i, (_, t) in enumerate(licenses.variants())]
    docs += [(5000, None), (5001, ""), (5002, "license " * 20_000), (5003, "\n\nlicense\n"), *[(6000 + i, t) for i, t in enumerate(licenses._OTHER)]]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, family string, row int")
    rows = licenses.scan(df, model).collect()
    want = plain_scan(docs, model)
    assert {(r["doc_id"], r["paragraph"], r["line"]): r["family"] for r in rows} == {k: v[0] for k, v in want.items()}
    for r in rows:
        _, p, overlap = want[r["doc_id"], r["paragraph"], r["line"]]
        assert abs(r["probability"] - p) < 1e-4 and abs(r["overlap"] - overlap) < 1e-5 and r["confirmed"] == (overlap >= licenses.CONFIRMS)
    truth = [f for f, _ in licenses.variants()]
    known = [r for r in rows if r["doc_id"] < 5000]
    assert len({r["doc_id"] for r in known}) > 0.95 * len(truth) and sum(truth[r["doc_id"]] == r["family"] for r in known) > 0.98 * len(known)
    assert sum(r["confirmed"] for r in known) > 0.8 * len(known) and not [r for r in rows if r["doc_id"] >= 6000]
    assert licenses.scan(df.limit(0), model).count() == 0
    assert licenses.unknown_sample(df.limit(0)) == []
    some = df.where("doc_id in (3, 4, 5)")
    assert licenses.scan(some.union(some), model).count() == 2 * licenses.scan(some, model).count() > 0


LINES = ["Distributed under the MIT terms.", "Provided under the 3-Clause BSD terms.", "Released under the Apache 2.0 terms.", "Distributed under Apache 2.0.", "BSD 3-Clause", "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files, to deal in\nthe software without restriction."]
PLAIN = ["She took her degree at MIT last year.", "The license plate of the car was gone.", "Copyright was explained to the class.", "mit", "Apache was a nation of the plains, and the terms of peace were hard."]


def test_licences_need_no_cue_word(spark):
    """Short statements, notices wrapped over lines, and paragraphs between others are found; sentences that mention licences are not."""
    model = licenses.fit(licenses.unknown_sample(spark.read.parquet(f"{MEDIUM}/documents.parquet")))
    docs = [(i, t) for i, t in enumerate(LINES)] + [(100 + i, f"Plain words come first,\nthen more of them.\n \n{t}\n\nAnd the rest.") for i, t in enumerate(LINES)] + [(200 + i, t) for i, t in enumerate(PLAIN)]
    rows = licenses.scan(spark.createDataFrame(docs, "doc_id long, text string"), model).collect()
    family = ["mit", "bsd", "apache-2.0", "apache-2.0", "bsd", "mit"]
    assert {(r["doc_id"], r["family"]) for r in rows} == {(i + k, f) for i, f in enumerate(family) for k in (0, 100)}
    assert all(r["paragraph"] == (r["doc_id"] >= 100) and r["line"] is None and r["confirmed"] for r in rows)


def test_licence_query_finds_the_lines(spark):
    rows = op6_licenses(spark, MEDIUM).collect()
    assert rows and Counter(r["confirmed"] for r in rows)[True] > 0.8 * len(rows)
