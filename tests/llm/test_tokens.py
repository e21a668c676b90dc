"""Re-Pair token files: exact round trips against the tokenizer applied to each whole text."""

from __future__ import annotations

import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from seqlake.llm import repair
from seqlake.llm.queries import op2_repair, tokenizer
from tests.conftest import MEDIUM


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer())
    return lambda s: t.encode(s, add_special_tokens=False).ids


@pytest.fixture(scope="module")
def encoder():
    return repair.Encoder(tokenizer())


def expected(rows, plain) -> list[tuple]:
    out, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array([*plain(t or ""), 0], "<u4")
        out.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def got(df) -> list[tuple]:
    return sorted(tuple(r) for r in df.select("doc_id", "start", "n_tokens", "ids_crc32").collect())


def test_query_matches_whole_text_encoding(spark, plain):
    rows = spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()
    assert got(op2_repair(spark, MEDIUM)) == sorted(expected([tuple(r) for r in rows], plain))


def test_odd_rows(spark, plain):
    rows = [(3, None), (1, ""), (2, " a  b\n\n\nc\t d\r\n e "), (5, "x" * 50_000), (5, "x" * 50_000), (4, "né <|endoftext|>   q\0 it's\n's"), (9, "the cat " * 9000)]
    df = spark.createDataFrame([(*r, "odd", 1) for r in rows] + [(None, "no place", "odd", 1)], "doc_id long, text string, start string, path int")
    assert got(repair.decode(repair.encode(df, tokenizer()))) == sorted(expected(rows, plain))


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert got(repair.decode(repair.encode(df, tokenizer()))) == []


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=" \n\t\r ab'sé1. \x1c", max_size=30), max_size=8))
def test_encoder_is_whole_text(texts):
    enc = repair.Encoder(tokenizer())
    ids, n = enc.encode(texts)
    whole = [enc.t.encode(t, add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in whole]
    assert ids.tolist() == [x for w in whole for x in w]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.lists(st.text(alphabet=" \n\t.,'-(s1a\u00e9\u00d7\u0436\u4e2d\u00b2\u00a0\u2003\u0301", max_size=20), max_size=5), max_size=4))
def test_pieces_kept_and_forgotten_are_whole_text(encoder, batches):
    """Marks after letters, digits and other signs, in batches between which pieces are forgotten, one after another with those left."""
    encoder.clear()
    kept, repair.KEPT = repair.KEPT, 6
    try:
        for texts in batches:
            ids, n = encoder.encode(texts)
            whole = [encoder.t.encode(t, add_special_tokens=False).ids for t in texts]
            assert n.tolist() == [len(w) for w in whole]
            assert ids.tolist() == [x for w in whole for x in w]
    finally:
        repair.KEPT = kept
        encoder.clear()


@pytest.mark.parametrize("texts", [[], [""], [None, ""], ["  "], ["a\0", "x<|endoftext|>"], [" "], ["\n"], ["\u00e9."], ["x" * 5000, None, "x" * 5000 + "."]])
def test_small_and_odd_batches(encoder, texts):
    ids, n = encoder.encode(texts)
    whole = [encoder.t.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert n.tolist() == [len(w) for w in whole] and ids.tolist() == [x for w in whole for x in w]


def test_the_library_meets_a_word_once(encoder, monkeypatch):
    """A word with other marks after it, or met again after the table was full, is not encoded again."""
    import types

    seen: list = []
    t = encoder.t
    monkeypatch.setattr(encoder, "t", types.SimpleNamespace(encode_batch_fast=lambda texts, **k: (seen.extend(texts), t.encode_batch_fast(texts, **k))[1]))
    encoder.clear()
    encoder.encode(["so wonder", "a wonder, a wonder. (wonder) wonder! wonder; wonder?"])
    assert "".join(seen).count(" wonder") == 1
    monkeypatch.setattr(repair, "KEPT", 30)
    encoder.encode(["the wonder " + " ".join(f"w{i}" for i in range(40))])
    encoder.encode(["the wonder"])
    assert "".join(seen).count(" wonder") == 1 and "w0" not in encoder.known.to_pylist()
    encoder.clear()


@settings(max_examples=100, deadline=None)
@given(st.lists(st.lists(st.integers(0, 5), max_size=60), min_size=1, max_size=6))
def test_grammar_round_trip_and_random_access(docs):
    ids = np.array([x for d in docs for x in d], np.uint32)
    counts = np.array([len(d) for d in docs])
    sym, per, rule = repair.compress(ids, counts, terminals=6, most=40, least=2)
    pairs: dict = {}
    at = 0
    for n in per:  # nothing that pays is left, or no rule
        d, at, last = sym[at : at + n].tolist(), at + n, None
        for i, p in enumerate(zip(d, d[1:])):
            if not (p[0] == p[1] and last == (p, i - 1)):
                pairs[p] = pairs.get(p, 0) + 1
                last = (p, i)
    assert len(rule) == 40 or max(pairs.values(), default=0) < 2
    assert repair.expand(sym, rule, 6).tolist() == ids.tolist()
    at = 0
    for d, n in zip(docs, per):
        assert repair.expand(sym[at : at + n], rule, 6).tolist() == d
        at += n
    assert at == len(sym)


def test_shard_gives_any_id():
    rng = np.random.default_rng(1)
    docs = [rng.integers(0, 7, n) for n in (0, 1, 500, 40)] + [np.tile([1, 2, 3, 4], 400)]
    f = io.BytesIO(repair.pack(np.arange(len(docs)), np.array([len(d) for d in docs]), np.concatenate(docs).astype(np.uint32), 50257))
    s = repair.Shard(f)
    assert len(s.rule) and s.symbols < sum(map(len, docs))
    for i, d in enumerate(docs):
        assert s.document(i).tolist() == d.tolist()
        for k in range(0, len(d), 37):
            assert s.token(i, k) == d[k]
    with pytest.raises(ValueError):
        repair.Shard(io.BytesIO(b"XXXX" + bytes(60)))


def test_long_repeats_shrink_to_few_symbols():
    """A passage that stands often is one symbol in the end, not one for every sixteen ids."""
    passage = np.random.default_rng(3).integers(0, 50_000, 600)
    ids = np.tile(passage, 200).astype(np.uint32)
    sym, per, rule = repair.compress(ids, np.full(200, 600), 50257)
    assert per.tolist() == [1] * 200 and repair.expand(sym, rule, 50257).tolist() == ids.tolist()


def test_rounds_are_those_of_a_full_count():
    """Rounds that look at new pairs alone find what a count of all pairs finds: nothing that pays is left, in either width."""
    rng = np.random.default_rng(5)
    ids = rng.choice(3000, 60_000, p=(w := 1 / np.arange(1, 3001)) / w.sum()).astype(np.uint32)
    counts = np.full(60, 1000)
    for terminals in (3000, 1 << 17):
        sym, per, rule = repair.compress(ids, counts, terminals)
        assert (repair.expand(sym, rule, terminals) == ids).all()
        inside = np.ones(len(sym), bool)
        inside[np.cumsum(per) - 1] = False
        pair = (sym[:-1].astype(np.int64) << 32 | sym[1:])[inside[:-1]]
        assert np.unique(pair, return_counts=True)[1].max() < repair.LEAST and len(rule) < repair.room(terminals)


def test_ids_beyond_the_tokenizer_are_refused():
    with pytest.raises(ValueError):
        repair.pack(np.array([1]), np.array([1]), np.array([50257], np.uint32), 50257)
