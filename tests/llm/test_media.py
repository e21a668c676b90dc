"""Media shards: exact round trips, one copy of equal contents, metadata from headers."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from hypothesis import given, settings, strategies as st

from seqlake.llm import media
from seqlake.llm.queries import op10_media
from tests.conftest import MEDIUM

SCHEMA = "doc_id long, text string, digest string, path int"


def expected(rows) -> dict:
    out = {}
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + bytes(64 if not raw else -len(raw) % 64)
        out[i] = (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
    return out


def result(df) -> dict:
    rows = df.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/documents.parquet").select("doc_id", "text").collect()]
    out = op10_media(spark, MEDIUM)
    assert result(out) == expected(rows)
    of: dict = {}
    text = dict(rows)
    for r in out.collect():
        of.setdefault(text[r["doc_id"]], set()).add((r["media_bytes"], r["media_sha256"], r["feature"]))
    assert all(len(v) == 1 for v in of.values())


def test_odd_rows(spark, monkeypatch):
    rows = [(1, None), (2, ""), (3, "a" * 64), (4, "a" * 65), (5, "\0"), (6, "é\U0001f600" * 40_000), *[(10 + i, f"text {i % 5} " * 40) for i in range(60)]]
    df = spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA).repartition(4)
    kept, index = media.store(df)
    assert result(media.features(kept, index)) == expected(rows)
    assert index.count() == len({x[2] for x in expected(rows).values()})  # a zero byte alone and no text pad to one payload
    head = {r["digest"]: (r["width"], r["height"], r["bits"]) for r in media.metadata(index).collect()}
    assert len(head) == index.count() and all(x[0] == 64 and x[2] == 8 for x in head.values())
    twice, again = media.store(spark.createDataFrame([(1, "q", "", 0), (1, "q", "", 0), (None, "q", "", 0)], SCHEMA))
    assert media.features(twice, again).count() == 3 and again.count() == 1
    none, empty = media.store(df.limit(0))
    assert media.features(none, empty).count() == 0 and media.metadata(empty).count() == 0


def test_what_is_stored_and_its_feature():
    """The stored form and the feature, written out for one payload."""
    p = bytes(range(64)) * 9
    data = media.encode(p)
    rows = b"".join(b"\0" + p[i : i + 64] for i in range(0, len(p), 64))
    chunk = lambda kind, x: len(x).to_bytes(4, "big") + kind + x + zlib.crc32(kind + x).to_bytes(4, "big")
    assert data == b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", (64).to_bytes(4, "big") + (9).to_bytes(4, "big") + bytes([8, 0, 0, 0, 0])) + chunk(b"IDAT", zlib.compress(rows, 3)) + chunk(b"IEND", b"")
    # Every row climbs from 0 to 63: mean 31.5, deviation of 0..63, and the right half of all eight rows of areas is above the mean.
    assert media.feature(p) == f"h9:m31.500:s{((64 * 64 - 1) / 12) ** 0.5:.3f}:{int('00001111' * 8, 2):016x}"


def test_a_task_that_forgets(spark, monkeypatch):
    monkeypatch.setattr(media, "KNOWN", 3)
    rows = [(i, f"text {i % 7}") for i in range(60)]
    kept, index = media.store(spark.createDataFrame([(*r, "", 0) for r in rows], SCHEMA).coalesce(1))
    assert index.count() == 7 and result(media.features(kept, index)) == expected(rows)


def test_shards_are_tar_files(spark):
    import tarfile

    _, index = media.store(spark.createDataFrame([(i, f"t{i}", "", 0) for i in range(9)], SCHEMA).coalesce(1))
    rows = index.collect()
    with tarfile.open(rows[0]["path"].removeprefix("file://")) as t:
        assert {m.name for m in t} == {r["digest"].hex() + ".png" for r in rows}
        for r in rows:
            data = t.extractfile(r["digest"].hex() + ".png").read()
            assert len(data) == r["length"] and hashlib.sha256(data).digest() == bytes(r["digest"])


@settings(max_examples=100, deadline=None)
@given(st.text(max_size=400))
def test_image_round_trip(text):
    p = media.payload_of(text)
    data = media.encode(p)
    assert media.decode(data) == p and media.header(data)[:2] == (64, len(p) // 64)
    assert media.feature(p) == media.feature(bytes(p))


def test_damage_is_found():
    data = bytearray(media.encode(media.payload_of("some text")))
    data[45] ^= 1
    with pytest.raises(ValueError):
        media.decode(bytes(data))
    with pytest.raises(ValueError):
        media.header(b"GIF89a" + bytes(40))
