"""ARC to WARC: exact round trips, revisits, malformed files, versions."""

from __future__ import annotations

import hashlib
import io
import random

import pytest

from seqlake.llm import archives
from seqlake.llm.queries import op1_warc
from tests.conftest import MEDIUM

SCHEMA = "page_id long, url string, html string, digest string, path string"


def expected(rows) -> dict:
    body = {p: (h or "").encode() for p, h in rows}
    first: dict = {}
    for p in sorted(body):
        if len(body[p]) >= 100:
            first.setdefault(body[p], p)
    out = {}
    for p, b in body.items():
        f = first.get(b, p)
        out[p] = (len(b), hashlib.sha256(b).hexdigest(), "response" if f == p else "revisit", None if f == p else f)
    return out


def result(df) -> dict:
    rows = df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/pages.parquet").select("page_id", "html").collect()]
    assert result(op1_warc(spark, MEDIUM)) == expected(rows)


@pytest.mark.parametrize("version", [0, 1, 2])
def test_odd_rows(spark, version, monkeypatch):
    monkeypatch.setattr(archives, "FILE_BYTES", 2000)
    rng = random.Random(1)
    big = "".join(rng.choice("abc \r\n") for _ in range(300_000))
    same = "HTTP/1.1 200 OK\r\n\r\n" + "x" * 200
    rows = [(1, None), (2, ""), (3, "a" * 99), (4, "a" * 99), (5, "b" * 100), (-6, "b" * 100), (7, "é" * 50), (8, "é" * 50), (9, big), (10, big), (11, same), (12, same), (13, "WARC/1.0\r\nX: 1\r\n\r\n"), *[(20 + i, f"page {i % 7} " * 30) for i in range(50)]]
    urls = [None, "", "http://a/b c", "http://é/\n", "filedesc"]
    df = spark.createDataFrame([(p, urls[i % len(urls)], h, "x", "y") for i, (p, h) in enumerate(rows)], SCHEMA).repartition(5)
    out = archives.read(archives.convert(archives.write_arc(df, version)))
    assert result(out) == expected(rows)
    assert out.where("warc_date <> '2020-01-01T00:00:00Z'").count() == 0
    assert out.select("record_id").distinct().count() == len(rows)


def test_repeated_rows_and_empty_table(spark):
    df = spark.createDataFrame([(1, "u", "z" * 200, "", ""), (1, "u", "z" * 200, "", ""), (None, "u", "z" * 200, "", "")], SCHEMA)
    out = archives.read(archives.convert(archives.write_arc(df))).collect()
    assert sorted(r["record_type"] for r in out) == ["response", "revisit", "revisit"]
    assert {r["refers_to"] for r in out} == {None, 1} and all(r["page_id"] == 1 for r in out if r["record_type"] == "response")
    assert archives.read(archives.convert(archives.write_arc(df.limit(0)))).count() == 0


def arc(version: int, *records: bytes) -> io.BytesIO:
    return io.BytesIO(archives.arc_head(version, "f.arc") + b"".join(records))


def test_header_lines_by_version():
    one = b"http://a/x y 1.2.3.4 1999 text/html 5\nhello\n"
    two = b"http://a/x y 1.2.3.4 19990102030405 text/html 200 ck - 77 f.arc 5\nhello\n"
    for version, record, names in ((1, one, 5), (2, two, 10)):
        (_, head, _), (offset, fields, block) = archives.read_arc(arc(version, record))
        assert head["url"].startswith("filedesc://") and len(fields) == names
        assert (fields["url"], fields["ip"], fields["type"], block) == ("http://a/x y", "1.2.3.4", "text/html", b"hello")
        assert offset == len(archives.arc_head(version, "f.arc"))
    assert (archives.iso("19990102030405"), archives.iso("1999"), archives.iso("x"), archives.iso("19991399000000")) == ("1999-01-02T03:04:05Z", "1999-01-01T00:00:00Z", "1970-01-01T00:00:00Z", "1970-01-01T00:00:00Z")


@pytest.mark.parametrize("record", [b"http://a 1.2.3.4 1999 text/html x\nhello\n", b"http://a 1.2.3.4 1999 text/html 50\nhello\n", b"short 5\nhello\n"])
def test_malformed_records(record):
    with pytest.raises(archives.BadRecord):
        list(archives.read_arc(arc(1, record)))
    with pytest.raises(archives.BadRecord):
        list(archives.read_warc(io.BytesIO(b"nonsense\r\n\r\n")))


def test_lenient_reading(spark, tmp_path):
    """Damage is listed and left out; what is whole is converted."""
    good = b"http://a/%d 1.2.3.4 19990101000000 text/html 5\nhello\n"
    data = archives.arc_head(1, "f.arc") + good % 1 + b"nonsense\n" + good % 2 + b"http://a 1.2.3.4 1999 text/html 500\nhello\n"
    (tmp_path / "f.arc").write_bytes(data)
    arcs = spark.createDataFrame([(f"file://{tmp_path}/f.arc",)], "path string")
    bad = archives.damaged(arcs).orderBy("offset").collect()
    assert [r["offset"] for r in bad] == [data.index(b"nonsense"), data.rindex(b"http://a ")] and "of 500" in bad[1]["why"]
    assert archives.read(archives.convert(arcs, lenient=True)).count() == 2
    with pytest.raises(Exception, match="nonsense"):
        archives.convert(arcs)
