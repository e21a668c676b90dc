"""The SQL of the queries that have it, against brute force."""

from __future__ import annotations

import __spark_entry__
from seqlake.llm.queries import ORACLES, QUERIES
from tests.llm import brute
from tests.llm.test_archives import expected


def test_registered():
    assert {*QUERIES} | {"pipeline"} <= {*__spark_entry__.queries()} and {*ORACLES} <= {*__spark_entry__.oracle_sql()}
    assert [n.split("_")[0] for n in QUERIES] == [f"op{i}" for i in range(1, 11)]


def test_near_duplicates(duck):
    got = duck.execute(ORACLES["op8_minhash"]).fetchall()
    assert {r[0]: (r[1], r[2]) for r in got} == brute.near(duck.execute("select doc_id, text from documents").fetchall())


def test_archives(duck):
    got = duck.execute(ORACLES["op1_warc"]).fetchall()
    assert {r[0]: tuple(r[1:]) for r in got} == expected(duck.execute("select page_id, html from pages").fetchall())
