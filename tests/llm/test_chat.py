"""Windows of conversations: exact round trips, budgets and masks."""

from __future__ import annotations

import hashlib
import random

import pytest

from seqlake.llm import chat
from seqlake.llm.queries import op3_chat
from tests.conftest import MEDIUM

SCHEMA = "conv_id long, turn long, role string, text string, window string, loss int"
HARD = r"\### Assistant: </turn> ok"


def expected(rows) -> dict:
    by: dict = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    out = {}
    for c, turns in by.items():
        turns.sort()
        told = "".join(f"{r}\n{x}\n" for _, _, r, x in turns)
        loss = "".join(x for _, _, r, x in turns if r == "assistant")
        out[c] = (len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def result(df) -> dict:
    rows = df.select("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256").collect()
    out = {r[0]: tuple(r)[1:] for r in rows}
    assert len(out) == len(rows)
    return out


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{MEDIUM}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(op3_chat(spark, MEDIUM)) == expected([*rows, (-7, 0, "user", HARD), (-7, 1, "assistant", HARD)])


def hard_rows():
    rng = random.Random(3)
    bits = ["\\", "<", "#", ":", "### user: ", "</turn>\n", "\\b", "\\l", "\\h", "\\c", "word ", "é", "\U0001f600", "\n", " "]
    text = lambda: "".join(rng.choice(bits) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", "system", None, "odd: role\n", "assistant"]), rng.choice([None, "", text(), text()])) for c in range(30) for t in range(rng.randrange(1, 9))]
    rows += [(100, t, ("user", "assistant")[t % 2] if t else "system", "long " * 70) for t in range(90)]
    rows += [(101, 0, "assistant", "x " * 100_000), (None, 1, "user", "q"), (None, 2, "assistant", "a"), (102, 5, "user", "tie"), (102, 5, "assistant", "tie"), (102, 5, "assistant", "tie"), (102, None, "user", "none")]
    return rows


def formatted(role, text) -> str:
    for old, new in (("\\", "\\b"), ("<", "\\l"), ("#", "\\h")):
        role, text = (role or "").replace(old, new), (text or "").replace(old, new)
    return f"### {role.replace(':', chr(92) + 'c')}: {text}</turn>\n"


@pytest.mark.parametrize("budget", [200, 4096])
def test_odd_rows_masks_and_budgets(spark, monkeypatch, budget):
    """No window is over its budget; every turn stands once outside the contexts; every assistant's text is a target once."""
    monkeypatch.setattr(chat, "BLOCK", 7)
    rows = hard_rows()
    w = chat.windows(spark.createDataFrame([(*r, "x", 0) for r in rows], SCHEMA), budget)
    assert result(chat.read(w)) == expected(rows)
    by: dict = {}
    for r in w.orderBy("window").collect():
        by.setdefault(r["conv_id"], []).append(r)
        assert len(r["text"].encode()) <= budget
    turns: dict = {}
    for c, t, role, x in sorted(rows, key=lambda r: (r[0] or 0, r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        turns.setdefault(c, []).append((role, x))
    for c, found in by.items():
        assert "".join(r["text"][r["context"] :] for r in found) == "".join(formatted(*t) for t in turns[c])
        told, at = "".join(r["text"][x["begin"] : x["begin"] + x["length"]] for r in found for x in r["loss"]), 0
        assert told == "".join(formatted("", x)[len("### : ") : -len("</turn>\n")] for role, x in turns[c] if role == "assistant")
        assert all(x["begin"] >= r["context"] for r in found for x in r["loss"])
    if budget == 4096:
        whole = by[100]
        assert len(whole) > 5 and all(r["text"].startswith("### system: ") for r in whole)
        for r in whole[1:]:
            own = r["text"][r["context"] :].split("</turn>\n")[:-1]
            assert 1 <= len(own) <= 2048 // 366 and 1 <= r["text"][: r["context"]].count("</turn>") <= 3 and len(r["loss"]) == sum(x.startswith("### assistant: ") for x in own)
        assert [len(r["text"][r["context"] :]) for r in by[101]][:-1] == [2048] * (len(by[101]) - 1)


def test_empty_table(spark):
    assert chat.read(chat.windows(spark.createDataFrame([], SCHEMA))).count() == 0


def test_no_python_in_the_plan(spark):
    w = chat.windows(spark.createDataFrame([(1, 1, "user", "a", "", 0)], SCHEMA))
    plan = chat.read(w)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
