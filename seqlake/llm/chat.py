r"""Conversations as budgeted windows of formatted turns with loss masks.

A turn is ``### role: text</turn>`` and a line break. Inside roles and texts ``\`` becomes
``\b``, ``<`` ``\l``, ``#`` ``\h``, and in roles ``:`` ``\c``, so no text can hold a control
string, and the reader gets back exactly what went in.

Tokens are those of a byte vocabulary: the UTF-8 bytes of the formatted turn, of which any
byte-level BPE gives no more. Half of a window's budget is for its span, a quarter each for
the system turn and for history. Prefix sums of the turns' tokens choose the spans: cells of
that half follow one another along the conversation, the turns inside a cell are a span, and
a turn that crosses a cell's end is a span of its own. So spans are aligned to turns and hold
no more than their half. Only a turn that is longer than that is cut, into parts that are a
span each. A window is the conversation's opening system turn, the last few turns before the
span (both repeated, and masked), and the span itself, whose assistant texts are the targets:
every turn, or every part of one, is a target at most once.

Everything is DataFrame expressions. Sums run by (conversation, block of turn numbers), and
turns that are history for a window are found by their index, so no conversation, however
long, is one task; only a window's own turns are ever gathered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqlake.llm.shared import table

ROLE, SEP, END = "### ", ": ", "</turn>\n"
#: Turn numbers of a block, whose turns are sorted in one task.
BLOCK = 4096
_TEXT = (("\\", "\\b"), ("<", "\\l"), ("#", "\\h"))
_NAME = (*_TEXT, (":", "\\c"))


def _replaced(c: Column, pairs) -> Column:
    for old, new in pairs:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def escape(c: Column) -> Column:
    return _replaced(c, _TEXT)


def unescape(c: Column) -> Column:
    return _replaced(c, [(n, o) for o, n in reversed(_NAME)])


def _turns(conversations: DataFrame, most: int) -> DataFrame:
    """Every turn: conv_id, its formatted text f, begin and length of its target there, how many parts of how many characters it has, the tokens and parts before it in its conversation."""
    c = conversations.select(
        conversations["conv_id"].cast("long").alias("conv_id"), conversations["turn"].cast("long").alias("turn"),
        F.coalesce(conversations["role"].cast("string"), F.lit("")).alias("role"), F.coalesce(conversations["text"].cast("string"), F.lit("")).alias("text"),
    )
    head, body = F.concat(F.lit(ROLE), _replaced(F.col("role"), _NAME), F.lit(SEP)), escape(F.col("text"))
    t = c.select("*", head.alias("head"), body.alias("body")).withColumn("f", F.concat("head", "body", F.lit(END)))
    n = F.octet_length("f").cast("long")
    wide = F.when(n == F.length("f"), F.lit(most)).otherwise(F.lit(most // 4))  # characters that surely fit
    t = t.withColumn("wide", wide).withColumn("parts", F.when(n <= most, F.lit(1)).otherwise(F.ceil(F.length("f") / F.col("wide"))).cast("long"))
    t = t.withColumn("n", F.when(n <= most, n).otherwise(F.col("parts") * most))  # a part counts as a whole cell
    t = t.withColumn("block", F.floor(F.col("turn") / BLOCK))
    block = t.groupBy("conv_id", "block").agg(F.sum("n").alias("_n"), F.sum("parts").alias("_p"))
    along = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    block = block.select("conv_id", "block", F.coalesce(F.sum("_n").over(along), zero).alias("_n"), F.coalesce(F.sum("_p").over(along), zero).alias("_p"))
    inside = Window.partitionBy("conv_id", "block").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumns({"before": F.coalesce(F.sum("n").over(inside), zero), "i": F.coalesce(F.sum("parts").over(inside), zero)})
    b = block.withColumnsRenamed({"conv_id": "_c", "block": "_b"})
    t = t.join(b, t["conv_id"].eqNullSafe(b["_c"]) & t["block"].eqNullSafe(b["_b"]))
    target = F.col("role") == "assistant"
    return t.select(
        "conv_id", "f", "wide", "parts", "n", (F.col("before") + F.col("_n")).alias("before"), (F.col("i") + F.col("_p")).alias("i"), (F.col("role") == "system").alias("system"),
        F.when(target, F.length("head")).alias("begin"), F.when(target, F.length("body")).alias("length"),
    )


def windows(conversations: DataFrame, budget: int = 4096, history_turns: int = 2) -> DataFrame:
    """(conv_id, window, context, text, loss) of every conversation (conv_id, turn, role, text).

    No window has more than ``budget`` tokens. Its first ``context`` characters are repeated:
    the system turn, if the conversation opens with one, and at most ``history_turns`` turns, or parts
    of one, before the span. A system turn or a history beyond a quarter of the budget is
    repeated only so far, the system turn from its start and closed, of the history the last turns that fit whole.
    ``loss`` has begin (from 0) and length in characters of each target, the escaped text of
    an assistant's turn or what a part holds of it. The windows of a conversation without their
    contexts, one after another, are all its turns, each once.
    Null roles and texts are empty. Rows of equal turn stand in order of role and text, and
    repeated rows are turns of their own; null turns come first. Null conv_id is a conversation. No rows: no windows.
    """
    cell, other = budget // 2, budget // 4
    if other // 4 <= len(END):
        raise ValueError("the budget must leave room for a turn's marks")
    t = table(_turns(conversations, cell), "turns")
    part = F.when(F.col("parts") == 1, F.array(F.lit(0).cast("long"))).otherwise(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))
    u = t.withColumn("k", F.explode(part))
    cut = F.when(F.col("parts") == 1, F.col("f")).otherwise(F.substr("f", (F.col("k") * F.col("wide") + 1).cast("int"), F.col("wide")))
    lo, hi = F.greatest(F.col("begin") - F.col("k") * F.col("wide"), F.lit(0)), F.least(F.col("begin") + F.col("length") - F.col("k") * F.col("wide"), F.col("wide"))
    whole, holds = F.col("parts") == 1, F.col("begin").isNotNull() & (hi > lo)
    size = F.when(whole, F.col("n")).otherwise(F.lit(cell).cast("long"))
    at = F.col("before") + F.col("k") * cell
    begins, ends = F.floor(at / cell), F.floor((at + size - 1) / cell)
    u = u.select(
        "conv_id", (F.col("i") + F.col("k")).alias("i"), (2 * begins + (ends > begins).cast("long")).alias("window"), cut.alias("f"),
        F.when(whole, F.col("begin")).otherwise(F.when(holds, lo)).cast("int").alias("begin"), F.when(whole, F.col("length")).otherwise(F.when(holds, hi - lo)).cast("int").alias("length"),
    )
    spans = u.groupBy("conv_id", "window").agg(F.min("i").alias("first"))
    none = [F.lit(None).cast("int").alias(c) for c in ("begin", "length")]
    back = spans.select("conv_id", "window", F.explode(F.sequence(F.lit(1), F.lit(max(1, history_turns)))).alias("back"), "first").where((F.col("back") <= F.col("first")) & (F.col("back") <= history_turns))
    back = back.select(F.col("conv_id").alias("_c"), F.col("window").alias("_w"), (F.col("first") - F.col("back")).alias("_i"), "back")
    past = u.join(back, u["conv_id"].eqNullSafe(back["_c"]) & (u["i"] == back["_i"])).select("conv_id", F.col("_w").alias("window"), "back", "i", "f")
    sums = F.sum(F.octet_length("f")).over(Window.partitionBy("conv_id", "window").orderBy("back"))
    opening = t.where("i = 0 and system").select(F.col("conv_id").alias("_c"), F.col("f").alias("_f"))
    marked = F.substr("_f", F.lit(1), F.lit(other // 4 - len(END)))
    opening = opening.select("_c", F.when(F.octet_length("_f") <= other, F.col("_f")).otherwise(F.concat(F.regexp_replace(marked, r"\\$", ""), F.lit(END))).alias("_f"))
    system = spans.where("first > 0").join(opening, F.col("conv_id").eqNullSafe(F.col("_c"))).select("conv_id", "window", F.lit(-1).cast("long").alias("i"), F.lit(True).alias("again"), F.col("_f").alias("f"), *none)
    # The system turn itself is not history: it is there already.
    opens = opening.select("_c", F.lit(True).alias("_open"))
    past = past.withColumn("sum", sums).where(F.col("sum") <= other).join(opens, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("i") == 0), "left").where("_open is null")
    past = past.select("conv_id", "window", "i", F.lit(True).alias("again"), "f", *none)
    own = u.select("conv_id", "window", "i", F.lit(False).alias("again"), "f", "begin", "length")
    rows = own.union(past).union(system).groupBy("conv_id", "window").agg(F.sort_array(F.collect_list(F.struct("i", "again", "f", "begin", "length"))).alias("all"))
    start = F.aggregate("all", F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("at")), lambda a, x: F.struct((a["sum"] + F.length(x["f"])).alias("sum"), F.concat(a["at"], F.array(a["sum"])).alias("at")), lambda a: a["at"])
    rows = rows.withColumn("at", start)
    spans = F.transform("all", lambda x, i: F.struct((F.get(F.col("at"), i) + x["begin"]).alias("begin"), x["length"].alias("length")))
    context = F.aggregate(F.filter("all", lambda x: x["again"]), F.lit(0), lambda a, x: a + F.length(x["f"]))
    return rows.select("conv_id", "window", context.alias("context"), F.array_join(F.transform("all", lambda x: x["f"]), "").alias("text"), F.filter(spans, lambda x: x["begin"].isNotNull()).alias("loss"))


def read(formatted: DataFrame) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars), from windows as they were written.

    The digests are of a whole conversation, so each is one row here, as long as its texts.
    """
    own = F.substr("text", F.col("context") + 1)
    learned = F.array_join(F.transform("loss", lambda x: F.substr(F.col("text"), x["begin"] + 1, x["length"])), "")
    rows = formatted.select("conv_id", "window", own.alias("own"), learned.alias("learned"), F.length("text").cast("long").alias("chars"))
    g = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("window", "own", "learned"))).alias("w"), F.sum("chars").alias("formatted_chars"))
    joined = lambda c: F.array_join(F.transform("w", lambda x: x[c]), "")
    parts = F.split("turns", F.lit(END), -1)
    role = lambda x: F.substring_index(F.substr(x, F.lit(len(ROLE) + 1)), SEP, 1)
    back = F.transform(F.slice("parts", 1, F.size("parts") - 1), lambda x: F.concat(unescape(role(x)), F.lit("\n"), unescape(F.substr(x, F.length(role(x)) + (len(ROLE) + len(SEP) + 1))), F.lit("\n")))
    g = g.select("conv_id", "formatted_chars", joined("own").alias("turns"), unescape(joined("learned")).alias("learned")).withColumn("parts", parts)
    return g.select("conv_id", (F.size("parts") - 1).cast("long").alias("n_turns"), F.sha2(F.array_join(back, ""), 256).alias("turns_sha256"), F.length("learned").cast("long").alias("loss_chars"), F.sha2("learned", 256).alias("loss_sha256"), "formatted_chars")
