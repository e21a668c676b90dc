"""Mixing sources to target weights with a multivariate-hypergeometric splitting tree.

A document's place in its source is a hash of its id, so the source's documents, in that
order, are a random permutation. The words a source must give are whole passes over it and
a last, partial one: the documents whose place is below a cut. The cut is found by
histograms of words by place, each refining the bin that the one before ended in, so no
source, however large, is sorted or gathered. A document at the cut that is too long for
what is missing is left out, and the places after it are cut in the same way.

Passes are cut into blocks of places, of about as many words in every source. The blocks a
source gives are its quota. Recursive halving deals the quotas among output shards: at each
node the left half's share of every source's blocks is drawn from the multivariate
hypergeometric distribution, until each leaf, a shard, has an exact number of blocks of each
source. Shards take disjoint runs of a source's permuted blocks, and rows of a shard are
shuffled by a second hash. What the mix takes is what these blocks hold: a block that the
tree deals to no shard would be in no output.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from seqlake.llm.shared import table

#: Places are integers below 2**PLACE_BITS; each histogram refines LEVEL_BITS of them.
PLACE_BITS, LEVEL_BITS = 40, 10
#: Words of a shard, blocks that a shard draws on average, and the most shards (a shard of 100 TB is then a task's 1.5 GB, sorted with spill).
SHARD_WORDS, BLOCKS_PER_SHARD, MOST_SHARDS = 1 << 22, 16, 1 << 16
#: What a cut leaves is filled while it is above this share of the partial pass.
FILL_ABOVE = 0.002
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    """Number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def targets(sizes: dict[str | None, int], most: float = 3.0) -> dict[str | None, float]:
    """Words each source gives: the total shared by weights 1, 2, 3, repeating, in order of code points, null last.

    A target stops at ``most`` times its source's size; what is over is shared among the
    others by weight until none is above.
    """
    order = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: float(i % 3 + 1) for i, s in enumerate(order)}
    got: dict = {}
    left, free = float(sum(sizes.values())), list(order)
    while free:
        unit = left / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not over:
            return got | {s: weight[s] * unit for s in free}
        for s in over:
            got[s] = most * sizes[s]
            left -= got[s]
        free = [s for s in free if s not in over]
    return got


def split_quotas(blocks: np.ndarray, shards: int, seed: int) -> np.ndarray:
    """(source x shard) numbers of blocks: every source's blocks dealt without replacement, shards as even as they can be.

    All blocks together must be fewer than 10**9, as the generator asks; ``mix`` makes about
    BLOCKS_PER_SHARD * MOST_SHARDS at most.
    """
    rng = np.random.default_rng(seed)
    out = np.zeros((len(blocks), shards), np.int64)
    todo = [(np.asarray(blocks, np.int64), 0, shards)]
    while todo:
        have, lo, hi = todo.pop()
        if hi - lo == 1:
            out[:, lo] = have
            continue
        mid = (lo + hi) // 2
        take = int(have.sum()) * (mid - lo) // (hi - lo)
        left = rng.multivariate_hypergeometric(have, take, method="marginals") if len(have) else have
        todo += [(have - left, mid, hi), (left, lo, mid)]
    return out


def sized(docs: DataFrame, seed: int) -> DataFrame:
    """``docs`` with _size and _place."""
    place = F.shiftrightunsigned(F.xxhash64(docs["doc_id"], F.lit(seed)), 64 - PLACE_BITS)
    return docs.withColumn("_size", size_of(docs["text"])).withColumn("_place", place)


def _joined(rows: DataFrame, kinds: str, values: dict) -> DataFrame:
    """``rows`` with a source's values, {source: (value, ...)}, in columns named and typed by ``kinds``; null for a source without.

    The joined side has a row for each source, as the driver holds it, whatever the data's size.
    """
    small = rows.sparkSession.createDataFrame([(s, *v) for s, v in values.items()], f"_s string, {kinds}")
    return rows.join(F.broadcast(small), rows["source"].eqNullSafe(small["_s"]), "left").drop("_s")


def _below(rows: DataFrame, last: dict) -> dict:
    """Of each source of ``last`` (words): the highest place below which its rows hold no more than that, and their words."""
    state = {s: (0, 0.0) for s, w in last.items() if w > 0}  # source: prefix of the place, words below it
    for depth in range(1, PLACE_BITS // LEVEL_BITS + 1 if state else 1):
        shift = PLACE_BITS - depth * LEVEL_BITS
        inside = _joined(rows, "_prefix long", {s: (prefix,) for s, (prefix, _) in state.items()}).where(F.shiftright("_place", shift + LEVEL_BITS) == F.col("_prefix"))
        hist: dict = {}
        for s, b, w in inside.groupBy("source", F.shiftright("_place", shift).alias("b")).agg(F.sum("_size").alias("w")).collect():
            hist.setdefault(s, []).append((b, w))
        for s, (prefix, below) in state.items():
            at, got = ((prefix + 1) << LEVEL_BITS) - 1, below
            for b, w in sorted(hist.get(s, [])):
                if got + w > last[s]:
                    at = b
                    break
                got += w
            state[s] = (at, got)
    return state


def _cut(rows: DataFrame, last: dict) -> tuple[dict, dict, dict]:
    """Of each source of ``last`` (words of its partial pass): the cut, the places of single
    documents that fill the rest, and further runs of places, [(from, to, most words of a document)].

    Each round at least halves what is missing: by the largest document that fits, if it is
    half of that, else by a cut over the places that follow, among all documents that fit.
    """
    state = _below(rows, last)
    fill: dict = {s: [] for s in state}
    runs: dict = {s: [] for s in state}
    need = {s: last[s] - got for s, (_, got) in state.items()}
    cut = {s: p for s, (p, _) in state.items()}
    after = {s: p + 1 for s, p in cut.items()}  # the document at a cut is longer than what is missing
    while short := {s: n for s, n in need.items() if n >= 1 and n > FILL_ABOVE * last[s]}:
        free = _joined(rows, f"_cut long, _need double, {_FILLS}", {s: (cut[s], short[s], fill[s], runs[s]) for s in short})
        free = free.where((F.col("_place") >= F.col("_cut")) & (F.col("_size") > 0) & (F.col("_size") < 2 * F.col("_need")) & ~_filled())
        fits = F.col("_size") <= F.col("_need")  # the largest that fits, else the smallest that overshoots by less than is missing
        best = F.max(F.struct(fits, F.when(fits, F.col("_size")).otherwise(-F.col("_size")), "_place", F.col("_size").alias("w")))
        got = {s: m for s, m in free.groupBy("source").agg(best.alias("m")).collect()}
        many = {}
        for s in short:
            if s not in got:
                need[s] = 0
            elif 2 * got[s]["w"] >= need[s]:
                fill[s].append(got[s]["_place"])
                need[s] -= got[s]["w"]
            else:
                many[s] = got[s]["w"]
        if many:
            rest = _joined(rows, "_after long, _most long", {s: (after[s], m) for s, m in many.items()})
            rest = rest.where((F.col("_place") >= F.col("_after")) & (F.col("_size") <= F.col("_most"))).select("source", "_size", "_place")
            for s, (p, w) in _below(rest, {s: need[s] for s in many}).items():
                runs[s].append((after[s], p, many[s]))
                need[s] = need[s] - w if w else 0
                after[s] = p + 1
    return cut, fill, runs


_FILLS = "_fill array<long>, _runs array<struct<lo: long, hi: long, most: long>>"


def _filled() -> Column:
    """Whether a row with _place, _size and its source's _fill and _runs is one of those that fill what the first cut leaves."""
    single = F.array_contains("_fill", F.col("_place"))
    return F.coalesce(single | F.exists("_runs", lambda r: (F.col("_place") >= r["lo"]) & (F.col("_place") < r["hi"]) & (F.col("_size") <= r["most"])), F.lit(False))


class Plan:
    """What each source gives: words, target, whole passes, the cut of the partial pass, places and runs of places that fill it, blocks of a pass and of the partial one, and every block's shard."""

    def __init__(self, docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 11):
        self.seed = seed
        rows = table(sized(docs, seed).select("source", "_size", "_place"), "sizes")  # the other scans are of this table
        self.words = {s: int(w) for s, w in rows.groupBy("source").agg(F.sum("_size")).collect()}
        self.target = targets(self.words)
        self.passes, last = {}, {}
        for s, n in self.words.items():
            self.passes[s] = int(self.target[s] // n) if n else 0
            last[s] = self.target[s] - self.passes[s] * n if n else 0.0
            if n and last[s] < 1e-9 * n:
                last[s] = 0.0
        self.cut, self.fill, self.runs = _cut(rows, last)
        total = sum(self.words.values())
        self.shards = shards or min(max(1, -(-total // SHARD_WORDS)), MOST_SHARDS)
        each = max(1, total // (self.shards * BLOCKS_PER_SHARD))  # words of a block
        self.blocks = {s: blocks or max(BLOCKS_PER_SHARD, -(-n // each)) for s, n in self.words.items()}
        self.partial = {s: max(-(-self.cut.get(s, 0) * b >> PLACE_BITS), int(bool(self.fill.get(s) or self.runs.get(s)))) for s, b in self.blocks.items()}
        names = sorted(self.words, key=lambda s: (s is None, s or ""))
        quota = split_quotas(np.array([self.passes[s] * self.blocks[s] + self.partial[s] for s in names], np.int64), self.shards, seed)
        rng = np.random.default_rng(seed + 1)
        self.shard = {s: rng.permutation(np.repeat(np.arange(self.shards), q)) for s, q in zip(names, quota)}

    def drawn(self, docs: DataFrame) -> DataFrame:
        """``docs`` with _block, an array of the blocks that hold each document, and _dealt, the shard of each of its source's blocks."""
        d = sized(docs, self.seed)
        kinds = f"_cut long, {_FILLS}, _passes int, _blocks long, _partial long, _dealt array<int>"
        d = _joined(d, kinds, {s: (self.cut.get(s, 0), self.fill.get(s, []), self.runs.get(s, []), self.passes[s], self.blocks[s], self.partial[s], self.shard[s].tolist()) for s in self.words})
        at = F.shiftright(F.col("_place") * F.col("_blocks"), PLACE_BITS)
        base = F.col("_passes") * F.col("_blocks")
        last = F.when(F.col("_place") < F.col("_cut"), base + at).when(_filled(), base + F.pmod(F.col("_place"), F.col("_partial")))
        whole = F.transform(F.sequence(F.lit(1), F.greatest("_passes", F.lit(1))), lambda k: (k - 1) * F.col("_blocks") + at)
        whole = F.when(F.col("_passes") > 0, whole).otherwise(F.array().cast("array<bigint>"))
        d = d.withColumn("_block", F.concat(whole, F.when(last.isNotNull(), F.array(last)).otherwise(F.array().cast("array<bigint>"))))
        return d.drop("_cut", "_fill", "_runs", "_passes", "_blocks", "_partial", "_place")


def mix(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 11, plan: Plan | None = None) -> DataFrame:
    """The mixed rows: every column of ``docs`` (doc_id, text, source, others), and _shard, _order, _copy.

    A document is there once for each block that a shard draws it in. ``shards`` is one for
    SHARD_WORDS words unless given, ``blocks`` those of a pass. Equal inputs give equal mixes.
    Documents without words follow their place like any other; a source without words gives
    none. A null source is one source, the last; the number of sources is that of the weights,
    so their totals come to the driver. Rows that repeat a doc_id and text are taken together.
    """
    plan = plan or Plan(docs, shards, blocks, seed)
    made = ("_shard", "_order", "_copy")  # columns of these names are replaced
    d = docs.select("doc_id", "text", "source", F.struct(*docs.columns).alias("_all"))
    d = plan.drawn(d).select("*", F.posexplode("_block").alias("_copy", "_b"))
    d = d.withColumn("_shard", F.get("_dealt", F.col("_b").cast("int"))).where("_shard is not null")
    order = F.xxhash64("doc_id", "_copy", F.lit(plan.seed + 2))
    return d.withColumn("_order", order).select(*[F.col("_all")[c].alias(c) for c in docs.columns if c not in made], *made)


def shuffled(mixed: DataFrame, shards: int) -> DataFrame:
    """Mixed rows with every shard in a partition of its own, in its own random order: written as they are, files are shuffled shards.

    Rows are dealt by a number whose hash is the shard's partition, so that no two shards share one.
    """
    home = F.pmod(F.hash(F.col("id").cast("int")), F.lit(shards))
    key = mixed.sparkSession.range(shards * 20).select(home.alias("_home"), F.col("id").cast("int").alias("_id")).groupBy("_home").agg(F.min("_id").alias("_key"))
    rows = mixed.join(F.broadcast(key), mixed["_shard"] == key["_home"], "left").withColumn("_key", F.coalesce("_key", "_shard"))
    return rows.repartition(shards, "_key").sortWithinPartitions("_shard", "_order", "doc_id", "_copy").drop("_key", "_home")


def taken(docs: DataFrame, shards: int | None = None, blocks: int | None = None, seed: int = 11) -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every document, ``taken`` counted in the shards as they were written.

    Rows of one doc_id, source and size are drawn together, so each has its share of their copies.
    """
    d = docs.select("doc_id", "text", "source")
    plan = Plan(d, shards, blocks, seed)
    mixed = mix(d, plan=plan).withColumn("_size", size_of(F.col("text")))
    back = table(shuffled(mixed, plan.shards), "mix")
    key = ["doc_id", "source", "_size"]
    there = d.withColumn("_size", size_of(F.col("text"))).select(*key, F.lit(1).alias("_row"), F.lit(0).alias("_copies"))
    both = there.union(back.select(*key, F.lit(0), F.lit(1))).groupBy(*key).agg(F.sum("_row").alias("_row"), F.sum("_copies").alias("_copies"))
    both = _joined(both, "_words long, _target double", {s: (plan.words[s], plan.target[s]) for s in plan.words})
    out = both.select("doc_id", F.col("_size").alias("size"), F.col("_words").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_copies") / F.col("_row")).cast("long").alias("taken"), F.explode(F.sequence(F.lit(1).cast("long"), "_row")).alias("_n"))
    return out.drop("_n")
