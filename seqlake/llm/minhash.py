"""Near-duplicate groups: universal hash minima, banding, verification, connected components.

1. Each text gets a digest of its words, its number of distinct five-word shingles, and
   BANDS * ROWS minima of multiply-shift hashes of those shingles. Texts of equal words
   become one representative.
2. Representatives that agree on a band's minima share a bucket. In a bucket of at most
   ``BUCKET`` members, signatures are compared and a spanning forest of the pairs whose
   estimate is not far below the threshold is kept. A larger one is linked whole to its first
   member, unless the signatures of most of its members disagree with that one's: then those
   that agree are linked, and the bucket is dealt again by its band and each other band, as
   pairs of similar texts agree on a second band too; what is still larger then is linked
   whole. So texts that share a band and little else fall apart at once, and copies stay
   together, at a cost in proportion to the bucket.
3. The candidate links themselves are checked on full shingle sets, a hub's text meeting its
   neighbours' in parts of ``HUB``. Components of these links are classes.
4. In a candidate group of several classes the pairs of different classes are compared by an
   exact prefix filter: of a pair at the threshold, the rarest shingles of both sets have one
   in common. Groups of at most ``BLOCK`` members are filtered in memory, many to a task. In a
   larger one each shingle is a row, and members whose rare shingles meet are checked as in 3,
   if that gives at most ``MEETINGS`` pairs a member: as with texts of one template. Where rare
   shingles are common too, as in a group of copies each a little different, members of the
   largest class and of all others are cut into blocks, and each pair of blocks that holds a
   minor one is a task of its own. Both ways are exact, and no task grows with the group.
5. Components of all confirmed links are the result.

A pair at the threshold of 0.85 is missed by all bands with probability (1 - 0.85**6)**24,
about 1e-5, if no third text connects it, and with about 2e-4 where one of its bands is a
larger bucket that is dealt again.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window, functions as F

from seqlake.llm.graph import components
from seqlake.llm.shared import settled, ship, table
from seqlake.llm.words import batches, mix, shingle_sets

BANDS, ROWS, BUCKET, HUB, BLOCK = 24, 6, 1024, 256, 256
#: Standard deviations of the estimate that a pair may lie below the threshold before the signature check drops it.
SLACK = 4.5
SIGNED = "doc_id long, hash long, digest binary, n_shingles long, bands array<long>, sketch binary"


def _multipliers(n: int) -> np.ndarray:
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def minima(values: np.ndarray, counts: np.ndarray, hashes: int) -> np.ndarray:
    """For each text (its number of values in ``counts``, all over 0) the least of each hash's 32 bits."""
    mult = _multipliers(2 * hashes)
    starts = np.cumsum(counts) - counts
    out = np.empty((len(counts), hashes), np.uint32)
    for k in range(hashes):
        h = values * mult[k]
        h += mult[hashes + k]
        h >>= np.uint64(32)
        out[:, k] = np.minimum.reduceat(h, starts)
    return out


def sign(frames):
    """Arrow batches of (doc_id, hash of the text, text) to SIGNED."""
    import pyarrow as pa

    for b in frames:
        ids, hashed, text = b.column(0), b.column(1), b.column(2).cast(pa.large_binary())
        for lo, hi in batches(text):
            values, n, h, words = shingle_sets(text.slice(lo, hi - lo).to_pylist())
            has = np.flatnonzero(n)
            ends = np.cumsum(words)
            digest: list = [None] * (hi - lo)
            up = mix(np.arange(1, len(h) + 1, dtype=np.uint64))
            if len(has):
                sig = minima(values, n[has], BANDS * ROWS)
                band = np.zeros((len(has), BANDS), np.uint64)
                for r in range(ROWS):
                    band = mix(band + sig[:, r::ROWS].astype(np.uint64) + np.uint64(r + 1))
                band = band.view(np.int64)
                small = (sig & np.uint32(255)).astype(np.uint8)
            bands: list = [None] * (hi - lo)
            sketch: list = [None] * (hi - lo)
            for j, i in enumerate(has):
                w = h[ends[i] - words[i] : ends[i]]
                digest[i] = (w * up[: len(w)]).sum(dtype=np.uint64).tobytes() + mix(w + up[: len(w)]).sum(dtype=np.uint64).tobytes() + len(w).to_bytes(6, "little")
                bands[i] = band[j]
                sketch[i] = small[j].tobytes()
            yield pa.RecordBatch.from_arrays(
                [ids.slice(lo, hi - lo).cast(pa.int64()), hashed.slice(lo, hi - lo), pa.array(digest, pa.binary()), pa.array(n, pa.int64()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
                ["doc_id", "hash", "digest", "n_shingles", "bands", "sketch"],
            )


class Forest:
    """Disjoint sets of hashable items."""

    def __init__(self):
        self.up: dict = {}

    def find(self, x):
        root = x
        while (p := self.up.get(root, root)) != root:
            root = p
        while (p := self.up.get(x, x)) != root:
            self.up[x] = root
            x = p
        return root

    def join(self, a, b) -> bool:
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        self.up[max(a, b)] = min(a, b)
        return True


def groups(frames, keys: int):
    """Arrow batches sorted by their first ``keys`` columns to (key, table of the group), one group in memory."""
    import pyarrow as pa

    held, at = [], None
    for b in frames:
        if not b.num_rows:
            continue
        columns = [b.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(b.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), b.num_rows]
        for lo, hi in zip(cuts, cuts[1:]):
            key = tuple(c[lo] for c in columns)
            if key != at and held:
                yield at, pa.Table.from_batches(held)
                held = []
            at = key
            held.append(b.slice(lo, hi - lo))
    if held:
        yield at, pa.Table.from_batches(held)


def _bucket_links(least: float):
    def run(frames):
        """(band, hash, id, sketch) by bucket: a spanning forest of the pairs whose signatures agree enough."""
        import pyarrow as pa

        for _, t in groups(frames, 2):
            ids = t.column(2).to_numpy()
            sig = np.frombuffer(b"".join(t.column(3).to_pylist()), np.uint8).reshape(len(ids), -1)
            need = least * sig.shape[1]
            group, todo, a, b = np.arange(len(ids)), range(len(ids)), [], []
            for i in todo:
                other = np.flatnonzero(group[i + 1 :] != group[i]) + i + 1
                if not len(other):
                    continue
                close = other[(sig[other] == sig[i]).sum(1) >= need]
                for g in np.unique(group[close]):
                    j = close[group[close] == g][0]
                    a.append(ids[i])
                    b.append(ids[j])
                    group[group == g] = group[i]
            if a:
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    return run


def confirm(sets: list, ids: list, percent: int, forest: Forest, left: set | None = None) -> list[tuple[int, int]]:
    """Links (a, b) with 100 * intersection >= percent * union that join what was apart, by an exact prefix filter.

    Of a pair, the ``percent`` share of the larger set must be common, so among the rarest
    ``size - ceil(percent * size / 100) + 1`` shingles of each there is a common one.
    With ``left``, pairs on one side of it are another task's.
    """
    if len(sets) < 2:
        return []
    flat, counts = np.concatenate(sets), np.array([len(s) for s in sets])
    uniq, inverse, freq = np.unique(flat, return_inverse=True, return_counts=True)
    ends = np.cumsum(counts)
    found, index = [], {}
    order = sorted(range(len(sets)), key=lambda i: (counts[i], ids[i]))
    for i in order:
        own, n = inverse[ends[i] - counts[i] : ends[i]], int(counts[i])
        keep = n - -(-percent * n // 100) + 1
        rare = own[np.lexsort((own, freq[own]))[:keep]]
        rare = rare[freq[rare] > 1].tolist()
        seen = set()
        for token in rare:
            for j in index.get(token, ()):
                if j in seen:
                    continue
                seen.add(j)
                m = int(counts[j])
                if m * 100 < percent * n or left is not None and (ids[i] in left) == (ids[j] in left) or forest.find(ids[i]) == forest.find(ids[j]):
                    continue
                other = inverse[ends[j] - m : ends[j]]
                both = m + n - len(np.unique(np.concatenate((own, other))))
                if 100 * both >= percent * (m + n - both):
                    forest.join(ids[i], ids[j])
                    found.append((ids[i], ids[j]))
            index.setdefault(token, []).append(i)
    return found


def _check(percent: int):
    def run(frames):
        """(hub, part, side, id, text), sorted, a hub's own text before its part's neighbours: the links that hold."""
        import pyarrow as pa

        own = None
        for b in frames:
            text = b.column(4).cast(pa.large_binary())
            side, hubs, ids = (b.column(i).to_numpy(zero_copy_only=False) for i in (2, 0, 3))
            found: list = []
            for lo, hi in batches(text):
                values, n, _, _ = shingle_sets(text.slice(lo, hi - lo).to_pylist())
                ends = np.cumsum(n)
                for i in range(lo, hi):
                    other = values[ends[i - lo] - n[i - lo] : ends[i - lo]]
                    if side[i] == 0:
                        own = other.copy()
                        continue
                    both = int((own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other).sum())
                    if 100 * both >= percent * (len(own) + len(other) - both):
                        found.append((hubs[i], ids[i]))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def direct(links: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """Those of the links (a, b) that hold on the full sets of ``texts`` (doc_id, text), a row for each; links of one ``a`` are checked together."""
    edges = table(links.select(F.col("a").alias("hub"), F.col("b").alias("id")).distinct(), "spokes")
    parts = table(edges.groupBy("hub").agg(F.ceil(F.count("*") / HUB).cast("int").alias("parts")), "hubs")
    spokes = edges.join(parts, "hub").select("hub", F.pmod(F.xxhash64("id"), F.col("parts")).cast("int").alias("part"), F.lit(1).alias("side"), "id")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("side"), F.col("hub").alias("id"))
    wanted = table(spokes.union(hubs), "wanted")
    rows = wanted.join(texts.withColumnRenamed("doc_id", "id"), "id").select("hub", "part", "side", "id", "text")
    return rows.repartition("hub", "part").sortWithinPartitions("hub", "part", "side").mapInArrow(settled(_check(percent)), "a long, b long")


def _verify(percent: int):
    def run(frames):
        """(part, one, two, component, left, class, id, text) by the first three: links between classes, of which pairs on one side of ``left`` are left out where it is set."""
        import pyarrow as pa

        for _, t in groups(frames, 3):
            comp, left, kind, ids = (t.column(i).to_pylist() for i in (3, 4, 5, 6))
            values, n, _, _ = shingle_sets(t.column(7).cast(pa.large_binary()).to_pylist())
            parts = np.split(values, np.cumsum(n)[:-1])
            by: dict = {}
            for i, c in enumerate(comp):
                by.setdefault(c, []).append(i)
            links = []
            for rows in by.values():
                forest, first = Forest(), {}
                for i in rows:
                    forest.join(first.setdefault(kind[i], ids[i]), ids[i])
                side = {ids[i] for i in rows if left[i]} if left[rows[0]] is not None else None
                links += confirm([parts[i] for i in rows], [ids[i] for i in rows], percent, forest, side)
            if links:
                yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def _exploded(frames):
    """(component, class, id, text) to a row for each distinct shingle: component, class, id, n of the set, shingle."""
    import pyarrow as pa

    for b in frames:
        text = b.column(3).cast(pa.large_binary())
        for lo, hi in batches(text):
            values, n, _, _ = shingle_sets(text.slice(lo, hi - lo).to_pylist())
            of = np.repeat(np.arange(lo, hi), n)
            for at in range(0, len(values), 1 << 18):
                i = of[at : at + (1 << 18)]
                take = pa.array(i)
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(take) for k in range(3)], pa.array(n[i - lo]), pa.array(values[at : at + (1 << 18)].view(np.int64))], ["component", "class", "id", "n", "shingle"])


def rare_shingles(placed: DataFrame, texts: DataFrame, percent: int) -> DataFrame:
    """(component, shingle, id, class, n) of each member's rarest shingles that members of different classes have, and ``of``, how many members have it so.

    Shingles are ordered by how many members of the component (id, component, class) have them,
    so what a component has in common comes last. Two sets that hold have one of these in common, as ``confirm`` says.
    """
    rows = placed.join(texts.withColumnRenamed("doc_id", "id"), "id").select("component", "class", "id", "text")
    e = table(rows.mapInArrow(settled(_exploded), "component long, class long, id long, n long, shingle long"), "shingles")
    often = e.groupBy("component", "shingle").agg(F.count("*").alias("often"), F.min("class").alias("c0"), F.max("class").alias("c1"))
    order = Window.partitionBy("component", "id").orderBy("often", "shingle")
    keep = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    rare = e.join(often, ["component", "shingle"]).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= keep)
    rare = table(rare.where("c0 <> c1").select("component", "shingle", "id", "class", "n"), "rare")
    return rare.join(rare.groupBy("component", "shingle").agg(F.count("*").alias("of")), ["component", "shingle"])


def rare_meetings(rare: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of different classes that have a rare shingle in common and could hold by their sizes."""
    rare = rare.where("of > 1").drop("of")
    other = rare.select("component", "shingle", F.col("id").alias("b"), F.col("class").alias("other"), F.col("n").alias("m"))
    met = rare.join(other, ["component", "shingle"]).where((F.col("id") < F.col("b")) & (F.col("class") != F.col("other")) & (100 * F.least("n", "m") >= percent * F.greatest("n", "m")))
    return met.select(F.col("id").alias("a"), "b").distinct()


#: A group's pairs are made by rare shingles where they give at most so many for each member, in blocks beyond.
MEETINGS = 64


def _classes(comp: DataFrame, classes: DataFrame) -> DataFrame:
    """(id, component, class, size, of, major, most) of the members of groups of several classes."""
    placed = table(comp.join(classes.withColumnRenamed("component", "class"), "id", "left").withColumn("class", F.coalesce("class", "id")), "classes")
    count = placed.groupBy("component", "class").agg(F.count("*").alias("n"))
    stats = count.groupBy("component").agg(F.sum("n").alias("size"), F.count("*").alias("of"), F.max_by("class", F.struct("n", "class")).alias("major"), F.max("n").alias("most")).where("of > 1")
    return table(placed.join(stats, "component"), "placed")


def _in_blocks(d: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between the classes of groups (``_classes``): small groups many to a task, of larger ones each pair of blocks that holds a minor class's members."""
    here = lambda n: F.ceil(F.col(n) / block).cast("int")
    minors, majors = F.greatest(F.ceil((F.col("size") - F.col("most")) / block).cast("int"), F.lit(1)), here("most")
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    own = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    task = lambda kind, one, two, left: F.struct(F.lit(kind).alias("kind"), one.cast("int").alias("one"), two.cast("int").alias("two"), left.cast("boolean").alias("left"))
    o = own(minors)
    among = F.transform(upto(minors), lambda j: task(0, F.least(o, j), F.greatest(o, j), F.when(j != o, o < j)))
    across = F.transform(upto(majors), lambda j: task(1, j, o, F.lit(False)))
    facing = F.transform(upto(minors), lambda j: task(1, own(majors), j, F.lit(True)))
    small = F.array(task(2, F.lit(0), F.lit(0), F.lit(None)))
    tasks = F.when(F.col("size") <= block, small).when(F.col("class") == F.col("major"), facing).otherwise(F.concat(among, across))
    bins = max(16, int(d.sparkSession.conf.get("spark.sql.shuffle.partitions")) * 4)
    rows = d.select("id", "component", "class", F.explode(tasks).alias("t"))
    part = F.when(F.col("t.kind") == 2, -1 - F.pmod(F.xxhash64("component"), F.lit(bins))).otherwise(F.col("component"))
    one = F.col("t.one") * 2 + (F.col("t.kind") == 1).cast("int")
    rows = table(rows.select(part.alias("part"), one.alias("one"), F.col("t.two").alias("two"), "component", F.col("t.left").alias("left"), "class", "id"), "tasks")
    full = rows.join(texts.withColumnRenamed("doc_id", "id"), "id").select("part", "one", "two", "component", "left", "class", "id", "text")
    return full.repartition("part", "one", "two").sortWithinPartitions("part", "one", "two").mapInArrow(settled(_verify(percent)), "a long, b long")


def between(comp: DataFrame, classes: DataFrame, texts: DataFrame, percent: int, block: int) -> DataFrame:
    """Links between different classes (id, component) of the same group of ``comp`` (id, component): all that join what is apart."""
    d = _classes(comp, classes)
    large = d.where(F.col("size") > block).select("id", "component", "class", "size")
    if large.isEmpty():
        return _in_blocks(d, texts, percent, block)
    rare = table(rare_shingles(large, texts, percent), "rare-of")
    pairs = rare.groupBy("component", "shingle").agg(F.first("of").alias("of")).groupBy("component").agg(F.sum(F.col("of") * (F.col("of") - 1) / 2).alias("pairs"))
    few = table(large.groupBy("component").agg(F.first("size").alias("size")).join(pairs, "component", "left").where(F.coalesce("pairs", F.lit(0)) <= MEETINGS * F.col("size")).select("component"), "few")
    rest = _in_blocks(d.join(few, "component", "left_anti"), texts, percent, block)
    if few.isEmpty():
        return rest
    return rest.union(direct(rare_meetings(rare.join(few, "component", "left_semi"), percent), texts, percent))


def _agree(least: float):
    def run(frames):
        """(band, hash, hub, id, sketch of the hub, own sketch) with agree: whether the signatures agree enough."""
        import pyarrow as pa

        for b in frames:
            if b.num_rows:
                one, two = (np.frombuffer(b"".join(b.column(i).to_pylist()), np.uint8).reshape(b.num_rows, -1) for i in (4, 5))
                yield pa.RecordBatch.from_arrays([*[b.column(i) for i in range(4)], pa.array((one == two).mean(1) >= least)], ["band", "hash", "hub", "id", "agree"])

    return run


def candidates(reps: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between representatives (doc_id, bands, sketch) whose components are the candidate groups."""
    p = percent / 100
    least = p - SLACK * (p * (1 - p) / (BANDS * ROWS)) ** 0.5
    sketch = reps.select(F.col("doc_id").alias("id"), "sketch")

    def shared(rows: DataFrame, name: str) -> DataFrame:
        found = table(rows.groupBy("band", "hash").agg(F.count("*").alias("n"), F.min("id").alias("hub")).where("n > 1"), "buckets")
        return table(rows.join(found, ["band", "hash"]), name)

    def forest(member: DataFrame) -> DataFrame:
        small = member.where(f"n <= {BUCKET}").select("band", "hash", "id").join(sketch, "id")
        return small.select("band", "hash", "id", "sketch").repartition("band", "hash").sortWithinPartitions("band", "hash", "id").mapInArrow(_bucket_links(least), "a long, b long")

    member = shared(reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band", "hash")), "members")
    large = member.where(f"n > {BUCKET}").select("band", "hash", "hub", "id")
    if large.isEmpty():
        return forest(member)
    of_hub = large.select("hub").distinct().join(sketch.withColumnRenamed("id", "hub"), "hub").withColumnRenamed("sketch", "hub_sketch")
    judged = large.join(of_hub, "hub").join(sketch, "id").select("band", "hash", "hub", "id", "hub_sketch", "sketch")
    judged = table(judged.mapInArrow(_agree(least), "band int, hash long, hub long, id long, agree boolean"), "judged")
    unlike = judged.groupBy("band", "hash").agg(F.count_if(~F.col("agree")).alias("others"), F.count("*").alias("n")).where("2 * others > n").select("band", "hash")
    # Copies with a few others among them stay together; of a bucket that mostly differs, the pairs that matter agree on a second band too.
    links = forest(member).union(judged.join(unlike, ["band", "hash"], "left_anti").where("id <> hub").select("hub", "id"))
    again = judged.join(unlike, ["band", "hash"], "left_semi")
    links = links.union(again.where("agree and id <> hub").select("hub", "id"))
    again = again.select("id", "band", "hash").join(reps.select(F.col("doc_id").alias("id"), F.posexplode("bands").alias("band2", "hash2")), "id").where("band <> band2")
    one, two = F.least(F.struct("band", "hash"), F.struct(F.col("band2").alias("band"), F.col("hash2").alias("hash"))), F.greatest(F.struct("band", "hash"), F.struct(F.col("band2").alias("band"), F.col("hash2").alias("hash")))
    again = shared(again.select("id", (F.lit(-1) - one["band"] * BANDS - two["band"]).alias("band"), F.xxhash64(one, two).alias("hash")).distinct(), "again")
    return links.union(forest(again)).union(again.where(f"n > {BUCKET} and id <> hub").select("hub", "id"))


def grouped(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """``near_duplicates`` with ``hash``, of the text: it tells rows of one doc_id with different texts apart."""
    ship(docs.sparkSession)
    d = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).withColumn("hash", F.xxhash64("text"))
    signed = table(d.select("doc_id", "hash", "text").mapInArrow(settled(sign), SIGNED), "signed")
    named = signed.where("digest is not null and doc_id is not null")
    # A text's node is a hash of its digest; its representative row is the first of those with equal words.
    alike = table(named.groupBy("digest").agg(F.min(F.struct("doc_id", "hash")).alias("rep")).select("digest", F.xxhash64("digest").alias("node"), "rep.doc_id", "rep.hash"), "alike")
    reps = named.join(alike.select("digest", "node", "doc_id", "hash"), ["doc_id", "hash", "digest"])
    reps = table(reps.select(F.col("node").alias("doc_id"), "bands", "sketch"), "reps")
    # Rows that repeat a representative's doc_id and text: where there are none, nothing needs to be sorted for them.
    repeated = not reps.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    once = (lambda x: x.dropDuplicates(["doc_id"])) if repeated else (lambda x: x)
    reps = once(reps)
    links = table(candidates(reps, percent), "candidates")
    comp = table(components(links), "groups")
    wanted = comp.join(alike.withColumnRenamed("node", "id"), "id").select("id", "doc_id", "hash")
    texts = table(once(d.join(wanted, ["doc_id", "hash"]).select(F.col("id").alias("doc_id"), "text")), "texts")
    held = table(direct(links, texts, percent), "held")
    more = table(between(comp, table(components(held), "sure"), texts, percent, block), "more")
    label = table(components(held.union(more)), "labels")
    joined = alike.join(label.withColumnsRenamed({"id": "node", "component": "label"}), "node", "left").withColumn("label", F.coalesce("label", "node"))
    least = table(joined.groupBy("label").agg(F.min("doc_id").alias("component_id")), "least")
    of = table(joined.join(least, "label").select("digest", "component_id"), "named")
    out = signed.select("doc_id", "hash", "n_shingles", "digest").join(of, "digest", "left")
    found = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return out.select("doc_id", "hash", "n_shingles", found.alias("component_id"), F.coalesce(F.col("doc_id") == found, F.lit(True)).alias("kept"))


def near_duplicates(docs: DataFrame, percent: int = 85, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs`` (doc_id, text; other columns are ignored).

    Texts are linked when 100 * |A & B| >= percent * |A | B| for their sets of distinct
    five-word shingles (fewer words: the whole sequence; none: empty, linked with nothing).
    component_id is the smallest doc_id reachable over links. Null and empty texts stand
    alone. Rows that repeat a doc_id with one text are one document, given once for each
    row; rows of one doc_id with different texts are each in their own text's group. A row
    without a doc_id stands alone: its component is null, and it is kept. An empty table gives an empty one.
    """
    return grouped(docs, percent, block).drop("hash")


def unique(docs: DataFrame, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` that stay when each group keeps its document of the smallest doc_id; all columns as they were.

    Rows without a doc_id stay. Of rows that repeat a doc_id and text one stays.
    """
    kept = table(grouped(docs, percent).where("kept and doc_id is not null").groupBy("doc_id", "hash").agg(F.count("*").alias("n")), "kept")
    d = docs.withColumns({"_id": docs["doc_id"].cast("long"), "_hash": F.xxhash64(docs["text"].cast("string"))})
    k = kept.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "n")
    once = d.join(k.where("n = 1"), ["_id", "_hash"], "left_semi").select(*docs.columns)
    once = once.unionByName(docs.where("doc_id is null"))
    several = k.where("n > 1")
    if several.isEmpty():
        return once
    return once.unionByName(d.join(several, ["_id", "_hash"], "left_semi").dropDuplicates(["_id", "_hash"]).select(*docs.columns))
