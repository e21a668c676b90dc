"""Joins of delimited tables, intervals, and matrices."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from seqlake.functions import seq as S
from seqlake.operators import chunks

INNER, LEFT, RIGHT, OUTER, ONLY_LEFT, ONLY_RIGHT, EXCEPT = "in", "le", "ri", "ou", "xl", "xr", "ex"


def keyed(df: DataFrame, key: str | Column, numeric: bool = False, unique: bool = False, prefix: str = "") -> DataFrame:
    """``df`` with the join key in ``k``: cast for a numeric order, one row a key, other columns prefixed."""
    k = F.col(key) if isinstance(key, str) else key
    d = df.withColumn("k", k.cast("double") if numeric else k.cast("string"))
    d = d.drop(key) if isinstance(key, str) and key != "k" else d
    d = d.select("k", *[F.col(c).alias(prefix + c) for c in d.columns if c != "k"])
    return d.dropDuplicates(["k"]) if unique else d


def join(a: DataFrame, b: DataFrame, how: str, zip_duplicates: bool = False, order: tuple[str, str] | None = None) -> DataFrame:
    """A join of two ``keyed`` tables.

    in, le, ri, ou: inner, left, right, outer; xl, xr: rows of one side only; ex: of either,
    with ``source`` 1 or 2. With ``zip_duplicates`` the n-th row of a key meets the n-th of the
    other side (in the order of the named columns) instead of all of them.
    """
    on = ["k"]
    if how == ONLY_LEFT:
        return a.join(b, on, "left_anti")
    if how == ONLY_RIGHT:
        return b.join(a, on, "left_anti")
    if how == EXCEPT:
        return a.join(b, on, "left_anti").withColumn("source", F.lit(1)).unionByName(b.join(a, on, "left_anti").withColumn("source", F.lit(2)), allowMissingColumns=True)
    if zip_duplicates:
        number = lambda d, c: d.withColumn("_n", F.row_number().over(Window.partitionBy("k").orderBy(c or d.columns[-1])))
        a, b = number(a, order and order[0]), number(b, order and order[1])
        on = ["k", "_n"]
    out = a.join(b, on, {INNER: "inner", LEFT: "left", RIGHT: "right", OUTER: "full"}[how])
    return out.drop("_n")


def join_many(tables: list[DataFrame], ops: str | list[str] = INNER) -> DataFrame:
    """Tables joined pairwise from the left; ``ops`` may differ from pair to pair. Inner joins are dealt out by what they make, as few keys may have most rows."""
    ops = [ops] * (len(tables) - 1) if isinstance(ops, str) else ops
    return reduce(lambda a, x: join_dealt(a, x[0]) if x[1] == INNER else join(a, x[0], x[1]), zip(tables[1:], ops), tables[0])


#: Rows of either side of a frequent key that meet in one place.
SLICE = 2048


def join_dealt(a: DataFrame, b: DataFrame, size: int = SLICE) -> DataFrame:
    """The inner join of two ``keyed`` tables, in which no key is one task.

    A key that makes more than ``size`` ** 2 rows has its rows of either side cut into slices of about
    ``size``, and each slice of one side meets each of the other's in a place of its own. Such keys are
    fewer than a ``size``-th of the rows.
    """
    n = lambda d, c: d.groupBy("k").agg(F.count("*").alias(c))
    cut = lambda c: F.ceil(F.col(c) / size).alias(c)
    many = F.broadcast(n(a, "_i").join(n(b, "_j"), "k").where(F.col("_i").cast("double") * F.col("_j") > size * size).select("k", cut("_i"), cut("_j")))

    def placed(d: DataFrame, own: str, other: str) -> DataFrame:
        parts = lambda c: F.coalesce(c, F.lit(1).cast("long"))
        x = d.join(many, "k", "left").withColumn(other, F.explode(F.sequence(F.lit(0).cast("long"), parts(other) - 1)))
        # As many partitions as are set: the planner would join small sides in few, however much they make.
        tasks = int(d.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        return x.withColumn(own, F.pmod(F.xxhash64(*[F.col(c) for c in d.columns]), parts(own))).repartition(tasks, "k", "_i", "_j")

    return placed(a, "_i", "_j").hint("merge").join(placed(b, "_j", "_i"), ["k", "_i", "_j"]).drop("_i", "_j")


#: Bins of 2**7, 2**10, ... positions; beyond them one bin of all, as size WHOLE.
SHIFTS, WHOLE = tuple(range(7, 35, 3)), 63


def own_bin(beg: Column, en: Column) -> Column:
    """(shift, bin) of the smallest bin that holds an interval whole: one for each, however long it is."""
    at = F.struct(F.lit(WHOLE).alias("shift"), F.lit(0).cast("long").alias("bin"))
    for s in reversed(SHIFTS):
        inside = F.struct(F.lit(s).alias("shift"), F.shiftright(beg, s).alias("bin"))
        at = F.when(F.shiftright(beg, s) == F.shiftright(en, s), inside).otherwise(at)
    return at


def in_bins(rows: DataFrame, at: str, others: DataFrame, above: Column | None = None) -> DataFrame:
    """``rows`` with _b, a row for (shift, bin) of the position ``at`` at every size of bins that ``others`` (_o, their own bins) have, or those that ``above`` holds for.

    The sizes are a joined table of a few rows: so the planner knows that there are many rows
    more, and never broadcasts them for the file's size.
    """
    sizes = F.broadcast(others.select(F.col("_o.shift").alias("_s")).distinct())
    d = rows.join(sizes, F.lit(True) if above is None else above)
    held = F.when(F.col("_s") == WHOLE, F.lit(0).cast("long")).otherwise(F.call_function("shiftright", F.col(at).cast("long"), F.col("_s")))
    return d.withColumn("_b", F.struct(F.col("_s").alias("shift"), held.alias("bin"))).drop("_s")


def points_in(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """Points (chr, pos) with the intervals (chr, beg, en) that hold them, both ends included.

    An interval lies in one bin, the smallest that holds it; a point looks in its bin of every
    size. So both sides meet on (chr, size, bin), an equi-join, and a contig-long interval is one row like others.
    """
    i = intervals.withColumn("_o", own_bin(F.col("beg").cast("long"), F.col("en").cast("long")))
    p = in_bins(points, "pos", i)
    return p.join(i.withColumnRenamed("_o", "_b"), ["chr", "_b"]).where("pos between beg and en").drop("_b")


def on_target(points: DataFrame, intervals: DataFrame) -> DataFrame:
    """``points`` with a flag whether any interval holds them: each place is looked up once."""
    hit = points_in(points.select("chr", "pos").distinct(), intervals.select("chr", "beg", "en")).select("chr", "pos").distinct()
    return points.join(hit.withColumn("on_target", F.lit(True)), ["chr", "pos"], "left").withColumn("on_target", F.coalesce("on_target", F.lit(False)))


#: Positions of a cell: with one more on either side, (CELL + 2) ** 2 places fit 64 bits.
CELL = 6


def at_amplicon_ends(reads: DataFrame, amplicons: DataFrame) -> DataFrame:
    """Reads (chr, beg, en) with ``amplicon``: whether they begin and end within one base of an amplicon (chr, beg, en).

    Both bounds are dealt into cells of CELL positions. The amplicons at a cell's places and next to them are bits of a
    number, summed on the map side; so an amplicon is two rows at most on average, and a read one.
    """
    cell = lambda c: F.floor(F.col(c) / CELL).cast("long")
    touched = lambda c: F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(1)), lambda i: F.floor((F.col(c) + i) / CELL).cast("long")))
    place = lambda c, k: (F.col(c) - F.col(k) * CELL + 1).cast("int")  # 0 for the last position of the cell before
    bit = (place("beg", "_b") * (CELL + 2) + place("en", "_e")).alias("_bit")
    a = amplicons.select("chr", "beg", "en", F.explode(touched("beg")).alias("_b")).select("*", F.explode(touched("en")).alias("_e"))
    a = a.groupBy("chr", "_b", "_e").agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("_hits"))
    r = reads.withColumns({"_b": cell("beg"), "_e": cell("en")}).join(a, ["chr", "_b", "_e"], "left")
    around = F.lit(sum(1 << (i * (CELL + 2) + j) for i in range(3) for j in range(3))).cast("long")
    corner = ((F.col("beg") - F.col("_b") * CELL) * (CELL + 2) + F.col("en") - F.col("_e") * CELL).cast("int")
    hit = F.col("_hits").bitwiseAND(F.call_function("shiftleft", around, corner)) != 0
    return r.withColumn("amplicon", F.coalesce(hit, F.lit(False))).drop("_b", "_e", "_hits")


def overlaps(a: DataFrame, b: DataFrame) -> DataFrame:
    """Pairs of intervals (chr, beg, en, aid) and (chr, b_beg, b_en, bid) that share a position, each once.

    Of two that meet, the one in the smaller bin lies in the other's bin whole. So each side's own bins meet the
    other's bins of that size and, in a second join, larger ones: a few rows for each interval, however long.
    """
    x = a.withColumn("_o", own_bin(F.col("beg").cast("long"), F.col("en").cast("long")))
    y = b.withColumn("_o", own_bin(F.col("b_beg").cast("long"), F.col("b_en").cast("long")))
    own = lambda d: d.withColumnRenamed("_o", "_b")
    meet = lambda p, q: p.join(q, ["chr", "_b"]).where("beg <= b_en and en >= b_beg").drop("_b")
    up = in_bins(x, "beg", y, F.col("_s") >= F.col("_o.shift")).drop("_o")
    return meet(up, own(y)).unionByName(meet(own(x), in_bins(y, "b_beg", x, F.col("_s") > F.col("_o.shift")).drop("_o")))


def fragments(intervals: DataFrame, width: int = chunks.WIDTH) -> DataFrame:
    """(chr, beg, en, n): disjoint tiles between all bounds, with how many intervals cover each.

    A running sum of +1 and -1 at the bounds, in chunks of ``width`` positions, so covering intervals are
    counted without a join and a long contig is many tasks.
    """
    edge = intervals.select("chr", F.col("beg").alias("x"), F.lit(1).alias("d")).union(intervals.select("chr", F.col("en") + 1, F.lit(-1)))
    g = edge.groupBy("chr", "x").agg(F.sum("d").alias("d"))
    f = chunks.running_sum(g, "chr", "x", "d", width=width)
    return f.select("chr", F.col("x").alias("beg"), (F.col("next") - 1).alias("en"), F.col("d_sum").alias("n")).where("n > 0")


def fragment_rows(intervals: DataFrame, key: str) -> DataFrame:
    """Each tile with the keys of the intervals that cover it, in order: a tile has no bound inside, so its first position tells."""
    f = fragments(intervals).select("chr", F.col("beg").alias("pos"), F.col("en").alias("to"))
    hit = points_in(f, intervals.select("chr", "beg", "en", key)).select("chr", F.col("pos").alias("beg"), F.col("to").alias("en"), key)
    return hit.groupBy("chr", "beg", "en").agg(F.array_sort(F.collect_list(key)).alias("rows"))


class IntervalIndex:
    """Tiles of intervals with the rows that cover them, built once, saved as Parquet and looked up by points or ranges.

    ``save`` keeps what it was built from beside it, and ``load`` refuses an index of other options.
    """

    def __init__(self, tiles: DataFrame, options: str = ""):
        self.tiles, self.options = tiles, options

    @classmethod
    def build(cls, intervals: DataFrame, key: str, options: str = "") -> IntervalIndex:
        return cls(fragment_rows(intervals, key), options)

    def save(self, path: str) -> None:
        self.tiles.withColumn("options", F.lit(self.options)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str, options: str = "") -> IntervalIndex:
        d = spark.read.parquet(path)
        if d.where(F.col("options") != options).limit(1).count():
            raise ValueError("the index was built with other options")
        return cls(d.drop("options"), options)

    def lookup(self, points: DataFrame) -> DataFrame:
        """Points (chr, pos) with ``rows``, the keys of the intervals that hold them."""
        return points_in(points, self.tiles).drop("beg", "en")

    def lookup_ranges(self, ranges: DataFrame, key: str) -> DataFrame:
        """Ranges (chr, b_beg, b_en, a key) with ``rows``, the keys of the intervals that they meet, each once."""
        hit = overlaps(self.tiles, ranges).groupBy("chr", "b_beg", "b_en", key).agg(F.flatten(F.collect_list("rows")).alias("rows"))
        return hit.withColumn("rows", F.array_sort(F.array_distinct("rows")))


def in_region(alignments: DataFrame, rname: str, beg: int, en: int) -> DataFrame:
    """Alignments (rname, pos, cigar) that reach into a region: the names and starts prune files and row groups, the spans decide.

    A table written by ``write_by_region`` reads only the bins that can hold such a start.
    """
    from seqlake.functions import cigar as C

    d = alignments.where((F.col("rname") == rname) & (F.col("pos") <= en))
    if "bin" in alignments.columns:
        longest = alignments.where(F.col("rname") == rname).agg(F.max(C.reference_span(F.col("cigar")))).first()[0] or 1
        d = d.where(F.col("bin").between((beg - longest) // REGION, en // REGION))
    return d.where(F.col("pos") + C.reference_span(F.col("cigar")) - 1 >= beg)


#: Positions of a partition of alignments.
REGION = 1 << 20


def write_by_region(alignments: DataFrame, path: str) -> None:
    """Alignments as Parquet by name and bin of REGION positions, sorted by position: ``in_region`` reads a few files of it."""
    d = alignments.withColumn("bin", F.floor(F.col("pos") / REGION))
    d.repartition("rname", "bin").sortWithinPartitions("rname", "bin", "pos").write.partitionBy("rname", "bin").parquet(path)


def sample_matrix(calls: DataFrame, samples: list[str], value: str = "value") -> DataFrame:
    """(chr, pos) x samples: sums of conditions, which keep a few numbers for a place, on the map side too."""
    return calls.groupBy("chr", "pos").agg(*[F.max(F.when(F.col("sample") == x, F.col(value))).alias(x) for x in samples])


def ranked(df: DataFrame, order: DataFrame, key: str = "chr") -> DataFrame:
    """Rows in a reference's order (key, rank), then pos."""
    return df.join(order, key, "left").orderBy(F.coalesce("rank", F.lit(1 << 30)), "pos").drop("rank")


def gene_rollup(rows: DataFrame) -> DataFrame:
    """Transcripts (gene, transcript_id, length, count, fpkm) by gene: length weighted by count + 1, sums, and transcript list."""
    w = F.col("count") + 1
    return rows.groupBy("gene").agg((F.sum(F.col("length") * w) / F.sum(w)).alias("length"), F.sum("count").alias("count"), F.sum("fpkm").alias("fpkm"), F.array_join(F.array_sort(F.collect_set("transcript_id")), ",").alias("transcripts"))


def contig_stats(contigs: DataFrame, least: int = 0) -> DataFrame:
    """One row over contigs (len) longer than ``least``: number, lengths, quartiles, N50 and N90.

    Nx is the longest length such that contigs at least that long hold x % of all bases. Lengths are counted first, so the
    running sum is over distinct lengths only.
    """
    c = contigs.where(F.col("len") > least).groupBy("len").agg(F.count("*").alias("n"))
    total = c.agg(F.sum(F.col("len") * F.col("n")).alias("total"))
    w = Window.orderBy(F.desc("len")).rowsBetween(Window.unboundedPreceding, 0)
    run = c.withColumn("run", F.sum(F.col("len") * F.col("n")).over(w)).crossJoin(F.broadcast(total))
    nx = run.agg(*[F.max(F.when(F.col("run") >= F.col("total") * p, F.col("len"))).alias(f"n{round(p * 100)}") for p in (0.5, 0.9)])
    base = c.agg(F.sum("n").alias("n"), F.min("len").alias("len_min"), F.max("len").alias("len_max"), (F.sum(F.col("len") * F.col("n")) / F.sum("n")).alias("len_mean"), *[F.percentile("len", p, F.col("n")).alias(a) for p, a in ((0.25, "q1"), (0.5, "median"), (0.75, "q3"))])
    return base.crossJoin(nx)


def repeated_kmers(contigs: DataFrame, k: int = 21) -> DataFrame:
    """One row over contigs (seq): k-mers, distinct ones, and those that are seen more than once."""
    n = contigs.select(F.explode(S.kmers(F.upper("seq"), k)).alias("kmer")).groupBy("kmer").agg(F.count("*").alias("n"))
    return n.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("kmers"), F.count("*").alias("distinct"), F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated"))


def scaled_rollup(rows: DataFrame, to: float = 1e6) -> DataFrame:
    """``gene_rollup`` with counts of each library (column ``library``) scaled to ``to`` in all."""
    total = rows.groupBy("library").agg(F.sum("count").alias("_t"))
    d = rows.join(total, "library").withColumn("scaled", F.col("count") * to / F.col("_t"))
    return d.groupBy("library", "gene").agg(F.sum("scaled").alias("scaled"), F.sum("count").alias("count"))


def to_bed(gtf: DataFrame) -> DataFrame:
    """GTF rows (chr, feature, beg, en, strand, transcript_id) as BED12 lines' fields."""
    exon, cds = F.col("feature") == "exon", F.col("feature") == "CDS"
    g = gtf.groupBy("transcript_id", "chr", "strand").agg(
        F.min(F.when(exon, F.col("beg"))).alias("beg"), F.max(F.when(exon, F.col("en"))).alias("en"), F.min(F.when(cds, F.col("beg"))).alias("tb"), F.max(F.when(cds, F.col("en"))).alias("te"),
        F.sort_array(F.collect_list(F.when(exon, F.struct("beg", "en")))).alias("x"),
    ).where("size(x) > 0")
    sizes = F.array_join(F.transform("x", lambda e: (e["en"] - e["beg"] + 1).cast("string")), ",")
    starts = F.array_join(F.transform("x", lambda e: (e["beg"] - F.col("beg")).cast("string")), ",")
    start = F.col("beg") - 1
    return g.select("chr", start.alias("start"), F.col("en").alias("end"), F.col("transcript_id").alias("name"), F.lit(0).alias("score"), "strand", F.coalesce(F.col("tb") - 1, start).alias("thick_start"), F.coalesce("te", start).alias("thick_end"), F.lit("0").alias("rgb"), F.size("x").alias("blocks"), sizes.alias("sizes"), starts.alias("starts")).orderBy("chr", "start", "name")


def gff3_to_gtf(gff: DataFrame) -> DataFrame:
    """GFF3 rows with attributes ID, Parent as GTF rows by transcript and its gene."""
    attr = lambda k: F.nullif(F.regexp_extract("attrs", rf"(?:^|;)\s*{k}=([^;]+)", 1), F.lit(""))
    d = gff.withColumn("id", attr("ID")).withColumn("parent", F.explode_outer(F.split(attr("Parent"), ",")))
    owner = d.where("id is not null").select(F.col("id").alias("tid"), F.col("parent").alias("gene")).distinct()
    rows = d.drop("id").where(F.col("feature").isin("exon", "CDS", "start_codon", "stop_codon")).join(owner, F.col("parent") == F.col("tid"), "left")
    text = F.concat(F.lit('gene_id "'), F.coalesce("gene", "parent"), F.lit('"; transcript_id "'), F.col("parent"), F.lit('";'))
    return rows.select("chr", "source", "feature", "beg", "en", "score", "strand", "frame", text.alias("attrs"))


def array_alignments(csv: DataFrame) -> DataFrame:
    """``chr:beg-end (strand) /// ...`` in ``alignments`` as 0-based intervals."""
    x = csv.withColumn("a", F.explode(F.split("alignments", r"\s*///\s*")))
    part = lambda i: F.regexp_extract("a", r"^(\S+):(\d+)-(\d+)(?: \(([+-])\))?", i)
    return x.where(part(1) != "").select(part(1).alias("chr"), (part(2).cast("long") - 1).alias("beg"), part(3).cast("long").alias("en"), F.nullif(part(4), F.lit("")).alias("strand"), *[c for c in csv.columns if c != "alignments"])


def lifted(rows: DataFrame, chain: DataFrame) -> DataFrame:
    """Rows with an ``alignment`` string replaced by its lifted form (alignment, lifted), where there is one."""
    return rows.join(chain, "alignment", "left").withColumn("alignment", F.coalesce("lifted", "alignment")).drop("lifted")
