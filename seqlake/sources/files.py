"""Readers of sequence files: ordered records, and delimited tables."""

from __future__ import annotations

import gzip
import io
import struct
import zipfile
import zlib

from pyspark.sql import DataFrame, SparkSession, Window, functions as F
from pyspark.sql.types import StructType

FASTQ = "file string, rec_no long, id string, seq string, com string, qual string, corrupt string"
PILEUP = "chr string, pos int, ref string, depth int, bases string, quals string"
SAM = "qname string, flag int, rname string, pos int, mapq int, cigar string, rnext string, pnext int, tlen int, seq string, qual string, tags map<string,string>, nm int"
GTF = "chr string, source string, feature string, beg long, en long, score string, strand string, frame string, attrs string"


def records(f, fake_quality: str = "h"):
    """(id, seq, com, qual, corrupt) of an open FASTQ or FASTA file of bytes; CR is dropped, a malformed record says why."""
    line = lambda: f.readline().rstrip(b"\r\n").decode("latin-1")
    first = f.readline()
    while first:
        name = first.rstrip(b"\r\n").decode("latin-1")
        if name.startswith(">"):
            parts = []
            first = f.readline()
            while first and not first.startswith(b">"):
                parts.append("".join(first.decode("latin-1").split()))
                first = f.readline()
            seq = "".join(parts)
            yield "@" + name[1:], seq, "+", fake_quality * len(seq), None
            continue
        if not name:
            first = f.readline()
            continue
        seq, com, qual = line(), line(), line()
        why = None
        if not name.startswith("@"):
            why = "id"
        elif not com.startswith("+"):
            why = "comment"
        elif len(seq) != len(qual):
            why = "length"
        yield name, seq, com, qual, why
        first = f.readline()


def open_path(uri: str):
    """A buffered reader of a plain, gzip or zip file (its first member) on any file system, read as it streams."""
    from pyarrow import fs

    where, name = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
    f = io.BufferedReader(where.open_input_file(name), 1 << 20)
    head = f.peek(4)[:4]
    if head == b"PK\x03\x04":
        z = zipfile.ZipFile(f)
        return z.open(z.namelist()[0])
    return io.BufferedReader(gzip.GzipFile(fileobj=f), 1 << 20) if head[:2] == b"\x1f\x8b" else f


def paths(spark: SparkSession, path: str) -> DataFrame:
    """(path) of the files below a path or a pattern; nothing of them is read."""
    from urllib.parse import unquote

    def plain(frames):
        import pyarrow as pa

        for b in frames:
            yield pa.RecordBatch.from_arrays([pa.array([unquote(p) for p in b.column(0).to_pylist()], pa.string())], ["path"])

    return spark.read.format("binaryFile").load(path).select("path").mapInArrow(plain, "path string")


def batched(rows, schema, most: int = 10_000):
    """Rows as Arrow batches of at most ``most``, so a file of any size is in memory a batch at a time."""
    import pyarrow as pa

    held: list = []
    for r in rows:
        held.append(r)
        if len(held) == most:
            yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, k.type) for c, k in zip(zip(*held), schema)], schema=schema)


def read_reads(spark: SparkSession, path: str, mode: str = "PERMISSIVE") -> DataFrame:
    """FASTQ or FASTA files, plain, gzip or zip, as FASTQ rows; rec_no counts a file's records from 0.

    A file is read as it streams, of any size, by one task, as its records can only be numbered in order; land large files as
    Parquet once. PERMISSIVE keeps malformed records with ``corrupt`` set, DROPMALFORMED drops
    them, FAILFAST raises.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(FASTQ))

    def rows(name: str):
        for n, r in enumerate(records(open_path(name))):
            if r[4] and mode == "FAILFAST":
                raise ValueError(f"{name}, record {n}: {r[4]}")
            if not (r[4] and mode == "DROPMALFORMED"):
                yield name, n, *r

    def run(frames):
        for b in frames:
            for name in b.column(0).to_pylist():
                yield from batched(rows(name), schema)

    return paths(spark, path).mapInArrow(run, FASTQ)


def read_adapters(spark: SparkSession, path: str) -> DataFrame:
    """FASTA of one-line sequences: id, seq, with U as T."""
    return read_reads(spark, path).select(F.trim(F.expr("substring(id, 2)")).alias("id"), F.translate(F.upper("seq"), "U", "T").alias("seq"))


def read_barcodes(spark: SparkSession, path: str) -> DataFrame:
    """``id seq [group]`` by white space: bid, bc, bc2 (after a dash), grp; comments, blank lines and a header are left out."""
    p = F.split(F.trim("value"), r"\s+")
    d = spark.read.text(path).where(~F.col("value").rlike(r"^\s*(#|$)")).select(F.get(p, 0).alias("bid"), F.get(p, 1).alias("s"), F.get(p, 2).alias("grp")).where("s is not null and lower(s) <> 'seq'")
    return d.select("bid", F.upper(F.split_part("s", F.lit("-"), F.lit(1))).alias("bc"), F.nullif(F.upper(F.split_part("s", F.lit("-"), F.lit(2))), F.lit("")).alias("bc2"), "grp")


def _fields(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.split("value", "\t").alias("f"))


def read_sam(spark: SparkSession, path: str) -> DataFrame:
    d = _fields(spark, path).where("f[0] not rlike '^@[A-Z][A-Z]$' and size(f) >= 11")
    tags = F.map_from_entries(F.transform(F.slice("f", 12, 1 << 16), lambda x: F.struct(F.substring(x, 1, 2), F.substring(x, 6, 1 << 16))))
    cols = [F.get("f", i).cast(t).alias(n) for i, (n, t) in enumerate((x.split(" ") for x in SAM.split(", ")[:11]))]
    return d.select(*cols, tags.alias("tags")).withColumn("nm", F.try_element_at("tags", F.lit("NM")).cast("int"))


def read_sam_contigs(spark: SparkSession, path: str) -> DataFrame:
    d = spark.read.text(path).where("value like '@SQ\t%'")
    return d.select(F.regexp_extract("value", r"\tSN:([^\t]+)", 1).alias("name"), F.regexp_extract("value", r"\tLN:(\d+)", 1).cast("long").alias("length"))


def sam_as_reads(sam: DataFrame) -> DataFrame:
    return sam.select(F.concat(F.lit("@"), "qname").alias("id"), "seq", F.lit("+").alias("com"), "qual")


def bam_records(source):
    """(contigs, rows of SAM) of a BAM file, its bytes or a reader of it unpacked: BGZF blocks, four-bit bases, qualities of offset 33."""
    f = gzip.open(io.BytesIO(source)) if isinstance(source, bytes) else source
    take = lambda fmt: struct.unpack("<" + fmt, f.read(struct.calcsize("<" + fmt)))
    if f.read(4) != b"BAM\x01":
        raise ValueError("not a BAM file")
    f.read(take("i")[0])
    contigs = []
    for _ in range(take("i")[0]):
        name = f.read(take("i")[0])[:-1].decode()
        contigs.append((name, take("i")[0]))
    kinds = {b"A": "c", b"c": "b", b"C": "B", b"s": "h", b"S": "H", b"i": "i", b"I": "I", b"f": "f"}

    def rows():
        while head := f.read(4):
            d = f.read(struct.unpack("<i", head)[0])
            tid, pos, l_name, mapq, _, n_cigar, flag, l_seq, mtid, mpos, tlen = struct.unpack("<iiBBHHHiiii", d[:32])
            at = 32 + l_name
            name = d[32 : at - 1].decode()
            ops = struct.unpack(f"<{n_cigar}I", d[at : at + 4 * n_cigar])
            at += 4 * n_cigar
            packed, n = d[at : at + (l_seq + 1) // 2], (l_seq + 1) // 2
            seq = "".join("=ACMGRSVTWYHKDBN"[x >> 4] + "=ACMGRSVTWYHKDBN"[x & 15] for x in packed)[:l_seq]
            at += n
            qual = "".join(chr(q + 33) for q in d[at : at + l_seq]) if l_seq and d[at] != 255 else "*"
            at += l_seq
            tags = {}
            while at < len(d):
                tag, kind = d[at : at + 2].decode(), d[at + 2 : at + 3]
                at += 3
                if kind in b"ZH":
                    end = d.index(b"\0", at)
                    tags[tag], at = d[at:end].decode(), end + 1
                elif kind == b"B":
                    sub, n = kinds[d[at : at + 1]], struct.unpack("<i", d[at + 1 : at + 5])[0]
                    v = struct.unpack(f"<{n}{sub}", d[at + 5 : at + 5 + n * struct.calcsize(sub)])
                    tags[tag], at = ",".join(map(str, v)), at + 5 + n * struct.calcsize(sub)
                else:
                    k = kinds[kind]
                    v = struct.unpack("<" + k, d[at : at + struct.calcsize(k)])[0]
                    tags[tag], at = v.decode() if isinstance(v, bytes) else str(v), at + struct.calcsize(k)
            ref = lambda t: contigs[t][0] if t >= 0 else "*"
            yield name, flag, ref(tid), pos + 1, mapq, "".join(f"{o >> 4}{'MIDNSHP=X'[o & 15]}" for o in ops) or "*", "=" if mtid == tid and tid >= 0 else ref(mtid), mpos + 1, tlen, seq or "*", qual, list(tags.items()), int(tags["NM"]) if "NM" in tags else None

    return contigs, rows()


def read_bam(spark: SparkSession, path: str) -> DataFrame:
    """BAM files as SAM rows; a file streams through one task."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL(SAM))

    def run(frames):
        for b in frames:
            for name in b.column(0).to_pylist():
                yield from batched(bam_records(open_path(name))[1], schema)

    return paths(spark, path).mapInArrow(run, SAM)


def read_alignments(spark: SparkSession, path: str) -> DataFrame:
    """SAM or BAM by the first bytes of the first file."""
    first = paths(spark, path).orderBy("path").first()
    return read_bam(spark, path) if first and open_path(first["path"]).read(4) == b"BAM\x01" else read_sam(spark, path)


#: Bases of a row of reference sequence.
FASTA_CHUNK = 1 << 16


def read_reference(spark: SparkSession, path: str, chunk: int = FASTA_CHUNK) -> DataFrame:
    """FASTA as (contig, chunk, seq): pieces of ``chunk`` bases, so that any stretch is a join or a filter on (contig, chunk), and no contig is one value."""

    def rows(name: str):
        contig, n, held = None, 0, ""
        for line in open_path(name):
            text = line.decode("latin-1").strip()
            if text.startswith(">"):
                if held:
                    yield contig, n, held
                contig, n, held = text[1:].split()[0] if text[1:].split() else "", 0, ""
                continue
            held += text
            while len(held) >= chunk:
                yield contig, n, held[:chunk]
                n, held = n + 1, held[chunk:]
        if held:
            yield contig, n, held

    def run(frames):
        import pyarrow as pa

        schema = pa.schema([("contig", pa.string()), ("chunk", pa.int64()), ("seq", pa.string())])
        for b in frames:
            for name in b.column(0).to_pylist():
                yield from batched(rows(name), schema, 64)

    return paths(spark, path).mapInArrow(run, "contig string, chunk long, seq string")


def contig_lengths(reference: DataFrame) -> DataFrame:
    """(contig, length, rank): an index of a reference in order of its names."""
    d = reference.groupBy("contig").agg(F.sum(F.length("seq")).alias("length"))
    return d.withColumn("rank", F.row_number().over(Window.orderBy("contig")))  # a row a contig


def fetch(reference: DataFrame, regions: DataFrame, chunk: int = FASTA_CHUNK) -> DataFrame:
    """Regions (contig, beg, en, from 1, both ends included) with ``bases`` of the reference; beyond a contig's ends there are none."""
    parts = F.sequence(F.floor((F.greatest("beg", F.lit(1)) - 1) / chunk), F.floor((F.col("en") - 1) / chunk))
    d = regions.distinct().where("en >= greatest(beg, 1)").withColumn("chunk", F.explode(parts)).join(reference, ["contig", "chunk"])
    lo = F.greatest(F.greatest("beg", F.lit(1)) - 1 - F.col("chunk") * chunk, F.lit(0))
    piece = F.substr("seq", (lo + 1).cast("int"), F.least(F.lit(chunk), F.col("en") - F.col("chunk") * chunk).cast("int") - lo.cast("int"))
    g = d.groupBy("contig", "beg", "en").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("chunk", piece.alias("p")))), lambda x: x["p"]), "").alias("bases"))
    return regions.join(g, ["contig", "beg", "en"], "left").withColumn("bases", F.coalesce("bases", F.lit("")))


def read_pileup(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", schema=PILEUP, quote="", escape="")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, row, value): the lines of text files, numbered from 0 in each file; a split of a file is numbered by itself and shifted by those before."""
    at = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    d = at.withColumn("row", F.row_number().over(Window.partitionBy("file", "block").orderBy("id")) - 1)
    n = at.groupBy("file", "block").agg(F.count("*").alias("n"))
    before = n.select("file", "block", F.coalesce(F.sum("n").over(Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    return d.join(before, ["file", "block"]).select("file", (F.col("row") + F.col("before")).alias("row"), "value")


def read_intervals(spark: SparkSession, path: str, sep: str = "\t", chr: int = 0, beg: int = 1, en: int = 2, comment: str = "#", skip: int = 0, half_open: bool = False) -> DataFrame:
    """Columns named by ordinals: chr, beg, en (both ends included), row (of its file, from 0) and line of each interval; the first ``skip`` lines of every file are left out."""
    f = F.split("value", "\t" if sep == "\t" else sep)
    d = numbered_lines(spark, path).where((F.col("row") >= skip) & ~F.col("value").startswith(comment))
    end = F.get(f, en).try_cast("long") - (1 if half_open else 0)
    return d.select(F.get(f, chr).alias("chr"), F.get(f, beg).try_cast("long").alias("beg"), end.alias("en"), "row", F.col("value").alias("line")).where("beg is not null and en is not null")


def read_stats(spark: SparkSession, path: str) -> tuple[dict[str, str], DataFrame]:
    """(parameters, rates) of a statistics file: lines of a key, a tab and a value; keys like ``noise A:C`` are a table (name, ref, base, rate).

    A report of a few hundred lines, which comes to the driver.
    """
    rows = [(r["k"], r["v"]) for r in spark.read.text(path).where("value like '%\t%'").select(F.split_part("value", F.lit("\t"), F.lit(1)).alias("k"), F.split_part("value", F.lit("\t"), F.lit(2)).alias("v")).collect()]
    pairs = [(k.rsplit(" ", 1)[0], *k.rsplit(" ", 1)[1].split(":"), float(v)) for k, v in rows if " " in k and k.rsplit(" ", 1)[1].count(":") == 1]
    return {k: v for k, v in rows}, spark.createDataFrame(pairs, "name string, ref string, base string, rate double")


def tagged(texts: DataFrame, tag: str) -> DataFrame:
    """``texts`` (value) with ``found``: what every <tag> of a markup record holds, in order."""
    return texts.withColumn("found", F.regexp_extract_all("value", F.lit(rf"(?s)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1))


def size_of(text: str) -> int:
    """A number with a unit: 10, 4k, 2m, 1g (powers of 1024)."""
    unit = {"k": 10, "m": 20, "g": 30}.get(text[-1:].lower(), 0)
    return int(float(text[:-1] if unit else text) * (1 << unit))


def head(spark: SparkSession, path: str, lines: int | None = None, size: str | None = None) -> DataFrame:
    """The first ``lines`` lines of a file, or the whole lines within the first bytes (``size``, as ``size_of``)."""
    d = numbered_lines(spark, path)
    if lines is not None:
        return d.where(F.col("row") < lines).orderBy("file", "row")
    used = F.sum(F.octet_length("value") + 1).over(Window.partitionBy("file").orderBy("row"))
    most = size_of(size or "0")
    return d.where(F.col("row") < most).withColumn("used", used).where(F.col("used") <= most).drop("used").orderBy("file", "row")


def read_gtf(spark: SparkSession, path: str) -> DataFrame:
    """GTF or GFF rows, with gene_id and transcript_id where there are any."""
    d = spark.read.csv(path, sep="\t", schema=GTF, comment="#", quote="", escape="")
    get = lambda k: F.nullif(F.regexp_extract("attrs", rf'{k}[ =]"?([^";]+)', 1), F.lit(""))
    return d.withColumn("gene_id", get("gene_id")).withColumn("transcript_id", F.coalesce(get("transcript_id"), get("Parent")))


def read_delimited(spark: SparkSession, path: str, header: bool = True, sep: str | None = None, quote: str | None = None, key: str | None = None, multi: bool = False, skip: str | None = None) -> DataFrame:
    """A delimited table; delimiter and quote are found from its first line unless given; column names in lower case.

    Lines that begin with ``skip`` are left out. With ``key`` the rows are by that column: one
    each (the greatest, of equal keys), or with ``multi`` all of them as an array ``rows``.
    """
    first = (spark.read.text(path).limit(1).collect() or [[""]])[0][0]
    sep = sep or max("\t,;| ", key=lambda c: (first.count(c), -"\t,;| ".index(c)))
    quote = quote or ('"' if '"' in first or "'" not in first else "'")
    d = spark.read.csv(path, header=header, sep=sep, quote=quote, comment=skip)
    d = d.toDF(*[c.strip().lower() for c in d.columns])
    if key is None:
        return d
    row = F.struct(*[c for c in d.columns if c != key])
    g = d.groupBy(key).agg(F.sort_array(F.collect_list(row)).alias("rows") if multi else F.max(row).alias("row"))
    return g if multi else g.select(key, "row.*")


def read_fasta_with_quality(spark: SparkSession, fasta: str, qual: str) -> DataFrame:
    """A FASTA file and its file of numeric qualities as FASTQ rows; names must agree. Both stream, a record at a time."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(StructType.fromDDL("rec_no long, name string, qual string"))

    def rows(uri: str):
        name, n, held = None, 0, []
        for line in open_path(uri):
            text = line.decode("latin-1").strip()
            if not text.startswith(">"):
                held += text.split()
                continue
            if name is not None:
                yield n, name, "".join(chr(int(x) + 33) for x in held)
                n += 1
            name, held = text[1:], []
        if name is not None:
            yield n, name, "".join(chr(int(x) + 33) for x in held)

    def run(frames):
        for b in frames:
            for uri in b.column(0).to_pylist():
                yield from batched(rows(uri), schema)

    a = read_reads(spark, fasta).select("rec_no", "id", "seq")
    j = a.join(paths(spark, qual).mapInArrow(run, "rec_no long, name string, qual string"), "rec_no")
    return j.where(F.assert_true(F.substring_index(F.expr("substring(id, 2)"), " ", 1) == F.substring_index("name", " ", 1), "names differ").isNull()).select("rec_no", "id", "seq", F.lit("+").alias("com"), "qual")


def line_estimate(spark: SparkSession, path: str, segments: int = 8, size: int = 1 << 16) -> DataFrame:
    """(path, lines) of files, estimated from the density of evenly spaced segments; a compressed file's from its first segment.

    Only the segments are read: of a plain file by seeking, of a gzip file from its start.
    """

    def run(frames):
        import pyarrow as pa
        from pyarrow import fs

        for b in frames:
            out = []
            for uri in b.column(0).to_pylist():
                where, name = (fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")) if uri.startswith("file:") else fs.FileSystem.from_uri(uri)
                f = where.open_input_file(name)
                total = f.size()
                if f.read(2) == b"\x1f\x8b":
                    f.seek(0)
                    raw, lines = f.read(size), 0
                    left = raw
                    while left[:2] == b"\x1f\x8b":  # member after member, as far as the bytes at hand go
                        z = zlib.decompressobj(31)
                        lines += z.decompress(left).count(b"\n")
                        left = z.unused_data
                    out.append(round(lines * total / len(raw)))
                elif total <= segments * size:
                    f.seek(0)
                    out.append(f.read().count(b"\n"))
                else:
                    seen = 0
                    for i in range(segments):
                        f.seek(i * ((total - size) // (segments - 1)))
                        seen += f.read(size).count(b"\n")
                    out.append(round(seen / (segments * size) * total))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.int64())], ["path", "lines"])

    return paths(spark, path).mapInArrow(run, "path string, lines long")
