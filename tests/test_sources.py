"""Readers and writers of sequence files."""

from __future__ import annotations

import gzip
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from seqlake.operators import alignments as A, tables as T, variants as V
from seqlake.sources import files, sinks

FQ = "@a 1\nACGT\n+\nIII@\n@b 1\r\nAC\r\n+x\r\n@I\r\n"


def rows(df, *c):
    return [tuple(r) for r in df.orderBy("rec_no").select(*c).collect()]


def test_fastq_and_fasta(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FQ)
    with gzip.open(tmp_path / "a.fq.gz", "wb") as f:
        f.write(FQ.encode())
    (tmp_path / "b.fa").write_text(">one x\nAC GT\nAA\n>two\n\n>three\nUU\n")
    want = [(0, "@a 1", "ACGT", "+", "III@", None), (1, "@b 1", "AC", "+x", "@I", None)]
    with zipfile.ZipFile(tmp_path / "a.fq.zip", "w") as z:
        z.writestr("a.fq", FQ)
    for name in ("a.fq", "a.fq.gz", "a.fq.zip"):
        assert rows(files.read_reads(spark, str(tmp_path / name)), "rec_no", "id", "seq", "com", "qual", "corrupt") == want
    assert rows(files.read_reads(spark, str(tmp_path / "b.fa")), "id", "seq", "qual") == [("@one x", "ACGTAA", "hhhhhh"), ("@two", "", ""), ("@three", "UU", "hh")]
    assert [tuple(r) for r in files.read_adapters(spark, str(tmp_path / "b.fa")).where("id = 'three'").collect()] == [("three", "TT")]


def test_malformed_records(spark, tmp_path):
    (tmp_path / "m.fq").write_text("@a\nACGT\n+\nIII\n@b\nAC\n+\nII\nx\nAC\n+\nII\n@c\nAC\n-\nII\n@d\nAC\n")
    path = str(tmp_path / "m.fq")
    assert rows(files.read_reads(spark, path), "rec_no", "corrupt") == [(0, "length"), (1, None), (2, "id"), (3, "comment"), (4, "comment")]
    assert rows(files.read_reads(spark, path, "DROPMALFORMED"), "rec_no") == [(1,)]
    with pytest.raises(Exception, match="record 0"):
        files.read_reads(spark, path, "FAILFAST").collect()


def test_write_and_read_back(spark, tmp_path):
    (tmp_path / "a.fq").write_text(FQ.replace("\r", ""))
    d = files.read_reads(spark, str(tmp_path / "a.fq"))
    sinks.write_fastq(d, str(tmp_path / "out"), gzip=True)
    back = files.read_reads(spark, str(tmp_path / "out/*.gz"))
    assert sorted((r["id"], r["seq"], r["qual"]) for r in back.collect()) == sorted((r["id"], r["seq"], r["qual"]) for r in d.collect())
    sinks.write_by(d.selectExpr("*", "if(rec_no = 0, 'x', null) as bc"), str(tmp_path / "by"), "bc")
    assert sorted(p.name for p in (tmp_path / "by").glob("bc=*")) == ["bc=unmatched", "bc=x"]
    assert [r["mate"] for r in sinks.interleaved(d, d, 1).collect()] == [1, 2]
    assert sinks.fasta_text(d).first()["value"] == ">a 1\nACGT"
    assert {r["metric"]: r["value"] for r in sinks.report(d.selectExpr("count(*) as n", "max(length(seq)) as m")).collect()} == {"n": "2", "m": "4"}


def test_barcodes(spark, tmp_path):
    (tmp_path / "b.txt").write_text("id seq style\n# no\n\nA1 acgt-ttgg G\nB1\tCCCC\n")
    assert [tuple(r) for r in files.read_barcodes(spark, str(tmp_path / "b.txt")).orderBy("bid").collect()] == [("A1", "ACGT", "TTGG", "G"), ("B1", "CCCC", None, None)]


SAM = "@SQ\tSN:c1\tLN:50\nr1\t0\tc1\t3\t60\t4M\t*\t0\t0\tACGT\tIIII\tNM:i:1\tXA:Z:c2,-7,4M,2;\nr2\t16\tc1\t5\t10\t2M1I1M\t=\t9\t30\tACGT\tIIII\nr3\t4\t*\t0\t0\t*\t*\t0\t0\tAC\tII\n"


def bam_bytes() -> bytes:
    """Two alignments in BAM, by hand."""
    head = b"@SQ\tSN:c1\tLN:50\n"
    out = b"BAM\x01" + struct.pack("<i", len(head)) + head + struct.pack("<i", 1) + struct.pack("<i", 3) + b"c1\0" + struct.pack("<i", 50)
    for name, flag, pos, ops, seq, tags in ((b"r1", 0, 2, [(4, 0)], "ACGT", b"NMC\x01XAZc2,-7,4M,2;\0"), (b"r2", 16, 4, [(2, 0), (1, 1), (1, 0)], "ACG", b"")):
        code = ["=ACMGRSVTWYHKDBN".index(c) for c in seq] + [0]
        packed = bytes(code[i] << 4 | code[i + 1] for i in range(0, len(seq), 2))
        body = struct.pack("<iiBBHHHiiii", 0, pos, len(name) + 1, 60, 0, len(ops), flag, len(seq), -1, -1, 0) + name + b"\0" + b"".join(struct.pack("<I", n << 4 | o) for n, o in ops) + packed + bytes([40] * len(seq)) + tags
        out += struct.pack("<i", len(body)) + body
    return gzip.compress(out)


def test_alignments(spark, tmp_path):
    (tmp_path / "a.sam").write_text(SAM)
    (tmp_path / "a.bam").write_bytes(bam_bytes())
    a = files.read_alignments(spark, str(tmp_path / "a.sam"))
    assert [tuple(r) for r in a.select("qname", "flag", "pos", "nm").collect()] == [("r1", 0, 3, 1), ("r2", 16, 5, None), ("r3", 4, 0, None)]
    assert tuple(files.read_sam_contigs(spark, str(tmp_path / "a.sam")).first()) == ("c1", 50)
    b = files.read_alignments(spark, str(tmp_path / "a.bam")).collect()
    assert [(r["qname"], r["rname"], r["pos"], r["cigar"], r["seq"], r["qual"], r["nm"]) for r in b] == [("r1", "c1", 3, "4M", "ACGT", "IIII", 1), ("r2", "c1", 5, "2M1I1M", "ACG", "III", None)]
    s = A.summary(a).first()
    assert (s["reads"], s["mapped"], s["reverse"], s["ins_rate"]) == (3, 2, 1, 1 / 8)
    alt = A.expand_alternatives(a.withColumn("xa", a["tags"]["XA"])).first()
    assert (alt["rname"], alt["pos"], alt["flag"] & 16, alt["seq"]) == ("c2", 7, 16, "ACGT")
    p = {r["pos"]: (r["depth"], r["bases"]) for r in A.pileup(a).collect()}
    assert p == {3: (1, "A"), 4: (1, "C"), 5: (2, "Ga"), 6: (2, "Tc"), 7: (1, "t")}
    assert A.flagstat(a).first()["mapped"] == 2


def test_pileup_calls(spark, tmp_path):
    (tmp_path / "p.txt").write_text("c1\t5\tA\t8\t^].^],^].^],^]T^]T^]t^]*\tIIIIIIII\nc1\t6\tC\t8\t..$.,+2AG,$$..-1t*\tIIIIIIII\nc1\t7\tC\t5\t.^+.,N<.\tIIIII+\n")
    for chunk in (20_000, 2, 1):  # rows 5, 6 and 7 in chunks of their own give the same
        c = V.calls(files.read_pileup(spark, str(tmp_path / "p.txt")), chunk=chunk)
        got = {(r["pos"], r["base"]): (r["fwd"], r["rev"], r["starts"], r["mq_sum"], r["seqs"]) for r in c.collect()}
        assert got == {
            (5, "A"): (2, 2, 4, 240, []), (5, "T"): (2, 1, 3, 180, []), (5, "*"): (1, 0, 1, 60, []),
            (6, "C"): (5, 2, 0, 420, []), (6, "*"): (1, 0, 0, 60, []), (6, "+"): (0 + 1, 0, 0, 60, ["AG"]), (6, "-"): (0, 1, 0, 60, ["T"]), (7, "C"): (3, 1, 1, 190, []),
        }
    g = V.genotypes(V.call(c, V.Limits(min_depth=2, loci=1, min_diversity=0.0))).collect()
    assert [(r["pos"], r["genotype"]) for r in g] == [(5, "het")]
    assert V.to_vcf(V.genotypes(V.call(c, V.Limits(min_depth=2, loci=1, min_diversity=0.0)))).first()["alt"] == "T"
    few = V.calls(files.read_pileup(spark, str(tmp_path / "p.txt")), least_mapq=20).where("pos = 7").first()
    assert (few["fwd"], few["rev"]) == (2, 1)


def test_limits_of_calls(spark):
    base = {"chr": "c", "pos": 1, "ref": "A", "depth": 100, "base": "T", "fwd": 20, "rev": 20, "qual": 1200, "qual_ssq": 36000, "mq_sum": 2400, "mq_ssq": 144000, "starts": 0, "diversity": 1.0, "agreement": 1.0, "seqs": [""][:0], "is_ref": False, "run": 1}
    cases = [{}, {"diversity": 0.1}, {"agreement": 0.1}, {"fwd": 1, "rev": 0}, {"fwd": 40, "rev": 0}, {"fwd": 3, "rev": 0, "qual": 120}, {"qual": 40, "fwd": 20}, {"base": "+", "seqs": ["AG", "AG", "AC"]}, {"base": "+", "seqs": ["AG"] * 3}, {"base": "-", "seqs": ["A"] * 9, "run": 7}, {"mq_sum": 10}]
    d = spark.createDataFrame([tuple((base | c | {"pos": i}).values()) for i, c in enumerate(cases)], "chr string, pos int, ref string, depth int, base string, fwd int, rev int, qual long, qual_ssq long, mq_sum long, mq_ssq long, starts int, diversity double, agreement double, seqs array<string>, is_ref boolean, run int")
    out = {r["pos"]: r for r in V.call(d).collect()}
    # three of a hundred reads at score 40: a mass of 1.65e-7, too much over a million loci, not over a thousand; no balance is asked of them.
    # Forty of a hundred at score 1, where 79 errors are expected: the mass there is 4e-7, which a tail would not be.
    assert {r["pos"] for r in V.call(d, V.Limits(loci=1000)).collect()} == {0, 5, 6, 8, 10}
    assert sorted(out) == [0, 8, 10] and out[10]["padj"] == 1.0 and out[0]["padj"] < 1e-20
    # 95 to 1 reads: the full strand is cut to the 19 that one in twenty allows
    r = V.rebalanced(d.where("pos = 0").selectExpr("* except (fwd, rev)", "95 as fwd", "1 as rev"), 0.05, F.lit(True)).first()
    assert (r["fwd"], r["rev"], r["qual"]) == (19, 1, 1200 - 76 * 12)


def plain_dispersion(own: dict, every: dict, length: float) -> tuple[float, float]:
    d, depth, reach = sum(own.values()), sum(every.values()), max(every) + 1
    e, share = d / length, d / depth
    if len(own) == 1:
        diversity = 0.0
    else:
        far = sum(int(abs(own.get(o, 0) - e)) ** 2 for o in range(reach)) - 2 * d
        diversity = max(0.0, 1 - max(0.0, far) / max(1.0, (d - e) ** 2 - 2 * d))
    mean = (d + 2 * share * reach) / (depth + 2 * reach)
    cubes = [n * abs((own.get(o, 0) + 2 * share) / (n + 2) - mean) ** 3 for o, n in every.items()]
    return diversity, max(0.0, 1 - (sum(max(0.0, c - share) for c in cubes) / (depth + 2 * reach)) ** (1 / 3) / share)


def test_dispersion_of_offsets(spark):
    import random

    rng = random.Random(4)
    loci = [{"T": {i: 1 for i in range(20)}}, {"T": {5: 20}, "A": {i: 1 for i in range(20)}}, {"T": {5: 19, 6: 1}, "A": {i: 2 for i in range(20)}}]
    loci += [{b: {o: rng.randrange(1, 9) for o in rng.sample(range(30), rng.randrange(1, 12))} for b in ("A", "T", None)} for _ in range(40)]
    rows = [("c", i, b, sum(o.values()), 0, list(o.items()), None if i % 5 == 4 else 20.0) for i, x in enumerate(loci) for b, o in x.items()]
    d = spark.createDataFrame(rows, "chr string, pos int, base string, fwd int, rev int, offsets array<struct<o: int, n: int>>, length double")
    out = {(r["pos"], r["base"]): (r["diversity"], r["agreement"]) for r in V.dispersed(d).collect()}
    assert out[0, "T"] == (1.0, 1.0) and out[1, "T"][0] == 0.0 and out[1, "T"][1] < 0.7 and out[2, "T"][0] < 0.2
    for i, x in enumerate(loci):
        every: dict = {}
        for o in x.values():
            for k, n in o.items():
                every[k] = every.get(k, 0) + n
        for b, o in x.items():
            if b is not None:
                assert out[i, b] == pytest.approx(plain_dispersion(o, every, max(every) + 1 if i % 5 == 4 else 20.0))


def test_long_reads_keep_their_start(spark):
    """Reads over many chunks have the same quality and offsets for any chunk width."""
    import random

    rng = random.Random(8)
    reads = sorted((rng.randrange(1, 300), rng.randrange(1, 250), rng.randrange(60), i) for i in range(60))
    rows = []
    for pos in range(1, 560):
        text = "".join(("^" + chr(33 + q) if pos == s else "") + "ACGT"[i % 4] + ("$" if pos == s + n - 1 else "") for s, n, q, i in reads if s <= pos < s + n)
        depth = sum(s <= pos < s + n for s, n, _, _ in reads)
        if depth:
            rows.append(("c", pos, "A", depth, text, "I" * depth))
    d = spark.createDataFrame(rows, "chr string, pos int, ref string, depth int, bases string, quals string")
    whole = {(r["pos"], r["base"]): r.asDict() for r in V.calls(d).collect()}
    assert {(r["pos"], r["base"]): r.asDict() for r in V.calls(d, chunk=40).collect()} == whole
    for (pos, base), r in whole.items():
        assert r["mq_sum"] == sum(q for s, n, q, i in reads if s <= pos < s + n and "ACGT"[i % 4] == base)


def test_intervals_and_gene_models(spark, tmp_path):
    (tmp_path / "i.txt").write_text("# x\nchr1\t10\t20\ta\nchr1\t20\t30\tb\nchr2\t5\t6\tc\n")
    i = files.read_intervals(spark, str(tmp_path / "i.txt"))
    assert i.count() == 3
    pts = spark.createDataFrame([("chr1", 20), ("chr1", 31), ("chr2", 5)], "chr string, pos long")
    assert sorted((r["chr"], r["pos"], r["line"][-1]) for r in T.points_in(pts, i).collect()) == [("chr1", 20, "a"), ("chr1", 20, "b"), ("chr2", 5, "c")]
    assert T.on_target(pts, i).where("on_target").count() == 2
    f = {(r["beg"], r["en"]): r["n"] for r in T.fragments(i.where("chr = 'chr1'")).collect()}
    assert f == {(10, 19): 1, (20, 20): 2, (21, 30): 1}
    gtf = 'c\ts\texon\t11\t20\t.\t+\t.\tgene_id "g"; transcript_id "t";\nc\ts\texon\t31\t40\t.\t+\t.\tgene_id "g"; transcript_id "t";\nc\ts\tCDS\t15\t35\t.\t+\t.\tgene_id "g"; transcript_id "t";\n'
    (tmp_path / "g.gtf").write_text(gtf)
    bed = T.to_bed(files.read_gtf(spark, str(tmp_path / "g.gtf"))).first()
    assert (bed["start"], bed["end"], bed["thick_start"], bed["thick_end"], bed["sizes"], bed["starts"]) == (10, 40, 14, 35, "10,10", "0,20")
    (tmp_path / "d.csv").write_text('"Id";"Alignments"\n1;"chr1:5-9 (+) /// chr2:7-8"\n')
    d = files.read_delimited(spark, str(tmp_path / "d.csv"))
    assert d.columns == ["id", "alignments"]
    assert sorted((r["chr"], r["beg"], r["en"], r["strand"] or "") for r in T.array_alignments(d).collect()) == [("chr1", 4, 9, "+"), ("chr2", 6, 8, "")]


def test_fasta_with_qualities(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">a\nACG\n>b\nTT\n")
    (tmp_path / "x.qual").write_text(">a\n1 2\n40\n>b\n5 6\n")
    assert rows(files.read_fasta_with_quality(spark, str(tmp_path / "x.fa"), str(tmp_path / "x.qual")), "id", "seq", "qual") == [("@a", "ACG", '"#I'), ("@b", "TT", "&'")]


def test_keyed_joins(spark):
    a = T.keyed(spark.createDataFrame([("1", "x"), ("2", "y"), ("2", "z")], "id string, v string"), "id")
    b = T.keyed(spark.createDataFrame([("2", "p"), ("3", "q")], "id string, w string"), "id")
    n = {h: T.join(a, b, h).count() for h in ("in", "le", "ri", "ou", "xl", "xr", "ex")}
    assert n == {"in": 2, "le": 3, "ri": 3, "ou": 4, "xl": 1, "xr": 1, "ex": 2}
    assert [tuple(r) for r in T.join(a, b, "in", zip_duplicates=True).collect()] == [("2", "y", "p")]
    assert T.join_many([a, b, T.keyed(spark.createDataFrame([("2", "r")], "id string, u string"), "id")]).count() == 2


def test_large_files_stream(spark, tmp_path):
    """A file of many Arrow batches, in order, without its content as one value; and in the plan no content is read."""
    n = 45_000
    with gzip.open(tmp_path / "big.fq.gz", "wb", 1) as f:
        for i in range(n):
            f.write(b"@r%d\nACGT\n+\nIIII\n" % i)
    d = files.read_reads(spark, str(tmp_path / "big.fq.gz"))
    r = d.agg(F.count("*"), F.max("rec_no"), F.count_if(F.col("id") == F.concat(F.lit("@r"), "rec_no")), F.count("corrupt")).first()
    assert tuple(r) == (n, n - 1, n, 0)
    assert "ReadSchema: struct<path:string>" in d._jdf.queryExecution().executedPlan().toString()


def test_several_files_are_zipped_by_name(spark, tmp_path):
    from seqlake.operators import pairs as P, reads as R

    for side in (1, 2):
        (tmp_path / f"s{side}").mkdir()
        for lane in "ab":
            (tmp_path / f"s{side}/{lane}.fq").write_text("".join(f"@{lane}{i} {side}\nACGT{'ACGT'[i]}\n+\nIIIII\n" for i in range(3)))
    one, two = (files.read_reads(spark, str(tmp_path / f"s{side}")) for side in (1, 2))
    z = P.zip_mates(one, two)
    assert z.count() == 6 and P.verify_ids(z, " ", 1).count() == 6
    kept = R.first_seen(one, 5)  # b's records are copies of a's
    assert sorted(r["id"] for r in kept.collect()) == ["@a0 1", "@a1 1", "@a2 1"]


def test_reference(spark, tmp_path):
    import random

    rng = random.Random(2)
    seq = {c: "".join(rng.choice("ACGT") for _ in range(n)) for c, n in (("c1", 1000), ("c2", 37))}
    (tmp_path / "r.fa").write_text("".join(f">{c} x\n" + "\n".join(s[i : i + 60] for i in range(0, len(s), 60)) + "\n" for c, s in seq.items()))
    ref = files.read_reference(spark, str(tmp_path / "r.fa"), 100)
    assert ref.count() == 11 and [tuple(r) for r in files.contig_lengths(ref).orderBy("rank").collect()] == [("c1", 1000, 1), ("c2", 37, 2)]
    ask = [("c1", 1, 5), ("c1", 95, 310), ("c1", 990, 2000), ("c2", -3, 4), ("c2", 30, 37), ("c3", 1, 2), ("c1", 100, 100), ("c1", 101, 200), ("c1", 101, 200)]
    got = files.fetch(ref, spark.createDataFrame(ask, "contig string, beg long, en long"), 100).collect()
    assert sorted(map(tuple, got)) == sorted((c, b, e, seq.get(c, "")[max(b, 1) - 1 : e]) for c, b, e in ask)


def test_lines_and_intervals(spark, tmp_path):
    (tmp_path / "i.tsv").write_text("head\nchr\tbeg\ten\nx\t1\t5\n# no\ny\t3\t9\n")
    (tmp_path / "j.tsv").write_text("head\nother\nz\t2\t4\n")
    got = files.read_intervals(spark, str(tmp_path / "*.tsv"), skip=2).orderBy("chr").collect()
    assert [tuple(r)[:4] for r in got] == [("x", 1, 5, 2), ("y", 3, 9, 4), ("z", 2, 4, 2)]
    assert [r["value"] for r in files.head(spark, str(tmp_path / "i.tsv"), 2).collect()] == ["head", "chr\tbeg\ten"]
    assert [r["value"] for r in files.head(spark, str(tmp_path / "i.tsv"), size="16").collect()] == ["head", "chr\tbeg\ten"]
    assert [files.size_of(x) for x in ("12", "4k", "1.5m")] == [12, 4096, 1572864]
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2000")
    try:
        (tmp_path / "long.txt").write_text("".join(f"line {i}\n" for i in range(3000)))
        d = files.numbered_lines(spark, str(tmp_path / "long.txt"))
        assert d.count() == 3000 and d.where("value <> concat('line ', row)").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = {r["path"].rsplit("/", 1)[1]: r["lines"] for r in files.line_estimate(spark, str(tmp_path / "long.txt"), 4, 1000).collect()}
    assert abs(got["long.txt"] - 3000) < 60
    with gzip.open(tmp_path / "z.gz", "wb") as f:
        f.write(b"".join(b"line %d\n" % i for i in range(50_000)))
    assert abs(files.line_estimate(spark, str(tmp_path / "z.gz"), 4, 20_000).first()["lines"] - 50_000) < 5_000


def test_small_parsers(spark, tmp_path):
    (tmp_path / "s.stats").write_text("reads\t7\nnoise A:C\t0.25\nnoise A:G\t0.5\nplain\n")
    values, rates = files.read_stats(spark, str(tmp_path / "s.stats"))
    assert values["reads"] == "7" and sorted(map(tuple, rates.collect())) == [("noise", "A", "C", 0.25), ("noise", "A", "G", 0.5)]
    d = spark.createDataFrame([("<a><t x='1'>one</t>\n<t>two\n</t><tt>no</tt></a>",)], "value string")
    assert files.tagged(d, "t").first()["found"] == ["one", "two\n"]
    (tmp_path / "d.csv").write_text("#c\nK;V\na;1\na;2\nb;3\n")
    p = str(tmp_path / "d.csv")
    assert sorted(map(tuple, files.read_delimited(spark, p, sep=";", key="k", skip="#").collect())) == [("a", "2"), ("b", "3")]
    assert {r["k"]: len(r["rows"]) for r in files.read_delimited(spark, p, sep=";", key="k", multi=True, skip="#").collect()} == {"a": 2, "b": 1}
    sam = spark.createDataFrame([("q", "AC", "II")], "qname string, seq string, qual string")
    assert tuple(files.sam_as_reads(sam).first()) == ("@q", "AC", "+", "II")


def test_named_outputs(spark, tmp_path):
    d = spark.createDataFrame([("@a", "A", "I", "x", True), ("@b", "C", "I", "y", False), ("@c", "G", "I", None, None)], "id string, seq string, qual string, bc string, keep boolean")
    assert sinks.write_named(d, "n/a", "bc", ["x"]) == {}
    made = sinks.write_named(d, str(tmp_path / "o.%.fq"), "bc", ["x", "y"])
    assert {v: files.read_reads(spark, p).first()["id"] for v, p in made.items()} == {"x": "@a", "y": "@b"}
    sinks.write_outcomes(d, "bc", {"x": str(tmp_path / "only")})
    assert files.read_reads(spark, str(tmp_path / "only")).count() == 1
    sinks.write_good_bad(d, str(tmp_path / "g"), str(tmp_path / "b"))
    assert [spark.read.parquet(str(tmp_path / x)).count() for x in "gb"] == [1, 2]


def test_regions_prune_files(spark, tmp_path):
    rows = [(f"q{i}", f"c{i % 2}", 1 + i * 40_000, "100M") for i in range(60)] + [("long", "c0", 5, "10M3000000N10M")]
    d = spark.createDataFrame(rows, "qname string, rname string, pos int, cigar string")
    T.write_by_region(d, str(tmp_path / "r"))
    back = spark.read.parquet(str(tmp_path / "r"))
    for beg, en in ((1_200_000, 1_300_000), (1, 10), (2_999_000, 2_999_999)):
        want = {q for q, c, p, g in rows if c == "c0" and p <= en and p + (99 if g == "100M" else 3_000_019) >= beg}
        assert {r["qname"] for r in T.in_region(back, "c0", beg, en).collect()} == want == {r["qname"] for r in T.in_region(d, "c0", beg, en).collect()}


def test_interval_index(spark, tmp_path):
    i = spark.createDataFrame([("x", 1, 5, "p"), ("x", 4, 9, "q"), ("y", 2, 2, "r")], "chr string, beg long, en long, name string")
    T.IntervalIndex.build(i, "name", "v1").save(str(tmp_path / "i"))
    with pytest.raises(ValueError):
        T.IntervalIndex.load(spark, str(tmp_path / "i"), "v2")
    x = T.IntervalIndex.load(spark, str(tmp_path / "i"), "v1")
    p = spark.createDataFrame([("x", 4), ("x", 9), ("x", 10), ("y", 2)], "chr string, pos long")
    assert {(r["chr"], r["pos"]): r["rows"] for r in x.lookup(p).collect()} == {("x", 4): ["p", "q"], ("x", 9): ["q"], ("y", 2): ["r"]}
    r = spark.createDataFrame([("x", 5, 20, 1), ("y", 3, 4, 2)], "chr string, b_beg long, b_en long, id int")
    assert [(r["id"], r["rows"]) for r in x.lookup_ranges(r, "id").collect()] == [(1, ["p", "q"])]


def test_intervals_of_any_length(spark):
    """Short, long and contig-long intervals, some across zero, against all pairs; each is one row of its side."""
    import random

    rng = random.Random(6)
    made = lambda n: [(c, b, b + rng.choice([0, 5, 100, 5000, 10**6, 3 * 10**9, 2**40]), i) for i in range(n) for c in [rng.choice("xy")] for b in [rng.randrange(-500, rng.choice([300, 10**4, 10**8]))]]
    a, b = made(120), made(120)
    x, y = spark.createDataFrame(a, "chr string, beg long, en long, aid int"), spark.createDataFrame(b, "chr string, b_beg long, b_en long, bid int")
    want = sorted((i, j) for c, p, q, i in a for d, r, s, j in b if c == d and p <= s and q >= r)
    assert sorted((r["aid"], r["bid"]) for r in T.overlaps(x, y).collect()) == want
    pts = [(rng.choice("xy"), rng.randrange(-600, rng.choice([300, 10**8])), i) for i in range(100)]
    hit = sorted((k, i) for c, p, k in pts for d, lo, hi, i in a if c == d and lo <= p <= hi)
    assert sorted((r["pid"], r["aid"]) for r in T.points_in(spark.createDataFrame(pts, "chr string, pos long, pid int"), x).collect()) == hit
