"""Queries of sources, sinks, functions, filters, joins and aggregates that the catalogue's first ones leave out, with their SQL."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, functions as F

from seqlake.functions import cigar as C, qual as Q, seq as S, sql as sql_functions, stats
from seqlake.operators import alignments as A, local, pairs as P, reads as R, tables as T
from seqlake.plans.catalogue import ADAPTERS, BARCODES, INTERVALS, POINTS, Q33, R6, W, _AD, _AL, _CLIP, _DX, _GTF, _LOW, _RUNS, _long, _reads, _t, query
from seqlake.plans.calling import SHOWN, _pileup
from seqlake.plans.derived import ALIGNMENTS, view
from seqlake.sources import files, sinks
from seqlake.streaming import streams


def scratch(spark, name: str) -> str:
    """A new path in the folder that all machines share; a local one only where the master is local and none is set."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        base = "file://" + tempfile.mkdtemp(prefix="seqlake-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/queries/{name}-{uuid.uuid4().hex}"


def _longs(df: DataFrame, *names: str) -> list:
    return [F.col(n).cast("bigint").alias(n) for n in names]


# --- sources and sinks: what is written is read back

@query(f"{W} select '@r'||rec_no as id, seq, qual, true as fine from reads")
def source_fastq(spark, d):
    path = scratch(spark, "fastq")
    sinks.write_fastq(_reads(spark, d).withColumn("id", F.concat(F.lit("@r"), "rec_no")), path, ordered=False, gzip=True)
    return files.read_reads(spark, path).select("id", "seq", "qual", F.col("corrupt").isNull().alias("fine"))


@query(f"{W} select '@r'||rec_no as id, seq, repeat('h',64) as qual from reads")
def source_fasta(spark, d):
    path = scratch(spark, "fasta")
    sinks.fasta_text(_reads(spark, d).withColumn("id", F.concat(F.lit("@r"), "rec_no"))).write.text(path)
    return files.read_reads(spark, path).select("id", "seq", "qual")


def _sam(spark, d) -> str:
    path = scratch(spark, "sam")
    a = view(spark, d, ALIGNMENTS)
    a.select(F.concat_ws("\t", "qname", "flag", "rname", "pos", "mapq", "cigar", F.lit("*"), F.lit("0"), F.lit("0"), "seq", "qual", F.concat(F.lit("NM:i:"), "nm"), F.lit("XT:A:U"))).write.text(path)
    return path


@query(f"{_AL} select qname, flag::bigint as flag, rname, pos::bigint as pos, mapq::bigint as mapq, cigar, nm::bigint as nm, 'U' as xt, seq, qual from a")
def source_sam(spark, d):
    s = files.read_alignments(spark, _sam(spark, d))
    return s.select("qname", *_longs(s, "flag", "pos", "mapq", "nm"), "rname", "cigar", F.col("tags")["XT"].alias("xt"), "seq", "qual")


@query(f"{_AL} select '@'||qname as id, seq, '+' as com, qual from a")
def source_sam_reads(spark, d):
    return files.sam_as_reads(files.read_sam(spark, _sam(spark, d)))


@query(f"{SHOWN} select distinct chr, pos, substr('ACGT',(pos%4+1)::int,1) as ref, depth::bigint as depth, depth::bigint as scores from depths")
def source_pileup(spark, d):
    path = scratch(spark, "pileup")
    _pileup(spark, d).select(F.concat_ws("\t", "chr", "pos", "ref", "depth", "bases", "quals")).write.text(path)
    p = files.read_pileup(spark, path)
    return p.select("chr", *_longs(p, "pos", "depth"), "ref", F.length("quals").cast("bigint").alias("scores"))


@query(f"with i as ({INTERVALS}) select chr::varchar as chr, beg, (en-1)::bigint as en, iid::varchar as iid from i")
def source_intervals(spark, d):
    path = scratch(spark, "intervals")
    i = view(spark, d, INTERVALS)
    i.select(F.concat_ws("\t", "iid", "chr", "beg", "en")).union(spark.createDataFrame([("#no\tx\t1\t2",), ("name\tchr\tbeg\tend",)], "v string")).write.text(path)
    return files.read_intervals(spark, path, chr=1, beg=2, en=3, half_open=True).select("chr", "beg", "en", F.split_part("line", F.lit("\t"), F.lit(1)).alias("iid"))


@query(f"with g as ({_GTF}) select transcript_id, 'g'||transcript_id as gene_id, feature, beg, en from g")
def source_gtf(spark, d):
    path = scratch(spark, "gtf")
    attrs = F.concat(F.lit('gene_id "g'), "transcript_id", F.lit('"; transcript_id "'), "transcript_id", F.lit('";'))
    view(spark, d, _GTF).select(F.concat_ws("\t", "chr", F.lit("x"), "feature", "beg", "en", F.lit("."), "strand", F.lit("."), attrs)).write.text(path)
    return files.read_gtf(spark, path).select("transcript_id", "gene_id", "feature", "beg", "en")


@query("select 'p'||c_custkey as probe, 'chr'||c_nationkey as chr, (c_custkey*10+k*7-1)::bigint as beg, (c_custkey*10+k*7+25)::bigint as en, case when k=0 then '+' end as strand from customer, unnest(range(0,2)) u(k)")
def source_array(spark, d):
    one = lambda k, tail: F.concat(F.lit("chr"), "c_nationkey", F.lit(":"), F.col("c_custkey") * 10 + k * 7, F.lit("-"), F.col("c_custkey") * 10 + k * 7 + 25, F.lit(tail))
    x = _t(spark, d, "customer").select(F.concat(F.lit("p"), "c_custkey").alias("probe"), F.concat_ws(" /// ", one(0, " (+)"), one(1, ""), F.lit("---")).alias("alignments"))
    return T.array_alignments(x).select("probe", "chr", "beg", "en", "strand")


@query("select n_regionkey::varchar as region, count(*)::bigint as n, max(n_name) as last from nation group by 1")
def source_delimited(spark, d):
    path = scratch(spark, "delimited")
    _t(spark, d, "nation").select(F.col("n_regionkey").alias("Region"), F.col("n_name").alias("Name")).write.csv(path, header=True, sep=";", quote="'", quoteAll=True)
    x = files.read_delimited(spark, path, key="region", multi=True)
    return x.select("region", F.size("rows").cast("bigint").alias("n"), F.array_max(F.transform("rows", lambda r: r["name"])).alias("last"))


@query(f"with b as ({BARCODES}) select bid::varchar as bid, bc, case when bid%2=0 then 'AC' end as bc2, 'g'||(bid%3) as grp from b")
def source_barcodes(spark, d):
    path = scratch(spark, "barcodes")
    b = view(spark, d, BARCODES)
    b.select(F.concat_ws(" ", "bid", F.concat(F.lower("bc"), F.when(F.col("bid") % 2 == 0, "-ac").otherwise("")), F.concat(F.lit("g"), F.col("bid") % 3))).union(spark.createDataFrame([("# none",), ("",), ("id seq style",)], "v string")).write.text(path)
    return files.read_barcodes(spark, path)


@query("select 'n'||n_nationkey as id, translate(substr(translate(md5(n_name),'0123456789abcdef','ACGUACGUACGUACGU'),1,12),'U','T') as seq from nation")
def source_adapters(spark, d):
    path = scratch(spark, "adapters")
    seq = F.substring(F.translate(F.md5(F.col("n_name").cast("binary")), "0123456789abcdef", "acguacguacguacgu"), 1, 12)
    _t(spark, d, "nation").select(F.concat(F.lit("> n"), "n_nationkey", F.lit("\n"), seq)).write.text(path)
    return files.read_adapters(spark, path)


@query(f"{W} select 'r'||rec_no as contig, 5::bigint as beg, (20+rec_no%60)::bigint as en, substr(seq,5,(16+rec_no%60)::int) as bases from reads")
def reference_fetch(spark, d):
    """Stretches of a reference in pieces of 16 bases; some end past a contig's end."""
    path = scratch(spark, "reference")
    _reads(spark, d).select(F.concat(F.lit(">r"), "rec_no", F.lit(" x\n"), F.substring("seq", 1, 40), F.lit("\n"), F.substring("seq", 41, 24))).write.text(path)
    ask = _reads(spark, d).select(F.concat(F.lit("r"), "rec_no").alias("contig"), F.lit(5).cast("long").alias("beg"), (20 + F.col("rec_no") % 60).alias("en"))
    return files.fetch(files.read_reference(spark, path, 16), ask, 16)


@query("select n_name as k, (n_nationkey*0.25)::double as rate, substr(n_name,1,1) as ref, 'X' as base from nation where n_regionkey=1")
def stats_reread(spark, d):
    path = scratch(spark, "stats")
    n = _t(spark, d, "nation")
    n.select(F.concat(F.col("n_name"), F.lit(" "), F.substring("n_name", 1, 1), F.lit(":X\t"), F.col("n_nationkey") * 0.25)).where(n["n_regionkey"] == 1).write.text(path)
    return files.read_stats(spark, path)[1].select(F.col("name").alias("k"), "rate", "ref", "base")


@query(f"with i as ({INTERVALS}), p as ({POINTS}) select p.chr, pos, pid, string_agg(iid::varchar,',' order by iid) as rows from p join i on p.chr=i.chr and pos between beg and en group by all")
def interval_index(spark, d):
    """Tiles built, saved, loaded and looked up."""
    path = scratch(spark, "tiles")
    T.IntervalIndex.build(view(spark, d, INTERVALS), "iid", "inclusive").save(path)
    x = T.IntervalIndex.load(spark, path, "inclusive").lookup(view(spark, d, POINTS))
    return x.select("chr", "pos", "pid", F.array_join(F.transform("rows", lambda r: r.cast("string")), ",").alias("rows"))


@query(f"{_AL} select qname, pos::bigint as pos, cigar from a where rname='c3' and pos<=2000 and pos+(case cigar when '30M2I32M' then 62 when '20M3D44M' then 67 else 64 end)-1>=1000")
def region_query(spark, d):
    path = scratch(spark, "regions")
    T.write_by_region(view(spark, d, ALIGNMENTS), path)
    return T.in_region(spark.read.parquet(path), "c3", 1000, 2000).select("qname", F.col("pos").cast("bigint").alias("pos"), "cigar")


@query("select n_nationkey::bigint as id, 'x'||n_name||'|'||n_regionkey as found from nation")
def tagged_fields(spark, d):
    n = _t(spark, d, "nation").select("n_nationkey", F.concat(F.lit("<r><v a='1'>x"), "n_name", F.lit("</v>\n<w>no</w><v>"), "n_regionkey", F.lit("</v></r>")).alias("value"))
    return files.tagged(n, "v").select(F.col("n_nationkey").cast("bigint").alias("id"), F.array_join("found", "|").alias("found"))


@query(f"{_DX} select coalesce(barcode::varchar,'unmatched') as barcode, count(*)::bigint as n from a group by 1")
def sink_by_barcode(spark, d):
    path = scratch(spark, "demux")
    sinks.write_by(P.assign(_reads(spark, d).withColumn("id", F.concat(F.lit("@"), "rec_no")), view(spark, d, BARCODES), 2, 2), path, "barcode")
    t = spark.read.text(path)
    return t.where("value like '@%' and value rlike '^@[0-9]+$'").groupBy(F.col("barcode").cast("string").alias("barcode")).agg(F.count("*").alias("n"))


@query(f"{W} select 'reads' as metric, count(*)::varchar as value from reads union all select 'most', max(length(seq))::varchar from reads")
def sink_report(spark, d):
    return sinks.report(_reads(spark, d).agg(F.count("*").alias("reads"), F.max(F.length("seq")).alias("most")))


@query(f"{W} select rec_no, mate::bigint as mate from reads, unnest([1,2]) u(mate) where rec_no<500")
def sink_interleaved(spark, d):
    r = _reads(spark, d)
    return sinks.interleaved(r, r, 500).select("rec_no", F.col("mate").cast("bigint").alias("mate"))


@query(f"{_AL}, b as (select qname, max((mapq, -nm)) as b from a where flag&256<>0 group by 1) select (b.b is null or (mapq,-nm)>=b.b) as good, count(*)::bigint as n from a left join b using (qname) group by 1")
def sink_good_bad(spark, d):
    a, path = view(spark, d, ALIGNMENTS), scratch(spark, "best")
    sinks.write_good_bad(A.best_mapping(a, a.where(F.col("flag").bitwiseAND(F.lit(256)) != 0)), path + "/good", path + "/bad")
    side = lambda name, good: spark.read.parquet(f"{path}/{name}").select(F.lit(good).alias("good"))
    return side("good", True).union(side("bad", False)).groupBy("good").agg(F.count("*").alias("n"))


@query(f"""{_AL}, m as (select qname, case when flag&16<>0 then reverse(translate(seq,'ACGT','TGCA')) else seq end as s from a where flag&256=0) select qname as name, min(s) as seq, count(*)::bigint as n from m group by 1""")
def sink_mates(spark, d):
    return A.mates(view(spark, d, ALIGNMENTS)).select("name", F.col("r1.seq").alias("seq"), "n")


# --- functions

@query(f"{W} select rec_no, (case substr(seq,1,1) when 'A' then 0 when 'C' then 1 when 'G' then 2 when 'T' then 3 else 4 end)::bigint as ix from reads")
def function_base_index(spark, d):
    return _reads(spark, d).select("rec_no", S.base_index(F.substring("seq", 1, 1)).cast("bigint").alias("ix"))


@query(f"{W}, q as (select rec_no, {Q33} as q from reads) select rec_no, (list_sum(q[8:14])//7)::bigint as inner_mean, (list_sum(q[1:4])//4)::bigint as first_mean from q")
def function_window_mean(spark, d):
    q = _reads(spark, d).select("rec_no", Q.scores(F.col("qual")).alias("q"))
    return q.select("rec_no", Q.window_mean(F.col("q"), F.lit(10), 7).cast("bigint").alias("inner_mean"), Q.window_mean(F.col("q"), F.lit(0), 7).cast("bigint").alias("first_mean"))


@query(f"""{W}, q as (select rec_no, i, ascii(substr(qual,i::int,1))-33 as q from reads, unnest(range(1,65)) u(i))
select rec_no, string_agg(chr((33+least(38,greatest(0,q+3-case when i=2 then 5 else 0 end-case when i=64 then 9 else 0 end)))::int),'' order by i) as qual from q group by rec_no""")
def function_adjust(spark, d):
    return _reads(spark, d).select("rec_no", Q.adjust(F.col("qual"), 3, 38, by_cycle={2: -5, -1: -9}).alias("qual"))


@query(f"{W} select rec_no, string_agg(case when ascii(substr(qual,i::int,1))-33<20 then 'N' else substr(seq,i::int,1) end,'' order by i) as seq from reads, unnest(range(1,65)) u(i) group by rec_no")
def function_masked(spark, d):
    return _reads(spark, d).select("rec_no", Q.masked(F.col("seq"), F.col("qual"), 20).alias("seq"))


@query(f"{W} select rec_no, substr(seq,1,30) as seq, substr(qual,1,30) as qual from reads")
def function_cut_length(spark, d):
    return R.cut_length(_reads(spark, d), 30).select("rec_no", "seq", "qual")


@query("select p_partkey, least(p_size,greatest(1,floor(-ln(p_size/60.0)/ln(2.2))))::bigint as clip from part")
def function_clip_length(spark, d):
    return _t(spark, d, "part").select("p_partkey", stats.clip_length(F.col("p_size"), F.lit(60.0), F.col("p_size")).cast("bigint").alias("clip"))


@query("select p_partkey, round(p_size/60.0,5)::double as p from part")
def function_normal(spark, d):
    """The quantile's probability is what it was asked for."""
    return _t(spark, d, "part").select("p_partkey", F.round(stats.pnorm(stats.qnorm(F.col("p_size") / 60.0)), 5).alias("p"))


@query("select l_orderkey, l_linenumber, floor(sqrt(floor(l_partkey*l_partkey/(l_suppkey+1))))::bigint as r from lineitem")
def function_rms(spark, d):
    return _t(spark, d, "lineitem").select("l_orderkey", "l_linenumber", Q.rms(F.col("l_partkey") * F.col("l_partkey"), F.col("l_suppkey") + 1).cast("bigint").alias("r"))


@query(f"{W} select rec_no, '1:'||(rec_no%7)||':9' as name from reads")
def function_read_name(spark, d):
    return _reads(spark, d).select("rec_no", S.read_name(F.concat(F.lit("M01:22:1:"), F.col("rec_no") % 7, F.lit(":9 1:N:0"))).alias("name"))


@query(f"""{W}, k as (select rec_no, translate(substr(seq,1,12),'N','A') as k from reads), p as (select rec_no, k, list_sum([pow(4,12-i)*(strpos('ACGT',substr(k,i::int,1))-1) for i in range(1,13)])::bigint as code, reverse(translate(k,'ACGT','TGCA')) as rc from k)
select rec_no, code, k as back, list_sum([pow(4,12-i)*(strpos('ACGT',substr(rc,i::int,1))-1) for i in range(1,13)])::bigint as rc_code from p""")
def function_pack(spark, d):
    code = S.pack2(F.translate(F.substring("seq", 1, 12), "N", "A"))
    x = _reads(spark, d).select("rec_no", code.alias("code"))
    return x.select("rec_no", "code", S.unpack2(F.col("code"), 12).alias("back"), S.pack2_revcomp(F.col("code"), 12).alias("rc_code"))


@query("select n_nationkey, n_regionkey||'|new'||n_name||'|'||n_nationkey as row from nation")
def function_replace_field(spark, d):
    row = F.concat_ws("|", "n_regionkey", "n_name", "n_nationkey")
    return _t(spark, d, "nation").select("n_nationkey", S.replace_field(row, 2, F.concat(F.lit("new"), "n_name"), r"\|").alias("row")).withColumn("row", F.replace("row", F.lit("\\|"), F.lit("|")))


@query("select n_nationkey, 'X'||n_nationkey as chr from nation")
def function_strip_chr(spark, d):
    return _t(spark, d, "nation").select("n_nationkey", S.strip_chr(F.concat(F.when(F.col("n_nationkey") % 2 == 0, "chr").otherwise("CHR"), F.lit("X"), "n_nationkey")).alias("chr"))


@query("select o_orderkey, (case when o_orderstatus='F' then 0 when o_custkey%5=0 then 3 when o_custkey%2=0 then 1 else 2 end)::bigint as code from orders")
def function_genotype_distance(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", S.genotype_distance(F.col("o_orderstatus") != "F", F.col("o_custkey") % 2 == 0, F.col("o_custkey") % 5 == 0).cast("bigint").alias("code"))


@query("select o_orderkey, upper(printf('%x', o_orderkey)) as hex, printf('%b', o_orderkey) as bin, (o_orderkey-1)::bigint as zero_based from orders")
def function_bases_of_numbers(spark, d):
    return _t(spark, d, "orders").select("o_orderkey", F.conv(F.col("o_orderkey").cast("string"), 10, 16).alias("hex"), F.bin("o_orderkey").alias("bin"), (F.col("o_orderkey") - 1).alias("zero_based"))


@query(f"{W} select rec_no, '@M1:7:'||(rec_no%8)||':1101:'||rec_no||':'||(rec_no*3)||' 1:'||case when rec_no%9=0 then 'Y' else 'N' end as id from reads")
def function_instrument_name(spark, d):
    lit = F.lit
    n = S.instrument_name(lit("M1"), lit(7), F.col("rec_no") % 8, lit(1101), F.col("rec_no"), F.col("rec_no") * 3, lit(1), F.col("rec_no") % 9 != 0)
    return _reads(spark, d).select("rec_no", n.alias("id"))


@query(f"{W} select rec_no, substr(seq,1,6) as bc, substr(seq,7,4) as bc2, 'hhhhhh' as q, 'hhhh' as q2 from reads")
def function_header_barcode(spark, d):
    name = F.concat(F.lit("@M1:1 1:N:0:"), F.substring("seq", 1, 6), F.lit("+"), F.substring("seq", 7, 4))
    b = _reads(spark, d).select("rec_no", S.header_barcodes(name).alias("b"))
    return b.select("rec_no", "b.bc", "b.bc2", F.col("b.qual").alias("q"), F.col("b.qual2").alias("q2"))


@query(f"{_AL} select qname, pos::bigint as pos, case when cigar='*' then '*' else '64M' end as plain from a")
def function_plain_cigar(spark, d):
    return view(spark, d, ALIGNMENTS).select("qname", F.col("pos").cast("bigint").alias("pos"), C.plain(F.col("cigar")).alias("plain"))


@query(f"""{_AL} select qname, case k when 0 then 'x1' else 'x2' end as rname, (pos+k)::bigint as pos, (case when k=1 then flag|16|256 else (flag-(flag&16))|256 end)::bigint as flag,
  case when (flag&16<>0)<>(k=1) then reverse(translate(seq,'ACGT','TGCA')) else seq end as seq from a, unnest([0,1]) u(k)""")
def alignment_alternatives(spark, d):
    xa = F.concat(F.lit("x1,+"), "pos", F.lit(",64M,0;x2,-"), F.col("pos") + 1, F.lit(",64M,1;"))
    x = A.expand_alternatives(view(spark, d, ALIGNMENTS).withColumn("xa", xa))
    return x.select("qname", "rname", *_longs(x, "pos", "flag"), "seq")


@query(f"{W} select rec_no, 60::bigint as score, 10::bigint as a_begin, 30::bigint as a_end, 0::bigint as b_begin, 20::bigint as b_end from reads")
def local_alignment(spark, d):
    """A stretch of a read is found in it, whole."""
    r = _reads(spark, d).select("rec_no", local.align(F.col("seq"), F.substring("seq", 11, 20)).alias("x")).select("rec_no", "x.*")
    return _long(r)


@query(f"{W} select rec_no, 0::bigint as part, seq from reads union all select rec_no, 1, substr(seq,1,40) from reads")
def split_long_reads(spark, d):
    """Reads cut at the copies of an adapter; the last piece is too short."""
    adapter = "GATTACAGATTACCAGGATTTACAGATTAC"
    x = _reads(spark, d).select("rec_no", F.concat("seq", F.lit(adapter), F.substring("seq", 1, 40), F.lit(adapter), F.substring("seq", 1, 9)).alias("seq")).withColumn("qual", F.repeat(F.lit("I"), F.length("seq")))
    return local.split_reads(x, adapter, 20).select("rec_no", F.col("part").cast("bigint").alias("part"), "seq")


@query(f"{W} select count(*)::bigint as reads, 2*count(*)::bigint as parts, (104*count(*))::bigint as bases, 40::bigint as len_min, 64::bigint as len_max, 2.0::double as q1, 2.0::double as median, 2.0::double as q3 from reads")
def split_summary(spark, d):
    return _long(local.part_summary(split_long_reads(spark, d)))


# --- filters

@query(f"""{W}, m as (select rec_no, substr(seq,1,(20+rec_no%30)::int) as s1, substr(seq,31,(10+rec_no%20)::int) as s2, (rec_no%3)::int as cut from reads),
h as (select *, (select count(*) from range(2,length(s1)+1) u(i) where substr(s1,i::int,1)='N' or substr(s1,i::int,1)=substr(s1,i::int-1,1))+(select count(*) from range(2,length(s2)+1) u(i) where substr(s2,i::int,1)='N' or substr(s2,i::int,1)=substr(s2,i::int-1,1)) as h from m)
select rec_no, case when length(s1)<case when cut=0 then 25 else 22 end then 'short1' when length(s2)<case when cut=0 then 25 else 15 end then 'short2' when h>=floor(0.3*(length(s1)+length(s2)-2)) then 'homopolymer' end as why from h""")
def template_filter(spark, d):
    """Mates judged together: lengths by mate, repeats pooled."""
    m = _reads(spark, d).select("rec_no", F.substr(F.col("seq"), F.lit(1), (20 + F.col("rec_no") % 30).cast("int")).alias("s1"), F.substr(F.col("seq"), F.lit(31), (10 + F.col("rec_no") % 20).cast("int")).alias("s2"), (F.col("rec_no") % 3).alias("cut"))
    f = R.MateLimits((22, 15), 25, homopolymer=0.3)
    return m.select("rec_no", R.template_reason(f, [F.col("s1"), F.col("s2")], [F.col("cut"), F.col("cut")]).alias("why"))


@query(f"{W} select rec_no from reads where rec_no%9<>0")
def purity_filter(spark, d):
    r = _reads(spark, d).withColumn("id", F.concat(F.lit("@r 1:"), F.when(F.col("rec_no") % 9 == 0, "Y").otherwise("N"), F.lit(":0:AC")))
    return R.filtered(r, R.Filters(min_length=1, purity=True)).select("rec_no")


@query(f"""{W}, o as (select rec_no, seq, k, aseq, off, least(off,length(aseq)) as n, hamming(substr(aseq,1,least(off,length(aseq))::int), substr(seq,(65-off)::int,least(off,length(aseq))::int)) as h
  from reads, (values {_CLIP}) a(k,aseq,lo), unnest(range(lo,65)) u(off)) select distinct rec_no from o where h<=(20*n)//100""")
def only_clipped(spark, d):
    from seqlake.plans.catalogue import MATCHED

    return R.only_clipped(R.clip_adapters(_reads(spark, d), MATCHED, 20.0)).select("rec_no")


@query(f"{W} select rec_no, rec_no%4 as file from reads where rec_no%4<>1")
def lane_filter(spark, d):
    r = _reads(spark, d).withColumn("file", F.col("rec_no") % 4).withColumn("seq", F.when(F.col("file") == 1, F.substring("seq", 1, 8)).otherwise(F.col("seq")))
    return R.without_index_lanes(r).select("rec_no", "file")


@query(f"{W}, s as (select rec_no, list_sum([case when substr(seq,i::int,1)='N' or {_LOW} then 1 else 0 end for i in range(2,65)]) as low, seq from reads), f as (select seq from s where low<floor(0.5*63)) select substr(seq,i::int,9) as kmer, count(*)::bigint as n from f, unnest(range(1,57)) u(i) where not contains(substr(seq,i::int,9),'N') group by 1")
def signature_filter(spark, d):
    """k-mers of the reads that are not of low complexity."""
    return R.kmer_counts(R.filtered(_reads(spark, d), R.Filters(min_length=9, low_complexity=0.5)), 9)


@query(f"{W}, f as (select *, rec_no%3 as file, rec_no//3 as n from reads) select file, n, seq from f qualify row_number() over (partition by substr(seq,1,20) order by file, n)=1")
def first_of_files(spark, d):
    """The first read of each prefix over several files, each of which counts its records from 0."""
    r = _reads(spark, d).select((F.col("rec_no") % 3).alias("file"), F.floor(F.col("rec_no") / 3).alias("rec_no"), "seq")
    return R.first_seen(r, 20).select("file", F.col("rec_no").alias("n"), "seq")


# --- joins

@query(f"{W} select (rec_no%3+1)::bigint as lane, rec_no//3 as rec_no, substr(seq,1,20) as a, substr(seq,41,20) as b from reads")
def zip_mates(spark, d):
    """Mates in files of three lanes each, paired by lane and record."""
    r = _reads(spark, d)
    side = lambda name, at: r.select(F.concat(F.lit(name), F.col("rec_no") % 3).alias("file"), F.floor(F.col("rec_no") / 3).alias("n"), F.concat(F.lit("@r"), "rec_no", F.lit(" "), F.lit(name)).alias("id"), F.substring("seq", at, 20).alias("seq"), F.substring("qual", at, 20).alias("qual")).withColumnRenamed("n", "rec_no")
    z = P.verify_ids(P.zip_mates(side("one", 1), side("two", 41)), " ", 1)
    return z.select(F.col("lane").cast("bigint").alias("lane"), "rec_no", F.col("r1.seq").alias("a"), F.col("r2.seq").alias("b"))


@query("select o_orderkey as qname, (o_custkey)::bigint as p1, (o_custkey+180)::bigint as p2, 20.0::double as off from orders")
def nearest_mates(spark, d):
    o = _t(spark, d, "orders")
    mate = lambda flag, shift: o.select(F.col("o_orderkey").alias("qname"), F.lit("c").alias("rname"), F.lit(flag).alias("flag"), (F.col("o_custkey") + shift).cast("int").alias("pos"))
    return _long(A.nearest_mates(mate(64, 0).union(mate(128, 900)).union(mate(128, 180)), 200.0).drop("rname"))


@query("""with p as (select o_orderkey as qname, k, o_custkey+k*50 as p1, o_custkey+k*50+100+o_orderkey%300 as p2, (k+o_orderkey)%3 as nm from orders, unnest([0,1]) u(k)),
f as (select *, p2+50-p1 as span from p where p1>=1 and p2+49<=1800 and p2+50-p1 between 120 and 350) select qname, p1::bigint as p1, p2::bigint as p2, nm::bigint as nm, span::bigint as span from f qualify row_number() over (partition by qname order by nm, span, p1, p2)=1""")
def proper_pairs(spark, d):
    o = _t(spark, d, "orders").select(F.col("o_orderkey").alias("qname"), "o_custkey", F.explode(F.array(F.lit(0), F.lit(1))).alias("k"))
    x = o.select("qname", F.lit("c").alias("rname"), (F.col("o_custkey") + F.col("k") * 50).alias("p1"), (F.col("o_custkey") + F.col("k") * 50 + 100 + F.col("qname") % 300).alias("p2"), F.lit(50).alias("len1"), F.lit(50).alias("len2"), F.lit(False).alias("reverse1"), F.lit(True).alias("reverse2"), ((F.col("k") + F.col("qname")) % 3).alias("nm"))
    best = A.proper_pairs(x, spark.createDataFrame([("c", 1800)], "name string, length int"), 350, 120)
    return best.select("qname", *_longs(best, "p1", "p2", "nm", "span"))


@query(f"{W}, p as ({BARCODES}), s as (select distinct substr(seq,1,10) as seq from reads), m as (select s.seq, min('b'||lpad(bid::varchar,3,'0')) as name from s join p on contains(s.seq, substr(bc,1,4)) group by 1) select s.seq, name from s left join m using (seq)")
def annotate_species(spark, d):
    """Sequences named by the first pattern that they hold."""
    p = view(spark, d, BARCODES).select(F.concat(F.lit("b"), F.lpad(F.col("bid").cast("string"), 3, "0")).alias("name"), F.substring("bc", 1, 4).alias("seq"))
    return P.annotated(_reads(spark, d).select(F.substring("seq", 1, 10).alias("seq")).distinct(), p)


@query("select o_orderkey, case when o_orderkey%2=0 then 'new'||o_custkey else 'c'||o_custkey end as alignment from orders")
def lifted_alignments(spark, d):
    o = _t(spark, d, "orders").select("o_orderkey", F.concat(F.lit("c"), "o_custkey").alias("alignment"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    chain = _t(spark, d, "customer").select(F.concat(F.lit("c"), "c_custkey").alias("alignment"), F.concat(F.lit("new"), "c_custkey").alias("lifted"))
    return T.lifted(o.where("even"), chain).unionByName(o.where("not even")).drop("even")


@query(f"with i as ({INTERVALS}), a as (select chr, (beg+1) as beg, en from i) select i.chr, i.beg, i.en, iid, exists(select 1 from a where a.chr=i.chr and abs(a.beg-i.beg)<=1 and abs(a.en-i.en)<=1) as amplicon from i")
def amplicon_ends(spark, d):
    i = view(spark, d, INTERVALS)
    return T.at_amplicon_ends(i, i.select("chr", (F.col("beg") + 1).alias("beg"), "en")).select("chr", "beg", "en", "iid", "amplicon")


# --- aggregates

@query(f"""{W}, s as (select 'CCC'||substr(seq,4) as seq from reads), c as (select i-1 as cycle, count(*) as n, {', '.join(f"100.0*count(*) filter (where substr(seq,i::int,1)='{b}')/count(*) as {b}" for b in 'ACGT')} from s, unnest(range(1,65)) u(i) group by i)
select false as from_end, cycle::bigint as cycle, 'A' as base, "A"::double as share from c where "A"<2 and cycle<3""")
def skewed_cycles(spark, d):
    r = _reads(spark, d).select(F.concat(F.lit("CCC"), F.substring("seq", 4, 61)).alias("seq"))
    return R.skewed_cycles(r).select("from_end", F.col("cycle").cast("bigint").alias("cycle"), "base", "share")


@query(f"""{W}, x as (select id, aseq, strpos(substr(seq,2),substr(aseq,1,5)) as e, case when strpos(aseq,substr(seq,1,5))>0 then strpos(aseq,substr(seq,1,5))-1 else -1 end as b from reads, {_AD}),
c as (select id, aseq as seq, count(*) filter (where e>0) as ae, count(*) filter (where e=59) as aex, count(*) filter (where b>=0) as ab, count(*) filter (where b>=0 and b=length(aseq)-5) as abx, count(*) as s from x group by all),
f as (select *, case when id like '%\\_3p%' escape '\\' then 'e' when id like '%\\_5p%' escape '\\' then 'b' when ae+10*aex>=ab+10*abx then 'e' else 'b' end as side from c where ae>floor(s*0.05/100) or ab>floor(s*0.05/100)), g as (select *, case when side='e' then ae else ab end as n from f)
select id, seq, side as "end", n::bigint as n, least(length(seq),greatest(1,floor(-ln(greatest(n,1)/s::double)/ln(2.2))))::bigint as clip from g""")
def adapter_ends(spark, d):
    c = R.adapter_counts(_reads(spark, d), spark.createDataFrame(ADAPTERS, "id string, seq string"), 5)
    return _long(R.adapter_ends(c, 0.05))


@query(f"""{W}, t as (select length(regexp_extract(seq,'^N*')) as clip_start, length(regexp_extract(seq,'N*$')) as clip_end from reads)
select {', '.join(f"count(*) filter (where {c}>0)::bigint as {c}_n, coalesce(round(avg({c}) filter (where {c}>0),6),0)::double as {c}_mean, coalesce(round(stddev_samp({c}) filter (where {c}>0),6),0)::double as {c}_sd" for c in ('clip_start', 'clip_end'))} from t""")
def trim_summary(spark, d):
    t = R.trim_summary(_reads(spark, d).select(S.n_run_start(F.col("seq")).alias("clip_start"), S.n_run_end(F.col("seq")).alias("clip_end")))
    return t.select(*[c if c.endswith("_n") else R6(F.col(c)).alias(c) for c in t.columns])


_BC = f"""{W}, b as (select bid::varchar as bid, substr(bc,1,3) as bc, case when bid%2=0 then substr(bc,4,2) end as bc2, 'g'||(bid%3) as grp from ({BARCODES})), h as (select seq from reads where rec_no<200000),
k as (select b.bid, b.bc, b.bc2, b.grp, count(*) filter (where substr(seq,1,3)=bc)::bigint as at_start, count(*) filter (where right(seq,3)=bc)::bigint as at_end, count(*) filter (where substr(seq,2,3)=bc)::bigint as shift_start,
  count(*) filter (where substr(seq,61,3)=bc)::bigint as shift_end, count(*) filter (where substr(seq,1,3)=bc and right(seq,2)=bc2)::bigint as dual from b, h group by all)"""


def _barcode_counts(spark, d):
    b = view(spark, d, BARCODES).select(F.col("bid").cast("string").alias("bid"), F.substring("bc", 1, 3).alias("bc"), F.when(F.col("bid") % 2 == 0, F.substring("bc", 4, 2)).alias("bc2"), F.concat(F.lit("g"), F.col("bid") % 3).alias("grp"))
    return P.barcode_counts(_reads(spark, d), b)


@query(f"{_BC} select * from k")
def barcode_counts(spark, d):
    c = _barcode_counts(spark, d)
    return c.select("bid", "bc", "bc2", "grp", *_longs(c, "at_start", "at_end", "shift_start", "shift_end", "dual"))


@query(f"""{_BC}, g as (select grp, sum(greatest(at_start,at_end)*ln(3)) as score, sum(at_start) as s, sum(at_end) as e, sum(shift_start) as ss, sum(shift_end) as se, avg(greatest(at_start,at_end,shift_start,shift_end)) as mean from k group by 1 order by score desc, grp limit 1),
p as (select *, case when greatest(e,se)>greatest(s,ss) then 'e' else 'b' end as side from g), q as (select *, case when side='e' then se>=1.2*e else ss>=1.2*s end and greatest(ss,se)>0 as shifted from p),
r as (select k.*, side, shifted, mean, case when side='e' then case when shifted then shift_end else at_end end else case when shifted then shift_start else at_start end end as n from k join q using (grp))
select bid, bc, grp, side as "end", shifted, n::bigint as n from r where n>0 and n>=mean/1.5""")
def barcode_selection(spark, d):
    return P.select_barcodes(_barcode_counts(spark, d), 1.5)


@query(f"""{_BC} select case when sum(at_end)>sum(at_start) then 'e' else 'b' end as "end", sum(dual)*1000>=greatest(sum(at_start),sum(at_end)) as dual, sum(at_start)::bigint as at_start, sum(at_end)::bigint as at_end from k""")
def barcode_end(spark, d):
    return P.list_end(_barcode_counts(spark, d))


@query(f"""{_BC} select grp, sum(at_start)::bigint as at_start, sum(at_end)::bigint as at_end, round(sum(greatest(at_start,at_end)*ln(3)),6) as score from k group by 1""")
def barcode_groups(spark, d):
    b = view(spark, d, BARCODES).select(F.concat(F.lit("g"), F.col("bid") % 3).alias("grp"), F.substring("bc", 1, 3).alias("bc"), F.col("bid"))
    g = P.barcode_profile(_reads(spark, d), b)
    return g.select("grp", "at_start", "at_end", R6(F.col("score")).alias("score"))


@query("""with v as (select l_suppkey as k, list_sort(list(l_quantity)) as v from lineitem group by 1), i as (select k, v, floor((len(v)-1)*0.3)::bigint as i from v)
select k, round(v[i+1]+0.3*(coalesce(v[i+2],v[i+1])-v[i+1]),9) as q from i""")
def quantile_interpolated(spark, d):
    v = _t(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("k")).agg(F.sort_array(F.collect_list("l_quantity")).alias("v"))
    return v.select("k", F.round(stats.quantile_p_interp(F.col("v"), 0.3), 9).alias("q"))


@query("""with t as (select (l_partkey%500+1)::bigint as tlen from lineitem), q as (select quantile_cont(tlen,0.25)::double as q1, quantile_cont(tlen,0.5)::double as median, quantile_cont(tlen,0.75)::double as q3, quantile_cont(tlen,0.1) as lo, quantile_cont(tlen,0.9) as hi from t)
select any_value(q1) as q1, any_value(median) as median, any_value(q3) as q3, round(avg(tlen),6) as mean, round(stddev_samp(tlen),6) as sd from t, q where tlen between lo and hi""")
def insert_sizes(spark, d):
    x = _t(spark, d, "lineitem").select(F.lit(3).alias("flag"), (F.col("l_partkey") % 500 + 1).cast("int").alias("tlen"))
    return A.insert_sizes(x).withColumns({"mean": R6(F.col("mean")), "sd": R6(F.col("sd"))})


@query("select count(*) filter (where o_custkey%7=0)::bigint as discordant, count(*) filter (where o_custkey%7<>0 and o_orderkey%3000>1000)::bigint as distant from orders where o_orderkey%11<>0")
def discordant_mates(spark, d):
    x = _t(spark, d, "orders").select(F.when(F.col("o_orderkey") % 11 == 0, 5).otherwise(1).alias("flag"), F.lit("c1").alias("rname"), F.when(F.col("o_custkey") % 7 == 0, "c2").otherwise("=").alias("rnext"), (-(F.col("o_orderkey") % 3000)).cast("int").alias("tlen"))
    return A.discordant(x)


@query(f"{W}, k as (select substr(seq,i::int,21) as k, count(*) as n from reads, unnest(range(1,45)) u(i) group by 1) select sum(n)::bigint as kmers, count(*)::bigint as \"distinct\", coalesce(sum(n) filter (where n>1),0)::bigint as repeated from k")
def contig_repeats(spark, d):
    return T.repeated_kmers(_reads(spark, d))


@query("""with r as (select p_brand as gene, l_returnflag as library, count(*) as count from part join lineitem on p_partkey=l_partkey group by all), t as (select library, sum(count) as t from r group by 1)
select library, gene, round(sum(count*1e6/t),4)::double as scaled, sum(count)::bigint as count from r join t using (library) group by all""")
def gene_scaled(spark, d):
    x = _t(spark, d, "part").join(_t(spark, d, "lineitem"), F.col("p_partkey") == F.col("l_partkey")).groupBy(F.col("p_brand").alias("gene"), F.col("l_returnflag").alias("library")).agg(F.count("*").alias("count"))
    return T.scaled_rollup(x).withColumn("scaled", F.round("scaled", 4))


@query("select 'c' as chr, l_partkey as beg, l_partkey+20 as en, 'gene_id \"g'||(l_orderkey%9)||'\"; transcript_id \"t'||l_orderkey||'\";' as attrs from lineitem where l_linenumber>1")
def gff_to_gtf(spark, d):
    li = _t(spark, d, "lineitem")
    row = lambda feature, beg, attrs: [F.lit("c").alias("chr"), F.lit("x").alias("source"), F.lit(feature).alias("feature"), F.col("l_partkey").alias("beg"), (F.col("l_partkey") + 20).alias("en"), *[F.lit(".").alias(c) for c in ("score", "strand", "frame")], attrs.alias("attrs")]
    tx = li.dropDuplicates(["l_orderkey"]).select(*row("mRNA", 1, F.concat(F.lit("ID=t"), "l_orderkey", F.lit(";Parent=g"), F.col("l_orderkey") % 9)))
    exons = li.where("l_linenumber > 1").select(*row("exon", 1, F.concat(F.lit("ID=e"), "l_orderkey", F.lit(";Parent=t"), "l_orderkey")))
    return T.gff3_to_gtf(tx.union(exons)).select("chr", "beg", "en", "attrs")


@query(f"""{W}, k as (select rec_no%2 as side, substr(seq,i::int,5) as kmer from reads, unnest(range(1,61)) u(i) where not contains(substr(seq,i::int,5),'N')), c as (select side, kmer, count(*) as n from k group by all),
l as (select side, kmer, n/avg(n) over (partition by side) as level from c qualify row_number() over (partition by side order by n desc, kmer)<=100), m as (select side, least(kmer,reverse(translate(kmer,'ACGT','TGCA'))) as kmer, sum(level) as level from l group by all),
j as (select coalesce(x.level,0) as x, coalesce(y.level,0) as y from (select * from m where side=0) x full join (select * from m where side=1) y using (kmer)) select round(sum(least(x,y))/sum(greatest(x,y)),6) as similarity from j""")
def signature_similarity(spark, d):
    r = _reads(spark, d)
    a, b = (R.signature(r.where(F.col("rec_no") % 2 == side), 5)[0] for side in (0, 1))
    return R.compare_signatures(a, b).withColumn("similarity", R6(F.col("similarity")))


@query(f"""{W}, k as (select rec_no%2 as side, substr(seq,i::int,5) as kmer from reads, unnest(range(1,61)) u(i) where not contains(substr(seq,i::int,5),'N')), c as (select side, kmer, count(*) as n from k group by all),
s as (select side, list_sort(list(n)) as v from c group by 1), x as (select side, p, v, (len(v)-1)*p/10.0 as h from s, range(0,11) u(p)),
t as (select side, p, (v[floor(h)::int+1]+(h-floor(h))*(coalesce(v[floor(h)::int+2],v[floor(h)::int+1])-v[floor(h)::int+1]))/v[-1] as q from x) select round(avg(abs(x.q-y.q)),6)::double as distance from t x join t y using (p) where x.side=0 and y.side=1""")
def signature_distance(spark, d):
    r = _reads(spark, d)
    a, b = (R.signature(r.where(F.col("rec_no") % 2 == side), 5)[1] for side in (0, 1))
    return R.quantile_distance(a, b).withColumn("distance", R6(F.col("distance")))


@query(f"{_AL} select rname, 6000::bigint as length, count(*) filter (where flag&4=0)::bigint as mapped, count(*) filter (where flag&4<>0)::bigint as unmapped from a group by 1")
def alignment_index_stats(spark, d):
    from seqlake.plans.catalogue import _contigs

    return A.index_stats(view(spark, d, ALIGNMENTS), _contigs(spark))


@query(f"""{_AL}, x as (select rname, pos, flag, unnest({_RUNS}) as r, seq, qual from a where flag&4=0), y as (select rname, pos+r[1]+k as pos, substr(seq,(r[2]+k+1)::int,1) as base, flag, ascii(substr(qual,(r[2]+k+1)::int,1))-33 as q from x, unnest(range(0,r[3])) u(k))
select rname, pos::bigint as pos, base, count(*)::bigint as n, count(*) filter (where flag&16<>0)::bigint as reverse, sum(q)::bigint as qual from y group by all""")
def alignment_base_sums(spark, d):
    return _long(A.base_sums(view(spark, d, ALIGNMENTS)))


# --- order and sets

@query("select o_orderkey from orders order by case o_orderstatus when 'P' then 1 when 'F' then 2 else 1000 end, o_orderkey limit 200")
def ranked_rows(spark, d):
    """The first rows in a reference's order."""
    o = _t(spark, d, "orders").select("o_orderkey", F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("chr"))
    return T.ranked(o, spark.createDataFrame([("P", 1), ("F", 2)], "chr string, rank int")).limit(200).select("o_orderkey")


@query(f"{_AL} select qname, flag::bigint as flag from a order by substr(qname,2)::int, flag limit 100")
def natural_order(spark, d):
    """The first hundred alignments by names as people count: r2 before r10."""
    return A.by_natural_name(view(spark, d, ALIGNMENTS)).limit(100).select("qname", F.col("flag").cast("bigint").alias("flag"))


@query(f"{_AL} select rname, pos::bigint as pos, count(*)::bigint as n from (select * from a union all select * from a) group by all")
def merged_alignments(spark, d):
    a = view(spark, d, ALIGNMENTS)
    return A.merged(a, a).groupBy("rname", F.col("pos").cast("bigint").alias("pos")).agg(F.count("*").alias("n"))


# --- streams, run over what there is

def _streamed(spark, d, table: str) -> DataFrame:
    """A table as a stream; the pattern lets a single file be one."""
    return spark.readStream.schema(_t(spark, d, table).schema).parquet(f"{d}/{table}.parque[t]")


def _drained(spark, stream: DataFrame, mode: str) -> DataFrame:
    """All that a stream gives now, as a table: each batch appended, or the last one in its place."""
    out = scratch(spark, "stream")

    def put(batch: DataFrame, _: int) -> None:
        batch.write.mode("append" if mode == "append" else "overwrite").parquet(out)

    stream.writeStream.outputMode(mode).option("checkpointLocation", scratch(spark, "offsets")).trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("select event_type, 2*count(*)::bigint as n from events group by 1")
def stream_counts(spark, d):
    """Running counts over two merged streams."""
    e = lambda: _streamed(spark, d, "events")
    return _drained(spark, streams.running_counts(streams.merged(e(), e()), "event_type"), "complete")


@query("select count(distinct substr(event_type||user_id,1,12))::bigint as n from events")
def stream_first_seen(spark, d):
    """First reads of each prefix within a horizon longer than the data."""
    e = _streamed(spark, d, "events").select(F.concat("event_type", "user_id").alias("seq"), F.col("ts").cast("timestamp").alias("ts"))
    return _drained(spark, streams.first_seen(e, 12, "ts", "4000 days"), "append").agg(F.count("*").alias("n"))


@query("select event_type as file, count(*)::bigint as n, round(avg(value),6) as mean, round(stddev_samp(value),6) as sd from events group by 1")
def stream_moments(spark, d):
    """Running moments kept as state."""
    e = _streamed(spark, d, "events").select(F.col("event_type").alias("file"), F.col("value").alias("mean_quality"))
    return _drained(spark, streams.running_moments(e), "update").withColumns({"mean": R6(F.col("mean")), "sd": R6(F.col("sd"))})


@query(f"{W} select rec_no from reads where length(seq)-length(replace(seq,'N',''))<=3")
def stream_filter(spark, d):
    """The batch filters on a stream."""
    docs = _streamed(spark, d, "documents").where("text is not null")
    r = docs.select(F.col("doc_id").alias("rec_no"), F.translate(F.concat(F.md5(F.col("text").cast("binary")), F.md5(F.reverse("text").cast("binary"))), "0123456789abcdef", "ACGTACGTACGTACGN").alias("seq"), F.lit("I" * 64).alias("qual"))
    return _drained(spark, R.filtered(r, R.Filters(min_length=1, max_n=3)).select("rec_no"), "append")


@query(f"""{W} select rec_no, reverse(translate(seq,'ACGT','TGCA')) as rc, hamming(substr(seq,1,32),substr(seq,33,32))::bigint as d, round(list_sum({Q33})/64.0,6)::double as q, round(exp(-3.0+(rec_no%5)*ln(3.0)-lgamma(rec_no%5+1)),9) as p, 56::bigint as kmers from reads""")
def sql_helpers(spark, d):
    """The registered SQL functions and table functions."""
    sql_functions.register(spark)
    _reads(spark, d).createOrReplaceTempView("sql_helper_reads")
    return spark.sql("""select rec_no, revcomp(seq) as rc, cast(hamming(substring(seq, 1, 32), substring(seq, 33, 32)) as bigint) as d, round(mean_phred(qual), 6) as q, round(poisson_pmf(cast(rec_no % 5 as int), 3D), 9) as p,
      (select count(*) from kmers(seq, 9)) as kmers from sql_helper_reads""")
