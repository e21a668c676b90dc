"""Queries of the sequence operators over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqlake.functions import cigar as C, qual as Q, seq as S, stats
from seqlake.operators import alignments, chunks, pairs as P, reads as R, tables as T, variants
from seqlake.plans.derived import ALIGNMENTS, ALLELES, BARCODES, INTERVALS, PAIRS, POINTS, READS, view
from seqlake.streaming import streams

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
ADAPTERS = [("tail", "ACGTACGTAC"), ("lead_5p", "CCAATTGG"), ("end_3p", "GTACA")]
MATCHED = [R.Adapter("end", "GTACA", "e", 2), R.Adapter("tail", "ACGTACGTAC", "e", 2)]


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return put


def _reads(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, READS)


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _long(df: DataFrame) -> DataFrame:
    """Integers as BIGINT, so both engines name the same types."""
    return df.select(*[F.col(c).cast("bigint").alias(c) if t in ("int", "smallint", "tinyint") else F.col(c) for c, t in df.dtypes])


R6 = lambda c: F.round(c, 6)
W = f"with reads as ({READS})"
Q33 = "[ascii(substr(qual,i::int,1))-33 for i in range(1,length(qual)+1)]"


@query(f"{W} select rec_no, reverse(translate(seq,'ACGT','TGCA')) as rc, reverse(qual) as rq from reads")
def reads_revcomp(spark, d):
    return _reads(spark, d).select("rec_no", S.revcomp(F.col("seq")).alias("rc"), F.reverse("qual").alias("rq"))


@query(f"{W} select rec_no, round(list_sum({Q33})/64.0,6)::double as mean_quality, round(pow(10,-(list_sum({Q33})/64.0)/10),6)::double as p from reads")
def reads_mean_quality(spark, d):
    m = Q.mean(F.col("qual"))
    return _reads(spark, d).select("rec_no", R6(m).alias("mean_quality"), R6(Q.to_probability(m)).alias("p"))


@query(f"{W} select rec_no, hamming(substr(seq,1,32),substr(seq,33,32))::bigint as d from reads")
def reads_hamming_prefix(spark, d):
    return _reads(spark, d).select("rec_no", S.hamming(F.substring("seq", 1, 32), F.substring("seq", 33, 32), 32).cast("bigint").alias("d"))


@query(f"{W} select rec_no, length(regexp_extract(seq,'^N*'))::bigint as n_start, length(regexp_extract(seq,'N*$'))::bigint as n_end from reads")
def reads_n_trim(spark, d):
    return _reads(spark, d).select("rec_no", S.n_run_start(F.col("seq")).cast("bigint").alias("n_start"), S.n_run_end(F.col("seq")).cast("bigint").alias("n_end"))


@query(f"{W} select rec_no, list_sum([case when substr(seq,i::int,1)='N' or substr(seq,i::int,1)=substr(seq,i::int-1,1) then 1 else 0 end for i in range(2,65)])::bigint as score from reads")
def reads_homopolymer(spark, d):
    return _reads(spark, d).select("rec_no", S.homopolymer_score(F.col("seq")).cast("bigint").alias("score"))


_LOW = " or ".join(f"(i>{2 * p - 1} and substr(seq,i::int-{p - 1},{p})=substr(seq,i::int-{2 * p - 1},{p}))" for p in (1, 2, 3, 4))


@query(f"{W} select rec_no, list_sum([case when substr(seq,i::int,1)='N' or {_LOW} then 1 else 0 end for i in range(2,65)])::bigint as score from reads")
def reads_lowcomplex(spark, d):
    return _reads(spark, d).select("rec_no", S.low_complexity_score(F.col("seq")).cast("bigint").alias("score"))


_TRIMS = f"""select rec_no, seq, qual, coalesce(list_min([i for i in range(1,65) if ascii(substr(qual,i::int,1))-33>=15])-1, 64) as a,
  coalesce(64-list_max([i for i in range(1,65) if ascii(substr(qual,i::int,1))-33>=15]), 0) as b from reads"""


@query(f"{W} select rec_no, a::bigint as trim_start, b::bigint as trim_end from ({_TRIMS})")
def reads_quality_trim(spark, d):
    t = Q.trims(F.col("qual"), 15)
    return _reads(spark, d).select("rec_no", t["start"].cast("bigint").alias("trim_start"), t["end"].cast("bigint").alias("trim_end"))


@query(f"""{W}, q as (select rec_no, substr(seq,a::int+1,(64-a-b)::int) as seq, substr(qual,a::int+1,(64-a-b)::int) as qual from ({_TRIMS}))
select rec_no, length(seq)::bigint as n, case when length(seq)=0 then 'empty' when length(seq)<55 then 'short'
  when list_sum({Q33})::double/length(qual) < 27 then 'quality' when length(seq)-length(replace(seq,'N',''))>5 then 'ns' else 'kept' end as outcome from q""")
def reads_filter_chain(spark, d):
    f = R.Filters(min_length=55, min_mean_quality=27.0, max_n=5)
    t = R.filtered(R.trim_quality(_reads(spark, d), 15), f, "why")
    return t.select("rec_no", F.length("seq").cast("bigint").alias("n"), F.coalesce("why", F.lit("kept")).alias("outcome"))


@query(f"{W} select rec_no, seq from reads qualify row_number() over (partition by substr(seq,1,20) order by rec_no)=1")
def reads_dedup(spark, d):
    return R.first_seen(_reads(spark, d), 20).select("rec_no", "seq")


@query(f"""{W}, n1 as (select rec_no, case when regexp_full_match(seq,'N*') then '' else regexp_replace(regexp_replace(seq,'^N+',''),'N+$','') end as seq,
  substr(qual, length(regexp_extract(seq,'^N*'))+1, 64-length(regexp_extract(seq,'^N*'))-length(regexp_extract(seq,'N*$'))) as qual from reads),
t as (select rec_no, seq, qual, coalesce(list_min([i for i in range(1,length(qual)+1) if ascii(substr(qual,i::int,1))-33>=15])-1,length(qual)) as a,
  coalesce(length(qual)-list_max([i for i in range(1,length(qual)+1) if ascii(substr(qual,i::int,1))-33>=15]),0) as b from n1),
c as (select rec_no, substr(seq,a::int+1,(length(seq)-a-b)::int) as seq, substr(qual,a::int+1,(length(qual)-a-b)::int) as qual from t)
select rec_no, seq, qual from (select * from c where length(seq)>=50 and list_sum({Q33})::double/length(qual)>=26)
qualify row_number() over (partition by substr(seq,1,30) order by rec_no)=1""")
def reads_kept(spark, d):
    """The flagship: N and quality trims, length and quality filters, first of each prefix."""
    t = R.trim_quality(R.trim_n(_reads(spark, d)), 15)
    return R.first_seen(R.filtered(t, R.Filters(min_length=50, min_mean_quality=26.0)), 30).select("rec_no", "seq", "qual")


@query(f"{W} select substr(seq,1,35) as prefix, count(*)::bigint as n from reads group by 1 having count(*)>1 order by n desc, prefix limit 10")
def reads_dup_top(spark, d):
    return R.duplicate_counts(_reads(spark, d)).orderBy(F.desc("n"), "prefix").limit(10)


@query(f"{W} select count(*)::bigint as prefixes, coalesce(sum(n),0)::bigint as reads from (select count(*) as n from reads group by substr(seq,1,35) having count(*)>1)")
def reads_dup_stats(spark, d):
    return R.duplicate_counts(_reads(spark, d)).agg(F.count("*").alias("prefixes"), F.coalesce(F.sum("n"), F.lit(0)).cast("bigint").alias("reads"))


_CYC = f"{W}, c as (select i::bigint as cycle, substr(seq,i::int,1) as base, (ascii(substr(qual,i::int,1))-33)::bigint as q from reads, unnest(range(1,65)) u(i))"


@query(f"{_CYC} select cycle, base, q, count(*)::bigint as n from c group by all")
def reads_cycle_base(spark, d):
    return _long(R.by_cycle(_reads(spark, d)))


@query(f"""{_CYC}, g as (select cycle, count(*)::bigint as n, min(q) as q_min, max(q) as q_max, sum(q)::bigint as q_sum, round(avg(q),6) as q_mean,
  quantile_cont(q,0.25)::double as q1, quantile_cont(q,0.5)::double as median, quantile_cont(q,0.75)::double as q3, {', '.join(f"count(*) filter (where base='{b}')::bigint as n_{b.lower()}" for b in 'ACGTN')} from c group by cycle),
e as (select cycle, min(q) as whisker_low, max(q) as whisker_high from c join g using (cycle) where q>=q1-1.5*(q3-q1) and q<=q3+1.5*(q3-q1) group by cycle)
select * from g join e using (cycle)""")
def reads_cycle_quality(spark, d):
    return _long(R.cycle_quality(_reads(spark, d)).withColumn("q_mean", R6(F.col("q_mean"))))


@query(f"{_CYC} select cycle, q, count(*)::bigint as n from c group by all")
def reads_quality_breakdown(spark, d):
    return _long(R.quality_breakdown(_reads(spark, d)))


@query("select length(text)::bigint as length, count(*)::bigint as n from documents where text is not null group by 1")
def reads_length_hist(spark, d):
    return _long(R.length_histogram(_t(spark, d, "documents").where("text is not null").select(F.col("text").alias("seq"))))


@query(f"{W} select rec_no, round(100.0*length(regexp_replace(seq,'[^GC]','','g'))/64,6)::double as gc from reads")
def reads_gc(spark, d):
    return _reads(spark, d).select("rec_no", R6(S.gc_percent(F.col("seq"))).alias("gc"))


@query(f"""{W}, r as (select 64 as len, length(regexp_replace(seq,'[^GC]','','g')) as gc, count(*) as reads from reads group by all),
m as (select c, unnest(range(greatest(floor(100*(c-0.5)/64+0.5),0)::int, least(floor(100*(c+0.5)/64+0.5),100)::int+1)) as percent from range(0,65) t(c)),
k as (select percent, count(*) as claims from m group by 1)
select percent::bigint as percent, round(sum(reads/claims::double),6) as n from r join m on gc=c join k using (percent) group by percent""")
def reads_gc_dist(spark, d):
    return R.gc_distribution(_reads(spark, d)).select(F.col("percent").cast("bigint").alias("percent"), R6(F.col("n")).alias("n"))


@query(f"""{W}, x as (select ascii(substr(qual,i::int,1))-33 as q from reads, unnest(range(1,36)) u(i))
select * from (select count(*)::bigint as reads, min(length(seq))::bigint as len_min, max(length(seq))::bigint as len_max, avg(length(seq)) as len_mean, coalesce(stddev_samp(length(seq)),0) as len_sd, sum(length(seq))::bigint as bases,
  {', '.join(f"round(100.0*sum(length(seq)-length(replace(seq,'{b}','')))/sum(length(seq)),6)::double as pct_{b.lower()}" for b in 'ACGTN')} from reads),
(select min(q)::bigint as q_min, max(q)::bigint as q_max, round(avg(q),6) as q_mean, round(stddev_samp(q),6) as q_sd from x)""")
def reads_summary(spark, d):
    s = R.summary(_reads(spark, d))
    return s.withColumns({c: R6(F.col(c)) for c in s.columns if c.startswith(("pct_", "q_mean", "q_sd"))})


@query(f"{W} select min(ascii(substr(qual,i::int,1)))::bigint as least, (case when min(ascii(substr(qual,i::int,1)))<64 then 33 else 64 end)::bigint as phred from reads, unnest(range(1,65)) u(i) where rec_no<10000")
def reads_phred_detect(spark, d):
    return R.phred_offset(_reads(spark, d))


_KM = f"{W}, k as (select substr(seq,i::int,9) as kmer, count(*)::bigint as n from reads, unnest(range(1,57)) u(i) where not contains(substr(seq,i::int,9),'N') group by 1)"


@query(f"{_KM} select kmer, n from k")
def reads_kmers(spark, d):
    return R.kmer_counts(_reads(spark, d), 9)


@query(f"{_KM} select kmer, round(n/(select avg(n) from k),6) as level from k order by n desc, kmer limit 100")
def reads_kmer_top(spark, d):
    return R.signature(_reads(spark, d))[0].select("kmer", R6(F.col("level")).alias("level"))


_AD = "(values " + ",".join(f"('{a}','{s}')" for a, s in ADAPTERS) + ") a(id,aseq)"


@query(f"""{W}, x as (select id, aseq, case when strpos(substr(seq,2),substr(aseq,1,5))>0 then strpos(substr(seq,2),substr(aseq,1,5)) else 0 end as e,
  case when strpos(aseq,substr(seq,1,5))>0 then strpos(aseq,substr(seq,1,5))-1 else -1 end as b from reads, {_AD})
select id, aseq as seq, count(*) filter (where e>0)::bigint as at_end, count(*) filter (where e=59)::bigint as at_end_exact, count(*) filter (where b>=0)::bigint as at_start,
  count(*) filter (where b>=0 and b=length(aseq)-5)::bigint as at_start_exact, count(*)::bigint as sampled from x group by all""")
def reads_adapter_profile(spark, d):
    return R.adapter_counts(_reads(spark, d), spark.createDataFrame(ADAPTERS, "id string, seq string"), 5)


_CLIP = ",".join(f"({i},'{a.seq}',{a.least})" for i, a in enumerate(MATCHED))


@query(f"""{W}, o as (select rec_no, seq, k, aseq, off, least(off,length(aseq)) as n, hamming(substr(aseq,1,least(off,length(aseq))::int), substr(seq,(65-off)::int,least(off,length(aseq))::int)) as h
  from reads, (values {_CLIP}) a(k,aseq,lo), unnest(range(lo,65)) u(off)),
s as (select *, (1000*(h*h+1))//n as score from (select *, min(case when h=0 and n=length(aseq) then off end) over (partition by rec_no,k) as stop from o) where h<=(20*n)//100 and off<=coalesce(stop,off)),
b as (select rec_no, k, off, score from s qualify row_number() over (partition by rec_no order by score, k desc, off desc)=1)
select rec_no, coalesce(off,0)::bigint as clip from reads left join b using (rec_no)""")
def reads_adapter_clip(spark, d):
    return R.clip_adapters(_reads(spark, d), MATCHED, 20.0).select("rec_no", F.col("clip_end").cast("bigint").alias("clip"))


_P = f"with pairs as ({PAIRS})"
_OV = f"""{_P}, o as (select rec_no, o, hamming(right(s1,o::int), substr(reverse(translate(s2,'ACGT','TGCA')),1,o::int)) as h from pairs, unnest(range(6,41)) u(o)),
b as (select rec_no, o, (1000*(h*h+1))//o as score from o where h<=(8*o)//100 qualify row_number() over (partition by rec_no order by (1000*(h*h+1))//o, o)=1)"""


@query(f"{_OV} select rec_no, o::bigint as overlap, score::bigint as score from pairs left join b using (rec_no)")
def pairs_overlap(spark, d):
    o = P.overlap(F.col("s1"), F.col("s2"))
    return view(spark, d, PAIRS).withColumn("o", o).select("rec_no", F.col("o.len").cast("bigint").alias("overlap"), F.col("o.score").cast("bigint").alias("score"))


@query(f"""{_OV}, r as (select rec_no, s1, q1, reverse(translate(s2,'ACGT','TGCA')) as r2, reverse(q2) as p2, o from pairs join b using (rec_no)),
j as (select rec_no, o, s1, q1, r2, p2, i, substr(s1,(40-o+i)::int,1) as x, substr(r2,i::int,1) as y, ascii(substr(q1,(40-o+i)::int,1)) as a, ascii(substr(p2,i::int,1)) as c from r, unnest(range(1,o+1)) u(i)),
m as (select rec_no, any_value(substr(s1,1,(40-o)::int)||'') as pre, any_value(substr(q1,1,(40-o)::int)) as qpre, any_value(substr(r2,o::int+1)) as post, any_value(substr(p2,o::int+1)) as qpost, any_value(o) as o,
  string_agg(case when x=y or a>c then x else y end,'' order by i) as mid, string_agg(chr(case when x=y then greatest(a,c) else 33+least(greatest(a,c),greatest(abs(a-c),3)) end),'' order by i) as qmid from j group by rec_no)
select rec_no, o::bigint as overlap, pre||mid||post as seq, qpre||qmid||qpost as qual from m""")
def pairs_merge(spark, d):
    j = P.join_pairs(view(spark, d, PAIRS)).where("joined")
    return j.select("rec_no", F.col("overlap").cast("bigint").alias("overlap"), "seq", "qual")


@query(f"{_OV} select count(*)::bigint as pairs, count(o)::bigint as joined, coalesce(avg(o),0)::double as mean, round(coalesce(stddev_samp(o),0),6)::double as sd from pairs left join b using (rec_no)")
def pairs_join_summary(spark, d):
    return P.join_summary(P.join_pairs(view(spark, d, PAIRS))).withColumn("sd", R6(F.col("sd")))


_DX = f"""{W}, barcodes as ({BARCODES}), x as (select rec_no, bid, hamming(substr(seq,1,8),bc) as d from reads, barcodes),
b as (select rec_no, bid, d as best, lead(d) over w as next, row_number() over w as k from x window w as (partition by rec_no order by d, bid)),
a as (select rec_no, best::bigint as best, next::bigint as next, (case when best<=2 and next>best and (best=0 or next-best>=2) then bid end)::bigint as barcode from b where k=1)"""


@query(f"{_DX} select rec_no, barcode, best, next from a")
def reads_demux(spark, d):
    return _long(P.assign(_reads(spark, d), view(spark, d, BARCODES), 2, 2).select("rec_no", "barcode", "best", "next"))


@query(f"{_DX} select coalesce(barcode::varchar,'unmatched') as barcode, count(*)::bigint as n from a group by 1 union all select 'total', count(*)::bigint from a")
def reads_demux_counts(spark, d):
    return P.assign_counts(P.assign(_reads(spark, d), view(spark, d, BARCODES), 2, 2))


@query(f"""{W}, c as (select substr(seq,1,4) as bc, count(*)::bigint as n from reads where rec_no<100000 and not contains(substr(seq,1,4),'N') group by 1),
m as (select min(n) as m from (select n from c order by n desc, bc limit 2)) select bc, n from c, m where n>=m*0.5""")
def barcode_discover(spark, d):
    return P.discover_barcodes(_reads(spark, d), 4, share=0.5)


_I, _PT = f"intervals as ({INTERVALS})", f"points as ({POINTS})"


@query(f"with {_I}, {_PT} select p.chr, pos, pid, beg, en, iid from points p join intervals i on p.chr=i.chr and pos between beg and en")
def interval_point_join(spark, d):
    return T.points_in(view(spark, d, POINTS), view(spark, d, INTERVALS)).select("chr", "pos", "pid", "beg", "en", "iid")


@query(f"with {_I}, {_PT} select chr, pos, pid, exists(select 1 from intervals i where i.chr=p.chr and p.pos between beg and en) as on_target from points p")
def interval_on_target(spark, d):
    return T.on_target(view(spark, d, POINTS), view(spark, d, INTERVALS)).select("chr", "pos", "pid", "on_target")


_A2 = f"a as ({INTERVALS}), b as (select o_custkey%10 as chr, (o_orderkey*7)%2000 as b_beg, (o_orderkey*7)%2000+20 as b_en, o_orderkey as bid from orders)"


@query(f"with {_A2} select a.chr, beg, en, iid, b_beg, b_en, bid from a join b on a.chr=b.chr and beg<=b_en and en>=b_beg")
def interval_overlap_join(spark, d):
    b = view(spark, d, "select o_custkey%10 as chr, (o_orderkey*7)%2000 as b_beg, (o_orderkey*7)%2000+20 as b_en, o_orderkey as bid from orders")
    return T.overlaps(view(spark, d, INTERVALS), b).select("chr", "beg", "en", "iid", "b_beg", "b_en", "bid")


@query(f"""with {_I}, e as (select chr, beg as x, 1 as d from intervals union all select chr, en+1, -1 from intervals), g as (select chr, x, sum(d) as d from e group by all),
f as (select chr, x as beg, lead(x) over w - 1 as en, sum(d) over w as n from g window w as (partition by chr order by x)) select chr, beg, en, n::bigint as n from f where n>0""")
def interval_fragments(spark, d):
    return T.fragments(view(spark, d, INTERVALS))


# Twice the customers' keys, so that both sides have rows that meet nothing.
_C, _O = "select (c_custkey*2)::varchar as k, c_name from customer", "select o_custkey::varchar as k, o_orderkey from orders"


def _sides(spark, d):
    c = T.keyed(_t(spark, d, "customer").select((F.col("c_custkey") * 2).alias("c_custkey"), "c_name"), "c_custkey")
    return c, T.keyed(_t(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey")


def _joined(name: str, how: str, sql: str):
    def run(spark, d):
        return T.join(*_sides(spark, d), how)

    run.__name__ = name
    query(f"with c as ({_C}), o as ({_O}) {sql}")(run)


_joined("join_inner", T.INNER, "select k, c_name, o_orderkey from c join o using (k)")
_joined("join_left", T.LEFT, "select k, c_name, o_orderkey from c left join o using (k)")
_joined("join_right", T.RIGHT, "select k, c_name, o_orderkey from c right join o using (k)")
_joined("join_outer", T.OUTER, "select k, c_name, o_orderkey from c full join o using (k)")
_joined("join_exclude_left", T.ONLY_LEFT, "select k, c_name from c anti join o using (k)")
_joined("join_exclude_right", T.ONLY_RIGHT, "select k, o_orderkey from o anti join c using (k)")
_joined("join_exclude_both", T.EXCEPT, "select k, c_name, 1 as source, null::bigint as o_orderkey from c anti join o using (k) union all select k, null, 2, o_orderkey from o anti join c using (k)")


@query(f"""with c as (select *, row_number() over (partition by k order by c_name) as n from ({_C})), o as (select *, row_number() over (partition by k order by o_orderkey) as n from ({_O})) select k, c_name, o_orderkey from c join o using (k,n)""")
def join_zip_duplicates(spark, d):
    return T.join(*_sides(spark, d), T.INNER, True, ("c_name", "o_orderkey"))


@query("select c_nationkey::varchar as k, c_custkey, n_name, s_suppkey from customer join nation on c_nationkey=n_nationkey join supplier on s_nationkey=c_nationkey")
def join_multiway(spark, d):
    k = lambda t, c, o: T.keyed(_t(spark, d, t).select(c, o), c)
    return T.join_many([k("customer", "c_nationkey", "c_custkey"), k("nation", "n_nationkey", "n_name"), k("supplier", "s_nationkey", "s_suppkey")])


@query("""with c as (select length(text)::bigint as len from documents where length(text)>100), r as (select len, sum(len) over (order by len desc rows unbounded preceding) as run, sum(len) over () as t from c)
select count(*)::bigint as n, min(len) as len_min, max(len) as len_max, round(avg(len),6) as len_mean, quantile_cont(len,0.25)::double as q1, quantile_cont(len,0.5)::double as median, quantile_cont(len,0.75)::double as q3,
  max(len) filter (where run>=t*0.5) as n50, max(len) filter (where run>=t*0.9) as n90 from r""")
def contig_n50(spark, d):
    s = T.contig_stats(_t(spark, d, "documents").select(F.length("text").alias("len")), 100)
    return _long(s.withColumn("len_mean", R6(F.col("len_mean"))))


@query("select l_suppkey as chr, l_partkey as pos, max(l_quantity) filter (where l_returnflag='A') as \"A\", max(l_quantity) filter (where l_returnflag='N') as \"N\", max(l_quantity) filter (where l_returnflag='R') as \"R\" from lineitem group by all")
def pivot_samples(spark, d):
    x = _t(spark, d, "lineitem").select(F.col("l_suppkey").alias("chr"), F.col("l_partkey").alias("pos"), F.col("l_returnflag").alias("sample"), F.col("l_quantity").alias("value"))
    return T.sample_matrix(x, ["A", "N", "R"])


@query(f"""with a as (select *, sum(n) over (partition by chr, pos) as depth from ({ALLELES})), r as (select *, row_number() over (partition by chr, pos order by n desc, qual desc, base desc) as k, sum(qual) over (partition by chr, pos) as tq from a),
l as (select chr, pos, any_value(depth)::double as depth, coalesce(max(n) filter (where k=2),0)/any_value(depth)::double as noise, coalesce(max(qual) filter (where k=2),0)/any_value(tq)::double as qnoise from r group by all),
x as (select * from l order by depth desc, chr, pos limit 500)
select count(*)::bigint as loci, quantile_cont(depth,0.25)::double as depth_q1, quantile_cont(depth,0.5)::double as depth_median, quantile_cont(depth,0.75)::double as depth_q3, round(avg(noise),6) as noise_mean, round(stddev_samp(noise),6) as noise_sd, round(avg(qnoise),6) as qnoise_mean, round(stddev_samp(qnoise),6) as qnoise_sd from x""")
def noise_quartiles(spark, d):
    """Noise of the deepest loci: the next allele's share of reads and of quality."""
    a = view(spark, d, ALLELES).withColumn("rev", F.col("n") - F.col("fwd"))
    a = a.join(a.groupBy("chr", "pos").agg(F.sum("n").alias("depth")), ["chr", "pos"])
    s = variants.noise_stats(variants.noise(a, 500))
    return s.withColumns({c: R6(F.col(c)) for c in s.columns if "noise" in c})


@query(f"with a as ({ALLELES}) select chr, pos, base, n::bigint as n, round(exp(-3.0+n*ln(3.0)-lgamma(n+1)),9) as p from a")
def allele_poisson(spark, d):
    return view(spark, d, ALLELES).select("chr", "pos", "base", "n", F.round(stats.poisson_pmf(F.col("n"), F.lit(3.0)), 9).alias("p"))


@query("""with l as (select o_orderkey as pos, o_orderstatus as ref from orders), g as (select *, coalesce((lag(ref) over w<>ref or lag(pos) over w<>pos-1)::int,1) as b from l window w as (order by pos)), h as (select *, sum(b) over (order by pos) as r from g)
select pos, ref, count(*) over (partition by r)::bigint as run from h""")
def locus_homopolymer_window(spark, d):
    from seqlake.operators.variants import homopolymer_runs

    x = _t(spark, d, "orders").select(F.lit(1).alias("chr"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("ref"))
    return homopolymer_runs(x).select("pos", "ref", "run")


@query("""with r as (select p_brand as gene, p_partkey::varchar as transcript_id, p_size as length, count(*) as count, round(sum(l_tax),4) as fpkm from part join lineitem on p_partkey=l_partkey group by all)
select gene, round(sum(length*(count+1))/sum(count+1),6)::double as length, sum(count)::bigint as count, round(sum(fpkm),4) as fpkm, string_agg(transcript_id,',' order by transcript_id) as transcripts from r group by gene""")
def gene_rollup(spark, d):
    l = _t(spark, d, "lineitem").groupBy("l_partkey").agg(F.count("*").alias("count"), F.round(F.sum("l_tax"), 4).alias("fpkm"))  # noqa: E741
    x = _t(spark, d, "part").join(l, F.col("p_partkey") == F.col("l_partkey")).select(F.col("p_brand").alias("gene"), F.col("p_partkey").cast("string").alias("transcript_id"), F.col("p_size").alias("length"), "count", "fpkm")
    return T.gene_rollup(x).withColumns({"length": R6(F.col("length")), "fpkm": F.round("fpkm", 4)})


@query(f"{W}, c as (select seq, count(*)::bigint as n from reads group by seq) select seq, n, round(log10(n),6) as log10, round(n/(select quantile_cont(n,0.75) from c),6)::double as normal from c")
def species_normalise(spark, d):
    return P.species_summary(_reads(spark, d)).withColumns({"log10": R6(F.col("log10")), "normal": R6(F.col("normal"))})


_AL = f"with a as ({ALIGNMENTS})"


@query(f"""{_AL}, m as (select *, (flag&4)=0 and pos>0 as ok from a) select count(*)::bigint as reads, count(*) filter (where ok)::bigint as mapped, count(*) filter (where flag&256<>0)::bigint as secondary,
  count(*) filter (where ok and flag&16<>0)::bigint as reverse, count(*) filter (where ok and flag&16=0)::bigint as forward, sum(length(seq)) filter (where ok)::bigint as bases, round(avg(mapq) filter (where ok),6) as mapq_mean, round(stddev_samp(mapq) filter (where ok),6) as mapq_sd,
  round(sum(case cigar when '30M2I32M' then 2 else 0 end) filter (where ok)::double/sum(length(seq)) filter (where ok),9) as ins_rate, round(sum(case cigar when '20M3D44M' then 3 else 0 end) filter (where ok)::double/sum(length(seq)) filter (where ok),9) as del_rate from m""")
def alignment_summary(spark, d):
    s = alignments.summary(view(spark, d, ALIGNMENTS))
    return s.select("reads", "mapped", "secondary", "reverse", "forward", "bases", R6(F.col("mapq_mean")).alias("mapq_mean"), R6(F.col("mapq_sd")).alias("mapq_sd"), F.round("ins_rate", 9).alias("ins_rate"), F.round("del_rate", 9).alias("del_rate"))


@query(f"{_AL}, n as (select qname, count(*) as n from a where flag&4=0 group by 1) select count(*)::bigint as names, count(*) filter (where n>1)::bigint as ambiguous, count(*) filter (where n=1)::bigint as single, max(n)::bigint as most from n")
def alignment_multi(spark, d):
    return alignments.multi_mapping(view(spark, d, ALIGNMENTS))


@query(f"{_AL}, b as (select qname, max((mapq, -nm)) as b from a where flag&256<>0 group by 1) select a.qname, pos, mapq::bigint as mapq, b.b is null or (mapq,-nm)>=b.b as keep from a left join b using (qname)")
def alignment_best(spark, d):
    a = view(spark, d, ALIGNMENTS)
    return alignments.best_mapping(a, a.where(F.col("flag").bitwiseAND(F.lit(256)) != 0)).select("qname", "pos", F.col("mapq").cast("bigint").alias("mapq"), "keep")


@query(f"{_AL} select qname, pos, (case cigar when '30M2I32M' then 62 when '20M3D44M' then 67 else 64 end)::bigint as span, 64::bigint as qlen from a")
def alignment_cigar(spark, d):
    return view(spark, d, ALIGNMENTS).select("qname", "pos", C.reference_span(F.col("cigar")).cast("bigint").alias("span"), C.query_length(F.col("cigar")).cast("bigint").alias("qlen"))


_RUNS = "(case cigar when '30M2I32M' then [(0,0,30),(30,32,32)] when '20M3D44M' then [(0,0,20),(23,20,44)] else [(0,0,64)] end)"


@query(f"{_AL}, x as (select rname, pos, unnest({_RUNS}) as r, seq from a where flag&4=0), y as (select rname, pos+r[1]+k as pos from x, unnest(range(0,r[3])) u(k)) select rname, pos::bigint as pos, count(*)::bigint as depth from y group by all")
def alignment_pileup(spark, d):
    return alignments.pileup(view(spark, d, ALIGNMENTS)).select("rname", F.col("pos").cast("bigint").alias("pos"), F.col("depth").cast("bigint").alias("depth"))


@query("select time_bucket(interval '1 hour', ts) as start, event_type, count(*)::bigint as n, round(sum(value),4) as total from events group by all")
def events_tumbling(spark, d):
    return streams.tumbling(_t(spark, d, "events")).withColumn("total", F.round("total", 4))


@query(f"{W} select rec_no, seq from reads where rec_no>=5 order by rec_no limit 50")
def reads_head(spark, d):
    return _reads(spark, d).where("rec_no >= 5").orderBy("rec_no").limit(50).select("rec_no", "seq")


@query(f"""{W}, m as (select rec_no, rec_no%3 as file, list_sum({Q33})/64.0 as m, length(seq)-length(replace(seq,'N','')) as ns from reads),
x as (select rec_no, m, ns, coalesce(64*count(*) over w,0) as b, avg(m) over w as mean, coalesce(stddev_samp(m) over w,0) as sd from m window w as (partition by file order by rec_no rows between unbounded preceding and 1 preceding))
select rec_no, case when b<6400 then m<25 or ns>1 else m<least(25,mean-3*sd) end as junk from x""")
def reads_running_quality(spark, d):
    r = _reads(spark, d).withColumn("file", F.col("rec_no") % 3)
    return R.running_quality(r, 6400, 25.0, width=1 << 10).select("rec_no", "junk")


@query(f"""{W}, s as (select *, length(regexp_extract(seq,'^N*')) as a, length(regexp_extract(seq,'N*$')) as b from reads), i as (select *, substr(qual,a+1,64-a-b) as q from s),
g as (select *, list_filter(range(1,length(q)+1), lambda i: ascii(substr(q,i::int,1))-33>=15) as good from i)
select rec_no, (a+case when len(good)>0 then good[1]-1 else length(q) end)::bigint as trim_start, (b+case when len(good)>0 then length(q)-good[-1] else 0 end)::bigint as trim_end from g""")
def reads_trim(spark, d):
    t = R.trim_reads(_reads(spark, d), least=15)
    return t.select("rec_no", F.col("trim_start").cast("bigint").alias("trim_start"), F.col("trim_end").cast("bigint").alias("trim_end"))


@query(f"""{_AL} select count(*)::bigint as total, count(*) filter (where flag&256<>0)::bigint as secondary, 0::bigint as duplicates, count(*) filter (where flag&4=0)::bigint as mapped, 0::bigint as paired,
  0::bigint as read1, 0::bigint as read2, 0::bigint as proper, 0::bigint as singletons from a""")
def alignment_flagstat(spark, d):
    return alignments.flagstat(view(spark, d, ALIGNMENTS))


@query(f"{_AL}, n as (select rname, count(*) over (partition by qname) as n from a where flag&4=0) select rname, count(*) filter (where n=1)::bigint as \"unique\", count(*) filter (where n>1)::bigint as ambiguous from n group by 1")
def alignment_ambiguity(spark, d):
    return alignments.ambiguity(view(spark, d, ALIGNMENTS))


def _contigs(spark):
    return spark.range(10).select(F.concat(F.lit("c"), "id").alias("name"), F.lit(6000).alias("length"))


@query(f"""{_AL}, b as (select rname, least(((pos-1)*30)//6000,29) as bin, count(*) as n, sum(length(seq)) as bases from a where flag&4=0 group by all), c as (select distinct rname from b),
s as (select c.rname, string_agg(chr(48+floor(log2(1+coalesce(n,0)))::int),'' order by u.bin) as signature from c cross join range(30) u(bin) left join b on b.rname=c.rname and b.bin=u.bin group by 1)
select rname, sum(bases)::bigint as bases, round(100.0*sum(bases)::double/(select sum(bases) from b)::double,6) as share, any_value(signature) as signature from b join s using (rname) group by 1""")
def alignment_coverage(spark, d):
    return alignments.coverage(view(spark, d, ALIGNMENTS), _contigs(spark)).withColumn("share", R6(F.col("share")))


@query(f"""{_AL}, m as (select rname, pos from a where flag&4=0), p as (select rname, pos::double as pos from m union all select 'c'||i, x::double from range(10) r(i), (values (1),(6000)) v(x)),
k as (select rname, avg(pos) as u from p group by 1), s as (select rname, avg(pow(pos-u,3))/pow(avg(pow(pos-u,2)),1.5) as skewness from p join k using (rname) group by 1),
d as (select rname, pos, count(*) as n from m group by all), v as (select rname, count(*) as positions, stddev_pop(n)/avg(n) as cv from d group by 1)
select rname, round(skewness,6) as skewness, round(coalesce(positions,0)*100.0/6000,6)::double as covered, round(cv,6) as cv from s left join v using (rname)""")
def alignment_skew(spark, d):
    return alignments.position_skew(view(spark, d, ALIGNMENTS), _contigs(spark)).select("rname", R6(F.col("skewness")).alias("skewness"), R6(F.col("covered").cast("double")).alias("covered"), R6(F.col("cv")).alias("cv"))


@query(f"""with a as (select *, substr('ANR',(pos%3+1)::int,1) as ref from ({ALLELES})), g as (select ref, base, sum(n) as n from a group by all), t as (select ref, sum(n) as t from g group by 1)
select ref, base, round(n::double/t::double,9) as rate from g join t using (ref) where ref<>base and n>20""")
def noise_error_rates(spark, d):
    a = view(spark, d, ALLELES).withColumn("ref", F.substr(F.lit("ANR"), (F.col("pos") % 3 + 1).cast("int"), F.lit(1))).withColumn("rev", F.col("n") - F.col("fwd"))
    return variants.error_rates(a).withColumn("rate", F.round("rate", 9))


@query(f"""{W}, s as (select substr(seq,1,8+(rec_no%3)::int) as seq, count(*) as n from reads group by 1), k as (select distinct substr(seq,1,8) as seq from reads),
h as (select s.seq, n, k.seq as key from s cross join range(4) c(c) join k on k.seq=substr(s.seq,1,(length(s.seq)-c)::int) qualify row_number() over (partition by s.seq order by c)=1) select key as seq, sum(n)::bigint as n from h group by 1""")
def species_known(spark, d):
    r = _reads(spark, d)
    s = r.groupBy(F.substr(F.col("seq"), F.lit(1), (8 + F.col("rec_no") % 3).cast("int")).alias("seq")).agg(F.count("*").alias("n"))
    return P.match_known(s, r.select(F.substring("seq", 1, 8).alias("seq")).distinct())


_GTF = "select 't'||cast(l_orderkey as string) as transcript_id, 'c' as chr, '+' as strand, case when l_linenumber%2=1 then 'exon' else 'CDS' end as feature, l_partkey*10 as beg, l_partkey*10+cast(l_quantity as bigint) as en from lineitem"


@query(f"""with g as ({_GTF}), x as (select transcript_id, min(beg) as b, max(en) as e, string_agg((en-beg+1)::varchar,',' order by beg,en) as sizes, list(beg order by beg,en) as begs, count(*) as blocks from g where feature='exon' group by 1),
c as (select transcript_id, min(beg) as tb, max(en) as te from g where feature='CDS' group by 1)
select transcript_id as name, b-1 as start, e as "end", coalesce(tb-1,b-1) as thick_start, coalesce(te,b-1) as thick_end, blocks::bigint as blocks, sizes, array_to_string(list_transform(begs, lambda y: (y-b)::varchar),',') as starts from x left join c using (transcript_id)""")
def gene_bed(spark, d):
    return _long(T.to_bed(view(spark, d, _GTF)).select("name", "start", "end", "thick_start", "thick_end", "blocks", "sizes", "starts"))


from seqlake.plans import calling  # noqa: E402, F401  more queries for QUERIES and ORACLES
from seqlake.plans import more  # noqa: E402, F401
