"""Queries of variant calling: a pileup made from alignments, its alleles, calls, genotypes and outputs, each with SQL from the alignments themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from seqlake.operators import alignments, variants
from seqlake.plans.catalogue import R6, query
from seqlake.plans.derived import DEEP, view

LIMITS = variants.Limits(min_depth=3, min_percent=5.0, min_quality_percent=2.0, min_allele=2, min_balance=0.2, min_diversity=0.05, min_agreement=0.05, min_indel=2, alpha=0.9, loci=10, max_phred=12)


def _pileup(spark, d) -> DataFrame:
    a = view(spark, d, DEEP)
    refs = spark.range(1, 700).select(F.explode(F.array(*[F.concat(F.lit("c"), F.lit(i).cast("string")) for i in range(10)])).alias("rname"), F.col("id").cast("int").alias("pos"))
    refs = refs.withColumn("ref", F.substr(F.lit("ACGT"), (F.col("pos") % 4 + 1).cast("int"), F.lit(1)))
    return alignments.pileup(a, marks=True, reference=refs).withColumnRenamed("rname", "chr")


_KINDS = "(case cigar when '30M2I32M' then [(0,0,30,'M'),(30,32,32,'M')] when '20M3D44M' then [(0,0,20,'M'),(20,20,3,'D'),(23,20,44,'M')] else [(0,0,64,'M')] end)"
_SPAN = "(case cigar when '30M2I32M' then 62 when '20M3D44M' then 67 else 64 end)"
#: Every base that a read shows at a locus, with where it is in the read; then insertions and deletions, at the base before.
SHOWN = f"""with al as (select rname as chr, pos::bigint as start, flag, cigar, mapq::bigint as mq, seq, qual, {_SPAN} as span, flag&16=0 as forward from ({DEEP}) where flag&4=0),
x as (select *, unnest({_KINDS}) as r from al), y as (select *, start+r[1]+k as pos, r[2]+case when r[4]='D' then 0 else k end as ix from x, unnest(range(0,r[3])) u(k)),
every as (select chr, pos, case when r[4]='D' then '*' else substr(seq,(ix+1)::int,1) end as base, (ascii(substr(qual,(ix+1)::int,1))-33)::bigint as q, mq, forward or r[4]='D' as fwd, pos=start as first, pos-start as o, ''::varchar as s from y),
indel as (select chr, start+29 as pos, '+' as base, (ascii(substr(qual,30,1))-33)::bigint as q, mq, forward as fwd, false as first, 29::bigint as o, substr(seq,31,2) as s from al where cigar='30M2I32M'
  union all select chr, start+19, '-', (ascii(substr(qual,20,1))-33)::bigint, mq, forward, false, 19, 'NNN' from al where cigar='20M3D44M'),
depths as (select chr, pos, count(*) as depth, max(o)+1 as reach from every group by all), ends as (select chr, start+span-1 as pos, count(*) as n, sum(span) as s from al group by all),
lens as (select d.chr, d.pos, depth, reach, (sum(s) over w)::double/(sum(n) over w) as len from depths d left join ends e using (chr, pos) window w as (partition by d.chr order by d.pos)),
own as (select chr, pos, base, o, count(*) as n from (select * from every where base<>'N' union all select * from indel) group by all), total as (select chr, pos, o, count(*) as n from every group by all),
sums as (select chr, pos, base, count(*) filter (where fwd) as fwd, count(*) filter (where not fwd) as rev, sum(q) as qual, sum(q*q) as qual_ssq, sum(mq) as mq_sum, sum(mq*mq) as mq_ssq, count(*) filter (where first) as starts,
  coalesce(list(s) filter (where s<>''), []) as seqs from (select * from every where base<>'N' union all select * from indel) group by chr, pos, base),
al1 as (select s.*, l.depth, l.reach, (s.fwd+s.rev)::double as d, (s.fwd+s.rev)/greatest(coalesce(l.len,l.reach),1)::double as e, (s.fwd+s.rev)/l.depth::double as share from sums s join lens l using (chr, pos)),
far as (select a.chr, a.pos, a.base, count(*) as places, sum(pow(floor(abs(o.n-a.e)),2))+(any_value(a.reach)-count(*))*any_value(pow(floor(a.e),2))-2*any_value(a.d) as far from al1 a join own o using (chr, pos, base) group by all),
apart as (select a.chr, a.pos, a.base, sum(greatest(t.n*pow(abs((coalesce(o.n,0)+2*a.share)/(t.n+2)-(a.d+2*a.share*a.reach)/(a.depth+2*a.reach)),3)-a.share,0)) as off
  from al1 a join total t on a.chr=t.chr and a.pos=t.pos left join own o on o.chr=a.chr and o.pos=a.pos and o.base=a.base and o.o=t.o group by all),
alleles as (select a.chr, a.pos, substr('ACGT',(a.pos%4+1)::int,1) as ref, a.base, a.depth, fwd, rev, qual, qual_ssq, mq_sum, mq_ssq, starts, seqs, base=substr('ACGT',(a.pos%4+1)::int,1) as is_ref,
  case when places=1 then 0 else greatest(0,1-greatest(0,far)/greatest(1,pow(d-e,2)-2*d)) end as diversity, greatest(0,1-cbrt(off/(a.depth+2*a.reach))/share) as agreement from al1 a join far using (chr, pos, base) join apart using (chr, pos, base))"""


@query(f"""{SHOWN} select chr, pos, ref, base, depth::bigint as depth, fwd::bigint as fwd, rev::bigint as rev, qual::bigint as qual, qual_ssq::bigint as qual_ssq, mq_sum::bigint as mq_sum, mq_ssq::bigint as mq_ssq, starts::bigint as starts,
  len(seqs)::bigint as indels, is_ref, round(diversity,6)::double as diversity, round(agreement,6)::double as agreement from alleles""")
def variant_alleles(spark, d):
    """Sums of every base at every locus, from the pileup's text."""
    c = variants.calls(_pileup(spark, d), chunk=100)
    longs = [F.col(x).cast("bigint").alias(x) for x in ("pos", "depth", "fwd", "rev", "qual", "qual_ssq", "mq_sum", "mq_ssq", "starts")]
    return c.select("chr", "ref", "base", *longs, F.size("seqs").cast("bigint").alias("indels"), "is_ref", R6(F.col("diversity")).alias("diversity"), R6(F.col("agreement")).alias("agreement"))


@query(f"""{SHOWN} select chr, pos, sum(fwd+rev)::bigint as n from alleles where mq_sum>=0 and pos between 100 and 200 and chr='c3' group by all""")
def variant_targets(spark, d):
    """Alleles of the loci in a target only."""
    t = spark.createDataFrame([("c3", 100, 150), ("c3", 140, 200)], "chr string, beg long, en long")
    return variants.calls(_pileup(spark, d), targets=t).groupBy("chr", F.col("pos").cast("bigint").alias("pos")).agg(F.sum(F.col("fwd") + F.col("rev")).alias("n"))


@query(f"""{SHOWN}, hq as (select chr, pos, base, count(*) filter (where fwd) as fwd, count(*) filter (where not fwd) as rev from every where base<>'N' and q>=20 and mq>=15 group by all) select chr, pos, base, fwd::bigint as fwd, rev::bigint as rev from hq""")
def variant_base_filters(spark, d):
    """Bases of a least quality on reads of a least mapping quality."""
    c = variants.calls(_pileup(spark, d), least_quality=20, least_mapq=15).where("base not in ('+', '-')")
    return c.select("chr", "base", *[F.col(x).cast("bigint").alias(x) for x in ("pos", "fwd", "rev")])


_L = LIMITS
#: The decisions, step by step: shares, the cut of an over-represented strand, the p-value, and what must hold.
CALLED = f"""{SHOWN}, c0 as (select *, depth as t, sum(qual) filter (where base not in ('+','-')) over (partition by chr, pos) as tq from alleles),
c1 as (select *, fwd+rev as n0, least(fwd,rev) as few, greatest(fwd,rev) as many, floor(greatest(fwd,rev)-(least(fwd,rev)/{_L.min_balance}-least(fwd,rev))) as over from c0 where t>={_L.min_depth}),
c2 as (select *, case when 100.0*n0/t>={_L.min_percent} and coalesce(100.0*qual/nullif(tq,0),0)>={_L.min_quality_percent} and n0>={_L.min_allele} and few>0 and few/n0::double<{_L.min_balance} and over>1 then over else 0 end as cut from c1),
c3 as (select * replace ((case when fwd<rev then fwd else fwd-cut end)::bigint as fwd, (case when fwd<rev then rev-cut else rev end)::bigint as rev, (qual-cut*floor(qual/n0::double))::bigint as qual, (mq_sum-cut*floor(mq_sum/n0::double))::bigint as mq_sum) from c2),
c4 as (select *, fwd+rev as n, 100.0*(fwd+rev)/t as pct, coalesce(100.0*qual/nullif(tq,0),0) as qpct, base in ('+','-') as indel from c3),
c5 as (select *, least(fwd,rev)/n::double as balance, t*pow(10.0,-least(qual/n::double,{_L.max_phred})/10) as mu, case when indel then (select max(k) from (select count(*) as k from unnest(seqs) v(z) group by z)) end as same from c4),
c6 as (select *, case when is_ref then 0 else exp(-mu+n*ln(mu)-lgamma(n+1))*{_L.loci} end as p from c5),
called as (select *, case when is_ref then 0 else least(greatest(p,{_L.loci}*pow(10.0,-mq_sum/10.0)),1.0) end as padj from c6
  where pct>={_L.min_percent} and qpct>={_L.min_quality_percent} and n>={_L.min_allele} and (balance>={_L.min_balance} or n<4) and diversity>={_L.min_diversity} and agreement>={_L.min_agreement}
  and (not indel or coalesce(same,0)>={max(_L.min_indel, _L.min_allele)}) and (base<>'*' or n>={_L.min_indel}) and p<={_L.alpha} and base<>'*')"""


def _called(spark, d) -> DataFrame:
    return variants.call(variants.calls(_pileup(spark, d), chunk=150), LIMITS)


@query(f"{CALLED} select chr, pos, base, n::bigint as n, fwd::bigint as fwd, rev::bigint as rev, qual::bigint as qual, round(pct,6)::double as pct, round(qpct,6)::double as qpct, round(balance,6)::double as balance, round(padj,6)::double as padj from called")
def variant_calls(spark, d):
    """Alleles that pass shares, strand balance, diversity, agreement and p-value."""
    c = _called(spark, d)
    return c.select("chr", "base", *[F.col(x).cast("bigint").alias(x) for x in ("pos", "n", "fwd", "rev", "qual")], *[R6(F.col(x)).alias(x) for x in ("pct", "qpct", "balance", "padj")])


GENOTYPES = f"""{CALLED}, ranked as (select *, case when len(seqs)>0 then (select z from (select z, count(*) as k from unnest(seqs) v(z) group by z) order by k desc, z limit 1) else '' end as s from called),
g as (select chr, pos, ref, count(*) as many, count(*) filter (where not is_ref) as alts, min(padj) filter (where not is_ref) as padj, string_agg(base||s||':'||round(pct,2)::double::varchar,' ' order by not is_ref, n desc, base) as alleles,
  string_agg(base,',' order by not is_ref, n desc, base) filter (where base<>ref) as alt, bool_or(base in ('+','-')) as indel from ranked group by all having count(*) filter (where not is_ref)>0)"""


@query(f"{GENOTYPES} select chr, pos, ref, case when many>1 then 'het' else 'hom' end as genotype, alleles, round(padj,6)::double as padj from g")
def variant_genotypes(spark, d):
    """Loci with a variant: heterozygous where two or more alleles pass, the reference first."""
    return variants.genotypes(_called(spark, d)).select("chr", F.col("pos").cast("bigint").alias("pos"), "ref", "genotype", F.array_join("alleles", " ").alias("alleles"), R6(F.col("padj")).alias("padj"))


@query(f"""{GENOTYPES} select chr, pos, '.' as id, ref, alt, 0.0+round(least(-10*log10(greatest(padj,1e-30)),300.0),1)::double as qual, 'PASS' as filter, 'GT='||case when many>1 then 'het' else 'hom' end as info from g""")
def variant_vcf(spark, d):
    return variants.to_vcf(variants.genotypes(_called(spark, d))).withColumn("pos", F.col("pos").cast("bigint"))


@query(f"{GENOTYPES} select count(*)::bigint as loci, count(*) filter (where many>1)::bigint as het, count(*) filter (where many=1)::bigint as hom, count(*) filter (where indel)::bigint as indels, count(*) filter (where not indel)::bigint as snps from g")
def variant_counts(spark, d):
    return variants.variant_counts(variants.genotypes(_called(spark, d)))


@query(f"{CALLED} select chr, pos, ref, max(depth)::bigint as depth, round(sum(case when is_ref then 0 else pct end),6)::double as pct, string_agg(base||':'||n::varchar,',' order by n desc, base) as calls from called group by all")
def variant_rows(spark, d):
    """The table of loci: depth, share of other bases, and counts of the alleles."""
    r = variants.to_rows(_called(spark, d))
    return r.select("chr", F.col("pos").cast("bigint").alias("pos"), "ref", F.col("depth").cast("bigint").alias("depth"), R6(F.col("pct")).alias("pct"), "calls")


@query(f"{CALLED} select chr, pos, base, n::bigint as n, fwd::bigint as fwd, rev::bigint as rev, round(qual/n::double,6)::double as quality, round(mq_sum/n::double,6)::double as mapping from called")
def variant_strands(spark, d):
    s = variants.to_strands(_called(spark, d))
    return s.select("chr", "base", *[F.col(x).cast("bigint").alias(x) for x in ("pos", "n", "fwd", "rev")], R6(F.col("quality")).alias("quality"), R6(F.col("mapping")).alias("mapping"))


@query(f"""{SHOWN}, star as (select chr, pos-1 as pos, qual/greatest(fwd+rev,1)::double as star from alleles where base='*')
select a.chr, a.pos, a.base, (case when a.base='-' and star is not null then round((fwd+rev)*least(star,qual/(fwd+rev)::double)) else qual end)::bigint as qual from alleles a left join star using (chr, pos)""")
def variant_scaled_deletions(spark, d):
    """Qualities of deletions scaled by those of the deleted bases at the next locus."""
    return variants.scale_deletions(variants.calls(_pileup(spark, d))).select("chr", F.col("pos").cast("bigint").alias("pos"), "base", "qual")


@query("""with l as (select o_orderkey as pos, o_orderstatus as ref from orders), x as (select l.pos, l.ref, i, coalesce(m.ref,'-') as b from l cross join range(-10,11) u(i) left join l m on m.pos=l.pos+i) select pos, ref, string_agg(b,'' order by i) as context from x group by all""")
def locus_context(spark, d):
    """The 21 reference bases around every locus."""
    x = spark.read.parquet(f"{d}/orders.parquet").select(F.lit(1).alias("chr"), F.col("o_orderkey").alias("pos"), F.col("o_orderstatus").alias("ref"))
    return variants.context(x, 10).select("pos", "ref", "context")


@query(f"""{SHOWN}, d as (select distinct chr, pos, depth from depths), p as (select chr, pos, depth, (select count(*) from every e where e.chr=d.chr and e.pos=d.pos and e.first) as started from d) select chr, pos, depth::bigint as depth, started::bigint as started from p""")
def pileup_marks(spark, d):
    """The pileup's text: depths, and the reads that it marks as begun."""
    p = _pileup(spark, d)
    began = F.size(F.regexp_extract_all("bases", F.lit(r"(\^.)"), F.lit(1)))
    return p.select("chr", F.col("pos").cast("bigint").alias("pos"), F.col("depth").cast("bigint").alias("depth"), began.cast("bigint").alias("started"))
