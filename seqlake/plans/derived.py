"""Reads, pairs, barcodes, intervals and points, derived from the driver's tables by SQL that both engines accept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

READS = """select doc_id as rec_no,
  translate(md5(text)||md5(reverse(text)),'0123456789abcdef','ACGTACGTACGTACGN') as seq,
  translate(md5('q'||cast(doc_id as string)),'0123456789abcdef','#+05:?@BDEFGHIJJ')
  ||translate(md5('r'||cast(doc_id as string)),'0123456789abcdef','#+05:?@BDEFGHIJJ') as qual
from documents where text is not null"""
PAIRS = f"""select rec_no, substring(seq,1,40) as s1, substring(qual,1,40) as q1,
  reverse(translate(substring(seq,25,40),'ACGT','TGCA')) as s2, reverse(substring(qual,25,40)) as q2 from ({READS})"""
BARCODES = "select n_nationkey as bid, substring(translate(md5(n_name),'0123456789abcdef','ACGTACGTACGTACGT'),1,8) as bc from nation"
INTERVALS = "select l_suppkey as chr, l_partkey*10 as beg, l_partkey*10+cast(l_quantity as int) as en, l_orderkey*10+l_linenumber as iid from lineitem"
POINTS = "select o_custkey%10 as chr, (o_orderkey*7)%2000 as pos, o_orderkey as pid from orders"
#: Alignments of reads to ten contigs; CIGARs of 64 bases.
ALIGNMENTS = f"""select 'r'||cast(rec_no%1000 as string) as qname, cast(case when rec_no%17=0 then 4 else (rec_no%2)*16 end + case when rec_no%13=0 then 256 else 0 end as int) as flag,
  'c'||cast(rec_no%10 as string) as rname, cast((rec_no*37)%5000+1 as int) as pos, cast((rec_no*7)%61 as int) as mapq,
  case when rec_no%5=0 then '30M2I32M' when rec_no%7=0 then '20M3D44M' else '64M' end as cigar, cast(rec_no%4 as int) as nm, seq, qual from ({READS})"""
#: The same on 600 positions of each contig, for loci that many reads cover.
DEEP = f"""select 'r'||cast(rec_no as string) as qname, cast(cast(floor(rec_no/10) as bigint)%2*16 as int) as flag, 'c'||cast(rec_no%10 as string) as rname, cast((rec_no*37)%500+1 as int) as pos, cast((rec_no*7)%61 as int) as mapq,
  case when rec_no%3=0 then '30M2I32M' when rec_no%7=0 then '20M3D44M' else '64M' end as cigar, seq, qual from ({READS})"""
ALLELES = """select l_suppkey as chr, l_partkey as pos, l_returnflag as base, count(*) as n, sum(cast(l_quantity as bigint)) as qual,
  sum(case when l_linestatus='F' then 1 else 0 end) as fwd from lineitem group by l_suppkey, l_partkey, l_returnflag"""


def view(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """``sql`` over tables of ``sf_dir``, named as they are in it."""
    out = sql
    for t in ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents"):
        out = _named(out, t, f"parquet.`{sf_dir}/{t}.parquet`")
    return once(spark.sql(out)) if "documents" in sql else spark.sql(out)


def once(df: DataFrame) -> DataFrame:
    """``df`` with every column computed once a row: the planner would put a filter, and what a lambda sees, in terms of the
    table's columns, so a read's digests were made anew for each of its bases. It moves nothing past a generated row."""
    return df.select(F.inline(F.array(F.struct(*[F.col(c) for c in df.columns]))))


def _named(sql: str, table: str, source: str) -> str:
    import re

    return re.sub(rf"\b(from|join)\s+{table}\b(?!\.)", rf"\1 {source} {table}", sql)
