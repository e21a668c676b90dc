"""The queries opN_<name>: each operator on its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from seqlake.llm import archives, chat, decontaminate, langid, licenses, media, minhash, mixing, repair, subword
from seqlake.llm.shared import documents, table


def _bucket(n: int):
    """crc32 of doc_id as text, modulo n."""
    return F.crc32(F.col("doc_id").cast("string")) % n


def tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to legacy archives of both versions, those to WARC, and the WARC files read back."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    back = archives.read(archives.convert(archives.write_arc(pages, 0)))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.decode(repair.encode(documents(spark, sf_dir), tokenizer()))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    hard = r"\### Assistant: </turn> ok"
    own = spark.createDataFrame([(-7, 0, "user", hard), (-7, 1, "assistant", hard)], "conv_id long, turn long, role string, text string")
    return chat.read(table(chat.windows(c.unionByName(own)), "chat"))


def op4_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    margin, bias = subword.train(docs.join(labels, "doc_id"), _bucket(3) != 1)
    s = subword.score(docs, margin, bias)
    return s.select("doc_id", (_bucket(3) == 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return licenses.scan(docs, licenses.fit(licenses.unknown_sample(docs)))


def op7_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text", "lang")
    names, model = langid.train(docs, _bucket(4) != 2)
    return langid.predict(docs, names, model).select("doc_id", (_bucket(4) == 2).alias("held_out"), "lang_pred", "score")


def op8_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken(documents(spark, sf_dir))


def op10_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, index = media.store(documents(spark, sf_dir))
    return media.features(rows, index)


QUERIES = {f.__name__: f for f in (op1_warc, op2_repair, op3_chat, op4_decontaminate, op5_quality, op6_licenses, op7_langid, op8_minhash, op9_mixing, op10_media)}
#: Queries whose columns SQL gives too; those of models, token and media files are tested against brute force.
ORACLES: dict[str, str] = {
    "op1_warc": """with p as (select page_id, coalesce(html,'') as t, min(page_id) over (partition by coalesce(html,'')) as f from pages)
select page_id, strlen(t)::bigint as payload_bytes, sha256(t) as payload_digest, case when strlen(t)>=100 and f<>page_id then 'revisit' else 'response' end as record_type,
  case when strlen(t)>=100 and f<>page_id then f end as refers_to from p""",
    "op8_minhash": r"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text,''),'ABCDEFGHIJKLMNOPQRSTUVWXYZ','abcdefghijklmnopqrstuvwxyz'),'[^\x20\x09-\x0D]+') as w from documents),
s as (select doc_id, list_distinct(case when len(w)>=5 then list_transform(range(1,len(w)-3), lambda i: w[i]||' '||w[i+1]||' '||w[i+2]||' '||w[i+3]||' '||w[i+4]) when len(w)>0 then [array_to_string(w,' ')] else [] end) as s from w),
e as (select doc_id, len(s) as n, unnest(s) as x from s), c as (select a.doc_id as a, b.doc_id as b, any_value(a.n) as n, any_value(b.n) as m, count(*) as k from e a join e b on a.x=b.x and a.doc_id<>b.doc_id group by 1,2),
l as (select a, b from c where 100*k>=85*(n+m-k)), r(id, seen) as (select doc_id, doc_id from documents union select r.id, l.b from r join l on r.seen=l.a)
select s.doc_id, len(s.s)::bigint as n_shingles, min(r.seen) as component_id, min(r.seen)=s.doc_id as kept from s join r on r.id=s.doc_id group by s.doc_id, s.s""",
}
