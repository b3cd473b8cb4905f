"""The registered queries of the training-data operators: each runs over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm import alignment, bpe_counts, fingerprints, id_files, langid, licenses, maxscore, mixing, near_dup, pieces, pii, prefix_trie, toxicity
from cuegrid.llm.common import fold_of, read
from cuegrid.plans.store import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
CHECKS: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edits_and_neighbours(read(spark, sf_dir, "documents"))
    return made.select("doc_id", "n_chars", "edited_sha256", fingerprints.as_text(F.col("samples")).alias("fingerprint"),
                       fingerprints.as_text(F.col("edited_samples")).alias("edited_fingerprint"), "near_edited", "near_next")


@query
def op2_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return (docs.select("doc_id", pii.found(F.col("text"), pii.train(docs), spark).alias("p"))
            .select("doc_id", "p.n_email", "p.n_ip", "p.n_card", "p.n_phone", F.sha2("p.base", 256).alias("base_sha256"), "p.spans"))


@query
def op3_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(read(spark, sf_dir, "documents"))


@query
def op4_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(fold_of() != 1))
    return (docs.select("doc_id", (fold_of() == 1).alias("held_out"), langid.predicted(F.col("text"), model, spark).alias("p"))
            .select("doc_id", "held_out", "p.lang_pred", "p.score"))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    labels = read(spark, sf_dir, "labels").where(fold_of() != 1).select("doc_id", "toxic")
    model = toxicity.train(docs, labels)
    return (docs.select("doc_id", (fold_of() == 1).alias("held_out"), toxicity.scored(F.col("text"), model, spark).alias("score"))
            .withColumn("predicted", F.when(F.col("score") >= toxicity.THRESHOLD, 1).otherwise(0)))


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = bpe_counts.token_counts(F.col("text"))
    return (read(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n.alias("n_tokens"))
            .withColumn("over_limit", F.col("n_tokens") > 512))


@query
def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.matches(read(spark, sf_dir, "documents"))


CHECKS["op7_licenses"] = licenses.check_sql()


@query
def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return maxscore.top_k(read(spark, sf_dir, "embeddings"))


CHECKS["op8_top_k"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * cast(x as double))) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id as vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
  from v q join v c on q.vec_id <> c.vec_id where q.vec_id % 20 = 0)
select query_id, cast(rank as integer) as rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s) where rank <= 20
"""


@query
def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.word_counts(mixing.mix(read(spark, sf_dir, "documents"))[0])


@query
def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", pieces.digests(F.col("text")).alias("e")).select("doc_id", "e.*")


@query
def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.aligned(read(spark, sf_dir, "documents"))


@query
def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.shared_starts_trie(read(spark, sf_dir, "conversations"))


# crc32 bit by bit over the digits of the id; its low bits are all that is asked for
CHECKS["op12_prefix_trie"] = r"""
with t as (
  select cast(conv_id as bigint) as conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as r, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
c as (
  select conv_id, conv_id - conv_id % 20 as base,
    xor(4294967295, list_reduce(flatten(list_transform(string_split(cast(conv_id as varchar), ''), lambda x: [cast(ord(x) as bigint), -1, -1, -1, -1, -1, -1, -1, -1])),
      lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end, cast(4294967295 as bigint))) % 4 as h
  from (select distinct conv_id from t)),
b as (select c.conv_id, t.r as d, role, text from c join t on t.conv_id = c.base and t.r <= c.h),
nb as (select conv_id, count(*) as n from b group by conv_id),
r as (
  select * from b union all
  select t.conv_id, coalesce(nb.n, 0) + t.r - c.h, role, text from t join c on c.conv_id = t.conv_id left join nb on nb.conv_id = t.conv_id where t.r > c.h),
p as (
  select conv_id, d, text, md5(string_agg(md5(length(role) || ':' || role || text), '') over (partition by conv_id order by d)) as k from r),
q as (
  select *, coalesce(lag(k) over (partition by conv_id order by d), '') as pk, d = max(d) over (partition by conv_id) as last from p
  union all select conv_id, 0, '', '', null, conv_id not in (select conv_id from p) from c),
n as (
  select d, k, min(conv_id) as conv_id, count(*) as n_convs, max(pk) as pk, len(regexp_extract_all(max(text), '[^\x20\x09-\x0D]+')) as words,
    sha256(coalesce(string_agg(cast(conv_id as varchar), ',' order by conv_id) filter (last), '')) as ends_sha256
  from q group by d, k),
ch as (select pk, count(*) as n_children from n where d > 0 group by pk),
f as (select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * words as saved from n left join ch on ch.pk = n.k),
s as (
  select q.k, sum(case when f.n_children = 0 then 1 else 0 end) as n_leaves, sum(f.saved) as saved_tokens
  from f join q on q.conv_id = f.conv_id and q.d <= f.d group by q.k)
select f.conv_id, f.d as depth, g.conv_id as parent_conv_id, f.n_convs, f.n_children, cast(n_leaves as bigint) as n_leaves, cast(saved_tokens as bigint) as saved_tokens, f.ends_sha256
from f join s on s.k = f.k left join n g on g.k = f.pk and f.d > 0
"""


@query
def op13_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = new_folder(spark, "id-files")
    id_files.write_ids(read(spark, sf_dir, "documents"), folder)
    return id_files.read_ids(spark, folder)
