"""A corpus, from raw documents to token ids: language, near-duplicates, personal data, source mix, encoding.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before kept. All but the last return the
columns of documents. Defined results: duplicates are found row by row, so rows without doc_id or with a repeated one are
judged by their own texts; null texts have no language and go in the first stage; further columns of the input are left out;
an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.llm import langid, mixing, near_dup, pieces, pii
from cuegrid.llm.common import WORD, fold_of
from cuegrid.plans.store import as_table

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def in_a_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that some learned language explains, letter by letter, as well as its own texts lead to expect; a missing lang is filled with it."""
    model = langid.train(docs.where(fold_of() != 1))
    judged = docs.select(*COLUMNS, langid.predicted(F.col("text"), model, spark).alias("p"))
    return (judged.where((F.col("p.lang_pred") != langid.UNKNOWN) & (F.col("p.fit") >= 0))
            .withColumn("lang", F.coalesce("lang", "p.lang_pred")).select(COLUMNS))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The row with the smallest doc_id of each near-duplicate group, rows without one last.

    Rows are told apart by a number of their own, written once, so equal ids link nothing. Rows without words are repeats
    only if doc_id and text are equal.
    """
    rows = as_table(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row")), "pipeline-rows")
    wordless = ~F.coalesce("text", F.lit("")).rlike(WORD)
    own = rows.select("row", F.col("doc_id").alias("id"), F.when(wordless, F.sha2(F.coalesce("text", F.lit("null")), 256)).alias("blank"))
    groups = near_dup.near_duplicates(rows.select(F.col("row").alias("doc_id"), "text")).select(F.col("doc_id").alias("row"), "component_id")
    group = F.when(F.col("blank").isNull(), F.struct(F.col("component_id"), F.lit(None).cast("long").alias("id"), "blank")).otherwise(
        F.struct(F.lit(None).cast("long").alias("component_id"), F.col("id").cast("long").alias("id"), "blank"))
    first = F.min(F.struct(F.col("id").isNull().alias("nul"), "id", "row"))
    kept = groups.join(own, "row").groupBy(group.alias("g")).agg(first.alias("first")).select("first.row")
    return rows.join(kept, "row", "left_semi").select(COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every span is replaced by its kind."""
    searched = docs.select(*COLUMNS, pii.found(F.col("text"), pii.train(docs), spark).alias("p"))
    return (searched.withColumn("n_chars", F.when(F.col("p.redacted").isNotNull(), F.length("p.redacted").cast("long")).otherwise(F.col("n_chars")))
            .withColumn("text", F.coalesce("p.redacted", "text")).select(COLUMNS))


def in_target_shares(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix takes of each document, as its text; documents of which it takes nothing go."""
    return mixing.taken_texts(docs.select(COLUMNS))


def as_token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, n_tokens, ids, decoded."""
    done = docs.select("doc_id", "lang", "source", pieces.encoded(F.col("text")).alias("e"))
    return done.select("doc_id", "lang", "source", F.size("e.ids").cast("long").alias("n_tokens"), "e.ids", "e.decoded")


STAGES = [
    ("language", in_a_language),
    ("near duplicates", one_of_each_group),
    ("personal data", without_personal_data),
    ("source mix", in_target_shares),
    ("token ids", as_token_ids),
]
#: The stages are trained, hashed or library-bound, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = as_table(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
