"""Pieces that several training-data operators share."""

from __future__ import annotations

import ctypes
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: What separates words: blank and the five ASCII controls from tab to carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold_of(doc_id: str = "doc_id") -> Column:
    """crc32 of the id's decimal text, modulo 3; rows without an id are in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 3, F.lit(0))


def utf8_words(text: str | None) -> list[bytes]:
    """The words of a text, A-Z lower-cased, as UTF-8. bytes.split and bytes.lower know ASCII only, which is the rule here."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def give_back() -> None:
    """Return freed memory to the system. Python workers live on and serve other operators, beside the executor's own memory."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim is not None:
        trim(0)


def uniform(*seeds: Column) -> Column:
    """A number in [0, 1) from 53 bits of a 64-bit hash of the columns."""
    return F.shiftrightunsigned(F.xxhash64(*seeds), 11).cast("double") * F.lit(1.0 / (1 << 53))


def sample_about(df: DataFrame, group: str, most: int, salt: str, groups: int = 1_000) -> DataFrame:
    """About `most` rows of each group (all rows of smaller groups), chosen by a hash of doc_id and of the row's number in reading order.

    Rows are drawn one by one, however many share an id, so the size of a sample is binomial. Reruns over the same files agree.
    A groupBy count and a threshold per group: no group is sorted or meets in one task. Up to `groups` groups the
    thresholds are part of the filter, so that texts outside the sample never move; with more they are joined.
    """
    u = uniform(F.col("doc_id"), F.monotonically_increasing_id(), F.lit(salt))
    counts = df.groupBy(group).count()
    few = counts.limit(groups + 1).collect()
    if len(few) <= groups:
        shares = [x for g, n in few if g is not None for x in (F.lit(g), F.lit(most / n))]
        for_null = F.lit(next((most / n for g, n in few if g is None), 0.0))
        return df.where(u < (F.coalesce(F.create_map(*shares)[F.col(group)], for_null) if shares else for_null))
    df = df.withColumn("_u", u)
    share = counts.select(F.col(group).alias("_group"), (F.lit(float(most)) / F.col("count")).alias("_share"))
    return df.join(share, F.col(group).eqNullSafe(F.col("_group"))).where("_u < _share").drop("_group", "_share", "_u")


def pieces_for(rows: int, per_task: int, least: int = 1) -> int:
    return max(least, math.ceil(rows / per_task))


def total_before(df: DataFrame, key: str, order: str, value: str, name: str, width: int = 4096) -> DataFrame:
    """df with the sum of `value` over the earlier rows of the same key; `order` is a whole number from 0.

    Two levels: inside runs of `width` order values, then over the totals of the runs, so no window holds a whole key.
    """
    run = F.floor(F.col(order) / F.lit(width))
    df = df.withColumn("_run", run)
    inside = Window.partitionBy(key, "_run").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    over = Window.partitionBy(key).orderBy("_run").rowsBetween(Window.unboundedPreceding, -1)
    runs = (df.groupBy(key, "_run").agg(F.sum(value).alias("_words"))
            .select(key, "_run", F.coalesce(F.sum("_words").over(over), F.lit(0)).alias("_before")))
    return (df.withColumn(name, F.coalesce(F.sum(value).over(inside), F.lit(0)))
            .join(runs, [key, "_run"]).withColumn(name, F.col(name) + F.col("_before")).drop("_run", "_before"))
