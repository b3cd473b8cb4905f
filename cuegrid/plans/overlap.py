"""Interval-overlap join on time buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.plans.scan import Run, Sequence, running

BUCKET_MS = 60_000


def _bucket(ms: Column, width: int) -> Column:
    return F.floor(ms / F.lit(width)).cast("long")


def overlap_pairs(
    left: DataFrame,
    right: DataFrame,
    key: str,
    l_start: str,
    l_end: str,
    r_start: str,
    r_end: str,
    width: int = BUCKET_MS,
) -> DataFrame:
    """Inner join of the spans of one key that share time, each pair once.

    Apart from the key the two sides must not share column names. Both sides
    are spread over the buckets they touch and equi-joined on (key, bucket), so
    a hot key is split by time and only spans of the same bucket meet. A pair is
    kept in the bucket where the later of the two starts falls, which makes a
    distinct over the pairs unnecessary.
    """
    def spread(df: DataFrame, start: str, end: str, out: str) -> DataFrame:
        buckets = F.sequence(_bucket(F.col(start), width), _bucket(F.col(end) - 1, width))
        return df.where(F.col(end) > F.col(start)).withColumn(out, F.explode(buckets))

    lhs = spread(left, l_start, l_end, "_bucket")
    rhs = spread(right, r_start, r_end, "_bucket")
    later = F.greatest(F.col(l_start), F.col(r_start))
    pairs = lhs.join(rhs, [key, "_bucket"]).where(
        (F.col(l_start) < F.col(r_end)) & (F.col(r_start) < F.col(l_end)) & (F.col("_bucket") == _bucket(later, width))
    )
    return pairs.drop("_bucket")


def shared_ms(l_start: str, l_end: str, r_start: str, r_end: str) -> Column:
    return F.greatest(F.lit(0), F.least(F.col(l_end), F.col(r_end)) - F.greatest(F.col(l_start), F.col(r_start)))


def overlap_totals(spans: DataFrame, others: DataFrame, keys: tuple[str, ...], ids: tuple[str, ...], start: str = "start_ms", end: str = "end_ms", width: int = 86_400_000) -> DataFrame:
    """keys, ids, others (how many of the others a span overlaps), shared_ms (for how long in total): one row for each span.

    No pairs are formed. Up to a time t the others have lasted t * (begun - ended) - (sum of starts - sum of ends) in all,
    so a span shares the difference between its end and its start; it meets those that begin before it ends and do
    not end before it starts. Both follow from running sums over the starts and ends of the others and of
    the spans. Spans and others of no or negative length overlap nothing; ids with keys tell the spans apart.
    """
    last, ask, first = 0, 1, 2  # at one time, ends come before the spans' own edges, and starts after them
    real = F.col(end) > F.col(start)
    none = [F.lit(None).cast(spans.schema[i].dataType).alias(i) for i in ids]
    edge = lambda t, kind, sign: [t.alias("t"), F.lit(kind).alias("kind"), F.lit(sign).alias("sign")]
    o = others.where(real)
    s = spans.where(real)
    events = (o.select(*keys, *none, *edge(F.col(start).cast("long"), first, 1)).unionByName(o.select(*keys, *none, *edge(F.col(end).cast("long"), last, -1)))
              .unionByName(s.select(*keys, *ids, *edge(F.col(start).cast("long"), ask, -1))).unionByName(s.select(*keys, *ids, *edge(F.col(end).cast("long"), ask, 1))))
    # equal moments are told apart by their sign alone: sums over them do not depend on their order
    asked = F.col("kind") == ask
    step = lambda v: F.when(asked, 0).otherwise(v)
    summed = running(events, Sequence(keys, ("t", "kind", "sign"), width), {
        "begun": Run("sum", step(F.when(F.col("kind") == first, 1).otherwise(0))), "ended": Run("sum", step(F.when(F.col("kind") == last, 1).otherwise(0))),
        "moments": Run("sum", step(F.col("sign") * F.col("t")))})
    lasted = F.col("t") * (F.col("begun") - F.col("ended")) - F.col("moments")
    met = summed.where(asked).groupBy(*keys, *ids).agg(
        F.sum(F.when(F.col("sign") > 0, F.col("begun")).otherwise(-F.col("ended"))).alias("others"), F.sum(F.col("sign") * lasted).alias("shared_ms"))
    flat = spans.where(~F.coalesce(real, F.lit(False))).select(*keys, *ids, F.lit(0).cast("long").alias("others"), F.lit(0).cast("long").alias("shared_ms"))
    return met.unionByName(flat)
