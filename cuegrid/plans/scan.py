"""Ordered scans over long sequences without one task per key.

A plain window partitioned by the media id puts a whole medium into one task.
Here every sequence is cut into chunks of its integer order column, so a task
holds at most `width` order values of one key. Each pass computes

  1. a window inside (keys, chunk),
  2. one summary row per (keys, chunk), and a window over those few rows,
  3. a join of the summary back to its chunk.

Only step 1 moves the rows, and it hashes on (keys, chunk), so a hot key
spreads over as many tasks as it has chunks.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from cuegrid.plans.store import cut

CHUNK = "_chunk"
FIRST_TO_HERE = (Window.unboundedPreceding, Window.currentRow)
FIRST_TO_BEFORE = (Window.unboundedPreceding, -1)


@dataclass(frozen=True)
class Sequence:
    """Keys, total order inside a key, and the chunk width in order units.

    The first order column must be an integer; it decides the chunk. Keys and
    order are not null.
    """

    keys: tuple[str, ...]
    order: tuple[str, ...]
    width: int = 65_536
    ready: bool = False  # the rows already carry their chunk

    def chunk(self) -> Column:
        return F.floor(F.col(self.order[0]) / F.lit(self.width)).cast("long")

    def with_chunk(self, df: DataFrame) -> DataFrame:
        return df if self.ready else df.withColumn(CHUNK, self.chunk())

    @property
    def chunk_keys(self) -> list[str]:
        return [*self.keys, CHUNK]

    def order_struct(self) -> Column:
        return F.struct(*self.order)

    def local(self, descending: bool = False) -> WindowSpec:
        order = [F.col(c).desc() if descending else F.col(c).asc() for c in self.order]
        return Window.partitionBy(*self.chunk_keys).orderBy(*order)

    def chain(self, descending: bool = False) -> WindowSpec:
        c = F.col(CHUNK)
        return Window.partitionBy(*self.keys).orderBy(c.desc() if descending else c.asc())


def _join_chain(rows: DataFrame, chain: DataFrame, seq: Sequence) -> DataFrame:
    """Plain equality, so the join reuses the hash partitioning of the local window."""
    return rows.join(chain, seq.chunk_keys, "left")


def neighbours(
    df: DataFrame,
    seq: Sequence,
    prev: Mapping[str, Column] | None = None,
    next: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Add values of the row before / after; null at either end of the key."""
    prev, next = dict(prev or {}), dict(next or {})
    base = seq.with_chunk(df)
    carried = F.struct(*[e.alias(f"p_{a}") for a, e in prev.items()], *[e.alias(f"n_{a}") for a, e in next.items()])
    base = base.withColumn("_nb_c", carried)
    edges = base.groupBy(*seq.chunk_keys).agg(
        F.min_by("_nb_c", seq.order_struct()).alias("_first"), F.max_by("_nb_c", seq.order_struct()).alias("_last"),
    )
    chain = edges.select(
        *seq.chunk_keys,
        F.lag("_last").over(seq.chain()).alias("_nb_before"), F.lead("_first").over(seq.chain()).alias("_nb_after"),
    )
    w = seq.local()
    rows = base.withColumn("_nb_lag", F.lag("_nb_c").over(w)).withColumn("_nb_lead", F.lead("_nb_c").over(w))
    rows = _join_chain(rows, chain, seq)
    for a in prev:
        rows = rows.withColumn(a, F.when(F.col("_nb_lag").isNotNull(), F.col(f"_nb_lag.p_{a}")).otherwise(F.col(f"_nb_before.p_{a}")))
    for a in next:
        rows = rows.withColumn(a, F.when(F.col("_nb_lead").isNotNull(), F.col(f"_nb_lead.n_{a}")).otherwise(F.col(f"_nb_after.n_{a}")))
    return rows.drop(CHUNK, "_nb_c", "_nb_lag", "_nb_lead", "_nb_before", "_nb_after")


@dataclass(frozen=True)
class Run:
    """One running value: op in sum, max, min, first, last (the last two skip nulls).

    first and last follow the scan, so "last" scanned backward is the nearest
    value at or after the row.
    """

    op: str
    value: Column
    exclusive: bool = False
    backward: bool = False

    def total(self, value: Column, order: Column) -> Column:
        if self.op in ("first", "last"):
            known = F.when(value.isNotNull(), order)
            earliest = (self.op == "first") != self.backward
            return F.min_by(value, known) if earliest else F.max_by(value, known)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.op](value)

    def windowed(self, value: Column) -> Column:
        if self.op == "first":
            return F.first(value, ignorenulls=True)
        if self.op == "last":
            return F.last(value, ignorenulls=True)
        return {"sum": F.sum, "max": F.max, "min": F.min}[self.op](value)

    def combine(self, before: Column, here: Column) -> Column:
        if self.op == "sum":
            return F.coalesce(before, F.lit(0)) + F.coalesce(here, F.lit(0))
        if self.op == "max":
            return F.greatest(before, here)
        if self.op == "min":
            return F.least(before, here)
        return F.coalesce(before, here) if self.op == "first" else F.coalesce(here, before)


def running(df: DataFrame, seq: Sequence, runs: Mapping[str, Run]) -> DataFrame:
    """Running aggregates from the start of the key (or from its end, backward)."""
    base = seq.with_chunk(df)
    for a, r in runs.items():
        base = base.withColumn(f"_v_{a}", r.value)
    order = seq.order_struct()
    totals = base.groupBy(*seq.chunk_keys).agg(*[r.total(F.col(f"_v_{a}"), order).alias(f"_t_{a}") for a, r in runs.items()])
    chain = totals.select(
        *seq.chunk_keys,
        *[r.windowed(F.col(f"_t_{a}")).over(seq.chain(r.backward).rowsBetween(*FIRST_TO_BEFORE)).alias(f"_o_{a}")
          for a, r in runs.items()],
    )
    rows = base
    for a, r in runs.items():
        frame = FIRST_TO_BEFORE if r.exclusive else FIRST_TO_HERE
        rows = rows.withColumn(f"_h_{a}", r.windowed(F.col(f"_v_{a}")).over(seq.local(r.backward).rowsBetween(*frame)))
    rows = _join_chain(rows, chain, seq)
    for a, r in runs.items():
        rows = rows.withColumn(a, r.combine(F.col(f"_o_{a}"), F.col(f"_h_{a}")))
    return rows.drop(CHUNK, *[f"{p}{a}" for a in runs for p in ("_v_", "_h_", "_o_")])


def islands(
    df: DataFrame,
    seq: Sequence,
    need: Mapping[str, Column],
    starts: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    out: str = "island",
    first_flag: str | None = None,
) -> DataFrame:
    """Number runs of rows: a row opens a new run if starts(previous, row) is true.

    starts gets two accessors, name -> Column, for the values listed in need.
    The neighbour test and the running count share one pass: the flag of a
    chunk's first row is settled on the chunk summaries.
    """
    def test(before: str, here: str) -> Column:
        hit = starts(lambda n: F.col(f"{before}.{n}"), lambda n: F.col(f"{here}.{n}"))
        return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)

    w = seq.local()
    base = seq.with_chunk(df).withColumn("_is_c", F.struct(*[e.alias(a) for a, e in need.items()]))
    base = base.withColumn("_is_p", F.lag("_is_c").over(w))
    base = base.withColumn("_is_f", F.when(F.col("_is_p").isNotNull(), test("_is_p", "_is_c")).otherwise(0))
    base = base.withColumn("_is_r", F.sum("_is_f").over(w.rowsBetween(*FIRST_TO_HERE)))
    summary = base.groupBy(*seq.chunk_keys).agg(
        F.min_by("_is_c", seq.order_struct()).alias("_is_first"), F.max_by("_is_c", seq.order_struct()).alias("_is_last"),
        F.sum("_is_f").alias("_is_n"),
    )
    chain = summary.withColumn("_is_before", F.lag("_is_last").over(seq.chain()))
    chain = chain.withColumn("_is_head", F.when(F.col("_is_before").isNull(), 1).otherwise(test("_is_before", "_is_first")))
    chain = chain.select(
        *seq.chunk_keys, "_is_head",
        (F.sum("_is_head").over(seq.chain().rowsBetween(*FIRST_TO_HERE))
         + F.coalesce(F.sum("_is_n").over(seq.chain().rowsBetween(*FIRST_TO_BEFORE)), F.lit(0))).alias("_is_off"),
    )
    rows = _join_chain(base, chain, seq).withColumn(out, F.col("_is_off") + F.col("_is_r"))
    if first_flag:
        rows = rows.withColumn(first_flag, F.when(F.col("_is_p").isNull(), F.col("_is_head")).otherwise(F.col("_is_f")))
    return rows.drop(CHUNK, "_is_c", "_is_p", "_is_f", "_is_r", "_is_head", "_is_off")


def sections(
    df: DataFrame,
    seq: Sequence,
    need: Mapping[str, Column],
    starts: Callable[[Callable[[str], Column], Callable[[str], Column]], Column],
    out: str = "island",
    first_flag: str = "first",
    prev: Mapping[str, str] | None = None,
    next: Mapping[str, str] | None = None,
    totals: Mapping[str, Column] | None = None,
    per_key: DataFrame | None = None,
) -> DataFrame:
    """Islands with neighbours and running totals: the rows move, are sorted and are stored once.

    prev and next name values of need to be taken from the row before or after
    (null at either end of the key), totals run from the start of the key.
    The columns of per_key, one row a key, are added to every row. A chunk is
    summed up by its first and last row alone, read from the stored rows.
    """
    prev, next, totals = dict(prev or {}), dict(next or {}), dict(totals or {})

    def test(before: str, here: str) -> Column:
        hit = starts(lambda n: F.col(f"{before}.{n}"), lambda n: F.col(f"{here}.{n}"))
        return F.when(F.coalesce(hit, F.lit(False)), 1).otherwise(0)

    w = seq.local()
    upto = w.rowsBetween(*FIRST_TO_HERE)
    rows = seq.with_chunk(df).withColumn("_se_c", F.struct(*[e.alias(a) for a, e in need.items()]))
    rows = rows.withColumns({f"_se_v_{a}": e for a, e in totals.items()})
    rows = rows.withColumns({"_se_p": F.lag("_se_c").over(w), "_se_n": F.lead("_se_c").over(w)})
    opens, closes = F.col("_se_p").isNull(), F.col("_se_n").isNull()
    rows = rows.withColumn("_se_f", F.when(opens, 0).otherwise(test("_se_p", "_se_c")))
    rows = rows.withColumns({"_se_r": F.sum("_se_f").over(upto), **{f"_se_h_{a}": F.sum(f"_se_v_{a}").over(upto) for a in totals}})
    near = {f"_se_b_{a}": F.col(f"_se_p.{n}") for a, n in prev.items()} | {f"_se_a_{a}": F.col(f"_se_n.{n}") for a, n in next.items()}
    rows = rows.withColumns({"_se_opens": opens, "_se_closes": closes, **near}).withColumn("_se_c", F.when(opens | closes, F.col("_se_c")))
    rows = cut(rows.drop("_se_p", "_se_n", *[f"_se_v_{a}" for a in totals]))

    ends = rows.where("_se_opens or _se_closes").groupBy(*seq.chunk_keys).agg(
        F.max(F.when(F.col("_se_opens"), F.col("_se_c"))).alias("_se_first"), F.max(F.when(F.col("_se_closes"), F.col("_se_c"))).alias("_se_last"),
        F.max("_se_r").alias("_se_k"), *[F.max(F.when(F.col("_se_closes"), F.col(f"_se_h_{a}"))).alias(f"_se_t_{a}") for a in totals])
    before = seq.chain().rowsBetween(*FIRST_TO_BEFORE)
    chain = ends.withColumns({"_se_before": F.lag("_se_last").over(seq.chain()), "_se_after": F.lead("_se_first").over(seq.chain())})
    chain = chain.withColumn("_se_head", F.when(F.col("_se_before").isNull(), 1).otherwise(test("_se_before", "_se_first")))
    chain = chain.select(
        *seq.chunk_keys, "_se_head", "_se_before", "_se_after",
        (F.sum("_se_head").over(seq.chain().rowsBetween(*FIRST_TO_HERE)) + F.coalesce(F.sum("_se_k").over(before), F.lit(0))).alias("_se_off"),
        *[F.coalesce(F.sum(f"_se_t_{a}").over(before), F.lit(0)).alias(f"_se_o_{a}") for a in totals])
    if per_key is not None:
        chain = chain.join(per_key, list(seq.keys), "left")
    rows = _join_chain(rows, chain, seq)
    rows = rows.withColumns({
        out: F.col("_se_off") + F.col("_se_r"), first_flag: F.when(F.col("_se_opens"), F.col("_se_head")).otherwise(F.col("_se_f")),
        **{a: F.when(F.col("_se_opens"), F.col(f"_se_before.{n}")).otherwise(F.col(f"_se_b_{a}")) for a, n in prev.items()},
        **{a: F.when(F.col("_se_closes"), F.col(f"_se_after.{n}")).otherwise(F.col(f"_se_a_{a}")) for a, n in next.items()},
        **{a: F.col(f"_se_o_{a}") + F.coalesce(F.col(f"_se_h_{a}"), F.lit(0)) for a in totals}})
    return rows.drop(CHUNK, *[c for c in rows.columns if c.startswith("_se_")])


def numbered(df: DataFrame, seq: Sequence, out: str) -> DataFrame:
    """1-based position inside the key."""
    return running(df, seq, {out: Run("sum", F.lit(1).cast("long"))})


def ranked_by(df: DataFrame, keys: tuple[str, ...], order: list[Column], out: str) -> DataFrame:
    """1-based rank inside the key by any sortable columns that give a total order.

    Range partitioning samples the data and splits a hot key over several
    partitions in order; the partition numbers are stored before they serve as
    chunks, because a second evaluation could draw other bounds.
    """
    placed = df.withColumn("_rank_key", F.struct(*order)).repartitionByRange(*keys, "_rank_key")
    placed = cut(placed.withColumn(CHUNK, F.spark_partition_id().cast("long")))
    return numbered(placed, Sequence(keys, ("_rank_key",), ready=True), out).drop("_rank_key")


def paced(
    df: DataFrame, seq: Sequence, weight: Column, value: Column, op: str,
    progress: str, reach: str, reach_before: str | None = None,
) -> DataFrame:
    """Running max or min of value measured against a running total, in one pass.

    progress is the total of weight over the rows before; reach is the extreme of
    (value - progress) up to the row, reach_before the same without the row. A
    chunk settles both against its own total; the chain shifts them.
    """
    best = {"max": F.max, "min": F.min}[op]
    pick = {"max": F.greatest, "min": F.least}[op]
    w = seq.local()
    base = seq.with_chunk(df).withColumn("_pc_w", weight).withColumn("_pc_v", value)
    base = base.withColumn("_pc_p", F.coalesce(F.sum("_pc_w").over(w.rowsBetween(*FIRST_TO_BEFORE)), F.lit(0)))
    base = base.withColumn("_pc_d", F.col("_pc_v") - F.col("_pc_p"))
    base = base.withColumn("_pc_upto", best("_pc_d").over(w.rowsBetween(*FIRST_TO_HERE)))
    if reach_before:
        base = base.withColumn("_pc_past", best("_pc_d").over(w.rowsBetween(*FIRST_TO_BEFORE)))
    summary = base.groupBy(*seq.chunk_keys).agg(F.sum("_pc_w").alias("_pc_sum"), best("_pc_d").alias("_pc_best"))
    before = seq.chain().rowsBetween(*FIRST_TO_BEFORE)
    chain = summary.withColumn("_pc_off", F.coalesce(F.sum("_pc_sum").over(before), F.lit(0)))
    chain = chain.select(*seq.chunk_keys, "_pc_off", best(F.col("_pc_best") - F.col("_pc_off")).over(before).alias("_pc_reach"))
    rows = _join_chain(base, chain, seq)
    rows = rows.withColumn(progress, F.col("_pc_off") + F.col("_pc_p"))
    rows = rows.withColumn(reach, pick(F.col("_pc_reach"), F.col("_pc_upto") - F.col("_pc_off")))
    if reach_before:
        rows = rows.withColumn(reach_before, pick(F.col("_pc_reach"), F.col("_pc_past") - F.col("_pc_off")))
    return rows.drop(CHUNK, "_pc_w", "_pc_v", "_pc_p", "_pc_d", "_pc_upto", "_pc_past", "_pc_off", "_pc_reach")
