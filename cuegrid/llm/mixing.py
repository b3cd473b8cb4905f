"""Mixing sources to target weights: fixed-length blocks, multinomial output shards, permuted indexes.

1. Pack: the words of a source, document after document in a hashed order, are cut into blocks of `block` words.
2. Draw: every slot of an output shard picks a source at random by its target, which makes the source counts of a shard
   one multinomial draw. Slots of a source are numbered through all shards; a source's draws beyond its exact quota are
   void, and a quota that the draws leave open goes to the last shards ("top-up").
3. Map: slot i of a source takes block permutation(i mod blocks) of pass i div blocks, so no block comes up twice before
   all have come up once, and none more than twice.
4. Join: slots and blocks meet by (source, block); a hot source is spread by its block numbers.

The permutation is the swap-or-not shuffle (Hoang, Morris, Rogaway 2012): a bijection on any range, as a column expression.

Defined results: null or wordless texts have size 0 and are never taken; a null source is a source of its own, sorted last;
repeated rows and rows without doc_id are packed like any others, each row for itself; an empty table gives empty results.
Of the input only doc_id, text and source are read; further columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import WORD, pieces_for, total_before, uniform
from cuegrid.plans.store import as_table

WORDS = re.compile(WORD)
WEIGHTS = (5, 2, 1)
ROUNDS = 14
#: Documents of a source that are packed in one window, on average.
BUCKET_ROWS = 256
#: Largest number of sources for which their table is sent to every task; beyond it, it is joined like any table.
BROADCAST_SOURCES = 20_000


def permuted(i: Column, n: Column, *key: Column) -> Column:
    """The i-th element, 0 <= i < n, of a pseudorandom permutation of 0..n-1 chosen by the key."""
    def step(x: Column, r: Column) -> Column:
        partner = F.pmod(F.xxhash64(*key, 2 * r) - x, n)
        return F.when(F.xxhash64(*key, 2 * r + 1, F.greatest(x, partner)).bitwiseAND(F.lit(1)) == 1, partner).otherwise(x)

    return F.aggregate(F.array(*map(F.lit, range(ROUNDS))), i.cast("long"), step)


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """source, sid (rank), rows, source_size, target: `share` of all words dealt by weight, at most `most` times a source's size.

    Dealing the excess again by weight until none is above its cap ends where target = min(cap, level * weight) with one
    level for all; the level follows from running sums over the sources ordered by cap / weight. One row per source.
    """
    rank = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("sid"), F.lit(len(weights))) + 1).cast("int"))
    s = (sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
         .withColumn("sid", F.row_number().over(rank).cast("long") - 1)
         .withColumn("weight", w).withColumn("cap", F.lit(float(most)) * F.col("source_size"))
         .withColumn("ratio", F.col("cap") / F.col("weight")))
    below = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.orderBy("ratio", "sid").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    goal = F.lit(float(share)) * F.sum("source_size").over(every)
    s = (s.withColumn("goal", goal)
         .withColumn("level", (F.col("goal") - F.coalesce(F.sum("cap").over(below), F.lit(0.0)))
                     / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(below), F.lit(0.0)))))
    # the level is that of the first source, in order of ratio, which its own level does not push above its cap
    open_ = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "sid", "level"))).over(every)["level"]
    return s.select("source", "sid", "rows", "source_size",
                    F.least(F.col("cap"), F.coalesce(open_, F.lit(float("inf"))) * F.col("weight")).alias("target"))


def mix(docs: DataFrame, block: int = 64, slots_per_shard: int = 16_384, seed: int = 9) -> tuple[DataFrame, DataFrame]:
    """(taken, slots).

    taken: row (a number for each input row), doc_id, digest (a hash of the text), size, source_size, target, and parts, an array of (first, last, times):
    words first..last-1 of the document come `times` times; null if none comes. slots: sid, shard, ordinal, pass, block.
    """
    sized = as_table(docs.select(
        "doc_id", F.col("source").alias("doc_source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.xxhash64("doc_id", F.length("text"), F.lit(seed)).alias("h"), F.xxhash64("text").alias("digest"), F.monotonically_increasing_id().alias("row")), "mix-sizes")
    quota = F.round(F.col("target") * F.col("blocks") / F.greatest("source_size", F.lit(1))).cast("long")
    sources = as_table(source_targets(sized.withColumnRenamed("doc_source", "source"))
                       .withColumn("blocks", F.ceil(F.col("source_size") / F.lit(block)).cast("long"))
                       .withColumn("quota", F.least(2 * F.col("blocks"), quota)), "mix-sources")
    n_sources = sources.count()
    small = F.broadcast(sources) if n_sources <= BROADCAST_SOURCES else sources
    bucketed = (sized.join(small, F.col("doc_source").eqNullSafe(F.col("source")))
                .withColumn("bucket", F.pmod(F.col("h"), F.ceil(F.col("rows") / F.lit(BUCKET_ROWS)).cast("long"))))

    # running word offsets of a source: over its buckets, then inside each
    starts = total_before(bucketed.groupBy("sid", "bucket").agg(F.sum("size").alias("words")), "sid", "bucket", "words", "bucket_start")
    inside = Window.partitionBy("sid", "bucket").orderBy("h", "row").rowsBetween(Window.unboundedPreceding, -1)
    packed = as_table(bucketed.withColumn("start", F.coalesce(F.sum("size").over(inside), F.lit(0)))
                      .join(starts.select("sid", "bucket", "bucket_start"), ["sid", "bucket"])
                      .select("row", "doc_id", "digest", "sid", "size", "source_size", "target", (F.col("start") + F.col("bucket_start")).alias("start")), "mix-packed")
    end, b = F.col("start") + F.col("size"), F.lit(block)
    cut = (packed.where("size > 0")
           .withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / b), F.floor((end - 1) / b))))
           .select("sid", "block", "row", (F.greatest(F.col("block") * b, F.col("start")) - F.col("start")).alias("first"),
                   (F.least((F.col("block") + 1) * b, end) - F.col("start")).alias("last")))
    slots = draw(sources, n_sources, slots_per_shard, seed)
    drawn = slots.groupBy("sid", "block").agg(F.count(F.lit(1)).alias("times"))
    parts = (cut.join(drawn, ["sid", "block"]).groupBy("row")
             .agg(F.array_sort(F.collect_list(F.struct("first", "last", "times"))).alias("parts")))
    return packed.select("row", "doc_id", "digest", "size", "source_size", "target").join(parts, "row", "left"), slots


def draw(sources: DataFrame, n_sources: int, slots_per_shard: int, seed: int) -> DataFrame:
    """sid, shard, ordinal, pass, block: one row for each slot of the mix; each source has exactly its quota."""
    spark = sources.sparkSession
    total = sources.agg(F.coalesce(F.sum("quota"), F.lit(0))).first()[0]
    shards = pieces_for(total, slots_per_shard)
    per = -(-total // shards)
    # cells of equal width over [0, 1) find a slot's source by an equality join, however many sources there are
    cells = max(4096, 4 * n_sources)
    upto = F.sum("quota").over(Window.orderBy("sid").rowsBetween(Window.unboundedPreceding, 0))
    edges = (sources.where("quota > 0").select("sid", "quota", "blocks", upto.alias("upto"))
             .select("sid", ((F.col("upto") - F.col("quota")) / F.lit(float(max(total, 1)))).alias("low"), (F.col("upto") / F.lit(float(max(total, 1)))).alias("high")))
    cell_edges = edges.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.floor(F.col("high") * cells))))
    picks = (spark.range(0, total, 1, max(1, min(1024, total // 65_536 + 1)))
             .select(F.floor(F.col("id") / F.lit(per)).alias("shard"), uniform(F.col("id"), F.lit(seed)).alias("u"))
             .withColumn("cell", F.floor(F.col("u") * cells)))
    counts = (picks.join(cell_edges, "cell").where((F.col("u") >= F.col("low")) & (F.col("u") < F.col("high")))
              .groupBy("sid", "shard").agg(F.count(F.lit(1)).alias("n")))
    placed = total_before(counts, "sid", "shard", "n", "before")
    drawn = placed.groupBy("sid").agg(F.sum("n").alias("drawn"))
    # the last shards take what the draws left open of a quota
    topup = (sources.join(drawn, "sid", "left").withColumn("drawn", F.coalesce("drawn", F.lit(0))).where("drawn < quota")
             .withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("quota") - F.col("drawn") - 1) / F.lit(slots_per_shard)))))
             .select("sid", (F.lit(shards) + F.col("k")).alias("shard"), F.least(F.lit(slots_per_shard), F.col("quota") - F.col("drawn") - F.col("k") * slots_per_shard).alias("n"),
                     (F.col("drawn") + F.col("k") * slots_per_shard).alias("before")))
    runs = placed.select("sid", "shard", "n", "before").unionByName(topup)
    meta = sources.select("sid", "quota", "blocks")
    return (runs.repartition(pieces_for(total, 4 * slots_per_shard), "sid", "shard").join(F.broadcast(meta) if n_sources <= BROADCAST_SOURCES else meta, "sid")
            .withColumn("ordinal", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("n") - 1)))
            .where("ordinal < quota").withColumn("pass", F.floor(F.col("ordinal") / F.col("blocks")))
            .select("sid", "shard", "ordinal", "pass", permuted(F.pmod("ordinal", "blocks"), F.col("blocks"), F.col("sid"), F.col("pass"), F.lit(seed)).alias("block")))


def word_counts(taken: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken: the words that the mix takes of each document, repeats counted."""
    words = F.aggregate("parts", F.lit(0).cast("long"), lambda a, p: a + (p["last"] - p["first"]) * p["times"])
    return taken.select("doc_id", "size", "source_size", F.col("target").cast("double"), F.coalesce(words, F.lit(0)).cast("long").alias("taken"))


def rebuilt(text: str, parts: list[tuple[int, int, int]]) -> str:
    """The taken words of a text, each with the white space that follows it, runs of equal repeats one after another."""
    starts = [m.start() for m in WORDS.finditer(text)]
    edges = [0, *starts[1:], len(text)]
    runs: list[list[int]] = []
    for first, last, times in parts:
        if runs and runs[-1][1] == first and runs[-1][2] == times:
            runs[-1][1] = last
        else:
            runs.append([first, last, times])
    out = []
    for first, last, times in runs:
        piece = text[edges[first]:edges[last]]
        out += [piece] * times
    glued = [p if p[-1:].isspace() else p + " " for p in out[:-1]]
    return "".join([*glued, *out[-1:]])


def taken_texts(docs: DataFrame, **settings: int) -> DataFrame:
    """docs with the text that the mix takes, and its n_chars; rows of which nothing is taken are left out.

    Rows meet their parts by (doc_id, text hash, place among equal rows), so repeated rows are served one by one.
    """
    digest = F.xxhash64("text")
    marked = docs.withColumn("_k", F.coalesce(F.col("doc_id").cast("long"), F.lit(0))).withColumn("_nul", F.col("doc_id").isNull()).withColumn("_digest", digest)
    taken = mix(docs, **settings)[0].where("parts is not null")
    keys = ["_k", "_nul", "_digest"]
    parts = (taken.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("_k"), F.col("doc_id").isNull().alias("_nul"), F.col("digest").alias("_digest"), "row", "parts")
             .withColumn("_turn", F.row_number().over(Window.partitionBy(*keys).orderBy("row"))).drop("row"))
    turns = marked.repartition(*keys).withColumn("_copy", F.row_number().over(Window.partitionBy(*keys).orderBy("source", "lang")))
    met = turns.join(parts, keys).where(F.col("_copy") - F.col("_turn") == 0)

    def texts(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for text, own in batches:
            yield pd.Series([rebuilt(t, [(p["first"], p["last"], p["times"]) for p in ps]) for t, ps in zip(text, own)])

    made = met.withColumn("text", F.pandas_udf(texts, "string")("text", "parts"))
    return made.withColumn("n_chars", F.length("text").cast("long")).select(docs.columns)
