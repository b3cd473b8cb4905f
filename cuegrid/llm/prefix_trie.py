"""A trie of shared conversation prefixes, built as a burst trie over shards.

1. Every turn gets an id (128 bits over role and text), every prefix of a conversation a key (128 bits, a running sum of hashes of
   turn ids and depths). Turns become narrow rows (conv_id, depth, key, parent's key); no conversation is gathered into an array.
2. Burst: the trie starts as one container with all suffixes. A container of more than `container` rows bursts by the next turn id: its head
   becomes a trie node, its suffixes go to one container for each next id. A round bursts 1, 2, 4, ... levels of what is still oversized, so
   rounds grow with the logarithm of the depth, and rows of settled containers are not read again.
3. Sweep: containers are dealt by their head over shards. A shard streams its containers, sorted by depth and key, into nodes, and sums each
   up from the leaves. A task holds one batch and one container, which is bounded.
4. Burst nodes have more than `container` rows below them, so there are few; they are aggregated map-side, take what the containers below them
   sum up to, and pass sums on to their ancestors by pointer doubling.

Members that end at a burst node may be any number. Their ids are joined in distributed runs of 4,096 id values; SHA-256 itself is serial, so
the runs of one node are hashed as a stream by one task.

Defined results: rows without conv_id belong to no conversation and are left out; a null role or text is empty; equal turn numbers of
a conversation are ordered by a hash of role and text, and repeated rows are turns of their own. Division of negative ids truncates, as in SQL.
Further columns are ignored; an empty table has no nodes. Equal keys count as equal sequences (128 bits).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import WORD
from cuegrid.plans.scan import Run, Sequence, ranked_by, running
from cuegrid.plans.store import as_table

#: Most rows (turns below the head) of a container that does not burst.
CONTAINER = 1_000
LIMBS = 4
KEY = ["depth", "k1", "k2"]
RUN_OF_IDS = 4_096


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, r (place from 1), t1, t2 (turn id), words (of the text)."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    named = conversations.where("conv_id is not null").select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.xxhash64(F.lit(1), role, text).alias("t1"), F.xxhash64(F.lit(2), text, role).alias("t2"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return ranked_by(named, ("conv_id",), [F.col(c) for c in ("turn", "t1", "t2")], "r").select("conv_id", "r", "t1", "t2", "words")


def with_shared_starts(turns: DataFrame, family: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conversations, rows) after each conversation c took its first h turns from conversation c - c % family, h = crc32(c) % most.

    conversations: conv_id, n (turns); rows: conv_id, depth, t1, t2, words.
    """
    own = turns.groupBy("conv_id").agg(F.count(F.lit(1)).alias("own"))
    id_ = F.col("conv_id")
    plan = own.select("conv_id", "own", (id_ - id_ % family).alias("base"), (F.crc32(id_.cast("string")) % most).alias("h"))
    sizes = own.where(id_ % family == 0).select(id_.alias("base"), F.col("own").alias("base_turns"))
    plan = as_table(plan.join(sizes, "base", "left").select("conv_id", "base", "h", F.least("h", F.coalesce("base_turns", F.lit(0))).alias("taken"), "own"), "trie-plan")
    given = turns.where((id_ % family == 0) & (F.col("r") < most)).withColumnRenamed("conv_id", "base")
    start = plan.join(given, "base").where("r <= h").select("conv_id", F.col("r").alias("depth"), "t1", "t2", "words")
    rest = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("r > h").select("conv_id", (F.col("taken") + F.col("r") - F.col("h")).alias("depth"), "t1", "t2", "words")
    sized = plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n"))
    return sized, start.unionByName(rest)


def keyed(rows: DataFrame, sized: DataFrame) -> DataFrame:
    """conv_id, depth, n, words, k1, k2 (the prefix up to this turn), p1, p2 (the prefix before it)."""
    low, mask = 32, F.lit(0xFFFFFFFF)
    ids = rows.withColumns({f"_x{i}": F.xxhash64(F.lit(i), "t1", "t2", "depth").bitwiseAND(mask) for i in range(LIMBS)})
    summed = running(ids, Sequence(("conv_id",), ("depth",), width=4_096), {f"_s{i}": Run("sum", F.col(f"_x{i}")) for i in range(LIMBS)})
    half = lambda a, b: F.shiftleft(a.bitwiseAND(mask), low).bitwiseOR(b.bitwiseAND(mask))
    here = [F.col(f"_s{i}") for i in range(LIMBS)]
    before = [F.col(f"_s{i}") - F.col(f"_x{i}") for i in range(LIMBS)]
    return summed.join(sized, "conv_id").select("conv_id", "depth", "n", "words", half(*here[:2]).alias("k1"), half(*here[2:]).alias("k2"), half(*before[:2]).alias("p1"), half(*before[2:]).alias("p2"))


def burst(rows: DataFrame, container: int) -> DataFrame:
    """KEY of every burst node below the root."""
    low, step, open_, found = 0, 1, rows, None
    while True:
        high = low + step
        sizes = open_.where((F.col("depth") > low) & (F.col("depth") <= high)).groupBy(*KEY).agg(F.sum(F.col("n") - F.col("depth") + 1).alias("below"))
        big = as_table(sizes.where(F.col("below") > container).select(*KEY), "trie-burst")
        found = big if found is None else found.unionByName(big)
        last = big.where(F.col("depth") == high)
        if last.isEmpty():
            return found
        still = open_.where(F.col("depth") == high).join(last, KEY, "left_semi").select("conv_id")
        open_ = as_table(open_.where(F.col("depth") > high).join(still, "conv_id", "left_semi"), "trie-open")
        low, step = high, 2 * step


NODE = "conv_id long, depth long, k1 long, k2 long, p1 long, p2 long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, head boolean"
ROW = ["h1", "h2", "depth", "k1", "k2", "p1", "p2", "conv_id", "n", "words", "top"]


def swept(rows: np.ndarray) -> pd.DataFrame:
    """The nodes of whole containers; rows: ROW as columns, sorted by head, depth, key and conv_id."""
    h1, h2, depth, k1, k2, p1, p2, conv, n, words, top = rows
    new = np.ones(len(depth), bool)
    new[1:] = np.any(rows[:5, 1:] != rows[:5, :-1], axis=0)
    first = np.flatnonzero(new)
    size = np.diff(np.append(first, len(new)))
    place = {key: i for i, key in enumerate(zip(*(x[first].tolist() for x in (h1, h2, depth, k1, k2))))}
    parents = [place.get((a, b, d - 1, p, q), -1) for a, b, d, p, q in zip(*(x[first].tolist() for x in (h1, h2, depth, p1, p2)))]
    ids, saved = conv[first].tolist(), ((size - 1) * words[first]).tolist()
    children, leaves = [0] * len(first), [0] * len(first)
    for i in range(len(first) - 1, -1, -1):  # deeper nodes of a container come later
        if not children[i]:
            leaves[i] = 1
        if (p := parents[i]) >= 0:
            children[p] += 1
            leaves[p] += leaves[i]
            saved[p] += saved[i]
    node = np.cumsum(new) - 1
    ends: list[list[int]] = [[] for _ in first]
    for i, c in zip(node[n == depth].tolist(), conv[n == depth].tolist()):
        ends[i].append(c)
    return pd.DataFrame({
        "conv_id": ids, "depth": depth[first], "k1": k1[first], "k2": k2[first], "p1": p1[first], "p2": p2[first],
        "parent_conv_id": pd.array([ids[p] if p >= 0 else None for p in parents], "Int64"), "n_convs": size, "n_children": children, "n_leaves": leaves, "saved_tokens": saved,
        "ends_sha256": [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in ends], "head": depth[first] == top[first] + 1})


def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    held = np.zeros((len(ROW), 0), np.int64)
    for batch in batches:
        rows = np.concatenate([held, batch[ROW].to_numpy(np.int64).T], axis=1)
        if not rows.shape[1]:
            continue
        last = np.flatnonzero((rows[0] != rows[0, -1]) | (rows[1] != rows[1, -1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last container may go on in the next batch
        if cut:
            yield swept(rows[:, :cut])
        held = rows[:, cut:].copy()
    if held.shape[1]:
        yield swept(held)


def digests(ends: DataFrame) -> DataFrame:
    """KEY, ends_sha256 from KEY, conv_id."""
    runs = ends.groupBy(*KEY, F.floor(F.col("conv_id") / F.lit(RUN_OF_IDS)).alias("run")).agg(F.array_sort(F.collect_list("conv_id")).alias("ids"))
    text = F.array_join(F.transform("ids", lambda x: x.cast("string")), ",")
    # the window makes "one node, one task, in order" a requirement of the plan
    ordered = runs.select(*KEY, text.alias("ids"), F.row_number().over(Window.partitionBy(*KEY).orderBy("run")).alias("turn"))

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        here, digest = None, None
        for batch in batches:
            out = []
            for key, turn, ids in zip(zip(*(batch[k].tolist() for k in KEY)), batch["turn"], batch["ids"]):
                if turn == 1:
                    if here is not None:
                        out.append((*here, digest.hexdigest()))
                    here, digest = key, hashlib.sha256()
                else:
                    digest.update(b",")
                digest.update(ids.encode())
            yield pd.DataFrame(out, columns=[*KEY, "ends_sha256"])
        if here is not None:
            yield pd.DataFrame([(*here, digest.hexdigest())], columns=[*KEY, "ends_sha256"])

    return ordered.mapInPandas(hashed, "depth long, k1 long, k2 long, ends_sha256 string")


def summed_up(nodes: DataFrame) -> DataFrame:
    """nodes (KEY, parent, leaves, saved) with the sums over all descendants; pass k adds those between 2^k and 2^(k+1) - 1 levels below.

    parent is a struct of KEY, null for the root.
    """
    v = as_table(nodes.withColumn("key", F.struct(*KEY)).withColumn("jump", F.col("parent")), "trie-sums")
    while not v.where("jump is not null").isEmpty():
        given = v.where("jump is not null").groupBy(F.col("jump").alias("key")).agg(F.sum("leaves").alias("more_leaves"), F.sum("saved").alias("more_saved"))
        far = v.select(F.col("key").alias("jump"), F.col("jump").alias("far"))
        v = as_table(v.join(given, "key", "left").join(far, "jump", "left")
                     .withColumn("leaves", F.col("leaves") + F.coalesce("more_leaves", F.lit(0))).withColumn("saved", F.col("saved") + F.coalesce("more_saved", F.lit(0)))
                     .withColumn("jump", F.col("far")).drop("more_leaves", "more_saved", "far"), "trie-sums")
    return v.drop("key", "jump")


def key_of(depth: Column, a: Column, b: Column) -> Column:
    return F.struct(depth.alias("depth"), a.alias("k1"), b.alias("k2"))


def trie(rows: DataFrame, sized: DataFrame, container: int = CONTAINER) -> DataFrame:
    """conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256: one row for each node.

    rows: as `keyed` gives them; sized: conv_id, n, also of conversations without turns.
    """
    big = burst(rows, container)
    top = rows.join(big, KEY).groupBy("conv_id").agg(F.max("depth").alias("top"))
    tops = as_table(sized.select("conv_id").join(top, "conv_id", "left").select("conv_id", F.coalesce("top", F.lit(0)).alias("top")), "trie-tops")
    placed = rows.join(tops, "conv_id")
    heads = placed.where(F.col("depth") == F.col("top") + 1).select("conv_id", F.col("k1").alias("h1"), F.col("k2").alias("h2"))
    inside = placed.where(F.col("depth") > F.col("top")).join(heads, "conv_id")
    # the window makes "one container, one task, in order" a requirement of the plan
    order = Window.partitionBy("h1", "h2").orderBy("depth", "k1", "k2", "conv_id")
    low = as_table(inside.withColumn("turn", F.row_number().over(order)).select(*ROW, "turn").mapInPandas(sweep, NODE), "trie-nodes")

    root = sized.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs")).where("n_convs > 0").select(
        "conv_id", F.lit(0).cast("long").alias("depth"), F.lit(0).cast("long").alias("k1"), F.lit(0).cast("long").alias("k2"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        "n_convs", F.lit(0).cast("long").alias("words"))
    burst_rows = placed.where(F.col("depth") <= F.col("top"))
    high = as_table(burst_rows.groupBy(*KEY).agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("words").alias("words"), F.max("p1").alias("p1"), F.max("p2").alias("p2"))
                    .select(*root.columns).unionByName(root), "trie-burst-nodes")
    above = lambda: [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    below = (low.where("head").select(*above(), "n_leaves", "saved_tokens").unionByName(high.where("depth > 0").select(*above(), F.lit(0).alias("n_leaves"), F.lit(0).alias("saved_tokens")))
             .groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_children"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved")))
    own = high.join(below, KEY, "left").select(
        *high.columns, F.coalesce("n_children", F.lit(0)).alias("n_children"), F.when(F.col("n_children").isNull(), 1).otherwise(F.col("leaves")).cast("long").alias("leaves"),
        ((F.col("n_convs") - 1) * F.col("words") + F.coalesce("saved", F.lit(0))).alias("saved"), F.when(F.col("depth") > 0, key_of(F.col("depth") - 1, F.col("p1"), F.col("p2"))).alias("parent"))
    full = summed_up(own)
    ends = (burst_rows.where("depth = n").select(*KEY, "conv_id")
            .unionByName(sized.where("n = 0").select(*[F.lit(0).cast("long").alias(k) for k in KEY], "conv_id")))
    parents = high.select(*[F.col(k).alias(f"_{k}") for k in KEY], F.col("conv_id").alias("_parent"))
    up = (F.col("depth") - 1 == F.col("_depth")) & (F.col("p1") == F.col("_k1")) & (F.col("p2") == F.col("_k2"))
    final = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    burst_nodes = (full.join(digests(ends), KEY, "left").join(parents, up, "left")
                   .select("conv_id", "depth", F.col("_parent").alias("parent_conv_id"), "n_convs", "n_children", F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
                           F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))
    head_nodes = low.where("head").join(parents, up).withColumn("parent_conv_id", F.col("_parent")).select(*final)
    return burst_nodes.select(*final).unionByName(head_nodes).unionByName(low.where("not head").select(*final))


def shared_starts_trie(conversations: DataFrame, container: int = CONTAINER) -> DataFrame:
    """The trie of conversations that took their first turns from the first of their family."""
    sized, rows = with_shared_starts(as_table(turns_of(conversations), "trie-turns"))
    return trie(as_table(keyed(rows, sized), "trie-rows"), sized, container)
