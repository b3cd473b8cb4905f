"""Exact top-k search by inner product with MaxScore pruning.

A vector's terms are its dimensions. Each dimension has a posting list per shard; a query weighs it by its own component.
Components may be negative, so contributions are measured from the least one that the shard's list can give to the query:
they are then at least 0, and a constant per query and shard is added back at the end. For each query and shard the terms
are ordered by their upper bounds. With the threshold set to the k-th best score known so far, the longest run of terms
with the least bounds whose bounds stay below it in sum is non-essential: a vector that only scores there cannot enter.
Essential postings are traversed; then the non-essential terms are probed, largest bound first, only for vectors whose
score so far plus the bounds still open can reach the threshold. Shards' best lists are merged by a ranked window.

Scores are whole numbers of components floor(64 * x). Pruning is by bound alone, so the result is exact, and ties go to the
smaller vec_id.

Scale: the table is cut into shards of `shard` rows; the stated queries travel to each shard in blocks of `query_block`
(a query set against all rows, by its contract). A task holds one shard and one block of queries.

Defined results: vectors that are null, or hold a null, NaN or infinite component, take no part; shorter vectors count as
padded with 0; rows without vec_id take no part; an empty vector scores 0. Repeated rows are candidates each for itself,
except for a query with their vec_id, and each repeated query row is answered. Components are exact up to 2^52 / 64, and
scores as long as their sum of magnitudes stays below 2^53; beyond that the task fails rather than round. Further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.llm.common import pieces_for
from cuegrid.plans.store import as_table

SCALE = 64


def usable(vector: Column) -> Column:
    d = lambda x: x.cast("double")
    return vector.isNotNull() & F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(d(x)) & (F.abs(d(x)) < F.lit(float("inf")))), F.lit(False))


def matrix(vectors: list, width: int) -> np.ndarray:
    out = np.zeros((len(vectors), width))
    for i, v in enumerate(vectors):
        out[i, :len(v)] = v
    return out


def best_of_shard(ids: np.ndarray, rows: np.ndarray, query_ids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query position, vec_id, score) of the k best of the shard for each query."""
    if np.abs(queries).sum(axis=1).max(initial=0) * np.abs(rows).max(initial=0) >= 2.0 ** 53:
        raise OverflowError("scores beyond 2^53 cannot be exact")
    order = np.argsort(ids, kind="stable")
    ids, rows = ids[order], rows[order]
    low, high = rows.min(axis=0), rows.max(axis=0)
    postings = np.ascontiguousarray(rows.T)
    out_q, out_i, out_s = [], [], []
    # a first threshold: the k-th best of the first rows
    head = min(len(ids), max(4 * k, 256))
    first = queries @ rows[:head].T
    for q in range(len(queries)):
        w = queries[q]
        least = np.minimum(w * low, w * high)
        bound = np.maximum(w * low, w * high) - least
        base = least.sum()
        own = ids == query_ids[q]
        known = np.sort(first[q][~own[:head]])
        threshold = (known[-k] if len(known) >= k else -np.inf) - base
        terms = np.argsort(-bound, kind="stable")
        rest = np.append(np.cumsum(bound[terms][::-1])[::-1], 0.0)  # bounds of terms[i:] in sum
        # non-essential: the run of last terms whose bounds in sum stay below the threshold
        n_essential = int(np.searchsorted(-rest, -threshold, side="left")) if np.isfinite(threshold) else len(terms)
        n_essential = min(max(n_essential, 0), len(terms))
        essential = terms[:n_essential]
        score = w[essential] @ postings[essential] - least[essential].sum() if len(essential) else np.zeros(len(ids))
        alive = np.flatnonzero((score + rest[n_essential] >= threshold) & ~own)
        score = score[alive]
        step = n_essential
        while step < len(terms) and len(alive):
            part = terms[step:step + 4]
            score = score + w[part] @ postings[np.ix_(part, alive)] - least[part].sum()
            step += len(part)
            if len(alive) > k:
                threshold = max(threshold, np.partition(score, -k)[-k])  # what is still open can only add
            keep = score + rest[step] >= threshold
            alive, score = alive[keep], score[keep]
        best = np.argsort(-score, kind="stable")[:k]  # alive is in order of vec_id
        out_q.append(np.full(len(best), q))
        out_i.append(ids[alive[best]])
        out_s.append(score[best] + base)
    return tuple(np.concatenate(x) if x else np.zeros(0) for x in (out_q, out_i, out_s))


def top_k(table: DataFrame, k: int = 20, every: int = 20, shard: int = 8_192, query_block: int = 512) -> DataFrame:
    """query_id, rank, vec_id, score: the k best other rows for each row whose vec_id is divisible by `every`."""
    quantised = F.transform("embedding", lambda x: F.floor(x.cast("double") * F.lit(float(SCALE))).cast("double"))
    rows = as_table(table.where(F.col("vec_id").isNotNull() & usable(F.col("embedding"))).select(F.col("vec_id").cast("long"), quantised.alias("v")), "maxscore-rows")
    count, width = rows.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("v")), F.lit(0))).first()
    shards = pieces_for(count, shard)
    n_queries = rows.where(F.col("vec_id") % every == 0).count()
    blocks = pieces_for(n_queries, query_block)
    of_shard = F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int")
    candidates = rows.select(of_shard.alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), "vec_id", "v", F.lit(False).alias("asks"))
    queries = (rows.where(F.col("vec_id") % every == 0)
               .select(F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"), F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), "vec_id", "v", F.lit(True).alias("asks")))

    def search(group: pd.DataFrame) -> pd.DataFrame:
        asks = group["asks"].to_numpy()
        own, q = group[~asks], group[asks]
        if not len(own) or not len(q):
            return pd.DataFrame({"query_id": [], "copy": [], "vec_id": [], "score": []}).astype("int64")
        q_ids = q["vec_id"].to_numpy()
        at, ids, scores = best_of_shard(own["vec_id"].to_numpy(), matrix(list(own["v"]), width), q_ids, matrix(list(q["v"]), width), k)
        at = at.astype(np.int64)
        return pd.DataFrame({"query_id": q_ids[at], "copy": q.groupby("vec_id").cumcount().to_numpy()[at], "vec_id": ids.astype(np.int64), "score": scores.astype(np.int64)})

    found = candidates.unionByName(queries).groupBy("shard", "block").applyInPandas(search, "query_id long, copy long, vec_id long, score long")
    ranked = Window.partitionBy("query_id", "copy").orderBy(F.col("score").desc(), "vec_id")
    return found.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
