"""Chunked scans and folds against plain loops, with chunks far smaller than the data."""

import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuegrid.operators import sequence
from cuegrid.plans import carry
from cuegrid.plans.scan import Run, Sequence, islands, neighbours, numbered, running

SCHEMA = "k long, o long, v long, t string"


def rows(seed, n=160):
    rng = random.Random(seed)
    # One key holds most rows; orders have gaps and start below zero.
    out, used = [], set()
    for _ in range(n):
        k = 1 if rng.random() < 0.6 else rng.randint(2, 6)
        o = rng.randint(-40, 200)
        if (k, o) not in used:
            used.add((k, o))
            out.append((k, o, rng.choice([None, *range(-9, 10)]), rng.choice([None, "a", "b"])))
    return out


def by_key(data):
    keys = {}
    for r in sorted(data, key=lambda r: (r[0], r[1])):
        keys.setdefault(r[0], []).append(r)
    return keys


@pytest.mark.parametrize("width", [1, 7, 64, 100_000])
def test_neighbours_running_and_islands(spark, width):
    data = rows(width)
    df = spark.createDataFrame(data, SCHEMA)
    seq = Sequence(("k",), ("o",), width)
    runs = {
        "total": Run("sum", F.col("v")), "total_before": Run("sum", F.col("v"), exclusive=True), "top": Run("max", F.col("v")),
        "low_before": Run("min", F.col("v"), exclusive=True), "first_t": Run("first", F.col("t")), "last_t": Run("last", F.col("t")),
        "next_t": Run("last", F.col("t"), backward=True), "rest": Run("sum", F.col("v"), backward=True),
    }
    near = {(r.k, r.o): r for r in neighbours(df, seq, prev={"pv": F.col("v"), "pt": F.col("t")}, next={"nv": F.col("v")}).collect()}
    run = {(r.k, r.o): r for r in running(df, seq, runs).collect()}
    isl = {(r.k, r.o): r for r in islands(df, seq, {"t": F.col("t"), "o": F.col("o")}, lambda p, c: (p("t") != c("t")) | (c("o") - p("o") > 5), "i", "s").collect()}
    num = {(r.k, r.o): r.n for r in numbered(df, seq, "n").collect()}
    assert len(near) == len(run) == len(isl) == len(data)
    for key, rs in by_key(data).items():
        island = 0
        for i, r in enumerate(rs):
            at = (key, r[1])
            assert (near[at].pv, near[at].pt) == ((rs[i - 1][2], rs[i - 1][3]) if i else (None, None))
            assert near[at].nv == (rs[i + 1][2] if i + 1 < len(rs) else None)
            upto, before, after = [x[2] for x in rs[:i + 1] if x[2] is not None], [x[2] for x in rs[:i] if x[2] is not None], [x[2] for x in rs[i:] if x[2] is not None]
            tags, later = [x[3] for x in rs[:i + 1] if x[3]], [x[3] for x in rs[i:] if x[3]]
            q = run[at]
            assert (q.total, q.total_before, q.rest) == (sum(upto), sum(before), sum(after))
            assert (q.top, q.low_before) == (max(upto, default=None), min(before, default=None))
            assert (q.first_t, q.last_t, q.next_t) == ((tags or [None])[0], (tags or [None])[-1], (later or [None])[0])
            opens = i == 0 or (rs[i - 1][3] is not None and r[3] is not None and rs[i - 1][3] != r[3]) or r[1] - rs[i - 1][1] > 5
            island += opens
            assert (isl[at].i, isl[at].s) == (island, int(opens))
            assert num[at] == i + 1


def sum_step():
    """Groups of values that add up to at most 20: depends on the whole open group."""
    def step(state, row):
        order, value = row
        if state is not None and state[0][1] + value > 20:
            state = None
        head, total = state[0] if state is not None else (order, 0)
        return [[head, total + value]], (head, total + value)
    return step


@pytest.mark.parametrize("width", [2, 17, 100_000])
def test_carry_fold_matches_one_pass(spark, width):
    rng = random.Random(width)
    data = [(1 if rng.random() < 0.7 else rng.randint(2, 4), o, rng.randint(0, 12)) for o in range(220)]
    df = spark.createDataFrame(data, "k long, o long, v long")
    out = T.StructType([T.StructField("head", T.LongType()), T.StructField("total", T.LongType())])
    got = {(r.k, r.o): (r.head, r.total) for r in carry.carry_fold(df, Sequence(("k",), ("o",), width), ["o", "v"], sum_step(), out).collect()}
    want, step = {}, sum_step()
    for key in {d[0] for d in data}:
        state = None
        for _, o, v in sorted(d for d in data if d[0] == key):
            state, want[(key, o)] = step(state, (o, v))
    assert got == want


def test_carry_fold_without_any_break_hands_state_through_every_chunk(spark):
    """A group that never closes: each chunk needs the end of the one before."""
    data = [(1, o, 0) for o in range(60)]
    out = T.StructType([T.StructField("head", T.LongType()), T.StructField("total", T.LongType())])
    df = spark.createDataFrame(data, "k long, o long, v long")
    got = carry.carry_fold(df, Sequence(("k",), ("o",), 10), ["o", "v"], sum_step(), out).collect()
    assert {r.head for r in got} == {0} and len(got) == 60


@pytest.mark.parametrize("chunks", [4, 64])
def test_an_open_group_takes_the_same_rounds_over_any_number_of_chunks(spark, chunks, monkeypatch):
    """The label of the open group is found by doubling, not handed from chunk to chunk."""
    data = [(k, o, 0) for k in (1, 2) for o in range(3, 10 * chunks)]
    out = T.StructType([T.StructField("head", T.LongType()), T.StructField("total", T.LongType())])
    rounds, ends = [], carry._ends
    monkeypatch.setattr(carry, "_ends", lambda *a: rounds.append(1) or ends(*a))
    got = carry.carry_fold(spark.createDataFrame(data, "k long, o long, v long"), Sequence(("k",), ("o",), 10), ["o", "v"], sum_step(), out).collect()
    assert {(r.k, r.head) for r in got} == {(1, 3), (2, 3)} and len(got) == len(data) and len(rounds) == 2


def test_long_tracks_keep_their_first_box_over_many_chunks(spark, monkeypatch):
    """Two tracks through all chunks, one that begins and ends midway, and one that crosses a silent chunk's border."""
    from cuegrid.operators import regions as R
    boxes = [(7, t * 250, 10 * t + k, 300, y, 400, 40, 90) for t in range(320) for k, y in enumerate((560, 640)) if not (k and 100 <= t < 104)]
    boxes += [(7, t * 250, 10 * t + 5, 300, 100, 300, 40, 90) for t in range(40, 90)]
    df = spark.createDataFrame(boxes, "media_id long, ts_ms long, seq long, x long, y long, w long, h long, score_pct long")
    rounds, ends = [], carry._ends
    monkeypatch.setattr(carry, "_ends", lambda *a: rounds.append(1) or ends(*a))
    got = {(r.seq, r.track_id) for r in R.box_tracks(df, 250, 1280, 720, 1_250).collect()}
    step, state, want = R._track_step(250, 1280, 720), None, set()
    for _, ts, seq, *box, _ in sorted(boxes):
        state, (track,) = step(state, (ts, seq, *box))
        want.add((seq, track))
    assert got == want and {t for _, t in want} == {0, 1, 405, 1041} and len(rounds) <= 3


@pytest.mark.parametrize("width", [1, 9, 100_000])
def test_paced_matches_loop(spark, width):
    from cuegrid.plans.scan import paced
    data = [(k, o, v or 0, t) for k, o, v, t in rows(width + 50)]
    df = spark.createDataFrame(data, SCHEMA)
    got = {(r.k, r.o): r for r in paced(df, Sequence(("k",), ("o",), width), F.abs("v"), F.col("o"), "max", "p", "r", "b").collect()}
    for key, rs in by_key(data).items():
        total, best = 0, None
        for r in rs:
            q = got[(key, r[1])]
            assert q.p == total and q.b == best
            best = max(x for x in (best, r[1] - total) if x is not None)
            assert q.r == best
            total += abs(r[2])


def test_carry_fold_keeps_chunks_whole_when_joins_turn_into_broadcasts(spark):
    """Planned as sort-merge, switched to broadcast at run time: chunks must not be torn."""
    data = [(k, o, (k + o) % 7) for k in range(40) for o in range(60)]
    df = spark.createDataFrame(data, "k long, o long, v long").repartition(8)
    out = T.StructType([T.StructField("head", T.LongType()), T.StructField("total", T.LongType())])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "10MB")
    try:
        got = {(r.k, r.o): (r.head, r.total) for r in carry.carry_fold(df, Sequence(("k",), ("o",), 25), ["o", "v"], sum_step(), out).collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    want, step = {}, sum_step()
    for key in range(40):
        state = None
        for _, o, v in sorted(d for d in data if d[0] == key):
            state, want[(key, o)] = step(state, (o, v))
    assert got == want


def test_runs_of_speaker_flips_need_no_group_for_each_word(spark):
    """Candidates at 2, 3, 4 and 8: of a run the 1st and 3rd are overwritten, across chunks of 3 words as well."""
    said = [None, "a", "b", "a", "b", "a", "a", "a", "c", "a"]
    words = spark.createDataFrame([(7, p, 1000 * p, 1000 * p + 100, s) for p, s in enumerate(said) if p], "media_id long, pos long, start_ms long, end_ms long, speaker string")
    fixed = sequence.smooth_speaker_flips(words, Sequence(("media_id",), ("pos",), 3))
    assert [r[0] for r in fixed.orderBy("pos").select("speaker_fixed").collect()] == ["a", "a", "a", "a", "a", "a", "a", "a", "a"]
    assert "_run" not in fixed._jdf.queryExecution().optimizedPlan().toString()
