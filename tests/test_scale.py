"""Results must not depend on chunk width, on partition counts or on one key holding most rows."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrid.operators import folds as G
from cuegrid.operators import regions as R
from cuegrid.operators import sequence as S
from cuegrid.operators import tracks as T
from cuegrid.plans.overlap import overlap_pairs
from cuegrid.plans.scan import Sequence, ranked_by
from cuegrid.plans.store import shared_dir
from cuegrid.workload import views

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, (tuple(r) for r in df.select(*sorted(df.columns)).collect())))


@pytest.fixture(scope="module")
def long_media(spark):
    """All media of the smallest tables strung together into one, plus one as it was."""
    c = views.marked(spark, SF)
    one = c.select(F.lit(1).cast("long").alias("media_id"), (F.col("media_id") * 1000 + F.col("cue_id")).alias("cue_id"),
                   (F.col("media_id") * 10_000_000 + F.col("start_ms")).alias("start_ms"), (F.col("media_id") * 10_000_000 + F.col("end_ms")).alias("end_ms"),
                   "speaker", "content", "source")
    return one.unionByName(c.where("media_id = 2").select(*one.columns)).cache()


def cue_sequence(width):
    return Sequence(("media_id",), ("cue_id",), width)


OPERATORS = {
    "fragments": lambda c, w: S.repair_fragment_speakers(c, cue_sequence(w)),
    "scenes": lambda c, w: S.scene_ids(c, cue_sequence(w)),
    "sentences": lambda c, w: S.sentence_utterances(c, cue_sequence(w)),
    "hard": lambda c, w: S.hard_breaks(c, cue_sequence(w)),
    "merged": lambda c, w: S.merge_intervals(c, cue_sequence(w)),
    "repeats": lambda c, w: S.adjacent_repetitions(c, cue_sequence(w)),
    "context": lambda c, w: T.translation_context(c, seq=cue_sequence(w)),
    "units": lambda c, w: G.dialogue_units(c, cue_sequence(w)),
    "utterances": lambda c, w: G.build_utterances(c, cue_sequence(w)),
    "spaced": lambda c, w: S.separate_spans(c, width_ms=w * 3000),
    "fonts": lambda c, w: S.limit_font_steps(c.withColumn("want", 18 + F.col("cue_id") * 37 % 17), "want", cue_sequence(w)),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_chunk_width_changes_nothing(long_media, name):
    run = OPERATORS[name]
    assert rows(run(long_media, 23)) == rows(run(long_media, 10**9))


def test_shuffle_partitions_change_nothing(spark, long_media):
    want = rows(S.sentence_utterances(long_media, cue_sequence(50)))
    old = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "13"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            assert rows(S.sentence_utterances(long_media, cue_sequence(50))) == want
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def spans(seed, n, key=lambda rng: 1 if rng.random() < 0.7 else rng.randint(2, 4)):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        a = rng.randint(-3000, 20_000)
        out.append((key(rng), i, a, a + rng.choice([0, rng.randint(1, 400), rng.randint(1, 9000)])))
    return out


def shared(a, b):
    return min(a[3], b[3]) - max(a[2], b[2])


def test_overlap_pairs_against_brute_force(spark):
    left, right = spans(1, 120), spans(2, 120)
    l = spark.createDataFrame(left, "media_id long, a long, s long, e long")
    r = spark.createDataFrame(right, "media_id long, b long, rs long, re long")
    want = sorted((x[1], y[1]) for x in left for y in right if x[0] == y[0] and x[3] > x[2] and y[3] > y[2] and shared(x, y) > 0)
    for width in (50, 1000, 60_000):
        got = overlap_pairs(l, r, "media_id", "s", "e", "rs", "re", width)
        assert sorted((x.a, x.b) for x in got.select("a", "b").collect()) == want


def test_regions_of_cues_against_brute_force(spark):
    cues = [(m, i, a, max(a + 1, b)) for m, i, a, b in spans(3, 90)]
    regs = [(m, i, a, max(a + 1, b)) for m, i, a, b in spans(4, 40)]
    regs += [(m, i + 1000, a, b) for m, i, a, b in regs[:15]]  # copies with the same times
    c = spark.createDataFrame(cues, "media_id long, cue_id long, start_ms long, end_ms long")
    r = spark.createDataFrame([(*x, x[1] * 10) for x in regs], "media_id long, region_id long, region_start long, region_end long, width long")
    best, widths, totals, active = {}, {}, {}, set()
    for x in cues:
        mine = sorted((y for y in regs if y[0] == x[0]), key=lambda y: y[1])
        if not mine:
            continue
        over = lambda y: max(0, shared(x, y))
        mid = (x[2] + x[3]) / 2
        best[x[1]] = max(mine, key=lambda y: (over(y), -min(abs(mid - y[2]), abs(mid - y[3]))))[1]
        widths[x[1]] = max(mine, key=over)[1] * 10
        totals[x[1]] = sum(map(over, mine))
        if totals[x[1]]:
            active.add(x[1])
    got = T.cue_region(c, r).collect()
    assert {g.cue_id: g.region_id for g in got} == best and {g.cue_id: g.visual_overlap_ms for g in got} == totals
    assert {g.cue_id: g.box_width for g in T.cue_box_width(c, r).collect()} == widths
    assert {g.cue_id for g in T.active_cues(c, r, 2000).collect()} == active


def track_loop(boxes, step, width, height):
    """Plain restatement of the tracking rule over one medium."""
    tracks, out = [], {}
    for ts, seq, x, y, w, h in sorted(boxes):
        found = None
        for t in tracks:
            pts, _, px, py, pw, ph = t[-1]
            dy, dx = abs(y + h / 2 - py - ph / 2), abs(x + w / 2 - px - pw / 2)
            if ts - pts <= 2.2 * step and dy <= max(0.045 * height, 0.8 * min(h, ph)) and dx <= max(0.12 * width, 0.45 * min(w, pw)) and (found is None or dy < found[0]):
                found = (dy, t)
        if found is None:
            tracks.append([(ts, seq, x, y, w, h)])
            out[seq] = seq
        else:
            found[1].append((ts, seq, x, y, w, h))
            out[seq] = found[1][0][1]
    return out


@pytest.mark.parametrize("width_ms", [1500, 10**9])
def test_tracks_against_brute_force(spark, width_ms):
    rng = random.Random(9)
    data = [(1 if rng.random() < 0.7 else 2, 250 * rng.randint(0, 60) + (5000 if i > 150 else 0), i, rng.randint(100, 700), rng.randint(300, 650), rng.randint(50, 500), rng.randint(20, 60), 80) for i in range(220)]
    df = spark.createDataFrame(data, "media_id long, ts_ms long, seq long, x long, y long, w long, h long, score_pct long")
    got = {r.seq: r.track_id for r in R.box_tracks(df, 250, 1280, 720, width_ms).collect()}
    want = {}
    for m in (1, 2):
        want.update(track_loop([d[1:7] for d in data if d[0] == m], 250, 1280, 720))
    assert got == want


def test_source_regions_fall_back_per_medium(spark):
    boxes = spark.createDataFrame([(1, 250 * i, i, 400, 600, 300, 40, 90) for i in range(8)], "media_id long, ts_ms long, seq long, x long, y long, w long, h long, score_pct long")
    cues = spark.createDataFrame([(1, 1, 0, 2000), (2, 1, 1000, 2000), (2, 2, 2300, 3000)], "media_id long, cue_id long, start_ms long, end_ms long")
    got = {r.media_id: r for r in R.source_regions(boxes, cues, 250, 1280, 720).collect()}
    assert (got[1].method, got[1].x, got[1].width, got[1].confidence) == ("visual_tracks_v2", 376, 348, 0.945)
    assert (got[2].method, got[2].y, got[2].height, got[2].confidence, got[2].start_ms, got[2].end_ms) == ("lower_band_fallback", 547, 101, 0.25, 880, 3180)


def test_ranked_by_splits_a_hot_key(spark):
    data = [(1 if i % 3 else 2, f"n{i * 7919 % 500:03d}", i) for i in range(500)]
    df = spark.createDataFrame(data, "k long, name string, i long").repartition(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {r.i: r["rank"] for r in ranked_by(df, ("k",), [F.col("name"), F.col("i")], "rank").collect()}
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    for k in (1, 2):
        for n, (_, _, i) in enumerate(sorted(d for d in data if d[0] == k), 1):
            assert got[i] == n


class Named:
    """A session as shared_dir sees it."""

    def __init__(self, master, named=None):
        self.master, self.named, self.chosen = master, named, None
        self.conf = self.sparkContext = self._jsc = self

    def get(self, _key, default=None):
        return self.named

    def getConf(self):
        return self

    def sc(self):
        return self

    def getCheckpointDir(self):
        return self

    def isDefined(self):
        return self.chosen is not None

    def setCheckpointDir(self, path):
        self.chosen = path


def test_shared_dir_follows_the_session_and_never_invents_one_on_a_cluster(spark):
    named = Named("spark://host:7077", "hdfs://shared/cp")
    assert shared_dir(named) == "hdfs://shared/cp" and named.chosen == "hdfs://shared/cp"
    with pytest.raises(ValueError):
        shared_dir(Named("spark://host:7077"))
    assert shared_dir(spark) == shared_dir(spark)


def test_speech_joins_in_the_fold_equal_the_column_function(spark):
    """Blank parts, parts of marks alone and Unicode blanks, joined one after another."""
    import random

    from pyspark.sql import functions as F

    from cuegrid.functions import text as X
    from cuegrid.operators import folds
    rng = random.Random(7)
    pick = lambda: "".join(rng.choice(["a", "bc", " ", ".", "...", "?", ",", "\u3000", "\u00a0", "", "。", "!"]) for _ in range(rng.randint(0, 5)))
    rows = [(k, pick(), pick(), rng.choice(["话。", "话，", "话", "", " 话！ ", "a,", None])) for k in range(400)]
    df = spark.createDataFrame(rows, "k long, l string, r string, s string")
    for row in df.select("l", "r", "s", X.join_spoken(F.col("l"), F.col("r"), F.coalesce("s", F.lit(""))).alias("t")).collect():
        assert folds._spoken_join(row["l"], row["r"], row["s"] or "") == row["t"]
