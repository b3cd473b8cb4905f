"""The dubbing timeline: one pass over the lines, whatever the chunks."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cuegrid.operators import sequence as S
from cuegrid.plans.scan import Sequence
from cuegrid.workload import views

SF = "/root/testdata/sf0.001"


def shuffled(spark) -> int:
    """Rows written to shuffles by the session so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteRecords() for i in range(stages.size()))


def test_aligned_lines_move_once_as_lines_and_once_as_sentences(spark):
    """Rows moved a line: the lines to their chunks and phrases, the sentences to the schedule (10.8 rows before, 1.6 since)."""
    n = views.marked(spark, SF).count()
    before = shuffled(spark)
    assert entry.queries()["aligned_lines"](spark, SF).count() == n
    moved = (shuffled(spark) - before) / n
    assert moved < 5


@pytest.fixture(scope="module")
def lines(spark):
    """Two media, one whole phrase of many lines, a null speaker, a blank and a missing text, an overlap, a long pause."""
    rows = [(7, i, 1_000 * i, 1_000 * i + 900, "user", "on and on, still") for i in range(1, 40)]
    rows += [(7, 41, 42_000, 43_000, None, " the end. "), (7, 43, 43_100, 43_050, "user", " "), (7, 44, 43_020, 50_000, "other", "12 km!"), (7, 45, 60_000, 61_000, "other", None)]
    rows += [(8, 5, 0, 10, "", "…")]
    return spark.createDataFrame(rows, "media_id long, cue_id long, start_ms long, end_ms long, speaker string, content string")


@pytest.mark.parametrize("width", [1, 3, 7, 16_384])
def test_timed_sentences_are_those_of_the_separate_steps(spark, lines, width):
    end = lines.groupBy("media_id").agg((F.max("end_ms") + 1500).alias("media_end_ms"))
    seq = Sequence(("media_id",), ("cue_id",), width)
    got = S.planned(S.timed_sentences(lines, end, seq), F.col("content"))
    phrases = S.phrase_ids(lines)
    want = S.speech_plans(S.sentences_of(phrases), F.col("content"), end).join(S.phrase_gaps(phrases).drop("phrase"), ["media_id", "utterance_id"])
    columns = [c for c in want.columns if c in got.columns]
    assert set(want.columns) == set(columns) == set(got.columns) - {"line_shares"}
    rows = sorted(map(str, want.select(columns).collect()))
    assert sorted(map(str, got.select(columns).collect())) == rows and len(rows) == 6


@pytest.mark.parametrize("width", [1, 16_384])
def test_lines_timed_by_shares_are_those_looked_up(spark, lines, width):
    end = lines.groupBy("media_id").agg(F.max("end_ms").alias("media_end_ms"))
    s = S.timed_sentences(lines, end, Sequence(("media_id",), ("cue_id",), width)).withColumns(
        {"scheduled_start_ms": 10 * F.col("start_ms"), "fitted_ms": F.when(F.col("phrase") == 1, 12_345).otherwise(0).cast("long")})
    columns = ["media_id", "cue_id", "aligned_start_ms", "aligned_end_ms"]
    got = S.retime_shares(s).select(columns)
    spoken = s.select("media_id", "phrase", "scheduled_start_ms", "fitted_ms", F.explode("cue_ids").alias("cue_id"))
    want = S.retime(lines.select("media_id", "cue_id", "content").join(spoken, ["media_id", "cue_id"])).select(columns)
    assert sorted(got.collect()) == sorted(want.collect()) and got.count() == 44
