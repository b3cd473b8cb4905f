"""Streams against plain loops: late samples, last lines, replays, and state that does not grow with history."""

import random

import pytest
from pyspark.sql import functions as F

from cuegrid.streaming import state as St


def source(spark, tmp_path, slices, schema):
    path = str(tmp_path / "in")
    for rows in slices:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


SAMPLES = "media_id long, seq long, ts_ms long, text string, score_pct long"


def test_sessions_hand_out_late_samples_and_last_lines(spark, tmp_path):
    slices = [
        [(1, 1, 0, "a", 10), (1, 2, 400, "a", 20), (2, 3, 0, "x", 5)],
        [(1, 4, 800, "a", 30), (1, 5, 1200, "b", 40), (2, 6, 400, None, 5)],
        [(1, 7, 600, "late", 50), (1, 8, 1600, "b", 60), (3, 9, 90_000, "z", 1)],
        [(1, 10, 1700, "b", 70), (3, 11, 90_400, "z", 2)],
    ]
    done, late = St.stream_sessions(source(spark, tmp_path, slices, SAMPLES), str(tmp_path / "out"), str(tmp_path / "cp"))
    assert sorted(map(tuple, late.collect())) == [(1, 600, "late", 50)]
    got = sorted(map(tuple, done.collect()), key=repr)
    # the clock of medium 3 closes the line of medium 1 before its last sample, which then opens one of its own
    assert got == sorted([(1, "a", 0, 1100, 60, 3), (1, "b", 900, 1900, 100, 2), (1, "b", 1400, 2000, 70, 1), (2, "x", 0, 300, 5, 1), (2, None, 100, 700, 5, 1), (3, "z", 89_700, 90_700, 3, 2)], key=repr)


def test_open_lines_can_be_left_open(spark, tmp_path):
    stream = source(spark, tmp_path, [[(1, 1, 0, "a", 10)], [(1, 2, 400, "b", 20)]], SAMPLES)
    done, _ = St.stream_sessions(stream, str(tmp_path / "out"), str(tmp_path / "cp"), ends=False)
    assert list(map(tuple, done.collect())) == [(1, "a", 0, 300, 10, 1)]


def test_a_bucket_table_reads_and_keeps_what_it_touches(spark, tmp_path):
    table = St.BucketTable(spark, str(tmp_path / "t"), ("k",), 4)
    rng, want = random.Random(1), {}
    for batch in range(6):
        rows = [(rng.randint(0, 40), batch, rng.randint(0, 9)) for _ in range(5)]
        rows = list({r[0]: r for r in rows}.values())
        want.update({r[0]: r for r in rows})
        changes = spark.createDataFrame(rows, "k long, at long, v long")
        touched = table.update(batch, changes, F.col("at"), ("k",))
        assert {r["k"] for r in touched.collect()} >= {r[0] for r in rows}
        assert {r["k"]: (r["k"], r["at"], r["v"]) for r in table.current().collect()} == want
    again = table.update(5, changes, F.col("at"), ("k",))  # a replay
    assert {r["k"]: (r["k"], r["at"], r["v"]) for r in table.current().collect()} == want and again.count() >= 1
    versions = St._batches(spark, f"{tmp_path}/t/rows")
    assert set(versions) <= set(table.index().values()) | set(table.index(before=5).values()) and len(St._batches(spark, f"{tmp_path}/t/index")) == 2


@pytest.mark.parametrize("history", [3, 12])
def test_a_micro_batch_reads_no_more_with_more_history(spark, tmp_path, history, monkeypatch):
    table, read = St.BucketTable(spark, str(tmp_path / "t"), ("k",), 8), []
    for batch in range(history):
        table.update(batch, spark.createDataFrame([(batch % 3, batch)], "k long, at long"), F.col("at"), ("k",))
    rows = St.BucketTable.rows
    monkeypatch.setattr(St.BucketTable, "rows", lambda self, index: read.append(len(index)) or rows(self, index))
    table.update(history, spark.createDataFrame([(0, history)], "k long, at long"), F.col("at"), ("k",))
    assert read == [1, 1]  # the bucket as it was, and as it became


def test_changes_are_worked_out_once(spark, tmp_path):
    seen = spark.sparkContext.accumulator(0)
    count = F.udf(lambda x: seen.add(1) or x, "long").asNondeterministic()
    table = St.BucketTable(spark, str(tmp_path / "t"), ("k",), 4)
    table.update(0, spark.range(50).select(count("id").alias("k"), F.lit(0).alias("at")), F.col("at"), ("k",))
    assert seen.value == 50 and table.current().count() == 50


def test_totals_are_the_only_state(spark, tmp_path):
    schema = "media_id long, provider string, model string, prompt long, completion long, hit long, miss long, total long"
    slices = [[(1, "p", "m", 1, 2, 3, 4, 5), (2, "p", "m", 1, 1, 1, 1, 1)], [(1, "p", "m", 10, 20, 30, 40, 50), (1, None, "m", 7, 7, 7, 7, None)]]
    found = St.stream_usage(source(spark, tmp_path, slices, schema), str(tmp_path / "out"), str(tmp_path / "cp"), 4)
    assert sorted(map(tuple, found.drop("bucket").select("media_id", "provider", "model", "requests", "prompt", "completion", "hit", "miss", "total").collect()), key=repr) == sorted(
        [(1, "p", "m", 2, 11, 22, 33, 44, 55), (1, None, "m", 1, 7, 7, 7, 7, None), (2, "p", "m", 1, 1, 1, 1, 1, 1)], key=repr)
    assert not (tmp_path / "cp" / "state").exists()
