"""Queries against their check SQL on small tables that once gave other rows."""

import unicodedata
from collections import Counter
from datetime import datetime

import duckdb
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cuegrid.functions import text as X
from cuegrid.llm import pii
from cuegrid.operators import catalog
from cuegrid.sources import reports, srt
from tests.test_checks import norm


@pytest.fixture
def same(spark, tmp_path):
    """Rows of a query on the given tables, after a comparison with its check SQL."""
    def run(name, **tables):
        con = duckdb.connect()
        con.execute("set timezone='UTC'")
        for table, (rows, schema) in tables.items():
            path = str(tmp_path / f"{table}.parquet")
            spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(path)
            con.execute(f"create view {table} as select * from '{path}/*.parquet'")
        df = entry.queries()[name](spark, str(tmp_path))
        cols = sorted(df.columns)
        got = Counter(tuple(norm(r[c]) for c in cols) for r in df.collect())
        cur = con.execute(entry.oracle_sql()[name])
        names = [d[0] for d in cur.description]
        assert sorted(names) == cols
        assert got == Counter(tuple(norm(r[names.index(c)]) for c in cols) for r in cur.fetchall())
        return got
    return run


TURNS = "conv_id long, turn int, role string, text string"


def test_provider_rounds_ask_for_the_cues(same):
    """31 cues: a batch of 30 is answered at once, a batch of one is asked twice; generated lines have no part in it."""
    turns = [(4, t, "user", "one two three four five six") for t in range(31)]
    assert same("provider_rounds", conversations=(turns, TURNS)) == {(1, 0, 4, "ok"): 1, (2, 1, 4, "ok"): 1}


def test_long_words_of_cues_keep_their_time(same):
    """A lone word of 19 characters lasts 1205 ms; the SQL of group_words does not cut it to 1200."""
    assert same("group_words", conversations=([(4, 0, "user", "abcdefghijklmnopqrs"), (4, 1, "user", "next")], TURNS))


EVENTS = "event_id long, user_id long, event_type string, ts timestamp_ntz, value double"


def test_overlapping_tracks_gives_pairs(same):
    day = lambda s: datetime(2024, 1, 1, 0, 0, s)
    events = [(1, 7, "click", day(0), 100.0), (2, 7, "view", day(1), 90.0), (3, 7, "view", day(2), 0.0), (4, 7, "click", day(3), 0.5), (5, 8, "view", day(0), 1.0), (6, 7, "error", day(0), 9.0)]
    assert same("overlapping_tracks", events=(events, EVENTS)) == {(1, 2, 7, 27_000_000): 1, (4, 2, 7, 150_000): 1}


def test_personal_data_examples_count_every_text(spark):
    """No text is left out of the training of op2: 3,000 equal candidates count at least 3,000 times."""
    docs = spark.range(3_000).selectExpr("id as doc_id", "'write to a@b.co' as text")
    kept = pii._examples(docs).where((F.col("kind") == 0) & (F.col("x")[1] == 6)).agg(F.sum("n")).first()[0]
    assert 3_000 <= kept <= 4_000  # about a fourth come again beside a generated case, whose own addresses are longer


def test_balanced_lines_split_a_text_once(spark):
    """The words of a text are split once, not once for each use and line."""
    lines = spark.createDataFrame([("a b", 2)], "t string, n long").select(X.balanced_lines(F.col("t"), F.col("n")).alias("l"))
    assert lines._jdf.queryExecution().analyzed().toString().count("split(") == 1
    assert lines.first()[0] == ["a", "b"]


def test_plain_texts_are_composed_without_python(spark):
    """Only texts that can change go to Python; the results are those of the standard library."""
    texts = ["", "Plain ASCII", "Stra\u00dfe \u00c9", "e\u0301\u212b", "\u1100\u1161 \u0130I", None]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(X.nfc(F.col("t")), X.nfc_folded(F.col("t"))).collect()
    norm_ = [t if t is None else unicodedata.normalize("NFC", t) for t in texts]
    assert [tuple(r) for r in got] == [(t, t and t.casefold()) for t in norm_]
    parts = list(X._mapped(iter([pa.array(["a", None] * 300)]), str.upper))
    assert parts[0].to_pylist() == ["A", None] * 300


def test_reports_come_in_bundles_or_one_file_a_medium(spark, tmp_path):
    """Both layouts give the same texts; a bundle has no folder for each medium."""
    rows = spark.createDataFrame([(k, f'\ufeff[{{"id": {k}}}]') for k in range(40)], "media_id long, body string").coalesce(2)
    reports.write_bundle(rows, str(tmp_path / "bundle"))
    reports.write_reports(rows, str(tmp_path / "files"))
    bundle = reports.bundle_texts(spark, str(tmp_path / "bundle"))
    files = reports.report_texts(spark, str(tmp_path / "files" / "*"))
    assert sorted((str(r[0]), r[1]) for r in bundle.collect()) == sorted((r[0], r[1].rstrip("\n")) for r in files.collect()) == sorted((str(k), f'[{{"id": {k}}}]') for k in range(40))
    assert len(list((tmp_path / "bundle").glob("*.parquet"))) <= 2


def test_srt_corpus_keeps_lines_of_all_kinds(spark, tmp_path):
    cues = spark.createDataFrame([(7, 1, 0, 900, "one"), (7, 2, 900, 950, ""), (7, 20_000, 1000, 2000, " two\nthree "), (8, 1, 5, 6, None)], "media_id long, cue_id long, start_ms long, end_ms long, content string")
    reports.write_bundle(srt.srt_texts(cues).withColumnRenamed("srt_text", "body"), str(tmp_path / "srt"))
    srt.write_srt(cues, str(tmp_path / "files"))
    bundle = srt.parse_srt(reports.bundle_texts(spark, str(tmp_path / "srt"))).withColumn("media_id", F.col("media_id").cast("string"))
    assert sorted(map(tuple, bundle.collect())) == sorted(map(tuple, srt.read_srt(spark, str(tmp_path / "files" / "*")).collect()))


def test_valid_artifacts_more_rows_make_more_tasks_not_larger_ones(spark):
    steps = [(m, s, f"{s}{m}") for m in range(60) for s in ("dub", "qa")]
    wanted = spark.createDataFrame([(m, s, "other" if m % 5 == 0 else p) for m, s, p in steps], "media_id long, name string, fingerprint string")
    manifest = spark.createDataFrame([(m, s, p, [f"{s}-0", f"{s}-1"] if s == "qa" else []) for m, s, p in steps], "media_id long, name string, fingerprint string, files array<string>")
    files = spark.createDataFrame([(m, f"qa-{i}", m % 3) for m in range(60) for i in (0, 1) if i == 0 or m % 7], "media_id long, file string, size_bytes long")
    usual = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df = catalog.valid_artifacts(wanted, manifest, files, per_task=10)
    assert df.rdd.getNumPartitions() > usual
    assert {tuple(r) for r in df.collect()} == {(m, s) for m, s, _ in steps if m % 5 and (s == "dub" or m % 3 and m % 7)}
