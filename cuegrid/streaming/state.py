"""Streaming versions of the usage ledger, batch progress and text sessions.

Current state lives in bucketed tables (`BucketTable`): a micro-batch reads and rewrites the buckets it touches only, so its cost
does not grow with history. A repeated micro-batch starts from the state before it and overwrites its own folders, so a
restart counts nothing twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.operators.catalog import batch_progress, usage_by_model
from cuegrid.plans.scan import Sequence, islands
from cuegrid.plans.store import children, remove

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STORE = "spark.sql.streaming.stateStore.providerClass"


@contextmanager
def spilled_state(spark: SparkSession) -> Iterator[None]:
    """Keep streaming state on disk in RocksDB, unless the session chose a store, for the queries started inside."""
    before = spark.conf.get(STORE, None)
    if before in (None, "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"):
        spark.conf.set(STORE, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(STORE)
        else:
            spark.conf.set(STORE, before)


def _run(stream: DataFrame, mode: str, write, checkpoint: str) -> None:
    """Process what the source has now, then stop."""
    with spilled_state(stream.sparkSession):
        query = stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(write).start()
        query.awaitTermination()


def _folder(path: str, batch_id: int) -> str:
    return f"{path}/batch={batch_id:09d}"


@dataclass(frozen=True)
class BucketTable:
    """The newest row of each key, in buckets by a hash of `by`.

    path/rows/batch=B/bucket=K holds bucket K as micro-batch B left it; path/index/batch=B tells for each bucket the micro-batch that wrote it
    last. Writing the index makes a version current, so readers see all of a micro-batch or nothing. Versions that neither of the last
    two indexes names are removed after each update.
    """

    spark: SparkSession
    path: str
    by: tuple[str, ...]
    buckets: int = 64

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.by), F.lit(self.buckets)).cast("int")

    def index(self, before: int | None = None) -> dict[int, int]:
        """bucket -> micro-batch, at most one entry for each bucket."""
        known = [b for b in _batches(self.spark, f"{self.path}/index") if before is None or b < before]
        return {r["bucket"]: r["written"] for r in self.spark.read.parquet(_folder(f"{self.path}/index", max(known))).collect()} if known else {}

    def rows(self, index: dict[int, int]) -> DataFrame | None:
        """The rows of the buckets of an index; null if there are none."""
        paths = [f"{_folder(f'{self.path}/rows', b)}/bucket={k}" for k, b in sorted(index.items())]
        return self.spark.read.parquet(*paths) if paths else None

    def update(self, batch_id: int, changes: DataFrame, newest: Column | None, keys: tuple[str, ...]) -> DataFrame:
        """Merge changes in; of a key's rows the one with the greatest `newest` stays, or, without it, their sums. Returns the touched buckets' rows."""
        spark, before = self.spark, self.index(before=batch_id)
        fresh = changes.withColumn("bucket", self.bucket()).persist()  # read twice; what it is made of is worked out once
        touched = [r[0] for r in fresh.select("bucket").distinct().collect()]
        old = self.rows({k: before[k] for k in touched if k in before})
        every = fresh if old is None else fresh.unionByName(old.withColumn("bucket", self.bucket()))
        values = [c for c in every.columns if c not in ("bucket", *keys)]
        by_key = every.groupBy("bucket", *keys)
        merged = by_key.agg(*[F.sum(c).alias(c) for c in values]) if newest is None else by_key.agg(F.max_by(F.struct(*values), newest).alias("v")).select("bucket", *keys, "v.*")
        target = _folder(f"{self.path}/rows", batch_id)
        if touched:  # buckets beyond the size of a partition are written by several tasks
            merged.hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(target)
        fresh.unpersist()
        now = before | dict.fromkeys(touched, batch_id)
        spark.createDataFrame(sorted(now.items()), "bucket int, written long").coalesce(1).write.mode("overwrite").parquet(_folder(f"{self.path}/index", batch_id))
        self._clear(batch_id, set(now.values()) | set(before.values()))
        return self.rows(dict.fromkeys(touched, batch_id)) if touched else changes.limit(0)

    def _clear(self, batch_id: int, used: set[int]) -> None:
        """Earlier indexes but the last, and versions no index names. A version is one folder of all buckets of a micro-batch."""
        for b in _batches(self.spark, f"{self.path}/rows"):
            if b < batch_id and b not in used:
                remove(self.spark, _folder(f"{self.path}/rows", b))
        for b in sorted(b for b in _batches(self.spark, f"{self.path}/index") if b < batch_id)[:-1]:
            remove(self.spark, _folder(f"{self.path}/index", b))

    def current(self) -> DataFrame | None:
        return self.rows(self.index())


def _batches(spark: SparkSession, path: str) -> list[int]:
    return [int(name.removeprefix("batch=")) for name in children(spark, path) if name.startswith("batch=")]


def stream_usage(tokens: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Running totals per medium and model; only buckets with changed totals are rewritten.

    tokens is a stream of operators.catalog.usage_tokens rows. Returns the
    current totals, ready for the cost and per-medium rollup. The totals are the only state: those of a micro-batch are
    added to them, so no second copy lies in a state store.
    """
    keys = ("media_id", "provider", "model")
    table = BucketTable(tokens.sparkSession, path, ("media_id",), buckets)

    def write(rows: DataFrame, batch_id: int) -> None:
        table.update(batch_id, usage_by_model(rows), None, keys)

    _run(tokens, "append", write, checkpoint)
    found = table.current()
    return found if found is not None else tokens.sparkSession.createDataFrame([], usage_by_model(tokens).schema)


def stream_batch_progress(changes: DataFrame, batches: DataFrame, path: str, checkpoint: str, buckets: int = 64) -> DataFrame:
    """Progress of every batch, recomputed for the batches a micro-batch touches.

    changes: a stream of (job_id, batch_id, position, filename, status, error,
    change_no); the highest change_no of a job wins. Both jobs and progress lie in buckets of batches.
    """
    spark = changes.sparkSession
    jobs = BucketTable(spark, f"{path}/jobs", ("batch_id",), buckets)
    progress = BucketTable(spark, f"{path}/progress", ("batch_id",), buckets)
    schema: list = []

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.select("job_id", "batch_id", "position", "filename", "status", "error", "change_no")
        near = jobs.update(batch_id, rows, F.struct("change_no", "status"), ("job_id", "batch_id"))
        touched = near.join(rows.select("batch_id").distinct(), "batch_id", "left_semi")
        made = batch_progress(touched.drop("bucket", "change_no"), batches).withColumn("at", F.lit(batch_id))
        schema[:] = [made.drop("at").schema]
        progress.update(batch_id, made, F.col("at"), ("batch_id",))

    _run(changes, "append", write, checkpoint)
    found = progress.current()
    return found.drop("at") if found is not None else spark.createDataFrame([], schema[0] if schema else "batch_id long")


LINES = "media_id long, text string, start_ms long, end_ms long, score_sum long, samples long"


def stream_sessions(samples: DataFrame, path: str, checkpoint: str, step_ms: int = 400, delay_ms: int = 0, ends: bool = True) -> tuple[DataFrame, DataFrame]:
    """(sessions, late) of a stream of (media_id, seq, ts_ms, text, score_pct).

    The state is one open line for each medium. A micro-batch joins its samples to the open lines as the batch operator does, by scans over
    chunks of a medium, so a hot medium is spread and no group is gathered. A line is closed by the next one of its medium, or when the latest sample
    of all media is `delay_ms` past the time at which a sample could still extend it; with `ends` what is open when the source is drained is closed as well.
    late: (media_id, ts_ms, text, score_pct) of samples that came after their place in the sequence was decided, for repair in batch.
    """
    spark = samples.sparkSession
    longest, pad = step_ms * 15 / 4, step_ms * 3 / 4  # bridged as in the batch operator: 9/4 steps between the padded spans
    folders = {name: f"{path}/{name}" for name in ("closed", "late", "open", "clock")}

    def kept(name: str, batch_id: int, schema: str) -> DataFrame:
        """What the micro-batch before left open."""
        known = [b for b in _batches(spark, folders[name]) if b < batch_id]
        return spark.read.schema(schema).parquet(_folder(folders[name], max(known))) if known else spark.createDataFrame([], schema)

    def put(name: str, batch_id: int, df: DataFrame) -> None:
        df.write.mode("overwrite").parquet(_folder(folders[name], batch_id))

    def padded(lines: DataFrame) -> DataFrame:
        start, end = F.greatest(F.lit(0), F.floor(F.col("start_ms") - pad)), F.floor(F.col("end_ms") + pad)
        return lines.select("media_id", "text", start.cast("long").alias("start_ms"), end.cast("long").alias("end_ms"), "score_sum", "samples")

    def write(rows: DataFrame, batch_id: int) -> None:
        rows = rows.select(F.col("media_id").cast("long").alias("media_id"), "seq", F.col("ts_ms").cast("long").alias("ts_ms"), "text", F.col("score_pct").cast("long").alias("score_pct")).persist()
        open_ = kept("open", batch_id, LINES)
        placed = rows.join(open_.select("media_id", F.col("end_ms").alias("reached")), "media_id", "left")
        early = F.col("ts_ms") < F.col("reached")
        put("late", batch_id, placed.where(early).select("media_id", "ts_ms", "text", "score_pct"))
        parts = placed.where(~F.coalesce(early, F.lit(False))).select(
            "media_id", F.col("ts_ms").alias("start_ms"), "seq", F.col("ts_ms").alias("end_ms"), "text", F.col("score_pct").alias("score_sum"), F.lit(1).cast("long").alias("samples"))
        held = open_.select("media_id", "start_ms", F.lit(-1).cast("long").alias("seq"), "end_ms", "text", "score_sum", "samples")
        runs = islands(parts.unionByName(held), Sequence(("media_id",), ("start_ms", "seq"), 3_600_000), {"text": F.col("text"), "start": F.col("start_ms"), "end": F.col("end_ms")},
                       lambda p, c: ~p("text").eqNullSafe(c("text")) | (c("start") - p("end") > longest))
        lines = runs.groupBy("media_id", "island").agg(
            F.first("text").alias("text"), F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.sum("score_sum").alias("score_sum"), F.sum("samples").alias("samples")).persist()
        last = lines.groupBy("media_id").agg(F.max("island").alias("last"))
        now = rows.agg(F.max("ts_ms").alias("now")).unionByName(kept("clock", batch_id, "now long")).agg(F.max("now").alias("now"))
        waits = (F.col("island") == F.col("last")) & (F.col("end_ms") + longest + delay_ms >= F.col("now"))
        judged = lines.join(last, "media_id").crossJoin(F.broadcast(now)).withColumn("waits", F.coalesce(waits, F.lit(True))).persist()  # now is one row
        put("closed", batch_id, padded(judged.where("not waits")))
        put("clock", batch_id, now)
        put("open", batch_id, judged.where("waits").select("media_id", "text", "start_ms", "end_ms", "score_sum", "samples"))
        for name in ("open", "clock"):
            for b in sorted(b for b in _batches(spark, folders[name]) if b < batch_id)[:-1]:
                remove(spark, _folder(folders[name], b))
        judged.unpersist()
        lines.unpersist()
        rows.unpersist()

    _run(samples, "append", write, checkpoint)

    def all_of(name: str, schema: str) -> DataFrame:
        found = [_folder(folders[name], b) for b in _batches(spark, folders[name])]
        return spark.read.schema(schema).parquet(*found) if found else spark.createDataFrame([], schema)

    done = all_of("closed", LINES)
    if ends:
        done = done.unionByName(padded(kept("open", 1 << 62, LINES)))
    return done, all_of("late", "media_id long, ts_ms long, text string, score_pct long")
