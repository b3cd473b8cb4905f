"""Streaming queries, run until the source is drained."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.operators import catalog as C
from cuegrid.streaming import state as St
from cuegrid.workload import views
from cuegrid.workload.catalogue import PROGRESS_SQL
from cuegrid.workload.registry import query
from cuegrid.workload.sources import fresh


def _stream(spark, slices):
    """A stream over the slices in their order, one file set per micro-batch."""
    path = fresh(spark, "stream-in")
    for s in slices:
        s.write.mode("append").parquet(path)
    schema = spark.read.parquet(path).schema
    files = max(1, len(spark.read.parquet(path).inputFiles()) // len(slices))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


@query("stream_usage", "usage_events", """select media_id, model, count(*) requests, sum(prompt_tokens)::bigint prompt, sum(completion_tokens)::bigint completion, sum(hit_tokens)::bigint hit,
  sum(prompt_tokens - hit_tokens)::bigint miss from usage_events group by all""")
def stream_usage(spark, sf_dir):
    u = views.usage_events(spark, sf_dir).select("media_id", F.lit("deepseek").alias("provider"), "model", "prompt_tokens",
                                                 F.col("hit_tokens").alias("prompt_cache_hit_tokens"), "completion_tokens")
    events = _stream(spark, [u.where(F.col("prompt_tokens") % 3 == k) for k in range(3)])
    t = St.stream_usage(C.usage_tokens(events), fresh(spark, "usage"), fresh(spark, "usage-cp"), buckets=8)
    return t.select("media_id", "model", "requests", "prompt", "completion", "hit", "miss")


@query("stream_batch_progress", "jobs batches", PROGRESS_SQL)
def stream_batch_progress(spark, sf_dir):
    j = views.jobs(spark, sf_dir).select("job_id", "batch_id", "position", "filename", "status", F.when(F.col("job_id") % 3 == 0, "provider error").alias("error"))
    first = j.withColumn("status", F.lit("queued")).withColumn("change_no", F.lit(1))
    second = j.where("job_id % 2 = 0").withColumn("status", F.lit("running")).withColumn("change_no", F.lit(2))
    final = j.withColumn("change_no", F.lit(3))
    changes = _stream(spark, [first, second, final])
    return St.stream_batch_progress(changes, views.batches(spark, sf_dir), fresh(spark, "progress"), fresh(spark, "progress-cp"), buckets=8)


@query("stream_ocr_sessions", "ocr_samples", """n as (select *, coalesce(lag(text) over w = text and (ts_ms - 300) - (lag(ts_ms) over w + 300) <= 900, false) same
    from ocr_samples window w as (partition by media_id order by seq)),
  s as (select *, sum(case when same then 0 else 1 end) over (partition by media_id order by seq) session from n),
  g as (select media_id, session, min(text) as text, greatest(0, min(ts_ms) - 300) start_ms, max(ts_ms) + 300 end_ms, sum(score_pct)::bigint score_sum, count(*) samples from s group by all)
  select media_id, text, start_ms, end_ms, score_sum, samples from g""")
def stream_ocr_sessions(spark, sf_dir):
    s = views.ocr_samples(spark, sf_dir)
    third = s.agg(F.max("ts_ms")).first()[0] // 3 + 1
    samples = _stream(spark, [s.where(F.floor(F.col("ts_ms") / third) == k) for k in range(3)])
    return St.stream_sessions(samples, fresh(spark, "sessions"), fresh(spark, "sessions-cp"))[0]
