"""Jobs, batches, artifacts and usage."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.operators import catalog as C
from cuegrid.sources.reports import artifact_rows
from cuegrid.workload import views
from cuegrid.workload.registry import query

def job():
    return F.col("job_id")


def pick(values, by):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (by % len(values) + 1).cast("int"))


def requests(spark, sf_dir):
    """Job requests with gaps and mistakes."""
    j = views.jobs(spark, sf_dir)
    return j.select(
        "job_id",
        pick(("https://host.example/v.mp4", " http://h/x", "ftp://host/x", "https:///nohost", "HTTPS://Host.example"), job()).alias("url"),
        pick(("openai", None, "gemini", "deepseek", "other"), job()).alias("provider"),
        pick((None, "auto", "gemini", "mystery"), job()).alias("translation_refine_provider"),
        pick((None, "tiny", "huge", "large-v3", "base", "small"), job()).alias("asr_model"),
        pick((None, 0, 3, 21), job()).alias("min_speakers"), pick((6, None, 20, 25, 1), job()).alias("max_speakers"),
        pick(("zh", None, "x", "fr"), job()).alias("source_language_code"),
        pick((None, 0.5, 1.5, -0.1, 1.0), job()).alias("original_audio_volume"),
        pick((None, "female", "robot"), job()).alias("speaker_gender_profile"), pick((None, False, True), job()).alias("dub"))


REQUESTS_SQL = """requests as (select job_id,
    ['https://host.example/v.mp4', ' http://h/x', 'ftp://host/x', 'https:///nohost', 'HTTPS://Host.example'][job_id % 5 + 1] url,
    ['openai', null, 'gemini', 'deepseek', 'other'][job_id % 5 + 1] provider,
    [null, 'auto', 'gemini', 'mystery'][job_id % 4 + 1] translation_refine_provider,
    [null, 'tiny', 'huge', 'large-v3', 'base', 'small'][job_id % 6 + 1] asr_model,
    [null, 0, 3, 21][job_id % 4 + 1] min_speakers, [6, null, 20, 25, 1][job_id % 5 + 1] max_speakers,
    ['zh', null, 'x', 'fr'][job_id % 4 + 1] source_language_code,
    [null, 0.5::double, 1.5::double, -0.1::double, 1.0::double][job_id % 5 + 1] original_audio_volume,
    [null, 'female', 'robot'][job_id % 3 + 1] speaker_gender_profile, [null, false, true][job_id % 3 + 1] dub from jobs)"""


@query("job_defaults", "jobs", REQUESTS_SQL + """ select job_id, coalesce(provider, 'deepseek') provider,
  case when coalesce(translation_refine_provider, 'auto') = 'auto' then coalesce(provider, 'deepseek') else translation_refine_provider end refine,
  coalesce(asr_model, 'qwen3-asr-1.7b') asr_model, coalesce(max_speakers, 6) max_speakers, coalesce(source_language_code, 'zh') lang,
  cast(round(coalesce(original_audio_volume, 0.08) * 100) as int) volume_pct, case when coalesce(dub, true) then 1 else 0 end dub from requests""")
def job_defaults(spark, sf_dir):
    r = C.fill_defaults(requests(spark, sf_dir))
    return r.select("job_id", "provider", F.col("translation_refine_provider").alias("refine"), "asr_model", "max_speakers",
                    F.col("source_language_code").alias("lang"), F.round(F.col("original_audio_volume") * 100).cast("int").alias("volume_pct"),
                    F.col("dub").cast("int").alias("dub"))


VIOLATIONS_SQL = """ select job_id, array_to_string(list_filter([
    case when not regexp_matches(trim(url), '^(?i:https?)://[^/?#]+') then 'url' end,
    case when provider not in ('openai', 'gemini', 'deepseek') then 'provider' end,
    case when translation_refine_provider not in ('auto', 'openai', 'gemini', 'deepseek') then 'translation_refine_provider' end,
    case when asr_model not in ('tiny', 'base', 'small', 'medium', 'large-v3', 'qwen3-asr-1.7b') then 'asr_model' end,
    case when min_speakers not between 1 and 20 then 'min_speakers' end, case when max_speakers not between 1 and 20 then 'max_speakers' end,
    case when length(source_language_code) not between 2 and 12 then 'source_language_code' end,
    case when original_audio_volume not between 0 and 1 then 'original_audio_volume' end,
    case when speaker_gender_profile not in ('auto', 'female', 'male', 'neutral') then 'speaker_gender_profile' end],
    lambda v: v is not null), ',') violations from requests"""


@query("validate_job_requests", "jobs", REQUESTS_SQL + VIOLATIONS_SQL)
def validate_job_requests(spark, sf_dir):
    r = requests(spark, sf_dir)
    return r.select("job_id", F.array_join(C.violations(r), ",").alias("violations"))


@query("split_requests", "jobs", REQUESTS_SQL + f""", judged as ({VIOLATIONS_SQL})
  select job_id, case when violations = '' then 'valid' else 'quarantined' end part, violations from judged""")
def split_requests(spark, sf_dir):
    valid, held = C.split_requests(requests(spark, sf_dir))
    return valid.select("job_id", F.lit("valid").alias("part"), F.lit("").alias("violations")).unionByName(
        held.select("job_id", F.lit("quarantined").alias("part"), F.array_join("violations", ",").alias("violations")))


@query("retryable_jobs", "jobs", "select job_id, retry_count from jobs where status = 'failed' and retry_count < 3")
def retryable_jobs(spark, sf_dir):
    # Failed jobs all have keys divisible by five, hence the shifted count.
    return C.retryable(views.jobs(spark, sf_dir)).select("job_id", "retry_count")


def _snapshot(spark, sf_dir):
    j = views.jobs(spark, sf_dir)
    return j.select("job_id", "status", ((job() / 5).cast("long") % 6).alias("retry_count"), F.concat(F.lit("e"), job().cast("string")).alias("error"), F.lit("old").alias("progress_message"))


@query("recover_interrupted", "jobs", """select job_id, case when status = 'running' then 'queued' else status end status,
  case when status <> 'running' then 'e' || job_id end error,
  case when status = 'running' then 'queued anew: its run was cut short' else 'old' end progress_message from jobs""")
def recover_interrupted(spark, sf_dir):
    return C.recover_interrupted(_snapshot(spark, sf_dir)).select("job_id", "status", "error", "progress_message")


@query("mark_for_retry", "jobs", """s as (select job_id, status, job_id // 5 % 6 n from jobs)
  select job_id, case when status = 'failed' and n < 3 then 'queued' else status end status, case when status = 'failed' and n < 3 then n + 1 else n end retry_count,
  case when status = 'failed' and n < 3 then 'queued anew: retry ' || (n + 1) || ' of 3' when status = 'failed' then 'no retry left' else 'old' end progress_message from s""")
def mark_for_retry(spark, sf_dir):
    return C.mark_for_retry(_snapshot(spark, sf_dir)).select("job_id", "status", "retry_count", "progress_message")


@query("eligible_for_cleanup", "batches", """s as (select batch_id, batch_status status, 1000 + batch_id output_bytes, 1000 + batch_id + case when batch_id % 4 = 0 then 1 else 0 end ack,
    case when batch_id % 6 = 0 then 5 end old from batches)
  select batch_id, case when status = 'done' and ack = output_bytes then 1 else 0 end ack_valid,
  case when status = 'done' and (ack = output_bytes or old is not null) then 1 else 0 end eligible from s""")
def eligible_for_cleanup(spark, sf_dir):
    k = F.col("batch_id")
    b = views.batches(spark, sf_dir).select(
        "batch_id", F.col("batch_status").alias("status"), (1000 + k).alias("output_bytes"),
        (1000 + k + F.when(k % 4 == 0, 1).otherwise(0)).alias("ack_bytes"), F.when(k % 6 == 0, 5).alias("download_confirmed_bytes"))
    return C.cleanup_state(b).select("batch_id", F.col("ack_valid").cast("int").alias("ack_valid"), F.col("eligible_for_cleanup").cast("int").alias("eligible"))


@query("resolve_branding", "batches", """s as (select batch_id, case when batch_id % 5 = 0 then '  ' when batch_id % 7 = 0 then repeat('n', 81) else channel_name end name,
    opacity_pct, batch_id % 3 = 0 logo from batches),
  t as (select *, trim(name) n from s),
  e as (select *, case when opacity_pct < 15 or opacity_pct > 85 then 'opacity' when length(n) > 80 then 'name_length'
    when n <> '' and not logo then 'logo_missing' when n = '' and logo then 'name_missing' end error from t)
  select batch_id, error, case when error is null then n end branding_name, case when error is null then opacity_pct end opacity_pct,
    case when error is null then case when n = '' then 'none' else 'upload' end end logo_source from e""")
def resolve_branding(spark, sf_dir):
    k = F.col("batch_id")
    name = F.when(k % 5 == 0, "  ").when(k % 7 == 0, F.repeat(F.lit("n"), F.lit(81))).otherwise(F.col("channel_name"))
    b = views.batches(spark, sf_dir).select("batch_id", name.alias("channel_name"), (F.col("opacity_pct") / 100).alias("watermark_opacity"), (k % 3 == 0).alias("has_logo"))
    r = C.resolve_branding(b)
    return r.select("batch_id", "error", "branding_name", F.round(F.col("branding_opacity") * 100).cast("long").alias("opacity_pct"), "logo_source")


@query("batch_episodes", "jobs", """select batch_id, position, job_id, filename, status from jobs""")
def batch_episodes(spark, sf_dir):
    j = views.jobs(spark, sf_dir)
    return C.batch_episodes(j.select("batch_id", "position", "job_id", "filename"), j.select("job_id", "status")).select(
        "batch_id", "position", "job_id", "filename", "status")


@query("job_batch_lookup", "jobs batches", """select j.job_id, case when j.job_id % 7 <> 0 then j.batch_id end batch_id from jobs j
  left join batches b on b.batch_id = j.batch_id and j.job_id % 7 <> 0
  where j.status = 'queued' and (b.batch_id is null or b.batch_status <> 'uploading')""")
def job_batch_lookup(spark, sf_dir):
    j = views.jobs(spark, sf_dir)
    placed = j.where(job() % 7 != 0).select("job_id", "batch_id")
    return C.startable_jobs(j.select("job_id", "status"), placed, views.batches(spark, sf_dir)).select("job_id", "batch_id")


STEPS = ("download", "transcript", "source_subtitle_mask", "translation", "dialogue_master", "burn", "dub", "qa")


def _artifacts(spark, sf_dir):
    n = F.col("l_linenumber").cast("int")
    lines = views.table(spark, sf_dir, "lineitem").select("l_orderkey", n.alias("n"), F.floor("l_quantity").cast("long").alias("q"))
    tasks = -(-lines.count() // 250_000)  # the row count that the files' footers give; more rows make more tasks, not larger ones
    if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")):
        lines = lines.repartition(tasks, "l_orderkey", "n")
    a = lines.groupBy("l_orderkey", "n").agg(F.max("q").alias("q"))
    return a.select(F.col("l_orderkey").alias("media_id"), F.element_at(F.array(*[F.lit(s) for s in STEPS]), F.col("n") % 8 + 1).alias("name"), "n", "q")


ARTIFACTS_SQL = """a0 as (select l_orderkey media_id, l_linenumber n, max(cast(floor(l_quantity) as bigint)) q from lineitem group by all),
  a as (select media_id, n, q, ['download', 'transcript', 'source_subtitle_mask', 'translation', 'dialogue_master', 'burn', 'dub', 'qa'][n % 8 + 1] as name from a0)"""


@query("valid_artifacts", "", ARTIFACTS_SQL + " select media_id, name from a where q % 5 <> 0 and q % 7 <> 0 and q % 3 <> 0 or q % 5 <> 0 and q % 3 <> 0 and n % 2 = 0")
def valid_artifacts(spark, sf_dir):
    # Fingerprints differ where q % 5 = 0; file 0 is empty where q % 3 = 0; odd steps own a second file, absent where q % 7 = 0.
    a = _artifacts(spark, sf_dir)
    print_ = F.concat("name", F.col("q").cast("string"))
    files = F.when(F.col("n") % 2 == 0, F.array(F.concat("name", F.lit("-0")))).otherwise(F.array(F.concat("name", F.lit("-0")), F.concat("name", F.lit("-1"))))
    manifest = a.select("media_id", "name", print_.alias("fingerprint"), files.alias("files"))
    wanted = a.select("media_id", "name", F.when(F.col("q") % 5 == 0, "other").otherwise(print_).alias("fingerprint"))
    first = a.select("media_id", F.concat("name", F.lit("-0")).alias("file"), (F.col("q") % 3).alias("size_bytes"))
    second = a.where((F.col("n") % 2 == 1) & (F.col("q") % 7 != 0)).select("media_id", F.concat("name", F.lit("-1")).alias("file"), F.lit(9).cast("long").alias("size_bytes"))
    return C.valid_artifacts(wanted, manifest, first.unionByName(second))


@query("invalidate_artifacts", "", ARTIFACTS_SQL + """ select media_id, name from a where media_id % 4 <> 0 or n % 8 <= 3""")
def invalidate_artifacts(spark, sf_dir):
    a = _artifacts(spark, sf_dir)
    reviewed = a.where("media_id % 4 = 0").select("media_id").distinct().withColumn("step", F.lit("translation"))
    return C.invalidate_after(a.select("media_id", "name"), reviewed, STEPS)


@query("read_artifacts", "", ARTIFACTS_SQL + """ select media_id, name, q from a where q % 6 <> 0""")
def read_artifacts(spark, sf_dir):
    a = _artifacts(spark, sf_dir)
    version = F.when(F.col("q") % 6 == 0, "1.0").otherwise("2.0")
    text = F.to_json(F.struct(version.alias("pipeline_version"), F.map_from_arrays(
        F.array("name"), F.array(F.struct(F.col("q").cast("string").alias("fingerprint"), F.array("name").alias("files")))).alias("artifacts")))
    rows = artifact_rows(a.select("media_id", text.alias("body")))
    return rows.select("media_id", "name", F.col("fingerprint").cast("long").alias("q"))


@query("uncached_synthesis", "cues", """u as (select media_id, cue_id, sha256(content || '|doc') f from cues),
  c as (select sha256(content || '|doc') f, case when cue_id % 3 = 0 then 512 else 4000 end size from cues where media_id % 2 = 0)
  select media_id, cue_id from u where f not in (select f from c where size > 512)""")
def uncached_synthesis(spark, sf_dir):
    c = views.cues(spark, sf_dir).withColumn("fingerprint", F.sha2(F.concat("content", F.lit("|doc")), 256))
    cache = c.where("media_id % 2 = 0").select("fingerprint", F.when(F.col("cue_id") % 3 == 0, 512).otherwise(4000).alias("size_bytes"))
    return C.uncached_synthesis(c.select("media_id", "cue_id", "fingerprint"), cache).select("media_id", "cue_id")


@query("usage_ledger", "usage_events", """m as (select media_id, model, count(*) requests, sum(prompt_tokens) prompt, sum(completion_tokens) completion, sum(hit_tokens) hit,
    sum(greatest(0, prompt_tokens - hit_tokens)) miss, sum(prompt_tokens + completion_tokens) total from usage_events group by all)
  select media_id, sum(requests)::bigint requests, sum(prompt)::bigint prompt, sum(completion)::bigint completion, sum(hit)::bigint hit, sum(miss)::bigint miss,
    sum(total)::bigint total, sum(case when contains(model, 'pro') then hit * 3625 + miss * 435000 + completion * 870000
      else hit * 2800 + miss * 140000 + completion * 280000 end)::bigint cost_pico_usd,
    string_agg(model || '=' || requests, ',' order by model) models from m group by media_id""")
def usage_ledger(spark, sf_dir):
    e = views.usage_events(spark, sf_dir).select(
        "media_id", F.lit("deepseek").alias("provider"), "model", "prompt_tokens", F.col("hit_tokens").alias("prompt_cache_hit_tokens"), "completion_tokens")
    led = C.usage_ledger(C.usage_tokens(e))
    names = F.array_join(F.transform(F.map_entries("models"), lambda m: F.concat(m["key"], F.lit("="), m["value"].cast("string"))), ",")
    return led.select("media_id", "requests", "prompt", "completion", "hit", "miss", "total",
                      "cost_pico_usd", names.alias("models"))


@query("read_usage_events", "usage_events", """select media_id, model, prompt_tokens prompt, completion_tokens completion, case when completion_tokens % 2 = 0 then hit_tokens else 0 end hit,
  case when completion_tokens % 2 = 0 then prompt_tokens - hit_tokens else prompt_tokens end miss, prompt_tokens + completion_tokens total from usage_events""")
def read_usage_events(spark, sf_dir):
    u = views.usage_events(spark, sf_dir)
    even = F.col("completion_tokens") % 2 == 0
    e = u.select("media_id", F.lit("any").alias("provider"), "model",
                 F.when(even, F.col("prompt_tokens")).alias("prompt_tokens"), F.when(~even, F.col("prompt_tokens")).alias("input_tokens"),
                 F.when(even, F.col("completion_tokens")).alias("completion_tokens"), F.when(~even, F.col("completion_tokens")).alias("output_tokens"),
                 F.when(even, F.col("hit_tokens")).alias("prompt_cache_hit_tokens"))
    return C.usage_tokens(e).drop("provider")


PROGRESS_SQL = """e as (select *, case when job_id % 3 = 0 then 'provider error' end error from jobs),
  n as (select batch_id, count(*) episodes, count(*) filter (status = 'done') completed, count(*) filter (status in ('queued', 'running')) active,
    count(*) filter (status in ('failed', 'needs_review')) failed, min(position) filter (status in ('failed', 'needs_review')) first_pos from e group by batch_id),
  x as (select n.*, e.filename || ': ' || coalesce(e.error, e.status) why from n left join e on e.batch_id = n.batch_id and e.position = n.first_pos)
  select batch_id, case when active > 0 then 'running' when failed > 0 then 'failed' when completed < episodes then 'running' else 'ready' end new_status,
    case when active > 0 then completed || ' of ' || episodes || ' done, ' || failed || ' to look at, others under way'
      when failed > 0 then 'stopped at position ' || first_pos else completed || ' of ' || episodes || ' done' end message,
    case when failed > 0 then why end error from x join batches b using (batch_id) where b.batch_status not in ('uploading', 'done')"""


@query("batch_progress", "jobs batches", PROGRESS_SQL)
def batch_progress(spark, sf_dir):
    e = views.jobs(spark, sf_dir).withColumn("error", F.when(job() % 3 == 0, "provider error"))
    return C.batch_progress(e, views.batches(spark, sf_dir))


@query("batch_media_profile", "jobs", """m as (select batch_id, position, size_bytes, 60000 + job_id % 977 * 100 ms, ['24', '25', '30000/1001'][job_id % 3 + 1] fps,
    case when batch_id % 2 = 0 then 'h264|1280|720' when job_id % 9 = 0 then 'hevc' else 'h264' end sig from jobs),
  f as (select batch_id, fps, count(*) n, min(position) p from m group by all),
  t as (select batch_id, fps from f qualify row_number() over (partition by batch_id order by n desc, p) = 1)
  select m.batch_id, sum(ms)::bigint duration_ms, sum(size_bytes)::bigint size_bytes, case when count(distinct sig) = 1 then 1 else 0 end same_streams,
    min(t.fps) target_fps, cast(round_even(sum(size_bytes) * 3.2::double, 0) as bigint) combine_bytes from m join t using (batch_id) group by m.batch_id""")
def batch_media_profile(spark, sf_dir):
    m = views.jobs(spark, sf_dir).select(
        "batch_id", "position", "size_bytes", (60_000 + job() % 977 * 100).alias("duration_ms"), pick(("24", "25", "30000/1001"), job()).alias("fps"),
        F.when(F.col("batch_id") % 2 == 0, "h264|1280|720").when(job() % 9 == 0, "hevc").otherwise("h264").alias("signature"))
    return C.batch_media_profile(m).withColumn("same_streams", F.col("same_streams").cast("int"))


@query("fingerprint", "cues", """c as (select media_id, cue_id // 16384 c, sha256(string_agg(cue_id || chr(31) || content, chr(30) order by cue_id)) d from cues group by all),
  g as (select media_id, c // 16384 g, sha256(string_agg(c || chr(31) || d, chr(30) order by c)) d from c group by all)
  select media_id, sha256(string_agg(g || chr(31) || d, chr(30) order by g)) fingerprint from g group by all""")
def fingerprint(spark, sf_dir):
    return C.chunk_fingerprints(views.cues(spark, sf_dir), ["media_id"], "cue_id", F.col("content"))


RECEIPTS_SQL = """e as (select batch_id, position, case when job_id % 8 = 0 then null else size_bytes end b, case when job_id % 10 = 0 then '' else 'x' end s from jobs)"""


def _receipts(spark, sf_dir):
    return views.jobs(spark, sf_dir).select("batch_id", "position", F.when(job() % 8 != 0, F.col("size_bytes")).alias("received_bytes"),
                                            F.when(job() % 10 == 0, "").otherwise("x").alias("sha256"))


@query("batch_receipts", "jobs batches", RECEIPTS_SQL + """, n as (select batch_id, count(*) uploaded, count(*) filter (b is null or b = 0 or s = '') missing from e group by batch_id)
  select b.batch_id, expected_episodes, coalesce(uploaded, 0) uploaded, coalesce(missing, 0) missing,
    case when coalesce(uploaded, 0) = expected_episodes and coalesce(missing, 0) = 0 then 1 else 0 end complete from batches b left join n using (batch_id)""")
def batch_receipts(spark, sf_dir):
    r = C.batch_receipts(_receipts(spark, sf_dir), views.batches(spark, sf_dir))
    return r.withColumn("complete", F.col("complete").cast("int"))


@query("missing_receipts", "jobs", RECEIPTS_SQL + " select batch_id, position from e where b is null or b = 0 or s = ''")
def missing_receipts(spark, sf_dir):
    return C.missing_receipts(_receipts(spark, sf_dir))


@query("recent_jobs", "", """select o_orderkey job_id, strftime(o_orderdate, '%Y-%m-%d') created from orders order by o_orderdate desc, o_orderkey desc limit 50""")
def recent_jobs(spark, sf_dir):
    o = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created_at"))
    return C.recent(o, 50).select("job_id", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("natural_order", "jobs", """f as (select batch_id, job_id, job_id % 97 a, job_id % 13 b, job_id % 2 = 0 lower_case from jobs)
  select batch_id, job_id, row_number() over (partition by batch_id order by a, b, job_id) natural_position from f""")
def natural_order(spark, sf_dir):
    name = F.concat(F.when(job() % 2 == 0, "tap-").otherwise("TAP-"), (job() % 97).cast("string"), F.lit(" Part"), F.lpad((job() % 13).cast("string"), 3, "0"), F.lit(".mp4"))
    f = views.jobs(spark, sf_dir).select("batch_id", "job_id", name.alias("filename"))
    return C.natural_order(f, "batch_id", "job_id").drop("filename")


@query("batches_by_status", "batches", "select batch_id, batch_status from batches where batch_status in ('done', 'uploading') order by batch_id")
def batches_by_status(spark, sf_dir):
    return C.by_status(views.batches(spark, sf_dir).withColumn("created_at", F.col("batch_id")), "done", "uploading").select("batch_id", "batch_status")


@query("load_catalog", "jobs", """select job_id, case when job_id % 2 = 0 then 'asr' else 'ocr' end subtitle_source, case when job_id % 2 = 0 then 0 else retry_count end retry_count,
  case when job_id % 2 = 0 then 'auto' else 'female' end speaker_gender_profile, case when job_id % 2 = 1 then size_bytes end received_bytes from jobs""")
def load_catalog(spark, sf_dir):
    j = views.jobs(spark, sf_dir)
    old = j.where(job() % 2 == 0).select("job_id", "status")
    new = j.where(job() % 2 == 1).select("job_id", "status", F.lit("ocr").alias("subtitle_source"), "retry_count",
                                     F.lit("female").alias("speaker_gender_profile"), F.col("size_bytes").alias("received_bytes"))
    t = C.with_added_columns(old, new, C.ADDED_JOB_COLUMNS)
    return t.select("job_id", "subtitle_source", "retry_count", "speaker_gender_profile", "received_bytes")
