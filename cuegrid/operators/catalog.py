"""Jobs, batches, artifacts and usage: the catalogue side."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.functions.text import natural_key, safe_label, strip
from cuegrid.functions.timing import rounded
from cuegrid.plans.scan import ranked_by

# Request defaults, allowed values and limits.
JOB_DEFAULTS = {
    "provider": "deepseek", "translation_draft_provider": "deepseek", "translation_refine_provider": "auto",
    "asr_model": "qwen3-asr-1.7b", "diarize": True, "max_speakers": 6, "source_language_code": "zh",
    "source_language": "Chinese", "target_language": "Vietnamese", "burn_subtitles": True,
    "hide_source_subtitles": False, "dub": True, "original_audio_volume": 0.08, "speaker_gender_profile": "auto",
}
PROVIDERS = ("openai", "gemini", "deepseek")
ASR_MODELS = ("tiny", "base", "small", "medium", "large-v3", "qwen3-asr-1.7b")
GENDER_PROFILES = ("auto", "female", "male", "neutral")
ADDED_JOB_COLUMNS = {
    "subtitle_source": "asr", "diarize": 0, "min_speakers": None, "max_speakers": None,
    "tts_secondary_voice": "vi-VN-NamMinhNeural", "voice_overrides": "{}", "narrator_mode": 1,
    "hide_source_subtitles": 1, "received_bytes": None, "sha256": None, "speaker_gender_profile": "auto",
    "translation_draft_provider": "deepseek", "translation_refine_provider": "auto", "retry_count": 0,
}
ADDED_BATCH_COLUMNS = {
    "channel_name": "", "watermark_opacity": 0.58, "output_filename": "", "expected_episodes": 0,
    "download_confirmed_at": None, "download_confirmed_bytes": None,
}
COMBINE_FACTOR = 3.2
ACTIVE, ATTENTION = ("queued", "running"), ("failed", "needs_review")
# USD per million tokens: cache hit, cache miss, output.
PRO_PRICE, BASE_PRICE, PRICED_PROVIDER = (0.003625, 0.435, 0.87), (0.0028, 0.14, 0.28), "deepseek"


#: Longest list of recent jobs.
MOST_RECENT = 200


def with_added_columns(old: DataFrame, current: DataFrame, defaults: dict) -> DataFrame:
    """Rows written before a column existed, brought to the current table shape."""
    rows = old.unionByName(current, allowMissingColumns=True)
    for name, value in defaults.items():
        if name in rows.columns and value is not None:
            rows = rows.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    return rows


def fill_defaults(requests: DataFrame, defaults: dict = JOB_DEFAULTS) -> DataFrame:
    """Missing options take their default; an automatic refine provider follows the provider."""
    for name, value in defaults.items():
        if name in requests.columns:
            requests = requests.withColumn(name, F.coalesce(F.col(name), F.lit(value)))
    if "translation_refine_provider" in requests.columns:
        refine = F.col("translation_refine_provider")
        requests = requests.withColumn("translation_refine_provider", F.when(refine == "auto", F.col("provider")).otherwise(refine))
    return requests


def violations(requests: DataFrame) -> Column:
    """Names of the request fields that break a rule; empty if the request is valid."""
    def bad(name: str, ok: Column) -> Column:
        # A missing optional value breaks nothing; url is the one required field.
        return F.when(~F.coalesce(ok, F.lit(name != "url")), F.lit(name))

    def between(name: str, low, high):
        return F.col(name).between(low, high)

    url = strip(F.col("url"))
    rules = {
        "url": url.rlike(r"^(?i:https?)://[^/?#]+"),
        "provider": F.col("provider").isin(*PROVIDERS),
        "translation_draft_provider": F.col("translation_draft_provider").isin(*PROVIDERS),
        "translation_refine_provider": F.col("translation_refine_provider").isin("auto", *PROVIDERS),
        "asr_model": F.col("asr_model").isin(*ASR_MODELS),
        "min_speakers": between("min_speakers", 1, 20), "max_speakers": between("max_speakers", 1, 20),
        "source_language_code": F.length("source_language_code").between(2, 12),
        "source_language": F.length("source_language").between(2, 50),
        "target_language": F.length("target_language").between(2, 50),
        "glossary": F.length("glossary") <= 10_000, "tts_voice": F.length("tts_voice") <= 100,
        "original_audio_volume": between("original_audio_volume", 0.0, 1.0),
        "speaker_gender_profile": F.col("speaker_gender_profile").isin(*GENDER_PROFILES),
    }
    checks = [bad(name, ok) for name, ok in rules.items() if name in requests.columns]
    return F.filter(F.array(*checks), lambda v: v.isNotNull())


def split_requests(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid requests, quarantined ones with the names of the fields that break a rule)."""
    judged = requests.withColumn("violations", violations(requests))
    return judged.where(F.size("violations") == 0).drop("violations"), judged.where(F.size("violations") > 0)


def retryable(jobs: DataFrame, max_retries: int = 3) -> DataFrame:
    budget = max(0, max_retries)
    return jobs.where((F.col("status") == "failed") & (F.coalesce("retry_count", F.lit(0)) < budget))


def recover_interrupted(jobs: DataFrame) -> DataFrame:
    was_running = F.col("status") == "running"
    return jobs.select(
        *[c for c in jobs.columns if c not in ("status", "error", "progress_message")],
        F.when(was_running, "queued").otherwise(F.col("status")).alias("status"),
        F.when(~was_running, F.col("error")).alias("error"),
        F.when(was_running, "queued anew: its run was cut short").otherwise(F.col("progress_message")).alias("progress_message"),
    )


def mark_for_retry(jobs: DataFrame, max_retries: int = 3) -> DataFrame:
    """Failed jobs with budget left go back to the queue, one attempt further."""
    budget = max(0, max_retries)
    count = F.coalesce("retry_count", F.lit(0))
    again = (F.col("status") == "failed") & (count < budget)
    message = F.concat(F.lit("queued anew: retry "), (count + 1).cast("string"), F.lit(f" of {budget}"))
    return jobs.withColumns({
        "status": F.when(again, "queued").otherwise(F.col("status")),
        "retry_count": F.when(again, count + 1).otherwise(count),
        "progress_message": F.when(again, message).when(F.col("status") == "failed", "no retry left").otherwise(F.col("progress_message")),
    })


def cleanup_state(batches: DataFrame) -> DataFrame:
    """Accept download receipts of the right size and mark what may be removed."""
    valid = (F.col("status") == "done") & (F.col("ack_bytes") == F.col("output_bytes")) & (F.col("ack_bytes") > 0)
    confirmed = F.coalesce(valid, F.lit(False)) | F.col("download_confirmed_bytes").isNotNull()
    return batches.withColumn("ack_valid", F.coalesce(valid, F.lit(False))).withColumn(
        "eligible_for_cleanup", confirmed & (F.col("status") == "done"))


def resolve_branding(batches: DataFrame, default_name: str = "", default_opacity: float = 0.58, default_logo: bool = False) -> DataFrame:
    """Channel name, opacity and logo source, or the reason the request is refused."""
    asked = strip(F.coalesce("channel_name", F.lit("")))
    name = F.when(asked != "", asked).otherwise(F.lit(default_name.strip()))
    opacity = F.coalesce("watermark_opacity", F.lit(default_opacity))
    logo = F.coalesce("has_logo", F.lit(False))
    error = (
        F.when(~opacity.between(0.15, 0.85), "opacity").when(F.length(name) > 80, "name_length")
        .when((name != "") & ~logo & F.lit(not default_logo), "logo_missing")
        .when((name == "") & logo, "name_missing")
    )
    source = F.when(name == "", "none").when(logo, "upload").otherwise("default")
    return batches.select(
        "batch_id", error.alias("error"), F.when(error.isNull(), name).alias("branding_name"),
        F.when(error.isNull(), opacity).alias("branding_opacity"), F.when(error.isNull(), source).alias("logo_source"))


def output_label(n_episodes: Column, single: Column, dub: Column, burn: Column) -> Column:
    return (
        F.when(n_episodes == 1, single).when(dub, "combined-vi-dubbed")
        .when(burn, "combined-vi-burned").otherwise("combined-source")
    )


def output_name(created_at: Column, label: Column) -> Column:
    return F.concat(F.date_format(created_at, "yyyyMMdd-HHmmss"), F.lit("_"), safe_label(label), F.lit(".mp4"))


def encode_budget(total_bytes: Column, total_ms: Column, width: Column, height: Column) -> list[Column]:
    kbps = total_bytes * 8 / F.greatest(total_ms / 1000, F.lit(0.001)) / 1000
    floor = 4200 * (F.greatest(F.lit(1), width * height) / (1920 * 1080))
    target = rounded(F.greatest(F.lit(650), F.least(F.lit(12_000), F.greatest(kbps * 2.4 - 128, floor))))
    return [target.alias("target_kbps"), rounded(F.least(F.lit(18_000), target * 1.5)).alias("max_kbps")]


def batch_episodes(batch_jobs: DataFrame, jobs: DataFrame) -> DataFrame:
    return batch_jobs.join(jobs, "job_id")


def startable_jobs(jobs: DataFrame, batch_jobs: DataFrame, batches: DataFrame) -> DataFrame:
    """Queued jobs that may start: on their own, or in a batch that is fully uploaded."""
    placed = jobs.where("status = 'queued'").join(batch_jobs.select("job_id", "batch_id"), "job_id", "left")
    placed = placed.join(batches.select("batch_id", "batch_status"), "batch_id", "left")
    return placed.where("batch_status is null or batch_status <> 'uploading'")


def batch_progress(episodes: DataFrame, batches: DataFrame) -> DataFrame:
    """New status of every batch that is neither uploading nor done."""
    weak = F.col("status").isin(*ATTENTION)
    first = F.when(weak, F.struct("position", "filename", F.coalesce("error", "status").alias("reason")))
    n = episodes.groupBy("batch_id").agg(
        F.count("*").alias("episodes"), F.count_if(F.col("status") == "done").alias("completed"),
        F.count_if(F.col("status").isin(*ACTIVE)).alias("active"), F.count_if(weak).alias("failed"), F.min(first).alias("first"))
    b = batches.where(~F.col("batch_status").isin("uploading", "done")).select("batch_id").join(n, "batch_id")
    status = (
        F.when(F.col("active") > 0, "running").when(F.col("failed") > 0, "failed")
        .when(F.col("completed") < F.col("episodes"), "running").otherwise("ready")
    )
    done = F.concat(F.col("completed").cast("string"), F.lit(" of "), F.col("episodes").cast("string"), F.lit(" done"))
    message = (
        F.when(F.col("active") > 0, F.concat(done, F.lit(", "), F.col("failed").cast("string"), F.lit(" to look at, others under way")))
        .when(F.col("failed") > 0, F.concat(F.lit("stopped at position "), F.col("first.position").cast("string")))
        .otherwise(done)
    )
    error = F.when(F.col("failed") > 0, F.concat("first.filename", F.lit(": "), "first.reason"))
    return b.select("batch_id", status.alias("new_status"), message.alias("message"), error.alias("error"))


def batch_media_profile(media: DataFrame) -> DataFrame:
    """Totals, stream equality and commonest frame rate per batch.

    media: (batch_id, position, duration_ms, size_bytes, signature, fps).
    Frame rates are counted before the batch is brought together.
    """
    per_rate = media.groupBy("batch_id", "fps").agg(
        F.count("*").alias("n"), F.min("position").alias("first"), F.sum("duration_ms").alias("ms"), F.sum("size_bytes").alias("bytes"),
        F.min("signature").alias("lo"), F.max("signature").alias("hi"))
    t = per_rate.groupBy("batch_id").agg(
        F.sum("ms").alias("duration_ms"), F.sum("bytes").alias("size_bytes"),
        (F.min("lo") == F.max("hi")).alias("same_streams"), F.min(F.struct(-F.col("n"), "first", "fps")).getField("fps").alias("target_fps"))
    return t.withColumn("combine_bytes", rounded(F.col("size_bytes") * COMBINE_FACTOR))


def missing_receipts(episodes: DataFrame) -> DataFrame:
    """(batch_id, position) of uploads without size or checksum."""
    return episodes.where((F.coalesce("received_bytes", F.lit(0)) == 0) | (F.coalesce("sha256", F.lit("")) == "")).select("batch_id", "position")


def batch_receipts(episodes: DataFrame, batches: DataFrame) -> DataFrame:
    """Is every expected episode of a batch uploaded with its receipt?"""
    missing = (F.coalesce("received_bytes", F.lit(0)) == 0) | (F.coalesce("sha256", F.lit("")) == "")
    n = episodes.groupBy("batch_id").agg(F.count("*").alias("uploaded"), F.count_if(missing).alias("missing"))
    r = batches.select("batch_id", "expected_episodes").join(n, "batch_id", "left")
    r = r.withColumns({c: F.coalesce(c, F.lit(0)) for c in ("uploaded", "missing")})
    return r.withColumn("complete", (F.col("uploaded") == F.col("expected_episodes")) & (F.col("missing") == 0))


def natural_order(files: DataFrame, key: str, tie: str) -> DataFrame:
    """Position of each file of `key` in natural name order."""
    return ranked_by(files, (key,), [natural_key(F.col("filename")).alias("name"), F.col(tie)], "natural_position")


def recent(jobs: DataFrame, n: int = 50) -> DataFrame:
    """Newest first, as a distributed top-n; a request for none or for more than 200 is refused."""
    if not 1 <= n <= MOST_RECENT:
        raise ValueError(f"between 1 and {MOST_RECENT} jobs can be listed, not {n}")
    return jobs.orderBy(F.desc("created_at"), F.desc("job_id")).limit(n)


def by_status(batches: DataFrame, *statuses: str) -> DataFrame:
    return batches.where(F.col("batch_status").isin(*statuses)).orderBy("created_at", "batch_id")


def usage_tokens(events: DataFrame) -> DataFrame:
    """One shape for both dialects of provider usage objects; names are null if absent."""
    def first_of(*names: str) -> Column:
        return F.coalesce(*[F.col(n) for n in names if n in events.columns], F.lit(0)).cast("long")

    hit = first_of("prompt_cache_hit_tokens")
    e = events.select(
        "media_id", "provider", "model", first_of("prompt_tokens", "input_tokens").alias("prompt"),
        first_of("completion_tokens", "output_tokens").alias("completion"), hit.alias("hit"),
        *[F.col(n) if n in events.columns else F.lit(None).cast("long").alias(n) for n in ("prompt_cache_miss_tokens", "total_tokens")])
    return e.select(
        "media_id", "provider", "model", "prompt", "completion", "hit",
        F.coalesce("prompt_cache_miss_tokens", F.greatest(F.lit(0), F.col("prompt") - F.col("hit"))).alias("miss"),
        F.coalesce("total_tokens", F.col("prompt") + F.col("completion")).alias("total"))


def usage_by_model(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("media_id", "provider", "model").agg(
        F.count("*").alias("requests"), *[F.sum(c).alias(c) for c in ("prompt", "completion", "hit", "miss", "total")])


def usage_ledger(tokens: DataFrame) -> DataFrame:
    """Running usage of each medium with its estimated cost.

    Summed per model first: the tariff and the per-model counts need it, and it
    shrinks a hot medium to a handful of rows before they meet.
    """
    m = usage_by_model(tokens)
    pro = F.lower("model").contains("pro")

    def price(i: int) -> Column:
        """USD per million tokens, as whole pico-dollars per token: sums stay exact."""
        return F.when(pro, round(PRO_PRICE[i] * 1_000_000)).otherwise(round(BASE_PRICE[i] * 1_000_000)).cast("long")

    cost = F.when(F.col("provider") == PRICED_PROVIDER, F.col("hit") * price(0) + F.col("miss") * price(1) + F.col("completion") * price(2))
    led = m.withColumn("_cost", F.coalesce(cost, F.lit(0))).groupBy("media_id").agg(
        *[F.sum(c).alias(c) for c in ("requests", "prompt", "completion", "hit", "miss", "total")],
        F.sum("_cost").alias("cost_pico_usd"), F.array_sort(F.collect_list(F.struct("model", "provider", "requests"))).alias("_m"))
    names = F.array_distinct(F.transform("_m", lambda x: x["model"]))

    def count(name: Column) -> Column:
        same = F.filter("_m", lambda x: x["model"] == name)
        return F.aggregate(same, F.lit(0).cast("long"), lambda n, x: n + x["requests"])

    return led.withColumn("cost_usd", F.round(F.col("cost_pico_usd") / 10**12, 6)).withColumn(
        "models", F.map_from_arrays(names, F.transform(names, count))).drop("_m")


def valid_artifacts(wanted: DataFrame, manifest: DataFrame, files: DataFrame, per_task: int = 250_000) -> DataFrame:
    """Steps that can be reused: same fingerprint and every file present and non-empty.

    wanted: (media_id, name, fingerprint); manifest adds files ARRAY<STRING>;
    files: (media_id, file, size_bytes). A task joins about per_task rows: with more rows than the
    usual partitions hold at that rate, there are more partitions, not larger ones.
    """
    rows = (manifest.select(F.greatest(F.size("files"), F.lit(1)).cast("long").alias("n")).unionByName(files.select(F.lit(1).cast("long").alias("n")))
            .agg(F.sum("n")).first()[0] or 0)
    tasks = -(-rows // per_task)
    many = tasks > int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def spread(df: DataFrame, keys: list[str]) -> DataFrame:
        return df.repartition(tasks, *keys) if many else df

    same_step, same_file = ["media_id", "name", "fingerprint"], ["media_id", "file"]
    same = spread(manifest, same_step).join(spread(wanted.select(*same_step), same_step), same_step, "left_semi")
    listed = same.select("media_id", "name", F.explode_outer("files").alias("file"))
    sized = spread(listed, same_file).join(spread(files, same_file), same_file, "left")
    found = sized.select("media_id", "name", (F.col("file").isNull() | (F.coalesce("size_bytes", F.lit(0)) > 0)).alias("found"))
    ok = spread(found, ["media_id", "name"]).groupBy("media_id", "name").agg(F.bool_and("found").alias("ok"))
    return ok.where("ok").select("media_id", "name")


def invalidate_after(manifest: DataFrame, reviewed: DataFrame, steps: tuple[str, ...]) -> DataFrame:
    """Drop artifacts of later steps than the reviewed one; reviewed: (media_id, step)."""
    rank = F.create_map(*[x for i, s in enumerate(steps) for x in (F.lit(s), F.lit(i))])
    m = manifest.join(reviewed, "media_id", "left")
    later = F.element_at(rank, F.col("name")) > F.element_at(rank, F.col("step"))
    return m.where(~F.coalesce(later, F.lit(False))).drop("step")


def uncached_synthesis(utterances: DataFrame, cache: DataFrame) -> DataFrame:
    """Utterances whose content fingerprint has no usable cached clip (over 512 bytes)."""
    return utterances.join(cache.where("size_bytes > 512").select("fingerprint"), "fingerprint", "left_anti")


def chunk_fingerprints(rows: DataFrame, keys: list[str], order: str, content: Column, width: int = 16_384) -> DataFrame:
    """SHA-256 over ordered content: bounded chunks first, then the chunk digests."""
    def digest(order_col: str, value: str) -> Column:
        rows_ = F.array_sort(F.collect_list(F.struct(F.col(order_col).alias("o"), F.col(value).alias("v"))))
        parts = F.transform(rows_, lambda r: F.concat(r["o"].cast("string"), F.lit("\x1f"), F.coalesce(r["v"], F.lit(""))))
        return F.sha2(F.array_join(parts, "\x1e"), 256)

    r = rows.select(*keys, order, content.alias("_v"), F.floor(F.col(order) / width).alias("_chunk"))
    chunks = r.groupBy(*keys, "_chunk").agg(digest(order, "_v").alias("_digest"))
    groups = chunks.withColumn("_group", F.floor(F.col("_chunk") / width)).groupBy(*keys, "_group").agg(digest("_chunk", "_digest").alias("_digest"))
    return groups.groupBy(*keys).agg(digest("_group", "_digest").alias("fingerprint"))
