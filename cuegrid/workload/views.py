"""Timed-dialogue tables derived from the driver tables, in Spark and in check SQL.

The Spark side stores each derived table once per session in the shared
folder, as a media pipeline would store its ingested tables; a changed source
file gives a new copy.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.plans.scan import Run, Sequence, numbered, ranked_by, running
from cuegrid.plans.store import as_table, source_stamp

CUE_WIDTH = 16_384
CUES = Sequence(("media_id",), ("cue_id",), CUE_WIDTH)
EVENTS = Sequence(("media_id",), ("seq",), 262_144)
WORDS = Sequence(("media_id",), ("pos",), 131_072)

_stored: dict[tuple, DataFrame] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _once(spark: SparkSession, sf_dir: str, name: str, source: str, build) -> DataFrame:
    key = (spark.sparkContext.applicationId, sf_dir, name, source_stamp(spark, f"{sf_dir}/{source}.parquet"))
    if key not in _stored:
        _stored[key] = as_table(build(), name)
    return _stored[key]


def _build_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("media_id"), "turn", F.col("role").alias("speaker"),
        F.split(F.trim("text"), r"\s+").alias("words"),
    ).withColumn("n", F.ceil(F.size("words") / 6).cast("long"))
    turns = running(turns, Sequence(("media_id",), ("turn",), 4_096), {"before": Run("sum", F.col("n"), exclusive=True)})
    lines = F.transform(
        F.sequence(F.lit(0), F.col("n").cast("int") - 1),
        lambda k: F.array_join(F.slice("words", k * 6 + 1, 6), " "),
    )
    cues = turns.select("media_id", "speaker", "before", F.posexplode(lines).alias("k", "content"))
    cues = cues.select(
        "media_id", (F.col("before") + F.col("k") + 1).alias("cue_id"), "speaker", "content",
        F.length("content").alias("n_chars"),
    )
    cues = cues.withColumn("dur_ms", (350 + 45 * F.col("n_chars")).cast("long"))
    cues = cues.withColumn(
        "gap_ms",
        F.when(F.col("cue_id") % 13 == 0, 2600).when(F.col("cue_id") % 7 == 0, 700)
        .otherwise((F.col("media_id") * 31 + F.col("cue_id") * 17) % 500).cast("long"),
    )
    cues = running(cues, CUES, {"end_ms": Run("sum", F.col("dur_ms") + F.col("gap_ms"))})
    return cues.select(
        "media_id", "cue_id", "speaker", "content", "n_chars",
        (F.col("end_ms") - F.col("dur_ms")).alias("start_ms"), "end_ms",
    )


def cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "cues", "conversations", lambda: _build_cues(spark, sf_dir))


# Endings that give the lines every kind of punctuation the rules look at.
LINE_TAILS = ("", ".", "?", "!", ",", ";", "…", "...", '."', " ")
SOURCE_TAILS = ("吗", "？", "。", "，", "！", "…", "", "...", "呢")


def marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cues with varied endings, fragments and blanks between them, and a source line for each.

    Every cue is there as a whole, with an even number; odd numbers are generated lines.
    """
    c = cues(spark, sf_dir)
    n = F.col("cue_id")
    pick = lambda values, by: F.element_at(F.array(*[F.lit(v) for v in values]), (n % by + 1).cast("int"))
    short = F.when(n % 15 == 0, F.substring("content", 1, 2)).when(n % 16 == 0, "").when(n % 18 == 0, " -- ").when(n % 25 == 4, "\u3000\u00a0")
    shown = F.when(n % 21 != 4, F.when(n % 29 == 7, "").otherwise(F.col("speaker")))
    source = F.concat(F.lit("原话"), pick(SOURCE_TAILS, 9))
    own = c.select("media_id", (2 * n).alias("cue_id"), "start_ms", "end_ms", shown.alias("speaker"), F.concat("content", pick(LINE_TAILS, 10)).alias("content"), source.alias("source"))
    more = c.select("media_id", (2 * n + 1).alias("cue_id"), F.col("end_ms").alias("start_ms"), (F.col("end_ms") + 20).alias("end_ms"), shown.alias("speaker"), short.alias("content"), source.alias("source"))
    return own.unionByName(more.where("content is not null"))


def asr_track(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A second track over the same media, shifted so that spans cross."""
    c = cues(spark, sf_dir)
    return c.select(
        "media_id", F.col("cue_id").alias("asr_id"),
        (F.col("start_ms") + (F.col("cue_id") * 37) % 7 * 220 - 500).alias("asr_start"),
        (F.col("end_ms") + (F.col("cue_id") * 53) % 5 * 260 - 450).alias("asr_end"),
        F.when(F.col("cue_id") % 9 == 0, F.lit("  ")).otherwise(F.concat(F.lit("heard "), "content")).alias("asr_text"),
        F.when(F.col("cue_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("speaker")).alias("asr_speaker"),
    )


def ocr_cues(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cues(spark, sf_dir)
    pct = 60 + (F.col("media_id") * 7 + F.col("cue_id") * 13) % 41
    return c.select(
        "media_id", "cue_id", "start_ms", "end_ms", "content",
        F.when(F.col("cue_id") % 17 == 0, F.lit(None).cast("double")).otherwise(pct / 100).alias("score"),
        (1 + F.col("cue_id") % 3).alias("samples"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of a cue share its time evenly; every fifth label or so is wrong or missing."""
    c = cues(spark, sf_dir).withColumn("w", F.split("content", " ")).withColumn("n", F.size("w"))
    span = F.col("end_ms") - F.col("start_ms")
    w = c.select("*", F.posexplode("w").alias("i", "word"))
    pos = F.col("cue_id") * 8 + F.col("i")
    return w.select(
        "media_id", pos.alias("pos"), "word",
        (F.col("start_ms") + F.floor(span * F.col("i") / F.col("n"))).cast("long").alias("start_ms"),
        (F.col("start_ms") + F.floor(span * (F.col("i") + 1) / F.col("n"))).cast("long").alias("end_ms"),
        F.when(pos % 11 == 3, F.when(F.col("speaker") == "user", "assistant").otherwise("user"))
        .when(pos % 19 == 5, F.lit(None).cast("string")).otherwise(F.col("speaker")).alias("speaker"),
    )


def with_durations(df: DataFrame) -> DataFrame:
    """(media_id, duration_ms) of the media of df; some end before their last row."""
    return df.select("media_id").distinct().withColumn("duration_ms", 6_000 + F.col("media_id") * 977 % 90_000)


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region per five cues; some cues fall between regions."""
    c = cues(spark, sf_dir).withColumn("region_id", F.floor(F.col("cue_id") / 5).cast("long"))
    r = c.groupBy("media_id", "region_id").agg(F.min("start_ms").alias("lo"), F.max("end_ms").alias("hi"))
    i = F.col("region_id")
    return r.select(
        "media_id", "region_id", (F.col("lo") + 900).alias("region_start"), (F.col("hi") - (i % 3) * 1700).alias("region_end"),
        (200 + i * 37 % 150).alias("x"), (540 + i * 11 % 60).alias("y"),
        (600 + i * 29 % 250).alias("width"), (50 + i % 23).alias("height"), (40 + i * 7 % 60).alias("confidence_pct"),
    ).where("region_end > region_start")


def epoch_ms(column: str):
    return F.expr(f"timestampdiff(MILLISECOND, timestamp_ntz'1970-01-01 00:00:00', {column})")


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = epoch_ms("ts")
    return table(spark, sf_dir, "events").select(
        F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), F.col("event_type").alias("track"),
        start.alias("start_ms"), (start + F.floor(F.col("value") * 1000)).cast("long").alias("end_ms"),
    )


def _ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("media_id"), F.col("event_id").alias("seq"), "event_type", "value")
    return numbered(e, EVENTS, "rank")


def ranked_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "ranked_events", "events", lambda: _ranked_events(spark, sf_dir))


def ocr_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_events(spark, sf_dir).select(
        "media_id", "seq", (F.col("rank") * 400).alias("ts_ms"), F.col("event_type").alias("text"),
        (F.floor(F.col("value") * 100) % 100).cast("long").alias("score_pct"),
    )


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("seq")
    return ranked_events(spark, sf_dir).select(
        "media_id", (F.col("rank") * 250).alias("ts_ms"), "seq",
        (300 + i * 37 % 200).alias("x"), (560 + i * 13 % 90).alias("y"),
        (400 + i * 7 % 300).alias("w"), (40 + i % 25).alias("h"), (40 + i * 11 % 60).alias("score_pct"),
    )


def _build_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Position in the batch by order date, then key."""
    o = table(spark, sf_dir, "orders")
    o = ranked_by(o, ("o_custkey",), [F.col("o_orderdate"), F.col("o_orderkey")], "position")
    key = F.col("o_orderkey")
    return o.select(
        key.alias("job_id"), F.col("o_custkey").alias("batch_id"), "position",
        F.when(F.col("o_orderstatus") == "F", "done")
        .when(F.col("o_orderstatus") == "O", F.when(key % 5 == 0, "failed").otherwise("queued"))
        .otherwise("running").alias("status"),
        F.concat(F.lit("ep-"), key.cast("string"), F.lit(".mp4")).alias("filename"),
        F.col("o_orderdate").alias("created_at"), (key % 5).cast("long").alias("retry_count"),
        F.floor("o_totalprice").cast("long").alias("size_bytes"), F.col("o_orderpriority").alias("priority"),
    )


def jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _once(spark, sf_dir, "jobs", "orders", lambda: _build_jobs(spark, sf_dir))


def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        c.alias("batch_id"),
        F.when(c % 11 == 0, "uploading").when(c % 13 == 0, "done").otherwise("running").alias("batch_status"),
        (c % 3 != 0).alias("dub"), (c % 2 == 0).alias("burn_subtitles"), (10 + c % 4).cast("long").alias("expected_episodes"),
        F.col("c_mktsegment").alias("channel_name"), (c % 100).cast("long").alias("opacity_pct"),
    )


def usage_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("media_id"),
        F.concat(F.lit("m"), (F.col("l_partkey") % 4).cast("string"), F.when(F.col("l_partkey") % 2 == 0, "-pro").otherwise("")).alias("model"),
        F.floor(F.col("l_quantity") * 40).cast("long").alias("prompt_tokens"),
        F.floor(F.col("l_quantity") * 10).cast("long").alias("hit_tokens"),
        F.floor(F.col("l_extendedprice") / 100).cast("long").alias("completion_tokens"),
    )


# The same tables for the check SQL.
DUCK: dict[str, tuple[tuple[str, ...], str]] = {
    "cues": ((), r"""
  with_words as (select conv_id, turn, role, unnest(string_split_regex(trim(text), '\s+')) word,
    generate_subscripts(string_split_regex(trim(text), '\s+'), 1) - 1 p from conversations),
  grouped as (select conv_id, turn, role, cast(floor(p / 6) as int) k, string_agg(word, ' ' order by p) content
    from with_words group by all),
  ordered as (select conv_id, row_number() over (partition by conv_id order by turn, k) cue_id, role speaker,
    content, length(content) n_chars from grouped),
  gaps as (select *, 350 + 45 * n_chars dur_ms, case when cue_id % 13 = 0 then 2600 when cue_id % 7 = 0 then 700
    else (conv_id * 31 + cue_id * 17) % 500 end gap_ms from ordered),
  cues as materialized (select conv_id media_id, cue_id, speaker, content, n_chars,
    cast(sum(dur_ms + gap_ms) over (partition by conv_id order by cue_id) - dur_ms as bigint) start_ms,
    cast(sum(dur_ms + gap_ms) over (partition by conv_id order by cue_id) as bigint) end_ms from gaps)"""),
    "marked": (("cues",), """
  lined as (select *, case when cue_id % 21 = 4 then null when cue_id % 29 = 7 then '' else speaker end shown,
    '原话' || ['吗', '？', '。', '，', '！', '…', '', '...', '呢'][cue_id % 9 + 1] source,
    case when cue_id % 15 = 0 then substr(content, 1, 2) when cue_id % 16 = 0 then '' when cue_id % 18 = 0 then ' -- ' when cue_id % 25 = 4 then chr(12288) || chr(160) end short from cues),
  marked as (select media_id, 2 * cue_id cue_id, start_ms, end_ms, shown speaker,
      content || ['', '.', '?', '!', ',', ';', '…', '...', '."', ' '][cue_id % 10 + 1] as content, source from lined
    union all select media_id, 2 * cue_id + 1, end_ms, end_ms + 20, shown, short, source from lined where short is not null)"""),
    "asr_track": (("cues",), """
  asr_track as (select media_id, cue_id asr_id, start_ms + (cue_id * 37) % 7 * 220 - 500 asr_start,
    end_ms + (cue_id * 53) % 5 * 260 - 450 asr_end, case when cue_id % 9 = 0 then '  ' else 'heard ' || content end asr_text,
    case when cue_id % 4 = 0 then null else speaker end asr_speaker from cues)"""),
    "ocr_cues": (("cues",), """
  ocr_cues as (select media_id, cue_id, start_ms, end_ms, content,
    case when cue_id % 17 = 0 then null else (60 + (media_id * 7 + cue_id * 13) % 41) / 100 end score,
    1 + cue_id % 3 samples from cues)"""),
    "words": (("cues",), """
  split_words as (select *, unnest(string_split(content, ' ')) word,
    generate_subscripts(string_split(content, ' '), 1) - 1 i, len(string_split(content, ' ')) n from cues),
  words as materialized (select media_id, cue_id * 8 + i pos, word,
    cast(start_ms + floor((end_ms - start_ms) * i / n) as bigint) start_ms,
    cast(start_ms + floor((end_ms - start_ms) * (i + 1) / n) as bigint) end_ms,
    case when (cue_id * 8 + i) % 11 = 3 then case when speaker = 'user' then 'assistant' else 'user' end
      when (cue_id * 8 + i) % 19 = 5 then null else speaker end speaker from split_words)"""),
    "regions": (("cues",), """
  region_spans as (select media_id, cast(floor(cue_id / 5) as bigint) region_id, min(start_ms) lo, max(end_ms) hi
    from cues group by all),
  regions as (select media_id, region_id, lo + 900 region_start, hi - (region_id % 3) * 1700 region_end,
    200 + region_id * 37 % 150 x, 540 + region_id * 11 % 60 y, 600 + region_id * 29 % 250 width,
    50 + region_id % 23 height, 40 + region_id * 7 % 60 confidence_pct from region_spans
    where hi - (region_id % 3) * 1700 > lo + 900)"""),
    "intervals": ((), """
  intervals as (select user_id media_id, event_id seq, event_type track, epoch_us(ts) // 1000 start_ms,
    cast(epoch_us(ts) // 1000 + floor(value * 1000) as bigint) end_ms from events)"""),
    "ranked_events": ((), """
  ranked_events as (select user_id media_id, event_id seq, event_type, value,
    row_number() over (partition by user_id order by event_id) rank from events)"""),
    "ocr_samples": (("ranked_events",), """
  ocr_samples as (select media_id, seq, rank * 400 ts_ms, event_type as text,
    cast(floor(value * 100) as bigint) % 100 score_pct from ranked_events)"""),
    "boxes": (("ranked_events",), """
  boxes as (select media_id, rank * 250 ts_ms, seq, 300 + seq * 37 % 200 x, 560 + seq * 13 % 90 y,
    400 + seq * 7 % 300 w, 40 + seq % 25 h, 40 + seq * 11 % 60 score_pct from ranked_events)"""),
    "jobs": ((), """
  jobs as (select o_orderkey job_id, o_custkey batch_id,
    row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as position,
    case o_orderstatus when 'F' then 'done' when 'O' then case when o_orderkey % 5 = 0 then 'failed' else 'queued' end
      else 'running' end status,
    concat('ep-', cast(o_orderkey as varchar), '.mp4') filename, o_orderdate created_at, o_orderkey % 5 retry_count,
    cast(floor(o_totalprice) as bigint) size_bytes, o_orderpriority priority from orders)"""),
    "batches": ((), """
  batches as (select c_custkey batch_id, case when c_custkey % 11 = 0 then 'uploading' when c_custkey % 13 = 0 then 'done'
      else 'running' end batch_status, c_custkey % 3 <> 0 dub, c_custkey % 2 = 0 burn_subtitles,
    10 + c_custkey % 4 expected_episodes, c_mktsegment channel_name, c_custkey % 100 opacity_pct from customer)"""),
    "usage_events": ((), """
  usage_events as (select l_orderkey media_id, concat('m', cast(l_partkey % 4 as varchar),
      case when l_partkey % 2 = 0 then '-pro' else '' end) model,
    cast(floor(l_quantity * 40) as bigint) prompt_tokens, cast(floor(l_quantity * 10) as bigint) hit_tokens,
    cast(floor(l_extendedprice / 100) as bigint) completion_tokens from lineitem)"""),
}


def check_sql(names: str, body: str, recursive: bool = False) -> str:
    """WITH the named derived tables (and what they build on) in front of body.

    body starts either with 'select' or with further 'name as (...)' entries.
    """
    wanted: list[str] = []

    def need(name: str) -> None:
        for other in DUCK[name][0]:
            need(other)
        if name not in wanted:
            wanted.append(name)

    for name in names.split():
        need(name)
    views = ",".join(DUCK[n][1] for n in wanted)
    body = body.strip()
    more = "" if body.lower().startswith("select") or not views else ","
    word = "with recursive" if recursive else "with"
    return f"{word} {views}{more}\n{body}" if views else (body if body.lower().startswith("select") else f"{word} {body}")
