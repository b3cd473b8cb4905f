"""Track matching, recognition filters and transcript measures."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.operators import tracks as T
from cuegrid.plans.overlap import overlap_pairs, overlap_totals, shared_ms
from cuegrid.workload import views
from cuegrid.workload.registry import query
from cuegrid.workload.scalars import strip_sql

# Spans of hours get buckets of hours: a span costs a row for each bucket it touches.
LONG_MS = 21_600_000

RATIO_SQL = """(least(c.end_ms, a.asr_end) - greatest(c.start_ms, a.asr_start)) / greatest(1, c.end_ms - c.start_ms, a.asr_end - a.asr_start)"""


@query("low_confidence_cues", "ocr_cues", "select media_id, cue_id from ocr_cues where coalesce(score, 1.0) < 0.88")
def low_confidence_cues(spark, sf_dir):
    return T.low_confidence(views.ocr_cues(spark, sf_dir)).select("media_id", "cue_id")


@query("asr_rescue", "ocr_cues asr_track", f"""pairs as (select c.media_id, c.cue_id, {strip_sql('a.asr_text')} t, a.asr_id, {RATIO_SQL} ratio
    from ocr_cues c join asr_track a on a.media_id = c.media_id and c.start_ms < a.asr_end and a.asr_start < c.end_ms
    where coalesce(c.score, 1.0) < 0.88 and a.asr_end > a.asr_start),
  best as (select * from pairs qualify row_number() over (partition by media_id, cue_id order by ratio desc, asr_id) = 1),
  good as (select * from best where ratio >= 0.25::double and t <> '')
  select c.media_id, c.cue_id, coalesce(g.t, c.content) as content, case when g.t is null then 0 else 1 end rescued
  from ocr_cues c left join good g using (media_id, cue_id)""")
def asr_rescue(spark, sf_dir):
    r = T.asr_rescue(views.ocr_cues(spark, sf_dir), views.asr_track(spark, sf_dir))
    return r.select("media_id", "cue_id", "content", F.col("rescued").cast("int").alias("rescued"))


@query("recover_speakers", "cues asr_track", f"""lab as (select * from asr_track where asr_speaker is not null and media_id in
    (select media_id from asr_track group by media_id having count(distinct asr_speaker) >= 2)),
  pairs as (select c.media_id, c.cue_id, a.asr_speaker, a.asr_id, {RATIO_SQL} ratio
    from cues c join lab a on a.media_id = c.media_id and c.start_ms < a.asr_end and a.asr_start < c.end_ms where a.asr_end > a.asr_start)
  select media_id, cue_id, asr_speaker speaker from (select * from pairs
    qualify row_number() over (partition by media_id, cue_id order by ratio desc, asr_id) = 1) where ratio >= 0.18::double""")
def recover_speakers(spark, sf_dir):
    return T.recover_speakers(views.cues(spark, sf_dir), views.asr_track(spark, sf_dir))


@query("speaker_reliability", "marked", """one as (select media_id, cue_id, case when media_id % 3 = 0 and speaker = 'user' then null else speaker end speaker from marked)
  select media_id, cue_id, case when media_id in (select media_id from one group by media_id having count(distinct nullif(speaker, '')) >= 2)
    then speaker end shown_speaker from one""")
def speaker_reliability(spark, sf_dir):
    c = views.marked(spark, sf_dir)
    hidden = (F.col("media_id") % 3 == 0) & (F.col("speaker") == "user")
    c = c.withColumn("speaker", F.when(~F.coalesce(hidden, F.lit(False)), F.col("speaker")))
    return T.speaker_reliability(c).select("media_id", "cue_id", "shown_speaker")


@query("cue_box_width", "cues regions", """p as (select c.media_id, c.cue_id, r.width, r.region_id,
    greatest(0, least(end_ms, region_end) - greatest(start_ms, region_start)) shared from cues c join regions r using (media_id))
  select media_id, cue_id, width box_width from p qualify row_number() over (partition by media_id, cue_id order by shared desc, region_id) = 1""")
def cue_box_width(spark, sf_dir):
    return T.cue_box_width(views.cues(spark, sf_dir), views.regions(spark, sf_dir))


@query("cue_region", "cues regions", """p as (select c.media_id, c.cue_id, r.region_id,
    greatest(0, least(end_ms, region_end) - greatest(start_ms, region_start)) shared,
    least(abs(start_ms + end_ms - 2 * region_start), abs(start_ms + end_ms - 2 * region_end)) far from cues c join regions r using (media_id))
  select media_id, cue_id, region_id, total visual_overlap_ms from (select *, sum(shared) over (partition by media_id, cue_id)::bigint total from p)
    qualify row_number() over (partition by media_id, cue_id order by shared desc, far, region_id) = 1""")
def cue_region(spark, sf_dir):
    return T.cue_region(views.cues(spark, sf_dir), views.regions(spark, sf_dir))


@query("active_cues", "cues regions", """select media_id, cue_id from cues c where exists (select 1 from regions r where r.media_id = c.media_id
    and greatest(start_ms, region_start) < least(end_ms, region_end))""")
def active_cues(spark, sf_dir):
    return T.active_cues(views.cues(spark, sf_dir), views.regions(spark, sf_dir)).select("media_id", "cue_id")


def _longer(spark, sf_dir):
    return views.intervals(spark, sf_dir).withColumn("end_ms", F.col("start_ms") + 300 * (F.col("end_ms") - F.col("start_ms")))


@query("overlapping_tracks", "intervals", """longer as (select * replace (start_ms + 300 * (end_ms - start_ms) as end_ms) from intervals)
  select a.media_id, a.seq a_seq, b.seq b_seq, least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) shared_ms
  from longer a join longer b on a.media_id = b.media_id and greatest(a.start_ms, b.start_ms) < least(a.end_ms, b.end_ms)
  where a.track = 'click' and b.track = 'view'""")
def overlapping_tracks(spark, sf_dir):
    i = _longer(spark, sf_dir)
    a = i.where("track = 'click'").select("media_id", F.col("seq").alias("a_seq"), "start_ms", "end_ms")
    b = i.where("track = 'view'").select("media_id", F.col("seq").alias("b_seq"), F.col("start_ms").alias("b_start"), F.col("end_ms").alias("b_end"))
    p = overlap_pairs(a, b, "media_id", "start_ms", "end_ms", "b_start", "b_end", width=LONG_MS)
    return p.select("media_id", "a_seq", "b_seq", shared_ms("start_ms", "end_ms", "b_start", "b_end").alias("shared_ms"))


@query("overlap_totals", "intervals", """longer as (select * replace (start_ms + 300 * (end_ms - start_ms) as end_ms) from intervals)
  select a.media_id, a.seq, count(b.seq) others, coalesce(sum(case when b.seq is not null then least(a.end_ms, b.end_ms) - greatest(a.start_ms, b.start_ms) end), 0)::bigint shared_ms
  from longer a left join longer b on a.media_id = b.media_id and greatest(a.start_ms, b.start_ms) < least(a.end_ms, b.end_ms) and a.track <> b.track group by all""")
def track_overlap_totals(spark, sf_dir):
    """How many events of other types each event overlaps, and for how long in total."""
    i = _longer(spark, sf_dir)
    every = overlap_totals(i, i, ("media_id",), ("seq",))
    own = overlap_totals(i, i, ("media_id", "track"), ("seq",))
    both = every.join(own.select("media_id", "seq", F.col("others").alias("same"), F.col("shared_ms").alias("same_ms")), ["media_id", "seq"])
    return both.select("media_id", "seq", (F.col("others") - F.col("same")).alias("others"), (F.col("shared_ms") - F.col("same_ms")).alias("shared_ms"))


@query("translation_context", "cues", """r as (select media_id, cue_id, row_number() over (partition by media_id order by cue_id) rank from cues),
  b as (select media_id, (rank - 1) // 30 batch_no, min(rank) lo, max(rank) hi from r group by all)
  select b.media_id, b.batch_no, r.cue_id, case when r.rank between lo and hi then 1 else 0 end in_batch
  from b join r on r.media_id = b.media_id and r.rank between b.lo - 6 and b.hi + 4""")
def translation_context(spark, sf_dir):
    c = T.translation_context(views.cues(spark, sf_dir))
    return c.select("media_id", "batch_no", "cue_id", F.col("in_batch").cast("int").alias("in_batch"))


def _recognised(spark, sf_dir):
    """Whole texts, and generated lines of one or two characters between them."""
    s = views.ocr_samples(spark, sf_dir)
    n = F.col("seq")
    short = s.where(n % 3 == 0).select("media_id", (n + 10_000_000_000).alias("seq"), F.substring(F.lit("ab"), 1, (n % 2 + 1).cast("int")).alias("text"), ((F.col("score_pct") + n) % 100).alias("score_pct"))
    both = s.select("media_id", "seq", "text", "score_pct").unionByName(short)
    return both.select("media_id", n.alias("cue_id"), "text", ((70 + F.col("score_pct") % 31) / 100).alias("score"), (1 + n % 3).alias("samples"))


OCR_SQL = """seen as (select media_id, seq, text, score_pct from ocr_samples
    union all select media_id, seq + 10000000000, substr('ab', 1, cast(seq % 2 + 1 as int)), (score_pct + seq) % 100 from ocr_samples where seq % 3 = 0),
  recognised as (select media_id, seq cue_id, text, (70 + score_pct % 31) / 100 score, 1 + seq % 3 samples from seen),
  stable as (select * from recognised where samples >= 2 or score >= 0.94::double and length(text) <= 2),
  kept as (select * from stable where media_id in (select media_id from stable group by media_id having count(*) >= 40)),
  cand as (select media_id, cue_id, unnest(range(3)) sample_no from recognised),
  scans as (select media_id, cue_id, sample_no, 'scan' || sample_no as text, (75 + (cue_id * 7 + sample_no * 5) % 25) / 100 score from cand),
  best as (select media_id, cue_id, score b_score, text b_text from scans
    qualify row_number() over (partition by media_id, cue_id order by score desc, sample_no) = 1),
  refined as (select k.media_id, k.cue_id, k.score < 0.88::double and b_score >= k.score + 0.06::double refined, k.text, k.score, k.samples, b_text, b_score
    from kept k join best using (media_id, cue_id))"""


@query("ocr_keep_filter", "ocr_samples", OCR_SQL + " select media_id, cue_id from kept")
def ocr_keep_filter(spark, sf_dir):
    return T.keep_recognised(_recognised(spark, sf_dir), 40).select("media_id", "cue_id")


def _refined(spark, sf_dir):
    raw = _recognised(spark, sf_dir)
    kept = T.keep_recognised(raw, 40)
    n = F.col("sample_no")
    scans = raw.select("media_id", "cue_id", F.explode(F.sequence(F.lit(0), F.lit(2))).alias("sample_no")).select(
        "media_id", "cue_id", "sample_no", F.concat(F.lit("scan"), n.cast("string")).alias("text"),
        ((75 + (F.col("cue_id") * 7 + n * 5) % 25) / 100).alias("score"))
    return raw, kept, T.refine_cues(kept, scans)


@query("refine_cues", "ocr_samples", OCR_SQL + """ select media_id, cue_id, case when refined then b_text else text end as text,
  case when refined then greatest(samples, 3) else samples end samples, cast(round(case when refined then b_score else score end * 100) as bigint) score_pct from refined""")
def refine_cues(spark, sf_dir):
    c = _refined(spark, sf_dir)[2]
    return c.select("media_id", "cue_id", "text", "samples", F.round(F.col("score") * 100).cast("long").alias("score_pct"))


@query("ocr_report", "ocr_samples", OCR_SQL + """ select r.media_id, raw_cues, coalesce(k.cues, 0) cues, coalesce(k.low_before, 0)::bigint low_before,
  coalesce(f.low_after, 0)::bigint low_after, coalesce(f.refined_count, 0)::bigint refined_count, coalesce(f.mean_pct, 0) mean_e9 from
    (select media_id, count(*) raw_cues from recognised group by media_id) r
    left join (select media_id, count(*) cues, sum(case when score < 0.88::double then 1 else 0 end) low_before from kept group by media_id) k using (media_id)
    left join (select media_id, sum(case when case when refined then b_score else score end < 0.88::double then 1 else 0 end) low_after,
      sum(case when refined then 1 else 0 end) refined_count, cast(round(avg(case when refined then b_score else score end) * 1000000000) as bigint) mean_pct
      from refined group by media_id) f using (media_id)""")
def ocr_report(spark, sf_dir):
    r = T.ocr_report(*_refined(spark, sf_dir))
    return r.select("media_id", "raw_cues", "cues", "low_before", "low_after", "refined_count", F.round(F.col("mean_score") * 1_000_000_000).cast("long").alias("mean_e9"))


@query("best_ocr_line", "boxes", """c as (select media_id, ts_ms // 1000 frame, seq, case when seq % 3 = 0 then 'plain, text' else '第' || repeat('字', cast(seq % 20 as int)) || '，！' end as text,
    x - 250 x_min, x - 250 + w x_max, score_pct / 100 score from boxes),
  p as (select *, regexp_replace(text, '[\\s，。！？,.!?]', '', 'g') plain, greatest(0, 1 - abs(x_min + (x_max - x_min) / 2 - 640) / 640) centre from c),
  k as (select *, score + centre * 0.12::double + least(length(plain), 18) * 0.004::double rank from p where regexp_matches(plain, '[\\x{3400}-\\x{9FFF}]') and centre >= 0.45::double)
  select media_id, frame, plain as text, cast(round(score * 100) as bigint) score_pct from k
    qualify row_number() over (partition by media_id, frame order by rank desc, seq) = 1""")
def best_ocr_line(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    text = F.when(F.col("seq") % 3 == 0, "plain, text").otherwise(
        F.concat(F.lit("第"), F.repeat(F.lit("字"), (F.col("seq") % 20).cast("int")), F.lit("，！")))
    c = b.select("media_id", F.floor(F.col("ts_ms") / 1000).alias("ts_ms"), F.col("seq").alias("line_no"), text.alias("text"),
                 (F.col("x") - 250).alias("x_min"), (F.col("x") - 250 + F.col("w")).alias("x_max"),
                 (F.col("score_pct") / 100).alias("score"), F.lit(1280).alias("crop_width"))
    return T.best_ocr_lines(c).select("media_id", F.col("ts_ms").alias("frame"), "text", F.round(F.col("score") * 100).cast("long").alias("score_pct"))


def _durations(spark, sf_dir):
    i = views.intervals(spark, sf_dir)
    return i.groupBy("media_id").agg(F.max("end_ms").alias("duration_ms")).withColumn("duration_ms", F.col("duration_ms") - 3_600_000)


def _interval_words(spark, sf_dir):
    return views.intervals(spark, sf_dir).withColumnRenamed("track", "word")


METRICS_SQL = """d as (select media_id, max(end_ms) - 3600000 duration_ms from intervals group by media_id),
  v as (select *, greatest(0, start_ms) s, least(duration_ms, end_ms) e from intervals join d using (media_id) where end_ms > start_ms),
  m as (select media_id, s, e, max(e) over (partition by media_id order by s, e rows between unbounded preceding and 1 preceding) reach from v where e > s),
  u as (select media_id, sum(greatest(0, e - greatest(s, coalesce(reach, s))))::bigint speech_ms from m group by media_id),
  n as (select media_id, count(*) words, sum(length(track))::bigint units from v group by media_id),
  metrics as (select d.media_id, duration_ms, coalesce(speech_ms, 0) speech_ms, coalesce(units, 0) units, coalesce(words, 0) words
    from d left join u using (media_id) left join n using (media_id))"""


@query("transcript_metrics", "intervals", METRICS_SQL + " select media_id, speech_ms, units, words, cast(floor(1000000000 * (speech_ms / duration_ms)) as bigint) coverage_ppb from metrics")
def transcript_metrics(spark, sf_dir):
    m = T.transcript_metrics(_interval_words(spark, sf_dir), _durations(spark, sf_dir))
    return m.select("media_id", "speech_ms", "units", "words", F.floor(1_000_000_000 * F.col("coverage")).cast("long").alias("coverage_ppb"))


@query("sparse_transcripts", "cues", """w as (select media_id, content word, start_ms, start_ms + 60 e from cues
    union all select -1 - media_id, case when cue_id > 2 then '' else 'x' end, start_ms, start_ms + 60 from cues),
  m as (select media_id, max(start_ms) duration_ms, sum(case when trim(word) <> '' then 60 else 0 end) ms, sum(length(replace(word, ' ', ''))) units from w group by media_id)
  select media_id from m where duration_ms >= 30000 and ms < greatest(750, duration_ms * 0.015::double) and units < 4""")
def sparse_transcripts(spark, sf_dir):
    """The transcripts of all media, and one nearly silent generated medium for each."""
    c = views.cues(spark, sf_dir)
    silent = c.select((-1 - F.col("media_id")).alias("media_id"), F.when(F.col("cue_id") > 2, "").otherwise("x").alias("content"), "start_ms")
    words = c.select("media_id", "content", "start_ms").unionByName(silent).select("media_id", F.col("content").alias("word"), "start_ms", (F.col("start_ms") + 60).alias("end_ms"))
    d = words.groupBy("media_id").agg(F.max("start_ms").alias("duration_ms"))
    return T.sparse_transcripts(T.transcript_metrics(words, d)).select("media_id")


@query("best_attempt", "words", """m as (select media_id, pos % 3 attempt, sum(length(word)) units, sum(end_ms - start_ms) ms from words group by all)
  select media_id, attempt from m qualify row_number() over (partition by media_id order by units desc, ms desc, attempt) = 1""")
def best_attempt(spark, sf_dir):
    w = views.words(spark, sf_dir).groupBy("media_id", (F.col("pos") % 3).alias("attempt")).agg(
        F.sum(F.length("word")).alias("units"), F.sum(F.col("end_ms") - F.col("start_ms")).alias("speech_ms"))
    return T.best_attempt(w)


@query("majority_speaker", "words", """n as (select media_id, pos // 8 cue_id, speaker, count(*) n from words group by all)
  select media_id, cue_id, case when speaker is null then null else speaker end majority from n
    qualify row_number() over (partition by media_id, cue_id order by speaker is null, n desc, speaker) = 1""")
def majority_speaker(spark, sf_dir):
    w = views.words(spark, sf_dir).withColumn("cue_id", F.floor(F.col("pos") / 8))
    return T.majority_speaker(w, "media_id", "cue_id")
