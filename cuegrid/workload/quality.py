"""Quality rules over derived deliverables."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.operators import quality as Q
from cuegrid.operators import sequence as S
from cuegrid.plans.scan import Sequence, numbered
from cuegrid.plans.store import cut
from cuegrid.workload import views
from cuegrid.workload.registry import query
from cuegrid.workload.scalars import WORDS_SQL, ignorable_sql, strip_sql


def deliverable(spark, sf_dir):
    """Translated lines with all kinds of defects; pos is their list order."""
    i = F.col("cue_id")
    c = views.marked(spark, sf_dir)
    c = c.withColumn("content", F.when(i % 37 == 0, F.concat("content", "source")).when(i % 26 == 3, "Thôi đi.").when(i % 26 == 4, " thôi ĐI. ").otherwise(F.col("content")))
    c = c.withColumn("end_ms", F.when(i % 41 == 0, F.col("start_ms")).otherwise(F.col("end_ms")))
    return numbered(c, views.CUES, "pos")


DELIVERABLE_SQL = """lines as (select media_id, cue_id, start_ms, case when cue_id % 41 = 0 then start_ms else end_ms end end_ms,
    case when cue_id % 37 = 0 then content || source when cue_id % 26 = 3 then 'Thôi đi.' when cue_id % 26 = 4 then ' thôi ĐI. ' else content end as content,
    row_number() over (partition by media_id order by cue_id) pos from marked),
  wanted as (select media_id, cue_id item_id from marked union all select media_id, cue_id + 1 from marked where media_id % 10 = 7 and cue_id % 100 = 18),
  expected as (select media_id, item_id, row_number() over (partition by media_id order by item_id) rank from wanted)"""


def expected_ids(spark, sf_dir):
    """The lines of the deliverable, and generated ones that it lacks."""
    lines = views.marked(spark, sf_dir).select("media_id", F.col("cue_id").alias("item_id"))
    lost = lines.where("media_id % 10 = 7 and item_id % 100 = 18").withColumn("item_id", F.col("item_id") + 1)
    return numbered(lines.unionByName(lost), Sequence(("media_id",), ("item_id",)), "rank")


CUE_SQL = f"""judged as (select l.media_id, l.cue_id, l.pos, {strip_sql('l.content')} bare, l.content, l.start_ms, l.end_ms,
    {ignorable_sql('s.content', '(s.end_ms - s.start_ms)')} noise, lag(lower({strip_sql('l.content')})) over (partition by l.media_id order by l.pos) said
    from lines l left join marked s using (media_id, cue_id)),
  cue_bad as (select media_id, cue_id, unnest([case when bare = '' and not coalesce(noise, false) then 'empty_lines' end, case when bare = '' and noise then 'empty_noise' end,
      case when regexp_matches(content, '[\\x{{3400}}-\\x{{9FFF}}]') then 'untranslated_text' end, case when start_ms < 0 or end_ms <= start_ms then 'subtitle_timing' end,
      case when lower(bare) = said and length(bare) > 4 then 'adjacent_repetition' end,
      case when {WORDS_SQL.format('content')} <= 2 and ends_with(bare, '.') then 'orphan_fragments' end]) as name from judged)"""


@query("qa_findings", "marked", DELIVERABLE_SQL + "," + CUE_SQL + " select media_id, name, cue_id item_id from cue_bad where name is not null")
def qa_findings(spark, sf_dir):
    return Q.findings(Q.cue_flags(deliverable(spark, sf_dir), views.marked(spark, sf_dir))).select("media_id", "name", "item_id")


@query("qa_first_ids", "marked", DELIVERABLE_SQL + "," + CUE_SQL + """ select media_id, name, string_agg(cue_id, ',' order by cue_id) ids from (select * from cue_bad
    where name is not null qualify row_number() over (partition by media_id, name order by cue_id) <= 20 or name in ('empty_lines', 'subtitle_timing')) group by all""")
def qa_first_ids(spark, sf_dir):
    f = Q.first_findings(Q.findings(Q.cue_flags(deliverable(spark, sf_dir), views.marked(spark, sf_dir))))
    return f.select("media_id", "name", F.array_join(F.transform("ids", lambda i: i.cast("string")), ",").alias("ids"))


def inputs(spark, sf_dir) -> dict:
    """Every table the rules read; a different tenth of the media lacks each optional one."""
    m, i = F.col("media_id"), F.col("cue_id")
    lines = cut(deliverable(spark, sf_dir))
    group = F.floor((i - 1) / 3)
    kept = lines.where((m % 8 != 3) | (i != 2))
    grouped = lines.withColumn("g", group)
    timing = grouped.where(m % 10 != 1).groupBy("media_id", "g").agg(F.min("cue_id").alias("utterance_id"))
    u = F.col("utterance_id")
    timing = timing.select(
        "media_id", "utterance_id", ((900 + u * 37 % 300) / 1000).alias("tempo"), (u * 53 % 200 - (m % 3) * 60).alias("overflow_ms"),
        (u * 71 % 15_000 - (m % 2) * 1500).alias("source_span_ms"), (u * 29 % 900 - (m % 4) * 50).alias("max_internal_gap_ms"),
        F.when((u % 59 == 1) & (m % 2 == 0), "sentence_group").otherwise(Q.ALIGNED).alias("alignment_mode"), F.when(u % 43 == 1, -5).otherwise(10).alias("schedule_shift_ms"))
    timing_ids = numbered(kept.where(m % 10 != 1).select("media_id", F.col("cue_id").alias("item_id")), Sequence(("media_id",), ("item_id",)), "rank")
    aligned = lines.where(m % 10 != 2).withColumn("start_ms", F.when((i % 61 == 5) & (m % 3 == 0), F.col("start_ms") - 5000).otherwise(F.col("start_ms")))
    aligned = aligned.withColumn("end_ms", F.when((m % 4 == 1) & (F.col("end_ms") <= F.col("start_ms")), F.col("start_ms")).otherwise(F.greatest(F.col("end_ms"), F.col("start_ms") + 1)))
    display = lines.where(m % 10 != 4).select("media_id", "cue_id", "pos", F.col("content").alias("line"))
    spoken = grouped.where(m % 10 != 4).groupBy("media_id", "g").agg(
        F.min("cue_id").alias("utterance_id"), S.joined_text("cue_id", F.upper("content")).alias("full_text"), S.id_list("cue_id").alias("cue_ids"))
    spoken = spoken.withColumn("full_text", F.when((u % 31 == 1) & (m % 2 == 1), F.concat("full_text", F.lit(" thêm"))).otherwise(F.concat("full_text", F.lit("!"))))
    r = views.regions(spark, sf_dir).where(m % 10 != 5)
    k = F.col("region_id")
    regions = r.select(
        "media_id", F.when(m % 7 != 6, k).alias("region_id"), F.when(m % 6 == 5, "lower_band_fallback").otherwise("visual_tracks_v2").alias("method"),
        "x", "y", F.when((k % 17 == 3) & (m % 5 == 1), 0).otherwise(F.col("width")).alias("width"), "height",
        F.when(m % 2 == 0, 0.6).otherwise(F.col("confidence_pct") / 100).alias("confidence"), F.col("region_start").alias("start"), F.col("region_end").alias("end"),
        F.lit(1280).alias("video_width"), F.lit(720).alias("video_height"))
    layout = lines.where(m % 10 != 6).select(
        "media_id", "cue_id", F.when((i % 83 == 2) & (m % 2 == 0), "").otherwise("Sans").alias("font"), (14 + i % 66 + F.when((m % 4 == 3) & (i % 66 == 65), 10).otherwise(0)).alias("font_size"), (1 + i % 2).alias("line_count"),
        F.struct(F.lit(100).alias("x"), F.lit(500).alias("y"), (600 + i % 50).alias("width"), F.lit(90).alias("height"), F.lit(12).alias("radius")).alias("background"),
        F.struct(F.lit(110).alias("x"), F.lit(510).alias("y"), F.when(m % 3 == 1, 591).otherwise(580).alias("width"), F.lit(60).alias("height")).alias("region"))
    media = views.cues(spark, sf_dir).select("media_id").distinct()
    probe = media.where(m % 10 != 8).select("media_id", (m % 9 * 1000).alias("duration_ms"), (m % 4 != 2).alias("has_audio"), F.lit(True).alias("has_video"))
    masters = media.where(m % 10 != 4).select("media_id", F.when(m % 9 == 2, "provider offline").alias("warning"))
    return dict(cues=lines, expected=expected_ids(spark, sf_dir), source=views.marked(spark, sf_dir), timing=timing, timing_ids=timing_ids,
                aligned=aligned, utterances=spoken, utterance_ids=numbered(display.select("media_id", F.col("cue_id").alias("item_id")), Sequence(("media_id",), ("item_id",)), "rank"),
                display=display, masters=masters, regions=regions, layout=layout, probe=probe)


QA_SQL = DELIVERABLE_SQL + "," + CUE_SQL + r""",
  media as (select distinct media_id from marked),
  cue_n as (select media_id, name, count(*) n from cue_bad where name is not null group by all),
  cue_v as (select m.media_id, r.name, case when coalesce(n, 0) > 0 then sev else 'pass' end severity, coalesce(n, 0) bad from media m
    cross join (values ('untranslated_text', 'error'), ('subtitle_timing', 'error'), ('adjacent_repetition', 'warning'), ('orphan_fragments', 'warning')) r(name, sev)
    left join cue_n c on c.media_id = m.media_id and c.name = r.name),
  empty_v as (select m.media_id, 'empty_lines' as name, case when e.n > 0 then 'error' when w.n > 0 then 'warning' else 'pass' end severity, case when e.n > 0 then e.n else coalesce(w.n, 0) end bad
    from media m left join cue_n e on e.media_id = m.media_id and e.name = 'empty_lines' left join cue_n w on w.media_id = m.media_id and w.name = 'empty_noise'),
  ids_n as (select e.media_id, count(*) filter (e.item_id is distinct from l.cue_id)::bigint bad from expected e left join lines l on l.media_id = e.media_id and l.pos = e.rank group by e.media_id),
  ids_v as (select media_id, 'subtitle_ids' as name, case when bad > 0 then 'error' else 'pass' end severity, bad from ids_n),
  g as (select *, (cue_id - 1) // 3 g from lines),
  t as (select media_id, min(cue_id) u from g where media_id % 10 <> 1 group by media_id, g),
  t_bad as (select media_id, sum(case when (900 + u * 37 % 300) / 1000 > 1.12::double then 1 else 0 end) a, sum(case when u * 53 % 200 - (media_id % 3) * 60 > 150 then 1 else 0 end) b,
    sum(case when u * 71 % 15000 - (media_id % 2) * 1500 > 14000 then 1 else 0 end) c, sum(case when u * 29 % 900 - (media_id % 4) * 50 > 800 then 1 else 0 end) d,
    sum(case when u % 59 = 1 and media_id % 2 = 0 or u % 43 = 1 then 1 else 0 end) e from t group by media_id),
  t_v as (select media_id, r.name, case when bad > 0 then case when r.name = 'tts_cue_alignment' then 'error' else 'warning' end else 'pass' end severity, bad::bigint bad
    from (select media_id, unnest(['tts_speed', 'tts_deadlines', 'tts_source_span', 'tts_internal_gap', 'tts_cue_alignment']) as name, unnest([a, b, c, d, e]) bad from t_bad) r),
  k as (select media_id, cue_id, row_number() over (partition by media_id order by cue_id) rank from lines where media_id % 10 <> 1 and (media_id % 8 <> 3 or cue_id <> 2)),
  cover_v as (select e.media_id, 'tts_cue_coverage' as name, case when count(*) filter (e.item_id is distinct from k.cue_id) > 0 then 'error' else 'pass' end severity,
    count(*) filter (e.item_id is distinct from k.cue_id) bad from expected e left join k on k.media_id = e.media_id and k.rank = e.rank where e.media_id % 10 <> 1 group by e.media_id),
  al as (select media_id, cue_id, pos, case when cue_id % 61 = 5 and media_id % 3 = 0 then start_ms - 5000 else start_ms end s, end_ms from lines where media_id % 10 <> 2),
  al2 as (select *, case when media_id % 4 = 1 and end_ms <= s then s else greatest(end_ms, s + 1) end e from al),
  al3 as (select *, lag(e) over (partition by media_id order by pos) p from al2),
  sync_n as (select media_id, count(*) filter (e <= s or s < p) bad from al3 group by media_id),
  sync_v as (select s.media_id, 'tts_subtitle_sync' as name, case when s.bad + i.bad > 0 then 'error' else 'pass' end severity, s.bad + i.bad bad from sync_n s join ids_n i using (media_id) where s.media_id % 10 <> 1),
  master_v as (select media_id, 'dialogue_master_ids' as name, severity, 2 * bad bad from ids_v where media_id % 10 <> 4),
  prov_v as (select media_id, 'dialogue_master_provider' as name, case when media_id % 9 = 2 then 'warning' else 'pass' end severity, case when media_id % 9 = 2 then 1 else 0 end bad from media where media_id % 10 <> 4),
  cons as (select media_id, min(cue_id) u from g where media_id % 10 <> 4 group by media_id, g),
  cons_v as (select media_id, 'dialogue_master_consistency' as name, case when count(*) filter (u % 31 = 1 and media_id % 2 = 1) > 0 then 'error' else 'pass' end severity,
    count(*) filter (u % 31 = 1 and media_id % 2 = 1) bad from cons group by media_id),
  reg as (select media_id, media_id % 7 <> 6 has, media_id % 7 <> 6 and (region_id % 17 = 3 and media_id % 5 = 1 or x + width > 1280 or y + height > 720) invalid,
    case when media_id % 2 = 0 then 60 else confidence_pct end conf from regions where media_id % 10 <> 5),
  reg_v as (select media_id, 'source_subtitle_mask' as name, case when bool_or(invalid) or not bool_or(has) then 'error' when min(conf) < 50 or media_id % 6 = 5 then 'warning' else 'pass' end severity,
    count(*) filter (invalid) bad from reg group by media_id),
  lay as (select media_id, count(*) filter (cue_id % 83 = 2 and media_id % 2 = 0 or 14 + cue_id % 66 + case when media_id % 4 = 3 and cue_id % 66 = 65 then 10 else 0 end > 80) a,
    count(*) filter (100 + 600 + cue_id % 50 < 110 + case when media_id % 3 = 1 then 591 else 580 end) b from lines where media_id % 10 <> 6 group by media_id),
  lay_v as (select media_id, unnest(['adaptive_subtitle_layout', 'source_pixels_covered']) as name, case when unnest([a, b]) > 0 then 'error' else 'pass' end severity, unnest([a, b]) bad from lay),
  probe_v as (select media_id, 'media_streams' as name, case when media_id % 9 > 0 and media_id % 4 <> 2 then 'pass' else 'error' end severity,
    case when media_id % 9 > 0 and media_id % 4 <> 2 then 0 else 1 end bad from media where media_id % 10 <> 8),
  verdict as (select * from cue_v union all select * from empty_v union all select * from ids_v union all select * from t_v union all select * from cover_v
    union all select * from sync_v union all select * from master_v union all select * from prov_v union all select * from cons_v
    union all select * from reg_v union all select * from lay_v union all select * from probe_v)"""


@query("qa_checks", "marked regions", QA_SQL + " select media_id, name, severity, bad from verdict")
def qa_checks(spark, sf_dir):
    return Q.checks(**inputs(spark, sf_dir))


@query("qa_summary", "marked regions", QA_SQL + """ select media_id, count(*) filter (severity = 'pass') pass, count(*) filter (severity = 'warning') warning,
  count(*) filter (severity = 'error') error, case when count(*) filter (severity = 'error') > 0 then 'needs_review' else 'done' end status from verdict group by media_id""")
def qa_summary(spark, sf_dir):
    return Q.summary(Q.checks(**inputs(spark, sf_dir)))
