"""Text regions and voices."""

from __future__ import annotations

from pyspark.sql import functions as F

from cuegrid.operators import regions as R
from cuegrid.workload import views
from cuegrid.workload.registry import query

STEP, WIDTH, HEIGHT = 250, 1280, 720


@query("top_boxes", "boxes", """f as (select *, ts_ms // 3000 frame from boxes)
  select media_id, frame, seq from (select * from f qualify row_number() over (partition by media_id, frame order by score_pct desc, seq) <= 5) where score_pct >= 48""")
def top_boxes(spark, sf_dir):
    b = views.boxes(spark, sf_dir).withColumn("ts_ms", F.floor(F.col("ts_ms") / 3000))
    return R.top_boxes(b).select("media_id", F.col("ts_ms").alias("frame"), "seq")


BANDS_SQL = """b as (select *, cast(round_even((y + h / 2) / 29, 0) as bigint) band, cast(round_even(ts_ms / 250, 0) as bigint) slot from boxes),
  g as (select media_id, band, count(distinct slot) support, count(*) n, sum(greatest(0, 1280 - abs(2 * x + w - 1280)))::bigint centre, sum(2 * y + h)::bigint down,
    min(seq) first_seq from b group by all),
  r as (select *, support * (0.72::double + 0.18::double * (centre / 1280 / n) + 0.10::double * (down / 1440 / n)) rank from g),
  best as (select media_id, band dominant from r qualify row_number() over (partition by media_id order by rank desc, first_seq) = 1),
  kept as (select r.media_id, r.band, dominant from r join best using (media_id) where abs(r.band - dominant) <= 2 and support >= 2)"""


@query("dominant_band", "boxes", BANDS_SQL + " select media_id, band, dominant from kept")
def dominant_band(spark, sf_dir):
    return R.dominant_bands(R.band_ranks(views.boxes(spark, sf_dir), STEP, WIDTH, HEIGHT))


def tracked(spark, sf_dir):
    b = views.boxes(spark, sf_dir)
    bands = R.dominant_bands(R.band_ranks(b, STEP, WIDTH, HEIGHT))
    return R.box_tracks(R.in_dominant_bands(b, bands, HEIGHT), STEP, WIDTH, HEIGHT)


# The tracks so far, row by row: a list of open tracks for each medium, oldest first.
TRACKS_SQL = BANDS_SQL + """,
  o as (select b.media_id, b.ts_ms ts, b.seq, b.x, b.y, b.w, b.h, b.score_pct, row_number() over (partition by b.media_id order by b.ts_ms, b.seq) i from b join kept using (media_id, band)),
  walk as (
    select media_id, i, seq track_id, [{'id': seq, 'ts': ts, 'x': x, 'y': y, 'w': w, 'h': h}] tracks from o where i = 1
    union all
    select media_id, i, coalesce(hit.id, seq), case when hit.id is null then list_append(live, {'id': seq, 'ts': ts, 'x': x, 'y': y, 'w': w, 'h': h})
      else list_transform(live, lambda t: case when t.id = hit.id then {'id': t.id, 'ts': ts, 'x': x, 'y': y, 'w': w, 'h': h} else t end) end
    from (select *, list_filter(fits, lambda t: abs(y + h / 2 - t.y - t.h / 2) = nearest)[1] hit
      from (select *, list_min(list_transform(fits, lambda t: abs(y + h / 2 - t.y - t.h / 2))) nearest
        from (select *, list_filter(live, lambda t: abs(x + w / 2 - t.x - t.w / 2) <= greatest(1280 * 0.12::double, 0.45::double * least(w, t.w))
              and abs(y + h / 2 - t.y - t.h / 2) <= greatest(720 * 0.045::double, 0.8::double * least(h, t.h))) fits
          from (select o.*, list_filter(k.tracks, lambda t: o.ts - t.ts <= 550) live from walk k join o on o.media_id = k.media_id and o.i = k.i + 1)))))"""


@query("box_tracks", "boxes", TRACKS_SQL + " select media_id, seq, track_id from walk join o using (media_id, i)", recursive=True)
def box_tracks(spark, sf_dir):
    return tracked(spark, sf_dir).select("media_id", "seq", "track_id")


@query("track_envelope", "boxes", """t as (select *, ts_ms // 2000 track from boxes),
  e as (select media_id, track, round(quantile_cont(x::double, 0.05), 6) x1, round(quantile_cont(y::double, 0.05), 6) y1, round(quantile_cont((x + w)::double, 0.95), 6) x2, round(quantile_cont((y + h)::double, 0.95), 6) y2,
    sum(score_pct) score, count(*) n, count(distinct ts_ms) samples, min(ts_ms) t1, max(ts_ms) t2 from t group by all having count(distinct ts_ms) >= 2),
  p as (select *, greatest(12, (x2 - x1) * 0.08::double) px, greatest(8, (y2 - y1) * 0.30::double) py from e),
  q as (select *, greatest(0, cast(round_even(round(x1 - px, 6), 0) as bigint)) l, greatest(0, cast(round_even(round(y1 - py, 6), 0) as bigint)) tp,
    least(1280, cast(round_even(round(x2 + px, 6), 0) as bigint)) r, least(720, cast(round_even(round(y2 + py, 6), 0) as bigint)) bt from p)
  select media_id, track region_id, l x, tp y, r - l width, bt - tp height,
    cast(round_even(round(least(0.99::double, 0.55::double * (score / 100 / n) + 0.45::double * least(1.0::double, samples / 4)) * 1000, 6), 0) as bigint) confidence_e3,
    greatest(0, t1 - 162) start_ms, t2 + 162 end_ms from q""")
def track_envelope(spark, sf_dir):
    t = views.boxes(spark, sf_dir).withColumn("track_id", F.floor(F.col("ts_ms") / 2000))
    e = R.track_envelopes(t, STEP, WIDTH, HEIGHT)
    return e.select("media_id", "region_id", "x", "y", "width", "height", F.round(F.col("confidence") * 1000).cast("long").alias("confidence_e3"), "start_ms", "end_ms")


@query("merge_regions", "regions", """o as (select *, row_number() over (partition by media_id order by region_start, region_id) i from regions),
  walk as (select media_id, i, region_id grp, region_end reached, y top, y + height bottom from o where i = 1
    union all select media_id, i, case when brk then region_id else grp end, region_end, case when brk then y else least(top, y) end, case when brk then y + height else greatest(bottom, y + height) end
    from (select o.*, w.grp, w.top, w.bottom, region_start - w.reached > 1.2::double * 1500 or abs((o.y + o.height / 2) - (w.top + w.bottom) / 2) > 720 * 0.045::double brk
      from walk w join o on o.media_id = w.media_id and o.i = w.i + 1))
  select w.media_id, w.grp region_id, min(x) x, min(y) y, max(x + width) - min(x) width, max(y + height) - min(y) height, min(confidence_pct) confidence_pct,
    min(region_start) start_ms, max_by(region_end, o.i) end_ms from walk w join o using (media_id, i) group by all""", recursive=True)
def merge_regions(spark, sf_dir):
    r = views.regions(spark, sf_dir).select(
        "media_id", "region_id", "x", "y", "width", "height", F.col("confidence_pct").alias("confidence"), F.col("region_start").alias("start_ms"), F.col("region_end").alias("end_ms"))
    return R.merge_regions(r, 1500, HEIGHT).withColumnRenamed("confidence", "confidence_pct")


DURATION_SQL = "6000 + media_id * 977 % 90000"
FALLBACK_SQL = f"""p_ as (select media_id, cue_id, greatest(0, start_ms - 120) s, end_ms + 180 e from cues),
  r_ as (select *, max(e) over (partition by media_id order by cue_id rows between unbounded preceding and 1 preceding) reach from p_),
  n_ as (select *, sum(case when reach is null or s - reach > 350 then 1 else 0 end) over (partition by media_id order by cue_id) span_id from r_),
  fallback as (select media_id, cast(span_id as bigint) region_id, 102 x, 547 y, 1076 width, 101 height, min(s) start_ms, least(max(e), {DURATION_SQL}) end_ms
    from n_ group by media_id, span_id having min(s) < {DURATION_SQL})"""


@query("fallback_region", "cues", FALLBACK_SQL + " select * from fallback")
def fallback_region(spark, sf_dir):
    cues = views.cues(spark, sf_dir)
    return R.fallback_regions(cues, WIDTH, HEIGHT, views.with_durations(cues)).drop("confidence")


@query("source_regions", "boxes cues", TRACKS_SQL + f""",
  e as (select media_id, track_id, round(quantile_cont(x::double, 0.05), 6) x1, round(quantile_cont(y::double, 0.05), 6) y1, round(quantile_cont((x + w)::double, 0.95), 6) x2,
    round(quantile_cont((y + h)::double, 0.95), 6) y2, sum(score_pct) score, count(*) n, count(distinct ts) samples, min(ts) t1, max(ts) t2
    from walk join o using (media_id, i) group by all having count(distinct ts) >= 2),
  p as (select *, greatest(12, (x2 - x1) * 0.08::double) px, greatest(8, (y2 - y1) * 0.30::double) py from e),
  q as (select *, greatest(0, cast(round_even(round(x1 - px, 6), 0) as bigint)) l, greatest(0, cast(round_even(round(y1 - py, 6), 0) as bigint)) tp,
    least(1280, cast(round_even(round(x2 + px, 6), 0) as bigint)) r, least(720, cast(round_even(round(y2 + py, 6), 0) as bigint)) bt from p),
  env as (select media_id, track_id region_id, l x, tp y, r - l width, bt - tp height,
    cast(round_even(round(least(0.99::double, 0.55::double * (score / 100 / n) + 0.45::double * least(1.0::double, samples / 4)) * 1000, 6), 0) as bigint) confidence_e3,
    greatest(0, t1 - 162) start_ms, least(t2 + 162, {DURATION_SQL}) end_ms from q),
  eo as (select *, row_number() over (partition by media_id order by start_ms, region_id) j from env),
  joins as (select media_id, j, region_id grp, end_ms reached, y top, y + height bottom from eo where j = 1
    union all select media_id, j, case when brk then region_id else grp end, end_ms, case when brk then y else least(top, y) end, case when brk then y + height else greatest(bottom, y + height) end
    from (select eo.*, k.grp, k.top, k.bottom, start_ms - k.reached > 1.2::double * 250 or abs((eo.y + eo.height / 2) - (k.top + k.bottom) / 2) > 720 * 0.045::double brk
      from joins k join eo on eo.media_id = k.media_id and eo.j = k.j + 1)),
  found as (select media_id, k.grp region_id, min(x) x, min(y) y, max(x + width) - min(x) width, max(y + height) - min(y) height, min(confidence_e3) confidence_e3,
    min(start_ms) start_ms, max_by(end_ms, j) end_ms from joins k join eo using (media_id, j) group by all),
  {FALLBACK_SQL},
  every as (select * from found union all select media_id, region_id, x, y, width, height, 250, start_ms, end_ms from fallback where media_id not in (select media_id from found))
  select *, case when media_id in (select media_id from boxes) then 'visual_tracks_v2' else 'lower_band_fallback' end method from every""", recursive=True)
def source_regions(spark, sf_dir):
    boxes, cues = views.boxes(spark, sf_dir), views.cues(spark, sf_dir)
    media = views.with_durations(boxes.select("media_id").unionByName(cues.select("media_id")))
    r = R.source_regions(boxes, cues, STEP, WIDTH, HEIGHT, media)
    return r.select("media_id", "region_id", "x", "y", "width", "height", F.round(F.col("confidence") * 1000).cast("long").alias("confidence_e3"), "start_ms", "end_ms", "method")


@query("longest_turns", "marked", """select media_id, speaker, cue_id from marked where speaker is not null
  qualify row_number() over (partition by media_id, speaker order by end_ms - start_ms desc, cue_id) <= 8""")
def longest_turns(spark, sf_dir):
    return R.longest_turns(views.marked(spark, sf_dir)).select("media_id", "speaker", "cue_id")


@query("voice_profile", "marked", """t as (select * from marked where speaker is not null qualify row_number() over (partition by media_id, speaker order by end_ms - start_ms desc, cue_id) <= 8),
  p as (select media_id, speaker, case when cue_id % 6 = 1 then null else case when (media_id + length(speaker)) % 4 = 0 then 140 when (media_id + length(speaker)) % 4 = 1 then 200
    when (media_id + length(speaker)) % 4 = 2 then 160 else 175 end + cue_id % 20 end hz from t),
  s as (select media_id, speaker, count(hz) n, median(hz) med, count(*) filter (hz < 165) m, count(*) filter (hz >= 190) f from p group by all),
  k as (select *, row_number() over (partition by media_id order by speaker) - 1 label_no, case when n > 0 then greatest(m, f) / n else 0 end agree from s),
  v as (select *, case when n < 2 or agree < 0.70::double or (med >= 165 and med < 190) is true then 'uncertain' when f > m then 'female' else 'male' end voice_type from k)
  select media_id, speaker, n evidence_turns, cast(round(med * 10) as bigint) median_dhz, voice_type, case when media_id % 7 = 3 and speaker = 'user' then 'chosen'
    when voice_type = 'uncertain' then case when label_no % 2 = 0 then 'A' else 'B' end when voice_type = 'female' then 'F' else 'M' end voice from v""")
def voice_profile(spark, sf_dir):
    t = views.marked(spark, sf_dir)
    k = (F.col("media_id") + F.length("speaker")) % 4
    hz = F.when(k == 0, 140).when(k == 1, 200).when(k == 2, 160).otherwise(175) + F.col("cue_id") % 20
    p = t.where("speaker is not null").select("media_id", "cue_id", F.when(F.col("cue_id") % 6 != 1, hz).alias("pitch_hz"))
    o = t.where("media_id % 7 = 3 and speaker = 'user'").select("media_id", "speaker").distinct().withColumn("voice", F.lit("chosen"))
    v = R.voice_profiles(t, p, "A", "B", "M", "F", o)
    return v.select("media_id", "speaker", "evidence_turns", F.round(F.col("median_pitch_hz") * 10).cast("long").alias("median_dhz"), "voice_type", "voice")
