"""Where burned-in text sits: bands, tracks, regions, and speaker voices.

Boxes are (media_id, ts_ms, seq, x, y, w, h, score_pct); frame size and sample
step are parameters or columns of the media table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cuegrid.functions.timing import rounded
from cuegrid.operators.sequence import merge_intervals
from cuegrid.plans.carry import carry_fold
from cuegrid.plans.scan import Sequence
from cuegrid.plans.store import cut

# Detector limits and voice ranges.
BEST_BOXES, BEST_NEURAL, LEAST_SCORE = 5, 8, 0.48
TURNS, MALE_BELOW_HZ, FEMALE_FROM_HZ, AGREEMENT = 8, 165, 190, 0.70


def top_boxes(boxes: DataFrame, n: int = BEST_BOXES, least: float | None = LEAST_SCORE) -> DataFrame:
    """The n best boxes of each frame that also reach the least score."""
    w = Window.partitionBy("media_id", "ts_ms").orderBy(F.desc("score_pct"), "seq")
    top = boxes.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")
    return top if least is None else top.where(F.col("score_pct") >= least * 100)


def _band(frame_height: int) -> Column:
    height = max(10, round(frame_height * 0.04))
    return F.bround((F.col("y") + F.col("h") / 2) / height).cast("long")


def band_ranks(boxes: DataFrame, step_ms: int, frame_width: int, frame_height: int) -> DataFrame:
    """Support and rank of every horizontal band of a medium.

    Centredness and height are averaged from whole-number sums, so the rank
    does not depend on the order in which tasks finish.
    """
    off = F.abs(2 * F.col("x") + F.col("w") - frame_width)
    b = boxes.withColumn("band", _band(frame_height)).withColumn("slot", F.bround(F.col("ts_ms") / step_ms).cast("long"))
    # One row per band and sample first: a hot medium shrinks before its bands are counted.
    slots = b.groupBy("media_id", "band", "slot").agg(
        F.count("*").alias("n"), F.sum(F.greatest(F.lit(0), F.lit(frame_width) - off)).alias("centre"),
        F.sum(2 * F.col("y") + F.col("h")).alias("down"), F.min(F.struct("ts_ms", "seq")).alias("first"))
    bands = slots.groupBy("media_id", "band").agg(
        F.count("*").alias("support"), F.sum("n").alias("n"), F.sum("centre").alias("centre"), F.sum("down").alias("down"), F.min("first").alias("first"))
    centred = F.col("centre") / frame_width / F.col("n")
    vertical = F.col("down") / (2 * frame_height) / F.col("n")
    return bands.withColumn("rank", F.col("support") * (0.72 + 0.18 * centred + 0.10 * vertical))


def dominant_bands(ranks: DataFrame) -> DataFrame:
    """(media_id, band): the best band and its well supported neighbours."""
    best = ranks.groupBy("media_id").agg(F.max(F.struct("rank", (-F.col("first.ts_ms")).alias("t"), (-F.col("first.seq")).alias("s"), "band")).alias("b"))
    near = ranks.join(best.select("media_id", F.col("b.band").alias("dominant")), "media_id")
    return near.where((F.abs(F.col("band") - F.col("dominant")) <= 2) & (F.col("support") >= 2)).select("media_id", "band", "dominant")


def in_dominant_bands(boxes: DataFrame, bands: DataFrame, frame_height: int) -> DataFrame:
    b = boxes.withColumn("band", _band(frame_height))
    return b.join(bands.select("media_id", "band"), ["media_id", "band"], "left_semi").drop("band")


def _track_step(step_ms: int, frame_width: int, frame_height: int):
    """Put a box on the open track nearest in height; tracks silent for 2.2 steps are closed.

    State: one [track_id, last ts, x, y, w, h] for each open track, oldest track first.
    """
    silence, tall, wide = step_ms * 2.2, frame_height * 0.045, frame_width * 0.12

    def offsets(box, last):
        """Distances of the centres as shares of what the two boxes allow, and the plain one in height."""
        (x, y, w, h), (u, v, s, t) = box, last
        across, down = abs(x + w / 2 - u - s / 2), abs(y + h / 2 - v - t / 2)
        return across <= max(wide, 0.45 * min(w, s)) and down <= max(tall, 0.8 * min(h, t)), down

    def step(state, row):
        ts, seq, *box = row
        live = {t[0]: t for t in state or () if ts - t[1] <= silence}
        fits = {track: down for track, t in live.items() for able, down in [offsets(box, t[2:])] if able}
        chosen = min(fits, key=fits.get, default=seq)  # of equal distances the oldest track's
        live[chosen] = [chosen, ts, *box]
        return list(live.values()), (chosen,)
    return step


def box_tracks(boxes: DataFrame, step_ms: int, frame_width: int, frame_height: int, width_ms: int = 3_600_000) -> DataFrame:
    """Add track_id, the seq of the track's first box."""
    seq = Sequence(("media_id",), ("ts_ms", "seq"), width_ms)
    out = T.StructType([T.StructField("track_id", T.LongType())])
    return carry_fold(boxes, seq, ["ts_ms", "seq", "x", "y", "w", "h"], _track_step(step_ms, frame_width, frame_height), out)


def track_envelopes(tracks: DataFrame, step_ms: int, frame_width: int, frame_height: int, media: DataFrame | None = None) -> DataFrame:
    """Region of each track seen in at least two samples.

    Percentiles count distinct pixel values, which the frame size bounds.
    media may give (media_id, duration_ms) to end regions with the video.
    """
    def edge_at(pixel: Column, share: float) -> Column:
        # Percentiles of whole pixels have two decimals; the rest is float noise.
        return F.round(F.percentile(pixel, F.lit(share)), 6)

    def whole(pixel: Column) -> Column:
        return rounded(F.round(pixel, 6))

    right_x, low_y = F.col("x") + F.col("w"), F.col("y") + F.col("h")
    t = tracks.groupBy("media_id", "track_id").agg(
        edge_at(F.col("x"), 0.05).alias("x1"), edge_at(F.col("y"), 0.05).alias("y1"), edge_at(right_x, 0.95).alias("x2"), edge_at(low_y, 0.95).alias("y2"),
        F.sum("score_pct").alias("score"), F.count("*").alias("n"), F.count_distinct("ts_ms").alias("samples"),
        F.min("ts_ms").alias("t1"), F.max("ts_ms").alias("t2")).where("samples >= 2")
    pad_x = F.greatest(F.lit(12.0), (F.col("x2") - F.col("x1")) * 0.08)
    pad_y = F.greatest(F.lit(8.0), (F.col("y2") - F.col("y1")) * 0.30)
    left, top = F.greatest(F.lit(0), whole(F.col("x1") - pad_x)), F.greatest(F.lit(0), whole(F.col("y1") - pad_y))
    right, bottom = F.least(F.lit(frame_width), whole(F.col("x2") + pad_x)), F.least(F.lit(frame_height), whole(F.col("y2") + pad_y))
    mean = F.col("score") / 100 / F.col("n")
    confidence = F.least(F.lit(0.99), 0.55 * mean + 0.45 * F.least(F.lit(1.0), F.col("samples") / 4))
    edge = rounded(F.lit(step_ms * 0.65))
    end = F.col("t2") + edge
    if media is not None:
        t = t.join(media.select("media_id", "duration_ms"), "media_id", "left")
        end = F.least(end, F.col("duration_ms"))
    return t.select(
        "media_id", F.col("track_id").alias("region_id"), left.alias("x"), top.alias("y"), (right - left).alias("width"), (bottom - top).alias("height"),
        (F.bround(F.round(confidence * 1000, 6)) / 1000).alias("confidence"), F.greatest(F.lit(0), F.col("t1") - edge).alias("start_ms"), end.alias("end_ms"))


def _merge_step(step_ms: int, frame_height: int):
    def step(state, row):
        region, start, end, y, height = row
        if state is not None:
            [[group, reached, top, bottom]] = state
            if start - reached > step_ms * 1.2 or abs((y + height / 2) - (top + bottom) / 2) > frame_height * 0.045:
                state = None
        if state is None:
            group, top, bottom = region, y, y + height
        return [[group, end, min(top, y), max(bottom, y + height)]], (group,)
    return step


def merge_regions(regions: DataFrame, step_ms: int, frame_height: int, width_ms: int = 3_600_000) -> DataFrame:
    """Join regions that follow each other at one height; the last one sets the end."""
    seq = Sequence(("media_id",), ("start_ms", "region_id"), width_ms)
    out = T.StructType([T.StructField("merged_id", T.LongType())])
    r = carry_fold(regions, seq, ["region_id", "start_ms", "end_ms", "y", "height"], _merge_step(step_ms, frame_height), out)
    order = F.struct("start_ms", "region_id")
    m = r.groupBy("media_id", "merged_id").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("width")).alias("right"), F.max(F.col("y") + F.col("height")).alias("bottom"),
        F.min("confidence").alias("confidence"), F.min("start_ms").alias("start_ms"), F.max_by("end_ms", order).alias("end_ms"))
    return m.select("media_id", F.col("merged_id").alias("region_id"), "x", "y", (F.col("right") - F.col("x")).alias("width"),
                    (F.col("bottom") - F.col("y")).alias("height"), "confidence", "start_ms", "end_ms")


def fallback_regions(cues: DataFrame, frame_width: int, frame_height: int, media: DataFrame | None = None) -> DataFrame:
    """The usual subtitle band over the padded cue times, at low confidence.

    media may give (media_id, duration_ms); spans then end with the video, and those that start after it are left out.
    """
    # The band in shares of the frame.
    x1, x2, y1, y2 = round(frame_width * 0.08), round(frame_width * 0.92), round(frame_height * 0.76), round(frame_height * 0.90)
    spans = merge_intervals(cues)
    if media is not None:
        spans = spans.join(media.select("media_id", "duration_ms"), "media_id", "left").withColumn("end_ms", F.least("end_ms", "duration_ms")).where("start_ms < end_ms")
    return spans.select(
        "media_id", F.col("span_id").alias("region_id"), F.lit(x1).cast("long").alias("x"), F.lit(y1).cast("long").alias("y"),
        F.lit(x2 - x1).cast("long").alias("width"), F.lit(y2 - y1).cast("long").alias("height"), F.lit(0.25).alias("confidence"), "start_ms", "end_ms")


def source_regions(boxes: DataFrame, cues: DataFrame, step_ms: int, frame_width: int, frame_height: int, media: DataFrame | None = None) -> DataFrame:
    """Regions of every medium of `cues`: merged tracks of the dominant bands, or the fallback band.

    method tells whether anything was detected; only the confidence tells a
    fallback after detections without a track. media may give (media_id,
    duration_ms), with which every region ends at the latest.
    """
    bands = dominant_bands(band_ranks(boxes, step_ms, frame_width, frame_height))
    tracks = box_tracks(in_dominant_bands(boxes, bands, frame_height), step_ms, frame_width, frame_height)
    envelopes = cut(track_envelopes(tracks, step_ms, frame_width, frame_height, media))
    found = cut(merge_regions(envelopes, step_ms, frame_height))
    bare = cues.join(found.select("media_id").distinct(), "media_id", "left_anti")
    seen = boxes.select("media_id").distinct().withColumn("method", F.lit("visual_tracks_v2"))
    both = found.unionByName(fallback_regions(bare, frame_width, frame_height, media))
    return both.join(seen, "media_id", "left").withColumn("method", F.coalesce("method", F.lit("lower_band_fallback")))


def longest_turns(turns: DataFrame, n: int = TURNS) -> DataFrame:
    """The n longest turns per speaker; the limit applies before the shuffle."""
    w = Window.partitionBy("media_id", "speaker").orderBy(F.desc(F.col("end_ms") - F.col("start_ms")), "cue_id")
    return turns.where("speaker is not null").withColumn("turn_no", F.row_number().over(w)).where(F.col("turn_no") <= n)


def voice_profiles(turns: DataFrame, pitches: DataFrame, primary: str, secondary: str, male: str, female: str, overrides: DataFrame | None = None) -> DataFrame:
    """Advisory voice per speaker from the pitch of its longest turns.

    pitches: (media_id, cue_id, pitch_hz); turns without a pitch give no
    evidence. Uncertain speakers alternate between the two voices.
    """
    p = longest_turns(turns).join(pitches, ["media_id", "cue_id"], "left")
    pitch = F.col("pitch_hz")
    s = p.groupBy("media_id", "speaker").agg(
        F.count(pitch).alias("evidence_turns"), F.median(pitch).alias("median_pitch_hz"),
        F.count_if(pitch < MALE_BELOW_HZ).alias("male_votes"), F.count_if(pitch >= FEMALE_FROM_HZ).alias("female_votes"))
    # One row per speaker by now, so the label order is a small window.
    s = s.withColumn("label_no", F.row_number().over(Window.partitionBy("media_id").orderBy("speaker")) - 1)
    agreement = F.when(F.col("evidence_turns") > 0, F.greatest("male_votes", "female_votes") / F.col("evidence_turns")).otherwise(0.0)
    s = s.withColumn("agreement", agreement)
    median = F.col("median_pitch_hz")
    unsure = (F.col("evidence_turns") < 2) | (F.col("agreement") < AGREEMENT) | F.coalesce((median >= MALE_BELOW_HZ) & (median < FEMALE_FROM_HZ), F.lit(False))
    kind = F.when(unsure, "uncertain").when(F.col("female_votes") > F.col("male_votes"), "female").otherwise("male")
    s = s.withColumn("voice_type", kind)
    voice = (
        F.when(F.col("voice_type") == "uncertain", F.when(F.col("label_no") % 2 == 0, primary).otherwise(secondary))
        .when(F.col("voice_type") == "female", female).otherwise(male)
    )
    s = s.withColumn("voice", voice).withColumn("overridden", F.lit(False))
    if overrides is not None:
        s = s.join(overrides.select("media_id", "speaker", F.col("voice").alias("_v")), ["media_id", "speaker"], "left")
        s = s.withColumn("overridden", F.col("_v").isNotNull()).withColumn("voice", F.coalesce("_v", "voice")).drop("_v")
    return s.drop("male_votes", "female_votes", "label_no")
