"""Matching two timed tracks of the same media, and recognised-text tracks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.functions.geometry import centredness
from cuegrid.functions.timing import overlap_ratio
from cuegrid.operators.sequence import CUES, translation_batches
from cuegrid.plans.overlap import overlap_pairs, shared_ms
from cuegrid.plans.scan import Run, Sequence, running

# Fixed values of recognition quality rules.
LOW_SCORE, SURE_SCORE, REFINE_GAIN, REFINE_SAMPLES, LEAST_CUES = 0.88, 0.94, 0.06, 3, 8
RESCUE_RATIO, SPEAKER_RATIO = 0.25, 0.18


def low_confidence(cues: DataFrame) -> DataFrame:
    return cues.where(F.coalesce("score", F.lit(1.0)) < LOW_SCORE)


def _best_match(cues: DataFrame, asr: DataFrame, value: Column) -> DataFrame:
    """Highest overlap ratio per cue, the earliest span on ties; one row per matched cue.

    asr: (media_id, asr_id, asr_start, asr_end, ...). Reduced with max() so the
    pairs of a cue are combined before they are shuffled.
    """
    left = cues.select("media_id", "cue_id", "start_ms", "end_ms")
    # Of spans with the same times only the first can win: copies go before the join.
    first = asr.groupBy("media_id", "asr_start", "asr_end").agg(F.min(F.struct("asr_id", value.alias("value"))).alias("f"))
    first = first.select("media_id", "asr_start", "asr_end", "f.*")
    pairs = overlap_pairs(left, first, "media_id", "start_ms", "end_ms", "asr_start", "asr_end")
    ratio = overlap_ratio(F.col("start_ms"), F.col("end_ms"), F.col("asr_start"), F.col("asr_end"))
    best = F.max(F.struct(ratio.alias("ratio"), (-F.col("asr_id")).alias("first"), "value"))
    return pairs.groupBy("media_id", "cue_id").agg(best.alias("best")).select(
        "media_id", "cue_id", F.col("best.ratio").alias("ratio"), F.col("best.value").alias("value"))


def asr_rescue(ocr: DataFrame, asr: DataFrame) -> DataFrame:
    """Replace weak recognised lines by the best overlapping ASR line; adds rescued."""
    best = _best_match(low_confidence(ocr), asr, X.strip(F.col("asr_text")))
    good = best.where((F.col("ratio") >= RESCUE_RATIO) & (F.col("value") != "")).select("media_id", "cue_id", "value")
    c = ocr.join(good, ["media_id", "cue_id"], "left")
    return (
        c.withColumn("rescued", F.col("value").isNotNull())
        .withColumn("content", F.coalesce("value", "content")).drop("value")
    )


def reliable_media(labelled: DataFrame, label: str) -> DataFrame:
    """Media with at least two known labels, found by min and max alone."""
    t = labelled.where(F.col(label) != "").groupBy("media_id").agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
    return t.where("_lo <> _hi").select("media_id")


def speaker_reliability(cues: DataFrame) -> DataFrame:
    """Hide speakers of media with fewer than two labels."""
    ok = reliable_media(cues, "speaker").withColumn("_ok", F.lit(True))
    return cues.join(ok, "media_id", "left").withColumn("shown_speaker", F.when(F.col("_ok"), F.col("speaker"))).drop("_ok")


def recover_speakers(cues: DataFrame, asr: DataFrame) -> DataFrame:
    """(media_id, cue_id, speaker) taken over from the best overlapping labelled ASR cue."""
    labelled = asr.where(F.col("asr_speaker").isNotNull())
    labelled = labelled.join(reliable_media(labelled, "asr_speaker"), "media_id", "left_semi")
    best = _best_match(cues, labelled, F.col("asr_speaker"))
    return best.where(F.col("ratio") >= SPEAKER_RATIO).select("media_id", "cue_id", F.col("value").alias("speaker"))


def _region_overlaps(cues: DataFrame, regions: DataFrame, *values: str) -> DataFrame:
    """Cue and region spans that share time; regions with the same times count as one with `copies`."""
    spans = cues.select("media_id", "cue_id", "start_ms", "end_ms")
    one = regions.groupBy("media_id", "region_start", "region_end").agg(F.min(F.struct("region_id", *values)).alias("f"), F.count("*").alias("copies"))
    one = one.select("media_id", "region_start", "region_end", "copies", "f.*")
    pairs = overlap_pairs(spans, one, "media_id", "start_ms", "end_ms", "region_start", "region_end")
    return pairs.withColumn("shared", shared_ms("start_ms", "end_ms", "region_start", "region_end"))


def cue_box_width(cues: DataFrame, regions: DataFrame) -> DataFrame:
    """Width of the region with most overlap; a cue without overlap takes the first region."""
    hit = _region_overlaps(cues, regions, "width").groupBy("media_id", "cue_id").agg(
        F.max(F.struct("shared", (-F.col("region_id")).alias("first"), "width")).alias("best"))
    first = regions.groupBy("media_id").agg(F.min(F.struct("region_id", "width")).alias("first"))
    c = cues.select("media_id", "cue_id").join(hit, ["media_id", "cue_id"], "left").join(first, "media_id")
    return c.select("media_id", "cue_id", F.coalesce("best.width", "first.width").alias("box_width"))


def _nearest_region(cues: DataFrame, regions: DataFrame, width_ms: int = 3_600_000) -> DataFrame:
    """Region whose edge is nearest to the middle of each cue, lowest id on ties.

    Edges and middles are laid on one time line (doubled, to stay integral) and
    the last edge before and first edge after each middle are carried to it.
    """
    edges = regions.select("media_id", "region_id", F.explode(F.array("region_start", "region_end")).alias("edge"))
    edges = edges.groupBy("media_id", (2 * F.col("edge")).alias("at")).agg(F.min("region_id").alias("region_id"))
    mid = cues.select("media_id", (F.col("start_ms") + F.col("end_ms")).alias("at"), "cue_id")
    line = edges.select("media_id", "at", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("cue_id"), F.struct("at", "region_id").alias("edge"))
    line = line.unionByName(mid.withColumn("kind", F.lit(1)).withColumn("edge", F.lit(None).cast(line.schema["edge"].dataType)))
    seq = Sequence(("media_id",), ("at", "kind", "cue_id"), 2 * width_ms)
    line = running(line, seq, {"_left": Run("last", F.col("edge")), "_right": Run("last", F.col("edge"), backward=True)})
    # An edge exactly on the middle sorts before it, so only _left sees it; equal distances compare by id.
    def at(side: str) -> Column:
        return F.when(F.col(side).isNotNull(), F.struct(F.abs(F.col(f"{side}.at") - F.col("at")).alias("far"), F.col(f"{side}.region_id").alias("region_id")))
    return line.where("kind = 1").select("media_id", "cue_id", F.least(at("_left"), at("_right")).getField("region_id").alias("near_id"))


def cue_region(cues: DataFrame, regions: DataFrame) -> DataFrame:
    """Region of each cue by most overlap, then nearest edge, then order; and the total overlap."""
    pairs = _region_overlaps(cues, regions)
    middle = F.col("start_ms") + F.col("end_ms")
    far = F.least(F.abs(middle - 2 * F.col("region_start")), F.abs(middle - 2 * F.col("region_end")))
    hit = pairs.groupBy("media_id", "cue_id").agg(
        F.max(F.struct("shared", (-far).alias("near"), (-F.col("region_id")).alias("first"))).alias("best"), F.sum(F.col("shared") * F.col("copies")).alias("visual_overlap_ms"))
    missed = cues.select("media_id", "cue_id", "start_ms", "end_ms").join(hit, ["media_id", "cue_id"], "left_anti")
    near = _nearest_region(missed, regions)
    found = hit.select("media_id", "cue_id", (-F.col("best.first")).alias("region_id"), "visual_overlap_ms")
    return found.unionByName(near.where("near_id is not null").select(
        "media_id", "cue_id", F.col("near_id").alias("region_id"), F.lit(0).cast("long").alias("visual_overlap_ms")))


def active_cues(cues: DataFrame, regions: DataFrame, width_ms: int = 3_600_000) -> DataFrame:
    """Cues on screen together with a region.

    No pairs are formed: laid out by time, a cue is active if the latest end of
    the regions that start before the cue's end lies after the cue's start.
    """
    spans = regions.where("region_end > region_start").select("media_id", F.col("region_start").alias("at"), F.lit(1).alias("kind"), F.lit(0).cast("long").alias("cue_id"),
                                                              F.col("region_end").alias("reach"), F.lit(None).cast("long").alias("start_ms"))
    spans = spans.groupBy("media_id", "at", "kind", "cue_id", "start_ms").agg(F.max("reach").alias("reach"))
    shown = cues.where("end_ms > start_ms").select("media_id", F.col("end_ms").alias("at"), F.lit(0).alias("kind"), "cue_id", F.lit(None).cast("long").alias("reach"), "start_ms")
    line = running(shown.unionByName(spans), Sequence(("media_id",), ("at", "kind", "cue_id"), width_ms), {"_reach": Run("max", F.col("reach"))})
    hit = line.where((F.col("kind") == 0) & (F.col("_reach") > F.col("start_ms"))).select("media_id", "cue_id")
    return cues.join(hit, ["media_id", "cue_id"], "left_semi")


def translation_context(cues: DataFrame, before: int = 6, after: int = 4, size: int = 30, seq: Sequence = CUES) -> DataFrame:
    """Every batch with its own cues and the ones around it; adds in_batch.

    A cue is sent to the batches whose context it lies in, so no join is needed.
    A batch only exists if it has cues of its own: its number is bounded by the
    number of cues, which the last rank tells.
    """
    c = translation_batches(cues, seq, size).drop("batch_no")
    rank = F.col("rank")
    lo = F.greatest(F.lit(0), F.ceil((rank - after) / F.lit(size)) - 1).cast("long")
    hi = F.floor((rank + before - 1) / F.lit(size)).cast("long")
    last = c.groupBy("media_id").agg(F.floor((F.max("rank") - 1) / size).cast("long").alias("_last"))
    c = c.join(last, "media_id").withColumn("batch_no", F.explode(F.sequence(lo, F.least(hi, F.col("_last")))))
    return c.withColumn("in_batch", F.floor((F.col("rank") - 1) / size) == F.col("batch_no")).drop("_last")


def keep_recognised(cues: DataFrame, least: int = LEAST_CUES) -> DataFrame:
    """Stable recognised lines, of media that have enough of them for a track."""
    kept = cues.where((F.col("samples") >= 2) | ((F.col("score") >= SURE_SCORE) & (F.length("text") <= 2)))
    enough = kept.groupBy("media_id").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("media_id")
    return kept.join(enough, "media_id", "left_semi")


def refine_cues(cues: DataFrame, candidates: DataFrame) -> DataFrame:
    """Take the best re-scan of a weak cue if it scores clearly better; adds refined.

    candidates: (media_id, cue_id, sample_no, text, score).
    """
    best = candidates.where(F.coalesce("text", F.lit("")) != "").groupBy("media_id", "cue_id").agg(
        F.max(F.struct("score", (-F.col("sample_no")).alias("first"), "text")).alias("best"))
    c = cues.join(best, ["media_id", "cue_id"], "left")
    better = (F.col("score") < LOW_SCORE) & (F.col("best.score") >= F.col("score") + REFINE_GAIN)
    c = c.withColumn("refined", F.coalesce(better, F.lit(False)))
    return c.withColumns({
        "text": F.when(F.col("refined"), F.col("best.text")).otherwise(F.col("text")),
        "samples": F.when(F.col("refined"), F.greatest("samples", F.lit(REFINE_SAMPLES))).otherwise(F.col("samples")),
        "score": F.when(F.col("refined"), F.col("best.score")).otherwise(F.col("score")),
    }).drop("best")


def ocr_report(raw: DataFrame, kept: DataFrame, refined: DataFrame) -> DataFrame:
    """Counts and mean score per medium over the stages of recognition."""
    n_raw = raw.groupBy("media_id").agg(F.count("*").alias("raw_cues"))
    before = kept.groupBy("media_id").agg(F.count_if(F.col("score") < LOW_SCORE).alias("low_before"))
    after = refined.groupBy("media_id").agg(
        F.count("*").alias("cues"), F.avg("score").alias("mean_score"),
        F.count_if(F.col("score") < LOW_SCORE).alias("low_after"), F.count_if(F.col("refined")).alias("refined_count"))
    r = n_raw.join(before, "media_id", "left").join(after, "media_id", "left")
    return r.select("media_id", "raw_cues", F.coalesce("mean_score", F.lit(0.0)).alias("mean_score"),
                    *[F.coalesce(c, F.lit(0)).alias(c) for c in ("cues", "low_before", "low_after", "refined_count")])


def best_ocr_lines(candidates: DataFrame) -> DataFrame:
    """The subtitle line of each frame among its text candidates.

    candidates: (media_id, ts_ms, line_no, text, x_min, x_max, score, crop_width).
    """
    c = candidates.withColumn("plain", X.ocr_plain(F.col("text"))).withColumn(
        "centre", centredness(F.col("x_min"), F.col("x_max") - F.col("x_min"), F.col("crop_width")))
    c = c.where(X.has_cjk(F.col("plain")) & (F.col("centre") >= 0.45))
    rank = F.col("score") + F.col("centre") * 0.12 + F.least(F.length("plain"), F.lit(18)) * 0.004
    best = F.max(F.struct(rank.alias("rank"), (-F.col("line_no")).alias("first"), "plain", "score"))
    return c.groupBy("media_id", "ts_ms").agg(best.alias("b")).select(
        "media_id", "ts_ms", F.col("b.plain").alias("text"), F.col("b.score").alias("score"))


def transcript_metrics(words: DataFrame, durations: DataFrame, width_ms: int = 600_000) -> DataFrame:
    """Speech time without double counting, text units and words per medium.

    Words are sorted by start; each adds what reaches past the running maximum
    of the ends before it, so the sum is the length of the union. Words with
    one start are merged first, which bounds the rows of a time chunk.
    """
    valid = words.where((X.strip(F.coalesce("word", F.lit(""))) != "") & (F.col("end_ms") > F.col("start_ms")))
    counts = valid.groupBy("media_id").agg(
        F.count("*").alias("words"), F.sum(F.length(F.replace(X.strip(F.col("word")), F.lit(" "), F.lit("")))).alias("units"))
    clipped = valid.join(durations, "media_id").select(
        "media_id", F.greatest(F.lit(0), F.col("start_ms")).alias("s"), F.least(F.col("duration_ms"), F.col("end_ms")).alias("e"))
    spans = clipped.where("e > s").groupBy("media_id", "s").agg(F.max("e").alias("e"))
    spans = running(spans, Sequence(("media_id",), ("s",), width_ms), {"_reach": Run("max", F.col("e"), exclusive=True)})
    speech = spans.groupBy("media_id").agg(
        F.sum(F.greatest(F.lit(0), F.col("e") - F.greatest("s", F.coalesce("_reach", "s")))).alias("speech_ms"))
    m = durations.join(speech, "media_id", "left").join(counts, "media_id", "left")
    m = m.select("media_id", "duration_ms", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("speech_ms", "units", "words")])
    return m.withColumn("coverage", F.when(F.col("duration_ms") > 0, F.col("speech_ms") / F.col("duration_ms")).otherwise(0.0))


def sparse_transcripts(metrics: DataFrame) -> DataFrame:
    """Near-empty recognition on a substantial video."""
    floor = F.greatest(F.lit(750.0), F.col("duration_ms") * 0.015)
    return metrics.where((F.col("duration_ms") >= 30_000) & (F.col("speech_ms") < floor) & (F.col("units") < 4))


def best_attempt(metrics: DataFrame) -> DataFrame:
    """The transcript attempt with most text, then most speech, then the first."""
    best = F.max(F.struct("units", "speech_ms", (-F.col("attempt")).alias("first")))
    return metrics.groupBy("media_id").agg(best.alias("b")).select("media_id", (-F.col("b.first")).alias("attempt"))


def majority_speaker(rows: DataFrame, *group: str) -> DataFrame:
    """Most frequent known label of a group, the smallest on ties; null if none is known."""
    n = rows.groupBy(*group, "speaker").agg(F.count("*").alias("n"))
    best = F.min(F.when(F.col("speaker") != "", F.struct((-F.col("n")).alias("n"), "speaker")))
    return n.groupBy(*group).agg(best.getField("speaker").alias("majority"))
