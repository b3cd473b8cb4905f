"""Operators put together: from words to source dialogue, from lines to a dubbing timeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuegrid.functions import timing as M
from cuegrid.functions import vietnamese as V
from cuegrid.operators import folds, sequence
from cuegrid.plans.scan import Sequence
from cuegrid.plans.store import cut


def source_dialogue(words: DataFrame, seq: Sequence = sequence.WORDS) -> DataFrame:
    """Aligned words -> numbered cues with repaired speakers."""
    smooth = sequence.smooth_speaker_flips(folds.clean_words(words), seq)
    cues = folds.group_words(smooth, seq, speaker="speaker_fixed").select("media_id", "cue_id", "start_ms", "end_ms", "content", "speaker")
    fixed = sequence.repair_fragment_speakers(cut(cues))
    return fixed.drop("speaker").withColumnRenamed("speaker_fixed", "speaker")


def spoken_sentences(lines: DataFrame, media_end: DataFrame) -> DataFrame:
    """Display lines -> sentences with their speech plan and speaking window."""
    plans = sequence.planned(sequence.timed_sentences(lines, media_end), V.spoken_text(F.col("content")))
    window = M.speech_window_ms(F.col("target_ms"), F.col("deadline_ms"), F.col("pause_before_ms"), F.col("pause_after_ms"))
    return plans.withColumn("window_ms", window)


def dub_timing(sentences: DataFrame, clips: DataFrame | None = None) -> DataFrame:
    """Timing report: one row per sentence on a timeline without overlaps.

    clips may give measured lengths as (media_id, utterance_id, original_ms);
    without them the predicted length stands in.
    """
    if clips is None:
        s = sentences.withColumn("original_ms", F.col("predicted_ms"))
    else:
        s = sentences.join(clips, ["media_id", "utterance_id"])
    window = F.greatest(F.lit(1), F.col("window_ms"))
    s = s.withColumn("fitted_ms", M.fitted_ms(F.col("original_ms"), window))
    t = sequence.schedule(s)
    return t.withColumn("required_tempo", F.round(F.col("original_ms") / window, 4)).withColumn(
        "tempo", F.round(F.col("original_ms") / F.greatest(F.lit(1), F.col("fitted_ms")), 4)).withColumn(
        "alignment_mode", F.lit("punctuated_sentence")).withColumnRenamed("shift_ms", "schedule_shift_ms")


def aligned_lines(timing: DataFrame) -> DataFrame:
    """Display lines moved to the audio that speaks them; timing is that of dub_timing."""
    return sequence.retime_shares(timing)
