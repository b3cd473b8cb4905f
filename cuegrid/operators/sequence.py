"""Operators over the ordered cues, words or samples of a medium.

Cues are (media_id, cue_id, start_ms, end_ms, content, speaker); cue_id is owned
by the source and never renumbered. All of these run as chunked scans, so a
long medium is spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.functions import timing as M
from cuegrid.plans.scan import Run, Sequence, islands, neighbours, numbered, paced, running, sections
from cuegrid.plans.store import cut

CUES = Sequence(("media_id",), ("cue_id",), 16_384)
WORDS = Sequence(("media_id",), ("pos",), 131_072)
DAY_MS = 86_400_000


def both_known_and_differ(a: Column, b: Column) -> Column:
    """An empty label is as unknown as a missing one."""
    a, b = F.nullif(a, F.lit("")), F.nullif(b, F.lit(""))
    return a.isNotNull() & b.isNotNull() & (a != b)


def joined_text(order: str, piece: Column) -> Column:
    """Pieces of a group in order, blank-separated; the groups are a few rows long."""
    rows = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), piece.alias("t"))))
    return F.array_join(F.transform(rows, lambda r: r["t"]), " ")


def id_list(order: str) -> Column:
    return F.array_sort(F.collect_list(order))


def repair_fragment_speakers(cues: DataFrame, seq: Sequence = CUES) -> DataFrame:
    """A fragment of 1-2 characters right behind a cue takes over its speaker."""
    size = F.length(F.regexp_replace("content", r"[^\p{L}\p{N}]", ""))
    runs = islands(
        cues, seq,
        {"start": F.col("start_ms"), "end": F.col("end_ms"), "size": size},
        lambda p, c: ~(c("size").between(1, 2) & (c("start") - p("end") <= 180)),
        out="_run",
    )
    within = Sequence((*seq.keys, "_run"), seq.order, seq.width)
    return running(runs, within, {"speaker_fixed": Run("first", F.col("speaker"))}).drop("_run")


def smooth_speaker_flips(words: DataFrame, seq: Sequence = WORDS) -> DataFrame:
    """Overwrite one-word flips shorter than 350 ms between two equal labels.

    Applied left to right a flip hides the next candidate, so of each run of
    consecutive candidates the 1st, 3rd, 5th ... are overwritten.
    """
    w = neighbours(words, seq, prev={"_before": F.col("speaker")}, next={"_after": F.col("speaker")})
    flip = (
        F.col("_before").isNotNull() & (F.col("_before") != "") & (F.col("_before") == F.col("_after"))
        & ~F.col("speaker").eqNullSafe(F.col("_before")) & (F.col("end_ms") - F.col("start_ms") < 350)
    )
    w = w.withColumn("_flip", F.coalesce(flip, F.lit(False)))
    # a candidate's place in its run: candidates so far, less those up to the last other word; nearly every word is a run of its own
    w = cut(running(w, seq, {"_upto": Run("sum", F.col("_flip").cast("int"))}))
    w = running(w, seq, {"_settled": Run("max", F.when(~F.col("_flip"), F.col("_upto")))})
    nth = F.col("_upto") - F.coalesce("_settled", F.lit(0))
    fixed = F.when(F.col("_flip") & (nth % 2 == 1), F.col("_before")).otherwise(F.col("speaker"))
    return w.withColumn("speaker_fixed", fixed).drop("_upto", "_settled", "_flip", "_before", "_after")


def scene_ids(cues: DataFrame, seq: Sequence = CUES, gap_ms: int = 2200) -> DataFrame:
    return islands(
        cues, seq, {"start": F.col("start_ms"), "end": F.col("end_ms")},
        lambda p, c: c("start") - p("end") >= gap_ms, out="scene_id",
    )


def hard_breaks(cues: DataFrame, seq: Sequence = CUES, gap_ms: int = 2800) -> DataFrame:
    """Add hard_break: no utterance may run from the previous cue into this one."""
    c = neighbours(cues, seq, prev={"_end": F.col("end_ms"), "_speaker": F.col("speaker")})
    hard = both_known_and_differ(F.col("_speaker"), F.col("speaker")) | (F.col("start_ms") - F.col("_end") >= gap_ms)
    return c.withColumn("hard_break", F.coalesce(hard, F.lit(False))).drop("_end", "_speaker")


def _phrase_needs(done: Column) -> dict[str, Column]:
    return {"start": F.col("start_ms"), "end": F.col("end_ms"), "speaker": F.col("speaker"), "done": done}


def _opens_phrase(gap_ms: int):
    return lambda p, c: p("done") | both_known_and_differ(p("speaker"), c("speaker")) | (c("start") - p("end") > gap_ms)


def phrase_ids(cues: DataFrame, seq: Sequence = CUES, gap_ms: int = 800) -> DataFrame:
    """Add phrase: display lines joined until punctuation, speaker change or pause."""
    return islands(cues, seq, _phrase_needs(X.ends_sentence(F.col("content"))), _opens_phrase(gap_ms), out="phrase")


def timed_sentences(lines: DataFrame, media_end: DataFrame, seq: Sequence = CUES, gap_ms: int = 800) -> DataFrame:
    """Sentences of display lines with all that timing needs of their lines, in one pass over them.

    The rows of sentences_of and phrase_gaps, next_ms (where the next sentence
    starts, or media_end_ms), and line_shares: of each line its id and the
    predicted length of the medium's lines before it and with it.
    """
    c = lines.select("media_id", "cue_id", "start_ms", "end_ms", "speaker", X.strip(F.col("content")).alias("content"),
                     F.greatest(F.lit(1), M.predict_ms(F.col("content"))).alias("_w"))
    c = sections(c, seq, _phrase_needs(F.col("content").rlike(X.SENTENCE_END)), _opens_phrase(gap_ms), out="phrase", first_flag="_first",
                 prev={"_end": "end"}, next={"_next": "start"}, totals={"_upto": F.col("_w")}, per_key=media_end)
    line = F.struct(
        "cue_id", "start_ms", "end_ms", "speaker", "content", F.when(F.col("_first") == 0, F.col("start_ms") - F.col("_end")).alias("gap"),
        F.coalesce("_next", "media_end_ms").alias("next"), F.struct("cue_id", (F.col("_upto") - F.col("_w")).alias("before"), F.col("_upto").alias("upto")).alias("share"))
    s = c.groupBy("media_id", "phrase").agg(F.sort_array(F.collect_list(line)).alias("_l"))
    first, last = F.col("_l")[0], F.element_at("_l", -1)
    return s.select(
        "media_id", "phrase", first["cue_id"].alias("utterance_id"), first["start_ms"].alias("start_ms"), last["end_ms"].alias("end_ms"), first["speaker"].alias("speaker"),
        F.array_join("_l.content", " ").alias("content"), F.col("_l.cue_id").alias("cue_ids"), last["next"].alias("next_ms"),
        (last["end_ms"] - first["start_ms"]).alias("source_span_ms"), F.greatest(F.lit(0), F.coalesce(F.array_max("_l.gap"), F.lit(0))).alias("max_internal_gap_ms"),
        F.size("_l").cast("long").alias("num_source_cues"), F.col("_l.share").alias("line_shares"))


def sentences_of(phrased: DataFrame) -> DataFrame:
    """One row per phrase: id and speaker of its first line, span of all lines."""
    return phrased.groupBy("media_id", "phrase").agg(
        F.min("cue_id").alias("utterance_id"),
        F.min_by("start_ms", "cue_id").alias("start_ms"), F.max_by("end_ms", "cue_id").alias("end_ms"),
        F.min_by(F.struct("speaker"), "cue_id").getField("speaker").alias("speaker"),
        joined_text("cue_id", X.strip(F.col("content"))).alias("content"), id_list("cue_id").alias("cue_ids"),
    )


def sentence_utterances(cues: DataFrame, seq: Sequence = CUES, gap_ms: int = 800) -> DataFrame:
    """Spoken sentences of display lines."""
    return sentences_of(phrase_ids(cues, seq, gap_ms))


def split_at_hard_breaks(lines: DataFrame, seq_width: int = 16_384) -> DataFrame:
    """Cut utterances where a line carries hard_break; rows are (media_id, utterance_id, cue_id, line, hard_break)."""
    seq = Sequence(("media_id", "utterance_id"), ("cue_id",), seq_width)
    parts = islands(lines, seq, {"hard": F.col("hard_break")}, lambda p, c: c("hard"), out="part")
    return parts.groupBy("media_id", "utterance_id", "part").agg(
        F.min("cue_id").alias("first_id"), id_list("cue_id").alias("cue_ids"), joined_text("cue_id", F.col("line")).alias("full_text"),
    )


def ocr_sessions(samples: DataFrame, seq: Sequence, step_ms: int = 400) -> DataFrame:
    """Runs of the same recognised text; a sample covers 3/4 step to either side."""
    pad, bridge = F.lit(step_ms * 3 / 4), F.lit(step_ms * 9 / 4)
    start, end = F.greatest(F.lit(0.0), F.col("ts_ms") - pad), F.col("ts_ms") + pad
    s = islands(
        samples, seq, {"text": F.col("text"), "start": start, "end": end},
        lambda p, c: (p("text") != c("text")) | (c("start") - p("end") > bridge), out="session",
    )
    return s.groupBy("media_id", "session").agg(
        F.floor(F.min(start)).cast("long").alias("start_ms"), F.floor(F.max(end)).cast("long").alias("end_ms"),
        F.first("text").alias("text"), F.sum("score_pct").alias("score_sum"), F.count("*").alias("samples"),
    )


def separate_spans(cues: DataFrame, least_ms: int = 350, space_ms: int = 20, width_ms: int = DAY_MS) -> DataFrame:
    """Give spans a minimum length and spacing, pushing later ones back.

    Pushed ends are a running maximum in disguise: with e = max(end, start+least)
    and d = least+space, the i-th end is max over j<=i of (e_j - d*j), plus d*i.
    """
    d = least_ms + space_ms
    seq = Sequence(("media_id",), ("start_ms", "end_ms", "cue_id"), width_ms)
    lifted = F.greatest(F.col("end_ms"), F.col("start_ms") + least_ms)
    c = paced(cues, seq, F.lit(d), lifted, "max", "_pace", "_upto", "_before")
    return (
        c.withColumn("timed_start_ms", F.greatest(F.col("start_ms"), F.col("_before") + F.col("_pace") - d + space_ms))
        .withColumn("timed_end_ms", F.col("_upto") + F.col("_pace")).drop("_pace", "_upto", "_before")
    )


def merge_intervals(cues: DataFrame, seq: Sequence = CUES, duration: Column | None = None) -> DataFrame:
    """Pad spans by 120/180 ms and join those at most 350 ms apart."""
    end = F.col("end_ms") + 180
    c = cues.withColumn("_s", F.greatest(F.lit(0), F.col("start_ms") - 120))
    c = c.withColumn("_e", F.least(end, duration) if duration is not None else end)
    c = running(c, seq, {"_reach": Run("max", F.col("_e"), exclusive=True)})
    opens = F.coalesce(F.col("_s") - F.col("_reach") > 350, F.lit(True))
    c = running(c, seq, {"span_id": Run("sum", F.when(opens, 1).otherwise(0))})
    return c.groupBy("media_id", "span_id").agg(F.min("_s").alias("start_ms"), F.max("_e").alias("end_ms"))


def speech_plans(utterances: DataFrame, spoken: Column, media_end: DataFrame, seq_width: int = 16_384) -> DataFrame:
    """Timing plan per utterance; media_end is (media_id, media_end_ms)."""
    seq = Sequence(("media_id",), ("utterance_id",), seq_width)
    u = neighbours(utterances, seq, next={"_next": F.col("start_ms")}).join(media_end, "media_id", "left")
    return planned(u.withColumn("next_ms", F.coalesce("_next", "media_end_ms")).drop("_next", "media_end_ms"), spoken)


def planned(utterances: DataFrame, spoken: Column) -> DataFrame:
    """Timing plan per utterance that knows where the next one starts (next_ms)."""
    u = utterances.withColumn("spoken_text", spoken)
    u = u.withColumn("target_ms", F.greatest(F.lit(250), F.col("end_ms") - F.col("start_ms")))
    u = u.withColumn("deadline_ms", F.greatest(F.col("target_ms"), F.col("next_ms") - F.col("start_ms")))
    u = u.withColumn("predicted_ms", M.predict_ms(F.col("spoken_text")))
    return (
        u.withColumn("emotion", M.emotion(F.col("content")))
        .withColumn("pace", M.pace(F.col("predicted_ms"), F.col("target_ms")))
        .withColumn("pause_before_ms", F.lit(0)).withColumn("pause_after_ms", M.pause_after_ms(F.col("spoken_text")))
        .drop("next_ms")
    )


def schedule(plans: DataFrame, seq_width: int = 16_384) -> DataFrame:
    """Start every clip at its planned time or right after the one before.

    plans carries start_ms, pause_before_ms, pause_after_ms, deadline_ms and
    fitted_ms. With P the total of clips and pauses before row i, the start is
    P_i plus the running maximum of (planned_j - P_j).
    """
    seq = Sequence(("media_id",), ("utterance_id",), seq_width)
    p = paced(plans, seq, F.col("fitted_ms") + F.col("pause_after_ms"), F.col("start_ms") + F.col("pause_before_ms"), "max", "_busy", "_slack")
    p = p.withColumn("scheduled_start_ms", F.col("_busy") + F.col("_slack"))
    return (
        p.withColumn("overflow_ms", F.greatest(F.lit(0), F.col("scheduled_start_ms") + F.col("fitted_ms") - (F.col("start_ms") + F.col("deadline_ms"))))
        .withColumn("shift_ms", F.col("scheduled_start_ms") - F.col("start_ms")).drop("_busy", "_slack")
    )


def retime(lines: DataFrame, seq_width: int = 16_384) -> DataFrame:
    """Spread a phrase's measured time over its lines by predicted length.

    lines are (media_id, phrase, cue_id, content, scheduled_start_ms, fitted_ms).
    """
    seq = Sequence(("media_id", "phrase"), ("cue_id",), seq_width)
    c = lines.withColumn("_w", F.greatest(F.lit(1), M.predict_ms(F.col("content"))))
    c = running(c, seq, {"_upto": Run("sum", F.col("_w")), "_before": Run("sum", F.col("_w"), exclusive=True)})
    whole = lines.withColumn("_w", F.greatest(F.lit(1), M.predict_ms(F.col("content")))).groupBy("media_id", "phrase").agg(
        F.sum("_w").alias("_all"), F.count("*").alias("_n"), F.max("cue_id").alias("_last"))
    c = c.join(whole, ["media_id", "phrase"])
    return _retimed(c).drop("_w", "_upto", "_before", "_all", "_n", "_last")


def _retimed(c: DataFrame) -> DataFrame:
    span = F.greatest(F.col("_n"), F.col("fitted_ms"))
    base = F.col("scheduled_start_ms")
    start = base + M.rounded(span * F.col("_before") / F.col("_all"))
    end = F.when(F.col("cue_id") == F.col("_last"), base + span).otherwise(base + M.rounded(span * F.col("_upto") / F.col("_all")))
    return c.withColumn("aligned_start_ms", start).withColumn("aligned_end_ms", F.greatest(F.col("aligned_start_ms") + 1, end))


def retime_shares(sentences: DataFrame) -> DataFrame:
    """retime from the line_shares of timed_sentences: rows of sentences become rows of lines, and no line is looked up.

    sentences are (media_id, utterance_id, line_shares, scheduled_start_ms, fitted_ms).
    """
    shares = F.col("line_shares")
    first, last = shares[0], F.element_at(shares, -1)
    c = sentences.select(
        "media_id", "utterance_id", "scheduled_start_ms", "fitted_ms", F.size(shares).cast("long").alias("_n"), first["before"].alias("_from"),
        (last["upto"] - first["before"]).alias("_all"), last["cue_id"].alias("_last"), F.explode(shares).alias("_s"))
    c = c.withColumns({"cue_id": F.col("_s.cue_id"), "_before": F.col("_s.before") - F.col("_from"), "_upto": F.col("_s.upto") - F.col("_from")})
    return _retimed(c).select("media_id", "utterance_id", "cue_id", "scheduled_start_ms", "fitted_ms", "aligned_start_ms", "aligned_end_ms")


def phrase_gaps(cues: DataFrame, seq_width: int = 16_384) -> DataFrame:
    """Per phrase: source span, largest pause inside, number of cues."""
    seq = Sequence(("media_id", "phrase"), ("cue_id",), seq_width)
    c = neighbours(cues, seq, prev={"_end": F.col("end_ms")})
    return c.groupBy("media_id", "phrase").agg(
        F.min("cue_id").alias("utterance_id"),
        (F.max_by("end_ms", "cue_id") - F.min_by("start_ms", "cue_id")).alias("source_span_ms"),
        F.greatest(F.lit(0), F.coalesce(F.max(F.col("start_ms") - F.col("_end")), F.lit(0))).alias("max_internal_gap_ms"),
        F.count("*").alias("num_source_cues"),
    )


def limit_font_steps(cues: DataFrame, size: str, seq: Sequence = CUES, step: int = 2) -> DataFrame:
    """Sizes may fall freely but rise by at most `step` from cue to cue."""
    c = paced(cues, seq, F.lit(step), F.col(size), "min", "_rise", "_low")
    return c.withColumn("font_size", F.col("_low") + F.col("_rise")).drop("_rise", "_low")


def translation_batches(cues: DataFrame, seq: Sequence = CUES, size: int = 30) -> DataFrame:
    """Add rank and batch_no: groups of `size` cues in order."""
    return numbered(cues, seq, "rank").withColumn("batch_no", F.floor((F.col("rank") - 1) / size).cast("long"))


def speaker_aliases(cues: DataFrame) -> DataFrame:
    """(media_id, speaker, alias) numbered by first appearance."""
    seen = cues.where("speaker is not null").groupBy("media_id", "speaker").agg(F.min("cue_id").alias("first_id"))
    order = Window.partitionBy("media_id").orderBy("first_id", "speaker")
    return seen.withColumn("alias", F.concat(F.lit("character_"), F.row_number().over(order).cast("string")))


def adjacent_repetitions(cues: DataFrame, seq: Sequence = CUES) -> DataFrame:
    """Cues that repeat the line before them."""
    bare = F.lower(X.strip(F.col("content")))
    c = neighbours(cues, seq, prev={"_said": bare})
    return c.where((bare == F.col("_said")) & (F.length(X.strip(F.col("content"))) > 4)).drop("_said")


def segments_to_cues(segments: DataFrame, seq: Sequence) -> DataFrame:
    """Timed segments (start_s, end_s, text) as cues numbered from 1 in order."""
    s = numbered(segments, seq, "cue_id")
    return s.select("media_id", "cue_id", M.seconds_to_ms(F.col("start_s")).alias("start_ms"), M.seconds_to_ms(F.col("end_s")).alias("end_ms"),
                    X.strip(F.col("text")).alias("content"))


def sample_grid(media: DataFrame, longest: int | None = None) -> DataFrame:
    """Detector timestamps of each medium from (media_id, duration_ms); `longest` spreads that many over a longer medium."""
    seconds = F.col("duration_ms") / 1000
    fps = F.when(seconds <= 120, 4).when(seconds <= 900, 2).otherwise(1)
    n = F.greatest(F.lit(1), M.rounded(seconds * fps))
    m = media.withColumn("_n", (n if longest is None else F.least(F.lit(longest), n)).cast("int"))
    m = m.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)))
    at = F.least(F.col("duration_ms"), F.floor((2 * F.col("sample_no") + 1) * F.col("duration_ms") / (2 * F.col("_n"))).cast("long"))
    return m.select("media_id", "sample_no", at.alias("ts_ms"))


def ocr_grid(media: DataFrame, samples_per_second: float = 2.5) -> DataFrame:
    """Text-recognition timestamps of each medium from (media_id, duration_ms): the middles of equal steps, none after the end."""
    step = 1000 / samples_per_second
    n = F.greatest(F.lit(1), M.rounded(F.col("duration_ms") / step)).cast("int")
    m = media.withColumn("sample_no", F.explode(F.sequence(F.lit(0), n - 1)))
    return m.select("media_id", "sample_no", F.least(F.col("duration_ms"), F.floor((F.col("sample_no") + 0.5) * step).cast("long")).alias("ts_ms"))


def refinement_grid(cues: DataFrame, per_pass: int = 7) -> DataFrame:
    """Re-scan timestamps of a weak cue: three shifted passes over its span."""
    # Share of the span by which a pass starts before the middle.
    shares = (0.45, 0.39, 0.33)
    span = F.greatest(F.lit(400), F.col("end_ms") - F.col("start_ms"))
    c = cues.withColumn("share", F.explode(F.array(*[F.lit(s) for s in shares])))
    c = c.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(per_pass - 1))))
    at = (F.col("start_ms") + F.col("end_ms")) / 2 - span * F.col("share") + F.col("sample_no") * span / F.lit(per_pass - 1)
    return c.withColumn("ts_ms", M.rounded(at))
