"""Quality rules over the tables of a finished medium.

Every rule flags rows. `findings` lists all of them, one row each; `checks`
gives one verdict per medium and rule, with the first ids only. A rule whose
input table has no row for a medium gives no verdict for it.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.plans.scan import Sequence, neighbours

# Severity of a broken rule, and limits.
CUE_RULES = {
    "empty_lines": "error", "empty_noise": "warning", "untranslated_text": "error", "subtitle_timing": "error",
    "adjacent_repetition": "warning", "orphan_fragments": "warning",
}
TIMING_RULES = {
    "tts_speed": "warning", "tts_deadlines": "warning", "tts_source_span": "warning",
    "tts_internal_gap": "warning", "tts_cue_alignment": "error",
}
LAYOUT_RULES = {"adaptive_subtitle_layout": "error", "source_pixels_covered": "error"}
MAX_TEMPO, MAX_OVERFLOW_MS, MAX_SPAN_MS, MAX_GAP_MS = 1.12, 150, 14_000, 800
ALIGNED = "punctuated_sentence"
#: How many ids a report lists for these rules; the others list all of theirs.
LISTED_IDS = dict.fromkeys((
    "empty_noise", "untranslated_text", "adjacent_repetition", "orphan_fragments", *TIMING_RULES), 20)


def _flags(rules: dict[str, Column]) -> Column:
    return F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(False)), F.lit(name)) for name, bad in rules.items()]), lambda f: f.isNotNull())


def cue_flags(cues: DataFrame, source: DataFrame, seq_width: int = 65_536) -> DataFrame:
    """Flags of translated lines. cues adds pos (list order); source: (media_id, cue_id, ...)."""
    bare = X.strip(F.col("content"))
    c = neighbours(cues, Sequence(("media_id",), ("pos",), seq_width), prev={"_said": F.lower(bare)})
    noise = X.ignorable(F.col("content"), F.col("end_ms") - F.col("start_ms"))
    c = c.join(source.select("media_id", "cue_id", noise.alias("_noise")), ["media_id", "cue_id"], "left")
    blank = bare == ""
    return c.select("media_id", F.col("cue_id").alias("item_id"), F.col("pos"), _flags({
        "empty_lines": blank & ~F.coalesce("_noise", F.lit(False)),
        "empty_noise": blank & F.col("_noise"),
        "untranslated_text": X.has_cjk(F.col("content")),
        "subtitle_timing": (F.col("start_ms") < 0) | (F.col("end_ms") <= F.col("start_ms")),
        "adjacent_repetition": (F.lower(bare) == F.col("_said")) & (F.length(bare) > 4),
        "orphan_fragments": (X.word_count(F.col("content")) <= 2) & bare.endswith("."),
    }).alias("flags"))


def timing_flags(timing: DataFrame) -> DataFrame:
    t = F.col
    return timing.select("media_id", t("utterance_id").alias("item_id"), t("utterance_id").alias("pos"), _flags({
        "tts_speed": t("tempo") > MAX_TEMPO, "tts_deadlines": t("overflow_ms") > MAX_OVERFLOW_MS,
        "tts_source_span": t("source_span_ms") > MAX_SPAN_MS, "tts_internal_gap": t("max_internal_gap_ms") > MAX_GAP_MS,
        "tts_cue_alignment": ~t("alignment_mode").eqNullSafe(ALIGNED) | (t("schedule_shift_ms") < 0),
    }).alias("flags"))


def aligned_flags(aligned: DataFrame, seq_width: int = 65_536) -> DataFrame:
    """Voice-aligned lines that are empty in time or overlap the line before; aligned adds pos."""
    a = neighbours(aligned, Sequence(("media_id",), ("pos",), seq_width), prev={"_end": F.col("end_ms")})
    return a.select("media_id", F.col("cue_id").alias("item_id"), "pos", _flags({
        "tts_subtitle_sync": (F.col("end_ms") <= F.col("start_ms")) | (F.col("start_ms") < F.col("_end")),
    }).alias("flags"))


def layout_flags(layout: DataFrame) -> DataFrame:
    """layout: (media_id, cue_id, font, font_size, line_count, background STRUCT, region STRUCT)."""
    c, b, r = F.col, lambda n: F.coalesce(F.col(f"background.{n}"), F.lit(0)), lambda n: F.coalesce(F.col(f"region.{n}"), F.lit(0))
    fits = F.coalesce(c("font"), F.lit("")) != ""
    valid = fits & c("font_size").between(12, 80) & c("line_count").isin(1, 2) & (b("radius") > 0)
    uncovered = (
        (b("x") > r("x")) | (b("y") > r("y")) | (b("x") + b("width") < r("x") + r("width")) | (b("y") + b("height") < r("y") + r("height"))
    )
    return layout.select("media_id", c("cue_id").alias("item_id"), c("cue_id").alias("pos"), _flags({
        "adaptive_subtitle_layout": ~F.coalesce(valid, F.lit(False)), "source_pixels_covered": uncovered,
    }).alias("flags"))


def consistency_flags(utterances: DataFrame, display: DataFrame) -> DataFrame:
    """Utterances whose display lines speak other words than the full text."""
    u = utterances.select("media_id", "utterance_id", "full_text", F.posexplode_outer("cue_ids").alias("i", "cue_id"))
    shown = u.join(display.select("media_id", "cue_id", "line"), ["media_id", "cue_id"], "left").groupBy("media_id", "utterance_id").agg(
        F.first("full_text").alias("full_text"), F.array_sort(F.collect_list(F.struct("i", F.coalesce("line", F.lit("")).alias("line")))).alias("l"))
    words = lambda text: F.regexp_extract_all(X.folded(text), F.lit(f"({X.WORD}+)"), F.lit(1))
    s = shown.withColumn("a", words(F.array_join(F.transform("l", lambda x: x["line"]), " "))).withColumn("b", words(F.coalesce("full_text", F.lit(""))))
    return s.select("media_id", F.col("utterance_id").alias("item_id"), F.col("utterance_id").alias("pos"),
                    _flags({"dialogue_master_consistency": F.col("a") != F.col("b")}).alias("flags"))


def order_flags(actual: DataFrame, expected: DataFrame, name: str, optional: bool = True) -> DataFrame:
    """Positions where the id list differs from the expected one.

    Both are (media_id, item_id, rank) with ranks 1..n, so equality of two
    lists is a join on the rank, never a collected list. An optional list is
    judged only for media that have it.
    """
    a = actual.select("media_id", "rank", F.col("item_id").alias("_got"))
    e = expected.select("media_id", "rank", "item_id")
    if optional:
        e = e.join(actual.select("media_id").distinct(), "media_id", "left_semi")
    both = e.join(a, ["media_id", "rank"], "full")
    return both.select("media_id", F.coalesce("item_id", "_got").alias("item_id"), F.col("rank").alias("pos"),
                       _flags({name: ~F.col("item_id").eqNullSafe(F.col("_got"))}).alias("flags"))


def verdicts(flagged: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(media_id, name, severity, bad) for each rule, from one pass over the flagged rows."""
    counts = [F.count_if(F.array_contains("flags", name)).alias(name) for name in rules]
    n = flagged.groupBy("media_id").agg(*counts)
    rows = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.lit(sev).alias("worst"), F.col(name).alias("bad")) for name, sev in rules.items()]))
    v = n.select("media_id", rows.alias("r")).select("media_id", "r.*")
    return v.select("media_id", "name", F.when(F.col("bad") > 0, F.col("worst")).otherwise("pass").alias("severity"), "bad")


def _fold_empty(v: DataFrame) -> DataFrame:
    """Blank lines give one verdict: the error outweighs harmless noise."""
    rest = v.where(~F.col("name").isin("empty_lines", "empty_noise"))
    pair = v.where(F.col("name").isin("empty_lines", "empty_noise")).groupBy("media_id").agg(
        F.sum(F.when(F.col("name") == "empty_lines", F.col("bad")).otherwise(0)).alias("e"), F.sum(F.when(F.col("name") == "empty_noise", F.col("bad")).otherwise(0)).alias("w"))
    one = pair.select("media_id", F.lit("empty_lines").alias("name"), F.when(F.col("e") > 0, "error").when(F.col("w") > 0, "warning").otherwise("pass").alias("severity"),
                      F.when(F.col("e") > 0, F.col("e")).otherwise(F.col("w")).alias("bad"))
    return rest.unionByName(one)


def mask_verdicts(regions: DataFrame) -> DataFrame:
    """regions: rows of the region report, one with a null region_id if it lists none."""
    c, has = F.col, F.col("region_id").isNotNull()
    invalid = has & (
        (c("width") <= 0) | (c("height") <= 0) | (c("start") < 0) | (c("end") <= c("start")) | (c("x") < 0) | (c("y") < 0)
        | (c("x") + c("width") > c("video_width")) | (c("y") + c("height") > c("video_height")))
    m = regions.groupBy("media_id").agg(
        F.count_if(has).alias("n"), F.count_if(invalid).alias("bad"), F.coalesce(F.min("confidence"), F.lit(0.0)).alias("confidence"), F.min("method").alias("method"))
    sev = F.when((c("bad") > 0) | (c("n") == 0), "error").when((c("confidence") < 0.5) | (c("method") == "lower_band_fallback"), "warning").otherwise("pass")
    return m.select("media_id", F.lit("source_subtitle_mask").alias("name"), sev.alias("severity"), "bad")


def stream_verdicts(probe: DataFrame) -> DataFrame:
    ok = F.coalesce((F.col("duration_ms") > 0) & F.col("has_audio") & F.col("has_video"), F.lit(False))
    return probe.select("media_id", F.lit("media_streams").alias("name"), F.when(ok, "pass").otherwise("error").alias("severity"), F.when(ok, 0).otherwise(1).cast("long").alias("bad"))


def provider_verdicts(masters: DataFrame) -> DataFrame:
    warned = F.coalesce("warning", F.lit("")) != ""
    return masters.select("media_id", F.lit("dialogue_master_provider").alias("name"), F.when(warned, "warning").otherwise("pass").alias("severity"), warned.cast("long").alias("bad"))


def _worst_of(v: DataFrame, name: str) -> DataFrame:
    """Several id or timing tests reported under one name."""
    return v.groupBy("media_id").agg(F.sum("bad").alias("bad")).select(
        "media_id", F.lit(name).alias("name"), F.when(F.col("bad") > 0, "error").otherwise("pass").alias("severity"), "bad")


def checks(
    cues: DataFrame, expected: DataFrame, source: DataFrame, *,
    timing: DataFrame | None = None, timing_ids: DataFrame | None = None, aligned: DataFrame | None = None,
    utterances: DataFrame | None = None, utterance_ids: DataFrame | None = None, display: DataFrame | None = None, masters: DataFrame | None = None,
    regions: DataFrame | None = None, layout: DataFrame | None = None, probe: DataFrame | None = None,
) -> DataFrame:
    """All verdicts (media_id, name, severity, bad).

    cues, aligned and display have pos = 1..n in list order; expected,
    timing_ids and utterance_ids are (media_id, item_id, rank).
    """
    def ranks(df: DataFrame) -> DataFrame:
        return df.select("media_id", F.col("cue_id").alias("item_id"), F.col("pos").alias("rank"))

    parts = [verdicts(order_flags(ranks(cues), expected, "subtitle_ids", optional=False), {"subtitle_ids": "error"}), _fold_empty(verdicts(cue_flags(cues, source), CUE_RULES))]
    if timing is not None:
        parts.append(verdicts(timing_flags(timing), TIMING_RULES))
        parts.append(verdicts(order_flags(timing_ids, expected, "tts_cue_coverage"), {"tts_cue_coverage": "error"}))
        if aligned is not None:
            aligned = aligned.join(timing.select("media_id").distinct(), "media_id", "left_semi")
            ids = verdicts(order_flags(ranks(aligned), expected, "tts_subtitle_sync"), {"tts_subtitle_sync": "error"})
            parts.append(_worst_of(ids.unionByName(verdicts(aligned_flags(aligned), {"tts_subtitle_sync": "error"})), "tts_subtitle_sync"))
    if utterances is not None:
        ids = verdicts(order_flags(ranks(display), expected, "dialogue_master_ids"), {"dialogue_master_ids": "error"})
        more = verdicts(order_flags(utterance_ids, expected, "dialogue_master_ids"), {"dialogue_master_ids": "error"})
        parts += [_worst_of(ids.unionByName(more), "dialogue_master_ids"), provider_verdicts(masters),
                  verdicts(consistency_flags(utterances, display), {"dialogue_master_consistency": "error"})]
    if regions is not None:
        parts.append(mask_verdicts(regions))
    if layout is not None:
        parts.append(verdicts(layout_flags(layout), LAYOUT_RULES))
    if probe is not None:
        parts.append(stream_verdicts(probe))
    return reduce(DataFrame.unionByName, parts)


def findings(flagged: DataFrame) -> DataFrame:
    """Every flagged row: (media_id, name, item_id, pos)."""
    return flagged.select("media_id", F.explode("flags").alias("name"), "item_id", "pos")


def first_findings(found: DataFrame, limits: dict[str, int] = LISTED_IDS) -> DataFrame:
    """The ids a report message shows, up to the rule's limit if it has one; that applies before the shuffle."""
    w = Window.partitionBy("media_id", "name").orderBy("pos", "item_id")
    limited = found.where(F.col("name").isin(*limits))
    most = reduce(lambda c, kv: c.when(F.col("name") == kv[0], kv[1]), limits.items(), F.when(F.lit(False), 0))
    # the window's rank limit needs one number; rules with a smaller one are cut after it
    top = limited.withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= max(limits.values(), default=0)).where(F.col("_k") <= most)
    whole = found.where(~F.col("name").isin(*limits)).select("*", F.struct("pos", "item_id").alias("_o"))
    return top.select("media_id", "name", "item_id", F.struct(F.col("pos"), "item_id").alias("_o")).unionByName(whole.select("media_id", "name", "item_id", "_o")).groupBy("media_id", "name").agg(F.transform(F.array_sort(F.collect_list("_o")), lambda x: x["item_id"]).alias("ids"))


def summary(checked: DataFrame) -> DataFrame:
    """Counts per severity and the status a medium ends with."""
    s = checked.groupBy("media_id").pivot("severity", ["pass", "warning", "error"]).agg(F.count("name"))
    s = s.fillna(0, ["pass", "warning", "error"])
    return s.withColumn("status", F.when(F.col("error") > 0, "needs_review").otherwise("done"))
