"""Comparing returned ids and texts with what was asked for."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuegrid.functions import text as X
from cuegrid.functions.timing import max_words
from cuegrid.plans.scan import Sequence, neighbours

# What a spoken direction may contain.
EMOTIONS = ("neutral", "warm", "sad", "tense", "angry", "questioning")
STYLES = ("doc_truyen", "tu_nhien")


def reconcile_ids(expected: DataFrame, returned: DataFrame, group: list[str], seq_width: int = 65_536) -> DataFrame:
    """Per group: ids missing, extra, duplicated, and whether the order was kept.

    expected: (group, item_id, rank); returned: (group, item_id, pos). Ids are
    counted per group first, so repeated answers shrink before the join.
    """
    counts = returned.groupBy(*group, "item_id").agg(F.count("*").alias("times"), F.min("pos").alias("pos"))
    both = expected.select(*group, "item_id", "rank").join(counts, [*group, "item_id"], "full")
    moved = neighbours(
        both.where("pos is not null and rank is not null"), Sequence(tuple(group), ("pos",), seq_width), prev={"_rank": F.col("rank")},
    ).groupBy(*group).agg(F.bool_or(F.col("rank") < F.col("_rank")).alias("reordered"))
    r = both.groupBy(*group).agg(
        F.count_if(F.col("times").isNull()).alias("missing"), F.count_if(F.col("rank").isNull()).alias("extra"),
        F.count_if(F.col("times") > 1).alias("duplicated"))
    r = r.join(moved, group, "left").withColumn("reordered", F.coalesce("reordered", F.lit(False)))
    clean = (F.col("missing") == 0) & (F.col("extra") == 0) & (F.col("duplicated") == 0) & ~F.col("reordered")
    partial = (F.col("extra") == 0) & (F.col("duplicated") == 0)
    return r.withColumn("exact", clean).withColumn("usable_if_partial", partial)


def review_view(source: DataFrame, translated: DataFrame) -> DataFrame:
    t = translated.select("media_id", "cue_id", F.col("text").alias("translation"))
    return source.join(t, ["media_id", "cue_id"], "left").withColumn("translation", F.coalesce("translation", F.lit("")))


def apply_edits(cues: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    """Overlay edited texts; edits: keys + edited. Adds was_edited."""
    c = cues.join(edits, keys, "left").withColumn("was_edited", F.col("edited").isNotNull())
    return c.withColumn("content", F.coalesce(X.strip(F.col("edited")), F.col("content"))).drop("edited")


def rejected_edits(cues: DataFrame, edits: DataFrame, keys: list[str]) -> DataFrame:
    return edits.join(cues.select(*keys), keys, "left_anti")


def apply_directions(plans: DataFrame, replies: DataFrame) -> DataFrame:
    """Spoken directions, taken over row by row once a batch of 30 has exactly its ids.

    plans: (media_id, batch_no, id, spoken_text, emotion, intensity, style,
    pause_before_ms, pause_after_ms); replies: the same names after media_id,
    batch_no and id, prefixed with new_.
    """
    keys = ["media_id", "batch_no", "id"]
    last = replies.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in replies.columns if c.startswith("new_")]), "pos").alias("n"))
    both = plans.select(*keys, F.lit(True).alias("asked")).join(last.select(*keys, F.lit(True).alias("answered")), keys, "full")
    whole = both.groupBy("media_id", "batch_no").agg(F.bool_and(F.coalesce(F.col("asked") & F.col("answered"), F.lit(False))).alias("whole")).where("whole")
    p = plans.join(last, keys, "left").join(whole, ["media_id", "batch_no"], "left")
    spoken = X.strip(F.coalesce("n.new_spoken_text", F.lit("")))
    mood = F.lower(F.coalesce("n.new_emotion", F.lit("neutral")))
    style = F.lower(F.coalesce("n.new_style", F.lit("doc_truyen")))
    p = p.withColumns({"_spoken": spoken, "_mood": mood, "_style": style}).withColumns(
        {"_key": X.lexical_key(F.col("_spoken")), "_old_key": X.lexical_key(F.col("spoken_text"))})
    ok = F.coalesce(F.col("whole"), F.lit(False)) & (F.col("_spoken") != "") & (F.col("_key") == F.col("_old_key")) & F.col("_mood").isin(*EMOTIONS) & F.col("_style").isin(*STYLES)
    p = p.withColumn("_ok", ok)

    def clamp(value: Column, default, low, high) -> Column:
        return F.least(F.lit(high), F.greatest(F.lit(low), F.coalesce(value, F.lit(default))))

    def taken(new: Column, old: str) -> Column:
        return F.when(F.col("_ok"), new).otherwise(F.col(old))

    return p.select(
        *keys, taken(F.col("_spoken"), "spoken_text").alias("spoken_text"), taken(F.col("_mood"), "emotion").alias("emotion"),
        taken(F.round(clamp(F.col("n.new_intensity"), 0.45, 0.30, 0.75), 2), "intensity").alias("intensity"), taken(F.col("_style"), "style").alias("style"),
        taken(clamp(F.col("n.new_pause_before_ms"), 0, 0, 120), "pause_before_ms").alias("pause_before_ms"),
        taken(clamp(F.col("n.new_pause_after_ms"), 100, 60, 280), "pause_after_ms").alias("pause_after_ms"),
        F.when(F.col("_ok"), "ai").otherwise("fallback").alias("prosody_source"))


def resumable_batches(cues: DataFrame, drafts: DataFrame) -> DataFrame:
    """Batches whose every cue has a draft and every real line a non-blank one.

    cues: (media_id, batch_no, cue_id, content, start_ms, end_ms); drafts: (media_id, cue_id, text).
    """
    c = cues.join(drafts.select("media_id", "cue_id", "text"), ["media_id", "cue_id"], "left")
    noise = X.ignorable(F.col("content"), F.col("end_ms") - F.col("start_ms"))
    ok = F.col("text").isNotNull() & (noise | (X.strip(F.coalesce("text", F.lit(""))) != ""))
    return c.groupBy("media_id", "batch_no").agg(F.bool_and(ok).alias("resumable"))


def missing_translations(cues: DataFrame, answers: DataFrame) -> DataFrame:
    """Real dialogue lines without a usable answer."""
    real = cues.where(~X.ignorable(F.col("content"), F.col("end_ms") - F.col("start_ms")))
    usable = answers.where(X.strip(F.coalesce("text", F.lit(""))) != "")
    return real.join(usable.select("media_id", "cue_id"), ["media_id", "cue_id"], "left_anti")


def merge_repairs(answers: DataFrame, repairs: DataFrame) -> DataFrame:
    """The repair round overrides the first answer where it says anything."""
    r = repairs.select("media_id", "cue_id", F.col("text").alias("_repair"))
    return answers.join(r, ["media_id", "cue_id"], "full").withColumn("text", F.coalesce("_repair", "text")).drop("_repair")


def overlong(lines: DataFrame) -> DataFrame:
    """Lines more than two words over what their time allows."""
    limit = max_words(F.col("end_ms") - F.col("start_ms"))
    return lines.withColumn("max_words", limit).where(X.split_count(F.col("text")) > F.col("max_words") + 2)


def accept_shortened(lines: DataFrame, shortened: DataFrame) -> DataFrame:
    """Overlay shorter wordings; a medium with a blank one keeps its lines."""
    blank = shortened.where(X.strip(F.coalesce("short", F.lit(""))) == "").select("media_id").distinct()
    good = shortened.join(blank, "media_id", "left_anti").select("media_id", "cue_id", "short")
    return lines.join(good, ["media_id", "cue_id"], "left").withColumn("text", F.coalesce("short", "text")).drop("short")


def master_coverage(expected: DataFrame, utterances: DataFrame, seq_width: int = 65_536) -> DataFrame:
    """Do the utterances, in order, use every expected id exactly once and contiguously?

    expected: (media_id, cue_id, rank) with ranks 1..n; utterances: (media_id,
    pos, cue_ids). Flattened ids equal the expected list exactly if each flat
    row's rank is one more than the rank before it, the first is 1 and the
    count agrees; no list is ever collected.
    """
    flat = utterances.select("media_id", F.col("pos").cast("long").alias("pos"), F.posexplode("cue_ids").alias("i", "cue_id"))
    flat = flat.join(expected, ["media_id", "cue_id"], "left")
    seq = Sequence(("media_id",), ("pos", "i"), seq_width)
    flat = neighbours(flat, seq, prev={"_rank": F.col("rank")})
    good = F.coalesce(F.col("rank") == F.coalesce("_rank", F.lit(0)) + 1, F.lit(False))
    got = flat.groupBy("media_id").agg(F.count("*").alias("used"), F.bool_and(good).alias("in_order"))
    want = expected.groupBy("media_id").agg(F.count("*").alias("wanted"))
    r = want.join(got, "media_id", "left")
    covered = F.coalesce(F.col("in_order") & (F.col("used") == F.col("wanted")), F.lit(False))
    return r.select("media_id", "wanted", F.coalesce("used", F.lit(0)).alias("used"), covered.alias("covered"))


def check_chunk(chunk: DataFrame, existing: DataFrame, batches: DataFrame) -> DataFrame:
    """Verdict per upload chunk: new positions, a harmless repeat, or the reason to refuse.

    chunk: (chunk_id, batch_id, position); existing: (batch_id, position).
    """
    c = chunk.join(batches.select("batch_id", "expected_episodes"), "batch_id")
    c = c.join(existing.select("batch_id", "position", F.lit(True).alias("_known")), ["batch_id", "position"], "left")
    per_pos = c.groupBy("chunk_id", "batch_id", "position", "expected_episodes").agg(F.count("*").alias("times"), F.max("_known").alias("known"))
    per = per_pos.groupBy("chunk_id", "batch_id").agg(
        F.bool_or((F.col("times") > 1) | ~F.col("position").between(1, F.col("expected_episodes"))).alias("bad"),
        F.count_if("known").alias("known"), F.count("*").alias("n"))
    verdict = (
        F.when(F.col("bad"), "duplicated_or_outside").when(F.col("known") == 0, "accepted")
        .when(F.col("known") == F.col("n"), "already_uploaded").otherwise("overlap")
    )
    return per.select("chunk_id", "batch_id", verdict.alias("verdict"))


def replace_positions(memberships: DataFrame, replacements: DataFrame) -> DataFrame:
    """Swap in new episodes at given (batch_id, position)."""
    kept = memberships.join(replacements.select("batch_id", "position"), ["batch_id", "position"], "left_anti")
    return kept.unionByName(replacements.select(*memberships.columns))


def request_payloads(cues: DataFrame, context: DataFrame) -> DataFrame:
    """One request per batch of 30 with its items and surrounding lines, as JSON text.

    cues: (media_id, batch_no, cue_id, content, speaker_alias, start_ms,
    end_ms); context: (media_id, batch_no, cue_id, content, speaker_alias, in_batch).
    """
    ms = F.col("end_ms") - F.col("start_ms")
    item = F.struct(F.col("cue_id").alias("id"), F.col("content").alias("text"), F.col("speaker_alias").alias("speaker"),
                    F.round(ms / 1000, 2).alias("target_duration_seconds"), max_words(ms).alias("max_words"))
    around = F.struct(F.col("cue_id").alias("id"), F.col("content").alias("text"), F.col("speaker_alias").alias("speaker"), F.col("in_batch").alias("translate"))
    items = cues.groupBy("media_id", "batch_no").agg(F.array_sort(F.collect_list(item)).alias("items"))
    lines = context.groupBy("media_id", "batch_no").agg(F.array_sort(F.collect_list(around)).alias("context"))
    r = items.join(lines, ["media_id", "batch_no"])
    return r.select("media_id", "batch_no", F.transform("items", lambda i: i["id"]).alias("expected_ids"),
                    F.to_json(F.struct("items", "context")).alias("request"))
