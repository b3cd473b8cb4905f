"""SubRip text in and out, ids kept as they are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuegrid.sources.reports import report_texts

TIME = r"\d+:\d\d:\d\d[,.]\d+"
#: The place before a block's head, and the head itself.
BEFORE_HEAD = rf"(?m)(?=^[ \t]*\d+[ \t]*\n{TIME} *--> *{TIME})"
HEAD = rf"^[ \t]*(\d+)[ \t]*\n({TIME}) *--> *({TIME})[^\n]*"


def timecode(ms: Column) -> Column:
    whole = F.floor(ms / 1000)
    return F.format_string(
        "%02d:%02d:%02d,%03d", F.floor(whole / 3600).cast("long"), (F.floor(whole / 60) % 60).cast("long"), (whole % 60).cast("long"), (ms % 1000).cast("long"))


def timecode_ms(code: Column) -> Column:
    p = F.split(code, "[:,.]")
    return ((p[0].cast("long") * 60 + p[1].cast("long")) * 60 + p[2].cast("long")) * 1000 + p[3].cast("long")


def srt_block(cue_id: Column, start_ms: Column, end_ms: Column, content: Column) -> Column:
    """One block; blank lines inside a line's text would end it early and are closed up."""
    legal = F.regexp_replace(F.regexp_replace(content, r"^\n+|\n+$", ""), r"\n{2,}", "\n")
    return F.concat(cue_id.cast("string"), F.lit("\n"), timecode(start_ms), F.lit(" --> "), timecode(end_ms), F.lit("\n"), legal, F.lit("\n\n"))


def srt_texts(cues: DataFrame, lines_per_part: int = 16_384) -> DataFrame:
    """(media_id, part_no, srt_text): parts of bounded length whose concatenation is the file."""
    block = srt_block(F.col("cue_id"), F.col("start_ms"), F.col("end_ms"), F.coalesce("content", F.lit("")))
    c = cues.select("media_id", "cue_id", F.floor(F.col("cue_id") / lines_per_part).cast("long").alias("part_no"), block.alias("block"))
    parts = F.array_sort(F.collect_list(F.struct("cue_id", "block")))
    return c.groupBy("media_id", "part_no").agg(F.array_join(F.transform(parts, lambda p: p["block"]), "").alias("srt_text"))


def write_srt(cues: DataFrame, path: str) -> None:
    """One folder per medium under a new path; file names sort in cue order.

    Range partitioning splits a long medium over several files in order.
    """
    block = srt_block(F.col("cue_id"), F.col("start_ms"), F.col("end_ms"), F.coalesce("content", F.lit("")))
    rows = cues.select("media_id", "cue_id", block.alias("value"))
    ordered = rows.repartitionByRange("media_id", "cue_id").sortWithinPartitions("media_id", "cue_id")
    # The writer ends every row with the block's closing line break.
    ordered.select("media_id", F.regexp_replace("value", r"\n$", "").alias("value")).write.option("lineSep", "\n").partitionBy("media_id").text(path)


def srt_blocks(texts: DataFrame) -> DataFrame:
    """(media_id, block_no, block): texts cut before every head, so a block may have any length; block 0 has no head."""
    body = F.regexp_replace(F.regexp_replace("body", r"\r\n?", "\n"), "^\ufeff", "")
    cut = F.split(F.concat(F.lit("\n"), body), BEFORE_HEAD)
    return texts.select("media_id", F.posexplode(cut).alias("block_no", "block"))


def parse_srt(texts: DataFrame) -> DataFrame:
    """Cues of (media_id, body) texts; a text is one SubRip file or one whole part of it."""
    b = srt_blocks(texts).where(F.col("block").rlike(HEAD))
    content = F.regexp_replace(F.regexp_replace("block", HEAD, ""), r"^\n+|\n+$", "")
    return b.select("media_id", F.regexp_extract("block", HEAD, 1).cast("long").alias("cue_id"), timecode_ms(F.regexp_extract("block", HEAD, 2)).alias("start_ms"),
                    timecode_ms(F.regexp_extract("block", HEAD, 3)).alias("end_ms"), content.alias("content"))


def malformed_blocks(texts: DataFrame) -> DataFrame:
    """(media_id, block_no, problem): text before the first head, and time lines inside a block that have no number above.

    Nothing of a file disappears without a row here or in parse_srt.
    """
    stray = (F.col("block_no") == 0) & F.regexp_replace("block", r"\s+", "").rlike(".")
    inner = F.regexp_replace("block", HEAD, "").rlike(rf"(?m)^[ \t]*{TIME} *-->")
    problem = F.when(stray, "no_head").when(inner, "no_number")
    return srt_blocks(texts).select("media_id", "block_no", problem.alias("problem")).where("problem is not null")


def read_srt(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Cues of SubRip files kept in one folder per medium."""
    return parse_srt(report_texts(spark, paths))
