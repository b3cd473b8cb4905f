"""JSON reports of the media tools, and their tables.

Every reader takes (media_id, body) rows or a path pattern; report_texts turns
the latter into the former. A report belongs to one medium and one tool run.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PIPELINE_VERSION = "2.0"

WORD = "struct<word:string,start:double,end:double,speaker:string,score:double>"
TRANSCRIPT = f"language string, text string, word_segments array<{WORD}>, segments array<struct<start:double,end:double,text:string,words:array<{WORD}>>>, engine string, elapsed_seconds double, peak_gpu_gib double"
OCR_REPORT = "engine string, sample_fps double, items array<struct<start:double,end:double,text:string,score:double,samples:int>>"
REGION = "struct<x:int,y:int,width:int,height:int,confidence:double,start:double,end:double>"
REGION_REPORT = f"method string, video struct<width:int,height:int>, samples int, sample_fps double, detections int, active_cues array<bigint>, regions array<{REGION}>"
TIMING = """array<struct<id:bigint,predicted_ms:bigint,raw_original_ms:bigint,original_ms:bigint,fitted_ms:bigint,target_ms:bigint,
  hard_deadline_ms:bigint,available_window_ms:bigint,required_tempo:double,tempo:double,overflow_ms:bigint,emotion:string,intensity:double,
  style:string,pause_before_ms:bigint,pause_after_ms:bigint,source_start_ms:bigint,scheduled_start_ms:bigint,schedule_shift_ms:bigint,
  alignment_mode:string,source_span_ms:bigint,max_internal_gap_ms:bigint,num_source_cues:int,cue_ids:array<bigint>>>"""
MASTER = """warning string, utterances array<struct<id:bigint,cue_ids:array<bigint>,full_text:string,start:double,end:double,speaker:string>>,
  display_lines array<struct<id:bigint,text:string>>"""
MANIFEST = "pipeline_version string, artifacts map<string,struct<fingerprint:string,files:array<string>,completed_at:string,metadata:map<string,string>>>"


def report_texts(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(media_id, body) of whole report files; the folder name is the media id."""
    text = spark.read.text(paths, wholetext=True)
    media = F.regexp_extract(F.input_file_name(), r"(?:^|/)(?:media_id=)?([^/]+)/[^/]+$", 1)
    return text.select(media.alias("media_id"), F.regexp_replace("value", "^\ufeff", "").alias("body"))


#: Where a report of each kind has its rows; "$" is the report itself.
LISTS = {"words": "$.word_segments", "segments": "$.segments", "ocr": "$.items", "regions": "$.regions", "timing": "$", "utterances": "$.utterances", "lines": "$.display_lines"}


def report_status(reports: DataFrame, kind: str) -> DataFrame:
    """(media_id, status), one row for each report: ok, empty, no_list or unreadable. All but ok give a reader no row."""
    whole = F.try_parse_json("body")
    listed = whole if LISTS[kind] == "$" else F.try_variant_get(whole, LISTS[kind], "variant")
    rows = F.try_variant_get(listed, "$", "array<variant>")
    status = F.when(whole.isNull(), "unreadable").when(listed.isNull() | ~F.schema_of_variant(listed).startswith("ARRAY"), "no_list").when(F.size(rows) == 0, "empty").otherwise("ok")
    return reports.select("media_id", status.alias("status"))


def _parsed(reports: DataFrame, schema: str) -> DataFrame:
    return reports.select("media_id", F.from_json("body", schema).alias("r"))


def aligned_words(reports: DataFrame) -> DataFrame:
    r = _parsed(reports, TRANSCRIPT).select("media_id", F.posexplode("r.word_segments").alias("pos", "w"))
    return r.select("media_id", F.col("pos").cast("long").alias("pos"), "w.word", F.bround(F.col("w.start") * 1000).cast("long").alias("start_ms"),
                    F.bround(F.col("w.end") * 1000).cast("long").alias("end_ms"), F.nullif(F.trim("w.speaker"), F.lit("")).alias("speaker"))


def segment_cues(reports: DataFrame) -> DataFrame:
    """Recognised segments as cues numbered from 1."""
    r = _parsed(reports, TRANSCRIPT).select("media_id", F.posexplode("r.segments").alias("i", "s"))
    return r.select("media_id", (F.col("i") + 1).cast("long").alias("cue_id"), F.bround(F.col("s.start") * 1000).cast("long").alias("start_ms"),
                    F.bround(F.col("s.end") * 1000).cast("long").alias("end_ms"), F.regexp_replace("s.text", r"^\s+|\s+$", "").alias("content"))


def ocr_cues(reports: DataFrame) -> DataFrame:
    r = _parsed(reports, OCR_REPORT).select("media_id", F.posexplode("r.items").alias("i", "c"))
    return r.select("media_id", (F.col("i") + 1).cast("long").alias("cue_id"), F.bround(F.col("c.start") * 1000).cast("long").alias("start_ms"),
                    F.bround(F.col("c.end") * 1000).cast("long").alias("end_ms"), "c.text", "c.score", "c.samples")


def regions(reports: DataFrame) -> DataFrame:
    r = _parsed(reports, REGION_REPORT).select("media_id", "r.method", "r.video", F.posexplode_outer("r.regions").alias("region_id", "g"))
    return r.select("media_id", "method", F.col("video.width").alias("video_width"), F.col("video.height").alias("video_height"), "region_id", "g.*")


def _parts(rows: DataFrame, order: str, item: Column, name: str, per_part: int) -> DataFrame:
    """(media_id, part_no, name): rows in lists of at most per_part consecutive order values, so a report of any length has parts of bounded size."""
    listed = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("i"))))
    return (rows.groupBy("media_id", F.floor(F.col(order) / per_part).cast("long").alias("part_no")).agg(listed.alias("l"))
            .select("media_id", "part_no", F.transform("l", lambda x: x["i"]).alias(name)))


def region_reports(rows: DataFrame, video: DataFrame, per_part: int = 4_096) -> DataFrame:
    """(media_id, part_no, body); a medium of video without regions gets one part with an empty list.

    video: media_id, method, video_width, video_height, and of samples, sample_fps, detections and active_cues what is known.
    """
    listed = _parts(rows, "region_id", F.struct("x", "y", "width", "height", "confidence", "start", "end"), "regions", per_part)
    v = video.join(listed, "media_id", "left").withColumn("regions", F.coalesce("regions", F.array().cast(f"array<{REGION}>")))
    known = [c for c in ("samples", "sample_fps", "detections", "active_cues") if c in video.columns]
    size = F.struct(F.col("video_width").alias("width"), F.col("video_height").alias("height")).alias("video")
    return v.select("media_id", F.coalesce("part_no", F.lit(0)).alias("part_no"), F.to_json(F.struct("method", size, *known, "regions")).alias("body"))


def timing_reports(rows: DataFrame, per_part: int = 4_096) -> DataFrame:
    """(media_id, part_no, body) of timing rows; columns that a row lacks are left out."""
    fields = [f.name for f in T._parse_datatype_string(TIMING).elementType if f.name in rows.columns]
    return _parts(rows, "id", F.struct(*fields), "l", per_part).select("media_id", "part_no", F.to_json("l").alias("body"))


def master_reports(utterances: DataFrame, lines: DataFrame, warnings: DataFrame, per_part: int = 4_096) -> DataFrame:
    """(media_id, part_no, body) of (media_id, utterance_id, cue_ids, full_text, start_ms, end_ms, speaker), (media_id, cue_id, line) and (media_id, warning).

    A part holds the utterances and lines whose ids fall into it; the warning stands in every part.
    """
    said = F.struct(F.col("utterance_id").alias("id"), "cue_ids", "full_text", (F.col("start_ms") / 1000).alias("start"), (F.col("end_ms") / 1000).alias("end"), "speaker")
    u = _parts(utterances, "utterance_id", said, "utterances", per_part)
    d = _parts(lines, "cue_id", F.struct(F.col("cue_id").alias("id"), F.col("line").alias("text")), "display_lines", per_part)
    both = u.join(d, ["media_id", "part_no"], "full").join(warnings.select("media_id", "warning"), "media_id", "left")
    none = lambda c: F.coalesce(c, F.array().cast(both.schema[c].dataType)).alias(c)
    return both.select("media_id", "part_no", F.to_json(F.struct("warning", none("utterances"), none("display_lines"))).alias("body"))


def tts_timing(reports: DataFrame) -> DataFrame:
    r = reports.select("media_id", F.posexplode(F.from_json("body", TIMING)).alias("pos", "t"))
    return r.select("media_id", "pos", "t.*")


def master_utterances(reports: DataFrame) -> DataFrame:
    r = _parsed(reports, MASTER).select("media_id", F.posexplode("r.utterances").alias("pos", "u"))
    return r.select("media_id", "pos", F.col("u.id").alias("utterance_id"), "u.cue_ids", "u.full_text", "u.speaker",
                    F.bround(F.col("u.start") * 1000).cast("long").alias("start_ms"), F.bround(F.col("u.end") * 1000).cast("long").alias("end_ms"))


def master_lines(reports: DataFrame) -> DataFrame:
    r = _parsed(reports, MASTER).select("media_id", F.posexplode("r.display_lines").alias("pos", "d"))
    return r.select("media_id", "pos", F.col("d.id").alias("cue_id"), F.col("d.text").alias("line"))


def artifact_rows(reports: DataFrame, version: str = PIPELINE_VERSION) -> DataFrame:
    """Checkpointed steps; manifests of another pipeline version count as empty."""
    r = _parsed(reports, MANIFEST).where(F.col("r.pipeline_version") == version)
    r = r.select("media_id", F.explode("r.artifacts").alias("name", "a"))
    return r.select("media_id", "name", "a.fingerprint", "a.files", "a.completed_at", "a.metadata")


def write_reports(rows: DataFrame, path: str) -> None:
    """One folder per medium with its report text; the path is new."""
    rows.select("media_id", "body").write.partitionBy("media_id").text(path)


def write_bundle(rows: DataFrame, path: str) -> None:
    """Many whole reports a file, as rows of (media_id, body); a folder and a file for each of millions of media cost more than their texts."""
    rows.select("media_id", "body").write.parquet(path)


def bundle_texts(spark: SparkSession, path: str) -> DataFrame:
    """(media_id, body) of the reports of a bundle."""
    return spark.read.parquet(path).select("media_id", F.regexp_replace("body", "^\ufeff", "").alias("body"))
