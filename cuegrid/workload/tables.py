"""The derived tables themselves."""

from cuegrid.workload import views
from cuegrid.workload.registry import query

for _name in ("cues", "asr_track", "ocr_cues", "words", "regions", "intervals", "ocr_samples", "boxes", "jobs", "usage_events", "batches"):
    query(f"view_{_name}", _name, f"select * from {_name}")(
        lambda spark, sf_dir, _build=getattr(views, _name): _build(spark, sf_dir))
