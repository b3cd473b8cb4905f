"""Frame geometry for burned-in text, in pixels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuegrid.functions.timing import rounded


def centredness(x: Column, w: Column, frame_width: Column) -> Column:
    half = frame_width / 2
    return F.greatest(F.lit(0.0), 1 - F.abs(x + w / 2 - half) / half)


def background_box(
    x: Column, y: Column, width: Column, height: Column,
    text_width: Column, line_count: Column, font_size: Column, frame_width: Column, frame_height: Column,
) -> Column:
    """Box that covers the region and the rendered text, kept inside the frame."""
    pad_x = F.greatest(F.lit(18), rounded(frame_width * 0.014))
    pad_y = F.greatest(F.lit(8), rounded(frame_height * 0.010))
    w = F.least(frame_width, F.greatest(width, text_width + pad_x * 2))
    h = F.least(frame_height, F.greatest(height, rounded(font_size * 1.22 * line_count + pad_y * 2)))
    cx, cy = x + F.floor(width / 2), y + F.floor(height / 2)
    bx = F.greatest(F.lit(0), F.least(frame_width - w, cx - F.floor(w / 2)))
    by = F.greatest(F.lit(0), F.least(frame_height - h, cy - F.floor(h / 2)))
    return F.struct(
        bx.cast("long").alias("x"), by.cast("long").alias("y"), w.cast("long").alias("width"), h.cast("long").alias("height"),
        F.greatest(F.lit(8), rounded(h * 0.18)).cast("long").alias("radius"),
    )
