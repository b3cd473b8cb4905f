"""Speech duration, pauses and speaking windows, all in integer milliseconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuegrid.functions.text import count_of, word_count

# Fixed values of the speech plan.
SYLLABLES_PER_SECOND = 3.45
MINOR_MARK_MS, MAJOR_MARK_MS, SHORTEST_MS = 180, 320, 350
MAX_DRIFT_RATIO, MAX_DRIFT_MS = 1.12, 220
MAX_TEMPO, LEAVE_TEMPO = 1.12, 1.03


def rounded(value: Column) -> Column:
    """Half-even rounding to an integer."""
    return F.bround(value).cast("long")


def seconds_to_ms(seconds: Column) -> Column:
    return rounded(seconds * 1000)


def predict_ms(text: Column) -> Column:
    spoken = word_count(text) / F.lit(SYLLABLES_PER_SECOND) * 1000
    pauses = MINOR_MARK_MS * count_of(text, "[,;:]") + MAJOR_MARK_MS * count_of(text, "[.!?]")
    return F.greatest(F.lit(SHORTEST_MS).cast("long"), rounded(spoken + pauses))


def emotion(text: Column) -> Column:
    return (
        F.when(text.contains("!"), "intense").when(text.contains("?"), "questioning")
        .when(text.contains("…") | text.contains("..."), "hesitant").otherwise("neutral")
    )


def pause_after_ms(text: Column) -> Column:
    t = F.regexp_replace(text, r"\s+$", "")
    return (
        F.when(t.rlike(r"(?:\.{2,}|…+)$"), 360).when(t.rlike(r"""\.["”’)]?$"""), 360)
        .when(t.rlike(r"""[!?]["”’)]?$"""), 320).when(t.rlike(r"""[;:]["”’)]?$"""), 240)
        .when(t.rlike(r""",["”’)]?$"""), 180).otherwise(100)
    )


def speech_window_ms(target: Column, deadline: Column, before: Column, after: Column) -> Column:
    soft = rounded(target * F.lit(MAX_DRIFT_RATIO)) + MAX_DRIFT_MS
    return F.greatest(target, F.least(deadline - before - after, soft))


def pace(predicted: Column, target: Column) -> Column:
    return F.least(F.lit(1.12), F.greatest(F.lit(0.94), predicted / F.greatest(F.lit(1), target)))


def fitted_ms(original: Column, window: Column) -> Column:
    """Length after the bounded speed-up; clips within 3% of the window stay as they are."""
    tempo = original / window
    unchanged = (window <= 0) | (original <= 0) | (tempo <= LEAVE_TEMPO)
    return F.when(unchanged, original).otherwise(rounded(original / F.least(F.lit(MAX_TEMPO), tempo)))


def max_words(duration_ms: Column) -> Column:
    return F.greatest(F.lit(2), F.least(F.lit(24), F.bround(duration_ms / 1000 * 3.2))).cast("int")


def overlap_ratio(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    shared = F.least(a_end, b_end) - F.greatest(a_start, b_start)
    longest = F.greatest(F.lit(1), a_end - a_start, b_end - b_start)
    return F.when(shared <= 0, 0.0).otherwise(shared / longest)
