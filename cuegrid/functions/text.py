"""Text predicates and rewrites as column expressions."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# Character classes and patterns of the dialogue rules.
# What counts as blank: ASCII white space, the separators U+001C to U+001F, and the blanks of Unicode, as the ideographic one.
BLANK = r"\s\x{1C}-\x{1F}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
WORD = r"[\p{L}\p{N}_\x{C0}-\x{1EF9}]"
CJK = r"[\x{3400}-\x{9FFF}]"
TERMINAL = r"""[.!?…,:;]\s*["”')\]}]*$"""
SENTENCE_END = r"""[.!?…]["”’)]?\s*$"""
UNIT_END = r"""[.!?。！？][)"”’]?\s*$"""
SOURCE_END = r"""[。！？!?]["”’)]?\s*$"""
ELLIPSIS_TAIL = r"(?:\.{3,}|…+)\s*$"
ELLIPSIS = r"\s*(?:\.{3,}|…+)\s*"
OCR_MARKS = rf"[{BLANK}，。！？,.!?]"
PAUSE_MARKS = ",;:!?。.，、！？…"
SOURCE_MARKS = {
    "?": "?", "？": "?", "!": "!", "！": "!", "。": ".", ".": ".",
    "，": ",", "、": ",", ",": ",", "…": "...",
}
QUESTION_PARTICLES = ("吗", "呢", "吧", "嘛", "么")


def strip(text: Column) -> Column:
    return F.regexp_replace(text, rf"^[{BLANK}]+|[{BLANK}]+$", "")


def one_spaced(text: Column) -> Column:
    return strip(F.regexp_replace(text, rf"[{BLANK}]+", " "))


def count_of(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def word_count(text: Column) -> Column:
    return count_of(text, WORD + "+")


def split_count(text: Column) -> Column:
    """Number of blank-separated pieces."""
    return count_of(text, rf"[^{BLANK}]+")


def compact(text: Column) -> Column:
    """Letters, digits and CJK only, underscore kept."""
    return F.regexp_replace(text, r"[^\p{L}\p{N}_\x{3400}-\x{9FFF}]", "")


def ignorable(text: Column, duration_ms: Column) -> Column:
    """Recognition noise that may stay silent."""
    core = compact(text)
    return (F.char_length(core) <= 1) | ((duration_ms <= 500) & core.rlike("^[A-Za-z]{1,3}$"))


def has_cjk(text: Column) -> Column:
    return text.rlike(CJK)


def has_terminal(text: Column) -> Column:
    return strip(text).rlike(TERMINAL)


def ends_sentence(text: Column) -> Column:
    return strip(text).rlike(SENTENCE_END)


def source_tail(source: Column) -> Column:
    """Mark the translated line should end with, judged by the source line."""
    clean = strip(F.coalesce(source, F.lit("")))
    tail = F.right(clean, F.lit(1))
    out = F.when(clean == "", "")
    for mark, mapped in SOURCE_MARKS.items():
        out = out.when(tail == mark, mapped)
    return out.when(tail.isin(*QUESTION_PARTICLES), "?").otherwise("")


def append_mark(text: Column, source: Column, fallback: str = ".") -> Column:
    clean = strip(F.coalesce(text, F.lit("")))
    tail = source_tail(source)
    return F.when((clean == "") | clean.rlike(TERMINAL), clean).otherwise(
        F.concat(clean, F.when(tail == "", fallback).otherwise(tail)))


def ocr_plain(text: Column) -> Column:
    return F.regexp_replace(text, OCR_MARKS, "")


def join_spoken(left: Column, right: Column, source_left: Column) -> Column:
    """Join two display lines, dropping a sentence end the source does not have."""
    source = strip(source_left)
    base = F.regexp_replace(left, rf"[{BLANK}]+$", "")
    bare = F.regexp_replace(base, rf"[.!?。！？]+[{BLANK}]*$|[{BLANK}]+$", "")
    bare = F.regexp_replace(bare, rf"[{BLANK}]+$", "")
    with_comma = F.when(source.rlike(r"[,，、]\s*$") & ~bare.endswith(","), F.concat(bare, F.lit(","))).otherwise(bare)
    kept = F.when(source.rlike(r"[。！？!?]\s*$"), base).otherwise(with_comma)
    return strip(F.concat(kept, F.lit(" "), F.regexp_replace(right, rf"^[{BLANK}]+", "")))


def balanced_lines(text: Column, count: Column) -> Column:
    """Split the words into `count` lines, longer ones first; null if too few words."""
    words = F.filter(F.split(text, rf"[{BLANK}]+"), lambda w: w != "")

    def lines(s: Column) -> Column:
        n = F.size(s["words"])
        base, extra = F.floor(n / s["count"]).cast("int"), (n % s["count"]).cast("int")
        parts = F.transform(
            F.sequence(F.lit(0), s["count"] - 1),
            lambda i: F.array_join(
                F.slice(s["words"], i * base + F.least(i, extra) + 1, base + F.when(i < extra, 1).otherwise(0)), " "),
        )
        return F.when((s["count"] >= 1) & (n >= s["count"]), parts)

    # Inside a lambda nothing is worked out twice unless it is a variable: the words of a text are split once, not once a line.
    return F.get(F.transform(F.array(F.struct(words.alias("words"), count.cast("int").alias("count"))), lines), F.lit(0))


def pause_clauses(text: Column) -> Column:
    """Clauses with their closing marks; marks without text before them are dropped."""
    flat = F.regexp_replace(one_spaced(text), r"\.{3,}", "…")
    raw = F.regexp_extract_all(flat, F.lit(rf"([^{PAUSE_MARKS}]+(?:[{PAUSE_MARKS}]\s*)*)"), F.lit(1))
    clean = F.transform(raw, lambda c: F.regexp_replace(F.trim(c), rf"([{PAUSE_MARKS}])\s+", "$1"))
    return F.filter(clean, lambda c: c.rlike(rf"[^{PAUSE_MARKS}]"))


def clause_pause_ms(clause: Column) -> Column:
    return (
        F.when(clause.rlike(r"(?:\.{2,}|…+)$"), 380).when(clause.rlike(r"[!?！？]+$"), 340)
        .when(clause.rlike(r"\.+$"), 380).when(clause.rlike(r"[:;]+$"), 260)
        .when(clause.endswith(","), 210).otherwise(0)
    )


def _mapped(batches: Iterator[pa.Array], change: Callable[[str], str]) -> Iterator[pa.Array]:
    """change of every text; only some hundred texts are Python values at a time."""
    for batch in batches:
        parts = [pa.array([t and change(t) for t in batch.slice(k, 256).to_pylist()], pa.string()) for k in range(0, len(batch), 256)]
        yield pa.concat_arrays(parts) if parts else pa.array([], pa.string())


@F.arrow_udf(StringType())
def _composed(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _mapped(text, lambda t: unicodedata.normalize("NFC", t))


@F.arrow_udf(StringType())
def _composed_folded(text: Iterator[pa.Array]) -> Iterator[pa.Array]:
    return _mapped(text, lambda t: unicodedata.normalize("NFC", t).casefold())


def nfc(text: Column) -> Column:
    """Texts without characters from U+0300 on are composed as they are and do not go to Python."""
    return F.coalesce(_composed(F.when(text.rlike(r"[^\x{0}-\x{2FF}]"), text)), text)


def nfc_folded(text: Column) -> Column:
    """ASCII folds as it is lower-cased and does not go to Python."""
    return F.coalesce(_composed_folded(F.when(text.rlike(r"[^\x{0}-\x{7F}]"), text)), F.lower(text))


@F.pandas_udf(StringType())
def folded(text: pd.Series) -> pd.Series:
    return text.map(str.casefold, na_action="ignore")


def lexical_key(text: Column) -> Column:
    """Words of the text, insensitive to case, composition and punctuation."""
    return F.array_join(F.regexp_extract_all(nfc_folded(text), F.lit(f"({WORD}+)"), F.lit(1)), " ")


def natural_key(filename: Column) -> Column:
    """Array that orders digit runs as numbers and the rest as folded text."""
    name = F.regexp_extract(filename, r"([^/]*)/*$", 1)
    parts = F.regexp_extract_all(name, F.lit(r"(\d+|[^\d]+)"), F.lit(1))

    def part(p: Column) -> Column:
        digits = p.rlike(r"^\d+$")
        bare = F.regexp_replace(p, r"^0+(?=\d)", "")
        return F.struct(
            F.when(digits, 0).otherwise(1).alias("kind"),
            F.when(digits, F.length(bare)).otherwise(0).alias("digits"),
            F.when(digits, bare).otherwise(F.lower(p)).alias("text"),
        )

    keyed = F.transform(parts, part)
    blank = F.array(F.struct(F.lit(1).alias("kind"), F.lit(0).alias("digits"), F.lit("").alias("text")))
    # A name that begins with digits sorts as if an empty text came first.
    return F.when(name.rlike(r"^\d"), F.concat(blank, keyed)).otherwise(keyed)


def safe_label(label: Column) -> Column:
    clean = F.regexp_replace(label, r'[<>:"/\\|?*\x00-\x1f]+', "-")
    clean = F.regexp_replace(clean, r"^[ .\-]+|[ .\-]+$", "")
    return F.when(clean == "", "video").otherwise(clean)
