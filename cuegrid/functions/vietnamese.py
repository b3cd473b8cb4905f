"""Numbers and measures in spoken Vietnamese."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuegrid.functions.text import one_spaced

# Digit words and spoken unit names.
DIGITS = ("không", "một", "hai", "ba", "bốn", "năm", "sáu", "bảy", "tám", "chín")
UNITS = {
    "m²": "mét vuông", "m2": "mét vuông", "m³": "mét khối", "m3": "mét khối",
    "km/h": "ki lô mét một giờ", "km": "ki lô mét", "cm": "xen ti mét",
    "mm": "mi li mét", "kg": "ki lô gam", "g": "gam", "%": "phần trăm",
}


def _digit(n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(d) for d in DIGITS]), (n + 1).cast("int"))


def spell_digits(text: Column) -> Column:
    return F.array_join(F.transform(F.split(text, ""), lambda d: _digit(d.cast("int"))), " ")


def _below_hundred(n: Column) -> Column:
    tens, ones = F.floor(n / 10), n % 10
    after_ten = F.when(ones == 0, "").when(ones == 5, " lăm").otherwise(F.concat(F.lit(" "), _digit(ones)))
    after_tens = F.when(ones == 1, " mốt").otherwise(after_ten)
    return (
        F.when(n < 10, _digit(n)).when(n < 20, F.concat(F.lit("mười"), after_ten))
        .otherwise(F.concat(_digit(tens), F.lit(" mươi"), after_tens))
    )


def _below_thousand(n: Column) -> Column:
    hundreds, rest = F.floor(n / 100), n % 100
    tail = F.when(rest == 0, "").otherwise(
        F.concat(F.when(rest < 10, " lẻ ").otherwise(" "), _below_hundred(rest)))
    return F.when(n < 100, _below_hundred(n)).otherwise(F.concat(_digit(hundreds), F.lit(" trăm"), tail))


def integer_words(value: Column) -> Column:
    n = F.abs(value.cast("long"))
    thousands, rest = F.floor(n / 1000), n % 1000
    with_thousands = F.concat(
        _below_thousand(thousands), F.lit(" nghìn"),
        F.when(rest == 0, "").otherwise(F.concat(F.lit(" "), _below_thousand(rest))),
    )
    plain = (
        F.when(n < 1000, _below_thousand(n)).when(n < 1_000_000, with_thousands)
        .otherwise(spell_digits(n.cast("string")))
    )
    return F.when(value < 0, F.concat(F.lit("âm "), plain)).otherwise(plain)


def spoken_text(text: Column) -> Column:
    """Read numbers that carry a unit; the text between them stays."""
    edge = r"[\p{L}\p{N}_]"
    units = "|".join(sorted(UNITS, key=len, reverse=True))
    pattern = rf"(?i)(?<!{edge})(\d+)\s*({units})(?!{edge})"
    flat = one_spaced(text)
    names = F.create_map(*[F.lit(x) for pair in UNITS.items() for x in pair])

    def spoken(number: Column, unit: Column) -> Column:
        read = F.when(F.length(number) <= 6, integer_words(number.cast("long"))).otherwise(spell_digits(number))
        return F.concat(read, F.lit(" "), F.element_at(names, F.lower(unit)))

    between = F.split(flat, pattern, -1)
    numbers = F.regexp_extract_all(flat, F.lit(pattern), F.lit(1))
    found = F.regexp_extract_all(flat, F.lit(pattern), F.lit(2))
    measures = F.zip_with(numbers, found, spoken)
    woven = F.array_join(F.zip_with(between, measures, lambda t, m: F.concat(t, F.coalesce(m, F.lit("")))), "")
    return F.when(F.size(numbers) == 0, flat).otherwise(one_spaced(woven))
