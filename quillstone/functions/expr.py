"""Scalar column functions over text, numbers and boxes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

NATIVE_DIGITS = "०१२३४५६७८९૦૧૨૩૪૫૬૭૮૯"


def strip(text: Column) -> Column:
    """Without white space at its ends, Unicode's included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def ascii_digits(text: Column) -> Column:
    return F.translate(text, NATIVE_DIGITS, "0123456789" * 2)


def numbers(text: Column) -> Column:
    """All whole numbers of a text as decimals, once currency marks, dots and commas are taken out ("1,200.50" is 120050)."""
    found = F.regexp_extract_all(ascii_digits(F.translate(text, "₹Rs.,", "")), F.lit(r"(\d+)"), 1)
    return F.transform(found, lambda x: x.try_cast("decimal(38,0)"))


def has_any(text: Column, words: list[str]) -> Column:
    """Whether one of the words is a part of text; words need not stand alone, and text must be in lower case for lower-case words to match."""
    # a word that holds another one says nothing more
    least = [w for w in dict.fromkeys(words) if not any(v != w and v in w for v in words)]
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(w)) for w in sorted(least, key=len)))


def confidence(ocr: Column, match: float | Column, place: float | Column = 1.0) -> Column:
    match = F.lit(float(match)) if isinstance(match, (int, float)) else match
    place = F.lit(float(place)) if isinstance(place, (int, float)) else place
    return F.bround(F.lit(0.4) * ocr + F.lit(0.4) * match + F.lit(0.2) * place, 2)


def region(center_y: Column, height: int = 600) -> Column:
    """header in the top 35 %, footer in the bottom 25 %, else body; both limits belong to them."""
    return F.when(center_y <= height * 0.35, "header").when(center_y >= height * 0.75, "footer").otherwise("body")


def quad_to_box(quad: Column) -> Column:
    xs, ys = F.transform(quad, lambda p: p[0]), F.transform(quad, lambda p: p[1])
    return F.struct(*(f(c).cast("int").alias(n) for n, f, c in (("x1", F.array_min, xs), ("y1", F.array_min, ys), ("x2", F.array_max, xs), ("y2", F.array_max, ys))))


def ltwh_to_box(left: Column, top: Column, width: Column, height: Column) -> Column:
    return F.struct(left.alias("x1"), top.alias("y1"), (left + width).alias("x2"), (top + height).alias("y2"))


def engine_confidence(value: Column) -> Column:
    """Percent to a share; -1 (no text) is 0."""
    return F.when(value == -1, F.lit(0.0)).otherwise(value / 100.0)


def iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Intersection over union of boxes x1, y1, x2, y2; 0 where they only touch or are apart."""
    w = F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"])
    h = F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"])
    area = lambda r: (r["x2"] - r["x1"]) * (r["y2"] - r["y1"])
    union = area(a) + area(b) - w * h
    return F.when((w <= 0) | (h <= 0) | (union <= 0), F.lit(0.0)).otherwise((w * h) / union.cast("double"))


def expand_box(box: Column, margin: int, width: int, height: int) -> Column:
    clip = lambda c, top: F.greatest(F.lit(0), F.least(c, F.lit(top)))
    return F.struct(clip(box["x1"] - margin, width).alias("x1"), clip(box["y1"] - margin, height).alias("y1"), clip(box["x2"] + margin, width).alias("x2"), clip(box["y2"] + margin, height).alias("y2"))


def clamp(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def symbol(text: Column, strict: bool = True) -> Column:
    """Kind of mark a text holds. strict: a ticked circle is circle_filled and a single letter a handwritten mark; else it is a tick."""
    kinds = [("tick", "✓✔√"), ("cross", "✗✘Xx"), ("circle_filled", "☑"), ("circle_empty", "☐")] if strict else [("tick", "✓✔☑√"), ("cross", "✗✘Xx"), ("circle_empty", "☐")]
    out = F.when(strip(text).rlike(r"^\p{L}$"), "handwritten_mark") if strict else F.lit(None).cast("string")
    for kind, marks in reversed(kinds):
        out = F.when(has_any(text, list(marks)), kind).otherwise(out)
    return out


def currency(value: Column, unit: str = "INR") -> Column:
    return F.when(value.isNull(), F.lit(f"{unit} N/A")).otherwise(F.concat(F.lit(unit + " "), F.format_number(value, 0)))


def percentage(share: Column) -> Column:
    return F.format_string("%.1f%%", share * 100.0)


def first_word(text: Column) -> Column:
    return F.get(F.split(strip(F.lower(text)), r"\s+"), F.lit(0))


# Language names and the codes of the two kinds of engines.
LANGUAGES = {"eng": "en", "english": "en", "hin": "hi", "hindi": "hi", "guj": "gu", "gujarati": "gu"}


LONG_LANGUAGES = {"eng": "eng", "english": "eng", "en": "eng", "hin": "hin", "hindi": "hin", "hi": "hin", "guj": "guj", "gujarati": "guj", "gu": "guj"}


def language_list(names: Column) -> Column:
    """Three-letter codes of an array of language names, each once and sorted, joined by +; eng for unknown ones and for none."""
    known = F.create_map(*(F.lit(x) for kv in LONG_LANGUAGES.items() for x in kv))
    codes = F.array_sort(F.array_distinct(F.transform(names, lambda n: F.coalesce(F.try_element_at(known, F.lower(n)), F.lit("eng")))))
    return F.when(F.coalesce(F.size(names), F.lit(0)) > 0, F.array_join(codes, "+")).otherwise("eng")


def language_code(name: Column) -> Column:
    """Two-letter code of a language name or three-letter code; en if unknown."""
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in LANGUAGES.items() for x in kv)), F.lower(name)), F.lit("en"))
