"""Candidates out of recognised words: by keyword, as power and cost, by section, in tables and as key and value."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import dims
from ..functions.expr import has_any, numbers, region, strip
from .extract import LEAST_COST, power_hits

#: Words beside which each field stands.
KEYWORDS = {"dealer": dims.DEALER_WORDS, "HP": dims.POWER_WORDS, "cost": dims.COST_WORDS}


def standard_words(rows: DataFrame) -> DataFrame:
    """text, x1, y1, x2, y2, confidence, page out of text, box (corner points), score and page_num; others are kept."""
    xs, ys = F.transform("box", lambda p: p[0]), F.transform("box", lambda p: p[1])
    out = rows.withColumns({"x1": F.array_min(xs), "y1": F.array_min(ys), "x2": F.array_max(xs), "y2": F.array_max(ys), "confidence": F.col("score").cast("double"), "page": F.col("page_num")})
    return out.drop("box", "score", "page_num")


def confident(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """Rows of at least that confidence."""
    return rows.filter(F.col("confidence") >= least)


def keyword_words(words: DataFrame, keywords: list[str]) -> DataFrame:
    """Words whose text holds one of the keywords, whatever the case."""
    return words.filter(has_any(F.lower("text"), [k.lower() for k in keywords]))


def power_candidates(words: DataFrame) -> DataFrame:
    """All columns and value: each power that a text names beside a power word or unit, from 15 to 100, once a word."""
    values = F.array_distinct(F.transform(power_hits(F.col("text")), lambda h: h["hp"]))
    return words.select(*words.columns, F.explode(values).alias("value"))


def cost_candidates(words: DataFrame, least: int = LEAST_COST) -> DataFrame:
    """All columns and value: each number of at least least in a text with a cost word."""
    values = F.filter(F.transform(numbers(F.col("text")), lambda n: n.cast("long")), lambda n: n >= least)
    return keyword_words(words, dims.COST_WORDS).select(*words.columns, F.explode(values).alias("value"))


def sections(words: DataFrame, page_height: int = 1000) -> DataFrame:
    """Adds section: header, body or footer by the middle of the box."""
    return words.withColumn("section", region((F.col("y1") + F.col("y2")) / 2, page_height))


def table_rows(words: DataFrame, keys: tuple[str, ...] = ("doc_id",), height: int = 20) -> DataFrame:
    """keys, row, cells (texts from left to right) of each band of so many pixels that holds two words at least."""
    rows = words.groupBy(*keys, F.floor((F.col("y1") + F.col("y2")) / 2 / height).alias("row")).agg(F.array_sort(F.collect_list(F.struct("x1", "pos", "text"))).alias("c"))
    return rows.filter(F.size("c") > 1).select(*keys, "row", F.transform("c", lambda c: c["text"]).alias("cells"))


def key_values(rows: DataFrame) -> DataFrame:
    """All columns but cells, with key and value: the first cell, without a colon at its end, and the others joined by spaces."""
    key = F.regexp_replace(strip(F.get("cells", F.lit(0))), r"\s*:$", "")
    return rows.select(*(c for c in rows.columns if c != "cells"), key.alias("key"), F.array_join(F.slice("cells", 2, 1 << 20), " ").alias("value"))


def best_candidate(found: DataFrame, keys: tuple[str, ...] = ("doc_id",), valid: Column | None = None) -> DataFrame:
    """The surest candidate of each document (ties: smaller page, then pos, where there are any), of those that are valid."""
    order = [F.desc("confidence"), *(c for c in ("page", "pos") if c in found.columns), F.desc("value")]
    rows = found if valid is None else found.filter(valid)
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def all_present(row: DataFrame, fields: tuple[str, ...]) -> DataFrame:
    """Adds complete: whether every field has a value."""
    ok = F.lit(True)
    for name in fields:
        ok = ok & F.col(name).isNotNull()
    return row.withColumn("complete", ok)


def process_words(words: DataFrame, page_height: int = 1000, least: float = 0.5) -> DataFrame:
    """doc_id, power, cost: the best valid candidates of each document's confident words."""
    good = sections(confident(words, least), page_height)
    power = best_candidate(power_candidates(good)).select("doc_id", F.col("value").alias("power"))
    cost = best_candidate(cost_candidates(good)).select("doc_id", F.col("value").alias("cost"))
    return all_present(words.select("doc_id").distinct().join(power, "doc_id", "left").join(cost, "doc_id", "left"), ("power", "cost"))
