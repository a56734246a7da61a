"""From raw documents to packed sequences: five stages, each written and read again by the next.

Every stage takes any columns besides doc_id, text and source, whatever their names, and returns them unchanged; an
empty table gives an empty one. Rows that share a doc_id, or have none, are documents of their own: none vanishes or
multiplies for that. Null, empty and blank texts pass the first three stages as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.lines import dedup_lines
from quillstone.llm.mixing import mix
from quillstone.llm.near_dedup import near_duplicates
from quillstone.llm.packing import pack
from quillstone.llm.quality import classify
from quillstone.llm.storage import cut, table, unique_ids

#: A document goes with its lines if it keeps less than this part of its characters: nearly all of it is in documents before it.
LEAST_LEFT = 0.2
#: Documents linked from this similarity on, in percent, are near-duplicates.
PERCENT = 80


def _others(docs: DataFrame) -> Column:
    return F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text"))


def _columns(docs: DataFrame, kept: str) -> list[Column]:
    """The columns of docs out of text and the struct of the others."""
    return [F.col("text") if c == "text" else F.col(kept)[c].alias(c) for c in docs.columns]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go. Rows are judged by their texts alone and not joined again."""
    return classify(docs, carry=_others(docs)).filter("kept").select(_columns(docs, "carried"))


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go, and with them documents that had words and keep none, or less than LEAST_LEFT of their characters; n_chars follows."""
    out = dedup_lines(docs, carry=F.struct(_others(docs).alias("others"), F.length("text").alias("before")))
    changed = F.size("removed") > 0
    stays = ~changed | (F.col("kept").rlike(r"[^\x20\x09-\x0D]") & (F.length("kept") >= LEAST_LEFT * F.col("carried.before")))
    out = out.filter(stays).select(F.col("kept").alias("text"), F.col("carried.others").alias("others"), changed.alias("changed"))
    n = [F.when(F.col("changed"), F.length("text")).otherwise(F.col("others")["n_chars"]).cast(docs.schema["n_chars"].dataType).alias("n_chars")] if "n_chars" in docs.columns else []
    kept = [F.col("text") if c == "text" else n[0] if c == "n_chars" else F.col("others")[c].alias(c) for c in docs.columns]
    return out.select(kept)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates, linked from a similarity of PERCENT, the document with the smallest doc_id stays."""
    rows, _ = unique_ids(docs, rows=True)
    dropped = near_duplicates(rows.select("doc_id", "text"), percent=PERCENT).filter(~F.col("kept")).select("doc_id")
    return rows.join(dropped, "doc_id", "left_anti").select(_columns(docs, "row"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each time, none if it is not taken. One without words stays."""
    rows, _ = unique_ids(docs, rows=True)
    times = mix(rows.select("doc_id", "text", F.col("row.source").alias("source"))).select("doc_id", F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.col("size")).cast("int").alias("times"))
    out = rows.hint("merge").join(times.filter("times > 0"), "doc_id")
    return out.select("text", "row", F.explode(F.array_repeat(F.lit(1), F.col("times")))).select(_columns(docs, "row"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row, however often it is there, as pieces of sequences."""
    return pack(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]
#: Trained models, similarity joins and tokenizers are beyond SQL; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
