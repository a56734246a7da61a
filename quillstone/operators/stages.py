"""The recognition, layout and extraction steps over whole folders, each with the files it leaves."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources import files
from ..sources.engines import Provider, recognise
from .document import extracted_document
from .layout import page_layout, with_regions
from .merge import dedupe_blocks
from .report import seeded_sample

PAGE = ("doc_id", "page_number")
LIMIT = 100


def sampled(rows: DataFrame, limit: int | None = LIMIT, seed: int = 7) -> DataFrame:
    """All rows of at most limit documents, chosen by a seeded hash; of all documents if limit is none or 0."""
    return rows.join(seeded_sample(rows.select("doc_id").distinct(), "doc_id", limit, seed), "doc_id", "left_semi") if limit else rows


def recognition_step(pages: DataFrame, providers: dict[str, Provider], limit: int | None = LIMIT, output: str | None = None) -> DataFrame:
    """Blocks of the pages (doc_id, page_number, data) by all engines, near-equal ones of a page once. With output also as
    {doc_id}_page{n}_ocr_output.json, for pages without blocks too."""
    pages = sampled(pages, limit)
    blocks = dedupe_blocks(recognise(pages, providers), PAGE)
    if output:
        item = F.struct("pos", "text", F.array("x1", "y1", "x2", "y2").alias("bbox"), "confidence")
        lists = blocks.groupBy(*PAGE).agg(F.transform(F.array_sort(F.collect_list(item)), lambda b: F.struct(b["text"].alias("text"), b["bbox"].alias("bbox"), b["confidence"].alias("confidence"))).alias("ocr_blocks"))
        empty = F.expr("array()").cast("array<struct<text:string,bbox:array<bigint>,confidence:double>>")
        full = pages.select(*PAGE).join(lists, list(PAGE), "left").withColumn("ocr_blocks", F.coalesce("ocr_blocks", empty))
        files.write_named(files.named_json(full, "ocr").select("name", "json"), output)
    return blocks


def layout_step(blocks: DataFrame, height: int = 600, limit: int | None = LIMIT, output: str | None = None) -> DataFrame:
    """One row a page with its three lists of blocks in reading order; with output also as {doc_id}_page{n}_layout_output.json."""
    rows = page_layout(with_regions(sampled(blocks, limit), height), PAGE)
    plain = lambda b: F.struct(b["text"].alias("text"), F.array(b["x1"], b["y1"], b["x2"], b["y2"]).alias("bbox"), b["confidence"].alias("confidence"))
    rows = rows.select(*PAGE, *(F.transform(f"{r}_blocks", plain).alias(f"{r}_blocks") for r in ("header", "body", "footer")))
    if output:
        files.write_named(files.named_json(rows, "layout").select("name", "json"), output)
    return rows


def layout_blocks(pages: DataFrame) -> DataFrame:
    """Rows of blocks out of layout rows: the region they were put in, pos counting on over header, body and footer."""
    parts = [files.exploded_blocks(pages, f"{r}_blocks").withColumn("region", F.lit(r)).withColumn("pos", F.col("pos") + k * (1 << 20)) for k, r in enumerate(("header", "body", "footer"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("center_y", (F.col("y1") + F.col("y2")) / 2)


def extraction_step(pages: DataFrame, visual: DataFrame | None = None, output: str | None = None) -> DataFrame:
    """Results of layout rows, one a document; with output also as {doc_id}_page{n}_extracted.json."""
    done = files.results(extracted_document(layout_blocks(pages), visual))
    if output:
        files.save_results(done, output)
    return done
