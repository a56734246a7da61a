"""Sources and sinks of each stage: page images, block and field JSON, result files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BLOCK = "struct<text:string,bbox:array<int>,confidence:double,is_handwritten:boolean,stroke_width_avg:double,symbol_type:string>"
OCR_SCHEMA = f"doc_id string, page_number int, ocr_blocks array<{BLOCK}>, _corrupt_record string"
LAYOUT_SCHEMA = "doc_id string, page_number int, " + ", ".join(f"{r}_blocks array<struct<text:string,bbox:array<int>,confidence:double>>" for r in ("header", "body", "footer")) + ", _corrupt_record string"


def png_files(spark: SparkSession, folder: str) -> DataFrame:
    """path of each .png file of a folder, whatever the case of the suffix; a missing folder raises AnalysisException."""
    return spark.read.format("binaryFile").load(folder).select("path").filter(F.col("path").rlike(r"(?i)\.png$"))


def images(spark: SparkSession, folder: str, drop_invalid: bool = False) -> DataFrame:
    """path and image (BGR) of a folder's files."""
    return spark.read.format("image").option("dropInvalid", drop_invalid).load(folder).select(F.regexp_replace("image.origin", "^file:/+", "file:/").alias("path"), "image")


def readable(rows: DataFrame) -> DataFrame:
    """Rows of JSON that parsed and hold anything."""
    fields = [c for c in rows.columns if c not in ("_corrupt_record", "path")]
    return rows.filter(F.col("_corrupt_record").isNull() & F.coalesce(*(F.when(F.col(c).isNotNull(), True) for c in fields), F.lit(False))).drop("_corrupt_record")


def _json(spark: SparkSession, folder: str, schema: str, pattern: str, compat: bool) -> DataFrame:
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("pathGlobFilter", pattern).json(folder).withColumn("path", F.col("_metadata.file_path"))
    rows = readable(rows)
    stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json$", "")
    rows = rows.withColumn("doc_id", F.coalesce("doc_id", stem)).withColumn("page_number", F.coalesce("page_number", F.lit(1)))
    if compat:
        rows = rows.groupBy("doc_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "doc_id"]), "path").alias("r")).select("doc_id", "r.*")
    return rows


def ocr_json(spark: SparkSession, folder: str, compat: bool = False) -> DataFrame:
    """A row a page; unreadable files are left out. compat keeps the last page of each document only."""
    return _json(spark, folder, OCR_SCHEMA, "*.json", compat)


def layout_json(spark: SparkSession, folder: str, compat: bool = False) -> DataFrame:
    return _json(spark, folder, LAYOUT_SCHEMA, "*layout*.json", compat)


def result_json(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("multiLine", True).json(path)


def exploded_blocks(pages: DataFrame, column: str = "ocr_blocks") -> DataFrame:
    """A row a block, with its pos and defaults: empty text, confidence 0.5, box of zeros."""
    b = pages.select("doc_id", "page_number", F.posexplode(column).alias("pos", "b"))
    box = F.coalesce("b.bbox", F.array(*[F.lit(0)] * 4))
    return b.select("doc_id", "page_number", F.col("pos").cast("long"), F.coalesce("b.text", F.lit("")).alias("text"), *(F.get(box, F.lit(k)).cast("long").alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))), F.coalesce("b.confidence", F.lit(0.5)).alias("confidence"))


def page_image(pages: DataFrame, files: DataFrame) -> DataFrame:
    """Adds image_path: the first existing of png, jpg, jpeg, each as {doc} and {doc}_pg1_normalized; null if there is none."""
    name = F.element_at(F.split("path", "/"), -1)
    tries = F.array(*(F.struct(F.lit(k).alias("k"), F.concat("doc_id", F.lit(f"{s}.{e}")).alias("name")) for k, (e, s) in enumerate((e, s) for e in ("png", "jpg", "jpeg") for s in ("", "_pg1_normalized"))))
    found = pages.select("doc_id").distinct().select("doc_id", F.explode(tries).alias("t")).join(files.select("path", name.alias("name")), F.col("t.name") == F.col("name")).groupBy("doc_id").agg(F.min_by("path", "t.k").alias("image_path"))
    return pages.join(found, "doc_id", "left")


def field_struct(value: Column, confidence: Column, bbox: Column | None = None, source: Column | None = None) -> Column:
    """A field as results hold it: absent is value null and confidence 0.0; box and source only where given."""
    parts = [value.alias("value"), F.coalesce(confidence, F.lit(0.0)).alias("confidence")]
    return F.struct(*parts, *([bbox.alias("bbox")] if bbox is not None else []), *([source.alias("source")] if source is not None else []))


def mark_struct(present: Column, confidence: Column, bbox: Column | None = None) -> Column:
    """A signature or a stamp as results hold it: absent is false and 0.0."""
    parts = [F.coalesce(present, F.lit(False)).alias("present"), F.coalesce(confidence, F.lit(0.0)).alias("confidence")]
    return F.struct(*parts, *([bbox.alias("bbox")] if bbox is not None else []))


RESULT_FIELDS = {"dealer_name": "dealer", "model_name": "model", "horse_power": "power", "asset_cost": "cost"}


def results(fields: DataFrame, stamped: Column | None = None, metadata: Column | None = None) -> DataFrame:
    """One result a document: doc_id, page_number, the four fields, signature, stamp, document_confidence; with stamped (a time)
    also extraction_timestamp, with metadata (a map) that too.

    fields has doc_id and, for each field, a value and its confidence (and where it has them its box and source); a missing
    column is an absent field, a missing page_number is 1.
    """
    col = lambda c: F.col(c) if c in fields.columns else None
    none = F.lit(None).cast("string")
    out = [F.col("doc_id"), (F.col("page_number") if "page_number" in fields.columns else F.lit(1)).cast("int").alias("page_number")]
    for name, c in RESULT_FIELDS.items():
        value, sure = (none if (x := col(k)) is None else x for k in (c, f"{c}_confidence"))
        out.append(field_struct(value, sure.cast("double"), col(f"{c}_box"), col(f"{c}_source")).alias(name))
    for name in ("signature", "stamp"):
        there, sure = (none if (x := col(k)) is None else x for k in (name, f"{name}_confidence"))
        out.append(mark_struct(there.cast("boolean"), sure.cast("double"), col(f"{name}_box")).alias(name))
    out.append((F.lit(0.0) if (x := col("document_confidence")) is None else F.coalesce(x, F.lit(0.0))).alias("document_confidence"))
    if stamped is not None:
        out.append(F.date_format(stamped, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("extraction_timestamp"))
    if metadata is not None:
        out.append(metadata.alias("metadata"))
    return fields.select(*out)


def page_key(doc_id: Column, page_number: Column) -> Column:
    return F.concat(doc_id.cast("string"), F.lit("_page"), page_number.cast("string"))


#: What follows the page key in the names of each step's files.
ENDINGS = {"ocr": "_ocr_output.json", "layout": "_layout_output.json", "result": "_extracted.json"}


def named_json(rows: DataFrame, kind: str, keep_nulls: bool = False) -> DataFrame:
    """doc_id, name and json of rows with doc_id and page_number, named as files of this kind (a key of ENDINGS). Null boxes
    and sources are left out; a null value stays."""
    name = F.concat(page_key(F.col("doc_id"), F.col("page_number")), F.lit(ENDINGS[kind]))
    options = {"ignoreNullFields": str(not keep_nulls and kind != "result").lower()}
    return rows.select("doc_id", name.alias("name"), F.to_json(F.struct(*rows.columns), options).alias("json"))


def _spaced(text: str, indent: int, sparse: bool) -> bytes:
    found = json.loads(text)
    if sparse:
        for part in found.values() if isinstance(found, dict) else []:
            for key in ("bbox", "source"):
                if isinstance(part, dict) and part.get(key, 1) is None:
                    del part[key]
    return json.dumps(found, indent=indent or None, ensure_ascii=False).encode()


def write_named(rows: DataFrame, folder: str, indent: int = 2) -> DataFrame:
    """Writes each row (name, and content or json) as a file of the folder, which any store that pyarrow knows may hold;
    returns name and path. JSON is indented, non-ASCII kept. A file appears whole under its name, so a task may run twice."""
    text = "json" in rows.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
        store.create_dir(base, recursive=True)
        for frame in frames:
            paths = []
            for name, body in zip(frame["name"], frame["body"], strict=True):
                part = f"{base}/.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(_spaced(body, indent, True) if text else body)
                store.move(part, f"{base}/{name}")
                paths.append(f"{base}/{name}")
            yield pd.DataFrame({"name": frame["name"], "path": paths})

    done = rows.select("name", F.col("json" if text else "content").alias("body")).mapInPandas(run, "name string, path string")
    # files are written once, here, and not again whenever the result is read
    names = done.select("path").agg(F.count(F.lit(1)).alias("n")).first().n
    base = fs.FileSystem.from_uri(folder)[1] if "://" in folder else folder
    return rows.select("name", F.concat(F.lit(f"{base}/"), "name").alias("path")) if names else rows.sparkSession.createDataFrame([], "name string, path string")


def save_results(rows: DataFrame, folder: str | None = None) -> DataFrame:
    """doc_id and output of each result: the path of its file in folder, or without a folder its JSON."""
    named = named_json(rows, "result", keep_nulls=True)
    if folder is None:
        return named.select("doc_id", F.col("json").alias("output"))
    return named.select("doc_id", "name").join(write_named(named.select("name", "json"), folder), "name").select("doc_id", F.col("path").alias("output"))


def as_json(rows: DataFrame, key: Column, keep_nulls: bool = True) -> DataFrame:
    """name and json of each row; nulls stay as null unless keep_nulls is off."""
    return rows.select(key.alias("name"), F.to_json(F.struct(*rows.columns), {"ignoreNullFields": str(not keep_nulls).lower()}).alias("json"))


def write_json(rows: DataFrame, folder: str, by: tuple[str, ...] = ("doc_id",)) -> None:
    """JSON lines, in a folder for each value of by; rows of one value are written by one task."""
    rows.repartition(*by).write.partitionBy(*by).option("ignoreNullFields", "false").json(folder)
