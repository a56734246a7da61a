"""Page images: reading, checks, normalisation, visual fields. Rows are Spark image structs (BGR bytes)."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import images
from ..sources import files
from .layout import number_pages, parse_page_names


def _array(row) -> np.ndarray:
    x = np.frombuffer(row["data"], np.uint8).reshape(row["height"], row["width"], row["nChannels"])
    return x[..., 0] if row["nChannels"] == 1 else x[..., :3]


_VISUAL = "path string, usable boolean, signature boolean, signature_confidence double, stamp boolean, stamp_confidence double, n_marks long, n_ticks long, handwritten boolean, stroke_width double, signature_box array<int>, stamp_box array<int>"


def _look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        out = []
        for row in frame.to_dict("records"):
            x = _array(row)
            g = images.gray(x)
            sign, stamp, pen = images.signature(g), images.chosen_stamp(x), images.strokes(g)
            marks = [m for m in images.marks(g) if m["present"]]
            out.append((row["path"], images.quality(g), sign["present"], sign["confidence"], stamp["present"], stamp["confidence"], len(marks), sum(m["kind"] == "tick" for m in marks), pen["handwritten"], pen["width"], sign["box"], stamp["box"]))
        yield pd.DataFrame(out, columns=[f.split()[0] for f in _VISUAL.split(", ")])


def visual_fields(pages: DataFrame) -> DataFrame:
    """One row a page with path and image: whether it is usable, signed, stamped, ticked, handwritten."""
    flat = pages.select("path", "image.height", "image.width", "image.nChannels", "image.data")
    return flat.mapInPandas(_look, _VISUAL)


_QUALITY = "path string, usable boolean, n_values long, variance double"
_STROKES = "path string, handwritten boolean, confidence double, width double, parts long, old_confidence double"
_SHAPES = "path string, ord long, x1 long, y1 long, x2 long, y2 long, kind string, confidence double, rules string"
_COLORS = "path string, color string, ord long, x1 long, y1 long, x2 long, y2 long, confidence double, is_circular boolean"


def _quality(path: str, x: np.ndarray) -> list[tuple]:
    g = images.gray(x)
    return [(path, images.quality(g), len(np.unique(g)), float(g.astype(float).var()) if g.size else 0.0)]


def _strokes(path: str, x: np.ndarray) -> list[tuple]:
    pen = images.strokes(x)
    return [(path, pen["handwritten"], pen["confidence"], pen["width"], pen["parts"], images.strokes_scored(x)["confidence"])]


def _marks(path: str, x: np.ndarray) -> list[tuple]:
    return [(path, k, *m["box"], m["kind"], m["confidence"], r) for r in images.MARK_RULES for k, m in enumerate(images.marks(x, r)) if m["present"]]


def _colors(path: str, x: np.ndarray) -> list[tuple]:
    hues = images.hsv(x) if x.ndim == 3 else None
    found = [(c, *images.color_regions(x, c, hues=hues)) for c in images.HSV_RANGES]
    return [(path, c, k, *b, sure, images.circular(x, b)) for c, boxes, sure in found for k, b in enumerate(boxes)]


def _rows(look, schema: str):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = [row for r in frame.to_dict("records") for row in look(r["path"], _array(r))]
            yield pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])

    return lambda pages: pages.select("path", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, schema)


#: From pages with path and image: whether a page is usable; strokes by both rules; marks by all three sets of rules; regions of each colour.
image_quality, stroke_widths, mark_shapes, color_regions = _rows(_quality, _QUALITY), _rows(_strokes, _STROKES), _rows(_marks, _SHAPES), _rows(_colors, _COLORS)


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages (path, image, any others) that can be read and pass the quality check. Numbers given before stay, gaps and all;
    an invoice without such a page is gone."""
    good = image_quality(pages.filter("image.height > 0")).filter("usable").select("path")
    return pages.join(good, "path", "left_semi")


def process_pages(spark: SparkSession, folder: str, width: int = 800, height: int = 600, compat: bool = False, output: str | None = None) -> DataFrame:
    """The first step over a folder of .png files: invoice_id, page_num, page_number, path and the normalised image of each
    usable page; with output also written there as {invoice_id}_pg{page_number}_normalized.png."""
    listed = number_pages(parse_page_names(files.png_files(spark, folder)))
    read = listed.join(files.images(spark, folder), "path")
    keep = usable_pages(read)
    out = keep.drop("image").join(normalised_pages(keep, width, height, compat), "path")
    if output:
        files.write_named(as_png(out.select(F.format_string("%s_pg%d_normalized.png", "invoice_id", "page_number").alias("name"), "image")), output)
    return out


def page_list(spark: SparkSession, paths: list[str], width: int = 800, height: int = 600, compat: bool = False, output: str | None = None) -> DataFrame:
    """page (place in the list, from 1), path and normalised image of the named files. A name that does not end in .png raises
    ValueError, a missing file AnalysisException. With output also written as {stem}_normalized.png."""
    if wrong := [p for p in paths if not p.lower().endswith(".png")]:
        raise ValueError(f"not a .png file: {wrong[0]}")
    if not paths:
        return spark.createDataFrame([], "page int, path string, image struct<origin:string,height:int,width:int,nChannels:int,mode:int,data:binary>")
    name = lambda c: F.regexp_replace(c, "^file:/+", "/")
    order = spark.createDataFrame([(k, p) for k, p in enumerate(paths, 1)], "page int, asked string")
    found = spark.read.format("image").load(list(dict.fromkeys(paths))).select(F.col("image.origin").alias("path"), "image")
    done = normalised_pages(found, width, height, compat)
    out = order.join(done, name(F.col("asked")) == name(F.col("path"))).select("page", "path", "image")
    if output:
        stem = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"(?i)\.png$", "")
        files.write_named(as_png(out.select(F.concat(stem, F.lit("_normalized.png")).alias("name"), "image")), output)
    return out


def folder_pages(spark: SparkSession, folder: str, **options) -> DataFrame:
    """page_list of a folder's .png files in the order of their paths; page is numbered by a window over file names alone."""
    listed = files.png_files(spark, folder).select("path", F.row_number().over(Window.orderBy("path")).alias("page"))
    return listed.join(normalised_pages(files.images(spark, folder), **options), "path").select("page", "path", "image")


def _png(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame({"name": frame["name"], "content": [images.png(_array(r)) for r in frame.to_dict("records")]})


def as_png(named: DataFrame) -> DataFrame:
    """name and content, a PNG file, of rows with name and image."""
    return named.select("name", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(_png, "name string, content binary")


def unit_images(pages: DataFrame, width: int = 800, height: int = 600) -> DataFrame:
    """path, height, width and pixels: grey pages scaled to size, values from 0 to 1."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame([(r["path"], height, width, (images.resize(images.gray(_array(r)), width, height).ravel() / np.float32(255)).tolist()) for r in frame.to_dict("records")], columns=["path", "height", "width", "pixels"])

    return pages.select("path", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(run, "path string, height int, width int, pixels array<float>")


def _normal(width: int, height: int, swapped: bool):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"path": frame["path"], "data": [images.normalise(_array(r), width, height, swapped).tobytes() for r in frame.to_dict("records")]})

    return run


def normalised_pages(pages: DataFrame, width: int = 800, height: int = 600, compat: bool = False) -> DataFrame:
    """path and image: grey, smoothed, equalised, scaled. compat takes BGR for RGB when it makes grey."""
    flat = pages.select("path", "image.height", "image.width", "image.nChannels", "image.data").mapInPandas(_normal(width, height, compat), "path string, data binary")
    image = F.struct(F.col("path").alias("origin"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.lit(1).alias("nChannels"), F.lit(0).alias("mode"), "data")
    return flat.select("path", image.alias("image"))
