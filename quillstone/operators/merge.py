"""Blocks of several recognition engines: unions, intersections, greedy removal of near-equal blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.fuzzy import ratio

BOX = ["x1", "y1", "x2", "y2"]


def _keyed(blocks: DataFrame) -> DataFrame:
    return blocks.withColumn("key", F.lower("text"))


def merge_union(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """All of left, and what right has under no text (whatever its case) and box of left."""
    on = [*by, "key", *BOX]
    return left.unionByName(_keyed(right).join(_keyed(left).select(on).distinct(), on, "left_anti").select(left.columns))


def merge_preferred(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Left first; the same rows as the union."""
    return merge_union(left, right, by)


def merge_intersection(left: DataFrame, right: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Rows of right whose text and box left has too, with the mean confidence; of equal keys in left the last by pos counts."""
    on = [*by, "key", *BOX]
    last = _keyed(left).groupBy(on).agg(F.max_by("confidence", "pos").alias("left_confidence"))
    both = _keyed(right).join(last, on).withColumn("confidence", (F.col("left_confidence") + F.col("confidence")) / 2)
    return both.select(right.columns)


def _overlaps(boxes: np.ndarray, i: int, kept: np.ndarray) -> np.ndarray:
    b = boxes[kept]
    w = np.minimum(b[:, 2], boxes[i, 2]) - np.maximum(b[:, 0], boxes[i, 0])
    h = np.minimum(b[:, 3], boxes[i, 3]) - np.maximum(b[:, 1], boxes[i, 1])
    inter = np.where((w > 0) & (h > 0), w * h, 0)
    area = (b[:, 2] - b[:, 0]) * (b[:, 3] - b[:, 1]) + (boxes[i, 2] - boxes[i, 0]) * (boxes[i, 3] - boxes[i, 1]) - inter
    return np.where(area > 0, inter / np.where(area > 0, area, 1), 0)


def _greedy(t: pa.Table) -> pa.Table:
    t = t.take(pa.array(np.lexsort((t.column("pos").to_numpy(), -t.column("confidence").to_numpy()))))
    boxes = np.stack([t.column(c).to_numpy().astype(float) for c in BOX], 1)
    texts = [(x or "").lower() for x in t.column("text").to_pylist()]
    kept: list[int] = []
    for i, text in enumerate(texts):
        near = [kept[k] for k in np.flatnonzero(_overlaps(boxes, i, np.array(kept, int)) > 0.5)] if kept else []
        if not any(ratio(text, texts[k]) > 0.8 for k in near):
            kept.append(i)
    return t.take(pa.array(kept, pa.int64()))


def dedupe_blocks(blocks: DataFrame, by: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """Greedy by falling confidence, then pos: a block goes if a kept one of its page overlaps it by more than 0.5 and reads alike by more than 0.8.

    A page is one group; pages hold hundreds of blocks at most. Boxes are compared before texts.
    """
    return blocks.groupBy(*by).applyInArrow(_greedy, blocks.schema)
