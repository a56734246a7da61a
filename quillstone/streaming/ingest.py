"""Pages as they arrive: the row-wise stages over a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators.layout import with_regions
from ..sources.files import OCR_SCHEMA, exploded_blocks, readable


def stream_blocks(spark: SparkSession, folder: str) -> DataFrame:
    """Blocks with their region of OCR pages that arrive in folder as JSON."""
    pages = readable(spark.readStream.schema(OCR_SCHEMA).option("multiLine", True).json(folder))
    return with_regions(exploded_blocks(pages))
