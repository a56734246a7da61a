"""Tables in the folder that all executors share, used to cut lineage."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named in spark.checkpoint.dir; where that is unset and all runs on one machine a temporary one, set once per session."""
    if not (path := spark.conf.get(KEY, None)):
        if not (master := spark.conf.get("spark.master", "")).startswith("local") or master.startswith("local-cluster"):
            raise ValueError(f"{KEY} must name a folder that all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="quillstone-")
        spark.conf.set(KEY, path)
    return path.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, so that a lost executor costs no recomputation beyond it."""
    df.write.parquet(path := fresh_path(df.sparkSession, name))
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unique_ids(docs: DataFrame, rows: bool = False) -> tuple[DataFrame, bool]:
    """(doc_id, own, text, and with rows all other columns as one, row; whether doc_id is new): own is the row's doc_id,
    and doc_id is the same if all are there and differ. Else it is a new number in the order of doc_id (null first),
    then of a hash of the text; rows that share both are numbered in any order."""
    own = F.col("doc_id").cast("long")
    rest = [F.struct(F.lit(0).alias("_"), *(F.col(f"`{c}`") for c in docs.columns if c != "text")).alias("row")] if rows else []
    docs = docs.select(own.alias("doc_id"), own.alias("own"), "text", *rest)
    if docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or doc_id is null").isEmpty():
        return docs, False
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = docs.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return cut(dealt.withColumn("doc_id", F.monotonically_increasing_id()), "numbered"), True


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
