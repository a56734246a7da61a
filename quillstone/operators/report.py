"""Reports over extracted fields, and seeded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import currency, percentage

FIELDS = ("dealer", "model", "power", "cost", "signature", "stamp")


def summary(fields: DataFrame) -> DataFrame:
    """metric, found, total, ratio: for each field the documents with a value (0, empty and false do not count), and mean_confidence."""
    types = dict(fields.dtypes)
    there = {n: (F.col(n) != "") if types[n] == "string" else F.col(n) if types[n] == "boolean" else F.col(n) != 0 for n in FIELDS if n in types}
    total = F.count(F.lit(1))
    one = fields.agg(total.alias("total"), F.coalesce(F.sum("document_confidence"), F.lit(0.0)).alias("mean_confidence"), *(F.count_if(c).alias(n) for n, c in there.items()))
    rows = F.explode(F.array(*(F.struct(F.lit(n).alias("metric"), F.col(n).cast("double").alias("found")) for n in (*there, "mean_confidence"))))
    return one.select("total", rows.alias("r")).select("r.metric", "r.found", "total", (F.col("r.found") / F.greatest("total", F.lit(1))).alias("ratio"))


def report_lines(fields: DataFrame) -> DataFrame:
    """doc_id, line: the text line of each document in the report."""
    shown = lambda c: F.coalesce(c, F.lit("None"))
    return fields.select("doc_id", F.concat_ws(" | ", F.col("doc_id").cast("string"), shown(F.col("dealer")), shown(F.col("model")), shown(F.col("power").cast("string")), currency(F.col("cost")), percentage(F.col("document_confidence"))).alias("line"))


#: How the report names each field.
SHOWN = {"dealer": "Dealer", "model": "Model", "power": "HP", "cost": "Cost", "signature": "Signature", "stamp": "Stamp"}


def report_text(fields: DataFrame) -> DataFrame:
    """part, doc_id, k, line: the whole report, to be read in this order. A part 0 line for each field of each document (N/A for a
    column that is not there, None for a null) and part 1 lines for the totals. Nothing is collected."""
    def value(name: str) -> Column:
        if name not in fields.columns:
            return F.lit("No" if name in ("signature", "stamp") else "N/A")
        if name in ("signature", "stamp"):
            return F.when(F.col(name), "Yes").otherwise("No")
        return F.coalesce(F.col(name).cast("string"), F.lit("None"))

    lines = [F.concat(F.lit("Document: "), F.col("doc_id").cast("string"))]
    lines += [F.concat(F.lit(f"  {label}: "), value(name)) for name, label in SHOWN.items()]
    lines.append(F.concat(F.lit("  Confidence: "), percentage(F.coalesce("document_confidence", F.lit(0.0)))))
    each = fields.select(F.lit(0).alias("part"), F.col("doc_id").cast("string").alias("doc_id"), F.posexplode(F.array(*lines)).alias("k", "line"))
    label = F.lit("")
    for name, shown in SHOWN.items():
        label = F.when(F.col("metric") == name, f"{shown} {'Present' if name in ('signature', 'stamp') else 'Found'}").otherwise(label)
    found = F.concat(label, F.lit(": "), F.col("found").cast("long").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" ("), percentage(F.col("ratio")), F.lit(")"))
    order = F.array_position(F.array(*(F.lit(m) for m in ("mean_confidence", *SHOWN))), F.col("metric"))
    totals = summary(fields).select(F.lit(1).alias("part"), F.lit("").alias("doc_id"), order.cast("int").alias("k"), F.when(F.col("metric") == "mean_confidence", F.concat(F.lit("Average Confidence: "), percentage(F.col("ratio")))).otherwise(found).alias("line"))
    return each.union(totals)


def seeded_sample(rows: DataFrame, key: str, limit: int | None, seed: int = 7) -> DataFrame:
    """limit rows of the smallest seeded hashes of key; all rows if limit is none or 0."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(limit) if limit else rows
