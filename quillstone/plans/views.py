"""Deterministic block views over the driver's tables, the same in Spark SQL and DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions import dims


def _q(words: list[str]) -> str:
    return ", ".join("'" + w.replace("'", "''") + "'" for w in words)


# {at} is an expression; lists count from 1 in both dialects.
_PICK = {"spark": "element_at(array({list}), CAST({at} AS INT))", "duck": "list_extract([{list}], CAST({at} AS INT))"}


def _pick(dialect: str, words: list[str], at: str) -> str:
    return _PICK[dialect].format(list=_q(words), at=at)


def invoice_blocks_sql(dialect: str, cost_factor: int = 10) -> str:
    """Seven text blocks for each order, as a recognised invoice would have."""
    dealer, model = _pick(dialect, dims.DEALERS, "o_custkey % 90 + 1"), _pick(dialect, dims.MODELS, "o_orderkey % 75 + 1")
    power = "CAST((o_orderkey % 50 + 1) * 3 AS {s})"
    s = "STRING" if dialect == "spark" else "VARCHAR"
    power = power.format(s=s)
    cost = f"CAST(CAST(floor(o_totalprice * {cost_factor}) AS BIGINT) AS {s})"
    texts = [
        (0, 20, f"CASE WHEN o_orderkey % 4 = 3 THEN {dealer} ELSE 'Dealer: ' || {dealer} END"),
        (1, 100, f"CASE WHEN o_orderkey % 3 = 0 THEN {model} WHEN o_orderkey % 3 = 1 THEN 'Model: ' || {model} ELSE 'Vehicle papers' END"),
        (2, 205, f"'Invoice no ' || CAST(o_orderkey AS {s})"),
        (3, 300, f"CASE WHEN o_orderkey % 4 = 0 THEN {power} || ' HP' WHEN o_orderkey % 4 = 1 THEN 'Horse Power: ' || {power} WHEN o_orderkey % 4 = 2 THEN 'Rating ' || {power} || ' kw' ELSE 'Engine no 7' END"),
        (4, 380, "CASE WHEN o_orderkey % 5 = 0 THEN 'कुल राशि' ELSE 'Qty 1 HSN 87019' END"),
        (5, 470, f"CASE WHEN o_orderkey % 7 = 0 THEN {cost} ELSE 'Total Rs. ' || {cost} END"),
        (6, 560, "CASE WHEN o_orderkey % 6 = 0 THEN 'ok ✓ 45' ELSE 'Thank you' END"),
    ]
    one = "SELECT o_orderkey AS doc_id, {p} AS pos, {t} AS text, CAST(40 AS BIGINT) AS x1, CAST({y} AS BIGINT) AS y1, CAST(400 AS BIGINT) AS x2, CAST({y} + 20 AS BIGINT) AS y2, CAST((o_orderkey * 31 + {p} * 17) % 101 AS DOUBLE) / 100 AS confidence FROM orders"
    return " UNION ALL ".join(one.format(p=p, y=y, t=t) for p, y, t in texts)


def document_blocks_sql(dialect: str) -> str:
    """A block for each line of each document, with a made-up place and confidence."""
    lines = "SELECT doc_id, pos, line FROM documents LATERAL VIEW posexplode(split(text, '\\n')) t AS pos, line" if dialect == "spark" else "SELECT doc_id, unnest(range(len(l))) AS pos, unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)"
    return f"""SELECT doc_id, CAST(pos AS BIGINT) AS pos, line AS text, CAST((pos * 53) % 600 AS BIGINT) AS x1, CAST((pos * 37 + doc_id * 13) % 580 AS BIGINT) AS y1,
      CAST((pos * 53) % 600 + 8 * length(line) AS BIGINT) AS x2, CAST((pos * 37 + doc_id * 13) % 580 + 20 AS BIGINT) AS y2,
      CAST((doc_id * 31 + pos * 17) % 101 AS DOUBLE) / 100 AS confidence FROM ({lines}) s"""


def _run(spark: SparkSession, sf_dir: str, table: str, sql: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {table}", "FROM {src}"), src=spark.read.parquet(f"{sf_dir}/{table}.parquet"))


def invoice_blocks(spark: SparkSession, sf_dir: str, cost_factor: int = 10) -> DataFrame:
    return _run(spark, sf_dir, "orders", invoice_blocks_sql("spark", cost_factor))


def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "documents", document_blocks_sql("spark"))


# Fields as extraction leaves them, some missing, made from orders alone.
def fields_sql(dialect: str) -> str:
    dealer, model = _pick(dialect, dims.DEALERS, "o_custkey % 90 + 1"), _pick(dialect, dims.MODELS, "o_orderkey % 75 + 1")
    conf = lambda k: f"CAST((o_orderkey * {k}) % 101 AS DOUBLE) / 100"
    return f"""SELECT o_orderkey AS doc_id,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {dealer} END AS dealer, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {model} END AS model,
      CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE CAST((o_orderkey % 50) * 3 AS BIGINT) END AS power, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE CAST(floor(o_totalprice * 10) AS BIGINT) END AS cost,
      CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE {conf(31)} END AS dealer_confidence, CASE WHEN o_orderkey % 7 = 0 THEN NULL ELSE {conf(17)} END AS model_confidence,
      CASE WHEN o_orderkey % 6 = 0 THEN NULL ELSE {conf(13)} END AS power_confidence, CASE WHEN o_orderkey % 8 = 0 THEN NULL ELSE {conf(7)} END AS cost_confidence,
      o_orderkey % 3 = 0 AS signature, o_orderkey % 4 = 0 AS stamp, {conf(29)} AS document_confidence FROM orders"""


def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _run(spark, sf_dir, "orders", fields_sql("spark"))
