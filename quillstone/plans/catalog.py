"""All registered queries of the extraction engine and their DuckDB oracles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..functions import dims, expr, rules
from ..functions.fuzzy import best_names
from ..operators import candidates, document, extract, layout, merge, pages, report
from ..sources import files
from . import views
from .views import _q

QUERIES: dict = {}
ORACLES: dict = {}
INV, DOC, FIELDS = views.invoice_blocks_sql("duck"), views.document_blocks_sql("duck"), views.fields_sql("duck")
REGION = "CASE WHEN (y1 + y2) / 2.0 <= 210 THEN 'header' WHEN (y1 + y2) / 2.0 >= 450 THEN 'footer' ELSE 'body' END"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _any(text: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({text}, {_q([w])})" for w in dict.fromkeys(words)) + ")"


def _numbers(text: str) -> str:
    return f"list_transform(regexp_extract_all(translate(translate({text}, '₹Rs.,', ''), '{expr.NATIVE_DIGITS}', '{'0123456789' * 2}'), '[0-9]+'), lambda x: TRY_CAST(x AS DECIMAL(38, 0)))"


@query(f"""WITH b AS (SELECT *, {REGION} AS region FROM ({INV})),
  n AS (SELECT *, (y1 + y2) / 2.0 AS cy, CASE region WHEN 'footer' THEN 0 ELSE 1 END AS r, {_any('lower(text)', dims.COST_WORDS)} AS said, list_max(list_filter({_numbers('text')}, lambda x: x >= 10000)) AS value FROM b WHERE region <> 'header'),
  k AS (SELECT *, bool_or(said) OVER (PARTITION BY doc_id) AS any_said FROM n),
  t AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY value DESC, r, cy, pos) AS rn FROM k WHERE value IS NOT NULL AND (said OR NOT any_said))
  SELECT doc_id, CAST(value AS BIGINT) AS value, confidence, pos, x1, y1, x2, y2, CASE WHEN value < 200000 OR value > 2000000 THEN FALSE ELSE TRUE END AS is_valid FROM t WHERE rn = 1""")
def asset_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = extract.asset_cost(layout.with_regions(views.invoice_blocks(spark, sf_dir)))
    return found.withColumn("is_valid", rules.validate_cost(F.col("value"))["is_valid"])


PAGES = "SELECT CASE WHEN o_orderkey % 3 = 0 THEN o_custkey || '_' || o_orderkey || '_pg' || (o_orderkey % 20) || '.png' WHEN o_orderkey % 3 = 1 THEN o_custkey || '_pg' || (o_orderkey % 20) || '.png' ELSE 'scan' || o_custkey || '.PNG' END AS path FROM orders"
PARSED = f"""SELECT path, CASE WHEN s SIMILAR TO '\\d+_\\d+_pg\\d+' OR s SIMILAR TO '\\d+_pg\\d+' THEN string_split(s, '_')[1] ELSE s END AS invoice_id,
  CAST(CASE WHEN s SIMILAR TO '\\d+_\\d+_pg\\d+' OR s SIMILAR TO '\\d+_pg\\d+' THEN regexp_extract(s, 'pg(\\d+)$', 1) ELSE '1' END AS INTEGER) AS page_num FROM (SELECT path, replace(path, '.png', '') AS s FROM ({PAGES}))"""


def _pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.parse_page_names(views._run(spark, sf_dir, "orders", PAGES))


@query(f"SELECT invoice_id, page_num, count(*) AS n FROM ({PARSED}) GROUP BY ALL")
def page_grouping(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).groupBy("invoice_id", "page_num").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT invoice_id, path, CAST(row_number() OVER (PARTITION BY invoice_id ORDER BY page_num, path) AS INTEGER) AS page_number FROM ({PARSED})")
def page_numbering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.number_pages(_pages(spark, sf_dir)).select("invoice_id", "path", "page_number")


@query(f"SELECT doc_id, pos, (y1 + y2) / 2.0 AS center_y, {REGION} AS region FROM ({DOC})")
def layout_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_regions(views.document_blocks(spark, sf_dir)).select("doc_id", "pos", "center_y", "region")


@query(f"SELECT doc_id, region, CAST(row_number() OVER (PARTITION BY doc_id, region ORDER BY y1 + y2, pos) AS INTEGER) AS region_pos, pos FROM (SELECT *, {REGION} AS region FROM ({DOC}))")
def layout_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.in_reading_order(layout.with_regions(views.document_blocks(spark, sf_dir))).select("doc_id", "region", "region_pos", "pos")


@query("SELECT doc_id, " + ", ".join(f"count(*) FILTER (region = '{r}') AS n_{r}, coalesce(string_agg(CAST(pos AS VARCHAR) || ':' || text, chr(10) ORDER BY y1 + y2, pos) FILTER (region = '{r}'), '') AS {r}" for r in ("header", "body", "footer")) + f" FROM (SELECT *, {REGION} AS region FROM ({DOC})) GROUP BY doc_id")
def page_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = layout.page_layout(layout.with_regions(views.document_blocks(spark, sf_dir)))
    said = lambda r: F.array_join(F.transform(f"{r}_blocks", lambda b: F.concat(b["pos"].cast("string"), F.lit(":"), b["text"])), "\n")
    return out.select("doc_id", *(c for r in ("header", "body", "footer") for c in (F.size(f"{r}_blocks").cast("long").alias(f"n_{r}"), said(r).alias(r))))


@query(f"SELECT region, count(*) AS n FROM (SELECT *, {REGION} AS region FROM ({DOC})) GROUP BY region")
def region_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.with_regions(views.document_blocks(spark, sf_dir)).groupBy("region").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT doc_id, pos, CAST(x1 AS INTEGER) AS x1, CAST(y1 AS INTEGER) AS y1, CAST(x2 AS INTEGER) AS x2, CAST(y2 AS INTEGER) AS y2 FROM ({DOC})")
def quad_to_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = lambda x, y: F.array(F.col(x), F.col(y))
    quads = views.document_blocks(spark, sf_dir).withColumn("q", F.array(point("x1", "y1"), point("x2", "y1"), point("x2", "y2"), point("x1", "y2")))
    return quads.select("doc_id", "pos", expr.quad_to_box(F.col("q")).alias("b")).select("doc_id", "pos", "b.*")


@query(f"SELECT doc_id, pos, CASE WHEN pct = -1 THEN 0.0::DOUBLE ELSE pct / 100.0::DOUBLE END AS confidence FROM (SELECT doc_id, pos, CAST(round(confidence * 100) AS INTEGER) - 1 AS pct FROM ({DOC})) WHERE pct >= 30 OR pct = -1")
def conf_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    pct = (F.round(F.col("confidence") * 100) - 1).cast("int")
    b = views.document_blocks(spark, sf_dir).select("doc_id", "pos", pct.alias("pct")).filter("pct >= 30 OR pct = -1")
    return b.select("doc_id", "pos", expr.engine_confidence(F.col("pct")).alias("confidence"))


WORDS = {"dealer": dims.DEALER_WORDS, "power": dims.POWER_WORDS, "cost": dims.COST_WORDS, "company": dims.COMPANY_WORDS}


@query(" UNION ALL ".join(f"SELECT doc_id, pos, '{k}' AS category FROM ({INV}) WHERE {_any('lower(text)', w)}" for k, w in WORDS.items()))
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = F.array_compact(F.array(*(F.when(expr.has_any(F.lower("text"), w), F.lit(k)) for k, w in WORDS.items())))
    return views.invoice_blocks(spark, sf_dir).select("doc_id", "pos", F.explode(found).alias("category"))


@query(f"SELECT doc_id, pos, CAST(num_pos AS INTEGER) AS num_pos, CAST(l[num_pos + 1] AS BIGINT) AS value FROM (SELECT doc_id, pos, l, unnest(range(len(l))) AS num_pos FROM (SELECT doc_id, pos, {_numbers('text')} AS l FROM ({INV})))")
def extract_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.invoice_blocks(spark, sf_dir).select("doc_id", "pos", F.posexplode(expr.numbers(F.col("text"))).alias("num_pos", "value")).withColumn("value", F.col("value").cast("long"))


MARKS = ["✓ ok", "✔", "√", "✗", "✘", "box X", "☑ done", "☐", "a", "Q", "none", "42"]


def _marks(spark: SparkSession, sf_dir: str, strict: bool) -> DataFrame:
    t = F.element_at(F.array(*map(F.lit, MARKS)), (F.col("doc_id") % len(MARKS) + 1).cast("int"))
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", t.alias("text")).withColumn("symbol_type", expr.symbol(F.col("text"), strict))


_MARKS_SQL = f"(SELECT doc_id, [{_q(MARKS)}][CAST(doc_id % {len(MARKS)} + 1 AS INTEGER)] AS text FROM documents)"


@query(f"SELECT doc_id, text, CASE WHEN regexp_matches(text, '[✓✔√]') THEN 'tick' WHEN regexp_matches(text, '[✗✘Xx]') THEN 'cross' WHEN contains(text, '☑') THEN 'circle_filled' WHEN contains(text, '☐') THEN 'circle_empty' WHEN regexp_matches(text, '^[A-Za-z]$') THEN 'handwritten_mark' END AS symbol_type FROM {_MARKS_SQL}")
def symbol_v1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir, True)


@query(f"SELECT doc_id, text, CASE WHEN regexp_matches(text, '[✓✔☑√]') THEN 'tick' WHEN regexp_matches(text, '[✗✘Xx]') THEN 'cross' WHEN contains(text, '☐') THEN 'circle_empty' END AS symbol_type FROM {_MARKS_SQL}")
def symbol_v2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _marks(spark, sf_dir, False)


LEFT = f"(SELECT * FROM ({DOC}) WHERE pos % 3 <> 0)"
RIGHT = f"(SELECT doc_id, pos, CASE WHEN pos % 2 = 0 THEN replace(text, 'the', 'THE') ELSE text END AS text, x1, y1, x2 + pos % 2 AS x2, y2, 1 - confidence AS confidence FROM ({DOC}) WHERE pos % 5 <> 0)"


def _engines(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    b = views.document_blocks(spark, sf_dir)
    right = b.filter("pos % 5 <> 0").withColumn("text", F.when(F.col("pos") % 2 == 0, F.replace("text", F.lit("the"), F.lit("THE"))).otherwise(F.col("text"))).withColumn("x2", F.col("x2") + F.col("pos") % 2).withColumn("confidence", 1 - F.col("confidence"))
    return b.filter("pos % 3 <> 0").withColumn("engine", F.lit("a")), right.withColumn("engine", F.lit("b"))


UNION = f"""SELECT doc_id, pos, 'a' AS engine, confidence FROM {LEFT} UNION ALL SELECT doc_id, pos, 'b', confidence FROM {RIGHT} r
  WHERE NOT EXISTS (SELECT 1 FROM {LEFT} l WHERE l.doc_id = r.doc_id AND lower(l.text) = lower(r.text) AND l.x1 = r.x1 AND l.y1 = r.y1 AND l.x2 = r.x2 AND l.y2 = r.y2)"""


@query(UNION)
def engine_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_union(*_engines(spark, sf_dir)).select("doc_id", "pos", "engine", "confidence")


@query(UNION)
def engine_preferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_preferred(*_engines(spark, sf_dir)).select("doc_id", "pos", "engine", "confidence")


@query(f"""SELECT r.doc_id, r.pos, (l.c + r.confidence) / 2 AS confidence FROM {RIGHT} r JOIN (SELECT doc_id, lower(text) AS k, x1, y1, x2, y2, arg_max(confidence, pos) AS c FROM {LEFT} GROUP BY ALL) l
  ON l.doc_id = r.doc_id AND l.k = lower(r.text) AND l.x1 = r.x1 AND l.y1 = r.y1 AND l.x2 = r.x2 AND l.y2 = r.y2""")
def engine_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merge.merge_intersection(*_engines(spark, sf_dir)).select("doc_id", "pos", "confidence")


@query(f"""WITH b AS (SELECT * FROM ({DOC})), p AS (SELECT a.doc_id, a.pos AS pos_a, b.pos AS pos_b, least(a.x2, b.x2) - greatest(a.x1, b.x1) AS w, least(a.y2, b.y2) - greatest(a.y1, b.y1) AS h,
    (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS t FROM b a JOIN b ON a.doc_id = b.doc_id AND a.pos < b.pos)
  SELECT doc_id, pos_a, pos_b, CAST(w * h AS DOUBLE) / CAST(t - w * h AS DOUBLE) AS iou FROM p WHERE w > 0 AND h > 0""")
def bbox_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = views.document_blocks(spark, sf_dir)
    pairs = b.alias("a").join(b.alias("b"), (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.pos") < F.col("b.pos")))
    box = lambda s: {k: F.col(f"{s}.{k}") for k in merge.BOX}
    return pairs.select(F.col("a.doc_id").alias("doc_id"), F.col("a.pos").alias("pos_a"), F.col("b.pos").alias("pos_b"), expr.iou(box("a"), box("b")).alias("iou")).filter("iou > 0")


@query(f"""WITH b AS (SELECT *, {REGION} AS region FROM ({INV})), c AS (SELECT *, CASE region WHEN 'header' THEN 0 ELSE 1 END AS r,
    list_filter([{_q(dims.MODELS)}], lambda m: lower(m) = lower(trim(text)))[1] AS exact, list_filter([{_q(dims.MODELS)}], lambda m: contains(trim(text), string_split(m, ' ')[-1]))[1] AS partial FROM b WHERE region <> 'footer'),
  d AS (SELECT *, round_even(CAST(0.4 AS DOUBLE) * confidence + CAST(0.4 AS DOUBLE) * CASE WHEN exact IS NOT NULL THEN CAST(1 AS DOUBLE) ELSE CAST(0.9 AS DOUBLE) END + CAST(0.2 AS DOUBLE) * CAST(0.8 AS DOUBLE), 2) AS c2 FROM c WHERE exact IS NOT NULL OR partial IS NOT NULL)
  SELECT doc_id, coalesce(exact, partial) AS model, c2 AS confidence, pos FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY c2 DESC, r, y1, pos) AS rn FROM d) WHERE rn = 1""")
def model_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.model_name(layout.with_regions(views.invoice_blocks(spark, sf_dir)))


_HP_SQL = " UNION ALL ".join(f"SELECT doc_id, pos, {k} AS pattern, text, TRY_CAST(nullif(regexp_extract(text, '(?i){p}', 1), '') AS BIGINT) AS v FROM ({INV})" for k, p in enumerate(extract.POWER_PATTERNS))


@query(f"SELECT doc_id, pos, pattern, hp FROM (SELECT doc_id, pos, pattern, CASE WHEN contains(lower(text), 'kw') THEN CAST(floor(v * CAST(1.34 AS DOUBLE)) AS BIGINT) ELSE v END AS hp FROM ({_HP_SQL})) WHERE hp BETWEEN 15 AND 100")
def hp_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.power_matches(views.invoice_blocks(spark, sf_dir)).select("doc_id", "pos", F.explode("hits").alias("h")).select("doc_id", "pos", "h.pattern", "h.hp")


@query()
def horse_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.horse_power(layout.with_regions(views.invoice_blocks(spark, sf_dir)))


@query()
def dealer_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.dealer_name(layout.with_regions(views.invoice_blocks(spark, sf_dir)))


@query()
def fuzzy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every distinct text of the header and body with the dealers it names with 0.6 at least."""
    names = list(dict.fromkeys(dims.DEALERS))
    texts = layout.with_regions(views.invoice_blocks(spark, sf_dir)).filter("region <> 'footer'").select("text").distinct()
    found = texts.select("text", F.explode(best_names(names)("text", F.lit(0.6))).alias("d"))
    return found.select("text", F.get(F.array(*(F.lit(n) for n in names)), F.col("d.ord")).alias("dealer"), F.col("d.score").alias("score"))


@query()
def block_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    left, right = _engines(spark, sf_dir)
    return merge.dedupe_blocks(left.unionByName(right).withColumn("pos", F.col("pos") * 2 + (F.col("engine") == "b").cast("long"))).select("doc_id", "pos", "engine")


_RANGES = "[" + ", ".join(f"{{'brand': '{b}', 'low': {lo}, 'high': {hi}}}" for b, (lo, hi) in dims.BRAND_POWER.items()) + "]"
_FOUND = f"list_filter({_RANGES}, lambda r: contains(lower(model), r.brand))[1]"
_POWER_SQL = """CASE WHEN power IS NULL THEN {a} WHEN power NOT BETWEEN 15 AND 100 THEN {b} WHEN f IS NULL THEN {c} WHEN power BETWEEN f.low AND f.high THEN {d} ELSE {e} END"""
VALID_POWER = f"SELECT doc_id, {_POWER_SQL.format(a='FALSE', b='FALSE', c='TRUE', d='TRUE', e='FALSE')} AS is_valid, CAST({_POWER_SQL.format(a=0.0, b=0.95, c=0.85, d=0.9, e=0.7)} AS DOUBLE) AS confidence FROM (SELECT *, {_FOUND} AS f FROM ({FIELDS}))"


def _fields(spark: SparkSession, sf_dir: str, check) -> DataFrame:
    f = views.extracted_fields(spark, sf_dir)
    return f.select("doc_id", check(f).alias("v")).select("doc_id", "v.*")


@query(VALID_POWER)
def validate_hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir, lambda f: rules.validate_power(f.power, f.model))


VALID_COST = f"SELECT doc_id, CASE WHEN cost IS NULL OR cost < 200000 OR cost > 2000000 THEN FALSE ELSE TRUE END AS is_valid, CAST(CASE WHEN cost IS NULL THEN 0 WHEN cost < 200000 OR cost > 2000000 THEN 0.8 ELSE 0.85 END AS DOUBLE) AS confidence FROM ({FIELDS})"


@query(VALID_COST)
def validate_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir, lambda f: rules.validate_cost(f.cost))


_FIRST = "string_split({} , ' ')[1]"
_MD = f"""CASE WHEN model IS NULL OR dealer IS NULL THEN {{a}} WHEN contains(lower(dealer), string_split(lower(model), ' ')[1]) OR {_any('lower(dealer)', list(dims.BRAND_POWER))} THEN {{b}}
  WHEN length(string_split(lower(model), ' ')[1]) > 3 AND contains(string_split(lower(model), ' ')[1], lower(dealer)) THEN {{c}} ELSE {{d}} END"""
VALID_MD = f"SELECT doc_id, {_MD.format(a='TRUE', b='TRUE', c='TRUE', d='FALSE')} AS is_valid, CAST({_MD.format(a=0.5, b=0.9, c=0.75, d=0.6)} AS DOUBLE) AS confidence FROM ({FIELDS})"


@query(VALID_MD)
def validate_model_dealer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir, lambda f: rules.validate_model_dealer(f.model, f.dealer))


_MH = "CASE WHEN model IS NULL OR power IS NULL THEN {a} WHEN len(list_filter(regexp_extract_all(model, '[0-9]+'), lambda n: CAST(n AS BIGINT) BETWEEN 20 AND 100 AND abs(CAST(n AS BIGINT) - power) > 20)) > 0 THEN {b} ELSE {c} END"


@query(f"SELECT doc_id, {_MH.format(a='TRUE', b='FALSE', c='TRUE')} AS is_valid, CAST({_MH.format(a=0.5, b=0.6, c=0.8)} AS DOUBLE) AS confidence FROM ({FIELDS})")
def validate_model_hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir, lambda f: rules.validate_model_power(f.model, f.power))


_MAP = "MAP {" + ", ".join(f"'{b}': '{d}'" for b, d in dims.BRAND_DEALERS.items()) + "}"
_CHECKED = "[" + ", ".join(f"{{'brand': '{b}', 'low': {dims.BRAND_POWER[b][0]}, 'high': {dims.BRAND_POWER[b][1]}}}" for b in dims.CHECKED_BRANDS) + "]"
_CHECKED_MAP = "MAP {" + ", ".join(f"'{b.split()[0]}': '{dims.BRAND_DEALERS[b]}'" for b in dims.CHECKED_BRANDS) + "}"


@query(f"""WITH f AS (SELECT *, string_split(lower(model), ' ')[1] AS a, string_split(lower(dealer), ' ')[1] AS b, list_filter({_CHECKED}, lambda r: contains(lower(model), r.brand))[1] AS g FROM ({FIELDS})),
  c AS (SELECT *, coalesce(NOT contains(b, a) AND NOT contains(a, b), FALSE) AS clash, {_CHECKED_MAP}[a] AS inferred FROM f)
  SELECT doc_id, coalesce(dealer, inferred) AS dealer, CASE WHEN dealer IS NULL AND model IS NOT NULL AND inferred IS NOT NULL THEN CAST(0.4 AS DOUBLE) WHEN clash THEN dealer_confidence * CAST(0.8 AS DOUBLE) ELSE dealer_confidence END AS dealer_confidence,
    CASE WHEN clash THEN model_confidence * CAST(0.8 AS DOUBLE) ELSE model_confidence END AS model_confidence, CASE WHEN coalesce(power NOT BETWEEN g.low AND g.high, FALSE) THEN power_confidence * CAST(0.7 AS DOUBLE) ELSE power_confidence END AS power_confidence,
    CASE WHEN coalesce(cost NOT BETWEEN 200000 AND 2000000, FALSE) THEN cost_confidence * CAST(0.6 AS DOUBLE) ELSE cost_confidence END AS cost_confidence FROM c""")
def cross_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir, lambda f: rules.cross_check(f.dealer, f.dealer_confidence, f.model, f.model_confidence, f.power, f.power_confidence, f.cost, f.cost_confidence))


@query(f"""SELECT p.doc_id, greatest(0, least(1, f.document_confidence - (0.0::DOUBLE + CASE WHEN m.is_valid THEN 0.0::DOUBLE ELSE 0.05::DOUBLE * (1.0::DOUBLE - m.confidence) END + CASE WHEN p.is_valid THEN 0.0::DOUBLE ELSE 0.1::DOUBLE * (1.0::DOUBLE - p.confidence) END
    + CASE WHEN c.is_valid THEN 0.0::DOUBLE ELSE 0.1::DOUBLE * (1.0::DOUBLE - c.confidence) END))) AS confidence FROM ({VALID_POWER}) p JOIN ({VALID_COST}) c USING (doc_id) JOIN ({VALID_MD}) m USING (doc_id) JOIN ({FIELDS}) f USING (doc_id)""")
def adjusted_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.extracted_fields(spark, sf_dir)
    return f.select("doc_id", rules.adjusted(f.document_confidence, rules.cross_validate(f.dealer, f.model, f.power, f.cost)).alias("confidence"))


@query(f"SELECT doc_id, {_MAP}[string_split(lower(model), ' ')[1]] AS value, CASE WHEN {_MAP}[string_split(lower(model), ' ')[1]] IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.4 AS DOUBLE) END AS confidence FROM ({FIELDS})")
def infer_dealer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir, lambda f: rules.infer_dealer(f.model))


_INFER = "list_filter(list_transform(regexp_extract_all(model, '[0-9]+'), lambda n: CAST(n AS BIGINT)), lambda n: n BETWEEN 15 AND 100)[1]"


@query(f"SELECT doc_id, {_INFER} AS value, CASE WHEN {_INFER} IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST(0.3 AS DOUBLE) END AS confidence FROM ({FIELDS})")
def infer_hp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fields(spark, sf_dir, lambda f: rules.infer_power(f.model))


_CONFS = ["dealer_confidence", "model_confidence", "power_confidence", "cost_confidence"]


_HUNDREDTHS = " + ".join(f"CAST(round(coalesce({c}, 0) * 100) AS BIGINT)" for c in _CONFS)


# in whole hundredths; half to even
@query(f"""SELECT doc_id, CAST(q + CASE WHEN 2 * r > n OR (2 * r = n AND q % 2 = 1) THEN 1 ELSE 0 END AS DOUBLE) / 100 AS confidence
  FROM (SELECT doc_id, n, s // n AS q, s % n AS r FROM (SELECT doc_id, {_HUNDREDTHS} + 180 AS s, 2 + {' + '.join(f'CASE WHEN {c} IS NULL THEN 0 ELSE 1 END' for c in _CONFS)} AS n FROM (SELECT * FROM ({FIELDS}))))""")
def doc_confidence_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.extracted_fields(spark, sf_dir)
    return f.select("doc_id", rules.mean_confidence(*(f[c] for c in _CONFS), F.lit(0.9), F.lit(0.9)).alias("confidence"))


_W = dict(zip(_CONFS, ("0.2", "0.25", "0.2", "0.2"), strict=True))


@query(f"""SELECT doc_id, CASE WHEN w > 0 THEN t / w ELSE 0 END AS confidence FROM (SELECT doc_id, CAST(0 AS DOUBLE) + {' + '.join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {c} * CAST({w} AS DOUBLE) END" for c, w in _W.items())} AS t,
  CAST(0 AS DOUBLE) + {' + '.join(f"CASE WHEN {c} IS NULL THEN CAST(0 AS DOUBLE) ELSE CAST({w} AS DOUBLE) END" for c, w in _W.items())} AS w FROM ({FIELDS}))""")
def doc_confidence_weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.extracted_fields(spark, sf_dir)
    return f.select("doc_id", rules.weighted_confidence(dealer_name=f.dealer_confidence, model_name=f.model_confidence, horse_power=f.power_confidence, asset_cost=f.cost_confidence).alias("confidence"))


_THERE = {"dealer": "dealer <> ''", "model": "model <> ''", "power": "power <> 0", "cost": "cost <> 0", "signature": "signature", "stamp": "stamp"}


@query(" UNION ALL ".join([*(f"SELECT '{m}' AS metric, CAST(count(*) FILTER ({c}) AS DOUBLE) AS found, count(*) AS total, CAST(count(*) FILTER ({c}) AS DOUBLE) / count(*) AS ratio FROM ({FIELDS})" for m, c in _THERE.items()), f"SELECT 'mean_confidence', round(sum(document_confidence), 6), count(*), round(sum(document_confidence) / count(*), 9) FROM ({FIELDS})"]))
def summary_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.summary(views.extracted_fields(spark, sf_dir)).withColumns({"found": F.round("found", 6), "ratio": F.when(F.col("metric") == "mean_confidence", F.round("ratio", 9)).otherwise(F.col("ratio"))})


@query(f"SELECT doc_id, CASE WHEN cost IS NULL THEN 'INR N/A' ELSE 'INR ' || format('{{:,}}', cost) END AS cost_text, CAST((doc_id * 29) % 101 AS INTEGER) || '.0%' AS pct_text FROM ({FIELDS})")
def format_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.extracted_fields(spark, sf_dir)
    return f.select("doc_id", expr.currency(f.cost).alias("cost_text"), expr.percentage(f.document_confidence).alias("pct_text"))


@query(f"""SELECT doc_id, CAST(doc_id AS VARCHAR) || ' | ' || coalesce(dealer, 'None') || ' | ' || coalesce(model, 'None') || ' | ' || coalesce(CAST(power AS VARCHAR), 'None') || ' | '
  || CASE WHEN cost IS NULL THEN 'INR N/A' ELSE 'INR ' || format('{{:,}}', cost) END || ' | ' || CAST((doc_id * 29) % 101 AS INTEGER) || '.0%' AS line FROM ({FIELDS})""")
def report_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_lines(views.extracted_fields(spark, sf_dir))


@query()
def seeded_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.seeded_sample(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id"), "doc_id", 100)


@query()
def all_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract.all_fields(layout.with_regions(views.invoice_blocks(spark, sf_dir)))


def _drawn(ids: pd.Series) -> pd.Series:
    """A page for each id: lines of ink, a red disc on some, a box on others, nothing on every fifth."""
    out = []
    for i in ids:
        x = np.full((120, 160, 3), 255, np.uint8)
        if i % 5:
            x[20:24, 10 : 60 + int(i) % 40] = 0
            x[40:44, 10:90] = 30
        if i % 3 == 0:
            yy, xx = np.mgrid[:120, :160]
            x[(yy - 90) ** 2 + (xx - 120) ** 2 < 144] = (0, 0, 220)
        if i % 4 == 0:
            x[95:115, 20:60] = 0
        out.append(x.tobytes())
    return pd.Series(out)


_draw = F.pandas_udf(_drawn, BinaryType())


@query()
def visual_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    seen = pages.visual_fields(_drawings(spark, sf_dir))
    return seen.withColumns({c: F.array_join(F.col(c).cast("array<string>"), ",") for c in ("signature_box", "stamp_box")})


@query()
def extracted_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.extracted_document(layout.with_regions(views.invoice_blocks(spark, sf_dir)))


@query(f"""SELECT doc_id, CASE WHEN power IS NULL THEN 'HP value is missing' WHEN power NOT BETWEEN 15 AND 100 THEN 'HP value ' || power || ' is outside typical tractor range (15-100)'
    WHEN f IS NULL THEN 'HP value ' || power || ' is within valid tractor range' WHEN power BETWEEN f.low AND f.high THEN 'HP value ' || power || ' is valid for ' || f.brand
    ELSE 'HP value ' || power || ' is outside expected range for ' || f.brand || ' (' || f.low || '-' || f.high || ')' END AS power_message,
  CASE WHEN cost IS NULL THEN 'Cost value is missing' WHEN cost < 200000 THEN 'Cost ' || cost || ' seems too low for a tractor' WHEN cost > 2000000 THEN 'Cost ' || cost || ' seems too high for a tractor'
    ELSE 'Cost ' || format('{{:,}}', cost) || ' is within reasonable tractor range' END AS cost_message FROM (SELECT *, {_FOUND} AS f FROM ({FIELDS}))""")
def rule_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.extracted_fields(spark, sf_dir)
    return f.select("doc_id", rules.power_message(f.power, f.model)["message"].alias("power_message"), rules.cost_message(f.cost)["message"].alias("cost_message"))


@query(f"SELECT doc_id, pos, CAST(unnest(list_filter({_numbers('text')}, lambda n: n >= 10000)) AS BIGINT) AS value FROM ({INV}) WHERE {_any('lower(text)', dims.COST_WORDS)}")
def cost_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.cost_candidates(views.invoice_blocks(spark, sf_dir)).select("doc_id", "pos", "value")


@query(f"SELECT DISTINCT doc_id, pos, hp AS value FROM ({ORACLES['hp_patterns']})")
def power_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.power_candidates(views.invoice_blocks(spark, sf_dir)).select("doc_id", "pos", "value")


@query(f"SELECT doc_id, pos, CASE WHEN (y1 + y2) / 2.0 <= 350 THEN 'header' WHEN (y1 + y2) / 2.0 >= 750 THEN 'footer' ELSE 'body' END AS section FROM ({DOC}) WHERE confidence >= 0.5")
def word_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.sections(candidates.confident(views.document_blocks(spark, sf_dir))).select("doc_id", "pos", "section")


@query(f"""SELECT doc_id, CAST(row AS BIGINT) AS row, regexp_replace(trim(cells[1], E' \\t\\n\\r'), ' *:$', '') AS key, array_to_string(cells[2:], ' ') AS value
  FROM (SELECT doc_id, floor((y1 + y2) / 2.0 / 20) AS row, list(text ORDER BY x1, pos) AS cells FROM (SELECT * FROM ({INV})) GROUP BY ALL) WHERE len(cells) > 1""".replace("/ 20)", "/ 200)"))
def table_key_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.key_values(candidates.table_rows(views.invoice_blocks(spark, sf_dir), height=200))


@query(f"SELECT doc_id, string_agg(text, chr(10) ORDER BY pos) AS text FROM ({INV}) GROUP BY doc_id")
def page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document.page_text(views.invoice_blocks(spark, sf_dir))


@query(f"SELECT doc_id || '_page' || (doc_id % 4 + 1) AS page_key FROM ({FIELDS})")
def page_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = views.extracted_fields(spark, sf_dir)
    return f.select(files.page_key(F.col("doc_id"), F.col("doc_id") % 4 + 1).alias("page_key"))


@query(f"""SELECT doc_id, 1 AS page_number, dealer AS dealer_value, coalesce(dealer_confidence, 0) AS dealer_confidence, power AS power_value, coalesce(power_confidence, 0) AS power_confidence, signature AS signature_present,
  CAST(0 AS DOUBLE) AS signature_confidence, document_confidence, strftime(make_timestamp(2024, 1, 2, 3, 4, 5.25), '%Y-%m-%dT%H:%M:%S.%f') AS extraction_timestamp FROM ({FIELDS})""")
def result_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = files.results(views.extracted_fields(spark, sf_dir), stamped=F.lit("2024-01-02 03:04:05.25").cast("timestamp"))
    return r.select("doc_id", "page_number", F.col("dealer_name.value").alias("dealer_value"), F.col("dealer_name.confidence").alias("dealer_confidence"), F.col("horse_power.value").alias("power_value"), F.col("horse_power.confidence").alias("power_confidence"),
                    F.col("signature.present").alias("signature_present"), F.col("signature.confidence").alias("signature_confidence"), "document_confidence", "extraction_timestamp")


@query()
def report_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.report_text(views.extracted_fields(spark, sf_dir))


def _drawings(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the keys are one small file; pages are drawn and looked at by all cores
    ids = spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey").repartition(4 * spark.sparkContext.defaultParallelism, "s_suppkey")
    image = F.struct(F.lit("").alias("origin"), F.lit(120).alias("height"), F.lit(160).alias("width"), F.lit(3).alias("nChannels"), F.lit(16).alias("mode"), _draw("s_suppkey").alias("data"))
    return ids.select(F.format_string("page%d.png", "s_suppkey").alias("path"), image.alias("image"))


@query()
def image_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.image_quality(_drawings(spark, sf_dir))


@query()
def stroke_width(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.stroke_widths(_drawings(spark, sf_dir))


@query()
def contour_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.mark_shapes(_drawings(spark, sf_dir))


@query()
def color_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.color_regions(_drawings(spark, sf_dir))
