import random

import pytest
from pyspark.sql import functions as F

from quillstone.functions import dims, expr, fuzzy, rules
from quillstone.operators import extract, layout, merge, report
from quillstone.sources import engines

COLS = "doc_id long, pos long, text string, x1 long, y1 long, x2 long, y2 long, confidence double"


def blocks(spark, rows):
    return layout.with_regions(spark.createDataFrame([(d, p, t, 0, y, 100, y + 20, c) for d, p, t, y, c in rows], COLS))


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_dimension_sizes():
    assert (len(dims.DEALERS), len(set(dims.DEALERS)), len(dims.MODELS), len(dims.BRAND_POWER)) == (90, 81, 75, 16)


@pytest.mark.parametrize(("text", "want"), [("Rs. 5,25,000.00", [52500000]), ("HP 48.5", [485]), ("४८ एचपी", [48]), ("none", []), ("", [])])
def test_numbers(spark, text, want):
    assert [int(x) for x in one(spark, expr.numbers(F.lit(text)))] == want


def test_text_functions(spark):
    assert one(spark, expr.strip(F.lit("\u00a0\t a \n"))) == "a"
    assert [one(spark, expr.symbol(F.lit(t))) for t in ("✓", "☑", "☐", "X", "q", "no")] == ["tick", "circle_filled", "circle_empty", "cross", "handwritten_mark", None]
    assert one(spark, expr.symbol(F.lit("☑"), False)) == "tick"
    assert one(spark, expr.currency(F.lit(525000))) == "INR 525,000" and one(spark, expr.currency(F.lit(None).cast("long"))) == "INR N/A"
    assert one(spark, expr.percentage(F.lit(0.875))) == "87.5%"
    assert [one(spark, expr.region(F.lit(y))) for y in (210.0, 210.5, 449.5, 450.0)] == ["header", "body", "body", "footer"]


def test_page_names(spark):
    names = ["172427893_3_pg11.png", "172561841_pg1.png", "sample_invoice.png", "A.PNG"]
    got = layout.parse_page_names(spark.createDataFrame([(n,) for n in names], "path string")).collect()
    assert [(r.invoice_id, r.page_num) for r in got] == [("172427893", 11), ("172561841", 1), ("sample_invoice", 1), ("A.PNG", 1)]


def test_fuzzy_score():
    assert fuzzy.score(" ABC Tractors", "abc tractors") == 1.0
    assert fuzzy.score("डीलर", "Swaraj") < 0.5 and fuzzy.score("डीलर", "Swaraj", compat=True) == 0.85
    assert fuzzy.ratio("tide", "diet") == 0.25 and fuzzy.ratio("diet", "tide") == 0.5
    rng = random.Random(4)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcde tr") for _ in range(rng.randint(1, 14))) for _ in range(2))
        whole, pruned = fuzzy.score(a, b), fuzzy.score(a, b, least=0.5)
        assert pruned == whole or (whole < 0.5 and pruned < 0.5)


def test_cost(spark):
    b = blocks(spark, [(1, 0, "Total Rs. 5,25,000", 500, 0.9), (1, 1, "999999", 510, 0.9), (2, 0, "777777 and 888888", 300, 0.5), (3, 0, "Total 99", 500, 1.0), (4, 0, "cost 50000", 20, 0.9)])
    assert {r.doc_id: (r.value, r.pos) for r in extract.asset_cost(b).collect()} == {1: (525000, 0), 2: (888888, 0)}


def fold_power(rows):
    """The fold over (v1, c1, v2, c2, v3, c3) as the rules say, one block after another."""
    v, c = None, 0.0
    for v1, c1, v2, c2, v3, c3 in rows:
        if v1 is not None and c1 > c:
            v, c = v1, min(c1, 1.0)
        if v2 is not None and c < 0.8 and c2 > c:
            v, c = v2, c2
        if v3 is not None and c < 0.7 and c3 > c:
            v, c = v3, c3
    return v


def test_power(spark):
    b = blocks(spark, [(1, 0, "50 HP", 300, 0.9), (2, 0, "Rating 40 kw", 300, 0.9), (3, 0, "✓ 45 ok", 300, 0.5), (4, 0, "engine no 30", 300, 0.4), (5, 0, "150 HP", 300, 0.9), (6, 0, "50 HP", 300, 1.0), (6, 1, "55 HP", 400, 1.0), (7, 0, "60 HP", 300, 0.2)])
    got = {r.doc_id: r.hp for r in extract.horse_power(b).collect()}
    assert got == {1: 50, 2: 53, 3: 45, 4: 30, 6: 55}
    assert fold_power([(50, 1.14, None, 0, None, 0), (55, 1.1, None, 0, None, 0)]) == 55


def test_model(spark):
    b = blocks(spark, [(1, 0, "mahindra 575 di", 20, 0.5), (1, 1, "x DI", 20, 0.55), (2, 0, "the DI", 300, 0.9), (3, 0, "nothing", 20, 0.9)])
    assert {r.doc_id: (r.model, r.pos) for r in extract.model_name(b).collect()} == {1: ("Mahindra 575 DI", 0), 2: ("Mahindra 575 DI", 0)}


def test_dealer(spark):
    b = blocks(spark, [(1, 0, "Dealer: ABC Tractors", 20, 0.9), (2, 0, "Swaraj", 20, 0.9), (3, 0, "zzzz qqqq", 20, 0.9), (4, 0, "Swaraj", 20, 0.1)])
    got = {r.doc_id: r.dealer for r in extract.dealer_name(b).collect()}
    assert got[1] == "ABC Tractors" and got[2] == "Swaraj" and set(got) == {1, 2}


def test_merge(spark):
    row = lambda p, t, c, x=0: (1, p, t, x, 0, x + 100, 20, c)
    left = spark.createDataFrame([row(0, "A", 0.5), row(1, "a", 0.7), row(2, "b", 0.1)], COLS)
    right = spark.createDataFrame([row(0, "a", 0.9), row(1, "c", 0.2), row(2, "b", 0.3, 5)], COLS)
    assert sorted((r.text, r.confidence) for r in merge.merge_union(left, right).collect()) == [("A", 0.5), ("a", 0.7), ("b", 0.1), ("b", 0.3), ("c", 0.2)]
    assert [(r.text, round(r.confidence, 9)) for r in merge.merge_intersection(left, right).collect()] == [("a", 0.8)]
    kept = merge.dedupe_blocks(left).collect()
    assert [(r.pos, r.text) for r in kept] == [(1, "a"), (2, "b")]
    again = merge.dedupe_blocks(spark.createDataFrame(kept, COLS))
    assert again.count() == 2


def test_rules(spark):
    v = lambda c: tuple(one(spark, c))
    n, s = (lambda x: F.lit(x).cast("long")), (lambda x: F.lit(x).cast("string"))
    assert [v(rules.validate_power(n(p), s(m))) for p, m in ((None, "x"), (150, "x"), (50, "Mahindra 575"), (70, "Sonalika 1"), (50, "other"))] == [(False, 0.0), (False, 0.95), (True, 0.9), (False, 0.7), (True, 0.85)]
    assert [v(rules.validate_cost(n(c)))[1] for c in (None, 199999, 500000, 2000001)] == [0.0, 0.8, 0.85, 0.8]
    assert v(rules.validate_model_dealer(s("Mahindra 575 DI"), s("Sonalika Tractors"))) == (True, 0.9)
    assert v(rules.validate_model_power(s("Mahindra 75"), n(20))) == (False, 0.6)
    assert v(rules.infer_dealer(s("mahindra 575 DI"))) == ("Mahindra Tractors", 0.4) and v(rules.infer_power(s("x 575 42"))) == (42, 0.3)
    assert one(spark, rules.weighted_confidence(dealer_name=F.lit(None).cast("double"))) == 0.0
    assert one(spark, rules.mean_confidence(F.lit(0.5), F.lit(None).cast("double"), F.lit(1.0))) == 0.75


def test_report_and_empty(spark):
    schema = "doc_id long, dealer string, model string, power long, cost long, signature boolean, stamp boolean, document_confidence double"
    rows = spark.createDataFrame([(1, "a", "", 0, 5, True, False, 0.5), (2, None, "m", 3, None, False, False, 1.0)], schema)
    got = {r.metric: (r.found, r.ratio) for r in report.summary(rows).collect()}
    assert got["dealer"] == (1, 0.5) and got["model"] == (1, 0.5) and got["cost"] == (1, 0.5) and got["mean_confidence"] == (1.5, 0.75)
    assert {r.ratio for r in report.summary(rows.limit(0)).collect()} == {0.0}
    empty = blocks(spark, [(1, 0, "x", 0, 0.1)]).limit(0)
    assert extract.all_fields(empty).count() == 0


def test_engines(spark):
    pages = spark.createDataFrame([("d", 1, b"x"), ("d", 2, None)], "doc_id string, page_number int, data binary")

    def broken(_):
        raise OSError

    got = engines.recognise(pages, {"mock": engines.mock, "bad": broken}, tag=True).collect()
    assert len(got) == 4 and got[1].text == "[mock] HP 50"
    assert engines.resolve("trocr+easyocr", ["eng", "hin"]) == ["trocr", "easyocr"] and engines.resolve("easyocr", ["hin"]) == ["easyocr"]
