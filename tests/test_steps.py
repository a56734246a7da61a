import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillstone.functions import dims, expr, fuzzy, images, rules
from quillstone.operators import candidates, document, layout, pages, report, stages
from quillstone.sources import engines, files

WORDS = "doc_id string, pos long, text string, x1 long, y1 long, x2 long, y2 long, confidence double"


def word(text, pos=0, y=0, conf=0.9, doc="d", x=0):
    return (doc, pos, text, x, y, x + 50, y + 20, conf)


def page(draw=(), color=False, size=(400, 400)):
    x = np.full((*size, 3) if color else size, 255, np.uint8)
    for value, a, b, c, d in draw:
        x[b:d, a:c] = value
    return x


def test_candidates(spark):
    one = lambda t: spark.createDataFrame([word(t)], WORDS)
    assert [r.value for r in candidates.power_candidates(one("Power 50 HP")).collect()] == [50]
    assert [r.value for r in candidates.cost_candidates(one("Total Amount 525000")).collect()] == [525000]
    rows = [word("Power 50 HP", 0, 400), word("Power 60 HP", 1, 420, 0.95), word("Total 525000", 2, 800), word("Total 725000", 3, 820, 0.4), word("other", 4, 10), word("none", 0, doc="e")]
    got = {r.doc_id: r for r in candidates.process_words(spark.createDataFrame(rows, WORDS)).collect()}
    assert (got["d"].power, got["d"].cost, got["d"].complete) == (60, 525000, True) and (got["e"].power, got["e"].complete) == (None, False)
    assert [r.section for r in candidates.sections(spark.createDataFrame(rows, WORDS)).orderBy("doc_id", "pos").collect()][:3] == ["body", "body", "footer"]
    table = spark.createDataFrame([word("Model :", 0, 100), word("Mahindra", 1, 104, x=90), word("575 DI", 2, 102, x=160), word("alone", 3, 300)], WORDS)
    assert [(r.key, r.value) for r in candidates.key_values(candidates.table_rows(table)).collect()] == [("Model", "Mahindra 575 DI")]
    quad = spark.createDataFrame([("HP 50", [[50, 120], [120, 121], [119, 145], [50, 144]], 0.98, 1)], "text string, box array<array<int>>, score double, page_num int")
    r = candidates.standard_words(quad).first()
    assert (r.x1, r.y1, r.x2, r.y2, r.confidence, r.page) == (50, 120, 120, 145, 0.98, 1)


def test_names_are_those_that_score(spark):
    """The bounds leave no name out: against every pair, one after another."""
    texts = ["dealer: abc tractors", "ABC Tractors", "", "₹₹", "Mahindra", "a", "sonalika intl tractors pvt ltd", "Invoice no 4711", "xyz tractor agency", "brothers & sons", "aeiou", "John Deere Indla"]
    floors = [(0.5, 0.6, 0.7)[k % 3] for k in range(len(texts))]
    for text, floor, found in zip(texts, floors, fuzzy.named(texts, floors, dims.DEALERS), strict=True):
        every = [(k, fuzzy.score(text, d)) for k, d in enumerate(dims.DEALERS)]
        assert found == [(k, s) for k, s in every if s >= floor]


def test_whole_document(spark):
    """No dealer: inferred from the model; a model's power out of its brand's range; a tick's number beats a weak power."""
    rows = [word("Mahindra 575 DI", 0, 100, 0.25, "a"), word("47 HP", 1, 300, 0.9, "a"), word("Total Rs. 5,25,000", 2, 500, 0.8, "a"), word("nothing", 0, 100, 0.9, "b")]
    blocks = layout.with_regions(spark.createDataFrame(rows, WORDS))
    got = {r.doc_id: r for r in document.extracted_document(blocks).collect()}
    a, b = got["a"], got["b"]
    assert (a.dealer_source, a.dealer_confidence, a.model, a.power, a.cost) == ("inferred", 0.4, "Mahindra 575 DI", 47, 525000)
    assert (a.signature, a.signature_confidence, a.stamp, a.stamp_confidence) == (False, 0.9, False, 0.9)
    # a text of 0.25 names no dealer, but a model: 0.4 * 0.25 + 0.56
    assert a.document_confidence == pytest.approx(round((0.4 + 0.66 + a.power_confidence + 0.8 + 1.8) / 6, 2))
    assert (b.dealer, b.power, b.cost, b.document_confidence) == (None, None, None, 0.9)
    visual = spark.createDataFrame([("b", True, 0.95, True, 0.8, 35, 0.85)], "doc_id string, signature boolean, signature_confidence double, stamp boolean, stamp_confidence double, mark_power int, mark_confidence double")
    b = {r.doc_id: r for r in document.extracted_document(blocks, visual).collect()}["b"]
    assert (b.power, b.power_confidence, b.power_source, b.stamp, b.document_confidence) == (35, 0.85, "visual", True, 0.87)
    marks = spark.createDataFrame([("a", 0, "circle", 0, 290, 20, 310), ("a", 1, "tick", 60, 310, 70, 330)], "doc_id string, ord int, kind string, x1 int, y1 int, x2 int, y2 int")
    assert [tuple(r) for r in document.beside_marks(blocks, marks).collect()] == [("a", 47, 0.85)]
    assert document.page_text(blocks).filter("doc_id = 'a'").first().text.split("\n")[1] == "47 HP"


def test_messages(spark):
    rows = [(None, None, None, None), (5, 100, "Mahindra 575", "X"), (50, 300000, "Mahindra 575 DI", "Mahindra Motors"), (90, 3000000, "Foo 40", "Bar")]
    df = spark.createDataFrame(rows, "power int, cost int, model string, dealer string")
    out = df.select(rules.power_message(F.col("power"), F.col("model"))["message"].alias("p"), rules.cost_message(F.col("cost")).alias("c"), rules.model_dealer_message(F.col("model"), F.col("dealer"))["message"].alias("d"), rules.model_power_message(F.col("model"), F.col("power"))["message"].alias("q")).collect()
    assert out[0].p == "HP value is missing" and out[0].c.message == "Cost value is missing" and out[0].d.startswith("Cannot validate")
    assert out[1].p == "HP value 5 is outside typical tractor range (15-100)" and out[1].c.suggestion == "Typical tractor cost should be above 200,000 INR"
    assert out[2].p == "HP value 50 is valid for mahindra" and out[2].c.message == "Cost 300,000 is within reasonable tractor range" and out[2].d == "Model brand is consistent with dealer name"
    assert out[3].p == "HP value 90 is within valid tractor range" and out[3].q == "Model Foo 40 contains number 40 but HP is 90" and out[3].c.message == "Cost 3000000 seems too high for a tractor"
    got = spark.createDataFrame([(["Hindi", "eng", "xx"],), ([],)], "n array<string>").select(expr.language_list(F.col("n")).alias("x")).collect()
    assert [r.x for r in got] == ["eng+hin", "eng"]


def test_marks_by_rules():
    thin = {"aspect": 1.0, "solidity": 0.4, "circularity": 0.2, "area": 500.0, "share": 0.02}
    assert images.mark_kind(thin, "wide") == ("tick", 0.85) and images.mark_kind(thin, "scored") == ("tick", pytest.approx(0.9))
    cross = thin | {"solidity": 0.2}
    assert [images.mark_kind(cross, r) for r in ("wide", "plain", "scored")] == [("cross", 0.8), ("square", 0.65), ("cross", pytest.approx(0.85))]
    disc = thin | {"solidity": 0.95, "circularity": 0.85}
    assert [images.mark_kind(disc, r) for r in ("wide", "plain", "scored")] == [("circle", 0.75), ("circle", 0.75), ("circle", pytest.approx(0.85))]
    flat = thin | {"aspect": 5.0, "share": 0.005}
    assert images.mark_kind(flat, "wide") == ("tick", 0.7) and images.mark_kind(flat | {"share": 0.02}, "wide") == ("square", 0.65)
    assert images.mark_kind(flat | {"area": 2000.0, "circularity": 0.5}, "scored") == ("unknown", 0.5)
    square = page([(0, 100, 100, 140, 140)])
    found = images.marks(square, "wide")
    assert len(found) == 1 and found[0]["present"] and all(abs(a - b) <= 3 for a, b in zip(found[0]["box"], (100, 100, 140, 140), strict=True))
    assert images.marks(square, region=(300, 300, 400, 400)) == [images.ABSENT] == images.marks(square, region=(50, 50, 40, 60))
    assert images.single_mark(page()) == images.ABSENT
    x1, y1, x2, y2 = images.padded_marks(square)[0]
    assert x1 <= 90 and x2 >= 150 and images.padded((0, 0, 5, 5), 10, square) == (0, 0, 15, 15)


def test_stamps_and_signatures():
    disc = page(color=True)
    yy, xx = np.mgrid[:400, :400]
    disc[(yy - 350) ** 2 + (xx - 330) ** 2 < 18**2] = (0, 0, 220)
    assert images.stamp(disc)["present"] and not images.stamp(disc[:200])["present"] and images.stamp(disc, "right")["present"]
    assert len(images.red_ink(disc)) == 1 and not images.red_ink(disc[..., 0])
    assert images.chosen_stamp(disc)["present"] and images.any_stamp(page(color=True))["present"] is False
    big = page(color=True)
    big[(yy - 200) ** 2 + (xx - 200) ** 2 < 60**2] = (0, 0, 220)
    assert len(images.red_ink(big)) == 1 and images.chosen_stamp(big)["present"] and images.circular(255 - images.gray(big), (130, 130, 270, 270))
    # a wide bar: 0.7, and 0.15 as it is wide, and 0.1 as its aspect is above 0.3
    bar = page([(0, 50, 330, 250, 370)])
    assert images.signature(bar)["confidence"] == pytest.approx(0.95) and not images.signature(page())["present"]
    tall = page([(0, 100, 305, 130, 395)])
    assert images.signature(tall)["confidence"] == pytest.approx(0.8)


def test_strokes_and_skew():
    even = np.zeros((60, 60), np.uint8)
    even[5:10, 5:10] = even[20:25, 20:25] = 255
    odd = even.copy()
    odd[30:55, 30:55] = 255
    assert images.strokes_scored(even) == {"handwritten": False, "confidence": 0.5, "width": 5.0}
    assert images.strokes_scored(odd)["handwritten"] and images.strokes_scored(odd)["confidence"] == 0.9 and images.is_handwritten(odd) and not images.is_handwritten(even)
    assert images.strokes_scored(np.zeros((0, 3), np.uint8))["confidence"] == 0.0 and images.block_strokes(odd, (70, 70, 80, 80))["confidence"] == 0.5
    assert [s["parts"] for s in images.blocks_strokes(odd, [(0, 0, 60, 60), (0, 0, 15, 15)])] == [3, 1]
    upright = page([(0, 100, 180, 300, 220)])
    assert images.skew(upright) == 0.0 and images.deskewed(upright) is upright
    c, s = np.cos(np.radians(5)), np.sin(np.radians(5))
    yy, xx = np.mgrid[:400, :400] - 200
    leaning = np.where((abs(c * xx + s * yy) < 100) & (abs(-s * xx + c * yy) < 20), 0, 255).astype(np.uint8)
    assert abs(abs(images.skew(leaning)) - 5) < 1 and abs(images.skew(images.deskewed(leaning))) < 1
    tick = page([(0, 100, 100, 140, 110), (0, 100, 100, 110, 140)])
    assert images.power_by_mark(tick, lambda crop: "no 7 but 45 HP")["value"] == 45 and images.power_by_mark(tick, lambda crop: None) is None
    assert images.written_power(page()) is None and images.written_cost(page()) is None


def test_pages_and_png_files(spark, tmp_path):
    inside, out = tmp_path / "in", tmp_path / "out"
    inside.mkdir()
    good = page([(0, 20, 20, 200, 60), (90, 100, 100, 300, 300)])
    for name, x in (("12_3_pg2.png", good), ("12_3_pg1.png", page()), ("77_pg1.png", page()), ("solo.PNG", good)):
        (inside / name).write_bytes(images.png(x))
    got = {(r.invoice_id, r.page_number) for r in pages.process_pages(spark, str(inside), output=str(out)).collect()}
    # the blank first page goes, its number is not given away; the invoice of blank pages is gone
    assert got == {("12", 2), ("solo.PNG", 1)} and {p.name for p in out.iterdir()} == {"12_pg2_normalized.png", "solo.PNG_pg1_normalized.png"}
    assert files.images(spark, str(out)).filter("image.height = 600 and image.width = 800").count() == 2
    asked = [str(inside / "solo.PNG"), str(inside / "12_3_pg2.png")]
    listed = pages.page_list(spark, asked, output=str(out)).orderBy("page").collect()
    assert [r.path.rpartition("/")[2] for r in listed] == ["solo.PNG", "12_3_pg2.png"] and (out / "solo_normalized.png").exists()
    with pytest.raises(ValueError):
        pages.page_list(spark, [str(inside / "x.jpg")])
    with pytest.raises(Exception, match="(?i)path|exist"):
        pages.page_list(spark, [str(inside / "missing.png")]).collect()
    assert pages.page_list(spark, []).count() == 0
    assert [r.page for r in pages.folder_pages(spark, str(inside)).orderBy("path").collect()] == [1, 2, 3, 4]
    unit = pages.unit_images(files.images(spark, str(inside)), 8, 6).collect()
    assert all(len(r.pixels) == 48 and 0 <= min(r.pixels) <= max(r.pixels) <= 1 for r in unit)


def test_steps_and_their_files(spark, tmp_path):
    shown = spark.createDataFrame([("d1", 1, b"x"), ("d2", 1, None)], "doc_id string, page_number int, data binary")
    blocks = stages.recognition_step(shown, {"one": engines.mock, "two": engines.mock}, output=str(tmp_path / "ocr"))
    # the second engine reads the same, so its blocks go
    assert blocks.count() == 4 and {p.name for p in (tmp_path / "ocr").iterdir()} == {"d1_page1_ocr_output.json", "d2_page1_ocr_output.json"}
    back = files.ocr_json(spark, str(tmp_path / "ocr"))
    assert sorted(r.text for r in files.exploded_blocks(back).collect()) == ["Cost 150000", "Dealer ABC Tractors", "HP 50", "Model X1"]
    laid = stages.layout_step(blocks, output=str(tmp_path / "layout"))
    again = files.layout_json(spark, str(tmp_path / "layout"))
    assert [len(r.header_blocks) for r in laid.collect()] == [len(r.header_blocks) for r in again.collect()] == [3]
    results = stages.extraction_step(again.select("doc_id", "page_number", "header_blocks", "body_blocks", "footer_blocks"), output=str(tmp_path / "out"))
    found = json.loads((tmp_path / "out" / "d1_page1_extracted.json").read_text())
    assert found["dealer_name"]["value"] == "ABC Tractors" and found["dealer_name"]["source"] == "text" and found["asset_cost"] == {"value": None, "confidence": 0.0}
    assert found["signature"] == {"present": False, "confidence": 0.9} and "\n  " in (tmp_path / "out" / "d1_page1_extracted.json").read_text()
    read = files.result_json(spark, str(tmp_path / "out" / "d1_page1_extracted.json"), "doc_id string, document_confidence double")
    assert read.first().doc_id == "d1" and {r.doc_id for r in files.save_results(results).collect()} == {"d1"}
    assert stages.sampled(blocks, 0).count() == 4 and stages.sampled(shown, 1).count() == 1
    lines = engines.by_lines(lambda part: (part.decode(), 0.5) if part != b"bad" else 1 / 0, lambda image: [((0, 0, 1, 1), p) for p in image.split()])
    assert [x[0] for x in lines(b"a bad c")] == ["a", "c"] and lines(None) == []


def test_results_and_report(spark):
    fields = spark.createDataFrame([("d", "ABC", 0.9, None, None, True, 0.5)], "doc_id string, dealer string, dealer_confidence double, power int, power_confidence double, signature boolean, document_confidence double")
    stamped = files.results(fields, stamped=F.lit("2024-01-02 03:04:05").cast("timestamp"), metadata=F.create_map(F.lit("k"), F.lit("v"))).first()
    assert stamped.extraction_timestamp.startswith("2024-01-02T03:04:05") and stamped.metadata == {"k": "v"} and stamped.page_number == 1
    assert stamped.horse_power.asDict() == {"value": None, "confidence": 0.0} and stamped.signature.present and stamped.stamp.asDict() == {"present": False, "confidence": 0.0}
    lines = [r.line for r in report.report_text(fields).orderBy("part", "doc_id", "k").collect()]
    assert lines[:5] == ["Document: d", "  Dealer: ABC", "  Model: N/A", "  HP: None", "  Cost: N/A"] and lines[5:8] == ["  Signature: Yes", "  Stamp: No", "  Confidence: 50.0%"]
    assert lines[8:] == ["Average Confidence: 50.0%", "Dealer Found: 1/1 (100.0%)", "HP Found: 0/1 (0.0%)", "Signature Present: 1/1 (100.0%)"]
    box = spark.createDataFrame([(5, 5, 20, 30)], "x1 int, y1 int, x2 int, y2 int").select(expr.expand_box(F.struct("x1", "y1", "x2", "y2"), 10, 25, 100).alias("b"), expr.ltwh_to_box(F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2")).alias("c"), expr.language_code(F.lit("Hindi")).alias("l"), fuzzy.text_ratio(F.lit("abcd"), F.lit("ABxd")).alias("r")).first()
    assert tuple(box.b) == (0, 0, 25, 40) and tuple(box.c) == (5, 5, 25, 35) and box.l == "hi" and box.r == pytest.approx(0.75)
