import numpy as np
import pytest

from quillstone.functions import images
from quillstone.operators import pages
from quillstone.sources import files
from quillstone.streaming import ingest


def disc(color, shape=(200, 200), at=(150, 150), r=25):
    x = np.full((*shape, 3), 255, np.uint8)
    yy, xx = np.mgrid[: shape[0], : shape[1]]
    x[(yy - at[0]) ** 2 + (xx - at[1]) ** 2 < r * r] = color
    return x


def test_quality():
    assert not images.quality(np.zeros((200, 200), np.uint8)) and not images.quality(np.zeros((99, 200), np.uint8))
    assert images.quality(np.tile(np.arange(200, dtype=np.uint8), (150, 1)))


def test_components_against_flood_fill():
    rng = np.random.default_rng(1)
    mask = rng.random((30, 40)) < 0.4
    got = images.components(mask)
    seen, count = np.zeros(mask.shape, bool), 0
    for y, x in zip(*np.nonzero(mask)):
        if not seen[y, x]:
            count += 1
            todo = [(y, x)]
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                assert got[a, b] == got[y, x]
                for c in range(max(a - 1, 0), min(a + 2, 30)):
                    for d in range(max(b - 1, 0), min(b + 2, 40)):
                        if mask[c, d] and not seen[c, d]:
                            seen[c, d] = True
                            todo.append((c, d))
    assert got.max() == count


def test_colors_and_shapes():
    red = disc((0, 0, 220))
    boxes, sure = images.color_regions(red)
    assert len(boxes) == 1 and sure == pytest.approx(0.9)
    assert images.stamps(red)[0]["color"] == "red" and not images.stamps(disc((0, 0, 0)))[0]["present"]
    with pytest.raises(ValueError):
        images.color_mask(red, "pink")
    s = images.shapes(images.color_mask(red, "red"))[0]
    assert s["circularity"] > 0.6 and 0.9 < s["aspect"] < 1.1 and s["solidity"] > 0.9
    assert images.color_regions(red[..., 0])[0] == []


def test_normalise_and_strokes():
    out = images.normalise(disc((0, 0, 0)))
    assert out.shape == (600, 800) and out.dtype == np.uint8
    x = np.zeros((50, 50), np.uint8)
    x[5:10, 5:10] = x[20:25, 20:25] = 255
    assert images.strokes(x) == {"handwritten": False, "confidence": 0.5, "width": 5.0, "variance": 0.0, "parts": 2}


def test_image_source(spark, tmp_path):
    (tmp_path / "a_pg1.PNG").write_bytes(images.png(disc((0, 0, 220))))
    (tmp_path / "b.png").write_bytes(images.png(disc((0, 0, 0))))
    (tmp_path / "c.txt").write_text("no")
    assert files.png_files(spark, str(tmp_path)).count() == 2
    found = {r.path.rpartition("/")[2]: r for r in pages.visual_fields(files.images(spark, str(tmp_path), True)).collect()}
    assert found["a_pg1.PNG"].stamp and not found["b.png"].stamp
    assert pages.normalised_pages(files.images(spark, str(tmp_path), True)).first().image.height == 600


def test_json_source_and_stream(spark, tmp_path):
    (tmp_path / "d_page1.json").write_text('{"doc_id": "d", "page_number": 1, "ocr_blocks": [{"text": "48 HP", "bbox": [0, 10, 5, 30], "confidence": 0.9}, {"text": "x"}]}')
    (tmp_path / "d_page2.json").write_text('{"doc_id": "d", "page_number": 2, "ocr_blocks": []}')
    (tmp_path / "bad.json").write_text("{")
    assert files.ocr_json(spark, str(tmp_path)).count() == 2 and files.ocr_json(spark, str(tmp_path), compat=True).count() == 1
    rows = files.exploded_blocks(files.ocr_json(spark, str(tmp_path))).orderBy("pos").collect()
    assert [(r.text, r.y1, r.confidence) for r in rows] == [("48 HP", 10, 0.9), ("x", 0, 0.5)]
    q = ingest.stream_blocks(spark, str(tmp_path)).writeStream.format("memory").queryName("blocks").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("blocks").count() == 2


def test_pages_are_drawn_by_many_tasks_and_looked_at_once_for_all_colours(spark, monkeypatch):
    from quillstone.plans import catalog

    assert catalog._drawings(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() > 1
    calls, hsv = [], images.hsv
    monkeypatch.setattr(images, "hsv", lambda x: calls.append(1) or hsv(x))
    assert pages._colors("p", disc((0, 0, 220))) == [("p", c, 0, 126, 126, 175, 175, pytest.approx(0.9), False) for c in ("red", "orange")]
    assert len(calls) == 1


def test_components_and_hull_of_odd_masks():
    for mask in (np.zeros((0, 0), bool), np.zeros((3, 4), bool), np.ones((1, 1), bool), np.ones((3, 1), bool)):
        assert images.components(mask).tolist() == mask.astype(int).tolist()
    # neighbours by a corner are one part, the ends of neighbouring rows are not
    assert images.components(np.array([[0, 0, 1], [1, 0, 0], [0, 1, 0]], bool)).tolist() == [[0, 0, 1], [2, 0, 0], [0, 2, 0]]
    assert images.hull(np.array([0, 2, 2, 0, 1, 1]), np.array([0, 0, 2, 2, 1, 2])) == [(0, 0), (2, 0), (2, 2), (0, 2)]
