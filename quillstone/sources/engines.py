"""Recognition engines as providers: image rows in, block rows out. Models are the caller's; a mock is built in."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import strip

BLOCKS = "doc_id string, page_number int, pos long, engine string, text string, x1 long, y1 long, x2 long, y2 long, confidence double"
Provider = Callable[[bytes | None], list[tuple[str, tuple[int, int, int, int], float]]]
#: Which engines a choice stands for: (engine, languages it reads).
CHOICES = {"easyocr": ["easyocr"], "tesseract": ["tesseract"], "both": ["tesseract", "easyocr"], "trocr+easyocr": ["trocr", "easyocr"]}


def resolve(choice: str, languages: list[str]) -> list[str]:
    """Engines of a choice; trocr reads English only, and an unknown choice means trocr beside easyocr for other languages."""
    engines = CHOICES.get(choice, ["trocr", "easyocr"])
    if choice == "trocr+easyocr":
        return [e for e in engines if (e == "trocr") == ("eng" in languages) or (e == "easyocr" and any(x != "eng" for x in languages))]
    if choice not in CHOICES:
        return ["trocr"] + (["easyocr"] if any(x != "eng" for x in languages) else [])
    return engines


def mock(_image: bytes | None) -> list[tuple[str, tuple[int, int, int, int], float]]:
    """Four blocks, the same for each image."""
    # Fixed values.
    return [("Dealer ABC Tractors", (50, 50, 260, 75), 0.96), ("HP 50", (50, 120, 120, 145), 0.98), ("Cost 150000", (50, 170, 200, 195), 0.97), ("Model X1", (50, 220, 150, 245), 0.95)]


def by_lines(read: Callable[[bytes], tuple[str, float]], lines: Callable[[bytes], list[tuple[tuple[int, int, int, int], bytes]]]) -> Provider:
    """A provider for engines that read one line image at a time; a line that fails is left out."""
    def provider(image: bytes | None) -> list[tuple[str, tuple[int, int, int, int], float]]:
        out = []
        for box, part in lines(image) if image is not None else []:
            try:
                text, conf = read(part)
            except Exception:  # a line's failure costs this line only
                continue
            out.append((text, box, conf))
        return out

    return provider


def recognise(pages: DataFrame, providers: dict[str, Provider], tag: bool = False) -> DataFrame:
    """Blocks of every page (doc_id, page_number, data) by every engine; a page on which an engine fails has none of it. tag puts the engine before the text."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for page in frame.itertuples():
                pos = 0
                for name, read in providers.items():
                    try:
                        found = read(page.data) if page.data is not None else []
                    except Exception:  # an engine's failure costs its blocks only
                        found = []
                    for text, box, conf in found:
                        out.append((page.doc_id, page.page_number, pos, name, f"[{name}] {text}" if tag else text, *box, conf))
                        pos += 1
            yield pd.DataFrame(out, columns=[c.split()[0] for c in BLOCKS.split(", ")])

    return pages.select("doc_id", "page_number", "data").mapInPandas(run, BLOCKS).filter(strip(F.col("text")) != "")
