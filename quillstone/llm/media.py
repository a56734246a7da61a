"""Media columns: lossless 8-bit images in archives, read by a data source that plans byte ranges."""

from __future__ import annotations

import hashlib
import json
import struct
import time
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .storage import cut, fresh_path, table

WIDTH = 64
PNG = b"\x89PNG\r\n\x1a\n"
ARCHIVE_BYTES, RANGE_BYTES, BATCH_BYTES, RETRIES = 64 << 20, 16 << 20, 4 << 20, 4
_ENTRY = np.dtype([("offset", "<u8"), ("length", "<u4"), ("crc", "<u4"), ("id", "<i8"), ("null", "u1")])
_TAIL = struct.Struct("<QQ8s")
_MAGIC = b"QSARCH01"


def padded(text: bytes) -> bytes:
    """text and zero bytes up to a positive multiple of WIDTH."""
    return text + b"\0" * (max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes, note: int) -> bytes:
    """An 8-bit grey image of WIDTH columns whose samples are the payload; note is kept as text under n_bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return PNG + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0" + str(note).encode()) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 2)) + _chunk(b"IEND", b"")


def decode_png(media: bytes) -> tuple[bytes, int]:
    """(payload, note); raises ValueError for anything that encode_png does not write."""
    if media[:8] != PNG:
        raise ValueError("no PNG signature")
    at, data, size, note = 8, [], (0, 0), 0
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, body = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if struct.unpack_from(">I", media, at + 8 + n)[0] != zlib.crc32(kind + body):
            raise ValueError(f"chunk {kind!r} is damaged")
        if kind == b"IHDR":
            size = struct.unpack(">II", body[:8])
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            note = int(body[8:])
        at += 12 + n
    raw = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(size[1], size[0] + 1)
    if raw[:, 0].any():
        raise ValueError("filtered rows")
    return raw[:, 1:].tobytes(), note


def _open(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url or url.startswith("file:/") else (fs.LocalFileSystem(), url)


class _Archive:
    """Members one after another, then their directory, then its place."""

    def __init__(self, folder: str) -> None:
        self.url = f"{folder}/{uuid.uuid4().hex}.qsa"
        system, path = _open(self.url)
        system.create_dir(path.rpartition("/")[0], recursive=True)
        self.out, self.size, self.entries = system.open_output_stream(path), 0, []

    def add(self, doc_id: int | None, media: bytes) -> None:
        self.entries.append((self.size, len(media), zlib.crc32(media), doc_id or 0, doc_id is None))
        self.out.write(media)
        self.size += len(media)

    def close(self) -> tuple[str, int, int]:
        directory = np.array(self.entries, _ENTRY).tobytes()
        self.out.write(directory + _TAIL.pack(self.size, len(self.entries), _MAGIC))
        self.out.close()
        return self.url, self.size, len(self.entries)


def _archive(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, now = [], None
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                raw = (text.as_py() or "").encode()
                now = now or _Archive(folder)
                now.add(doc_id.as_py(), encode_png(padded(raw), len(raw)))
                if now.size >= ARCHIVE_BYTES:
                    done.append(now.close())
                    now = None
        if now:
            done.append(now.close())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done, strict=True) if done else ([], [], []), (pa.string(), pa.int64(), pa.int64()), strict=True)], names=["url", "body_bytes", "members"])

    return run


@dataclass
class Range(InputPartition):
    """Members of an archive whose first byte lies in [start, end)."""

    url: str
    start: int
    end: int

    def __init__(self, url: str, start: int, end: int) -> None:
        super().__init__((url, start, end))
        self.url, self.start, self.end = url, start, end


def retried(read, attempts: int = RETRIES, pause: float = 0.2):
    """read(), again after a growing pause for as long as it raises OSError or ValueError and attempts are left."""
    for k in range(attempts):
        try:
            return read()
        except (OSError, ValueError):
            if k + 1 == attempts:
                raise
            time.sleep(pause * 2**k)


class ArchiveReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.range_bytes = options["path"], int(options.get("rangebytes", RANGE_BYTES))

    def partitions(self) -> list[InputPartition]:
        system, path = _open(f"{self.path}/_archives.json")
        with system.open_input_stream(path) as f:
            found = json.loads(f.read())
        return [Range(url, at, min(at + self.range_bytes, size)) for url, size, _ in found for at in range(0, size, self.range_bytes)] or [Range("", 0, 0)]

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        if not partition.url:
            return
        system, path = _open(partition.url)

        def part(start: int, length: int) -> bytes:
            with system.open_input_file(path) as f:
                f.seek(start)
                return f.read(length)

        def directory() -> np.ndarray:
            total = system.get_file_info(path).size
            place, n, magic = _TAIL.unpack(part(total - _TAIL.size, _TAIL.size))
            if magic != _MAGIC:
                raise ValueError(f"{partition.url} is no archive")
            return np.frombuffer(part(place, n * _ENTRY.itemsize), _ENTRY)

        entries = retried(directory)
        entries = entries[(entries["offset"] >= partition.start) & (entries["offset"] < partition.end)]

        def member(e: np.void, block: bytes, base: int) -> bytes:
            media = block[int(e["offset"]) - base :][: int(e["length"])]

            def again() -> bytes:
                got = part(int(e["offset"]), int(e["length"]))
                if zlib.crc32(got) != e["crc"]:
                    raise ValueError(f"member at {e['offset']} of {partition.url} is damaged")
                return got

            return media if zlib.crc32(media) == e["crc"] else retried(again)

        at = 0
        while at < len(entries):
            base = int(entries["offset"][at])
            end = max(at + 1, int(np.searchsorted(entries["offset"], base + BATCH_BYTES)))
            some = entries[at:end]
            try:
                block = part(base, int(some["offset"][-1]) + int(some["length"][-1]) - base)
            except OSError:
                block = b""
            media = [member(e, block, base) for e in some]
            yield pa.RecordBatch.from_arrays([pa.array(some["id"], pa.int64(), mask=some["null"].astype(bool)), pa.array(media, pa.binary())], names=["doc_id", "media"])
            at = end


class ArchiveSource(DataSource):
    """spark.read.format("media_archive").load(folder): doc_id and media of every member of a folder's archives."""

    @classmethod
    def name(cls) -> str:
        return "media_archive"

    def schema(self) -> str:
        return "doc_id long, media binary"

    def reader(self, schema) -> ArchiveReader:
        return ArchiveReader(self.options)


def write_archives(docs: DataFrame) -> str:
    """Stores each row's text as an image in archives and returns their folder.

    docs needs doc_id and text; other columns are ignored. Null text is empty; null or repeated doc_ids and
    repeated rows are members each; no rows make a folder without archives. A task that is run again writes
    archives of its own, and only those of the attempt whose rows count are listed. The driver sees one row
    for each archive of ARCHIVE_BYTES.
    """
    spark = docs.sparkSession
    folder = fresh_path(spark, "archives")
    made = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_archive(folder), "url string, body_bytes long, members long"), "archive-list")
    listed = [(r.url, r.body_bytes, r.members) for r in made.orderBy("url").collect()]
    system, path = _open(folder)
    system.create_dir(path, recursive=True)
    with system.open_output_stream(f"{path}/_archives.json") as f:
        f.write(json.dumps(listed).encode())
    return folder


def read_archives(spark: SparkSession, folder: str) -> DataFrame:
    spark.dataSource.register(ArchiveSource)
    return spark.read.format("media_archive").load(folder)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
    for batch in batches:
        out = []
        for doc_id, item in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            media = item.as_py()
            payload, n = decode_png(media)
            x = np.frombuffer(payload, np.uint8)
            bins = ",".join(map(str, np.bincount(x >> 5, minlength=8)))
            feature = f"{WIDTH}x{len(x) // WIDTH};sum={int(x.sum(dtype=np.int64))};max={int(x.max())};nonzero={int(np.count_nonzero(x))};bins={bins}"
            out.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)], names=_FEATURE_NAMES)


_FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
_FEATURE_NAMES = [x.split()[0] for x in _FEATURES.split(", ")]


def media_features(media: DataFrame) -> DataFrame:
    """Decodes doc_id, media rows and describes the samples: size, sum, maximum, non-zero count and an 8-bin histogram."""
    return media.select("doc_id", "media").mapInArrow(_features, _FEATURES)


def op8_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_features(read_archives(spark, write_archives(table(spark, sf_dir, "documents"))))
