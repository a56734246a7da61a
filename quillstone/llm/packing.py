"""Harmonic packing of token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .kernels import Rolling, chunks
from .storage import cut, table

CAPACITY = 4096
END_ID = 2
#: A piece may stay whole if it leaves at most this part of its slot empty; else it is cut to the next smaller slot.
SLACK = 128
#: Odd words, and pieces of words, whose ids a task keeps; they go with the task. A piece costs more to find again.
CACHED_WORDS, CACHED_PIECES = 200_000, 500_000
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, slots int, part int, k long"
_kept: dict[str, bytes] = {}
_tokenizers: dict[str, Tokenizer] = {}
#: What each tokenizer knows besides its vocabulary; words that hold it go through the tokenizer as they are.
_added: dict[str, regex.Pattern] = {}


def slots_of(length: int, capacity: int = CAPACITY) -> int:
    """The harmonic class: how many pieces of this length a sequence holds, as many as of any length in the class."""
    return capacity // length


def pieces_of(tokens: int, capacity: int = CAPACITY, slack: int = SLACK) -> list[int]:
    """Lengths of the pieces a document is cut into: full sequences, then largest reciprocal slots, until the rest nearly fills one."""
    out = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left:
        slot = capacity // (capacity // left)
        if slot - left <= slot // slack:
            out.append(left)
            break
        smaller = capacity // (capacity // left + 1)
        out.append(smaller)
        left -= smaller
    return out


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else the next from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in shown)}


_LETTERS = _byte_letters()
#: Fixed value: the pattern that the vocabulary's own file splits text by.
_SPLIT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
_ODD_SPACE = regex.compile(r"[^\S\n]|[\x1c-\x1f]")


#: Code units up to here are characters that no other one composes with; what they are and their small letter is read from tables.
PLAIN = 0x300
SPACE, LETTER, NUMBER, OTHER, ODD = range(5)


def _kinds() -> tuple[np.ndarray, np.ndarray]:
    """For each plain unit and, in the last place, any other: its kind, and its small letter. White space besides that between words is odd, as is a letter with two small ones."""
    kind, small = np.full(PLAIN + 1, ODD, np.uint8), np.arange(PLAIN + 1, dtype=np.uint16)
    for c in range(PLAIN):
        x = chr(c)
        if regex.fullmatch(r"[\x20\x09-\x0D]", x):
            kind[c] = SPACE
        elif not _ODD_SPACE.match(x) and len(x.lower()) == 1:
            kind[c] = LETTER if regex.match(r"\p{L}", x) else NUMBER if regex.match(r"\p{N}", x) else OTHER
            small[c] = ord(x.lower())
    return kind, small


_KIND, _SMALL = _kinds()
_LETTER_OF = np.array([ord(_LETTERS[b]) if b != 10 else 10 for b in range(256)], "<u2")
_RNG = np.random.default_rng(20261128)
#: Values of units in hashes: of plain pieces by small letters, of odd words as they are.
_RAW = _RNG.integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_FOLDED = (_RNG.integers(0, 2**63, 1 << 16, dtype=np.uint64) * np.uint64(2) + np.uint64(1))[_SMALL]


class Known:
    """Ids by hash: open addressing in numpy, so that all pieces of a batch are looked up at once."""

    def __init__(self, bits: int = 16) -> None:
        self.n, self.words, self.used, self.ids = 0, 0, 0, np.zeros(1 << bits, "<u4")
        self._slots(bits)

    def _slots(self, bits: int) -> None:
        self.key, self.at, self.width = np.zeros(1 << bits, np.uint64), np.zeros(1 << bits, np.int64), np.zeros(1 << bits, np.int64)

    def find(self, h: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 if it is not known."""
        mask = len(self.key) - 1
        slot = (h & np.uint64(mask)).astype(np.int64)
        left = np.flatnonzero(self.key[slot] != h)
        while len(left):
            there = self.key[slot[left]]
            slot[left[there == 0]] = -1
            left = left[(there != 0) & (there != h[left])]
            slot[left] = (slot[left] + 1) & mask
        return slot

    def add(self, h: np.ndarray, ids: np.ndarray, width: np.ndarray) -> None:
        """New hashes, each once, and their ids one after another."""
        at = self.used + np.cumsum(width) - width
        if self.used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids[: self.used], np.zeros(max(len(ids), self.used), "<u4")])
        self.ids[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        self.n += len(h)
        if 2 * self.n > len(self.key):
            full = self.key != 0
            h, at, width = (np.concatenate([a, b]) for a, b in ((self.key[full], h), (self.at[full], at), (self.width[full], width)))
            self._slots((2 * self.n).bit_length())
        mask = len(self.key) - 1
        slot, left = (h & np.uint64(mask)).astype(np.int64), np.arange(len(h))
        while len(left):
            free = left[self.key[slot[left]] == 0]
            self.key[slot[free]] = h[free]
            left = left[self.key[slot[left]] != h[left]]
            slot[left] = (slot[left] + 1) & mask
        self.at[slot], self.width[slot] = at, width


_known = Known()


def _ranges(start: np.ndarray, width: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, one after another."""
    ends = np.cumsum(width)
    return np.repeat(start - ends + width, width) + np.arange(ends[-1] if len(ends) else 0)


def _encode(words: list[bytes], tokenizer: Tokenizer, added: regex.Pattern) -> list[bytes]:
    """Ids of each odd word. The words are normalised together and looked up piece by piece; the pieces' ids are kept.
    A batch that holds other white space than the words' own ends goes through the tokenizer as it is."""
    joined = b"\n".join(words).decode("utf-8", "replace")
    if added.search(joined):
        texts = [w.decode("utf-8", "replace") for w in words]
        odd = [bool(added.search(x)) for x in texts]
        plain = iter(_encode([w for w, o in zip(words, odd, strict=True) if not o], tokenizer, added))
        return [np.array(tokenizer.encode(x, add_special_tokens=False).ids, "<u4").tobytes() if o else next(plain) for x, o in zip(texts, odd, strict=True)]
    parts = tokenizer.normalizer.normalize_str(joined).split(" ") if words and not _ODD_SPACE.search(joined) else []
    if len(parts) != len(words):
        return [np.array(e.ids, "<u4").tobytes() for e in tokenizer.encode_batch([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]
    model, out = tokenizer.model, []
    if len(_kept) > CACHED_PIECES:
        _kept.clear()
    for part in parts:
        # a piece by itself is one piece
        if (got := _kept.get(part)) is not None:
            out.append(got)
            continue
        ids = b""
        for piece in _SPLIT.findall(part):
            if (got := _kept.get(piece)) is None:
                got = _kept[piece] = np.array([t.id for t in model.tokenize(piece.encode().decode("latin-1").translate(_LETTERS))], "<u4").tobytes()
            ids += got
        out.append(ids)
    return out


def _units(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The text as UTF-16 code units (bytes, if all are ASCII), the rows' offsets in them, and the bytes and offsets they are from: invalid ones are replaced."""
    if not len(data) or data.max() < 128:
        return data, offsets, data, offsets
    starts = offsets[:-1][np.diff(offsets) > 0]
    try:
        if (data[starts] & 0xC0 == 0x80).any():
            raise ValueError
        text = data.tobytes().decode()
    except ValueError:
        raw = data.tobytes()
        rows = [raw[a:b].decode("utf-8", "replace").encode() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        data, offsets = np.frombuffer(b"".join(rows), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        text = data.tobytes().decode()
    per_byte = (data & 0xC0 != 0x80).astype(np.uint8)
    per_byte += data >= 0xF0
    return np.frombuffer(text.encode("utf-16-le"), "<u2"), np.concatenate([[0], np.cumsum(per_byte, dtype=np.int64)])[offsets], data, offsets


def _splits(plain: np.ndarray, kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the pieces that _SPLIT finds; first: a row starts at the unit."""
    solid = kind != SPACE
    begin = solid.copy()
    begin[1:] &= (kind[1:] != kind[:-1]) | (kind[1:] == NUMBER) | first[1:]
    quote = np.flatnonzero(begin & (plain == 39))
    if len(quote):
        # an apostrophe that starts a piece takes some letters along; units beyond its row's end are no letters of it
        padded = np.concatenate([plain, np.zeros(2, plain.dtype)])
        one, two = (np.where(np.concatenate([first, np.ones(2, bool)])[quote + k], 0, _SMALL[padded[quote + k]]) for k in (1, 2))
        two = np.where(one == 0, 0, two)
        width = np.where(np.isin(one, [ord(c) for c in "stmd"]), 1, 0)
        for x, y in ("re", "ve", "ll"):
            width[(one == ord(x)) & (two == ord(y))] = 2
        quote, width = quote[width > 0], width[width > 0]
        begin[quote + 1] = False
        after = (quote + 1 + width)[quote + 1 + width < len(plain)]
        begin[after] = solid[after]
    last = solid
    last[:-1] &= ~solid[1:] | begin[1:]
    return np.flatnonzero(begin), np.flatnonzero(last) + 1


def _new_pieces(units: np.ndarray, start: np.ndarray, width: np.ndarray, tokenizer: Tokenizer) -> tuple[np.ndarray, np.ndarray]:
    """Ids of plain pieces, one after another, and how many each has."""
    ends = np.cumsum(width + 1)
    low = np.full(ends[-1], 10, "<u2")
    inside = np.ones(ends[-1], bool)
    inside[ends - 1] = False
    low[inside] = _SMALL[units[_ranges(start, width)]]
    raw = np.frombuffer(low[:-1].tobytes().decode("utf-16-le").encode(), np.uint8)
    tokenize = tokenizer.model.tokenize
    ids = [[t.id for t in tokenize(piece)] for piece in _LETTER_OF[raw].tobytes().decode("utf-16-le").split("\n")]
    count = np.fromiter(map(len, ids), np.int64, len(ids))
    return np.fromiter(chain.from_iterable(ids), "<u4", count.sum()), count


def token_ids(data: np.ndarray, offsets: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows, each ended by END_ID, and the rows' offsets. The tokenizer drops white space and never joins
    what it separates, nor the pieces it splits words into, so distinct pieces are encoded once and kept by hash, for
    as long as the task has room. Words with characters that are not plain, or with what the tokenizer knows besides
    its vocabulary, are odd: they are encoded as words."""
    global _known
    if path not in _tokenizers:
        _tokenizers[path] = Tokenizer.from_file(path)
        _added[path] = regex.compile("|".join(regex.escape(t.content) for t in _tokenizers[path].get_added_tokens_decoder().values()) or r"(?!)", regex.IGNORECASE)
        _known = Known()
        _kept.clear()
    tokenizer, added = _tokenizers[path], _added[path]
    if _known.n > CACHED_PIECES or _known.words > CACHED_WORDS:
        _known = Known()
    units, at, data, offsets = _units(data, offsets)
    plain = np.minimum(units, np.uint16(PLAIN))
    kind = _KIND[plain]
    first = np.zeros(len(units), bool)
    first[at[:-1][at[:-1] < len(units)]] = True
    raw = data.tobytes().lower()
    for token in tokenizer.get_added_tokens_decoder().values():
        found, content = -1, token.content.encode().lower()
        if not content.isascii():
            kind[kind != SPACE] = ODD
            continue
        while content and (found := raw.find(content, found + 1)) >= 0:
            # all words of the row
            row = int(np.searchsorted(offsets, found, "right")) - 1
            part = kind[at[row] : at[row + 1]]
            part[part != SPACE] = ODD
            found = int(offsets[row + 1]) - 1
    words = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(units) and kind.max() == ODD:
        solid = kind != SPACE
        begin, last = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | first[1:]
        last[:-1] &= ~solid[1:] | first[1:]
        begin, last = np.flatnonzero(begin), np.flatnonzero(last) + 1
        odd = np.logical_or.reduceat(kind == ODD, begin)
        words = begin[odd], last[odd]
        kind[_ranges(words[0], words[1] - words[0])] = SPACE
    start, end = _splits(plain, kind, first)
    h = Rolling(plain, _FOLDED).of(start, end)
    odd = np.zeros(len(start), bool)
    if len(words[0]):
        width = words[1] - words[0]
        ends = np.cumsum(width)
        order = np.argsort(np.concatenate([start, words[0]]), kind="stable")
        h = np.concatenate([h, ~Rolling(units[_ranges(words[0], width)], _RAW).of(ends - width, ends)])[order]
        odd = np.concatenate([odd, np.ones(len(width), bool)])[order]
        start, end = np.concatenate([start, words[0]])[order], np.concatenate([end, words[1]])[order]
    h |= h == 0
    slot = _known.find(h)
    if len(missing := np.flatnonzero(slot < 0)):
        _, where = np.unique(h[missing], return_index=True)
        new = missing[where]
        pieces, rest = new[~odd[new]], new[odd[new]]
        if len(pieces):
            _known.add(h[pieces], *_new_pieces(units, start[pieces], end[pieces] - start[pieces], tokenizer))
        if len(rest):
            got = _encode([units[a:b].astype("<u2").tobytes().decode("utf-16-le").encode() for a, b in zip(start[rest].tolist(), end[rest].tolist(), strict=True)], tokenizer, added)
            _known.add(h[rest], np.frombuffer(b"".join(got), "<u4"), np.fromiter(map(len, got), np.int64, len(got)) // 4)
            _known.words += len(rest)
        slot = _known.find(h)
    each = _known.width[slot]
    before = np.concatenate([[0], np.cumsum(each)])
    rows = np.concatenate([[0], np.cumsum(np.diff(before[np.searchsorted(start, at)]) + 1)])
    out = np.full(rows[-1], END_ID, "<u4")
    into = np.ones(rows[-1], bool)
    into[rows[1:] - 1] = False
    out[into] = _known.ids[_ranges(_known.at[slot], each)]
    return out, rows


def _forget() -> None:
    global _known
    _known = Known()
    _kept.clear()


def _cut_documents(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, counts = TaskContext.get().partitionId(), {}
        try:
            for batch in batches:
                doc_ids = batch.column(0).to_pylist()
                for lo, hi, data, offsets in chunks(batch.column(1)):
                    ids, rows = token_ids(data, offsets, path)
                    out = []
                    for i in range(hi - lo):
                        at, total = int(rows[i]), int(rows[i + 1] - rows[i])
                        start = 0
                        for n in pieces_of(total, capacity):
                            cls = slots_of(n, capacity)
                            out.append((doc_ids[lo + i], start, n, zlib.crc32(ids[at + start : at + start + n]), total, cls, part, counts.get(cls, 0)))
                            counts[cls] = counts.get(cls, 0) + 1
                            start += n
                    kinds = (pa.int64(),) * 5 + (pa.int32(),) * 2 + (pa.int64(),)
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names=[f.split()[0] for f in _PIECES.split(", ")])
        finally:
            _forget()

    return run


def _first_fit(capacity: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        room: list[int] = []
        rows = rows.sort_values(["length", "doc_id", "start"], ascending=[False, True, True])
        seq, off = [], []
        for n in rows["length"]:
            b = next((i for i, r in enumerate(room) if r >= n), len(room))
            if b == len(room):
                room.append(capacity)
            seq.append(((capacity + 1) << 40) + b)
            off.append(capacity - room[b])
            room[b] -= n
        return rows.assign(sequence_id=seq, offset=off)[["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]]

    return run


def pack(docs: DataFrame, tokenizer: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A piece of class slots = capacity // length goes into the sequence number k // slots of its class, where k is
    its place among the class's pieces; places are dealt by each task for itself and shifted by the counts of the
    tasks before, so full sequences need no search. The pieces that would end in a part-full sequence, fewer
    than slots a class and so bounded whatever the input, share sequences by first fit. Null and empty texts are
    a single END_ID. A repeated or null doc_id is packed like any other row; other columns are ignored.
    """
    path = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    pieces = cut(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_cut_documents(path, capacity), _PIECES), "pieces")
    counts = pieces.groupBy("slots", "part").agg((F.max("k") + 1).alias("c"))
    whole = Window.partitionBy("slots")
    counts = counts.select("slots", "part", (F.sum("c").over(whole.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("c")).alias("base"), F.sum("c").over(whole).alias("n"))
    placed = pieces.join(counts, ["slots", "part"]).withColumn("g", F.col("base") + F.col("k"))
    full = F.col("g") < F.col("n") - F.col("n") % F.col("slots")
    out = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    bins = placed.filter(full).withColumn("bin", F.floor(F.col("g") / F.col("slots")))
    before = Window.partitionBy("slots", "bin").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    bins = bins.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("long"))).withColumn("sequence_id", F.shiftleft(F.col("slots").cast("long"), 40) + F.col("bin"))
    rest = placed.filter(~full).select(*out[:5], F.lit(0).alias("one")).groupBy("one").applyInPandas(_first_fit(capacity), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
    return bins.select(out).union(rest.select(out))


def op7_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))
