"""Fuzzy line deduplication: keys of least piece hashes, edit similarity, one occurrence of each connected group.

Edit similarity alone decides a link; keys and sketches only find the pairs to look at, and can miss some. A line
has up to two kinds of pieces: pairs of neighbouring words if it has WORDY words, three-character windows if it is
short, else GRAM-byte windows. SimHash blocks were tried first; README says why they lose most links at 0.8.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from difflib import SequenceMatcher
from os.path import commonprefix

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .edits import Texts
from .kernels import U, Rolling, chunks, mix, word_bounds
from .links import block_pairs, linked_pairs, spanning_many
from .storage import cut, table

#: Lines of fewer words stay as they are. Linked lines have an edit similarity of at least SIMILARITY.
LEAST_WORDS, SIMILARITY = 1, 0.8
#: Kinds of pieces: word pairs from WORDY words on, three characters up to SHORT characters, GRAM bytes from LONG characters on for lines of up to WORDY + 1 words.
WORDY, LONG, SHORT, GRAM = 7, 32, 40, 6
PAIRS, THREES, GRAMS = 0, 1, 2
#: A key is made of OF least piece hashes; each line has KEYS keys of a kind.
KEYS, OF = 19, 3
#: Least hashes of a line; a bit of each makes its sketch. Lines that share a key are candidates if their sketches are at most RADIUS bits apart, SHORT_RADIUS for three characters.
LEVEL_BITS = 6
FUNCTIONS, RADIUS, SHORT_RADIUS = 64 - LEVEL_BITS, 22, 20
#: Pairs of lines of up to so many characters are compared together.
BATCHED = 2048
#: Words that are aligned to bound a distance; longer stretches go to the exact distance at once, which takes less then.
ALIGNED = 200
#: Records (key, sketch), or characters of lines in parts, that a task holds. Keys and sketches of more than HOT are compared with their texts at hand, leaders first.
HELD, HOT = 1 << 18, 32
_RNG = np.random.default_rng(1105)
_XOR = _RNG.integers(0, 2**32, FUNCTIONS, dtype=np.uint32)
_MUL = _RNG.integers(0, 2**32, FUNCTIONS, dtype=np.uint32) | np.uint32(1)
_ROUND = _RNG.integers(0, 2**63, 3, dtype=U) * U(2) + U(1)
_ONE = U(1)
# ASCII letters in lower case, digits and bytes beyond ASCII stay; all else is a space, so words carry no marks.
_NORMAL = np.full(256, 32, np.uint8)
_NORMAL[48:58] = np.arange(48, 58)
_NORMAL[97:123] = _NORMAL[65:91] = np.arange(97, 123)
_NORMAL[128:] = np.arange(128, 256)


def _segment_sum(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    sums = np.concatenate([np.zeros(1, values.dtype), np.cumsum(values)])
    return sums[at[1:]] - sums[at[:-1]]


def _spread(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions at[k], at[k] + 1, ... of size[k] each, one after another."""
    ends = np.cumsum(size)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(at - ends + size, size)


def _least(pieces: np.ndarray, size: np.ndarray, functions: int) -> np.ndarray:
    """The least hash of each run of pieces under so many functions; runs are not empty."""
    at = np.cumsum(size) - size
    out = np.zeros((len(size), functions), np.uint32)
    for k in range(functions if len(size) else 0):
        out[:, k] = np.minimum.reduceat((pieces ^ _XOR[k]) * _MUL[k], at)
    return out


def _long(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    pieces = (Rolling(text).windows(GRAM) >> U(32)).astype(np.uint32)
    return _least(pieces[_spread(at, size - GRAM + 1)], size - GRAM + 1, FUNCTIONS)


def _short(text: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Three-character windows, with two blanks on either side. Texts that are not UTF-8 go by bytes."""
    padded = np.zeros(int(size.sum()) + 4 * len(size), np.uint8)
    ends = np.cumsum(size + 4)
    padded[_spread(ends - size - 2, size)] = text[_spread(at, size)]
    code = np.frombuffer(padded.tobytes().decode("utf-8", "surrogateescape").encode("utf-32-le", "surrogatepass"), np.uint32).astype(U)
    count = np.add.reduceat((padded & 0xC0) != 0x80, ends - size - 4) if len(size) else size
    if count.sum() != len(code):
        code, count = padded.astype(U), size + 4
    first = np.cumsum(count) - count
    pieces = mix(mix(code[:-2] * U(0x9E3779B97F4A7C15) + code[1:-1]) + code[2:] * U(0xC4CEB9FE1A85EC53)) >> U(32)
    return _least(pieces.astype(np.uint32)[_spread(first, count - 2)], count - 2, FUNCTIONS)


class Lines:
    """The lines of a chunk of rows: row, place in it, words, and id, a 64-bit hash of the normalised words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        breaks = np.flatnonzero(data == 10)
        # a break at a row's end starts a last, empty line of that row, not of the next
        row = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, breaks, "right") - 1])
        self.row = row[np.argsort(row, kind="stable")]
        self.place = np.arange(len(row)) - np.searchsorted(self.row, self.row, "left")
        self.plain = _NORMAL[data]
        self.start, self.end = word_bounds(self.plain, offsets)
        self.word = Rolling(self.plain).of(self.start, self.end)
        line = np.searchsorted(breaks, self.start, "left") + np.searchsorted(offsets, self.start, "right") - 1
        self.words = np.bincount(line, minlength=len(row))
        self.at = np.concatenate([[0], np.cumsum(self.words)])
        spread = np.arange(len(self.word)) - self.at[line]
        self.id = mix(_segment_sum(self.word * (mix(spread.astype(U) + _ONE) | _ONE), self.at) + self.words.astype(U))

    def sizes(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, characters) of these normalised lines, none of them without words."""
        size = _segment_sum(self.end - self.start, self.at)[lines] + self.words[lines] - 1
        inner = np.concatenate([[0], np.cumsum((self.plain & 0xC0) == 0x80)])
        return size, size - inner[self.end[self.at[lines + 1] - 1]] + inner[self.start[self.at[lines]]]

    def texts(self, lines: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(normalised text, where each of these lines starts); one space after each word."""
        words = _spread(self.at[lines], self.words[lines])
        size = self.end[words] - self.start[words]
        edge = np.concatenate([[0], np.cumsum(size + 1)])
        text = np.full(edge[-1], 32, np.uint8)
        text[_spread(edge[:-1], size)] = self.plain[_spread(self.start[words], size)]
        return text, edge[np.cumsum(self.words[lines]) - self.words[lines]]


def _sketch(least: np.ndarray, chars: np.ndarray) -> np.ndarray:
    """A bit of each least hash, and in the last LEVEL_BITS bits the length in steps of an eighth, so that lengths four fifths apart are two steps apart."""
    level = np.clip(np.log(np.maximum(chars, 1) / 4) / np.log(1.125), 0, (1 << LEVEL_BITS) - 1).astype(U)
    bits = np.zeros((len(least), 64), np.uint8)
    bits[:, : least.shape[1]] = least >> np.uint32(4) & np.uint32(1)
    return np.packbits(bits, axis=1).view(">u8").astype(U).ravel() | level


def apart(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Bits in which sketches differ; all of them if their lengths rule a link out."""
    last = U((1 << LEVEL_BITS) - 1)
    steps = np.abs((x & last).astype(np.int64) - (y & last).astype(np.int64))
    return np.where(steps <= 2, np.bitwise_count((x ^ y) >> U(LEVEL_BITS)).astype(np.int64), 64)


def _keys(least: np.ndarray, kind: int) -> np.ndarray:
    parts = least[:, : KEYS * OF].reshape(len(least), KEYS, OF).astype(U)
    total = (np.arange(KEYS, dtype=U) + U(1)) * U(0x9E3779B97F4A7C15) + (parts * _ROUND).sum(2, dtype=U)
    return (mix(total) >> U(32) & ~U(3) | U(kind)).astype(np.uint32).ravel()


def signed(lines: Lines, some: np.ndarray) -> tuple[np.ndarray, ...]:
    """(first sketch, second sketch or the first again, keys, their sketches) of these lines, none without words."""
    words = lines.words[some]
    size, chars = lines.sizes(some)
    pairs, threes = np.flatnonzero(words >= WORDY), np.flatnonzero(chars <= SHORT)
    grams = np.flatnonzero((chars >= LONG) & (words <= WORDY + 1) & ((words < WORDY) | (chars > SHORT)))
    at = _spread(lines.at[some[pairs]], words[pairs] - 1)
    pieces = (mix(lines.word[at] * _ROUND[0] + lines.word[at + 1] * _ROUND[1]) >> U(32)).astype(np.uint32)
    least = {PAIRS: (pairs, _least(pieces, words[pairs] - 1, FUNCTIONS))}
    for kind, who, of in ((THREES, threes, _short), (GRAMS, grams, _long)):
        text, start = lines.texts(some[who])
        least[kind] = who, of(text, start, size[who])
    first, second = np.zeros(len(some), U), np.zeros(len(some), U)
    keys, sketches = [], []
    for kind, (who, hashes) in least.items():
        x = _sketch(hashes, chars[who])
        second[who] = np.where(first[who] == 0, x, first[who])
        first[who] = x
        keys.append(_keys(hashes, kind))
        sketches.append(np.repeat(x, KEYS))
    return first, second, np.concatenate(keys), np.concatenate(sketches)


def _reach(key: np.ndarray) -> np.ndarray:
    return np.where(key & 3 == THREES, SHORT_RADIUS, RADIUS)


def bucket_ties(key: np.ndarray, sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of distinct sorted records. In every round the first record left of each key leads it and takes the near ones as ties; never more ties than records."""
    u, v = [np.zeros(0, U)], [np.zeros(0, U)]
    while len(key):
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        size = np.diff(np.concatenate([first, [len(key)]]))
        more = np.repeat(size > 1, size)
        more[first] = False
        lead = np.repeat(sig[first], size)[more]
        key, sig = key[more], sig[more]
        near = apart(lead, sig) <= _reach(key)
        u.append(lead[near])
        v.append(sig[near])
        key, sig = key[~near], sig[~near]
    return np.concatenate(u), np.concatenate(v)


def bucket_pairs(key: np.ndarray, sig: np.ndarray, hot: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(u, v, keys, members): all near sketches of keys with up to hot of them; of the other keys ties, and all that they have."""
    order = np.lexsort((sig, key))
    key, sig = key[order], sig[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (sig[1:] != sig[:-1])
    key, sig = key[new], sig[new]
    size = np.diff(np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]])))
    few, many = np.repeat((size > 1) & (size <= hot), size), np.repeat(size > hot, size)
    i, j = block_pairs([0, *np.cumsum(size[(size > 1) & (size <= hot)]).tolist()])
    k, x = key[few], sig[few]
    near = apart(x[i], x[j]) <= _reach(k[i])
    u, v = bucket_ties(key[many], sig[many])
    u, v = np.concatenate([x[i[near]], u]), np.concatenate([x[j[near]], v])
    return *_distinct(np.minimum(u, v), np.maximum(u, v)), key[many], sig[many]


def _distinct(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((v, u))
    u, v = u[order], v[order]
    new = np.ones(len(u), bool)
    new[1:] = (u[1:] != u[:-1]) | (v[1:] != v[:-1])
    return u[new].view(np.int64), v[new].view(np.int64)


_LINES = "doc_id long, h long, place long, id long, sig long, other long, part int, blob binary"
_SCHEMA = pa.schema([(f.split()[0], {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[f.split()[1]]) for f in _LINES.split(", ")])


def _batch(n: int, **columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([columns.get(f.name, pa.nulls(n, f.type)) for f in _SCHEMA], schema=_SCHEMA)


def _describe(least_words: int, parts: int):
    def packed(key: np.ndarray, sig: np.ndarray) -> pa.RecordBatch:
        """Records in key order, one blob for each part of the key space."""
        order = np.argsort(key)
        key, sig = key[order], sig[order]
        part = (key.astype(U) * U(parts) >> U(32)).astype(np.int32)
        edge = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]]))
        blobs = [key[a:b].tobytes() + sig[a:b].tobytes() for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True)]
        return _batch(len(blobs), part=pa.array(part[edge[:-1]]), blob=pa.array(blobs, pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                lines = Lines(data, offsets)
                some = np.flatnonzero(lines.words >= max(least_words, 1))
                # each line once a chunk
                first = np.sort(some[np.unique(lines.id[some], return_index=True)[1]])
                x, y, key, sig = signed(lines, first)
                held.append((key, sig))
                ids, h = (batch.column(k).slice(lo, hi - lo).take(pa.array(lines.row[some])) for k in (0, 2))
                one, two, null = np.zeros(len(lines.row), U), np.zeros(len(lines.row), U), np.ones(len(lines.row), bool)
                one[first], two[first], null[first] = x, y, False
                marks = [pa.array(c[some].view(np.int64), mask=null[some]) for c in (one, two)]
                part = pa.array((lines.id[some] % U(parts)).astype(np.int32))
                yield _batch(len(some), part=part, doc_id=ids, h=h, place=pa.array(lines.place[some]), id=pa.array(lines.id[some].view(np.int64)), sig=marks[0], other=marks[1])
                if sum(len(k) for k, _ in held) >= HELD:
                    yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))
                    held.clear()
        if held:
            yield packed(*(np.concatenate(c) for c in zip(*held, strict=True)))

    return run


def _tied(hot: int):
    """Rows come sorted by part; lines pass. Of blobs whole parts are looked at together, as many as fit in HELD records: near sketches
    go on as sig and other, those of hot keys as sig, with the key in place."""

    def ties(blobs: list[tuple[int, bytes]]) -> Iterator[pa.RecordBatch]:
        key = np.concatenate([np.frombuffer(b, np.uint32, len(b) // 12) for _, b in blobs])
        sig = np.concatenate([np.frombuffer(b[len(b) // 3 :], U) for _, b in blobs])
        order = np.argsort(key)
        key, sig = key[order], sig[order]
        same = key[1:] == key[:-1]
        again = np.zeros(len(key), bool)
        again[1:] |= same
        again[:-1] |= same
        u, v, keys, members = bucket_pairs(key[again], sig[again], hot)
        yield _batch(len(u), sig=pa.array(u), other=pa.array(v))
        yield _batch(len(keys), place=pa.array(keys.astype(np.int64)), sig=pa.array(members.view(np.int64)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, bytes]] = []
        records = 0
        for batch in batches:
            plain = pc.is_null(batch.column("blob"))
            yield pa.RecordBatch.from_arrays(batch.filter(plain).columns, schema=_SCHEMA)
            some = batch.filter(pc.invert(plain))
            for part, blob in zip(some.column("part").to_pylist(), some.column("blob"), strict=True):
                if records >= HELD and held[-1][0] != part:
                    yield from ties(held)
                    held, records = [], 0
                held.append((part, blob.as_py()))
                records += len(held[-1][1]) // 12
        if held:
            yield from ties(held)

    return run


def edit_distance(a: str, b: str, limit: float = float("inf")) -> int:
    """Levenshtein distance, a column of the table at a time as bits of one integer; beyond limit some number beyond it."""
    same = len(commonprefix((a, b)))
    a, b = a[same:], b[same:]
    same = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - same], b[: len(b) - same]
    if len(a) > len(b):
        a, b = b, a
    if not a:
        return len(b)
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    mask, top, score = (1 << len(a)) - 1, 1 << len(a) - 1, len(a)
    up, down = mask, 0
    for left, c in zip(range(len(b) - 1, -1, -1), b, strict=True):
        hit = where.get(c, 0)
        diagonal = (((hit & up) + up) ^ up) | hit | down
        plus, minus = down | ~(diagonal | up) & mask, up & diagonal
        score += bool(plus & top) - bool(minus & top)
        if score - left > limit:
            return score - left
        plus = (plus << 1 | 1) & mask
        minus = minus << 1 & mask
        up, down = minus | ~((hit | down) | plus) & mask, plus & (hit | down)
    return score


def normalised(line: bytes) -> str:
    return b" ".join(_NORMAL[np.frombuffer(line, np.uint8)].tobytes().split()).decode("utf-8", "replace")


def replaced(a: list[str], b: list[str], limit: float) -> bool:
    """Whether an upper bound of the edit distance of two lines is within limit: words that differ are typed anew."""
    typed = lambda x: sum(map(len, x)) + len(x)
    if len(a) == len(b) and sum(max(len(x), len(y)) for x, y in zip(a, b, strict=True) if x != y) <= limit:
        return True
    n = len(commonprefix((a, b)))
    a, b = a[n:], b[n:]
    n = len(commonprefix((a[::-1], b[::-1])))
    a, b = a[: len(a) - n], b[: len(b) - n]
    if max(typed(a), typed(b)) <= limit:
        return True
    if max(len(a), len(b)) > ALIGNED or max(typed(a), typed(b)) - typed(list((Counter(a) & Counter(b)).elements())) > limit:
        return False
    steps = SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    return sum(max(typed(a[i:j]), typed(b[k:m])) for kind, i, j, k, m in steps if kind != "equal") <= limit


def _triples(line: str) -> set[str]:
    """Its distinct character triples; an edit takes three away at most."""
    return {line[k : k + 3] for k in range(len(line) - 2)}


def _same(lines: list[str], similarity: float):
    """same(i, j): whether two of the lines have that edit similarity."""
    parts: dict[int, tuple[list[str], set[str]]] = {}
    held = 0

    def split(k: int) -> tuple[list[str], set[str]]:
        nonlocal held
        if k not in parts:
            if held > HELD:
                parts.clear()
                held = 0
            held += len(lines[k])
            parts[k] = lines[k].split(" "), _triples(lines[k])
        return parts[k]

    def same(i: int, j: int) -> bool:
        limit = (1 - similarity) * max(len(lines[i]), len(lines[j])) + 1e-9
        if abs(len(lines[i]) - len(lines[j])) > limit:
            return False
        (a, x), (b, y) = split(i), split(j)
        if max(len(x), len(y)) - len(x & y) > 3 * limit:
            return False
        return replaced(a, b, limit) or edit_distance(lines[i], lines[j], limit) <= limit

    return same


def _near(lines: list[str], similarity: float):
    """near(i, j): which pairs of the lines have that edit similarity. Those of up to BATCHED characters go together, longer ones each by itself."""
    texts, alone = Texts([t if len(t) <= BATCHED else "" for t in lines]), _same(lines, similarity)
    chars = np.array([len(t) for t in lines], np.int64)

    def near(i: np.ndarray, j: np.ndarray) -> np.ndarray:
        size = np.maximum(chars[i], chars[j])
        out = np.zeros(len(i), bool)
        some = np.flatnonzero(size <= BATCHED)
        out[some] = texts.within(i[some], j[some], (1 - similarity) * size[some] + 1e-9)
        for k in np.flatnonzero(size > BATCHED).tolist():
            out[k] = alone(int(i[k]), int(j[k]))
        return out

    return near


def _confirm(similarity: float):
    """Of rows with near, the candidates of a row."""

    def links(rows: pa.Table, edges: list[int]) -> list[tuple[int, int]]:
        lines = [normalised(t or b"") for t in rows.column("text").cast(pa.binary()).to_pylist()]
        ids, near = rows.column("doc_id").to_numpy(), rows.column("near").combine_chunks()
        known, at = np.unique(ids, return_index=True)
        pairs = pc.list_parent_indices(near).to_numpy().astype(np.int64), at[np.searchsorted(known, near.flatten().to_numpy())]
        return spanning_many(ids, ids, [pairs], _near(lines, similarity))

    return links


def _confirm_hot(similarity: float):
    """Of rows that share a key, all with near sketches and known in different parts: those of two blocks x and y, or of one."""

    def links(rows: pa.Table, edges: list[int]) -> list[tuple[int, int]]:
        lines = [normalised(t or b"") for t in rows.column("text").cast(pa.binary()).to_pylist()]
        ids = rows.column("doc_id").to_pylist()
        key, x, y, block, mark, known = (rows.column(c).to_numpy() for c in ("key", "x", "y", "block", "mark", "known"))
        reach = _reach(key)
        size = np.array([len(t) for t in lines])
        mark = mark.view(U)

        def pairs() -> Iterator[tuple[np.ndarray, np.ndarray]]:
            for lo, hi in zip(edges[:-1], edges[1:], strict=True):
                for i in range(lo, hi - 1):
                    rest = slice(i + 1, hi)
                    ok = (apart(mark[i], mark[rest]) <= reach[i]) & (known[rest] != known[i]) & (np.abs(size[rest] - size[i]) <= (1 - similarity) * np.maximum(size[rest], size[i]) + 1e-9)
                    if x[i] != y[i]:
                        ok &= block[rest] != block[i]
                    j = i + 1 + np.flatnonzero(ok)
                    if len(j):
                        yield np.full(len(j), i), j

        return spanning_many(ids, known.tolist(), pairs(), _near(lines, similarity))

    return links


def _left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (doc_id, n_lines, removed, kept, ...) come with whole texts in kept; lines are counted, and those that go are cut from the texts that have any."""
    for batch in batches:
        removed, text = batch.column(2), batch.column(3).cast(pa.binary())
        n = pc.fill_null(pc.add(pc.count_substring(text, "\n"), 1), 0).cast(pa.int64())
        some = pc.greater(pc.list_value_length(removed), 0)
        kept = []
        for raw, gone in zip(text.filter(some), removed.filter(some), strict=True):
            out = set(gone.values.to_numpy().tolist())
            kept.append(b"\n".join([x for i, x in enumerate(raw.as_py().split(b"\n")) if i not in out]))
        left = pc.replace_with_mask(text, some, pa.array(kept, pa.binary())).view(batch.schema.field(3).type)
        yield pa.RecordBatch.from_arrays([batch.column(0), n, removed, left, *batch.columns[4:]], names=batch.schema.names)


def _candidates(distinct: DataFrame, ties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pairs u, v of lines; members key, doc_id, mark of hot keys): all lines that share a key and have near sketches are in
    pairs, or in one hot key with pairs that connect most of them. Whether two lines are candidates depends on them alone."""
    marks = cut(distinct.select("id", F.explode(F.array_distinct(F.array("sig", "other"))).alias("mark")), "marks")
    at = lambda c: marks.select(F.col("mark").alias(c), F.col("id").alias(f"{c}_id"))
    sketches = cut(ties.filter("other is not null").select(F.col("sig").alias("u"), F.col("other").alias("v")).distinct(), "sketches")
    hot = ties.filter("other is null").select(F.col("place").alias("key"), F.col("sig").alias("mark")).join(marks, "mark").select("key", F.col("id").alias("doc_id"), "mark")
    busy = cut(marks.groupBy("mark").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("rep")).filter(F.col("n") > HOT).select("mark", "rep"), "busy")
    few, apart_ = marks, sketches
    stars = None
    if not busy.isEmpty():
        # a sketch of many lines is a hot key of its own, and so is a pair of sketches with one of them
        b = lambda c: busy.select(F.col("mark").alias(c), F.col("rep").alias(f"{c}_rep"))
        few = marks.join(busy, "mark", "left_anti")
        crowd = sketches.join(b("u"), "u", "left").join(b("v"), "v", "left")
        apart_ = crowd.filter("u_rep is null and v_rep is null").select("u", "v")
        crowd = cut(crowd.filter("u_rep is not null or v_rep is not null").select("u", "v"), "crowd")
        reps = marks.groupBy("mark").agg(F.min("id").alias("rep"))
        r = lambda c: reps.select(F.col("mark").alias(c), F.col("rep").alias(f"{c}_rep"))
        stars = marks.join(busy, "mark").select("rep", "id").union(crowd.join(r("u"), "u").join(r("v"), "v").select("u_rep", "v_rep"))
        pair = F.xxhash64("u", "v").bitwiseAND(F.lit(-4))
        hot = hot.union(marks.join(busy, "mark").select(F.col("mark").bitwiseAND(F.lit(-4)), "id", "mark"))
        hot = hot.union(crowd.select(pair.alias("key"), F.explode(F.array("u", "v")).alias("mark")).join(marks, "mark").select("key", "id", "mark"))
    other = few.select("mark", F.col("id").alias("v"))
    pairs = apart_.join(at("u"), "u").join(at("v"), "v").select("u_id", "v_id").union(few.withColumnRenamed("id", "u").join(other, "mark").filter("u < v").select("u", "v"))
    pairs = (pairs.union(stars) if stars is not None else pairs).toDF("a", "b")
    return cut(pairs.filter("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "pairs"), cut(hot, "hot")


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY, least_words: int = LEAST_WORDS, carry: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, n_lines, removed (places of the lines that go, ascending), kept (the text left), and carried if carry is given.

    docs needs doc_id and text; other columns are ignored, but carry, any expression over docs, is passed on. A line is what stands between line
    feeds. Lines are normalised (letters of A-Z in lower case, other ASCII but digits as spaces); equal ones are
    linked, and so are those with an edit similarity of at least similarity, as far as they share a key
    (chosen for 0.8; README has the measured recall). Of each connected group the occurrence with the smallest doc_id, then place, stays. Lines of
    fewer than least_words words, by default those without any, always stay. A null text has no lines and stays null; an empty one is one
    empty line. Rows that share a doc_id, null included, are told apart by their texts; those that share both get the same result.
    Equal lines are counted before any join, so a line that all documents share is one row there.
    """
    spark = docs.sparkSession
    key = F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h")
    docs = docs.select(*key, *([carry.alias("carried")] if carry is not None else []))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select("doc_id", "text", "h").filter("text is not null").mapInArrow(_describe(least_words, 4 * parts), _LINES)
    found = cut(found.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(_tied(HOT), _LINES), "lines")
    lines, ties = found.filter("id is not null"), found.filter("id is null")
    distinct = cut(lines.groupBy("id").agg(F.min(F.struct("doc_id", "h", "place")).alias("first"), F.min("sig").alias("sig"), F.min("other").alias("other"), F.count(F.lit(1)).alias("n")), "distinct")
    near, hot = _candidates(distinct, ties)

    ids = near.select(F.explode(F.array("u", "v")).alias("id")).union(hot.select("doc_id")).distinct()
    wanted = distinct.join(ids, "id").select("id", "first.*").groupBy(F.col("doc_id").alias("d"), F.col("h").alias("dh")).agg(F.collect_list(F.struct("place", "id")).alias("wanted"))
    here = F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("h") == F.col("dh"))
    # texts are not sorted, the other side is hashed; a text is split once, before its lines are taken
    spread = docs.select("doc_id", "text", "h").join(wanted.hint("shuffle_hash"), here).select("wanted", F.split("text", "\n").alias("t"))
    texts = spread.select(F.explode("wanted").alias("w"), "t").select(F.col("w.id").alias("doc_id"), F.get("t", F.col("w.place").cast("int")).alias("text")).dropDuplicates(["doc_id"])
    groups = linked_pairs(near, hot, cut(texts, "line-texts"), _confirm(similarity), _confirm_hot(similarity))

    whole = distinct.join(groups.withColumnRenamed("node", "id"), "id", "left").filter("n > 1 or component is not null").select("id", F.coalesce("component", "id").alias("g"), "first")
    best = whole.groupBy("g").agg(F.min("first").alias("best"))
    keep = whole.join(best, "g").select("id", "best")
    gone = lines.join(keep, "id").filter(F.struct("doc_id", "h", "place") != F.col("best")).groupBy(F.col("doc_id").alias("d"), F.col("h").alias("dh")).agg(F.array_sort(F.collect_set("place")).alias("removed"))
    none = F.expr("array()").cast("array<bigint>")
    rest = ["carried"] if carry is not None else []
    out = docs.join(gone.hint("shuffle_hash"), here, "left").select("doc_id", F.lit(0).cast("long").alias("n_lines"), F.coalesce("removed", none).alias("removed"), F.col("text").alias("kept"), *rest)
    return out.mapInArrow(_left, out.schema)


def op3_fuzzy_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", F.size("removed").cast("long").alias("n_removed"), F.array_join(F.transform("removed", lambda x: x.cast("string")), ",").alias("removed"), F.sha2(F.coalesce("kept", F.lit("")).cast("binary"), 256).alias("kept_sha256"))
