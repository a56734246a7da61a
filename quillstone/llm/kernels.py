"""numpy kernels over the bytes of an Arrow text column; documents are never cut, batches of them are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 1 << 19
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(0, 2**63, 256, dtype=U) * U(2) + U(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
WORDS = 5
_SHINGLE = _RNG.integers(0, 2**63, WORDS, dtype=U) * U(2) + U(1)
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit changes every output bit."""
    x = x ^ (x >> U(33))
    x = x * U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def chunks(column: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets of the rows in them); about limit bytes each, whole rows, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    n = len(column)
    if not n:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    at = 0
    while at < n:
        end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield at, end, data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at]
        at = end


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, CHUNK_BYTES + (1 << 17))
        _powers[:] = [np.concatenate([np.ones(1, U), np.full(size - 1, b, U)]).cumprod(dtype=U) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


class Rolling:
    """Hashes of any ranges of one buffer of bytes, or of other units by their values."""

    def __init__(self, data: np.ndarray, values: np.ndarray = _BYTE) -> None:
        up, self.down = _tables(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, U)
        np.cumsum(values[data] * up[: len(data)], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])

    def windows(self, width: int) -> np.ndarray:
        """One for each start of a window inside the buffer."""
        return mix((self.sums[width:] - self.sums[: len(self.sums) - width]) * self.down[: len(self.sums) - width])


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all rows."""
    solid = ~_SPACE[data]
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1]
    last[:-1] &= ~solid[1:]
    inner = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    first[inner] = solid[inner]
    last[inner - 1] = solid[inner - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def shingle_sets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per row its sorted distinct five-word shingles as 64-bit hashes: (hashes of all rows, offsets of the rows)."""
    n = len(offsets) - 1
    data = _LOWER[data]
    start, end = word_bounds(data, offsets)
    if not len(start):
        return np.zeros(0, U), np.zeros(n + 1, np.int64)
    word = Rolling(data).of(start, end)
    row = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(row, minlength=n)
    first = np.concatenate([[0], np.cumsum(count)])
    hashes, rows = [], []
    if len(word) >= WORDS:
        total = word[: len(word) - WORDS + 1] * _SHINGLE[0]
        for k in range(1, WORDS):
            total = total + word[k : len(word) - WORDS + 1 + k] * _SHINGLE[k]
        whole = row[: len(total)] == row[WORDS - 1 :]
        hashes.append(mix(total[whole]))
        rows.append(row[: len(total)][whole])
    few = np.flatnonzero((count > 0) & (count < WORDS))
    if len(few):
        hashes.append(np.array([mix((word[first[r] : first[r] + count[r]] * _SHINGLE[: count[r]]).sum(dtype=U)[None] + U(count[r]))[0] for r in few], U))
        rows.append(few)
    h, r = np.concatenate(hashes), np.concatenate(rows)
    order = np.lexsort((h, r))
    h, r = h[order], r[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (r[1:] != r[:-1])
    h, r = h[keep], r[keep]
    return h, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))])


def segment_reduce(op: np.ufunc, values: np.ndarray, offsets: np.ndarray, empty: int) -> np.ndarray:
    """op over each row's values; empty for rows without any."""
    out = np.full(len(offsets) - 1, empty, values.dtype)
    full = np.flatnonzero(np.diff(offsets))
    if len(full):
        out[full] = op.reduceat(values, offsets[full])
    return out
