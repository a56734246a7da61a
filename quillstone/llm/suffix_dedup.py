"""Exact removal of repeated substrings, by suffix sorting around content-defined anchors.

A window is WIDTH bytes of one document. Its anchor is the GRAM-byte string inside it with the least hash, so
equal windows have equal anchors at equal places, and only windows of anchors that occur twice can repeat.
An anchor's occurrence owns a run of neighbouring window starts; its context is the bytes of those windows.

1. Anchors are counted by hash; occurrences of those that repeat are kept.
2. Equal contexts collapse: all windows of all but the first occurrence are repeats.
3. Where an anchor has several contexts, the windows of one occurrence of each are suffix-sorted: multikey
   quicksort on eight-byte words to SHALLOW bytes, then a blind trie orders each group that is still equal.
   Windows that end up equal are repeats of the earliest.
4. Anchors with more than HOT contexts are not brought together; their windows go by 128-bit fingerprint, each
   to the earliest, with pre-aggregation.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .kernels import U, Rolling, chunks, mix
from .storage import cut, table, unique_ids

WIDTH, GRAM = 100, 24
SHALLOW = 64
#: Contexts sorted together; at under 180 bytes each, a group is at most 1.5 MB.
HOT = 8192
_PLACE = 24
_SPAN = WIDTH - GRAM + 1
_AT = U((1 << _PLACE) - 1)
#: Fixes the order that picks anchors.
_ORDER = U(0xD6E8FEB86659FD93)


def _sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    size = 1
    while size * 2 <= width:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (width - size)], x[width - size :]) if width > size else x


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash, context hash, row, first window start in the row, anchor place in the first window, last start minus first)."""
    empty = np.zeros(0, np.int64)
    parts = []
    roll = Rolling(data)
    step = (1 << _PLACE) - WIDTH
    count = np.maximum(np.diff(offsets) - WIDTH + 1, 0)
    for base in range(0, max(len(data) - WIDTH + 1, 0), step):
        some = slice(base, min(base + step + WIDTH - 1, len(data)))
        gram = (roll.sums[some.start + GRAM : some.stop + 1] - roll.sums[some.start : some.stop + 1 - GRAM]) * roll.down[some.start : some.stop + 1 - GRAM]
        least = gram * _ORDER
        least &= ~_AT
        least |= np.arange(len(gram), dtype=U)
        least = _sliding_min(least, _SPAN)
        # starts of windows that end in their row
        row = np.repeat(np.arange(len(count)), np.clip(base + len(least) - offsets[:-1], 0, count) - np.clip(base - offsets[:-1], 0, count))
        if not len(row):
            continue
        lo = np.clip(base - offsets[:-1], 0, count)
        n = np.bincount(row, minlength=len(count))
        starts = np.arange(len(row)) + np.repeat(offsets[:-1] + lo - base - np.cumsum(n) + n, n)
        at = (least[starts] & _AT).astype(np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (row[1:] != row[:-1])
        first = np.flatnonzero(new)
        last = np.concatenate([first[1:], [len(starts)]]) - 1
        lo, hi, p, r = starts[first], starts[last], at[first], row[first]
        context = roll.of(lo + base, hi + base + WIDTH)
        context = mix(context ^ ((p - lo) * 128 + (hi - lo)).astype(U))
        parts.append((mix(gram[p]), context, r, lo + base - offsets[r], p - lo, hi - lo))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (empty.astype(U), empty.astype(U), empty, empty, empty, empty)


def _anchor_rows(full: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                h, f, row, start, place, more = anchors(data, offsets)
                columns = [pa.array(h.view(np.int64))]
                if full:
                    ids = batch.column(0).slice(lo, hi - lo).cast(pa.int64()).take(pa.array(row))
                    columns += [pa.array(f.view(np.int64)), ids, pa.array(start << 14 | place << 7 | more)]
                yield pa.RecordBatch.from_arrays(columns, names=["h", "f", "doc_id", "at"][: len(columns)])

    return run


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, g, doc_id, start, place, body) of a document's wanted contexts; of hot ones a row for each window, without body."""
    for batch in batches:
        texts, wanted = batch.column(1), batch.column(2)
        for i, doc_id in enumerate(batch.column(0).to_pylist()):
            raw = (texts[i].as_py() or "").encode()
            items = wanted[i].values
            h, at, hot = (items.field(k).to_numpy(zero_copy_only=False) for k in range(3))
            start, more, place = at >> 14, at & 127, at >> 7 & 127
            cold = np.flatnonzero(~hot)
            out = [(h[cold], np.zeros(len(cold), np.int64), start[cold], place[cold], [raw[start[k] : start[k] + more[k] + WIDTH] for k in cold])]
            if hot.any():
                windows = np.concatenate([np.arange(start[k], start[k] + more[k] + 1) for k in np.flatnonzero(hot)])
                data = np.frombuffer(raw, np.uint8)
                a, b = Rolling(data).of(windows, windows + WIDTH), Rolling(data[::-1]).of(len(data) - windows - WIDTH, len(data) - windows)
                out.append((a.view(np.int64), b.view(np.int64), windows, np.full(len(windows), -1), [None] * len(windows)))
            for hh, g, s, p, body in out:
                yield pa.RecordBatch.from_arrays([pa.array(hh, pa.int64()), pa.array(g, pa.int64()), pa.array([doc_id] * len(hh), pa.int64()), pa.array(s, pa.int64()), pa.array(p, pa.int64()), pa.array(body, pa.binary())], names=["h", "g", "doc_id", "start", "place", "body"])


def multikey_quicksort(words: np.ndarray, place: np.ndarray, group: np.ndarray, depth_limit: int) -> tuple[np.ndarray, np.ndarray]:
    """(order, group) of suffixes sorted inside their groups by their first depth_limit bytes; equal ones share a group in the result.

    words holds the big-endian eight-byte word at every place of the text. All groups are split three ways by a
    pivot word at once; the equal third goes on eight bytes deeper.
    """
    order = np.argsort(group, kind="stable")
    g = group[order]
    part = np.cumsum(np.concatenate([[0], g[1:] != g[:-1]])) if len(g) else g
    depth = np.zeros(len(order), np.int64)
    while True:
        size = np.bincount(part) if len(part) else np.zeros(0, int)
        live = np.flatnonzero((size[part] > 1) & (depth < depth_limit)) if len(part) else np.zeros(0, int)
        if not len(live):
            return order, part
        first = np.concatenate([[0], np.cumsum(size)[:-1]])
        key = words[place[order[live]] + depth[live]]
        middle = first + size // 2
        pivot = words[place[order[middle]] + depth[middle]][part[live]]
        side = (key > pivot).astype(np.int64) - (key < pivot)
        rank = np.ones(len(part), np.int64)
        rank[live] += side
        depth[live[side == 0]] += 8
        new = part * 3 + rank
        move = np.argsort(new, kind="stable")
        order, new, depth = order[move], new[move], depth[move]
        part = np.cumsum(np.concatenate([[0], new[1:] != new[:-1]]))


def blind_trie(strings: list[bytes]) -> list[list[int]]:
    """Groups of equal strings, in order; all are of one length. Inner nodes keep only the depth where strings part."""
    width = len(strings[0])
    root: list = [[0]]  # a leaf: [members]; an inner node: [depth, {byte: node}]
    for i in range(1, len(strings)):
        x = strings[i]
        node = root
        while len(node) == 2:
            node = node[1].get(x[node[0]]) or next(iter(node[1].values()))
        y = strings[node[0][0]]
        if x == y:
            node[0].append(i)
            continue
        common = width - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7) // 8
        node = root
        while len(node) == 2 and node[0] < common:
            node = node[1][x[node[0]]]
        if len(node) == 2 and node[0] == common:
            node[1][x[common]] = [[i]]
        else:
            old = node[:]
            node[:] = [common, {y[common]: old, x[common]: [[i]]}]
    out, stack = [], [root]
    while stack:
        node = stack.pop()
        if len(node) == 1:
            out.append(node[0])
        else:
            stack += [node[1][c] for c in sorted(node[1], reverse=True)]
    return out


def repeated_windows(h: np.ndarray, doc: np.ndarray, start: np.ndarray, place: np.ndarray, bodies: list[bytes]) -> tuple[np.ndarray, ...]:
    """(context number, first window, end) of runs of windows that equal one of an earlier (doc, start) under the same anchor."""
    text = b"".join(bodies) + b"\0" * 16
    length = np.fromiter(map(len, bodies), np.int64, len(bodies))
    base = np.concatenate([[0], np.cumsum(length)[:-1]])
    count = length - WIDTH + 1
    ctx = np.repeat(np.arange(len(bodies)), count)
    d = np.arange(len(ctx)) - np.repeat(np.cumsum(count) - count, count)
    at = base[ctx] + d
    raw = np.frombuffer(text, np.uint8)
    words = np.zeros(len(raw) - 8, U)
    for k in range(8):
        words = words << U(8) | raw[k : k + len(words)]
    _, number = np.unique(h, return_inverse=True)
    order, part = multikey_quicksort(words, at, number[ctx] * 256 + (place[ctx] - d + 128), SHALLOW)
    size = np.bincount(part)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    again = np.zeros(len(ctx), bool)
    tied = order[(size > 1)[part]]
    rank = np.zeros(len(ctx), np.int64)
    rank[tied[np.lexsort(((start[ctx] + d)[tied], doc[ctx[tied]]))]] = np.arange(len(tied))
    for p in np.flatnonzero(size > 1).tolist():
        members = order[first[p] : first[p] + size[p]]
        for same in blind_trie([text[m : m + WIDTH] for m in at[members].tolist()]):
            if len(same) > 1:
                who = members[same]
                again[who] = True
                again[who[rank[who].argmin()]] = False
    hits = np.flatnonzero(again)
    if not len(hits):
        return (np.zeros(0, np.int64),) * 3
    new = np.concatenate([[True], (hits[1:] != hits[:-1] + 1) | (ctx[hits[1:]] != ctx[hits[:-1]])])
    last = np.concatenate([np.flatnonzero(new)[1:], [len(hits)]]) - 1
    a, b = hits[new], hits[last]
    return ctx[a], d[a], d[b] + 1


_SORTED_BYTES = 1 << 18


def _sorted_repeats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by h; an anchor's contexts, HOT at most, are kept together across batches."""
    held: pa.Table | None = None

    def ranges(t: pa.Table) -> pa.RecordBatch:
        h, doc, start, place = (t.column(k).to_numpy() for k in range(4))
        ctx, a, b = repeated_windows(h, doc, start, place, t.column(4).to_pylist())
        return pa.RecordBatch.from_arrays([pa.array(doc[ctx]), pa.array(start[ctx] + a), pa.array(start[ctx] + b - 1 + WIDTH)], names=["doc_id", "start", "end"])

    for batch in batches:
        held = pa.Table.from_batches([batch]) if held is None else pa.concat_tables([held, pa.Table.from_batches([batch])])
        while len(held):
            h = held.column(0).to_numpy()
            ends = np.flatnonzero(h[1:] != h[:-1]) + 1
            if not len(ends):
                break
            size = np.cumsum(np.fromiter((len(x.as_py()) for x in held.column(4)), np.int64, len(held)))
            fits = ends[size[ends - 1] <= _SORTED_BYTES]
            end = int(fits[-1]) if len(fits) else int(ends[0])
            if len(fits) == len(ends) and size[-1] < _SORTED_BYTES:
                break
            yield ranges(held.slice(0, end))
            held = held.slice(end).combine_chunks()
    if held is not None and len(held):
        yield ranges(held)


def _strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for doc_id, text, cuts in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
            raw = (text.as_py() or "").encode()
            spans: list[dict] = []
            kept = raw
            if cuts.is_valid and len(raw):
                starts, ends = (cuts.values.field(k).to_numpy() for k in range(2))
                depth = np.cumsum(np.bincount(starts, minlength=len(raw) + 1) - np.bincount(ends, minlength=len(raw) + 1))
                gone = depth[:-1] > 0
                kept = np.frombuffer(raw, np.uint8)[~gone].tobytes()
                edge = np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))
                spans = [{"start": int(a), "end": int(b)} for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1), strict=True)]
            out.append((doc_id, len(raw), spans, kept))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int64()), pa.array([x[1] for x in out], pa.int64()), pa.array([x[2] for x in out], pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array([x[3] for x in out], pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (removed runs of bytes: start, end), kept (the bytes left).

    docs needs doc_id and text; other columns are ignored. Every byte goes that a WIDTH-byte
    string covers which also starts earlier, in a smaller doc_id or before in the same text; overlaps count and
    strings are judged on the input. Null is empty; texts under WIDTH bytes stay whole; an empty table gives an
    empty result. Rows that share a doc_id are documents of their own, in the order of a hash of their texts; null
    comes before all others.
    """
    docs, _ = unique_ids(docs)
    seen = docs.select("doc_id", "text").mapInArrow(_anchor_rows(False), "h long").groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("h")
    hits = cut(docs.select("doc_id", "text").mapInArrow(_anchor_rows(True), "h long, f long, doc_id long, at long").hint("merge").join(seen, "h"), "hits")
    firsts = cut(hits.groupBy("h", "f").agg(F.min(F.struct("doc_id", "at")).alias("first"), F.count(F.lit(1)).alias("n")), "firsts")
    later = hits.join(firsts.filter("n > 1").select("h", "f", "first"), ["h", "f"]).filter(F.struct("doc_id", "at") != F.col("first"))
    begin = F.shiftright("at", 14)
    later = later.select("doc_id", begin.alias("start"), (begin + F.col("at").bitwiseAND(127) + WIDTH).alias("end"))

    several = firsts.groupBy("h").agg(F.count(F.lit(1)).alias("contexts")).filter("contexts > 1")
    wanted = firsts.select("h", "first.doc_id", "first.at").join(several, "h").groupBy("doc_id").agg(F.collect_list(F.struct("h", "at", (F.col("contexts") > HOT).alias("hot"))).alias("wanted"))
    found = cut(wanted.hint("merge").join(docs, "doc_id").select("doc_id", "text", "wanted").mapInArrow(_contexts, "h long, g long, doc_id long, start long, place long, body binary"), "contexts")
    cold = found.filter("body is not null").select("h", "doc_id", "start", "place", "body")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = cold.repartition(parts, "h").sortWithinPartitions("h").mapInArrow(_sorted_repeats, "doc_id long, start long, end long")
    hot = found.filter("body is null").select("h", "g", "doc_id", "start")
    earliest = hot.groupBy("h", "g").agg(F.min(F.struct("doc_id", "start")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "g", "first")
    routed = hot.join(earliest, ["h", "g"]).filter(F.struct("doc_id", "start") != F.col("first")).select("doc_id", "start", (F.col("start") + WIDTH).alias("end"))

    cuts = later.union(sorted_).union(routed).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    return docs.hint("merge").join(cuts, "doc_id", "left").select("own", "text", "cuts").mapInArrow(_strip, "doc_id long, n_bytes long, spans array<struct<start:bigint,end:bigint>>, kept binary")


def op1_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents"))
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return out.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
