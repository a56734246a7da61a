"""Components of confirmed links, out of ties that only suggest them."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .graph import components, contract
from .storage import cut

#: Rows of a block, and shared pivots of a tied set that has several blocks.
BLOCK, PIVOTS = 64, 16
#: Rows of a block of a hot key.
HOT_BLOCK = 2048
#: Rows looked at together; a block that goes on is carried over. Pairs of lines go by more rows, up to so many bytes or so.
HELD_ROWS, HELD_LINES, HELD_BYTES = 512, 1 << 15, 1 << 23
#: Pairs that are looked at together. Of them each part goes by its first one, then by MORE times as many in each round.
AT_ONCE, MORE = 1 << 14, 4
#: Pairs of a block of a set; more, or lines of more than HELD_BYTES, are dealt by both ends.
DEALT = 1 << 12
#: Takes rows and the edges of their blocks; gives links inside blocks that connect all that links connect.
Confirm = Callable[[pa.Table, list[int]], list[tuple[int, int]]]


def spanning(ids: list[int], known: list, pairs: Iterable[tuple[int, int]], same: Callable[[int, int], bool]) -> list[tuple[int, int]]:
    """Pairs that connect all rows that confirmed links connect, beyond the parts in known: one row of each part, with the smallest of those.

    pairs are places of candidates, likely ones first; same(i, j) confirms a link. Pairs already connected are skipped.
    """
    root = list(range(len(ids)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    seen: dict = {}
    for i, k in enumerate(known):
        root[find(i)] = find(seen.setdefault(k, i))
    before = [find(i) for i in range(len(ids))]
    for i, j in pairs:
        a, b = find(i), find(j)
        if a != b and same(i, j):
            root[a] = b
    # stars, not the paths by which links were found, so that components need few rounds
    best: dict[int, int] = {}
    for a in dict.fromkeys(before):
        best[find(a)] = min(best.get(find(a), ids[a]), ids[a])
    return [(ids[a], best[find(a)]) for a in dict.fromkeys(before) if ids[a] != best[find(a)]]


def spanning_many(ids: list[int], known: list[int], pairs: Iterable[tuple[np.ndarray, np.ndarray]], same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """As spanning, for arrays of pairs, AT_ONCE of them or so at a time; those that same has connected by others in an earlier round are skipped."""
    own = np.unique(np.array(known, np.int64), return_inverse=True)[1]
    label = own.copy()
    held: list[tuple[np.ndarray, np.ndarray]] = []
    many = 0

    def merge() -> None:
        if not held:
            return
        i, j = (np.concatenate(c) for c in zip(*held, strict=True))
        held.clear()
        most = 1
        while len(i):
            some = label[i] != label[j]
            i, j = i[some], j[some]
            order = np.argsort(label[i], kind="stable")
            i, j = i[order], j[order]
            part = label[i]
            now = np.arange(len(i)) - np.searchsorted(part, part) < most
            a, b = i[now], j[now]
            i, j = i[~now], j[~now]
            most *= MORE
            yes = same(a, b)
            if yes.any():
                root = np.arange(int(label.max()) + 1)
                node, low = contract(label[a[yes]], label[b[yes]])
                root[node] = low
                label[:] = root[label]

    for i, j in pairs:
        some = label[i] != label[j]
        held.append((i[some], j[some]))
        many += int(some.sum())
        if many >= AT_ONCE:
            merge()
            many = 0
    merge()
    whole = np.array(ids, np.int64)
    first = np.unique(own, return_index=True)[1]
    best = np.full(len(label), np.iinfo(np.int64).max)
    np.minimum.at(best, label[first], whole[first])
    to = best[label[first]]
    return [(a, b) for a, b in zip(whole[first].tolist(), to.tolist(), strict=True) if a != b]


def block_pairs(edges: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Places i < j of all pairs of rows of one block; a block has BLOCK rows or so."""
    edge = np.array(edges)
    after = np.repeat(edge[1:], np.diff(edge)) - np.arange(edge[-1]) - 1
    i = np.repeat(np.arange(edge[-1]), after)
    return i, i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(after) - after, after)


def _blocks(confirm: Confirm, by: int, most: int = HELD_ROWS):
    """Rows come sorted by their first by columns, then known, focus and the columns of texts; whole blocks are confirmed, most rows or so at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def edges_of(t: pa.Table) -> list[int]:
            new = np.any([k[1:] != k[:-1] for k in (t.column(k).to_numpy() for k in range(by))], axis=0)
            return [0, *(np.flatnonzero(new) + 1).tolist(), len(t)]

        def done(t: pa.Table, edges: list[int]) -> pa.RecordBatch:
            size = np.diff(edges)
            some = np.repeat(size > 1, size)
            found = confirm(t.slice(0, edges[-1]).filter(pa.array(some)), [0, *np.cumsum(size[size > 1]).tolist()]) if some.any() else []
            return pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], names=["u", "v"])

        for batch in batches:
            for lo in range(0, len(batch), HELD_ROWS):
                part = pa.Table.from_batches([batch.slice(lo, HELD_ROWS)])
                held = part if held is None else pa.concat_tables([held, part])
                if len(held) < most and held.nbytes < HELD_BYTES:
                    continue
                edges = edges_of(held)[:-1]
                yield done(held, edges)
                held = held.slice(edges[-1])
        if held is not None and len(held):
            yield done(held, edges_of(held))

    return run


def linked(sets: DataFrame, texts: DataFrame, confirm: Confirm, further: bool = False) -> DataFrame:
    """(node, component) of rows that a confirmed link reaches; component is its smallest node, which itself may be left out.

    sets has doc_id, set_id and puts at least all rows that links connect into one set; texts has doc_id and what confirm reads, and
    with further also rows in no set, which go before anything is dealt. A row of texts may be there twice.
    Sets of up to BLOCK rows are confirmed whole. Larger ones are dealt into blocks of BLOCK rows that share
    PIVOTS rows. What that leaves apart is compared again: rows outside the largest confirmed part with all blocks of their set, so
    that no link between parts is lost. No task holds more than two blocks.
    """
    h = F.xxhash64("doc_id", F.lit(5))
    blocks = F.ceil(F.col("n") / BLOCK)
    counts = sets.groupBy("set_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    sized = cut(sets.join(counts, "set_id").select("doc_id", "set_id", blocks.alias("blocks"), F.pmod(h, blocks).alias("block")), "blocks")
    if further:
        texts = cut(texts.hint("merge").join(sized.select("doc_id"), "doc_id").select(texts.columns), "tied-texts")
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    yes, none = F.lit(True).alias("focus"), F.col("doc_id").alias("known")

    def confirmed(rows: DataFrame, by: list[str], name: str) -> DataFrame:
        rows = rows.hint("merge").join(texts, "doc_id").select(*by, "known", "focus", *texts.columns)
        return cut(rows.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(_blocks(confirm, len(by)), "u long, v long"), name)

    small = confirmed(sized.filter("blocks = 1").select("set_id", "doc_id", none, yes), ["set_id"], "links")
    small = small.select(F.col("u").alias("node"), F.col("v").alias("component"))
    large = sized.filter("blocks > 1")
    if large.isEmpty():
        return small
    pivots = large.groupBy("set_id", F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(PIVOTS)).alias("g")).agg(F.min(F.struct(F.xxhash64("doc_id", F.lit(7)), "doc_id", "blocks")).alias("p"))
    pivots = pivots.select(F.col("p.doc_id").alias("doc_id"), "set_id", F.col("p.blocks").alias("blocks"))
    everywhere = pivots.select("doc_id", "set_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"))
    dealt = large.select("doc_id", "set_id", "block").union(everywhere).distinct()
    first = confirmed(dealt.select("doc_id", "set_id", "block", none, yes), ["set_id", "block"], "links")
    found = components(first)
    located = cut(large.join(found, F.col("doc_id") == F.col("node"), "left").select("doc_id", "set_id", F.coalesce("component", "doc_id").alias("part")), "parts")
    main = located.groupBy("set_id", "part").agg(F.count(F.lit(1)).alias("c")).groupBy("set_id").agg(F.max(F.struct("c", "part")).alias("m"), F.sum("c").alias("n"))
    main = main.select("set_id", F.col("m.part").alias("main"), F.ceil((F.col("n") - F.col("m.c")) / BLOCK).alias("outs"), F.ceil(F.col("n") / BLOCK).alias("alls")).filter("outs > 0")
    placed = located.join(main, "set_id").withColumn("out", F.col("part") != F.col("main"))
    near, far = F.pmod(h, F.col("outs")), F.pmod(h, F.col("alls"))
    span = lambda c: F.sequence(F.lit(0).cast("long"), F.col(c) - 1)
    rest = placed.filter("out").select("doc_id", "set_id", "part", "out", near.alias("x"), F.explode(span("alls")).alias("y"))
    rest = rest.union(placed.select("doc_id", "set_id", "part", "out", F.explode(span("outs")).alias("x"), far.alias("y")))
    rest = rest.groupBy("doc_id", "set_id", "x", "y").agg(F.first("part").alias("known"), F.first("out").alias("focus"))
    second = confirmed(rest.select("doc_id", "set_id", "x", "y", "known", "focus"), ["set_id", "x", "y"], "links")
    return small.union(components(first.union(second)))


def linked_pairs(pairs: DataFrame, hot: DataFrame, texts: DataFrame, confirm: Confirm, confirm_hot: Confirm) -> DataFrame:
    """(node, component) of rows that a confirmed link reaches; component is its smallest node.

    pairs has candidates u, v, once each; hot has key, doc_id and mark, rows of which any two of one key may be candidates. texts has
    doc_id and what confirm and confirm_hot read. All pairs are looked at but those whose ends others of their block connect: by sets
    that pairs connect, each row there once with its candidates as near. Sets of more than DEALT pairs, or of more than HELD_BYTES
    of texts, are dealt into blocks by both ends of a pair, so that not even one row's pairs lie all in one. Then
    rows of a hot key that are not connected yet are compared with each other, in blocks of HOT_BLOCK.
    """
    parts = int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def confirmed(rows: DataFrame, by: list[str], how: Confirm) -> DataFrame:
        rows = rows.hint("merge").join(texts, "doc_id").select(*by, *(c for c in rows.columns if c not in by), *(c for c in texts.columns if c != "doc_id"))
        return cut(rows.repartition(parts, *by).sortWithinPartitions(*by).mapInArrow(_blocks(how, len(by), HELD_LINES), "u long, v long"), "links")

    sets = components(pairs).select(F.col("node").alias("u"), F.col("component").alias("set_id"))
    sizes = texts.select(F.col("doc_id").alias("u"), F.octet_length("text").alias("bytes"))
    placed = cut(pairs.join(sets, "u").join(sizes, "u"), "placed")
    large = placed.groupBy("set_id").agg(F.greatest(F.count(F.lit(1)) / DEALT, F.sum("bytes") / HELD_BYTES).alias("blocks")).filter("blocks > 1").select("set_id", F.ceil(F.sqrt("blocks")).alias("blocks"))
    block = lambda c: F.pmod(F.xxhash64(c, F.lit(5)), F.coalesce("blocks", F.lit(1).cast("long"))).alias(f"{c}_block")
    end = lambda c, other: F.struct(F.col(c).alias("doc_id"), other.cast("long").alias("other"))
    dealt = placed.join(large, "set_id", "left").select("set_id", block("u"), block("v"), F.explode(F.array(end("u", F.col("v")), end("v", F.lit(None)))).alias("end"))
    by = ["set_id", "u_block", "v_block"]
    links = confirmed(dealt.groupBy(*by, F.col("end.doc_id").alias("doc_id")).agg(F.collect_list("end.other").alias("near")), by, confirm)
    found = components(links)
    if hot.isEmpty():
        return found
    located = cut(hot.join(found, F.col("doc_id") == F.col("node"), "left").select("key", "doc_id", "mark", F.coalesce("component", "doc_id").alias("known")), "parts")
    open_ = located.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("known").alias("a"), F.max("known").alias("b")).filter("a <> b").select("key", F.ceil(F.col("n") / HOT_BLOCK).alias("blocks"))
    rows = located.join(open_, "key").withColumn("block", F.pmod(F.xxhash64("doc_id", F.lit(5)), F.col("blocks")))
    rows = rows.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.select("key", F.least("block", "k").alias("x"), F.greatest("block", "k").alias("y"), "block", "doc_id", "mark", "known")
    return components(links.union(confirmed(rows, ["key", "x", "y"], confirm_hot)))
