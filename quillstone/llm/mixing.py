"""Mixing sources to target weights by subset-sum budget fitting."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .storage import cut, table

SEED = 17
LIMIT = 3
#: Words left to the exact knapsack of a source, once whole lengths have been dealt in proportion.
KNAPSACK = 1 << 15


def targets(sizes: dict, weights: dict, limit: int = LIMIT) -> dict:
    """Words for each source: shares of the whole by weight, none above limit times its size; excess is reshared by weight."""
    left, open_, out = float(sum(sizes.values())), dict.fromkeys(sizes), {}
    while open_:
        per = left / sum(weights[s] for s in open_)
        over = [s for s in open_ if weights[s] * per > limit * sizes[s]]
        if not over:
            return out | {s: weights[s] * per for s in open_}
        for s in over:
            out[s] = float(limit * sizes[s])
            left -= out[s]
            del open_[s]
    return out


def fit(counts: list[tuple[int, int]], budget: int, cap: int = KNAPSACK) -> dict[int, int]:
    """How many documents of each length to take, their words summing to budget as nearly as they can from below.

    counts has (length, documents). Each length first gets its share of documents rounded down. Longest lengths are
    added while more than cap words are open; where fewer are, shares are given back until about cap words are. The
    rest is an exact bounded knapsack, so a budget up to cap is met as nearly as any choice can; beyond it the sum
    is the best that the shares kept allow, in practice the budget itself.
    """
    total = sum(n * c for n, c in counts)
    budget = max(0, min(budget, total))
    take = {n: c * budget // total if total and budget > cap else 0 for n, c in counts}
    left = budget - sum(n * k for n, k in take.items())
    for kinds, n in enumerate(sorted(take, reverse=True)):
        back = min(take[n], max(0, cap - left) // (n * (len(take) - kinds)) if n else 0)
        take[n], left = take[n] - back, left + n * back
    free = {n: c - take[n] for n, c in counts}
    for n in sorted(free, reverse=True):
        if left <= cap:
            break
        k = min(free[n], (left - cap) // n) if n else 0
        take[n], free[n], left = take[n] + k, free[n] - k, left - k * n
    reach, mask, steps = 1, (1 << left + 1) - 1, []
    for n in sorted(free):
        k = 1
        spare = min(free[n], left // n) if n else 0
        while spare > 0 and not reach >> left & 1:
            part = min(k, spare)
            spare, k = spare - part, k * 2
            steps.append((n, part, reach))
            reach |= reach << n * part & mask
        if reach >> left & 1:
            break
    at = reach.bit_length() - 1
    for n, part, before in reversed(steps):
        if not before >> at & 1:
            at -= n * part
            take[n] += part
    return take


def _plan(rows: pd.DataFrame) -> pd.DataFrame:
    size, goal = int(rows.source_size.iloc[0]), float(rows.target.iloc[0])
    whole = int(goal // size) if size else 0
    extra = fit(list(zip(rows["size"].tolist(), rows["docs"].tolist(), strict=True)), round(goal) - whole * size)
    return pd.DataFrame({"source": rows.source, "size": rows["size"], "docs": rows["docs"], "source_size": size, "target": goal, "whole": whole, "extra": [extra[n] for n in rows["size"]]})


def mix(docs: DataFrame, seed: int = SEED, limit: int = LIMIT) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    A source is taken whole as often as its target allows and then some of its documents once more, chosen by a
    seeded hash of doc_id among those of each length, so reruns agree. Size counts words [^\\x20\\x09-\\x0D]+;
    null and empty texts have none and are never more than 0. Weights are 1, 2, 3, repeating over the sources
    by code point, null last. Only doc_id, source and text are read. Repeated rows are documents of their own,
    ranked arbitrarily among themselves. Documents are taken whole, so a source comes as near its target as
    its lengths allow: exactly in all but tiny sources. The driver sees one row per source; lengths are counted before any
    shuffle, and a hot length is ranked in about the square root of its documents at a time.
    """
    spark = docs.sparkSession
    docs = cut(docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size")), "sizes")
    sizes = {r.source: int(r.s) for r in docs.groupBy("source").agg(F.sum("size").alias("s")).collect()}
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    goals = targets(sizes, {s: k % 3 + 1 for k, s in enumerate(names)}, limit)
    goal = spark.createDataFrame([(s, sizes[s], goals[s]) for s in names], "gs string, source_size long, target double")
    counts = docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("docs")).join(goal, F.col("source").eqNullSafe(F.col("gs"))).drop("gs")
    plan = cut(counts.groupBy("source").applyInPandas(_plan, "source string, size long, docs long, source_size long, target double, whole long, extra long"), "plan")
    u = F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 40))
    p = plan.select(F.col("source").alias("ps"), F.col("size").alias("pn"), "docs", "source_size", "target", "whole", "extra")
    rows = docs.join(p, F.col("source").eqNullSafe(F.col("ps")) & (F.col("size") == F.col("pn"))).drop("ps", "pn").withColumn("u", u)
    some = (F.col("extra") > 0) & (F.col("extra") < F.col("docs"))
    rows = rows.withColumn("part", F.when(some, F.floor(F.col("u") * F.ceil(F.sqrt("docs")) / F.lit(float(1 << 40)))))
    kind = ["source", "size"]
    parts = rows.filter(some).groupBy(*kind, "part").agg(F.count(F.lit(1)).alias("c"), F.first("extra").alias("extra"))
    parts = parts.withColumn("before", F.sum("c").over(Window.partitionBy(*kind).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)))
    edge = parts.filter((F.coalesce("before", F.lit(0)) < F.col("extra")) & (F.coalesce("before", F.lit(0)) + F.col("c") >= F.col("extra"))).select(F.col("source").alias("es"), F.col("size").alias("en"), F.col("part").alias("edge"), (F.col("extra") - F.coalesce("before", F.lit(0))).alias("need"))
    picked = rows.filter(some).join(edge, F.col("source").eqNullSafe(F.col("es")) & (F.col("size") == F.col("en"))).drop("es", "en")
    last = Window.partitionBy("source", "size", "part").orderBy("u", "doc_id")
    inside = picked.filter("part = edge").withColumn("k", F.row_number().over(last)).withColumn("more", (F.col("k") <= F.col("need")).cast("long"))
    outside = picked.filter("part <> edge").withColumn("more", (F.col("part") < F.col("edge")).cast("long"))
    every = rows.filter(~some).withColumn("more", (F.col("extra") > 0).cast("long"))
    out = ["doc_id", "source", "size", "source_size", "target", "whole", "more"]
    return inside.select(out).union(outside.select(out)).union(every.select(out)).select("doc_id", "source", "size", "source_size", "target", (F.col("size") * F.least(F.col("whole") + F.col("more"), F.lit(limit))).alias("taken"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
