"""Quality classifier: overlapping heuristic labellers, their accuracies by expectation-maximisation, a hashed linear scorer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .kernels import U, Rolling, chunks, mix, word_bounds
from .storage import table

#: Documents that the scorer is fitted on: those of the smallest seeded hashes. All others are only scored.
SAMPLE = 4096
DIMS = 512
SEED = 29
#: A document goes if its probability of being bad is above this.
REJECT = 0.5
ABSTAIN, BAD, GOOD = 0, 1, 2
LABELLERS = ("symbols", "endings", "capitals", "exclaims", "columns", "loose_marks", "repeats", "same_lines", "letters", "sentences", "echoes")
#: Labellers are taken to be better than chance and never certain.
ACCURACY = (0.8, 0.99)
_SYMBOL, _UPPER, _LETTER, _EXCLAIM, _PIPE, _STOP = (np.zeros(256, np.int64) for _ in range(6))
_SYMBOL[list(b"#$%&*~^<>{}@_=")] = 1
_UPPER[65:91] = 1
_LETTER[65:91] = _LETTER[97:123] = 1
_EXCLAIM[33] = 1
_PIPE[124] = 1
_STOP[[46, 63]] = 1
_MARK = np.zeros(256, np.int64)
_MARK[33:48] = _MARK[58:65] = _MARK[91:97] = _MARK[123:127] = 1
_KIND = np.full(256, 1, np.int64)
_KIND[65:91], _KIND[97:123], _KIND[48:58], _KIND[128:] = 2, 0, 3, 0


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((keys, row))
    k, r = keys[order], row[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (r[1:] != r[:-1])
    return np.bincount(r[new], minlength=n)


def describe(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(votes, features, words) of rows. votes: one of ABSTAIN, BAD, GOOD for each labeller; features: DIMS hashed word-shape shares."""
    n = len(offsets) - 1

    def count(t: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(t[data])])
        return sums[offsets[1:]] - sums[offsets[:-1]]

    start, end = word_bounds(data, offsets)
    row = np.searchsorted(offsets, start, "right") - 1
    words = np.bincount(row, minlength=n)
    per = np.maximum(words, 1)
    roll = Rolling(data)
    word = roll.of(start, end)
    variety = _distinct(word, row, n) / per
    echo = np.bincount(row[1:], weights=(word[1:] == word[:-1]) & (row[1:] == row[:-1]), minlength=n) / per
    newline = np.flatnonzero(data == 10)
    line_start = np.unique(np.concatenate([offsets[:-1], newline + 1]))
    line_start = line_start[line_start < len(data)]
    line_end = np.minimum(np.concatenate([line_start[1:], [len(data)]]), len(data))
    line_row = np.searchsorted(offsets, line_start, "right") - 1
    lines = np.bincount(line_row, minlength=n)
    same = 1 - _distinct(roll.of(line_start, line_end), line_row, n) / np.maximum(lines, 1)
    symbols, exclaims, pipes, stops = (count(t) / per for t in (_SYMBOL, _EXCLAIM, _PIPE, _STOP))
    letters, capital = count(_LETTER), count(_UPPER)
    capitals = capital / np.maximum(letters, 1)
    dense = letters / np.maximum(letters + count(_MARK), 1)
    odd = np.bincount(row, weights=_SYMBOL[data[end - 1]] if len(end) else None, minlength=n) / per
    loose = np.bincount(row, weights=(end - start == 1) * _MARK[data[start]] if len(end) else None, minlength=n) / per
    long_ = words >= 20

    def vote(bad: np.ndarray, good: np.ndarray | bool = False) -> np.ndarray:
        return np.where(words == 0, ABSTAIN, np.where(bad, BAD, np.where(good, GOOD, ABSTAIN)))

    votes = np.stack([
        vote(symbols > 0.4),
        vote(odd > 0.4),
        vote(capitals > 0.5),
        vote(exclaims > 0.4),
        vote(pipes > 0.2),
        vote(loose > 0.2),
        vote(long_ & (variety < 0.2)),
        vote((lines >= 4) & (same > 0.5)),
        vote(dense < 0.8, (dense > 0.93) & (variety > 0.3)),
        vote(long_ & (stops < 0.02), (stops > 0.03) & (stops < 0.4) & (dense > 0.9) & (variety > 0.3)),
        vote(long_ & (echo > 0.3)),
    ], 1)

    features = np.zeros((n, DIMS), np.float32)
    if len(start):
        length = np.minimum(end - start, 31) // 4
        upper = np.concatenate([[0], np.cumsum(_UPPER[data])])
        shout = (upper[end] - upper[start]) * 2 > end - start
        last = np.where(_KIND[data[end - 1]] == 0, 0, data[end - 1].astype(np.int64))
        shape = ((_KIND[data[start]] * 8 + length) * 256 + last) * 2 + shout
        slot = (mix(shape.astype(U) + U(SEED)) % U(DIMS)).astype(np.int64)
        features += np.bincount(row * DIMS + slot, minlength=n * DIMS).reshape(n, DIMS)
        features /= per[:, None]
        for k, x in enumerate((variety, same)):
            slot = (mix((np.minimum(x, 0.999) * 10).astype(U) + U(1000 * (k + 1))) % U(DIMS)).astype(np.int64)
            features[np.arange(n), slot] += 1
    return votes, features, words


def fit_labellers(votes: np.ndarray, counts: np.ndarray, rounds: int = 200) -> tuple[float, np.ndarray]:
    """(prior of bad, accuracy of each labeller where it speaks) by expectation-maximisation over distinct vote patterns.

    It starts from equal accuracies of 0.8 and a prior of 0.1; labellers are taken to err independently of one
    another given the class, with an accuracy inside ACCURACY.
    """
    prior, accuracy = 0.1, np.full(votes.shape[1], 0.8)
    for _ in range(rounds):
        bad = posterior(votes, prior, accuracy)
        prior = (float((bad * counts).sum()) + 1) / (float(counts.sum()) + 10)
        right = np.where(votes == BAD, bad[:, None], 1 - bad[:, None]) * (votes != ABSTAIN) * counts[:, None]
        new = np.clip((right.sum(0) + 8) / (((votes != ABSTAIN) * counts[:, None]).sum(0) + 10), *ACCURACY)
        if np.abs(new - accuracy).max(initial=0) < 1e-6:
            break
        accuracy = new
    return prior, accuracy


def posterior(votes: np.ndarray, prior: float, accuracy: np.ndarray) -> np.ndarray:
    """P(bad) of each row of votes; an abstention says nothing."""
    weight = np.log(accuracy) - np.log1p(-accuracy)
    odds = np.log(prior) - np.log1p(-prior) + ((votes == BAD) * weight).sum(1) - ((votes == GOOD) * weight).sum(1)
    return 1 / (1 + np.exp(-np.clip(odds, -50, 50)))


def fit_scorer(features: np.ndarray, bad: np.ndarray, rounds: int = 200, rate: float = 0.3, decay: float = 1e-4) -> np.ndarray:
    """Weights and a constant of a logistic model for soft labels, by adaptive gradient descent."""
    x = np.concatenate([np.sqrt(features), np.ones((len(features), 1), np.float32)], 1)
    w, speed = np.zeros(x.shape[1]), np.full(x.shape[1], 1e-8)
    for _ in range(rounds if len(x) else 0):
        g = x.T @ (1 / (1 + np.exp(-(x @ w))) - bad) / len(x) + decay * w
        speed += g * g
        w -= rate * g / np.sqrt(speed)
    return w


_POWERS = 3 ** np.arange(len(LABELLERS))


BLANK = -1


def _batched(make, names: list[str], pass_on: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo, hi, data, offsets in chunks(batch.column(1)):
                same = [batch.column(k).slice(lo, hi - lo) for k in (range(batch.num_columns) if pass_on else (0,))]
                yield pa.RecordBatch.from_arrays([*same, *make(*describe(data, offsets))], names=[*batch.schema.names[: len(same)], *names])

    return run


def _pattern(votes: np.ndarray, words: np.ndarray) -> pa.Array:
    return pa.array(np.where(words > 0, (votes * _POWERS).sum(1), BLANK))


def _patterns(votes: np.ndarray, features: np.ndarray, words: np.ndarray) -> list[pa.Array]:
    return [_pattern(votes, words)]


def _examples(votes: np.ndarray, features: np.ndarray, words: np.ndarray) -> list[pa.Array]:
    return [_pattern(votes, words), pa.array([x.tobytes() for x in features], pa.binary())]


def _scores(weights: np.ndarray):
    def make(votes: np.ndarray, features: np.ndarray, words: np.ndarray) -> list[pa.Array]:
        p = 1 / (1 + np.exp(-np.clip(np.sqrt(features) @ weights[:-1] + weights[-1], -50, 50)))
        return [pa.array(p, mask=words == 0)]

    return make


def _unpack(patterns: np.ndarray) -> np.ndarray:
    return patterns[:, None] // _POWERS % 3


def classify(docs: DataFrame, sample: int = SAMPLE, reject: float = REJECT, carry: Column | None = None) -> DataFrame:
    """One row per row of docs: doc_id, p_bad double, kept boolean; with carry, any expression over docs, also text and carried.

    docs needs doc_id and text; other columns are ignored. Every document votes for the labellers' accuracies
    (counts of vote patterns, of which there are at most 3 ** 11, reach the driver); the scorer is fitted on at
    most sample documents that some labeller speaks on, and scores all that have words. Null, empty and blank texts are kept with p_bad null. Equal texts
    score the same, whatever their doc_id; rows may share one or have none. An empty table gives an empty result.
    """
    rest = [] if carry is None else [carry.alias("carried")]
    full = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *rest)
    docs = full.select("doc_id", "text")
    seen = docs.mapInArrow(_batched(_patterns, ["pattern"]), "doc_id long, pattern long").filter(F.col("pattern") != BLANK).groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).orderBy("pattern").collect()
    votes, counts = _unpack(np.array([r.pattern for r in seen], np.int64)), np.array([r.n for r in seen], float)
    prior, accuracy = fit_labellers(votes, counts)
    h = F.xxhash64("doc_id", F.lit(SEED))
    edge = docs.select(h.alias("h")).orderBy("h").limit(sample).agg(F.max("h").alias("edge")).first().edge
    few = docs.filter(h <= F.lit(edge)).mapInArrow(_batched(_examples, ["pattern", "features"]), "doc_id long, pattern long, features binary")
    rows = few.filter(F.col("pattern") != BLANK).limit(sample).collect()
    some = _unpack(np.array([r.pattern for r in rows], np.int64))
    voted = (some != ABSTAIN).any(1)
    x = np.stack([np.frombuffer(r.features, np.float32) for r in rows]) if rows else np.zeros((0, DIMS), np.float32)
    weights = fit_scorer(x[voted], posterior(some, prior, accuracy)[voted])
    if carry is None:
        scored = docs.mapInArrow(_batched(_scores(weights), ["p_bad"]), "doc_id long, p_bad double")
    else:
        scored = full.mapInArrow(_batched(_scores(weights), ["p_bad"], True), StructType([*full.schema.fields, StructField("p_bad", DoubleType())]))
    return scored.withColumn("kept", F.coalesce("p_bad", F.lit(0.0)) <= reject)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"))
