import random
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as pipeline
from quillstone.llm import lines, mixing

WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


# names that the stages use themselves, and one in another case
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, old string, changed string, kept string, times long, `row` long, carried long, h long"
NAMES = [f.split()[0].strip("`") for f in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def rows():
    """Unlike texts, copies, near copies, shared lines, nulls, blanks, repeated and null doc_ids, repeated rows."""
    rng = random.Random(12)
    shared = prose(rng, 12)
    texts = [". ".join("".join(c for c in prose(rng, 9) if not c.isdigit()).capitalize() + str(k) for _ in range(8)) + "." for k in range(20)]
    texts = [" ".join(w + "abcdefgh"[k % 8] + "stuvw"[k // 8] for w in t.split(" ")) for k, t in enumerate(texts)]
    out = [(k, t) for k, t in enumerate(texts)]
    out += [(30 + k, texts[k] + "\n" + shared) for k in range(3)]
    near = prose(rng, 200).split()
    for k in range(6):
        out.append((40 + k, " ".join(near[: 30 * k] + [f"new{k}"] + near[30 * k + 1 :])))
    out += [(50, None), (51, ""), (52, " \n "), (53, prose(rng, 30)), (53, prose(rng, 31)), (54, texts[0]), (54, texts[0]), (None, prose(rng, 33)), (None, None)]
    return [(i, t, "en", ["a", "b", None][k % 3], len(t or ""), "o", "c", "k", k, 2 * k, 3, 4) for k, (i, t) in enumerate(out)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).cache()


def key(row):
    return tuple(str(x) for x in row)


def test_stages_keep_columns_and_empty_tables(spark, docs):
    for _, stage in pipeline.STAGES[:-1]:
        assert stage(spark, docs.limit(0), "").count() == 0 and stage(spark, docs, "").columns == NAMES


def test_quality_keeps_rows(spark, docs, rows):
    got = [tuple(r) for r in pipeline.quality_stage(spark, docs, "").collect()]
    assert not Counter(map(key, got)) - Counter(map(key, rows)) and len(got) >= len(rows) - 2
    assert {r[0] for r in got if not (r[1] or "").strip()} == {50, 51, 52, None}


def test_lines_against_brute_force(spark, docs, rows):
    got = Counter(key(r) for r in pipeline.line_stage(spark, docs, "").collect())
    spots, norm = defaultdict(set), {}
    order = sorted({(i is not None, i or 0, t) for i, t, *_ in rows if t is not None})
    for d in order:
        for p, line in enumerate(d[2].split("\n")):
            if n := lines.normalised(line.encode()):
                spots[n].add((*d, p))
    names = sorted(spots)
    group = {n: n for n in names}
    for a in names:
        for b in names:
            if a < b and lines.edit_distance(a, b) <= 0.2 * max(len(a), len(b)):
                group = {n: group[a] if g == group[b] else g for n, g in group.items()}
    # rows that share a doc_id go by a hash of their texts, here only where their lines differ anyway
    first = {g: min(s for n in names if group[n] == g for s in spots[n]) for g in set(group.values())}
    want = Counter()
    for r in rows:
        d = (r[0] is not None, r[0] or 0, r[1])
        parts = None if r[1] is None else r[1].split("\n")
        left = [x for p, x in enumerate(parts or []) if not (n := lines.normalised(x.encode())) or first[group[n]] == (*d, p)]
        if parts is None or len(left) == len(parts):
            want[key(r)] += 1
        elif (text := "\n".join(left)).strip() and len(text) >= 0.2 * len(r[1]):
            want[key((r[0], text, *r[2:4], len(text), *r[5:]))] += 1
    assert got == want


def test_near_duplicates_against_brute_force(spark, docs, rows):
    got = Counter(key(r) for r in pipeline.near_dedup_stage(spark, docs, "").collect())
    sets = [{tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if (w := (r[1] or "").lower().split()) else set() for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                label = [label[j] if g == label[i] else g for g in label]
    assert sum(got.values()) == len(set(label)) < len(rows) - 5
    by = defaultdict(list)
    for r, g in zip(rows, label, strict=True):
        by[g].append(r)
    assert all(sum(got[key(r)] for r in {key(x): x for x in some}.values()) == 1 and got[key(min(some, key=lambda r: (r[0] is not None, r[0] or 0)))] for some in by.values() if len({x[0] for x in some}) == len(some))


def test_mixing_repeats_rows(spark, docs, rows):
    got = Counter(key(r) for r in pipeline.mixing_stage(spark, docs, "").collect())
    assert set(got) <= {key(r) for r in rows} and max(got.values()) <= 2 * mixing.LIMIT
    size = lambda r: len((r[1] or "").split())
    sizes = {s: sum(size(r) for r in rows if r[3] == s) for s in ("a", "b", None)}
    goals = mixing.targets(sizes, {"a": 1, "b": 2, None: 3})
    for s, goal in goals.items():
        words = sum(got[k] * size(r) for k, r in {key(r): r for r in rows}.items() if r[3] == s)
        assert goal - max(map(size, rows)) <= words <= goal + 1  # whole documents only
    assert all(got[key(r)] for r in rows if not size(r))


def test_whole_run(spark, tmp_path, docs):
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    pieces = pipeline.run(spark, str(tmp_path)).collect()
    assert pieces and all(0 < r.length <= 4096 for r in pieces)
    assert {r.doc_id for r in pieces} <= {r.doc_id for r in docs.collect()}
