import hashlib
import random
import time
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from quillstone.llm import chat, edits, graph, lines, links, media, mixing, near_dedup, packing, pii, quality, storage, suffix_dedup, topk

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h long, id long, key string"
WORDS = "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau phi chi psi omega".split()


def prose(rng, n):
    return " ".join(rng.choice(WORDS) + str(rng.randrange(50)) for _ in range(n))


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty, blank and short texts, copies, near copies, shared passages, one long text."""
    rng = random.Random(5)
    base, passage = prose(rng, 120), prose(rng, 40)
    out = [None, "", "   \n ", "one", "one two", base, base, base.upper(), "é漢字 ✓ " * 40, prose(rng, 9000)]
    for _ in range(12):
        words = base.split()
        words[rng.randrange(len(words))] = "changed"
        out.append(" ".join(words))
    out += [prose(rng, 30) + "\n" + passage + "\n" + prose(rng, 30) for _ in range(6)]
    return dict(enumerate(out, 3))


@pytest.fixture(scope="module")
def docs(spark, texts):
    return spark.createDataFrame([(i, t, "en", [None, "a", "b"][i % 3], 0, 1, 2, "k") for i, t in texts.items()], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_repeats(docs, empty, texts):
    got = {r.doc_id: r for r in suffix_dedup.remove_repeats(docs).collect()}
    seen: set = set()
    for i, t in texts.items():
        raw, gone = (t or "").encode(), set()
        for s in range(len(raw) - 99):
            if raw[s : s + 100] in seen:
                gone |= set(range(s, s + 100))
            seen.add(raw[s : s + 100])
        assert bytes(got[i].kept) == bytes(b for k, b in enumerate(raw) if k not in gone)
        assert (got[i].n_bytes, len(got[i].spans)) == (len(raw), sum(k - 1 not in gone for k in gone))
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_repeats_by_fingerprint(docs, monkeypatch):
    want = {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()}
    monkeypatch.setattr(suffix_dedup, "HOT", 1)
    assert {r.doc_id: bytes(r.kept) for r in suffix_dedup.remove_repeats(docs).collect()} == want


def test_suffix_order():
    rng = random.Random(2)
    bodies = [bytes(rng.choice(b"ab") for _ in range(40)) for _ in range(60)]
    text = b"".join(bodies) + b"\0" * 16
    raw = np.frombuffer(text, np.uint8).astype(np.uint64)
    words = np.zeros(len(raw) - 8, np.uint64)
    for k in range(8):
        words = words << np.uint64(8) | raw[k : k + len(words)]
    at = np.arange(0, len(text) - 56)
    order, part = suffix_dedup.multikey_quicksort(words, at, np.zeros(len(at), int), 16)
    keys = [text[p : p + 16] for p in at[order]]
    assert keys == sorted(keys) and all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], part, part[1:]))
    groups = suffix_dedup.blind_trie(bodies + bodies[:9])
    assert [(bodies * 2)[g[0]] for g in groups] == sorted(set(bodies)) and sum(map(len, groups)) == 69


def test_mixing(docs, empty):
    rows = mixing.mix(docs).collect()
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
        assert r.taken <= 3 * r["size"] and (r["size"] == 0 or r.taken % r["size"] == 0)
    for some in by.values():
        assert abs(sum(r.taken for r in some) - some[0].target) <= max(r["size"] for r in some)  # whole documents only
        assert some[0].source_size == sum(r["size"] for r in some)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    assert mixing.mix(empty).count() == 0
    assert mixing.targets({"a": 10, "b": 1000}, {"a": 2, "b": 1}) == {"a": 30.0, "b": 980.0}
    rng = random.Random(1)
    for _ in range(100):
        counts = [(n, rng.randint(1, 4)) for n in rng.sample(range(1, 30), 5)]
        budget = rng.randint(0, sum(n * c for n, c in counts))
        reach = {0}
        for n, c in counts:
            reach = {x + n * k for x in reach for k in range(c + 1)}
        take = mixing.fit(counts, budget)
        assert all(0 <= take[n] <= c for n, c in counts) and sum(n * k for n, k in take.items()) == max(x for x in reach if x <= budget)
        some = mixing.fit(counts, budget, cap=60)
        assert all(0 <= some[n] <= c for n, c in counts) and budget - 30 < sum(n * k for n, k in some.items()) <= budget
    assert mixing.fit([(21, 4), (13, 1), (26, 4), (7, 4), (4, 1)], 178).items() and sum(n * k for n, k in mixing.fit([(21, 4), (13, 1), (26, 4), (7, 4), (4, 1)], 178).items()) == 178


def test_lines(docs, empty, texts):
    got = {r.doc_id: r for r in lines.dedup_lines(docs).collect()}
    spots = defaultdict(list)
    for i, t in texts.items():
        for p, line in enumerate([] if t is None else t.split("\n")):
            if len((n := lines.normalised(line.encode())).split()) >= lines.LEAST_WORDS:
                spots[n].append((i, p))
    names = sorted(spots)
    group = {n: {n} for n in names}
    for a in range(len(names)):
        for b in range(a):
            x, y = names[a], names[b]
            if lines.edit_distance(x, y) <= 0.2 * max(len(x), len(y)):
                both = group[x] | group[y]
                for n in both:
                    group[n] = both
    gone = {s for n in names for s in spots[n] if s != min(t for m in group[n] for t in spots[m])}
    for i, t in texts.items():
        keep = None if t is None else "\n".join(x for p, x in enumerate(t.split("\n")) if (i, p) not in gone)
        assert got[i].kept == keep and got[i].removed == sorted(p for j, p in gone if j == i)
    assert lines.dedup_lines(empty).count() == 0


def test_lines_by_edit_similarity(spark):
    """Against edit similarity alone: one or two words changed in lines of many lengths, and typing errors in short ones."""
    rng = random.Random(17)
    rows = []
    for n in [6] * 10 + [10, 20, 40, 80] * 10:
        words = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 9))) for _ in range(n)]
        other = list(words)
        if n == 6:
            other[2] = other[2][:-1] + "0"
        for k in rng.sample(range(n), 1 + (n > 10)) if n > 6 else []:
            other[k] = rng.choice(words)
        rows += [" ".join(words), " ".join(other).upper() + "!"]
    names = [lines.normalised(t.encode()) for t in rows]
    group = list(range(len(rows)))
    for j in range(len(rows)):
        for i in range(j):
            if lines.edit_distance(names[i], names[j]) <= 0.2 * max(len(names[i]), len(names[j])):
                group = [group[i] if g == group[j] else g for g in group]
    got = lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
    assert {r.doc_id for r in got if r.removed} == {i for i, g in enumerate(group) if i != g} and len(set(group)) < 0.6 * len(rows)


def test_lines_of_large_sets(spark, monkeypatch):
    """Sets of several blocks, hot keys met by one task, repeated and null doc_ids, and columns passed on."""
    monkeypatch.setattr(lines, "HOT", 8)
    rng = random.Random(4)
    stem = [f"word{rng.randrange(900)}" for _ in range(30)]
    rows = [(i, " ".join(stem[:k] + [f"x{i}"] + stem[k + 1 :]), i) for i in range(300) for k in [rng.randrange(30)]]
    rows += [(1000, prose(rng, 20), 7)] * 2 + [(1000, "another text\n" + rows[5][1], 8), (None, "no id\nno id", 9), (None, None, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, removed long")
    got = sorted(((r.doc_id, r.carried, r.kept) for r in lines.dedup_lines(docs, carry=lines.F.col("removed")).collect()), key=str)
    # a null doc_id comes before all others
    want = [(i, c, t if i == 0 else "") for i, t, c in rows[:300]] + [(1000, 7, rows[300][1])] * 2 + [(1000, 8, "another text"), (None, 9, "no id"), (None, 10, None)]
    assert got == sorted(want, key=str)


def test_lines_do_not_depend_on_the_size_of_sets(spark, monkeypatch):
    """Every two lines that share a key and have near sketches are compared, in sets of any size and for hot keys, so a row's links are those of a table of its own."""
    rng = random.Random(8)
    parts = ["the", "on", "er", "tion", "ha", "re", "nd"]
    rows = sorted({" ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(2, 4))) for _ in range(2500)})
    rows = [t for t in rows if len(t) < lines.LONG]
    data = np.frombuffer("".join(rows).encode(), np.uint8)
    some = lines.Lines(data, np.concatenate([[0], np.cumsum([len(t) for t in rows])]))
    key, sig = lines.signed(some, np.arange(len(rows)))[2:]
    assert len(key) == lines.KEYS * len(rows)  # three characters only
    buckets = defaultdict(list)
    for n, k in enumerate(key.tolist()):
        buckets[k].append(n // lines.KEYS)
    group = list(range(len(rows)))
    for i, j in sorted({(i, j) for b in buckets.values() for i in b for j in b if i < j}):
        if group[i] != group[j] and lines.apart(sig[i * lines.KEYS], sig[j * lines.KEYS]) <= lines.SHORT_RADIUS and lines.edit_distance(rows[i], rows[j]) <= 0.2 * max(len(rows[i]), len(rows[j])):
            low, high = sorted((group[i], group[j]))
            group = [low if g == high else g for g in group]
    want = {i for i, g in enumerate(group) if i != g}
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string").repartition(3)
    for hot in (lines.HOT, 3):
        monkeypatch.setattr(lines, "HOT", hot)
        monkeypatch.setattr(links, "HOT_BLOCK", 8, raising=False)
        assert {r.doc_id for r in lines.dedup_lines(docs).collect() if r.removed} == want and want


def test_crowded_sketches(spark, monkeypatch):
    """Lines of the same word pairs, so of one sketch: each is compared with all, whatever leads them."""
    monkeypatch.setattr(lines, "HOT", 2)
    a, b = "one two three four five six seven eight nine ten", "ab cd ef gh ij kl mn op qr st uv wx"
    rows = [f"{a} {a} {x}" for x in ("one", "one two", "one two three", "one two three four")] + [f"{b} {b} {b[: 3 * k - 1]}" for k in range(1, 6)] + ["free line that stands for itself alone here"]
    got = {r.doc_id for r in lines.dedup_lines(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect() if r.removed}
    assert got == {1, 2, 3, 5, 6, 7, 8}


def test_edits_of_many_texts():
    """Against the plain distance: sizes about multiples of 64, empty texts, unlike and like pairs, any limit."""
    rng = random.Random(5)
    texts = []
    for size in (0, 1, 2, 30, 63, 64, 65, 127, 128, 129, 200, 330, 500):
        for _ in range(6):
            text = "".join(rng.choices("abcdé 中", k=size))
            other = list(text)
            for _ in range(rng.randint(0, size // 3 + 1)):
                at = rng.randrange(len(other) + 1)
                other[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "é"])
            texts += [text, "".join(other)]
    some = edits.Texts(texts)
    pairs = [(k, k ^ 1) for k in range(len(texts))] + [(rng.randrange(len(texts)), rng.randrange(len(texts))) for _ in range(3000)]
    i, j = np.array(pairs).T
    far = np.array([lines.edit_distance(texts[a], texts[b]) for a, b in pairs])
    for limit in (0.2 * np.maximum(some.size[i], some.size[j]) + 1e-9, far, far - 1, np.array([rng.randrange(400) for _ in pairs])):
        assert (some.within(i, j, limit) == (far <= limit)).all()


def test_lines_of_hot_keys_are_compared_together(monkeypatch):
    """Unlike lines of one hot key are told apart without a distance for each pair; the links are those of the plain distance."""
    rng = random.Random(6)
    rows = [" ".join("".join(rng.choices("abcdef", k=6)) for _ in range(8)) for _ in range(60)]
    rows += [t[:-3] + "xyz" for t in rows[:9]]
    want = [(60 + k, k) for k in range(9)]
    n = len(rows)
    mark = np.full(n, 21, np.int64)
    table = pa.table({"key": [8] * n, "x": [0] * n, "y": [0] * n, "block": [0] * n, "doc_id": range(n), "mark": mark, "known": range(n), "text": rows})
    plain = {(j, i) for i in range(n) for j in range(i + 1, n) if lines.edit_distance(rows[i], rows[j]) <= 0.2 * 55}
    assert plain == set(want)
    monkeypatch.setattr(lines, "edit_distance", None)
    assert sorted(lines._confirm_hot(lines.SIMILARITY)(table, [0, n])) == want


def test_short_lines(spark):
    rows = [(1, "Ietzte.\nfirst of these\n\n--"), (2, "ietzte\nAll rights reserved.\n\n--"), (3, "all rights reserved\nyes"), (4, "Yes!\nno")]
    got = {r.doc_id: r.removed for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: [], 2: [0], 3: [0], 4: [0]}


def test_edit_distance():
    rng = random.Random(3)
    for _ in range(200):
        a, b = ("".join(rng.choice("abc") for _ in range(rng.randrange(15))) for _ in range(2))
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        assert lines.edit_distance(a, b) == row[-1]


def test_components(spark, monkeypatch):
    monkeypatch.setattr(graph, "HELD", 64)
    rng = np.random.default_rng(3)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 400, (260, 2))] + [(1000 + i, 1001 + i) for i in range(300)] + [(2000, 2001 + i) for i in range(50)] + [(5000, 5000), (7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        low, high = sorted((find(a), find(b)))
        root[high] = low
    got = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5))
    assert {(r.node, r.component) for r in got.collect()} == {(x, find(x)) for x in root}
    assert got.count() == len(root)
    assert graph.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("held", [64, 1 << 20])
def test_components_meet_their_nodes_once(spark, monkeypatch, held):
    """However many rounds components take, one table of all nodes is joined and written."""
    monkeypatch.setattr(graph, "HELD", held)
    sizes = []

    def cut(df, name):
        sizes.append((name, (out := storage.cut(df, name)).count()))
        return out

    monkeypatch.setattr(graph, "cut", cut)
    edges = [(i, i + 1) for i in range(60)] + [(1000 + i // 5, 2000 + i) for i in range(100)]
    got = graph.components(spark.createDataFrame(edges, "u long, v long").repartition(5)).collect()
    want = {i: 0 for i in range(61)} | {1000 + i: 1000 + i for i in range(20)} | {2000 + i: 1000 + i // 5 for i in range(100)}
    assert {r.node: r.component for r in got} == want and len(got) == len(want)
    assert [n for name, n in sizes if name == "labels"].count(len(want)) == 1


def test_near_duplicates(docs, empty, texts):
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs).collect()}
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    label = {i: i for i in sets}
    for i in sets:
        for j in sets:
            if i < j and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = label[i], label[j]
                label = {k: min(a, b) if v in (a, b) else v for k, v in label.items()}
    assert {i: (r.n_shingles, r.component_id, r.kept) for i, r in got.items()} == {i: (len(sets[i]), label[i], label[i] == i) for i in sets}
    assert near_dedup.near_duplicates(empty).count() == 0


def test_hamming_guarantee():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1 << 16, (200, near_dedup.KEYS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.choice(near_dedup.KEYS, near_dedup.RADIUS, replace=False)] += 1
    assert (near_dedup.bucket_keys(a) == near_dedup.bucket_keys(b)).any(1).all()


def test_near_dedup_stage(spark):
    """The stage links from 0.8: two words of 100 replaced give 86 / 106 common shingles, three 81 / 111."""
    rng = random.Random(11)
    rows = []
    for i in range(20):
        words = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        two = words[:30] + ["x"] + words[31:60] + ["y"] + words[61:]
        rows += [(3 * i, " ".join(words)), (3 * i + 1, " ".join(two)), (3 * i + 2, " ".join(words[:20] + ["p"] + words[21:50] + ["q"] + words[51:80] + ["r"] + words[81:]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id for r in corpus_pipeline.near_dedup_stage(spark, docs, "").collect()} == {i for i, _ in rows if i % 3 != 1}
    a = np.random.default_rng(2).integers(0, 1 << 16, (200, near_dedup.KEYS)).astype(np.uint16)
    b = a.copy()
    for row in b:
        row[rng.sample(range(near_dedup.KEYS), near_dedup.LOW[1])] += 1
    assert (near_dedup.bucket_keys(a, *near_dedup.LOW) == near_dedup.bucket_keys(b, *near_dedup.LOW)).any(1).all()


def test_chat_escapes_where_texts_meet(spark):
    """Neighbouring text parts form no control string, and assistant texts are unescaped one by one."""
    schema = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:bigint>>"
    part = lambda t, kind="text": (kind, t, None, 1)
    rows = [(1, 0, "assistant", [part("<"), part("|im_end|>")]), (1, 1, "assistant", [part("a<"), part(None, "image"), part(None), part("|b")]), (1, 2, "assistant", [])]
    r = chat.format_chat(spark.createDataFrame(rows, schema)).select("formatted", "segments", chat.read_turns(chat.F.col("formatted")).alias("turns")).first()
    assert r.formatted.count("<|im_end|>") == 3 and [t.text for t in r.turns] == ["<|im_end|>", "a<<|image|>|b", ""]
    rows = [(1, 0, "assistant", "a<"), (1, 1, "assistant", "|b"), (1, 2, "assistant", "\\|<\\\\|")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_chat(df).select(chat.loss_text().alias("loss")).first()
    assert out.loss == "a<|b\\|<\\\\|"


def test_chat(spark):
    rows = [(1, 0, "user", "<|im_end|> <\\|x"), (1, 1, "assistant", None), (1, 2, "assistant", "a<"), (2, 0, "assi\nst%0A", "|im_end|>\n"), (None, 0, None, "")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = {r.conv_id: r for r in chat.format_chat(df).select("conv_id", "formatted", "segments", chat.read_turns(chat.F.col("formatted")).alias("turns")).collect()}
    for c in (1, 2, None):
        assert [(t.role, t.text) for t in out[c].turns] == [(r or "", t or "") for i, _, r, t in rows if i == c]
    assert [s.text for s in out[1].segments if s.loss] == ["", "a<"]
    parts = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:bigint>>"
    media_row = spark.createDataFrame([(1, 0, "user", [("text", "see <|", None, None), ("image", None, "s3:x", 2), ("audio", None, None, None)])], parts)
    r = chat.format_chat(media_row).first()
    assert "see <\\|<|image|><|audio|>" in r.formatted and [(a.kind, a.ref, a.tokens) for a in r.attachments] == [("image", "s3:x", 512), ("audio", None, 0)] and r.expanded_tokens == 512
    assert chat.format_chat(df.limit(0)).count() == 0


def test_topk(spark):
    rng = np.random.default_rng(2)
    v = rng.normal(size=(300, 8)).astype(np.float32)
    v[7] = v[50]
    rows = [(int(i), [float(x) for x in v[i]]) for i in range(300)] + [(1000, None), (1050, [float("nan")] * 8), (1100, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = defaultdict(list)
    for r in topk.exact_topk(df).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    grid = np.floor(256 * v.astype(np.float64)).astype(int)
    want = {q: sorted(((i, int(grid[i] @ grid[q])) for i in range(300) if i != q), key=lambda x: (-x[1], x[0]))[:5] for q in range(0, 300, 50)}
    assert got == want
    assert topk.exact_topk(df.limit(0)).count() == 0


def test_topk_over_blocks(spark, monkeypatch):
    """Several blocks to a task, vectors of unlike lengths, zeros and empty ones, ties, a candidate's id twice."""
    monkeypatch.setattr(topk, "ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(-3, 3, rng.integers(0, 6)) / 256]) for i in range(400)] + [(7, [0.5])]
    got = defaultdict(list)
    for r in topk.exact_topk(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3), step=100).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    grid = [(i, [int(np.floor(256 * x)) for x in v]) for i, v in rows]
    for q in (0, 100, 200, 300):
        want = sorted(((i, sum(a * b for a, b in zip(v, grid[q][1]))) for i, v in grid if i != q), key=lambda x: (-x[1], x[0]))[:5]
        assert got[q] == want


def test_packing(docs, empty, texts):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: np.array(t.encode(x or "", add_special_tokens=False).ids + [2], "<u4") for i, x in texts.items()}
    rows = packing.pack(docs).collect()
    for i, x in ids.items():
        at = 0
        for r in sorted((r for r in rows if r.doc_id == i), key=lambda r: r.start):
            assert (r.start, r.ids_crc32, r.doc_tokens) == (at, zlib.crc32(x[at : at + r.length]), len(x))
            at += r.length
        assert at == len(x)
    bins = defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for b in bins.values():
        ends = np.cumsum([n for _, n in sorted(b)])
        assert [o for o, _ in sorted(b)] == [0, *ends[:-1]] and ends[-1] <= packing.CAPACITY
    assert packing.pack(empty).count() == 0
    assert all(sum(packing.pieces_of(n)) == n for n in range(1, 9000, 7))


def test_packing_control_strings(spark):
    rows = [(1, "a <|endoftext|>b x<|ENDOFTEXT|>y"), (2, "<|startoftext|>"), (None, "one two"), (1, "one two")]
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = sorted(zlib.crc32(np.array(t.encode(x, add_special_tokens=False).ids + [2], "<u4")) for _, x in rows)
    assert sorted(r.ids_crc32 for r in got) == want


def _ids(rows):
    raw = [r if isinstance(r, bytes) else r.encode() for r in rows]
    offsets = np.cumsum([0, *map(len, raw)])
    ids, at = packing.token_ids(np.frombuffer(b"".join(raw), np.uint8), offsets, public_tokenizers.path("word_bpe_49k.json"))
    return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]


def _plain_ids(rows):
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    return [e.ids + [2] for e in t.encode_batch([r.decode("utf-8", "replace") if isinstance(r, bytes) else r for r in rows], add_special_tokens=False)]


def test_packing_takes_plain_words_by_pieces(monkeypatch):
    """Words of Latin letters, digits and marks are not encoded one by one: their pieces are, each once."""
    rng, calls = random.Random(6), []
    rows = [" ".join(rng.choice(("Über", "l'eau", "we'Re", "x''s", "it's's", "naïve")) + rng.choice("0!,.?-") + str(rng.randrange(10**6)) for _ in range(400)) for _ in range(20)]
    packing._forget()
    monkeypatch.setattr(packing, "_encode", lambda *_: pytest.fail("encoded as words"))
    new = packing._new_pieces
    monkeypatch.setattr(packing, "_new_pieces", lambda units, start, width, t: calls.append(len(start)) or new(units, start, width, t))
    want = _plain_ids(rows)
    assert _ids(rows) == want and _ids(rows[::-1]) == want[::-1]
    assert len(calls) == 1 and calls[0] < 60
    packing._forget()


def test_packing_odd_texts(monkeypatch):
    """All characters, invalid bytes, ends of rows, marks that compose, control strings; also when little is kept."""
    characters = [chr(c) for c in range(0x3000)]
    rows = characters + [f"a{c}b {c}{c}1{c}'{c}s" for c in characters] + [b"\xc3", b"\xa9", b"a\xe6\xbc b", b"\xff\xfe x", b"ok \xed\xa0\x80z", b"", b"\xf0\x9f\x98 q"]
    assert _ids(rows) == _plain_ids(rows)
    assert _ids([]) == [] and _ids([" ", ""]) == [[2], [2]]
    rng, some = random.Random(7), [*"'''sStTrReEvVmMlLdD  \n1289.,!éÉßİıǰȺ\x85\xa0\x1c\x00", "\u0301", "\u0307", "漢", "😀", "ª", "²", "’", "K", "ſ", "각", "ᄀ", "ᅡ", "<|endoftext|>", "<|ENDOFTEXT|>", "<|"]
    monkeypatch.setattr(packing, "CACHED_PIECES", 50)
    monkeypatch.setattr(packing, "CACHED_WORDS", 20)
    for _ in range(60):
        rows = ["".join(rng.choice(some) for _ in range(rng.randrange(40))) for _ in range(30)]
        assert _ids(rows) == _plain_ids(rows)
    packing._forget()


def test_media(spark, docs, empty, texts):
    out = {r.doc_id: r for r in media.media_features(media.read_archives(spark, media.write_archives(docs))).collect()}
    for i, t in texts.items():
        raw = (t or "").encode()
        want = raw + b"\0" * (64 if not raw else -len(raw) % 64)
        assert (out[i].n_bytes, out[i].payload_bytes, out[i].payload_sha256, out[i].tail_crc32) == (len(raw), len(want), hashlib.sha256(want).hexdigest(), zlib.crc32(want[-64:]))
    assert media.read_archives(spark, media.write_archives(empty)).count() == 0
    with pytest.raises(ValueError):
        media.decode_png(media.encode_png(b"x" * 64, 64)[:-20] + b"0" * 20)
    calls = []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return 5

    assert media.retried(flaky, pause=0) == 5


def test_personal_data(docs, empty):
    rng = random.Random(8)
    for _ in range(500):
        x = "".join(rng.choice("ab.@-9 ") for _ in range(40))
        assert pii.emails(x) == [m.span() for m in pii.EMAIL.finditer(x)]
    x = "é a.b@c.de, 10.0.0.256 and 1.2.3.4 or 4111 1111 1111 1111 or +1 (415) 555-2671 or 4111111111111112"
    got = {k: [x[a:b] for a, b in v] for k, v in pii.base_spans(x).items()}
    assert got == {"email": ["a.b@c.de"], "ip": ["1.2.3.4"], "card": ["4111 1111 1111 1111"], "phone": ["+1 (415) 555-2671"]}
    for x in ["1" * 300_000, "1." * 100_000, "1" * 200_000 + "..1.1.1.1", "+1" + "(" * 300_000, "a@" * 100_000, "x" * 300_000 + "@", "1 " * 200_000, "@" + "a" * 300_000]:
        began = time.time()
        pii.base_spans(x)
        assert time.time() - began < 5
    right = total = 0
    emit, move = pii.train()
    for text, marks in pii.LABELLED:
        data = np.frombuffer(text.encode(), np.uint8)
        a, b = pii.word_bounds(data, np.array([0, len(data)]))
        labels = pii.Decoder(emit, move).words(pii.shapes(data, a, b), np.zeros(len(a), int))
        right += sum(pii.LABELS[k] == marks.get(i, "O") for i, k in enumerate(labels))
        total += len(a)
    assert right >= 0.98 * total
    score, length = np.random.default_rng(3).normal(size=(20, 5, 3)), np.array([1, 2, 3, 4, 5] * 4)
    for row, n, path in zip(score, length, pii.viterbi(score, move, length)):
        best = max(np.ndindex(*(3,) * n), key=lambda p: sum(row[t, k] for t, k in enumerate(p)) + sum(move[a, b] for a, b in zip(p, p[1:])))
        assert tuple(path[:n]) == best
    assert pii.personal_data(docs).filter("n_email + n_ip + n_card + n_phone > 0").count() == 0
    assert pii.personal_data(empty).count() == 0


def base_by_patterns(text):
    """The base kinds by the plain patterns."""
    out = [("email", m.span()) for m in pii.EMAIL.finditer(text)]
    out += [("ip", m.span()) for m in pii.IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    for m in pii.CARD.finditer(text):
        digits = [int(c) for c in m.group() if c.isdigit()]
        twice = [2 * d - 9 * (d > 4) if k % 2 else d for k, d in enumerate(reversed(digits))]
        out += [("card", m.span())] * (13 <= len(digits) <= 19 and sum(twice) % 10 == 0)
    out += [("phone", m.span()) for m in pii.PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m.group()) <= 15]
    return [f"{k}:{a}:{b}" for k, (a, b) in out]


def test_personal_data_against_patterns(spark):
    rng = random.Random(21)
    pieces = ["a.b@c.de", "1.2.3.4", "1.2.3.4.5.6.7.8.9", "256.1.1.1", "007.0255.1.1", "4111 1111 1111 1111", "4111-1111-1111-1111", "5500005555555559", "+1 (415) 555-2671", "+44", "..", " ", "-", "@", "é", "12", "3", "漢", "\n", "x"]
    rows = [(k, "".join(rng.choice(pieces) for _ in range(rng.randrange(30)))) for k in range(400)]
    rows += [(400, None), (401, ""), (402, (rows[1][1] + " ") * 20_000), (402, rows[0][1]), (None, rows[2][1])]
    got = spark.createDataFrame(rows, "doc_id long, text string").transform(pii.personal_data).collect()
    want = sorted((str(i), ",".join(base_by_patterns(t or ""))) for i, t in rows)
    assert sorted((str(r.doc_id), r.base) for r in got) == want
    assert all(r.spans.startswith(r.base) and (r.n_email, r.n_ip, r.n_card, r.n_phone) == tuple(r.base.count(k + ":") for k in pii.BASE) for r in got)


def test_repeated_and_null_ids(spark, texts):
    """Rows that share a doc_id are documents of their own, null first."""
    some = [(None, texts[8]), (4, texts[8] + " and more"), (4, texts[8] + " and more"), (5, "unlike all others"), (5, None)]
    df = spark.createDataFrame(some, "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_bytes, len(r.kept)) for r in suffix_dedup.remove_repeats(df).collect()), key=str)
    n, m = len(texts[8]), len(some[1][1])
    # the second of equal rows goes whole, the first but for the part that no window before covers
    assert got == sorted([(None, n, n), (4, m, m - n), (4, m, 0), (5, 17, 17), (5, 0, 0)], key=str)
    near = sorted(((r.doc_id, r.component_id, r.kept) for r in near_dedup.near_duplicates(df).collect()), key=str)
    assert near == sorted([(None, None, True), (4, None, False), (4, None, False), (5, 5, True), (5, 5, True)], key=str)


def test_quality_on_labels(spark):
    """Held against the labels, which no fit sees; documents with words that all labellers abstain on are scored too."""
    sf = "/root/testdata/sf0.01"
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    got = {r.doc_id: r for r in quality.classify(spark.read.parquet(f"{sf}/documents.parquet")).collect()}
    low, good = ([i for i, q in labels.items() if q == k and i in got] for k in (0, 1))
    assert sum(not got[i].kept for i in low) >= 0.9 * len(low) and sum(got[i].kept for i in good) >= 0.99 * len(good)
    blank = {r.doc_id for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if not (r.text or "").split()}
    assert {i for i, r in got.items() if r.p_bad is None} == blank


def test_quality(spark, empty):
    rng = random.Random(6)
    good = [". ".join(prose(rng, 9).capitalize() for _ in range(12)) + "." for _ in range(60)]
    bad = ["!! ".join(prose(rng, 30).upper().split()) for _ in range(8)] + [" ".join(w + "$$$" for w in prose(rng, 40).split()) for _ in range(8)] + [" | ".join(prose(rng, 40).split()) for _ in range(8)] + ["same " * 80] * 4
    good = ["".join(c for c in t if not c.isdigit()) for t in good]
    rows = [(i, t) for i, t in enumerate(good + bad + [None, "", " "])]
    got = {r.doc_id: r for r in quality.classify(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i].kept for i in range(len(good))) and got[len(rows) - 1].p_bad is None and got[len(rows) - 3].kept
    assert sum(not got[len(good) + k].kept for k in range(len(bad))) >= 0.8 * len(bad)
    assert quality.classify(empty).count() == 0


def test_a_piece_of_a_word_is_one_piece_by_itself():
    """So pieces that are known need no split; they outlast more words than a task keeps."""
    rng = random.Random(2)
    for _ in range(2000):
        word = "".join(rng.choice("'stremlvd1!?-é") for _ in range(rng.randrange(9)))
        assert all(packing._SPLIT.findall(x) == [x] for x in packing._SPLIT.findall(word))
    assert packing.CACHED_PIECES > packing.CACHED_WORDS


def test_distances_by_bounds(monkeypatch):
    """Lines with other words, and lines of other characters, are told apart without a distance; the answers are those of the plain one."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzé") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    rows = [""]
    for n in (1, 3, 9, 30, 120):
        for _ in range(6):
            words = rng.choices(vocabulary, k=n)
            rows.append(" ".join(words))
            words[rng.randrange(n)] = rng.choice(vocabulary)
            rows.append(" ".join(words[1:] + ["new"] if n > 3 else words))
            rows.append(rows[-1].replace("a", "e", 2) + "x")
    i, j = (np.array(c) for c in zip(*((a, b) for a in range(len(rows)) for b in range(len(rows))), strict=True))
    limit = np.array([0.2 * max(len(rows[a]), len(rows[b])) + 1e-9 for a, b in zip(i, j, strict=True)])
    want = np.array([lines.edit_distance(rows[a], rows[b]) <= k for a, b, k in zip(i, j, limit, strict=True)])
    for hashed in (edits.HASHED, 50):
        monkeypatch.setattr(edits, "HASHED", hashed)
        texts = edits.Texts(rows)
        assert (texts.within(i, j, limit) == want).all()
        typed = texts._typed(i, j, limit)
        assert not (typed & ~want).any() and typed.sum() > 0.5 * want.sum()
        assert not ((texts._unlike(i, j) > limit) & want).any()
    monkeypatch.setattr(edits.Texts, "_near", None)
    base = " ".join(vocabulary[:40])
    pair = edits.Texts([base, base.replace(vocabulary[3], "other").replace(vocabulary[30], ""), "0123456789" * (len(base) // 10)])
    assert pair.within(np.array([0, 0]), np.array([1, 2]), np.array([0.2 * len(base)] * 2)).tolist() == [True, False]


def test_connected_pairs_are_not_compared():
    """Of the pairs of a clique few are compared before the rest is known to be connected; pairs that are no links are all compared."""
    n, asked = 60, []
    i, j = np.triu_indices(n, 1)

    def same(a, b):
        asked.extend(zip(a.tolist(), b.tolist(), strict=True))
        return a % 2 == b % 2

    assert len(links.spanning_many(list(range(n)), list(range(n)), [(i, j)], lambda a, b: (same(a, b) | True))) == n - 1 and len(asked) < 2 * n
    asked.clear()
    got = links.spanning_many(list(range(n)), list(range(n)), [(i, j)], same)
    assert sorted(got) == sorted([(k, k % 2) for k in range(2, n)])
    assert {(a, b) for a, b in zip(i.tolist(), j.tolist(), strict=True) if a % 2 != b % 2} <= set(asked) and len(asked) == len(set(asked))


def test_large_sets_are_dealt_by_both_ends(spark, monkeypatch):
    """A set of many pairs is confirmed in blocks; its links are those of the whole set."""
    rng = random.Random(6)
    words = [f"word{k}" for k in range(12)]
    rows = [" ".join(words[:k] + [f"x{rng.randrange(99)}"] + words[k + 1 :]) for k in rng.choices(range(12), k=40)]
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    want = sorted(lines.dedup_lines(docs).select("doc_id", "kept").collect())
    monkeypatch.setattr(links, "DEALT", 3)
    assert sorted(lines.dedup_lines(docs).select("doc_id", "kept").collect()) == want
    assert sum(r.kept == "" for r in want) > 20
