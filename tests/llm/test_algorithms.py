"""Problems 2, 3, 5, 7, 8 and 9 against brute force, and the edges."""

import random
import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from sievewright.llm import mixing, near_records, queries, ranking, together, tokenizer, vectors
from sievewright.llm.common import vocabulary_path
from sievewright.llm.graph import components

from ..conftest import DATA

# ------------------------------------------------------------------ problem 2

COMMENT = "ord bigint, file_path string, line bigint, message string, words string, rep int"


def linked(rows, window=15):
    """The pairs of all sets, by comparing everything."""
    seen = {}
    for o, f, ln, m, *_ in rows:
        if None in (o, f, ln, m):
            continue
        words = frozenset(re.findall("[a-z0-9_]+", m.lower()))
        if words and f.split("/")[-1]:
            seen[o] = (f.split("/")[-1], ln, words)
    parent = {o: o for o in seen}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(seen, 2):
        (fa, la, wa), (fb, lb, wb) = seen[a], seen[b]
        if fa == fb and abs(la - lb) <= window and 5 * len(wa & wb) >= 3 * len(wa | wb):
            parent[find(a)] = find(b)
    groups = defaultdict(list)
    for o in seen:
        groups[find(o)].append(o)
    return {(min(p), max(p)) for g in groups.values() for p in combinations(g, 2)}


def p2(spark, rows, **how):
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], COMMENT)
    return {tuple(r) for r in near_records.group_pairs(near_records.near_groups(df, **how)).collect()}


def some_comments(n, files, seed, vocab=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocab)]
    rows, base = [], [[rng.choice(words) for _ in range(12)] for _ in range(n // 6)]
    for o in range(n):
        b = list(rng.choice(base))
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = rng.choice(words)
        rows.append((o, f"d{rng.randrange(3)}/{rng.choice(files)}", rng.randrange(40), " ".join(b)))
    return rows


def test_p2_against_brute_force(spark):
    rows = some_comments(300, ["a.py", "b.py"], 1)
    assert p2(spark, rows) == linked(rows)


def test_p2_hot_node_branches_and_blocks(spark):
    rows = some_comments(400, ["hot.py"], 2)
    want = linked(rows)
    assert p2(spark, rows, node_size=16, trees=8, branch=3.0, depth=2) == want
    assert p2(spark, rows, node_size=16, depth=0) == want  # everything large in blocks


def test_p2_branches_at_the_defaults(spark):
    rows = some_comments(900, ["hot.py"], 4, vocab=400)
    trace, df = [], spark.createDataFrame([(*r, "x", 1) for r in rows], COMMENT)
    got = {tuple(r) for r in near_records.group_pairs(near_records.near_groups(df, trace=trace), stretch=7).collect()}
    assert len(trace) > 1 and trace[1][1] > 1 and trace[0][3] > 24
    want = linked(rows)
    assert len(got & want) >= 0.99 * len(want) and got <= want


def test_p2_near_copies_in_one_place(spark):
    rows = [(i, "a.py", 5, " ".join(f"w{j}" for j in range(20) if j != i % 20) + f" x{i}") for i in range(3000)]
    trace, df = [], spark.createDataFrame([(*r, "x", 1) for r in rows], COMMENT)
    got = near_records.near_groups(df, trace=trace).collect()
    assert len(got) == 3000 and {r.group_id for r in got} == {0} and {r.n_links for r in got} == {2999}


def test_p2_copies_and_edges(spark):
    copies = [(i, "x/a.py", 5, "The same, the SAME words_1 here") for i in range(50)]
    odd = [(100, None, 5, "the same words_1 here"), (101, "a.py", None, "the same words_1 here"), (102, "a.py", 5, "!!!"), (103, "a.py", 5, ""), (104, "a.py", 5, None), (105, "dir/", 5, "the same words_1 here"), (None, "a.py", 5, "the same words_1 here"), (3, "x/a.py", 5, "The same, the SAME words_1 here")]
    got = p2(spark, copies + odd)
    assert got == set(combinations(range(50), 2))
    assert p2(spark, []) == set()
    assert p2(spark, [(1, "a", 0, "a b c"), (2, "z/a", 15, "c b a"), (3, "a", 31, "a b c"), (4, "a", -20, "a b c")]) == {(1, 2)}
    long = " ".join(f"t{i}" for i in range(20_000))
    assert p2(spark, [(1, "a", 0, long), (2, "a", 1, long + " more")]) == {(1, 2)}
    chain = [(i, "a", 15 * i, "same text here") for i in range(12)]
    assert p2(spark, chain) == set(combinations(range(12), 2))  # through others


def test_p2_groups_have_links(spark):
    df = spark.createDataFrame([(1, "a", 0, "a b c d e", "", 0), (2, "a", 1, "a b c d f", "", 0), (3, "a", 2, "z y x w v", "", 0), (4, "a", 0, "a b c d e", "", 0)], COMMENT)
    got = {r.ord: (r.group_id, r.n_links) for r in near_records.near_groups(df).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 4: (1, 1)}


def test_p2_keeps_words_once(spark, monkeypatch):
    rows, kept = some_comments(900, ["hot.py"], 4, vocab=400), []

    def cut(df, really=near_records.cut):
        out = really(df)
        kept.append(out.count() if "toks" in df.columns else 0)
        return out

    monkeypatch.setattr(near_records, "cut", cut)
    trace, df = [], spark.createDataFrame([(*r, "x", 1) for r in rows], COMMENT)
    near_records.near_groups(df, trace=trace).collect()
    assert len(trace) > 2 and sum(kept) <= len(rows)  # nodes branch, and no record is written again for that


def test_p2_large_nodes_branch_over_tasks(spark):
    rows = some_comments(400, ["hot.py"], 2)
    want = linked(rows)
    assert p2(spark, rows, node_size=16, trees=8, branch=3.0, gather=100) == want
    assert p2(spark, rows, node_size=16, depth=0, gather=100, block=64) == want


def test_p2_nodes_over_several_batches():
    rng = np.random.default_rng(1)
    n = 600
    node = np.sort(rng.integers(0, 12, n))
    toks = [rng.choice(60, 12, replace=False).astype(np.int64) * 7919 for _ in range(n)]
    toks = [toks[i - 1] if i % 3 == 0 and i else toks[i] for i in range(n)]
    t = pa.table({"tree": np.zeros(n, np.int32), "node": node, "rep": np.arange(n), "line": np.full(n, 3), "toks": pa.array(toks, pa.list_(pa.int64())), "path": pa.array([[]] * n, pa.list_(pa.int64()))})
    how = {"window": 15, "num": 3, "den": 5, "least": 0.6, "node_size": 24, "trees": 4, "branch": 2.0, "depth": 2, "pays": 3.0}
    got = [
        sorted((r["a"], r["b"]) for b in near_records._in_task(0, how | {"rows": rows}, False)(iter(t.to_batches(max_chunksize=7))) for r in b.to_pylist())
        for rows in (1, 100, 10_000)
    ]
    sets = [set(x.tolist()) for x in toks]
    want = [(a, b) for a, b in combinations(range(n), 2) if node[a] == node[b] and 5 * len(sets[a] & sets[b]) >= 3 * len(sets[a] | sets[b])]
    assert got[0] == got[1] == got[2] and set(got[0]) <= set(want) and len(got[0]) >= 0.99 * len(want) > 100


def test_components(spark):
    rng = random.Random(3)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5, 5)] + [(2000, 2001 + i) for i in range(200)]
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((find(a), find(b)))
            parent[y] = x
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {x: find(x) for x in parent}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# ------------------------------------------------------------------ problem 3

CHUNK = "chunk_id bigint, content_hash string, embedding array<float>, point int, vec string"


def test_p3_recall_against_brute_force(spark):
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((60, 64))
    x = (centres[rng.integers(0, 60, 1500)] + 0.35 * rng.standard_normal((1500, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, f"h{i}", v.tolist(), 0, "") for i, v in enumerate(x)], CHUNK)
    got = defaultdict(dict)
    for r in vectors.neighbours(vectors.contents(df), least=64).collect():
        got[r.id][r.other] = r.sim
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    hits = sum(len(set(best[i].tolist()) & set(got[i])) for i in range(1500))
    assert hits / (1500 * 5) >= 0.9
    assert all(len(v) == 5 for v in got.values()) and all(abs(s[i, j] - v) < 1e-6 for i, d in got.items() for j, v in d.items())


def test_p3_does_not_depend_on_the_number_of_partitions(spark):
    rng = np.random.default_rng(6)
    df = spark.createDataFrame([(i, f"h{i}", v.tolist(), 0, "") for i, v in enumerate(rng.standard_normal((250, 64)))], CHUNK)
    few, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for n in ("1", "4", "200"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            few.append({(r.id, r.other, r.place) for r in vectors.neighbours(vectors.contents(df)).collect()})
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    x = np.array([r.embedding for r in df.orderBy("chunk_id").collect()])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = x @ x.T - 3 * np.eye(250)
    assert few[0] == few[1] == few[2]  # least is 256, so every node is the whole tree
    assert few[2] == {(i, int(j), k + 1) for i in range(250) for k, j in enumerate(np.argsort(-s[i])[:5])}


def test_p3_recall_at_the_defaults_and_any_number_of_partitions(spark):
    rng = np.random.default_rng(9)
    n = 4000
    x = (rng.standard_normal((100, 64))[rng.integers(0, 100, n)] + 0.4 * rng.standard_normal((n, 64))).astype(np.float32)
    df = spark.createDataFrame([(i, f"h{i}", v.tolist(), 0, "") for i, v in enumerate(x)], CHUNK)
    u = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    s = u @ u.T - 3 * np.eye(n)
    best = np.argsort(-s, axis=1)[:, :5]
    recall, was = [], spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for parts in ("4", "200", "1000"):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = defaultdict(set)
            for r in vectors.neighbours(vectors.contents(df)).collect():
                got[r.id].add(r.other)
            recall.append(sum(len(set(best[i].tolist()) & got[i]) for i in range(n)) / (5 * n))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)
    assert min(recall) >= 0.95 and max(recall) - min(recall) <= 0.005, recall


def test_p3_rows_that_no_direction_tells_apart():
    x = np.ones((600, 8)) / 8**0.5
    x[:, 0] += np.arange(600) * 1e-12
    ids = np.arange(600)
    got, sims = vectors._node(x, ids, np.zeros(600, np.uint64), 8, 3, 16, 64)
    assert (got >= 0).all() and (np.abs(sims - 1) < 1e-6).all() and all(i not in row for i, row in enumerate(got.tolist()))


def test_p3_ranges_are_nodes():
    rng = np.random.default_rng(7)
    code = np.sort(rng.integers(0, 1 << 48, 5000) >> rng.integers(0, 20, 5000)).astype(np.uint64)
    first = (code >> np.uint64(48 - vectors.RANGE_BITS)).astype(int)
    parts = vectors._ranges({(0, int(p)): int((first == p).sum()) for p in np.unique(first)}, 1, 40, 300)
    part = np.array([parts[0, int(p)] for p in first])
    assert len(set(part.tolist())) > 5
    lo, hi = vectors._ascend(code, 48, 40)
    for one in np.unique(part):
        at = np.flatnonzero(part == one)
        a, b = vectors._ascend(code[at], 48, 40)
        assert (a + at[0] == lo[at]).all() and (b + at[0] == hi[at]).all()


def test_p3_equal_vectors_and_edges(spark):
    e = [1.0] + [0.0] * 63
    f = [0.6, 0.8] + [0.0] * 62
    nan, zero = [float("nan")] * 64, [0.0] * 64
    rows = [(10 + i, f"h{i}", e, 0, "") for i in range(9)] + [(10, "h0", e, 0, ""), (5, "h0", None, 0, ""), (40, "f", f, 0, ""), (41, "n", nan, 0, ""), (42, "z", zero, 0, ""), (43, "s", [1.0], 0, ""), (44, "m", [], 0, ""), (45, None, e, 0, ""), (None, "q", e, 0, ""), (46, "i", [float("inf")] + [0.0] * 63, 0, "")]
    near = vectors.neighbours(vectors.contents(spark.createDataFrame(rows, CHUNK))).collect()
    got = defaultdict(list)
    for r in sorted(near, key=lambda r: (r.id, r.place)):
        got[r.id].append((r.other, round(r.sim, 6)))
    assert set(got) == {5, *range(11, 19), 40}
    assert got[5] == [(i, 1.0) for i in range(11, 16)] and got[18] == [(5, 1.0)] + [(i, 1.0) for i in range(11, 15)]
    assert got[40] == [(i, 0.6) for i in (5, 11, 12, 13, 14)]
    assert vectors.neighbours(vectors.contents(spark.createDataFrame([], CHUNK))).count() == 0
    assert vectors.neighbours(vectors.contents(spark.createDataFrame([rows[0]], CHUNK))).count() == 0


def test_p3_hot_node():
    """Thousands of vectors with the same hash string: longer strings tell them apart."""
    rng = np.random.default_rng(2)
    spread = rng.standard_normal((300, 64))
    x = 5 * rng.standard_normal(64) + 1e-3 * (spread[rng.integers(0, 300, 6000)] + 0.2 * rng.standard_normal((6000, 64)))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got_i, got_s = vectors._node(x, np.arange(6000), np.zeros(6000, np.uint64), 48, 5, 64, 512)
    s = x @ x.T
    np.fill_diagonal(s, -2)
    best = np.argsort(-s, axis=1)[:, :5]
    assert np.mean([len(set(a) & set(b)) / 5 for a, b in zip(best.tolist(), got_i.tolist())]) > 0.5  # one tree alone
    assert np.isfinite(got_s).all() and (np.diff(got_s, axis=1) <= 1e-12).all()


def test_p3_ascent():
    code = np.sort(np.random.default_rng(1).integers(0, 2**20, 500)).astype(np.uint64)
    lo, hi = vectors._ascend(code, 20, 20)
    for i in range(500):
        assert lo[i] <= i < hi[i] and hi[i] - lo[i] >= 20
        same = [d for d in range(21) if (code >> np.uint64(20 - d) == code[i] >> np.uint64(20 - d)).sum() >= 20]
        assert hi[i] - lo[i] == (code >> np.uint64(20 - max(same)) == code[i] >> np.uint64(20 - max(same))).sum()


# ------------------------------------------------------------------ problem 5

HIT = "query_id bigint, source string, hit_rank int, chunk_id bigint, score double, points int"


def test_p5_ranks_ties_and_edges(spark):
    nan = float("nan")
    rows = [
        (1, "a", 1, 10, 9.0, 0), (1, "a", 2, 11, 5.0, 0), (1, "a", None, 12, 5.0, 0), (1, "a", 4, 13, 1.0, 0), (1, "a", 1, 10, 9.0, 0), (1, "b", 1, 12, 1e9, 0), (1, "b", 2, 13, float("inf"), 0),
        (1, "b", 3, 99, 5.0, 0), (1, "b", 4, 11, nan, 0), (1, "b", 5, 11, None, 0), (None, "a", 1, 10, 1.0, 0), (1, None, 1, 10, 1.0, 0), (1, "c", 1, None, 1.0, 0), (2, "a", 1, 11, 3.0, 0), (2, "a", 2, 10, 3.0, 0),
    ]
    hits = spark.createDataFrame(rows, HIT)
    chunks = spark.createDataFrame([(i, 0) for i in (10, 11, 12, 13)] + [(None, 0), (10, 1)], "chunk_id bigint, score int")
    got = {(r.query_id, r.chunk_id): (round(r.points, 6), r.n_lists) for r in ranking.borda(hits, chunks).collect()}
    assert got == {(1, 10): (1.0, 1), (1, 11): (0.625, 1), (1, 12): (0.625 + 0.5, 2), (1, 13): (0.25 + 1.0, 2), (2, 10): (0.75, 1), (2, 11): (0.75, 1)}
    wanted = spark.createDataFrame([(1, 2), (1, 2), (2, 1), (3, 4), (None, 2)], "query_id bigint, n_wanted int")
    top = ranking.top_wanted(ranking.borda(hits, chunks), wanted).orderBy("query_id", "place").collect()
    assert [(r.query_id, r.chunk_id) for r in top] == [(1, 13), (1, 12), (2, 10)]
    assert ranking.top_wanted(ranking.borda(hits.limit(0), chunks), wanted.limit(0)).count() == 0
    weighted = ranking.borda(hits, chunks, spark.createDataFrame([("b", 3.0)], "source string, weight double"))
    assert round({r.chunk_id: r.points for r in weighted.where("query_id = 1").collect()}[13], 6) == 3.25


def test_p5_hot_list_against_brute_force(spark):
    rng = random.Random(4)
    rows = [(1, "hot", None, i, float(rng.randrange(200)), 0) for i in range(3000)]
    hits, chunks = spark.createDataFrame(rows, HIT), spark.range(3000).withColumnRenamed("id", "chunk_id")
    n = Counter(r[4] for r in rows)
    above = {s: sum(c for t, c in n.items() if t > s) for s in n}
    got = {r.chunk_id: r.points for r in ranking.borda(hits, chunks).collect()}
    assert all(abs(got[r[3]] - (3001 - (above[r[4]] + (n[r[4]] + 1) / 2)) / 3000) < 1e-6 for r in rows)


# ------------------------------------------------------------------ problem 7

@pytest.mark.parametrize("heavy", [0, 3, 1000])
def test_p7_against_brute_force(spark, heavy):
    rng = random.Random(heavy)
    baskets = {f"c{i}": {f"p{min(rng.randrange(40), rng.randrange(40))}" for _ in range(rng.randrange(1, 8))} | ({"hot"} if i % 2 else set()) for i in range(400)}
    rows = [(c, p, 1) for c, ps in baskets.items() for p in ps]
    rows += rows[:50] + [("c1", None, 1), ("c1", "", 1), (None, "p1", 1), ("gone", "p1", 1), ("gone", "p2", 1)] + [("wide", f"p{i}", 1) for i in range(30)]
    changes = spark.createDataFrame([(*r[:2], 0, 0) for r in rows], "commit_id string, path string, n int, co int")
    commits = spark.createDataFrame([(c, f"r{int(c[1:]) % 2}", 0) for c in baskets] + [("wide", "r0", 0), ("c1", "r1", 1), (None, "r0", 0), ("x", None, 0)], "commit_id string, repo string, n int")
    want = Counter()
    for c, ps in baskets.items():
        for a, b in combinations(sorted(ps), 2):
            want[f"r{int(c[1:]) % 2}", a, b] += 1
    base = together.baskets_of(changes, commits)
    got = {(r.repo, r.path_a, r.path_b): r.co for r in together.pair_counts(base, together.item_counts(base), 5, heavy).collect()}
    assert got == {k: v for k, v in want.items() if v >= 5}
    single = {(r.repo, r.path): r.c for r in together.item_counts(base).collect()}
    n = Counter(f"r{int(c[1:]) % 2}" for c in baskets)
    full = {(r.repo, r.path_a, r.path_b) for r in together.together(changes, commits, min_lift=1.2).collect()}
    assert full == {k for k, v in want.items() if v >= 5 and v * n[k[0]] >= 1.2 * single[k[0], k[1]] * single[k[0], k[2]]}


def test_p7_empty_and_bytes(spark):
    changes = spark.createDataFrame([(f"c{i}", p) for i in range(6) for p in ("a-b", "a/b", "é", "z")], "commit_id string, path string")
    commits = spark.createDataFrame([(f"c{i}", "r") for i in range(6)], "commit_id string, repo string")
    got = {(r.path_a, r.path_b) for r in together.together(changes, commits, min_lift=0.5).collect()}
    assert got == {("a-b", "a/b"), ("a-b", "z"), ("a-b", "é"), ("a/b", "z"), ("a/b", "é"), ("z", "é")}
    assert together.together(changes.limit(0), commits).count() == 0 and together.together(changes, commits.limit(0)).count() == 0


# ------------------------------------------------------------------ problem 8

@pytest.fixture(scope="module")
def auto():
    path = vocabulary_path("byte_bpe_50k.json")
    return tokenizer.automaton(path)


@pytest.fixture(scope="module")
def reference_encoding():
    tokenizers = pytest.importorskip("tokenizers")
    tok = tokenizers.Tokenizer.from_file(vocabulary_path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    return lambda texts: [e.ids for e in tok.encode_batch(texts, add_special_tokens=False)]


ODD = [
    "a" * 3000, "aaa" * 7, "é" * 300, " " * 500, "\n" * 77 + "a", "日本語テキスト" * 60, "<|endoftext|> hi", "🚀👩‍👩‍👧 x", "½²Ⅷ 12 3", "'s't're x'LL don't", "".join(map(chr, range(1, 700))), "\t x\r\n y  ", "\x00\x01", "snake_case_name camelCaseName", "x=1;//y", "Ａ１", "naïve café​",
]


def test_p8_equals_the_library(auto, reference_encoding):
    a, split = auto
    got = [a.encode_words(split(t)) for t in ODD]
    assert got == reference_encoding(ODD)
    assert [a.decode(g) for g in got] == ODD


def test_p8_random_texts(auto, reference_encoding):
    a, split = auto
    rng = random.Random(8)
    parts = [t.decode() for t in rng.sample([t for t in a.tokens if t], 8000) if t.decode("utf-8", "ignore").encode() == t]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 6))) for _ in range(3000)]
    assert [a.encode_words(split(t)) for t in texts] == reference_encoding(texts)


def test_p8_vocabulary_forms_agree():
    a = tokenizer.load_vocabulary(vocabulary_path("byte_bpe_50k.json"))
    b = tokenizer.load_vocabulary(vocabulary_path("byte_bpe_50k.tiktoken"))
    assert a[1] == b[1] and a[0][:50256] == b[0][:50256]
    assert tokenizer.unpack(tokenizer.pack(*a)) == a


def test_p8_small_gadgets():
    """All strings over two letters against merging in list order."""
    letters = [b"a", b"b", b"aa", b"ab", b"aab", b"ba", b"aaaa"]
    merges = [(0, 0, 2), (0, 1, 3), (2, 1, 4), (1, 0, 5), (2, 2, 6)]
    a = tokenizer.Automaton(letters, merges)

    def merged(w):
        parts = [0 if c == 97 else 1 for c in w]
        for x, y, made in merges:
            i, out = 0, []
            while i < len(parts):
                if parts[i:i + 2] == [x, y]:
                    out.append(made)
                    i += 2
                else:
                    out.append(parts[i])
                    i += 1
            parts = out
        return tuple(parts)

    for n in range(1, 11):
        for k in range(2**n):
            w = bytes(97 + (k >> i & 1) for i in range(n))
            if w not in a.ids:
                assert a.encode_word(w) == merged(w), w


def test_p8_table(spark, auto):
    df = spark.createDataFrame([(1, "hello world", [0]), (2, "", [0]), (3, None, [0]), (None, "x", [0])], "doc_id bigint, text string, ids array<int>")
    got = {r.doc_id: r.ids for r in tokenizer.encoded(df).collect()}
    a, split = auto
    assert got == {1: a.encode_words(split("hello world")), 2: [], 3: [], None: a.encode_words(["x"])}
    assert tokenizer.encoded(df.limit(0)).count() == 0
    assert {r.doc_id: r.n_tokens for r in tokenizer.counted(df).collect()} == {k: len(v) for k, v in got.items()}


# ------------------------------------------------------------------ problem 9

DOC = "doc_id bigint, text string, source string, n_tokens int, copies int"
TARGET = "source string, target_share double, max_repeats int"


def test_p9_shares(spark):
    rows = [(i, "word " * (1 + i % 9), s, 0, 0) for i, s in enumerate(["web"] * 3000 + ["Wiki-Pages "] * 400 + ["code"] * 200 + ["none"] * 50)] + [(9000, None, "web", 0, 0), (9001, "", "web", 0, 0), (9002, "x", None, 0, 0), (None, "x", "web", 0, 0)]
    docs = spark.createDataFrame(rows, DOC)
    targets = spark.createDataFrame([("web", 0.5, 1), ("wiki_pages", 0.3, 3), ("code", 0.1, 2), ("absent", 0.1, 4)], TARGET)
    copies, report = mixing.mixture(docs, targets)
    got = {r.source: r for r in report.collect()}
    absent = got.pop("absent")  # a target without tokens is reported too
    assert (absent.tokens, absent.tokens_drawn, absent.rate, absent.share_reached) == (0, 0, 0.0, 0.0)
    assert set(got) == {"web", "wiki_pages", "code"} and all(r.rate <= r.max_repeats for r in got.values())
    assert max(r.rate / r.max_repeats for r in got.values()) == pytest.approx(1.0)
    for r in got.values():
        assert r.share_reached == pytest.approx(r.target_share / 0.9, abs=0.03)
    each = Counter(r.doc_id for r in copies.collect())
    assert all(v <= 3 for v in each.values()) and 9000 not in each and 9002 not in each
    assert sum(r.n_tokens for r in copies.where("source = 'code'").collect()) == got["code"].tokens_drawn
    again = mixing.mixture(docs.repartition(7), targets)[0]
    assert sorted(map(tuple, again.select("doc_id", "copy").collect())) == sorted(map(tuple, copies.select("doc_id", "copy").collect()))


def test_p9_fixed_total_and_empty(spark):
    docs = spark.createDataFrame([(i, "word " * 4, "a" if i < 100 else "b", 0, 0) for i in range(1100)], DOC)
    targets = spark.createDataFrame([("A", 0.5, 2), ("b", 0.5, 1)], TARGET)
    sizes = mixing.sized(docs)
    rate = {r.source: r for r in mixing.rates(sizes, targets, 3000).collect()}
    assert rate["a"].rate == 2.0 and rate["b"].rate == pytest.approx((3000 - 2 * rate["a"].tokens) / rate["b"].tokens)
    copies, report = mixing.mixture(docs.limit(0), targets)
    assert copies.count() == 0 and {(r.source, r.tokens_drawn, r.share_reached) for r in report.collect()} == {("a", 0, 0.0), ("b", 0, 0.0)}
    assert mixing.mixture(docs, targets.limit(0))[1].count() == 0


# ------------------------------------------------------------------ queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(name, compare):
    compare(queries.queries()[name], SQL[name])


@pytest.mark.parametrize("name", sorted(set(queries.queries()) - set(SQL)))
def test_query_runs(name, spark):
    assert queries.queries()[name](spark, f"{DATA}/sf0.001").count() > 0


def test_p5_missing_scores_at_the_middle_rank(spark):
    hits = spark.createDataFrame([(1, "a", k, float(9 - k)) for k in range(1, 6)] + [(1, "b", 5, 0.5), (1, "b", 4, 0.1), (2, "b", 1, 1.0)], "query_id bigint, source string, chunk_id bigint, score double")
    chunks = spark.createDataFrame([(k,) for k in range(1, 6)], "chunk_id bigint")
    got = {(r.query_id, r.chunk_id): (round(r.points, 6), r.n_lists) for r in ranking.borda(hits, chunks, missing="mid").collect()}
    want = {(1, k): ((6 - k) / 5 + {5: 1.0, 4: 0.5}.get(k, 0.75), 2 if k > 3 else 1) for k in range(1, 6)} | {(2, 1): (1.0, 1)}
    assert got == {k: (round(p, 6), n) for k, (p, n) in want.items()}
    with pytest.raises(ValueError):
        ranking.borda(hits, chunks, missing="last")


def test_p9_reports_every_target(spark):
    docs = spark.createDataFrame([(n, "some words here " * 5, "A-b" if n % 3 else "c") for n in range(300)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a_b", 0.5, 3), ("C", 0.49, 2), ("runbook", 0.01, 4)], "source string, target_share double, max_repeats int")
    rows = {r.source: r for r in mixing.mixture(docs, targets)[1].collect()}
    assert set(rows) == {"a_b", "c", "runbook"} and rows["runbook"].tokens == rows["runbook"].tokens_drawn == 0 and rows["runbook"].rate == 0
    assert rows["c"].binds and not rows["a_b"].binds and rows["c"].tokens_left == 0 and abs(rows["a_b"].share_reached + rows["c"].share_reached - 1) < 1e-9
