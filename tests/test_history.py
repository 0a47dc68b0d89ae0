"""Hotspots, coupling, ownership and bus factor on small histories."""

import random
from collections import Counter, defaultdict

import pytest

from sievewright.operators import history

COMMITS = "commit_id string, repo string, author string, email string, ts bigint"
CHANGES = "commit_id string, path string, lines_added bigint, lines_deleted bigint"


def tables(spark, commits):
    """commits: [(author, {path: (added, deleted)})] of one repo."""
    rows = [(f"c{i}", "r", a, f"{a}@x", 1000 + i) for i, (a, _) in enumerate(commits)]
    files = [(f"c{i}", p, *n) for i, (_, fs) in enumerate(commits) for p, n in fs.items()]
    c, f = spark.createDataFrame(rows, COMMITS), spark.createDataFrame(files, CHANGES)
    return history.clean_changes(f).join(history.clean_commits(c), "commit_id")


def same(*paths):
    return ("alice", {p: (1, 0) for p in paths})


def pairs(spark, commits, **how):
    return [(r.file_a, r.file_b, r.co_changes, round(r.coupling_degree, 6)) for r in history.coupling(tables(spark, commits), **how).collect()]


def test_coupling(spark):
    both = [same("a.rs", "b.rs")] * 3
    assert pairs(spark, both) == [("a.rs", "b.rs", 3, 1.0)]
    assert pairs(spark, [same("a.rs"), same("b.rs")], min_co=1) == []
    third = [same("a.rs", "b.rs"), same("a.rs"), same("a.rs")]
    assert pairs(spark, third, min_coupling=0.3, min_co=1) == [("a.rs", "b.rs", 1, 0.333333)]
    assert pairs(spark, third, min_coupling=0.5, min_co=1) == []
    assert pairs(spark, [same("a.rs", "b.rs")], min_co=2) == []
    assert pairs(spark, [same("z.rs", "a.rs"), same("a.rs", "z.rs")], min_co=2) == [("a.rs", "z.rs", 2, 1.0)]


def test_wide_commits_and_empty_paths_are_left_out(spark):
    rows = [("w", f"f{i}", 1, 0) for i in range(3)] + [("n", "f0", 1, 0), ("n", "f0", 1, 0), ("n", "", 1, 0), ("n", None, 1, 0), (None, "x", 1, 0)]
    kept = history.clean_changes(spark.createDataFrame(rows, CHANGES), max_files=2).collect()
    assert [(r.commit_id, r.path) for r in kept] == [("n", "f0")]


def test_ownership(spark):
    one = history.ownership(tables(spark, [("alice", {"main.rs": (1, 1)})] * 3)).first()
    assert (one.bus_factor, one.is_knowledge_silo, one.dominant_ratio, one.n_authors) == (1, True, 1.0, 1)
    five = history.ownership(tables(spark, [(f"a{i}", {"main.rs": (1, 1)}) for i in range(5)])).first()
    assert (five.bus_factor, five.is_knowledge_silo, round(five.dominant_ratio, 6)) == (5, False, 0.2)
    mixed = history.ownership(tables(spark, [("alice", {"m": (1, 1)})] * 3 + [("bob", {"m": (1, 1)})])).first()
    assert (mixed.dominant_ratio, mixed.is_knowledge_silo, mixed.authors[0].author) == (0.75, False, "alice")


def test_bus_factor_of_three_files(spark):
    rows = tables(spark, [(f"a{i}", {f"f{i}": (1, 0)}) for i in range(3)])
    assert history.bus_factor(rows).first().project_bus_factor == 2
    assert history.bus_factor(rows.limit(0)).count() == 0


def greedy(files):
    """Removing the author with the most files, counted anew each time by the first ranking."""
    entries = Counter(e for authors in files.values() for e in authors)
    order = sorted(entries, key=lambda e: (-entries[e], e))
    main = {f: {e for e, n in authors.items() if n / sum(authors.values()) > 0.1} for f, authors in files.items()}
    gone = set()
    for step, author in enumerate(order, 1):
        gone.add(author)
        if sum(m <= gone for m in main.values()) > len(files) // 2:
            return step
    return len(order)


@pytest.mark.parametrize("seed", range(3))
def test_bus_factor_against_the_loop(spark, seed):
    rng = random.Random(seed)
    files = defaultdict(Counter)
    commits = []
    for i in range(60):
        a, f = f"a{rng.randrange(7)}", f"f{rng.randrange(9)}"
        commits.append((a, {f: (1, 0)}))
        files[f][f"{a}@x"] += 1
    assert history.bus_factor(tables(spark, commits)).first().project_bus_factor == greedy(files)


def test_hotspots(spark):
    rows = tables(spark, [("alice", {"main.rs": (100, 50)}), ("alice", {"main.rs": (80, 40)}), ("alice", {"main.rs": (60, 30)}), ("bob", {"Cargo.toml": (1, 0), "gone.rs": (5, 5)})])
    current = spark.createDataFrame([("r", "main.rs", 100), ("r", "Cargo.toml", 10)], "repo string, path string, loc int")
    got = {r.path: r for r in history.hotspots(rows, current).collect()}
    assert set(got) == {"main.rs", "Cargo.toml"} and got["main.rs"].score > got["Cargo.toml"].score
    assert got["main.rs"].revisions == 3 and got["main.rs"].total_churn == 360
    assert abs(got["main.rs"].score - (0.5 + 0.3 + 0.2)) < 1e-9
    empty = spark.createDataFrame([("r", "main.rs", 0)], "repo string, path string, loc int")
    assert history.hotspots(rows, empty).first().score == 0.5  # no lines anywhere: no size part, no churn relative to it


def test_insights(spark):
    rows = tables(spark, [same("a.rs", "b.rs")] * 3)
    current = spark.createDataFrame([("r", "a.rs", 10), ("r", "b.rs", 5)], "repo string, path string, loc int")
    changed = spark.createDataFrame([("r", "a.rs"), ("r", "b.rs")], "repo string, path string")
    lines = [r.line for r in history.insight_lines(changed, history.hotspots(rows, current), history.coupling(rows), history.ownership(rows)).orderBy("part", "sort_key").collect()]
    assert lines[2] == "- a.rs and b.rs changed together 3 times, a degree of 1.00"
    assert lines[3] == "- a.rs: known to few, 100% of its commits are by alice@x" and len(lines) == 5
