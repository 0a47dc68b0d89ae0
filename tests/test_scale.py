"""Hot keys and long documents: the same results as small ones, and no task that holds them all."""

import io
import json

from pyspark.sql import functions as F

from sievewright.operators import findings, symbols
from sievewright.plans import commands
from sievewright.sources import sinks


def test_patches_of_a_hot_path(spark):
    old = [f"line {i}" for i in range(400)]
    files = spark.createDataFrame([("hot.rs", "\n".join(old) + "\n"), ("b.rs", "x\ny"), ("c.rs", "z\n"), ("e.rs", "")], "path string, content string")
    rows = [(i, "hot.rs", i % 400 + 1, f"new {i}") for i in range(2000)] + [(5000, "b.rs", 2, "y1\ny2"), (5001, "b.rs", 9, "out"), (5002, None, 1, "n"), (5003, "c.rs", None, "n"), (5004, "b.rs", 2, "first"), (5005, "gone.rs", 1, "n"), (5006, "e.rs", 1, "n")]
    comments = spark.createDataFrame(rows, "ord bigint, file_path string, line bigint, patch string")
    got = {r.path: (r.content, r.n_applied) for r in findings.applied_patches(files, comments).collect()}
    assert got["hot.rs"] == ("\n".join(f"new {1600 + i}" for i in range(400)) + "\n", 2000)
    assert got["b.rs"] == ("x\nfirst\ny2", 2) and "c.rs" not in got and got["e.rs"][1] == 0
    assert findings.applied_patches(files, comments.limit(0)).count() == 0


def test_a_long_sarif_document(spark):
    comments = spark.createDataFrame([(i, "a.rs", i, "bug" if i % 2 else "info", f"m{i}", 50.0, None, "p" if i % 3 == 0 else None) for i in range(300)], "ord bigint, file_path string, line bigint, severity string, message string, confidence double, suggestion string, patch string")
    out = io.StringIO()
    sinks.write_sarif(comments, out)
    assert json.loads(out.getvalue()) == json.loads(sinks.sarif(comments).first()[0])
    empty = io.StringIO()
    sinks.write_sarif(comments.limit(0), empty)
    assert json.loads(empty.getvalue())["runs"][0]["results"] == []


def test_pagerank_by_hand(spark):
    edges = [(1, 2, 2), (1, 3, 1), (2, 3, 1), (3, 1, 4), (4, 3, 1), (4, 9, 1)]
    nodes = spark.createDataFrame([(n,) for n in (1, 2, 3, 4, 5)], "sym_id bigint")
    got = {r.sym_id: r["rank"] for r in symbols.pagerank(nodes, spark.createDataFrame(edges, "from_id bigint, to_id bigint, m bigint"), rounds=7, cut_every=3).collect()}
    out = {f: sum(m for a, _, m in edges if a == f) for f in {a for a, _, _ in edges}}
    rank = {n: 0.2 for n in range(1, 6)}
    for _ in range(7):
        rank = {n: 0.15 / 5 + sum(0.85 * rank[a] * m / out[a] for a, b, m in edges if b == n) for n in rank}
    assert got.keys() == rank.keys() and all(abs(got[n] - rank[n]) < 1e-12 for n in rank)


def test_review_numbers_comments_of_hashed_responses(spark):
    one = json.dumps({"comments": [{"file": "a.rs", "line": 3 * k, "severity": "bug", "message": f"fault {k}", "confidence": 90} for k in (1, 2)]})
    responses = spark.createDataFrame([(2**63 - 5, one), (-(2**63) + 3, one)], "resp_id bigint, response string")
    rules = spark.createDataFrame([], "ord bigint, name string, severity string, description string")
    rows = commands.review(responses, rules)
    assert rows.select("ord").distinct().count() == rows.count() > 0 and rows.agg(F.min("ord")).first()[0] >= 1
