"""A review from diff to findings, with a model that is a function."""

import json

from sievewright.operators import diffs
from sievewright.plans import commands
from sievewright.sources.readers import ReviewSettings


def change(path, *lines):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,1 +1,{len(lines)} @@\n" + "".join(f"+{x}\n" for x in lines)


def chat(messages):
    said = messages[-1]["content"]
    if said.startswith("Score each"):
        return json.dumps({"evaluations": [{"index": i, "score": 3 if "weak" in x else 9} for i, x in enumerate(x for x in said.split("\n") if x.startswith("["))]})
    if "labels" in said:
        return '```json\n{"title": "t", "description": "d", "labels": ["x"]}\n```'
    found = []
    for x in said.split("\n"):
        if x.startswith("+++ b/"):
            path = x[6:]
        if "unwrap" in x:
            found += [{"file": path, "line": 1, "severity": "bug", "message": "breaks no-unwrap", "confidence": 97}] * 2
        if "weak" in x:
            found.append({"file": path, "line": 2, "severity": "bug", "message": "weak", "confidence": 99})
        if "style" in x:
            found.append({"file": path, "line": 3, "severity": "info", "message": "style", "confidence": 99})
    return json.dumps({"comments": found})


def rows(spark):
    one = change("src/a.rs", "unwrap()", "weak") + change("Cargo.lock", "unwrap()") + change("src/b.rs", "style")
    return diffs.parsed(spark.createDataFrame([("d1", one), ("d2", change("x/c.rs", "unwrap()"))], "diff_id string, text string"))


def test_review(spark):
    rules = spark.createDataFrame([(0, "no-unwrap", "bug", "never")], "ord bigint, name string, severity string, description string")
    got = commands.review_diffs(rows(spark), rules, chat, ReviewSettings(min_confidence=90.0)).collect()
    kept = sorted((r.diff_id, r.file_path, r.rule, r.n_same) for r in got if r.reason is None)
    assert kept == [("d1", "src/a.rs", "no-unwrap", 2), ("d2", "x/c.rs", "no-unwrap", 2)]
    assert {r.message: r.reason for r in got if r.reason} == {"style": "info-level excluded"}  # the weak one went in the reflection
    plain = commands.review_diffs(rows(spark), rules, chat, ReviewSettings(self_reflection=False, max_comments=1)).collect()
    assert sum(r.reason is None for r in plain) == 2 and any(r.reason == "exceeded max comment limit" for r in plain)


def test_prompts(spark):
    rules = spark.createDataFrame([(0, "no-unwrap", "bug", "never")], "ord bigint, name string, severity string, description string")
    scored = spark.createDataFrame([("src/b.rs", 0.8)], "path string, score double")
    got = {(r.diff_id, r.group_no): r.messages for r in commands.review_prompts(rows(spark), rules, ReviewSettings(), scored).collect()}
    assert set(got) == {("d1", 0), ("d2", 0)}
    user = got["d1", 0][1].content
    assert "history score 0.80" in user and user.index("b/src/b.rs") < user.index("b/src/a.rs") and "Cargo.lock" not in user
    assert "- [bug] no-unwrap: never" in got["d1", 0][0].content
    alone = commands.review_prompts(rows(spark), rules, ReviewSettings(cross_file=False))
    assert alone.count() == 3


def test_describe(spark):
    out = commands.describe(spark.createDataFrame([("d", "+x")], "diff_id string, text string"), chat).first()
    assert (out.diff_id, out.title, out.labels) == ("d", "t", ["x"])
