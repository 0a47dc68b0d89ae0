"""Findings, model responses, patches, messages, reports and state."""

import json

import pytest

from sievewright.functions import models, scores, text
from sievewright.operators import findings, state
from sievewright.plans.commands import exit_code
from sievewright.sources import readers, sinks

C = "ord bigint, file_path string, line bigint, severity string, message string, confidence double, suggestion string, patch string, rule string"
FOUR = [(1, "a.rs", 1, "info", "m1", 95.0), (2, "b.rs", 10, "bug", "m2", 98.0), (3, "c.rs", 20, "warning", "m3", 85.0), (4, "d.rs", 30, "bug", "m4", 50.0)]


def comments(spark, rows):
    return spark.createDataFrame([tuple(r) + (None,) * (9 - len(r)) for r in rows], C)


def kept(df):
    return [(r.file_path, r.reason) for r in df.orderBy("ord").collect()]


def test_filter(spark):
    df = comments(spark, FOUR)
    every = ("bug", "warning", "info")
    assert kept(findings.filtered(df, 90.0, every, 10)) == [("a.rs", None), ("b.rs", None), ("c.rs", "below confidence threshold"), ("d.rs", "below confidence threshold")]
    assert kept(findings.filtered(df, 0.0, ("bug", "warning"), 10))[0] == ("a.rs", "info-level excluded")
    cut = findings.filtered(df, 0.0, every, 2)
    assert {r.file_path: r.place for r in cut.where("reason is null").collect()} == {"b.rs": 1, "d.rs": 2}
    assert cut.where("reason = 'exceeded max comment limit'").count() == 2
    assert findings.funnel(findings.filtered(findings.deduplicated(df), 90.0, every, 10), df).first().comments_filtered == 2
    assert findings.filtered(df.limit(0)).count() == 0


def test_dedup_keeps_first_and_highest(spark):
    df = comments(spark, [(5, "a", 1, "bug", "x", 80.0, "late"), (2, "a", 1, "warning", "x", 60.0, "first"), (3, "a", 1, "bug", "x", 95.0, None), (4, "a", 2, "bug", "x", 1.0), (9, None, None, None, None, None)])
    rows = {r.ord: r for r in findings.deduplicated(df).collect()}
    assert set(rows) == {2, 4, 9} and (rows[2].confidence, rows[2].severity, rows[2].suggestion, rows[2].n_same) == (95.0, "warning", "first", 3)


def test_tag_and_reflect(spark):
    rules = spark.createDataFrame([(0, "no-unwrap", "bug", "d"), (1, "naming", "info", "d")], "ord bigint, name string, severity string, description string")
    df = comments(spark, [(1, "a", 1, "bug", "breaks naming and no-unwrap", 99.0), (2, "b", 2, "bug", "fine", 99.0), (3, "c", 3, "bug", None, 99.0)])
    assert {r.ord: r.rule for r in findings.tagged(df, rules).collect()} == {1: "no-unwrap", 2: None, 3: None}
    numbered = findings.renumbered(df)
    ev = spark.createDataFrame([(0, 0, 3, None), (0, 1, 8, "info"), (1, 2, 6, None)], "idx bigint, pos int, score int, revised_severity string")
    assert {r.ord: r.severity for r in findings.reflected(numbered, ev).collect()} == {1: "info", 3: "bug"}
    assert findings.reviewed(df, rules, None, min_confidence=0.0, limit=9).where("reason is null").count() == 3


def test_response_json(spark):
    ok = {"file": "a.rs", "line": 3, "severity": "Bug", "message": "m", "confidence": 150}
    bad = [
        json.dumps({"comments": []}), "not json", "[]", json.dumps({"comments": [ok, {"file": "a"}]}), json.dumps({"comments": [dict(ok, line=0), dict(ok, line="7"), dict(ok, line=1.5), dict(ok, severity="fatal"), {k: v for k, v in ok.items() if k != "line"}]}),
        json.dumps({"comments": [dict(ok, message=5)]}), "",
    ]
    rows = [(i, x) for i, x in enumerate(bad)] + [(10, json.dumps({"comments": [ok]})), (11, "```json\n" + json.dumps({"comments": [dict(ok, confidence="high"), dict(ok, confidence=-3)]}) + "\n```"), (12, None)]
    got = findings.parsed_comments(spark.createDataFrame(rows, "resp_id bigint, response string")).orderBy("resp_id", "pos").collect()
    assert [(r.resp_id, r.line, r.severity, r.confidence) for r in got] == [(10, 3, "bug", 100.0), (11, 3, "bug", 50.0), (11, 3, "bug", 0.0)]


def test_evaluation_json(spark):
    e = lambda **k: json.dumps({"evaluations": [{"index": 0, "score": 8} | k]})
    rows = [(1, e()), (2, e(score=12)), (3, e(score=-1)), (4, e(score=256)), (5, e(score=2.5)), (6, "x"), (7, e(revised_severity="WARNING")), (8, e(revised_severity="odd"))]
    got = {r.resp_id: (r.score, r.revised_severity) for r in findings.parsed_evaluations(spark.createDataFrame(rows, "resp_id bigint, response string")).collect()}
    assert got == {1: (8, None), 2: (10, None), 7: (8, "warning"), 8: (8, None)}


def patched(spark, content, *patches):
    files = spark.createDataFrame([("f", content)], "path string, content string")
    df = comments(spark, [(i, p, ln, "bug", "m", 99.0, None, t, None) for i, (p, ln, t) in enumerate(patches)])
    got = findings.applied_patches(files, df).collect()
    return (got[0].content if got else content), {r.ord: r.reason for r in findings.patch_log(files, df).collect()}


def test_patches(spark):
    assert patched(spark, "a\nb\nc\n", ("f", 2, "B")) == ("a\nB\nc\n", {0: None})
    assert patched(spark, "a\nb", ("f", 1, "x\ny"), ("f", 2, "z")) == ("x\ny\nz", {0: None, 1: None})
    assert patched(spark, "a\n", ("f", 9, "x"), ("g", 1, "x")) == ("a\n", {0: "line out of range", 1: "file not found"})
    assert patched(spark, "a\nb\n", ("f", 1, "x\ny"), ("f", 1, "z")) == ("z\ny\nb\n", {0: None, 1: None})


def test_messages(spark):
    rows = [(1, 0, "user", "a"), (1, 1, "user", "b"), (1, 2, "assistant", "c"), (1, 3, "user", "d"), (2, 0, "user", "e")]
    got = findings.merged_messages(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, content string")).orderBy("conv_id", "turn").collect()
    assert [(r.conv_id, r.role, r.content) for r in got] == [(1, "user", "a\n\nb"), (1, "assistant", "c"), (1, "user", "d"), (2, "user", "e")]
    assert models.hoisted([{"role": "system", "content": "s"}, {"role": "user", "content": "a"}, {"role": "user", "content": "b"}]) == ("s", [{"role": "user", "content": "a\n\nb"}])


def test_rules_markdown(spark):
    lines = ["# Rules", "", "- [bug] no-unwrap: Never call unwrap", "* Keep functions small and simple please", "- [INFO] a name that is far too long to be a name of any rule: text", "- [warning] empty:"]
    got = findings.rules_from_markdown(spark.createDataFrame(list(enumerate(lines)), "ord bigint, line string")).orderBy("ord").collect()
    assert [(r.name, r.severity) for r in got] == [("no-unwrap", "bug"), ("keep-functions-small-and", "warning"), ("a-name-that-is", "info")]


def test_redaction(spark):
    token = "a1" * 12
    rows = [("key sk-abcdefghi123 end",), (f"t {token}.",), ("plain words only",), ("sk-short",), ("aaaaaaaa.bbbbbbbb.cccccccc",), ("x" * 400,)]
    got = [r[0] for r in spark.createDataFrame(rows, "c string").select(text.clean_reason("c", ("plain",))).collect()]
    assert got[:5] == ["key [REDACTED_TOKEN] end", "t [REDACTED_TOKEN]", "[REDACTED] words only", "sk-short", "[REDACTED_TOKEN]"]
    assert len(got[5]) == 320 and got[5].endswith("…")


def test_sarif_and_reports(spark):
    df = comments(spark, [(1, "a.rs", 5, "warning", "w", 91.0), (2, "b.rs", 6, "bug", 'say "x"', 97.6, "do", "line1\nline2", "r1")])
    doc = json.loads(sinks.sarif(df).first().sarif)
    run = doc["runs"][0]
    assert doc["version"] == "2.1.0" and [r["id"] for r in run["tool"]["driver"]["rules"]] == ["sievewright/warning", "sievewright/bug"]
    assert [r["level"] for r in run["results"]] == ["warning", "error"] and "fixes" not in run["results"][0]
    assert run["results"][1]["fixes"][0]["artifactChanges"][0]["replacements"][0]["insertedContent"]["text"] == "line1\nline2"
    report = sinks.review_report(df, {"model_used": "m", "files_reviewed": 2})
    assert "[BUG] b.rs:6 (confidence: 98%, rule: r1)\n  say \"x\"\n  Suggestion: do\n  Patch:\n    line1\n    line2\n" in report
    assert "## ⚠️ Warning — `a.rs:5` (91%)\n\nw\n\n" in sinks.review_report(df, {}, "markdown", "sum")
    assert sinks.copy_report(df).startswith("Issues to fix:\n\n1. [WARNING] a.rs:5\n   w\n\n2. [BUG]") and sinks.copy_report(df.limit(0)) == "No issues found."
    assert sinks.metadata_line("tool", 1, 2) == "tool: reviewed (1 comment, iteration 2)"
    assert (exit_code(df, "bug"), exit_code(df.where("ord = 1"), "bug"), exit_code(df, "info"), exit_code(df, None)) == (1, 0, 1, 0)
    assert sinks.post_review(df, "s")["event"] == "REQUEST_CHANGES"
    sent = []

    def refuse(row):
        sent.append(row["event"])
        if len(sent) == 1:
            raise RuntimeError("422 Unprocessable Entity")

    assert sinks.post_review(df, "s", refuse)["event"] == "COMMENT" and sent == ["REQUEST_CHANGES", "COMMENT"]


def test_retries():
    calls, waits = [], []

    def flaky():
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("HTTP 429 Too Many Requests")
        return "ok"

    assert models.with_retries(flaky, sleep=waits.append) == ("ok", 3, 2) and waits == [1.0, 2.0]
    with pytest.raises(ValueError):
        models.with_retries(lambda: (_ for _ in ()).throw(ValueError("no")))


def test_state(spark, tmp_path):
    store = state.IndexStore(spark, str(tmp_path / "index")).create().create()
    row = lambda r, s: spark.createDataFrame([("c1", r, None, s, None)], state.TABLES["feedback"])
    store.upsert("feedback", row(-1, 1), ["comment_id"], "seq")
    assert state.feedback_counts(store.read("feedback")).first() == (0, 1)
    store.upsert("feedback", row(1, 2), ["comment_id"], "seq")
    assert state.feedback_counts(store.read("feedback")).first() == (1, 0) and state.newest_negative(store.read("feedback")).count() == 0
    store.upsert("feedback", state.rated(spark, [("c2", "not_useful", "why"), ("c3", "skip", None)], 3), ["comment_id"], "seq")
    assert [r.comment_id for r in state.newest_negative(store.read("feedback")).collect()] == ["c2"] and store.size() > 0
    store.upsert("files", spark.createDataFrame([("a", "h", 1), ("b", "h", 1)], state.TABLES["files"]), ["path"], "indexed_at")
    store.delete_paths("files", spark.createDataFrame([("a",)], "p string"), "path")
    assert [r.path for r in store.read("files").collect()] == ["b"]


def test_settings_and_events(spark, tmp_path):
    s = readers.settings('[review]\nmax_comments = 9\nunknown = 1\n[[rules]]\nname = "n"\nseverity = "bug"\ndescription = "d"\n')
    assert (s.review.max_comments, s.review.min_confidence, s.review.severity_filter) == (9, 90.0, ("bug", "warning"))
    assert readers.rules_table(spark, s).first().name == "n" and readers.settings("").review.max_diff_tokens == 64_000
    assert readers.pull_reference("o/n#12") == ("o", "n", 12)
    with pytest.raises(ValueError):
        readers.pull_reference("o/n")
    with pytest.raises(ValueError):
        readers.contained(str(tmp_path), "../x")
    assert readers.review_state(spark, str(tmp_path / "none")) is None
    ev = spark.sql("select timestamp'2026-01-01' as timestamp, 'c' as commit, 2L as comment_count union all select timestamp'2026-01-02', null, 1L")
    sinks.append_events(ev, str(tmp_path / "events"))
    sinks.append_events(ev, str(tmp_path / "events"))
    assert state.iterations(spark.read.json(str(tmp_path / "events"))).first().iteration_count == 2


def test_severities(spark):
    df = spark.createDataFrame([("BUG",), ("info",), ("x",), (None,)], "s string")
    assert [r[0] for r in df.select(scores.severity_rank("s")).collect()] == [0, 3, None, None]


def test_vector_bytes(spark):
    from sievewright.functions.vectors import bytes_to_vector, vector_to_bytes

    df = spark.createDataFrame([([1.0, -2.5],), ([],), (None,)], "v array<float>")
    back = [r[0] for r in df.select(bytes_to_vector(vector_to_bytes("v"))).collect()]
    assert back == [[1.0, -2.5], [], None]
    assert spark.sql("select X'0000803f00' as b").select(bytes_to_vector("b")).first()[0] == [1.0]
