"""The diff parser, the skip cascade and risk."""

import pytest

from sievewright.functions import scores, text
from sievewright.operators import diffs
from sievewright.plans.commands import analyze_diff

TWO = """diff --git a/src/main.rs b/src/main.rs
index 1..2 100644
--- a/src/main.rs
+++ b/src/main.rs
@@ -1,3 +1,4 @@ fn main
 fn main() {
+    if x { y }
     z();
@@ -10 +11,2 @@
-old
+new
+more
diff --git a/logo.png b/logo.png
Binary files a/logo.png and b/logo.png differ
diff --git a/gone.txt b/gone.txt
deleted file mode 100644
--- a/gone.txt
+++ /dev/null
@@ -1 +0,0 @@
-bye
\\ No newline at end of file
"""


def test_parse():
    assert diffs.parse_diff("") == [] and diffs.parse_diff("no diff\n") == []
    a, b = diffs.parse_diff(TWO)
    assert (a["new_path"], len(a["hunks"]), a["is_deleted"]) == ("src/main.rs", 2, False)
    h = a["hunks"][1]
    assert (h["old_start"], h["old_lines"], h["new_start"], h["new_lines"], h["content"], h["change_type"]) == (10, 1, 11, 2, "-old\n+new\n+more\n", "modify")
    assert b["is_deleted"] and b["hunks"][0]["file_path"] == "gone.txt" and b["hunks"][0]["content"] == "-bye\n" and b["hunks"][0]["change_type"] == "delete"


def test_parse_kinds():
    new = diffs.parse_diff("diff --git a/n b/n\nnew file mode 100644\n--- /dev/null\n+++ b/n\n@@ -0,0 +1 @@\n+x\n")[0]
    assert new["is_new"] and new["hunks"][0]["change_type"] == "add"
    ren = diffs.parse_diff("diff --git a/o b/n\nsimilarity index 100%\nrename from o\nrename to n\n")[0]
    assert ren["is_rename"] and ren["new_path"] == "" and ren["hunks"] == []
    bare = diffs.parse_diff("--- /dev/null\n+++ b/new.txt\n@@ -0,0 +1,1 @@\n+hello\n")
    assert len(bare) == 1 and bare[0]["hunks"][0]["change_type"] == "add" and bare[0]["new_path"] == "new.txt"
    assert diffs.clean_path('"a/src/my file.rs"') == "src/my file.rs" and diffs.clean_path("/dev/null") == "/dev/null" and diffs.clean_path("a/b/x") == "b/x"
    with pytest.raises(diffs.MalformedDiff):
        diffs.parse_diff("diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ broken @@\n")


def test_header_lines_inside_hunks():
    sql = "diff --git a/q.sql b/q.sql\n--- a/q.sql\n+++ b/q.sql\n@@ -1,2 +1 @@\n--- comment\n x\n"
    assert diffs.parse_diff(sql)[0]["hunks"][0]["content"] == " x\n"  # as a reader that goes line by line
    strict = diffs.parse_diff(sql, strict=True)[0]
    assert strict["old_path"] == "q.sql" and strict["hunks"][0]["content"] == "--- comment\n x\n"
    two = "--- a/x\n+++ b/x\n@@ -1 +1 @@\n-a\n+b\n--- a/y\n+++ b/y\n@@ -1 +1 @@\n-c\n+d\n"
    assert len(diffs.parse_diff(two)) == 1
    assert [f["new_path"] for f in diffs.parse_diff(two, strict=True)] == ["x", "y"]


def frames(spark, diff):
    rows = diffs.parsed(spark.createDataFrame([("d", diff)], "diff_id string, text string"))
    return diffs.files_of(rows), diffs.hunks_of(rows)


def one(path, *lines):
    return f"diff --git a/{path} b/{path}\n--- a/{path}\n+++ b/{path}\n@@ -1,1 +1,{len(lines)} @@\n" + "".join(f"+{x}\n" for x in lines)


def test_risk(spark):
    files, hunks = frames(spark, one("a.rs", "x", "y", "z"))
    r = diffs.file_risk(files, hunks).first()
    assert (r.added, r.size, r.complexity, r.diffusion, r.file_type, r.total, r.level) == (3, 6.0, 0.0, 20.0, 50.0, 13.0, "low")
    files, hunks = frames(spark, "".join(one(f"{n}.rs", "x") for n in "abc"))
    o = diffs.overall_risk(diffs.file_risk(files, hunks)).first()
    assert (o.total_files, o.diffusion, o.total, o.risk_level) == (3, 60.0, 21.0, "low")
    nothing = frames(spark, "")
    assert diffs.overall_risk(diffs.file_risk(*nothing)).count() == 0
    text_report = analyze_diff(diffs.parsed(spark.createDataFrame([("d", TWO)], "diff_id string, text string")), "text")
    assert text_report.startswith("Risk Report\n===========\nOverall Risk:") and "src/main.rs" in text_report
    assert "| src/main.rs | modify | +3/-1 |" in analyze_diff(diffs.parsed(spark.createDataFrame([("d", TWO)], "diff_id string, text string")), "markdown")


def test_levels_and_types(spark):
    df = spark.createDataFrame([(25.0,), (25.1,), (50.0,), (50.1,), (75.0,), (75.1,)], "t double")
    assert [r[0] for r in df.select(scores.risk_level(df.t)).collect()] == ["low", "medium", "medium", "high", "high", "critical"]
    df = spark.createDataFrame([("a.rs",), ("a.toml",), ("a.md",), ("a.csv",), ("/dev/null",), ("",), (".bashrc",)], "p string")
    assert [r[0] for r in df.select(scores.file_type_risk("p")).collect()] == [50.0, 20.0, 5.0, 30.0, 30.0, 30.0, 30.0]
    assert [r[0] for r in df.select(text.extension("p")).collect()] == ["rs", "toml", "md", "csv", "", "", ""]
    df = spark.createDataFrame([("+} else if x {\n",), ("+a ? b : c\n",), ("-if x\n+if y\n",), ("+x\n",), ("",)], "c string")
    assert [r[0] for r in df.select(scores.branch_delta("c")).collect()] == [2, 1, 0, 0, 0]


def test_skip_cascade(spark):
    names = ["Cargo.lock", "vendor/x.rs", "app.min.js", "x.generated.ts", "a.g.dart", "b.pb.go", "c.snap", "x/y.test.ts", "src/main.rs"]
    files, hunks = frames(spark, "".join(one(n, "x") for n in names) + one("gen.go", "// Code generated by y") + one("long.js", "x" * 501) + one("big.rs", *["x"] * 1002))
    got = {r.new_path: r.skip_reason for r in diffs.skip_cascade(files, hunks, ("snap",), ("*.test.ts", "[")).collect()}
    assert got == {
        "Cargo.lock": "lock file", "vendor/x.rs": "vendored", "app.min.js": "minified", "x.generated.ts": "generated", "a.g.dart": "generated", "b.pb.go": "generated", "c.snap": "pattern: *.snap",
        "x/y.test.ts": "pattern: *.test.ts", "src/main.rs": None, "gen.go": "generated", "long.js": "minified", "big.rs": "too large",
    }


@pytest.mark.parametrize("rows, budget, groups", [
    ([("src/a", 10), ("src/b", 10), ("lib/c", 10)], 100, 2), ([("a/x", 1), ("b/x", 1), ("c/x", 1)], 100, 3), ([("a/x", 60), ("a/y", 60)], 100, 2), ([("x", 10), ("y", 10)], 100, 1), ([("a/x", 500)], 100, 1),
])
def test_pack_groups(spark, rows, budget, groups):
    df = spark.createDataFrame([("d", i, p, n) for i, (p, n) in enumerate(rows)], "diff_id string, ord int, new_path string, tokens bigint")
    assert diffs.pack_groups(df, budget).select("group_no").distinct().count() == groups


def test_lines(spark):
    df = spark.createDataFrame([("a\nb\n",), ("",), ("a\r\nb",), ("\n",), ("a\n\n",)], "c string")
    assert [r[0] for r in df.select(text.lines("c")).collect()] == [["a", "b"], [], ["a", "b"], [""], ["a", ""]]
