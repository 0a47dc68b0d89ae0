"""Problem 1: layout on texts of any length, hunks judged together, and hand-written code that is no case."""

import pytest

from sievewright.llm import handwritten
from sievewright.llm.lexing import scan

STUB = "function get_{0}(a) {{\n  check(a);\n  return call('{0}', a);\n}}\n\n"


@pytest.mark.parametrize("path, lang, text, why", [
    ("a.js", "javascript", "var a=1;function b(c){return c+a}b(2);alert(a)", "minified"),
    ("a.js", "javascript", "\n".join("function f%d(b){var d=b+1;return d>2?d:e(d)};g(%d);h[%d]=f%d(2);var k%d=i(h);" % (i, i, i, i, i) for i in range(9)) + "\n", "minified"),
    ("a.js", "javascript", "if (a) { b(); c(); d(); }\n", None), ("a.py", "python", "x = 1; y = 2; z = 3\n", None), ("a.go", "go", "package a\n\nfunc f() { g(); h(); i(); j() }\n", None),
    ("a.js", "javascript", "".join(STUB.format(f"m{i}") for i in range(12)), "generated"), ("a.js", "javascript", "".join(STUB.format(f"m{i}") for i in range(4)), None),
    ("a.py", "python", "# python 3.12 or later\nimport os\n", None), ("a.js", "javascript", "// Reads files generated by the build\nlet a = 1;\n", None), ("a.py", "python", "# Callers must do not modify the returned list\nx = f()\n", None),
    ("a.py", "python", "OPTIONS = {\n" + "".join(f'    "option_{i}": {i},\n' for i in range(25)) + "}\n", None), ("tools/external/client.go", "go", "package client\n", None), ("tools/external/zlib/client.go", "go", "package client\n", "vendored"),
    ("a.py", "python", "# This file was generated by lex from a.y.\nx = 1\n", "declared"), ("a.py", "python", "# Generated by lex\nx = 1\n", "declared"), ("a.c", "c", "/* do not edit */\nint x;\n", "declared"), ("a.js", "javascript", "// lib 1.2.3 | (c) x\nlet a = 1;\n", "vendored"),
    ("a.min.js", "javascript", "let a = 1;\n", "minified"), (None, None, None, None), ("a.js", "javascript", "", None), ("a.js", "javascript", "\n" * 5000, None),
])
def test_files(path, lang, text, why):
    assert handwritten.why(text, path, lang) == why


def test_columns_and_python_agree(spark):
    texts = ["var a=1;function b(c){return c+a}b(2);alert(a)", "x = [" + "1, 2, " * 80 + "]", "let a = f(1);\n", "".join(STUB.format(f"m{i}") for i in range(12)), "1, 2, 3, 4\n" * 20, ""]
    rows = [handwritten.measured(t, *scan(t, "javascript")) for t in texts]
    df = spark.createDataFrame([(n, *r.values()) for n, r in enumerate(rows)], "n int, " + ", ".join(f"{k} bigint" for k in rows[0]))
    got = {r.n: r.why for r in df.withColumn("why", handwritten.shows_column()).collect()}
    assert got == {n: handwritten.shows(r) for n, r in enumerate(rows)} and got[0] == "minified" and got[4] == "data" and got[2] is None


def test_hunks_of_a_file_are_judged_together(spark):
    piece = "+  [12, 40, 77, 91],\n"
    d = spark.createDataFrame([("d", 0, "r", "a.py"), ("d", 1, "r", "b.py"), ("e", 0, "r", "a.py")], "diff_id string, file_ord int, repo string, new_path string")
    h = spark.createDataFrame(
        [("d", 0, k, "a.py", 10 * k + 5, piece) for k in range(12)] + [("d", 1, 0, "b.py", 5, piece), ("e", 0, 0, "a.py", 5, "+def f(a):\n+    return a\n")] + [("d", 1, 0, "b.py", 5, piece)] * 12,
        "diff_id string, file_ord int, hunk_ord int, file_path string, new_start bigint, content string",
    )
    s = spark.createDataFrame([], "file_id bigint, repo string, path string, why string")
    assert {tuple(r) for r in handwritten.flagged_diffs(d, h, s).collect()} == {("d", 0, "data")}  # repeated rows of one hunk count once
