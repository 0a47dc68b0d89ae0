"""Properties against plain loops, over random inputs."""

import random
import re
import string

from hypothesis import given, settings
from hypothesis import strategies as st

from sievewright.functions import text
from sievewright.operators import diffs, symbols


def is_secret(token):
    if token.startswith("sk-") and len(token) >= 12:
        return True
    if len(token) >= 24 and re.search("[A-Za-z]", token) and re.search("[0-9]", token):
        return True
    parts = token.split(".")
    return len(token) >= 24 and len(parts) >= 3 and all(len(p) >= 8 for p in parts)


def test_redaction_against_tokens(spark):
    rng = random.Random(1)
    alphabet = string.ascii_letters[:8] + "123._-" + " :/\n"
    rows = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(80))) for _ in range(1500)]
    rows += ["sk-" + "a" * n for n in range(6, 12)] + ["a" * n + "1" for n in range(20, 26)] + [".".join("abcdefgh"[:n] for _ in range(3)) for n in (7, 8)]
    df = spark.createDataFrame(list(enumerate(rows)), "i int, c string")
    got = {r.i: r.o for r in df.select("i", text.redact("c").alias("o")).collect()}
    want = {i: re.sub(r"[A-Za-z0-9_.-]+", lambda m: "[REDACTED_TOKEN]" if is_secret(m.group()) else m.group(), r) for i, r in enumerate(rows)}
    assert got == want


def test_budget_against_the_loop(spark):
    rng = random.Random(2)
    rows = [(g, i, rng.randrange(0, 30), rng.random()) for g in range(20) for i in range(rng.randrange(1, 25))]
    df = spark.createDataFrame(rows, "g int, sym_id int, token_cost int, order_rank double")
    got = {(r.g, r.sym_id) for r in symbols.fit_budget(df, 100, ["g"]).collect()}
    want = set()
    for g in range(20):
        used = 0
        for _, i, c, _ in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3], r[1])):
            used += max(c, 1)
            if used > 100:
                break
            want.add((g, i))
    assert got == want


def test_packing_against_the_loop(spark):
    rng = random.Random(3)
    rows = [(f"d{d}", i, f"{rng.choice('abc')}/x{i}", rng.randrange(1, 60)) for d in range(15) for i in range(rng.randrange(1, 20))]
    df = spark.createDataFrame(rows, "diff_id string, ord int, new_path string, tokens bigint")
    got = {}
    for r in diffs.pack_groups(df, 100).collect():
        got.setdefault((r.diff_id, r.group_no), set()).add(r.ord)
    want = {}
    for d in {r[0] for r in rows}:
        no = -1
        for folder in "abc":
            used = 0
            mine = sorted(r for r in rows if r[0] == d and r[2][0] == folder)
            for k, (_, i, _, n) in enumerate(mine):
                if k == 0 or used + n > 100 and used > 0:
                    no, used = no + 1, 0
                used += n
                want.setdefault((d, no), set()).add(i)
    assert got == want


LINE = st.text(alphabet="ab -+@ ", min_size=0, max_size=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("+- "), LINE), min_size=1, max_size=12))
def test_strict_parsing_keeps_every_line(body):
    old = sum(m in "- " for m, _ in body)
    new = sum(m in "+ " for m, _ in body)
    content = "".join(f"{m}{t}\n" for m, t in body)
    parsed = diffs.parse_diff(f"diff --git a/x b/x\n--- a/x\n+++ b/x\n@@ -1,{old} +1,{new} @@\n{content}", strict=True)
    assert len(parsed) == 1 and parsed[0]["hunks"][0]["content"] == content


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab/*?.[]!", max_size=8), st.text(alphabet="ab/.", max_size=8))
def test_globs(pattern, name):
    rx = text.glob_regex(pattern)
    if rx is None:
        return
    plain = "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in re.sub(r"\*+", "*", pattern))
    if "[" not in pattern:
        assert bool(re.match(rx, name)) == bool(re.fullmatch(plain, name, re.S))
