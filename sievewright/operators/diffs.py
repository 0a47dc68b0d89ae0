"""Unified diffs: parsing, filtering, risk, sizes and rebuilding.

Tables: ``diff_files(diff_id, file_ord, old_path, new_path, is_new, is_deleted, is_rename)`` and
``diff_hunks(diff_id, file_ord, hunk_ord, file_path, old_start, old_lines, new_start, new_lines,
content, change_type)``.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text

#: Files whose changes are not reviewed.
LOCK_FILES = ("package-lock.json", "yarn.lock", "Cargo.lock", "pnpm-lock.yaml", "poetry.lock", "Gemfile.lock", "composer.lock", "go.sum")
VENDOR_DIRS = ("vendor", "third_party", "node_modules")
GENERATED_MARKS = ("// Code generated", "# AUTO-GENERATED")

PARSED = (
    "diff_id string, file_ord int, hunk_ord int, old_path string, new_path string, is_new boolean, is_deleted boolean, is_rename boolean, "
    "file_path string, old_start bigint, old_lines bigint, new_start bigint, new_lines bigint, content string, change_type string"
)
_HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


class MalformedDiff(ValueError):
    """A hunk header that is none; the whole diff fails."""


def clean_path(raw: str) -> str:
    """A header's path without quotes and without one leading a/ or b/."""
    path = raw.strip()
    if len(path) >= 2 and path[0] == '"' and path[-1] == '"':
        path = path[1:-1]
    return path[2:] if path[:2] in ("a/", "b/") else path


_HEADERS = {
    "old_path": re.compile(r"(?m)^--- (.*)$"), "new_path": re.compile(r"(?m)^\+\+\+ (.*)$"), "is_new": re.compile(r"(?m)^new file mode"),
    "is_deleted": re.compile(r"(?m)^deleted file mode"), "is_rename": re.compile(r"(?m)^rename (?:from|to) "), "binary": re.compile(r"(?m)^Binary files .* differ$"),
}


def _take_headers(state: dict, part: str) -> None:
    """Lets the header lines of a part change a file's state; the last path of a kind counts."""
    for key, rx in _HEADERS.items():
        if (seen := rx.findall(part)):
            state[key] = clean_path(seen[-1]) if key.endswith("path") else True
    if state["new_path"] == "/dev/null":
        state["is_deleted"] = True


def _counted(body: list[str], old: int, new: int) -> int:
    """How many lines of a hunk's part its header's counts cover."""
    at = 0
    while at < len(body) and (old > 0 or new > 0):
        mark = body[at][:1] or " "
        old -= mark in "- "
        new -= mark in "+ "
        at += 1
    return at


def _section(part: str, strict: bool) -> list[dict]:
    """The files of a stretch of a diff that one git header, or none, opens."""
    head, *hunks = re.split(r"(?m)^(?=@@ )", part)
    blank = {"old_path": "", "new_path": "", "is_new": False, "is_deleted": False, "is_rename": False, "binary": False}
    files = [{**blank, "hunks": []}]
    _take_headers(files[-1], head)
    for piece in hunks:
        now = files[-1]
        title, *body = piece.split("\n")
        if not (m := _HUNK.match(title)):
            raise MalformedDiff(title[:80])
        old_start, old_lines, new_start, new_lines = (int(x) if x else 1 for x in m.groups())
        if strict:
            cover = _counted(body, old_lines, new_lines)
            content, rest = body[:cover], body[cover:]
        else:
            content, rest = [x for x in body if not x.startswith(("--- ", "+++ "))], body
        now["hunks"].append({
            "old_start": old_start, "old_lines": old_lines, "new_start": new_start, "new_lines": new_lines,
            "content": "".join(x + "\n" for x in content if x[:1] in ("+", "-", " ")),
            "change_type": "add" if now["is_new"] or old_lines == 0 else "delete" if now["is_deleted"] or new_lines == 0 else "modify",
            "file_path": now["old_path"] if now["is_deleted"] else now["new_path"],
        })
        after = "\n".join(rest)
        if strict and _HEADERS["old_path"].search(after):
            files.append({**blank, "hunks": []})
        _take_headers(files[-1], after)
    return files


def parse_diff(diff: str, strict: bool = False) -> list[dict]:
    """The files of a diff, each with its hunks; binary files are left out.

    As readers that go line by line do, a header line counts wherever it stands, also inside a hunk,
    and a patch without git headers is one file. With ``strict`` the counts of a hunk's header decide
    what belongs to it, so removed lines that look like headers stay content and headerless files in
    a row are told apart.
    """
    start, *parts = re.split(r"(?m)^(?=diff --git )", diff.replace("\r\n", "\n"))
    if (bare := re.search(r"(?m)^--- ", start)):
        parts.insert(0, start[bare.start():])
    return [f for p in parts for f in _section(p, strict) if not f["binary"]]


def _parse_rows(strict: bool, fail: bool):
    names = [p.split()[0] for p in PARSED.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for diff_id, diff in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    files = parse_diff(diff or "", strict)
                except MalformedDiff:
                    if fail:
                        raise
                    continue
                for k, f in enumerate(files):
                    head = {"diff_id": diff_id, "file_ord": k, **{n: f[n] for n in ("old_path", "new_path", "is_new", "is_deleted", "is_rename")}}
                    rows += [{**head, "hunk_ord": j, **h} for j, h in enumerate(f["hunks"])] or [head]
            types = {"string": pa.string(), "int": pa.int32(), "bigint": pa.int64(), "boolean": pa.bool_()}
            kinds = [types[p.split()[1]] for p in PARSED.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds)], names)

    return run


def parsed(diffs: DataFrame, strict: bool = False, fail: bool = True) -> DataFrame:
    """(diff_id, text) as one row per hunk, and one for each file without hunks.

    A malformed hunk header fails the job, or with ``fail=False`` drops its diff.
    """
    return diffs.select("diff_id", "text").mapInArrow(_parse_rows(strict, fail), PARSED)


def files_of(rows: DataFrame) -> DataFrame:
    return rows.select("diff_id", "file_ord", "old_path", "new_path", "is_new", "is_deleted", "is_rename").distinct()


def hunks_of(rows: DataFrame) -> DataFrame:
    return rows.where("hunk_ord is not null").select("diff_id", "file_ord", "hunk_ord", "file_path", "old_start", "old_lines", "new_start", "new_lines", "content", "change_type")


def clean_files(files: DataFrame) -> DataFrame:
    return files.where("diff_id is not null and file_ord is not null").dropDuplicates(["diff_id", "file_ord"])


def clean_hunks(hunks: DataFrame) -> DataFrame:
    return hunks.where("diff_id is not null and file_ord is not null and hunk_ord is not null").dropDuplicates(["diff_id", "file_ord", "hunk_ord"])


def path_reason(path: str | Column, extensions: tuple[str, ...] = ()) -> Column:
    """Why a path alone is skipped, null if it is kept."""
    c, name = text.col(path), text.basename(path)
    out = (
        F.when(name.isin(*LOCK_FILES), "lock file").when(F.arrays_overlap(F.split(c, "/"), F.array(*map(F.lit, VENDOR_DIRS))), "vendored")
        .when(name.endswith(".min.js") | name.endswith(".min.css"), "minified")
        .when(name.contains(".generated.") | name.endswith(".g.dart") | name.endswith(".pb.go") | name.endswith(".pb.rs"), "generated")
    )
    return out.when(text.extension(path).isin(*extensions), F.concat(F.lit("pattern: *."), text.extension(path))) if extensions else out


def file_facts(hunks: DataFrame) -> DataFrame:
    """(diff_id, file_ord, hunks, added, deleted, longest, marked, content_bytes, complexity): what the cascade and the risk need of the hunks.

    ``marked``: a generator's mark within the first five lines of the hunks put one after the other.
    Each hunk gives its line count and the lines among its first five that carry a mark; the offset
    of a hunk is a running sum, so contents are never put together.
    """
    from pyspark.sql import Window as W

    ln = text.lines("content")
    facts = hunks.select(
        "diff_id", "file_ord", "hunk_ord", F.size(ln).alias("n"), scores.marked_lines("content", "+").alias("added"), scores.marked_lines("content", "-").alias("deleted"),
        F.coalesce(F.array_max(F.transform(ln, lambda x: F.octet_length(x))), F.lit(0)).alias("longest"),
        F.array_min(F.filter(F.transform(F.slice(ln, 1, 5), lambda x, i: F.when(x.contains(GENERATED_MARKS[0]) | x.contains(GENERATED_MARKS[1]), i)), lambda i: i.isNotNull())).alias("mark_at"),
        F.octet_length("content").alias("bytes"), scores.hunk_complexity("content").alias("complexity"),
    )
    ahead = W.partitionBy("diff_id", "file_ord").orderBy("hunk_ord").rowsBetween(W.unboundedPreceding, -1)
    facts = facts.withColumn("before", F.coalesce(F.sum("n").over(ahead), F.lit(0)))
    return facts.groupBy("diff_id", "file_ord").agg(
        F.count("*").alias("hunks"), F.sum("added").alias("added"), F.sum("deleted").alias("deleted"), F.max("longest").alias("longest"),
        F.max(F.coalesce(F.col("before") + F.col("mark_at") < 5, F.lit(False))).alias("marked"), F.sum("bytes").alias("content_bytes"), F.avg("complexity").alias("complexity"),
    )


def with_facts(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """The files with the facts of their hunks, zeros for files without any."""
    zero = {"hunks": 0, "added": 0, "deleted": 0, "longest": 0, "marked": False, "content_bytes": 0, "complexity": 0.0}
    return files.join(file_facts(hunks), ["diff_id", "file_ord"], "left").fillna(zero)


def skip_cascade(files: DataFrame, hunks: DataFrame, extensions: tuple[str, ...] = (), globs: tuple[str, ...] = (), max_changed: int = 1000, longest: int = 500) -> DataFrame:
    """The files with ``skip_reason``, null for those kept; the first rule that applies gives it.

    Order: lock file, vendored, minified, generated by name, generated by content, extension, too
    large, custom glob. Malformed globs are ignored.
    """
    rows = with_facts(files, hunks)
    path, name = F.col("new_path"), text.basename("new_path")
    reason = F.when(name.isin(*LOCK_FILES), "lock file")
    reason = reason.when(F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, VENDOR_DIRS))), "vendored")
    reason = reason.when(name.endswith(".min.js") | name.endswith(".min.css") | (F.col("longest") > longest), "minified")
    reason = reason.when(name.contains(".generated.") | name.endswith(".g.dart") | name.endswith(".pb.go") | name.endswith(".pb.rs") | F.col("marked"), "generated")
    if extensions:
        reason = reason.when(text.extension("new_path").isin(*extensions), F.concat(F.lit("pattern: *."), text.extension("new_path")))
    reason = reason.when(F.col("added") + F.col("deleted") > max_changed, "too large")
    for g in globs:
        if (rx := text.glob_regex(g)) is not None:
            reason = reason.when(path.rlike(rx), F.lit(f"pattern: {g}"))
    return rows.withColumn("skip_reason", reason)


def file_risk(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """Per file: the five components, their weighted total and its level."""
    rows = with_facts(files, hunks)
    size, diffusion = scores.size_risk(F.col("added") + F.col("deleted")), scores.diffusion_risk(F.col("hunks"))
    out = rows.select(
        "diff_id", "file_ord", "new_path", scores.change_type(F.col("is_new"), F.col("is_deleted"), F.col("is_rename")).alias("change_type"), "added", "deleted", "hunks",
        size.alias("size"), "complexity", diffusion.alias("diffusion"), F.lit(0.0).alias("coverage"), scores.file_type_risk("new_path").alias("file_type"),
    )
    total = scores.risk_total(F.col("size"), F.col("complexity"), F.col("diffusion"), F.col("coverage"), F.col("file_type"))
    return out.withColumn("total", total).withColumn("level", scores.risk_level(F.col("total")))


def overall_risk(risk: DataFrame) -> DataFrame:
    """Per diff: totals, mean complexity over files, the riskiest file type, the overall score and level."""
    sums = risk.groupBy("diff_id").agg(
        F.count("*").alias("total_files"), F.sum("added").alias("total_additions"), F.sum("deleted").alias("total_deletions"), F.avg("complexity").alias("complexity"), F.max("file_type").alias("file_type")
    )
    sums = sums.withColumn("size", scores.size_risk(F.col("total_additions") + F.col("total_deletions"))).withColumn("diffusion", scores.diffusion_risk(F.col("total_files")))
    total = scores.risk_total(F.col("size"), F.col("complexity"), F.col("diffusion"), F.lit(0.0), F.col("file_type"))
    return sums.withColumn("total", total).withColumn("risk_level", scores.risk_level(F.col("total")))


def size_estimate(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(diff_id, file_ord, tokens): bytes div 4 of the rebuilt text, hunk headers taken as 20 bytes."""
    rows = with_facts(files, hunks)
    bytes_ = (F.octet_length("old_path") + 7) + (F.octet_length("new_path") + 7) + F.col("hunks") * 20 + F.col("content_bytes")
    return rows.select("diff_id", "file_ord", "new_path", F.floor(bytes_ / 4).cast("bigint").alias("tokens"))


def rebuilt(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(diff_id, file_ord, text): each file's diff written out again, hunks in order."""
    head = F.format_string("@@ -%d,%d +%d,%d @@\n", "old_start", "old_lines", "new_start", "new_lines")
    body = hunks.groupBy("diff_id", "file_ord").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("hunk_ord", F.concat(head, "content").alias("t")))), lambda x: x["t"]), "").alias("body")
    )
    return files.join(body, ["diff_id", "file_ord"], "left").select(
        "diff_id", "file_ord", F.concat(F.lit("--- a/"), "old_path", F.lit("\n+++ b/"), "new_path", F.lit("\n"), F.coalesce("body", F.lit(""))).alias("text")
    )


def pack_groups(files: DataFrame, max_tokens: int) -> DataFrame:
    """Files (diff_id, ord, new_path, tokens) with the group of a resetting budget, by directory.

    Within a directory, in order, a file opens a new group if the current one would pass the budget
    and is not empty. The fold runs per (diff, directory) as an expression over the ordered sizes;
    groups are numbered within a diff by directory, components compared one by one.
    """
    from pyspark.sql import Window as W

    entry = F.struct("ord", "new_path", "tokens")
    dirs = files.groupBy("diff_id", text.parent_dir("new_path").alias("dir")).agg(F.array_sort(F.collect_list(entry)).alias("files"))
    start = F.struct(F.lit(0).cast("bigint").alias("used"), F.lit(0).alias("group"), F.expr("cast(array() as array<int>)").alias("groups"))

    def step(acc: Column, f: Column) -> Column:
        full = (acc["used"] + f["tokens"] > max_tokens) & (acc["used"] > 0)
        group = acc["group"] + F.when(full, 1).otherwise(0)
        return F.struct(F.when(full, f["tokens"]).otherwise(acc["used"] + f["tokens"]).cast("bigint").alias("used"), group.alias("group"), F.concat(acc["groups"], F.array(group)).alias("groups"))

    folded = dirs.withColumn("groups", F.aggregate("files", start, step, lambda a: a["groups"]))
    before = W.partitionBy("diff_id").orderBy(F.split("dir", "/")).rowsBetween(W.unboundedPreceding, -1)
    folded = folded.withColumn("base", F.coalesce(F.sum(F.element_at("groups", -1) + 1).over(before), F.lit(0)))
    rows = folded.select("diff_id", "dir", "base", F.explode(F.arrays_zip("files", "groups")).alias("z"))
    return rows.select("diff_id", "dir", F.col("z.files.ord").alias("ord"), F.col("z.files.new_path").alias("new_path"), F.col("z.files.tokens").alias("tokens"), (F.col("base") + F.col("z.groups")).cast("int").alias("group_no"))


def split_plan(sizes: DataFrame, max_tokens: int = 64_000, cross_file: bool = True) -> DataFrame:
    """The review groups of every diff: one if it fits the budget, else those of ``pack_groups``; one per file without ``cross_file``."""
    from pyspark.sql import Window as W

    rows = sizes.select("diff_id", F.col("file_ord").alias("ord"), "new_path", "tokens")
    if not cross_file:
        return rows.withColumn("group_no", (F.row_number().over(W.partitionBy("diff_id").orderBy("ord")) - 1).cast("int"))
    whole = sizes.groupBy("diff_id").agg(F.sum("tokens").alias("all_tokens"), F.count("*").alias("n_files"))
    packed = pack_groups(rows, max_tokens).join(whole, "diff_id")
    return packed.withColumn("group_no", F.when((F.col("all_tokens") > max_tokens) & (F.col("n_files") > 1), F.col("group_no")).otherwise(0)).select("diff_id", "ord", "new_path", "tokens", "group_no")
