"""Problem 1: generated, minified, vendored files and data saved as code.

Each text is lexed and re-emitted in a canonical form (one statement or block edge a line), and the
original layout is held against it. Layout is judged first, on texts of any length:

* minified: the canonical form has several times the lines, and the original has next to no optional
  white space;
* data: almost all text outside comments is literals and their punctuation, and there are many (fewer
  in a piece of a file without a single name);
* generated: the blocks of the text are copies of one shape, as no hand keeps them.

What a text measures is a row of sums, so the hunks of a changed file are measured where they are
read and judged together by their sums; no text is shuffled or joined. Who keeps a file cannot be
seen in a layout that looks like any other, so the comments before the first code token count next,
where tools and copies declare themselves, and the folders and name parts that tools and package
managers use last. Words in strings, in later comments, in sentences about other files or inside
longer names (``external_api``, ``generated_report``) say nothing.

Defined results: a null path or content shows nothing by itself; files whose new_path is null or
/dev/null are never cases; repeated rows count once; unknown languages are judged by path only.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .lexing import language_of, scan

#: Folders that hold other projects' code; of the second kind only with a package's folder in them.
VENDOR_DIRS = frozenset("vendor _vendor third_party third-party thirdparty node_modules bower_components jspm_packages Pods Carthage site-packages".split())
VENDOR_WITH_PACKAGE = frozenset("deps extern external".split())
#: Folders that tools write.
GENERATED_DIRS = frozenset("generated __generated__ generated-sources generated-src autogen gen".split())
#: Name parts that tools give to what they write.
GENERATED_NAME = re.compile(
    r"(?:\.generated\.|\.gen\.|\.g\.|_generated\.|_gen\.|\.pb\.|\.pb-c\.|_pb2?\.|_pb2?_grpc\.|_grpc_pb\.|\.tab\.[chy]$|\.designer\.|^zz_generated[_.]|^moc_|^ui_.*\.h$|\.yy\.[ch]$)"
)
MINIFIED_NAME = re.compile(r"(?:[.\-_]min\.(?:js|css|mjs)$|\.bundle\.js$|\.chunk\.js$|\.packed\.js$)")
#: How tools and copies declare themselves at the top of a file: of the file itself, at a sentence's start.
DECLARES = re.compile(
    r"""(?imx) \bcode\ generated\b | \bgenerated\ code\b | @generated\b | \bauto-?\ ?generated\b | \b(?:was|is|been|file)\ automatically\ (?:generated|created|produced)\b | (?:^|[-.;:,*#/(–—]\s*)automatically\ (?:generated|created|produced)\b
    | (?:^|[-.;:,*#/(–—]\s*|\b(?:is|was|been|file|code|source)\ )generated\ (?:from|by|with|using|automatically)\b | (?:^|[-.;:,*#/(–—!]\s*|\bplease\ |\band\ )do\ not\ (?:edit|modify|patch)\b | (?-i:\bDO\ NOT\ (?:EDIT|MODIFY)\b) | \bmachine[- ](?:made|generated|written)\b
    | \bautomatisch\ (?:erzeugt|generiert|erstellt)\b | \bgén[ée]r[ée]\ automatiquement\b | \bgenerado\ autom[áa]ticamente\b | 自動生成
    | \bvendored\ (?:from|copy)\b | \bthird[- ]party\ (?:library|code|copy|source)\b | \bupstream\ copy\b | (?:^|[-.;:,*#/(–—]\s*|\b(?:is|was|been|file|code|source)\ )copied\ (?:verbatim\ )?from\b"""
)
#: A banner of a package: its name and version and no sentence about it, or a kept comment with a single name.
BANNER = re.compile(r"(?m)^\s*(?:/\*!|//!?|#|/\*)\s*[a-z][\w.-]*(?:\s+v?\d+\.\d+(?:\.\d+)*\s*(?:$|\*/|[-|(,–—*])|\s*\*/)")


_SHAPE = {"id": "a", "num": "0", "str": "s", "special": "a"}


def canonical(tokens: list[tuple[str, str, int]]) -> list[str]:
    """The code re-emitted with a line for every statement and block edge, as shapes of tokens."""
    lines: list[str] = []
    now: list[str] = []
    depth = 0
    for kind, tok, _ in tokens:
        if kind == "id" or kind == "op" and tok != ";":
            now.append("a" if kind == "id" else tok)
        elif kind == "nl":
            if depth == 0 and now:
                lines.append(" ".join(now))
                now = []
        elif kind != "com":
            now.append(_SHAPE.get(kind, tok))
            if tok == "(" or tok == "[":
                depth += 1
            elif tok == ")" or tok == "]":
                depth = max(0, depth - 1)
            elif tok == "{" or tok == "}" or tok == ";" and depth == 0:
                lines.append(" ".join(now))
                now = []
    if now:
        lines.append(" ".join(now))
    return lines


#: What a text measures; the first ones add up over the hunks of a file, of the others the largest counts.
SUMS = ("code", "names", "space", "lines", "made", "literals", "values")
LARGEST = ("shaped", "key", "open")


_DATA_OPS = frozenset((",", ":", "=", "-", ";"))


def measured(text: str, tokens: list[tuple[str, str, int]], left: str) -> dict[str, int]:
    """Sums over a lexed text, characters unless said otherwise.

    code, names (also operators that are no punctuation of data), white space but for line ends, lines with code, made (lines of the canonical form), literals and values (their
    number); shaped (lines of the canonical form in blocks of the text's commonest shape if at least
    ten blocks or forty lines have it), key (a key block is in it), open (it ends within a string or comment).
    """
    out = dict.fromkeys((*SUMS, *LARGEST), 0)
    made = canonical(tokens)
    kinds = [k for k, _, _ in tokens]
    lens: dict[str, int] = dict.fromkeys(("com", "nl", "str", "num", "op", "open", "close"), 0)
    for kind, tok, _ in tokens:
        lens[kind] = lens.get(kind, 0) + len(tok)
    out["code"] = sum(lens.values()) - lens["com"] - lens["nl"]
    out["literals"], out["values"] = lens["str"] + lens["num"], kinds.count("str") + kinds.count("num")
    data = sum(len(t) for k, t, _ in tokens if k == "op" and t in _DATA_OPS)
    out["names"] = out["code"] - out["literals"] - lens["open"] - lens["close"] - data
    out["space"] = len(text) - out["code"] - lens["com"] - lens["nl"]
    bare = [k for k in kinds if k != "com"]
    out["lines"] = sum(1 for k, after in zip(bare, [*bare[1:], "nl"]) if after == "nl" and k != "nl")
    out["made"] = len(made)
    if len(made) < 20:
        out["key"], out["open"] = int("-----BEGIN " in text), int(bool(left))
        return out
    blocks = Counter(_blocks(made))
    if blocks:
        (shape, n), = blocks.most_common(1)
        out["shaped"] = n * (shape.count("\n") + 1) if n >= 10 and "\n" in shape or n >= 40 and "(" in shape else 0
    out["key"], out["open"] = int("-----BEGIN " in text), int(bool(left))
    return out


def _blocks(made: list[str]) -> Iterator[str]:
    """The top-level blocks of a canonical form, each as its lines."""
    depth, now = 0, []
    for ln in made:
        now.append(ln)
        depth += ln.count("{") - ln.count("}")
        if depth <= 0:
            if len(now) > 1 or not now[0].endswith("{"):
                yield "\n".join(now)
            now, depth = [], 0


def shows(m) -> str | None:
    """What measures show: 'minified', 'data', 'generated' or None. The same as shows_column."""
    if m["open"] == 0 and m["key"] == 0 and 25 * m["names"] <= 2 * m["code"] and (m["values"] >= 100 or m["literals"] >= 800 or m["names"] == 0 and m["literals"] >= 80):
        return "data"
    if m["made"] >= 3 * m["lines"] and m["lines"] > 0 and 12 * m["space"] <= m["code"] and m["made"] >= 4:
        return "minified"
    return "generated" if m["made"] > 0 and 10 * m["shaped"] >= 9 * m["made"] else None


def shows_column() -> Column:
    c = F.col
    return (
        F.when((c("open") == 0) & (c("key") == 0) & (25 * c("names") <= 2 * c("code")) & ((c("values") >= 100) | (c("literals") >= 800) | (c("names") == 0) & (c("literals") >= 80)), "data")
        .when((c("made") >= 3 * c("lines")) & (c("lines") > 0) & (12 * c("space") <= c("code")) & (c("made") >= 4), "minified")
        .when((c("made") > 0) & (10 * c("shaped") >= 9 * c("made")), "generated")
    )


def opening(tokens: list[tuple[str, str, int]]) -> str:
    """The comments before the first code token, one after the other, without their marks."""
    out = []
    for kind, tok, _ in tokens:
        if kind == "com":
            out.append(tok)
        elif kind != "nl":
            break
    return "\n".join(out)


def declared(head: str) -> str | None:
    """What the comments at the top of a file declare: 'declared', 'vendored' or None."""
    bare = re.sub(r"(?m)^[\s/*#!]+|\*/\s*$", "", head)
    return "declared" if DECLARES.search(bare) else "vendored" if BANNER.search(head) else None


def by_path(path: str | None) -> str | None:
    """What a path shows: 'vendored', 'generated', 'minified' or None."""
    if not path:
        return None
    *dirs, name = path.split("/")
    if VENDOR_DIRS.intersection(dirs) or VENDOR_WITH_PACKAGE.intersection(dirs[:-1]):
        return "vendored"
    if GENERATED_DIRS.intersection(dirs) or GENERATED_NAME.search(name):
        return "generated"
    return "minified" if MINIFIED_NAME.search(name) else None


def by_text(text: str | None, lang: str | None, top: bool = True) -> str | None:
    """What a text shows; ``top`` if it begins where the file does."""
    if not text or lang is None:
        return None
    text = text.replace("\r\n", "\n")
    tokens, left = scan(text, lang)
    return shows(measured(text, tokens, left)) or (declared(opening(tokens)) if top else None)


def why(text: str | None, path: str | None, language: str | None) -> str | None:
    """Why a file is no hand-written source: by layout, by its head, by its path; None if it is."""
    return by_text(text, language_of(None, path) or language_of(language, path)) or by_path(path)


def _source_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        found = [why(t, p, la) for p, la, t in zip(d["path"], d["language"], d["content"])]
        yield pa.RecordBatch.from_arrays(
            [pa.array(d["file_id"], pa.int64()), pa.array(d["repo"], pa.string()), pa.array(d["path"], pa.string()), pa.array(found, pa.string())], ["file_id", "repo", "path", "why"]
        )


def new_text(content: str) -> str:
    """The new side of a hunk."""
    return "\n".join(ln[1:] for ln in content.split("\n") if ln and ln[0] in "+ ")


def _hunk_measures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fields = (*SUMS, *LARGEST)
    for b in batches:
        d = b.to_pydict()
        rows: dict[str, list] = {f: [] for f in fields}
        heads = []
        for path, start, content in zip(d["file_path"], d["new_start"], d["content"]):
            lang, m, head = language_of(None, path), dict.fromkeys(fields, 0), None
            if content and lang:
                text = new_text(content).replace("\r\n", "\n")
                tokens, left = scan(text, lang)
                m = measured(text, tokens, left)
                head = declared(opening(tokens)) if start is None or start <= 1 else None
            for f in fields:
                rows[f].append(m[f])
            heads.append(head)
        yield pa.RecordBatch.from_arrays(
            [*(b.column(b.schema.get_field_index(n)) for n in ("diff_id", "file_ord", "hunk_ord")), pa.array(heads, pa.string()), *(pa.array(rows[f], pa.int64()) for f in fields)],
            ["diff_id", "file_ord", "hunk_ord", "head", *fields],
        )


def _path_flags(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        found = [by_path(p) for p in b.column(b.schema.get_field_index("new_path")).to_pylist()]
        yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.string())], [*b.schema.names, "by_path"])


def flagged_sources(files: DataFrame) -> DataFrame:
    """(file_id, repo, path, why) of every file once; why is null for hand-written files."""
    flags = files.select("file_id", "repo", "path", "language", "content").where("file_id is not null").mapInArrow(
        _source_flags, "file_id bigint, repo string, path string, why string"
    )
    return flags.groupBy("file_id").agg(F.min("repo").alias("repo"), F.min("path").alias("path"), F.min("why").alias("why"))


def flagged_diffs(diff_files: DataFrame, hunks: DataFrame, sources: DataFrame) -> DataFrame:
    """(diff_id, file_ord, why) of the changed files that are not hand-written.

    Hunks are measured where they are read and their measures added up by file, each hunk once.
    """
    files = (
        diff_files.where("diff_id is not null and file_ord is not null and new_path is not null and new_path <> '/dev/null' and new_path <> ''")
        .select("diff_id", "file_ord", "repo", "new_path").dropDuplicates(["diff_id", "file_ord"])
    )
    schema = "diff_id string, file_ord int, hunk_ord int, head string, " + ", ".join(f"{f} bigint" for f in (*SUMS, *LARGEST))
    each = (
        hunks.select("diff_id", "file_ord", "hunk_ord", "file_path", "new_start", "content").where("diff_id is not null and file_ord is not null and hunk_ord is not null")
        .mapInArrow(_hunk_measures, schema)
        .groupBy("diff_id", "file_ord", "hunk_ord").agg(F.min("head").alias("head"), *[F.max(f).alias(f) for f in (*SUMS, *LARGEST)])
    )
    texts = each.groupBy("diff_id", "file_ord").agg(F.min("head").alias("head"), *[F.sum(f).alias(f) for f in SUMS], *[F.max(f).alias(f) for f in LARGEST])
    by_text_ = texts.select("diff_id", "file_ord", F.coalesce(shows_column(), "head").alias("by_text"))
    known = sources.where("why is not null").select("repo", F.col("path").alias("new_path"), "why").dropDuplicates(["repo", "new_path"])
    paths = files.mapInArrow(_path_flags, "diff_id string, file_ord int, repo string, new_path string, by_path string")
    every = paths.join(known, ["repo", "new_path"], "left").join(by_text_, ["diff_id", "file_ord"], "left")
    reason = F.coalesce(F.concat(F.lit("source: "), "why"), "by_text", "by_path")
    return every.select("diff_id", "file_ord", reason.alias("why")).where("why is not null")


def found(files: DataFrame, diff_files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(record_kind, record_key): the cases among source files and changed files."""
    from .common import cut

    flags = cut(flagged_sources(files))
    diffs = flagged_diffs(diff_files, hunks, flags)
    return flags.where("why is not null").select(F.lit("source").alias("record_kind"), F.col("file_id").cast("string").alias("record_key")).union(
        diffs.select(F.lit("diff"), F.concat_ws("#", "diff_id", "file_ord"))
    )
