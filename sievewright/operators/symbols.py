"""Symbols: extraction, chunks, references, the name graph, its ranks and a budgeted map.

``source_files(path, language, content)`` gives ``symbols(path, name, kind, line, end_line,
signature, scope, token_cost, content)`` and ``refs(from_file, from_symbol, to_name, line)`` in one
pass. Python is parsed by its own parser; the other languages by declaration patterns over a text
whose comments and strings are blanked, so names in them do not count. That is less than a grammar
gives: bodies are found by brackets, and a declaration has to begin on a line of its own.
"""

from __future__ import annotations

import ast
import re
import warnings
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text
from ..functions.scores import KIND_LABELS, lookup
from ..plans.lineage import checkpointed

MAX_BYTES = 1_048_576
SNIFF_BYTES = 8192

_C_LIKE = r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)'"
_BLANK = {
    "rust": re.compile(r"//[^\n]*|/\*.*?\*/|r(#*)\".*?\"\1|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\\n]|\\.)'", re.S),
    "go": re.compile(_C_LIKE + r"|`[^`]*`", re.S),
    "javascript": re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`", re.S),
    "ruby": re.compile(r"#[^\n]*|\"(?:[^\"\\]|\\.)*\"|'(?:[^'\\]|\\.)*'|^=begin.*?^=end", re.S | re.M),
    "python": re.compile(r"#[^\n]*"),
}
for _n in ("java", "c", "cpp", "kotlin", "swift", "php"):
    _BLANK[_n] = re.compile(_C_LIKE + (r"|'(?:[^'\\\n]|\\.)*'|#[^\n]*" if _n == "php" else ""), re.S)
_BLANK["typescript"] = _BLANK["javascript"]

_W = r"[^\W\d]\w*"
_JS = [
    ("Function", rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:async[ \t]+)?function[ \t]*\*?[ \t]*(?P<n>{_W})"), ("Class", rf"^[ \t]*(?:export[ \t]+)?(?:default[ \t]+)?(?:abstract[ \t]+)?class[ \t]+(?P<n>{_W})"),
    ("Function", rf"^[ \t]*(?:export[ \t]+)?(?:const|let|var)[ \t]+(?P<n>{_W})[^=\n]*=[ \t]*(?:async[ \t]*)?(?:\([^)\n]*\)|{_W})[^=\n]*=>"),
    ("Method", rf"^[ \t]+(?:(?:public|private|protected|static|async|readonly|get|set|override)[ \t]+)*(?!if\b|for\b|while\b|switch\b|catch\b|return\b|function\b)(?P<n>{_W})[ \t]*\([^;{{}}\n]*\)[^;{{}}=\n]*\{{"),
]
#: kind and pattern of a declaration by language; group n is the name
_DECLARES: dict[str, list[tuple[str, str]]] = {
    "rust": [
        ("Function", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:(?:const|async|unsafe|extern(?:[ \t]+\"[^\"]*\")?)[ \t]+)*fn[ \t]+(?P<n>{_W})"), ("Struct", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?struct[ \t]+(?P<n>{_W})"),
        ("Enum", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?enum[ \t]+(?P<n>{_W})"), ("Trait", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?(?:unsafe[ \t]+)?trait[ \t]+(?P<n>{_W})"),
        ("Impl", rf"^[ \t]*(?:unsafe[ \t]+)?impl(?:<[^>{{]*>)?[ \t]+(?P<n>{_W})"), ("Module", rf"^[ \t]*(?:pub(?:\([^)]*\))?[ \t]+)?mod[ \t]+(?P<n>{_W})"),
    ],
    "go": [
        ("Method", rf"^func[ \t]*\([^)\n]*\)[ \t]*(?P<n>{_W})"), ("Function", rf"^func[ \t]+(?P<n>{_W})"), ("Struct", rf"^type[ \t]+(?P<n>{_W})[ \t]+struct\b"), ("Interface", rf"^type[ \t]+(?P<n>{_W})[ \t]+interface\b"),
    ],
    "javascript": _JS,
    "typescript": [*_JS, ("Interface", rf"^[ \t]*(?:export[ \t]+)?interface[ \t]+(?P<n>{_W})"), ("Enum", rf"^[ \t]*(?:export[ \t]+)?(?:const[ \t]+)?enum[ \t]+(?P<n>{_W})")],
    "java": [
        ("Class", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract|sealed)[ \t]+)*class[ \t]+(?P<n>{_W})"), ("Interface", rf"^[ \t]*(?:(?:public|private|protected|static|sealed)[ \t]+)*interface[ \t]+(?P<n>{_W})"),
        ("Enum", rf"^[ \t]*(?:(?:public|private|protected|static)[ \t]+)*enum[ \t]+(?P<n>{_W})"),
        ("Method", rf"^[ \t]+(?:(?:public|private|protected|static|final|abstract|synchronized|native)[ \t]+)*(?:<[^>\n]*>[ \t]+)?(?!return\b|new\b|else\b|throw\b)(?:[\w.<>\[\],? ]+[ \t]+)?(?!if\b|for\b|while\b|switch\b|catch\b)(?P<n>{_W})[ \t]*\([^;{{}}\n]*\)[^;{{}}=\n]*\{{"),
    ],
    "c": [
        ("Struct", rf"^[ \t]*(?:typedef[ \t]+)?struct[ \t]+(?P<n>{_W})[ \t]*\{{"), ("Enum", rf"^[ \t]*(?:typedef[ \t]+)?enum[ \t]+(?P<n>{_W})[ \t]*\{{"),
        ("Function", rf"^(?!return\b|else\b|typedef\b)(?:[\w*]+[ \t*]+)+\**(?P<n>{_W})[ \t]*\([^;{{}}]*\)\s*[{{;]"),
    ],
    "ruby": [("Method", rf"^[ \t]*def[ \t]+(?:self\.)?(?P<n>{_W}[?!=]?)"), ("Class", rf"^[ \t]*class[ \t]+(?P<n>[A-Z]\w*)"), ("Module", rf"^[ \t]*module[ \t]+(?P<n>[A-Z]\w*)")],
    "php": [
        ("Function", rf"^[ \t]*(?:(?:public|private|protected|static|final|abstract)[ \t]+)*function[ \t]+&?(?P<n>{_W})"), ("Class", rf"^[ \t]*(?:(?:final|abstract)[ \t]+)*class[ \t]+(?P<n>{_W})"),
        ("Interface", rf"^[ \t]*interface[ \t]+(?P<n>{_W})"), ("Trait", rf"^[ \t]*trait[ \t]+(?P<n>{_W})"), ("Module", r"^[ \t]*namespace[ \t]+(?P<n>[\w\\]+)"),
    ],
    "kotlin": [("Function", rf"^[ \t]*(?:\w+[ \t]+)*fun[ \t]+(?:<[^>]*>[ \t]*)?(?:{_W}\.)?(?P<n>{_W})"), ("Interface", rf"^[ \t]*(?:\w+[ \t]+)*interface[ \t]+(?P<n>{_W})"), ("Class", rf"^[ \t]*(?:(?!interface)\w+[ \t]+)*(?:class|object)[ \t]+(?P<n>{_W})")],
    "swift": [
        ("Function", rf"^[ \t]*(?:\w+[ \t]+)*func[ \t]+(?P<n>{_W})"), ("Class", rf"^[ \t]*(?:\w+[ \t]+)*class[ \t]+(?!func\b|var\b)(?P<n>{_W})"), ("Struct", rf"^[ \t]*(?:\w+[ \t]+)*struct[ \t]+(?P<n>{_W})"),
        ("Enum", rf"^[ \t]*(?:\w+[ \t]+)*enum[ \t]+(?P<n>{_W})"), ("Interface", rf"^[ \t]*(?:\w+[ \t]+)*protocol[ \t]+(?P<n>{_W})"),
    ],
}
_DECLARES["cpp"] = [("Class", rf"^[ \t]*(?:template[ \t]*<[^>]*>[ \t]*)?class[ \t]+(?P<n>{_W})[^;{{]*\{{"), *_DECLARES["c"]]
_COMPILED = {k: [(kind, re.compile(p, re.M)) for kind, p in v] for k, v in _DECLARES.items()}
#: Kinds that hold members and give them their scope.
_HOLDERS = {"Struct", "Enum", "Trait", "Impl", "Class", "Interface"}
_WORD = re.compile(rf"(?<![\w.]){_W}|(?<=\.){_W}")
_CONTROL = frozenset("if else for while loop match switch catch return do try".split())
_RESERVED = frozenset("if else for while loop match return let mut fn pub use struct enum trait impl self Self super crate as in func package import var const type range go defer def class end do then module require true false nil null None True False function export default public private protected static final void int long char float double boolean new this await async try catch throw raise elif except with lambda not and or is from switch case break continue print string number".split())


def _blanked(content: str, language: str) -> str:
    return _BLANK[language].sub(lambda m: re.sub(r"[^\n]", " ", m.group(0)), content)


def _sign(body: str) -> str:
    head = body.split("{", 1)[0] if "{" in body else body.split(":", 1)[0]
    return " ".join(head.split())


def _body_end(clean: str, start: int, language: str) -> int:
    """Where the declaration that begins at ``start`` ends."""
    if language == "ruby":
        indent = re.match(r"[ \t]*", clean[start:]).group()
        m = re.compile(rf"^{indent}end\b", re.M).search(clean, start + 1)
        return m.end() if m else len(clean)
    depth, opened = 0, False
    for m in re.compile(r"[{};]").finditer(clean, start):
        if m.group() == "{":
            depth, opened = depth + 1, True
        elif m.group() == "}":
            depth -= 1
            if depth <= 0:
                return m.end()
        elif not opened:
            return m.end()
    return len(clean)


def _python_symbols(content: str) -> list[dict] | None:
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            tree = ast.parse(content)
        except (SyntaxError, ValueError, RecursionError):
            return None
    rows, lines = [], content.split("\n")

    def visit(node: ast.AST, scope: str | None, in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                kind = "Class" if isinstance(child, ast.ClassDef) else "Method" if in_class else "Function"
                body = "\n".join(lines[child.lineno - 1:child.end_lineno])
                rows.append({"name": child.name, "kind": kind, "line": child.lineno, "end_line": child.end_lineno, "scope": scope, "content": body, "signature": _sign(body.lstrip())})
                visit(child, child.name if kind == "Class" else scope, kind == "Class")
            else:
                visit(child, scope, in_class)

    visit(tree, None, False)
    return rows


def symbols_of(content: str, language: str) -> list[dict]:
    """The symbols of a text: name, kind, line, end_line, scope, signature, content."""
    if language == "python":
        found = _python_symbols(content)
        if found is not None:
            return found
        clean = _BLANK["python"].sub(lambda m: " " * len(m.group()), content)
        rules = [("Function", re.compile(rf"^(?:async[ \t]+)?def[ \t]+(?P<n>{_W})", re.M)), ("Method", re.compile(rf"^[ \t]+(?:async[ \t]+)?def[ \t]+(?P<n>{_W})", re.M)), ("Class", re.compile(rf"^[ \t]*class[ \t]+(?P<n>{_W})", re.M))]
    elif language in _COMPILED:
        clean, rules = _blanked(content, language), _COMPILED[language]
    else:
        return []
    starts = [0, *(m.end() for m in re.finditer("\n", content))]
    rows, taken = [], set()
    for kind, rx in rules:
        for m in rx.finditer(clean):
            at = m.start("n")
            if at in taken or m.group("n") in _CONTROL:
                continue
            taken.add(at)
            begin = m.start() + len(m.group()) - len(m.group().lstrip())
            line = bisect_right(starts, begin)
            end = _body_end(clean, starts[line - 1], language) if language != "python" else clean.find("\n", begin) % (len(clean) + 1)
            body = content[begin:end]
            rows.append({"name": m.group("n"), "kind": kind, "line": line, "end_line": bisect_right(starts, max(end - 1, begin)), "scope": None, "content": body, "signature": _sign(body), "_span": (begin, end)})
    holders = [r for r in rows if r["kind"] in _HOLDERS]
    for r in rows:
        inside = [h for h in holders if h is not r and h["_span"][0] < r["_span"][0] and r["_span"][1] <= h["_span"][1]]
        if inside:
            holder = max(inside, key=lambda h: h["_span"][0])
            r["scope"] = holder["name"]
            if r["kind"] == "Function":
                r["kind"] = "Method"
    rows.sort(key=lambda r: (r["line"], r["_span"]))
    return rows


def refs_of(content: str, language: str, found: list[dict]) -> list[dict]:
    """Names used in a text, with the innermost symbol around them; definitions are no uses."""
    if language not in _BLANK:
        return []
    clean = _blanked(content, language)
    if language == "python":
        clean = re.sub(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", lambda m: " " * len(m.group()), clean)
    defined = {(r["line"], r["name"]) for r in found}
    spans = sorted((r["line"], -r["end_line"], r["name"]) for r in found if r["kind"] not in ("Module",))
    rows = []
    for no, line in enumerate(clean.split("\n"), 1):
        around = None
        for a, b, name in spans:
            if a > no:
                break
            if -b >= no:
                around = name
        for m in _WORD.finditer(line):
            w = m.group()
            if w not in _RESERVED and (no, w) not in defined:
                rows.append({"from_symbol": around, "to_name": w, "line": no})
    return rows


SYMBOLS = "path string, language string, name string, kind string, line bigint, end_line bigint, scope string, signature string, content string"
REFS = "path string, from_symbol string, to_name string, line bigint"


def _extracted(refs: bool):
    schema = REFS if refs else SYMBOLS
    names = [p.split()[0] for p in schema.split(", ")]
    kinds = [pa.int64() if p.endswith("bigint") else pa.string() for p in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[dict] = []
            for path, lang, content in zip(*(b.column(i).to_pylist() for i in range(3))):
                if not content or not lang:
                    continue
                found = symbols_of(content, lang)
                rows += [{"path": path, "language": lang, **r} for r in (refs_of(content, lang, found) if refs else found)]
            yield pa.RecordBatch.from_arrays([pa.array([r.get(n) for r in rows], t) for n, t in zip(names, kinds)], names)

    return run


def readable(files: DataFrame, key: str = "path") -> DataFrame:
    """(key, language, content) of files that count: known language, not too large, no NUL near the top; each path once.

    The language is that of the extension.
    """
    lang = text.language(text.extension("path"))
    return (
        files.where(F.col("content").isNotNull() & (F.octet_length("content") <= MAX_BYTES) & (lang != "unknown") & (F.locate("\u0000", F.substring("content", 1, SNIFF_BYTES)) == 0))
        .select(F.col(key).alias("path"), lang.alias("language"), "content").dropDuplicates(["path"])
    )


def symbols(files: DataFrame) -> DataFrame:
    """One row per symbol of readable files, with its token cost: bytes of the signature div 4."""
    return files.select("path", "language", "content").mapInArrow(_extracted(False), SYMBOLS).withColumn("token_cost", text.token_estimate("signature"))


def references(files: DataFrame) -> DataFrame:
    return files.select("path", "language", "content").mapInArrow(_extracted(True), REFS)


def code_chunks(files: DataFrame) -> DataFrame:
    """Chunks of readable files, one per entity; an impl or module is a scope and no chunk."""
    rows = symbols(files).where("kind not in ('Impl', 'Module')")
    kind = F.lower("kind")
    return rows.select(
        F.col("path").alias("file_path"), F.col("line").alias("start_line"), "end_line", F.col("name").alias("entity_name"), kind.alias("entity_type"), "language", "content",
        text.context_header(F.col("path"), kind, F.col("name"), F.col("scope"), F.col("signature")).alias("context_header"), text.content_hash("content").alias("content_hash"),
    )


def identified(rows: DataFrame) -> DataFrame:
    """Symbols with a stable ``sym_id`` in the order of path, line and name."""
    return rows.withColumn("sym_id", F.xxhash64("path", "line", "name", "kind"))


# ------------------------------------------------------------------ graph

def name_edges(symbol_rows: DataFrame, refs: DataFrame, by: str | None = None) -> DataFrame:
    """(from_id, to_id, m): references resolved by name, parallel ones counted.

    A name stands for its first symbol, by path and line (within ``by``, such as a repo, if given).
    References without an enclosing symbol, unresolved names and self-references give no edge.
    """
    scope = [by] if by else []
    order = F.struct("path", "line", "sym_id")
    first = symbol_rows.groupBy(*scope, "name").agg(F.min_by("sym_id", order).alias("sym_id"))
    uses = refs.where("from_symbol is not null").groupBy(*scope, "from_symbol", "to_name").agg(F.count("*").alias("m"))
    to = first.select(*scope, F.col("name").alias("to_name"), F.col("sym_id").alias("to_id"))
    source = first.select(*scope, F.col("name").alias("from_symbol"), F.col("sym_id").alias("from_id"))
    joined = uses.join(to, [*scope, "to_name"]).join(source, [*scope, "from_symbol"])
    return joined.where("from_id <> to_id").groupBy("from_id", "to_id").agg(F.sum("m").alias("m"))


def pagerank(nodes: DataFrame, edges: DataFrame, damping: float = 0.85, rounds: int = 20, cut_every: int = 10) -> DataFrame:
    """(sym_id, rank) after exactly ``rounds`` synchronous rounds from 1/N.

    The base is (1 - d)/N over all nodes; an edge carries d * rank * m / out-degree with parallel
    edges counted; what nodes without edges hold is dropped, so ranks need not add up to 1. Edges
    are weighted once and kept partitioned by their source; lineage is cut by checkpoints.
    """
    n = nodes.select(F.count("*").alias("n"))
    out = edges.groupBy("from_id").agg(F.sum("m").alias("out"))
    weighted = checkpointed(edges.join(out, "from_id").select("from_id", "to_id", (damping * F.col("m") / F.col("out")).alias("w")).join(nodes.select(F.col("sym_id").alias("to_id")), "to_id", "left_semi").repartition("from_id"))
    start = checkpointed(nodes.select("sym_id").join(F.broadcast(n)).select("sym_id", ((1.0 - damping) / F.col("n")).alias("base"), (1.0 / F.col("n")).alias("rank")))
    base = start.select("sym_id", F.col("base").alias("got"))
    ranks = start.select("sym_id", "rank")
    for i in range(rounds):
        # the sum over the base and what came in: one shuffle a round, by the key of the next round's join
        sent = weighted.join(ranks, weighted.from_id == ranks.sym_id).select(F.col("to_id").alias("sym_id"), (F.col("rank") * F.col("w")).alias("got"))
        ranks = base.unionByName(sent).groupBy("sym_id").agg(F.sum("got").alias("rank"))
        if (i + 1) % cut_every == 0 and i + 1 < rounds:
            ranks = checkpointed(ranks)
    return ranks


def focused(ranked: DataFrame, focus: list[str], boost: float = 2.0) -> DataFrame:
    """Symbols with ``order_rank``: the rank, doubled for files in focus."""
    weight = F.when(F.col("path").isin(*focus), boost).otherwise(1.0) if focus else F.lit(1.0)
    return ranked.withColumn("order_rank", F.col("rank") * weight)


def fit_budget(ranked: DataFrame, max_tokens: int, by: list[str] | None = None) -> DataFrame:
    """The prefix by rank whose costs, at least 1 each, stay within the budget.

    Costs are whole and at least 1, so at most ``max_tokens`` symbols can be in: the best that many
    are taken first, and the running sum goes over them alone.
    """
    order = [F.col("order_rank").desc(), F.col("sym_id")]
    if not by:
        few = ranked.orderBy(*order).limit(max(max_tokens, 0)).withColumn("_one", F.lit(1))
        run = W.partitionBy("_one").orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
        return few.withColumn("used_tokens", F.sum(F.greatest("token_cost", F.lit(1))).over(run)).where(F.col("used_tokens") <= max_tokens).drop("_one")
    few = ranked.withColumn("_place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("_place") <= max_tokens)
    run = W.partitionBy(*by).orderBy(*order).rowsBetween(W.unboundedPreceding, 0)
    return few.withColumn("used_tokens", F.sum(F.greatest("token_cost", F.lit(1))).over(run)).where(F.col("used_tokens") <= max_tokens).drop("_place")


def map_stats(files: DataFrame, symbol_rows: DataFrame) -> DataFrame:
    """One row: file and symbol counts and the sorted languages."""
    f = files.agg(F.count("*").alias("files"), F.array_sort(F.collect_set("language")).alias("languages"))
    return f.join(F.broadcast(symbol_rows.agg(F.count("*").alias("symbols"))))


def map_lines(picked: DataFrame, style: str = "text") -> DataFrame:
    """(path, section): the map's section of every file, symbols in line order; see ``render`` for the whole."""
    label = lookup(KIND_LABELS, "kind")
    rows = picked.withColumn("label", label).groupBy("path").agg(F.array_sort(F.collect_list(F.struct("line", "sym_id", "label", "signature", text.truncate_bytes("signature").alias("cut")))).alias("s"))
    if style == "markdown":
        body = F.array_join(F.transform("s", lambda x: F.concat(F.lit("- **"), x["label"], F.lit("** `"), x["signature"], F.lit("`\n"))), "")
        return rows.select("path", F.concat(F.lit("## `"), "path", F.lit("`\n\n"), body, F.lit("\n")).alias("section"))
    rows = rows.join(F.broadcast(rows.agg(F.max("path").alias("_last")))).withColumn("is_last", F.col("path") == F.col("_last"))
    child = F.when(F.col("is_last"), "    ").otherwise("│   ")
    body = F.array_join(F.transform("s", lambda x, i: F.concat(child, F.when(i == F.size("s") - 1, "└── ").otherwise("├── "), x["label"], F.lit(" "), x["cut"], F.lit("\n"))), "")
    return rows.select("path", F.concat(F.when(F.col("is_last"), "└── ").otherwise("├── "), "path", F.lit("\n"), body).alias("section"))
