"""Problem 6: source files that do not parse.

A file is cut into chunks at lines that begin a declaration of their own. A chunk is a map from the
lexer state it may be entered in to a summary: the state it is left in, the brackets it closes that
were opened before, the brackets it leaves open, its last token and its first fault. Summaries
compose associatively (``fold``), so the chunks of a long file are summarised in different tasks and
reduced. The reduced file is invalid if it leaves a string, comment or bracket open, or a bracket
closes another kind.

The reduction also says where no bracket is open and the statement before has ended. Between such
places stand balanced statements; they are parsed by the local grammars of their language: of what
may stand between two brackets (``grammars``), of Ruby's lines and words, of Python's logical lines,
each parsed alone in a normalised form with its indentation followed. One chunk or many, the verdict
is that of the whole text.

C: of the branches of a conditional directive the first is read (the other one of ``#if 0``).
Markup in JavaScript and TypeScript is lexed: tags have to match, and the code in its {holes} is
checked like any other.

Defined results: capitals and outer blanks in ``language`` do not matter; a null language means
that of the path's extension; unknown names, null and empty contents are valid; repeated rows
count once (a file_id is flagged once).
"""

from __future__ import annotations

import ast
import re
import warnings
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .grammars import fault_of
from .lexing import entry_states, language_of, scan

PAIRS = {")": "(", "]": "[", "}": "{", "end": "k"}

# ------------------------------------------------------------------ Ruby

#: Ruby's words.
RUBY_OPEN = frozenset("def class module begin case for do".split())
RUBY_MAYBE = frozenset("if unless while until".split())
RUBY_MIDDLE = frozenset("else elsif when in rescue ensure then".split())
RUBY_PREFIX = frozenset("return not and or then else elsif when do yield puts raise require require_relative include extend attr_accessor attr_reader attr_writer private public protected alias undef super in case if unless while until begin ensure rescue defined? class module def p print loop break next".split())


def _ruby(tokens: list) -> tuple[list[str], list[str], str | None]:
    """Unmatched closers, unmatched openers and first fault of a Ruby chunk."""
    stack: list[str] = []
    closers: list[str] = []
    state, prev, at_start, loop_line = "start", "", True, False
    commands = 0
    sig = [t for t in tokens if t[0] != "com"]
    in_def, for_open = False, False
    aliased = False
    edge, dotted, before = 0, False, ""  # where the token before ends; of a command: whether its receiver has a dot
    for kind, tok, at in sig:
        touches, edge = at == edge, at + len(tok)
        if in_def and tok == "=" and stack and stack[-1] == "k" and prev != "def":
            if not touches:  # a definition without an end
                stack.pop()
                in_def, state, prev = False, "op", tok
            continue
        if kind == "nl":
            if for_open:
                return closers, stack, "for without in"
            if state == "op" and prev not in ("|", "*", "&", "?", "!", ","):
                if prev == ":":
                    return closers, stack, ": at the line's end"
            if state != "op":
                state, at_start, commands, in_def = "start", True, 0, False
                loop_line = False
            continue
        if kind == "bad":
            return closers, stack, f"stray {tok!r}"
        if kind == "conflict":
            return closers, stack, "conflict marker"
        if tok == ";":
            state, at_start, prev, commands, in_def = "start", True, tok, 0, False
            continue
        if kind == "id" and prev not in (".", "&.", "::", "def") and not (in_def and prev == "def"):
            if tok == "end":
                if state == "op" and prev not in ("|", ")"):
                    return closers, stack, f"{prev} end"
                if stack:
                    if stack[-1] != "k":
                        return closers, stack, f"{stack[-1]} end"
                    stack.pop()
                else:
                    closers.append("end")
                state, at_start, prev = "operand", False, tok
                continue
            if tok in RUBY_MIDDLE and not (tok == "in" and for_open):
                if stack and stack[-1] != "k" and tok != "then":
                    return closers, stack, f"{tok} in {stack[-1]}"
                if tok in ("else", "elsif", "when", "ensure") and state == "op":
                    return closers, stack, f"{prev} {tok}"
                if tok == "rescue" and not at_start:
                    state, prev = "op", tok
                    continue
                state, at_start, prev, commands = "start" if tok in ("else", "then", "ensure", "rescue") else "op", tok in ("else", "then", "ensure"), tok, 0
                continue
            if tok == "in" and for_open:
                for_open, state, prev = False, "op", tok
                continue
            if tok in RUBY_OPEN or tok in RUBY_MAYBE:
                if tok == "do":
                    if loop_line:
                        loop_line, state, at_start, prev = False, "start", True, tok
                        continue
                    if state == "op":
                        return closers, stack, f"{prev} do"
                    stack.append("k")
                    state, at_start, prev, commands = "start", True, tok, 0
                    continue
                if tok in RUBY_MAYBE and not (at_start or state == "op" or prev == "|"):
                    state, prev = "op", tok  # a modifier
                    continue
                if state == "operand" and not at_start:
                    return closers, stack, f"{prev} {tok}"
                stack.append("k")
                loop_line = tok in ("while", "until", "for")
                for_open = tok == "for"
                in_def = tok == "def"
                state, at_start, prev = ("start" if tok == "begin" else "op"), tok == "begin", tok
                continue
        if kind in ("id", "num", "str", "special"):
            if state == "operand":
                command = (commands <= (1 if dotted else 0) or aliased) and (prev_kind == "id" or prev_kind == "special" and prev[-1] in "?!$" or aliased) and not any(b == "(" for b in stack[-1:])
                if tok in ("and", "or", "not", "rescue"):
                    state, prev = "op", tok
                    continue
                if not (command or prev in RUBY_PREFIX or prev_kind == "str" and kind == "str" or kind == "special" and tok.endswith(":")):
                    return closers, stack, f"{prev[:20]} {tok[:20]}"
                if not commands:
                    dotted = before == "."
                commands += 1
            if at_start:
                commands, dotted, aliased = 0, False, tok in ("alias", "undef")
            before = prev
            state, at_start, prev, prev_kind = "operand", False, tok, kind
            if kind == "special" and tok.endswith(":"):
                state = "op"
            if kind == "id" and tok in RUBY_PREFIX:
                state = "maybe"
            continue
        if kind == "open":
            stack.append(tok)
            state, at_start, prev, prev_kind = "first", tok == "{", tok, kind
            if tok == "{":
                commands = 0
            continue
        if kind == "close":
            if state == "op" and prev not in ("|", ",", "*", "&") and not (prev.endswith(":") and len(prev) > 1):
                return closers, stack, f"{prev} {tok}"
            if stack:
                if stack[-1] != PAIRS[tok]:
                    return closers, stack, f"{stack[-1]} {tok}"
                stack.pop()
            else:
                closers.append(tok)
            state, at_start, prev, prev_kind = "operand", False, tok, kind
            continue
        if tok == "|":
            state, at_start, prev, prev_kind = "maybe", False, tok, kind
            continue
        if state in ("op", "start", "first") and tok not in ("-", "+", "!", "~", "*", "&", "**", "::", "->", "..", "...", "[", ":", "?", "<<"):
            if not (state == "start" and tok in (".", "&.") or prev == "def" or tok == "," and prev.endswith(":") and len(prev) > 1):
                return closers, stack, f"{prev[:20] or 'start'} {tok}"
        if state == "op" and tok == ":" and prev != "?":
            return closers, stack, f"{prev} :"
        if in_def and tok == ":" and state == "operand":
            return closers, stack, "def with a colon"
        if tok == "->" and state == "operand":
            return closers, stack, f"{prev[:20]} ->"
        state, at_start, prev, prev_kind = "op", False, tok, kind
    if state == "op" and prev not in ("|",):
        return closers, stack, f"{prev} at the end"
    if for_open:
        return closers, stack, "for without in"
    return closers, stack, None


# ------------------------------------------------------------------ Python

_PYTHON_WORDS = frozenset("False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda nonlocal not or pass raise return try while with yield match case type print exec".split())
#: Headers that need an earlier clause: what is put before them, to be parsed alone.
_CLAUSE = {"elif": "if x:\n pass\n", "else": "if x:\n pass\n", "except": "try:\n pass\n", "finally": "try:\n pass\n", "case": "match x:\n "}
_FOLLOWS = {"elif": {"if", "elif"}, "else": {"if", "elif", "for", "while", "except", "async"}, "except": {"try", "except"}, "finally": {"try", "except", "else"}}


@lru_cache(maxsize=65536)
def _python_statement(shape: str, word: str) -> bool:
    text = shape
    if shape.endswith(":"):
        text += "\n case x:\n  pass" if word == "match" else "\n  pass" if word == "case" else "\n pass"
    if word == "try":
        text += "\nfinally:\n pass"
    text = _CLAUSE.get(word, "") + text
    if word == "@":
        text += "\ndef x(): pass"
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        try:
            ast.parse(text)
            return True
        except (SyntaxError, ValueError, MemoryError, RecursionError):
            return False


def _python(text: str, tokens: list) -> str | None:
    """The first fault of the statements of a balanced text."""
    depth, line = 0, []
    levels, due = [], False
    last: dict[int, str] = {}
    for tok in [*tokens, ("nl", "\n", len(text))]:
        kind, t, at = tok
        if kind in ("bad", "conflict"):
            return f"stray {t[:12]!r}"
        if kind == "com":
            continue
        if kind == "open":
            depth += 1
        elif kind == "close":
            depth -= 1
        if kind != "nl" or depth > 0:
            if kind != "nl":
                line.append(tok)
            continue
        if depth < 0:
            depth, line = 0, []
            continue
        if not line:
            continue
        start = line[0][2]
        begin = text.rfind("\n", 0, start) + 1
        indent = len(text[begin:start].expandtabs(8)) if not text[begin:start].strip() else 0
        if text[begin:start].startswith("﻿"):
            indent = 0
        if not levels:
            if indent:
                return "indent at the start"
            levels = [indent]
        if due:
            if indent <= levels[-1]:
                return "no block"
            levels.append(indent)
        elif indent > levels[-1]:
            return "stray indent"
        while indent < levels[-1]:
            last.pop(levels.pop(), None)
            if not levels:
                return "dedent"
        if indent != levels[-1]:
            return "dedent to no block"
        word = line[0][1] if line[0][0] in ("id", "op") else ""
        if word in _FOLLOWS and last.get(indent, "") not in _FOLLOWS[word]:
            return f"{word} without its clause"
        shape = " ".join(
            t if k in ("op", "open", "close") or t in _PYTHON_WORDS else "x" if k == "id" else "0" if k == "num" else "'s'" for k, t, _ in line
        )
        if not _python_statement(shape, word) and not (_CLAUSE.get(word) and _python_statement(shape, "")):
            return shape[:60]
        last[indent] = word
        due = line[-1][1] == ":" and line[-1][0] == "op"
        line = []
    if due:
        return "no block at the end"
    return None


# ------------------------------------------------------------------ chunks

#: Words that begin a declaration or statement of its own at the left margin.
_BEGIN = {
    "python": "def class import from if for while with try async @",
    "rust": "pub fn use mod struct enum trait impl const static unsafe extern type async #[",
    "go": "func type var const import",
    "javascript": "function class import export const let var async if for while switch try",
    "java": "public private protected class interface enum record import abstract final @",
    "c": "static extern typedef struct union enum int void char long unsigned const inline #",
    "ruby": "def class module require require_relative",
}
_BEGIN["typescript"] = _BEGIN["javascript"] + " interface type enum declare namespace abstract"


@lru_cache(maxsize=None)
def _cuts(lang: str) -> re.Pattern:
    words = [w for w in _BEGIN[lang].split() if w[0].isalpha()]
    marks = [re.escape(w) for w in _BEGIN[lang].split() if not w[0].isalpha()]
    return re.compile(rf"(?m)(?<!\\\n)^(?:(?:{'|'.join(words)})\b{''.join('|' + m for m in marks)})")


def split_chunks(text: str, size: int, lang: str) -> list[str]:
    """The text in pieces of at least ``size`` characters, cut where a line begins a declaration."""
    out, at = [], 0
    while len(text) - at > size and (m := _cuts(lang).search(text, at + size)):
        out.append(text[at:m.start()])
        at = m.start()
    return [*out, text[at:]]


_DIRECTIVE = re.compile(r"[ \t]*#[ \t]*(?:(?P<if>if|ifdef|ifndef)|(?P<else>else|elif|elifdef|elifndef)|(?P<end>endif))\b(?P<zero>[ \t]+0[ \t]*$)?")


def taken(text: str) -> tuple[str, str | None]:
    """C with the branches blanked that are not read, and the fault of its conditionals."""
    if not re.search(r"(?m)^[ \t]*#[ \t]*(?:if|el|endif)", text):
        return text, None
    out, stack = [], []  # of each open conditional: whether its branch is read, and whether one has been
    more = False
    for line in text.split("\n"):
        m = _DIRECTIVE.match(line)
        if more:  # a directive over several lines
            more = line.endswith("\\")
            out.append("")
        elif m:
            more = line.endswith("\\")
            if m.group("if"):
                stack.append([not m.group("zero"), not m.group("zero")])
            elif not stack:
                return text, f"{m.group().strip()} without #if"
            elif m.group("end"):
                stack.pop()
            else:
                stack[-1] = [not stack[-1][1], True]
            out.append("")
        else:
            out.append(line if all(s[0] for s in stack) else "")
    return "\n".join(out), "#if left open" if stack else None


def _brackets(tokens: list) -> tuple[list[str], list[str], str | None]:
    """Closers of brackets opened before, brackets left open, first fault."""
    closers, openers = [], []
    for kind, tok, _ in tokens:
        if kind == "open":
            openers.append(tok)
        elif kind == "close":
            if openers:
                if openers.pop() != PAIRS[tok]:
                    return closers, openers, f"closed by {tok}"
            else:
                closers.append(tok)
        elif kind == "conflict":
            return closers, openers, "conflict marker"
        elif kind == "bad":
            return closers, openers, f"stray {tok[:12]!r}"
    return closers, openers, None


def summarise(text: str, lang: str, state: str = "", markup: bool = True, lexed: tuple[list, str] | None = None) -> tuple[str, str, str, str, str | None]:
    """(state at the end, closers, openers, last token, first fault) of a chunk entered in ``state``."""
    tokens, left = lexed or scan(text, lang, state, markup=markup)
    if lang == "ruby":
        closers, openers, _ = _ruby(tokens)
        bad = next((f"stray {t[:12]!r}" if k == "bad" else "conflict marker" for k, t, _ in tokens if k in ("bad", "conflict")), None)
    else:
        closers, openers, bad = _brackets(tokens)
    last = next((t for k, t, _ in reversed(tokens) if k not in ("com", "nl") and not (lang == "c" and k == "special")), "")
    return left, " ".join(closers), " ".join(openers), last[-1:], bad


def state_map(text: str, lang: str, whole: bool = False) -> dict[str, tuple]:
    """The summary of a chunk for every state it may be entered in; absent states pass through."""
    return {s: summarise(text, lang, s) for s in ([""] if whole else entry_states(text, lang))}


def _through(m: dict[str, tuple], state: str) -> tuple[str, str, str, str, str | None]:
    """What a map says of a state; a chunk that cannot end it lies within it."""
    return m.get(state, (state, "", "", "", None))


def fold(a: dict[str, tuple], b: dict[str, tuple]) -> dict[str, tuple]:
    """Two neighbouring chunks' maps as one; the operation is associative."""
    out = {}
    for s in {*a, *b}:
        mid, close_a, open_a, last_a, bad_a = _through(a, s)
        end, close_b, open_b, last_b, bad_b = _through(b, mid)
        stack, close, bad = open_a.split(), close_b.split(), bad_a or bad_b
        while stack and close:
            if stack[-1] != PAIRS[close[0]]:
                bad = bad or f"closed by {close[0]}"
                break
            stack.pop()
            close.pop(0)
        out[s] = (end, " ".join([*close_a.split(), *close]), " ".join([*stack, *open_b.split()]), last_b or last_a, bad)
    return out


def verdict(total: dict[str, tuple]) -> str | None:
    """The fault of a folded file's strings, comments and brackets; None if there is none."""
    end, closers, openers, _, fault = _through(total, "")
    if fault:
        return fault
    if end and not end.startswith("l:=end"):
        return "left open"
    return f"not closed: {openers}" if openers else f"not opened: {closers}" if closers else None


def balanced(maps: list[dict[str, tuple]], lang: str) -> list[int]:
    """For every chunk the number of its run: between runs no bracket is open and a statement has ended."""
    out, run, total = [], 0, {"": ("", "", "", "", None)}
    for k, m in enumerate(maps):
        state, closers, openers, last, _ = _through(total, "")
        if k and not state and not openers and not closers and (lang in ("python", "ruby", "go") or last in (";", "}")):
            run += 1
        out.append(run)
        total = fold(total, m)
    return out


def statements(text: str, lang: str, markup: bool = True, lexed: tuple[list, str] | None = None) -> str | None:
    """The first fault of balanced statements by the local grammars."""
    tokens, left = lexed or scan(text, lang, markup=markup)
    if lang == "ruby":
        return _ruby(tokens)[2]
    if lang == "python":
        return _python(text, tokens)
    return fault_of(tokens, lang)


def prepared(text: str, lang: str) -> tuple[str, str | None]:
    """The text as it is cut into chunks, and a fault found on the way."""
    text = text.replace("\r\n", "\n")
    return taken(text) if lang == "c" else (text, None)


def check_text(text: str | None, language: str | None, path: str | None, size: int = 1 << 16) -> str | None:
    """The fault of one file, None if valid; chunks of ``size`` characters and more."""
    lang = language_of(language, path)
    if not text or lang is None:
        return None
    text, fault = prepared(text, lang)
    if fault:
        return fault
    markup = not text.lstrip().startswith("<")
    chunks = split_chunks(text, size, lang)
    if len(chunks) == 1:
        lexed = scan(text, lang, markup=markup)
        return verdict({"": summarise(text, lang, "", markup, lexed)}) or statements(text, lang, markup, lexed)
    maps: list[dict[str, tuple]] = []
    total: dict[str, tuple] = {"": ("", "", "", "", None)}
    for c in chunks:
        state = total[""][0]
        # here the state is known, so the map has one entry
        now = {state: summarise(c, lang, state, markup)}
        maps.append(now)
        total = {"": fold({"": total[""]}, now)[""]}
    if fault := verdict(total):
        return fault
    runs = balanced(maps, lang)
    at = 0
    for run in range(runs[-1] + 1):
        n = runs.count(run)
        if fault := statements("".join(chunks[at:at + n]), lang, markup):
            return fault
        at += n
    return None


def _checked(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = b.to_pydict()
            faults = [check_text(t, la, p, size) for t, la, p in zip(cols["content"], cols["language"], cols["path"])]
            langs = [language_of(la, p) for la, p in zip(cols["language"], cols["path"])]
            yield pa.RecordBatch.from_arrays(
                [b.column(b.schema.get_field_index("file_id")), b.column(b.schema.get_field_index("repo")), pa.array(langs, pa.string()), pa.array(faults, pa.string())],
                ["file_id", "repo", "language", "fault"],
            )

    return run


def _cut(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                file_id, repo, path, language, content = (b.column(k)[i].as_py() for k in range(5))
                lang = language_of(language, path)
                text, fault = prepared(content, lang) if lang else ("", None)
                chunks = split_chunks(text, size, lang) if lang and not fault else [""]
                n = len(chunks)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([file_id] * n, pa.int64()), pa.array([repo] * n, pa.string()), pa.array([lang] * n, pa.string()), pa.array([fault] * n, pa.string()), pa.array(range(n), pa.int32()), pa.array(chunks, pa.string())],
                    ["file_id", "repo", "language", "fault", "ord", "chunk"],
                )

    return run


_MAP = "array<struct<entry:string,left:string,closers:string,openers:string,last:string,bad:string>>"
_ENTRIES = pa.list_(pa.struct([(f, pa.string()) for f in ("entry", "left", "closers", "openers", "last", "bad")]))


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        d = b.to_pydict()
        maps = [[dict(zip(("entry", "left", "closers", "openers", "last", "bad"), (s, *v))) for s, v in state_map(c, la).items()] if la else [] for la, c in zip(d["language"], d["chunk"])]
        yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(n)) for n in ("file_id", "repo", "language", "fault", "ord")), pa.array(maps, _ENTRIES)], ["file_id", "repo", "language", "fault", "ord", "entries"])


def _reduced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ("left", "closers", "openers", "last", "bad")
    for b in batches:
        faults, runs = [], []
        for lang, fault, parts in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("language", "fault", "parts"))):
            maps = [{e["entry"]: tuple(e[n] for n in names) for e in p["entries"]} for p in sorted(parts, key=lambda p: p["ord"])]
            total: dict[str, tuple] = {"": ("", "", "", "", None)}
            for m in maps:
                total = {"": fold(total, m)[""]}
            fault = fault or (verdict(total) if lang else None)
            faults.append(fault)
            runs.append([0] * len(maps) if fault or not lang else balanced(maps, lang))
        yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index("file_id")), pa.array(faults, pa.string()), pa.array(runs, pa.list_(pa.int32()))], ["file_id", "fault", "runs"])


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        ids, faults = [], []
        for file_id, lang, parts in zip(*(b.column(b.schema.get_field_index(n)).to_pylist() for n in ("file_id", "language", "parts"))):
            ids.append(file_id)
            faults.append(statements("".join(p["chunk"] for p in sorted(parts, key=lambda p: p["ord"])), lang))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(faults, pa.string())], ["file_id", "fault"])


OUT = "file_id bigint, repo string, language string, fault string"


def _spread(big: DataFrame, chunk: int) -> DataFrame:
    """The faults of long files: chunks summarised and balanced runs parsed in tasks of their own."""
    # the chunks are laid out by file and place, so that a long file is many tasks' work
    chunks = big.mapInArrow(_cut(chunk), "file_id bigint, repo string, language string, fault string, ord int, chunk string").dropDuplicates(["file_id", "ord"])
    maps = chunks.mapInArrow(_summarised, f"file_id bigint, repo string, language string, fault string, ord int, entries {_MAP}")
    # one row per file: a summary is as long as the brackets that its chunk leaves open
    files = maps.groupBy("file_id").agg(
        F.min("repo").alias("repo"), F.min("language").alias("language"), F.min("fault").alias("fault"), F.collect_list(F.struct("ord", "entries")).alias("parts")
    )
    reduced = files.select("file_id", "language", "fault", "parts").mapInArrow(_reduced, "file_id bigint, fault string, runs array<int>")
    runs = reduced.where("fault is null").select("file_id", F.posexplode("runs").alias("ord", "run"))
    texts = chunks.where("language is not null").join(runs, ["file_id", "ord"]).groupBy("file_id", "run").agg(F.min("language").alias("language"), F.collect_list(F.struct("ord", "chunk")).alias("parts"))
    parsed = texts.select("file_id", "language", "parts").mapInArrow(_parsed, "file_id bigint, fault string")
    faults = reduced.select("file_id", "fault").unionByName(parsed).groupBy("file_id").agg(F.min("fault").alias("fault"))
    return files.select("file_id", "repo", "language").join(faults, "file_id").select("file_id", "repo", "language", "fault")


def checked_files(files: DataFrame, chunk: int = 1 << 16, large: int = 1 << 20) -> DataFrame:
    """(file_id, repo, language, fault) of every file once; fault is null for valid files.

    Files up to ``large`` characters are reduced in the task that reads them; the chunks of longer
    ones are spread over tasks. The verdict is the same.
    """
    rows = files.select("file_id", "repo", "path", "language", "content").where("file_id is not null")
    little = rows.where(F.coalesce(F.length("content"), F.lit(0)) <= large)
    both = little.mapInArrow(_checked(chunk), OUT).unionByName(_spread(rows.where(F.length("content") > large), chunk))
    return both.groupBy("file_id").agg(F.min("repo").alias("repo"), F.min("language").alias("language"), F.min("fault").alias("fault"))


def rates(checked: DataFrame) -> DataFrame:
    """(repo, language, files, invalid, share): share of flagged files, language 'unknown' where none is known."""
    return checked.groupBy("repo", F.coalesce("language", F.lit("unknown")).alias("language")).agg(
        F.count("*").alias("files"), F.count("fault").alias("invalid"), (F.count("fault") / F.count("*")).alias("share")
    )
