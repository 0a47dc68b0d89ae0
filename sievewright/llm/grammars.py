"""Local grammars of the languages with braces: what may stand between two brackets.

A text whose brackets match is a tree: what stands between two brackets is a sequence of words,
literals, operators and whole bracket groups. Each sequence is parsed by itself, by the grammar of
its role (a block's statements, a call's arguments, a pattern, a type's members and so on), with the
groups in it unopened; the parse gives each of them its own role. So every statement is parsed by a
grammar that looks at no more than its own level, and equal shapes are parsed once (``parsed``).

The grammars take every valid text; they are wider than the languages, since types of expressions,
precedence and names are not looked at.
"""

from __future__ import annotations

from functools import lru_cache

from .grammar_base import Fault, Grammar
from .grammar_c import C
from .grammar_go import Go
from .grammar_java import Java
from .grammar_js import JavaScript, TypeScript
from .grammar_rust import Rust

GRAMMARS: dict[str, type[Grammar]] = {"c": C, "go": Go, "java": Java, "javascript": JavaScript, "rust": Rust, "typescript": TypeScript}

#: Operators that may end a list of types, taken apart.
_APART = {">>": (">", ">"), ">>>": (">", ">", ">"), ">>=": (">", ">", "="), ">>>=": (">", ">", ">", "="), ">=": (">", "=")}
#: After these a line end ends a statement in Go.
_GO_END = frozenset(("++", "--", "break", "continue", "fallthrough", "return"))


class _Group:
    __slots__ = ("attribute", "codes", "inner", "places")

    def __init__(self) -> None:
        self.attribute = False  # an attribute of Rust says nothing about the code
        self.codes: list[str] = []
        self.inner: list[_Group] = []
        self.places: list[int] = []


def _tree(tokens: list, lang: str) -> _Group:
    """The bracket tree of tokens whose brackets match, as codes; a code that begins a line has a mark in JavaScript and TypeScript."""
    words = GRAMMARS[lang].WORDS
    apart = lang in ("java", "rust", "typescript")
    lines = lang in ("javascript", "typescript")
    root = _Group()
    now, stack = root, []
    fresh = False
    for n, (kind, tok, _) in enumerate(tokens):
        if kind == "com":
            continue
        if kind == "nl":
            fresh = True
            if lang == "go" and now.codes and (now.codes[-1] in _GO_END or now.codes[-1][0] in "a0\"([{"):
                now.codes.append(";")
                now.places.append(n)
            continue
        if kind == "id":
            code = tok if tok in words else "A" if lang == "c" and (tok.isupper() or tok[:3] in ("PRI", "SCN") or tok[0] == "_" and tok[1:].isupper()) else "m" if lang == "c" and "_" in tok else "a"
        elif kind == "num":
            code = "0"
        elif kind == "str":
            code = "`" if lines and tok[0] == "`" else '"'
        elif kind == "special":
            if lang == "c":
                continue  # a directive
            code = "'" if lang == "rust" else "a"
        elif kind == "open" and tok == "[" and lang == "rust" and (now.codes[-1:] == ["#"] or now.codes[-2:] == ["#", "!"]):
            for c in (now.codes, now.places):
                del c[c.index("#", max(0, len(c) - 2)) if c is now.codes else len(now.codes):]
            stack.append(now)
            now, fresh = _Group(), False
            now.attribute = True
            continue
        elif kind == "open":
            now.codes.append("¶" + tok if fresh and lines else tok)
            now.places.append(n)
            child = _Group()
            now.inner.append(child)
            stack.append(now)
            now, fresh = child, False
            continue
        elif kind == "close":
            parent = stack.pop()
            if not now.codes and not now.attribute:
                parent.codes[-1] += tok
                parent.inner.pop()
            now, fresh = parent, False
            continue
        elif kind == "op":
            if apart and tok in _APART:
                now.codes.extend(_APART[tok])
                now.places.extend([n] * len(_APART[tok]))
                fresh = False
                continue
            code = tok
        else:
            raise Fault(n)
        now.codes.append("¶" + code if fresh and lines else code)
        now.places.append(n)
        fresh = False
    return root


def _pieces(codes: list[str], lang: str, role: str):
    """The spans of a group's statements; a statement's semicolon belongs to it."""
    if role not in GRAMMARS[lang].BLOCKS:
        yield 0, len(codes)
        return
    begin, header = 0, False
    for i, c in enumerate(codes):
        if lang == "go":
            header = c in ("if", "for", "switch", "select") or header and c[0] != "{"
        if c[-1] == ";" and not header:
            after = codes[i + 1].lstrip("¶") if i + 1 < len(codes) else ""
            if after not in ("else", "while"):
                yield begin, i + 1
                begin = i + 1
    if begin < len(codes):
        yield begin, len(codes)


@lru_cache(maxsize=1 << 16)
def parsed(lang: str, role: str, shape: str) -> tuple[int, tuple[str, ...]]:
    """(place of the first fault, -1 if there is none, roles of the groups) of a sequence of codes."""
    g = GRAMMARS[lang](shape.split(" ") if shape else [])
    try:
        g.read(role)
        if g.i < g.n:
            raise Fault(max(g.i, g.far))
    except Fault:
        return max(g.i, g.far), ()
    except RecursionError:
        return -1, ("any",) * sum(c in ("(", "[", "{") for c in g.t[:g.n])
    return -1, tuple(g.roles)


def fault_of(tokens: list, lang: str) -> str | None:
    """The first fault in the statements of a text whose brackets match."""
    try:
        root = _tree(tokens, lang)
    except Fault as f:
        return f"{tokens[f.args[0]][0]}: {tokens[f.args[0]][1][:20]!r}"
    work = [(root, GRAMMARS[lang].TOP)]
    while work:
        group, role = work.pop()
        if role == "any":
            continue
        codes, child = group.codes, 0
        pieces = _pieces(codes, lang, role) if codes else [(0, 0)]
        for begin, end in pieces:
            bad, roles = parsed(lang, role, " ".join(codes[begin:end]))
            if bad >= 0:
                at = min(begin + bad, len(codes))
                near = [tokens[p][1][:20] for p in group.places[max(0, at - 1):at + 1]]
                return " ".join(near) + (" at the end" if at >= len(codes) else "")
            for r in roles:
                work.append((group.inner[child], r))
                child += 1
    return None
