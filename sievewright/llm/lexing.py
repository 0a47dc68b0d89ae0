"""Lexers of eight languages that can start in any state, so a file may be lexed in chunks.

``scan(text, lang, state)`` gives the tokens of a chunk that is entered in ``state`` and the state
it is left in. The normal state is ''. Others name an open construct: 'e:X' ends at the text X,
'q:X' ends at X unless a backslash precedes it, 'n:D' is D nested block comments, 'l:X' ends at a
line that is X alone (heredoc, =begin).
"""

from __future__ import annotations

import re
from functools import lru_cache

#: File extensions and the language each stands for.
EXTENSIONS = {
    "py": "python", "rs": "rust", "go": "go", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascript",
    "ts": "typescript", "tsx": "typescript", "java": "java", "c": "c", "h": "c", "rb": "ruby",
}
LANGUAGES = ("python", "rust", "go", "javascript", "typescript", "java", "c", "ruby")

#: Operators of each language, longest first within the pattern.
OPERATORS = {
    "c": "<<= >>= ... -> ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= + - * / % = < > ! & | ^ ~ . , ; : ?",
    "java": ">>>= <<= >>= ... -> :: ++ -- << <= >= == != && || += -= *= /= %= &= |= ^= + - * / % = < > ! & | ^ ~ . , ; : ? @",
    "javascript": ">>>= **= <<= >>= ??= &&= ||= === !== >>> ... => ** ?? ?. ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= + - * / % = < > ! & | ^ ~ . , ; : ? @",
    "go": "<<= >>= &^= ... := <- ++ -- << >> <= >= == != && || += -= *= /= %= &= |= ^= &^ + - * / % = < > ! & | ^ ~ . , ; :",
    "rust": "<<= >>= ..= ... -> => :: .. << <= >= == != && || += -= *= /= %= &= |= ^= + - * / % = < > ! & | ^ . , ; : ? @ # $",
    "python": "**= //= <<= >>= ... -> := ** // << >> <= >= == != += -= *= /= %= &= |= ^= @= + - * / % = < > & | ^ ~ . , ; : @",
    "ruby": "**= <<= >>= &&= ||= <=> === ... => :: .. ** =~ !~ << >> <= >= == != && || += -= *= /= %= &= |= ^= &. -> + - * / % = < > ! & | ^ ~ . , ; : ?",
}
OPERATORS["typescript"] = OPERATORS["javascript"]

_STR = r'"(?:[^"\\\n]|\\[\s\S])*"'
_CHR = r"'(?:[^'\\\n]|\\[\s\S])*'"
_ID = r"[^\W\d]\w*"
_EXP = r"(?:[eE][+-]?\d[\d_]*)?"
_HEX = r"0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+"
_HEX_FLOAT = r"0[xX](?:[0-9a-fA-F_]+\.?[0-9a-fA-F_]*|\.[0-9a-fA-F_]+)[pP][+-]?\d+"
#: Numbers that may end or begin with their point; Rust's may end with it, but not before a name or a range.
_POINTED = rf"(?:{_HEX_FLOAT}|{_HEX}|\d[\d_]*(?:\.[\d_]*)?{_EXP}|\.\d[\d_]*{_EXP})"
_NUMBERS = {"rust": rf"(?:{_HEX}|\d[\d_]*(?:\.\d[\d_]*|\.(?![.\w]))?{_EXP})", "ruby": rf"(?:{_HEX}|\d[\d_]*(?:\.\d[\d_]*)?{_EXP})"}
_SUFFIX = {"c": "[uUlLfF]*", "java": "[lLfFdD]?", "javascript": "n?", "typescript": "n?", "go": "i?", "rust": r"(?:_?[iuf](?:8|16|32|64|128|size))?", "python": "[jJ]?", "ruby": "[ri]?"}
_BLOCK = {"c": r"/\*", "java": r"/\*", "javascript": r"/\*", "typescript": r"/\*", "go": r"/\*", "rust": r"/\*"}
#: Longer constructs: what opens them, by language. Their ends are in _state_of.
_OPENS = {
    "python": r"(?:[rRbBfFuU]{0,2})(?:\"\"\"|''')",
    "java": r'"""', "javascript": "`", "typescript": "`", "go": "`",
    "rust": r'b?r#*"|b?"', "ruby": r"<<[~-]?(?:[A-Z_]\w*|'\w+'|\"\w+\")|\"|'|`", "c": r"(?!)",
}
_COMMENT = {"python": r"#[^\n]*", "ruby": r"#[^\n]*"}
_STRINGS = {
    "python": rf"[rRbBfFuU]{{0,2}}(?:{_STR}|{_CHR})", "ruby": r"%[wWiIqQrxs](?:\[(?:[^\[\]\\]|\\.|\[[^\]]*\])*\]|\((?:[^()\\]|\\.|\([^)]*\))*\)|\{(?:[^{}\\]|\\.|\{[^}]*\})*\}|<[^>]*>|\|[^|]*\||![^!]*!|/[^/]*/)", "rust": r"b?'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u\{[0-9a-fA-F_]+\}|.))'",
    "c": f"{_STR}|{_CHR}", "java": f"{_STR}|{_CHR}", "javascript": f"{_STR}|{_CHR}", "typescript": f"{_STR}|{_CHR}", "go": f"{_STR}|{_CHR}",
}
_SPECIAL = {
    "c": r"(?m:^[ \t]*\#[ \t]*(?:(?:include|include_next|define|undef|if|ifdef|ifndef|else|elif|elifdef|elifndef|endif|pragma|error|warning|line|ident|embed)\b(?:[^\n\\/]|\\[\s\S]|/(?!\*)|/\*[\s\S]*?\*/)*|$))",
    "rust": r"'[^\W\d]\w*(?!')",
    "ruby": r"\$(?:\d+|-\w|[!@&~`'+*$?:\"<>,./\\;=_])(?!\w)|(?m:^=begin\b[^\n]*)|(?m:^__END__\n[\s\S]*)|@@?[^\W\d]\w*|\$[^\W\d]\w*|(?<![\w:)\]]):[^\W\d]\w*[?!]?|[^\W\d]\w*[?!](?![=\w])|[^\W\d]\w*:(?![:\w])",
    "javascript": r"\#[^\W\d]\w*", "typescript": r"\#[^\W\d]\w*",
}
_REGEX = re.compile(r"/(?:[^/\\\n\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_REGEX_LINES = re.compile(r"/(?:[^/\\\[]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
#: Ruby's literals that may also be an operator and a name: only where an operand is due.
_DUE = re.compile(r"%(?:\[(?:[^\[\]\\]|\\.|\[[^\]]*\])*\]|\((?:[^()\\]|\\.|\([^)]*\))*\)|\{(?:[^{}\\]|\\.|\{[^}]*\})*\})|\?(?:\\.|[^\s\w]|\w(?!\w))")
_REGEX_LANGS = {"javascript", "typescript", "ruby"}
_CONFLICT = r"(?m:^(?:<{7}|={7}|>{7}|\|{7})(?=[ \r\n]|\Z)[^\n]*)"


@lru_cache(maxsize=None)
def _master(lang: str) -> re.Pattern:
    ops = "|".join(re.escape(o) for o in sorted(OPERATORS[lang].split(), key=len, reverse=True))
    ident = r"(?!\d)[\w$]+" if lang in ("javascript", "typescript", "java") else _ID
    parts = [
        ("ws", r"[ \t\r\f\v﻿]+|\\\r?\n"), ("nl", r"\n"), ("conflict", _CONFLICT),
        ("block", _BLOCK.get(lang, r"(?!)")), ("com", _COMMENT.get(lang, r"//[^\n]*")),
        ("opens", _OPENS[lang]), ("str", _STRINGS[lang]), ("special", _SPECIAL.get(lang, r"(?!)")),
        ("num", rf"{_NUMBERS.get(lang, _POINTED)}{_SUFFIX[lang]}(?!\w)"), ("id", ident), ("open", r"[(\[{]"), ("close", r"[)\]}]"), ("op", ops), ("bad", r"[\s\S]"),
    ]
    return re.compile("|".join(f"(?P<{k}>{p})" for k, p in parts))


def _state_of(opener: str, lang: str) -> str:
    """The state that an opener of _OPENS or a block comment leads to."""
    if opener == "/*":
        return "n:1" if lang == "rust" else "e:*/"
    if opener.startswith("<<"):
        return "l:" + opener.lstrip("<~-").strip("'\"")
    if lang == "rust" and "r" in opener:
        return 'e:"' + "#" * opener.count("#")
    if lang == "go":
        return "e:`"
    if lang == "python":
        return "q:" + opener[-3:]
    return "q:" + opener.lstrip("b") if lang == "rust" else "q:" + opener


#: Languages and quotes whose strings hold code, and what opens it.
_HOLES = {("ruby", '"'): "#{", ("ruby", "`"): "#{", ("javascript", "`"): "${", ("typescript", "`"): "${"}
_INNER = re.compile(r"[{}]|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\]|\\.)*`")


def _past_hole(text: str, pos: int) -> int:
    """Behind the brace that closes a hole that was opened right before ``pos``; -1 if none does."""
    depth = 1
    for m in _INNER.finditer(text, pos):
        depth += {"{": 1, "}": -1}.get(m.group(), 0)
        if depth == 0:
            return m.end()
    return -1


_FSTRING = re.compile(r"[rRbBuU]?[fF][rR]?(\"\"\"|\'\'\'|\"|')")
_IN_HOLE = re.compile(r"[{}\[\]()]|[rRbBuUfF]{0,2}(?:\"\"\"|\'\'\'|\"|')")


def _past_fstring(text: str, pos: int) -> int:
    """Behind the f-string that begins at ``pos``, whose holes may hold strings in the same quotes; -1 if it does not end."""
    m = _FSTRING.match(text, pos)
    if not m:
        return -1
    quote, at = m.group(1), m.end()
    stop = re.compile(rf"\\[\s\S]|{{{{|}}}}|{{|{quote}" + ("" if len(quote) > 1 else r"|\n"))
    while s := stop.search(text, at):
        if s.group() == quote:
            return s.end()
        if s.group() == "\n":
            return -1
        at = s.end()
        if s.group() == "{":
            depth = 1
            while depth and (h := _IN_HOLE.search(text, at)):
                at = h.end()
                if h.group() in ("{", "[", "("):
                    depth += 1
                elif h.group() in ("}", "]", ")"):
                    depth -= 1
                elif "f" in h.group().lower():
                    at = _past_fstring(text, h.start())
                else:
                    q = h.group().lstrip("rRbBuU")
                    at = _close(text, at, "q:" + q)[0]
                if at < 0:
                    return -1
            if depth:
                return -1
    return -1


def _close(text: str, pos: int, state: str, lang: str = "") -> tuple[int, str]:
    """Where the construct of ``state`` ends from ``pos`` on, and the state there."""
    kind, end = state[0], state[2:]
    if kind == "q" and (hole := _HOLES.get((lang, end))):
        at = pos
        for m in iter(lambda: re.compile(rf"\\[\s\S]|{re.escape(end)}|{re.escape(hole)}").search(text, at), None):
            if m.group() == end:
                return m.end(), ""
            at = m.end()
            if m.group() == hole:
                inside = _past_hole(text, at)
                at = inside if inside > 0 else at
        return len(text), state
    if kind == "e":
        at = text.find(end, pos)
        return (at + len(end), "") if at >= 0 else (len(text), state)
    if kind == "q":
        at = pos
        while True:
            at = text.find(end, at)
            if at < 0:
                return len(text), state
            back = at
            while back > pos and text[back - 1] == "\\":
                back -= 1
            if (at - back) % 2 == 0:
                return at + len(end), ""
            at += 1
    if kind == "l":
        m = re.compile(rf"(?m)^[ \t]*{re.escape(end)}(?=[ \t\r]*$|\b)").search(text, pos)
        return (m.end(), "") if m else (len(text), state)
    depth = int(end)
    for m in re.compile(r"/\*|\*/").finditer(text, pos):
        depth += 1 if m.group() == "/*" else -1
        if depth == 0:
            return m.end(), ""
    return len(text), f"n:{depth}"


_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "when", "if", "unless", "and", "or", "not", "puts"}


#: Words after which a value stands, so that '<' opens an element there.
_BEFORE_MARKUP = {"return", "default", "yield", "await", "case", "typeof", "else", "do"}
_TAG = re.compile(r"<(?:>|(?P<name>[A-Za-z_$][\w$.:-]*)(?P<types><[^<>(){}\n]*>)?(?=[\s/>{]))")
_ATTRIBUTE = re.compile(r"""(?:\s|/\*[\s\S]*?\*/|//[^\n]*)*(?:(?P<end>/?\s*>)|(?P<hole>\{)|(?P<name>[A-Za-z_$][\w$:.-]*)(?:\s*=\s*(?:"[^"]*"|'[^']*'|(?P<value>\{)|(?P<element>(?=<))))?)""")
_CLOSING = re.compile(r"</\s*([A-Za-z_$][\w$.:-]*)?\s*>")
_CHILD = re.compile(r"[<{}>]")


def _element(text: str, pos: int, lang: str, holes: list, alone: bool = False) -> int:
    """Behind the element that begins at ``pos``, -1 if it is not closed properly, or if it has children though it has to stand ``alone``.

    The tokens of its {holes} go to ``holes``.
    """
    names: list[str] = []

    def hole(at: int) -> int:
        inside: list[tuple[str, str, int]] = []
        end = _lex(text, lang, "", inside, at, True)[1]
        if end >= 0:
            holes.extend([("open", "(", at - 1), *inside, ("close", ")", end - 1)])
        return end

    while True:
        if text.startswith("</", pos):
            m = _CLOSING.match(text, pos)
            if not m or not names or names.pop() != (m.group(1) or ""):
                return -1
            pos = m.end()
        elif text[pos] == "{":
            pos = hole(pos + 1)
        else:
            m = _TAG.match(text, pos)
            if not m:
                return -1
            pos, closed = m.end(), False
            while m.group("name"):
                a = _ATTRIBUTE.match(text, pos)
                if not a:
                    return -1
                pos = a.end()
                if a.group("end"):
                    closed = a.group("end")[0] == "/"
                    break
                if a.group("hole") or a.group("value"):
                    pos = hole(pos)
                elif a.group("element") is not None:
                    pos = _element(text, pos, lang, holes)
                if pos < 0:
                    return -1
            if not closed and alone:
                return -1
            if not closed:
                names.append(m.group("name") or "")
        if pos < 0 or not names:
            return pos
        child = _CHILD.search(text, pos)
        if not child or child.group() in "}>":
            return -1
        pos = child.start()


def scan(text: str, lang: str, state: str = "", kept=None, markup: bool = False) -> tuple[list[tuple[str, str, int]], str]:
    """Tokens (kind, text, start) without white space, and the state at the end.

    Kinds: nl com str num id special open close op bad conflict. A construct that an earlier chunk
    opened gives a 'str' or 'com' token for its rest; one left open here gives one too. The tokens are
    appended to ``kept`` if it is given.

    With ``markup``, an element where a value stands is a 'str' that is called with its {holes}, one
    that is not closed properly is 'bad' unless TypeScript may mean types by it.
    """
    out: list[tuple[str, str, int]] = [] if kept is None else kept
    try:
        return out, _lex(text, lang, state, out, 0, False, markup)[0]
    except RecursionError:  # hundreds of elements inside each other's holes
        out.append(("bad", "<", 0))
        return out, ""


def _lex(text: str, lang: str, state: str, out: list, pos: int, hole: bool, markup: bool = True) -> tuple[str, int]:
    """scan() from ``pos`` on, into ``out``: (state at the end, -1); in a ``hole``, up to the brace that closes it: ('', place behind it)."""
    match = _master(lang).match
    n, depth = len(text), 0
    markup = markup and lang in ("javascript", "typescript")
    value = ("open", "", 0)  # the last token that is neither comment nor line end
    waiting: list[str] = []  # heredocs that begin at the next line
    if state:
        end, left = _close(text, 0, state, lang)
        out.append(("com" if state in ("e:*/", "l:=end") or state[0] == "n" else "str", text[:end], 0))
        if left:
            return left, -1
        pos = end
    if not pos and not hole and text.startswith("#!") and lang in ("javascript", "typescript", "rust") and not text.startswith("#!["):
        pos = (text.find("\n") + 1 or n + 1) - 1
        out.append(("com", text[:pos], 0))
    regexes = lang in _REGEX_LANGS
    last = out[-1] if out else ("nl", "", 0)
    while pos < n:
        if markup and last[0] not in ("nl", "com"):
            value = last
        if markup and text[pos] == "<" and (value[0] == "open" or value[0] == "op" and value[1] not in ("++", "--") or value[0] == "id" and value[1] in _BEFORE_MARKUP) and (t := _TAG.match(text, pos)):
            name, holes = t.group("name") or "", []
            ends = lang == "javascript" or re.compile(rf"</\s*{re.escape(name)}\s*>").search(text, t.end())
            end = _element(text, pos, lang, holes, not ends)
            if end > 0:
                for token in [("str", t.group(), pos), *holes]:
                    out.append(token)
                last, pos = out[-1], end
                continue
            if ends:
                out.append(("bad", t.group(), pos))
                if hole:
                    return "", -1
                last, pos, markup = out[-1], t.end(), False  # nothing is tried twice
                continue
        if regexes and text[pos] == "/" and (last[0] in ("op", "open", "nl", "com") or (last[0] == "id" and last[1] in _BEFORE_REGEX)):
            r = _REGEX.match(text, pos) or lang == "ruby" and last[0] in ("op", "open", "nl") and _REGEX_LINES.match(text, pos)
            if r and text[pos:pos + 2] not in ("//", "/*"):
                out.append(("str", r.group(), pos))
                last, pos = out[-1], r.end()
                continue
        if lang == "ruby" and text[pos] in "%?" and (last[0] in ("op", "open", "nl") or last[0] == "id" and last[1] in _BEFORE_REGEX) and (r := _DUE.match(text, pos)):
            out.append(("str", r.group(), pos))
            last, pos = out[-1], r.end()
            continue
        m = match(text, pos)
        kind, tok = m.lastgroup, m.group()
        if kind == "ws":
            pos = m.end()
            continue
        if lang == "python" and kind in ("str", "opens") and tok[0] in "fFrR" and (kind == "opens" or tok.count("{") != tok.count("}")) and (end := _past_fstring(text, pos)) > 0:
            out.append(("str", text[pos:end], pos))
            last, pos = out[-1], end
            continue
        if kind in ("opens", "block") or (kind == "special" and tok.startswith("=begin")):
            if tok.startswith("<<") and lang == "ruby":
                if last[0] in ("id", "num", "close") and not tok[2:3] in "~-":
                    kind, tok = "op", "<<"
                    out.append((kind, tok, pos))
                    last, pos = out[-1], pos + 2
                    continue
                waiting.append(_state_of(tok, lang))
                out.append(("str", tok, pos))
                last, pos = out[-1], m.end()
                continue
            inner = "l:=end" if kind == "special" else _state_of(tok, lang)
            end, left = _close(text, m.end(), inner, lang)
            if lang == "java" and tok == '"""' and "\n" not in text[m.end():end]:
                end, left = m.end() - 1, ""  # "" followed by a quote
            out.append(("com" if kind != "opens" else "str", text[pos:end], pos))
            if left:
                return left, -1
            last, pos = out[-1], end
            continue
        if hole and tok in "{}" and kind in ("open", "close"):
            depth += 1 if tok == "{" else -1
            if depth < 0:
                return "", m.end()
        out.append((kind, tok, pos))
        last, pos = out[-1], m.end()
        if kind == "nl" and waiting:
            for w in waiting:
                end, left = _close(text, pos, w)
                out.append(("com", text[pos:end], pos))
                if left:
                    return left, -1
                pos = end
            waiting = []
            last = ("nl", "", pos)
    return waiting[0] if waiting else "", -1


def language_of(language: str | None, path: str | None) -> str | None:
    """The lexer's language: the named one, capitals aside, else that of the path's extension."""
    if language is not None:
        name = language.strip().lower()
        return name if name in LANGUAGES else None
    return EXTENSIONS.get((path or "").rsplit("/", 1)[-1].rpartition(".")[2])


def entry_states(text: str, lang: str) -> list[str]:
    """The states in which a chunk may be entered and that its text can end: others pass unchanged."""
    states = [""]
    if "*/" in text and lang in _BLOCK:
        states += [f"n:{d}" for d in range(1, 1 + text.count("*/"))] if lang == "rust" else ["e:*/"]
    quotes = {"python": ["q:'''", 'q:"""'], "java": ['q:"""'], "javascript": ["q:`"], "typescript": ["q:`"], "go": ["e:`"], "rust": ['q:"'] + ['e:"' + "#" * k for k in range(4)], "ruby": ["q:'", 'q:"', "q:`"]}
    states += [s for s in quotes.get(lang, []) if s[2:] in text]
    if lang == "ruby":
        states += ["l:" + w for w in dict.fromkeys(re.findall(r"(?m)^[ \t]*(=end|[A-Z_]\w*)[ \t\r]*$", text))]
    return states
