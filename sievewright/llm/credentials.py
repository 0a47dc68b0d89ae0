"""Problem 4: credentials in source files and hunks, found through a trigram index and masked.

The index lists, for every chunk of a text, the trigrams it holds of those that any detector
needs. What a detector needs is derived from its regular expression: literal runs become
conjunctions of their trigrams, alternations become disjunctions, optional parts ask for nothing.
Postings are bits in the row of their text, or a table of their own that is kept and used again;
they are intersected by built-in expressions, and a detector runs only on the chunks that are left.
The value it finds is then judged (stand-ins, masked values, labels and names looked up elsewhere
are not credentials).

A text is masked in place: every character of a value becomes ``*`` but for the pieces' quotes, so
line breaks and the code around stay as they were.

Defined results: null and empty texts hold nothing; repeated rows count once; lines end at ``\\n``
and are numbered from 1; in hunks the marker at the front of a line is not part of it.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_Q = r"""(?P<q>["'`])(?P<v>(?:(?!(?P=q))[^\\\n]|\\.)*)(?P=q)"""
_MORE = r"""(?P<more>(?:\s*(?:[+,.]\s*)?["'`](?:[^"'`\\\n]|\\.)*["'`])*)"""
#: Words of names whose value is a credential.
_NAMES = (
    r"(?:passw(?:or)?d|passphrase|passwort|kennwort|contrase(?:n|ñ)a|(?:smtp|db|ftp|mail|user|root|admin|login|imap|ldap)_?pass(?-i:(?![a-z]))|pwd|secret|credential"
    r"|(?:api|access|signing|sign|hmac|secret|private|encryption|encrypt|master|auth|deploy|storage|account|service)_?key|token|bearer)"
)
#: The shapes by which issuers make their keys known.
_ISSUED = (
    r"(?:(?:AKIA|ASIA)[A-Z0-9]{12,}|(?:ghp_|gho_|ghu_|ghs_|ghr_)[A-Za-z0-9]{20,}|github_pat_\w{20,}|glpat-[\w-]{16,}|xox[abprs]-[\w-]{10,}|sk-[A-Za-z0-9_-]{16,}|sk_live_[A-Za-z0-9]{10,}"
    r"|[a-z]{2}_live_[A-Za-z0-9]{16,}|AIza[\w-]{30,}|npm_[A-Za-z0-9]{20,}|vlt\.[A-Za-z0-9_-]{16,}|hvs\.[\w-]{16,}|SG\.[\w-]{16,}\.[\w-]{16,}|eyJ[\w-]{8,}\.eyJ[\w-]{4,}\.[\w-]{8,})"
)
#: name -> expression with the value in group v; flags are case-insensitive where the name is free text
DETECTORS: dict[str, tuple[str, int]] = {
    "key_block": (r"(?P<v>-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----)", 0),
    "issued": (rf"(?<![A-Za-z0-9+/_])(?P<v>{_ISSUED})", 0),
    "issued_split": (r"""["'`](?P<v>(?:AKIA|ASIA|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|glpat-|xox[abprs]-|sk-|[a-z]{2}_live_|AIza|npm_|vlt\.|hvs\.|eyJ)[\w.-]*)["'`](?P<more>(?:\s*(?:[+,.]\s*)?["'`][\w.-]+["'`])+)""", 0),
    "named": (rf"""{_NAMES}(?P<rest>[\w$]{{0,24}})["'\]]{{0,2}}[ \t]*(?::[ \t]*[&\w'<>\[\] .*?]{{1,40}}?[ \t]*)?(?:=>|:=|=|:)\s*(?:[\w.!]{{0,24}}\(\s*)?[brfu&@$]{{0,2}}{_Q}{_MORE}""", re.I),
    "fallback": (rf"""{_NAMES}(?P<rest>\w{{0,24}})(?:["'`\])]{{1,3}}\s*,|["'`\])]{{0,3}}\s*(?:\|\||\?\?|\bor\b))\s*{_Q}""", re.I),
    "url_login": (r"""[a-z][a-z0-9+.-]*://[^\s:/@"'`]*:(?P<v>[^\s/"'`]+)@[A-Za-z0-9\[]""", re.I),
    "url_query": (r"""[?&;](?:access_?token|auth|auth_?token|sig|signature|key|api_?key|token|secret|password|pwd|pass|x-amz-signature|x-amz-security-token|client_secret)=(?P<v>[^\s&"'`;#<>]+)""", re.I),
    "pair": (r"""(?<![\w?&])(?:\w*password|\w*passwd|pwd|pass|secret|api_?key)[ \t]*[=:][ \t]*(?P<v>[^\s"'`;,&(){}\[\]<>]\S*?)(?=[;"'`]|\s|$)""", re.I | re.M),
    "header": (r"""\b(?:bearer|basic|token)[ \t]+(?P<v>[A-Za-z0-9+/_.~=-]{12,})""", re.I),
    "login_call": (rf"""\b(?:\w*(?:login|log_in)|signin|sign_in|signon|sign_on|logon|authenticate|opensession|open_session|setcredentials?|set_credentials?|connectas|connect_as|connect)\w*!?\(\s*["'`][^"'`\n]*["'`]\s*,\s*{_Q}""", re.I),
    "env": (r"""^[ \t]*(?:(?:export|set|ENV|ARG|-e|-[ \t])[ \t]*)?(?:\w*(?:token|secret|credentials?|passphrase)|\w*(?:api|access|signing|secret|private|encryption|master|auth|deploy|account|service)_?key)\w{0,12}=(?P<v>[^\s"'`;,&(){}\[\]<>$]{8,})[ \t]*$""", re.I | re.M),
    "name_value": (r"""\bname["']?[ \t]*[:=][ \t]*["']?\w*(?:token|secret|password|passwd|passphrase|_key)\w{0,12}["']?,?\s*["']?value["']?[ \t]*[:=][ \t]*["']?(?P<v>[^\s"'`,;{}()<>$]{6,})""", re.I),
    "auth_pair": (rf"""\bauth\w{{0,12}}[ \t]*=[ \t]*[(\[][ \t]*["'][^"'\n]*["'][ \t]*,[ \t]*{_Q}""", re.I),
    "note_sign_in": (r"""\b(?:sign|log)[ \t]?in[ \t]+as[ \t]+\S+[ \t]+with[ \t]+(?P<v>\S+)""", re.I),
    "note_old_login": (r"""\blogin:?[ \t]+[\w.@-]+[ \t]+/[ \t]+(?P<v>\S+)""", re.I),
    "note_curl": (r"""\bcurl\b[^\n"'`]*?[ \t](?:-u|--user)[ \t]*[\w.@-]+:(?P<v>\S+)""", re.I),
}
_COMPILED = {k: re.compile(p, f) for k, (p, f) in DETECTORS.items()}
#: Where a detector that begins with a name can begin, looked for in lower case, which is faster than without regard to case.
_NAMED = re.compile(f"(?={_NAMES.replace('(?-i:(?![a-z]))', '')})")
_NAMED_ANY = re.compile(_NAMED.pattern, re.I)
#: The first line of the other detectors that may run over several.
_HEADS = {
    "issued_split": re.compile(r"""["'`](?:AKIA|ASIA|ghp_|gho_|ghu_|ghs_|ghr_|github_pat_|glpat-|xox[abprs]-|sk-|[a-z]{2}_live_|AIza|npm_|vlt\.|hvs\.|eyJ)"""),
    "login_call": re.compile(r"\b(?:\w*(?:login|log_in)|signin|sign_in|signon|sign_on|logon|authenticate|opensession|open_session|setcredentials?|set_credentials?|connectas|connect_as|connect)\w*!?\(", re.I),
}


def _matches(kind: str, text: str, lo: int, hi: int, at_names: list[int], ends: dict[str, int]) -> Iterator[re.Match]:
    """The matches that begin in lo..hi, which are line starts, wherever they end; ``ends`` holds where the last one of each kind did."""
    if kind not in ("named", "fallback", *_HEADS):
        yield from _COMPILED[kind].finditer(text, lo, hi)
        return
    match = _COMPILED[kind].match
    for at in at_names if kind not in _HEADS else [m.start() for m in _HEADS[kind].finditer(text, lo, hi)]:
        if at >= ends.get(kind, 0) and (m := match(text, at)):
            ends[kind] = m.end()
            yield m


#: Words of values that stand in for a credential, and of names whose value is none.
_STANDIN = re.compile(
    r"(?i)^(?:your|my|the|some|any|enter|insert|put|add|set|use)[-_ ].*|^(?:change|replace)[-_ ]?(?:me|this|it).*|.*\b(?:dummy|example|placeholder|sample|fake|redacted|not-a-real|notreal)\b.*|^(?:todo|tbd|fixme|none|null|nil|undefined|test|secret|password|token|xxx+|n/?a|foo|bar|abc|123+|1234567890?)$"
    r"|^[x*•.\-_#?0]+$|^<.*>$|^\[.*\]$|^\{.*\}$|^\$[\w({].*|^%.*%$|^%[sdv(].*|^#\{.*|^@@.*@@$|^«.*»$"
)
_OTHER = frozenset("label hint min max len length ttl count size url uri path name id ids field prefix header type expiry expires expiration policy public placeholder title text message msg help regex pattern env var file hash digest checksum days age rotation limit budget gauge host format kind index provider manager store service_name of gate".split())
_SIMPLE = re.compile(r"^[a-z]+$|^[A-Z][a-z]+$|^[A-Z]+(?:_[A-Z]+)+$|^[A-Z]+$|^[a-z]+(?:_[a-z]+)+$|^[a-z]+(?:-[a-z]+)+$|^[a-z]+(?:\.[a-z]+)+$")


def _parts(name: str) -> list[str]:
    return [p.lower() for p in re.findall(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+", name)]


def is_credential(kind: str, value: str, match: re.Match | None = None) -> bool:
    """Whether a found value is a credential and no stand-in, label, name or identifier."""
    if kind in ("key_block", "issued"):
        return not re.search(r"(?i)example|x{6,}|0{8,}|\*{3,}", value)
    v = value.strip()
    if kind == "issued_split":
        return bool(re.match(_ISSUED, v)) and is_credential("issued", v)
    if len(v) < 5 or _STANDIN.match(v) or re.search(r"\s", v) or "****" in v:
        return False
    if re.match(r"(?i)^(?:ssh-|data:|sha\d+-|-----BEGIN|[a-z]+://|\$\{|\$\(|process\.|os\.|env\.|env\(|std::|System\.)", v):
        return False
    if kind in ("named", "fallback") and match is not None:
        if _OTHER.intersection(_parts(match.group("rest"))):
            return False
        name = match.group(0)[: match.start("rest") - match.start()].lower()
        if name in ("token", "bearer") and re.fullmatch(r"[0-9a-f]{8}(?:-[0-9a-f]{4}){3}-[0-9a-f]{12}", v):
            return False
        if kind == "named" and name in ("token", "bearer") and not (re.search(r"\d", v) and re.search(r"[A-Za-z]", v) and (len(v) >= 12 or len(v) >= 8 and re.search(r"[a-z]", v) and re.search(r"[A-Z]", v))):
            return False
    if kind == "header":
        return bool(re.search(r"\d", v) or re.search(r"[a-z]", v) and re.search(r"[A-Z]", v[1:]))
    if kind in ("env", "name_value"):
        # an identifier or a path is a name looked up elsewhere
        if re.fullmatch(r"[a-z][a-z0-9]*(?:[_.-][a-z0-9]+)*|[A-Z][A-Z0-9]*(?:_[A-Z0-9]+)*|[a-z]\w*(?:\.\w+)+|[A-Za-z]+\d{0,2}|[./~].*|\w+://.*", v) and not re.fullmatch(r"(?=(?:.*\d){4})[0-9a-zA-Z]{20,}", v):
            return False
        return bool(re.search(r"\d", v) and re.search(r"[A-Za-z]", v))
    if kind == "pair" and (v.endswith("(") or re.search(r"[()]", v)):
        return False
    if _SIMPLE.match(v):
        return False
    if kind == "url_login":
        return True
    return bool(re.search(r"\d", v) or re.search(r"[^\w.-]", v) or re.search(r"[a-z][A-Z]", v) and len(v) >= (12 if kind in ("named", "fallback") else 6))


def find_values(text: str, only: set[str] | None = None, lo: int = 0, hi: int | None = None, ends: dict[str, int] | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Spans of values where they begin, and of all their pieces, for the matches that begin in lo..hi."""
    spans: list[tuple[int, int, bool]] = []
    hi, ends, at_names = len(text) if hi is None else hi, {} if ends is None else ends, []
    if only is None or only & {"named", "fallback"}:
        piece = text[lo:hi]
        low = piece.lower()
        at_names = [lo + m.start() for m in (_NAMED.finditer(low) if len(low) == len(piece) else _NAMED_ANY.finditer(piece))]
    for kind in _COMPILED:
        if only is not None and kind not in only:
            continue
        for m in _matches(kind, text, lo, hi, at_names, ends):
            value, pieces = m.group("v"), [m.span("v")]
            if kind in ("named", "issued_split") and m.group("more"):
                at = m.start("more")
                for p in re.finditer(r"""["'`]((?:[^"'`\\\n]|\\.)*)["'`]""", m.group("more")):
                    value += p.group(1)
                    pieces.append((at + p.start(1), at + p.end(1)))
            if is_credential(kind, value, m):
                spans += [(a, b, i == 0) for i, (a, b) in enumerate(pieces)]
    return sorted({(a, b) for a, b, first in spans if first}), sorted({(a, b) for a, b, _ in spans})


# ------------------------------------------------------------------ trigrams

def required(pattern: str, flags: int) -> tuple | None:
    """What trigrams a regular expression needs: ('and'|'or', parts), ('gram', g), or None for nothing."""
    from re import _constants as C, _parser

    def all_of(parts: list) -> tuple | None:
        parts = [p for p in parts if p]
        return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))

    def walk(seq, run: str = "") -> tuple | None:
        # run: the literals right before seq, which its first literals continue
        parts: list = []

        def close() -> None:
            nonlocal run
            parts.extend(("gram", run[i:i + 3]) for i in range(len(run) - 2))
            run = ""

        for op, arg in seq:
            if op is C.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            before = run[-2:]
            close()
            if op is C.SUBPATTERN:
                parts.append(walk(arg[-1], before))
            elif op is C.BRANCH:
                alts = [walk(a, before) for a in arg[1]]
                if all(alts):
                    parts.append(("or", tuple(alts)))
            elif op in (C.MAX_REPEAT, C.MIN_REPEAT, C.POSSESSIVE_REPEAT) and arg[0] > 0:
                parts.append(walk(arg[2], before))
        close()
        return all_of(parts)

    return walk(_parser.parse(pattern, flags))


def grams_of(query: tuple | None) -> set[str]:
    if query is None:
        return set()
    return {query[1]} if query[0] == "gram" else set().union(*map(grams_of, query[1]))


def holds(query: tuple | None, present: set[str]) -> bool:
    """Whether the postings of a chunk satisfy a query: conjunctions intersect, disjunctions unite."""
    if query is None:
        return True
    if query[0] == "gram":
        return query[1] in present
    return (all if query[0] == "and" else any)(holds(q, present) for q in query[1])


@lru_cache(maxsize=1)
def _index() -> tuple[dict[str, tuple | None], np.ndarray, dict[int, str]]:
    queries = {k: required(p, f) for k, (p, f) in DETECTORS.items()}
    grams = sorted(set().union(*(grams_of(q) for q in queries.values())))
    table = np.zeros(1 << 24, dtype=bool)
    names = {int.from_bytes(g.encode(), "big"): g for g in grams}
    table[list(names)] = True
    return queries, table, names


@lru_cache(maxsize=1)
def _lower() -> np.ndarray:
    low = np.arange(129, dtype=np.uint32)
    low[65:91] += 32
    low[128] = 0  # everything beyond ASCII
    return low


def postings(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Positions and codes of the trigrams of a text, case aside, that some detector needs."""
    _, table, _ = _index()
    b = _lower()[np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32), 128)]
    if len(b) < 3:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    codes = (b[:-2] << 16) | (b[1:-1] << 8) | b[2:]
    at = np.flatnonzero(table[codes])
    return at, codes[at]


def alternatives(query: tuple | None, bit: dict[str, int]) -> list[int]:
    """A query as the sets of trigrams (bits) of which one has to be held whole."""
    if query is None:
        return [0]
    if query[0] == "gram":
        return [bit[query[1]]]
    parts = [alternatives(q, bit) for q in query[1]]
    if query[0] == "or":
        return sorted({m for p in parts for m in p})
    out = [0]
    for p in parts:
        out = sorted({m | n for m in out for n in p})
    return out


@lru_cache(maxsize=1)
def _bits() -> tuple[dict[int, int], list[tuple[str, list[int]]]]:
    queries, _, names = _index()
    bit = {g: 1 << k for k, g in enumerate(names.values())}
    return {c: bit[g] for c, g in names.items()}, [(k, alternatives(q, bit)) for k, q in queries.items()]


def candidates(codes: list[int]) -> set[str]:
    """The detectors whose queries the postings (trigram codes) of a chunk satisfy."""
    bit, kinds = _bits()
    held = 0
    for c in set(codes):
        held |= bit[c]
    return {k for k, sets in kinds if any(held & m == m for m in sets)}


def chunk_starts(text: str, size: int) -> list[int]:
    """Where the chunks of a text begin: at lines, about ``size`` characters apart."""
    out, at = [0], 0
    while True:
        nl = text.find("\n", at + size)
        if nl < 0 or nl + 1 >= len(text):
            return out
        at = nl + 1
        out.append(at)


def chunk_spans(text: str, size: int = 400) -> list[tuple[int, int]]:
    """The spans whose trigrams a chunk holds; each reaches two lines into the next. What begins in a chunk is followed to wherever it ends."""
    heads = chunk_starts(text, size)
    out = []
    for lo, hi in zip(heads, [*heads[1:], len(text)]):
        for _ in range(2):
            hi = (text.find("\n", hi) + 1) or len(text)
        out.append((lo, hi))
    return out


_KEY_EDGE = re.compile(r"-----(?:(?P<end>END)|BEGIN) [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----")
#: A line of a key block: an armor header or base64, also as a piece of a string or comment.
_ARMOR = re.compile(
    r"""[ \t]*(?:(?:\#|//|\*|>|\|)[ \t]*)?["'`]?(?P<b>(?:Version|Comment|Charset|Hash|MessageID|Proc-Type|DEK-Info|Key-Info): [^\n]*?|(?:[A-Za-z0-9+/=]|\\[nrt])*)["'`]?[ \t]*[+,.\\]?[ \t\r]*(?:\n|\Z)"""
)


def _key_body(text: str, at: int) -> list[tuple[int, int]]:
    """What to mask of the key block whose BEGIN line's marker ends at ``at``.

    Everything up to its END; without one, the base64 and armor lines that follow.
    """
    edge = _KEY_EDGE.search(text, at)
    if edge and edge.group("end"):
        return [(at, edge.end())]
    out, last = [], ""
    if rest := re.compile(r"(?:\\[nrt]|[A-Za-z0-9+/=])+").match(text, at):
        out.append(rest.span())
        at = rest.end()
    at = (text.find("\n", at) + 1) or len(text)
    while at < len(text) and (m := _ARMOR.match(text, at)):
        body = m.group("b")
        # a lower-case word is code, and so is a short line after an empty one
        if re.fullmatch("[a-z]{1,15}", body) or body and len(body) < 16 and not last and out:
            break
        if body:
            out.append(m.span("b"))
        last, at = body, m.end()
    return out


def chunk_grams(text: str, size: int = 400) -> list[tuple[int, list[int]]]:
    """The postings of a text: (where a chunk begins, its trigrams as words of bits) of the chunks that hold any."""
    at, codes = postings(text)
    if not len(at):
        return []
    bit, _ = _bits()
    heads = chunk_starts(text, size)
    edges = [*heads[1:], len(text)]
    out = []
    for k in np.unique(np.searchsorted(heads, at, side="right") - 1):
        # a chunk holds the trigrams of two lines of the next one too
        lo, hi = heads[k], edges[k]
        for _ in range(2):
            hi = (text.find("\n", hi) + 1) or len(text)
        a, b = np.searchsorted(at, (lo, hi))
        held = 0
        for c in set(codes[a:b].tolist()):
            held |= bit[c]
        out.append((lo, [_signed(held >> 64 * w & (1 << 64) - 1) for w in range(_words())]))
    return out


def _signed(word: int) -> int:
    return word - (1 << 64) if word >> 63 else word  # as a bigint


def _words() -> int:
    return -(-len(_index()[2]) // 64)


def candidate_mask(words: list[int]) -> int:
    """The detectors whose queries a chunk's trigrams satisfy, as bits in the order of DETECTORS. The same as mask_sql."""
    held = sum((w & (1 << 64) - 1) << 64 * k for k, w in enumerate(words))
    return sum(1 << k for k, (_, sets) in enumerate(_bits()[1]) if any(held & m == m for m in sets))


@lru_cache(maxsize=None)
def mask_sql(words: str) -> str:
    """SQL for the detectors whose queries a chunk's words of bits satisfy: conjunctions intersect postings, disjunctions unite them."""
    out = []
    for k, (_, sets) in enumerate(_bits()[1]):
        held = [" AND ".join(f"({words}[{w}] & {need}L) = {need}L" for w in range(_words()) if (need := _signed(m >> 64 * w & (1 << 64) - 1))) or "true" for m in sets]
        out.append(f"IF({' OR '.join(f'({h})' for h in held)}, {1 << k}, 0)")
    return "CAST(" + " + ".join(out) + " AS INT)"


def verify(text: str, chunks: list[tuple[int, int]], size: int = 400) -> tuple[list[int], str]:
    """(line numbers on which values begin, the text masked), by the detectors of the candidate chunks (begin, mask) alone."""
    heads = chunk_starts(text, size)
    edge = dict(zip(heads, [*heads[1:], len(text)]))
    starts: set[int] = set()
    masks: set[tuple[int, int]] = set()
    ends: dict[str, int] = {}
    kinds = list(DETECTORS)
    for lo, mask in sorted(chunks):
        which = {k for n, k in enumerate(kinds) if mask >> n & 1}
        begin, spans = find_values(text, which, lo, edge[lo], ends)
        starts |= {x for x, _ in begin}
        masks.update(spans)
        if "key_block" in which:
            for x, y in begin:
                if text.startswith("-----BEGIN", x):
                    masks.update(_key_body(text, y))
    if not starts:
        return [], text
    out = list(text)
    for a, b in masks:
        for i in range(a, b):
            if out[i] not in "\n\r":
                out[i] = "*"
    lines = [0, *(m.end() for m in re.finditer("\n", text))]
    return sorted({bisect_right(lines, a) for a in starts}), "".join(out)


def scan_text(text: str | None, size: int = 400) -> tuple[list[int], str | None]:
    """Index, candidates and verification of one text."""
    if not text:
        return [], text
    chunks = [(lo, mask) for lo, words in chunk_grams(text, size) if (mask := candidate_mask(words))]
    return verify(text, chunks, size) if chunks else ([], text)


_POSTED = "record_key string, content string, chunks array<struct<begin:bigint,words:array<bigint>>>"


def _posted(hunk: bool, keep: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("begin", pa.int64()), ("words", pa.list_(pa.int64()))]))
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                if hunk and text:
                    text = "\n".join(ln[1:] for ln in text.split("\n"))
                rows.append([{"begin": lo, "words": words} for lo, words in chunk_grams(text)] if text else [])
            content = b.column(1) if keep else pa.nulls(b.num_rows, pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), content, pa.array(rows, kind)], ["record_key", "content", "chunks"])

    return run


def _scanned(hunk: bool, masked: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, lines, texts = [], [], []
            for key, text, chunks in zip(*(b.column(k).to_pylist() for k in range(3))):
                body = text
                if hunk and text and chunks:
                    marks = [ln[:1] for ln in text.split("\n")]
                    body = "\n".join(ln[1:] for ln in text.split("\n"))
                found, out = verify(body, [(c["begin"], c["mask"]) for c in chunks]) if chunks else ([], body)
                if masked:
                    if hunk and text and chunks:
                        out = "\n".join(m + ln for m, ln in zip(marks, out.split("\n")))
                    keys.append(key)
                    lines.append(len(found))
                    texts.append(out)
                else:
                    keys += [key] * len(found)
                    lines += found
            cols = [pa.array(keys, pa.string()), pa.array(lines, pa.int64())]
            if masked:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(texts, pa.string())], ["record_key", "n_values", "content"])
            else:
                yield pa.RecordBatch.from_arrays(cols, ["record_key", "line_no"])

    return run


def index_table(texts: DataFrame, hunk: bool = False) -> DataFrame:
    """(record_key, chunk_at, words): the index of texts (record_key, content) as a table to keep.

    ``words`` are the trigrams of the chunk as bits, in the order of ``index_grams``. A chunk without
    any needed trigram has no row. Chunks of hunks begin at places in the text without line markers.
    """
    return texts.select("record_key", "content").mapInArrow(_posted(hunk, False), _POSTED).select("record_key", F.explode("chunks").alias("c")).select("record_key", F.col("c.begin").alias("chunk_at"), F.col("c.words").alias("words"))


def index_grams() -> list[str]:
    """The trigrams that any detector needs, in the order of their bits."""
    return list(_index()[2].values())


def index_candidates(index: DataFrame) -> DataFrame:
    """(record_key, chunk_at, detector): the chunks on which each detector has to run, by built-in expressions alone."""
    kinds = F.array(*map(F.lit, DETECTORS))
    bits = F.array(*[F.lit(1 << n) for n in range(len(DETECTORS))])
    held = F.filter(kinds, lambda k, i: F.col("mask").bitwiseAND(F.get(bits, i)) != 0)
    return index.withColumn("mask", F.expr(mask_sql("words"))).where("mask <> 0").select("record_key", "chunk_at", F.explode(held).alias("detector"))


def with_candidates(texts: DataFrame, hunk: bool = False, index: DataFrame | None = None) -> DataFrame:
    """(record_key, content, chunks): each text with its candidate chunks (begin, mask).

    The postings are made in the pass that reads the texts and stay in their rows, so nothing moves;
    with ``index``, a kept table of ``index_table``, they come from there by a join over record_key
    (repeated rows of a key give the same postings).
    """
    if index is None:
        posted = texts.select("record_key", "content").mapInArrow(_posted(hunk, True), _POSTED)
        held = f"transform(chunks, c -> named_struct('begin', c.begin, 'mask', {mask_sql('c.words')}))"
        return posted.select("record_key", "content", F.expr(f"filter({held}, c -> c.mask <> 0)").alias("chunks"))
    rows = index.select("record_key", F.col("chunk_at").alias("begin"), F.expr(mask_sql("words")).alias("mask")).where("mask <> 0").distinct()
    chunks = rows.groupBy("record_key").agg(F.collect_list(F.struct("begin", "mask")).alias("chunks"))  # bounded by one text
    return texts.select("record_key", "content").join(chunks, "record_key", "left").select("record_key", "content", F.coalesce("chunks", F.array().cast("array<struct<begin:bigint,mask:int>>")).alias("chunks"))


def _texts(files: DataFrame, hunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    source = files.where("file_id is not null").select(F.col("file_id").cast("string").alias("record_key"), "content")
    hunk = hunks.where("diff_id is not null and file_ord is not null and hunk_ord is not null").select(
        F.concat_ws("#", "diff_id", "file_ord", "hunk_ord").alias("record_key"), "content"
    )
    return source, hunk


def found(files: DataFrame, hunks: DataFrame, index: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """(record_kind, record_key, line_no): every line on which a credential's value begins.

    ``index``: kept tables of ``index_table`` for both, if there are any.
    """
    source, hunk = _texts(files, hunks)
    schema = "record_key string, line_no bigint"
    kept = index or (None, None)
    sides = [with_candidates(t, h, i).where(F.size("chunks") > 0).mapInArrow(_scanned(h, False), schema) for t, h, i in ((source, False, kept[0]), (hunk, True, kept[1]))]
    return sides[0].select(F.lit("source").alias("record_kind"), "*").union(sides[1].select(F.lit("hunk"), "*")).distinct()


def candidate_chunks(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(record_kind, record_key, chunk_at, detector): the chunks of both tables on which each detector has to run."""
    source, hunk = _texts(files, hunks)
    return (
        index_candidates(index_table(source)).select(F.lit("source").alias("record_kind"), "*")
        .union(index_candidates(index_table(hunk, True)).select(F.lit("hunk"), "*")).distinct()
    )


def redacted(files: DataFrame, hunks: DataFrame) -> DataFrame:
    """(record_kind, record_key, n_values, content): every text, its credentials masked."""
    source, hunk = _texts(files, hunks)
    schema = "record_key string, n_values bigint, content string"
    sides = [with_candidates(t, h).mapInArrow(_scanned(h, True), schema) for t, h in ((source, False), (hunk, True))]
    both = sides[0].select(F.lit("source").alias("record_kind"), "*").union(sides[1].select(F.lit("hunk"), "*"))
    return both.groupBy("record_kind", "record_key").agg(F.max("n_values").alias("n_values"), F.min("content").alias("content"))
