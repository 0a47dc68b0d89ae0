"""Problem 8: encoding a corpus with a public byte-level BPE vocabulary, by a tokenization automaton.

A merge (u, v) of the vocabulary's list is a gadget on the automaton whose arcs are tokens: where
an arc u leads to a state with an arc v, it adds the arc uv and forbids v after that u. Applying
the gadgets in list order gives a deterministic automaton that accepts exactly the token sequences
that BPE produces, and its state after a token depends on that token alone. The full table has
|V| squared entries, so its rows are compiled on demand: whether the arc b leaves the state after a
follows from the gadgets that made a and b, latest first (``allowed``), and is kept.

A word is encoded by following the one path of arcs that spells it, the longest arc first at every
byte. The automaton is deterministic in this sense too: a byte can be reached by one path only, the
encoding of what lies before it, so a byte from which no arc led on is never tried again, and time
is linear in the word for a bounded token length, however long the word. Texts are split into words
before; a word met again costs one look-up in a table with a fixed bound.

Defined results: null and empty texts give an empty list; strings that look like special tokens
are ordinary text; invalid surrogates count as U+FFFD; every text is encoded whole.
"""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import vocabulary_path

#: Fixed value: how the vocabulary's texts are split into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words kept in a task's table; beyond it the table starts anew.
TABLE = 400_000
FOREVER = 1 << 40


def _byte_letters() -> dict[str, int]:
    """The printable stand-in of every byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def load_vocabulary(path: str) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    """(bytes of every token id, merges (left id, right id, made id) in list order) of a BPE file.

    A .json file lists merges; a .tiktoken file has ranks only, and a token's merge is the split of
    it that the tokens of lower rank give.
    """
    if path.endswith(".json"):
        model = json.load(open(path, encoding="utf-8"))["model"]
        letters = _byte_letters()
        ids = {t: i for t, i in model["vocab"].items() if all(c in letters for c in t)}
        tokens = [b""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            tokens[i] = bytes(letters[c] for c in t)
        merges = []
        for m in model["merges"]:
            a, b = m.split(" ") if isinstance(m, str) else m
            merges.append((ids[a], ids[b], ids[a + b]))
        return tokens, merges
    ranks = {base64.b64decode(a): int(b) for a, b in (ln.split() for ln in open(path, "rb") if ln.strip())}
    tokens = [b""] * (max(ranks.values()) + 1)
    for t, i in ranks.items():
        tokens[i] = t
    merges = []
    for t, i in sorted(ranks.items(), key=lambda x: x[1]):
        if len(t) == 1:
            continue
        parts = [bytes([c]) for c in t]
        while len(parts) > 2:
            best = min((ranks.get(parts[k] + parts[k + 1], FOREVER), k) for k in range(len(parts) - 1))
            if best[0] >= i:
                break
            k = best[1]
            parts[k:k + 2] = [parts[k] + parts[k + 1]]
        if len(parts) == 2:
            merges.append((ranks[parts[0]], ranks[parts[1]], i))
    return tokens, merges


class Automaton:
    """The deterministic automaton of a merge list, compiled gadget by gadget as it is used."""

    def __init__(self, tokens: list[bytes], merges: list[tuple[int, int, int]]) -> None:
        self.tokens = tokens
        n = len(tokens)
        self.left, self.right, self.birth = [-1] * n, [-1] * n, [-1] * n
        self.gadget: dict[tuple[int, int], int] = {}
        for k, (a, b, made) in enumerate(merges):
            self.gadget.setdefault((a, b), k)
            if self.birth[made] < 0:
                self.left[made], self.right[made], self.birth[made] = a, b, k
        self.rows: dict[int, bool] = {}
        self.words: dict[str, tuple[int, ...]] = {}
        # a token that its own merge can never make (earlier gadgets cut its halves apart) labels no arc
        self.ids: dict[bytes, int] = {}
        for i, t in enumerate(tokens):
            if t and (len(t) == 1 or self.birth[i] >= 0 and self._uncut(self.left[i], self.right[i], self.birth[i])):
                self.ids.setdefault(t, i)
        self.longest = max(map(len, self.ids), default=1)

    def allowed(self, a: int, b: int) -> bool:
        """Whether the arc b leaves the state after a: no gadget applied before both were made cuts it.

        The state after a token made by (u, v) has the arcs of the state after v at that time, and
        an arc made by (u, v) starts where u does, so the later of the two is undone step by step.
        A pair that meets as the right one is made is merged from the left first and so is cut.
        """
        key = a * len(self.tokens) + b
        known = self.rows.get(key)
        if known is None:
            if len(self.rows) > 4 * TABLE:
                self.rows.clear()
            known = self.rows[key] = self._uncut(a, b, FOREVER)
        return known

    def _uncut(self, a: int, b: int, until: int) -> bool:
        birth, gadget = self.birth, self.gadget
        while True:
            at = gadget.get((a, b))
            if at is not None and at < until:
                return False
            x, y = birth[a], birth[b]
            if x < 0 and y < 0:
                return True
            if x > y:
                until, a = x, self.right[a]
            else:
                until, b = y + 1, self.left[b]

    def encode_word(self, word: bytes) -> tuple[int, ...]:
        """The labels of the path that spells a word."""
        ids = self.ids
        whole = ids.get(word)
        if whole is not None:
            return (whole,)
        n, most, allowed = len(word), self.longest, self.allowed
        path: list[int] = []
        ends: list[int] = []
        dead: set[int] = set()
        at, prev, end = 0, -1, min(n, most)
        while at < n:
            while end > at:
                if end not in dead:
                    token = ids.get(word[at:end])
                    if token is not None and (prev < 0 or allowed(prev, token)):
                        break
                end -= 1
            else:  # no arc leads on from here: the last arc was not the one
                dead.add(at)
                path.pop()
                end = ends.pop() - 1
                at = ends[-1] if ends else 0
                prev = path[-1] if path else -1
                continue
            path.append(token)
            ends.append(end)
            at, prev, end = end, token, min(n, end + most)
        return tuple(path)

    def encode_words(self, words: list[str]) -> list[int]:
        out: list[int] = []
        table = self.words
        for w in words:
            ids = table.get(w)
            if ids is None:
                ids = self.encode_word(w.encode("utf-8", "replace") if w.isprintable() else w.encode("utf-16", "surrogatepass").decode("utf-16", "replace").encode())
                if len(table) >= TABLE:
                    table.clear()
                if len(w) <= 64:
                    table[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        """The text whose arcs' labels these are."""
        return b"".join(self.tokens[i] for i in ids).decode("utf-8", "replace")


_made: dict[str, tuple] = {}


def automaton(path: str, packed: bytes | None = None) -> tuple[Automaton, object]:
    """The automaton and word splitter of a vocabulary, made once in a process."""
    if path not in _made:
        import regex

        if packed is None:
            tokens, merges = load_vocabulary(path)
        else:
            tokens, merges = unpack(packed)
        _made[path] = Automaton(tokens, merges), regex.compile(WORDS).findall
    return _made[path]


def pack(tokens: list[bytes], merges: list[tuple[int, int, int]]) -> bytes:
    """A vocabulary as bytes, to be sent to executors that do not have the file."""
    sizes = np.array([len(t) for t in tokens], dtype=np.uint16).tobytes()
    return len(tokens).to_bytes(4, "big") + len(merges).to_bytes(4, "big") + sizes + np.array(merges, dtype=np.int32).tobytes() + b"".join(tokens)


def unpack(data: bytes) -> tuple[list[bytes], list[tuple[int, int, int]]]:
    n, m = int.from_bytes(data[:4], "big"), int.from_bytes(data[4:8], "big")
    sizes = np.frombuffer(data, np.uint16, n, 8).astype(np.int64)
    merges = np.frombuffer(data[8 + 2 * n:8 + 2 * n + 12 * m], np.int32).reshape(m, 3)
    ends = np.cumsum(sizes) + 8 + 2 * n + 12 * m
    return [data[e - s:e] for s, e in zip(sizes.tolist(), ends.tolist())], [tuple(x) for x in merges.tolist()]


def _encoded(path: str, shared, count: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, split = automaton(path, shared.value)
        for b in batches:
            ids, sizes = [], [0]
            counts = []
            for text in b.column(1).to_pylist():
                got = auto.encode_words(split(text)) if text else []
                if count:
                    counts.append(len(got))
                else:
                    ids.append(np.array(got, dtype=np.int32))
                    sizes.append(sizes[-1] + len(got))
            if count:
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(counts, pa.int64()), *b.columns[2:]], ["doc_id", "n_tokens", *b.schema.names[2:]])
            else:
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat))], ["doc_id", "ids"])

    return run


def _shared(df: DataFrame, path: str):
    # Under 2 MB for a vocabulary of 50,000 tokens, whatever the corpus.
    return df.sparkSession.sparkContext.broadcast(pack(*load_vocabulary(path)))


def encoded(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids): the token ids of every document."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    return documents.select("doc_id", "text").mapInArrow(_encoded(path, _shared(documents, path), False), "doc_id bigint, ids array<int>")


def counted(documents: DataFrame, *keep: str, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens, kept columns): the size of every document in tokens."""
    path = path or vocabulary_path("byte_bpe_50k.json")
    kept = documents.select("doc_id", "text", *keep)
    schema = "doc_id bigint, n_tokens bigint" + "".join(f", {f.name} {f.dataType.simpleString()}" for f in kept.schema.fields[2:])
    return kept.mapInArrow(_encoded(path, _shared(documents, path), True), schema)
