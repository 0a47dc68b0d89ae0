"""External models as injected callables: embedding, chat, retries, prompts and defaults.

No client of any provider is built in. A callable is sent to the executors and called there with
batches of texts, in order.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Embedder = Callable[[list[str]], list[list[float]]]

#: Vector widths, batch sizes and pauses by provider.
WIDTHS = {"voyage": 1024, "gemini": 768, "openai": 1536}
BATCH_SIZES = {"voyage": 64, "gemini": 100, "openai": 64}
PAUSES_MS = {"voyage": 200, "gemini": 100, "openai": 200}


def hash_embedding(texts: list[str], width: int = 64) -> list[list[float]]:
    """A deterministic embedding for tests: words hashed to signed places, norm 1."""
    out = []
    for t in texts:
        v = np.zeros(width)
        for w in t.lower().split():
            h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "big")
            v[h % width] += 1 if h >> 63 else -1
        n = np.linalg.norm(v)
        out.append((v / n if n else v).tolist())
    return out


def embedded(rows: DataFrame, embed: Embedder, text_col: str, out: str = "embedding", batch: int = 64, pause_ms: int = 0) -> DataFrame:
    """``rows`` with a vector of each text; null texts have none. Order within a batch is that of the rows."""
    rows = rows.drop(out)
    names = rows.columns
    schema = T.StructType([*rows.schema.fields, T.StructField(out, T.ArrayType(T.FloatType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text_col)).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            vectors: list = [None] * len(texts)
            for k in range(0, len(at), batch):
                for i, v in zip(at[k:k + batch], embed([texts[i] for i in at[k:k + batch]])):
                    vectors[i] = v
                if pause_ms and k + batch < len(at):
                    time.sleep(pause_ms / 1000)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(vectors, pa.list_(pa.float32()))], [*names, out])

    return rows.mapInArrow(run, schema)


def answered(prompts: DataFrame, chat: Callable[[list[dict]], str], retries: int = 3, first_wait: float = 1.0) -> DataFrame:
    """(id, messages array<struct<role,content>>) as (id, response, calls, retries_used); see ``with_retries``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [with_retries(lambda m=m: chat(m), retries, first_wait) for m in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([g[0] for g in got]), pa.array([g[1] for g in got], pa.int32()), pa.array([g[2] for g in got], pa.int32())], ["id", "response", "calls", "retries_used"])

    return prompts.select(F.col("id").cast("bigint"), "messages").mapInArrow(run, "id bigint, response string, calls int, retries_used int")


def limited(error: Exception) -> bool:
    return any(x in str(error).lower() for x in ("429", "too many requests"))


def with_retries(call: Callable[[], str], retries: int = 3, first_wait: float = 1.0, sleep: Callable[[float], None] = time.sleep) -> tuple[str, int, int]:
    """(answer, calls, retries used): a rate limit is waited out, twice as long each time; other errors pass."""
    for n in range(retries + 1):
        try:
            return call(), n + 1, n
        except Exception as e:
            if n == retries or not limited(e):
                raise
            sleep(first_wait * 2**n)
    raise AssertionError


# ------------------------------------------------------------------ prompts

def section(title: str, body: str | None) -> str:
    return f"## {title}\n\n{body}\n\n" if body else ""


def review_prompt(diff: str, repo_map: str | None = None, related: str | None = None, history: str | None = None, extra: str | None = None, cross_file: bool = False) -> str:
    """Map, related code, history, diff, further context and the note on several files, in this order."""
    note = "The files above change together; look for faults between them too.\n" if cross_file else ""
    return section("Repository map", repo_map) + section("Related code", related) + section("Change history", history) + section("Diff", f"```diff\n{diff}\n```") + section("Further context", extra) + note


def system_prompt(rules: list[tuple[str, str, str]] = (), negatives: list[str] = (), suggestions: bool = False) -> str:
    """What a review is to return, with custom rules (name, severity, description) and comments that were unwelcome."""
    kinds = "bug, warning, suggestion, info" if suggestions else "bug, warning"
    out = f'Review the diff. Answer with JSON {{"comments": [{{"file", "line", "severity", "message", "confidence", "suggestion", "patch"}}]}}. Severities: {kinds}. Confidence is 0 to 100.\n'
    if rules:
        out += "Rules of this project:\n" + "".join(f"- [{s}] {n}: {d}\n" for n, s, d in rules)
    if negatives:
        out += "Comments like these were not wanted:\n" + "".join(f"- {x[:200] + '...' if len(x) > 200 else x}\n" for x in negatives)
    return out


REFLECT = 'Score each comment from 1 to 10 by how sure and useful it is. Answer with JSON {"evaluations": [{"index", "score", "reason", "revised_severity"}]}.\n\n'
DESCRIBE = 'Write a title, a description and labels for this change, as JSON {"title", "description", "labels"}.'


def reflection_prompt(comments: list[tuple[int, str, int, str]], diff: str) -> str:
    listed = "".join(f"[{i}] {p}:{ln} {m}\n" for i, p, ln, m in comments)
    return f"{REFLECT}{listed}\n```diff\n{diff}\n```\n"


def describe_prompt(diff: str, repo_map: str | None = None, history: str | None = None) -> str:
    return section("Repository map", repo_map) + section("Change history", history) + f"{DESCRIBE}\n\n```diff\n{diff}\n```\n"


DESCRIPTION = "title string, description string, labels array<string>"


def parsed_description(responses: DataFrame) -> DataFrame:
    """(resp_id, title, description, labels); anything else than such an object is an error."""
    from .text import strip_fences

    got = F.from_json(strip_fences("response"), DESCRIPTION, {"mode": "FAILFAST"})
    return responses.select("resp_id", got.alias("d")).select("resp_id", "d.*")


def hoisted(messages: list[dict]) -> tuple[str, list[dict]]:
    """System messages joined by a blank line, and the others with runs of one role merged."""
    system = "\n\n".join(m["content"] for m in messages if m["role"] == "system")
    out: list[dict] = []
    for m in messages:
        if m["role"] == "system":
            continue
        if out and out[-1]["role"] == m["role"]:
            out[-1] = {"role": m["role"], "content": out[-1]["content"] + "\n\n" + m["content"]}
        else:
            out.append(dict(m))
    return system, out


def checks(settings: dict[str, object], probes: dict[str, Callable[[], bool]]) -> list[tuple[str, str, str, str]]:
    """(name, status, detail, hint) rows: each probe passes or fails; settings without a value warn."""
    rows = [(k, "pass" if v else "warn", str(v or ""), "" if v else f"set {k}") for k, v in settings.items()]
    for name, probe in probes.items():
        try:
            ok, detail = bool(probe()), ""
        except Exception as e:
            ok, detail = False, str(e)
        rows.append((name, "pass" if ok else "fail", detail, "" if ok else f"check {name}"))
    return rows
