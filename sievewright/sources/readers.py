"""Sources: repository files, git history, diffs, pull requests, configuration and saved state."""

from __future__ import annotations

import subprocess
import tomllib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, fields
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import text

MAX_BYTES = 1_048_576
HISTORY = "commit_id string, author string, email string, ts bigint, message string, path string, lines_added bigint, lines_deleted bigint, status string, renamed_from string"


def repository_files(spark: SparkSession, root: str, ignored: list[str] | None = None, max_bytes: int = MAX_BYTES) -> DataFrame:
    """(path, language, content) of a folder: files of known languages, not too large, not hidden, not empty, text in UTF-8.

    Size and name are filtered before contents are read. ``ignored`` are paths below the root that
    an ignore file names (see ``git_ignored``); they are anti-joined.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/") + "/"
    path = F.regexp_replace(F.regexp_replace("path", "^file:/+", "/"), "^" + base.replace(".", r"\."), "")
    lang = text.language(text.extension("rel"))
    # what is no UTF-8 has a replacement character after decoding that its bytes do not have
    rows = files.where(F.col("length") <= max_bytes).select(path.alias("rel"), "content").where(~F.col("rel").rlike(r"(^|/)\."))
    rows = rows.select("rel", lang.alias("language"), "content").where("language <> 'unknown'")
    rows = rows.where((F.locate("00", F.hex(F.substring("content", 1, 8192))) == 0) | ~F.hex(F.substring("content", 1, 8192)).rlike("^(?:..)*00")).where(F.is_valid_utf8(F.col("content").cast("string")))
    rows = rows.where(F.length("content") > 0).select(F.col("rel").alias("path"), "language", F.col("content").cast("string").alias("content"))
    if ignored:
        rows = rows.join(spark.createDataFrame([(p,) for p in ignored], "path string"), "path", "left_anti")
    return rows


def git_ignored(root: str) -> list[str]:
    """Paths that the repository's ignore files leave out, empty without git."""
    done = subprocess.run(["git", "-C", root, "ls-files", "--others", "--ignored", "--exclude-standard"], capture_output=True, text=True)
    return done.stdout.split("\n")[:-1] if done.returncode == 0 else []


class GitHistory(DataSource):
    """``spark.read.format("git_history").option("path", folder)``: one row per changed file of every commit.

    Options: path, branch (HEAD), since_days with now (epoch seconds). Commits are read against
    their first parent with renames found, newest first. Each range of commits is a partition.
    """

    @classmethod
    def name(cls) -> str:
        return "git_history"

    def schema(self) -> str:
        return HISTORY

    def reader(self, schema) -> DataSourceReader:
        return _GitReader(dict(self.options))


@dataclass
class _Commits(InputPartition):
    ids: list[str] = field(default_factory=list)


class _GitReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root, self.branch = options["path"], options.get("branch", "HEAD")
        days, now = options.get("since_days"), options.get("now")
        self.since = int(now) - int(days) * 86_400 if days and now else None

    def _git(self, *args: str) -> str:
        return subprocess.run(["git", "-C", self.root, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")

    def partitions(self) -> list[InputPartition]:
        rows = [ln.split() for ln in self._git("log", "--format=%H %ct", self.branch).splitlines()]
        ids = [h for h, t in rows if self.since is None or int(t) >= self.since]
        return [_Commits(ids[i:i + 500]) for i in range(0, len(ids), 500)]

    def read(self, partition: _Commits) -> Iterator[tuple]:
        # one process a range; a commit's record begins with a byte that no name holds
        done = subprocess.run(
            ["git", "-C", self.root, "log", "--no-walk=unsorted", "--stdin", "-M", "-m", "--first-parent", "--raw", "--numstat", "-z", "--format=%x01%H%x00%an%x00%ae%x00%ct%x00%s%x00"],
            input="\n".join(partition.ids).encode() + b"\n", capture_output=True, check=True,
        )
        for record in done.stdout.decode("utf-8", "replace").split("\x01")[1:]:
            h, name, mail, at, subject, tail = (record.split("\x00", 5) + [""] * 6)[:6]
            yield from changes_of(h.strip(), name or "unknown", mail or "unknown", int(at or 0), subject, tail.lstrip("\x00"))


def changes_of(commit: str, author: str, email: str, ts: int, message: str, listing: str) -> Iterator[tuple]:
    """Rows out of git's zero-separated raw and numstat listings of one commit."""
    parts = [p for p in listing.lstrip("\n").split("\x00")]
    kinds: dict[str, tuple[str, str | None]] = {}
    counts: dict[str, tuple[int, int]] = {}
    names = {"A": "Added", "D": "Deleted", "R": "Renamed"}
    i = 0
    while i < len(parts):
        p = parts[i].lstrip("\n")
        if p.startswith(":"):
            letter = p.split()[-1][:1]
            if letter in "RC":
                kinds[parts[i + 2]] = (names.get(letter, "Modified"), parts[i + 1] if letter == "R" else None)
                i += 3
            else:
                kinds[parts[i + 1]] = (names.get(letter, "Modified"), None)
                i += 2
            continue
        cols = p.split("\t")
        if len(cols) == 3:
            add, rem = (0 if c == "-" else int(c) for c in cols[:2])
            if cols[2]:
                counts[cols[2]] = (add, rem)
                i += 1
            else:
                counts[parts[i + 2]] = (add, rem)
                i += 3
            continue
        i += 1
    for path, (status, source) in kinds.items():
        if path:
            add, rem = counts.get(path, (0, 0))
            yield (commit, author, email, ts, message.split("\n")[0], path, add, rem, status, source)


class PullRequestDiff(DataSource):
    """``spark.read.format("pull_request")`` with option ref ``owner/name#number``: one row (ref, text).

    The text comes from a callable registered in ``PullRequestDiff.fetch``; without one the read
    fails, since this library has no network client of its own.
    """

    fetch: Callable[[str, str, int], str] | None = None

    @classmethod
    def name(cls) -> str:
        return "pull_request"

    def schema(self) -> str:
        return "ref string, text string"

    def reader(self, schema) -> DataSourceReader:
        return _PullReader(self.options["ref"], type(self).fetch)


class _PullReader(DataSourceReader):
    def __init__(self, ref: str, fetch) -> None:
        self.ref, self.get = ref, fetch

    def read(self, partition) -> Iterator[tuple]:
        if self.get is None:
            raise RuntimeError("register a fetch function to read pull requests")
        yield (self.ref, self.get(*pull_reference(self.ref)))


def pull_reference(ref: str) -> tuple[str, str, int]:
    """owner, name and number of ``owner/name#number``."""
    where, mark, number = ref.partition("#")
    owner, slash, name = where.partition("/")
    if not (mark and slash and owner and name and number.isdigit()):
        raise ValueError(f"not a pull request: {ref}")
    return owner, name, int(number)


def diff_text(spark: SparkSession, path: str) -> DataFrame:
    """(diff_id, text): each file of a path as one diff, named by its path."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("diff_id"), F.col("value").alias("text"))


def git_diff(spark: SparkSession, root: str, ref: str | None = None, base: str | None = None) -> DataFrame:
    """(diff_id, text) of a range (with ..), one commit, or the changes since ``base`` (else HEAD)."""
    if ref and ".." in ref:
        args = ["diff", ref]
    elif ref:
        args = ["show", "--format=", ref]
    else:
        args = ["diff", base or "HEAD"]
    out = subprocess.run(["git", "-C", root, *args], capture_output=True, check=True).stdout.decode("utf-8", "replace")
    return spark.createDataFrame([(ref or base or "HEAD", out)], "diff_id string, text string")


def required_diff(diffs: DataFrame) -> DataFrame:
    """Fails on an empty diff, as review and description need one."""
    return diffs.withColumn("text", F.when(F.trim("text") == "", F.raise_error(F.lit("empty diff"))).otherwise(F.col("text")))


# ------------------------------------------------------------------ configuration and state

@dataclass
class ReviewSettings:
    max_comments: int = 5
    min_confidence: float = 90.0
    severity_filter: tuple[str, ...] = ("bug", "warning")
    skip_patterns: tuple[str, ...] = ()
    skip_extensions: tuple[str, ...] = ()
    max_diff_tokens: int = 64_000
    include_suggestions: bool = False
    cross_file: bool = True
    self_reflection: bool = True
    self_reflection_score_threshold: int = 7


@dataclass
class Settings:
    review: ReviewSettings = field(default_factory=ReviewSettings)
    llm: dict = field(default_factory=dict)
    embedding: dict = field(default_factory=dict)
    paths: dict = field(default_factory=dict)
    rules: list = field(default_factory=list)


def settings(source: str | None) -> Settings:
    """Settings of a TOML text; missing keys take their defaults, unknown ones are ignored."""
    data = tomllib.loads(source or "")
    known = {f.name: f for f in fields(ReviewSettings)}
    review = {k: tuple(v) if isinstance(v, list) else v for k, v in data.get("review", {}).items() if k in known}
    return Settings(ReviewSettings(**review), data.get("llm", {}), data.get("embedding", {}), data.get("paths", {}), data.get("rules", []))


def settings_file(path: str) -> Settings:
    return settings(Path(path).read_text(encoding="utf-8"))


def rules_table(spark: SparkSession, s: Settings) -> DataFrame:
    rows = [(i, r.get("name"), r.get("severity", "warning"), r.get("description")) for i, r in enumerate(s.rules)]
    return spark.createDataFrame(rows, "ord bigint, name string, severity string, description string")


STATE = "last_reviewed_sha string, timestamp timestamp, comments array<struct<file_path:string,line:bigint,severity:string,message:string,confidence:double,suggestion:string,patch:string,rule:string>>"


def review_state(spark: SparkSession, path: str) -> DataFrame | None:
    """The saved state, None if there is none; a malformed file is an error."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    if not p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
        return None
    return spark.read.schema(STATE).option("mode", "FAILFAST").json(path, multiLine=True)


def contained(root: str, path: str) -> Path:
    """A path below a root with links followed; anything outside is an error."""
    base = Path(root).resolve()
    full = (base / path).resolve()
    if full != base and base not in full.parents:
        raise ValueError(f"{path} is outside of {root}")
    return full


def register(spark: SparkSession) -> None:
    """Makes the data sources known to a session."""
    spark.dataSource.register(GitHistory)
    spark.dataSource.register(PullRequestDiff)
