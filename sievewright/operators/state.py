"""Persisted state as tables: keyed upserts, feedback, iteration counts, and the index's folder.

An upsert is the union of what is stored and what is new with the latest row of a key kept, written
to a new version of the folder; readers take the version that a pointer file names, so a run that
dies half-way leaves the old one in place.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of an index and their columns.
TABLES = {
    "chunks": "chunk_id bigint, file_path string, start_line bigint, end_line bigint, entity_name string, entity_type string, language string, content string, context_header string, content_hash string, embedding array<float>",
    "files": "path string, hash string, indexed_at bigint",
    "metadata": "key string, value string, seq bigint",
    "feedback": "comment_id string, rating int, comment string, seq bigint, ts timestamp",
    "postings": "chunk_id bigint, term string, tf bigint, len int",
}
#: What a verdict is worth.
RATINGS = {"useful": 1, "yes": 1, "y": 1, "up": 1, "not_useful": -1, "no": -1, "n": -1, "down": -1}


def latest(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of every key by ``order``; partial aggregates keep one row per key and task."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_row")).select(*keys, "_row.*").select(*rows.columns)


def upserted(stored: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    return latest(stored.unionByName(new, allowMissingColumns=True), keys, order)


def without_paths(stored: DataFrame, paths: DataFrame, key: str) -> DataFrame:
    """The rows of paths that are not to be deleted."""
    return stored.join(paths.select(F.col(paths.columns[0]).alias(key)).distinct(), key, "left_anti")


def rating(verdict: str | Column) -> Column:
    low = F.lower(F.trim(F.col(verdict) if isinstance(verdict, str) else verdict))
    pairs = [F.lit(x) for kv in RATINGS.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), low), F.lit(0))


def rated(spark: SparkSession, verdicts: list[tuple[str, str, str | None]], seq: int) -> DataFrame:
    """Feedback rows of (comment_id, verdict, comment), numbered from ``seq``: what an interactive round adds."""
    rows = [(c, v, note, seq + i) for i, (c, v, note) in enumerate(verdicts)]
    df = spark.createDataFrame(rows, "comment_id string, verdict string, comment string, seq bigint")
    return df.select("comment_id", rating("verdict").alias("rating"), "comment", "seq", F.current_timestamp().alias("ts"))


def feedback_counts(feedback: DataFrame, *by: str) -> DataFrame:
    return feedback.groupBy(*by).agg(F.count_if(F.col("rating") > 0).alias("positive"), F.count_if(F.col("rating") < 0).alias("negative"))


def newest_negative(feedback: DataFrame, limit: int = 5) -> DataFrame:
    """The last negative ratings; re-rating a comment makes it new."""
    return feedback.where(F.col("rating") < 0).orderBy(F.col("seq").desc()).limit(limit)


def iterations(events: DataFrame) -> DataFrame:
    """(commit, iteration_count, last_reviewed) out of the log of review events."""
    return events.groupBy("commit").agg(F.count("*").alias("iteration_count"), F.max("timestamp").alias("last_reviewed"))


class IndexStore:
    """The tables of an index under a folder, each a series of parquet versions and a pointer."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def create(self) -> IndexStore:
        """Makes the folder and every missing table; what exists stays."""
        for name, schema in TABLES.items():
            if self.version(name) is None:
                self.write(name, self.spark.createDataFrame([], schema))
        return self

    def _pointer(self, name: str) -> str:
        return f"{self.root}/{name}/_current.json"

    def version(self, name: str) -> int | None:
        p = self._path(self._pointer(name))
        if not self._fs.exists(p):
            return None
        stream = self._fs.open(p)
        try:
            return json.loads(bytes(b & 0xFF for b in stream.readAllBytes()).decode())["version"]
        finally:
            stream.close()

    def size(self) -> int:
        """Bytes of all versions."""
        return int(self._fs.getContentSummary(self._path(self.root)).getLength())

    def read(self, name: str) -> DataFrame:
        at = self.version(name)
        if at is None:
            raise FileNotFoundError(f"{self.root} has no table {name}")
        return self.spark.read.schema(TABLES[name]).parquet(f"{self.root}/{name}/v{at}")

    def write(self, name: str, rows: DataFrame) -> int:
        """Writes a new version, then lets the pointer name it."""
        at = (self.version(name) or 0) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{at}")
        out = self._fs.create(self._path(self._pointer(name)), True)
        out.write(bytearray(json.dumps({"version": at}).encode()))
        out.close()
        return at

    def upsert(self, name: str, new: DataFrame, keys: list[str], order: str) -> int:
        return self.write(name, upserted(self.read(name), new, keys, order))

    def delete_paths(self, name: str, paths: DataFrame, key: str) -> int:
        return self.write(name, without_paths(self.read(name), paths, key))
