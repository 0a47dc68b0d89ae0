"""Retrieval over chunks: vector and keyword search, rank fusion, and the index's upkeep.

``chunks(chunk_id, file_path, start_line, end_line, entity_name, entity_type, language, content,
context_header, content_hash, embedding)``. Queries are tables too, so many run in one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, text
from ..plans.lineage import numbered

#: Most bytes of a query table that is broadcast; a larger one is joined in blocks.
BROADCAST_BYTES = 64 << 20


def by_content(chunks: DataFrame, order: str = "chunk_id") -> DataFrame:
    """One row per content_hash, the last by ``order``: what an upsert on the hash leaves."""
    keep = [c for c in chunks.columns if c != "content_hash"]
    last = chunks.groupBy("content_hash").agg(F.max_by(F.struct(*keep), order).alias("row"))
    return last.select("content_hash", "row.*").select(*chunks.columns)


def by_place(chunks: DataFrame) -> DataFrame:
    """One row per (file_path, start_line, content_hash): equal code in two files stays twice."""
    keep = [c for c in chunks.columns if c not in ("file_path", "start_line", "content_hash")]
    last = chunks.groupBy("file_path", "start_line", "content_hash").agg(F.max_by(F.struct(*keep), "chunk_id").alias("row"))
    return last.select("file_path", "start_line", "content_hash", "row.*").select(*chunks.columns)


def check_width(chunks: DataFrame, width: int) -> DataFrame:
    """Fails a job that reads vectors of another width than the index has, and asks for a new index."""
    wrong = F.col("embedding").isNotNull() & (F.size("embedding") > 0) & (F.size("embedding") != width)
    message = F.concat(F.lit(f"embedding width mismatch: the index has {width}, the vectors have "), F.size("embedding").cast("string"), F.lit("; re-index to change the model"))
    return chunks.withColumn("embedding", F.when(wrong, F.raise_error(message)).otherwise(F.col("embedding")))


def unit(c: str | Column) -> Column:
    """A vector of doubles of norm 1; zeros if it has none."""
    v = F.transform(text.col(c), lambda x: x.cast("double"))
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    return F.when(norm > 0, F.transform(v, lambda x: x / norm)).otherwise(v)


def vector_search(rows: DataFrame, queries: DataFrame, limit: int, key: str = "chunk_id", vector: str = "embedding", exclude_self: bool = False) -> DataFrame:
    """(query_id, key, score, place): the ``limit`` most similar rows of each query, earlier keys first on ties.

    Vectors of another length and zero vectors score 0; a NaN stands above all numbers.
    A stated query set (query_id, query_vector) against all rows. Norms are taken once per row and
    query, only keys and scores reach the shuffle, and Spark cuts each partition to ``limit`` rows a
    query before it. Text is for the caller to join afterwards.
    """
    if limit <= 0:
        return rows.sparkSession.createDataFrame([], f"query_id bigint, {key} bigint, score double, place int")
    some = lambda c: F.exists(c, lambda x: x != 0)
    q = queries.where("query_vector is not null").select("query_id", unit("query_vector").alias("qv"), some("query_vector").alias("q_some"))
    r = rows.where(F.col(vector).isNotNull()).select(key, unit(vector).alias("rv"), some(vector).alias("r_some"))
    size = queries.select("query_id", "query_vector")._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    small = float(str(size)) * 2 <= BROADCAST_BYTES  # vectors become doubles
    if small:
        pairs = r.join(F.broadcast(q))
    else:
        # blocks of queries meet blocks of rows: each side is copied once per block of the other
        n = 32
        pairs = r.withColumn("rb", F.pmod(F.xxhash64(key), F.lit(n))).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))).join(
            q.withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(n))).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n - 1)))), ["rb", "qb"]
        )
    if exclude_self:
        pairs = pairs.where(F.col(key) != F.col("query_id"))
    dot = F.aggregate(F.zip_with("qv", "rv", lambda a, b: a * b), F.lit(0.0), lambda a, v: a + v)
    hits = pairs.select("query_id", key, F.when((F.size("qv") == F.size("rv")) & F.col("q_some") & F.col("r_some"), dot).otherwise(0.0).alias("score"))
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return hits.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


# ------------------------------------------------------------------ keyword search

def tokens(c: str | Column) -> Column:
    """Lower-case runs of ASCII letters and digits; an underscore separates, as other marks do."""
    return F.regexp_extract_all(F.lower(text.col(c)), F.lit("[a-z0-9]+"), F.lit(0))


def postings(docs: DataFrame, key: str, *fields: str) -> DataFrame:
    """(key, term, tf, len): term counts over all fields; a document's length counts all its tokens."""
    every = F.flatten(F.array(*[F.coalesce(tokens(f), F.expr("cast(array() as array<string>)")) for f in fields]))
    rows = docs.select(key, every.alias("toks")).select(key, F.size("toks").alias("len"), F.explode("toks").alias("term"))
    return rows.groupBy(key, "term").agg(F.count("*").alias("tf"), F.max("len").alias("len"))


def bm25(post: DataFrame, queries: DataFrame, key: str, limit: int | None = None, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """(query_id, key, score, place): BM25 of the documents that hold any term of a query.

    ``queries`` is (query_id, query_text). Inverse document frequency is ln((N - n + 0.5) / (n + 0.5)),
    at least 1e-6. N and the mean length come from the postings; documents without tokens are not in.
    """
    wanted = queries.select("query_id", F.explode(F.array_distinct(tokens("query_text"))).alias("term")).distinct()
    sizes = post.groupBy(key).agg(F.max("len").alias("len")).agg(F.count("*").alias("n_docs"), F.avg("len").alias("avg_len"))
    df = post.join(wanted.select("term").distinct(), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))
    idf = F.greatest(F.ln((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(1e-6))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    # one row of totals; the frequencies have a row per term that is asked for
    scored = post.join(wanted, "term").join(df, "term").join(F.broadcast(sizes)).groupBy("query_id", key).agg(F.sum(part).alias("raw"))
    scored = scored.select("query_id", key, F.round(F.greatest("raw", F.lit(0.0)), 9).alias("score"))
    if limit is None:
        return numbered(scored, ["query_id"], [F.col("score").desc(), F.col(key)])
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), key)
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


# ------------------------------------------------------------------ fusion

def fuse(lists: DataFrame, key: str, k: int = 60) -> DataFrame:
    """(query_id, key, score, n_lists) by reciprocal rank: the sum of 1 / (k + place) over a query's lists.

    ``lists`` is (query_id, source, key, place) with places from 1.
    """
    return lists.groupBy("query_id", key).agg(F.sum(1.0 / (k + F.col("place"))).alias("score"), F.count("*").alias("n_lists"))


def first_places(df: DataFrame, limit: int, key: str) -> DataFrame:
    order = W.partitionBy("query_id").orderBy(F.round("score", 12).desc(), key)
    return df.withColumn("place", F.row_number().over(order)).where(F.col("place") <= limit)


def hybrid(vector_hits: DataFrame, keyword_hits: DataFrame, key: str, limit: int, k: int = 60) -> DataFrame:
    """Fusion of both searches, each asked for twice the limit."""
    both = vector_hits.select("query_id", F.lit("vector").alias("source"), key, "place").unionByName(keyword_hits.select("query_id", F.lit("keyword").alias("source"), key, "place"))
    return first_places(fuse(both, key, k), limit, key)


# ------------------------------------------------------------------ upkeep

def classify(current: DataFrame, stored: DataFrame, key: str = "path") -> DataFrame:
    """(key, state): new, changed, unchanged or deleted, by content hash; ``current`` and ``stored`` are (key, hash)."""
    a, b = current.select(key, F.col("hash").alias("now")), stored.select(key, F.col("hash").alias("then"))
    state = F.when(F.col("then").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("now") == F.col("then"), "unchanged").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, state.alias("state"))


def reindexed(stored_chunks: DataFrame, states: DataFrame, new_chunks: DataFrame, key: str = "file_path") -> DataFrame:
    """The index after a run: chunks of unchanged files, and new ones of new and changed files."""
    kept = stored_chunks.join(states.where("state = 'unchanged'").select(F.col(states.columns[0]).alias(key)), key, "left_semi")
    made = new_chunks.join(states.where("state in ('new', 'changed')").select(F.col(states.columns[0]).alias(key)), key, "left_semi")
    return kept.unionByName(made, allowMissingColumns=True)


def has_chunks(hashes: DataFrame, chunks: DataFrame) -> DataFrame:
    """The hashes that the index holds."""
    return hashes.join(chunks.select("content_hash").distinct(), "content_hash", "left_semi")


def index_stats(chunks: DataFrame, files: DataFrame, feedback: DataFrame | None = None) -> DataFrame:
    """One row: numbers of chunks, of files in the file table, and of chunks with a vector."""
    c = chunks.agg(F.count("*").alias("total_chunks"), F.count_if(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).alias("embedded_chunks"))
    return c.join(F.broadcast(files.agg(F.count("*").alias("total_files"))))


def related_snippets(diff_files: DataFrame, post: DataFrame, chunks: DataFrame, per_stem: int = 3, most_bytes: int = 4000, most_parts: int = 3) -> DataFrame:
    """(diff_id, part_no, snippet): code related to a diff by its files' names.

    Each file's stem is searched; its best three hits count, those of the file itself dropped
    afterwards. Of a diff's parts the first three stay, as long as their bytes with the separators
    already written do not pass ``most_bytes``; the first that does ends the list.
    """
    stems = diff_files.select("diff_id", "file_ord", "new_path", text.stem("new_path").alias("stem")).where("stem <> ''")
    asked = stems.select("stem").distinct().select(F.xxhash64("stem").alias("query_id"), "stem", F.col("stem").alias("query_text"))
    hits = bm25(post, asked, "chunk_id", per_stem).join(asked.select("query_id", "stem"), "query_id").select("stem", "chunk_id", "place")
    parts = stems.join(hits, "stem").join(chunks.select("chunk_id", "entity_name", "file_path", "start_line", "content"), "chunk_id").where("file_path <> new_path")
    line = F.concat(F.lit("// Related: "), F.coalesce("entity_name", F.lit("")), F.lit(" ("), "file_path", F.lit(":"), F.col("start_line").cast("string"), F.lit(")\n"), F.coalesce("content", F.lit("")))
    order = W.partitionBy("diff_id").orderBy("file_ord", "place", "chunk_id")
    numbered = parts.select("diff_id", "file_ord", "place", "chunk_id", line.alias("snippet")).withColumn("part_no", F.row_number().over(order)).where(F.col("part_no") <= most_parts)
    run = W.partitionBy("diff_id").orderBy("part_no").rowsBetween(W.unboundedPreceding, 0)
    used = F.sum(F.octet_length("snippet")).over(run) + 2 * (F.col("part_no") - 1)
    return numbered.withColumn("used", used).where(F.col("used") <= most_bytes).select("diff_id", "part_no", "chunk_id", "snippet")
