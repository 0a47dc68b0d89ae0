"""The library's commands and tools as functions: map, search, history, diff, review, index.

Each composes operators; callables stand for models. What they return are tables, or a report
where ``style`` is given.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import models, scores, text
from ..functions.models import Embedder, embedded
from ..operators import diffs, findings, history, retrieval, symbols
from ..operators.state import IndexStore
from ..sources import sinks
from ..sources.readers import ReviewSettings
from .lineage import checkpointed, numbered


def make_map(files: DataFrame, max_tokens: int = 1024, focus: list[str] | None = None, style: str = "text") -> str | DataFrame:
    """The most important symbols of a repository within a budget; ``style`` None gives the table."""
    if style == "sarif":
        raise ValueError("a map has no SARIF form")
    found = checkpointed(symbols.identified(symbols.symbols(symbols.readable(files))).drop("content"))
    edges = symbols.name_edges(found, symbols.references(symbols.readable(files)))
    ranked = found.join(symbols.pagerank(found, edges), "sym_id")
    picked = symbols.fit_budget(symbols.focused(ranked, focus or []), max_tokens)
    return picked if style is None else sinks.repo_map(picked, style)


def analyze_diff(parsed: DataFrame, style: str | None = None):
    """Per-file and overall risk of parsed diffs (see diffs.parsed)."""
    files, hunks = diffs.files_of(parsed), diffs.hunks_of(parsed)
    per_file = diffs.file_risk(files, hunks)
    overall = diffs.overall_risk(per_file)
    return (per_file, overall) if style is None else sinks.risk_report(per_file, overall, style)


def history_tables(commits: DataFrame, changes: DataFrame, current: DataFrame, now: int | None = None, since_days: int = 180, min_coupling: float = 0.3, min_co: int = 3) -> dict[str, DataFrame]:
    """Hotspots, coupling, ownership and its summary; the joined history is read once and shared."""
    rows = history.clean_changes(changes).join(history.clean_commits(commits, now, since_days), "commit_id")
    rows = checkpointed(rows)
    owned = history.ownership(rows)
    return {
        "hotspots": history.hotspots(rows, current), "coupling": history.coupling(rows, min_coupling, min_co), "ownership": owned,
        "summary": history.ownership_summary(owned, history.bus_factor(rows)), "history": rows,
    }


def build_index(store: IndexStore, files: DataFrame, embed: Embedder, width: int) -> None:
    """Chunks of all files with vectors, upserted by content hash; stored chunks of other files stay."""
    made = symbols.code_chunks(symbols.readable(files)).withColumn("chunk_id", F.xxhash64("file_path", "start_line", "content_hash"))
    made = retrieval.check_width(embedded(made.withColumn("_t", F.concat_ws("\n\n", "context_header", "content")), embed, "_t").drop("_t"), width)
    store.create().upsert("chunks", made, ["content_hash"], "chunk_id")
    hashes = symbols.readable(files).select("path", text.content_hash("content").alias("hash"), F.unix_timestamp(F.current_timestamp()).alias("indexed_at"))
    store.upsert("files", hashes, ["path"], "indexed_at")
    _refresh(store)


def _refresh(store: IndexStore) -> None:
    post = retrieval.postings(store.read("chunks"), "chunk_id", "entity_name", "content", "context_header")
    store.write("postings", post.select("chunk_id", "term", F.col("tf").cast("bigint").alias("tf"), F.col("len").cast("int").alias("len")))


def update_index(store: IndexStore, files: DataFrame, embed: Embedder, width: int) -> DataFrame:
    """Re-chunks new and changed files only, drops deleted ones, and returns the state of every path."""
    ready = symbols.readable(files)
    now = ready.select("path", text.content_hash("content").alias("hash"))
    states = checkpointed(retrieval.classify(now, store.read("files").select("path", "hash")))
    touched = ready.join(states.where("state in ('new', 'changed')"), "path", "left_semi")
    made = symbols.code_chunks(touched).withColumn("chunk_id", F.xxhash64("file_path", "start_line", "content_hash"))
    made = retrieval.check_width(embedded(made.withColumn("_t", F.concat_ws("\n\n", "context_header", "content")), embed, "_t").drop("_t"), width)
    store.write("chunks", retrieval.reindexed(store.read("chunks"), states, made))
    store.write("files", now.withColumn("indexed_at", F.unix_timestamp(F.current_timestamp())))
    _refresh(store)
    return states


def search(store: IndexStore, queries: DataFrame, embed: Embedder, limit: int = 10) -> DataFrame:
    """(query_id, place, score, chunk columns): hybrid search of (query_id, query_text); text is joined after the limit."""
    chunks = store.read("chunks")
    vectors = embedded(queries.select("query_id", "query_text"), embed, "query_text", "query_vector")
    near = retrieval.vector_search(chunks.select("chunk_id", "embedding"), vectors, 2 * limit)
    words = retrieval.bm25(store.read("postings"), queries, "chunk_id", 2 * limit)
    top = retrieval.hybrid(near, words, "chunk_id", limit)
    return top.join(chunks.drop("embedding"), "chunk_id").select("query_id", "place", "score", "file_path", "start_line", "end_line", "language", "content")


def review(responses: DataFrame, rules: DataFrame, evaluations: DataFrame | None = None, **how) -> DataFrame:
    """Findings out of model responses (resp_id, response), judged; ``reason`` is null for those kept."""
    rows = numbered(findings.parsed_comments(responses), [], [F.col("resp_id"), F.col("pos")], "ord")
    return findings.reviewed(rows, rules, evaluations, **how)


def review_prompts(parsed: DataFrame, rules: DataFrame, settings: ReviewSettings, scored: DataFrame | None = None) -> DataFrame:
    """(diff_id, group_no, id, messages): what a model is asked about every group of a diff's files.

    Files that the skip cascade drops are left out; a diff within the token budget is one group.
    With ``scored`` (path, score) of a repository the riskiest files come first within a group.
    """
    files, hunks = diffs.files_of(parsed), diffs.hunks_of(parsed)
    kept = diffs.skip_cascade(files, hunks, settings.skip_extensions, settings.skip_patterns).where("skip_reason is null").select(*files.columns)
    plan = diffs.split_plan(diffs.size_estimate(kept, hunks), settings.max_diff_tokens, settings.cross_file)
    if scored is None:
        ranked = plan.withColumn("score", F.lit(0.0))
    else:
        ranked = plan.join(scored.select(F.col("path").alias("new_path"), "score"), "new_path", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    texts = diffs.rebuilt(kept, hunks).withColumnRenamed("file_ord", "ord")
    entry = F.struct((-F.col("score")).alias("k"), "ord", "text", history.hotspot_banner(F.col("new_path"), F.col("score")).alias("note"))
    groups = ranked.join(texts, ["diff_id", "ord"]).groupBy("diff_id", "group_no").agg(F.array_sort(F.collect_list(entry)).alias("f"))
    names = rules.select("name", "severity", "description", "ord").collect()  # a configuration file's rules
    system = models.system_prompt([(r["name"], r["severity"], r["description"]) for r in sorted(names, key=lambda r: r["ord"])], suggestions=settings.include_suggestions)
    notes = F.array_join(F.filter(F.transform("f", lambda x: x["note"]), lambda x: x.isNotNull()), "\n")
    body = F.concat(F.when(notes != "", F.concat(F.lit("## Hotspot Analysis\n\n"), notes, F.lit("\n\n"))).otherwise(""), F.lit("## Diff\n\n```diff\n"), F.array_join(F.transform("f", lambda x: x["text"]), ""), F.lit("\n```\n"))
    message = lambda role, c: F.struct(F.lit(role).alias("role"), c.alias("content"))
    return groups.select("diff_id", "group_no", F.xxhash64("diff_id", "group_no").alias("id"), F.array(message("system", F.lit(system)), message("user", body)).alias("messages"))


def review_diffs(parsed: DataFrame, rules: DataFrame, chat: Callable, settings: ReviewSettings | None = None, scored: DataFrame | None = None) -> DataFrame:
    """Judged findings by diff: prompts, answers, tagging, deduplication, self-reflection and the filter.

    ``chat`` answers a list of messages; it is called once a group, and once a diff for the
    reflection. A reflection that says nothing usable keeps all comments.
    """
    settings = settings or ReviewSettings()
    asked = checkpointed(review_prompts(parsed, rules, settings, scored))
    answers = checkpointed(models.answered(asked.select("id", "messages"), chat))
    got = findings.parsed_comments(answers.select(F.col("id").alias("resp_id"), "response")).join(asked.select(F.col("id").alias("resp_id"), "diff_id", "group_no"), "resp_id")
    rows = got.withColumn("ord", F.col("group_no") * F.lit(1_000_000).cast("bigint") + F.col("pos"))
    rows = findings.deduplicated(findings.tagged(rows, rules), ("diff_id",))
    rows = checkpointed(findings.renumbered(rows, "diff_id"))
    if settings.self_reflection:
        line = F.struct("idx", F.concat(F.lit("["), F.col("idx").cast("string"), F.lit("] "), "file_path", F.lit(":"), F.col("line").cast("string"), F.lit(" "), "message").alias("t"))
        listed = rows.groupBy("diff_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("t"))
        ask = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(models.REFLECT), F.col("t")).alias("content")))
        said = models.answered(listed.select(F.xxhash64("diff_id").alias("id"), ask.alias("messages")), chat)
        ev = findings.parsed_evaluations(said.select(F.col("id").alias("resp_id"), "response")).join(listed.select("diff_id", F.xxhash64("diff_id").alias("resp_id")), "resp_id")
        rows = findings.reflected(rows, ev, settings.self_reflection_score_threshold, ("diff_id",))
    # ord is unique within a diff only; the filter's places are by diff as well
    rows = rows.withColumn("ord", F.xxhash64("diff_id", "idx")).withColumnRenamed("idx", "nth")
    return findings.filtered(rows, settings.min_confidence, settings.severity_filter, settings.max_comments, "diff_id")


def describe(diff_texts: DataFrame, chat: Callable) -> DataFrame:
    """(diff_id, title, description, labels) of diffs (diff_id, text); an answer that is none is an error."""
    ask = F.array(F.struct(F.lit("user").alias("role"), F.concat(F.lit(models.DESCRIBE + "\n\n```diff\n"), "text", F.lit("\n```\n")).alias("content")))
    rows = diff_texts.select("diff_id", F.xxhash64("diff_id").alias("id"), ask.alias("messages"))
    said = models.parsed_description(models.answered(rows.select("id", "messages"), chat).select(F.col("id").alias("resp_id"), "response"))
    return rows.select("diff_id", F.col("id").alias("resp_id")).join(said, "resp_id").drop("resp_id")


def exit_code(comments: DataFrame, fail_on: str | None) -> int:
    """1 if any comment is at least as bad as ``fail_on``."""
    if fail_on is None:
        return 0
    if fail_on not in scores.SEVERITIES:
        raise ValueError(f"unknown severity {fail_on}")
    return int(findings.any_meets(comments, fail_on).first()["failed"])


def tool_history(spark: SparkSession, commits: DataFrame, changes: DataFrame, current: DataFrame, analysis: str = "all", **how) -> dict[str, DataFrame]:
    """The history tool: all, coupling or ownership; anything else is an error."""
    if analysis not in ("all", "coupling", "ownership"):
        raise ValueError(f"unknown analysis {analysis}")
    out = history_tables(commits, changes, current, **how)
    return out if analysis == "all" else {k: v for k, v in out.items() if k.startswith(analysis) or analysis == "ownership" and k == "summary"}
