"""Sinks: JSON, SARIF, text and markdown reports, the event log, saved state and review posts.

Reports are of bounded size (a limit, a budget, one review), so they are put together from ordered
lines at the end; what they are made of is computed in tables.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scores, text

#: How severities are shown.
UPPER = {"bug": "BUG", "warning": "WARNING", "suggestion": "SUGGESTION", "info": "INFO"}
TITLE = {"bug": "Bug", "warning": "Warning", "suggestion": "Suggestion", "info": "Info"}
SIGNS = {"bug": "🐛", "warning": "⚠️", "suggestion": "💡", "info": "ℹ️"}
SCHEMA_URL = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json"


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w.title() for w in rest)


def to_json(df: DataFrame, name: str = "json") -> DataFrame:
    """Each row as a JSON object with camel-case keys; nulls left out."""
    return df.select(F.to_json(F.struct(*[F.col(c).alias(camel(c)) for c in df.columns])).alias(name))


def sarif_level(c: str | Column = "severity") -> Column:
    return scores.lookup(scores.SARIF_LEVELS, c)


def sarif_rules(comments: DataFrame, tool: str = "sievewright") -> DataFrame:
    """(id, name, level, first_ord): the severities in use, in the order they are first seen."""
    return comments.groupBy("severity").agg(F.min("ord").alias("first_ord")).select(
        F.concat(F.lit(tool + "/"), "severity").alias("id"), scores.lookup(TITLE, "severity").alias("name"), sarif_level().alias("level"), "first_ord"
    )


def sarif_results(comments: DataFrame, tool: str = "sievewright") -> DataFrame:
    """(ord, result): each comment as a SARIF result; a fix only where there is a patch."""
    place = F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine")).alias("region"))
    change = F.struct(F.struct(F.col("file_path").alias("uri")).alias("artifactLocation"), F.array(F.struct(F.struct(F.col("line").alias("startLine")).alias("deletedRegion"), F.struct(F.col("patch").alias("text")).alias("insertedContent"))).alias("replacements"))
    fix = F.when(F.col("patch").isNotNull(), F.array(F.struct(F.struct(F.lit("Suggested fix").alias("text")).alias("description"), F.array(change).alias("artifactChanges"))))
    return comments.select("ord", F.struct(
        F.concat(F.lit(tool + "/"), "severity").alias("ruleId"), sarif_level().alias("level"), F.struct(F.col("message").alias("text")).alias("message"),
        F.array(F.struct(place.alias("physicalLocation"))).alias("locations"), fix.alias("fixes"),
    ).alias("result"))


def sarif(comments: DataFrame, tool: str = "sievewright", version: str = "0.1.0", url: str = "") -> DataFrame:
    """One row: the SARIF 2.1.0 document of a review's comments; ``write_sarif`` writes a long one piece by piece."""
    rules = sarif_rules(comments, tool).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "id", "name", "level"))), lambda r: F.struct(
        r["id"].alias("id"), F.struct(r["name"].alias("text")).alias("shortDescription"), F.struct(r["level"].alias("level")).alias("defaultConfiguration"))).alias("rules"))
    results = sarif_results(comments, tool).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.to_json("result").alias("j")))), lambda r: r["j"]).alias("results"))
    both = rules.join(F.broadcast(results))
    head = F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.lit(url).alias("informationUri"), F.col("rules")))
    return both.select(F.concat(F.lit('{"$schema":"' + SCHEMA_URL + '","version":"2.1.0","runs":[{"tool":{"driver":'), head, F.lit('},"results":['), F.array_join("results", ","), F.lit("]}]}")).alias("sarif"))


def sarif_parts(comments: DataFrame, tool: str = "sievewright", version: str = "0.1.0", url: str = "") -> DataFrame:
    """(part, ord, line): the document in pieces, its head, a line per result and its end, to be written in this order."""
    whole = comments.agg(F.lit(2).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.lit("]}]}").alias("line"))
    rules = sarif_rules(comments, tool).agg(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "id", "name", "level"))), lambda r: F.struct(
        r["id"].alias("id"), F.struct(r["name"].alias("text")).alias("shortDescription"), F.struct(r["level"].alias("level")).alias("defaultConfiguration"))).alias("rules"))  # one per severity
    head = F.to_json(F.struct(F.lit(tool).alias("name"), F.lit(version).alias("version"), F.lit(url).alias("informationUri"), F.col("rules")))
    first = rules.select(F.lit(0).alias("part"), F.lit(0).cast("bigint").alias("ord"), F.concat(F.lit('{"$schema":"' + SCHEMA_URL + '","version":"2.1.0","runs":[{"tool":{"driver":'), head, F.lit('},"results":[')).alias("line"))
    return first.unionByName(sarif_results(comments, tool).select(F.lit(1).alias("part"), F.col("ord").cast("bigint").alias("ord"), F.to_json("result").alias("line"))).unionByName(whole)


def write_sarif(comments: DataFrame, out, **how) -> None:
    """Writes the document to a text file object, one result at a time, so that no task or driver holds all of them."""
    between = ""
    for r in sarif_parts(comments, **how).orderBy("part", "ord").toLocalIterator():
        out.write((between if r["part"] == 1 else "") + r["line"])
        between = "," if r["part"] == 1 else ""


def _indented(c: str, before: str) -> Column:
    return F.array_join(F.transform(text.lines(c), lambda x: F.concat(F.lit(before), x, F.lit("\n"))), "")


def _confidence() -> Column:
    return F.format_string("%.0f", F.coalesce("confidence", F.lit(50.0)).cast("double"))


def comment_text(comments: DataFrame, style: str = "text") -> DataFrame:
    """(ord, block): each comment as it stands in a text, markdown or copy report."""
    where = F.concat("file_path", F.lit(":"), F.col("line").cast("string"))
    opt = lambda c, col: F.when(F.col(c).isNotNull(), col).otherwise("")
    if style == "markdown":
        rule = opt("rule", F.concat(F.lit(", rule: "), "rule"))
        block = F.concat(
            F.lit("## "), scores.lookup(SIGNS, "severity"), F.lit(" "), scores.lookup(TITLE, "severity"), F.lit(" — `"), where, F.lit("` ("), _confidence(), F.lit("%"), rule, F.lit(")\n\n"), "message", F.lit("\n\n"),
            opt("suggestion", F.concat(F.lit("> **Suggestion:** "), "suggestion", F.lit("\n\n"))), opt("patch", F.concat(F.lit("```\n"), "patch", F.lit("\n```\n\n"))),
        )
    elif style == "copy":
        block = F.concat(
            F.lit("["), scores.lookup(UPPER, "severity"), F.lit("] "), where, F.lit("\n"), _indented("message", "   "), opt("suggestion", _indented("suggestion", "   Fix: ")),
            opt("patch", F.concat(F.lit("   ```diff\n"), _indented("patch", "   "), F.lit("   ```\n"))), F.lit("\n"),
        )
    else:
        rule = opt("rule", F.concat(F.lit(", rule: "), "rule"))
        block = F.concat(
            F.lit("["), scores.lookup(UPPER, "severity"), F.lit("] "), where, F.lit(" (confidence: "), _confidence(), F.lit("%"), rule, F.lit(")\n  "), "message", F.lit("\n"),
            opt("suggestion", F.concat(F.lit("  Suggestion: "), "suggestion", F.lit("\n"))), opt("patch", F.concat(F.lit("  Patch:\n"), _indented("patch", "    "))), F.lit("\n"),
        )
    return comments.select("ord", block.alias("block"))


def joined(rows: DataFrame, order: str, block: str) -> str:
    """The blocks of a bounded report, in order."""
    return "".join(r[0] for r in rows.orderBy(order).select(block).collect())


def review_report(comments: DataFrame, stats: dict, style: str = "text", summary: str | None = None, skipped: list[tuple[str, str]] | None = None) -> str:
    """A review as text or markdown. ``stats`` has the funnel's numbers; comments are those kept."""
    n = comments.count()
    s = {k: stats.get(k, 0) for k in ("files_reviewed", "files_skipped", "total_hunks", "comments_filtered", "comments_deduplicated", "comments_reflected_out", "llm_calls", "llm_retries", "hotspot_files")}
    model = stats.get("model_used", "none")
    b = "**" if style == "markdown" else ""
    head = (
        f"{b}Model:{b} {model} | {b}Files:{b} {s['files_reviewed']} (skipped: {s['files_skipped']}) | {b}Hunks:{b} {s['total_hunks']} | {b}Comments:{b} {n} "
        f"(filtered: {s['comments_filtered']}, deduped: {s['comments_deduplicated']}, reflected: {s['comments_reflected_out']}) | {b}LLM calls:{b} {s['llm_calls']} (retries: {s['llm_retries']})\n\n"
    )
    body = joined(comment_text(comments, style), "ord", "block") or "No issues found.\n"
    if style == "markdown":
        return "# Review Results\n\n" + head + (f"> {summary}\n\n" if summary else "") + body
    out = "Review Results\n==============\n" + head
    if (k := s["hotspot_files"]) > 0:
        out += f"Much reworked files among those changed: {k}\n\n"
    if summary:
        out += f"Summary: {summary}\n\n"
    if skipped:
        out += "Skipped files:\n" + "".join(f"  {p} ({r})\n" for p, r in skipped) + "\n"
    return out + body


def copy_report(comments: DataFrame) -> str:
    """Numbered issues to be fixed."""
    blocks = [r[0] for r in comment_text(comments, "copy").orderBy("ord").select("block").collect()]
    return "Issues to fix:\n\n" + "".join(f"{i}. {b}" for i, b in enumerate(blocks, 1)) if blocks else "No issues found."


def metadata_line(tool: str, n: int, iteration: int | None = None) -> str:
    """A commit trailer: how many comments, and which iteration."""
    word = "comment" if n == 1 else "comments"
    return f"{tool}: reviewed ({n} {word})" if iteration is None else f"{tool}: reviewed ({n} {word}, iteration {iteration})"


def risk_report(per_file: DataFrame, overall: DataFrame, style: str = "text") -> str:
    """The risk of one diff, its files in order."""
    o = overall.first()
    rows = per_file.orderBy("file_ord").collect()
    total, level = (o["total"], o["risk_level"].title()) if o else (0.0, "Low")
    files, added, deleted = (o["total_files"], o["total_additions"], o["total_deletions"]) if o else (0, 0, 0)
    if style == "markdown":
        table = "| File | Change | +/- | Risk |\n|------|--------|-----|------|\n" + "".join(f"| {r['new_path']} | {r['change_type']} | +{r['added']}/-{r['deleted']} | {r['total']:.1f} |\n" for r in rows) + "\n" if rows else ""
        return f"# Risk Report\n\n**Overall Risk:** {total:.1f}/100 ({level})\n\n{table}**Summary:** {files} files, +{added} additions, -{deleted} deletions\n"
    table = f"{'File':<40} {'Change':>8} {'+/-':>10} {'Risk':>8}\n{'-' * 70}\n" + "".join(f"{r['new_path']:<40} {r['change_type']:>8} {r['added']:>+4}/{r['deleted']:<4}  {r['total']:>5.1f}\n" for r in rows) if rows else ""
    return f"Risk Report\n===========\nOverall Risk: {total:.1f}/100 ({level})\n\n{table}\nSummary: {files} files, +{added} additions, -{deleted} deletions\n"


def history_report(spots: DataFrame, pairs: DataFrame, owners: DataFrame, summary: DataFrame, commits: int, style: str = "text", limit: int = 20, min_coupling: float = 0.3) -> str:
    """Hotspots, coupling and ownership of one repository, each to the limit."""
    h = spots.orderBy(F.col("score").desc(), "path").limit(limit).collect()
    c = pairs.orderBy(F.col("coupling_degree").desc(), "file_a", "file_b").limit(limit).collect()
    silos = owners.where("is_knowledge_silo").orderBy(F.col("dominant_ratio").desc(), "path").limit(limit).collect()
    s = summary.first()
    own = [("Total files", s["total_files"]), ("Single-author files", s["single_author_files"]), ("Knowledge silos", s["knowledge_silos"]), ("Project bus factor", s["project_bus_factor"])] if s else []
    top = lambda r: f"{r['authors'][0]['email']} ({r['authors'][0]['ratio'] * 100:.0f}%)"
    if style == "markdown":
        out = f"# Git History Analysis\n\n**Commits analyzed:** {commits}\n\n## Hotspots\n\n"
        out += "| Rank | File | Score | Revisions | Churn | LoC | Authors |\n|------|------|-------|-----------|-------|-----|---------|\n" + "".join(
            f"| {i} | `{r['path']}` | {r['score']:.2f} | {r['revisions']} | {r['total_churn']} | {r['current_loc']} | {r['authors']} |\n" for i, r in enumerate(h, 1)) + "\n" if h else "No hotspots detected.\n\n"
        out += "## Temporal Coupling\n\n" + ("| File A | File B | Coupling | Co-changes |\n|--------|--------|----------|------------|\n" + "".join(
            f"| `{r['file_a']}` | `{r['file_b']}` | {r['coupling_degree']:.2f} | {r['co_changes']} |\n" for r in c) + "\n" if c else "No significant coupling detected.\n\n")
        out += "## Ownership & Bus Factor\n\n" + "".join(f"- **{k}:** {v}\n" for k, v in own) + "\n"
        return out + ("### Knowledge Silos\n\n" + "".join(f"- `{r['path']}`: {top(r)}\n" for r in silos) + "\n" if silos else "")
    rule = "-" * 72 + "\n"
    out = f"Hotspots (top {limit}):\n" + rule + "".join(f"{i:>2}. {r['path']:<40} score={r['score']:.2f}  rev={r['revisions']}  churn={r['total_churn']}  loc={r['current_loc']}  authors={r['authors']}\n" for i, r in enumerate(h, 1)) + "\n"
    out += f"Temporal Coupling (min coupling: {min_coupling}):\n" + rule + ("".join(f"  {r['file_a']} <-> {r['file_b']} (coupling={r['coupling_degree']:.2f}, co-changes={r['co_changes']})\n" for r in c) or "  No significant coupling detected.\n") + "\n"
    names = ("Total files:", "Single-author:", "Knowledge silos:", "Project bus factor:")
    out += "Ownership & Bus Factor:\n" + rule + "".join(f"  {n:<20}{v}\n" for n, (_, v) in zip(names, own))
    return out + ("\n  Knowledge Silos:\n" + "".join(f"    {r['path']}: {top(r)}\n" for r in silos) if silos else "") + "\n"


def search_report(hits: DataFrame, style: str = "text") -> str:
    """Results (place, file_path, start_line, end_line, score, language, content) of one query."""
    rows = hits.orderBy("place").collect()
    if not rows:
        return "No results found."
    if style == "markdown":
        return "# Search Results\n\n" + "\n".join(f"## {i}. `{r['file_path']}:{r['start_line']}–{r['end_line']}` (score: {r['score']:.4f})\n\n```{r['language'] or 'text'}\n{r['content']}\n```\n" for i, r in enumerate(rows, 1))
    head = lambda t: "\n".join("   " + x for x in (t or "").split("\n")[:3])
    return "\n".join(f"{i}. {r['file_path']}:{r['start_line']}–{r['end_line']} (score: {r['score']:.4f})\n{head(r['content'])}\n" for i, r in enumerate(rows, 1))


def repo_map(picked: DataFrame, style: str = "text") -> str:
    """The map of picked symbols; '' if there are none."""
    from ..operators.symbols import map_lines

    body = joined(map_lines(picked, style), "path", "section")
    return ("# Repository Map\n\n" if style == "markdown" and body else "") + body


# ------------------------------------------------------------------ writing

def append_events(events: DataFrame, path: str) -> None:
    """Review events (timestamp, commit, comment_count) as JSON lines; those without a commit are not written."""
    events.where("commit is not null").select("timestamp", "commit", "comment_count").write.mode("append").json(path)


def save_state(state: DataFrame, path: str) -> None:
    """One row (last_reviewed_sha, timestamp, comments); an unknown commit is HEAD."""
    state.withColumn("last_reviewed_sha", F.coalesce("last_reviewed_sha", F.lit("HEAD"))).coalesce(1).write.mode("overwrite").json(path)


def review_body(comments: DataFrame, summary: str) -> DataFrame:
    """One row (event, body, comments): a review to be posted; bugs ask for changes."""
    body = F.concat(
        F.lit("**"), scores.lookup(SIGNS, "severity"), F.lit(" "), scores.lookup(TITLE, "severity"), F.lit("** (confidence: "), _confidence(), F.lit("%)\n\n"), "message",
        F.when(F.col("suggestion").isNotNull(), F.concat(F.lit("\n\n**Suggestion:** "), "suggestion")).otherwise(""),
    )
    entry = F.struct("ord", F.col("file_path").alias("path"), "line", F.lit("RIGHT").alias("side"), body.alias("body"))
    return comments.agg(
        F.when(F.coalesce(F.bool_or(F.col("severity") == "bug"), F.lit(False)), "REQUEST_CHANGES").otherwise("COMMENT").alias("event"), F.lit(summary).alias("body"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["path"].alias("path"), x["line"].alias("line"), x["side"].alias("side"), x["body"].alias("body"))).alias("comments"),
    )


def post_review(comments: DataFrame, summary: str, send: Callable[[dict], None] | None = None) -> dict:
    """Posts a review through ``send``; without one it returns the body unsent. A refused request for changes is sent once more as a comment."""
    row = review_body(comments, summary).first().asDict(recursive=True)
    if send is None:
        return row
    try:
        send(row)
    except Exception as e:
        refused = any(x in str(e) for x in ("422", "Unprocessable Entity", "Validation Failed", "can't request changes"))
        if row["event"] != "REQUEST_CHANGES" or not refused:
            raise
        row |= {"event": "COMMENT", "body": summary + "\n\n(Sent as a comment, since asking for changes was refused.)"}
        send(row)
    return row
