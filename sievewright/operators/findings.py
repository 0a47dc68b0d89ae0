"""Review findings: parsing, tagging, deduplication, rescoring, filtering, patches and messages.

``comments(ord, file_path, line, severity, message, confidence, suggestion, patch, rule)``; ``ord``
carries the order that lists have by themselves.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scores, text
from ..plans.lineage import numbered, runs

FIELDS = ("file_path", "line", "severity", "message", "confidence", "suggestion", "patch", "rule")


def clean_comments(comments: DataFrame) -> DataFrame:
    """Each ord once; comments without a path, line or message cannot be placed and stay as they are."""
    return comments.where("ord is not null").dropDuplicates(["ord"])


# ------------------------------------------------------------------ model responses

def parsed_comments(responses: DataFrame) -> DataFrame:
    """Comments out of model responses (resp_id, response).

    A response that is no JSON object with a list, or in which any entry lacks a text for file,
    severity or message, gives nothing. Of the others, entries with a bad line (missing, 0,
    negative, no integer) or an unknown severity are dropped alone. The confidence is 50 unless it
    is a number, and lies within 0 and 100.
    """
    rows = responses.select("resp_id", F.try_parse_json(text.strip_fences("response")).alias("v"))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT")).select("resp_id", F.try_variant_get("v", "$.comments", "array<variant>").alias("items")).where("items is not null")
    kind = lambda o, k: F.coalesce(F.schema_of_variant(F.try_variant_get(o, f"$.{k}", "variant")), F.lit("VOID"))
    whole = F.forall("items", lambda o: (kind(o, "file") == "STRING") & (kind(o, "severity") == "STRING") & (kind(o, "message") == "STRING"))
    each = rows.where(whole).select("resp_id", F.posexplode("items").alias("pos", "o"))
    o = F.col("o")
    get = lambda k, t: F.try_variant_get(o, f"$.{k}", t)
    number = kind(o, "confidence").rlike("^(BIGINT|DOUBLE|DECIMAL|FLOAT|INT)")
    conf = F.when(number, F.least(F.greatest(get("confidence", "double"), F.lit(0.0)), F.lit(100.0))).otherwise(50.0)
    return each.where((kind(o, "line") == "BIGINT") & (get("line", "bigint") > 0)).select(
        "resp_id", "pos", get("file", "string").alias("file_path"), get("line", "bigint").alias("line"), scores.severity(get("severity", "string")).alias("severity"),
        get("message", "string").alias("message"), conf.alias("confidence"), get("suggestion", "string").alias("suggestion"), get("patch", "string").alias("patch"), F.lit(None).cast("string").alias("rule"),
    ).where("severity is not null")


def parsed_evaluations(responses: DataFrame) -> DataFrame:
    """(resp_id, pos, idx, score, revised_severity) out of self-reflection responses.

    A score that is no whole number from 0 to 255, or an index that is none, voids the response;
    scores are capped at 10, and unknown revised severities count as none.
    """
    rows = responses.select("resp_id", F.try_parse_json(text.strip_fences("response")).alias("v"))
    rows = rows.where(F.schema_of_variant("v").startswith("OBJECT")).select("resp_id", F.try_variant_get("v", "$.evaluations", "array<variant>").alias("items")).where("items is not null")
    kind = lambda o, k: F.coalesce(F.schema_of_variant(F.try_variant_get(o, f"$.{k}", "variant")), F.lit("VOID"))
    num = lambda o, k: F.try_variant_get(o, f"$.{k}", "bigint")
    whole = F.forall("items", lambda o: (kind(o, "index") == "BIGINT") & (kind(o, "score") == "BIGINT") & num(o, "index").between(0, 2**62) & num(o, "score").between(0, 255))
    each = rows.where(whole).select("resp_id", F.posexplode("items").alias("pos", "o"))
    o = F.col("o")
    return each.select("resp_id", "pos", num(o, "index").alias("idx"), F.least(num(o, "score"), F.lit(10)).cast("smallint").alias("score"), scores.severity(F.coalesce(F.try_variant_get(o, "$.revised_severity", "string"), F.try_variant_get(o, "$.revisedSeverity", "string"))).alias("revised_severity"))


# ------------------------------------------------------------------ the pipeline

def tagged(comments: DataFrame, rules: DataFrame) -> DataFrame:
    """Comments with the first rule, by the rules' order, whose name their message contains.

    The rules (ord, name, severity, description) come from a configuration file and are gathered
    into one row, so the comments are read once and no pair of comment and rule is made.
    """
    few = rules.agg(F.array_sort(F.collect_list(F.struct("ord", "name"))).alias("_rules"))
    hit = F.filter("_rules", lambda r: F.coalesce(F.contains("message", r["name"]), F.lit(False)))
    return comments.join(F.broadcast(few)).withColumn("rule", F.coalesce(F.try_element_at(hit, F.lit(1))["name"], F.col("rule"))).drop("_rules")


def deduplicated(comments: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """One comment per (file, line, message), within ``by``: the first one's fields with the highest confidence.

    ``n_same`` counts the comments it stands for; ``ord`` is the first one's. Partial aggregates
    meet before the shuffle, so a comment repeated without end stays small.
    """
    first = F.min_by(F.struct("severity", "suggestion", "patch", "rule"), "ord")
    rows = comments.groupBy(*by, "file_path", "line", "message").agg(first.alias("f"), F.max("confidence").alias("confidence"), F.min("ord").alias("ord"), F.count("*").alias("n_same"))
    return rows.select(*by, "ord", "file_path", "line", "f.severity", "message", "confidence", "f.suggestion", "f.patch", "f.rule", "n_same")


def renumbered(rows: DataFrame, by: str | None = None) -> DataFrame:
    """Rows with ``idx`` from 0 in the order of ord, within ``by`` if given; no task sees all rows of a group."""
    return numbered(rows, [by] if by else [], [F.col("ord")], "idx").withColumn("idx", F.col("idx") - 1)


def reflected(comments: DataFrame, evaluations: DataFrame, least: int = 7, by: tuple[str, ...] = ()) -> DataFrame:
    """Comments (idx) kept by their evaluation: its score reaches ``least`` or there is none; revised severities replace.

    The last evaluation of an index counts, by ``pos``. ``by`` are further key columns, such as a review's id.
    """
    last = evaluations.groupBy(*by, "idx").agg(F.max_by(F.struct("score", "revised_severity"), "pos").alias("e"))
    rows = comments.join(last, [*by, "idx"], "left")
    return rows.where(F.col("e.score").isNull() | (F.col("e.score") >= least)).withColumn("severity", F.coalesce("e.revised_severity", "severity")).drop("e")


def filtered(comments: DataFrame, min_confidence: float = 90.0, severities: tuple[str, ...] = ("bug", "warning"), limit: int = 5, by: str | None = None) -> DataFrame:
    """Comments with ``reason``, null for those kept, and ``place`` among the kept by severity and ord.

    A comment under the confidence is out for that, then one of an excluded severity, then what
    lies beyond the limit. Only the first ``limit`` places have to be told apart, so partitions are
    cut to them before the shuffle; the rest is joined as out.
    """
    rank = scores.severity_rank("severity")
    reason = F.when(F.coalesce(F.col("confidence"), F.lit(0.0)) < min_confidence, "below confidence threshold").when(
        ~F.coalesce(F.col("severity").isin(*severities), F.lit(False)), F.concat(F.coalesce("severity", F.lit("unknown")), F.lit("-level excluded"))
    )
    judged = comments.withColumn("reason", reason)
    ok = judged.where("reason is null").withColumn("rank", rank)
    if by:
        first = ok.withColumn("place", F.row_number().over(W.partitionBy(by).orderBy("rank", "ord"))).where(F.col("place") <= limit).select("ord", "place")
    else:
        one = ok.select("ord", "rank").orderBy("rank", "ord").limit(limit).withColumn("_one", F.lit(1))
        first = one.select("ord", F.row_number().over(W.partitionBy("_one").orderBy("rank", "ord")).alias("place"))
    return judged.join(first, "ord", "left").withColumn("reason", F.when(F.col("reason").isNull() & F.col("place").isNull(), "exceeded max comment limit").otherwise(F.col("reason")))


def reviewed(comments: DataFrame, rules: DataFrame, evaluations: DataFrame | None, **how) -> DataFrame:
    """Tag, deduplicate, renumber, reflect, filter: the order of the steps matters.

    Without evaluations (a failed reflection) all comments stay.
    """
    rows = renumbered(deduplicated(tagged(comments, rules)))
    if evaluations is not None:
        rows = reflected(rows, evaluations)
    return filtered(rows, **how)


def funnel(judged: DataFrame, before: DataFrame) -> DataFrame:
    """One row: comments before, removed as repeats, filtered (cut ones included), kept."""
    a = before.agg(F.count("*").alias("comments_generated"))
    b = judged.agg(F.count_if(F.col("reason").isNotNull()).alias("comments_filtered"), F.count_if(F.col("reason").isNull()).alias("comments_kept"), F.sum(F.col("n_same") - 1).alias("comments_deduplicated"))
    return a.join(F.broadcast(b))


def any_meets(comments: DataFrame, threshold: str) -> DataFrame:
    """One row: whether any comment is at least as bad as the threshold."""
    return comments.agg(F.coalesce(F.bool_or(scores.meets_threshold("severity", threshold)), F.lit(False)).alias("failed"))


def severity_counts(rows: DataFrame, *by: str) -> DataFrame:
    return rows.groupBy(*by, F.lower("severity").alias("severity")).agg(F.count("*").alias("n"))


# ------------------------------------------------------------------ patches and messages

def applied_patches(files: DataFrame, comments: DataFrame) -> DataFrame:
    """(path, content, n_applied): files with the lines that patches replace, each by the patch's lines.

    Patches count from the bottom up, so line numbers stay those of the old text; of several on one
    line each later one replaces the first line of what the one before it left, by ord. Patches are
    gathered by line and joined to the lines of their files, so those of a hot path are many
    tasks' work; the lines of a file are put together once, and the break at its end stays.
    """
    given = comments.where("patch is not null and file_path is not null and line is not null")
    new = text.lines("patch").alias("new")
    by_line = given.select(F.col("file_path").alias("path"), F.col("line").cast("bigint").alias("line"), "ord", new).groupBy("path", "line").agg(F.array_sort(F.collect_list(F.struct("ord", "new"))).alias("p"))
    named = given.select(F.col("file_path").alias("path")).distinct()
    old = files.join(named, "path", "left_semi").select("path", F.col("content").endswith("\n").alias("broken"), text.lines("content").alias("old"))
    lines = old.select("path", "broken", F.posexplode_outer("old").alias("at", "was")).withColumn("line", F.col("at").cast("bigint") + 1)
    met = lines.join(by_line, ["path", "line"], "left")
    out = F.when(F.col("p").isNull(), F.array("was")).otherwise(F.aggregate("p", F.array("was"), lambda acc, p: F.concat(p["new"], F.slice(acc, 2, F.size(acc)))))
    rows = met.select("path", "broken", "line", out.alias("out"), F.coalesce(F.size("p"), F.lit(0)).alias("n"), F.col("was").isNotNull().alias("is_line"))
    body = F.array_join(F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_line"), F.struct("line", "out")))), lambda x: x["out"])), "\n")
    return rows.groupBy("path").agg(F.first("broken").alias("broken"), body.alias("b"), F.sum(F.greatest("n", F.lit(0))).cast("int").alias("n_applied")).select(
        "path", F.when(F.col("broken"), F.concat("b", F.lit("\n"))).otherwise(F.col("b")).alias("content"), "n_applied"
    )


def patch_log(files: DataFrame, comments: DataFrame) -> DataFrame:
    """(ord, path, line, status, reason) of every patch."""
    sizes = files.select(F.col("path").alias("file_path"), text.line_count("content").alias("n_lines"))
    rows = comments.where("patch is not null").join(sizes, "file_path", "left")
    reason = F.when(F.col("n_lines").isNull(), "file not found").when(F.col("line").isNull() | (F.col("line") < 1) | (F.col("line") > F.col("n_lines")), "line out of range")
    return rows.select("ord", F.col("file_path").alias("path"), "line", F.when(reason.isNull(), "applied").otherwise("skipped").alias("status"), reason.alias("reason"))


def merged_messages(messages: DataFrame) -> DataFrame:
    """Messages (conv_id, turn, role, content) with runs of one role joined by a blank line."""
    rows = runs(messages, ["conv_id"], [F.col("turn")], "role")
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n\n")
    return rows.groupBy("conv_id", "run", "role").agg(F.min("turn").alias("turn"), body.alias("content")).select("conv_id", "turn", "role", "content")


def batches(rows: DataFrame, size: int, order: str, by: str | None = None) -> DataFrame:
    """Rows with ``batch_no``: groups of ``size`` in order, for calls to a model."""
    return renumbered(rows.withColumnRenamed(order, "ord"), by).withColumn("batch_no", F.floor(F.col("idx") / size)).withColumnRenamed("ord", order).drop("idx")


def rules_from_markdown(lines: DataFrame) -> DataFrame:
    """Rules (ord, name, severity, description) of markdown lines (ord, line).

    A list item may begin with a severity in brackets (else warning) and a name before a colon, if
    that is under 40 bytes and has under 4 blanks; else the name is the first four words.
    """
    rows = lines.select("ord", F.trim("line").alias("t")).where(~F.col("t").startswith("#") & (F.col("t") != ""))
    rows = rows.select("ord", F.trim(F.regexp_replace("t", r"^[-*] ", "")).alias("t")).where("t <> ''")
    sev, rest = F.regexp_extract("t", r"^\[([^\]]*)\]", 1), F.trim(F.regexp_replace("t", r"^\[[^\]]*\]", ""))
    has = F.col("t").rlike(r"^\[[^\]]*\]")
    rows = rows.select("ord", F.when(has, F.lower(sev)).otherwise("warning").alias("severity"), F.when(has, rest).otherwise(F.col("t")).alias("rest"))
    head = F.trim(F.substring_index("rest", ":", 1))
    named = F.col("rest").contains(":") & (F.octet_length(head) < 40) & (F.length(F.regexp_replace(head, "[^ ]", "")) < 4)
    tail = F.trim(F.regexp_replace("rest", r"^[^:]*:", ""))
    return rows.select("ord", F.when(named, head).otherwise(text.slug("rest")).alias("name"), "severity", F.when(named, tail).otherwise(F.col("rest")).alias("description")).where("description <> ''")


def ordered_rules(rules: DataFrame) -> DataFrame:
    """Rules by severity for a prompt, unknown ones last."""
    return rules.withColumn("_r", F.coalesce(scores.severity_rank("severity"), F.lit(9))).orderBy("_r", "ord").drop("_r")
