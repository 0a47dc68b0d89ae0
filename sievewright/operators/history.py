"""Change history: hotspots, temporal coupling, ownership and bus factor, insights for a diff.

Inputs are ``commits(commit_id, repo, author, email, ts, ...)`` and ``file_changes(commit_id, path,
lines_added, lines_deleted, ...)``. Rows delivered again count once. Results are by repo, so
histories of many repositories share one job; a single repository is the case of one repo.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

DAY = 86_400
UNKNOWN = "unknown"


def cutoff(now: int, since_days: int) -> int:
    """The earliest commit time that still counts."""
    return now - since_days * DAY


def clean_commits(commits: DataFrame, now: int | None = None, since_days: int = 180) -> DataFrame:
    """(commit_id, repo, author, email, ts), one row per commit, authors filled in.

    With ``now``, commits before the cutoff are left out; the filter reaches the scan.
    """
    if now is not None:
        commits = commits.where(F.col("ts") >= cutoff(now, since_days))
    return commits.where("commit_id is not null and repo is not null").groupBy("commit_id").agg(
        F.min("repo").alias("repo"), F.coalesce(F.min("author"), F.lit(UNKNOWN)).alias("author"),
        F.coalesce(F.min("email"), F.lit(UNKNOWN)).alias("email"), F.min("ts").alias("ts"),
    )


def clean_changes(changes: DataFrame, max_files: int | None = 25) -> DataFrame:
    """Distinct changes with a path, those of commits wider than ``max_files`` left out.

    Widths are counted per commit with partial sums, and the narrow commits semi-joined, so a very
    wide commit is never gathered.
    """
    rows = (
        changes.where("commit_id is not null and path is not null and path <> ''")
        .select("commit_id", "path", F.coalesce("lines_added", F.lit(0)).alias("lines_added"), F.coalesce("lines_deleted", F.lit(0)).alias("lines_deleted")).distinct()
    )
    if max_files is None:
        return rows
    narrow = rows.groupBy("commit_id").agg(F.count("*").alias("files")).where(F.col("files") <= max_files).select("commit_id")
    return rows.join(narrow, "commit_id", "left_semi")


def hotspot_base(history: DataFrame, author: str = "author") -> DataFrame:
    """(repo, path, revisions, total_churn, authors, last_modified): rows count as revisions."""
    return history.groupBy("repo", "path").agg(
        F.count("*").alias("revisions"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("total_churn"),
        F.countDistinct(author).alias("authors"), F.greatest(F.max("ts"), F.lit(0)).alias("last_modified"),
    )


def hotspots(history: DataFrame, current: DataFrame) -> DataFrame:
    """Scores of the files that still exist: half revisions, 0.3 relative churn, 0.2 lines, each against the repo's maximum.

    ``current`` is (repo, path, loc). A repo whose files are all empty gets no size part.
    """
    base = hotspot_base(history).join(current, ["repo", "path"])
    base = base.withColumn("relative_churn", F.when(F.col("loc") > 0, F.col("total_churn") / F.col("loc")).otherwise(0.0))
    most = base.groupBy("repo").agg(F.max("revisions").alias("max_rev"), F.greatest(F.max("relative_churn"), F.lit(1.0)).alias("max_rel"), F.max("loc").alias("max_loc"))
    score = (
        0.5 * F.col("revisions") / F.col("max_rev") + 0.3 * F.col("relative_churn") / F.col("max_rel")
        + F.when(F.col("max_loc") > 0, 0.2 * F.col("loc") / F.col("max_loc")).otherwise(0.0)
    )
    return base.join(most, "repo").select("repo", "path", "revisions", "total_churn", "relative_churn", F.col("loc").alias("current_loc"), "authors", "last_modified", score.alias("score"))


def top_per_repo(df: DataFrame, n: int, *order: Column) -> DataFrame:
    """The first n rows of every repo; partitions are cut to n rows each before the shuffle."""
    return df.withColumn("place", F.row_number().over(W.partitionBy("repo").orderBy(*order))).where(F.col("place") <= n)


def coupling(history: DataFrame, min_coupling: float = 0.3, min_co: int = 3) -> DataFrame:
    """(repo, file_a, file_b, co_changes, changes_a, changes_b, coupling_degree) of files that change together.

    Files with fewer than ``min_co`` commits cannot qualify and leave before the self-join, and the
    width guard of ``clean_changes`` bounds the pairs of a commit.
    """
    touched = history.select("repo", "commit_id", "path").distinct()
    counts = touched.groupBy("repo", "path").agg(F.count("*").alias("changes"))
    often = touched.join(counts.where(F.col("changes") >= min_co).select("repo", "path"), ["repo", "path"], "left_semi")
    a = often.select("repo", "commit_id", F.col("path").alias("file_a"))
    b = often.select("repo", "commit_id", F.col("path").alias("file_b"))
    pairs = a.join(b, ["repo", "commit_id"]).where("file_a < file_b").groupBy("repo", "file_a", "file_b").agg(F.count("*").alias("co_changes")).where(F.col("co_changes") >= min_co)
    ca = counts.select("repo", F.col("path").alias("file_a"), F.col("changes").alias("changes_a"))
    cb = counts.select("repo", F.col("path").alias("file_b"), F.col("changes").alias("changes_b"))
    degree = F.col("co_changes") / F.greatest("changes_a", "changes_b")
    return (
        pairs.join(ca, ["repo", "file_a"]).join(cb, ["repo", "file_b"]).withColumn("coupling_degree", degree)
        .where(F.col("coupling_degree") >= min_coupling).select("repo", "file_a", "file_b", "co_changes", "changes_a", "changes_b", "coupling_degree")
    )


def author_shares(history: DataFrame) -> DataFrame:
    """(repo, path, author, email, commits, ratio): shares of a file's changes by (name, email)."""
    each = history.groupBy("repo", "path", "author", "email").agg(F.count("*").alias("commits"))
    total = F.sum("commits").over(W.partitionBy("repo", "path"))
    return each.withColumn("ratio", F.col("commits") / total)


def ownership(history: DataFrame) -> DataFrame:
    """(repo, path, total_commits, n_authors, dominant_ratio, bus_factor, is_knowledge_silo, authors) by file.

    Authors are ordered by commits, then name, then email.
    """
    entry = F.struct((-F.col("commits")).alias("k"), "author", "email", "commits", "ratio")
    return author_shares(history).groupBy("repo", "path").agg(
        F.sum("commits").alias("total_commits"), F.count("*").alias("n_authors"), F.max("ratio").alias("dominant_ratio"),
        F.count_if(F.col("ratio") > 0.1).alias("bus_factor"), (F.max("ratio") > 0.8).alias("is_knowledge_silo"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda x: F.struct(x["author"].alias("author"), x["email"].alias("email"), x["commits"].alias("commits"), x["ratio"].alias("ratio"))).alias("authors"),
    )


def bus_factor(history: DataFrame) -> DataFrame:
    """(repo, project_bus_factor): how many authors must leave before over half the files have no main author.

    Closed form of removing the author with the most files again and again: authors are ranked once
    by their number of (file, name, email) entries, ties by email; a file is orphaned when the last
    of its authors with over a tenth of it has gone, at once if it has none.
    """
    shares = author_shares(history)
    rank = W.partitionBy("repo").orderBy(F.col("entries").desc(), "email")
    ranked = shares.groupBy("repo", "email").agg(F.count("*").alias("entries")).withColumn("pos", F.row_number().over(rank))
    gone = shares.join(ranked.select("repo", "email", "pos"), ["repo", "email"]).groupBy("repo", "path").agg(
        F.coalesce(F.max(F.when(F.col("ratio") > 0.1, F.col("pos"))), F.lit(1)).alias("gone")
    )
    steps = gone.groupBy("repo", "gone").agg(F.count("*").alias("files"))
    upto = F.sum("files").over(W.partitionBy("repo").orderBy("gone").rowsBetween(W.unboundedPreceding, 0))
    whole = F.sum("files").over(W.partitionBy("repo"))
    return steps.withColumn("orphaned", upto).withColumn("half", F.floor(whole / 2)).where("orphaned > half").groupBy("repo").agg(F.min("gone").cast("bigint").alias("project_bus_factor"))


def ownership_summary(files: DataFrame, factor: DataFrame) -> DataFrame:
    """(repo, total_files, single_author_files, knowledge_silos, project_bus_factor)."""
    total = files.groupBy("repo").agg(
        F.count("*").alias("total_files"), F.count_if(F.col("n_authors") == 1).alias("single_author_files"), F.count_if("is_knowledge_silo").alias("knowledge_silos")
    )
    return total.join(factor, "repo", "left").withColumn("project_bus_factor", F.coalesce("project_bus_factor", F.lit(0)))


def diff_hotspots(diffs: DataFrame, scored: DataFrame) -> DataFrame:
    """Changed files with the score of their path, 0 if it has none."""
    return diffs.join(scored.select("repo", F.col("path").alias("new_path"), "score"), ["repo", "new_path"], "left").withColumn("score", F.coalesce("score", F.lit(0.0)))


def insight_lines(changed: DataFrame, scored: DataFrame, coupled: DataFrame, owned: DataFrame, since_days: int = 180) -> DataFrame:
    """(repo, part, sort_key, line): what the history says about changed files (repo, path).

    A coupling line comes once, also if both of its files changed.
    """
    two = lambda c: F.format_string("%.2f", F.col(c).cast("double"))
    spots = scored.join(changed, ["repo", "path"], "left_semi").select(
        "repo", F.lit(1).alias("part"), F.col("path").alias("sort_key"),
        F.concat(
            F.lit("- "), "path", F.lit(": "), F.col("revisions").cast("string"), F.lit(f" changes within {since_days} days by "), F.col("authors").cast("string"), F.lit(" people; history score "), two("score"),
            F.when(F.col("score") >= 0.7, F.lit(", one of the most reworked files")).otherwise(F.lit("")),
        ).alias("line"),
    )
    names = changed.select("repo", "path")
    side = lambda f: coupled.join(names.withColumnRenamed("path", f), ["repo", f], "left_semi")
    pairs = side("file_a").unionByName(side("file_b")).distinct().select(
        "repo", F.lit(2).alias("part"), F.concat_ws("|", "file_a", "file_b").alias("sort_key"),
        F.concat(F.lit("- "), "file_a", F.lit(" and "), "file_b", F.lit(" changed together "), F.col("co_changes").cast("string"), F.lit(" times, a degree of "), two("coupling_degree")).alias("line"),
    )
    silos = owned.where("is_knowledge_silo").join(changed, ["repo", "path"], "left_semi").select(
        "repo", F.lit(3).alias("part"), F.col("path").alias("sort_key"),
        F.concat(F.lit("- "), "path", F.lit(": known to few, "), F.format_string("%.0f", F.col("authors")[0]["ratio"] * 100), F.lit("% of its commits are by "), F.col("authors")[0]["email"]).alias("line"),
    )
    return spots.unionByName(pairs).unionByName(silos)


def hotspot_banner(path: Column, score: Column) -> Column:
    """The note for a changed file by its score's band, null below 0.4."""
    two = F.format_string("%.2f", score.cast("double"))
    return F.when(
        score >= 0.7, F.concat(path, F.lit(": history score "), two, F.lit(", among the most reworked files of this repository. Read every changed line of it closely and report doubtful ones too."))
    ).when(score >= 0.4, F.concat(path, F.lit(": history score "), two, F.lit(", reworked more than most. Look twice.")))
