"""The core's queries over the test tables, each with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scores, text
from ..operators import diffs, findings, history, retrieval, state, symbols
from ..session import ship
from ..sources import sinks
from .lineage import checkpointed, numbered

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}
NOW = 1_767_225_600  # the first second of 2026: a fixed present for windows over history


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        def run(spark: SparkSession, d: str) -> DataFrame:
            ship(spark)
            return f(spark, d)

        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = sql
        return f

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def r6(*cols: str) -> list:
    return [F.round(c, 6).alias(c) for c in cols]


# ------------------------------------------------------------------ history

def _history(spark: SparkSession, d: str, max_files: int | None = 25) -> DataFrame:
    return history.clean_changes(t(spark, d, "file_changes"), max_files).join(history.clean_commits(t(spark, d, "commits")), "commit_id")


def _current(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "source_files").where("repo is not null and path is not null and content is not null")
    return files.select("repo", "path", text.line_count("content").alias("loc")).groupBy("repo", "path").agg(F.max("loc").alias("loc"))


_H = """
cc AS (SELECT commit_id, min(repo) AS repo, coalesce(min(author), 'unknown') AS author, coalesce(min(email), 'unknown') AS email, min(ts) AS ts
       FROM commits WHERE commit_id IS NOT NULL AND repo IS NOT NULL GROUP BY 1),
fc AS (SELECT DISTINCT commit_id, path, coalesce(lines_added, 0) AS lines_added, coalesce(lines_deleted, 0) AS lines_deleted
       FROM file_changes WHERE commit_id IS NOT NULL AND path IS NOT NULL AND path <> ''),
nc AS (SELECT commit_id FROM fc GROUP BY 1 HAVING count(*) <= 25),
h AS (SELECT * FROM fc JOIN nc USING (commit_id) JOIN cc USING (commit_id)),
cur AS (SELECT repo, path, max(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END END) AS loc
        FROM source_files WHERE repo IS NOT NULL AND path IS NOT NULL AND content IS NOT NULL GROUP BY ALL)
"""
_SPOTS = f"""{_H},
b0 AS (SELECT repo, path, count(*) AS revisions, sum(lines_added + lines_deleted) AS total_churn, count(DISTINCT author) AS authors, greatest(max(ts), 0) AS last_modified FROM h GROUP BY ALL),
b1 AS (SELECT *, CASE WHEN loc > 0 THEN total_churn / loc ELSE 0.0 END AS rel FROM b0 JOIN cur USING (repo, path)),
m1 AS (SELECT repo, max(revisions) AS mr, greatest(max(rel), 1.0) AS ml, max(loc) AS mc FROM b1 GROUP BY 1),
spots AS (SELECT b1.*, 0.5 * revisions / mr + 0.3 * rel / ml + CASE WHEN mc > 0 THEN 0.2 * loc / mc ELSE 0.0 END AS score FROM b1 JOIN m1 USING (repo))
"""


@query(f"""WITH {_SPOTS}, o AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY round(score, 9) DESC, path) AS place FROM spots)
SELECT repo, path, revisions, total_churn::BIGINT AS total_churn, loc::BIGINT AS current_loc, authors, last_modified, round(score, 6) AS score, place FROM o WHERE place <= 20""")
def hotspots_topk(spark: SparkSession, d: str) -> DataFrame:
    spots = history.hotspots(_history(spark, d), _current(spark, d))
    top = history.top_per_repo(spots, 20, F.round("score", 9).desc(), F.col("path"))
    return top.select("repo", "path", "revisions", "total_churn", F.col("current_loc").cast("bigint").alias("current_loc"), "authors", "last_modified", *r6("score"), F.col("place").cast("bigint").alias("place"))


@query(f"WITH {_SPOTS} SELECT repo, path, revisions, total_churn::BIGINT AS total_churn, authors, last_modified FROM b0")
def hotspot_base(spark: SparkSession, d: str) -> DataFrame:
    return history.hotspot_base(_history(spark, d))


@query(f"""WITH {_H} SELECT cc.repo, commit_id, count(*) AS files, sum(lines_added + lines_deleted)::BIGINT AS churn FROM h JOIN cc USING (commit_id)
WHERE cc.ts >= {NOW} - 400 * 86400 GROUP BY ALL""")
def wide_commit_guard(spark: SparkSession, d: str) -> DataFrame:
    recent = history.clean_commits(t(spark, d, "commits"), NOW, 400)
    rows = history.clean_changes(t(spark, d, "file_changes")).join(recent, "commit_id")
    return rows.groupBy("repo", "commit_id").agg(F.count("*").alias("files"), F.sum(F.col("lines_added") + F.col("lines_deleted")).alias("churn"))


_COUPLED = f"""{_H},
tch AS (SELECT DISTINCT repo, commit_id, path FROM h), kc AS (SELECT repo, path, count(*) AS n FROM tch GROUP BY ALL),
pr AS (SELECT a.repo, a.path AS file_a, b.path AS file_b, count(*) AS co_changes FROM tch a JOIN tch b USING (repo, commit_id) WHERE a.path < b.path GROUP BY ALL HAVING count(*) >= 3),
coupled AS (SELECT pr.*, x.n AS changes_a, y.n AS changes_b, co_changes / greatest(x.n, y.n) AS coupling_degree FROM pr
  JOIN kc x ON x.repo = pr.repo AND x.path = file_a JOIN kc y ON y.repo = pr.repo AND y.path = file_b WHERE co_changes / greatest(x.n, y.n) >= 0.3)
"""


@query(f"WITH {_COUPLED} SELECT repo, file_a, file_b, co_changes, changes_a, changes_b, round(coupling_degree, 6) AS coupling_degree FROM coupled")
def coupling_pairs(spark: SparkSession, d: str) -> DataFrame:
    out = history.coupling(_history(spark, d))
    return out.withColumn("coupling_degree", F.round("coupling_degree", 6))


_OWN = f"""{_H},
sh0 AS (SELECT repo, path, author, email, count(*) AS commits FROM h GROUP BY ALL),
sh AS (SELECT *, commits / sum(commits) OVER (PARTITION BY repo, path) AS ratio FROM sh0),
owned AS (SELECT repo, path, sum(commits)::BIGINT AS total_commits, count(*) AS n_authors, max(ratio) AS dominant_ratio, count(*) FILTER (WHERE ratio > 0.1) AS bus_factor,
  max(ratio) > 0.8 AS is_knowledge_silo, arg_min(email, (-commits, author, email)) AS top_email FROM sh GROUP BY ALL),
pos AS (SELECT repo, email, row_number() OVER (PARTITION BY repo ORDER BY count(*) DESC, email) AS pos FROM sh GROUP BY repo, email),
gone AS (SELECT repo, path, coalesce(max(pos) FILTER (WHERE ratio > 0.1), 1) AS gone FROM sh JOIN pos USING (repo, email) GROUP BY ALL),
steps AS (SELECT repo, gone, sum(count(*)) OVER (PARTITION BY repo ORDER BY gone) AS orphaned, sum(count(*)) OVER (PARTITION BY repo) AS files FROM gone GROUP BY repo, gone),
factor AS (SELECT repo, min(gone) AS project_bus_factor FROM steps WHERE orphaned > files // 2 GROUP BY 1)
"""


@query(f"WITH {_OWN} SELECT repo, path, total_commits, n_authors, round(dominant_ratio, 6) AS dominant_ratio, bus_factor, is_knowledge_silo, top_email FROM owned")
def ownership_files(spark: SparkSession, d: str) -> DataFrame:
    out = history.ownership(_history(spark, d))
    return out.select("repo", "path", "total_commits", "n_authors", *r6("dominant_ratio"), "bus_factor", "is_knowledge_silo", F.col("authors")[0]["email"].alias("top_email"))


@query(f"""WITH {_OWN} SELECT o.repo, count(*) AS total_files, count(*) FILTER (WHERE n_authors = 1) AS single_author_files, count(*) FILTER (WHERE is_knowledge_silo) AS knowledge_silos,
coalesce(any_value(project_bus_factor), 0) AS project_bus_factor FROM owned o LEFT JOIN factor f ON f.repo = o.repo GROUP BY o.repo""")
def ownership_summary(spark: SparkSession, d: str) -> DataFrame:
    rows = _history(spark, d)
    return history.ownership_summary(history.ownership(rows), history.bus_factor(rows))


@query(f"WITH {_OWN} SELECT repo, project_bus_factor FROM factor")
def project_bus_factor(spark: SparkSession, d: str) -> DataFrame:
    return history.bus_factor(_history(spark, d))


@query(f"WITH {_OWN} SELECT repo, path, author, email, commits, round(ratio, 6) AS ratio FROM sh")
def author_shares(spark: SparkSession, d: str) -> DataFrame:
    return history.author_shares(_history(spark, d)).withColumn("ratio", F.round("ratio", 6))


_DF = """
df AS (SELECT diff_id, file_ord, any_value(repo) AS repo, any_value(old_path) AS old_path, any_value(new_path) AS new_path, any_value(is_new) AS is_new, any_value(is_deleted) AS is_deleted, any_value(is_rename) AS is_rename
       FROM diff_files WHERE diff_id IS NOT NULL AND file_ord IS NOT NULL GROUP BY diff_id, file_ord),
dh AS (SELECT diff_id, file_ord, hunk_ord, any_value(content) AS content, any_value(old_start) AS old_start, any_value(old_lines) AS old_lines, any_value(new_start) AS new_start, any_value(new_lines) AS new_lines,
       any_value(file_path) AS file_path, any_value(change_type) AS change_type FROM diff_hunks WHERE diff_id IS NOT NULL AND file_ord IS NOT NULL AND hunk_ord IS NOT NULL GROUP BY diff_id, file_ord, hunk_ord)
"""


def _files(spark: SparkSession, d: str) -> DataFrame:
    return diffs.clean_files(t(spark, d, "diff_files"))


def _hunks(spark: SparkSession, d: str) -> DataFrame:
    return diffs.clean_hunks(t(spark, d, "diff_hunks"))


@query(f"WITH {_SPOTS}, {_DF} SELECT diff_id, file_ord, df.repo, new_path, round(coalesce(score, 0.0), 6) AS score FROM df LEFT JOIN spots ON spots.repo = df.repo AND spots.path = new_path")
def diff_hotspots(spark: SparkSession, d: str) -> DataFrame:
    out = history.diff_hotspots(_files(spark, d), history.hotspots(_history(spark, d), _current(spark, d)))
    return out.select("diff_id", "file_ord", "repo", "new_path", *r6("score"))


@query(f"""WITH {_COUPLED}, {_DF}, ch AS (SELECT DISTINCT repo, new_path AS path FROM df)
SELECT repo, file_a, file_b, co_changes FROM coupled WHERE (repo, file_a) IN (SELECT (repo, path) FROM ch) OR (repo, file_b) IN (SELECT (repo, path) FROM ch)""")
def changed_couplings(spark: SparkSession, d: str) -> DataFrame:
    changed = _files(spark, d).select("repo", F.col("new_path").alias("path")).distinct()
    pairs = history.coupling(_history(spark, d))
    side = lambda f: pairs.join(changed.withColumnRenamed("path", f), ["repo", f], "left_semi")
    return side("file_a").unionByName(side("file_b")).distinct().select("repo", "file_a", "file_b", "co_changes")


def _two(x: str) -> str:
    return f"printf('%.2f', round(({x})::DECIMAL(18,9), 2)::DOUBLE)"


_TAIL = f"""{_SPOTS}, {_COUPLED.replace(_H + ',', '')}, {_OWN.replace(_H + ',', '')}, {_DF},
ch AS (SELECT DISTINCT repo, new_path AS path FROM df WHERE repo IS NOT NULL AND new_path IS NOT NULL)"""


@query(f"""WITH {_TAIL}
SELECT repo, 1 AS part, path AS sort_key, '- ' || path || ': ' || revisions || ' changes within 180 days by ' || authors || ' people; history score ' || {_two('score')} || CASE WHEN score >= 0.7 THEN ', one of the most reworked files' ELSE '' END AS line
FROM spots SEMI JOIN ch USING (repo, path)
UNION ALL SELECT repo, 2, file_a || '|' || file_b, '- ' || file_a || ' and ' || file_b || ' changed together ' || co_changes || ' times, a degree of ' || {_two('coupling_degree')} FROM coupled c
WHERE EXISTS (SELECT 1 FROM ch WHERE ch.repo = c.repo AND (ch.path = file_a OR ch.path = file_b))
UNION ALL SELECT repo, 3, path, '- ' || path || ': known to few, ' || round((dominant_ratio * 100)::DECIMAL(18,9), 0)::BIGINT || '% of its commits are by ' || top_email FROM owned SEMI JOIN ch USING (repo, path) WHERE is_knowledge_silo""")
def history_insights(spark: SparkSession, d: str) -> DataFrame:
    rows = _history(spark, d)
    changed = _files(spark, d).select("repo", F.col("new_path").alias("path")).distinct()
    return history.insight_lines(changed, history.hotspots(rows, _current(spark, d)), history.coupling(rows), history.ownership(rows))


# ------------------------------------------------------------------ diffs

_LINES = "string_split(content, chr(10))"
_MARKED = "len(list_filter({0}, lambda x: starts_with(x, '{1}')))"
_FACTS = f"""{_DF},
hl AS (SELECT *, CASE WHEN content = '' THEN []::VARCHAR[] WHEN content LIKE '%' || chr(10) THEN {_LINES}[:-2] ELSE {_LINES} END AS ln FROM dh),
hf AS (SELECT diff_id, file_ord, hunk_ord, ln, {_MARKED.format('ln', '+')} AS added, {_MARKED.format('ln', '-')} AS deleted, coalesce(list_max(list_transform(ln, lambda x: strlen(x))), 0) AS longest, strlen(content) AS bytes FROM hl),
ff AS (SELECT diff_id, file_ord, count(*) AS hunks, sum(added)::BIGINT AS added, sum(deleted)::BIGINT AS deleted, max(longest) AS longest, sum(bytes)::BIGINT AS bytes,
  len(list_filter(flatten(list(ln ORDER BY hunk_ord))[:5], lambda x: contains(x, '// Code generated') OR contains(x, '# AUTO-GENERATED'))) > 0 AS marked FROM hf GROUP BY ALL),
fx AS (SELECT df.*, split_part(new_path, '/', -1) AS name, coalesce(hunks, 0) AS hunks, coalesce(added, 0) AS added, coalesce(deleted, 0) AS deleted, coalesce(longest, 0) AS longest, coalesce(bytes, 0) AS bytes, coalesce(marked, false) AS marked
       FROM df LEFT JOIN ff USING (diff_id, file_ord))
"""
_EXT = "regexp_extract({0}, '^.+\\.([^.]*)$', 1)"


@query(f"""WITH {_FACTS} SELECT diff_id, file_ord, new_path, CASE
WHEN name IN ('package-lock.json', 'yarn.lock', 'Cargo.lock', 'pnpm-lock.yaml', 'poetry.lock', 'Gemfile.lock', 'composer.lock', 'go.sum') THEN 'lock file'
WHEN list_has_any(string_split(new_path, '/'), ['vendor', 'third_party', 'node_modules']) THEN 'vendored'
WHEN name LIKE '%.min.js' OR name LIKE '%.min.css' OR longest > 500 THEN 'minified'
WHEN contains(name, '.generated.') OR name LIKE '%.g.dart' OR name LIKE '%.pb.go' OR name LIKE '%.pb.rs' OR marked THEN 'generated'
WHEN {_EXT.format('name')} IN ('rb', 'snap') THEN 'pattern: *.' || {_EXT.format('name')}
WHEN added + deleted > 40 THEN 'too large' WHEN new_path LIKE '%/index.%' THEN 'pattern: */index.*' END AS skip_reason FROM fx""")
def skip_cascade(spark: SparkSession, d: str) -> DataFrame:
    rows = diffs.skip_cascade(_files(spark, d), _hunks(spark, d), ("rb", "snap"), ("*/index.*", "[broken"), max_changed=40)
    return rows.select("diff_id", "file_ord", "new_path", "skip_reason")


_BRANCH = " + ".join(
    f"(starts_with(x, '{w}') OR contains(x, ' {w}'))::INT" for w in scores.BRANCHES
) + " + (contains(x, '?') AND contains(x, ':'))::INT"
_CX = f"""{_FACTS},
bl AS (SELECT diff_id, file_ord, hunk_ord, unnest(ln) AS l FROM hl), bt AS (SELECT diff_id, file_ord, hunk_ord, left(l, 1) AS mark, regexp_replace(l[2:], '^\\s+|\\s+$', '', 'g') AS x FROM bl),
bc AS (SELECT diff_id, file_ord, hunk_ord, sum(CASE mark WHEN '+' THEN 1 WHEN '-' THEN -1 ELSE 0 END * ({_BRANCH}))::BIGINT AS delta FROM bt GROUP BY ALL),
hc AS (SELECT diff_id, file_ord, hunk_ord, coalesce(delta, 0) AS delta, least(100.0, abs(coalesce(delta, 0)) * 15.0) AS complexity FROM dh LEFT JOIN bc USING (diff_id, file_ord, hunk_ord)),
fc2 AS (SELECT diff_id, file_ord, avg(complexity) AS complexity FROM hc GROUP BY ALL),
fr AS (SELECT fx.*, coalesce(complexity, 0.0) AS complexity, least((added + deleted) * 2.0, 100.0) AS size, least(hunks * 20.0, 100.0) AS diffusion,
  CASE WHEN {_EXT.format('name')} IN ('rs', 'py', 'ts', 'tsx', 'js', 'jsx', 'go', 'java', 'c', 'cpp', 'h') THEN 50.0 WHEN {_EXT.format('name')} IN ('toml', 'yaml', 'yml', 'json') THEN 20.0 WHEN {_EXT.format('name')} IN ('md', 'txt', 'rst') THEN 5.0 ELSE 30.0 END AS file_type
  FROM fx LEFT JOIN fc2 USING (diff_id, file_ord)),
fk AS (SELECT *, least(greatest(0.25 * size + 0.25 * complexity + 0.2 * diffusion + 0.15 * file_type, 0.0), 100.0) AS total FROM fr)
"""
_LEVEL = "CASE WHEN {0} <= 25 THEN 'low' WHEN {0} <= 50 THEN 'medium' WHEN {0} <= 75 THEN 'high' ELSE 'critical' END"


@query(f"WITH {_CX} SELECT diff_id, file_ord, hunk_ord, delta::INT AS delta, complexity::DOUBLE AS complexity FROM hc")
def branch_keywords(spark: SparkSession, d: str) -> DataFrame:
    return _hunks(spark, d).select("diff_id", "file_ord", "hunk_ord", scores.branch_delta("content").alias("delta"), scores.hunk_complexity("content").alias("complexity"))


@query(f"""WITH {_CX} SELECT diff_id, file_ord, new_path, CASE WHEN is_new THEN 'add' WHEN is_deleted THEN 'delete' WHEN is_rename THEN 'move' ELSE 'modify' END AS change_type, added, deleted,
round(size::DOUBLE, 6) AS size, round(complexity::DOUBLE, 6) AS complexity, round(diffusion::DOUBLE, 6) AS diffusion, file_type::DOUBLE AS file_type, round(total::DOUBLE, 6) AS total, {_LEVEL.format('total')} AS level FROM fk""")
def risk_files(spark: SparkSession, d: str) -> DataFrame:
    out = diffs.file_risk(_files(spark, d), _hunks(spark, d))
    return out.select("diff_id", "file_ord", "new_path", "change_type", F.col("added").cast("bigint").alias("added"), F.col("deleted").cast("bigint").alias("deleted"), *r6("size", "complexity", "diffusion", "file_type", "total"), "level")


@query(f"""WITH {_CX}, o AS (SELECT diff_id, count(*) AS total_files, sum(added)::BIGINT AS total_additions, sum(deleted)::BIGINT AS total_deletions, avg(complexity) AS cx, max(file_type) AS ft FROM fk GROUP BY 1),
o2 AS (SELECT *, least(0.25 * least((total_additions + total_deletions) * 2.0, 100.0) + 0.25 * cx + 0.2 * least(total_files * 20.0, 100.0) + 0.15 * ft, 100.0) AS total FROM o)
SELECT diff_id, total_files, total_additions, total_deletions, round(total::DOUBLE, 6) AS total, {_LEVEL.format('total')} AS risk_level FROM o2""")
def risk_report(spark: SparkSession, d: str) -> DataFrame:
    out = diffs.overall_risk(diffs.file_risk(_files(spark, d), _hunks(spark, d)))
    return out.select("diff_id", "total_files", F.col("total_additions").cast("bigint").alias("total_additions"), F.col("total_deletions").cast("bigint").alias("total_deletions"), *r6("total"), "risk_level")


@query(f"WITH {_FACTS} SELECT diff_id, file_ord, ((strlen(old_path) + 7 + strlen(new_path) + 7 + hunks * 20 + bytes) // 4)::BIGINT AS tokens FROM fx")
def diff_size_estimate(spark: SparkSession, d: str) -> DataFrame:
    return diffs.size_estimate(_files(spark, d), _hunks(spark, d)).select("diff_id", "file_ord", "tokens")


@query(f"""WITH {_DF}, b AS (SELECT diff_id, file_ord, string_agg('@@ -' || old_start || ',' || old_lines || ' +' || new_start || ',' || new_lines || ' @@' || chr(10) || content, '' ORDER BY hunk_ord) AS body FROM dh GROUP BY ALL)
SELECT diff_id, file_ord, '--- a/' || old_path || chr(10) || '+++ b/' || new_path || chr(10) || coalesce(body, '') AS text FROM df LEFT JOIN b USING (diff_id, file_ord)""")
def rebuilt_diffs(spark: SparkSession, d: str) -> DataFrame:
    return diffs.rebuilt(_files(spark, d), _hunks(spark, d))


@query(f"""WITH {_DF} SELECT diff_id || '#' || file_ord AS diff_id, 0 AS file_ord, (row_number() OVER (PARTITION BY dh.diff_id, file_ord ORDER BY hunk_ord) - 1)::INT AS hunk_ord, CASE WHEN new_path = '/dev/null' THEN old_path ELSE new_path END AS file_path, old_start, old_lines, new_start, new_lines, CASE WHEN content LIKE '%' || chr(10) THEN content ELSE content || chr(10) END AS content,
CASE WHEN old_path = '/dev/null' OR old_lines = 0 THEN 'add' WHEN new_path = '/dev/null' OR new_lines = 0 THEN 'delete' ELSE 'modify' END AS change_type
FROM dh JOIN df USING (diff_id, file_ord)""")
def diff_parse(spark: SparkSession, d: str) -> DataFrame:
    files, hunks = _files(spark, d), _hunks(spark, d)
    # a hunk's stored text may lack the last line break that a written diff has
    whole = hunks.withColumn("content", F.when(F.col("content").endswith("\n"), F.col("content")).otherwise(F.concat("content", F.lit("\n"))))
    texts = diffs.rebuilt(files.join(whole.select("diff_id", "file_ord").distinct(), ["diff_id", "file_ord"], "left_semi"), whole)
    # the counts of a hunk's header settle what belongs to it, so removed lines like '-- x' stay content
    rows = diffs.parsed(texts.select(F.concat_ws("#", "diff_id", "file_ord").alias("diff_id"), "text"))
    return diffs.hunks_of(rows).select("diff_id", "file_ord", "hunk_ord", "file_path", "old_start", "old_lines", "new_start", "new_lines", "content", "change_type")


@query(f"""WITH RECURSIVE {_FACTS}, e AS (SELECT diff_id, file_ord AS ord, regexp_extract(new_path, '^(.*)/[^/]*$', 1) AS dir, ((strlen(old_path) + 7 + strlen(new_path) + 7 + hunks * 20 + bytes) // 4)::BIGINT AS tokens FROM fx),
n AS (SELECT *, row_number() OVER (PARTITION BY diff_id, dir ORDER BY ord) AS k FROM e),
w(diff_id, dir, ord, k, used, grp) AS (SELECT diff_id, dir, ord, k, tokens, 0 FROM n WHERE k = 1
  UNION ALL SELECT n.diff_id, n.dir, n.ord, n.k, CASE WHEN w.used + n.tokens > 200 AND w.used > 0 THEN n.tokens ELSE w.used + n.tokens END, CASE WHEN w.used + n.tokens > 200 AND w.used > 0 THEN w.grp + 1 ELSE w.grp END
  FROM w JOIN n ON n.diff_id = w.diff_id AND n.dir = w.dir AND n.k = w.k + 1),
x AS (SELECT diff_id, dir, max(grp) + 1 AS g FROM w GROUP BY ALL), y AS (SELECT diff_id, dir, coalesce(sum(g) OVER (PARTITION BY diff_id ORDER BY string_split(dir, '/') ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS base FROM x)
SELECT diff_id, ord, (base + grp)::INT AS group_no FROM w JOIN y USING (diff_id, dir)""")
def directory_pack(spark: SparkSession, d: str) -> DataFrame:
    sizes = diffs.size_estimate(_files(spark, d), _hunks(spark, d))
    return diffs.pack_groups(sizes.select("diff_id", F.col("file_ord").alias("ord"), "new_path", "tokens"), 200).select("diff_id", "ord", "group_no")


@query(f"""WITH {_DF}, p AS (SELECT diff_id, count(*) AS n, list(split_part(new_path, '/', -1) ORDER BY file_ord) AS names, list(string_split(new_path, '/')[:-2] ORDER BY file_ord) AS dirs FROM df GROUP BY 1),
q AS (SELECT *, list_filter(range(1, 40), lambda i: len(dirs[1]) >= i AND len(list_filter(dirs, lambda s: s[:i] = dirs[1][:i])) = n) AS ok FROM p),
c AS (SELECT *, array_to_string(dirs[1][:coalesce(list_max(ok), 0)], '/') AS common FROM q)
SELECT diff_id, CASE WHEN n = 1 THEN names[1] WHEN common <> '' THEN common || '/' WHEN n > 3 THEN array_to_string(names[:3], ', ') || ', ...' ELSE array_to_string(names, ', ') END AS label FROM c""")
def group_labels(spark: SparkSession, d: str) -> DataFrame:
    paths = _files(spark, d).groupBy("diff_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("file_ord", "new_path"))), lambda x: x["new_path"]).alias("paths"))
    return paths.select("diff_id", text.group_label("paths").alias("label"))


# ------------------------------------------------------------------ retrieval

_CH = """
ch AS (SELECT chunk_id, any_value(file_path) AS file_path, any_value(start_line) AS start_line, any_value(entity_name) AS entity_name, any_value(content) AS content, any_value(context_header) AS context_header,
       any_value(content_hash) AS content_hash, any_value(embedding) AS embedding FROM chunks WHERE chunk_id IS NOT NULL GROUP BY chunk_id)
"""


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "chunks").where("chunk_id is not null").dropDuplicates(["chunk_id"])


@query("""WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS q FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id, round(list_cosine_similarity(q, embedding::DOUBLE[]), 6) AS score FROM embeddings, q WHERE vec_id <> query_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM s) SELECT query_id, vec_id, score, place::INT AS place FROM o WHERE place <= 10""")
def vector_topk(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "embeddings")
    asked = rows.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query_vector"))  # the stated query set
    hits = retrieval.vector_search(rows, asked, 20, "vec_id", exclude_self=True).withColumn("score", F.round("score", 6))
    return retrieval.first_places(hits.drop("place"), 10, "vec_id").select("query_id", "vec_id", "score", "place")


_TOK = "regexp_extract_all(lower(coalesce({0}, '')), '[a-z0-9]+')"
_BM = f"""{_CH},
dk AS (SELECT chunk_id, list_concat(list_concat({_TOK.format('entity_name')}, {_TOK.format('content')}), {_TOK.format('context_header')}) AS toks FROM ch),
pt AS (SELECT chunk_id, term, count(*) AS tf, any_value(l) AS len FROM (SELECT chunk_id, len(toks) AS l, unnest(toks) AS term FROM dk) GROUP BY ALL),
st AS (SELECT count(*) AS n_docs, avg(len(toks)) AS avg_len FROM dk WHERE len(toks) > 0), dfq AS (SELECT term, count(*) AS df FROM pt GROUP BY 1)
"""
_BMSCORE = "round(sum(greatest(ln((n_docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 9)"


@query(f"""WITH {_BM}, qs AS (SELECT query_id, any_value(query_text) AS query_text FROM search_queries GROUP BY 1), qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(query_text), '[a-z0-9]+')) AS term FROM qs),
s AS (SELECT query_id, chunk_id, {_BMSCORE} AS score FROM qt JOIN pt USING (term) JOIN dfq USING (term), st GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM s) SELECT query_id, chunk_id, round(score, 6) AS score, place::INT AS place FROM o WHERE place <= 10""")
def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    post = retrieval.postings(_chunks(spark, d), "chunk_id", "entity_name", "content", "context_header")
    asked = t(spark, d, "search_queries").groupBy("query_id").agg(F.min("query_text").alias("query_text"))
    return retrieval.bm25(post, asked, "chunk_id", 10).select("query_id", "chunk_id", *r6("score"), "place")


_FUSE = """
v AS (SELECT query_id, source, chunk_id, max(score) AS score FROM hits WHERE score IS NOT NULL AND NOT isnan(score) AND query_id IS NOT NULL AND source IS NOT NULL AND chunk_id IS NOT NULL GROUP BY ALL),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id, source ORDER BY score DESC, chunk_id) AS place FROM v),
f AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + place)) AS score, count(*) AS n_lists FROM p GROUP BY ALL)
"""


@query(f"WITH {_FUSE} SELECT query_id, chunk_id, round(score, 6) AS score, n_lists FROM f")
def rrf_fusion(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "hits").where("query_id is not null and source is not null and chunk_id is not null and score is not null and not isnan(score)")
    rows = rows.groupBy("query_id", "source", "chunk_id").agg(F.max("score").alias("score"))
    placed = numbered(rows, ["query_id", "source"], [F.col("score").desc(), F.col("chunk_id")])
    return retrieval.fuse(placed, "chunk_id").select("query_id", "chunk_id", *r6("score"), "n_lists")


@query(f"""WITH {_BM}, q AS (SELECT chunk_id AS query_id, embedding::DOUBLE[] AS q, entity_name FROM ch WHERE chunk_id % 50 = 0),
cv AS (SELECT chunk_id, embedding::DOUBLE[] AS e FROM ch WHERE embedding IS NOT NULL),
vs AS (SELECT query_id, chunk_id, CASE WHEN len(q) <> len(e) OR len(e) = 0 OR list_sum(list_transform(q, lambda x: x * x)) = 0 OR list_sum(list_transform(e, lambda x: x * x)) = 0 THEN 0.0 ELSE list_cosine_similarity(q, e) END AS score FROM q, cv WHERE q IS NOT NULL),
vp AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS place FROM vs QUALIFY place <= 20),
qt AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(entity_name), '[a-z0-9]+')) AS term FROM q),
ks AS (SELECT query_id, chunk_id, {_BMSCORE} AS score FROM qt JOIN pt USING (term) JOIN dfq USING (term), st GROUP BY ALL),
kp AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM ks QUALIFY place <= 20),
f AS (SELECT query_id, chunk_id, round(sum(1.0::DOUBLE / (60 + place)), 12) AS score FROM (SELECT * FROM vp UNION ALL SELECT * FROM kp) GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS place FROM f) SELECT query_id, chunk_id, round(score, 6) AS score, place::INT AS place FROM o WHERE place <= 10""")
def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    asked = rows.where("chunk_id % 50 = 0")  # the stated query set
    near = retrieval.vector_search(rows, asked.select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query_vector")), 200)
    near = near.withColumn("score", F.round("score", 9)).drop("place")
    near = retrieval.first_places(near, 20, "chunk_id")
    post = retrieval.postings(rows, "chunk_id", "entity_name", "content", "context_header")
    words = retrieval.bm25(post, asked.select(F.col("chunk_id").alias("query_id"), F.col("entity_name").alias("query_text")), "chunk_id", 20)
    return retrieval.hybrid(near, words, "chunk_id", 10).select("query_id", "chunk_id", *r6("score"), "place")


@query("SELECT content_hash, max(chunk_id) AS chunk_id, count(DISTINCT chunk_id) AS places FROM chunks WHERE content_hash IS NOT NULL GROUP BY 1")
def chunk_upsert(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d).where("content_hash is not null")
    last = retrieval.by_content(rows.select("chunk_id", "file_path", "content_hash")).select("content_hash", "chunk_id")
    return last.join(rows.groupBy("content_hash").agg(F.count("*").alias("places")), "content_hash")


@query("""WITH a AS (SELECT path, min(sha256(content)) AS h FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY 1), b AS (SELECT file_path AS path, max(content_hash) AS h FROM chunks WHERE file_path IS NOT NULL GROUP BY 1)
SELECT path, CASE WHEN b.h IS NULL THEN 'new' WHEN a.h IS NULL THEN 'deleted' WHEN a.h = b.h THEN 'unchanged' ELSE 'changed' END AS state FROM a FULL JOIN b USING (path)""")
def incremental_states(spark: SparkSession, d: str) -> DataFrame:
    now = t(spark, d, "source_files").where("path is not null and content is not null").groupBy("path").agg(F.min(text.content_hash("content")).alias("hash"))
    then = t(spark, d, "chunks").where("file_path is not null").groupBy(F.col("file_path").alias("path")).agg(F.max("content_hash").alias("hash"))
    return retrieval.classify(now, then)


@query(f"""WITH {_CH} SELECT (SELECT count(*) FROM ch) AS total_chunks, (SELECT count(*) FROM ch WHERE embedding IS NOT NULL AND len(embedding) > 0) AS embedded_chunks, (SELECT count(DISTINCT file_id) FROM source_files) AS total_files""")
def index_stats(spark: SparkSession, d: str) -> DataFrame:
    return retrieval.index_stats(_chunks(spark, d), t(spark, d, "source_files").select("file_id").distinct())


@query("WITH a AS (SELECT DISTINCT sha256(content) AS content_hash FROM chunks WHERE content IS NOT NULL) SELECT content_hash FROM a WHERE content_hash IN (SELECT content_hash FROM chunks WHERE content_hash IS NOT NULL)")
def has_chunks(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "chunks")
    return retrieval.has_chunks(rows.where("content is not null").select(text.content_hash("content").alias("content_hash")).distinct(), rows)


@query(f"""WITH {_BM}, {_DF}, sm AS (SELECT diff_id, file_ord, new_path, regexp_replace(split_part(new_path, '/', -1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM df WHERE new_path IS NOT NULL),
qt AS (SELECT DISTINCT stem, unnest(regexp_extract_all(lower(stem), '[a-z0-9]+')) AS term FROM sm WHERE stem <> ''), s AS (SELECT stem, chunk_id, {_BMSCORE} AS score FROM qt JOIN pt USING (term) JOIN dfq USING (term), st GROUP BY ALL),
o AS (SELECT *, row_number() OVER (PARTITION BY stem ORDER BY score DESC, chunk_id) AS place FROM s QUALIFY place <= 3),
r AS (SELECT diff_id, file_ord, place, chunk_id, '// Related: ' || coalesce(entity_name, '') || ' (' || file_path || ':' || start_line || ')' || chr(10) || coalesce(content, '') AS snippet FROM sm JOIN o USING (stem) JOIN ch USING (chunk_id) WHERE file_path <> new_path),
n AS (SELECT *, row_number() OVER (PARTITION BY diff_id ORDER BY file_ord, place, chunk_id) AS part_no FROM r QUALIFY part_no <= 3),
u AS (SELECT *, sum(strlen(snippet)) OVER (PARTITION BY diff_id ORDER BY part_no) + 2 * (part_no - 1) AS used FROM n)
SELECT diff_id, part_no::INT AS part_no, chunk_id, snippet FROM u WHERE used <= 4000""")
def related_snippets(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d)
    post = retrieval.postings(rows, "chunk_id", "entity_name", "content", "context_header")
    return retrieval.related_snippets(_files(spark, d), post, rows)


@query("""SELECT query_id, array_to_string(list_transform(list_filter(list_transform(regexp_split_to_array(query_text, '\\s+'), lambda w: regexp_replace(w, '[^\\pL\\pM\\p{N}_]', '', 'g')), lambda w: w <> ''), lambda w: '"' || w || '"'), ' OR ') AS keywords
FROM (SELECT DISTINCT query_id, query_text FROM search_queries)""")
def keyword_queries(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "search_queries").select("query_id", "query_text").distinct().select("query_id", text.keyword_query("query_text").alias("keywords"))


# ------------------------------------------------------------------ symbols and graphs

def _sources(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "source_files").where("file_id is not null").dropDuplicates(["file_id"])
    return files.select(F.concat_ws(":", "repo", "path").alias("key"), "path", "content")


@query()
def symbol_table(spark: SparkSession, d: str) -> DataFrame:
    found = symbols.identified(symbols.symbols(symbols.readable(_sources(spark, d), "key")))
    return found.select("sym_id", "path", "name", "kind", "line", "end_line", "scope", "signature", "token_cost")


@query()
def symbol_references(spark: SparkSession, d: str) -> DataFrame:
    return symbols.references(symbols.readable(_sources(spark, d), "key")).groupBy("path", "from_symbol", "to_name").agg(F.count("*").alias("n"), F.min("line").alias("first_line"))


@query()
def source_chunks(spark: SparkSession, d: str) -> DataFrame:
    return symbols.code_chunks(symbols.readable(_sources(spark, d), "key")).select("file_path", "start_line", "end_line", "entity_name", "entity_type", "language", "content_hash", "context_header")


@query()
def repo_map(spark: SparkSession, d: str) -> DataFrame:
    ready = symbols.readable(_sources(spark, d), "key")
    repo = F.substring_index("path", ":", 1)
    found = checkpointed(symbols.identified(symbols.symbols(ready)).drop("content").withColumn("repo", repo))
    edges = symbols.name_edges(found, symbols.references(ready).withColumn("repo", repo), "repo")
    ranked = symbols.focused(found.join(symbols.pagerank(found, edges), "sym_id"), [])
    picked = symbols.fit_budget(ranked.withColumn("order_rank", F.round("order_rank", 15)), 1024, ["repo"])
    return picked.select("repo", "path", "name", "kind", "line", "signature", F.round("rank", 12).alias("rank"), "used_tokens")


@query("""SELECT coalesce(CASE regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1) WHEN 'py' THEN 'python' WHEN 'rs' THEN 'rust' WHEN 'go' THEN 'go' WHEN 'js' THEN 'javascript' WHEN 'ts' THEN 'typescript' WHEN 'java' THEN 'java' WHEN 'c' THEN 'c' WHEN 'rb' THEN 'ruby' ELSE 'unknown' END) AS language,
count(*) AS files, sum(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END END)::BIGINT AS lines
FROM (SELECT DISTINCT file_id, path, content FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL) GROUP BY 1""")
def language_stats(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "source_files").where("path is not null and content is not null").select("file_id", "path", "content").distinct()
    return files.select(text.language(text.extension("path")).alias("language"), text.line_count("content").cast("bigint").alias("n")).groupBy("language").agg(F.count("*").alias("files"), F.sum("n").alias("lines"))


@query("WITH d AS (SELECT DISTINCT path FROM source_files WHERE path IS NOT NULL) SELECT path, split_part(path, '/', -1) AS name, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir, regexp_extract(split_part(path, '/', -1), '^.+\\.([^.]*)$', 1) AS ext, regexp_replace(split_part(path, '/', -1), '^(.+)\\.[^.]*$', '\\1') AS stem FROM d")
def path_parts(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "source_files").where("path is not null").select("path").distinct().select("path", text.basename("path").alias("name"), text.parent_dir("path").alias("dir"), text.extension("path").alias("ext"), text.stem("path").alias("stem"))


_TRADE = """
e0 AS (SELECT c_nationkey AS a, s_nationkey AS b FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
e AS (SELECT a, b, count(*) AS m FROM e0 GROUP BY ALL), w AS (SELECT a, b, m / sum(m) OVER (PARTITION BY a) AS w FROM e), nn AS (SELECT count(*) AS n FROM nation),
k0 AS (SELECT n_nationkey AS id, 1.0::DOUBLE / n AS r FROM nation, nn)
"""
_ROUNDS = ",".join(
    f"k{i} AS (SELECT n_nationkey AS id, 0.15::DOUBLE / n + coalesce(g, 0) AS r FROM nation LEFT JOIN (SELECT b, sum(0.85::DOUBLE * r * w) AS g FROM w JOIN k{i - 1} ON a = id GROUP BY b) ON b = n_nationkey, nn)" for i in range(1, 21)
)


@query(f"WITH {_TRADE}, {_ROUNDS} SELECT id::BIGINT AS sym_id, round(r, 6) AS rank FROM k20")
def pagerank_trade(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "lineitem").select("l_orderkey", "l_suppkey").join(t(spark, d, "orders").select("o_orderkey", "o_custkey"), F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(t(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("o_custkey") == F.col("c_custkey")).join(t(spark, d, "supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    edges = rows.where("c_nationkey <> s_nationkey").groupBy(F.col("c_nationkey").cast("bigint").alias("from_id"), F.col("s_nationkey").cast("bigint").alias("to_id")).agg(F.count("*").alias("m"))
    nodes = t(spark, d, "nation").select(F.col("n_nationkey").cast("bigint").alias("sym_id"))
    return symbols.pagerank(nodes, edges).select("sym_id", *r6("rank"))


@query("""WITH s AS (SELECT p_partkey AS sym_id, greatest(strlen(p_name) // 4, 1) AS cost, p_retailprice * CASE WHEN p_brand IN ('Brand#11', 'Brand#12') THEN 2.0 ELSE 1.0 END AS order_rank FROM part),
o AS (SELECT *, sum(cost) OVER (ORDER BY order_rank DESC, sym_id ROWS UNBOUNDED PRECEDING) AS used FROM s) SELECT sym_id, round(order_rank, 6) AS order_rank, used::BIGINT AS used_tokens FROM o WHERE used <= 2000""")
def budget_prefix(spark: SparkSession, d: str) -> DataFrame:
    rows = t(spark, d, "part").select(F.col("p_partkey").alias("sym_id"), text.token_estimate("p_name").alias("token_cost"), F.col("p_retailprice").alias("rank"), F.col("p_brand").alias("path"))
    picked = symbols.fit_budget(symbols.focused(rows, ["Brand#11", "Brand#12"]), 2000)
    return picked.select("sym_id", *r6("order_rank"), "used_tokens")


# ------------------------------------------------------------------ findings

_CM = """
cm AS (SELECT ord, any_value(file_path) AS file_path, any_value(line) AS line, any_value(severity) AS severity, any_value(message) AS message, any_value(confidence) AS confidence,
       any_value(suggestion) AS suggestion, any_value(patch) AS patch, any_value(rule) AS rule FROM comments WHERE ord IS NOT NULL GROUP BY ord),
dd AS (SELECT min(ord) AS ord, file_path, line, arg_min(coalesce(severity, '~'), ord) AS severity0, message, max(confidence) AS confidence, count(*) AS n_same FROM cm GROUP BY file_path, line, message),
dx AS (SELECT *, nullif(severity0, '~') AS severity FROM dd)
"""
_RULES = [(0, "stable", "warning", "keep it"), (1, "cache", "bug", "invalidate"), (2, "schema", "info", "migrate")]


def _comments(spark: SparkSession, d: str) -> DataFrame:
    return findings.clean_comments(t(spark, d, "comments"))


def _rules(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(_RULES, "ord bigint, name string, severity string, description string")


@query(f"WITH {_CM} SELECT ord, file_path, line, severity, message, confidence, n_same FROM dx")
def finding_dedup(spark: SparkSession, d: str) -> DataFrame:
    return findings.deduplicated(_comments(spark, d)).select("ord", "file_path", "line", "severity", "message", "confidence", "n_same")


_JUDGED = f"""{_CM},
rk AS (SELECT *, CASE lower(severity) WHEN 'bug' THEN 0 WHEN 'warning' THEN 1 WHEN 'suggestion' THEN 2 WHEN 'info' THEN 3 END AS rank,
  CASE WHEN coalesce(confidence, 0) < 70 THEN 'below confidence threshold' WHEN NOT coalesce(severity IN ('bug', 'warning'), false) THEN coalesce(severity, 'unknown') || '-level excluded' END AS reason0 FROM dx),
pl AS (SELECT ord, row_number() OVER (PARTITION BY file_path ORDER BY rank, ord) AS place FROM rk WHERE reason0 IS NULL),
jd AS (SELECT rk.*, CASE WHEN place <= 3 THEN place END AS place, CASE WHEN reason0 IS NULL AND (place IS NULL OR place > 3) THEN 'exceeded max comment limit' ELSE reason0 END AS reason FROM rk LEFT JOIN pl USING (ord))
"""


def _judged(spark: SparkSession, d: str) -> DataFrame:
    return findings.filtered(findings.deduplicated(_comments(spark, d)), 70.0, limit=3, by="file_path")


@query(f"WITH {_JUDGED} SELECT ord, reason, place::INT AS place FROM jd")
def finding_filter(spark: SparkSession, d: str) -> DataFrame:
    return _judged(spark, d).select("ord", "reason", "place")


@query(f"WITH {_JUDGED} SELECT (SELECT count(*) FROM cm) AS comments_generated, count(*) FILTER (WHERE reason IS NOT NULL) AS comments_filtered, count(*) FILTER (WHERE reason IS NULL) AS comments_kept, sum(n_same - 1)::BIGINT AS comments_deduplicated FROM jd")
def finding_funnel(spark: SparkSession, d: str) -> DataFrame:
    return findings.funnel(_judged(spark, d), _comments(spark, d))


@query(f"WITH {_CM} SELECT ord, CASE WHEN contains(message, 'stable') THEN 'stable' WHEN contains(message, 'cache') THEN 'cache' WHEN contains(message, 'schema') THEN 'schema' ELSE rule END AS rule FROM cm")
def rule_tagging(spark: SparkSession, d: str) -> DataFrame:
    return findings.tagged(_comments(spark, d), _rules(spark)).select("ord", "rule")


@query(f"""WITH {_CM}, n AS (SELECT *, row_number() OVER (ORDER BY ord) - 1 AS idx FROM dx), ev AS (SELECT event_id AS idx, (event_id * 7) % 11 AS score, CASE WHEN event_type = 'click' THEN 'info' END AS rev FROM events)
SELECT ord, idx, coalesce(rev, severity) AS severity FROM n LEFT JOIN ev USING (idx) WHERE score IS NULL OR score >= 7""")
def reflect_join(spark: SparkSession, d: str) -> DataFrame:
    rows = findings.renumbered(findings.deduplicated(_comments(spark, d)))
    score = t(spark, d, "events").select(F.col("event_id").alias("idx"), F.lit(0).alias("pos"), ((F.col("event_id") * 7) % 11).alias("score"), F.when(F.col("event_type") == "click", "info").alias("revised_severity"))
    return findings.reflected(rows, score).select("ord", F.col("idx").cast("bigint").alias("idx"), "severity")


@query(f"WITH {_CM} SELECT file_path, lower(severity) AS severity, count(*) AS n FROM cm GROUP BY ALL")
def severity_counts(spark: SparkSession, d: str) -> DataFrame:
    return findings.severity_counts(_comments(spark, d), "file_path")


@query(f"WITH {_CM} SELECT file_path, coalesce(bool_or(lower(severity) IN ('bug', 'warning')), false) AS failed FROM cm GROUP BY 1")
def fail_on_warning(spark: SparkSession, d: str) -> DataFrame:
    return _comments(spark, d).groupBy("file_path").agg(F.coalesce(F.bool_or(scores.meets_threshold("severity", "warning")), F.lit(False)).alias("failed"))


@query(f"""WITH {_CM}, m AS (SELECT ord, file_path, line, severity, message, confidence FROM cm WHERE file_path IS NOT NULL AND severity IS NOT NULL AND message IS NOT NULL AND line > 0)
SELECT ord AS resp_id, file_path, line, lower(severity) AS severity, message, least(greatest(coalesce(confidence, 50.0), 0.0), 100.0) AS confidence FROM m WHERE lower(severity) IN ('bug', 'warning', 'suggestion', 'info')""")
def comment_json(spark: SparkSession, d: str) -> DataFrame:
    entry = F.struct(F.col("file_path").alias("file"), "line", "severity", "message", F.when(~F.isnan("confidence"), F.col("confidence")).alias("confidence"), "suggestion", "patch")
    text_of = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(entry).alias("comments"))), F.lit("\n```"))
    return findings.parsed_comments(_comments(spark, d).select(F.col("ord").alias("resp_id"), text_of.alias("response"))).select("resp_id", "file_path", "line", "severity", "message", "confidence")


@query("""SELECT event_id AS resp_id, user_id AS idx, least(cast(floor(value) AS BIGINT), 10)::SMALLINT AS score FROM events WHERE floor(value) BETWEEN 0 AND 255 AND user_id >= 0""")
def evaluation_json(spark: SparkSession, d: str) -> DataFrame:
    body = F.to_json(F.struct(F.array(F.struct(F.col("user_id").alias("index"), F.floor("value").alias("score"), F.lit("x").alias("reason"))).alias("evaluations")))
    return findings.parsed_evaluations(t(spark, d, "events").select(F.col("event_id").alias("resp_id"), body.alias("response"))).select("resp_id", "idx", "score")


@query(f"""WITH {_CM}, m AS (SELECT coalesce(file_path, '') AS conv_id, ord AS turn, coalesce(severity, 'none') AS role, coalesce(message, '') AS content FROM cm),
g AS (SELECT *, CASE WHEN lag(role) OVER w IS DISTINCT FROM role THEN 1 ELSE 0 END AS new FROM m WINDOW w AS (PARTITION BY conv_id ORDER BY turn)), r AS (SELECT *, sum(new) OVER (PARTITION BY conv_id ORDER BY turn) AS run FROM g)
SELECT conv_id, min(turn) AS turn, role, string_agg(content, chr(10) || chr(10) ORDER BY turn) AS content FROM r GROUP BY conv_id, run, role""")
def merge_messages(spark: SparkSession, d: str) -> DataFrame:
    rows = _comments(spark, d).select(F.coalesce("file_path", F.lit("")).alias("conv_id"), F.col("ord").alias("turn"), F.coalesce("severity", F.lit("none")).alias("role"), F.coalesce("message", F.lit("")).alias("content"))
    return findings.merged_messages(rows)


@query(f"""WITH {_CM} SELECT ord, sha256(encode(file_path) || unhex(substr(hex8, 7, 2) || substr(hex8, 5, 2) || substr(hex8, 3, 2) || substr(hex8, 1, 2)) || encode(message)) AS comment_id
FROM (SELECT *, lpad(printf('%X', line), 8, '0') AS hex8 FROM cm WHERE file_path IS NOT NULL AND line IS NOT NULL AND message IS NOT NULL)""")
def comment_hash(spark: SparkSession, d: str) -> DataFrame:
    rows = _comments(spark, d).where("file_path is not null and line is not null and message is not null")
    return rows.select("ord", text.comment_hash(F.col("file_path"), F.col("line"), F.col("message")).alias("comment_id"))


@query(f"""WITH {_CM}, f AS (SELECT path, max(CASE WHEN content = '' THEN 0 ELSE len(string_split(content, chr(10))) - CASE WHEN content LIKE '%' || chr(10) THEN 1 ELSE 0 END END) AS n FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY 1)
SELECT ord, file_path AS path, line, CASE WHEN n IS NULL OR line IS NULL OR line < 1 OR line > n THEN 'skipped' ELSE 'applied' END AS status,
CASE WHEN n IS NULL THEN 'file not found' WHEN line IS NULL OR line < 1 OR line > n THEN 'line out of range' END AS reason FROM cm LEFT JOIN f ON path = file_path WHERE patch IS NOT NULL""")
def patch_log(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "source_files").where("path is not null and content is not null").select("path", "content").withColumn("n", text.line_count("content")).groupBy("path").agg(F.max_by("content", "n").alias("content"))
    return findings.patch_log(files, _comments(spark, d))


_LN = "CASE WHEN {0} LIKE '%' || chr(10) OR {0} = '' THEN string_split({0}, chr(10))[:-2] ELSE string_split({0}, chr(10)) END"
_LN = f"list_transform({_LN}, lambda x: regexp_replace(x, '\r$', ''))"


@query(f"""WITH {_CM}, f AS (SELECT path, min(content) AS content FROM source_files WHERE path IS NOT NULL AND content IS NOT NULL GROUP BY 1),
p AS (SELECT file_path AS path, line, list({_LN.format('patch')} ORDER BY ord) AS ps, count(*) AS n FROM cm WHERE patch IS NOT NULL AND file_path IS NOT NULL AND line IS NOT NULL GROUP BY 1, 2),
l AS (SELECT path, content, {_LN.format('content')} AS ln FROM f WHERE path IN (SELECT path FROM p)), e AS (SELECT path, ln, unnest(range(1, len(ln) + 1)) AS line FROM l),
o AS (SELECT path, line, CASE WHEN ps IS NULL THEN [ln[line]] ELSE list_reduce(list_prepend([ln[line]], ps), lambda a, q: q || a[2:]) END AS made, coalesce(n, 0) AS n FROM e LEFT JOIN p USING (path, line)),
g AS (SELECT path, array_to_string(flatten(list(made ORDER BY line)), chr(10)) AS body, sum(n)::INT AS n FROM o GROUP BY 1)
SELECT l.path, coalesce(body, '') || CASE WHEN content LIKE '%' || chr(10) THEN chr(10) ELSE '' END AS content, coalesce(n, 0)::INT AS n_applied FROM l LEFT JOIN g USING (path)""")
def patch_apply(spark: SparkSession, d: str) -> DataFrame:
    files = t(spark, d, "source_files").where("path is not null and content is not null").groupBy("path").agg(F.min("content").alias("content"))
    return findings.applied_patches(files, _comments(spark, d))


@query(f"""WITH {_CM} SELECT ord, 'sievewright/' || severity AS rule_id, CASE severity WHEN 'bug' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, message, file_path AS uri, line AS start_line, patch IS NOT NULL AS has_fix FROM cm WHERE severity IN ('bug', 'warning', 'suggestion', 'info')""")
def sarif_results(spark: SparkSession, d: str) -> DataFrame:
    rows = sinks.sarif_results(_comments(spark, d).where(F.col("severity").isin(*scores.SEVERITIES)))
    place = F.col("result.locations")[0]["physicalLocation"]
    return rows.select("ord", "result.ruleId", "result.level", F.col("result.message.text").alias("message"), place["artifactLocation"]["uri"].alias("uri"), place["region"]["startLine"].alias("start_line"), F.col("result.fixes").isNotNull().alias("has_fix")).withColumnRenamed("ruleId", "rule_id")


@query(f"""WITH {_CM} SELECT 'sievewright/' || severity AS id, CASE severity WHEN 'bug' THEN 'Bug' WHEN 'warning' THEN 'Warning' WHEN 'suggestion' THEN 'Suggestion' ELSE 'Info' END AS name,
CASE severity WHEN 'bug' THEN 'error' WHEN 'warning' THEN 'warning' ELSE 'note' END AS level, min(ord) AS first_ord FROM cm WHERE severity IN ('bug', 'warning', 'suggestion', 'info') GROUP BY severity""")
def sarif_rules(spark: SparkSession, d: str) -> DataFrame:
    return sinks.sarif_rules(_comments(spark, d).where(F.col("severity").isin(*scores.SEVERITIES)))


@query(f"""WITH {_CM} SELECT ord, '## ' || CASE severity WHEN 'bug' THEN '🐛 Bug' WHEN 'warning' THEN '⚠️ Warning' WHEN 'suggestion' THEN '💡 Suggestion' ELSE 'ℹ️ Info' END || ' — `' || file_path || ':' || line || '` ('
|| CASE WHEN isnan(confidence) THEN 'NaN' ELSE round(coalesce(confidence, 50)::DECIMAL(18,6), 0)::BIGINT::VARCHAR END || '%' || CASE WHEN rule IS NULL THEN '' ELSE ', rule: ' || rule END || ')' || chr(10) || chr(10) || message || chr(10) || chr(10)
|| CASE WHEN suggestion IS NULL THEN '' ELSE '> **Suggestion:** ' || suggestion || chr(10) || chr(10) END || CASE WHEN patch IS NULL THEN '' ELSE '```' || chr(10) || patch || chr(10) || '```' || chr(10) || chr(10) END AS block
FROM cm WHERE severity IN ('bug', 'warning', 'suggestion', 'info') AND file_path IS NOT NULL AND line IS NOT NULL AND message IS NOT NULL""")
def review_text(spark: SparkSession, d: str) -> DataFrame:
    rows = _comments(spark, d).where(F.col("severity").isin(*scores.SEVERITIES) & F.col("file_path").isNotNull() & F.col("line").isNotNull() & F.col("message").isNotNull())
    return sinks.comment_text(rows, "markdown")


# ------------------------------------------------------------------ text functions and state

_SEC = "(starts_with(x, 'sk-') AND len(x) >= 12) OR (len(x) >= 24 AND regexp_matches(x, '[A-Za-z]') AND regexp_matches(x, '[0-9]')) OR (len(x) >= 24 AND len(string_split(x, '.')) >= 3 AND len(list_filter(string_split(x, '.'), lambda s: len(s) < 8)) = 0)"


@query(f"""SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '[A-Za-z0-9_.-]+|(?s:[^A-Za-z0-9_.-])+'), lambda x: CASE WHEN regexp_matches(x, '^[A-Za-z0-9_.-]') AND ({_SEC}) THEN '[REDACTED_TOKEN]' ELSE x END), '') AS clean FROM documents WHERE text IS NOT NULL""")
def redact_tokens(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("text is not null").select("doc_id", text.redact("text").alias("clean"))


_STRIP = "regexp_replace({0}, '^[ \\t\\r\\n\\f]+|[ \\t\\r\\n\\f]+$', '', 'g')"


@query(f"""WITH j AS (SELECT doc_id, text, TRY_CAST(text AS JSON) AS v FROM documents WHERE text IS NOT NULL), f AS (SELECT doc_id, nullif({_STRIP.format("v ->> '$.message'")}, '') AS m, nullif({_STRIP.format("v ->> '$.detail'")}, '') AS e,
list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP.format('x')}), lambda x: x <> '')[1] AS l FROM j) SELECT doc_id, coalesce(m, e, l) AS reason FROM f""")
def error_reasons(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("text is not null").select("doc_id", text.error_reason("text").alias("reason"))


@query("""SELECT chunk_id, trim(regexp_replace(CASE WHEN contains(content, '{') THEN split_part(content, '{', 1) WHEN contains(content, ':') THEN split_part(content, ':', 1) ELSE content END, '\\s+', ' ', 'g'), ' ') AS signature, strlen(content) // 4 AS tokens
FROM (SELECT chunk_id, any_value(content) AS content FROM chunks WHERE chunk_id IS NOT NULL GROUP BY 1) WHERE content IS NOT NULL""")
def chunk_signatures(spark: SparkSession, d: str) -> DataFrame:
    return _chunks(spark, d).where("content is not null").select("chunk_id", text.signature("content").alias("signature"), text.token_estimate("content").alias("tokens"))


@query("SELECT doc_id, CASE WHEN length(text) > 320 THEN left(text, 319) || '…' ELSE text END AS short, CASE WHEN length(text) > 200 THEN left(text, 200) || '...' ELSE text END AS example FROM documents WHERE text IS NOT NULL")
def text_limits(spark: SparkSession, d: str) -> DataFrame:
    return t(spark, d, "documents").where("text is not null").select("doc_id", text.ellipsis("text").alias("short"), text.example("text").alias("example"))


@query("WITH r AS (SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY ALL) SELECT r.user_id, r.event_type, r.event_id, value FROM r JOIN events USING (event_id)")
def keyed_upsert(spark: SparkSession, d: str) -> DataFrame:
    return state.latest(t(spark, d, "events").select("user_id", "event_type", "event_id", "value"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id", "value")


@query("SELECT event_type, count(*) FILTER (WHERE r > 0) AS positive, count(*) FILTER (WHERE r < 0) AS negative FROM (SELECT event_type, CASE WHEN value > 60 THEN 1 WHEN value < 20 THEN -1 ELSE 0 END AS r FROM events) GROUP BY 1")
def feedback_counts(spark: SparkSession, d: str) -> DataFrame:
    rated = t(spark, d, "events").withColumn("rating", state.rating(F.when(F.col("value") > 60, "useful").when(F.col("value") < 20, "not_useful").otherwise("skip")))
    return state.feedback_counts(rated, "event_type")


@query("SELECT event_id AS seq, user_id FROM events WHERE value < 20 ORDER BY event_id DESC LIMIT 5")
def newest_negative(spark: SparkSession, d: str) -> DataFrame:
    rated = t(spark, d, "events").select(F.col("event_id").alias("seq"), "user_id", F.when(F.col("value") < 20, -1).otherwise(1).alias("rating"))
    return state.newest_negative(rated).select("seq", "user_id")


@query("SELECT user_id::VARCHAR AS commit, count(*) AS iteration_count, max(ts) AS last_reviewed FROM events GROUP BY 1")
def event_iterations(spark: SparkSession, d: str) -> DataFrame:
    return state.iterations(t(spark, d, "events").select(F.col("user_id").cast("string").alias("commit"), F.col("ts").alias("timestamp")))


@query("SELECT file_path FROM chunks WHERE file_path IS NOT NULL AND file_path NOT IN (SELECT new_path FROM diff_files WHERE new_path IS NOT NULL) GROUP BY 1")
def stale_paths(spark: SparkSession, d: str) -> DataFrame:
    stored = t(spark, d, "chunks").where("file_path is not null").select("file_path").distinct()
    return state.without_paths(stored, t(spark, d, "diff_files").where("new_path is not null").select(F.col("new_path").alias("path")), "file_path")
