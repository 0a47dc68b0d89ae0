"""The queries of the training-data problems; every one runs over its whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import ship
from . import credentials, handwritten, mixing, near_records, ranking, residue, syntax, together, tokenizer, vectors
from .common import small_batches, table


def _ready(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        small_batches(spark)
        return f(spark, sf_dir)

    return run


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return handwritten.found(table(spark, d, "source_files"), table(spark, d, "diff_files"), table(spark, d, "diff_hunks"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return near_records.group_pairs(near_records.near_groups(table(spark, d, "comments")))


def p2_groups(spark: SparkSession, d: str) -> DataFrame:
    return near_records.near_groups(table(spark, d, "comments"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return vectors.neighbour_pairs(vectors.neighbours(vectors.contents(table(spark, d, "chunks"))))


def p3_neighbours(spark: SparkSession, d: str) -> DataFrame:
    near = vectors.neighbours(vectors.contents(table(spark, d, "chunks")))
    return near.select("id", "other", F.round("sim", 6).alias("sim"), "place")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return credentials.found(table(spark, d, "source_files"), table(spark, d, "diff_hunks"))


def p4_redacted(spark: SparkSession, d: str) -> DataFrame:
    return credentials.redacted(table(spark, d, "source_files"), table(spark, d, "diff_hunks"))


def p4_index(spark: SparkSession, d: str) -> DataFrame:
    return credentials.candidate_chunks(table(spark, d, "source_files"), table(spark, d, "diff_hunks"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    points = ranking.borda(table(spark, d, "hits"), table(spark, d, "chunks"))
    return ranking.top_wanted(points, table(spark, d, "search_queries")).select("query_id", "chunk_id")


def p5_ranking(spark: SparkSession, d: str) -> DataFrame:
    points = ranking.borda(table(spark, d, "hits"), table(spark, d, "chunks"))
    return points.select("query_id", "chunk_id", F.round("points", 6).alias("points"), "n_lists")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return syntax.checked_files(table(spark, d, "source_files")).where("fault is not null").select("file_id")


def p6_rates(spark: SparkSession, d: str) -> DataFrame:
    return syntax.rates(syntax.checked_files(table(spark, d, "source_files")))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return together.together(table(spark, d, "file_changes"), table(spark, d, "commits")).select("repo", "path_a", "path_b")


def p7_pairs(spark: SparkSession, d: str) -> DataFrame:
    pairs = together.together(table(spark, d, "file_changes"), table(spark, d, "commits"))
    return pairs.withColumn("lift", F.round("lift", 6))


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encoded(table(spark, d, "documents"))


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents"))


def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    return residue.kept(table(spark, d, "documents")).select("doc_id", "repo", "source", "lang")


QUERIES = {
    f.__name__: f
    for f in (
        p1_found, p2_found, p2_groups, p3_found, p3_neighbours, p4_found, p4_redacted, p4_index, p5_found, p5_ranking, p6_found, p6_rates,
        p7_found, p7_pairs, p8_ids, p9_mixture, p9_shares, p10_found, p10_kept,
    )
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: _ready(f) for name, f in QUERIES.items()}


_VALID_HITS = """
v AS (SELECT query_id, source, chunk_id, max(score) AS score FROM hits
      WHERE query_id IS NOT NULL AND source IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)
        AND chunk_id IN (SELECT chunk_id FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY ALL),
r AS (SELECT *, rank() OVER (PARTITION BY query_id, source ORDER BY score DESC)
        + (count(*) OVER (PARTITION BY query_id, source, score) - 1) / 2.0 AS rk,
        count(*) OVER (PARTITION BY query_id, source) AS n FROM v),
b AS (SELECT query_id, chunk_id, sum((n + 1 - rk) / n) AS points, count(*) AS n_lists FROM r GROUP BY ALL)
"""

_PAIRS = """
i AS (SELECT DISTINCT commit_id, path FROM file_changes WHERE commit_id IS NOT NULL AND path IS NOT NULL AND path <> ''),
w AS (SELECT commit_id FROM i GROUP BY 1 HAVING count(*) <= 25),
c AS (SELECT commit_id, min(repo) AS repo FROM commits WHERE repo IS NOT NULL GROUP BY 1),
b AS (SELECT repo, commit_id, path FROM i JOIN w USING (commit_id) JOIN c USING (commit_id)),
n AS (SELECT repo, count(DISTINCT commit_id) AS n FROM b GROUP BY 1),
k AS (SELECT repo, path, count(*) AS c FROM b GROUP BY ALL),
p AS (SELECT x.repo, x.path AS path_a, y.path AS path_b, count(*) AS co FROM b x JOIN b y USING (repo, commit_id)
      WHERE x.path < y.path GROUP BY ALL HAVING count(*) >= 5),
o AS (SELECT p.repo, path_a, path_b, co, ka.c AS c_a, kb.c AS c_b, n.n, round(co * n.n / (ka.c * kb.c), 6) AS lift FROM p JOIN n USING (repo)
      JOIN k ka ON ka.repo = p.repo AND ka.path = path_a JOIN k kb ON kb.repo = p.repo AND kb.path = path_b WHERE co * n.n >= 3 * ka.c * kb.c)
"""

_WORDS = """
w AS (SELECT ord, any_value(split_part(file_path, '/', -1)) AS name, any_value(line) AS line,
             list_distinct(regexp_extract_all(any_value(lower(message)), '[a-z0-9_]+')) AS words
      FROM comments WHERE ord IS NOT NULL AND file_path IS NOT NULL AND line IS NOT NULL AND message IS NOT NULL GROUP BY ord),
u AS (SELECT * FROM w WHERE name <> '' AND len(words) > 0),
e AS (SELECT x.ord AS a, y.ord AS b FROM u x JOIN u y ON x.name = y.name AND abs(x.line - y.line) <= 15 AND x.ord <> y.ord
      WHERE 5 * len(list_intersect(x.words, y.words)) >= 3 * (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words)))),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a)
"""

_NEAR = """
h AS (SELECT content_hash, min(chunk_id) AS id,
        min(embedding) FILTER (WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0) AS vec
      FROM chunks WHERE content_hash IS NOT NULL AND chunk_id IS NOT NULL GROUP BY 1),
g AS (SELECT id, vec::DOUBLE[] AS vec FROM h WHERE vec IS NOT NULL),
s AS (SELECT x.id, y.id AS other, list_cosine_similarity(x.vec, y.vec) AS sim FROM g x JOIN g y ON x.id <> y.id),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY sim DESC, other) AS place FROM s QUALIFY place <= 5)
"""


_GROUPS = """
w AS (SELECT ord, any_value(split_part(file_path, '/', -1)) AS name, any_value(line) AS line, list_sort(list_distinct(regexp_extract_all(any_value(lower(message)), '[a-z0-9_]+'))) AS words
      FROM comments WHERE ord IS NOT NULL AND file_path IS NOT NULL AND line IS NOT NULL AND message IS NOT NULL GROUP BY ord),
u AS (SELECT * FROM w WHERE name <> '' AND len(words) > 0),
rp AS (SELECT name, line, words, min(ord) AS rep, count(*) AS n FROM u GROUP BY ALL),
e AS (SELECT x.rep AS a, y.rep AS b FROM rp x JOIN rp y ON x.name = y.name AND abs(x.line - y.line) <= 15 AND x.rep <> y.rep
      WHERE 5 * len(list_intersect(x.words, y.words)) >= 3 * (len(x.words) + len(y.words) - len(list_intersect(x.words, y.words)))),
reach(a, b) AS (SELECT a, b FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
g AS (SELECT a AS rep, least(a, min(b)) AS group_id FROM reach GROUP BY a), d AS (SELECT a AS rep, count(*) AS n_links FROM e GROUP BY a)
"""


def oracle_sql() -> dict[str, str]:
    """SQL for the problems it can state; the others are tested against brute force."""
    return {
        "p2_found": f"WITH RECURSIVE {_WORDS} SELECT a AS ord_a, b AS ord_b FROM reach WHERE a < b",
        "p2_groups": f"WITH RECURSIVE {_GROUPS} SELECT u.ord, coalesce(group_id, rp.rep) AS group_id, coalesce(n_links, 0) AS n_links FROM u JOIN rp USING (name, line, words) "
        "LEFT JOIN g ON g.rep = rp.rep LEFT JOIN d ON d.rep = rp.rep WHERE group_id IS NOT NULL OR n > 1",
        "p3_neighbours": f"WITH {_NEAR} SELECT id, other, round(sim, 6) AS sim, place::INT AS place FROM t",
        "p3_found": f"WITH {_NEAR} SELECT DISTINCT least(id, other) AS chunk_a, greatest(id, other) AS chunk_b FROM t",
        "p5_found": f"WITH {_VALID_HITS}, o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY points DESC, chunk_id) AS place FROM b) "
        "SELECT query_id, chunk_id FROM o JOIN (SELECT query_id, max(n_wanted) AS n_wanted FROM search_queries GROUP BY 1) USING (query_id) WHERE place <= n_wanted",
        "p5_ranking": f"WITH {_VALID_HITS} SELECT query_id, chunk_id, round(points, 6) AS points, n_lists FROM b",
        "p7_found": f"WITH {_PAIRS} SELECT repo, path_a, path_b FROM o",
        "p7_pairs": f"WITH {_PAIRS} SELECT repo, path_a, path_b, co, c_a, c_b, n, lift FROM o",
    }
