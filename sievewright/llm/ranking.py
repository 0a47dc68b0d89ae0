"""Problem 5: one ranking from several differently scaled scores, by Borda count.

Every source's list is turned into points that depend on standing alone, so no source rules by the
size of its numbers. A list of n distinct chunks gives ``(n + 1 - rank) / n`` to each, where the
rank counts competition-style from the best and ties share the average of the places they fill.
A source that does not list a chunk adds nothing to it. Points are summed by weight (1 each unless
given) and equal sums are ordered by chunk_id.

Ranks come from a distributed running count, not from one window over a list: a list may hold a
third of all rows. Distinct (query, source, score) values are range-partitioned, counted within
each partition, and offset by what the earlier partitions of the same list hold.

Defined results: rows delivered again count once; a null or NaN score, a null key, and a chunk_id
that is not in the chunk table do not count; infinite scores are numbers; several scores of one
chunk in one list count as the best of them; empty tables give no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices


def valid_hits(hits: DataFrame, chunks: DataFrame) -> DataFrame:
    """(query_id, source, chunk_id, score): one row per chunk and list, its best usable score."""
    known = chunks.select("chunk_id").where("chunk_id is not null").distinct()
    return (
        hits.where("query_id is not null and source is not null and score is not null and not isnan(score)")
        .join(known, "chunk_id", "left_semi")
        .groupBy("query_id", "source", "chunk_id")
        .agg(F.max("score").alias("score"))
    )


def average_ranks(valid: DataFrame) -> DataFrame:
    """(query_id, source, score, rank, n): the averaged competition rank of each score of a list."""
    keys = ["query_id", "source"]
    steps = valid.groupBy(*keys, "score").agg(F.count("*").alias("same"))
    laid = cut(
        steps.repartitionByRange(slices(steps), *keys, F.col("score").desc())
        .withColumn("part", F.spark_partition_id())
    )
    inside = W.partitionBy("part", *keys).orderBy(F.col("score").desc()).rowsBetween(W.unboundedPreceding, -1)
    # Few rows: one per partition and list that meet.
    parts = laid.groupBy("part", *keys).agg(F.sum("same").alias("held"))
    ahead = W.partitionBy(*keys).orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    offsets = parts.select(
        "part", *keys,
        F.coalesce(F.sum("held").over(ahead), F.lit(0)).alias("before"),
        F.sum("held").over(W.partitionBy(*keys)).alias("n"),
    )
    return (
        laid.withColumn("above", F.coalesce(F.sum("same").over(inside), F.lit(0)))
        .join(offsets, ["part", *keys])
        .select(*keys, "score", "n", (F.col("before") + F.col("above") + (F.col("same") + 1) / 2).alias("rank"))
    )


def borda(hits: DataFrame, chunks: DataFrame, weights: DataFrame | None = None, missing: str = "nothing") -> DataFrame:
    """(query_id, chunk_id, points, n_lists) over all lists; ``weights`` may give (source, weight).

    A list that lacks a chunk adds nothing to it, or with ``missing="mid"`` the points of the middle
    rank, (n + 1) / 2n of a list of n; lists of other queries add nothing either way.
    """
    if missing not in ("nothing", "mid"):
        raise ValueError(f"unknown way with missing scores: {missing}")
    valid = valid_hits(hits, chunks)
    ranks = average_ranks(valid)
    scored = valid.join(ranks, ["query_id", "source", "score"]).withColumn(
        "part_points", (F.col("n") + 1 - F.col("rank")) / F.col("n")
    )
    if weights is not None:
        scored = scored.join(weights.select("source", "weight"), "source", "left").withColumn(
            "part_points", F.col("part_points") * F.coalesce("weight", F.lit(1.0))
        )
    # whole nano-units: a sum of doubles would depend on the order of the rows
    unit = lambda c: F.round(c * 1e9).cast("long")
    if missing == "nothing":
        return scored.groupBy("query_id", "chunk_id").agg((F.sum(unit(F.col("part_points"))) / 1e9).alias("points"), F.count("*").alias("n_lists"))
    mid = (F.col("n") + 1) / 2 / F.col("n")
    if weights is not None:
        ranks = ranks.join(weights.select("source", "weight"), "source", "left")
        mid = mid * F.coalesce("weight", F.lit(1.0))
    # what all lists of a query would give in the middle, less what the lists give that have the chunk
    lists = ranks.select("query_id", "source", "n", mid.alias("mid")).distinct()
    whole = lists.groupBy("query_id").agg(F.sum(unit(F.col("mid"))).alias("all_mid"))
    got = scored.join(lists.select("query_id", "source", "mid"), ["query_id", "source"]).groupBy("query_id", "chunk_id").agg(
        F.sum(unit(F.col("part_points")) - unit(F.col("mid"))).alias("over"), F.count("*").alias("n_lists")
    )
    return got.join(whole, "query_id").select("query_id", "chunk_id", ((F.col("over") + F.col("all_mid")) / 1e9).alias("points"), "n_lists")


def top_wanted(points: DataFrame, wanted: DataFrame) -> DataFrame:
    """(query_id, chunk_id, points, place): each query's n_wanted best chunks.

    The literal bound on the place lets Spark cut every partition to it before the shuffle.
    """
    wanted = wanted.where("query_id is not null").groupBy("query_id").agg(F.max("n_wanted").alias("n_wanted"))
    most = wanted.agg(F.max("n_wanted")).first()[0] or 0
    order = W.partitionBy("query_id").orderBy(F.col("points").desc(), "chunk_id")
    placed = points.withColumn("place", F.row_number().over(order)).where(F.col("place") <= int(most))
    return placed.join(wanted, "query_id").where("place <= n_wanted").drop("n_wanted")
