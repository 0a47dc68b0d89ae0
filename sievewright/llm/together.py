"""Problem 7: items that appear together, by heavy-light decomposition.

A basket is a commit, an item a path of the commit's repo. Pair counts come from three parts whose
union is every pair that meets:

* heavy-heavy: the most frequent items of a repo own a row of a bit matrix over the baskets of a
  block; a pair's count in the block is the popcount of the conjunction of two rows;
* light-light: pairs of rare items are hash-counted per block;
* heavy-light: the posting list of a rare item probes the bit rows of the heavy items.

Blocks are partitions of baskets, so a hot item or repo is spread over all of them; each block
emits its counts already added up, and one sum by pair follows. Items in fewer than ``min_co``
baskets cannot be in a result and are dropped beforehand, which is exact.

Defined results: repeated rows count once; null and empty items and baskets without a group do
not count; baskets without items or with more than ``max_width`` distinct items are left out; a
basket delivered with several groups belongs to the smallest; empty tables give no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Partial counts kept in a task before they are handed on.
FLUSH_PAIRS = 200_000


def baskets_of(changes: DataFrame, commits: DataFrame, max_width: int = 25) -> DataFrame:
    """(repo, commit_id, path): distinct items of the baskets that count.

    Widths are counted before anything is gathered, so a very wide basket stays spread.
    """
    items = (
        changes.where("commit_id is not null and path is not null and path <> ''")
        .select("commit_id", "path").distinct()
    )
    narrow = items.groupBy("commit_id").count().where(F.col("count") <= max_width).select("commit_id")
    repos = (
        commits.where("commit_id is not null and repo is not null")
        .groupBy("commit_id").agg(F.min("repo").alias("repo"))
    )
    keep = narrow.join(repos, "commit_id")
    return items.join(keep, "commit_id").select("repo", "commit_id", "path")


def _pairs_in_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Partial pair counts of a partition of baskets (repo, items[path, heavy])."""
    schema = pa.schema([("repo", pa.string()), ("path_a", pa.string()), ("path_b", pa.string()), ("n", pa.int64())])
    counts: Counter = Counter()

    def flush() -> pa.RecordBatch:
        keys = list(counts)
        out = pa.RecordBatch.from_arrays(
            [pa.array([k[i] for k in keys], pa.string()) for i in range(3)] + [pa.array(list(counts.values()), pa.int64())],
            schema=schema,
        )
        counts.clear()
        return out

    for batch in batches:
        by_repo: dict[str, list] = {}
        for repo, items in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            by_repo.setdefault(repo, []).append(items)
        for repo, rows in by_repo.items():
            heavy = sorted({i["path"] for r in rows for i in r if i["heavy"]})
            place = {p: k for k, p in enumerate(heavy)}
            bits = np.zeros((len(heavy), len(rows)), dtype=bool)
            postings: dict[str, list[int]] = {}
            for b, items in enumerate(rows):
                light = []
                for i in items:
                    if i["heavy"]:
                        bits[place[i["path"]], b] = True
                    else:
                        light.append(i["path"])
                        postings.setdefault(i["path"], []).append(b)
                light.sort()
                for x in range(len(light)):
                    for y in range(x + 1, len(light)):
                        counts[repo, light[x], light[y]] += 1
            if heavy:
                packed = np.packbits(bits, axis=1)
                for k in range(len(heavy) - 1):
                    meet = np.bitwise_count(packed[k + 1:] & packed[k]).sum(axis=1)
                    for j in np.flatnonzero(meet):
                        counts[repo, heavy[k], heavy[k + 1 + int(j)]] += int(meet[j])
                for path, at in postings.items():
                    meet = bits[:, at].sum(axis=1)
                    for k in np.flatnonzero(meet):
                        h = heavy[k]
                        counts[(repo, h, path) if h.encode() < path.encode() else (repo, path, h)] += int(meet[k])
            if len(counts) >= FLUSH_PAIRS:
                yield flush()
    if counts:
        yield flush()


def item_counts(baskets: DataFrame) -> DataFrame:
    """(repo, path, c): in how many baskets an item is."""
    return baskets.groupBy("repo", "path").agg(F.count("*").alias("c"))


def pair_counts(baskets: DataFrame, counts: DataFrame, min_co: int = 5, heavy_per_repo: int = 256) -> DataFrame:
    """(repo, path_a, path_b, co) of every pair that meets in at least ``min_co`` baskets."""
    order = W.partitionBy("repo").orderBy(F.col("c").desc(), "path")
    top = (
        counts.where(F.col("c") >= min_co).withColumn("place", F.row_number().over(order))
        .where(F.col("place") <= heavy_per_repo).select("repo", "path", F.lit(True).alias("heavy"))
    )
    kept = counts.where(F.col("c") >= min_co).select("repo", "path").join(top, ["repo", "path"], "left")
    rows = (
        baskets.join(kept, ["repo", "path"])
        .groupBy("repo", "commit_id")
        .agg(F.collect_list(F.struct("path", F.coalesce("heavy", F.lit(False)).alias("heavy"))).alias("items"))
        .where(F.size("items") > 1)
        .select("repo", "items")
    )
    partial = rows.mapInArrow(_pairs_in_blocks, "repo string, path_a string, path_b string, n bigint")
    return partial.groupBy("repo", "path_a", "path_b").agg(F.sum("n").alias("co")).where(F.col("co") >= min_co)


def together(changes: DataFrame, commits: DataFrame, max_width: int = 25, min_co: int = 5, min_lift: float = 3.0) -> DataFrame:
    """(repo, path_a, path_b, co, c_a, c_b, n, lift), path_a < path_b by bytes.

    ``lift`` is co * n / (c_a * c_b): how much more often the two meet than by chance.
    """
    from .common import cut

    baskets = cut(baskets_of(changes, commits, max_width))
    counts = item_counts(baskets)
    n = baskets.select("repo", "commit_id").distinct().groupBy("repo").agg(F.count("*").alias("n"))
    pairs = pair_counts(baskets, counts, min_co)
    a = counts.select("repo", F.col("path").alias("path_a"), F.col("c").alias("c_a"))
    b = counts.select("repo", F.col("path").alias("path_b"), F.col("c").alias("c_b"))
    return (
        pairs.join(a, ["repo", "path_a"]).join(b, ["repo", "path_b"]).join(n, "repo")
        .where(F.col("co") * F.col("n") >= F.lit(min_lift) * F.col("c_a") * F.col("c_b"))
        .select("repo", "path_a", "path_b", "co", "c_a", "c_b", "n", (F.col("co") * F.col("n") / (F.col("c_a") * F.col("c_b"))).alias("lift"))
    )
