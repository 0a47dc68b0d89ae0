"""Problem 3: the most similar vectors of every vector, by a hash-prefix forest.

Each of ``trees`` trees gives every vector a long hash string: the signs of its products with
random directions. A tree is the sorted array of these strings, spread over tasks by ranges that are
nodes of the tree, so that no vector's node crosses a range. A
vector starts at the longest prefix it shares with others and ascends, one bit at a time for all
vectors together, until its node holds ``least`` vectors; it is compared with the whole node by
exact cosine. The best k of all trees are its neighbours.

Hot spots: contents with the very same vector are one point of the forest and are resolved
exactly afterwards (similarity 1, smallest ids first). A node that stays larger than ``most`` at
full hash length gets longer strings of its own.

Index, queries and sample: every vector is indexed and every vector is a query; the directions
need no fitting beyond the mean vector, which is an average over all rows. Recall against brute
force is measured in the tests.

Defined results: contents stand under their smallest id; null, empty, misshapen, all-zero and
non-finite vectors are not indexed; fewer than k others give fewer neighbours; equal similarities
are ordered by id; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, slices, usable_vector

NEAR = "point bigint, ids array<bigint>, sims array<double>"


def contents(chunks: DataFrame, width: int = 64) -> DataFrame:
    """(id, vec): each content with a usable vector under its smallest chunk_id."""
    return (
        chunks.where("content_hash is not null and chunk_id is not null")
        .select("content_hash", "chunk_id", F.when(usable_vector("embedding", width), F.col("embedding")).alias("vec"))
        .groupBy("content_hash").agg(F.min("chunk_id").alias("id"), F.min("vec").alias("vec"))
        .where("vec is not null").select("id", "vec")
    )


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(-1, width)


def _hash_rows(trees: int, bits: int, width: int, mean: np.ndarray, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng = np.random.default_rng(seed)
        planes = rng.standard_normal((width, trees * bits))
        place = (np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)).astype(np.uint64)
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column(1), width)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            signs = ((x - mean) @ planes > 0).reshape(len(x), trees, bits)
            codes = (signs * place).sum(axis=2, dtype=np.uint64).astype(np.int64)
            for t in range(trees):
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(np.full(len(x), t, np.int32)), pa.array(codes[:, t]), batch.column(1)],
                    ["point", "tree", "code", "vec"],
                )

    return run


#: Rows and columns of one block of similarities, so a task holds 32 MB of them at most.
ROWS, COLUMNS = 512, 8192


def _best(x: np.ndarray, rows: np.ndarray, lo: int, hi: int, k: int, ids: np.ndarray, out_i: np.ndarray, out_s: np.ndarray) -> None:
    """Exact cosines of ``rows`` against lo..hi, keeping the best k of each."""
    for at in range(0, len(rows), ROWS):
        r = rows[at:at + ROWS]
        top_i, top_s = out_i[r], out_s[r]
        for left in range(lo, hi, COLUMNS):
            right = min(left + COLUMNS, hi)
            s = x[r] @ x[left:right].T
            own = np.flatnonzero((r >= left) & (r < right))
            s[own, r[own] - left] = -np.inf
            kk = min(k, right - left)
            top = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
            got = np.take_along_axis(s, top, axis=1)
            both_i = np.concatenate([top_i, np.where(np.isfinite(got), ids[left + top], -1)], axis=1)
            both_s = np.concatenate([top_s, got], axis=1)
            order = np.argsort(-both_s, axis=1, kind="stable")[:, :k]
            top_i, top_s = np.take_along_axis(both_i, order, axis=1), np.take_along_axis(both_s, order, axis=1)
        out_i[r], out_s[r] = top_i, top_s


def _ascend(code: np.ndarray, bits: int, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For every position of a sorted hash array, the range of its deepest node of ``least`` members."""
    n = len(code)
    lo, hi = np.zeros(n, np.int64), np.full(n, n, np.int64)
    open_ = np.ones(n, bool)
    for depth in range(bits, 0, -1):
        p = code >> np.uint64(bits - depth)
        starts = np.flatnonzero(np.r_[True, p[1:] != p[:-1]])
        ends = np.r_[starts[1:], n]
        group = np.repeat(np.arange(len(starts)), ends - starts)
        take = open_ & ((ends - starts)[group] >= least)
        lo[take], hi[take] = starts[group][take], ends[group][take]
        open_ &= ~take
        if not open_.any():
            break
    return lo, hi


def _node(x: np.ndarray, ids: np.ndarray, code: np.ndarray, bits: int, k: int, least: int, most: int, depth: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The best k of every row of a sorted stretch of a tree, each from its own node.

    A node is compared whole. One that many rows share although it is larger than ``most`` (their
    hash strings are equal to the end) gets longer strings: signs around its own mean, again sorted
    and ascended. Rows that no direction tells apart are compared whole, block by block.
    """
    n = len(x)
    out_i, out_s = np.full((n, k), -1, np.int64), np.full((n, k), -np.inf)
    lo, hi = _ascend(code, bits, least)
    key = lo * (n + 1) + hi
    order = np.argsort(key, kind="stable")
    cuts = np.flatnonzero(np.r_[True, np.diff(key[order]) != 0])
    for a, b in zip(cuts, np.r_[cuts[1:], n]):
        rows = np.sort(order[a:b])
        left, right = int(lo[rows[0]]), int(hi[rows[0]])
        if right - left <= most or len(rows) <= 4 * least:
            _best(x, rows, left, right, k, ids, out_i, out_s)
        elif depth < 3:
            part = x[left:right]
            planes = np.random.default_rng(1000 + depth).standard_normal((x.shape[1], bits))
            place = np.uint64(1) << np.arange(bits - 1, -1, -1, dtype=np.uint64)
            longer = ((part - part.mean(axis=0)) @ planes > 0) @ place
            again = np.argsort(longer, kind="stable")
            got_i, got_s = _node(part[again], ids[left:right][again], longer[again], bits, k, least, most, depth + 1)
            back = np.argsort(again)[rows - left]
            out_i[rows], out_s[rows] = got_i[back], got_s[back]
        else:
            _best(x, rows, left, right, k, ids, out_i, out_s)
    return out_i, out_s


#: Bits of a hash string by which a tree is divided into ranges.
RANGE_BITS = 12


def _ranges(counts: dict[tuple[int, int], int], trees: int, least: int, size: float) -> dict[tuple[int, int], int]:
    """The range of every (tree, first RANGE_BITS of the code), given how many vectors each holds.

    A range is a node of the tree. Nodes over ``size`` are divided, but only where both halves hold
    ``least``: so the deepest node of ``least`` members of any vector lies within its range, and ranges change nothing.
    """
    out: dict[tuple[int, int], int] = {}
    number = 0
    for tree in range(trees):
        sums = np.zeros(1 << RANGE_BITS, np.int64)
        for (t, p), c in counts.items():
            if t == tree:
                sums[p] = c
        total = np.r_[0, np.cumsum(sums)]
        nodes = [(0, 1 << RANGE_BITS)]
        while nodes:
            lo, hi = nodes.pop()
            mid = (lo + hi) // 2
            left, right = total[mid] - total[lo], total[hi] - total[mid]
            # an empty half leaves the node as it is
            if hi - lo > 1 and (not left or not right or left + right > size and min(left, right) >= least):
                nodes += [(a, b) for a, b, n in ((mid, hi, right), (lo, mid, left)) if n]
                continue
            for p in range(lo, hi):
                if sums[p]:
                    out[tree, p] = number
            number += 1
    return out


def _search(bits: int, width: int, k: int, least: int, most: int):
    def one(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(parts).combine_chunks()
        ids = t.column("point").to_numpy()
        code = t.column("code").to_numpy().astype(np.uint64)
        x = _matrix(t.column("vec").combine_chunks(), width)
        x /= np.linalg.norm(x, axis=1, keepdims=True)
        at = np.argsort(code, kind="stable")
        out_i, out_s = _node(x[at], ids[at], code[at], bits, k, least, most)
        good = out_i >= 0
        sizes = np.r_[0, np.cumsum(good.sum(axis=1))].astype(np.int32)
        return pa.RecordBatch.from_arrays(
            [pa.array(ids[at]), pa.ListArray.from_arrays(sizes, pa.array(out_i[good])), pa.ListArray.from_arrays(sizes, pa.array(out_s[good]))],
            ["point", "ids", "sims"],
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows come sorted by range; one range at a time is held
        held: list[pa.RecordBatch] = []
        now = None
        for b in batches:
            part = b.column(b.schema.get_field_index("part")).to_numpy()
            edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), len(part)] if len(part) else []
            for lo, hi in zip(edges, edges[1:]):
                if held and part[lo] != now:
                    yield one(held)
                    held = []
                now = part[lo]
                held.append(b.slice(lo, hi - lo))
        if held:
            yield one(held)

    return run


#: Vectors that a range holds at most, where it can be divided: 50 MB of them in a task.
RANGE_ROWS = 100_000


def neighbours(vectors: DataFrame, k: int = 5, width: int = 64, trees: int = 12, bits: int = 48, least: int | None = None, most: int = 4096, seed: int = 17) -> DataFrame:
    """(id, other, sim, place): the k most similar others of every row of ``vectors`` (id, vec).

    ``least`` is how many vectors a node has to hold before it is compared; by default twice the
    square root of their number, at least 256, so that recall holds as the collection grows.
    """
    points = cut(
        vectors.groupBy("vec").agg(F.min("id").alias("point"), F.count("*").alias("copies"))
        .select("point", "vec", "copies")
    )
    same = vectors.join(points.where("copies > 1").select("vec", "point"), "vec").select("id", "point")
    mean_of = points.agg(*[F.avg(F.get("vec", F.lit(i))).alias(f"m{i}") for i in range(width)], F.count("*").alias("n")).first()
    if not mean_of["n"]:
        return vectors.sparkSession.createDataFrame([], "id bigint, other bigint, sim double, place int")
    norm = points.agg(F.avg(F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))))).first()[0]
    mean = np.array(mean_of[:width], dtype=np.float64) / norm
    least = least or max(256, int(2 * mean_of["n"] ** 0.5))
    hashed = points.select("point", "vec").mapInArrow(
        _hash_rows(trees, bits, width, mean, seed), "point bigint, tree int, code bigint, vec array<float>"
    )
    prefix = F.shiftright("code", max(0, bits - RANGE_BITS)).cast("int").alias("prefix")
    counts = {(r["tree"], r["prefix"]): r["count"] for r in hashed.select("tree", prefix).groupBy("tree", "prefix").count().collect()}
    ranges = _ranges(counts, trees, least, max(8 * least, min(RANGE_ROWS, trees * mean_of["n"] / slices(hashed, trees))))
    parts = hashed.sparkSession.createDataFrame([(t, p, r) for (t, p), r in ranges.items()], "tree int, prefix int, part int")
    laid = hashed.withColumn("prefix", prefix).join(F.broadcast(parts), ["tree", "prefix"]).select("point", "part", "code", "vec")
    laid = laid.repartitionByRange(min(slices(hashed, trees), max(ranges.values()) + 1), "part").sortWithinPartitions("part")
    found = laid.mapInArrow(_search(bits, width, k, least, most), NEAR)
    pairs = found.select("point", F.explode(F.arrays_zip("ids", "sims")).alias("p")).select("point", F.col("p.ids").alias("near"), F.col("p.sims").alias("sim"))
    # Per point at most trees * k rows, so the window has a bound.
    pairs = pairs.groupBy("point", "near").agg(F.max("sim").alias("sim"))
    best = W.partitionBy("point").orderBy(F.col("sim").desc(), "near")
    kept = pairs.withColumn("place", F.row_number().over(best)).where(F.col("place") <= k).drop("place")
    # Contents with equal vectors: each point stands for its k + 1 smallest contents, which is all a list of k can use.
    firsts = same.withColumn("nth", F.row_number().over(W.partitionBy("point").orderBy("id"))).where(F.col("nth") <= k + 1).drop("nth")
    near = kept.join(firsts.select(F.col("point").alias("near"), F.col("id").alias("o")), "near", "left").select("point", F.coalesce("o", "near").alias("other"), "sim")
    wide = same.select("point", "id")
    out = near.join(wide, "point", "left").select(F.coalesce("id", "point").alias("id"), "other", "sim")
    twins = wide.join(firsts.select("point", F.col("id").alias("other")), "point").where("id <> other").select("id", "other", F.lit(1.0).alias("sim"))
    rank = W.partitionBy("id").orderBy(F.col("sim").desc(), "other")
    return out.union(twins).withColumn("place", F.row_number().over(rank)).where(F.col("place") <= k)


def neighbour_pairs(near: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b: pairs of which one is among the other's best."""
    return near.select(F.least("id", "other").alias("chunk_a"), F.greatest("id", "other").alias("chunk_b")).distinct()
