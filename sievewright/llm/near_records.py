"""Problem 2: near-duplicate records with small edits, by a chosen-path set similarity join.

Records are sets of words that stand in a place: the last component of a path and a line. Two are
linked if the place's name is equal, the lines differ by at most ``window`` and the Jaccard
similarity of their word sets reaches ``least``. Linked records form groups, directly or through
others.

The join branches instead of comparing all pairs:

* Roots. A pair within ``window`` lines shares a band of two windows' width, so (name, band) roots
  lose no pair; each record is in two.
* Copies. Records equal in name, line and words are one representative, linked without comparing.
* Branching. A node of more than ``node_size`` records sends each record down the words that the
  node's hash chooses for it among those not yet on its path, ``branch / least`` words expected,
  independently in ``trees`` trees. A pair at the threshold shares a chosen word with probability
  about ``1 - exp(-1.25 * branch)`` at each level of a tree; the trees multiply the misses.
* Gathering. A node of at most ``gather`` records lies in one task, which branches it further by
  positions: its records are moved once, not once a tree and level. Larger nodes branch over tasks
  until theirs are small enough; only that copies records.
* Leaves. Small nodes are compared exhaustively and exactly. So are nodes that would not split: whose
  words are so common in them that one level of branching is expected to compare ``pays`` times as
  much as the node whole (many records that share nearly all words), and what is left after ``depth`` levels. Those
  of more than ``gather`` records are compared in squares of ``block`` by ``block`` records spread over tasks, so no
  node is cut short; its H records are shuffled H / ``block`` times.

Defined results: repeated rows of a key count once; a null or empty name, a null line or a text
without words links to nothing; empty tables give no rows. Similarities are compared in integers.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, slices
from .graph import components

LINK = "a bigint, b bigint"
TOLD = "level bigint, nodes bigint, held bigint, most bigint"


def words_of(text: str) -> Column:
    """The distinct words of a text, sorted: longest runs of a-z, 0-9 and _ after lower-casing."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9_]+"), F.lit(0))))


def places(comments: DataFrame) -> DataFrame:
    """(ord, name, line, words) of the records that can link; a repeated row is there again."""
    name = F.element_at(F.split("file_path", "/"), -1)
    return (
        comments.where("ord is not null and file_path is not null and line is not null and message is not null")
        .select("ord", name.alias("name"), "line", words_of("message").alias("words"))
        .where("name <> '' and size(words) > 0")
    )


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mix of unsigned numbers (splitmix64)."""
    x = x + np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, as many as counted."""
    return np.repeat(starts - np.cumsum(counts) + counts, counts) + np.arange(int(counts.sum()))


class _Gathered:
    """Whole nodes that lie in one task: (tree, node) in order, branched and compared by positions, so no record is copied."""

    def __init__(self, t: pa.Table, how: dict):
        self.how = how

        def column(name: str) -> pa.Array:
            c = t.column(name).combine_chunks()
            return c.chunk(0) if isinstance(c, pa.ChunkedArray) else c

        tree, node = column("tree").to_numpy(), column("node").to_numpy()
        self.rep, self.line = column("rep").to_numpy(), column("line").to_numpy()
        new = np.ones(len(node), bool)
        new[1:] = (node[1:] != node[:-1]) | (tree[1:] != tree[:-1])
        self.root = np.cumsum(new) - 1
        self.tree, self.seed = tree[new], node[new].astype(np.uint64)
        words, path = column("toks"), column("path")
        self.size = np.diff(words.offsets.to_numpy()).astype(np.int64)
        self.left = self.size - np.diff(path.offsets.to_numpy())  # words that are not on the path so far
        row, tok = np.repeat(np.arange(len(node)), self.size), words.flatten().to_numpy()
        every, word = np.unique(tok, return_inverse=True)
        keys, gid, count = np.unique(self.root[row] * len(every) + word, return_inverse=True, return_counts=True)
        shared = count[gid] > 1  # words of one record alone lead nowhere and add to no intersection
        taken = np.zeros(len(row), bool)
        ends = path.offsets.to_numpy().astype(np.int64)
        flat, on = path.flatten().to_numpy(), np.diff(ends)
        for k in range(int(on.max(initial=0))):
            at = on > k
            step = np.zeros(len(node), np.int64)
            step[at] = flat[ends[:-1][at] - ends[0] + k]
            taken |= at[row] & (tok == step[row])
        self.alone = np.bincount(row[~shared & ~taken], minlength=len(node))
        rank = np.cumsum(count > 1) - 1
        self.row, self.gid, self.free = row[shared], rank[gid[shared]], ~taken[shared]
        self.tok = every[keys[count > 1] % max(1, len(every))].astype(np.uint64)
        of = keys[count > 1] // max(1, len(every))
        self.first = np.searchsorted(of, np.arange(len(self.seed)))  # of each root among the shared words
        self.width = -(-np.bincount(of, minlength=len(self.seed)) // 64)
        self.common = np.bincount(self.row, minlength=len(node))
        keep = self.free
        self.frow, self.fgid = self.row[keep], self.gid[keep]
        self.starts = np.searchsorted(self.frow, np.arange(len(node) + 1))
        self.a: list[np.ndarray] = []
        self.b: list[np.ndarray] = []
        self.told: list[tuple[int, int, int, int]] = []

    def compare(self, a: np.ndarray, b: np.ndarray) -> None:
        """Keep the pairs of positions that link."""
        num, den = self.how["num"], self.how["den"]
        ok = np.abs(self.line[a] - self.line[b]) <= self.how["window"]
        # no more words can be shared than either record shares with anyone
        ok &= np.minimum(self.common[a], self.common[b]) * (num + den) >= (self.size[a] + self.size[b]) * num
        a, b = a[ok], b[ok]
        if not len(a):
            return
        level = np.ceil(np.log2(np.maximum(self.width, 1))).astype(int)
        of = level[self.root[a]]
        for c in np.unique(of):
            x, y = a[of == c], b[of == c]
            rows = np.unique(np.concatenate([x, y]))
            place = np.full(len(self.root), -1)
            place[rows] = np.arange(len(rows))
            mine = place[self.row] >= 0
            at, bit = place[self.row[mine]], self.gid[mine] - self.first[self.root[self.row[mine]]]
            inter, total = np.zeros(len(x), np.int64), 1 << int(c)
            px, py = place[x], place[y]
            band = max(1, min(total, (32 << 20) // (8 * len(rows))))  # columns of 64 words at a time
            for lo in range(0, total, band):
                bits = np.zeros(len(rows) * band, np.uint64)
                here = (bit >> 6 >= lo) & (bit >> 6 < lo + band)
                np.add.at(bits, at[here] * band + (bit[here] >> 6) - lo, np.uint64(1) << (bit[here] & 63).astype(np.uint64))
                bits = bits.reshape(len(rows), band)
                few = max(1, (8 << 20) // (8 * band))
                for k in range(0, len(x), few):
                    inter[k:k + few] += np.bitwise_count(bits[px[k:k + few]] & bits[py[k:k + few]]).sum(axis=1, dtype=np.int64)
            ok = inter * den >= (self.size[x] + self.size[y] - inter) * num
            p, q = self.rep[x[ok]], self.rep[y[ok]]
            self.a.append(np.minimum(p, q))
            self.b.append(np.maximum(p, q))

    def whole(self, member: np.ndarray, held: np.ndarray) -> None:
        """Compare all pairs of nodes that lie one after another in ``member``."""
        after = _spread(np.zeros(len(held), np.int64), held)
        after = np.repeat(held, held) - 1 - after  # later members of the same node
        ends = np.cumsum(after)
        lo = 0
        while lo < len(member):
            hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + (1 << 20), "right")))
            counts = after[lo:hi]
            self.compare(np.repeat(member[lo:hi], counts), member[_spread(np.arange(lo + 1, hi + 1), counts)])
            lo = hi

    def branch(self, level: int, member: np.ndarray, held: np.ndarray, seed: np.ndarray, tree: np.ndarray, root: np.ndarray, path: np.ndarray) -> None:
        """Nodes of ``held`` members each, one after another; path: a node's words that were chosen here."""
        how = self.how
        node = np.repeat(np.arange(len(held)), held)
        self.told.append((level, int((held > 1).sum()), int(held[held > 1].sum()), int(held.max(initial=0))))
        split = (held > how["node_size"]) & (level < how["depth"])
        if split.any():
            big = split[node]
            who, at = member[big], node[big]
            counts = self.starts[who + 1] - self.starts[who]
            e = _spread(self.starts[who], counts)
            p = np.minimum(how["branch"] / how["least"] / np.maximum(self.left[who] - path.shape[1], 1), 1.0)
            rec, on, word = np.repeat(who, counts), np.repeat(at, counts), self.fgid[e]
            chance = np.repeat(p, counts)
            free = np.ones(len(word), bool)
            for k in range(path.shape[1]):
                free &= word != path[on, k]
            rec, on, word, chance = rec[free], on[free], word[free], chance[free]
            key = on * len(self.tok) + word
            # what one level of branching is expected to compare, against comparing the node whole
            kinds, inverse, c = np.unique(key, return_inverse=True, return_counts=True)
            cost = np.bincount(inverse, chance, len(kinds)) * c
            work = np.bincount(kinds // max(1, len(self.tok)), cost, len(held)) + np.bincount(at, p * self.alone[who], len(held))
            split &= work * np.where(tree == 0, how["trees"], 1) < how["pays"] * held.astype(float) * held
            go = split[on]
            rec, on, word, chance, inverse = rec[go], on[go], word[go], chance[go], inverse[go]
            for each in range(1, how["trees"] + 1) if len(rec) else ():
                # the trees begin at the root; a node of a tree goes on in its own
                begins = tree[on] == 0
                now = begins if each > 1 else np.ones(len(on), bool)
                own = np.where(begins, each, tree[on])
                # a word is chosen by the hash of node, tree and word alone, so both of a pair choose it
                hashed = _mixed(seed[on] ^ _mixed(self.tok[word] + _mixed(own.astype(np.uint64))))
                chosen = now & ((hashed >> np.uint64(33)).astype(np.float64) < chance * 2.0**31)
                if not chosen.any():
                    continue
                order = np.flatnonzero(chosen)
                order = order[np.argsort(inverse[order], kind="stable")]
                _, first, count = np.unique(inverse[order], return_index=True, return_counts=True)
                pairs = count > 1
                lead = order[first[pairs]]
                self.branch(
                    level + 1, rec[order[_spread(first[pairs], count[pairs])]], count[pairs], hashed[lead], own[lead], root[on[lead]],
                    np.column_stack([path[on[lead]], word[lead]]),
                )
        rest = ~split & (held > 1)
        self.whole(member[rest[node]], held[rest])

    def run(self, level: int) -> None:
        held = np.bincount(self.root, minlength=len(self.seed))
        self.branch(level, np.arange(len(self.root)), held, self.seed, self.tree, np.arange(len(held)), np.zeros((len(held), 0), np.int64))


def _in_task(level: int, how: dict, tell: bool):
    """Links, or with ``tell`` counts of nodes, of rows laid out by (tree, node)."""

    def done(t: pa.Table) -> pa.RecordBatch:
        g = _Gathered(t, how)
        g.run(level)
        if tell:
            return pa.RecordBatch.from_arrays([pa.array(list(x), pa.int64()) for x in zip(*g.told)], ["level", "nodes", "held", "most"])
        pairs = np.unique(np.column_stack([np.concatenate([*g.a, np.zeros(0, np.int64)]), np.concatenate([*g.b, np.zeros(0, np.int64)])]), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0], pa.int64()), pa.array(pairs[:, 1], pa.int64())], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            kept.append(batch)
            rows += batch.num_rows
            if rows < how["rows"]:
                continue
            t = pa.Table.from_batches(kept)
            tree, node = t.column("tree").to_numpy(), t.column("node").to_numpy()
            changes = np.flatnonzero((node[1:] != node[:-1]) | (tree[1:] != tree[:-1]))
            if len(changes):
                cut_at = int(changes[-1]) + 1
                yield done(t.slice(0, cut_at))
                t = t.slice(cut_at)
            kept, rows = t.to_batches(), t.num_rows
        if kept:
            yield done(pa.Table.from_batches(kept))

    return run


def _compare(reps: np.ndarray, lines: np.ndarray, toks: np.ndarray, ends: np.ndarray, half: np.ndarray, window: int, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of two blocks that link. Record i has the words toks[ends[i]:ends[i + 1]]; if halves 1 and 2 are given, only pairs between them."""
    size = np.diff(ends).astype(np.int32)
    rows = np.repeat(np.arange(len(reps)), size)
    _, word, count = np.unique(toks, return_inverse=True, return_counts=True)
    shared = count[word] > 1  # words of one record alone add to no intersection
    _, col = np.unique(word[shared], return_inverse=True)
    m = np.zeros((len(reps), int(col.max()) + 1 if len(col) else 1), dtype=np.float32)
    m[rows[shared], col] = 1
    one = np.flatnonzero(half <= 1)
    two = np.flatnonzero(half == 2) if half.any() else one
    inter = np.rint(m[one] @ m[two].T).astype(np.int32)
    ok = inter * den >= (size[one][:, None] + size[two][None, :] - inter) * num
    ok &= np.abs(lines[one][:, None] - lines[two][None, :]) <= window
    if two is one:
        ok = np.triu(ok, 1)
    x, y = np.nonzero(ok)
    a, b = reps[one[x]], reps[two[y]]
    return np.minimum(a, b), np.maximum(a, b)


def _square(window: int, num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        t = table.combine_chunks()
        words = t.column("toks").combine_chunks()
        words = words.chunk(0) if isinstance(words, pa.ChunkedArray) else words
        ends = words.offsets.to_numpy().astype(np.int64)
        a, b = _compare(
            t.column("rep").to_numpy(), t.column("line").to_numpy(), words.flatten().to_numpy(), ends - ends[0], t.column("half").to_numpy(), window, num, den
        )
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return run


def links(
    reps: DataFrame, window: int = 15, least: float = 0.6, node_size: int = 24, trees: int = 4, branch: float = 2.0, depth: int = 2, block: int = 1024, pays: float = 3.0, gather: int = 16384, trace: list | None = None,
) -> DataFrame:
    """(a, b), a < b: linked representatives of ``reps`` (rep, name, line, toks).

    ``trace`` is given (level, nodes, records in them, largest node) of every level.
    """
    share = Fraction(least).limit_denominator(1000)
    how = {
        "window": window, "num": share.numerator, "den": share.denominator, "least": float(least), "node_size": node_size, "trees": trees, "branch": branch, "depth": depth,
        "pays": pays, "rows": 8192,
    }
    band = F.floor(F.col("line") / window)
    start = reps.select("rep", "line", "toks", F.xxhash64("name").alias("root"), F.explode(F.array(band, band - 1)).alias("band"))
    front = start.select(F.xxhash64("root", "band").alias("node"), F.lit(0).alias("tree"), "rep", "line", "toks", F.array().cast("array<bigint>").alias("path"))
    found: list[DataFrame] = []
    whole: list[DataFrame] = []
    told: list[DataFrame] = []
    for level in range(depth + 1):
        held = cut(front.groupBy("tree", "node").agg(F.count("*").alias("held")).where(F.col("held") > gather))
        none = held.isEmpty()
        small = front if none else front.join(held, ["tree", "node"], "left_anti")
        # a fixed number of partitions, so a node is never divided
        laid = small.repartition(slices(small), "tree", "node").sortWithinPartitions("tree", "node")
        found.append(laid.mapInArrow(_in_task(level, how, False), LINK))
        if trace is not None:
            told.append(laid.mapInArrow(_in_task(level, how, True), TOLD))
            told.append(held.select(F.lit(level).cast("bigint").alias("level"), F.lit(1).cast("bigint").alias("nodes"), "held", F.col("held").alias("most")))
        if none:
            break
        large = front.join(held, ["tree", "node"])
        if level == depth:
            whole.append(large)
            break
        # what one level of branching is expected to compare, against comparing the node whole
        large = large.withColumn("free", F.array_except("toks", "path"))
        step = large.where(F.size("free") > 0).select("tree", "node", "rep", "held", (F.lit(branch / float(least)) / F.size("free")).alias("chance"), F.explode("free").alias("tok"))
        per = step.groupBy("tree", "node", "tok").agg(F.count("*").alias("c"), F.avg("chance").alias("p"), F.first("held").alias("held"))
        work = F.sum(F.least(F.col("p"), F.lit(1.0)) * F.col("c") * F.col("c")) * (trees if level == 0 else 1)
        splits = cut(per.groupBy("tree", "node").agg(work.alias("work"), F.first("held").alias("held")).where(F.col("work") < F.lit(pays) * F.col("held") * F.col("held")).select("tree", "node"))
        whole.append(large.join(splits, ["tree", "node"], "left_anti").drop("free"))
        large = large.join(splits, ["tree", "node"])
        if level == 0:
            large = large.drop("tree").withColumn("tree", F.explode(F.sequence(F.lit(1), F.lit(trees))))
        # a word is chosen by the hash of node, tree and word alone, so both of a pair choose it
        chance = F.lit(branch / float(least)) / F.size("free") * F.lit(float(2**31))
        step = large.where(F.size("free") > 0).select("tree", "node", "rep", "line", "toks", "path", chance.alias("chance"), F.explode("free").alias("tok"))
        chosen = step.withColumn("next", F.xxhash64("tree", "node", "tok")).where(F.pmod("next", F.lit(2**31)) < F.col("chance"))
        front = cut(chosen.select(F.col("next").alias("node"), "tree", "rep", "line", "toks", F.array_append("path", F.col("tok")).alias("path")))
    if trace is not None:
        every = told[0]
        for more in told[1:]:
            every = every.unionByName(more)
        trace.extend(tuple(r) for r in every.groupBy("level").agg(F.sum("nodes"), F.sum("held"), F.max("most")).orderBy("level").collect())
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    for rest in whole:
        blocks = F.ceil(F.col("held") / block)
        own = F.pmod(F.xxhash64("rep", F.lit(7)), blocks)
        other = F.explode(F.sequence(F.lit(0), blocks - 1))
        squares = (
            rest.withColumn("own", own).select("tree", "node", "rep", "line", "toks", "own", other.alias("other"))
            .select("tree", "node", F.least("own", "other").alias("x"), F.greatest("own", "other").alias("y"), "own", "rep", "line", "toks")
            .withColumn("half", F.when(F.col("x") == F.col("y"), 0).when(F.col("own") == F.col("x"), 1).otherwise(2).cast("int"))
        )
        # a group holds two blocks at most
        out = out.union(squares.select("tree", "node", "x", "y", "rep", "line", "toks", "half").groupBy("tree", "node", "x", "y").applyInArrow(_square(window, share.numerator, share.denominator), LINK))
    return out.distinct()


def near_groups(comments: DataFrame, **how) -> DataFrame:
    """(ord, group_id, n_links): every record in a group of at least two, with its links to other texts.

    ``group_id`` is the smallest ord of the group. Copies of one text in one place count as one
    representative for n_links.
    """
    # two hashes: 128 bits stand for a text in a place
    ready = places(comments).withColumns({"copy": F.xxhash64("name", "line", "words"), "copy2": F.xxhash64(F.lit(1), "words", "line", "name")})
    every = cut(ready.select("ord", "name", "line", "copy", "copy2", F.transform("words", lambda w: F.xxhash64(w)).alias("toks")))
    # repeated rows of a key count once; only keys and hashes are moved for that
    own = cut(every.groupBy("ord").agg(F.min(F.struct("copy", "copy2")).alias("c")).select("ord", "c.copy", "c.copy2"))
    reps = cut(own.groupBy("copy", "copy2").agg(F.min("ord").alias("rep"), F.count("*").alias("n")))
    texts = every.groupBy("copy", "copy2").agg(F.min("name").alias("name"), F.min("line").alias("line"), F.min("toks").alias("toks"))
    texts = texts.join(reps, ["copy", "copy2"])
    pairs = cut(links(texts.select("rep", "name", "line", "toks"), **how))
    ends = pairs.select(F.col("a").alias("rep")).union(pairs.select(F.col("b").alias("rep")))
    degree = ends.groupBy("rep").agg(F.count("*").alias("n_links"))
    comps = components(pairs)
    labelled = (
        reps.join(comps.withColumnRenamed("node", "rep"), "rep", "left").join(degree, "rep", "left")
        .where("comp is not null or n > 1")
        .select("copy", "copy2", F.coalesce("comp", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    )
    return own.join(labelled, ["copy", "copy2"]).select("ord", "group_id", "n_links")


def group_pairs(groups: DataFrame, stretch: int = 1000) -> DataFrame:
    """(ord_a, ord_b): all pairs of each group, which the found cases are.

    A group of more than ``stretch`` records is joined in parts of about that size, so one group's
    pairs are many tasks' work.
    """
    sizes = groups.groupBy("group_id").agg(F.ceil(F.count("*") / stretch).cast("int").alias("parts"))
    sized = groups.join(sizes, "group_id")
    a = sized.select("group_id", F.pmod(F.xxhash64("ord"), "parts").cast("int").alias("part"), F.col("ord").alias("ord_a"))
    b = sized.select("group_id", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("ord").alias("ord_b"))
    return a.join(b, ["group_id", "part"]).where("ord_a < ord_b").select("ord_a", "ord_b")
