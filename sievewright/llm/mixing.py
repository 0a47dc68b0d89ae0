"""Problem 9: mixing sources to target weights.

Tokens are added up by source, and a source with t tokens, share w and at most m copies gets the
rate r = w * total / t. The total is the largest at which no source needs more than its m copies,
so every share is reached as nearly as whole documents allow; with a total of the caller's choice,
sources at their cap keep it and the rest take over what they leave, in proportion to their shares.
A document is emitted floor(r) times, and once more if the hash of the seed and its id falls below
the fraction of r, so the draw is the same on every run and layout.

Defined results: source names count without regard to case, outer blanks and ``-`` or ``_``; null
sources and those missing from the targets take no part; targets without tokens get nothing and are reported with 0, and
the other shares are scaled up to fill in; documents without tokens add nothing and are not drawn;
repeated targets of one name count once, with their largest share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut
from .tokenizer import counted


def source_name(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.translate(F.lower(F.trim(F.regexp_replace(c, r"^\s+|\s+$", ""))), "-", "_")


def sized(documents: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, source, n_tokens) of the documents that take part, sizes in tokens of a public vocabulary."""
    some = documents.where("doc_id is not null and source is not null and text is not null and text <> ''")
    return counted(some, "source", path=path).select("doc_id", source_name("source").alias("source"), "n_tokens").where("n_tokens > 0")


def rates(sizes: DataFrame, targets: DataFrame, total_tokens: int | None = None) -> DataFrame:
    """(source, target_share, max_repeats, tokens, docs, rate, binds), one row per target.

    A target without tokens has 0 tokens and rate 0. ``binds`` marks the sources at their cap: the
    scarcest of them fixes the total.
    """
    named = (
        targets.where("source is not null and target_share > 0 and max_repeats > 0")
        .groupBy(source_name("source").alias("source")).agg(F.max("target_share").alias("target_share"), F.max("max_repeats").alias("max_repeats"))
    )
    held = sizes.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count("*").alias("docs"))
    every = named.join(held, "source", "left").collect()  # as many rows as mix_targets has
    every.sort(key=lambda r: r["source"])
    rows = [r for r in every if r["tokens"]]
    rate: dict[str, float] = {}
    if rows:
        share = {r["source"]: r["target_share"] for r in rows}
        most = {r["source"]: float(r["max_repeats"]) * r["tokens"] for r in rows}
        if total_tokens is None:
            scale = sum(share.values())
            total = min(most[s] * scale / share[s] for s in share)
            take = {s: share[s] / scale * total for s in share}
        else:
            take, free, left = {}, dict(share), float(min(total_tokens, sum(most.values())))
            while free:
                scale = sum(free.values())
                capped = [s for s in free if free[s] / scale * left >= most[s]]
                if not capped:
                    take |= {s: free[s] / scale * left for s in free}
                    break
                for s in capped:
                    take[s] = most[s]
                    del free[s]
                left = max(0.0, float(min(total_tokens, sum(most.values()))) - sum(take.values()))
        rate = {r["source"]: min(float(r["max_repeats"]), take.get(r["source"], 0.0) / r["tokens"]) for r in rows}
    spark = sizes.sparkSession
    return spark.createDataFrame(
        [
            (r["source"], float(r["target_share"]), int(r["max_repeats"]), int(r["tokens"] or 0), int(r["docs"] or 0), float(rate.get(r["source"], 0.0)), bool(r["tokens"]) and rate[r["source"]] >= r["max_repeats"] * (1 - 1e-9))
            for r in every
        ],
        "source string, target_share double, max_repeats int, tokens bigint, docs bigint, rate double, binds boolean",
    )


def drawn(sizes: DataFrame, rate: DataFrame, seed: int = 20240) -> DataFrame:
    """(doc_id, source, n_tokens, copies): how often each document is emitted, 0 included."""
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # The rates have one row per target, so the small side of the join has that bound.
    return sizes.join(F.broadcast(rate.select("source", "rate")), "source").select(
        "doc_id", "source", "n_tokens", (F.floor("rate") + F.when(draw < F.col("rate") - F.floor("rate"), 1).otherwise(0)).cast("int").alias("copies")
    )


def mixture(documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, seed: int = 20240, path: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The drawn copies (doc_id, copy, source, n_tokens) and the report by source.

    The report has (source, target_share, max_repeats, tokens, rate, binds, tokens_drawn, share_reached,
    tokens_left), a row per target; tokens_left are those of documents that were not drawn at all.
    """
    sizes = cut(sized(documents, path))
    rate = rates(sizes, targets, total_tokens)
    draws = drawn(sizes, rate, seed)
    copies = draws.where("copies > 0").select("doc_id", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy"), "source", "n_tokens")
    got = draws.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("copies")).alias("tokens_drawn"), F.sum(F.when(F.col("copies") == 0, F.col("n_tokens")).otherwise(0)).alias("tokens_left"))
    whole = got.agg(F.sum("tokens_drawn").alias("whole"))
    # one row holds the whole
    report = rate.join(got, "source", "left").join(F.broadcast(whole)).select(
        "source", "target_share", "max_repeats", "tokens", "rate", "binds", F.coalesce("tokens_drawn", F.lit(0)).alias("tokens_drawn"),
        F.coalesce(F.coalesce("tokens_drawn", F.lit(0)) / F.when(F.col("whole") > 0, F.col("whole")), F.lit(0.0)).alias("share_reached"), F.coalesce("tokens_left", F.lit(0)).alias("tokens_left"),
    )
    return copies, report
