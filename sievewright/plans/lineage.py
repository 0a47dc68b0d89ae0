"""Cutting lineage by reliable checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def checkpointed(df: DataFrame) -> DataFrame:
    """A checkpoint in the folder of spark.checkpoint.dir, which executors share; a temporary one only in a local session."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder:
            if not sc.master.startswith("local[") and sc.master != "local":
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            folder = tempfile.mkdtemp(prefix="checkpoints-")
        sc.setCheckpointDir(folder)
    return df.checkpoint(eager=True)


def numbered(rows: DataFrame, keys: list[str], order: list[Column], out: str = "place") -> DataFrame:
    """Rows numbered from 1 within ``keys`` by ``order``, however many rows a key has.

    Rows are laid out by range of keys and order; each partition numbers its own and adds what the
    earlier partitions hold of the same key. The layout is checkpointed, since both passes have to
    see the same one.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(rows.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    by = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(1))
    base = laid.groupBy("_part", *keys).agg(F.count("*").alias("_held"))  # one row per partition and key that meet
    base = base.select("_part", *keys, F.coalesce(F.sum("_held").over(by.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_base"))
    local = laid.withColumn("_local", F.row_number().over(W.partitionBy("_part", *keys).orderBy(*order)))
    on = [F.col("l._part") == F.col("b._part"), *[F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]]
    joined = local.alias("l").join(base.alias("b"), on)
    return joined.select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_base") + F.col("_local")).alias(out))


def runs(rows: DataFrame, keys: list[str], order: list[Column], value: str, out: str = "run") -> DataFrame:
    """Rows with the number of their run of equal ``value`` within ``keys`` by ``order``.

    Laid out as in ``numbered``: a partition's first row of a key looks at the last value that
    earlier partitions have of it, and run numbers go on from theirs.
    """
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = checkpointed(rows.repartitionByRange(n, *[F.col(k) for k in keys], *order).withColumn("_part", F.spark_partition_id()))
    w = W.partitionBy("_part", *keys).orderBy(*order)
    seen = laid.withColumn("_nth", F.row_number().over(w)).withColumn("_prev", F.lag(value).over(w))
    seen = seen.withColumn("_new", F.when(F.col("_nth") == 1, 0).otherwise((~F.col("_prev").eqNullSafe(F.col(value))).cast("int")))
    seen = seen.withColumn("_local", F.sum("_new").over(w))
    ends = seen.groupBy("_part", *keys).agg(F.min_by(F.struct(F.col(value).alias("v")), "_nth").alias("_first"), F.max_by(F.struct(F.col(value).alias("v")), "_nth").alias("_last"), F.max("_local").alias("_inner"))
    by = W.partitionBy(*keys).orderBy("_part")
    ends = ends.withColumn("_before", F.lag("_last").over(by))
    ends = ends.withColumn("_step", F.when(F.col("_before").isNull(), 0).otherwise((~F.col("_before.v").eqNullSafe(F.col("_first.v"))).cast("int")))
    ends = ends.withColumn("_base", F.sum("_step").over(by) + F.coalesce(F.sum("_inner").over(by.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    on = [F.col("l._part") == F.col("b._part"), *[F.col(f"l.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]]
    return seen.alias("l").join(ends.alias("b"), on).select(*[F.col(f"l.{c}") for c in rows.columns], (F.col("_base") + F.col("_local")).alias(out))
