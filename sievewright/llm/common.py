"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.lineage import checkpointed as cut  # noqa: F401 - the operators cut lineage by this


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One table of the input folder."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Bound an Arrow batch of whole texts, unless the session already sets a bound of its own."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if spark.conf.get(key, "10000") == "10000":
        spark.conf.set(key, str(rows))


def slices(df: DataFrame, least: int = 1) -> int:
    """A task count for a wide step: the session's shuffle partitions, at least ``least``."""
    return max(least, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def utf8(values: pa.Array) -> list:
    """A string column as Python strings; None stays."""
    return values.to_pylist()


def vocabulary_path(name: str) -> str:
    """Where a public vocabulary file lies: the installed package's folder, else /opt/tokenizers."""
    try:
        import public_tokenizers

        return public_tokenizers.path(name)
    except ImportError:
        return os.path.join("/opt/tokenizers", name)


def usable_vector(col: str, width: int):
    """A vector of the right width whose numbers are finite and not all zero."""
    v = F.col(col)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) == width) & finite & F.exists(v, lambda x: x != 0)
