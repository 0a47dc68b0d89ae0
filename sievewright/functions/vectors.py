"""Vectors as little-endian bytes and back, for stores that keep them so."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


@F.pandas_udf("binary")
def vector_to_bytes(v: pd.Series) -> pd.Series:
    return v.map(lambda x: None if x is None else np.asarray(x, dtype="<f4").tobytes())


@F.pandas_udf("array<float>")
def bytes_to_vector(b: pd.Series) -> pd.Series:
    """Whole numbers of four bytes; what is left over at the end is ignored."""
    return b.map(lambda x: None if x is None else np.frombuffer(x[: len(x) // 4 * 4], dtype="<f4").tolist())
