"""Status change points."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.ordering import neighbour


def change_points(df: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[str], state: str) -> DataFrame:
    """Rows whose state differs from the one before, with ``previous``; the first row of a key counts."""
    placed = neighbour(df, key, bucket, order, state, "previous")
    return placed.filter(~F.col("previous").eqNullSafe(F.col(state)))
