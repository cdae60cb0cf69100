"""Checks that stand before every broadcast, and the reliable cut of a long lineage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.session import work_folder

BROADCAST_ROWS = 200_000


def sent_out(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """The side with a broadcast hint when it has at most ``rows`` rows; beyond that Spark shuffles it.

    The count stops at the bound. Meant for query tables, dimensions and tables read back from ``settled``.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def spread(df: DataFrame) -> DataFrame:
    """The rows dealt evenly over as many tasks as a shuffle has, for costly work on rows of few bytes.

    Scans and adaptive shuffles are cut by bytes, so a narrow table of millions of rows may come as one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def settled(df: DataFrame) -> DataFrame:
    """Computed once and kept in the shared work folder, where it outlives executors."""
    work_folder(df.sparkSession)
    return df.checkpoint(eager=True)
