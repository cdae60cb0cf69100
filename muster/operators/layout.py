"""Assigning positioned text to table cells by geometry, as equi-joins on page and bucket."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.operators.ordering import bounds, neighbour
from muster.operators.sizing import sent_out, settled

# Horizontal bounds of the eight periods on a page, and the least overlap that counts.
PERIOD_BOUNDS = (
    (1, 93.6, 175.4),
    (2, 175.4, 257.3),
    (3, 257.3, 339.1),
    (4, 339.1, 421.0),
    (5, 502.7, 584.5),
    (6, 584.5, 666.4),
    (7, 666.4, 748.2),
    (8, 748.2, 830.0),
)
MIN_OVERLAP = 20.0
CENTRE_TOLERANCE = 2.0
CELL_TOLERANCE = 1.0


def cells_from_rulings(rulings: DataFrame, key: Sequence[str], at: str, width: float, start: str, end: str) -> DataFrame:
    """Cells between adjacent distinct rulings of a page."""
    lines = rulings.select(*key, F.col(at).alias(start)).distinct()
    paired = neighbour(lines, key, F.floor(F.col(start) / width), [start], start, end, forward=True)
    return paired.filter(F.col(end).isNotNull())


def assign_cells(
    words: DataFrame, cells: DataFrame, page: str, width: float, tolerance: float | None = None,
    x: tuple[str, str, str] = ("x", "x0", "x1"), y: tuple[str, str, str] = ("y", "y0", "y1"),
) -> DataFrame:
    """Words with each cell that holds their centre.

    ``tolerance`` widens cells and includes their edges; None is strict containment. A cell stands under
    each bucket of ``width`` that it reaches, a word under one, so each pair meets once.
    """
    slack = 0.0 if tolerance is None else tolerance
    (wx, cx0, cx1), (wy, cy0, cy1) = x, y
    reach = F.sequence(F.floor((F.col(cy0) - slack) / width), F.floor((F.col(cy1) + slack) / width))
    spread = cells.withColumn("_bucket", F.explode(reach))
    placed = words.withColumn("_bucket", F.floor(F.col(wy) / width))
    pairs = placed.join(spread, [page, "_bucket"]).drop("_bucket")

    def holds(value: str, low: str, high: str) -> Column:
        if tolerance is None:
            return (F.col(value) > F.col(low)) & (F.col(value) < F.col(high))
        return F.col(value).between(F.col(low) - slack, F.col(high) + slack)

    return pairs.filter(holds(wx, cx0, cx1) & holds(wy, cy0, cy1))


def overlap_bins(
    cells: DataFrame, x0: str, x1: str, bins: Sequence[tuple[int, float, float]] = PERIOD_BOUNDS, least: float = MIN_OVERLAP
) -> DataFrame:
    """First and last bin that overlap a cell by more than ``least``; null when none does.

    The bins are a handful of constants, so they travel inside the expression and nothing is joined.
    """
    table = F.array(*[F.struct(F.lit(n).alias("bin"), F.lit(a).alias("a"), F.lit(b).alias("b")) for n, a, b in bins])
    hits = F.filter(table, lambda r: F.least(F.col(x1), r["b"]) - F.greatest(F.col(x0), r["a"]) > least)
    numbers = F.transform(hits, lambda r: r["bin"])
    return cells.withColumn("first_bin", F.array_min(numbers)).withColumn("last_bin", F.array_max(numbers))


def nearest_match(
    points: DataFrame, marks: DataFrame, key: Sequence[str], at: str, width: float, tolerance: float
) -> DataFrame:
    """Each point with the nearest mark of its page, when it is nearer than ``tolerance``; the lower one of equals."""
    found = bounds(points, marks, key, at, width, "_lo", "_hi", inclusive=True)
    below, above = F.col(at) - F.col("_lo"), F.col("_hi") - F.col(at)
    nearest = F.when(F.coalesce(below <= above, below.isNotNull()), F.col("_lo")).otherwise(F.col("_hi"))
    near = found.withColumn("nearest", nearest)
    return near.filter(F.abs(F.col("nearest") - F.col(at)) < tolerance).select(*points.columns, "nearest")


def unallocated(
    words: DataFrame, assigned: DataFrame, cells: DataFrame, page: str, word: str,
    y: tuple[str, str, str] = ("y", "y0", "y1"), x: tuple[str, str] = ("x", "x0"),
) -> DataFrame:
    """Words right of the left edge and within the height of the cells of their page that no cell took."""
    extent = settled(cells.groupBy(page).agg(F.min(y[1]).alias("_top"), F.max(y[2]).alias("_bottom"), F.min(x[1]).alias("_left")))
    high = (F.col(y[0]) > F.col("_top")) & (F.col(y[0]) < F.col("_bottom"))
    inside = words.join(sent_out(extent), page).filter(high & (F.col(x[0]) > F.col("_left")))
    return inside.select(*words.columns).join(assigned.select(word).distinct(), word, "left_anti")
