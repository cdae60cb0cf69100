"""Order-dependent work that does not put a whole group into one task.

A plain window over a partition key puts all rows of a key into one task, and a key may hold a third of
the table. The helpers here split each key into ordered buckets: the window runs inside (key, bucket),
and a small table with one row per bucket carries counts or values from one bucket to the next.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET = 100_000


def same_key(names: Sequence[str], left: str, right: str) -> Column:
    """Null-safe equality of the named columns of two aliased sides."""
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def ranked(
    df: DataFrame,
    key: Sequence[str],
    coarse: Sequence[Column],
    fine: Sequence[Column],
    name: str = "rank",
    total: str | None = None,
) -> DataFrame:
    """Add the row number within ``key`` ordered by ``coarse`` and then ``fine``.

    ``coarse`` are sort expressions with many ties; every combination of them is one bucket. Buckets are
    counted with map-side combine, the running sum goes over buckets only, and rows are numbered inside
    their bucket. ``total`` adds the number of rows of the key.
    """
    steps = [f"_c{i}" for i in range(len(coarse))]
    # one struct per bucket: it is never null, its null fields are equal to each other, and the count,
    # the window and the join all hash it, so rows are shuffled once
    group = F.struct(*key) if key else F.struct(F.lit(0).alias("_all"))
    bucket = F.struct(group.alias("k"), *[e.alias(c) for c, e in zip(steps, coarse)])
    work = df.withColumn("_b", bucket)
    counts = work.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    line = Window.partitionBy("_b.k").orderBy(*[f"_b.{c}" for c in steps])
    before = F.sum("_n").over(line.rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.withColumn("_before", F.coalesce(before, F.lit(0)))
    if total is not None:
        offsets = offsets.withColumn(total, F.sum("_n").over(Window.partitionBy("_b.k")))
    numbered = work.withColumn("_in", F.row_number().over(Window.partitionBy("_b").orderBy(*fine)))
    joined = numbered.join(offsets, "_b")
    kept = [*df.columns, (F.col("_before") + F.col("_in")).alias(name)]
    return joined.select(*kept, *([total] if total is not None else []))


def neighbour(
    df: DataFrame, key: Sequence[str], bucket: Column, order: Sequence[str], value: str, name: str, forward: bool = False
) -> DataFrame:
    """Add the value of the previous (or next) row of the same ``key`` in the given order.

    ``bucket`` must not fall as the order goes up. A row at the edge of its bucket takes the edge value
    of the nearest bucket that has rows.
    """
    work = df.withColumn("_b", F.struct(F.struct(*key).alias("k"), bucket.alias("at")))
    inside = Window.partitionBy("_b").orderBy(*order)
    step = F.lead if forward else F.lag
    edge_of = F.min_by if forward else F.max_by
    edges = work.groupBy("_b").agg(edge_of(F.struct(value), F.struct(*order)).alias("_edge"))
    carried = step("_edge").over(Window.partitionBy("_b.k").orderBy("_b.at"))
    edges = edges.withColumn("_carry", carried).drop("_edge")
    near = work.withColumn("_near", step(F.struct(value)).over(inside))
    found = F.coalesce(F.col("_near"), F.col("_carry"))[value]
    return near.join(edges, "_b").select(*df.columns, found.alias(name))


def bounds(
    points: DataFrame, marks: DataFrame, key: Sequence[str], at: str, width: float, lower: str, upper: str,
    inclusive: bool = False,
) -> DataFrame:
    """Add to each point the greatest mark below and the least mark above it on the same key.

    An as-of lookup both ways, strict on both sides unless ``inclusive`` lets a mark at the point count
    as the one below. Positions and marks are made distinct together, one pass in order inside each
    (key, bucket of ``width``) finds the neighbours there, and a table with one row per bucket brings
    the nearest marks outside of it.
    """
    bucket = F.struct(F.struct(*key).alias("k"), F.floor(F.col(at) / width).alias("at")).alias("_b")
    none = F.lit(None).cast(marks.schema[at].dataType)
    both = points.select(bucket, F.col(at).alias("_at"), none.alias("_mark"), F.lit(True).alias("_asked")).unionByName(
        marks.select(bucket, F.col(at).alias("_at"), F.col(at).alias("_mark"), F.lit(False).alias("_asked"))
    )
    places = both.groupBy("_b", "_at").agg(F.max("_mark").alias("_mark"), F.max("_asked").alias("_asked"))
    # frames that grow row by row are kept up; one that shrinks would be worked out anew for each row, so the marks above
    # are read in descending order
    row, back = Window.partitionBy("_b").orderBy("_at"), Window.partitionBy("_b").orderBy(F.col("_at").desc())
    last_below = Window.currentRow if inclusive else -1
    near = places.select(
        "_b",
        "_at",
        "_asked",
        F.max("_mark").over(row.rowsBetween(Window.unboundedPreceding, last_below)).alias("_lo"),
        F.min("_mark").over(back.rowsBetween(Window.unboundedPreceding, -1)).alias("_hi"),
    ).filter("_asked")
    line, line_back = Window.partitionBy("_b.k").orderBy("_b.at"), Window.partitionBy("_b.k").orderBy(F.col("_b.at").desc())
    carry = (
        places.groupBy("_b")
        .agg(F.min("_mark").alias("_min"), F.max("_mark").alias("_max"))
        .select(
            "_b",
            F.max("_max").over(line.rowsBetween(Window.unboundedPreceding, -1)).alias("_below"),
            F.min("_min").over(line_back.rowsBetween(Window.unboundedPreceding, -1)).alias("_above"),
        )
    )
    found = near.join(carry, "_b").select(
        "_b", "_at", F.coalesce("_lo", "_below").alias(lower), F.coalesce("_hi", "_above").alias(upper)
    )
    tagged = points.withColumn("_b", bucket).withColumn("_at", F.col(at))
    return tagged.join(found, ["_b", "_at"]).select(*points.columns, lower, upper)
