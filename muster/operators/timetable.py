"""Timetable algebra: period ranges, slots, grids and lookups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The school week.
DAYS = ("الأحد", "الاثنين", "الثلاثاء", "الأربعاء", "الخميس")
PERIODS = 8
PERIOD_TIMES = {
    1: "8:00 - 8:45",
    2: "9:00 - 9:45",
    3: "10:00 - 10:45",
    4: "11:00 - 11:45",
    5: "12:00 - 12:45",
    6: "13:00 - 13:45",
    7: "14:00 - 14:45",
    8: "15:00 - 15:45",
}


def slots(blocks: DataFrame) -> DataFrame:
    """One row per period of each block."""
    return blocks.withColumn("period", F.explode(F.sequence("period_start", "period_end")))


def covers(period: Column) -> Column:
    return (F.col("period_start") <= period) & (period <= F.col("period_end"))


def has_lesson(
    lessons: Column, grade: Column | None = None, subject: Column | None = None, day: Column | None = None,
    period: Column | None = None,
) -> Column:
    """The same-lesson predicate on a nested array of lessons; parts left None are open."""

    def holds(lesson: Column) -> Column:
        condition = F.lit(True)
        for name, wanted in (("grade", grade), ("subject", subject), ("day_index", day)):
            if wanted is not None:
                condition = condition & (lesson[name] == wanted)
        if period is not None:
            condition = condition & (lesson["period_start"] <= period) & (period <= lesson["period_end"])
        return condition

    return F.exists(lessons, holds)


def first_covering(blocks: DataFrame, key: Sequence[str], order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """The first lesson of each (key, day, period): an aggregate with map-side combine, not a window."""
    first = F.min_by(F.struct(*values), F.struct(*order)).alias("_first")
    return slots(blocks).groupBy(*key, "day_index", "period").agg(first).select(*key, "day_index", "period", "_first.*")


def week(spark: SparkSession, days: int = len(DAYS), periods: int = PERIODS) -> DataFrame:
    """The days and periods of a week, a table of fixed size."""
    return spark.range(days * periods).select(
        F.floor(F.col("id") / periods).cast("bigint").alias("day_index"), (F.col("id") % periods + 1).alias("period")
    )


def every_slot(entities: DataFrame, days: int = len(DAYS), periods: int = PERIODS) -> DataFrame:
    """Each entity with each slot of the week, made on the spot from constants."""
    by_day = entities.withColumn("day_index", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(days - 1).cast("bigint"))))
    return by_day.withColumn("period", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(periods).cast("bigint"))))


def occupancy_grid(
    entities: DataFrame, blocks: DataFrame, key: str, order: Sequence[str], values: Sequence[str],
    period_times: dict[int, str] = PERIOD_TIMES,
) -> DataFrame:
    """Entity by day by period, with the first covering lesson or nulls, and the printed period time."""
    times = F.create_map(*[F.lit(x) for p, label in period_times.items() for x in (p, label)])
    grid = every_slot(entities.select(key))
    filled = grid.join(first_covering(blocks, [key], order, values), [key, "day_index", "period"], "left")
    return filled.withColumn("period_time", F.element_at(times, F.col("period").cast("int")))


def slot_map(blocks: DataFrame, day: int, period: int, order: Sequence[str], values: Sequence[str]) -> DataFrame:
    """What every class has in one slot: its first lesson, or nulls for a class without one. One aggregate."""
    there = (F.col("day_index") == day) & covers(F.lit(period))
    first = F.min_by(F.when(there, F.struct(*values)), F.when(there, F.struct(*order))).alias("_first")
    return blocks.groupBy("class_code").agg(first).select("class_code", "_first.*")


def unassigned_slots(blocks: DataFrame) -> DataFrame:
    """Slots of the week in which a class that occurs at all has no lesson."""
    taken = slots(blocks).select("class_code", "day_index", "period").distinct()
    return every_slot(taken.select("class_code").distinct()).join(taken, ["class_code", "day_index", "period"], "left_anti")


def entities_without(blocks: DataFrame, subject: str, key: str = "class_code") -> DataFrame:
    """Entities with no lesson of a subject: one aggregate."""
    return (
        blocks.groupBy(key)
        .agg(F.max(F.col("subject") == subject).alias("_has"))
        .filter(~F.col("_has"))
        .select(key)
    )
