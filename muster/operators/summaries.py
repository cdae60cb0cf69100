"""Counts, rollups and facets.

Group keys may be hot, so counts rely on map-side combine; nested results have one row per owner and day.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.operators.ordering import ranked
from muster.operators.timetable import DAYS, PERIODS, slots

GRADES = (5, 6, 7, 8)  # fixed values: the grades of the school


def domain(spark: SparkSession, name: str, values: Sequence[int]) -> DataFrame:
    """A closed domain as a table."""
    items = F.array(*[F.lit(v).cast("bigint") for v in values])
    return spark.range(1).select(F.explode(items).alias(name))


def group_counts(df: DataFrame, *keys: str, name: str = "n") -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def zero_filled(spark: SparkSession, counts: DataFrame, key: str, values: Sequence[int]) -> DataFrame:
    """Counts over a closed domain, with zeros for values that do not occur."""
    return domain(spark, key, values).join(counts, key, "left").na.fill(0)


def grade_rollup(spark: SparkSession, roster: DataFrame, grades: Sequence[int] = GRADES) -> DataFrame:
    """Per grade: people and number of sections."""
    by_class = group_counts(roster, "grade", "section")
    totals = by_class.groupBy("grade").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("sections"))
    return zero_filled(spark, totals, "grade", grades)


def entities_per_value(spark: SparkSession, blocks: DataFrame, entity: str, value: str, values: Sequence[int]) -> DataFrame:
    """Entities that have a value at least once. Distinct pairs first, then counts."""
    counts = blocks.select(entity, value).distinct().groupBy(value).agg(F.count(F.lit(1)).alias("n"))
    return zero_filled(spark, counts, value, values)


def facet_values(df: DataFrame, array: str, name: str) -> DataFrame:
    return df.select(F.explode(array).alias(name)).distinct()


def category_counts(df: DataFrame, category: str, position: str) -> DataFrame:
    """Count per category that occurs, with the position of its first appearance."""
    return df.groupBy(category).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first_at"))


def weekly_totals(owners: DataFrame, blocks: DataFrame, owner: str = "owner") -> DataFrame:
    """Per owner: blocks, occupied periods, sorted distinct grades and subjects; owners without blocks stay.

    The distinct sets are bounded by the number of grades and subjects and are combined map-side.
    """
    totals = blocks.groupBy(owner).agg(
        F.count(F.lit(1)).alias("lesson_count"),
        F.sum(F.col("period_end") - F.col("period_start") + 1).alias("occupied_periods"),
        F.array_sort(F.collect_set("grade")).alias("grades"),
        F.array_sort(F.collect_set("subject")).alias("subjects"),
    )
    joined = owners.select(owner).join(totals, owner, "left")
    return joined.select(
        owner,
        F.coalesce("lesson_count", F.lit(0)).alias("lesson_count"),
        F.coalesce("occupied_periods", F.lit(0)).alias("occupied_periods"),
        F.coalesce("grades", F.array().cast("array<bigint>")).alias("grades"),
        F.coalesce("subjects", F.array().cast("array<string>")).alias("subjects"),
    )


LESSON_ORDER = ("day_index", "period_start", "period_end", "class_code", "subject")


def weekly_lessons(blocks: DataFrame, tie: Sequence[str], owner: str = "owner") -> DataFrame:
    """Nested lessons in canonical order, one row per owner and day of the week whatever their number.

    The order within a row is that of ``LESSON_ORDER``, then ``tie``; days in order give the week of an owner.
    """
    fields = [*LESSON_ORDER, "grade", "section"]
    order = [F.col(c).alias(f"_o{i}") for i, c in enumerate([*LESSON_ORDER, *tie])]
    item = F.struct(*order, F.struct(*fields).alias("lesson"))
    ordered = F.array_sort(F.collect_list(item)).alias("_items")
    return blocks.groupBy(owner, "day_index").agg(ordered).select(owner, "day_index", F.transform("_items", lambda x: x["lesson"]).alias("lessons"))


def project_nested(df: DataFrame, array: str, fields: Sequence[str]) -> DataFrame:
    """Only the named fields of each array element, elements in the order of those fields."""
    return df.withColumn(array, F.array_sort(F.transform(array, lambda x: F.struct(*[x[f].alias(f) for f in fields]))))


def block_counts(blocks: DataFrame) -> DataFrame:
    """Blocks by grade, by subject and by class in one pass over the blocks."""
    sets = blocks.groupingSets([["grade"], ["subject"], ["class_code"]], "grade", "subject", "class_code")
    counted = sets.agg(F.grouping_id().alias("_g"), F.count(F.lit(1)).alias("n"))
    kind = F.when(F.col("_g") == 3, "grade").when(F.col("_g") == 5, "subject").otherwise("class")
    value = F.coalesce(F.col("grade").cast("string"), "subject", "class_code")
    return counted.select(kind.alias("kind"), value.alias("value"), "n")


def occupied_by_class(blocks: DataFrame) -> DataFrame:
    return group_counts(slots(blocks), "class_code")


def day_period_counts(blocks: DataFrame, days: int = len(DAYS), periods: int = PERIODS) -> DataFrame:
    """Slots per day and period, one column per period, zero where nothing is."""
    counted = (
        slots(blocks)
        .groupBy("day_index")
        .pivot("period", list(range(1, periods + 1)))
        .agg(F.count(F.lit(1)))
        .withColumnsRenamed({str(p): f"p{p}" for p in range(1, periods + 1)})
    )
    all_days = domain(blocks.sparkSession, "day_index", range(days))
    return all_days.join(counted, "day_index", "left").na.fill(0)


def day_totals(blocks: DataFrame, owner: str = "owner") -> DataFrame:
    return blocks.groupBy(owner, "day_index").agg(F.sum(F.col("period_end") - F.col("period_start") + 1).alias("periods"))


def without_blocks(owners: DataFrame, blocks: DataFrame, owner: str = "owner") -> DataFrame:
    return owners.join(blocks.select(owner).distinct(), owner, "left_anti")


def extraction_counts(blocks: DataFrame, owner: str = "owner") -> DataFrame:
    """One row: owners, blocks, occupied periods and double blocks. Grouped by owner first, so that the
    distinct count needs no shuffle of blocks."""
    span = F.col("period_end") - F.col("period_start") + 1
    per_owner = blocks.groupBy(owner).agg(
        F.count(F.lit(1)).alias("b"), F.sum(span).alias("o"), F.count_if(span == 2).alias("d")
    )
    return per_owner.agg(
        F.count(F.lit(1)).alias("owners"),
        F.sum("b").alias("lesson_blocks"),
        F.sum("o").alias("occupied_periods"),
        F.sum("d").alias("double_blocks"),
    )


def many_labels(df: DataFrame, owner: str, label: str) -> DataFrame:
    """Owners printed under more than one label: a row for every label of such an owner, with their number."""
    pairs = df.select(owner, label).distinct()
    several = pairs.groupBy(owner).agg(F.count(F.lit(1)).alias("labels")).filter(F.col("labels") > 1)
    return pairs.join(several, owner)


def ordered_words(words: DataFrame, key: Sequence[str], line: Column, x: str, tie: str, width: float) -> DataFrame:
    """The words of each cell with their ``line``, numbered by height, and their ``rank`` in it from right to left.

    One row per word, however many there are: in order of line and rank they are the text of the cell.
    """
    placed = words.withColumn("line", line)
    return ranked(placed, [*key, "line"], [F.floor(-F.col(x) / width)], [-F.col(x), F.col(tie)], name="rank")


def bounds_of(df: DataFrame, date: str) -> DataFrame:
    return df.agg(F.min(date).alias("range_start"), F.max(date).alias("range_end"), F.count(F.lit(1)).alias("records"))
