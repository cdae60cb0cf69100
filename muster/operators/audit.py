"""The audit of a timetable against a second extraction of it, as one long report.

Both sides are reduced once, to one row per owner; the source also to one row per class and slot. All counts, digests,
discrepancies and warnings come from these two small tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import text
from muster.operators.sizing import settled
from muster.operators.timetable import slots, unassigned_slots

LESSON = ("day_index", "period_start", "period_end", "class_code", "subject")
#: Hex digits of a lesson's digest that are summed; sums of 10 ** 20 lessons fit a decimal.
_DIGITS = 12
_SIDES = {"source": 0, "candidate": 1}


def owner_records(source: DataFrame, candidate: DataFrame, owners: DataFrame) -> DataFrame:
    """One row per owner of either side or of ``owners`` (owner, name): of each side the number of blocks, occupied periods
    and double periods and a digest of the multiset of lessons, null for a side without blocks."""
    lesson = F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in LESSON]), 256)
    number = F.conv(F.substring(lesson, 1, _DIGITS), 16, 10).cast("decimal(38,0)")
    columns = ["owner", *LESSON]
    both = source.select(*columns, F.lit(0).alias("_side")).unionByName(candidate.select(*columns, F.lit(1).alias("_side")))
    both = both.select("owner", "_side", text.occupied(F.col("period_start"), F.col("period_end")).alias("_periods"), number.alias("_number"))
    values = []
    for name, side in _SIDES.items():
        here = F.col("_side") == side
        values += [
            F.count(F.when(here, 1)).alias(f"{name}_blocks"), F.sum(F.when(here, F.col("_periods"))).alias(f"{name}_occupied"),
            F.count(F.when(here & (F.col("_periods") == 2), 1)).alias(f"{name}_doubles"), F.sum(F.when(here, F.col("_number"))).alias(f"{name}_lessons"),
        ]
    reduced = both.groupBy("owner").agg(*values)
    return owners.select("owner", "name", F.lit(True).alias("listed")).join(reduced, "owner", "full_outer")


def class_slots(source: DataFrame, subject: str) -> DataFrame:
    """One row per class and slot of the source: lessons in it, its first and last owner, whether one is of the subject."""
    return slots(source).groupBy("class_code", "day_index", "period").agg(
        F.count(F.lit(1)).alias("lessons"), F.min("owner").alias("first"), F.max("owner").alias("last"), F.max(F.col("subject") == subject).alias("has_subject")
    )


def _row(part: str, kind: str, key: Column, value: Column) -> Column:
    return F.struct(F.lit(part).alias("part"), F.lit(kind).alias("type"), key.cast("string").alias("key"), value.cast("string").alias("value"))


def _listed(df: DataFrame, *rules: tuple[Column, Column]) -> DataFrame:
    """The rows of all rules that hold, out of one pass over ``df``."""
    found = F.array_compact(F.array(*[F.when(rule, row) for rule, row in rules]))
    return df.select(F.explode(found).alias("_r")).select("_r.*")


def audit_report(source: DataFrame, candidate: DataFrame, owners: DataFrame, subject: str) -> DataFrame:
    """(part, type, key, value) of the parts result, count, digest, discrepancy and warning.

    Discrepancies: an owner with lessons on one side only (missingRecord, unexpectedRecord), and of owners with lessons on both each field
    that differs (recordMismatch). Warnings do not count against the result: owners without lessons, names made of single letters, slots
    of the week without a lesson for a class, classes without the subject, slots in which a class has several lessons.
    """
    records = settled(owner_records(source, candidate, owners))
    week = settled(class_slots(source, subject))
    owner, both = F.col("owner"), (F.col("source_blocks") > 0) & (F.col("candidate_blocks") > 0)

    def differs(field: str) -> tuple[Column, Column]:
        a, b = F.col(f"source_{field}").cast("string"), F.col(f"candidate_{field}").cast("string")
        return both & ~a.eqNullSafe(b), _row("discrepancy", "recordMismatch", F.concat(owner.cast("string"), F.lit(f".{field}")), F.concat(a, F.lit(" <> "), b))

    none = F.lit("")
    discrepancies = settled(_listed(
        records,
        ((F.col("source_blocks") > 0) & (F.col("candidate_blocks") == 0), _row("discrepancy", "missingRecord", owner, none)),
        ((F.col("source_blocks") == 0) & (F.col("candidate_blocks") > 0), _row("discrepancy", "unexpectedRecord", owner, none)),
        *[differs(f) for f in ("blocks", "occupied", "doubles", "lessons")],
    ))
    totals = records.agg(
        F.count(F.when(F.col("listed"), 1)).alias("owners"), F.count(F.when(F.col("source_blocks") > 0, 1)).alias("records"),
        *[F.coalesce(F.sum(f"{side}_{f}"), F.lit(0)).alias(f"{side}_{f}") for side in _SIDES for f in ("blocks", "occupied", "doubles", "lessons")],
    )
    counted = _listed(
        totals,
        *[(F.lit(True), _row("count", name, none, F.col(column))) for name, column in (
            ("owners", "owners"), ("records", "records"), ("lessonBlocks", "source_blocks"), ("occupiedPeriods", "source_occupied"), ("doublePeriodBlocks", "source_doubles"),
        )],
        *[(F.lit(True), _row("digest", side, none, F.col(f"{side}_lessons"))) for side in _SIDES],
    )
    result = discrepancies.agg(F.count(F.lit(1)).alias("n")).select(_row("result", "ok", none, F.col("n") == 0).alias("_r")).select("_r.*")
    slot = F.concat_ws(" ", "class_code", "day_index", "period")
    taken = week.select("class_code", "day_index", F.col("period").alias("period_start"), F.col("period").alias("period_end"))
    without = week.groupBy("class_code").agg(F.max("has_subject").alias("_has"))
    warnings = [
        _listed(
            records,
            (F.col("listed") & (F.coalesce("source_blocks", F.lit(0)) == 0), _row("warning", "blankSchedule", owner, none)),
            (F.col("listed") & text.is_placeholder(F.col("name"), 2), _row("warning", "placeholderName", owner, F.col("name"))),
        ),
        _listed(unassigned_slots(taken), (F.lit(True), _row("warning", "unassignedClassPeriod", slot, none))),
        _listed(without, (~F.col("_has"), _row("warning", "classWithoutSubject", F.col("class_code"), F.lit(subject)))),
        _listed(week, (F.col("lessons") > 1, _row("warning", "sourceClassConflict", slot, F.concat_ws(" ", "lessons", "first", "last")))),
    ]
    report = result.unionByName(counted).unionByName(discrepancies)
    for more in warnings:
        report = report.unionByName(more)
    return report
