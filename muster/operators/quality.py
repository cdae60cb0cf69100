"""Data-quality rules. Each gives the rows that break it; none stops at the first."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import text
from muster.functions.posts import CATEGORY_RULES, DEFAULT_CATEGORY
from muster.operators.ordering import ranked
from muster.operators.sizing import sent_out, settled
from muster.operators.timetable import DAYS, PERIODS, slots

# The closed category domain and the form of cached media paths.
CATEGORIES = tuple(name for name, _ in CATEGORY_RULES) + (DEFAULT_CATEGORY,)
CACHED_PATH = r"^/activity-media/[a-f0-9]+\.(jpg|png|webp)$"
GRADE_RANGE = (5, 8)


def repeated(df: DataFrame, *key: str) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def repeated_names(df: DataFrame, name: str) -> DataFrame:
    """Names that occur more than once, as written and as search keys."""
    raw = repeated(df, name).select(F.lit("name").alias("kind"), F.col(name).alias("value"), "n")
    keyed = df.select(text.normalize(F.col(name)).alias("_key"))
    return raw.unionByName(repeated(keyed, "_key").select(F.lit("searchName").alias("kind"), F.col("_key").alias("value"), "n"))


def expected_counts(df: DataFrame, expected: Mapping[str, tuple[Column, int]]) -> DataFrame:
    """One row per expectation: (aggregate, wanted number)."""
    row = df.agg(*[value.alias(name) for name, (value, _) in expected.items()])
    checks = F.array(
        *[
            F.struct(F.lit(name).alias("check"), F.lit(wanted).cast("bigint").alias("expected"), F.col(name).cast("bigint").alias("actual"))
            for name, (_, wanted) in expected.items()
        ]
    )
    found = row.select(F.explode(checks).alias("c")).select("c.*")
    return found.withColumn("ok", F.col("expected") == F.col("actual"))


def blank(df: DataFrame, name: str) -> DataFrame:
    return df.filter(F.coalesce(text.collapse_spaces(F.col(name)), F.lit("")) == "")


def bad_period_range(df: DataFrame, start: str = "period_start", end: str = "period_end", last: int = PERIODS) -> DataFrame:
    good = (F.col(start) >= 1) & (F.col(start) <= F.col(end)) & (F.col(end) <= last)
    return df.filter(~F.coalesce(good, F.lit(False)))


def double_booked(blocks: DataFrame, entity: str) -> DataFrame:
    """Slots in which an entity has more than one lesson."""
    return repeated(slots(blocks), entity, "day_index", "period")


def double_booked_with(blocks: DataFrame, entity: str, page: str) -> DataFrame:
    """The same, with each contributing page in a row of its own and how often it contributes."""
    per_page = settled(slots(blocks).groupBy(entity, "day_index", "period", page).agg(F.count(F.lit(1)).alias("lessons")))
    per_slot = per_page.groupBy(entity, "day_index", "period").agg(F.sum("lessons").alias("n")).filter(F.col("n") > 1)
    return per_page.join(sent_out(per_slot), [entity, "day_index", "period"])


def incomplete(df: DataFrame, required: Sequence[str], grade: str = "grade") -> DataFrame:
    """Records that lack a required value, or whose grade is outside the domain."""
    missing = F.array_compact(
        F.array(*[F.when(F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", F.lit(c)) for c in required])
    )
    issue = (
        F.when(F.size("_missing") > 0, F.concat(F.lit("missing "), F.array_join("_missing", ",")))
        .when(~F.col(grade).between(*GRADE_RANGE), "grade outside domain")
    )
    return df.withColumn("_missing", missing).withColumn("issue", issue).filter(F.col("issue").isNotNull()).drop("_missing")


def check_completeness(checks: DataFrame, entity: str, expected: int) -> DataFrame:
    """One row: are there as many checks as entities times the expected number?"""
    per = checks.groupBy(entity).agg(F.count(F.lit(1)).alias("n"))
    row = per.agg(F.count(F.lit(1)).alias("entities"), F.coalesce(F.sum("n"), F.lit(0)).alias("performed"))
    return row.withColumn("expected", F.col("entities") * expected).withColumn("complete", F.col("performed") == F.col("expected"))


def archive_issues(df: DataFrame, start: str, end: str, categories: Sequence[str] = CATEGORIES) -> DataFrame:
    """Rule breaks of archive records (id, issue): text, dates, categories, media, repeated ids."""
    text_missing = (F.coalesce("title", F.lit("")) == "") | (F.coalesce("description", F.lit("")) == "")
    in_range = F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end)))
    cached_bad = F.exists("media", lambda m: m["localPath"].isNotNull() & ~m["localPath"].rlike(CACHED_PATH))
    rules = [
        (text_missing, "missing text"),
        (~F.coalesce(in_range, F.lit(False)), "date outside range"),
        (~F.col("category").isin(*categories), "unknown category"),
        (F.exists("media", lambda m: ~m["url"].rlike("^https://")), "media not https"),
        (cached_bad, "bad cached path"),
    ]
    found = F.array_compact(F.array(*[F.when(rule, F.lit(name)) for rule, name in rules]))
    rows = df.select("id", F.explode(found).alias("issue"))
    return rows.unionByName(repeated(df, "id").select("id", F.lit("repeated id").alias("issue")))


def sequence_breaks(df: DataFrame, sheet: str, row: str, number: str, width: int = 10_000) -> DataFrame:
    """Rows of a sheet whose number is not their place in it; ``width`` rows of a sheet go together."""
    placed = ranked(df, [sheet], [F.floor(F.col(row) / width)], [F.col(row)], name="expected")
    return placed.filter(F.col("expected") != F.col(number))


def order_breaks(df: DataFrame, position: str, key: str, width: int = 100_000) -> DataFrame:
    """Records of one list that are not at the place their key says (1..n by position)."""
    placed = ranked(df, [], [F.floor(F.col(position) / width)], [F.col(position)], name="place")
    return placed.filter(F.col("place") != F.col(key))


def all_slots(days: int = len(DAYS), periods: int = PERIODS) -> int:
    return days * periods
