"""Rosters from raw sheet cells."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.functions import text


def sheet_rows(cells: DataFrame) -> DataFrame:
    """One row per sheet row with a whole number in column 0; column 1 is the name. Blank names are kept here."""
    rows = cells.groupBy("sheet", "row").agg(
        F.max(F.when(F.col("col") == 0, F.col("num"))).alias("_number"), F.max(F.when(F.col("col") == 1, F.col("str"))).alias("name")
    )
    return rows.filter(F.col("_number") == F.floor("_number")).select(
        "sheet", "row", F.col("_number").cast("bigint").alias("number"), F.coalesce("name", F.lit("")).alias("name")
    )


def is_blank(name: str = "name"):
    return text.collapse_spaces(F.col(name)) == ""


def roster_from_cells(cells: DataFrame, year: str) -> DataFrame:
    """Roster records with lineage; the class comes from the sheet name, and rows with a blank name are left out."""
    rows = sheet_rows(cells).filter(~is_blank())
    parsed = rows.withColumn("_class", text.class_from_header(F.lit(""), F.col("sheet")))
    return parsed.select(
        text.record_id(F.lit(year), F.col("_class.grade"), F.col("_class.section"), F.col("number")).alias("id"),
        "name",
        F.col("_class.grade").alias("grade"),
        F.col("_class.section").alias("section"),
        F.col("number").alias("roster_order"),
        F.col("sheet").alias("source_sheet"),
        (F.col("row") + 1).alias("source_row"),
    )


def import_report(cells: DataFrame) -> DataFrame:
    """One row of counts over all sheets. Per-sheet counts come first, so sheets are counted without a distinct."""
    rows = sheet_rows(cells)
    per_sheet = rows.groupBy("sheet").agg(
        F.count_if(~is_blank()).alias("r"),
        F.count_if(is_blank()).alias("b"),
        F.count_if(~is_blank() & text.has_space_run(F.col("name"))).alias("f"),
    )
    return per_sheet.agg(
        F.count(F.lit(1)).alias("sheets"),
        F.sum("r").alias("records"),
        F.count_if(F.col("r") > 0).alias("groups"),
        F.sum("b").alias("skipped_blank"),
        F.sum("f").alias("formatting_issues"),
    )


def formatting_issues(cells: DataFrame) -> DataFrame:
    """Where names have runs of blanks, as printed row numbers."""
    rows = sheet_rows(cells).filter(~is_blank() & text.has_space_run(F.col("name")))
    return rows.select("sheet", (F.col("row") + 1).alias("source_row"))


def import_report_rows(cells: DataFrame, year: str) -> DataFrame:
    """The whole import report as rows (part, name, grade, section, source_row, n), however many issues there are.

    Parts are ``count`` (the counts of ``import_report`` by name), ``grade`` and ``class`` (records of each), and ``issue`` (sheet
    and printed row of each name with a run of blanks). What a part has no use for is null.
    """
    roster = roster_from_cells(cells, year)
    counts = import_report(cells)
    named = F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.coalesce(c, F.lit(0)).alias("n")) for c in counts.columns]))
    classes = roster.groupBy("grade", "section").agg(F.count(F.lit(1)).alias("n"))
    grades = classes.groupBy("grade").agg(F.sum("n").alias("n"))

    def rows(df: DataFrame, part: str) -> DataFrame:
        kinds = {"name": "string", "grade": "bigint", "section": "bigint", "source_row": "bigint", "n": "bigint"}
        values = [(F.col(c) if c in df.columns else F.lit(None)).cast(kind).alias(c) for c, kind in kinds.items()]
        return df.select(F.lit(part).alias("part"), *values)

    issues = formatting_issues(cells).withColumnRenamed("sheet", "name")
    parts = {"count": counts.select(named.alias("_c")).select("_c.*"), "grade": grades, "class": classes, "issue": issues}
    frames = [rows(df, part) for part, df in parts.items()]
    return reduce(DataFrame.unionByName, frames)
