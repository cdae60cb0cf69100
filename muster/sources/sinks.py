"""Reports and guarded publishing. Data is written to a new path, so readers never see half of it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from muster.operators.reconcile import dataset_digest
from muster.operators.sizing import settled


def write_report(report: DataFrame, path: str) -> None:
    """A report as JSON documents, nulls kept."""
    report.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def publish_if_clean(df: DataFrame, issues: DataFrame, data_path: str, report_path: str) -> bool:
    """Write the issues as a report in any case, and the data only when there are none."""
    found = settled(issues)
    write_report(found, report_path)
    clean = found.isEmpty()
    if clean:
        df.write.mode("errorifexists").parquet(data_path)
    return clean


def publish_if_changed(new: DataFrame, old: DataFrame, fields: Sequence[str], path: str) -> bool:
    """Write the new version only when its content differs from the old one; decided by digests."""
    tagged = dataset_digest(new, fields).unionByName(dataset_digest(old, fields))
    changed = tagged.agg(F.count_distinct("records", "digest").alias("n")).head()["n"] > 1
    if changed:
        new.write.mode("errorifexists").parquet(path)
    return changed
