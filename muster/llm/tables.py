"""Reading the corpus tables and keeping intermediate tables in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.session import fresh_path, use_utc

#: A word, as all operators of this package take it.
WORD = r"[^\x20\x09-\x0D]+"


#: Default limits of Arrow batches, and those that serve long texts.
_BATCHES = {
    "spark.sql.execution.arrow.maxRecordsPerBatch": ("10000", "2000"),
    "spark.sql.execution.arrow.maxBytesPerBatch": ("67108864b", "8m"),
}


def bounded_batches(spark: SparkSession) -> None:
    """Texts go to Python workers in batches of at most about 8 MB, so that the memory of a worker does not depend on
    how long they are. Limits that the session was given stay."""
    for name, (default, ours) in _BATCHES.items():
        if spark.conf.get(name, default) == default:
            spark.conf.set(name, ours)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    """The whole table of documents."""
    use_utc(spark)
    return spark.read.parquet(f"{folder}/documents.parquet")


#: Whether Spark removes the shuffle files of a query as soon as it has ended.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def kept(df: DataFrame, label: str, path: str | None = None, **options: int) -> DataFrame:
    """Written to the shared work folder and read again: computed once, cut off from its lineage. The files of its shuffles
    go once it is written, so the disk holds those of one step, not of all steps since the driver last collected garbage. ``options`` go to the writer."""
    spark = df.sparkSession
    path = path or fresh_path(spark, label)
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def released(spark: SparkSession, paths: list[str]) -> None:
    """Empties kept tables that nothing reads any more."""
    for path in paths:
        spark.range(0).write.mode("overwrite").parquet(path)


def n_words(text: str = "text"):
    """The number of words of a text; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("bigint")
