"""Incremental runs: the archive and the status log as streams.

State lives in versioned tables, one folder per batch, so a batch that is run again after a failure
writes the same version again and readers only see finished ones. A version holds only the rows that its
batch touched; now and then all of them are put together and the older folders go.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from muster.operators.archive import merge_archive
from muster.operators.ordering import neighbour
from muster.operators.sizing import settled
from muster.operators.status import change_points

_DONE = "_SUCCESS"
COMPACT = 20


class VersionedTable:
    """A table kept as numbered folders below one path: rows by ``key``, of which the newest version counts.

    Version -1 is the table before any batch. After every ``COMPACT`` versions a batch also writes the whole
    table (``w`` folders), from which reading then starts.
    """

    def __init__(self, spark: SparkSession, path: str, schema: str, key: Sequence[str] = ("id",)) -> None:
        self._spark, self._path, self._schema, self._key = spark, path.rstrip("/"), schema, list(key)

    def _folder(self, version: int, kind: str = "v") -> str:
        return f"{self._path}/{kind}{version + 1:012d}"

    def _system(self, path: str):
        place = self._spark._jvm.org.apache.hadoop.fs.Path(path)  # type: ignore[union-attr]
        return place, place.getFileSystem(self._spark._jsc.hadoopConfiguration())

    def _finished(self, kind: str = "v") -> list[int]:
        pattern, system = self._system(f"{self._path}/{kind}*/{_DONE}")
        return sorted(int(s.getPath().getParent().getName()[1:]) - 1 for s in system.globStatus(pattern) or [])

    def _parts(self, before: int | None) -> list[tuple[int, str]]:
        """Version and folder of what the table is read from, the whole table first."""
        fits = lambda v: before is None or v < before
        wholes = [v for v in self._finished("w") if fits(v)][-1:]
        newer = [v for v in self._finished() if fits(v) and (not wholes or v > wholes[0])]
        return [(v, self._folder(v, "w")) for v in wholes] + [(v, self._folder(v)) for v in newer]

    def read(self, before: int | None = None) -> DataFrame:
        """The table after the newest finished version, or the newest older than ``before``."""
        parts = self._parts(before)
        if not parts:
            return self._spark.createDataFrame([], self._schema)
        frames = [self._spark.read.schema(self._schema).parquet(path).withColumn("_v", F.lit(v)) for v, path in parts]
        if len(frames) == 1:
            return frames[0].drop("_v")
        rows = reduce(DataFrame.unionByName, frames)
        rest = [c for c in rows.columns if c not in (*self._key, "_v")]
        newest = rows.groupBy(*self._key).agg(F.max_by(F.struct(*rest), "_v").alias("_r"))
        return newest.select(*self._key, "_r.*").select(*rows.drop("_v").columns)

    def write(self, df: DataFrame, version: int = -1) -> None:
        """The rows that a batch touched; now and then also the whole table, after which older folders are removed."""
        df.write.mode("overwrite").parquet(self._folder(version))
        if len(self._parts(version + 1)) > COMPACT:
            self.read(before=version + 1).write.mode("overwrite").parquet(self._folder(version, "w"))
            # the batch may be run again and then reads the table before it: the last whole one and what follows stay
            for last in [v for v in self._finished("w") if v < version][-1:]:
                gone = [self._folder(v) for v in self._finished() if v <= last] + [self._folder(v, "w") for v in self._finished("w") if v < last]
                for path in gone:
                    place, system = self._system(path)
                    system.delete(place, True)


def sync_archive(
    snapshots: DataFrame, archive: VersionedTable, to_records: Callable[[DataFrame], DataFrame], start: str, checkpoint: str
) -> StreamingQuery:
    """Run all waiting snapshots into the archive; each batch is one new version with the rows it changed.

    A batch without usable posts, or that changes nothing, writes no version and leaves the archive as it is.
    """

    def apply(batch: DataFrame, version: int) -> None:
        records = settled(to_records(batch))
        if records.isEmpty():
            return
        current = archive.read(before=version)
        changed = settled(merge_archive(current, records, start).filter(F.col("change") != "unchanged"))
        if not changed.isEmpty():
            archive.write(changed.drop("change"), version)

    return (
        snapshots.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def sync_once(archive: DataFrame, records: DataFrame, start: str) -> DataFrame:
    """The same for one batch without a stream; fails when there are no usable posts."""
    if records.isEmpty():
        raise ValueError("no posts could be read from the snapshots; the archive is left as it is")
    return merge_archive(archive, records, start)


def track_status(
    states: DataFrame, last: VersionedTable, log: str, key: Sequence[str], bucket: Column, order: Sequence[str], state: str,
    checkpoint: str,
) -> StreamingQuery:
    """Append change points of a stream of states to ``log``, carrying the last state per key over batches.

    ``last`` holds one row per key: the key, the order columns and the state; a batch writes the keys it touched.
    The rows themselves are kept below the log too. A key with rows older than its last state gets all its
    change points anew from them, and ``change_log`` then leaves out what was written for it before.
    """
    columns = [*key, *order, state]

    def apply(batch: DataFrame, version: int) -> None:
        rows = settled(batch.select(*columns))
        rows.write.mode("overwrite").parquet(f"{log}/rows/batch={version}")
        before = settled(last.read(before=version).join(rows.select(*key).distinct(), list(key), "left_semi"))
        seen = before.select(*key, F.struct(*order).alias("_last"))
        late = settled(rows.join(seen, list(key)).filter(F.struct(*order) < F.col("_last")).select(*key).distinct())
        both = rows.withColumn("_new", F.lit(True)).unionByName(before.select(*columns).withColumn("_new", F.lit(False)))
        placed = neighbour(both.join(late, list(key), "left_anti"), key, bucket, order, state, "previous")
        changed = placed.filter(F.col("_new") & ~F.col("previous").eqNullSafe(F.col(state))).select(*columns, "previous")
        changed = changed.withColumn("whole", F.lit(False))
        if not late.isEmpty():
            history = batch.sparkSession.read.schema(rows.schema).parquet(f"{log}/rows").filter(F.col("batch") <= version)
            again = change_points(history.select(*columns).join(late, list(key), "left_semi"), key, bucket, order, state)
            changed = changed.unionByName(again.select(*columns, "previous").withColumn("whole", F.lit(True)))
        changed.write.mode("overwrite").parquet(f"{log}/changes/batch={version}")
        newest = F.max_by(F.struct(*order, state), F.struct(*order)).alias("_s")
        last.write(rows.unionByName(before.select(*columns)).groupBy(*key).agg(newest).select(*key, "_s.*"), version)

    return (
        states.writeStream.foreachBatch(apply)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def change_log(spark: SparkSession, log: str, key: Sequence[str]) -> DataFrame:
    """The change points of a log: of a key that was written anew only what came with and after that."""
    rows = spark.read.parquet(f"{log}/changes")
    anew = rows.filter("whole").groupBy(*key).agg(F.max("batch").alias("_from"))
    valid = rows.join(anew, list(key), "left").filter(F.col("_from").isNull() | (F.col("batch") >= F.col("_from")))
    return valid.drop("_from", "whole", "batch")
