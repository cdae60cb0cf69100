"""Where two datasets differ: digests of ranges of an integer key, level by level.

A node of the tree is a range of keys. Its digest is made of the number of its rows and of sums of row hashes, so a range of a
higher level is the sum of the ranges below it: rows are hashed and summed once, into the smallest ranges, and all higher levels
come from those few sums. Both sides meet range by range, not row by row; only ranges that differ are read again for their rows.

Rows without a key form one range of their own, whose bounds are null.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.functions import text
from muster.operators.reconcile import PARTS, diff_records, digest_of, hash_part
from muster.operators.sizing import sent_out, settled

#: Keys of a smallest range, ranges in one of the next level, and levels.
WIDTH, FAN, LEVELS = 1 << 16, 16, 4
_SUMS = [f"p{i}" for i in range(PARTS)]


def range_start(key: Column, width: int) -> Column:
    """The lowest key of the range that a key lies in, also below zero."""
    return key - F.pmod(key, F.lit(width))


def range_sums(df: DataFrame, key: str, fields: Sequence[str], width: int = WIDTH) -> DataFrame:
    """(first, records, p0, p1, …) of every smallest range: one aggregate that combines map-side."""
    rows = df.select(range_start(F.col(key), width).alias("first"), F.sha2(text.canonical_json(*fields), 256).alias("_h"))
    return rows.groupBy("first").agg(
        F.count(F.lit(1)).alias("records"), *[F.sum(hash_part(F.col("_h"), i)).alias(p) for i, p in enumerate(_SUMS)]
    )


def differing_ranges(
    source: DataFrame, candidate: DataFrame, key: str, fields: Sequence[str], width: int = WIDTH, fan: int = FAN, levels: int = LEVELS
) -> DataFrame:
    """Every range, of every level, whose rows are not the same on both sides, with the records and the digest of each side."""
    both = range_sums(source, key, fields, width).withColumn("_s", F.lit(True)).unionByName(
        range_sums(candidate, key, fields, width).withColumn("_s", F.lit(False))
    )
    widths = [width * fan**level for level in range(levels)]
    nodes = [
        F.struct(F.lit(level).alias("level"), range_start(F.col("first"), w).alias("first"), F.lit(w - 1).cast("bigint").alias("reach"))
        for level, w in enumerate(widths)
    ]
    summed = (
        both.withColumn("_node", F.explode(F.array(*nodes))).groupBy("_node.level", "_node.first", "_node.reach")
        .agg(*[F.sum(F.when(F.col("_s") == side, F.col(c))).alias(f"{c}_{side}") for side in (True, False) for c in ("records", *_SUMS)])
    )

    def records(side: bool) -> Column:
        return F.coalesce(F.col(f"records_{side}"), F.lit(0))

    told = summed.select(
        "level", "first", (F.col("first") + F.col("reach")).alias("last"),
        records(True).alias("source_records"), records(False).alias("candidate_records"),
        *[digest_of(records(side), [F.col(f"{p}_{side}") for p in _SUMS]).alias(f"{name}_digest") for side, name in ((True, "source"), (False, "candidate"))],
    )
    return told.filter(F.col("source_digest") != F.col("candidate_digest"))


def diff_in_ranges(source: DataFrame, candidate: DataFrame, key: str, fields: Sequence[str], width: int = WIDTH) -> DataFrame:
    """The differing fields of all rows, as ``diff_records`` gives them, from the rows of the ranges that differ alone.

    Rows whose key is null meet no row and are told as missing and unexpected ones, where that range differs.
    """
    found = settled(differing_ranges(source, candidate, key, [key, *fields], width, levels=1).select(F.col("first").alias("_first")))

    def inside(df: DataFrame) -> DataFrame:
        return df.join(sent_out(found), range_start(df[key], width).eqNullSafe(F.col("_first")), "left_semi")

    return diff_records(inside(source), inside(candidate), key, fields)
