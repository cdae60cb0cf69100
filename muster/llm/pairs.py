"""Confirming pairs of sets, one row a pair, whatever the number of pairs that one set is in."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm import flat
from muster.llm.tables import kept

#: A set goes out in one copy for so many of its pairs.
SHARE = 512


def similar(num: int, den: int) -> Callable[..., Column]:
    """Whether two sets, as the bytes of their sorted 64-bit elements, have a Jaccard similarity of num / den or more."""

    @F.arrow_udf("boolean")
    def similar_sets(left: pa.Array, right: pa.Array) -> pa.Array:
        out = []
        for a, b in zip(left, right):
            x, y = np.frombuffer(a.as_py(), dtype=np.uint64), np.frombuffer(b.as_py(), dtype=np.uint64)
            if len(x) > len(y):
                x, y = y, x
            both = int((y[np.minimum(np.searchsorted(y, x), len(y) - 1)] == x).sum()) if len(x) else 0
            out.append(both > 0 and den * both >= num * (len(x) + len(y) - both))
        flat.give_back()
        return pa.array(out, pa.bool_())

    return similar_sets


def confirmed(pairs: DataFrame, sets_of: Callable[[DataFrame], DataFrame], num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose whole sets are similar.

    ``sets_of`` takes (node, n), the nodes that are asked for, and gives (node, n, set). Every end of a pair is a row of its own; a
    node with many pairs is split by a salt of the pair, and its set goes out once for each salt. Both sets of a pair
    meet by pair. Pairs that stand twice and sets that stand twice give one row.
    """
    pairs = kept(pairs.select("a", "b"), "pairs")
    side = F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(True).alias("first")), F.struct(F.col("b").alias("node"), F.lit(False).alias("first"))))
    ends = pairs.select("a", "b", side.alias("_e")).select("a", "b", "_e.node", "_e.first")
    asked = kept(ends.groupBy("node").agg(F.count(F.lit(1)).alias("n")), "asked")
    salted = (
        ends.join(asked.select(F.col("node").alias("_of"), "n"), F.col("node") == F.col("_of"))
        .select("a", "b", "node", "first", F.pmod(F.xxhash64("a", "b"), F.expr(f"1 + n DIV {SHARE}")).alias("salt"))
    )
    given = sets_of(asked).select(F.col("node").alias("_node"), "set", F.explode(F.expr(f"sequence(0L, n DIV {SHARE})")).alias("_salt"))
    met = salted.join(given, (F.col("node") == F.col("_node")) & (F.col("salt") == F.col("_salt"))).select("a", "b", "first", F.col("set").alias("x"))
    pair = Window.partitionBy("a", "b").orderBy(F.col("first").desc())  # two rows, or as many as a repeated set has copies
    other = F.when(~F.lead("first").over(pair), F.lead("x").over(pair))
    met = met.withColumn("y", other).where("first AND y IS NOT NULL")
    return met.where(similar(num, den)("x", "y")).select("a", "b").distinct()
