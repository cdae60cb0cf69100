"""Mixing sources to target weights by entropy balancing.

Each source has a target number of words. Among all document rates from 0 to ``MOST`` that meet it, those nearest
to 1 in relative entropy are exponentially tilted: ``rate = min(MOST, exp(tilt * size / mean size of the source))``.
The tilts maximize the convex dual, one number per source; Newton steps kept inside a shrinking bracket find
them. Every step is one aggregation over a histogram of sizes per source, which is built from the
documents once, so a hot source costs one row per distinct size. Rates are rounded to copies from the largest
size of a source down, and the words that rounding leaves are carried on to the next size, so the words taken
come within about one short document of the target. Inside one size the documents that
get one copy more are chosen by hash; they are numbered in buckets, so a hot size is split too.

``target_words`` shares out the targets: weights repeat over the sources in order of code point, null last; no
target exceeds ``cap`` times its source, and what is above is shared again by weight.

Defined results: a null text has size 0. Documents of size 0 have rate 1, get one copy and take no words. An
empty table gives an empty result. A null source is a source of its own. Repeated rows are documents of their own in
``mix``; in ``apply_mix`` rows that share an id share the least number of copies of theirs. Only the id, the
source and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.tables import kept, n_words
from muster.operators.ordering import ranked

WEIGHTS = (3, 1, 2)
SHARE = 1.5
CAP = 2.0
MOST = 2.0
STEPS = 40
TOLERANCE = 1e-9
#: Documents of one source and size are numbered in so many parts.
PARTS = 64


def target_words(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(source, source_size) with ``target``: filled up evenly by weight, no target over ``cap`` times its source.

    Sources fill up in order of how much a unit of weight may give them; the level at which all words are
    given out follows from running sums in this order. One row per source.
    """
    one = Window.partitionBy(F.lit(0))
    named = sizes.withColumn("_at", F.row_number().over(one.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_at") % len(weights) + 1).cast("int"))
    most = F.col("source_size") * F.lit(cap)
    filled = one.orderBy("_full", "_at")
    lines = (
        named.withColumn("_w", weight)
        .withColumn("_full", most / F.col("_w"))
        .withColumn("_total", F.sum("source_size").over(one) * F.lit(share))
        .withColumn("_below", F.coalesce(F.sum(most).over(filled.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("_rest", F.sum("_w").over(filled.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("_level", (F.col("_total") - F.col("_below")) / F.col("_rest"))
    )
    reached = F.when(F.col("_level") <= F.col("_full"), F.struct("_full", "_at", "_level"))
    level = F.min(reached).over(one)["_level"]  # of the first source that is not filled up
    return lines.withColumn("_reached", level).select(
        "source", "source_size", F.when(F.col("_full") <= F.col("_reached"), most).otherwise(
            F.coalesce(F.col("_w") * F.col("_reached"), most)).alias("target"),
    )


def _same(left: str, right: str, *names: str):
    condition = F.lit(True)
    for name in names:
        condition = condition & F.col(f"{left}.{name}").eqNullSafe(F.col(f"{right}.{name}"))
    return condition


def _rate(most: float):
    return F.least(F.lit(most), F.exp(F.least(F.col("tilt") * F.col("size") / F.col("mean"), F.lit(50.0))))


def tilts(cells: DataFrame, goals: DataFrame, most: float = MOST, steps: int = STEPS) -> DataFrame:
    """(source, mean, tilt): the maximum of each source's dual, by distributed Newton steps inside a bracket.

    ``cells`` has (source, size, n) with sizes above 0, ``goals`` (source, source_size, target). The gradient of
    the dual is the target less the words at the present rates, its curvature the derivative of the words;
    both are sums over the cells. A step that leaves the bracket is replaced by its middle. A target of ``most``
    times the source has no finite tilt and takes the upper end, where every rate is ``most``.
    """
    means = cells.groupBy("source").agg(
        (F.sum(F.col("n") * F.col("size")) / F.sum("n")).alias("mean"), F.min("size").alias("least")
    )
    unit = F.col("mean") / F.col("least")
    whole = F.col("target") >= F.col("source_size") * F.lit(most * (1 - 1e-12))
    high, low = unit * F.lit(1.0001 * math.log(most)), unit * F.lit(-50.0)
    state = kept(
        goals.alias("g").join(means.alias("m"), _same("g", "m", "source")).select(
            "g.source", "target", "mean", F.when(whole, high).otherwise(F.lit(0.0)).alias("tilt"),
            low.alias("low"), high.alias("high"), whole.alias("done"),
        ),
        "tilts",
    )
    words = F.col("n") * F.col("size") * _rate(most)
    slope = F.when(_rate(most) < most, words * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
    for _ in range(steps):
        sums = (
            cells.alias("c").join(state.where("NOT done").alias("s"), _same("c", "s", "source"))
            .select("c.source", "size", "n", "mean", "tilt")
            .groupBy("source").agg(F.sum(words).alias("words"), F.sum(slope).alias("slope"))
        )
        gap = F.col("words") - F.col("target")
        settled = F.col("done") | (F.abs(gap) <= F.lit(TOLERANCE) * F.col("target"))
        new_low = F.when(~F.col("done") & (gap < 0), F.col("tilt")).otherwise(F.col("low"))
        new_high = F.when(~F.col("done") & (gap > 0), F.col("tilt")).otherwise(F.col("high"))
        newton = F.col("tilt") - gap / F.nullif(F.col("slope"), F.lit(0.0))
        inside = (newton > new_low) & (newton < new_high)
        state = kept(
            state.alias("s").join(sums.alias("w"), _same("s", "w", "source"), "left").select(
                "s.source", "target", "mean",
                F.when(settled, F.col("tilt")).when(inside, newton).otherwise((new_low + new_high) / 2).alias("tilt"),
                new_low.alias("low"), new_high.alias("high"), settled.alias("done"),
            ),
            "tilts",
        )
        if state.where("NOT done").isEmpty():
            break
    return state.select("source", "mean", "tilt")


def _rounded(cells: pd.DataFrame, most: float) -> pd.DataFrame:
    """The copies of all documents of one size, from the largest size down; what rounding leaves is carried on.

    One group is the histogram of one source, with one row per distinct size.
    """
    cells = cells.sort_values("size", ascending=False)
    carry, copies = 0.0, []
    for n, size, rate in zip(cells["n"], cells["size"], cells["rate"]):
        wanted = n * rate + (carry / size if size else 0.0)
        copies.append(int(min(max(math.floor(wanted + 0.5), 0), n * int(most))))
        carry += (n * rate - copies[-1]) * size
    return cells.assign(_all=copies)


def mix(
    docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text",
    weights: Sequence[int] = WEIGHTS, share: float = SHARE, cap: float = CAP, most: float = MOST,
) -> DataFrame:
    """(id, size, source_size, target, rate, copies, taken) of every document."""
    slim = docs.select(F.col(doc_id).alias("_id"), F.col(source).alias("source"), n_words(text).alias("size"))
    histogram = kept(slim.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "sizes")
    goals = kept(
        target_words(histogram.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), weights, share, cap),
        "targets",
    )
    found = tilts(histogram.where("size > 0"), goals, most)
    rated = (
        histogram.alias("h").join(goals.alias("g"), _same("h", "g", "source"))
        .select("h.source", "size", "n", "source_size", "target").alias("r")
        .join(found.alias("t"), _same("r", "t", "source"), "left")
        .select("r.source", "size", "n", "source_size", "target",
                F.when(F.col("size") == 0, F.lit(1.0)).otherwise(_rate(most)).alias("rate"))
    )
    cells = rated.groupBy("source").applyInPandas(
        lambda cells: _rounded(cells, most), f"{', '.join(f'{c} {t}' for c, t in rated.dtypes)}, _all bigint"
    )
    part = F.pmod(F.xxhash64("_id"), F.lit(PARTS))
    numbered = ranked(slim, ["source", "size"], [part], [F.xxhash64("_id", F.lit(1)), F.col("_id")], "_place")
    base = F.floor(F.col("_all") / F.col("n"))
    copies = F.least(base + (F.col("_place") <= F.col("_all") - base * F.col("n")).cast("bigint"), F.lit(int(most))).cast("bigint")
    return (
        numbered.alias("d").join(cells.alias("c"), _same("d", "c", "source", "size"))
        .select(F.col("_id").alias(doc_id), F.col("d.size").alias("size"), "source_size", "target", "rate", copies.alias("copies"))
        .withColumn("taken", F.col("copies") * F.col("size"))
    )


def apply_mix(docs: DataFrame, doc_id: str = "doc_id", **how) -> DataFrame:
    """The documents themselves, each as often as its copies say; columns as they were."""
    copies = mix(docs, doc_id=doc_id, **how).groupBy(F.col(doc_id).alias("_id")).agg(F.min("copies").alias("_copies")).where("_copies > 0")
    names = [F.col(f"d.`{c}`") for c in docs.columns]
    times = F.explode(F.sequence(F.lit(1), F.col("_copies").cast("int")))
    return docs.alias("d").join(copies, F.col(f"d.`{doc_id}`").eqNullSafe(F.col("_id"))).select(*names, times.alias("_time")).select(
        *[F.col(f"`{c}`") for c in docs.columns]
    )
