"""Bucketed windows against plain ones, with one key that holds most of the rows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from muster.operators import layout, ordering, reconcile, summaries


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(11)
    data = [(("hot" if rng.random() < 0.6 else f"k{rng.randint(0, 4)}"), rng.randint(0, 300), i, rng.choice("ab")) for i in range(1500)]
    return spark.createDataFrame(data, "key string, y long, i long, state string").cache()


def test_ranked(rows):
    plain = rows.withColumn("w", F.row_number().over(Window.partitionBy("key").orderBy("y", "i"))).withColumn(
        "n", F.count("*").over(Window.partitionBy("key"))
    )
    mine = ordering.ranked(plain, ["key"], [F.floor(F.col("y") / 10)], [F.col("y"), F.col("i")], total="t")
    assert mine.count() == 1500 and mine.filter("rank <> w or t <> n").isEmpty()


@pytest.mark.parametrize("forward", [False, True])
def test_neighbour(rows, forward):
    window = Window.partitionBy("key").orderBy("y", "i")
    plain = rows.withColumn("w", (F.lead if forward else F.lag)("state").over(window))
    mine = ordering.neighbour(plain, ["key"], F.floor(F.col("y") / 7), ["y", "i"], "state", "near", forward)
    assert mine.count() == 1500 and mine.filter("not (near <=> w)").isEmpty()


@pytest.mark.parametrize("inclusive", [False, True])
def test_bounds(rows, inclusive):
    marks = rows.filter("i % 9 = 0").select("key", "y").distinct()
    got = ordering.bounds(rows, marks, ["key"], "y", 25, "lo", "hi", inclusive).collect()
    have = {}
    for m in marks.collect():
        have.setdefault(m.key, []).append(m.y)
    assert len(got) == 1500
    for r in got:
        near = have.get(r.key, [])
        assert r.lo == max([v for v in near if v < r.y or (inclusive and v == r.y)], default=None)
        assert r.hi == min([v for v in near if v > r.y], default=None)


def test_bounds_read_no_frame_that_shrinks(rows):
    plan = ordering.bounds(rows, rows.filter("i % 9 = 0").select("key", "y").distinct(), ["key"], "y", 25, "lo", "hi")._jdf.queryExecution().toString()
    assert "unboundedfollowing" not in plan.lower()


@pytest.mark.parametrize("tolerance", [None, 1.0])
def test_assign_cells(spark, tolerance):
    rng = random.Random(13)
    words = [(i, "p" if rng.random() < 0.7 else "q", rng.randint(0, 40), rng.randint(0, 40)) for i in range(200)]
    cells = [(j, "p" if j % 3 else "q", a, a + rng.randint(1, 15), b, b + rng.randint(1, 15))
             for j in range(30) for a, b in [(rng.randint(0, 30), rng.randint(0, 30))]]
    got = layout.assign_cells(
        spark.createDataFrame(words, "i long, page string, x long, y long"),
        spark.createDataFrame(cells, "j long, page string, x0 long, x1 long, y0 long, y1 long"), "page", 5, tolerance,
    )
    t = tolerance
    inside = (lambda v, a, b: a < v < b) if t is None else (lambda v, a, b: a - t <= v <= b + t)
    want = {(i, j) for i, p, x, y in words for j, q, a, b, c, d in cells if p == q and inside(x, a, b) and inside(y, c, d)}
    listed = [(r.i, r.j) for r in got.collect()]
    assert set(listed) == want and len(listed) == len(want)


def test_digest_sees_content_not_order(rows):
    fields = ["key", "y", "i", "state"]
    whole = reconcile.dataset_digest(rows, fields).head()
    assert reconcile.dataset_digest(rows.repartition(5, "i").orderBy(F.desc("i")), fields).head() == whole
    changed = rows.withColumn("state", F.when(F.col("i") == 77, "z").otherwise(F.col("state")))
    assert reconcile.dataset_digest(changed, fields).head().digest != whole.digest
    assert reconcile.dataset_digest(rows.union(rows.limit(1)), fields).head().digest != whole.digest


def test_words_of_a_line_are_ranked(spark):
    words = [("p", 0, (i * 37) % 101, i, f"w{i}") for i in range(101)] + [("q", 0, 1, 500, "solo")]
    df = spark.createDataFrame(words, "page string, y long, x long, i long, t string")
    rows = summaries.ordered_words(df, ["page"], F.col("y"), "x", "i", width=10.0).orderBy("page", "line", "rank").collect()
    assert [r["rank"] for r in rows] == [*range(1, 102), 1]
    assert [r["t"] for r in rows if r.page == "p"] == [w[4] for w in sorted(words[:-1], key=lambda w: -w[2])]
