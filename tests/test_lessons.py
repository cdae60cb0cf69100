"""Lessons of printed pages, from few words and rulings."""

from pyspark.sql import functions as F

from muster.operators import lessons

WORDS = "page bigint, word bigint, x0 double, x1 double, y0 double, y1 double, size double, text string, glyphs array<struct<x: double, c: string>>"


def page(spark, words, lines, days=((1, 0, 20.0),), periods=((1, 1, 15.0), (1, 2, 25.0), (1, 3, 35.0))):
    return lessons.page_lessons(
        spark.createDataFrame(words, WORDS), spark.createDataFrame(lines, "page bigint, x0 double, y0 double, x1 double, y1 double"),
        spark.createDataFrame(days, "page bigint, day_index bigint, centre double"),
        spark.createDataFrame(periods, "page bigint, period bigint, centre double"),
    ).collect()


def ruled(*xs, at=1):
    level = [(at, 0.0, 10.0, 50.0, 10.0), (at, 0.0, 10.004, 50.0, 10.004), (at, 0.0, 30.0, 50.0, 30.0), (at, 0.0, 90.0, 50.0, 90.0)]
    return level + [(at, float(x), 30.0, float(x), 10.0) for x in xs] + [(at, 33.0, 60.0, 33.0, 90.0)]  # the last one crosses no row


def label(word, x, text, size=12.0, y=12.0, digits=""):
    return (1, word, x - 1, x + 1, y, y + 2, size, text, [(x + i, c) for i, c in enumerate(digits)])


def test_merged_cells_and_texts(spark):
    words = [
        label(1, 20.0, "السابع"), label(2, 18.0, "٠١", digits="١٠"), label(3, 16.0, "لغة", 9.0, 16.0), label(4, 22.0, "مادة", 9.0, 16.0),
        label(5, 20.0, "حاسوب ١", 8.0, 18.0), label(6, 20.0, "--", 8.0, 20.0),
        label(7, 35.0, "الثامن"), label(8, 36.0, "3", digits="3"), label(9, 30.0, "edge"), label(10, 5.0, "margin"), label(11, 45.0, None),
    ]
    got = page(spark, words, ruled(10, 30, 40, 50))
    rows = {(r.kind, r.period_start, r.word): r for r in got}
    assert set(rows) == {("lesson", 1, None), ("incompleteCell", 3, None), ("unallocatedCellText", None, 9), ("unallocatedCellText", None, 11)}
    one = rows["lesson", 1, None]
    assert (one.period_end, one.class_code, one.subject, one.class_text) == (2, "7/10", "مادة لغة", "السابع ٠١")
    other = rows["incompleteCell", 3, None]
    assert (other.grade, other.section, other.subject, other.class_code) == (8, 3, "", None)


def test_rows_that_cannot_be_told(spark):
    few = page(spark, [label(1, 20.0, "السابع")], ruled(10, 30, 40))
    assert [(r.kind, r.day_index) for r in few] == [("rowGeometry", 0)]
    assert [(r.kind, r.day_index) for r in page(spark, [label(1, 20.0, "x")], [(2, 0.0, 1.0, 9.0, 1.0)])] == [("rowGeometry", 0)]
    assert page(spark, [], [], [], []) == []


def test_room_notes_and_repeated_words(spark):
    words = [label(1, 20.0, "الخامس"), label(2, 20.0, "2", digits="2"), label(3, 20.0, "مادة", 9.0), label(3, 20.0, "مادة", 9.0)]
    got = page(spark, words, ruled(10, 30, 40, 50, 30))
    assert [(r.kind, r.class_code, r.subject) for r in got] == [("lesson", "5/2", "مادة مادة")]


def test_tables_dealt_by_page_are_not_dealt_again(spark):
    dealt = lambda rows, schema: spark.createDataFrame(rows, schema).repartition(5, "page")
    got = lessons.page_lessons(
        dealt([label(1, 20.0, "السابع"), label(2, 35.0, "stray")], WORDS), dealt(ruled(10, 30, 40, 50), "page bigint, x0 double, y0 double, x1 double, y1 double"),
        dealt([(1, 0, 20.0), (1, 1, 50.0), (None, 2, 20.0)], "page bigint, day_index bigint, centre double"),
        dealt([(1, 1, 15.0), (1, 2, 25.0)], "page bigint, period bigint, centre double"),
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    # only the words are dealt once more, after Python has seen them; nothing is kept or sent out whole
    assert plan.count("Exchange hashpartitioning") == plan.count("REPARTITION_BY_NUM") + 1
    assert "BroadcastExchange" not in plan
    assert sorted((r.page or 0, r.kind, r.day_index or 0, r.word or 0) for r in got.collect()) == [
        (0, "rowGeometry", 2, 0), (1, "incompleteCell", 0, 0), (1, "rowGeometry", 1, 0), (1, "unallocatedCellText", 0, 2)]


def test_rulings_of_a_page_are_read_once(spark):
    got = lessons.page_lessons(
        spark.createDataFrame([label(1, 20.0, "السابع"), label(2, 35.0, "stray")], WORDS),
        spark.createDataFrame(ruled(10, 30, 40, 50), "page bigint, x0 double, y0 double, x1 double, y1 double").withColumn("x0", F.col("x0") + F.lit(0.0)),
        spark.createDataFrame([(1, 0, 20.0), (1, 1, 50.0), (1, 1, 51.0), (2, 3, 20.0)], "page bigint, day_index bigint, centre double"),
        spark.createDataFrame([(1, 1, 15.0), (1, 2, 25.0)], "page bigint, period bigint, centre double"),
    )
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("collect_set(struct(day_index") == 2  # one aggregate in two steps
    assert sorted((r.page, r.kind, r.day_index or 0, r.word or 0) for r in got.collect()) == [
        (1, "incompleteCell", 0, 0), (1, "rowGeometry", 1, 0), (1, "rowGeometry", 1, 0), (1, "unallocatedCellText", 0, 2), (2, "rowGeometry", 3, 0)]
