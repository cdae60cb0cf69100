"""Queries of timetable algebra and summaries (F3, F6, F10, F12, R6, J5-J7, J15, J16, A, O5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import filters, summaries, timetable
from muster.plans.q_text import soft_sql
from muster.plans.views import (
    ROW_ORDER,
    ROW_ORDER_SQL,
    archive,
    blocks_a,
    blocks_b,
    owners,
    points,
    roster,
    table,
    with_views,
)
from muster.registry import query

FIRST_SQL = f"""first_lessons AS (SELECT owner, day_index, period, f.class_code, f.subject FROM (
  SELECT owner, day_index, period, arg_min({{'class_code': class_code, 'subject': subject}}, ROW({ROW_ORDER_SQL})) AS f
  FROM slots_a GROUP BY owner, day_index, period))"""


@query("f3_slot_containment", "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, owner bigint",
       with_views("blocks_a") + "SELECT l_orderkey, l_linenumber, l_partkey, owner FROM blocks_a WHERE 3 BETWEEN period_start AND period_end")
def f3(spark, folder):
    return blocks_a(spark, folder).filter(timetable.covers(F.lit(3))).select("l_orderkey", "l_linenumber", "l_partkey", "owner")


HAYSTACK_SQL = f"""{soft_sql("class_code || ' الصف ' || CASE grade WHEN 5 THEN 'الخامس' WHEN 6 THEN 'السادس' WHEN 7 THEN 'السابع' ELSE 'الثامن' END || ' ' || subject || ' owner' || owner")}"""


SLOT_HAYSTACK_SQL = HAYSTACK_SQL.replace("|| ' ' || subject || ' owner' || owner", "|| lesson")


def sparse(blocks, day, period):
    """Blocks of which most orders have nothing in one slot, so that classes are free then."""
    return blocks.filter(~((F.col("day_index") == day) & timetable.covers(F.lit(period))) | (F.col("l_orderkey") % 97 == 0))


def text_blocks(spark, folder):
    return blocks_a(spark, folder).withColumn("label", F.concat(F.lit("owner"), F.col("owner")))


@query("f6_filter_classes", "class_code string",
       with_views("blocks_a") + f""", hay AS (SELECT class_code, {HAYSTACK_SQL} AS h FROM blocks_a)
SELECT class_code FROM hay GROUP BY class_code HAVING bool_or(contains(h, '8/')) AND bool_or(contains(h, 'RF')) AND bool_or(contains(h, 'owner7'))""")
def f6(spark, folder):
    return filters.filter_classes(text_blocks(spark, folder), "٨/ RF owner7", "class_code", "grade", ["subject", "label"])


@query("f6_filter_classes_in_slot", "class_code string",
       with_views("blocks_a") + f""", classes AS (SELECT DISTINCT class_code, grade FROM blocks_a),
first AS (SELECT class_code, grade, arg_min({{'subject': subject, 'owner': owner}}, ROW({ROW_ORDER_SQL})) AS f FROM blocks_a
  WHERE day_index = 2 AND 1 BETWEEN period_start AND period_end AND l_orderkey % 97 = 0 GROUP BY class_code, grade),
seen AS (SELECT class_code, grade, coalesce(' ' || f.subject, '') || coalesce(' owner' || f.owner, '') AS lesson
  FROM classes LEFT JOIN first USING (class_code, grade)),
hay AS (SELECT class_code, {SLOT_HAYSTACK_SQL} AS h FROM seen WHERE grade = 7)
SELECT class_code FROM hay GROUP BY class_code HAVING bool_or(contains(h, 'السابع')) AND bool_or(contains(h, '7/1'))""")
def f6_slot(spark, folder):
    return filters.filter_classes(
        sparse(text_blocks(spark, folder), 2, 1), "السَّابع 7/1", "class_code", "grade", ["subject", "label"], slot=(2, 1),
        order=ROW_ORDER, only_grade=7,
    )


@query("f10_teaches_grade", "owner bigint", with_views("blocks_a") + "SELECT DISTINCT owner FROM blocks_a WHERE grade = 6")
def f10(spark, folder):
    weekly = summaries.weekly_totals(owners(spark, folder), blocks_a(spark, folder))
    return filters.has_member(weekly, "grades", 6).select("owner")


LESSON_SQL = "(day_index, period_start, period_end, class_code, subject)"
CHUNKS_SQL = f"""numbered AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY day_index, period_start, period_end,
   class_code, subject, {ROW_ORDER_SQL}) AS rank FROM blocks_a)"""


@query("f12_project_nested", "owner bigint, day_index bigint, lessons string", with_views("blocks_a") + """
SELECT owner, day_index, string_agg(class_code || ' ' || subject, ',' ORDER BY class_code, subject) AS lessons
FROM blocks_a GROUP BY owner, day_index""")
def f12(spark, folder):
    nested = summaries.weekly_lessons(blocks_a(spark, folder), ROW_ORDER)
    slim = summaries.project_nested(nested, "lessons", ["class_code", "subject"])
    shown = F.array_join(F.transform("lessons", lambda x: F.concat_ws(" ", x["class_code"], x["subject"])), ",")
    return slim.select("owner", "day_index", shown.alias("lessons"))


@query("r6_matching_lesson", "owner bigint, class_code string, subject string",
       with_views("slots_a") + f", {FIRST_SQL} SELECT owner, class_code, subject FROM first_lessons WHERE day_index = 1 AND period = 4")
def r6(spark, folder):
    at = blocks_a(spark, folder).filter((F.col("day_index") == 1) & timetable.covers(F.lit(4)))
    first = timetable.first_covering(at, ["owner"], ROW_ORDER, ["class_code", "subject"])
    return first.filter(F.col("period") == 4)


@query("j5_lookup", "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, owner bigint, name string",
       with_views("blocks_b", "owners_v") + "SELECT l_orderkey, l_linenumber, l_partkey, b.owner, name FROM blocks_b b LEFT JOIN owners_v o ON o.owner = b.owner")
def j5(spark, folder):
    joined = filters.lookup(blocks_b(spark, folder), owners(spark, folder).select("owner", "name"), "owner")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "owner", "name")


@query("j6_occupancy_grid", "owner bigint, day_index bigint, period bigint, class_code string, subject string, period_time string",
       with_views("slots_a", "owners_v") + f""", {FIRST_SQL}
SELECT o.owner, d.d AS day_index, p.p AS period, class_code, subject,
       CASE WHEN p.p < 3 THEN (p.p + 7) || ':00 - ' || (p.p + 7) || ':45' ELSE (p.p + 7) || ':00 - ' || (p.p + 7) || ':45' END AS period_time
FROM owners_v o, range(5) AS d(d), range(1, 9) AS p(p)
LEFT JOIN first_lessons f ON f.owner = o.owner AND f.day_index = d.d AND f.period = p.p""")
def j6(spark, folder):
    return timetable.occupancy_grid(owners(spark, folder), blocks_a(spark, folder), "owner", ROW_ORDER, ["class_code", "subject"])


@query("j7_slot_map", "class_code string, subject string, owner bigint", with_views("slots_a") + f"""
SELECT class_code, f.subject AS subject, f.owner AS owner FROM (SELECT DISTINCT class_code FROM slots_a) LEFT JOIN (
  SELECT class_code, arg_min({{'subject': subject, 'owner': owner}}, ROW({ROW_ORDER_SQL})) AS f
  FROM slots_a WHERE day_index = 3 AND period = 1 AND l_orderkey % 97 = 0 GROUP BY class_code) USING (class_code)""")
def j7(spark, folder):
    return timetable.slot_map(sparse(blocks_a(spark, folder), 3, 1), 3, 1, ROW_ORDER, ["subject", "owner"])


@query("j7_school_map", "class_code string, subject string, label string", with_views("blocks_a") + f""", classes AS (SELECT DISTINCT class_code, grade FROM blocks_a),
first AS (SELECT class_code, grade, arg_min({{'subject': subject, 'owner': owner}}, ROW({ROW_ORDER_SQL})) AS f FROM blocks_a
  WHERE day_index = 3 AND 1 BETWEEN period_start AND period_end AND l_orderkey % 97 = 0 GROUP BY class_code, grade),
seen AS (SELECT class_code, grade, f.subject AS subject, 'owner' || f.owner AS label, coalesce(' ' || f.subject, '') || coalesce(' owner' || f.owner, '') AS lesson
  FROM classes LEFT JOIN first USING (class_code, grade)),
hay AS (SELECT class_code, subject, label, {SLOT_HAYSTACK_SQL} AS h FROM seen WHERE grade = 6)
SELECT class_code, subject, label FROM hay WHERE contains(h, '6/1')""")
def j7_school_map(spark, folder):
    return filters.school_map(sparse(text_blocks(spark, folder), 3, 1), 3, 1, ["subject", "label"], ROW_ORDER, "٦/1", only_grade=6)


# Classes of grade and owner digit, so that the week has gaps.
GAP_SQL = "gaps AS (SELECT * REPLACE (class_code || '-' || (owner % 9) || subject AS class_code) FROM slots_a)"


def gap_blocks(spark, folder):
    code = F.concat(F.col("class_code"), F.lit("-"), (F.col("owner") % 9).cast("string"), F.col("subject"))
    return blocks_a(spark, folder).withColumn("class_code", code)


@query("j15_unassigned_slots", "class_code string, day_index bigint, period bigint", with_views("slots_a") + f""", {GAP_SQL}
SELECT class_code, d.d AS day_index, p.p AS period FROM (SELECT DISTINCT class_code FROM gaps), range(5) AS d(d), range(1, 9) AS p(p)
EXCEPT SELECT class_code, day_index, period FROM gaps""")
def j15(spark, folder):
    return timetable.unassigned_slots(gap_blocks(spark, folder))


@query("j16_entities_without", "owner bigint", with_views("blocks_a") + """
SELECT DISTINCT owner FROM blocks_a EXCEPT SELECT owner FROM blocks_a WHERE subject = 'RF' AND class_code = '5/3' AND day_index = 0""")
def j16(spark, folder):
    wanted = (F.col("subject") == "RF") & (F.col("class_code") == "5/3") & (F.col("day_index") == 0)
    flagged = blocks_a(spark, folder).withColumn("subject", F.when(wanted, "wanted").otherwise("other"))
    return timetable.entities_without(flagged, "wanted", "owner")


@query("a1_class_counts", "grade bigint, section bigint, n bigint",
       with_views("roster_v") + "SELECT grade, section, count(*) AS n FROM roster_v GROUP BY ALL ORDER BY grade, section")
def a1(spark, folder):
    return summaries.group_counts(roster(spark, folder), "grade", "section").orderBy("grade", "section")


@query("a2_grade_rollup", "grade bigint, total bigint, sections bigint", with_views("roster_v") + """
SELECT g.g AS grade, count(id) AS total, count(DISTINCT section) AS sections
FROM range(4, 9) AS g(g) LEFT JOIN roster_v r ON r.grade = g.g GROUP BY g.g""")
def a2(spark, folder):
    # grade 4 is in the domain but not in the data
    return summaries.grade_rollup(spark, roster(spark, folder), (4, *summaries.GRADES))


@query("a3_owners_per_grade", "grade bigint, n bigint", with_views("blocks_a") + """
SELECT g.g AS grade, count(DISTINCT owner) AS n FROM range(5, 9) AS g(g) LEFT JOIN blocks_a b ON b.grade = g.g GROUP BY g.g""")
def a3(spark, folder):
    return summaries.entities_per_value(spark, blocks_a(spark, folder), "owner", "grade", summaries.GRADES)


@query("a4_facet_values", "audience string", with_views("archive_v") + "SELECT DISTINCT unnest(audiences) AS audience FROM archive_v")
def a4(spark, folder):
    return summaries.facet_values(archive(spark, folder), "audiences", "audience")


@query("a5_category_counts", "category string, n bigint, first_at bigint",
       with_views("archive_v") + "SELECT category, count(*) AS n, min(doc_id) AS first_at FROM archive_v GROUP BY category ORDER BY first_at")
def a5(spark, folder):
    return summaries.category_counts(archive(spark, folder), "category", "doc_id").orderBy("first_at")


@query("a6_headline", "records bigint, specialist bigint, with_media bigint, media bigint", with_views("archive_v") + """
SELECT count(*) AS records, count_if(specialist) AS specialist, count_if(len(media) > 0) AS with_media, sum(len(media)) AS media FROM archive_v""")
def a6(spark, folder):
    return archive(spark, folder).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("specialist").alias("specialist"),
        F.count_if(F.size("media") > 0).alias("with_media"),
        F.sum(F.size("media")).alias("media"),
    )


@query("a7_weekly_totals", "owner bigint, lesson_count bigint, occupied_periods bigint, grades string, subjects string",
       with_views("owners_v", "blocks_a") + """
SELECT o.owner, count(b.owner) AS lesson_count, coalesce(sum(period_end - period_start + 1), 0) AS occupied_periods,
       coalesce(array_to_string(list_sort(list_distinct(list(b.grade) FILTER (b.grade IS NOT NULL))), ','), '') AS grades,
       coalesce(array_to_string(list_sort(list_distinct(list(b.subject) FILTER (b.subject IS NOT NULL))), ','), '') AS subjects
FROM (SELECT c_custkey AS owner FROM customer) o LEFT JOIN blocks_a b ON b.owner = o.owner GROUP BY o.owner""")
def a7(spark, folder):
    # customers as the directory: most of them have no lessons and keep an empty week
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("owner"))
    weekly = summaries.weekly_totals(people, blocks_a(spark, folder))
    return weekly.withColumn("grades", F.array_join(F.col("grades").cast("array<string>"), ",")).withColumn(
        "subjects", F.array_join("subjects", ",")
    )


SHOWN_LESSON_SQL = "day_index || ' ' || period_start || '-' || period_end || ' ' || class_code || ' ' || subject"


@query("a7_weekly_lessons", "owner bigint, day_index bigint, lessons string", with_views("blocks_a") + f""", {CHUNKS_SQL}
SELECT owner, day_index, string_agg({SHOWN_LESSON_SQL}, ',' ORDER BY rank) AS lessons FROM numbered GROUP BY owner, day_index""")
def a7_lessons(spark, folder):
    nested = summaries.weekly_lessons(blocks_a(spark, folder), ROW_ORDER)

    def shown(x):
        return F.concat_ws(
            " ", x["day_index"], F.concat_ws("-", x["period_start"], x["period_end"]), x["class_code"], x["subject"]
        )

    return nested.select("owner", "day_index", F.array_join(F.transform("lessons", shown), ",").alias("lessons"))


@query("a8_block_counts", "kind string, value string, n bigint", with_views("blocks_a") + """
SELECT 'grade' AS kind, CAST(grade AS VARCHAR) AS value, count(*) AS n FROM blocks_a GROUP BY grade
UNION ALL SELECT 'subject', subject, count(*) FROM blocks_a GROUP BY subject
UNION ALL SELECT 'class', class_code, count(*) FROM blocks_a GROUP BY class_code""")
def a8(spark, folder):
    return summaries.block_counts(blocks_a(spark, folder))


@query("a9_occupied_by_class", "class_code string, n bigint",
       with_views("slots_a") + "SELECT class_code, count(*) AS n FROM slots_a GROUP BY class_code")
def a9(spark, folder):
    return summaries.occupied_by_class(blocks_a(spark, folder))


@query("a10_day_period_counts", "day_index bigint, " + ", ".join(f"p{p} bigint" for p in range(1, 9)), with_views("slots_a") + f"""
SELECT d.d AS day_index, {", ".join(f"count(*) FILTER (period = {p}) AS p{p}" for p in range(1, 9))}
FROM range(6) AS d(d) LEFT JOIN slots_a s ON s.day_index = d.d GROUP BY d.d""")
def a10(spark, folder):
    # a sixth day, which has no lessons, is filled with zeros
    return summaries.day_period_counts(blocks_a(spark, folder), days=6)


@query("a11_day_totals", "owner bigint, day_index bigint, periods bigint", with_views("blocks_a") + """
SELECT owner, day_index, sum(period_end - period_start + 1) AS periods FROM blocks_a GROUP BY owner, day_index""")
def a11(spark, folder):
    return summaries.day_totals(blocks_a(spark, folder))


@query("a12_empty_entities", "owner bigint", """
SELECT c_custkey AS owner FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def a12(spark, folder):
    people = table(spark, folder, "customer").select(F.col("c_custkey").alias("owner"))
    urgent = table(spark, folder, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return summaries.without_blocks(people, urgent.select(F.col("o_custkey").alias("owner")))


@query("a13_extraction_counts", "owners bigint, lesson_blocks bigint, occupied_periods bigint, double_blocks bigint",
       with_views("blocks_a") + """
SELECT count(DISTINCT owner) AS owners, count(*) AS lesson_blocks, sum(period_end - period_start + 1) AS occupied_periods,
       count_if(period_end - period_start = 1) AS double_blocks FROM blocks_a""")
def a13(spark, folder):
    return summaries.extraction_counts(blocks_a(spark, folder))


@query("a14_archive_bounds", "range_start date, range_end date, records bigint",
       with_views("archive_v") + "SELECT min(date) AS range_start, max(date) AS range_end, count(*) AS records FROM archive_v")
def a14(spark, folder):
    return summaries.bounds_of(archive(spark, folder), "date")


@query("a15_many_labels", "l_partkey bigint, subject string, labels bigint", with_views("blocks_b") + """
SELECT l_partkey, subject, labels FROM (
  SELECT l_partkey, subject, count(*) OVER (PARTITION BY l_partkey) AS labels FROM (SELECT DISTINCT l_partkey, subject FROM blocks_b)) WHERE labels > 1""")
def a15(spark, folder):
    return summaries.many_labels(blocks_b(spark, folder), "l_partkey", "subject")


@query("a16_text_assembly", "page string, line bigint, rank bigint, text string", with_views("points_v") + """
SELECT page, line, rank, text FROM (SELECT *, row_number() OVER (PARTITION BY page, line ORDER BY x DESC, event_id) AS rank
      FROM (SELECT *, CAST(round(y / 120.0) AS BIGINT) AS line FROM points_v))""")
def a16(spark, folder):
    line = F.round(F.col("y") / 120.0).cast("bigint")
    return summaries.ordered_words(points(spark, folder), ["page"], line, "x", "event_id", width=100.0)


@query("o5_lesson_order", "owner bigint, rank bigint, day_index bigint, period_start bigint, period_end bigint, class_code string, subject string",
       with_views("blocks_a") + f""", {CHUNKS_SQL} SELECT owner, rank, day_index, period_start, period_end, class_code, subject FROM numbered""")
def o5(spark, folder):
    from muster.operators.ordering import ranked

    return ranked(
        blocks_a(spark, folder), ["owner"], [F.col(c) for c in summaries.LESSON_ORDER], [F.col(c) for c in ROW_ORDER]
    )
