"""Queries of reconciliation (J1-J4, J8, U1, U2), quality rules (Q, W1, W5), archive filters (F, O3, O4) and cells (S2, A17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import audit, filters, quality, reconcile
from muster.operators.timetable import slots
from muster.plans.q_text import SPACE_SQL, join_key_sql, primary_sql, soft_sql
from muster.plans.views import (
    RANGE_START,
    ROW_ORDER,
    ROW_ORDER_SQL,
    archive,
    blocks_a,
    blocks_b,
    cand_orders,
    cells,
    orders,
    owners,
    roster,
    roster_ar,
    table,
    with_views,
)
from muster.registry import query
from muster.sources import cells as cell_source

SLOT = ["l_orderkey", "period"]
RIGHT_SQL = f"""found AS (SELECT l_orderkey, period, count(*) AS matches,
     arg_min({{'owner': owner, 'subject': subject}}, ROW({ROW_ORDER_SQL}, copy)) AS r FROM slots_b GROUP BY l_orderkey, period),
matched AS (SELECT a.*, coalesce(matches, 0) AS matches, CASE WHEN matches = 1 THEN r.owner END AS other_owner,
       CASE WHEN matches = 1 THEN r.subject END AS other_subject
  FROM slots_a a LEFT JOIN found USING (l_orderkey, period))"""


def matched(spark, folder):
    return reconcile.reconcile_slots(
        slots(blocks_a(spark, folder)), slots(blocks_b(spark, folder)), SLOT, [*ROW_ORDER, "copy"], ["owner", "subject"]
    )


@query("j1_reconcile_slots", "l_orderkey bigint, period bigint, l_linenumber bigint, l_partkey bigint, matches bigint, status string",
       with_views("slots_a", "slots_b") + f""", {RIGHT_SQL}
SELECT l_orderkey, period, l_linenumber, l_partkey, matches,
       CASE WHEN matches = 1 THEN 'matched' ELSE 'missingOrMultiple' END AS status FROM matched""")
def j1(spark, folder):
    return matched(spark, folder).withColumn("status", reconcile.slot_status(F.col("matches")))


LABEL_SQL = "'Supplier#' || lpad(CAST(owner AS VARCHAR), 9, '0')"


@query("j2_attribute_mismatches", "l_orderkey bigint, period bigint, l_linenumber bigint, type string, source string, candidate string",
       with_views("slots_a", "slots_b", "owners_v") + f""", {RIGHT_SQL},
named AS (SELECT m.*, {LABEL_SQL.replace('owner', 'm.owner')} AS label, name FROM matched m LEFT JOIN owners_v o ON o.owner = other_owner WHERE matches = 1)
SELECT l_orderkey, period, l_linenumber, 'subjectMismatch' AS type, subject AS source, other_subject AS candidate
FROM named WHERE {join_key_sql('subject')} <> {join_key_sql('other_subject')}
UNION ALL SELECT l_orderkey, period, l_linenumber, 'nameMismatch', label, name
FROM named WHERE NOT contains({join_key_sql("coalesce(name, '')")}, {join_key_sql('label')})""")
def j2(spark, folder):
    names = owners(spark, folder).select(F.col("owner").alias("other_owner"), "name")
    label = F.concat(F.lit("Supplier#"), F.lpad(F.col("owner").cast("string"), 9, "0"))
    named = filters.lookup(matched(spark, folder), names, "other_owner").withColumn("label", label)
    return reconcile.attribute_mismatches(named, ("subject", "other_subject"), ("label", "name"))


@query("j3_resolve_blocks", "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, l_suppkey bigint, resolved bigint, status string",
       with_views("slots_a", "slots_b") + f""", {RIGHT_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN count(DISTINCT other_owner) = 1 THEN min(other_owner) END AS resolved,
       CASE WHEN count(DISTINCT other_owner) = 1 THEN 'resolved' ELSE 'unresolved' END AS status
FROM matched GROUP BY {ROW_ORDER_SQL}""")
def j3(spark, folder):
    found = reconcile.resolve_blocks(matched(spark, folder), ROW_ORDER, "other_owner")
    return found.withColumn("status", F.when(F.col("resolved").isNull(), "unresolved").otherwise("resolved"))


@query("j4_slot_set_diff", "l_orderkey bigint, period bigint, side string", with_views("slots_a", "slots_b") + """
SELECT *, 'left' AS side FROM (SELECT l_orderkey, period FROM slots_a EXCEPT SELECT l_orderkey, period FROM slots_b)
UNION ALL SELECT *, 'right' FROM (SELECT l_orderkey, period FROM slots_b EXCEPT SELECT l_orderkey, period FROM slots_a)""")
def j4(spark, folder):
    return reconcile.slot_set_diff(slots(blocks_a(spark, folder)), slots(blocks_b(spark, folder)), SLOT)


ORDER_FIELDS = ["o_custkey", "o_orderstatus", "o_orderpriority", "cents", "day"]


@query("j8_diff_records", "o_orderkey bigint, type string, field string, source string, candidate string",
       with_views("cand_orders") + """
SELECT o.o_orderkey, 'missingRecord' AS type, '' AS field, NULL AS source, NULL AS candidate
FROM orders_v o WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cand_orders)
""" + "".join(f"""UNION ALL SELECT o_orderkey, 'fieldMismatch', '{f}', CAST(s.{f} AS VARCHAR), CAST(c.{f} AS VARCHAR)
FROM orders_v s JOIN cand_orders c USING (o_orderkey) WHERE s.{f} IS DISTINCT FROM c.{f}
""" for f in ORDER_FIELDS))
def j8(spark, folder):
    return reconcile.diff_records(orders(spark, folder), cand_orders(spark, folder), "o_orderkey", ORDER_FIELDS)


# Number of sections per grade.
SECTIONS = {5: 11, 6: 10, 7: 9, 8: 9}


@query("u1_coverage", "class_code string, status string", with_views("blocks_a") + """,
expected AS (SELECT g || '/' || s AS class_code FROM (VALUES (5, 11), (6, 10), (7, 9), (8, 9)) AS v(g, n), range(1, 13) AS s(s) WHERE s <= n + 1)
SELECT class_code, 'missing' AS status FROM (SELECT class_code FROM expected EXCEPT SELECT class_code FROM blocks_a)
UNION ALL SELECT class_code, 'unexpected' FROM (SELECT class_code FROM blocks_a EXCEPT SELECT class_code FROM expected)""")
def u1(spark, folder):
    # one section more per grade than there is, so that both kinds occur
    codes = [f"{g}/{s}" for g, n in SECTIONS.items() for s in range(1, n + 2)]
    expected = spark.range(1).select(F.explode(F.array(*[F.lit(c) for c in codes])).alias("class_code"))
    return reconcile.coverage(expected, blocks_a(spark, folder).select("class_code"), "class_code")


@query("u2_multiset_diff", "side string, owner bigint, day_index bigint, period_start bigint, class_code string, subject string",
       with_views("blocks_a", "blocks_b") + """,
l AS (SELECT owner, day_index, period_start, class_code, subject FROM blocks_a),
r AS (SELECT owner, day_index, period_start, class_code, subject FROM blocks_b)
SELECT 'left' AS side, * FROM (SELECT * FROM l EXCEPT ALL SELECT * FROM r)
UNION ALL SELECT 'right', * FROM (SELECT * FROM r EXCEPT ALL SELECT * FROM l)""")
def u2(spark, folder):
    columns = ["owner", "day_index", "period_start", "class_code", "subject"]
    return reconcile.multiset_diff(blocks_a(spark, folder).select(*columns), blocks_b(spark, folder).select(*columns))


@query("q1_unique_ids", "l_orderkey bigint, l_linenumber bigint, n bigint",
       "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def q1(spark, folder):
    return quality.repeated(table(spark, folder, "lineitem"), "l_orderkey", "l_linenumber")


@query("q2_unique_names", "kind string, value string, n bigint", with_views("roster_ar_v") + f"""
SELECT 'name' AS kind, name AS value, count(*) AS n FROM roster_ar_v GROUP BY name HAVING count(*) > 1
UNION ALL SELECT 'searchName', {primary_sql('name')} AS k, count(*) FROM roster_ar_v GROUP BY k HAVING count(*) > 1""")
def q2(spark, folder):
    return quality.repeated_names(roster_ar(spark, folder), "name")


@query("q3_expected_counts", "name string, expected bigint, actual bigint, ok boolean", with_views("roster_v") + """,
c AS (SELECT count(*) AS r, count(DISTINCT grade) AS g, count(DISTINCT (grade, section)) AS k FROM roster_v)
SELECT *, expected = actual AS ok FROM (SELECT 'records' AS name, 1395 AS expected, r AS actual FROM c
UNION ALL SELECT 'grades', 4, g FROM c UNION ALL SELECT 'classes', 39, k FROM c)""")
def q3(spark, folder):
    # fixed values: the numbers the school states
    expected = {
        "records": (F.count(F.lit(1)), 1395),
        "grades": (F.count_distinct("grade"), 4),
        "classes": (F.count_distinct("grade", "section"), 39),
    }
    return quality.expected_counts(roster(spark, folder), expected).withColumnRenamed("check", "name")


@query("q4_blank_names", "sheet string, row bigint",
       with_views("sheet_rows_v") + f"SELECT sheet, row FROM sheet_rows_v WHERE regexp_replace(name, '{SPACE_SQL}+', '', 'g') = ''")
def q4(spark, folder):
    return quality.blank(cell_source.sheet_rows(cells(spark, folder)), "name")


RANGES_SQL = """ranges AS (SELECT *, period_start + CASE WHEN l_quantity >= 49 THEN 3 WHEN l_quantity <= 1 THEN -1 ELSE 0 END AS raw_end FROM blocks_a)"""


@query("q5_bad_period_range", "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, period_start bigint, raw_end bigint",
       with_views("blocks_a") + f""", {RANGES_SQL} SELECT l_orderkey, l_linenumber, l_partkey, period_start, raw_end FROM ranges
WHERE NOT (period_start >= 1 AND period_start <= raw_end AND raw_end <= 8)""")
def q5(spark, folder):
    shift = F.when(F.col("l_quantity") >= 49, 3).when(F.col("l_quantity") <= 1, -1).otherwise(0)
    raw = blocks_a(spark, folder).withColumn("raw_end", F.col("period_start") + shift)
    return quality.bad_period_range(raw, end="raw_end")


@query("q6_owner_overlap", "owner bigint, day_index bigint, period bigint, n bigint", with_views("slots_a") + """
SELECT owner, day_index, period, count(*) AS n FROM slots_a GROUP BY ALL HAVING count(*) > 1""")
def q6(spark, folder):
    return quality.double_booked(blocks_a(spark, folder), "owner")


@query("q7_class_overlap", "class_code string, day_index bigint, period bigint, owner bigint, lessons bigint, n bigint",
       with_views("slots_b") + """
SELECT * FROM (SELECT class_code, day_index, period, owner, count(*) AS lessons FROM slots_b GROUP BY ALL)
JOIN (SELECT class_code, day_index, period, count(*) AS n FROM slots_b GROUP BY ALL HAVING count(*) > 1) USING (class_code, day_index, period)""")
def q7(spark, folder):
    return quality.double_booked_with(blocks_b(spark, folder), "class_code", "owner")


DAMAGED_SQL = """damaged AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_partkey % 50 = 0 THEN NULL WHEN l_partkey % 51 = 0 THEN 9 ELSE grade END AS grade,
   CASE WHEN l_partkey % 47 = 0 THEN NULL ELSE section END AS section, CASE WHEN l_orderkey % 53 = 0 THEN ' ' ELSE subject END AS subject FROM blocks_a)"""


@query("q8_incomplete", "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, issue string", with_views("blocks_a") + f""", {DAMAGED_SQL}
SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN m <> '' THEN 'missing ' || m ELSE 'grade outside domain' END AS issue
FROM (SELECT *, concat_ws(',', CASE WHEN grade IS NULL THEN 'grade' END, CASE WHEN section IS NULL THEN 'section' END,
                         CASE WHEN trim(subject) = '' THEN 'subject' END) AS m FROM damaged) WHERE m <> '' OR grade NOT BETWEEN 5 AND 8""")
def q8(spark, folder):
    part = F.col("l_partkey")
    damaged = blocks_a(spark, folder).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        F.when(part % 50 == 0, None).when(part % 51 == 0, 9).otherwise(F.col("grade")).alias("grade"),
        F.when(part % 47 == 0, None).otherwise(F.col("section")).alias("section"),
        F.when(F.col("l_orderkey") % 53 == 0, " ").otherwise(F.col("subject")).alias("subject"),
    )
    return quality.incomplete(damaged, ["grade", "section", "subject"])


@query("q9_metadata_equality", "o_orderkey bigint, field string, source string, candidate string", with_views("cand_orders") + """
SELECT o_orderkey, 'status' AS field, s.o_orderstatus AS source, c.o_orderstatus AS candidate FROM orders_v s JOIN cand_orders c USING (o_orderkey)
WHERE s.o_orderstatus IS DISTINCT FROM c.o_orderstatus
UNION ALL SELECT o_orderkey, 'cents', CAST(s.cents AS VARCHAR), CAST(c.cents AS VARCHAR) FROM orders_v s JOIN cand_orders c USING (o_orderkey)
WHERE s.cents IS DISTINCT FROM c.cents
UNION ALL SELECT o_orderkey, 'status', o_orderstatus, NULL FROM orders_v WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cand_orders)
UNION ALL SELECT o_orderkey, 'cents', CAST(cents AS VARCHAR), NULL FROM orders_v WHERE o_orderkey NOT IN (SELECT o_orderkey FROM cand_orders)""")
def q9(spark, folder):
    def with_meta(df):
        meta = F.create_map(F.lit("status"), F.col("o_orderstatus"), F.lit("cents"), F.col("cents").cast("string"))
        return df.select("o_orderkey", meta.alias("meta"))

    return reconcile.metadata_mismatches(
        with_meta(orders(spark, folder)), with_meta(cand_orders(spark, folder)), ["o_orderkey"], "meta"
    )


def digest_sql(view: str) -> str:
    parts = " || '|' || ".join(
        f"CAST(coalesce(sum(CAST(('0x' || substring(h, {1 + 8 * i}, 8)) AS BIGINT)), 0) AS VARCHAR)" for i in range(8)
    )
    return f"""SELECT count(*) AS records, sha256(count(*) || '|' || {parts}) AS digest
FROM (SELECT sha256(CAST(to_json({{'cents': cents, 'day': day, 'o_custkey': o_custkey, 'o_orderkey': o_orderkey,
   'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus}}) AS VARCHAR)) AS h FROM {view})"""


@query("q10_dataset_digest", "side string, records bigint, digest string", with_views("cand_orders") + f"""
SELECT 'source' AS side, * FROM ({digest_sql('orders_v')}) UNION ALL SELECT 'candidate', * FROM ({digest_sql('cand_orders')})""")
def q10(spark, folder):
    fields = ["o_orderkey", *ORDER_FIELDS]
    left = reconcile.dataset_digest(orders(spark, folder), fields).withColumn("side", F.lit("source"))
    return left.unionByName(reconcile.dataset_digest(cand_orders(spark, folder), fields).withColumn("side", F.lit("candidate")))


@query("q11_check_completeness", "entities bigint, performed bigint, expected bigint, complete boolean", with_views("slots_a") + """
SELECT entities, performed, entities * 40 AS expected, performed = entities * 40 AS complete FROM (
  SELECT count(DISTINCT owner) AS entities, count(*) AS performed FROM (SELECT DISTINCT owner, day_index, period FROM slots_a))""")
def q11(spark, folder):
    checks = slots(blocks_a(spark, folder)).select("owner", "day_index", "period").distinct()
    return quality.check_completeness(checks, "owner", quality.all_slots())


@query("q12_archive_rules", "id string, issue string", with_views("archive_v") + r""",
a AS (SELECT * REPLACE (CASE WHEN doc_id % 29 = 0 THEN '' ELSE title END AS title, CASE WHEN doc_id % 31 = 0 THEN 'other' ELSE category END AS category) FROM archive_v)
SELECT id, 'missing text' AS issue FROM a WHERE title = '' OR description = ''
UNION ALL SELECT id, 'date outside range' FROM a WHERE date NOT BETWEEN DATE '2024-01-01' AND DATE '2024-01-28'
UNION ALL SELECT id, 'unknown category' FROM a WHERE category = 'other'
UNION ALL SELECT id, 'media not https' FROM a WHERE len(media) > 0 AND doc_id % 17 = 0
UNION ALL SELECT id, 'bad cached path' FROM a WHERE len(media) > 0 AND NOT regexp_full_match(local_path, '/activity-media/[a-f0-9]+\.(jpg|png|webp)')""")
def q12(spark, folder):
    key = F.col("doc_id")
    damaged = archive(spark, folder).withColumn("title", F.when(key % 29 == 0, "").otherwise(F.col("title"))).withColumn(
        "category", F.when(key % 31 == 0, "other").otherwise(F.col("category"))
    )
    return quality.archive_issues(damaged, RANGE_START, "2024-01-28")


@query("q13_audit_report", "rule string, n bigint, ok boolean", with_views("slots_a", "slots_b", "cand_orders") + f""", {RIGHT_SQL},
w AS (SELECT owner, day_index, period FROM slots_a GROUP BY ALL HAVING count(*) > 1),
counts AS (SELECT 'missingOrMultiple' AS rule, count(*) AS n FROM matched WHERE matches <> 1
 UNION ALL SELECT 'ownerOverlap', count(*) FROM w
 UNION ALL SELECT 'badPeriodRange', count(*) FROM blocks_a WHERE period_end > 8
 UNION ALL SELECT 'slotSetMismatch', (SELECT count(*) FROM (SELECT l_orderkey, period FROM slots_a EXCEPT SELECT l_orderkey, period FROM slots_b))
     + (SELECT count(*) FROM (SELECT l_orderkey, period FROM slots_b EXCEPT SELECT l_orderkey, period FROM slots_a)))
SELECT rule, n, n = 0 AS ok FROM counts""")
def q13(spark, folder):
    a, b = blocks_a(spark, folder), blocks_b(spark, folder)
    report = reconcile.summary(
        {
            "missingOrMultiple": matched(spark, folder).filter(F.col("matches") != 1),
            "ownerOverlap": quality.double_booked(a, "owner"),
            "badPeriodRange": quality.bad_period_range(a),
            "slotSetMismatch": reconcile.slot_set_diff(slots(a), slots(b), SLOT),
        }
    )
    return report.withColumn("ok", F.col("n") == 0)


# Owners of some classes only, so that there are owners without lessons, gaps in the week and classes without the subject.
AUDITED = "owner % 7 <> 3 AND (class_code <> '5/1' OR subject <> 'AF') AND NOT (day_index = 2 AND period_start >= 5)"
AUDIT_NAME_SQL = "CASE WHEN owner % 11 = 0 THEN 'a b' ELSE name END"
_LESSON_SQL = "('0x' || substring(sha256(concat_ws('|', day_index, period_start, period_end, class_code, subject)), 1, 12))::BIGINT"


@query("q13_audit_full_report", "part string, type string, key string, value string", with_views("blocks_a", "blocks_b", "owners_v") + f""",
a AS (SELECT *, {_LESSON_SQL} AS h FROM blocks_a WHERE {AUDITED}), b AS (SELECT *, {_LESSON_SQL} AS h FROM blocks_b WHERE {AUDITED}),
ra AS (SELECT owner, count(*) AS blocks, sum(period_end - period_start + 1) AS occupied, count(*) FILTER (period_end > period_start) AS doubles, sum(h) AS lessons FROM a GROUP BY owner),
rb AS (SELECT owner, count(*) AS blocks, sum(period_end - period_start + 1) AS occupied, count(*) FILTER (period_end > period_start) AS doubles, sum(h) AS lessons FROM b GROUP BY owner),
fields AS (
  SELECT owner || '.' || f AS key, x AS s, y AS c FROM (
    SELECT owner, unnest(['blocks', 'occupied', 'doubles', 'lessons']) AS f, unnest([ra.blocks, ra.occupied, ra.doubles, ra.lessons]) AS x,
      unnest([rb.blocks, rb.occupied, rb.doubles, rb.lessons]) AS y FROM ra JOIN rb USING (owner))),
d AS (
  SELECT 'missingRecord' AS type, owner::VARCHAR AS key, '' AS value FROM ra ANTI JOIN rb USING (owner)
  UNION ALL SELECT 'unexpectedRecord', owner::VARCHAR, '' FROM rb ANTI JOIN ra USING (owner)
  UNION ALL SELECT 'recordMismatch', key, s || ' <> ' || c FROM fields WHERE s <> c),
s AS (SELECT class_code, day_index, unnest(range(period_start, period_end + 1)) AS period, owner, subject FROM a),
o AS (SELECT owner, {AUDIT_NAME_SQL} AS name FROM owners_v)
SELECT 'result' AS part, 'ok' AS type, '' AS key, CASE WHEN (SELECT count(*) FROM d) = 0 THEN 'true' ELSE 'false' END AS value
UNION ALL SELECT 'count', 'owners', '', count(*)::VARCHAR FROM o
UNION ALL SELECT 'count', 'records', '', count(*)::VARCHAR FROM ra
UNION ALL SELECT 'count', 'lessonBlocks', '', count(*)::VARCHAR FROM a
UNION ALL SELECT 'count', 'occupiedPeriods', '', count(*)::VARCHAR FROM s
UNION ALL SELECT 'count', 'doublePeriodBlocks', '', count(*)::VARCHAR FROM a WHERE period_end = period_start + 1
UNION ALL SELECT 'digest', 'source', '', sum(h)::VARCHAR FROM a
UNION ALL SELECT 'digest', 'candidate', '', sum(h)::VARCHAR FROM b
UNION ALL SELECT 'discrepancy', type, key, value FROM d
UNION ALL SELECT 'warning', 'blankSchedule', owner::VARCHAR, '' FROM o ANTI JOIN ra USING (owner)
UNION ALL SELECT 'warning', 'placeholderName', owner::VARCHAR, name FROM o WHERE owner % 11 = 0
UNION ALL SELECT 'warning', 'unassignedClassPeriod', class_code || ' ' || d || ' ' || p, '' FROM (
  SELECT class_code, d, p FROM (SELECT DISTINCT class_code FROM s), range(5) AS d(d), range(1, 9) AS p(p) EXCEPT SELECT class_code, day_index, period FROM s)
UNION ALL SELECT 'warning', 'classWithoutSubject', class_code, 'AF' FROM s GROUP BY class_code HAVING count(*) FILTER (subject = 'AF') = 0
UNION ALL SELECT 'warning', 'sourceClassConflict', class_code || ' ' || day_index || ' ' || period, count(*) || ' ' || min(owner) || ' ' || max(owner)
  FROM s GROUP BY class_code, day_index, period HAVING count(*) > 1""")
def q13_full(spark, folder):
    names = owners(spark, folder).withColumn("name", F.when(F.col("owner") % 11 == 0, "a b").otherwise(F.col("name")))
    return audit.audit_report(blocks_a(spark, folder).filter(AUDITED), blocks_b(spark, folder).filter(AUDITED), names, "AF")


NAMED_SQL = f"named AS (SELECT *, regexp_replace(name, '{SPACE_SQL}+', '', 'g') <> '' AS has_name FROM sheet_rows_v)"


@query("s2_roster_from_cells", "id string, name string, grade bigint, section bigint, roster_order bigint, source_sheet string, source_row bigint",
       with_views("sheet_rows_v") + f""", {NAMED_SQL}, parsed AS (SELECT *, CAST(substring(CAST(conv_id AS VARCHAR), 1, 2) AS BIGINT) AS section FROM named)
SELECT '2026-5-' || section || '-' || number AS id, name, 5 AS grade, section, number AS roster_order, sheet AS source_sheet, row + 1 AS source_row
FROM parsed WHERE has_name""")
def s2(spark, folder):
    return cell_source.roster_from_cells(cells(spark, folder), "2026")


@query("a17_import_report", "sheets bigint, records bigint, groups bigint, skipped_blank bigint, formatting_issues bigint",
       with_views("sheet_rows_v") + f""", {NAMED_SQL}
SELECT count(DISTINCT sheet) AS sheets, count_if(has_name) AS records, count(DISTINCT sheet) FILTER (has_name) AS groups,
       count_if(NOT has_name) AS skipped_blank, count_if(has_name AND regexp_matches(name, '{SPACE_SQL}{{2,}}')) AS formatting_issues FROM named""")
def a17(spark, folder):
    return cell_source.import_report(cells(spark, folder))


@query("w1_sequence_breaks", "sheet string, row bigint, number bigint, expected bigint", with_views("sheet_rows_v") + f""", {NAMED_SQL}
SELECT * FROM (SELECT sheet, row, number, row_number() OVER (PARTITION BY sheet ORDER BY row) AS expected FROM named WHERE has_name)
WHERE number <> expected""")
def w1(spark, folder):
    rows = cell_source.sheet_rows(cells(spark, folder)).filter(~cell_source.is_blank())
    return quality.sequence_breaks(rows, "sheet", "row", "number")


@query("w5_order_breaks", "position bigint, key bigint, place bigint", """
SELECT * FROM (SELECT position, key, row_number() OVER (ORDER BY position) AS place FROM (
  SELECT p_partkey AS position, p_partkey + 1 + CASE WHEN p_size > 45 THEN 1 ELSE 0 END AS key FROM part)) WHERE place <> key""")
def w5(spark, folder):
    key = F.col("p_partkey") + 1 + F.when(F.col("p_size") > 45, 1).otherwise(0)
    listed = table(spark, folder, "part").select(F.col("p_partkey").alias("position"), key.alias("key"))
    return quality.order_breaks(listed, "position", "key")


@query("f4_filter_archive", "id string", with_views("archive_v") + """
SELECT id FROM archive_v WHERE category IN ('teaching') AND list_contains(audiences, 'en') AND len(media) > 0
   AND date BETWEEN DATE '2024-01-03' AND DATE '2024-01-27'
UNION ALL SELECT id FROM archive_v WHERE specialist AND list_contains(grades, 5)""")
def f4(spark, folder):
    records = archive(spark, folder)
    first = filters.filter_archive(
        records, category="teaching", audience="en", date_from="2024-01-03", date_to="2024-01-27", with_media=True
    )
    return first.select("id").unionByName(filters.filter_archive(records, grade=5, flagged_only=True).select("id"))


CATEGORY_LABEL_CASE = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in filters.CATEGORY_LABELS.items()) + " END"
ARCHIVE_HAY_SQL = soft_sql(
    f"concat_ws(' ', title, description, {CATEGORY_LABEL_CASE}, array_to_string(audiences, ' '), array_to_string(people, ' '), "
    "array_to_string(list_transform(grades, lambda g: 'الصف ' || CASE g WHEN 5 THEN 'الخامس' WHEN 6 THEN 'السادس' WHEN 7 THEN 'السابع' "
    "WHEN 8 THEN 'الثامن' ELSE CAST(g AS VARCHAR) END), ' '), CAST(date AS VARCHAR))"
)


@query("f5_text_filter", "id string", with_views("archive_v") + f"""
SELECT id FROM (SELECT id, {ARCHIVE_HAY_SQL} AS h FROM archive_v) WHERE contains(h, 'معلمون') AND contains(h, 'الحصص') AND contains(h, '2024-01-1')""")
def f5(spark, folder):
    return filters.text_filter(archive(spark, folder), " معلمون  الحصص 2024-01-1", filters.archive_haystack()).select("id")


@query("f5_text_filter_grade", "id string", with_views("archive_v") + f"""
SELECT id FROM (SELECT id, {ARCHIVE_HAY_SQL} AS h FROM archive_v) WHERE contains(h, 'الصف') AND contains(h, 'السابع') AND contains(h, 'the')""")
def f5_grade(spark, folder):
    return filters.text_filter(archive(spark, folder), "الصّف السابع the", filters.archive_haystack()).select("id")


@query("f9_existing_keys", "owner bigint", with_views("blocks_b") + """
SELECT DISTINCT owner FROM blocks_b WHERE owner IN (SELECT s_suppkey FROM supplier)""")
def f9(spark, folder):
    saved = blocks_b(spark, folder).select("owner").distinct()
    return filters.existing_keys(saved, owners(spark, folder), "owner")


@query("f11_drop_before", "id string, date date", with_views("archive_v") + "SELECT id, date FROM archive_v WHERE date >= DATE '2024-01-15'")
def f11(spark, folder):
    return filters.drop_before(archive(spark, folder), "date", "2024-01-15")


@query("o3_locale_sort", "name string", with_views("roster_ar_v") + "SELECT DISTINCT name FROM roster_ar_v ORDER BY name")
def o3(spark, folder):
    return roster_ar(spark, folder).select("name").distinct().orderBy(F.collate("name", "ar"))


@query("o4_archive_order", "id string, date date", with_views("archive_v") + "SELECT id, date FROM archive_v ORDER BY date DESC, id DESC")
def o4(spark, folder):
    return archive(spark, folder).orderBy(F.desc("date"), F.desc("id"))
