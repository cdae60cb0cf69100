"""Queries of ranked search (C21, R), filters over queries (F1, F2, F7, F8) and paging (O1, O2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.functions import scoring
from muster.operators import search
from muster.operators.sizing import settled
from muster.plans.q_text import compact_sql, osa_rows_sql, primary_sql, soft_sql, token_score_sql
from muster.plans.views import (
    QUERY_ROWS_AR,
    blocks_a,
    facet_rows,
    owner_query_rows,
    owners,
    query_rows,
    roster,
    roster_ar,
    with_views,
)
from muster.operators.timetable import slots
from muster.registry import query


def scored_sql(records: str, queries: str, key: str, number: str, facet: str, order: str) -> str:
    """CTEs up to ``gated`` (query_id, key, score): all pairs in SQL, the token tier from a distance table."""
    return f"""
rec AS (SELECT *, {primary_sql('name')} AS p, {soft_sql('name')} AS s, {compact_sql('name')} AS c FROM {records}),
typed AS (SELECT * REPLACE (regexp_replace(query, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g') AS query) FROM {queries}),
ask AS (SELECT *, {primary_sql('query')} AS qp, {soft_sql('query')} AS qs, {compact_sql('query')} AS qc FROM typed),
words AS (SELECT DISTINCT w AS b FROM (SELECT unnest(string_split(s, ' ')) AS w FROM rec) WHERE w <> ''),
asked AS (SELECT DISTINCT w AS a FROM (SELECT unnest(string_split(qs, ' ')) AS w FROM ask) WHERE w <> ''),
close_words AS (SELECT a, b FROM asked, words WHERE length(a) >= 3 AND a[1] = b[1] AND abs(length(a) - length(b)) <= 2),
{osa_rows_sql('close_words')},
word_scores AS (SELECT a, b, {token_score_sql('a', 'b', 'coalesce(distance, 99)')} AS ts FROM (SELECT a, b FROM asked, words) LEFT JOIN osa USING (a, b)),
rec_words AS (SELECT DISTINCT s, unnest(list_filter(string_split(s, ' '), lambda w: w <> '')) AS b FROM rec),
ask_words AS (SELECT DISTINCT qs, t AS a, i FROM (SELECT qs, unnest(list_filter(string_split(qs, ' '), lambda w: w <> '')) AS t,
       generate_subscripts(list_filter(string_split(qs, ' '), lambda w: w <> ''), 1) AS i FROM ask)),
best AS (SELECT s, qs, i, max(ts) AS m FROM rec_words JOIN word_scores USING (b) JOIN ask_words USING (a) GROUP BY s, qs, i),
tiers AS (SELECT s, qs, min(m) AS least_m, avg(m) AS mean_m FROM best GROUP BY s, qs),
bonus AS (SELECT s, qs, max(ts) AS first_ts FROM (SELECT DISTINCT s, list_filter(string_split(s, ' '), lambda w: w <> '')[1] AS b FROM rec)
          JOIN word_scores USING (b) JOIN (SELECT qs, a FROM ask_words WHERE i = 1) USING (a) GROUP BY s, qs),
pair_scores AS (SELECT query_id, {key}, CASE WHEN qp = '' THEN 1
    {number} WHEN p = qp THEN 1000 WHEN starts_with(p, qp) THEN 940 WHEN contains(p, qp) THEN 860
    WHEN contains(s, qs) THEN 780 WHEN contains(c, qc) THEN 740 WHEN least_m = 0 THEN 0
    ELSE round(CASE WHEN least_m >= 82 THEN 700 ELSE 540 END + mean_m + CASE WHEN first_ts >= 90 THEN 25 ELSE 0 END) END AS score,
    qp <> '' AS has_text, query <> '' AS has_query, {order}
  FROM rec r JOIN ask q ON ({facet}) LEFT JOIN tiers USING (s, qs) LEFT JOIN bonus USING (s, qs)),
gated AS (SELECT * FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS top FROM pair_scores WHERE score > 0)
          WHERE NOT has_text OR top < 700 OR score >= 700)"""


ROSTER_NUMBER = "WHEN number = trim(query) THEN 1100"
ROSTER_FACET = """(q.grade IS NULL OR r.grade = q.grade) AND (q.section IS NULL OR r.section = q.section)
    AND (trim(query) <> '' OR (q.grade IS NOT NULL AND q.section IS NOT NULL))"""
ROSTER_ORDER = "r.grade, r.section, roster_order"


def roster_sql(records: str = "roster_v", queries: str = "queries_v") -> str:
    return with_views(records, queries).replace("WITH ", "WITH RECURSIVE ", 1) + "," + scored_sql(
        records, queries, "id", ROSTER_NUMBER, ROSTER_FACET, ROSTER_ORDER
    )


RANK_SQL = """row_number() OVER (PARTITION BY query_id ORDER BY score DESC, grade, section, roster_order, id) AS rank,
       count(*) OVER (PARTITION BY query_id) AS total"""


def keyed_roster(spark, folder):
    return search.add_search_keys(roster(spark, folder), "name")


# Each record against its own name, distorted in seven ways.
OWN_QUERY_SQL = """CASE id % 7 WHEN 0 THEN name WHEN 1 THEN substring(name, 1, 6) WHEN 2 THEN substring(name, 3, 8)
    WHEN 3 THEN replace(name, ' ', '') WHEN 4 THEN string_split(name, ' ')[2] || ' ' || string_split(name, ' ')[1]
    WHEN 5 THEN name[1] || name[3] || name[2] || substring(name, 4) ELSE name || ' xyz' END"""


@query("c21_record_score", "id bigint, query string, score bigint",
       with_views("roster_v").replace("WITH ", "WITH RECURSIVE ", 1) + f""",
own AS (SELECT id AS query_id, {OWN_QUERY_SQL} AS query FROM roster_v),"""
       + scored_sql("roster_v", "own", "id", ROSTER_NUMBER, "r.id = q.query_id", ROSTER_ORDER)
       + " SELECT id, query, score FROM pair_scores JOIN own USING (query_id)")
def c21(spark, folder):
    name, key = F.col("name"), F.col("id")
    words = F.split(name, " ")
    typed = (
        F.when(key % 7 == 0, name)
        .when(key % 7 == 1, F.substring(name, 1, 6))
        .when(key % 7 == 2, F.substring(name, 3, 8))
        .when(key % 7 == 3, F.regexp_replace(name, " ", ""))
        .when(key % 7 == 4, F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0))))
        .when(key % 7 == 5, F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1), F.substring(name, 2, 1), F.substring(name, F.lit(4), F.length(name))))
        .otherwise(F.concat(name, F.lit(" xyz")))
    )
    both = search.add_search_keys(keyed_roster(spark, folder).withColumn("query", typed), "query", "q_")
    names = tuple(F.col(k) for k in ("primary", "soft", "compact"))
    asked = tuple(F.col(f"q_{k}") for k in ("primary", "soft", "compact"))
    value = scoring.record_score(names, asked, F.coalesce("number", F.lit("")), F.col("query"))
    return both.select("id", "query", value.alias("score"))


@query("r1_search_keys", "id bigint, name string, primary_key string, soft_key string, compact_key string",
       with_views("roster_ar_v") + f"""SELECT id, name, {primary_sql('name')} AS primary_key,
       {soft_sql('name')} AS soft_key, {compact_sql('name')} AS compact_key FROM roster_ar_v""")
def r1(spark, folder):
    keyed = search.add_search_keys(roster_ar(spark, folder), "name")
    return keyed.withColumnsRenamed({"primary": "primary_key", "soft": "soft_key", "compact": "compact_key"})


@query("r2_score", "query_id bigint, id bigint, score bigint",
       roster_sql() + " SELECT query_id, id, score FROM pair_scores WHERE score > 0 AND has_query")
def r2(spark, folder):
    facets = [("grade", "grade"), ("section", "section")]
    return search.matches(keyed_roster(spark, folder), query_rows(spark), "id", "number", facets)


@query("r3_direct_gate", "query_id bigint, id bigint, score bigint",
       roster_sql() + " SELECT query_id, id, score FROM gated WHERE has_query")
def r3(spark, folder):
    return search.direct_gate(settled(r2(spark, folder)))  # the gate reads the matches twice


@query("r4_search_roster", "query_id bigint, rank bigint, id bigint, score bigint, total bigint",
       roster_sql() + f" SELECT query_id, id, score, {RANK_SQL} FROM gated")
def r4(spark, folder):
    return search.search_roster(keyed_roster(spark, folder), query_rows(spark))


@query("r4_search_roster_arabic", "query_id bigint, rank bigint, id bigint, score bigint, total bigint",
       roster_sql("roster_ar_v", "queries_ar_v") + f" SELECT query_id, id, score, {RANK_SQL} FROM gated")
def r4_arabic(spark, folder):
    keyed = search.add_search_keys(roster_ar(spark, folder), "name")
    return search.search_roster(keyed, query_rows(spark, QUERY_ROWS_AR))


# One query per customer segment and brand: a query table that grows with the data.
DERIVED_SQL = """derived AS (SELECT row_number() OVER (ORDER BY p_name) AS query_id,
   CASE WHEN length(p_name) % 2 = 0 THEN p_name[1] || p_name[3] || p_name[2] || substring(p_name, 4) ELSE p_name END AS query,
   NULL::BIGINT AS grade, NULL::BIGINT AS section FROM (SELECT DISTINCT p_name FROM part)),"""


@query("r4_search_many_queries", "query string, n bigint, best bigint, ranks bigint",
       with_views("roster_v").replace("WITH ", "WITH RECURSIVE ", 1) + "," + DERIVED_SQL
       + scored_sql("roster_v", "derived", "id", ROSTER_NUMBER, ROSTER_FACET, ROSTER_ORDER)
       + f""" SELECT query, count(*) AS n, max(score) AS best, sum(rank * (id + 1)) AS ranks
FROM (SELECT query_id, id, score, {RANK_SQL} FROM gated) JOIN derived USING (query_id) GROUP BY query""")
def r4_many(spark, folder):
    name = F.col("p_name")
    swapped = F.concat(F.substring(name, 1, 1), F.substring(name, 3, 1), F.substring(name, 2, 1), F.substring(name, F.lit(4), F.length(name)))
    asked = (
        spark.read.parquet(f"{folder}/part.parquet")
        .select("p_name")
        .distinct()
        .select(
            F.xxhash64("p_name").alias("query_id"),
            F.when(F.length(name) % 2 == 0, swapped).otherwise(name).alias("query"),
            F.lit(None).cast("bigint").alias("grade"),
            F.lit(None).cast("bigint").alias("section"),
        )
    )
    found = search.search_roster(keyed_roster(spark, folder), asked)
    per_query = found.groupBy("query_id").agg(
        F.count(F.lit(1)).alias("n"), F.max("score").alias("best"), F.sum(F.col("rank") * (F.col("id") + 1)).alias("ranks")
    )
    return per_query.join(asked, "query_id")


OWNER_FACET = """NOT (q.grade IS NOT NULL OR q.subject IS NOT NULL OR q.day_index IS NOT NULL OR q.period IS NOT NULL)
    OR EXISTS (FROM blocks_a b WHERE b.owner = r.owner AND (q.grade IS NULL OR b.grade = q.grade)
      AND (q.subject IS NULL OR b.subject = q.subject) AND (q.day_index IS NULL OR b.day_index = q.day_index)
      AND (q.period IS NULL OR q.period BETWEEN b.period_start AND b.period_end))"""


@query("r5_search_owners", "query_id bigint, rank bigint, owner bigint, score bigint, total bigint",
       with_views("owners_v", "owner_queries_v", "blocks_a").replace("WITH ", "WITH RECURSIVE ", 1) + ","
       + scored_sql("owners_v", "owner_queries_v", "owner", "", OWNER_FACET, "source_page") + """
SELECT query_id, owner, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, source_page, owner) AS rank,
       count(*) OVER (PARTITION BY query_id) AS total FROM gated""")
def r5(spark, folder):
    keyed = search.add_search_keys(owners(spark, folder), "name")
    return search.search_owners(keyed, slots(blocks_a(spark, folder)), owner_query_rows(spark))


@query("r7_spacing_equivalence", "spelling string, n bigint, ids bigint", with_views("roster_v") + """
, hits AS (SELECT id FROM roster_v WHERE contains(replace(name, ' ', ''), 'hotgear'))
SELECT spelling, count(*) AS n, sum(id) AS ids FROM hits, (VALUES ('spaced'), ('joined')) AS v(spelling) GROUP BY spelling""")
def r7(spark, folder):
    asked = spark.sql(
        "SELECT CAST(query_id AS BIGINT) query_id, query, CAST(NULL AS BIGINT) grade, CAST(NULL AS BIGINT) section "
        "FROM VALUES (1, 'hot gear'), (2, 'hotgear') AS q(query_id, query)"
    )
    found = search.search_roster(keyed_roster(spark, folder), asked)
    return found.groupBy(F.when(F.col("query_id") == 1, "spaced").otherwise("joined").alias("spelling")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")
    )


@query("f1_optional_eq", "query_id bigint, id bigint", with_views("roster_v", "queries_v") + """
SELECT query_id, id FROM queries_v q JOIN roster_v r ON (q.grade IS NULL OR r.grade = q.grade)
  AND (q.section IS NULL OR r.section = q.section) WHERE q.grade IS NOT NULL""")
def f1(spark, folder):
    # the queries all name a grade, so the grade is a join key; the section stays an open filter
    asked = query_rows(spark).filter(F.col("grade").isNotNull()).select("query_id", "grade", F.col("section").alias("q_section"))
    pairs = roster(spark, folder).join(asked, "grade").filter(search.optional_match([("section", "q_section")]))
    return pairs.select("query_id", "id")


@query("f1_optional_eq_values", "id bigint, grade bigint, section bigint",
       with_views("roster_v") + "SELECT id, grade, section FROM roster_v WHERE grade = 7")
def f1_values(spark, folder):
    return search.optional_eq(roster(spark, folder), grade=7, section=None)


@query("f2_has_lesson", "query_id bigint, owner bigint", with_views("blocks_a", "facets_v") + """
SELECT DISTINCT query_id, owner FROM facets_v q JOIN blocks_a b ON (q.grade IS NULL OR b.grade = q.grade)
  AND (q.subject IS NULL OR b.subject = q.subject) AND (q.day_index IS NULL OR b.day_index = q.day_index)
  AND (q.period IS NULL OR q.period BETWEEN b.period_start AND b.period_end)""")
def f2(spark, folder):
    return search.owners_for_facets(slots(blocks_a(spark, folder)), facet_rows(spark))


@query("f7_result_columns", "id bigint, name string, grade bigint, section bigint, roster_order bigint, number string",
       with_views("roster_v") + "SELECT id, name, grade, section, roster_order, number FROM roster_v")
def f7(spark, folder):
    keyed = keyed_roster(spark, folder)
    return search.to_result(keyed, "id", "name", "grade", "section", "roster_order", "number")


@query("f8_ready_gate", "query_id bigint, id bigint", with_views("roster_v", "queries_v") + """
SELECT query_id, id FROM queries_v q JOIN roster_v r ON r.grade = q.grade AND (q.section IS NULL OR r.section = q.section)
WHERE regexp_replace(q.query, '^[\\s\\p{Z}]+|[\\s\\p{Z}]+$', '', 'g') <> '' OR q.section IS NOT NULL""")
def f8(spark, folder):
    asked = query_rows(spark).filter(search.ready()).select("query_id", "grade", F.col("section").alias("q_section"))
    pairs = roster(spark, folder).join(asked, "grade").filter(search.optional_match([("section", "q_section")]))
    return pairs.select("query_id", "id")


@query("o1_rank_sort", "grade bigint, section bigint, roster_order bigint, rank bigint", with_views("roster_v") + """
SELECT grade, section, roster_order, row_number() OVER (PARTITION BY grade ORDER BY section, roster_order) AS rank FROM roster_v""")
def o1(spark, folder):
    from muster.operators.ordering import BUCKET, ranked

    return ranked(
        roster(spark, folder), ["grade"], [F.col("section"), F.floor(F.col("roster_order") / BUCKET)], [F.col("roster_order")]
    )


@query("o2_page", "query_id bigint, rank bigint, id bigint, total bigint, has_more boolean",
       roster_sql() + f""" SELECT query_id, id, rank, total, total > 80 AS has_more
FROM (SELECT query_id, id, {RANK_SQL} FROM gated) WHERE rank > 40 AND rank <= 80""")
def o2(spark, folder):
    return search.search_roster_page(keyed_roster(spark, folder), query_rows(spark), search.PAGE_SEARCH, search.PAGE_SEARCH)
