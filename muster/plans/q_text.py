"""Queries of the scalar functions (C)."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.functions import posts, scoring, text
from muster.plans.views import (
    CATEGORY_CASE,
    LATIN_AUDIENCES,
    LATIN_RULES,
    SQL_VIEWS,
    blocks_a,
    roster,
    roster_ar,
    table,
    with_views,
)
from muster.operators.sizing import spread
from muster.registry import query

SPACE_SQL = r"[\s\x0B\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{FEFF}]"
MARKS_SQL = r"[\x{064B}-\x{065F}\x{0670}\x{06D6}-\x{06ED}]"
MARKS_NARROW_SQL = r"[\x{064B}-\x{065F}\x{0670}]"


def primary_sql(column: str) -> str:
    return (
        f"trim(regexp_replace(translate(regexp_replace(coalesce({column}, ''), '{MARKS_SQL}', '', 'g'), "
        f"'أإآٱىـ', 'ااااي'), '{SPACE_SQL}+', ' ', 'g'))"
    )


def soft_sql(column: str) -> str:
    return f"translate({primary_sql(column)}, 'ةؤئ', 'هوي')"


def compact_sql(column: str) -> str:
    return f"replace({soft_sql(column)}, ' ', '')"


def join_key_sql(column: str) -> str:
    return (
        f"regexp_replace(translate(regexp_replace({column}, '{MARKS_NARROW_SQL}', '', 'g'), "
        f"'أإآٱىةـ', 'اااايه'), '{SPACE_SQL}+', '', 'g')"
    )


@query("c1_normalize", "id bigint, primary_key string, soft_key string, compact_key string",
       with_views("roster_ar_v") + f"""SELECT id, {primary_sql('name')} AS primary_key, {soft_sql('name')} AS soft_key,
       {compact_sql('name')} AS compact_key FROM roster_ar_v""")
def c1(spark, folder):
    name = F.col("name")
    return roster_ar(spark, folder).select(
        "id",
        text.normalize(name).alias("primary_key"),
        text.normalize(name, soft=True).alias("soft_key"),
        text.normalize(name, soft=True, compact=True).alias("compact_key"),
    )


@query("c1_normalize_documents", "doc_id bigint, soft_key string",
       f"SELECT doc_id, {soft_sql('text')} AS soft_key FROM documents")
def c1_documents(spark, folder):
    return table(spark, folder, "documents").select("doc_id", text.normalize(F.col("text"), soft=True).alias("soft_key"))


@query("c2_join_key", "id bigint, join_key string",
       with_views("roster_ar_v") + f"SELECT id, {join_key_sql('name')} AS join_key FROM roster_ar_v")
def c2(spark, folder):
    return roster_ar(spark, folder).select("id", text.join_key(F.col("name")).alias("join_key"))


@query("c3_label_key", "id bigint, label_key string",
       with_views("roster_ar_v") + "SELECT id, translate(trim(name), 'أإآٱ', 'اااا') AS label_key FROM roster_ar_v")
def c3(spark, folder):
    return roster_ar(spark, folder).select("id", text.label_key(F.col("name")).alias("label_key"))


@query("c4_fold_digits", "o_orderkey bigint, printed string, folded string", """
SELECT o_orderkey, printed, translate(printed, '٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹', '01234567890123456789') AS folded
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN translate(CAST(o_orderkey AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩')
      ELSE translate(CAST(o_orderkey AS VARCHAR), '0123456789', '۰۱۲۳۴۵۶۷۸۹') END AS printed FROM orders)""")
def c4(spark, folder):
    key = F.col("o_orderkey").cast("string")
    printed = F.when(
        F.col("o_orderkey") % 2 == 0, F.translate(key, "0123456789", text.ARABIC_DIGITS[:10])
    ).otherwise(F.translate(key, "0123456789", text.ARABIC_DIGITS[10:]))
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", printed.alias("printed"))
        .withColumn("folded", text.fold_digits(F.col("printed")))
    )


@query("c5_reverse_word", "id bigint, visual string",
       with_views("roster_v") + "SELECT id, reverse(name) AS visual FROM roster_v")
def c5(spark, folder):
    return roster(spark, folder).select("id", text.reverse_word(F.col("name")).alias("visual"))


@query("c6_has_letter", "doc_id bigint, pieces bigint, with_letter bigint", r"""
SELECT doc_id, len(w) AS pieces, len(list_filter(w, lambda t: regexp_matches(t, '\p{L}'))) AS with_letter
FROM (SELECT doc_id, string_split(text, ' ') AS w FROM documents)""")
def c6(spark, folder):
    # NFKC turns no letter into a non-letter in running prose, so it is taken once per text.
    return (
        table(spark, folder, "documents")
        .select("doc_id", F.size(F.split("text", " ")).alias("pieces"), F.split(text.nfkc(F.col("text")), " ").alias("w"))
        .select("doc_id", "pieces", F.size(F.filter("w", lambda t: t.rlike(r"\p{L}"))).alias("with_letter"))
    )


HEADER_SQL = """CASE id % 4 WHEN 0 THEN 'class ' || grade || ' / ' || section WHEN 1 THEN 'class ' || grade || '\\' || section
         ELSE 'list' END"""


@query("c7_class_from_header", "id bigint, header string, sheet string, grade bigint, section bigint",
       with_views("roster_v") + f"""
SELECT id, header, sheet,
       CASE WHEN header LIKE 'class%' THEN g WHEN sheet LIKE 'sheet%' THEN NULL ELSE g END AS grade,
       CASE WHEN header LIKE 'class%' THEN s WHEN sheet LIKE 'sheet%' THEN NULL ELSE s END AS section
FROM (SELECT id, grade AS g, section AS s, {HEADER_SQL} AS header,
             CASE WHEN id % 4 = 3 THEN 'sheet ' || section
                  ELSE CASE grade WHEN 5 THEN 'خامس' WHEN 6 THEN 'سادس' WHEN 7 THEN 'سابع' ELSE 'ثامن' END
                       || '  ' || section END AS sheet
      FROM roster_v)""")
def c7(spark, folder):
    key, grade, section = F.col("id"), F.col("grade"), F.col("section")
    words = F.create_map(*[F.lit(x) for word, g in text.SHEET_GRADES.items() for x in (g, word)])
    return (
        roster(spark, folder)
        .select(
            "id",
            F.when(key % 4 == 0, F.concat(F.lit("class "), grade, F.lit(" / "), section))
            .when(key % 4 == 1, F.concat(F.lit("class "), grade, F.lit("\\"), section))
            .otherwise("list")
            .alias("header"),
            F.when(key % 4 == 3, F.concat(F.lit("sheet "), section))
            .otherwise(F.concat(F.element_at(words, grade.cast("int")), F.lit("  "), section))
            .alias("sheet"),
        )
        .withColumn("parsed", text.class_from_header(F.col("header"), F.col("sheet")))
        .select("id", "header", "sheet", "parsed.*")
    )


@query("c8_class_from_label", "id bigint, label string, grade bigint, section bigint",
       with_views("roster_v") + """
SELECT id, CASE WHEN id % 6 = 0 THEN w || ' ' || d || ' - ' || d WHEN id % 6 = 1 THEN 'غرفة ' || d ELSE w || '/' || d END AS label,
       CASE WHEN id % 6 >= 2 THEN grade END AS grade, CASE WHEN id % 6 >= 2 THEN section END AS section
FROM (SELECT *, CASE grade WHEN 5 THEN 'الخامس' WHEN 6 THEN 'الساد' WHEN 7 THEN 'السابع' ELSE 'الثامن' END AS w,
             translate(CAST(section AS VARCHAR), '0123456789', '٠١٢٣٤٥٦٧٨٩') AS d FROM roster_v)""")
def c8(spark, folder):
    key = F.col("id")
    word = F.element_at(
        F.create_map(*[F.lit(x) for p in ((5, "الخامس"), (6, "الساد"), (7, "السابع"), (8, "الثامن")) for x in p]),
        F.col("grade").cast("int"),
    )
    digits = F.translate(F.col("section").cast("string"), "0123456789", text.ARABIC_DIGITS[:10])
    label = (
        F.when(key % 6 == 0, F.concat(word, F.lit(" "), digits, F.lit(" - "), digits))
        .when(key % 6 == 1, F.concat(F.lit("غرفة "), digits))
        .otherwise(F.concat(word, F.lit("/"), digits))
    )
    return (
        roster(spark, folder)
        .select("id", label.alias("label"))
        .withColumn("parsed", text.class_from_label(F.col("label")))
        .select("id", "label", "parsed.*")
    )


@query("c9_compose_keys", "id bigint, class_code string, record_id string, page_id string",
       with_views("roster_v") + """
SELECT id, grade || '/' || section AS class_code, '2026-' || grade || '-' || section || '-' || roster_order AS record_id,
       'page-' || CASE WHEN id < 1000 THEN lpad(CAST(id AS VARCHAR), 3, '0') ELSE CAST(id AS VARCHAR) END AS page_id
FROM roster_v""")
def c9(spark, folder):
    return roster(spark, folder).select(
        "id",
        text.class_code(F.col("grade"), F.col("section")).alias("class_code"),
        text.record_id(F.lit("2026"), F.col("grade"), F.col("section"), F.col("roster_order")).alias("record_id"),
        text.page_id("page", F.col("id")).alias("page_id"),
    )


@query("c10_id_instant", "page_id bigint, source_id string, at_ms bigint, shown string", """
SELECT page_id, CAST(s AS VARCHAR) AS source_id, (s >> 22) + 1288834974657 AS at_ms,
       strftime(make_timestamp(((s >> 22) + 1288834974657) * 1000), '%Y-%m-%d %H:%M:%S.%g') AS shown
FROM (SELECT page_id, (page_id + 1) << 40 AS s FROM pages)""")
def c10(spark, folder):
    source_id = F.shiftleft(F.col("page_id") + 1, 40)
    millis = posts.id_millis(source_id)
    return table(spark, folder, "pages").select(
        "page_id",
        source_id.cast("string").alias("source_id"),
        millis.alias("at_ms"),
        F.date_format(F.timestamp_millis(millis), "yyyy-MM-dd HH:mm:ss.SSS").alias("shown"),
    )


@query("c11_post_instant", "event_id bigint, stamp string, at_us bigint, local_day date", """
SELECT event_id, stamp, epoch_us(instant) AS at_us, CAST(instant + INTERVAL 4 HOUR AS DATE) AS local_day
FROM (SELECT event_id, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') WHEN 1 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S')
                       WHEN 2 THEN strftime(ts + INTERVAL 3 HOUR, '%Y-%m-%dT%H:%M:%S+03:00') ELSE 'just now' END AS stamp,
             CASE WHEN event_id % 4 < 3 THEN date_trunc('second', ts)
                  ELSE make_timestamp((((event_id + 1) * 1024 + 5) + 1288834974657) * 1000) END AS instant FROM events)""")
def c11(spark, folder):
    key, ts = F.col("event_id"), F.col("ts")
    iso = "yyyy-MM-dd'T'HH:mm:ss"
    stamp = (
        F.when(key % 4 == 0, F.concat(F.date_format(ts, iso), F.lit("Z")))
        .when(key % 4 == 1, F.date_format(ts, iso))
        .when(key % 4 == 2, F.concat(F.date_format(ts + F.expr("INTERVAL 3 HOURS"), iso), F.lit("+03:00")))
        .otherwise("just now")
    )
    source_id = F.shiftleft((key + 1) * 1024 + 5, 22)
    return (
        table(spark, folder, "events")
        .select("event_id", stamp.alias("stamp"), posts.post_instant(stamp, source_id).alias("at"))
        .select("event_id", "stamp", F.unix_micros("at").alias("at_us"), posts.local_date(F.col("at")).alias("local_day"))
    )


@query("c12_classify", "doc_id bigint, category string, flagged boolean",
       f"SELECT doc_id, {CATEGORY_CASE} AS category, {CATEGORY_CASE} = 'guidance' AS flagged FROM documents")
def c12(spark, folder):
    return (
        table(spark, folder, "documents")
        .select("doc_id", posts.category(F.col("text"), LATIN_RULES).alias("category"))
        .withColumn("flagged", posts.is_flagged(F.col("category")))
    )


_LABEL_SQL = ", ".join(
    "CASE WHEN " + " OR ".join(f"contains(text, '{w}')" for w in words) + f" THEN '{name}' END"
    for name, words in LATIN_AUDIENCES
)


@query("c13_audiences", "doc_id bigint, audiences string", f"""
SELECT doc_id, CASE WHEN a = '' THEN 'everyone' ELSE a END AS audiences
FROM (SELECT doc_id, concat_ws(',', {_LABEL_SQL}, CASE WHEN doc_id % 9 = 0 THEN 'specialists' END) AS a FROM documents)""")
def c13(spark, folder):
    labels = posts.audiences(
        F.col("text"), F.col("doc_id") % 9 == 0, LATIN_AUDIENCES, flagged_label="specialists", default="everyone"
    )
    return table(spark, folder, "documents").select("doc_id", F.array_join(labels, ",").alias("audiences"))


@query("c14_grade_mentions", "doc_id bigint, grades string", """
SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN '5' WHEN 1 THEN '6,7' WHEN 2 THEN '6,8' ELSE '' END AS grades FROM documents""")
def c14(spark, folder):
    key = F.col("doc_id")
    tail = (
        F.when(key % 4 == 0, "صف  الخامس")
        .when(key % 4 == 1, "الصف السابع ثم صف٦ والصف السابع")
        .when(key % 4 == 2, "الصف 8 / صف السادس")
        .otherwise("الخامس 7")
    )
    return table(spark, folder, "documents").select(
        "doc_id",
        F.array_join(posts.grade_mentions(F.concat_ws(" ", "text", tail)).cast("array<string>"), ",").alias("grades"),
    )


@query("c15_title", "doc_id bigint, title string", SQL_VIEWS["titles_v"][1])
def c15(spark, folder):
    return table(spark, folder, "documents").select("doc_id", posts.title(F.col("text")).alias("title"))


def image_url():
    third = F.col("page_id") % 3
    suffix = F.when(third == 0, ".jpg?name=small").when(third == 1, ".webp").otherwise(".gif?x=a.png")
    return F.concat(F.element_at(F.split("url", r"[?#]"), 1), suffix)


PAGE_PATH_SQL = r"regexp_extract(url, '^https?://[^/?#]*([^?#]*)', 1)"


@query("c16_media_key", "page_id bigint, media_key string, page_key string", f"""
SELECT page_id, p || CASE WHEN page_id % 3 = 2 THEN '.gif' ELSE '' END AS media_key, p AS page_key
FROM (SELECT page_id, {PAGE_PATH_SQL} AS p FROM pages)""")
def c16(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id",
        posts.media_key(image_url()).alias("media_key"),
        posts.media_key(F.col("url")).alias("page_key"),
    )


@query("c17_media_stem", "page_id bigint, stem string", "SELECT page_id, substring(sha256(url), 1, 24) AS stem FROM pages")
def c17(spark, folder):
    return table(spark, folder, "pages").select("page_id", posts.media_stem(F.col("url")).alias("stem"))


@query("c18_allow_list", "page_id bigint, allowed boolean", r"""
SELECT page_id, regexp_matches(url, '^https://blog\.tionsh\.example\.net([/?#]|$)') AS allowed FROM pages""")
def c18(spark, folder):
    return table(spark, folder, "pages").select(
        "page_id", posts.is_allowed(F.col("url"), "blog.tionsh.example.net").alias("allowed")
    )


# Neighbouring names: each record beside the one with the next key.
def neighbours(spark, folder):
    left = roster(spark, folder).select("id", F.col("name").alias("a"))
    right = roster(spark, folder).select((F.col("id") - 1).alias("id"), F.col("name").alias("b"))
    return spread(left.join(right, "id"))


NEIGHBOURS_SQL = "neighbours AS (SELECT l.id, l.name AS a, r.name AS b FROM roster_v l JOIN roster_v r ON r.id = l.id + 1)"


def osa_rows_sql(pairs: str) -> str:
    """Recursive table fill over distinct pairs (a, b): one step per letter of a, rows as lists."""
    return f"""osa_pairs AS (SELECT DISTINCT a, b FROM {pairs}),
osa_rows(a, b, i, older, last) AS (
  SELECT a, b, 0, range(0, length(b) + 1), range(0, length(b) + 1) FROM osa_pairs
  UNION ALL
  SELECT a, b, i + 1, last, list_reduce(range(1, length(b) + 1), lambda acc, j: acc || [CAST(least(
      last[j + 1] + 1, acc[j] + 1, last[j] + CASE WHEN a[i + 1] = b[j] THEN 0 ELSE 1 END,
      CASE WHEN i > 0 AND j > 1 AND a[i + 1] = b[j - 1] AND a[i] = b[j] THEN older[j - 1] + 1 ELSE 1000 END) AS BIGINT)],
      [CAST(i + 1 AS BIGINT)])
  FROM osa_rows WHERE i < length(a)),
osa AS (SELECT a, b, last[length(b) + 1] AS distance FROM osa_rows WHERE i = length(a))"""


@query("c19_osa_distance", "id bigint, distance bigint",
       with_views("roster_v").replace("WITH ", "WITH RECURSIVE ", 1) + f", {NEIGHBOURS_SQL}, {osa_rows_sql('neighbours')} "
       "SELECT id, distance FROM neighbours JOIN osa USING (a, b)")
def c19(spark, folder):
    return neighbours(spark, folder).select("id", scoring.osa_distance(F.col("a"), F.col("b")).alias("distance"))


def token_score_sql(q: str, n: str, distance: str) -> str:
    return f"""CASE WHEN {q} = {n} THEN 100 WHEN starts_with({n}, {q}) THEN 92 WHEN contains({n}, {q}) THEN 82
  WHEN length({q}) < 3 OR {q}[1] <> {n}[1] THEN 0
  WHEN {distance} <= CASE WHEN length({q}) >= 7 THEN 2 ELSE 1 END THEN 62 - 8 * {distance} ELSE 0 END"""


# First and last words of neighbouring names, the query word with letters 2 and 3 swapped on odd ids.
TOKEN_PAIRS_SQL = """token_pairs AS (SELECT id, CASE WHEN id % 2 = 1 THEN w[1] || w[3] || w[2] || w[4:] ELSE w END AS a, n AS b
FROM (SELECT id, string_split(a, ' ')[1 + id % 3] AS w, string_split(b, ' ')[1 + id % 3] AS n FROM neighbours))"""


@query("c20_token_score", "id bigint, score bigint",
       with_views("roster_v").replace("WITH ", "WITH RECURSIVE ", 1)
       + f", {NEIGHBOURS_SQL}, {TOKEN_PAIRS_SQL}, {osa_rows_sql('token_pairs')} "
       f"SELECT id, {token_score_sql('a', 'b', 'distance')} AS score FROM token_pairs JOIN osa USING (a, b)")
def c20(spark, folder):
    pick = (F.col("id") % 3).cast("int")
    word = F.get(F.split("a", " "), pick)
    swapped = F.concat(F.substring(word, 1, 1), F.substring(word, 3, 1), F.substring(word, 2, 1), F.substring(word, F.lit(4), F.length(word)))
    pairs = neighbours(spark, folder).select(
        "id", F.when(F.col("id") % 2 == 1, swapped).otherwise(word).alias("q"), F.get(F.split("b", " "), pick).alias("n")
    )
    return pairs.select("id", scoring.token_score(F.col("q"), F.col("n")).alias("score"))


@query("c22_occupied", "l_orderkey bigint, l_linenumber bigint, l_partkey bigint, occupied bigint, is_double boolean",
       with_views("blocks_a") + """SELECT l_orderkey, l_linenumber, l_partkey, period_end - period_start + 1 AS occupied,
       period_end > period_start AS is_double FROM blocks_a""")
def c22(spark, folder):
    start, end = F.col("period_start"), F.col("period_end")
    return blocks_a(spark, folder).select(
        "l_orderkey", "l_linenumber", "l_partkey", text.occupied(start, end).alias("occupied"), (end > start).alias("is_double")
    )


@query("c23_placeholder", "id bigint, shown string, at_least_one boolean, at_least_two boolean",
       with_views("roster_v") + r"""
SELECT id, shown, len(t) >= 1 AND len(list_filter(t, lambda w: length(w) <> 1)) = 0 AS at_least_one,
       len(t) >= 2 AND len(list_filter(t, lambda w: length(w) <> 1)) = 0 AS at_least_two
FROM (SELECT *, list_filter(regexp_split_to_array(shown, '\s+'), lambda w: w <> '') AS t
      FROM (SELECT id, CASE id % 5 WHEN 0 THEN name[1] || ' ' || name[2] WHEN 1 THEN ' ' || name[1] WHEN 2 THEN ' ' ELSE name END AS shown
            FROM roster_v))""")
def c23(spark, folder):
    key, name = F.col("id"), F.col("name")
    shown = (
        F.when(key % 5 == 0, F.concat_ws(" ", F.substring(name, 1, 1), F.substring(name, 2, 1)))
        .when(key % 5 == 1, F.concat(F.lit(" "), F.substring(name, 1, 1)))
        .when(key % 5 == 2, " ")
        .otherwise(name)
    )
    return roster(spark, folder).select("id", shown.alias("shown")).select(
        "id",
        "shown",
        text.is_placeholder(F.col("shown")).alias("at_least_one"),
        text.is_placeholder(F.col("shown"), 2).alias("at_least_two"),
    )


@query("c24_space_run", "conv_id bigint, turn bigint, space_run boolean",
       f"SELECT conv_id, turn, regexp_matches(text, '{SPACE_SQL}{{2,}}') AS space_run FROM conversations")
def c24(spark, folder):
    return table(spark, folder, "conversations").select("conv_id", "turn", text.has_space_run(F.col("text")).alias("space_run"))


@query("c25_canonical_json", "o_orderkey bigint, json string", with_views("cand_orders") + """
SELECT o_orderkey, CAST(to_json({'cents': cents, 'day': day, 'o_custkey': o_custkey, 'o_orderkey': o_orderkey,
   'o_orderpriority': o_orderpriority, 'o_orderstatus': o_orderstatus}) AS VARCHAR) AS json FROM cand_orders""")
def c25(spark, folder):
    from muster.plans.views import cand_orders

    df = cand_orders(spark, folder)
    return df.select("o_orderkey", text.canonical_json(*df.columns).alias("json"))


@query("c26_printed_date", "o_orderkey bigint, printed string, day date", """
SELECT o_orderkey, CASE WHEN o_orderkey % 7 = 0 THEN strftime(o_orderdate, '%d/%m/%y') ELSE
         translate(strftime(o_orderdate, '%d/%m/%Y'), '0123456789', '٠١٢٣٤٥٦٧٨٩') END AS printed,
       CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS day FROM orders""")
def c26(spark, folder):
    shown = F.translate(F.date_format("o_orderdate", "dd/MM/yyyy"), "0123456789", text.ARABIC_DIGITS[:10])
    printed = F.when(F.col("o_orderkey") % 7 == 0, F.date_format("o_orderdate", "dd/MM/yy")).otherwise(shown)
    return (
        table(spark, folder, "orders")
        .select("o_orderkey", printed.alias("printed"))
        .withColumn("day", text.printed_date(F.col("printed")))
    )
