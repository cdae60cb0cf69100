"""Directory, timetable and archive shaped views over the given tables, in Spark and as SQL text.

The two definitions of each view are kept side by side; ``with_views`` puts the SQL ones, with what
they need, in front of a query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from muster.functions import posts, text


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


# --- roster -------------------------------------------------------------------------------------

# Ordinary words standing in for the words of the part names.
ARABIC_WORDS = {
    "small": "صغير", "red": "احمر", "hot": "ساخن", "old": "قديم", "large": "كبير", "blue": "ازرق",
    "cold": "بارد", "new": "جديد", "ring": "حلقه", "plate": "لوحه", "widget": "اداه", "rod": "قضيب",
    "gizmo": "كرسي", "bolt": "مسمار", "gear": "عجله", "anvil": "سندان", "ECONOMY": "اقتصادي",
    "LARGE": "واسع", "STANDARD": "عادي", "MEDIUM": "وسط", "SMALL": "ضيق", "PROMO": "ترويجي",
}


def roster(spark: SparkSession, folder: str) -> DataFrame:
    part = table(spark, folder, "part")
    key = F.col("p_partkey")
    return part.select(
        key.alias("id"),
        F.concat_ws(" ", "p_name", "p_type").alias("name"),
        (5 + F.col("p_size") % 4).cast("bigint").alias("grade"),
        (1 + key % 11).alias("section"),
        key.alias("roster_order"),
        F.when(key % 5 == 0, F.concat(F.lit("E"), key.cast("string"))).alias("number"),
    )


def _spelling(name: Column, variant: Column) -> Column:
    return (
        F.when(variant == 1, F.regexp_replace(name, "(^| )ا", "$1أ"))
        .when(variant == 2, F.regexp_replace(name, "ه( |$)", "ة$1"))
        .when(variant == 3, F.regexp_replace(name, "ي( |$)", "ى$1"))
        .when(variant == 4, F.regexp_replace(name, "^(.)", "$1ـ"))
        .when(variant == 5, F.regexp_replace(name, "^(.)", "$1َ"))
        .otherwise(name)
    )


def roster_ar(spark: SparkSession, folder: str) -> DataFrame:
    words = F.create_map(*[F.lit(x) for pair in ARABIC_WORDS.items() for x in pair])
    translated = F.array_join(F.transform(F.split("name", " "), lambda w: F.element_at(words, w)), " ")
    return roster(spark, folder).withColumn("name", _spelling(translated, F.col("id") % 6))


_WORD_CASE = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in ARABIC_WORDS.items())

SQL_VIEWS: dict[str, tuple[tuple[str, ...], str]] = {}

SQL_VIEWS["roster_v"] = ((), """
SELECT p_partkey AS id, p_name || ' ' || p_type AS name, CAST(5 + p_size % 4 AS BIGINT) AS grade,
       1 + p_partkey % 11 AS section, p_partkey AS roster_order,
       CASE WHEN p_partkey % 5 = 0 THEN 'E' || p_partkey END AS number
FROM part""")

SQL_VIEWS["roster_ar_v"] = (("roster_v",), f"""
SELECT id, CASE id % 6
         WHEN 1 THEN regexp_replace(n, '(^| )ا', '\\1أ', 'g')
         WHEN 2 THEN regexp_replace(n, 'ه( |$)', 'ة\\1', 'g')
         WHEN 3 THEN regexp_replace(n, 'ي( |$)', 'ى\\1', 'g')
         WHEN 4 THEN regexp_replace(n, '^(.)', '\\1ـ')
         WHEN 5 THEN regexp_replace(n, '^(.)', '\\1' || chr(1614))
         ELSE n END AS name, grade, section, roster_order, number
FROM (SELECT *, array_to_string(list_transform(string_split(name, ' '),
        lambda w: CASE w {_WORD_CASE} END), ' ') AS n FROM roster_v)""")

# Queries as typed by users: exact, prefix, inside, joined words, reordered, swapped letters, one typo
# in a long token, short, external number, browse, not ready, no hit.
QUERY_ROWS = """VALUES
 (1, 'small ring ECONOMY', NULL, NULL), (2, 'small ri', NULL, NULL), (3, 'ring ECO', NULL, NULL),
 (4, 'smallring', NULL, NULL), (5, 'ring small', NULL, NULL), (6, 'samll rign', NULL, NULL),
 (7, 'ECNOOMY gizmo', NULL, NULL), (8, 're', NULL, NULL), (9, '', 6, 3), (10, '', 6, NULL),
 (11, 'zzzzz', NULL, NULL), (12, 'E35', NULL, NULL), (13, 'red', 7, NULL), (14, 'STANARD bolt', NULL, 4),
 (15, '  hot   gear ', NULL, NULL), (16, 'p anvil', NULL, NULL), (17, 'wigdet STNADARD', 5, NULL),
 (18, 'ـ', 6, NULL), (19, chr(9), 6, 3), (20, chr(9) || chr(160), 6, NULL), (21, chr(9) || 'E35', NULL, NULL), (22, 'ـ', NULL, 4)"""

QUERY_ROWS_AR = """VALUES
 (1, 'حلقة صغيرة', NULL, NULL), (2, 'احمر لوحه', NULL, NULL), (3, 'أحمرلوحة', NULL, NULL),
 (4, 'احمر لوحة', NULL, NULL), (5, 'كرسى', NULL, NULL), (6, 'اقتصداي جديد', NULL, NULL),
 (7, 'قديم مسمار', 6, NULL), (8, 'ازرق', NULL, 5), (9, '', 7, 2)"""


def query_rows(spark: SparkSession, rows: str = QUERY_ROWS) -> DataFrame:
    return spark.sql(
        f"SELECT CAST(query_id AS BIGINT) query_id, query, CAST(grade AS BIGINT) grade, "
        f"CAST(section AS BIGINT) section FROM {rows} AS q(query_id, query, grade, section)"
    )


SQL_VIEWS["queries_v"] = ((), f"SELECT * FROM ({QUERY_ROWS}) AS q(query_id, query, grade, section)")
SQL_VIEWS["queries_ar_v"] = ((), f"SELECT * FROM ({QUERY_ROWS_AR}) AS q(query_id, query, grade, section)")


# --- timetable ----------------------------------------------------------------------------------

ROW_ORDER = ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
ROW_ORDER_SQL = ", ".join(ROW_ORDER)


def blocks_a(spark: SparkSession, folder: str) -> DataFrame:
    lines = table(spark, folder, "lineitem").select(*ROW_ORDER, "l_returnflag", "l_linestatus")
    return lines.select(
        *ROW_ORDER,
        F.col("l_suppkey").alias("owner"),
        (F.col("l_orderkey") % 5).alias("day_index"),
        F.col("l_linenumber").cast("bigint").alias("period_start"),
        (F.col("l_linenumber") + F.when(F.col("l_quantity") >= 45, 1).otherwise(0)).cast("bigint").alias("period_end"),
        (5 + F.col("l_partkey") % 4).alias("grade"),
        (1 + F.col("l_partkey") % 11).alias("section"),
        text.class_code(5 + F.col("l_partkey") % 4, 1 + F.col("l_partkey") % 11).alias("class_code"),
        F.concat("l_returnflag", "l_linestatus").alias("subject"),
    )


SQL_VIEWS["blocks_a"] = ((), f"""
SELECT {ROW_ORDER_SQL}, l_suppkey AS owner, l_orderkey % 5 AS day_index, l_linenumber AS period_start,
       l_linenumber + CASE WHEN l_quantity >= 45 THEN 1 ELSE 0 END AS period_end,
       5 + l_partkey % 4 AS grade, 1 + l_partkey % 11 AS section,
       (5 + l_partkey % 4) || '/' || (1 + l_partkey % 11) AS class_code,
       l_returnflag || l_linestatus AS subject
FROM lineitem""")


def blocks_b(spark: SparkSession, folder: str) -> DataFrame:
    """The second source: blocks_a with rows missing, subjects changed and rows doubled under another owner."""
    base = blocks_a(spark, folder)
    copies = F.when(F.col("l_orderkey") % 101 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return (
        base.filter(F.col("l_orderkey") % 97 != 0)
        .withColumn("subject", F.when(F.col("l_partkey") % 89 == 0, "XX").otherwise(F.col("subject")))
        .withColumn("copy", F.explode(copies))
        .withColumn("owner", F.col("owner") + F.col("copy"))
    )


SQL_VIEWS["blocks_b"] = (("blocks_a",), """
SELECT a.* REPLACE (CASE WHEN l_partkey % 89 = 0 THEN 'XX' ELSE subject END AS subject, owner + copy AS owner), copy
FROM blocks_a a, (VALUES (0), (1)) AS c(copy)
WHERE l_orderkey % 97 <> 0 AND (copy = 0 OR l_orderkey % 101 = 0)""")

for _side in "ab":
    SQL_VIEWS[f"slots_{_side}"] = ((f"blocks_{_side}",), f"""
SELECT *, unnest(range(period_start, period_end + 1)) AS period FROM blocks_{_side}""")


def owners(spark: SparkSession, folder: str) -> DataFrame:
    """Schedule owners: a name of two words, and the page they are printed on."""
    supplier = table(spark, folder, "supplier")
    return supplier.select(
        F.col("s_suppkey").alias("owner"),
        F.concat(F.col("s_name"), F.lit(" NATION_"), F.col("s_nationkey").cast("string")).alias("name"),
        (F.col("s_suppkey") + 1).alias("source_page"),
    )


SQL_VIEWS["owners_v"] = ((), """
SELECT s_suppkey AS owner, s_name || ' NATION_' || s_nationkey AS name, s_suppkey + 1 AS source_page
FROM supplier""")

# Facet sets: any of grade, subject, day and period may be left open.
FACET_ROWS = """VALUES
 (1, 7, 'RF', 2, 3), (2, NULL, 'AO', NULL, 8), (3, 5, NULL, NULL, NULL), (4, NULL, NULL, 4, 1),
 (5, 8, 'NO', 0, NULL), (6, NULL, 'ZZ', NULL, NULL), (7, 6, NULL, 1, 2)"""


def facet_rows(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT CAST(query_id AS BIGINT) query_id, CAST(grade AS BIGINT) grade, subject, "
        "CAST(day_index AS BIGINT) day_index, CAST(period AS BIGINT) period "
        f"FROM {FACET_ROWS} AS f(query_id, grade, subject, day_index, period)"
    )


SQL_VIEWS["facets_v"] = ((), f"SELECT * FROM ({FACET_ROWS}) AS f(query_id, grade, subject, day_index, period)")

OWNER_QUERY_ROWS = """VALUES
 (1, 'Supplier#000000003', NULL, NULL, NULL, NULL), (2, 'NATION_7', NULL, NULL, NULL, NULL),
 (3, 'Suplier#000000009', 7, NULL, NULL, NULL), (4, 'NATION_1 Supplier#', NULL, 'RF', 2, 3),
 (5, '', 6, 'AO', 1, 2), (6, '', NULL, NULL, NULL, NULL), (7, 'NAITON_3', NULL, NULL, 4, 1),
 (8, 'Supplier#00000000', 5, NULL, NULL, 8), (9, 'Supplier', NULL, 'ZZ', NULL, NULL),
 (10, 'ـ', 6, 'AO', 1, 2), (11, chr(9), NULL, NULL, NULL, NULL)"""


def owner_query_rows(spark: SparkSession) -> DataFrame:
    return spark.sql(
        "SELECT CAST(query_id AS BIGINT) query_id, query, CAST(grade AS BIGINT) grade, subject, "
        "CAST(day_index AS BIGINT) day_index, CAST(period AS BIGINT) period "
        f"FROM {OWNER_QUERY_ROWS} AS f(query_id, query, grade, subject, day_index, period)"
    )


SQL_VIEWS["owner_queries_v"] = (
    (), f"SELECT * FROM ({OWNER_QUERY_ROWS}) AS f(query_id, query, grade, subject, day_index, period)"
)


# --- records in two versions ----------------------------------------------------------------------

def orders(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        "o_orderpriority",
        F.round(F.col("o_totalprice") * 100).cast("bigint").alias("cents"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
    )


def cand_orders(spark: SparkSession, folder: str) -> DataFrame:
    return orders(spark, folder).filter(F.col("o_orderkey") % 103 != 0).withColumn(
        "o_orderstatus", F.when(F.col("o_orderkey") % 83 == 0, "X").otherwise(F.col("o_orderstatus"))
    ).withColumn("cents", F.when(F.col("o_orderkey") % 211 == 0, None).otherwise(F.col("cents")))


SQL_VIEWS["orders_v"] = ((), """
SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority, CAST(round(o_totalprice * 100) AS BIGINT) AS cents,
       strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders""")
SQL_VIEWS["cand_orders"] = (("orders_v",), """
SELECT * REPLACE (CASE WHEN o_orderkey % 83 = 0 THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
                  CASE WHEN o_orderkey % 211 = 0 THEN NULL ELSE cents END AS cents)
FROM orders_v WHERE o_orderkey % 103 <> 0""")


# --- cells of sheets ------------------------------------------------------------------------------

def cells(spark: SparkSession, folder: str) -> DataFrame:
    """Sheet cells from conversations: column 0 the number (with gaps), column 1 the name (some blank)."""
    talk = table(spark, folder, "conversations")
    number = F.col("turn") + 1 + F.when((F.col("conv_id") % 7 == 0) & (F.col("turn") >= 2), 1).otherwise(0)
    name = F.when((F.col("conv_id") + F.col("turn")) % 11 == 0, "  ").otherwise(F.col("text"))
    return talk.select(
        F.concat(F.lit("خامس "), F.col("conv_id").cast("string")).alias("sheet"),
        F.col("turn").alias("row"),
        F.explode(
            F.array(
                F.struct(F.lit(0).alias("col"), number.cast("double").alias("num"), F.lit(None).cast("string").alias("str")),
                F.struct(F.lit(1).alias("col"), F.lit(None).cast("double").alias("num"), name.alias("str")),
            )
        ).alias("cell"),
    ).select("sheet", "row", "cell.*")


SQL_VIEWS["sheet_rows_v"] = ((), """
SELECT 'خامس ' || conv_id AS sheet, conv_id, turn AS row,
       turn + 1 + CASE WHEN conv_id % 7 = 0 AND turn >= 2 THEN 1 ELSE 0 END AS number,
       CASE WHEN (conv_id + turn) % 11 = 0 THEN '  ' ELSE text END AS name
FROM conversations""")


# --- archive --------------------------------------------------------------------------------------

# Latin keyword rules, so that the invented prose has hits.
LATIN_RULES = (
    ("guidance", ("schder", "nterti")), ("transport", ("ierouai", "sitedio")), ("health", ("onaile", "ndern")),
    ("honors", ("ouque", "edata")), ("visits", ("retion", "iterel")), ("community", ("entha", "enauch")),
    ("media", ("euxa", "aslos")), ("administration", ("hand", "cion")), ("teaching", ("the", "und")),
)
LATIN_AUDIENCES = (("students", ("the", "les")), ("staff", ("of", "sch")), ("parents", ("que", "and")))
RANGE_START = "2024-01-01"


def archive(spark: SparkSession, folder: str) -> DataFrame:
    """Archive records from documents: dated, classified, with audiences, grades and media."""
    key = F.col("doc_id")
    labels = table(spark, folder, "labels").select("doc_id", "quality")
    category = posts.category(F.col("text"), LATIN_RULES)
    base = table(spark, folder, "documents").select("doc_id", "text", "lang").join(labels, "doc_id", "left")
    media = F.transform(
        F.sequence(F.lit(1), key % 3 + F.lit(0)),
        lambda i: F.struct(
            F.lit("image").alias("type"),
            F.concat(
                F.when(key % 17 == 0, "http").otherwise("https"),
                F.lit("://media.example.org/m/"),
                F.floor(key / 2).cast("string"), F.lit("-"), i.cast("string"), F.lit(".jpg"),
            ).alias("url"),
            F.when(key % 5 == 0, F.concat(F.lit("/activity-media/"), key.cast("string"), F.lit(".jpg"))).alias("localPath"),
            F.lit("cover").alias("alt"),
        ),
    )
    return base.select(
        key.alias("doc_id"),
        F.concat(F.lit("d-"), key.cast("string")).alias("id"),
        F.date_add(F.to_date(F.lit(RANGE_START)), (key % 30).cast("int")).alias("date"),
        posts.title(F.col("text")).alias("title"),
        F.col("text").alias("description"),
        category.alias("category"),
        (F.coalesce(F.col("quality"), F.lit(0)) == 1).alias("specialist"),
        F.array(F.col("lang"), F.when(key % 2 == 0, "طلبة").otherwise("معلمون")).alias("audiences"),
        F.array(F.concat(F.lit("person "), (key % 10).cast("string"))).alias("people"),
        F.when(key % 3 == 0, F.array(5 + key % 4)).otherwise(F.array().cast("array<bigint>")).alias("grades"),
        F.when(key % 3 == 0, F.array().cast(MEDIA_TYPE)).otherwise(media.cast(MEDIA_TYPE)).alias("media"),
    )


MEDIA_TYPE = "array<struct<type:string,url:string,localPath:string,alt:string>>"


def _sql_mentions(column: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{w}')" for w in words) + ")"


CATEGORY_CASE = "CASE " + " ".join(
    f"WHEN {_sql_mentions('text', words)} THEN '{name}'" for name, words in LATIN_RULES
) + f" ELSE '{posts.DEFAULT_CATEGORY}' END"

SQL_VIEWS["titles_v"] = ((), f"""
SELECT doc_id, CASE WHEN s = '' THEN '{posts.TITLE_DEFAULT}' WHEN length(s) <= {posts.TITLE_LIMIT} THEN s
            ELSE regexp_replace(substring(s, 1, {posts.TITLE_CUT}), ' [^ ]*$', '') || '…' END AS title
FROM (SELECT doc_id, regexp_replace(regexp_extract(
               regexp_replace(regexp_replace(text, 'https?://[^\\s]+|#[\\p{{L}}\\p{{N}}_\\x{{600}}-\\x{{6FF}}]+', '', 'g'),
                              '^[ .،ـ-]+|[ .،ـ-]+$', '', 'g'), '^[^!؟\\n]*'), '^\\s+|\\s+$', '', 'g') AS s
      FROM documents)""")

SQL_VIEWS["archive_v"] = (("titles_v",), f"""
SELECT d.doc_id, 'd-' || d.doc_id AS id, DATE '{RANGE_START}' + CAST(d.doc_id % 30 AS INTEGER) AS date, title,
       text AS description, {CATEGORY_CASE} AS category, coalesce(quality, 0) = 1 AS specialist,
       [lang, CASE WHEN d.doc_id % 2 = 0 THEN 'طلبة' ELSE 'معلمون' END] AS audiences,
       ['person ' || (d.doc_id % 10)] AS people,
       CASE WHEN d.doc_id % 3 = 0 THEN [5 + d.doc_id % 4] ELSE [] END AS grades,
       list_transform(range(1, d.doc_id % 3 + 1), lambda i: CASE WHEN d.doc_id % 17 = 0 THEN 'http' ELSE 'https' END
           || '://media.example.org/m/' || (d.doc_id // 2) || '-' || i || '.jpg') AS media,
       CASE WHEN d.doc_id % 5 = 0 THEN '/activity-media/' || d.doc_id || '.jpg' END AS local_path
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id JOIN titles_v t ON t.doc_id = d.doc_id""")


# --- status and geometry --------------------------------------------------------------------------

def statuses(spark: SparkSession, folder: str) -> DataFrame:
    return status_columns(table(spark, folder, "events"))


def status_columns(events: DataFrame) -> DataFrame:
    return events.select(
        "user_id",
        "event_id",
        F.unix_micros(F.col("ts").cast("timestamp")).alias("micros"),
        F.when(F.col("event_type") == "error", "failure").otherwise("success").alias("state"),
    )


SQL_VIEWS["status_v"] = ((), """
SELECT user_id, event_id, epoch_us(ts) AS micros, CASE WHEN event_type = 'error' THEN 'failure' ELSE 'success' END AS state
FROM events""")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """Words on pages: a page is a day and an event type, y the second of the day, x the value."""
    ts = F.col("ts")
    return table(spark, folder, "events").select(
        "event_id",
        F.concat_ws("/", F.date_format(ts, "yyyy-MM-dd"), "event_type").alias("page"),
        (F.hour(ts) * 3600 + F.minute(ts) * 60 + F.floor(F.second(ts))).cast("bigint").alias("y"),
        F.col("value").alias("x"),
        F.concat(F.lit("w"), F.col("event_id").cast("string")).alias("text"),
    )


def rulings(spark: SparkSession, folder: str) -> DataFrame:
    """Ruling lines: the first event of each two hours on each page."""
    p = points(spark, folder)
    return p.groupBy("page", F.floor(F.col("y") / 7200).alias("band")).agg(F.min("y").alias("y")).select("page", "y")


SQL_VIEWS["points_v"] = ((), """
SELECT event_id, strftime(ts, '%Y-%m-%d') || '/' || event_type AS page,
       CAST(hour(ts) * 3600 + minute(ts) * 60 + second(ts) AS BIGINT) AS y, value AS x, 'w' || event_id AS text
FROM events""")
SQL_VIEWS["rulings_v"] = (("points_v",), "SELECT page, min(y) AS y FROM points_v GROUP BY page, y // 7200")
SQL_VIEWS["ruling_cells_v"] = (("rulings_v",), """
SELECT * FROM (SELECT page, y AS y0, lead(y) OVER (PARTITION BY page ORDER BY y) AS y1 FROM rulings_v)
WHERE y1 IS NOT NULL""")


# --- snapshots and the archive they feed -----------------------------------------------------------

ACCOUNT = "lantern_school"
SYNC_START = "2024-01-01"
VERIFIED = "2024-03-01"


def snapshots(pages: DataFrame) -> DataFrame:
    """Snapshots from pages: the whole page, with each article as the text of a post, a status link, often a time, and images.

    Neighbouring pages share an image; posts without a time are dated by their id, which is before the
    start of the archive. Each page holds its post twice.
    """
    key = F.col("page_id")
    source = F.shiftleft(key + 1, 40).cast("string")
    stamp = F.date_format(F.timestamp_millis(F.lit(1704067200000) + key * 3600000), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    time = F.when(key % 7 != 0, F.concat(F.lit('<time datetime="'), stamp, F.lit('">now</time>'))).otherwise("")
    image = F.concat(F.lit(f"<img src=\"https://{posts.MEDIA_HOST}/media/M"), F.floor(key / 2).cast("string"), F.lit('.jpg?name=small">'))
    post = F.concat(
        F.lit('<article><div data-testid="tweetText">$1'), F.lit(f'</div><a href="/{ACCOUNT}/status/'), source,
        F.lit('">'), time, F.lit("</a>"), image, F.lit("</article>"),
    )
    whole = F.regexp_replace("html", F.lit("(?s)<article>(.*?)</article>"), F.concat(post, post))
    return pages.select(key.alias("snapshot_id"), whole.alias("html"))


SQL_VIEWS["posts_v"] = ((), f"""
SELECT page_id, CAST(((page_id + 1) << 40) AS VARCHAR) AS source_id,
       trim(regexp_replace(regexp_replace(regexp_replace(replace(regexp_replace(regexp_extract(html, '(?s)<article>(.*?)</article>', 1), '<[^>]*>', ' ', 'g'),
            '&quot;', '"'), '&amp;?', '&', 'g'), '&amp;?', '&', 'g'), '\\s+', ' ', 'g')) AS text,
       CASE WHEN page_id % 7 <> 0 THEN strftime(make_timestamp((1704067200000 + page_id * 3600000) * 1000), '%Y-%m-%dT%H:%M:%SZ') END AS stamp,
       CAST(CASE WHEN page_id % 7 <> 0 THEN make_timestamp((1704067200000 + page_id * 3600000) * 1000)
            ELSE make_timestamp(((page_id + 1) * 262144 + 1288834974657) * 1000) END + INTERVAL 4 HOUR AS DATE) AS date,
       'https://{posts.MEDIA_HOST}/media/M' || (page_id // 2) || '.jpg?name=small' AS image
FROM pages""")


def stored_archive(spark: SparkSession, folder: str) -> DataFrame:
    """The archive before the run: of three pages one is linked, one has only the image, one is not there."""
    from muster.operators.archive import ARCHIVE_SCHEMA

    key = F.col("page_id")
    media = F.array(
        F.struct(
            F.lit("image").alias("type"),
            F.concat(F.lit(f"https://{posts.MEDIA_HOST}/media/M"), F.floor(key / 2).cast("string"), F.lit(".png")).alias("url"),
            F.lit(None).cast("string").alias("localPath"),
            F.lit("kept").alias("alt"),
        )
    )
    rows = table(spark, folder, "pages").filter(key % 3 != 2).select(
        F.concat(F.lit("r-"), key.cast("string")).alias("id"),
        F.when(key % 3 == 0, F.shiftleft(key + 1, 40).cast("string")).alias("source_id"),
        F.to_date(F.lit(SYNC_START)).alias("date"),
        F.concat(F.lit("kept "), key.cast("string")).alias("title"),
        F.lit("old text").alias("description"),
        F.lit("visits").alias("category"),
        F.array(F.lit("all")).alias("audiences"),
        F.array().cast("array<string>").alias("people"),
        F.array().cast("array<int>").alias("grades"),
        F.lit(False).alias("specialist"),
        F.when(key % 2 == 0, media).otherwise(F.array().cast(MEDIA_TYPE)).cast(MEDIA_TYPE).alias("media"),
        F.lit("https://example.org/").alias("source_url"),
        F.lit("old").alias("source_label"),
        F.when(key % 4 == 0, F.to_date(F.lit("2024-02-02"))).alias("verified_at"),
    )
    return rows.to(spark.createDataFrame([], ARCHIVE_SCHEMA).schema)


SQL_VIEWS["stored_v"] = ((), f"""
SELECT page_id, 'r-' || page_id AS id, CASE WHEN page_id % 3 = 0 THEN CAST(((page_id + 1) << 40) AS VARCHAR) END AS source_id,
       DATE '{SYNC_START}' AS date, 'kept ' || page_id AS title, 'old text' AS description,
       CASE WHEN page_id % 2 = 0 THEN 'https://{posts.MEDIA_HOST}/media/M' || (page_id // 2) || '.png' END AS media_url,
       CASE WHEN page_id % 4 = 0 THEN DATE '2024-02-02' END AS verified_at
FROM pages WHERE page_id % 3 <> 2""")

# Posts and the record each belongs to: by id, or the only unlinked record with the same image, earliest post first.
SQL_VIEWS["matches_v"] = (("posts_v", "stored_v"), f"""
SELECT p.source_id, s.id FROM posts_v p JOIN stored_v s ON s.source_id = p.source_id WHERE p.date >= DATE '{SYNC_START}'
UNION ALL
SELECT source_id, id FROM (
  SELECT p.source_id, min(s.id) AS id, row_number() OVER (PARTITION BY min(s.id) ORDER BY p.page_id) AS turn
  FROM posts_v p JOIN stored_v s ON s.source_id IS NULL AND s.media_url = replace(p.image, '.jpg?name=small', '.png')
  WHERE p.date >= DATE '{SYNC_START}' AND p.source_id NOT IN (SELECT source_id FROM stored_v WHERE source_id IS NOT NULL)
  GROUP BY p.source_id, p.page_id HAVING count(DISTINCT s.id) = 1) WHERE turn = 1""")
SQL_VIEWS["merged_v"] = (("matches_v",), f"""
SELECT s.id, coalesce(p.source_id, s.source_id) AS source_id, coalesce(p.date, s.date) AS date, s.title,
       coalesce(p.text, s.description) AS description, coalesce(s.verified_at, CASE WHEN p.source_id IS NOT NULL THEN DATE '{VERIFIED}' END) AS verified_at,
       CASE WHEN p.source_id IS NULL THEN coalesce(media_url, '') WHEN media_url IS NULL THEN p.image
            WHEN media_url = replace(p.image, '.jpg?name=small', '.png') THEN media_url ELSE media_url || ' ' || p.image END AS media,
       CASE WHEN p.source_id IS NULL THEN 'unchanged' ELSE 'enriched' END AS change
FROM stored_v s LEFT JOIN matches_v m ON m.id = s.id LEFT JOIN posts_v p ON p.source_id = m.source_id
UNION ALL
SELECT 'x-' || source_id, source_id, date, NULL, text, DATE '{VERIFIED}', image, 'added'
FROM posts_v WHERE date >= DATE '{SYNC_START}' AND source_id NOT IN (SELECT source_id FROM matches_v)""")


# --- SQL assembly ---------------------------------------------------------------------------------

def with_views(*names: str) -> str:
    """A WITH clause defining the named views and all they rest on."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for need in SQL_VIEWS[name][0]:
                visit(need)
            order.append(name)

    for name in names:
        visit(name)
    return "WITH " + ",\n".join(f"{n} AS ({SQL_VIEWS[n][1]})" for n in order) + "\n"
