"""Lessons of printed pages (J10, J14, W3, A16 together): a page per order, a printed lesson per line of it."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import lessons
from muster.plans.views import table
from muster.registry import query

# The printed page: five rows of 40 below 100, eight columns of 80 right of 100. Uprights 0, 3 and 8 run over the whole table,
# the others stand in single rows and are missing where cells are merged; some rows lack all of them.
GRADE_WORDS = ("الصف الخامس", "الساد", "السابع", "الثامن")
GRADE_WORDS_SQL = ", ".join(f"'{w}'" for w in GRADE_WORDS)

PAGES_SQL = f"""
WITH pages AS (SELECT DISTINCT l_orderkey AS page FROM lineitem), rows_ AS (
  SELECT page, d AS day_index, 120.0 + 40 * d AS centre FROM pages, (SELECT unnest(range(5)) AS d)
), uprights AS (
  SELECT page, j, 100.0 + 80 * j AS x, NULL AS d FROM pages, (SELECT unnest([0, 3, 8]) AS j)
  UNION ALL
  SELECT page, j, 100.0 + 80 * j, day_index FROM rows_, (SELECT unnest([1, 2, 4, 5, 6, 7]) AS j)
  WHERE (page + 3 * day_index + j) % 4 <> 0 AND NOT (page % 13 = 5 AND day_index = 2)
), crossed AS (
  SELECT r.page, r.day_index, r.centre, u.x FROM rows_ r JOIN uprights u ON u.page = r.page AND (u.d IS NULL OR u.d = r.day_index)
), whole AS (
  SELECT *, count(*) OVER (PARTITION BY page, day_index) AS n, lead(x) OVER (PARTITION BY page, day_index ORDER BY x) AS x1 FROM crossed
), cells AS (
  SELECT page, day_index, centre, x AS x0, x1, 1 + CAST(x - 100 AS BIGINT) // 80 AS first, CAST(x1 - 100 AS BIGINT) // 80 AS last FROM whole WHERE n >= 4 AND x1 IS NOT NULL
), lines AS (
  SELECT l_orderkey AS page, l_linenumber AS line, l_partkey AS part, l_suppkey AS supp, 140.0 + 80 * (l_partkey % 8) AS c,
    120.0 + 40 * ((l_linenumber - 1) % 5) AS m FROM lineitem
), words AS (
  SELECT page, line * 10 + 1 AS word, c - 11 AS x, m - 6 AS y, c - 20 AS x0, m - 10 AS y0, 12.0 AS size, [{GRADE_WORDS_SQL}][1 + supp % 4] AS text, '' AS digits, c AS dx FROM lines
  UNION ALL SELECT page, line * 10 + 2, c + 5, m - 6, c + 1, m - 10, 12.0, translate(reverse(CAST(supp % 12 + 1 AS VARCHAR)), '0123456789', '٠١٢٣٤٥٦٧٨٩'), CAST(supp % 12 + 1 AS VARCHAR), c + 2 FROM lines WHERE part % 9 <> 0
  UNION ALL SELECT page, line * 10 + 3, c + 10, m + 5, c + 5, m + 2, 9.0, 'S' || part % 50, '', c FROM lines WHERE part % 7 <> 0
  UNION ALL SELECT page, line * 10 + 4, c - 10, m + 5, c - 15, m + 2, 9.0, 'T' || supp % 5, '', c FROM lines WHERE part % 7 <> 0
  UNION ALL SELECT page, line * 10 + 5, c, m + 12, c - 5, m + 10, 8.0, 'حاسوب ' || part % 3, '', c FROM lines WHERE part % 5 = 0
  UNION ALL SELECT page, line * 10 + 6, c, m + 15, c - 5, m + 13, 8.0, '12', '', c FROM lines WHERE part % 3 = 0
  UNION ALL SELECT page, line * 10 + 7, 340.0, m, 335.0, m - 2, 8.0, 'stray', '', c FROM lines WHERE part % 11 = 0
  UNION ALL SELECT page, line * 10 + 8, 70.0, m, 65.0, m - 2, 8.0, 'margin', '', c FROM lines WHERE part % 11 = 0
), inside AS (
  SELECT k.page, k.day_index, k.first, k.last, k.x0 AS cx, w.* EXCLUDE (page), max(size) OVER (PARTITION BY k.page, k.day_index, k.x0) AS top
  FROM cells k JOIN words w ON w.page = k.page AND w.x > k.x0 AND w.x < k.x1 AND w.y > k.centre - 20 AND w.y < k.centre + 20
), glyphs AS (
  SELECT page, day_index, cx, string_agg(digits[i], '' ORDER BY dx + 4 * (i - 1), word, i, digits[i]) AS digits
  FROM (SELECT *, unnest(range(1, length(digits) + 1)) AS i FROM inside WHERE size = top) GROUP BY ALL
), told AS (
  SELECT page, day_index, first, last, cx, coalesce(string_agg(text, ' ' ORDER BY word, x0, text) FILTER (size = top), '') AS class_text,
    coalesce(string_agg(text, ' ' ORDER BY y0, -x0, word, text) FILTER (size < top AND text NOT LIKE '%حاسوب%' AND text <> '12'), '') AS subject
  FROM inside GROUP BY ALL
), parsed AS (
  SELECT t.*, CASE WHEN class_text LIKE '%الخام%' THEN 5 WHEN class_text LIKE '%الساد%' THEN 6 WHEN class_text LIKE '%السابع%' THEN 7 WHEN class_text LIKE '%الثامن%' THEN 8 END AS grade,
    TRY_CAST(coalesce(g.digits, CASE WHEN class_text = '12' THEN '12' END) AS BIGINT) AS section
  FROM told t LEFT JOIN glyphs g USING (page, day_index, cx)
)
SELECT page, CASE WHEN grade IS NOT NULL AND section IS NOT NULL AND subject <> '' THEN 'lesson' ELSE 'incompleteCell' END AS kind, day_index,
  first AS period_start, last AS period_end, grade, section,
  CASE WHEN grade IS NOT NULL AND section IS NOT NULL AND subject <> '' THEN grade || '/' || section END AS class_code, subject, class_text, NULL AS word FROM parsed
UNION ALL
SELECT w.page, 'unallocatedCellText', NULL, NULL, NULL, NULL, NULL, NULL, text, NULL, word FROM words w
JOIN (SELECT page, min(centre) - 20 AS top, max(centre) + 20 AS bottom FROM whole WHERE n >= 4 GROUP BY page) e ON e.page = w.page AND w.y > e.top AND w.y < e.bottom
WHERE w.x > 100 AND NOT EXISTS (SELECT 1 FROM inside i WHERE i.page = w.page AND i.word = w.word)
UNION ALL
SELECT DISTINCT page, 'rowGeometry', day_index, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM whole WHERE n < 4"""


def printed(spark, folder):
    """Words, rulings, days and periods of the printed pages."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    # dealt by page before a page becomes many rulings; the number keeps small shares, which grow later, apart
    dealt = lines.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "l_orderkey")
    pages = dealt.select(F.col("l_orderkey").alias("page")).distinct()
    day = F.col("day_index")
    days = pages.select("page", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("day_index")).withColumn("centre", 120.0 + 40 * day)
    periods = pages.select("page", F.explode(F.sequence(F.lit(1), F.lit(8))).alias("period")).withColumn("centre", 60.0 + 80 * F.col("period"))
    # every level ruling is drawn in two strokes that differ by less than a place
    def ruling(x0, y0, x1, y1):
        return F.struct(*[(F.lit(v) if isinstance(v, float) else v).alias(c) for c, v in dict(x0=x0, y0=y0, x1=x1, y1=y1).items()])

    level = [ruling(a, 100.0 + 40 * k + low, b, 100.0 + 40 * k + low) for k in range(6) for a, b, low in ((60.0, 400.0, 0.0), (400.0, 740.0, 0.003))]
    long = [ruling(100.0 + 80 * n, 100.0, 100.0 + 80 * n, 300.0) for n in (0, 3, 8)]
    short = [
        F.when(((F.col("page") + 3 * d + n) % 4 != 0) & ~((F.col("page") % 13 == 5) & F.lit(d == 2)), ruling(100.0 + 80 * n, 140.0 + 40 * d, 100.0 + 80 * n, 100.0 + 40 * d))
        for d in range(5) for n in (1, 2, 4, 5, 6, 7)
    ]
    rulings = pages.select("page", F.explode(F.array_compact(F.array(*level, *long, *short))).alias("r")).select("page", "r.*")

    part, supp, line = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_linenumber")
    c, m = 140.0 + 80 * (part % 8), 120.0 + 40 * ((line - 1) % 5)
    number = (supp % 12 + 1).cast("string")
    no_glyphs = F.expr("CAST(array() AS array<struct<x: double, c: string>>)")

    def word(k, x, width, y, height, size, text, glyphs=no_glyphs, when=None):
        made = F.struct(
            (line * 10 + k).cast("bigint").alias("word"), x.cast("double").alias("x0"), (x + width).cast("double").alias("x1"),
            y.cast("double").alias("y0"), (y + height).cast("double").alias("y1"), F.lit(size).alias("size"), text.alias("text"), glyphs.alias("glyphs"),
        )
        return made if when is None else F.when(when, made)

    arabic = F.translate(number, "0123456789", "٠١٢٣٤٥٦٧٨٩")
    shown = F.transform(F.split(arabic, ""), lambda d, k: F.struct((c + 2 + 4 * k).cast("double").alias("x"), d.alias("c")))
    names = F.array(*map(F.lit, GRADE_WORDS))
    stray = part % 11 == 0
    made = F.array_compact(F.array(
        word(1, c - 20, 18, m - 10, 8, 12.0, F.get(names, (supp % 4).cast("int"))),
        word(2, c + 1, 8, m - 10, 8, 12.0, F.reverse(arabic), shown, part % 9 != 0),
        word(3, c + 5, 10, m + 2, 6, 9.0, F.concat(F.lit("S"), (part % 50).cast("string")), when=part % 7 != 0),
        word(4, c - 15, 10, m + 2, 6, 9.0, F.concat(F.lit("T"), (supp % 5).cast("string")), when=part % 7 != 0),
        word(5, c - 5, 10, m + 10, 4, 8.0, F.concat(F.lit("حاسوب "), (part % 3).cast("string")), when=part % 5 == 0),
        word(6, c - 5, 10, m + 13, 4, 8.0, F.lit("12"), when=part % 3 == 0),
        word(7, F.lit(335.0), 10, m - 2, 4, 8.0, F.lit("stray"), when=stray),
        word(8, F.lit(65.0), 10, m - 2, 4, 8.0, F.lit("margin"), when=stray),
    ))
    words = dealt.select(F.col("l_orderkey").alias("page"), F.explode(made).alias("w")).select("page", "w.*")
    return words, rulings, days, periods


@query("j10_page_lessons", "page bigint, kind string, day_index bigint, period_start bigint, period_end bigint, grade bigint, section bigint, "
       "class_code string, subject string, class_text string, word bigint", PAGES_SQL)
def j10_page_lessons(spark, folder):
    """Lessons and issues of all printed pages."""
    return lessons.page_lessons(*printed(spark, folder))
