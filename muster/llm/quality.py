"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source.

``statistics`` measures every whole text with SQL functions only. ``sketch`` counts each measure in cells that
keep six leading bits of its value: a quantile sketch with a relative error of 1/32 whose merge is a sum, so
that tasks, sources and languages combine in any order to the same result. ``thresholds`` reads quartiles off
the sketch of a language and source and sets a fence: the outer quartile plus three times the distance of the
quartiles, or plus a fixed slack where a measure hardly varies. A sketch of under ``LEAST`` documents is merged
with those of the same language, and if these are too few, with all. ``verdicts`` joins the fences to the documents.

Documents that break a base rule (under ``BASE_WORDS`` words, or over half of the words in repeated windows) fail
before any fence and are not in the sketches.

Defined results: a null or empty text has all counts 0 and fails the base rule. Null languages and sources are
groups of their own. A document without a fence (nothing passed the base rules) is kept unless it fails the
base rule itself. Repeated rows count as often as they occur. Only the named columns are read. Windows of three
words are compared by 64-bit hashes within one document.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.tables import WORD, kept

BASE_WORDS = 50
BASE_REPEATED = 50  # per cent
LEAST = 200
REACH = 5
MEASURES = ("word_length", "symbols", "dup_lines", "repeated")
_BITS = 6


def _once(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(places: Column) -> Column:
    """Words covered by windows of three that begin at the given places, which are in order."""
    widths = F.transform(places, lambda at, k: F.coalesce(F.least(F.lit(3), F.get(places, k + 1) - at), F.lit(3)))
    return F.aggregate(widths, F.lit(0), lambda total, width: total + width)


def _repeated_places(hashes: Column) -> Column:
    """Places of the hashes that occur twice or more: equal ones stand together after a sort."""
    marked = F.sort_array(F.transform(hashes, lambda h, k: F.struct(h.alias("h"), k.alias("k"))))

    def beside(rows: Column) -> Column:
        same = lambda x, k, step: F.coalesce(F.get(rows, k + step)["h"] == x["h"], F.lit(False))
        return F.sort_array(F.transform(F.filter(rows, lambda x, k: same(x, k, -1) | same(x, k, 1)), lambda x: x["k"]))

    return _once(marked, beside)


def _repeat_words(words: Column) -> Column:
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(words) - 3), lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2))
    )
    some = _once(
        hashes,
        lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(_once(_repeated_places(h), _covered)),
    )
    return F.when(F.size(words) < 4, F.lit(0)).otherwise(some)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The other columns of ``docs`` with the counts of each text and whether a base rule fails."""
    whole = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(whole, "\n"), lambda line: line.rlike(WORD))
    of_words = _once(
        F.regexp_extract_all(whole, F.lit(WORD), F.lit(0)),
        lambda w: F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            _repeat_words(w).cast("bigint").alias("n_repeat_words"),
        ),
    )
    of_lines = _once(
        lines,
        lambda rows: F.struct(
            F.size(rows).cast("bigint").alias("n_lines"),
            (F.size(rows) - F.size(F.array_distinct(rows))).cast("bigint").alias("n_dup_lines"),
        ),
    )
    others = [F.col(f"`{c}`") for c in docs.columns if c != text]
    counted = docs.select(
        *others, of_words.alias("_w"), of_lines.alias("_l"), F.regexp_count(whole, F.lit("[#*$%&|<>]")).cast("bigint").alias("n_symbols")
    )
    failed = (F.col("_w.n_words") < BASE_WORDS) | (100 * F.col("_w.n_repeat_words") > BASE_REPEATED * F.col("_w.n_words"))
    return counted.select(
        *others, "_w.n_words", "_w.word_chars", "n_symbols", "_l.n_lines", "_l.n_dup_lines", "_w.n_repeat_words", failed.alias("base_failed")
    )


def _measures() -> dict[str, Column]:
    """The measures of a document that has words, in hundredths of a character or in thousandths."""
    return {
        "word_length": F.expr("100 * word_chars div nullif(n_words, 0)"),
        "symbols": F.expr("1000 * n_symbols div nullif(n_words, 0)"),
        "dup_lines": F.expr("1000 * n_dup_lines div nullif(n_lines, 0)"),
        "repeated": F.expr("1000 * n_repeat_words div nullif(n_words, 0)"),
    }


def _cell(value: Column) -> Column:
    """The value with only its leading bits."""
    rest = F.greatest(F.length(F.bin(value)) - _BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, rest), rest)


def _last_of(cell: Column) -> Column:
    """The greatest value that falls into a cell."""
    return cell + F.call_function("shiftleft", F.lit(1).cast("bigint"), F.greatest(F.length(F.bin(cell)) - _BITS, F.lit(0))) - 1


def sketch(stats: DataFrame) -> DataFrame:
    """(lang, source, measure, cell, n) over the documents that pass the base rules."""
    each = F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), _cell(value).alias("cell")) for name, value in _measures().items()]))
    return (
        stats.where("NOT base_failed").select("lang", "source", each.alias("_m"))
        .groupBy("lang", "source", "_m.measure", "_m.cell").agg(F.count(F.lit(1)).alias("n"))
    )


def thresholds(sketches: DataFrame) -> DataFrame:
    """(lang, source) with the fences of every measure, ``<measure>_low`` and ``<measure>_high``."""
    levels = F.explode(F.array(
        F.struct(F.lit(0).alias("level"), F.struct("lang", "source").alias("at")),
        F.struct(F.lit(1).alias("level"), F.struct("lang", F.lit(None).cast("string").alias("source")).alias("at")),
        F.struct(F.lit(2).alias("level"), F.struct(F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("source")).alias("at")),
    ))
    merged = (
        sketches.select(levels.alias("_v"), "measure", "cell", "n")
        .groupBy("_v.level", "_v.at", "measure", "cell").agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy("level", "at", "measure")
    ranked = merged.withColumn("upto", F.sum("n").over(group.orderBy("cell"))).withColumn("total", F.sum("n").over(group))
    tenths = ranked.groupBy("level", "at", "measure").agg(
        F.max("total").alias("total"),
        F.min(F.when(F.col("upto") * 10 >= F.col("total"), F.col("cell"))).alias("low"),
        F.min(F.when(F.col("upto") * 2 >= F.col("total"), F.col("cell"))).alias("middle"),
        F.min(F.when(F.col("upto") * 10 >= F.col("total") * 9, _last_of(F.col("cell")))).alias("high"),
    )
    below = F.col("low") - REACH * (_last_of(F.col("middle")) - F.col("low"))
    above = F.col("high") + REACH * (F.col("high") - F.col("middle"))
    fences = tenths.groupBy("level", "at").agg(
        F.max("total").alias("total"),
        *[F.max(F.when(F.col("measure") == m, below)).alias(f"{m}_low") for m in MEASURES],
        *[F.max(F.when(F.col("measure") == m, above)).alias(f"{m}_high") for m in MEASURES],
    )
    asked = sketches.select("lang", "source").distinct().select("lang", "source", levels.alias("_v"))
    names = [f"{m}_{end}" for m in MEASURES for end in ("low", "high")]
    enough = (F.col("f.total") >= LEAST) | (F.col("f.level") == 2)
    return (
        asked.alias("a").join(fences.alias("f"), (F.col("a._v.level") == F.col("f.level")) & (F.col("a._v.at") == F.col("f.at")))
        .where(enough)
        .groupBy("a.lang", "a.source").agg(F.min_by(F.struct(*[f"f.{n}" for n in names]), F.col("f.level")).alias("_f"))
        .select("lang", "source", "_f.*")
    )


def verdicts(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, with counts, ``base_failed`` and ``kept``; needs ``lang`` and ``source``."""
    stats = kept(statistics(docs, text), "quality")  # the counts are read twice and made once
    fences = thresholds(sketch(stats))
    outside = F.lit(False)
    for name, value in _measures().items():
        outside = outside | (value > F.col(f"f.{name}_high"))
    outside = outside | (_measures()["word_length"] < F.col("f.word_length_low"))
    same = F.col("s.lang").eqNullSafe(F.col("f.lang")) & F.col("s.source").eqNullSafe(F.col("f.source"))
    passed = ~F.col("base_failed") & ~F.coalesce(outside, F.lit(False))
    return stats.alias("s").join(fences.alias("f"), same, "left").select("s.*", passed.alias("kept"))


SQL = """
WITH w AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), windows AS (
  SELECT doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 2)) AS i FROM w)
), repeated AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS times FROM windows) WHERE times > 1
  ) GROUP BY doc_id
), lines AS (
  SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM w
  ) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id
), stats AS (
  SELECT w.doc_id, lang, source, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
    CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols, coalesce(l.n_lines, 0) AS n_lines,
    coalesce(l.n_dup, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
    len(ws) < 50 OR 100 * coalesce(r.n, 0) > 50 * len(ws) AS base_failed
  FROM w LEFT JOIN repeated r ON r.doc_id = w.doc_id LEFT JOIN lines l ON l.doc_id = w.doc_id
), measured AS (
  SELECT lang, source, measure, v FROM (
    SELECT lang, source, 'word_length' AS measure, 100 * word_chars // n_words AS v FROM stats WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'symbols', 1000 * n_symbols // n_words FROM stats WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'dup_lines', 1000 * n_dup_lines // n_lines FROM stats WHERE NOT base_failed
    UNION ALL SELECT lang, source, 'repeated', 1000 * n_repeat_words // n_words FROM stats WHERE NOT base_failed)
), cells AS (
  SELECT lang, source, measure, CASE WHEN v < 64 THEN v ELSE v - v % (CAST(2 AS BIGINT) ** (length(bin(v)) - 6))::BIGINT END AS cell FROM measured
), levelled AS (
  SELECT 0 AS level, lang, source, measure, cell FROM cells
  UNION ALL SELECT 1, lang, NULL, measure, cell FROM cells UNION ALL SELECT 2, NULL, NULL, measure, cell FROM cells
), counted AS (
  SELECT level, lang, source, measure, cell, count(*) AS n FROM levelled GROUP BY ALL
), ranked AS (
  SELECT *, sum(n) OVER (PARTITION BY level, lang, source, measure ORDER BY cell) AS upto,
    sum(n) OVER (PARTITION BY level, lang, source, measure) AS total FROM counted
), ends AS (
  SELECT *, cell + CASE WHEN cell < 64 THEN 0 ELSE (CAST(2 AS BIGINT) ** (length(bin(cell)) - 6))::BIGINT - 1 END AS last FROM ranked
), tenths AS (
  SELECT level, lang, source, measure, max(total) AS total, min(CASE WHEN upto * 10 >= total THEN cell END) AS low,
    min(CASE WHEN upto * 2 >= total THEN cell END) AS middle, min(CASE WHEN upto * 2 >= total THEN last END) AS middle_last,
    min(CASE WHEN upto * 10 >= total * 9 THEN last END) AS high FROM ends GROUP BY level, lang, source, measure
), fences AS (
  SELECT level, lang, source, max(total) AS total,
    max(CASE WHEN measure = 'word_length' THEN low - 5 * (middle_last - low) END) AS wl_low,
    max(CASE WHEN measure = 'word_length' THEN high + 5 * (high - middle) END) AS wl_high,
    max(CASE WHEN measure = 'symbols' THEN high + 5 * (high - middle) END) AS sy_high,
    max(CASE WHEN measure = 'dup_lines' THEN high + 5 * (high - middle) END) AS dl_high,
    max(CASE WHEN measure = 'repeated' THEN high + 5 * (high - middle) END) AS re_high
  FROM tenths GROUP BY level, lang, source
), joined AS (
  SELECT s.*, f.* EXCLUDE (lang, source), row_number() OVER (PARTITION BY s.doc_id ORDER BY f.level) AS best
  FROM stats s LEFT JOIN fences f ON (f.total >= 200 OR f.level = 2) AND (
    f.level = 0 AND f.lang IS NOT DISTINCT FROM s.lang AND f.source IS NOT DISTINCT FROM s.source
    OR f.level = 1 AND f.lang IS NOT DISTINCT FROM s.lang OR f.level = 2)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(100 * word_chars // n_words > wl_high OR 100 * word_chars // n_words < wl_low
    OR 1000 * n_symbols // n_words > sy_high OR 1000 * n_dup_lines // n_lines > dl_high
    OR 1000 * n_repeat_words // n_words > re_high, false) AS kept
FROM joined WHERE best = 1
"""
