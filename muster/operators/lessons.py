"""Lessons of printed timetable pages: from words and rulings to cells with spans, their texts, and what does not fit.

A page comes as rows of four tables: words (``page, word, x0, x1, y0, y1, size, text, glyphs``), rulings
(``page, x0, y0, x1, y1``), the middle heights of its days (``page, day_index, centre``) and the middles of its period
columns (``page, period, centre``). A row of a day lies between the nearest level rulings around its middle; its cells lie
between neighbouring upright rulings that cross that middle, so merged cells are found by the rulings they lack. The rulings of a page
make one row with its cells by band; words meet it on the page and look for their band, then their cell. Every cell is one group, as
large as what is printed in it. All steps go by page, so the words are dealt out once and nothing is kept in between.

Defined results: a day without a ruling above or below, or with under ``LEAST_UPRIGHTS`` uprights, gives one row
``rowGeometry`` and no cells. Cells without a period are no lessons; words in them are left over like words in no cell. Words on an edge are
in no cell. Null texts count as empty. Repeated rulings count once, repeated words as often as they occur.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions import text

# When a ruling is level or upright, decimals of its place, uprights of a whole row, when sizes are equal, and the
# word of a note about the room, which is no subject.
STRAIGHT = 0.01
PLACES = 2
LEAST_UPRIGHTS = 4
SAME_SIZE = 0.01
ROOM_NOTE = "حاسوب"


def page_frames(rulings: DataFrame, days: DataFrame, periods: DataFrame) -> DataFrame:
    """One row per page with days: the days whose cells cannot be told, its cells by band, and the extent of the table.

    ``poor`` holds (day_index), ``bands`` (y0, y1, cells), the cells being (day_index, x0, x1, y0, y1, first, last), and
    ``top``, ``bottom`` and ``left`` bound the table. Each of the three tables is folded by page, as large as what is drawn on it.
    """
    drawn = rulings.groupBy("page").agg(
        F.collect_set(F.when(F.abs(F.col("y0") - F.col("y1")) < STRAIGHT, F.round("y0", PLACES))).alias("levels"),
        F.collect_set(F.when(F.abs(F.col("x0") - F.col("x1")) < STRAIGHT, F.struct(
            F.round("x0", PLACES).alias("x"), F.least("y0", "y1").alias("top"), F.greatest("y0", "y1").alias("bottom")
        ))).alias("uprights"),
    )
    middles = days.groupBy("page").agg(F.collect_set(F.struct("day_index", "centre")).alias("days"))
    columns = periods.groupBy("page").agg(F.collect_set(F.struct("period", "centre")).alias("periods"), F.min("centre").alias("first"))
    # merged: each side is far larger than the table it unfolds from, by which Spark would judge whether to send it out
    page = middles.join(drawn.hint("merge"), "page", "left").join(columns.hint("merge"), "page", "left")

    # the nearest level rulings above and below the middle of every day
    rows = F.transform("days", lambda d: F.struct(
        d["day_index"].alias("day_index"), d["centre"].alias("centre"),
        F.array_max(F.filter("levels", lambda y: y < d["centre"])).alias("y0"), F.array_min(F.filter("levels", lambda y: y > d["centre"])).alias("y1"),
    ))
    page = page.withColumn("rows", rows).withColumn("told", F.filter("rows", lambda r: r["y0"].isNotNull() & r["y1"].isNotNull()))

    # the uprights that cross the middle of a row, each place once, by day
    def crossing(day: Column) -> Column:
        across = lambda r: F.filter("uprights", lambda u: (u["top"] < r["centre"]) & (u["bottom"] > r["centre"]))
        places = F.transform(F.filter("told", lambda r: r["day_index"] == day), lambda r: F.transform(
            across(r), lambda u: F.struct(u["x"].alias("x"), r["y0"].alias("y0"), r["y1"].alias("y1"))
        ))
        return F.struct(day.alias("day_index"), F.sort_array(F.array_distinct(F.coalesce(F.flatten(places), F.expr("array()")))).alias("lines"))

    numbers = F.array_distinct(F.transform("rows", lambda r: r["day_index"]))
    page = page.withColumn("whole", F.filter(F.transform(numbers, crossing), lambda d: F.size(d["lines"]) >= LEAST_UPRIGHTS))
    poor = F.filter("rows", lambda r: ~F.exists("whole", lambda d: d["day_index"].eqNullSafe(r["day_index"])))

    # cells between neighbouring places that hold the middle of a period
    def between(day: Column) -> Column:
        count = F.size(day["lines"]) - 1
        return F.zip_with(F.slice(day["lines"], F.lit(1), count), F.slice(day["lines"], F.lit(2), count), lambda a, b: F.struct(
            day["day_index"].alias("day_index"), a["x"].alias("x0"), b["x"].alias("x1"), a["y0"].alias("y0"), a["y1"].alias("y1"),
            F.filter("periods", lambda p: (p["centre"] > a["x"]) & (p["centre"] < b["x"])).alias("held"),
        ))

    cells = F.transform(F.filter(F.flatten(F.transform("whole", between)), lambda c: F.size(c["held"]) > 0), lambda c: F.struct(
        *[c[x].alias(x) for x in ("day_index", "x0", "x1", "y0", "y1")],
        F.array_min(F.transform(c["held"], lambda p: p["period"])).alias("first"), F.array_max(F.transform(c["held"], lambda p: p["period"])).alias("last"),
    ))
    height = lambda c: F.struct(c["y0"].alias("y0"), c["y1"].alias("y1"))
    bands = F.transform(F.array_distinct(F.transform("cells", height)), lambda b: F.struct(
        b["y0"].alias("y0"), b["y1"].alias("y1"), F.filter("cells", lambda c: height(c) == b).alias("cells")
    ))
    # the left edge is the last place before the first period, by row; the least of them counts
    before = F.transform("whole", lambda d: F.filter(d["lines"], lambda p: p["x"] < F.col("first")))
    lefts = F.flatten(F.transform("edges", lambda e: F.transform(
        F.array_distinct(F.transform(e, height)), lambda b: F.array_max(F.transform(F.filter(e, lambda p: height(p) == b), lambda p: p["x"]))
    )))
    edge = lambda name: F.transform(F.flatten("edges"), lambda p: p[name])
    return page.withColumn("cells", F.array_distinct(cells)).withColumn("edges", before).select(
        "page", F.transform(poor, lambda r: r["day_index"]).alias("poor"), bands.alias("bands"),
        F.array_min(edge("y0")).alias("top"), F.array_max(edge("y1")).alias("bottom"), F.array_min(lefts).alias("left"),
    )


def _joined(words: Column) -> Column:
    return F.array_join(F.transform(words, lambda w: w["text"]), " ")


def cell_texts(inside: DataFrame) -> DataFrame:
    """One row per cell: the class printed in its largest letters and the subject in the smaller ones, right to left by line.

    Words without a cell (``cell_x0`` null) stand in a row of their number, ``lost``; ``w`` keeps the words.
    """
    word = F.struct("word", "size", "x0", F.round("y0", 1).alias("line"), F.coalesce("text", F.lit("")).alias("text"), "glyphs")
    cell = ["page", "day_index", "first", "last", "cell_x0", "lost", *[c for c in inside.columns if c == "poor"]]
    held = inside.groupBy(*cell).agg(F.sort_array(F.collect_list(word)).alias("w"), F.max("size").alias("top"))
    large = F.filter("w", lambda w: F.col("top") - w["size"] < SAME_SIZE)
    subject = F.filter(
        "w", lambda w: (F.col("top") - w["size"] >= SAME_SIZE) & ~F.contains(w["text"], F.lit(ROOM_NOTE)) & w["text"].rlike(r"\p{L}")
    )
    lines = F.sort_array(F.transform(subject, lambda w: F.struct(w["line"], (-w["x0"]).alias("left"), w["word"], w["text"])))
    glyphs = F.flatten(F.transform(large, lambda w: F.transform(
        F.coalesce(w["glyphs"], F.expr("array()")), lambda g, k: F.struct(g["x"].alias("x"), w["word"].alias("word"), k.alias("k"), g["c"].alias("c"))
    )))
    digits = F.sort_array(F.filter(glyphs, lambda g: g["c"].rlike(r"^\p{Nd}$")))
    return held.select(*cell, "w", _joined(large).alias("class_text"), _joined(lines).alias("subject"), F.array_join(F.transform(digits, lambda g: g["c"]), "").alias("digits"))


def page_lessons(words: DataFrame, rulings: DataFrame, days: DataFrame, periods: DataFrame) -> DataFrame:
    """Rows (page, kind, day_index, period_start, period_end, grade, section, class_code, subject, class_text, word).

    ``kind`` is ``lesson``, or an issue: ``incompleteCell`` without class or subject, ``unallocatedCellText`` for a word
    inside the table that no cell took, ``rowGeometry`` for a day whose cells cannot be told.
    """
    # numbered before Python sees them, which makes them be dealt again
    first = F.row_number().over(Window.partitionBy("page").orderBy("word")) == 1
    clean = words.withColumn("_first", first).withColumn("text", text.collapse_edges(text.nfkc(F.coalesce("text", F.lit("")))))
    frames = page_frames(rulings, days, periods)
    period = periods.schema["period"].dataType

    # every step goes by page: a table that comes dealt by page is not dealt again
    placed = clean.withColumn("x", (F.col("x0") + F.col("x1")) / 2).withColumn("y", (F.col("y0") + F.col("y1")) / 2)
    high = F.filter("bands", lambda b: (F.col("y") > b["y0"]) & (F.col("y") < b["y1"]))
    takers = F.flatten(F.transform(high, lambda b: F.filter(b["cells"], lambda c: (F.col("x") > c["x0"]) & (F.col("x") < c["x1"]))))
    in_table = (F.col("y") > F.col("top")) & (F.col("y") < F.col("bottom")) & (F.col("x") > F.col("left"))
    # days whose cells cannot be told come as cells without an edge with the first word of their page, or alone where it has no word
    none = F.lit(None).cast("double")
    untold = F.transform("poor", lambda d: F.struct(
        d.alias("day_index"), *[none.alias(c) for c in ("x0", "x1", "y0", "y1")], F.lit(None).cast(period).alias("first"), F.lit(None).cast(period).alias("last"),
        F.lit(True).alias("poor"),
    ))
    taking = F.transform(takers, lambda c: F.struct(*[c[x].alias(x) for x in ("day_index", "x0", "x1", "y0", "y1", "first", "last")], F.lit(False).alias("poor")))
    taking = F.when(F.size(taking) > 0, taking).when(F.col("_first").isNotNull(), F.array(F.lit(None)))
    given = F.concat(F.coalesce(taking, F.array()), F.when(F.coalesce("_first", F.lit(True)), F.coalesce(untold, F.array())).otherwise(F.array()))
    met = frames.hint("merge").join(placed, "page", "left")
    met = met.select(*words.columns, in_table.alias("_in_table"), F.explode(given).alias("_cell"))
    # a word is known by its page and number: what took one of its rows took it
    poor = F.coalesce(F.col("_cell.poor"), F.lit(False))
    took = F.col("_cell").isNotNull() & ~poor
    met = met.withColumn("_taken", F.max(took).over(Window.partitionBy("page", "word"))).where(took | poor | (F.col("_in_table") & ~F.col("_taken")))
    told = cell_texts(met.select(
        *words.columns, *[F.col(f"_cell.{c}").alias(c) for c in ("day_index", "first", "last")], F.col("_cell.x0").alias("cell_x0"),
        F.when(~took & ~poor, F.col("word")).alias("lost"), poor.alias("poor"),
    ))
    grade = F.coalesce(*[F.when(F.contains("class_text", F.lit(w)), F.lit(g)) for w, g in text.LABEL_GRADES.items()])
    section = text.fold_digits(F.col("digits")).try_cast("bigint")
    told = told.withColumn("grade", grade).withColumn("section", section)
    good = F.col("grade").isNotNull() & F.col("section").isNotNull() & (F.col("subject") != "")
    none = F.lit(None)

    def row(kind: Column | str, **given: Column) -> Column:
        kinds = dict(
            day_index="bigint", period_start="bigint", period_end="bigint", grade="bigint", section="bigint", class_code="string",
            subject="string", class_text="string", word="bigint",
        )
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), *[given.get(c, none).cast(t).alias(c) for c, t in kinds.items()])

    code = F.concat_ws("/", F.col("grade").cast("string"), F.col("section").cast("string"))
    lesson = row(
        F.when(good, "lesson").otherwise("incompleteCell"), day_index=F.col("day_index"), period_start=F.col("first"), period_end=F.col("last"),
        grade=F.col("grade"), section=F.col("section"), class_code=F.when(good, code), subject=F.col("subject"), class_text=F.col("class_text"),
    )
    lost = F.transform("w", lambda w: row("unallocatedCellText", word=w["word"], subject=w["text"]))
    untold = F.transform("w", lambda w: row("rowGeometry", day_index=F.col("day_index")))  # as often as the day is told
    rows = F.when(F.col("poor"), untold).when(F.col("cell_x0").isNotNull(), F.array(lesson)).otherwise(lost)
    return told.select("page", F.explode(rows).alias("_row")).select("page", "_row.*")
