"""Ranked, typo-tolerant search of a table of records by a table of queries.

Nothing here pairs every record with every query. Candidates come from one equi-join on short text keys:

* a query stands under the first letters of its longest word, under each word of the record vocabulary
  that is a near spelling of that word, and under the number it may be;
* a record stands under the letter runs of its compact name, its words, and its external number.

Every score tier implies one of these keys, so the candidates are complete; each is then scored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.functions import scoring, text
from muster.operators.ordering import BUCKET, ranked
from muster.operators.sizing import sent_out, settled, spread

GRAM = 3  # a record stands under all runs of 1 to GRAM letters
PAGE_SEARCH, PAGE_BROWSE, PAGE_ARCHIVE = 40, 100, 12


def add_search_keys(df: DataFrame, name: str, prefix: str = "") -> DataFrame:
    """Add the primary, soft and compact key of a name; the name itself is not touched.

    One scan of the name column, ended at the first hit, looks for text that NFKC might change. When
    there is none, as in plain Latin or Arabic names, the keys are made without leaving the JVM.
    """
    changes = not df.select(name).filter(text.needs_nfkc(F.col(name))).isEmpty()
    canonical = df.withColumn("_nfkc", text.nfkc(F.col(name)) if changes else F.col(name))
    keys = {
        f"{prefix}primary": text.normalize(F.col("_nfkc"), canonical=True),
        f"{prefix}soft": text.normalize(F.col("_nfkc"), soft=True, canonical=True),
        f"{prefix}compact": text.normalize(F.col("_nfkc"), soft=True, compact=True, canonical=True),
    }
    return canonical.withColumns(keys).drop("_nfkc")


def typed(query: str = "query") -> Column:
    """The text of a query without white space of any kind around it; null is empty."""
    return text.trimmed(F.coalesce(F.col(query), F.lit("")))


def ready(query: str = "query", grade: str = "grade", section: str = "section") -> Column:
    """A roster query runs when it has text, or else both grade and section."""
    return (typed(query) != "") | (F.col(grade).isNotNull() & F.col(section).isNotNull())


def optional_eq(df: DataFrame, **values: object) -> DataFrame:
    """Keep rows equal in each column given; None means that the column is not filtered."""
    for column, value in values.items():
        if value is not None:
            df = df.filter(F.col(column) == F.lit(value))
    return df


def optional_match(pairs: Sequence[tuple[str, str]]) -> Column:
    """The same filter for a table of queries: (record column, query column), open when the query has null."""
    condition = F.lit(True)
    for record, query in pairs:
        condition = condition & (F.col(query).isNull() | (F.col(query) == F.col(record)))
    return condition


def _runs(compact: Column) -> Column:
    """All distinct letter runs of 1 to GRAM letters, tagged by kind."""
    length = F.length(compact)

    def of_size(size: int) -> Column:
        starts = F.when(length >= size, F.sequence(F.lit(1), length - size + 1)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.concat(F.lit("g:"), F.substring(compact, i, F.lit(size))))

    return F.concat(*[of_size(n) for n in range(1, GRAM + 1)])


def record_keys(records: DataFrame, number: str | None) -> DataFrame:
    words = F.transform(scoring.tokens_of(F.col("soft")), lambda t: F.concat(F.lit("t:"), t))
    parts = [_runs(F.col("compact")), words]
    if number is not None:
        parts.append(F.when(F.col(number) != "", F.array(F.concat(F.lit("n:"), number))).otherwise(F.array().cast("array<string>")))
    return records.withColumn("_key", F.explode(F.array_distinct(F.concat(*parts))))


def _longest(soft: Column) -> Column:
    """The longest word of a query; the first one of equals."""
    return F.aggregate(
        scoring.tokens_of(soft), F.lit(""), lambda best, t: F.when(F.length(t) > F.length(best), t).otherwise(best)
    )


def query_keys(queries: DataFrame, vocabulary: DataFrame) -> DataFrame:
    """Keys of each query; ``vocabulary`` holds the distinct words of the records in column ``word``."""
    anchored = queries.filter(F.col("q_primary") != "").withColumn("_anchor", _longest(F.col("q_soft")))
    runs = anchored.withColumn("_key", F.concat(F.lit("g:"), F.substring("_anchor", 1, GRAM)))
    numbers = anchored.withColumn("_key", F.concat(F.lit("n:"), F.col("query")))
    # near spellings meet on a form with letters left out, then the distance itself decides
    long_enough = anchored.filter(F.length("_anchor") >= scoring.FUZZY_MIN_LENGTH).select("_anchor").distinct()
    forms = long_enough.withColumn(
        "_form", F.explode(scoring.shortened(F.col("_anchor"), F.length("_anchor") >= scoring.LONG_TOKEN))
    )
    reachable = F.length("word") >= scoring.LONG_TOKEN - 2  # shorter words are never two edits from a long one
    words = vocabulary.select("word", F.explode(scoring.shortened(F.col("word"), reachable)).alias("_form"))
    spelled = (
        words.join(sent_out(forms), "_form")
        .filter(~F.contains("word", F.substring("_anchor", 1, GRAM)))  # those meet on the letter run already
        .select("_anchor", "word")
        .distinct()
        .filter(scoring.fuzzy_distance(F.col("_anchor"), F.col("word")).isNotNull())
        .select("_anchor", F.concat(F.lit("t:"), "word").alias("_key"))
    )
    near = anchored.join(spelled, "_anchor")
    return runs.unionByName(numbers).unionByName(near).drop("_anchor").distinct()


def _name_keys(prefix: str) -> tuple[Column, Column, Column]:
    return tuple(F.col(f"{prefix}{k}") for k in ("primary", "soft", "compact"))  # type: ignore[return-value]


def score(
    records: DataFrame, queries: DataFrame, key: str, number: str | None = None, facets: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Scored pairs above zero of records (with search keys) and queries (``query_id``, ``query``).

    ``facets`` pairs record columns with query columns holding the wanted value or null. Queries whose text
    normalizes to nothing are not handled here, see ``browse``. Record columns are kept; the query brings ``query_id``.
    """
    wanted = [q for _, q in facets]
    asked = add_search_keys(queries.select("query_id", typed().alias("query"), *wanted), "query", "q_")
    asked = settled(asked).select("*", *[F.col(q).alias(f"_f{i}") for i, q in enumerate(wanted)]).drop(*wanted)
    vocabulary = records.select(F.explode(scoring.tokens_of(F.col("soft"))).alias("word")).distinct()
    # the query keys are few: computed once, so that the many record keys meet them without a shuffle
    pairs = record_keys(spread(records), number).join(sent_out(settled(query_keys(asked, vocabulary))), "_key")
    pairs = pairs.filter(optional_match([(r, f"_f{i}") for i, (r, _) in enumerate(facets)]))
    value = scoring.record_score(
        _name_keys(""),
        _name_keys("q_"),
        None if number is None else F.coalesce(F.col(number), F.lit("")),
        None if number is None else F.col("query"),
    )
    # scored before the pairs are made distinct: only real matches are shuffled
    hits = pairs.withColumn("score", value).filter(F.col("score") > 0)
    return hits.select("query_id", *records.columns, "score").dropDuplicates([key, "query_id"])


def keyless(queries: DataFrame) -> DataFrame:
    """Queries whose text normalizes to nothing: blank ones, and such as a lone mark."""
    keyed = add_search_keys(queries.withColumn("query", typed()), "query", "q_")
    return keyed.filter(F.col("q_primary") == "").select(*queries.columns)


def _under_masks(df: DataFrame, columns: Sequence[str], asked: DataFrame, wanted: Sequence[str]) -> DataFrame:
    """Rows of ``df`` once for each set of facets that the queries leave open, open columns being null as ``_m<i>``.

    Only the sets that occur among the queries are made; there are at most two to the number of facets.
    """
    masks = asked.select(*[F.col(w).isNotNull().alias(f"_o{i}") for i, w in enumerate(wanted)]).distinct().collect()
    made = [F.struct(*[F.when(F.lit(m[i]), F.col(c)).alias(f"_m{i}") for i, c in enumerate(columns)], *[F.lit(m[i]).alias(f"_o{i}") for i in range(len(columns))]) for m in masks]
    if not made:
        return df.limit(0).select("*", *[F.col(c).alias(f"_m{i}") for i, c in enumerate(columns)])
    complete = F.lit(True)
    for i in range(len(columns)):
        complete = complete & (~F.col(f"_o{i}") | F.col(f"_m{i}").isNotNull())
    return df.select("*", F.explode(F.array(*made)).alias("_mask")).select(*df.columns, "_mask.*").filter(complete).drop(*[f"_o{i}" for i in range(len(columns))])


def browse(records: DataFrame, queries: DataFrame, key: Sequence[tuple[str, str]]) -> DataFrame:
    """Queries without a search key list the records equal in all facets that they name; each scores 1."""
    columns, wanted = [c for c, _ in key], [f"_f{i}" for i in range(len(key))]
    asked = settled(keyless(queries).select("query_id", *[F.col(q).alias(f) for f, (_, q) in zip(wanted, key)]))
    match = F.lit(True)
    for i, f in enumerate(wanted):
        match = match & F.col(f"_m{i}").eqNullSafe(F.col(f))
    met = _under_masks(records, columns, asked, wanted).join(sent_out(asked), match)
    return met.select("query_id", *records.columns, F.lit(1).alias("score"))


def matches(
    records: DataFrame, queries: DataFrame, key: str, number: str | None = None, facets: Sequence[tuple[str, str]] = ()
) -> DataFrame:
    """Scored pairs of all queries that have text, also where it normalizes to nothing."""
    listed = browse(records, queries.filter(typed() != ""), facets)
    return score(records, queries, key, number, facets).unionByName(listed)


def direct_gate(scored: DataFrame) -> DataFrame:
    """Drop weaker matches of a query that has a direct one. Decided per query by an aggregate, not a window."""
    best = scored.groupBy("query_id").agg(F.max("score").alias("_best"))
    return (
        scored.join(sent_out(best), "query_id")
        .filter((F.col("_best") < scoring.DIRECT_GATE) | (F.col("score") >= scoring.DIRECT_GATE))
        .drop("_best")
    )


def roster_matches(
    records: DataFrame, queries: DataFrame, key: str = "id", number: str | None = "number", grade: str = "grade", section: str = "section"
) -> DataFrame:
    """All matches (``query_id``, record columns, ``score``) of the queries that are ready, after the gate."""
    facets = [(grade, "grade"), (section, "section")]
    usable = queries.filter(ready())
    return direct_gate(settled(score(records, usable, key, number, facets))).unionByName(browse(records, usable, facets))


def search_roster(
    records: DataFrame,
    queries: DataFrame,
    key: str = "id",
    number: str | None = "number",
    grade: str = "grade",
    section: str = "section",
    order: str = "roster_order",
) -> DataFrame:
    """Ranked matches per query: score (for queries with text), then grade, section and roster order.

    Adds ``rank`` and ``total``. Queries that are not ready give nothing. The roster order is bucketed by
    range, so that ranking one query with very many matches spreads over the cluster. Where only a page is
    wanted, ``search_roster_page`` does not rank what lies beyond it.
    """
    return ranked(
        roster_matches(records, queries, key, number, grade, section),
        ["query_id"],
        [-F.col("score"), F.col(grade), F.col(section), F.floor(F.col(order) / BUCKET)],
        [F.col(order), F.col(key)],
        total="total",
    )


def search_roster_page(
    records: DataFrame,
    queries: DataFrame,
    offset: int = 0,
    limit: int = PAGE_SEARCH,
    key: str = "id",
    number: str | None = "number",
    grade: str = "grade",
    section: str = "section",
    order: str = "roster_order",
) -> DataFrame:
    """One page of ``search_roster`` per query, with ``has_more``, without ranking all matches."""
    found = roster_matches(records, queries, key, number, grade, section)
    return best_page(found, [F.col("score").desc(), F.col(grade), F.col(section), F.col(order), F.col(key)], offset, limit)


def best_page(found: DataFrame, order: Sequence[Column], offset: int, limit: int) -> DataFrame:
    """Rows ``offset`` + 1 to ``offset`` + ``limit`` of each query in the given order, with ``rank``, ``total`` and ``has_more``.

    A row number below a bound lets every task cut each query to its first rows before the shuffle and once more after it,
    so a task sends and reads ``offset`` + ``limit`` rows a query at most; the totals are counted apart. Spark does so up to the bound of
    spark.sql.optimizer.windowGroupLimitThreshold (1000); beyond it ``ranked`` and ``page`` spread a long ranking better.
    """
    last = offset + limit
    totals = found.groupBy("query_id").agg(F.count(F.lit(1)).alias("total")).withColumnRenamed("query_id", "_query")
    placed = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)))
    first = placed.filter(F.col("rank") <= last).filter(F.col("rank") > offset)
    counted = first.join(totals, F.col("query_id") == F.col("_query")).drop("_query")
    return counted.withColumn("has_more", F.col("total") > last)


def page(ranked_df: DataFrame, offset: int, limit: int) -> DataFrame:
    """One page of ranked results, with whether more follow."""
    last = F.lit(offset + limit)
    return ranked_df.filter((F.col("rank") > offset) & (F.col("rank") <= last)).withColumn("has_more", F.col("total") > last)


def owners_for_facets(slots: DataFrame, queries: DataFrame, owner: str = "owner") -> DataFrame:
    """(query_id, owner) for queries with at least one facet, all of which hold on one lesson slot.

    Each slot stands under its value or nothing for each set of facets that some query leaves open, so open
    facets are equal to nothing and one null-safe equi-join does it; the small query side is what gets sent out.
    """
    facets = ["grade", "subject", "day_index", "period"]
    some = F.coalesce(*[F.col(f).cast("string") for f in facets]).isNotNull()
    wanted = [f"q_{f}" for f in facets]
    asked = queries.filter(some).select("query_id", *[F.col(f).alias(q) for f, q in zip(facets, wanted)])
    options = _under_masks(slots.select(owner, *facets), facets, asked, wanted)
    match = F.lit(True)
    for i, q in enumerate(wanted):
        match = match & F.col(f"_m{i}").eqNullSafe(F.col(q))
    return options.join(sent_out(asked), match).select("query_id", owner).distinct()


def search_owners(owners: DataFrame, slots: DataFrame, queries: DataFrame, owner: str = "owner", order: str = "source_page") -> DataFrame:
    """Ranked schedule owners: nested facets on one lesson, then score and gate, then source order.

    A query with neither text nor facets lists every owner.
    """
    facets = ["grade", "subject", "day_index", "period"]
    some = F.coalesce(*[F.col(f).cast("string") for f in facets]).isNotNull()
    queries = settled(add_search_keys(queries.withColumn("query", typed()), "query", "q_"))
    has_text = F.col("q_primary") != ""
    allowed = owners_for_facets(slots, queries, owner)
    named = settled(score(owners, queries.filter(has_text), owner))
    kept = named.join(sent_out(queries.select("query_id", some.alias("_bound"))), "query_id").join(
        allowed.withColumn("_allowed", F.lit(True)), ["query_id", owner], "left"
    )
    by_text = kept.filter(~F.col("_bound") | F.col("_allowed")).select(*named.columns)
    blank = queries.filter(~has_text)
    by_facets = owners.join(allowed.join(blank.select("query_id"), "query_id", "left_semi"), owner)
    # with no facet at all every owner is a hit: the open facet is null on both sides
    everyone = browse(owners, blank.filter(~some).withColumn("_none", F.lit(None).cast(owners.schema[owner].dataType)), [(owner, "_none")])
    listed = by_facets.select("query_id", *owners.columns).unionByName(everyone.select("query_id", *owners.columns))
    # ranking reads its input twice, and this one rests on the lessons
    found = settled(direct_gate(by_text).unionByName(listed.withColumn("score", F.lit(1))))
    return ranked(
        found,
        ["query_id"],
        [-F.col("score"), F.floor(F.col(order) / BUCKET)],
        [F.col(order), F.col(owner)],
        total="total",
    )


def to_result(df: DataFrame, *columns: str) -> DataFrame:
    """Only the columns a result list shows."""
    return df.select(*columns)
