"""Typo-tolerant match scores as Columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from muster.functions import text

# The score ladder.
EXTERNAL, EXACT, PREFIX, CONTAINS, SOFT_CONTAINS, COMPACT_CONTAINS = 1100, 1000, 940, 860, 780, 740
TOKEN_EQUAL, TOKEN_PREFIX, TOKEN_CONTAINS, TOKEN_FUZZY, FUZZY_STEP = 100, 92, 82, 62, 8
DIRECT_BASE, FUZZY_BASE, FIRST_TOKEN_BONUS = 700, 540, 25
FUZZY_MIN_LENGTH, LONG_TOKEN = 3, 7
DIRECT_GATE = 700


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it several times in ``body``."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _past_common_start(pair: Column) -> Column:
    """The two strings of a pair without the letters they both begin with."""
    differs = F.zip_with(F.split(pair["a"], ""), F.split(pair["b"], ""), lambda x, y: ~x.eqNullSafe(y))
    return bind(
        F.array_position(differs, True).cast("int"),
        lambda at: F.struct(
            F.when(at == 0, "").otherwise(F.substring(pair["a"], at, F.length(pair["a"]))).alias("a"),
            F.when(at == 0, "").otherwise(F.substring(pair["b"], at, F.length(pair["b"]))).alias("b"),
        ),
    )


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance where swapping neighbours costs one and no substring is edited twice.

    Letters shared at either end do not count, so only the differing cores are compared. They come out
    reversed, which changes no distance. A core of up to ``BITS`` letters is held in the bits of one number and the
    distance takes one step per letter of the other; two longer cores fill the table of distances.
    """

    def reversed_cores(pair: Column) -> Column:
        return F.struct(F.reverse(pair["a"]).alias("a"), F.reverse(pair["b"]).alias("b"))

    started = bind(F.struct(a.alias("a"), b.alias("b")), _past_common_start)
    cores = bind(bind(started, reversed_cores), _past_common_start)

    def of_cores(pair: Column) -> Column:
        a_first = F.length(pair["a"]) <= F.length(pair["b"])
        short, long = F.when(a_first, pair["a"]).otherwise(pair["b"]), F.when(a_first, pair["b"]).otherwise(pair["a"])
        ordered = F.struct(short.alias("a"), long.alias("b"))
        return bind(ordered, lambda p: F.when(p["a"] == "", F.length(p["b"])).when(F.length(p["a"]) <= BITS, _fold_bits(p["a"], p["b"])).otherwise(_fill(p["a"], p["b"])))

    return bind(cores, of_cores)


#: Letters of a word that fit the bits of a signed number, with room for the carry of one addition.
BITS = 62


def _letters(word: Column) -> Column:
    return F.filter(F.split(word, ""), lambda x: x != "")


def _fold_bits(short: Column, long: Column) -> Column:
    """One step per letter of ``long`` over bit vectors with one bit per letter of ``short``.

    ``up`` and ``down`` mark the places where the current column of the table of distances rises or falls by one, ``even`` those whose
    diagonal step is free; only the distance at the last place is kept as a number. A swap is a place that the letter matches,
    whose neighbour the letter before matches, where the diagonal step before was not free.
    """
    shift = lambda value, n: F.call_function("shiftleft", value, n)
    flip = F.bitwise_not
    one, none = F.lit(1).cast("bigint"), F.lit(0).cast("bigint")

    def places(letters: Column, letter: Column) -> Column:
        return F.aggregate(F.transform(letters, lambda x, i: F.when(x == letter, shift(one, i)).otherwise(none)), none, lambda m, b: m.bitwiseOR(b))

    def fold(known: Column) -> Column:
        whole, last = known["whole"], known["last"]

        def step(state: Column, letter: Column) -> Column:
            def with_hits(hits: Column) -> Column:
                swap = shift(flip(state["even"]).bitwiseAND(hits), F.lit(1)).bitwiseAND(state["hits"])
                carried = (hits.bitwiseAND(state["up"]) + state["up"]).bitwiseXOR(state["up"])
                even = carried.bitwiseOR(hits).bitwiseOR(state["down"]).bitwiseOR(swap).bitwiseAND(whole)

                def with_even(even: Column) -> Column:
                    rise = state["down"].bitwiseOR(flip(even.bitwiseOR(state["up"]))).bitwiseAND(whole)
                    fall = even.bitwiseAND(state["up"])
                    return bind(F.struct(even.alias("even"), rise.alias("rise"), fall.alias("fall")), moved)

                def moved(x: Column) -> Column:
                    rise = shift(x["rise"], F.lit(1)).bitwiseOR(one)
                    change = F.when(x["rise"].bitwiseAND(last) != 0, 1).when(x["fall"].bitwiseAND(last) != 0, -1).otherwise(0)
                    up = shift(x["fall"], F.lit(1)).bitwiseOR(flip(x["even"].bitwiseOR(rise))).bitwiseAND(whole)
                    down = rise.bitwiseAND(x["even"]).bitwiseAND(whole)
                    return F.struct(up.alias("up"), down.alias("down"), x["even"].alias("even"), hits.alias("hits"), (state["distance"] + change).alias("distance"))

                return bind(even, with_even)

            return bind(F.element_at(known["places"], letter), with_hits)

        start = F.struct(whole.alias("up"), none.alias("down"), none.alias("even"), none.alias("hits"), F.length(short).alias("distance"))
        return F.aggregate(_letters(long), start, step, lambda state: state["distance"])

    kinds = F.array_distinct(_letters(long))
    last = shift(one, F.length(short) - 1)
    table = bind(_letters(short), lambda letters: F.map_from_arrays(kinds, F.transform(kinds, lambda x: places(letters, x))))
    return bind(F.struct((last - 1).bitwiseOR(last).alias("whole"), last.alias("last"), table.alias("places")), fold)


def _fill(a: Column, b: Column) -> Column:
    """One fold over the letters of ``a``; the state keeps the last two rows of the distance table, and
    the inner fold appends to the next row cell by cell.
    """
    width = F.length(b)
    first = F.sequence(F.lit(0), width)

    def next_row(state: Column, i: Column) -> Column:
        letter, before = F.substring(a, i, F.lit(1)), F.substring(a, i - 1, F.lit(1))

        def cell(row: Column, j: Column) -> Column:
            other = F.substring(b, j, F.lit(1))
            plain = F.least(
                F.get(state["last"], j) + 1,
                F.get(row, j - 1) + 1,
                F.get(state["last"], j - 1) + F.when(letter == other, 0).otherwise(1),
            )
            swap = (i > 1) & (j > 1) & (letter == F.substring(b, j - 1, F.lit(1))) & (before == other)
            value = F.when(swap, F.least(plain, F.get(state["older"], j - 2) + 1)).otherwise(plain)
            return F.concat(row, F.array(value))

        row = F.aggregate(F.sequence(F.lit(1), width), F.array(i), cell)
        return F.struct(state["last"].alias("older"), row.alias("last"))

    folded = F.aggregate(
        F.sequence(F.lit(1), F.length(a)),
        F.struct(first.alias("older"), first.alias("last")),
        next_row,
        lambda state: F.get(state["last"], width),
    )
    return (
        F.when(a == b, F.lit(0))
        .when(F.length(a) == 0, width)
        .when(width == 0, F.length(a))
        .otherwise(folded)
    )


def shortened(token: Column, twice: Column) -> Column:
    """The token and all forms of it with one later letter left out, or up to two when ``twice`` holds.

    Two tokens that begin alike and are within distance one share such a form, and within distance two
    they share one with up to two letters left out, so near tokens meet by equality.
    """

    def without_one(t: Column) -> Column:
        # from the second letter on; a single letter has no shorter form
        places = F.when(F.length(t) >= 2, F.sequence(F.lit(2), F.length(t))).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.concat(F.substring(t, F.lit(1), i - 1), F.substring(t, i + 1, F.length(t))))

    once = F.concat(F.array(token), without_one(token))
    return F.array_distinct(F.when(twice, F.concat(once, F.flatten(F.transform(once, without_one)))).otherwise(once))


def allowed_distance(query_token: Column) -> Column:
    return F.when(F.length(query_token) >= LONG_TOKEN, 2).otherwise(1)


def fuzzy_distance(query_token: Column, name_token: Column) -> Column:
    """Distance of two tokens when it is within the allowance, else null.

    A swap costs Levenshtein two, so a Levenshtein distance above twice the allowance rules the
    pair out, and one of at most 1 is the answer; only the rest needs the table.
    """
    allowed = allowed_distance(query_token)
    comparable = (
        (F.length(query_token) >= FUZZY_MIN_LENGTH)
        & (F.substring(query_token, 1, 1) == F.substring(name_token, 1, 1))
        & (F.abs(F.length(query_token) - F.length(name_token)) <= allowed)
    )

    def settle(near: Column) -> Column:
        full = bind(osa_distance(query_token, name_token), lambda d: F.when(d <= allowed, d))
        return F.when(near < 0, None).when(near <= 1, near).otherwise(full)

    # the bounded form stops early and gives -1 beyond the bound
    bounded = F.when(allowed == 2, F.levenshtein(query_token, name_token, 4)).otherwise(
        F.levenshtein(query_token, name_token, 2)
    )
    return F.when(comparable, bind(bounded, settle))


def token_score(query_token: Column, name_token: Column) -> Column:
    return (
        F.when(query_token == name_token, TOKEN_EQUAL)
        .when(F.startswith(name_token, query_token), TOKEN_PREFIX)
        .when(F.contains(name_token, query_token), TOKEN_CONTAINS)
        .otherwise(
            F.coalesce(F.lit(TOKEN_FUZZY) - fuzzy_distance(query_token, name_token) * FUZZY_STEP, F.lit(0))
        )
    )


def tokens_of(key: Column) -> Column:
    return F.filter(F.split(key, " "), lambda t: t != "")


def _token_tier(q_tokens: Column, n_tokens: Column) -> Column:
    """Score when every query word matches some word of the name, else 0."""
    best = F.transform(
        q_tokens, lambda q: F.coalesce(F.array_max(F.transform(n_tokens, lambda n: token_score(q, n))), F.lit(0))
    )
    # only an equal first word, or one that begins like it, scores high enough for the bonus
    begins = F.startswith(F.get(n_tokens, F.lit(0)), F.get(q_tokens, F.lit(0)))
    bonus = F.when(begins, FIRST_TOKEN_BONUS).otherwise(0)

    def finish(state: Column) -> Column:
        base = F.when(state["least"] >= TOKEN_CONTAINS, DIRECT_BASE).otherwise(FUZZY_BASE)
        return F.when(state["least"] == 0, 0).otherwise(
            F.round(base + state["total"] / state["n"] + bonus).cast("int")
        )

    return F.aggregate(
        best,
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("total"), F.lit(TOKEN_EQUAL).alias("least")),
        lambda acc, s: F.struct(
            (acc["n"] + 1).alias("n"), (acc["total"] + s).alias("total"), F.least(acc["least"], s).alias("least")
        ),
        finish,
    )


def record_score(
    name: tuple[Column, Column, Column],
    query: tuple[Column, Column, Column],
    number: Column | None = None,
    typed: Column | None = None,
) -> Column:
    """Score of a record under a query; both come as (primary, soft, compact) keys.

    ``number`` is the record's external number and ``typed`` the query as typed. A ``CASE`` stops at
    the first tier that holds, so the token tier is worked out only for rows that reach it.
    """
    primary, soft, compact = name
    q_primary, q_soft, q_compact = query
    # both word lists are bound once, so that the inner loops do not split the names again
    words = F.struct(tokens_of(q_soft).alias("q"), tokens_of(soft).alias("n"))
    token_tier = bind(words, lambda w: _token_tier(w["q"], w["n"]))
    # a query word can only match when the name holds it, or has a word that begins like it
    spaced = F.concat(F.lit(" "), soft)
    hopeful = F.forall(
        tokens_of(q_soft),
        lambda q: F.contains(soft, q)
        | ((F.length(q) >= FUZZY_MIN_LENGTH) & F.contains(spaced, F.concat(F.lit(" "), F.substring(q, 1, 1)))),
    )
    ladder = F.when(q_primary == "", 1)
    if number is not None and typed is not None:
        ladder = ladder.when((number != "") & (number == text.trimmed(typed)), EXTERNAL)
    return (
        ladder.when(primary == q_primary, EXACT)
        .when(F.startswith(primary, q_primary), PREFIX)
        .when(F.contains(primary, q_primary), CONTAINS)
        .when(F.contains(soft, q_soft), SOFT_CONTAINS)
        .when(F.contains(compact, q_compact), COMPACT_CONTAINS)
        .when(~hopeful, 0)
        .otherwise(token_tier)
    )
