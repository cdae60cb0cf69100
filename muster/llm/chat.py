"""Preference formatting: one prompt and two masked completions from a chosen and a rejected conversation.

``format_preferences`` takes pairs of conversations as arrays of turns, finds the longest prefix of turns that both
share, renders it once as the prompt and renders what follows on each side as a completion. A completion comes
with its mask: the spans of characters that a model learns from, which are the text and the end mark of each
``assistant`` turn. Headers and turns of other roles are masked out.

``with_other_endings`` makes pairs from a table of turns: the chosen conversation is a conversation as it is, the
rejected one has the last text of another conversation in place of its own.

Defined results: turns are ordered by turn, then role, then text, nulls first; repeated turns all stay. Null roles and texts
are empty strings. Equal conversations are all prompt, with two empty completions; if one is the beginning of the
other, its completion is empty. ``usable`` is true when the completions differ and both have something to learn.
A conversation without a partner is rejected without its last turn. Rows without a conversation id belong to none
and are left out. Mark strings inside a text are ordinary text; spans, not searches, tell what is learned from.
Only the named columns are read, so further columns cannot clash.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "<|end|>\n"
LEARNED_ROLE = "assistant"
TURNS = "array<struct<role:string,text:string>>"


def conversations(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): every conversation as one array of (role, text), in order."""
    own = F.struct(F.col(turn).alias("at"), F.col(role).alias("role"), F.col(text).alias("text"))
    ordered = F.sort_array(F.collect_list(own))
    plain = F.transform(ordered, lambda t: F.struct(F.coalesce(t["role"], F.lit("")).alias("role"), F.coalesce(t["text"], F.lit("")).alias("text")))
    return turns.where(F.col(conv_id).isNotNull()).groupBy(F.col(conv_id).cast("bigint").alias("conv_id")).agg(plain.alias("turns"))


def with_other_endings(turns: DataFrame, **names: str) -> DataFrame:
    """(pair_id, chosen, rejected) of every conversation; the ending comes from the conversation of the other parity."""
    own = conversations(turns, **names)
    ends = conversations(turns, **names).select(F.col("conv_id").bitwiseXOR(F.lit(1)).alias("of"), F.element_at("turns", -1)["text"].alias("ending"))
    last = F.struct(F.element_at("turns", -1)["role"].alias("role"), F.col("ending").alias("text"))
    before = F.slice("turns", 1, F.size("turns") - 1)
    rejected = F.when(F.col("ending").isNull(), before).otherwise(F.concat(before, F.array(last)))
    return own.join(ends, own["conv_id"] == ends["of"], "left").select(
        F.col("conv_id").alias("pair_id"), F.col("turns").alias("chosen"), rejected.alias("rejected")
    )


def _header(turn: Column) -> Column:
    return F.concat(F.lit("<|"), turn["role"], F.lit("|>\n"))


def _piece(turn: Column) -> Column:
    return F.concat(_header(turn), turn["text"], F.lit(END))


def rendered(turns: Column) -> Column:
    """The turns as one string."""
    return F.array_join(F.transform(turns, _piece), "")


def learned_spans(turns: Column) -> Column:
    """(start, length) in characters of what is learned from in the rendered turns."""

    def add(state: Column, turn: Column) -> Column:
        head, body = F.length(_header(turn)), F.length(turn["text"]) + len(END)
        span = F.struct((state["at"] + head).alias("start"), body.alias("length"))
        spans = F.when(turn["role"] == LEARNED_ROLE, F.concat(state["spans"], F.array(span))).otherwise(state["spans"])
        return F.struct((state["at"] + head + body).alias("at"), spans.alias("spans"))

    begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    return F.aggregate(turns, begin, add, lambda state: state["spans"])


def common_turns(a: Column, b: Column) -> Column:
    """The length of the longest prefix that two arrays of turns share."""
    shorter = F.least(F.size(a), F.size(b))
    equal = F.zip_with(F.slice(a, F.lit(1), shorter), F.slice(b, F.lit(1), shorter), lambda x, y: x == y)
    at = F.array_position(equal, False).cast("int")
    return F.when(at == 0, shorter).otherwise(at - 1)


def format_preferences(pairs: DataFrame, pair_id: str = "pair_id") -> DataFrame:
    """(pair_id, n_prompt_turns, prompt, chosen, rejected, chosen_mask, rejected_mask, usable) of (pair_id, chosen, rejected).

    The masks are arrays of (start, length) in the completions.
    """
    empty = F.array().cast(TURNS)
    a, b = F.coalesce(F.col("chosen"), empty), F.coalesce(F.col("rejected"), empty)
    split = pairs.select(F.col(pair_id).alias("pair_id"), a.alias("a"), b.alias("b"), common_turns(a, b).alias("k"))
    rest = lambda side: F.slice(F.col(side), F.col("k") + 1, F.size(side))
    told = split.select(
        "pair_id", F.col("k").cast("bigint").alias("n_prompt_turns"), rendered(F.slice("a", F.lit(1), F.col("k"))).alias("prompt"),
        rendered(rest("a")).alias("chosen"), rendered(rest("b")).alias("rejected"),
        learned_spans(rest("a")).alias("chosen_mask"), learned_spans(rest("b")).alias("rejected_mask"),
    )
    usable = (F.col("chosen") != F.col("rejected")) & (F.size("chosen_mask") > 0) & (F.size("rejected_mask") > 0)
    return told.withColumn("usable", usable)


def mask_text(mask: Column) -> Column:
    """A mask as text, start:length by comma."""
    return F.array_join(F.transform(mask, lambda s: F.concat_ws(":", s["start"], s["length"])), ",")


SQL = """
WITH t AS (
  SELECT conv_id, row_number() OVER w AS i, count(*) OVER (PARTITION BY conv_id) AS n, coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST)
), r AS (
  SELECT conv_id, i, role, text FROM t WHERE i < n
  UNION ALL SELECT t.conv_id, t.i, t.role, l.text FROM t JOIN t l ON l.conv_id = xor(t.conv_id, 1) AND l.i = l.n WHERE t.i = t.n
), k AS (
  SELECT t.conv_id, coalesce(min(CASE WHEN r.i IS NULL OR r.role <> t.role OR r.text <> t.text THEN t.i - 1 END), max(t.n)) AS k
  FROM t LEFT JOIN r ON r.conv_id = t.conv_id AND r.i = t.i GROUP BY t.conv_id
), pieces AS (
  SELECT s.side, s.conv_id, s.i, k.k, s.role, '<|' || s.role || '|>' || chr(10) AS head, s.text || '<|end|>' || chr(10) AS body
  FROM (SELECT 'a' AS side, conv_id, i, role, text FROM t UNION ALL SELECT 'b', conv_id, i, role, text FROM r) s JOIN k ON k.conv_id = s.conv_id
), placed AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY side, conv_id, i > k ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS pos FROM pieces
), sides AS (
  SELECT side, conv_id, max(k) AS k,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE i <= k), '') AS prompt,
    coalesce(string_agg(head || body, '' ORDER BY i) FILTER (WHERE i > k), '') AS completion,
    coalesce(string_agg(CAST(pos + length(head) AS VARCHAR) || ':' || CAST(length(body) AS VARCHAR), ',' ORDER BY i) FILTER (WHERE i > k AND role = 'assistant'), '') AS mask
  FROM placed GROUP BY side, conv_id
)
SELECT a.conv_id AS pair_id, a.k AS n_prompt_turns, a.prompt, a.completion AS chosen, coalesce(b.completion, '') AS rejected,
  a.mask AS chosen_mask, coalesce(b.mask, '') AS rejected_mask,
  a.completion <> coalesce(b.completion, '') AND a.mask <> '' AND coalesce(b.mask, '') <> '' AS usable
FROM (SELECT * FROM sides WHERE side = 'a') a LEFT JOIN (SELECT * FROM sides WHERE side = 'b') b ON b.conv_id = a.conv_id
"""
