"""Substring dedup by recompression: which runs of words also stand in a document with a smaller id.

Texts are sequences of word names. Each round names what stands side by side, by content alone, so every task
gives equal substrings equal symbols inside: a round of runs replaces k equal neighbours by one symbol of
(symbol, k), a round of pairs splits the symbols into left and right ones by a hash bit and replaces each
left-right pair by one symbol. A symbol carries its context, the words that its making depends on; if these lie
in a window of words, the symbol is the same wherever the window occurs. The symbols of the last round are named
once more in groups of ``GROUP`` neighbours, the high-level symbols.

Every window of ``width`` words names one of the high-level symbols within it, the least by hash; where a run is
so long that it has none, the window's own hash stands in. Equal windows thus name equal symbols, and

1. a shuffle by symbol finds those that two documents share (``shared_symbols``),
2. only windows whose symbol is shared are compared, by 96 bits of hash over all their words, in a second
   shuffle that finds the least document of each (``repeated_spans``),
3. the words covered by windows that a smaller document holds are taken out (``cut``).

Whole texts are symbols too: a document equal to a smaller one is repeated as a whole and asks for no window.
Texts are shuffled by id and hash once, compressed, and Spark reuses that exchange in steps 2 and 3. Before each shuffle a part
of a batch settles among its own documents what it can: of many documents with a symbol or window one asks,
and the others are answered at once, so a passage that a third of all documents share makes one row per part.
What windows are compared grows with what is repeated, not with the corpus.

Defined results: a null or empty text has no words, nothing is removed and its kept words are the empty string. A text
shorter than ``width`` words keeps all of them. Repeats inside one document, or between rows with the same id,
are left; rows of one id are told apart by a hash of their texts and each loses its own repeats only. A row with a null id is compared with nothing and kept. Texts of any length are taken whole. Only the
id and the text are read, so further columns cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm import flat
from muster.llm.flat import mixed
from muster.llm.tables import bounded_batches, kept
from muster.operators.sizing import sent_out

WIDTH = 13
#: Rounds of naming: runs, then pairs twice.
ROUNDS = ("runs", "pairs", "pairs")
GROUP = 3
#: Documents of a batch settle among themselves in parts of about so many bytes of text.
PART_BYTES = 8 << 20

_STEP_A, _STEP_B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class Symbols(NamedTuple):
    """Symbols of several texts in a row; a barrier stands before, between and after the texts."""

    names: np.ndarray
    barrier: np.ndarray
    context_start: np.ndarray
    context_end: np.ndarray


def _first_symbols(words: flat.Words) -> tuple[Symbols, np.ndarray]:
    """One symbol per word, and the text of each place (the text before it for a barrier)."""
    texts = len(words.offsets) - 1
    text_of = np.repeat(np.arange(texts), np.diff(words.offsets))
    places = np.arange(len(words.names)) + text_of + 1
    barrier = np.ones(len(words.names) + texts + 1, dtype=bool)
    barrier[places] = False
    names = mixed(np.arange(len(barrier), dtype=np.uint64) + _STEP_B)
    names[places] = words.names
    at = np.arange(len(barrier))
    return Symbols(names, barrier, at, at + 1), np.cumsum(barrier) - 1


def _name_runs(s: Symbols) -> Symbols:
    """Runs of equal symbols become one; to see that a run ends takes its neighbours."""
    fresh = np.ones(len(s.names), dtype=bool)
    fresh[1:] = (s.names[1:] != s.names[:-1]) | s.barrier[1:] | s.barrier[:-1]
    first = np.flatnonzero(fresh)
    after = np.append(first[1:], len(s.names))
    size = (after - first).astype(np.uint64)
    names = np.where(size > 1, mixed(s.names[first] * np.uint64(3) + size), s.names[first])
    starts, ends = s.context_start[np.maximum(first - 1, 0)], s.context_end[np.minimum(after, len(s.names) - 1)]
    return Symbols(names, s.barrier[first], starts, ends)


def _name_pairs(s: Symbols, level: int) -> Symbols:
    """A left symbol and a right one after it become one.

    A left symbol never joins the one before it, a right one never the one after it, so the context grows by
    the neighbour on one side only.
    """
    right = (mixed(s.names + _STEP_A * np.array(level, dtype=np.uint64)) >> np.uint64(63)).astype(bool)
    joins = np.zeros(len(s.names), dtype=bool)
    joins[:-1] = (~right & ~s.barrier)[:-1] & (right & ~s.barrier)[1:]
    taken = np.zeros(len(s.names), dtype=bool)
    taken[1:] = joins[:-1]
    at = np.flatnonzero(~taken)
    after, before = np.minimum(at + 1, len(s.names) - 1), np.maximum(at - 1, 0)
    pair = joins[at]
    names = np.where(pair, mixed(s.names[at] * np.uint64(5) + mixed(s.names[after] + np.uint64(level))), s.names[at])
    starts = np.where(right[at], s.context_start[before], s.context_start[at])
    ends = np.where(right[at], s.context_end[at], s.context_end[after])
    return Symbols(names, s.barrier[at], starts, ends)


def _high_level(s: Symbols, width: int) -> Symbols:
    """All rounds, then groups of neighbours; only what fits a window with its context stays."""
    for level, kind in enumerate(ROUNDS, 1):
        s = _name_runs(s) if kind == "runs" else _name_pairs(s, level)
    names, barrier, n = s.names, s.barrier, len(s.names) - GROUP + 1
    if n <= 0:
        return Symbols(names[:0], barrier[:0], s.context_start[:0], s.context_end[:0])
    group, stopped = names[:n], barrier[:n]
    for k in range(1, GROUP):
        group, stopped = mixed(group * np.uint64(7) + names[k : n + k]), stopped | barrier[k : n + k]
    starts, ends = s.context_start[:n], s.context_end[GROUP - 1 :]
    fit = ~stopped & (ends - starts <= width)
    return Symbols(group[fit], stopped[fit], starts[fit], ends[fit])


def _whole_hash(words: flat.Words, step: np.uint64) -> np.ndarray:
    """A hash of all words of each text in order."""
    at = np.arange(len(words.names), dtype=np.uint64) - np.repeat(words.offsets[:-1], np.diff(words.offsets)).astype(np.uint64)
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(words.names + mixed(at + step)), dtype=np.uint64)))
    return mixed(total[words.offsets[1:]] - total[words.offsets[:-1]] + step)


def _window_hash(names: np.ndarray, starts: np.ndarray, width: int, step: np.uint64) -> np.ndarray:
    total = np.zeros(len(starts), dtype=np.uint64)
    own = mixed(names ^ step)
    for k in range(width):
        total = total * step + own[starts + k]
    return mixed(total)


def _least_inside(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """For each range low <= i < high of a few indexes, that of the least key: a sparse table of minima."""
    table, size = [np.arange(len(keys))], 1
    most = int((high - low).max())
    while size * 2 <= most:
        a, b = table[-1][:-size], table[-1][size:]
        table.append(np.where(keys[b] < keys[a], b, a))
        size *= 2
    level = np.frexp((high - low).astype(np.float64))[1] - 1
    found = np.empty(len(low), dtype=np.int64)
    for k, row in enumerate(table):
        mine = np.flatnonzero(level == k)
        a, b = row[low[mine]], row[high[mine] - (1 << k)]
        found[mine] = np.where(keys[b] < keys[a], b, a)
    return found


class Windows(NamedTuple):
    """All windows of several texts: place of the first word, text, first word in the text, named symbol."""

    place: np.ndarray
    text: np.ndarray
    start: np.ndarray
    symbol: np.ndarray


def _windows(words: flat.Words, width: int) -> tuple[Symbols, Windows]:
    first, text_of = _first_symbols(words)
    n = len(first.names) - width + 1
    if n <= 0:
        none = np.zeros(0, dtype=np.int64)
        return first, Windows(none, none, none, np.zeros(0, dtype=np.uint64))
    barriers = np.concatenate(([0], np.cumsum(first.barrier)))
    place = np.flatnonzero(barriers[width:] == barriers[:-width])
    high = _high_level(first, width)
    low_at = np.searchsorted(high.context_start, place)
    high_at = np.searchsorted(high.context_end, place + width, side="right")
    has = high_at > low_at
    symbol = np.empty(len(place), dtype=np.uint64)
    if has.any():
        symbol[has] = high.names[_least_inside(high.names, low_at[has], high_at[has])]
    symbol[~has] = _window_hash(first.names, place[~has], width, _STEP_B)
    text = text_of[place]
    return first, Windows(place, text, place - text - 1 - words.offsets[text], symbol)


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row, part in flat.slices(batch.column(1), PART_BYTES):
            yield batch.slice(row, len(part))


def _ids(batch: pa.RecordBatch, column: int = 0) -> np.ndarray:
    return batch.column(column).to_numpy(zero_copy_only=False).astype(np.int64)


def _runs(values: np.ndarray) -> np.ndarray:
    """Where a new value begins."""
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    return fresh


def _asked_symbols(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(asked, symbol, doc, print, known): the least document of a part of a batch with a symbol asks for it; if the part has
    more documents with it, all of them know that it is shared.

    A whole text of a window or more is a symbol too, whose second hash stands for the symbol; ``known`` is null.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(batches):
            ids, symbols, docs, wholes, seconds, owners = _ids(batch), [], [], [], [], []
            prints, own_prints, owner_prints = _ids(batch, 2), [], []
            for row, part in flat.slices(batch.column(1)):
                words = flat.words(part)
                _, windows = _windows(words, width)
                long = np.flatnonzero(np.diff(words.offsets) >= width)
                wholes.append(_whole_hash(words, _STEP_A)[long])
                seconds.append(_whole_hash(words, _STEP_B)[long])
                owners.append(ids[row + long])
                owner_prints.append(prints[row + long])
                new = _runs(windows.symbol) | _runs(windows.text)
                symbols.append(windows.symbol[new])
                docs.append(ids[row + windows.text[new]])
                own_prints.append(prints[row + windows.text[new]])
            if not symbols:
                continue
            symbol, doc, own = np.concatenate(symbols), np.concatenate(docs), np.concatenate(own_prints)
            order = np.lexsort((own, doc, symbol))
            symbol, doc, own = symbol[order], doc[order], own[order]
            new = _runs(symbol)
            distinct = new | _runs(doc) | _runs(own)
            symbol, doc, own, new = symbol[distinct], doc[distinct], own[distinct], new[distinct]
            alone = new.copy()
            alone[:-1] &= new[1:]  # the only document of its symbol
            asked = np.where(new, symbol, mixed(symbol + doc.astype(np.uint64) * _STEP_A))
            owner = np.concatenate(owners)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((asked, *wholes)).view(np.int64)), pa.array(np.concatenate((symbol, *seconds)).view(np.int64)),
                    pa.array(np.concatenate((doc, owner))), pa.array(np.concatenate((own, *owner_prints))),
                    pa.array(np.append(~alone, np.zeros(len(owner), bool)), mask=np.arange(len(doc) + len(owner)) >= len(doc)),
                ],
                names=["asked", "symbol", "doc", "print", "known"],
            )
            flat.give_back()

    return ask


def shared_symbols(docs: DataFrame, width: int) -> DataFrame:
    """(doc, print, symbols, copy): the symbols of each row that another document also has, and whether the whole text
    is that of a smaller document; of such a copy no symbols are needed."""
    asked = docs.mapInArrow(_asked_symbols(width), "asked bigint, symbol bigint, doc bigint, print bigint, known boolean")
    group = Window.partitionBy("asked", "symbol")
    least = asked.withColumn("_least", F.min("doc").over(group)).withColumn("_most", F.max("doc").over(group))
    copy = F.col("known").isNull() & (F.col("doc") > F.col("_least"))
    shared = least.where(F.col("known") | (F.col("known").isNotNull() & (F.col("_least") != F.col("_most"))) | copy)
    return shared.groupBy("doc", "print").agg(
        F.collect_list(F.when(F.col("known").isNotNull(), F.col("symbol"))).alias("symbols"), F.max(F.col("known").isNull()).alias("copy")
    )


def _span_rows(doc: np.ndarray, own: np.ndarray, start: np.ndarray) -> list[np.ndarray]:
    """Sorted (doc, print, start) rows as (doc, print, first start, number of starts in a row)."""
    fresh = _runs(doc) | _runs(own)
    fresh[1:] |= start[1:] != start[:-1] + 1
    first = np.flatnonzero(fresh)
    return [doc[first], own[first], start[first], np.diff(np.append(first, len(doc)))]


def _asked_windows(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """(window, rest, doc, print, known) of windows whose symbol is shared.

    The least document of a batch with a window asks: ``rest`` has 32 further bits of the window's hash above
    its start. The others know that it is repeated: ``rest`` has the number of starts in a row above the first.
    """

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _parts(_unpacked(batches)):
            ids, found, copies = _ids(batch), [], []
            copy, prints = batch.column(3).to_numpy(zero_copy_only=False).astype(bool), _ids(batch, 4)
            for row, part in flat.slices(batch.column(1)):
                own = batch.column(2).slice(row, len(part))
                sizes = np.diff(np.asarray(own.offsets))
                keys = own.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
                words = flat.words(part)
                first, windows = _windows(words, width)
                starts = np.diff(words.offsets)[copy[row : row + len(part)]] - width + 1
                copies.append((*[x[row : row + len(part)][copy[row : row + len(part)]] for x in (ids, prints)], starts))
                marked = mixed(keys + np.repeat(np.arange(len(part)), sizes).astype(np.uint64) * _STEP_A)
                hit = np.isin(mixed(windows.symbol + windows.text.astype(np.uint64) * _STEP_A), marked)
                hit &= ~copy[row + windows.text]
                place = windows.place[hit]
                found.append((
                    _window_hash(first.names, place, width, _STEP_A),
                    _window_hash(first.names, place, width, _STEP_B) >> np.uint64(32),
                    ids[row + windows.text[hit]],
                    prints[row + windows.text[hit]],
                    windows.start[hit],
                ))
            if not found:
                continue
            window, more, doc, own, start = (np.concatenate(x) for x in zip(*found))
            order = np.lexsort((start, doc, more, window))
            window, more, doc, own, start = window[order], more[order], doc[order], own[order], start[order]
            new = _runs(window) | _runs(more)
            least = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))] if len(doc) else doc
            asks = doc == least
            order = np.lexsort((start[~asks], own[~asks], doc[~asks]))
            known, known_own, begin, times = _span_rows(doc[~asks][order], own[~asks][order], start[~asks][order])
            whole, whole_own, all_starts = (np.concatenate(x) for x in zip(*copies))
            known, known_own = np.concatenate((known, whole)), np.concatenate((known_own, whole_own))
            begin = np.concatenate((begin, np.zeros(len(whole), np.int64)))
            times = np.concatenate((times, all_starts))
            rest = np.concatenate((more[asks].astype(np.int64) << 32 | start[asks], times << 32 | begin))
            key = np.concatenate((window[asks], mixed(known.astype(np.uint64) * _STEP_A + begin.astype(np.uint64))))
            yield pa.RecordBatch.from_arrays(
                [pa.array(key.view(np.int64)), pa.array(rest), pa.array(np.concatenate((doc[asks], known))),
                 pa.array(np.concatenate((own[asks], known_own))), pa.array(np.arange(len(rest)) >= asks.sum())],
                names=["window", "rest", "doc", "print", "known"],
            )
            flat.give_back()

    return ask


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc, print, spans): the starts of the windows that a document with a smaller id also has.

    ``docs`` has (id, text), ``print``, a hash that tells rows of one id apart, and ``row``, a struct with the same text packed. A span is a 64-bit number, the number of starts in a row
    above the first of them.
    """
    shared = shared_symbols(docs.select("id", "text", "print"), width)
    texts = docs.select("id", "print", "row")
    same = (texts["id"] == shared["doc"]) & (texts["print"] == shared["print"])
    joined = texts.join(shared.hint("shuffle_hash"), same).select("id", "row", "symbols", "copy", texts["print"])
    asked = joined.mapInArrow(_asked_windows(width), "window bigint, rest bigint, doc bigint, print bigint, known boolean")
    group = Window.partitionBy("window", F.when(F.col("known"), F.lit(-1)).otherwise(F.shiftrightunsigned("rest", 32)))
    later = asked.withColumn("_least", F.min("doc").over(group)).where("known OR doc > _least")
    one = F.expr("rest & 4294967295L") + F.lit(1 << 32)
    span = F.when(F.col("known"), F.col("rest")).otherwise(one)
    return later.select("doc", "print", span.alias("span")).groupBy("doc", "print").agg(F.collect_list("span").alias("spans"))


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches whose second column is a struct of a packed text and carried fields: the text takes its place, the
    fields come last. Parts of bounded size."""
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        texts, size, start = [], 0, 0
        packed, *carried = batch.column(1).flatten()
        for i, data in enumerate(packed):
            texts.append(unpack.decompress(data.as_py()) if data.is_valid else None)
            size += len(texts[-1] or b"")
            if size >= PART_BYTES or i == batch.num_rows - 1:
                rest = [*batch.columns[2:], *carried]
                names = ["id", "text", *batch.schema.names[2:], *[f"_carry{k}" for k in range(len(carried))]]
                columns = [batch.column(0).slice(start, len(texts)), pa.array(texts, pa.binary()).cast(pa.string())]
                yield pa.RecordBatch.from_arrays([*columns, *[c.slice(start, len(texts)) for c in rest]], names=names)
                texts, size, start = [], 0, i + 1


def _packed(text: Column) -> Column:
    """Texts compressed for their shuffle; null stays null."""

    @F.arrow_udf("binary")
    def pack(texts: pa.Array) -> pa.Array:
        press = zstandard.ZstdCompressor(level=3)
        return pa.array([press.compress(t.as_buffer()) if t.is_valid else None for t in texts.cast(pa.binary())], pa.binary())

    return pack(text)


def _kept(text: str | None, spans: list[int], width: int) -> tuple[int, int, str, str | None]:
    """Words, words removed, the kept words joined by blanks, and the text without the removed words."""
    data = (text or "").encode("utf-8")
    words = data.split()
    if not spans:
        return len(words), 0, b" ".join(words).decode("utf-8"), text
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    packed = np.array(spans, dtype=np.int64)
    begin = packed & 0xFFFFFFFF
    np.add.at(edges, begin, 1)
    np.add.at(edges, begin + (packed >> 32) - 1 + width, -1)
    stays = np.cumsum(edges)[:-1] == 0
    at = [(m.start(), m.end()) for m in _WORD.finditer(data)]
    turns = np.flatnonzero(np.diff(np.concatenate(([0], stays.astype(np.int8), [0]))))
    runs = turns.reshape(-1, 2)
    left, last = [], 0
    for a, b in runs.tolist():
        gap = data[at[a - 1][1] if a else 0 : at[a][0]] if not last else data[last : at[a][0]]
        left.append((b"\n" if b"\n" in gap else b" ") if last else b"")
        left.append(data[at[a][0] : at[b - 1][1]])
        last = at[b - 1][1]
    words = [w for w, stay in zip(words, stays.tolist()) if stay]
    return len(stays), int((~stays).sum()), b" ".join(words).decode("utf-8"), b"".join(left).decode("utf-8")


def _cut(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _unpacked(batches):
            spans, more = batch.column(2).to_pylist(), batch.columns[3:]
            for row, part in flat.slices(batch.column(1), 8 * flat.SLICE_BYTES):
                texts = batch.column(1).slice(row, len(part)).to_pylist()
                rows = [_kept(text, own or [], width) for text, own in zip(texts, spans[row : row + len(part)])]
                n, removed, kept, whole = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(row, len(part)), pa.array(n, pa.int64()), pa.array(removed, pa.int64()),
                     pa.array(kept, pa.string()), pa.array(whole, pa.string()), *[c.slice(row, len(part)) for c in more]],
                    names=["id", "n_words", "n_removed", "kept_words", "kept_text", *batch.schema.names[3:]],
                )

    return cut


def _told_apart(docs: DataFrame) -> DataFrame:
    """Adds ``print``: a hash of the text for rows that share their id, zero for all others, as zeros cost a shuffle nothing."""
    twins = docs.where("id IS NOT NULL").groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(F.col("id").alias("_twin"))
    met = docs.join(sent_out(kept(twins, "twins")), F.col("id") == F.col("_twin"), "left")
    return met.withColumn("print", F.when(F.col("_twin").isNotNull(), F.xxhash64("text")).otherwise(F.lit(0).cast("bigint"))).drop("_twin")


def dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = WIDTH, carry: Sequence[str] = ()) -> DataFrame:
    """(id, n_words, n_removed, kept_words, kept_text) of every document, and the columns named in ``carry``.

    ``kept_words`` has the kept words joined by one blank; ``kept_text`` is the text itself with the removed words
    cut out, so a text of which nothing is removed is unchanged. Carried columns may have any names.
    """
    bounded_batches(docs.sparkSession)
    slim = docs.select(
        F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"), *[F.col(f"`{c}`").alias(f"_carry{i}") for i, c in enumerate(carry)]
    )
    more = [f"_carry{i}" for i in range(len(carry))]
    # what is carried travels in one column with the text, so that the shuffle of both steps is the same
    slim = _told_apart(slim).select("id", "text", "print", F.struct(_packed(F.col("text")).alias("packed"), *more).alias("row"))
    named = slim.where("id IS NOT NULL")
    spans = repeated_spans(named, width)
    texts = named.select("id", "print", "row")
    same = (texts["id"] == spans["doc"]) & (texts["print"] == spans["print"])
    cut = texts.join(spans.hint("shuffle_hash"), same, "left").select("id", "row", "spans")
    alone = slim.where("id IS NULL").select("id", "row", F.lit(None).cast("array<bigint>").alias("spans"))
    schema = ", ".join(
        ["id bigint, n_words bigint, n_removed bigint, kept_words string, kept_text string"]
        + [f"{name} {docs.schema[c].dataType.simpleString()}" for name, c in zip(more, carry)]
    )
    done = cut.mapInArrow(_cut(width), schema).unionByName(alone.mapInArrow(_cut(width), schema))
    return done.select(F.col("id").alias(doc_id), "n_words", "n_removed", "kept_words", "kept_text", *[F.col(m).alias(c) for m, c in zip(more, carry)])


SQL = """
WITH d AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS g FROM (SELECT doc_id, ws, unnest(generate_series(1, len(ws) - 12)) AS i FROM d)
), r AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY g) AS least FROM g) WHERE doc_id > least
), c AS (
  SELECT DISTINCT doc_id, unnest(generate_series(i, i + 12)) AS p FROM r
), w AS (
  SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d
), k AS (
  SELECT w.doc_id, count(*) AS n, string_agg(w.word, ' ' ORDER BY w.p) AS kept
  FROM w LEFT JOIN c ON c.doc_id = w.doc_id AND c.p = w.p WHERE c.p IS NULL GROUP BY w.doc_id
)
SELECT d.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(k.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k.kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON k.doc_id = d.doc_id
"""
