"""Joining documents whose word n-gram sets have a Jaccard similarity of at least num / den, by PartEnum.

Two sets of sizes a <= b are that similar when at most (den - num)(a + b) / (den + num) elements are in one of
them only, and then a >= b num / den. Sizes are cut into bands; a set joins its own band, and the next one too
where it is large enough to have a partner there. In each band the domain of elements is partitioned by hash,
on the first level into about half as many parts as elements may differ, each into ``PARTS`` on the second.
Among the first-level parts a set looks at, one at least has a single differing element or none, so two of its
second-level parts agree: each pair of these is one signature, named by the elements it holds, and similar sets
share one. Sets look at a few parts more than are needed, so that one shared signature holds elements; only
sets with so many empty signatures that this does not follow give out the empty ones too.

1. ``signatures`` makes the sets of some texts and their signatures; of the documents of a part of a batch with a
   signature the least asks for it, the others name it as their partner. One shuffle by signature finds each
   asker's least partner.
2. Each document is compared with the one partner it shares most signatures with, so a group of n documents
   gives n - 1 pairs. Pairs that sizes and a parity sketch of the elements do not rule out are verified over
   the whole sets, one row per pair, and components are built of the links found.
3. A signature may still hold documents of different components. While such groups are crowded, those outside
   of a group's main component are compared with its most linked member, up to ``HUBS`` such members a round, which joins
   families of near copies.
4. Documents that share a signature but are in different components after that meet by signature, across
   components only, under the same filters and a sketch as wide as their size asks for, which leaves few pairs that are not similar.
   Signatures are looked at in passes, where they are crowded first one in ``FEW`` squared, then one in ``FEW``, then the rest; a pass
   holds no more sketches than ``PASS_SKETCHES`` for each document. What a pass finds is joined to the components before the next one, so that
   families, whose members share many signatures, make few pairs. Of more pairs than documents each document tries a few
   at a time. So no link is lost, and within a component no more pairs are made.

Defined results: a null or empty text, or one without words, has no elements and links with nothing. A text with fewer
words than n has its whole sequence of words as one element. A null id links with nothing; its
size and component are null. Rows with the same id are taken as one document (the largest set stands for its size). Elements are
compared by 52 bits of hash within two sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm import flat
from muster.llm.components import components
from muster.llm.flat import mixed
from muster.llm.pairs import confirmed
from muster.llm.tables import bounded_batches, kept, released
from muster.operators.sizing import sent_out
from muster.session import fresh_path

SHINGLE, NUM, DEN = 5, 4, 5
PARTS = 3
#: 64-bit numbers of the wide sketch and of the one that it folds to.
WIDE, SKETCH = 64, 8
#: Hubs are tried while groups make over so many pairs per row.
CROWDED = 8
WORTH = 25
#: Hubs not tried yet that a document is compared with in a round.
HUBS = 3
#: One in so many signatures joins most families, before all of them are looked at.
FEW = 16
#: Wide sketches for each document that a pass over signatures may send around, and elements for which the narrow sketch is sharp.
PASS_SKETCHES, SHARP = 2, 700
#: Partners that a document lists.
PARTNERS = 256
#: Documents of a batch meet in parts of about so many bytes of text.
PART_BYTES = 4 << 20
#: Rows of a slice; they fit the bits of an element that hold its text.
_ROW_BITS = 12
_STEP = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Elements of a slice of texts in order of text and name, and the offsets of the texts."""
    words = flat.words(texts, lower=True)
    count = np.diff(words.offsets)
    total = np.zeros(max(len(words.names) - n + 1, 0), dtype=np.uint64)
    for k in range(n):
        total = total * _STEP + mixed(words.names[k : k + len(total)] + np.uint64(n))
    text_of = np.repeat(np.arange(len(count)), count)
    inside = text_of[: len(total)] == text_of[n - 1 :][: len(total)]
    names, owners = [mixed(total)[inside]], [text_of[: len(total)][inside]]
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        whole = np.zeros(len(short), dtype=np.uint64)
        for k in range(n - 1):
            more = count[short] > k
            whole[more] = whole[more] * _STEP + mixed(words.names[words.offsets[short[more]] + k] + np.uint64(k))
        names.append(mixed(whole + count[short].astype(np.uint64)))
        owners.append(short)
    drop = np.uint64(_ROW_BITS)
    keys = (np.concatenate(owners).astype(np.uint64) << np.uint64(64 - _ROW_BITS)) | (np.concatenate(names) >> drop)
    keys = np.unique(keys)
    owner = (keys >> np.uint64(64 - _ROW_BITS)).astype(np.int64)
    return keys & np.uint64((1 << (64 - _ROW_BITS)) - 1), np.searchsorted(owner, np.arange(len(count) + 1))


def most_different(a: np.ndarray, b: np.ndarray, num: int, den: int) -> np.ndarray:
    """How many elements may be in one of two similar sets of sizes a and b only."""
    return (den - num) * (a + b) // (den + num)


def _differing(size: np.ndarray, num: int, den: int) -> np.ndarray:
    return most_different(size, size * den // num, num, den)


class Bands:
    """Bands of sizes up to a largest size, with the numbers of parts of each."""

    def __init__(self, largest: int, num: int, den: int):
        starts = [1, 2]
        while starts[-2] <= largest:  # one further start: the last band, too, ends where it ends for any larger set
            starts.append(max(starts[-1] + 1, -(-starts[-1] * max(3 * num, 2 * den) // (2 * num))))
        self.starts = np.array(starts, dtype=np.int64)
        needed = _differing(self.starts[1:] - 1, num, den) // 2 + 1
        self.spare = (needed + 6) // 12
        self.parts = needed + self.spare


def _part_signatures(elements: np.ndarray, offsets: np.ndarray, band: np.ndarray, used: np.ndarray, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of sets in the given bands that look at the first ``used`` parts."""
    sizes, parts = np.diff(offsets), bands.parts[band]
    base = np.concatenate(([0], np.cumsum(used * PARTS)))
    of = np.repeat(np.arange(len(sizes)), sizes)
    mix = mixed(elements ^ _STEP)
    first = ((mix >> np.uint64(24)) % parts[of].astype(np.uint64)).astype(np.int64)
    second = (((mix & np.uint64(0xFFFFFF)) * np.uint64(PARTS)) >> np.uint64(24)).astype(np.int64)
    seen = first < used[of]
    cell = base[of[seen]] + first[seen] * PARTS + second[seen]
    held = np.bincount(cell, minlength=base[-1]).reshape(-1, PARTS)
    sums = np.zeros(base[-1], dtype=np.uint64)
    np.add.at(sums, cell, mixed(elements[seen]))
    sums = sums.reshape(-1, PARTS)
    text = np.repeat(np.arange(len(sizes)), used)
    part = np.arange(len(text)) - base[text] // PARTS
    empty = np.stack([held[:, a] + held[:, b] == 0 for a, b in ((0, 1), (0, 2), (1, 2))], axis=1)
    hollow = np.bincount(text, weights=empty.any(axis=1), minlength=len(sizes))
    give = (hollow > bands.spare[band])[text]
    tag = mixed(band[text].astype(np.uint64) * np.uint64(1 << 32) + part.astype(np.uint64))
    texts, names = [], []
    for j, (a, b) in enumerate(((0, 1), (0, 2), (1, 2))):
        out = ~empty[:, j] | give
        texts.append(text[out])
        names.append(mixed((sums[out, a] * np.uint64(3) ^ mixed(sums[out, b] + np.uint64(j))) + tag[out]))
    return np.concatenate(texts), np.concatenate(names)


def signatures(elements: np.ndarray, offsets: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, signature) of all sets that have elements; sets whose partners must be equal give their own name."""
    sizes = np.diff(offsets)
    bands = Bands(int(sizes.max(initial=1)), num, den)
    differing = _differing(sizes, num, den)
    own = np.searchsorted(bands.starts, sizes, side="right") - 1
    texts, names = [], []
    for step in (0, 1):
        band = own + step
        mine = (sizes > 0) & (differing > 0)
        if step:
            mine &= sizes * den >= bands.starts[np.minimum(band, len(bands.starts) - 1)] * num
        rows = np.flatnonzero(mine)
        if len(rows):
            keep = np.repeat(mine, sizes)
            edges = np.concatenate(([0], np.cumsum(sizes[rows])))
            used = differing[rows] // 2 + 1 + bands.spare[band[rows]]
            text, name = _part_signatures(elements[keep], edges, band[rows], used, bands)
            texts.append(rows[text])
            names.append(name)
    small = np.flatnonzero((sizes > 0) & (differing == 0))
    if len(small):
        texts.append(small)
        names.append(_set_names(elements, offsets)[small])
    if not texts:
        return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.uint64)
    return np.concatenate(texts), np.concatenate(names)


def _set_names(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(elements + _STEP), dtype=np.uint64)))
    return mixed(total[offsets[1:]] - total[offsets[:-1]] + np.diff(offsets).astype(np.uint64))


def _sketches(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One bit per bucket of elements: whether an odd number of them is in it.

    Where two sketches differ, an odd number of elements is in one of the sets only, so the number of bits that
    differ is never above the number of such elements. That holds for folded sketches too.
    """
    rows = len(offsets) - 1
    bit = mixed(elements) % np.uint64(64 * WIDE)
    at = np.repeat(np.arange(rows) * WIDE, np.diff(offsets)) + (bit // np.uint64(64)).astype(np.int64)
    out = np.zeros(rows * WIDE, dtype=np.uint64)
    np.bitwise_xor.at(out, at, np.uint64(1) << (bit % np.uint64(64)))
    return out.reshape(rows, WIDE)


def _lists(rows: np.ndarray) -> pa.Array:
    ends = np.arange(len(rows) + 1, dtype=np.int32) * WIDE
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(rows.reshape(-1).view(np.int64)))


_BITS = [f"s{i}" for i in range(SKETCH)]
_ROWS = "asked bigint, signature bigint, doc bigint, lead bigint, kind int, size bigint, " + ", ".join(f"{b} bigint" for b in _BITS) + ", wide array<bigint>"
#: Kinds of rows: a document itself, one that asks for a signature, one that has a partner in its batch.
_SELF, _ASKS, _LED = 0, 1, 2


def _signed(n: int, num: int, den: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(row, len(part)) for b in batches for row, part in flat.slices(b.column(1), PART_BYTES)):
            ids = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            sizes, sketches, sets, docs, names = [], [], [], [], []
            leads: dict[int, int] = {}
            order = np.argsort(ids, kind="stable")
            for row, part in flat.slices(batch.column(1), rows=1 << _ROW_BITS):
                elements, offsets = shingle_sets(part, n)
                sizes.append(np.diff(offsets))
                sketches.append(_sketches(elements, offsets))
                own = _set_names(elements, offsets)
                sets.append(own)
                text, name = signatures(elements, offsets, num, den)
                docs.append(row + text)
                names.append(name)
            if not sizes:
                continue
            size, own = np.concatenate(sizes), np.concatenate(sets)
            # documents with one set: the least of the batch stands for them, and they link with it
            _, least, group = np.unique(own[order], return_index=True, return_inverse=True)
            lead = np.empty(len(ids), dtype=np.int64)
            lead[order] = ids[order[least[group]]]
            stands = np.zeros(len(ids), dtype=bool)
            stands[order[least]] = True
            row, name = np.concatenate(docs), np.concatenate(names)
            keep = stands[row]
            doc, name = ids[row[keep]], name[keep]
            order = np.lexsort((doc, name))
            doc, name = doc[order], name[order]
            new = np.ones(len(doc), dtype=bool)
            new[1:] = name[1:] != name[:-1]
            again = ~new
            again[1:] &= doc[1:] == doc[:-1]
            doc, name, new = doc[~again], name[~again], new[~again]
            least = doc[np.maximum.accumulate(np.where(new, np.arange(len(doc)), 0))] if len(doc) else doc
            led = np.zeros(len(doc), dtype=bool)
            led[:-1] = new[:-1] & ~new[1:]  # asks, and has others in the batch
            asked = np.where(new, name, mixed(name + doc.astype(np.uint64) * _STEP))
            linked = (size > 0) & (lead != ids)
            wide = np.concatenate(sketches)
            folded = np.bitwise_xor.reduce(wide.reshape(len(wide), -1, SKETCH), axis=1).view(np.int64)
            several = len(ids) + len(doc)
            made = pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate((mixed(ids.astype(np.uint64) + _STEP), asked)).view(np.int64)),
                    pa.array(np.concatenate((np.zeros(len(ids), np.uint64), name)).view(np.int64), mask=np.concatenate((np.zeros(len(ids), bool), new))),
                    pa.array(np.concatenate((ids, doc))),
                    pa.array(np.concatenate((lead, least)), mask=np.concatenate((~linked, new & ~led))),
                    pa.array(np.concatenate((np.full(len(ids), _SELF), np.where(new, _ASKS, _LED))), pa.int32()),
                    pa.array(np.concatenate((size, np.zeros(len(doc), np.int64))), mask=np.arange(several) >= len(ids)),
                    *[pa.concat_arrays([pa.array(column), pa.nulls(len(doc), pa.int64())]) for column in folded.T],
                    pa.concat_arrays([_lists(wide), pa.nulls(len(doc), pa.list_(pa.int64()))]),
                ],
                names=[c.split()[0] for c in _ROWS.split(", ")],
            )
            yield from flat.sliced(made)
            del made, doc, name, least, asked, row
            flat.give_back()

    return make


def _set_bytes(n: int) -> Callable[[Column], Column]:
    @F.arrow_udf("binary")
    def set_bytes(texts: pa.Array) -> pa.Array:
        out = []
        for _, part in flat.slices(texts, rows=1 << _ROW_BITS):
            elements, offsets = shingle_sets(part, n)
            out.extend(elements[a:b].tobytes() for a, b in zip(offsets[:-1], offsets[1:]))
        flat.give_back()
        return pa.array(out, pa.binary())

    return set_bytes


def _could_be(num: int, den: int) -> Column:
    """Sizes and sketches of a pair that do not rule it out."""
    a, b = F.col("size_a"), F.col("size_b")
    apart = sum((F.bit_count(F.col(f"{bits}_a").bitwiseXOR(F.col(f"{bits}_b"))) for bits in _BITS), F.lit(0))
    return (a * num <= b * den) & (b * num <= a * den) & (apart * (den + num) <= (a + b) * (den - num))


def _named(df: DataFrame, side: str, *names: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in names])


def _verified(docs: DataFrame, info: DataFrame, pairs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that are similar, by their whole sets.

    Sizes and sketches rule most others out. The texts of the rest are read once; each document's set goes to
    its pairs, where both meet by pair.
    """
    left, right = (_named(info, x, "doc", "size", *_BITS, "wide") for x in "ab")
    apart = F.aggregate(F.zip_with("wide_a", "wide_b", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    likely = (
        pairs.join(left, F.col("a") == F.col("doc_a")).join(right, (F.col("b") == F.col("doc_b")) & _could_be(num, den))
        .where(apart * (den + num) <= (F.col("size_a") + F.col("size_b")) * (den - num)).select("a", "b")
    )

    def sets_of(asked: DataFrame) -> DataFrame:
        return docs.join(sent_out(asked), docs["id"] == F.col("node")).select("node", "n", _set_bytes(n)(F.col("text")).alias("set"))

    return confirmed(likely, sets_of, num, den)


def _both_ways(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _open_groups(members: DataFrame, info: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Members (signature, doc) of the signatures with several components, with doc's size and root, the number of members,
    and the component that most members are in (base) with its most linked member (hub)."""
    ends = links.select(F.col("a").alias("end")).unionAll(links.select("b")).groupBy("end").agg(F.count(F.lit(1)).alias("degree"))
    nodes = (
        info.join(roots, info["doc"] == roots["v"], "left").join(ends, info["doc"] == ends["end"], "left")
        .select(F.col("doc").alias("of"), "size", F.coalesce("root", "doc").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    )
    members = members.select("signature", "doc")
    at = members.join(nodes, members["doc"] == nodes["of"]).select("signature", "doc", "size", "root", "degree")
    groups = (
        at.groupBy("signature", "root").agg(F.count(F.lit(1)).alias("n"), F.max_by("doc", F.struct("degree", "doc")).alias("hub"))
        .groupBy("signature").agg(
            F.max_by(F.struct("root", "hub"), F.struct("n", "root")).alias("base"), F.count(F.lit(1)).alias("roots"), F.sum("n").alias("members")
        )
        .where("roots > 1").select(F.col("signature").alias("of_group"), "base.hub", F.col("base.root").alias("base"), "members")
    )
    return at.join(groups, at["signature"] == groups["of_group"]).select("signature", "doc", "size", "root", "base", "hub", "members")


def _partners(pairs: DataFrame) -> DataFrame:
    """(of, partners): up to ``PARTNERS`` documents that a document stands in a pair with; one of the two lists the other."""
    first = F.pmod(F.xxhash64("a", "b"), F.lit(2)) == 0
    listed = pairs.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("of"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("to"))
    some = listed.groupBy("of", F.pmod(F.xxhash64("to"), F.lit(PARTNERS)).alias("_k")).agg(F.max("to").alias("to"))
    return some.groupBy("of").agg(F.collect_list("to").alias("partners"))


def _width() -> Column:
    """Numbers of the sketch that tells sets of a size apart."""
    steps = F.when(F.col("size") <= SHARP, SKETCH)
    width = 2 * SKETCH
    while width < WIDE:
        steps = steps.when(F.col("size") <= SHARP * width // SKETCH, width)
        width *= 2
    return steps.otherwise(WIDE)


def _halves(sketch: Column) -> Column:
    """A sketch folded to half of its width."""
    half = (F.size(sketch) / 2).cast("int")
    return F.zip_with(F.slice(sketch, F.lit(1), half), F.slice(sketch, half + 1, half), lambda x, y: x.bitwiseXOR(y))


def _sharp() -> Column:
    """The wide sketch folded to the width of a set's size; null where that is the narrow one."""
    folded, steps, width = F.col("wide"), F.when(F.lit(False), F.col("wide")), WIDE
    while width > SKETCH:
        steps, folded, width = steps.when(_width() == width, folded), _halves(folded), width // 2
    return steps


def _sharply_apart(num: int, den: int) -> Column:
    """Whether the sharp sketches of a pair rule it out; where one has none they do not."""
    a, b = F.col("sharp_a"), F.col("sharp_b")
    like = lambda x, y: F.when(F.size(x) > F.size(y), _halves(x)).otherwise(x)
    apart = F.aggregate(F.zip_with(like(a, b), like(b, a), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda n, k: n + k)
    return F.coalesce(apart * (den + num) > (F.col("size_a") + F.col("size_b")) * (den - num), F.lit(False))


def _across(open_: DataFrame, info: DataFrame, num: int, den: int, seen: DataFrame | None = None) -> DataFrame:
    """All pairs (a, b), a < b, of a signature in different components that nothing rules out, without most of those seen;
    those of the base meet the others only. A pair comes once for each signature."""
    told = open_.select("signature", "doc", "root", (F.col("root") != F.col("base")).alias("out"))
    told = told.join(info.select("doc", "size", *_BITS, _sharp().alias("sharp")), "doc")
    columns = ["signature", "doc", "root", "out", "size", *_BITS, "sharp"]
    # of two members outside of the base the lesser one is on the left
    met = (F.col("signature_a") == F.col("signature_b")) & (F.col("root_a") != F.col("root_b")) & (~F.col("out_b") | (F.col("doc_a") < F.col("doc_b"))) & _could_be(num, den)
    if seen is not None:
        told, columns = told.join(_partners(seen), F.col("doc") == F.col("of"), "left"), [*columns, "partners"]
        for x, y in ("ab", "ba"):
            met &= ~F.coalesce(F.array_contains(f"partners_{x}", F.col(f"doc_{y}")), F.lit(False))
    left, right = (_named(told, x, *columns) for x in "ab")
    met &= ~_sharply_apart(num, den)
    return left.where("out_a").join(right, met).select(F.least("doc_a", "doc_b").alias("a"), F.greatest("doc_a", "doc_b").alias("b"))


def _rooted(df: DataFrame, roots: DataFrame, of: str, to: str) -> DataFrame:
    """Adds the root of a document; one without links is its own."""
    at = roots.select(F.col("v").alias("_v"), F.col("root").alias("_root"))
    return df.join(at, F.col(of) == F.col("_v"), "left").withColumn(to, F.coalesce("_root", of)).drop("_v", "_root")


def _still_open(open_: DataFrame, roots: DataFrame) -> DataFrame:
    """Members of those signatures that have several components now."""
    now = _rooted(_rooted(open_.select("signature", "doc", F.col("base").alias("_base")), roots, "doc", "root"), roots, "_base", "base")
    out = F.max(F.col("root") != F.col("base")).over(Window.partitionBy("signature"))
    return now.withColumn("_out", out).where("_out").select("signature", "doc", "root", "base")


def _passes(open_: DataFrame, documents: int, crowded: bool) -> list[Column]:
    """Parts of the signatures that are looked at one after the other."""
    few, fewer = (F.pmod(F.xxhash64("signature"), F.lit(min(n, 1 << 62))) == 0 for n in (FEW, FEW * FEW))
    sent = open_.agg(F.sum(_width())).first()[0] or 0
    parts = -(-sent // max(PASS_SKETCHES * WIDE * documents, 1))
    of = F.pmod(F.xxhash64("signature", F.lit(1)), F.lit(max(parts, 1)))
    rest = [of == i for i in range(max(parts, 1))]
    return [fewer, few & ~fewer, *[~few & part for part in rest]] if crowded else rest


def _linked_across(
    docs: DataFrame, info: DataFrame, open_: DataFrame, links: DataFrame, roots: DataFrame, tested: DataFrame, crowded: bool, n: int, num: int, den: int
) -> DataFrame:
    """The roots when all similar pairs that share a signature are in one component."""
    documents, seen = info.count(), None
    for part in _passes(open_, documents, crowded):
        made = _across(_still_open(open_.where(part), roots), info, num, den, seen).distinct()
        left, share = kept(made.join(_both_ways(tested), ["a", "b"], "left_anti"), "across"), HUBS
        while many := left.count():
            # more pairs than documents: each document tries a few, and what they join needs no further ones
            order = Window.partitionBy("b").orderBy(F.xxhash64("a", "b"))
            some = left.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= share).select("a", "b")
            new = left if many <= documents else kept(some, "some")
            found = kept(_verified(docs, info, new, n, num, den), "found")
            tested, missed = tested.union(new), new.join(found, ["a", "b"], "left_anti")
            seen = missed if seen is None else seen.union(missed)
            if not found.isEmpty():
                links = kept(links.union(found), "links")
                roots = components(links)
            if new is left:
                break
            apart = _rooted(_rooted(left.join(new, ["a", "b"], "left_anti"), roots, "a", "_x"), roots, "b", "_y").where("_x != _y")
            left, share = kept(apart.select("a", "b"), "across"), share * HUBS
    return roots


def join_components(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, num: int = NUM, den: int = DEN
) -> DataFrame:
    """(id, n_shingles, component_id) of every document; the component is the least id reachable by links."""
    spark = docs.sparkSession
    bounded_batches(spark)
    slim = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    named = slim.where("id IS NOT NULL")
    group = Window.partitionBy("asked")
    rows = (
        named.mapInArrow(_signed(n, num, den), _ROWS)
        .withColumn("_least", F.min("doc").over(group)).withColumn("_times", F.count(F.lit(1)).over(group))
        .where((F.col("kind") != _ASKS) | (F.col("_times") > 1) | F.col("lead").isNotNull())
    )
    large = [fresh_path(spark, "signatures")]  # of tables with a row for each signature of a document
    lead = F.when(F.col("kind") == _ASKS, F.col("_least")).otherwise(F.col("lead"))
    table = kept(rows.select("kind", F.coalesce("signature", "asked").alias("signature"), "doc", lead.alias("lead"), "size", *_BITS, "wide"), "signatures", large[0])
    info = table.where(F.col("kind") == _SELF).groupBy("doc").agg(F.max_by(F.struct("size", *_BITS, "wide"), "size").alias("_i")).select("doc", "_i.*")
    info = kept(info, "sets")
    copies = table.where((F.col("kind") == _SELF) & F.col("lead").isNotNull()).select(F.col("lead").alias("a"), F.col("doc").alias("b"))
    members = table.where(F.col("kind") != _SELF).select("signature", "doc", "lead")
    met = members.where("doc != lead").groupBy("doc", "lead").agg(F.count(F.lit(1)).alias("n"))
    tried = met.groupBy(F.col("doc").alias("b")).agg(F.max_by("lead", F.struct(F.col("n"), -F.col("lead"))).alias("a"))
    tried = kept(tried.select("a", "b"), "tried")
    links = kept(_verified(named, info, tried, n, num, den).union(copies), "links")
    roots = components(links)

    open_, tested, before = members.select("signature", "doc"), tried, None
    while True:
        large.append(fresh_path(spark, "open"))
        open_ = kept(_open_groups(open_, info, roots, links), "open", large[-1])
        rows, pairs = open_.agg(F.count(F.lit(1)), F.sum(F.when(F.col("root") != F.col("base"), F.col("members")))).first()
        if not rows:
            break
        # documents outside of a group's main component are compared with its hub, as long as that links many of them
        # and the groups still make far more pairs than they have rows
        hubs = open_.where("root != base").groupBy(F.col("doc").alias("b"), F.col("hub").alias("a")).agg(F.count(F.lit(1)).alias("n"))
        hubs = hubs.join(_both_ways(tested).select(F.col("a").alias("_a"), F.col("b").alias("_b")), (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")
        hubs = hubs.groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "a")), False), 1, HUBS).alias("_h"))  # one a signature at most
        # a round that joined nothing is not followed by another one
        new = kept(hubs.select(F.explode("_h.a").alias("a"), "b"), "hubs") if pairs > CROWDED * rows and (rows, pairs) != before else None
        before = (rows, pairs)
        found = kept(_verified(named, info, new, n, num, den), "found") if new is not None else None
        last = found is None or found.count() * WORTH <= new.count()  # also where nothing is left to compare
        if found is not None:
            links, tested = kept(links.union(found), "links"), tested.union(new)
            roots = components(links)
        if last:
            roots = _linked_across(named, info, open_, links, roots, tested, pairs > CROWDED * rows, n, num, den)
            break
    released(spark, large)
    told = (
        info.join(roots, info["doc"] == roots["v"], "left")
        .select(F.col("doc").alias(doc_id), F.col("size").alias("n_shingles"), F.coalesce("root", "doc").alias("component_id"))
    )
    none = slim.where("id IS NULL").select(
        F.col("id").alias(doc_id), F.lit(None).cast("bigint").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")
    )
    return told.unionByName(none)


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 3], ' ') AS e
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 3, least(len(ws), 1)))) AS i FROM d)
), n AS (
  SELECT d.doc_id, count(s.e) AS n FROM d LEFT JOIN s ON s.doc_id = d.doc_id GROUP BY d.doc_id
), links AS (
  SELECT x.a, x.b FROM (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON b.e = a.e AND b.doc_id <> a.doc_id GROUP BY a.doc_id, b.doc_id) x
  JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 100 * x.k >= 85 * (p.n + q.n - x.k)
), reached AS (
  SELECT doc_id AS v, doc_id AS r FROM n
  UNION
  SELECT links.b AS v, reached.r FROM reached JOIN links ON links.a = reached.v WHERE reached.r < links.b
)
SELECT n.doc_id, n.n AS n_shingles, min(reached.r) AS component_id FROM n JOIN reached ON reached.v = n.doc_id GROUP BY n.doc_id, n.n
"""
