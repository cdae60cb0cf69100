"""Near duplicates by MinHash bands, with odd sketches for the candidates and whole sets for the links.

1. Every text becomes its set of word n-grams: a 128-bit name of the set, ``BANDS`` band keys of ``DEPTH`` minima each, and an
   odd sketch. Its sample has the least element of each of ``BINS`` bins (one hash, so a sample costs one pass); every
   sampled pair of bin and element flips one of ``64 * WORDS`` bits. The exclusive or of two sketches is the sketch of
   the samples' symmetric difference, and the number of its bits tells how large that is; a small set is its own
   sample, so the estimate is nearly exact there. ``most_apart`` is the number of bits that a pair at the threshold
   stays under but for fewer than one in a million.
2. Texts with one set are one class and link with each other; only classes go on.
3. Classes that share a band key are candidates. Each is first compared with one other, the least of the class it
   shares most keys with; so a group of n gives n - 1 pairs. Components are built of what links.
4. While keys hold classes of several components and such a comparison links many, those outside of a key's main
   component are compared with its most linked class, up to ``HUBS`` such classes a round. At last all classes that share a key across components meet,
   each pair at the first key they share, and only if sizes and odd sketches leave it possible.
5. All candidates are confirmed on their whole sets (``pairs.confirmed``).

A pair at the threshold of 0.85 shares no key once in 10**8, at higher similarities more rarely. No candidates are capped.

Defined results: a null or empty text, or one without words, has no elements and links with nothing. With fewer words
than n the whole sequence is one element. Rows with the same id are judged one by one by their texts. A row with a null
id links with nothing and has a null component; it is kept. Elements are compared by 52 bits of hash within two sets,
sets of one class by 128 bits. Columns other than id and text are not read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from muster.llm import flat
from muster.llm.components import components
from muster.llm.flat import mixed
from muster.llm.jaccard import shingle_sets
from muster.llm.pairs import confirmed
from muster.llm.tables import bounded_batches, kept
from muster.operators.sizing import sent_out

SHINGLE, NUM, DEN = 5, 85, 100
BANDS, DEPTH = 32, 5
#: Bins of a sample, and 64-bit words of its sketch.
BINS, WORDS = 2048, 32
#: Standard deviations that a candidate's sample may be off.
SURE = 4
#: Hubs that a class is compared with in a round.
HUBS = 3
#: Another round with hubs pays while one in so many of its comparisons links.
WORTH = 25
_ROWS = 1 << 12
_SEED = np.uint64(0xD6E8FEB86659FD93)


def set_names(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over the elements of each set."""
    size, out = np.diff(offsets).astype(np.uint64), []
    for seed in (np.uint64(1), _SEED):
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mixed(elements * seed + seed), dtype=np.uint64)))
        out.append(mixed(total[offsets[1:]] - total[offsets[:-1]] + size))
    return out[0], out[1]


def band_keys(elements: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Keys of the bands of each set, one row a set; all sets have elements."""
    starts, out = offsets[:-1], np.empty((len(offsets) - 1, BANDS), dtype=np.uint64)
    for band in range(BANDS):
        key = np.full(len(starts), band + 1, dtype=np.uint64)
        for step in range(DEPTH):
            salt = mixed(np.array([band * DEPTH + step + 1], dtype=np.uint64) * _SEED)[0]
            x = (elements ^ salt) * (salt | np.uint64(1))
            x ^= x >> np.uint64(32)
            x *= _SEED
            key = mixed(key * np.uint64(31) ^ np.minimum.reduceat(x, starts))
        out[:, band] = key
    return out


def odd_sketches(elements: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sketch of each set's sample, as rows of 64-bit words, and the number of bins that the sample fills."""
    rows = len(offsets) - 1
    mix = mixed(elements + _SEED)
    cell = np.repeat(np.arange(rows), np.diff(offsets)) * BINS + (mix % np.uint64(BINS)).astype(np.int64)
    order = np.lexsort((mix, cell))
    cell, mix = cell[order], mix[order]
    least = np.ones(len(cell), dtype=bool)
    least[1:] = cell[1:] != cell[:-1]
    cell, mix = cell[least], mix[least]
    bit = mixed(mix ^ (mix >> np.uint64(17))) % np.uint64(64 * WORDS)
    out = np.zeros(rows * WORDS, dtype=np.uint64)
    np.bitwise_xor.at(out, cell // BINS * WORDS + (bit // np.uint64(64)).astype(np.int64), np.uint64(1) << (bit % np.uint64(64)))
    return out.reshape(rows, WORDS), np.bincount(cell // BINS, minlength=rows)


def most_apart(a: Column, b: Column, bins_a: Column, bins_b: Column, num: int, den: int) -> Column:
    """How many bits the sketches of two sets of these sizes and filled bins may differ in at a similarity of num / den.

    At the threshold s the union has (a + b) / (1 + s) elements; it fills more or fewer bins than expected as its parts do. In s
    of these both samples hold the same element. Their number deviates as in drawing u of the union's elements without putting back. m differing entries set
    (1 - exp(-2m / bits)) / 2 of the bits, as several may fall on one bit, with a deviation of its own.
    """
    s, bits = num / den, 64 * WORDS
    union = (a + b) / (1 + s)
    expected = [BINS * (1 - F.exp(-x / BINS)) for x in (a, b, union)]
    filled = expected[2] * (bins_a + bins_b) / (expected[0] + expected[1])
    apart = F.greatest(bins_a + bins_b - 2 * s * filled, F.lit(1.0))
    drawn = 4 * s * (1 - s) * filled * F.greatest(1 - filled / union, F.lit(0.0))
    slope = F.exp(-2 * apart / bits)
    fallen = F.greatest(bits / 4 * (1 - slope * slope) - apart * slope * slope, F.lit(0.0))
    return bits / 2 * (1 - slope) + SURE * F.sqrt(slope * slope * drawn + fallen) + 3


_BITS = [f"s{i}" for i in range(WORDS)]
_SETS = "doc bigint, size bigint, h1 bigint, h2 bigint, bins int, " + ", ".join(f"{b} bigint" for b in _BITS) + ", bands array<bigint>"


def _signed(n: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, part in flat.slices(batch.column(1), rows=_ROWS):
                elements, offsets = shingle_sets(part, n)
                size = np.diff(offsets)
                some = np.flatnonzero(size)
                edges = np.concatenate(([0], np.cumsum(size[some])))
                h1, h2 = set_names(elements, offsets)
                bands, (words, bins) = np.zeros((len(size), BANDS), np.uint64), odd_sketches(elements, offsets)
                if len(some):
                    bands[some] = band_keys(elements, edges)
                ends = pa.array(np.arange(len(size) + 1, dtype=np.int32) * BANDS)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(row, len(part)), pa.array(size), pa.array(h1.view(np.int64)), pa.array(h2.view(np.int64)),
                        pa.array(bins.astype(np.int32)), *[pa.array(w) for w in np.ascontiguousarray(words.T).view(np.int64)],
                        pa.ListArray.from_arrays(ends, pa.array(bands.reshape(-1).view(np.int64)), mask=pa.array(size == 0)),
                    ],
                    names=[c.split()[0] for c in _SETS.split(", ")],
                )
            flat.give_back()

    return make


def _set_named(n: int) -> Callable[..., Column]:
    @F.arrow_udf("binary")
    def set_named(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.Array:
        """The set of each text as bytes, where it has the given name; else null."""
        out, asked = [], [x.to_numpy(zero_copy_only=False) for x in (first, second)]
        for row, part in flat.slices(texts, rows=_ROWS):
            elements, offsets = shingle_sets(part, n)
            told = [x.view(np.int64) == y[row : row + len(part)] for x, y in zip(set_names(elements, offsets), asked)]
            out.extend(elements[a:b].tobytes() if same else None for a, b, same in zip(offsets[:-1], offsets[1:], told[0] & told[1]))
        flat.give_back()
        return pa.array(out, pa.binary())

    return set_named


def _sets_of(docs: DataFrame, classes: DataFrame, n: int) -> Callable[[DataFrame], DataFrame]:
    """The sets of the asked classes, made from the texts of their least documents; an id may stand for several texts."""

    def sets_of(asked: DataFrame) -> DataFrame:
        wanted = asked.join(classes.select("node", "doc", "h1", "h2"), "node")
        met = docs.join(sent_out(kept(wanted, "wanted")), docs["id"] == F.col("doc"))
        return met.select("node", "n", _set_named(n)(F.col("text"), F.col("h1"), F.col("h2")).alias("set")).where("set IS NOT NULL")

    return sets_of


def _possible(num: int, den: int) -> Column:
    """Sizes and sketches of (…_a, …_b) leave a similarity of num / den possible."""
    a, b = F.col("size_a"), F.col("size_b")
    apart = sum((F.bit_count(F.col(f"{w}_a").bitwiseXOR(F.col(f"{w}_b"))) for w in _BITS), F.lit(0))
    return (a * num <= b * den) & (b * num <= a * den) & (apart <= most_apart(a, b, F.col("bins_a"), F.col("bins_b"), num, den))


def _side(df: DataFrame, side: str) -> DataFrame:
    return df.select(*[F.col(c).alias(f"{c}_{side}") for c in df.columns])


def _checked(pairs: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs that sizes and sketches leave possible."""
    info = classes.select("node", "size", "bins", *_BITS)
    left, right = _side(info, "a"), _side(info, "b")
    return pairs.join(left, F.col("a") == F.col("node_a")).join(right, (F.col("b") == F.col("node_b")) & _possible(num, den)).select("a", "b")


def _open_keys(members: DataFrame, classes: DataFrame, roots: DataFrame, links: DataFrame) -> DataFrame:
    """Members (key, node) of the keys that hold several components: with the root of each, the component that most of the
    key's members are in (base), and the class of it that most links end at (hub)."""
    ends = links.select(F.col("a").alias("end")).unionAll(links.select("b")).groupBy("end").agg(F.count(F.lit(1)).alias("degree"))
    of = classes.select(F.col("node").alias("of")).join(roots, F.col("of") == F.col("v"), "left").join(ends, F.col("of") == F.col("end"), "left")
    of = of.select("of", F.coalesce("root", "of").alias("root"), F.coalesce("degree", F.lit(0)).alias("degree"))
    at = members.select("key", "node").join(of, F.col("node") == F.col("of")).select("key", "node", "root", "degree")
    groups = (
        at.groupBy("key", "root").agg(F.count(F.lit(1)).alias("n"), F.max_by("node", F.struct("degree", "node")).alias("hub"))
        .groupBy("key").agg(F.max_by(F.struct("root", "hub"), F.struct("n", "root")).alias("base"), F.count(F.lit(1)).alias("roots"))
        .where("roots > 1").select(F.col("key").alias("of_key"), F.col("base.root").alias("base"), "base.hub")
    )
    return at.join(groups, F.col("key") == F.col("of_key")).select("key", "node", "root", "base", "hub")


def _across(open_: DataFrame, classes: DataFrame, num: int, den: int) -> DataFrame:
    """All possible pairs of classes that share a key but no component, each at the first key that it shares."""
    told = open_.select("key", "node", "root", "base").join(classes.select("node", "size", "bins", *_BITS, "bands"), "node")
    left, right = _side(told.where("root != base"), "a"), _side(told, "b")
    once = (F.col("root_b") == F.col("base_b")) | (F.col("node_a") < F.col("node_b"))  # two outside of the base would meet twice
    shared = F.filter(F.zip_with("bands_a", "bands_b", lambda x, y: F.when(x == y, x)), lambda x: x.isNotNull())
    met = (F.col("key_a") == F.col("key_b")) & (F.col("root_a") != F.col("root_b")) & once & _possible(num, den) & (F.get(shared, F.lit(0)) == F.col("key_a"))
    return left.join(right, met).select(F.col("node_a").alias("a"), F.col("node_b").alias("b"))


def _new(pairs: DataFrame, tried: DataFrame) -> DataFrame:
    both = tried.select(F.least("a", "b").alias("_a"), F.greatest("a", "b").alias("_b"))
    return pairs.join(both, (F.least("a", "b") == F.col("_a")) & (F.greatest("a", "b") == F.col("_b")), "left_anti")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n: int = SHINGLE, num: int = NUM, den: int = DEN) -> DataFrame:
    """(id, n_shingles, component_id, kept) of every row; the component is the least id reachable by links, and kept is
    whether the row has that id."""
    bounded_batches(docs.sparkSession)
    slim = docs.select(F.col(doc_id).cast("bigint").alias("id"), F.col(text).alias("text"))
    sets = kept(slim.mapInArrow(_signed(n), _SETS), "sets")
    some = sets.where("size > 0 AND doc IS NOT NULL")
    classes = some.groupBy("h1", "h2").agg(F.min_by(F.struct("doc", "size", "bins", *_BITS, "bands"), "doc").alias("_c"))
    classes = kept(classes.select(F.monotonically_increasing_id().alias("node"), "h1", "h2", "_c.*"), "classes")
    sets_of = _sets_of(slim, classes, n)

    keys = classes.select("node", F.explode("bands").alias("key"))
    leads = keys.groupBy("key").agg(F.min("node").alias("lead"), F.count(F.lit(1)).alias("_n")).where("_n > 1").drop("_n")
    members = kept(keys.join(leads.withColumnRenamed("key", "_key"), F.col("key") == F.col("_key")).select("key", "node", "lead"), "members")
    met = members.where("node != lead").groupBy("node", "lead").agg(F.count(F.lit(1)).alias("n"))
    tried = met.groupBy(F.col("node").alias("b")).agg(F.max_by("lead", F.struct("n", -F.col("lead"))).alias("a"))
    tried = kept(tried.select("a", "b"), "tried")
    links = kept(confirmed(_checked(tried, classes, num, den), sets_of, num, den), "links")
    roots, open_, last = components(links), members, False
    while not last:
        open_ = kept(_open_keys(open_, classes, roots, links), "open")
        hubs = open_.where("root != base").groupBy(F.col("node").alias("b"), F.col("hub").alias("a")).agg(F.count(F.lit(1)).alias("n"))
        nearest = _new(hubs, tried).groupBy("b").agg(F.slice(F.sort_array(F.collect_list(F.struct("n", "a")), False), 1, HUBS).alias("_a"))  # one a key at most
        new = kept(nearest.select(F.explode("_a.a").alias("a"), "b"), "hubs")
        found = kept(confirmed(_checked(new, classes, num, den), sets_of, num, den), "found")
        last = found.count() * WORTH <= new.count()  # also where nothing is left to compare
        links, tried = kept(links.union(found), "links"), kept(tried.union(new), "tried")
        roots = components(links)
    open_ = kept(_open_keys(open_, classes, roots, links), "open")
    found = kept(confirmed(_new(_across(open_, classes, num, den), tried), sets_of, num, den), "found")
    if not found.isEmpty():
        roots = components(kept(links.union(found), "links"))

    named = classes.select("h1", "h2", "doc", "node").join(roots, F.col("node") == F.col("v"), "left").withColumn("root", F.coalesce("root", "node"))
    least = named.groupBy("root").agg(F.min("doc").alias("component_id"))
    named = named.join(least.withColumnRenamed("root", "_root"), F.col("root") == F.col("_root")).select(F.col("h1").alias("_h1"), F.col("h2").alias("_h2"), "component_id")
    told = some.select("doc", "size", "h1", "h2").join(named, (F.col("h1") == F.col("_h1")) & (F.col("h2") == F.col("_h2"))).select("doc", "size", "component_id")
    alone = sets.where("size = 0 OR doc IS NULL").select("doc", "size", F.col("doc").alias("component_id"))
    return told.unionAll(alone).select(
        F.col("doc").alias(doc_id), F.when(F.col("doc").isNotNull(), F.col("size")).alias("n_shingles"), "component_id",
        F.coalesce(F.col("doc") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


SQL = """
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents
), s AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i:i + 4], ' ') AS e
  FROM (SELECT doc_id, ws, unnest(generate_series(1, greatest(len(ws) - 4, least(len(ws), 1)))) AS i FROM d)
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
SELECT n.doc_id, n.n AS n_shingles, min(reached.r) AS component_id, n.doc_id = min(reached.r) AS kept
FROM n JOIN reached ON reached.v = n.doc_id GROUP BY n.doc_id, n.n
"""
