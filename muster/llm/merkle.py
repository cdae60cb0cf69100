"""A Merkle manifest of a dataset: digest trees of arity 8, stored as blocks in van Emde Boas layout.

1. Every row becomes a leaf digest (SQL functions). ``numbered`` gives the leaves of each tree their places in order: a
   sort by ranges, a count per range and tree, and an offset for each, so a tree with most of the rows spreads over
   all tasks.
2. ``DEEP`` levels above the leaves make one block: an aligned subtree of up to 8 ** DEEP leaves, built by one group of that
   size and stored as one array of digests. Inside, a tree of L levels is split at half its height; its top comes
   first, then its bottom trees in order, each laid out the same way. ``address`` computes where a node lies, so a
   path through a block touches few cache lines whatever their size, and construction and the look-up of siblings
   share that arithmetic. The roots of the blocks are the leaves of the next tier, until a tree is one block.
3. The roots of the trees are the leaves of one more tree, built the same way.
4. Downwards, each block gets the siblings on the path from its root to the root of all, once; a leaf's proof is the
   siblings inside its block followed by those.

Memory: a task holds a block of 8 ** DEEP leaves with its nodes. Nothing but block roots moves up a tier.

Defined results: a null column enters a leaf as ``-``, an empty text as ``0:``. Leaves ascend by id, null ids first; rows with one
id ascend by leaf digest. A null tree key is a tree of its own, before the others. A row's other columns do not matter.
A table without rows gives none.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from muster.llm.tables import bounded_batches, kept

ARITY_BITS = 3
ARITY = 1 << ARITY_BITS
#: Levels of a block above its leaves.
DEEP = 4


def field(value: Column) -> Column:
    """A column as it enters a leaf: ``-`` for null, else its length in bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(*columns: Column) -> Column:
    """The digest of the given columns as 32 bytes."""
    return F.unhex(F.sha2(F.concat(*[field(c) for c in columns]), 256))


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# ---- layout


def nodes_of(levels: int) -> int:
    """Nodes of a whole tree of so many levels."""
    return (ARITY**levels - 1) // (ARITY - 1)


def address(levels: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Place of the nodes with the given indexes at a depth (the root's is 0) of a tree of so many levels."""
    at = np.zeros(len(index), dtype=np.int64)
    index = index.astype(np.int64)
    while levels > 1:
        top = levels // 2
        if depth < top:
            levels = top
            continue
        bottom = levels - top
        below = ARITY_BITS * (depth - top)
        at += nodes_of(top) + (index >> below) * nodes_of(bottom)
        index, depth, levels = index & ((1 << below) - 1), depth - top, bottom
    return at


def joined(digests: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(d.hex().encode() for d in digests)).digest()


def lay_out(leaves: list[bytes], levels: int) -> np.ndarray:
    """Digests of a tree with the given leaves at its lowest level, in van Emde Boas layout; places of absent nodes stay 0."""
    counts = [len(leaves)]
    while len(counts) < levels:
        counts.append(-(-counts[-1] // ARITY))
    last = max(int(address(levels, levels - 1 - up, np.array([n - 1]))[0]) for up, n in enumerate(counts))
    cells = np.zeros((last + 1, 32), dtype=np.uint8)
    now = leaves
    for up in range(levels):
        if up:
            now = [joined(now[i : i + ARITY]) for i in range(0, len(now), ARITY)]
        places = address(levels, levels - 1 - up, np.arange(len(now)))
        cells[places] = np.frombuffer(b"".join(now), dtype=np.uint8).reshape(-1, 32)
    return cells


def levels_for(n: int) -> int:
    """Levels of the tree of n leaves that is a block of its own."""
    levels = 1
    while n > 1:
        n, levels = -(-n // ARITY), levels + 1
    return levels


class Block:
    """One stored block: runs of siblings by address, for leaves 0 to n - 1."""

    def __init__(self, cells: bytes, n: int, levels: int):
        self.cells, self.levels, self.counts = np.frombuffer(cells, dtype=np.uint8).reshape(-1, 32), levels, [n]
        while len(self.counts) < levels:
            self.counts.append(-(-self.counts[-1] // ARITY))
        self.runs: dict[tuple[int, int], list[bytes]] = {}

    def run(self, up: int, first: int) -> list[bytes]:
        """The nodes of a run, so many levels above the leaves."""
        if (up, first) not in self.runs:
            places = address(self.levels, self.levels - 1 - up, np.arange(first, min(first + ARITY, self.counts[up])))
            self.runs[up, first] = [self.cells[p].tobytes() for p in places]
        return self.runs[up, first]

    def path(self, at: int) -> list[tuple[bytes, bytes]]:
        """Siblings before and after the leaf and each of its ancestors below the block's root."""
        out = []
        for up in range(self.levels - 1):
            node = at >> (ARITY_BITS * up)
            first = node & ~(ARITY - 1)
            run = self.run(up, first)
            out.append((b"".join(run[: node - first]), b"".join(run[node - first + 1 :])))
        return out


def proof_digest(path: list[tuple[bytes, bytes]]) -> str:
    return hashlib.sha256(b"".join((before + after).hex().encode() for before, after in path)).hexdigest()


def folded(digest: bytes, path: list[tuple[bytes, bytes]]) -> bytes:
    """The root that a leaf digest and its siblings give."""
    for before, after in path:
        digest = hashlib.sha256((before + digest + after).hex().encode()).digest()
    return digest


# ---- places


def numbered(df: DataFrame, tree: str, order: list[str], name: str) -> DataFrame:
    """Adds the place of each row in its tree (a bigint from 0). The table is kept once, sorted by ranges."""
    sorted_ = df.repartitionByRange(F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])
    sorted_ = sorted_.sortWithinPartitions(F.col(tree).asc_nulls_first(), *[F.col(c).asc_nulls_first() for c in order])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # rows of one part come in order, so the place within (part, tree) is a running count
        now, seen = object(), 0
        for batch in batches:
            keys = batch.column(batch.schema.get_field_index(tree)).to_pylist()
            places = np.empty(len(keys), dtype=np.int64)
            for i, key in enumerate(keys):
                now, seen = (now, seen + 1) if key == now else (key, 0)
                places[i] = seen
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(places)], names=[*batch.schema.names, "_in"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in sorted_.schema.fields)
    placed = kept(sorted_.withColumn("_part", F.spark_partition_id()).mapInArrow(count, f"{fields}, _part int, _in bigint"), "placed")
    counts = placed.groupBy("_part", tree).agg(F.count(F.lit(1)).alias("_n"))  # at most parts + trees rows
    before = Window.partitionBy(tree).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("_part").alias("_p"), F.col(tree).alias("_t"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_t"))
    return placed.join(offsets, same).select(*df.columns, (F.col("_before") + F.col("_in")).alias(name))


# ---- construction

_BLOCK = "tree string, block bigint, n int, levels int, root binary, cells binary"


def _build(more: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    extra = [c.split()[0] for c in more.split(", ")] if more else []

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i].as_py() for name in ("tree", "block", "whole", "leaves", *extra)}
                levels = DEEP + 1 if row["whole"] else levels_for(len(row["leaves"]))
                cells = lay_out(row["leaves"], levels)
                made = [row["tree"], row["block"], len(row["leaves"]), levels, cells[address(levels, 0, np.array([0]))[0]].tobytes(), cells.tobytes()]
                made += [row[c] for c in extra]
                kinds = [pa.string(), pa.int64(), pa.int32(), pa.int32(), pa.binary(), pa.binary(), *[batch.schema.field(c).type for c in extra]]
                names = [*[c.split()[0] for c in _BLOCK.split(", ")], *extra]
                yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(made, kinds)], names=names)

    return build


def _tier(leaves: DataFrame, carried: list[str]) -> DataFrame:
    """Blocks of the leaves (tree, at, digest, total), with the carried columns as arrays in the order of the leaves."""
    kinds = dict(leaves.select(*carried).dtypes)
    wide = F.shiftright("at", ARITY_BITS * DEEP)
    rows = F.sort_array(F.collect_list(F.struct("at", "digest", *carried)))  # 8 ** DEEP at most
    grouped = leaves.groupBy("tree", wide.alias("block"), (F.col("total") > ARITY**DEEP).alias("whole")).agg(rows.alias("_r"))
    arrays = grouped.select("tree", "block", "whole", F.col("_r.digest").alias("leaves"), *[F.col(f"_r.{c}").alias(c) for c in carried])
    more = ", ".join(f"{c} array<{kinds[c]}>" for c in carried)
    return kept(arrays.mapInArrow(_build(more), _BLOCK + (", " + more if more else "")), "blocks")


def _with_totals(leaves: DataFrame) -> DataFrame:
    """The leaves with the number of leaves of their tree."""
    totals = leaves.groupBy(F.col("tree").alias("_t")).agg(F.count(F.lit(1)).alias("total"))
    return leaves.join(totals, F.col("tree").eqNullSafe(F.col("_t"))).drop("_t")


def _tiers(leaves: DataFrame, carried: list[str]) -> list[DataFrame]:
    """The blocks of all tiers of the trees; every tree of the last one is a single block."""
    tiers = [_tier(_with_totals(leaves), carried)]
    while not (more := tiers[-1].where("block > 0")).isEmpty():
        trees = more.select(F.col("tree").alias("_t")).distinct()
        above = tiers[-1].join(trees, F.col("tree").eqNullSafe(F.col("_t")), "left_semi")
        tiers.append(_tier(_with_totals(above.select("tree", F.col("block").alias("at"), F.col("root").alias("digest"))), []))
    return tiers


@dataclass(frozen=True)
class Manifest:
    """Blocks of each tier of the trees, blocks of each tier of the tree over their roots, and the trees (tree, place, subroot)."""

    tiers: list[DataFrame]
    top: list[DataFrame]
    trees: DataFrame

    def root(self) -> str | None:
        """The root of all, in hexadecimal digits; none without rows."""
        row = self.top[-1].select("root").first()
        return row["root"].hex() if row else None


def build(leaves: DataFrame, tree: str, key: str, digest: str = "digest", carry: list[str] | None = None) -> Manifest:
    """The manifest of leaves with the given columns; ``carry`` columns are kept with the leaves."""
    bounded_batches(leaves.sparkSession)
    carried = [key, *(carry or [])]
    slim = leaves.select(F.col(tree).alias("tree"), F.col(digest).alias("digest"), *carried)
    tiers = _tiers(numbered(slim, "tree", [key, "digest", *(carry or [])], "at"), carried)
    # a tree ends where it is one block: its tier is the first in which it has no block but block 0
    subroots = None
    for blocks in tiers:
        single = blocks.groupBy("tree").agg(F.max("block").alias("_m"), F.min_by("root", "block").alias("subroot")).where("_m = 0").select("tree", "subroot")
        if subroots is not None:
            single = single.join(subroots.select(F.col("tree").alias("_t")), F.col("tree").eqNullSafe(F.col("_t")), "left_anti")
        subroots = single if subroots is None else subroots.unionAll(single)
    placed = numbered(subroots.withColumn("_all", F.lit("")), "_all", ["tree"], "place").select("tree", "place", "subroot")
    placed = kept(placed, "trees")
    top = _tiers(placed.select(F.lit("").alias("tree"), F.col("place").alias("at"), F.col("subroot").alias("digest")), [])
    return Manifest(tiers, top, placed)


# ---- proofs

_PATH = "array<struct<before:binary,after:binary>>"


def _to_path(value: list | None) -> list[tuple[bytes, bytes]]:
    return [(p["before"], p["after"]) for p in value or []]


def _down(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Paths of the leaves of blocks of a width, continued by the path of their block."""
    kind = pa.list_(pa.struct([("before", pa.binary()), ("after", pa.binary())]))

    def down(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, above = Block(row["cells"], row["n"], row["levels"]), _to_path(row["path"])
                for first in range(0, row["n"], 512):
                    some = range(first, min(first + 512, row["n"]))
                    paths = [[{"before": b, "after": a} for b, a in block.path(at) + above] for at in some]
                    at = row["block"] * width + np.array(some, dtype=np.int64)
                    trees = pa.array([row["tree"]] * len(some), pa.string())
                    yield pa.RecordBatch.from_arrays([trees, pa.array(at), pa.array(paths, kind)], names=["tree", "at", "path"])

    return down


def _paths(tiers: list[DataFrame], ends: DataFrame) -> DataFrame:
    """The lowest tier's blocks, each with the path of its root; ``ends`` gives (tree, path) for the trees' roots."""
    ends = ends.select(F.col("tree").alias("_tree"), F.col("path").alias("_end"))
    given = None
    for blocks in reversed(tiers):
        # a block's root is a leaf of the tier above, where its tree has one; else it is its tree's root
        if given is None:
            blocks = blocks.withColumn("_up", F.lit(None).cast(_PATH))
        else:
            above = given.select(F.col("tree").alias("_t"), F.col("at").alias("_at"), F.col("path").alias("_up"))
            blocks = blocks.join(above, F.col("tree").eqNullSafe(F.col("_t")) & (F.col("block") == F.col("_at")), "left").drop("_t", "_at")
        with_path = blocks.join(ends, F.col("tree").eqNullSafe(F.col("_tree")), "left").withColumn("path", F.coalesce("_up", "_end")).drop("_up", "_end", "_tree")
        given = with_path.select("tree", "block", "n", "levels", "cells", "path").mapInArrow(_down(ARITY**DEEP), f"tree string, at bigint, path {_PATH}")
        lowest = with_path
    return lowest


def proofs(manifest: Manifest, key: str, suspect: str) -> DataFrame:
    """(key, leaf, subroot, root, proof_sha256, folded_root, verified) of every leaf. ``suspect`` is a carried column with the digest to
    fold instead of the leaf's own, where it is not null."""
    spark = manifest.trees.sparkSession
    none = spark.createDataFrame([("", [])], f"tree string, path {_PATH}")
    top = _paths(manifest.top, none).select("tree", "block", "n", "levels", "cells", "path").mapInArrow(_down(ARITY**DEEP), f"tree string, at bigint, path {_PATH}")
    ends = manifest.trees.join(top.select("at", "path"), F.col("place") == F.col("at")).select("tree", "path", "subroot")
    blocks = _paths(manifest.tiers, ends).join(manifest.trees.select(F.col("tree").alias("_t"), "subroot"), F.col("tree").eqNullSafe(F.col("_t")))
    root = manifest.root()
    kind = dict(manifest.tiers[0].dtypes)[key][6:-1]

    def prove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                block, above = Block(row["cells"], row["n"], row["levels"]), _to_path(row["path"])
                out: list[list] = [[] for _ in range(4)]
                for at in range(row["n"]):
                    path = block.path(at) + above
                    own = block.run(0, at & ~(ARITY - 1))[at & (ARITY - 1)]
                    asked = row["suspect"][at]
                    end = folded(own if asked is None else asked, path).hex()
                    for column, value in zip(out, (own.hex(), proof_digest(path), end, end == root)):
                        column.append(value)
                n = row["n"]
                ids = batch.column(0)[i].values
                columns = [ids, pa.array(out[0]), pa.array([row["subroot"].hex()] * n), pa.array([root] * n), *[pa.array(c) for c in out[1:]]]
                yield pa.RecordBatch.from_arrays(columns, names=[key, "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])

    schema = f"{key} {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"
    return blocks.select(key, F.col(suspect).alias("suspect"), "n", "levels", "cells", "path", "subroot").mapInArrow(prove, schema)


def document_leaves(docs: DataFrame) -> DataFrame:
    """(doc_id, lang, digest, tampered) of documents; tampered is the digest with a lower-cased text, for every id whose checksum 3 divides."""
    whole = [F.col("doc_id").cast("bigint"), F.col("source"), F.col("lang"), F.col("n_chars").cast("bigint")]
    chosen = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")).cast("binary")) % 3 == 0
    return docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), F.col("lang"), leaf(*whole, F.col("text")).alias("digest"),
        F.when(chosen, leaf(*whole, lower_ascii(F.col("text")))).alias("tampered"),
    )


_LEVELS = 8  # of the SQL: 8 ** 8 leaves a tree
_BYTES = "list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
_CRC = f"xor(list_reduce({_BYTES}, lambda c, b: list_reduce(range(0, 8), lambda k, i: xor(k >> 1, (k & 1) * 3988292384), xor(c, b)), 4294967295), 4294967295)"


def _leaf_sql(text: str) -> str:
    parts = [f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen(CAST({c} AS VARCHAR)) || ':' || {c} END" for c in ("doc_id", "source", "lang", "n_chars", text)]
    return f"sha256({' || '.join(parts)})"


def _tree_sql(name: str) -> str:
    """Levels ``name``0, ``name``1, ... of trees g with nodes i and digests h; c counts the nodes of a level."""
    return ", ".join(
        f"""{name}{k + 1} AS MATERIALIZED (
  SELECT g, i, h, count(*) OVER (PARTITION BY g) AS c FROM (
    SELECT g, i // 8 AS i, CASE WHEN min(c) = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY i)) END AS h FROM {name}{k} GROUP BY g, i // 8))"""
        for k in range(_LEVELS)
    )


def _fold_sql(name: str, tree: str, first: str) -> str:
    steps = [f"{name}0 AS MATERIALIZED ({first})"]
    for k in range(_LEVELS):
        steps.append(f"""{name}{k + 1} AS MATERIALIZED (
  SELECT d.doc_id, d.g, d.i // 8 AS i, d.p || coalesce(string_agg(r.h, '' ORDER BY r.i) FILTER (r.i <> d.i), '') AS p,
    CASE WHEN min(r.c) = 1 THEN d.f ELSE sha256(string_agg(CASE WHEN r.i = d.i THEN d.f ELSE r.h END, '' ORDER BY r.i)) END AS f
  FROM {name}{k} d JOIN {tree}{k} r ON r.g = d.g AND r.i // 8 = d.i // 8 GROUP BY d.doc_id, d.g, d.i, d.p, d.f)""")
    return ", ".join(steps)


SQL = f"""
WITH d AS MATERIALIZED (
  SELECT doc_id, dense_rank() OVER (ORDER BY lang NULLS FIRST) - 1 AS g, {_leaf_sql("text")} AS leaf,
    CASE WHEN {_CRC} % 3 = 0 THEN {_leaf_sql("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} ELSE {_leaf_sql("text")} END AS told
  FROM documents
), n AS MATERIALIZED (
  SELECT doc_id, g, leaf, told, row_number() OVER (PARTITION BY g ORDER BY doc_id) - 1 AS i, count(*) OVER (PARTITION BY g) AS c FROM d
), l0 AS (SELECT g, i, leaf AS h, c FROM n), {_tree_sql("l")},
t0 AS MATERIALIZED (SELECT 0 AS g, g AS i, h, count(*) OVER () AS c FROM l{_LEVELS}), {_tree_sql("t")},
{_fold_sql("f", "l", "SELECT doc_id, g, i, '' AS p, told AS f FROM n")},
{_fold_sql("u", "t", f"SELECT doc_id, 0 AS g, g AS i, p, f FROM f{_LEVELS}")}
SELECT n.doc_id, n.leaf, s.h AS subroot, r.h AS root, sha256(u.p) AS proof_sha256, u.f AS folded_root, u.f = r.h AS verified
FROM n JOIN u{_LEVELS} u ON u.doc_id = n.doc_id JOIN l{_LEVELS} s ON s.g = n.g JOIN t{_LEVELS} r ON true
"""
