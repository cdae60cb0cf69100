"""Centroid clusters, Merkle manifests and odd-sketch duplicates against plain versions."""

import hashlib
import math
import random
import zlib

import numpy as np
import plain
import pytest
from test_pairs_and_passages import corpus, frame, small_batches  # noqa: F401

from muster.llm import centroids, merkle, oddsketch

VECTORS = "vec_id bigint, embedding array<float>, vec string, cluster string, distance int"


def vectors(seed, n=80, size=6):
    rng = random.Random(seed)
    middles = [[rng.uniform(-1, 1) for _ in range(size)] for _ in range(5)]
    rows = [(i, [float(np.float32(m + rng.gauss(0, 0.2))) for m in rng.choice(middles)]) for i in rng.sample(range(1000), n)]
    rows += [(5000 + i, rows[0][1]) for i in range(30)]  # one very common vector
    return rows + [(2000, None), (2001, []), (2002, [None] * size), (2003, [math.inf] + [0.0] * (size - 1)), (2004, [math.nan] * size), (2005, [1.0] * (size + 1))]


def plain_clusters(rows, k, rounds, size):
    kept = []
    for i, v in rows:
        if v is not None and len(v) == size and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * x) for x in v]))
    points = [v for _, v in sorted(kept, key=lambda r: (hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, p)), c) for c, p in enumerate(points)) for _, v in kept]

    for _ in range(rounds):
        at = assign()
        for c in range(len(points)):
            own = [v for (_, v), (_, x) in zip(kept, at) if x == c]
            if own:
                points[c] = [sum(column) // len(own) for column in zip(*own)]
    at = assign()
    whole = sum(d for d, _ in at)
    return sorted(
        (i, c, d, sum(e for e, x in at if x == c), whole, hashlib.sha256(",".join(map(str, points[c])).encode()).hexdigest())
        for (i, _), (d, c) in zip(kept, at)
    )


@pytest.mark.parametrize("k, pivots", [(7, 3), (200, 8), (1, 1)])
def test_clusters_equal_comparing_all(spark, small_batches, k, pivots):  # noqa: F811
    rows = vectors(k)
    table = spark.createDataFrame([(i, v, "x", "y", 1) for i, v in rows], VECTORS).repartition(3)
    assigned, last = centroids.cluster(table, k=k, pivots=pivots, size=6)
    assert sorted(tuple(r) for r in centroids.told(assigned, last).collect()) == plain_clusters(rows, k, 5, 6)


def test_clusters_of_nothing_and_of_huge_values(spark):
    none = spark.createDataFrame([], VECTORS)
    assert centroids.told(*centroids.cluster(none)).collect() == []
    huge = spark.createDataFrame([(1, [3e38, -3e38], "", "", 0), (None, [0.0, 0.0], "", "", 0), (1, [0.0, 1.0], "", "", 0)], VECTORS)
    got = centroids.told(*centroids.cluster(huge, k=1, rounds=0, size=2)).collect()
    assert len(got) == 3 and max(r["distance"] for r in got) <= 2 * (2**28) ** 2


def test_bounds_leave_out_most_centroids_of_separate_groups():
    rng = np.random.default_rng(3)
    middles = rng.integers(-5000, 5000, (12, 16))
    rows = (middles[rng.integers(0, 12, 3000)] + rng.integers(-60, 60, (3000, 16))).astype(np.int64)
    pivots = centroids.spread_pivots(rows[:60], 8)
    at, far, taken = centroids.nearest(rows, centroids.squared(rows, pivots), middles.astype(np.int64), pivots)
    every = centroids.squared(rows, middles)
    assert (far == every.min(axis=1)).all() and (at == every.argmin(axis=1)).all()
    assert taken < len(rows) * len(middles) / 4


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_manifest(docs):
    """docs are (doc_id, source, lang, n_chars, text)."""

    def own(row, text):
        parts = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (*row[:4], text)]
        return h(*parts)

    def levels(nodes):
        out = [nodes]
        while len(out[-1]) > 1:
            out.append([h(*out[-1][i : i + 8]) for i in range(0, len(out[-1]), 8)])
        return out

    def siblings(tree, at):
        out = []
        for nodes in tree[:-1]:
            first = at // 8 * 8
            out.append((nodes[first:at], nodes[at + 1 : first + 8]))
            at //= 8
        return out

    langs = sorted({d[2] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    trees = []
    for lang in langs:
        rows = sorted((d for d in docs if d[2] == lang), key=lambda d: (d[0] is not None, d[0] or 0, own(d, d[4])))
        trees.append((rows, levels([own(d, d[4]) for d in rows])))
    top = levels([tree[-1][0] for _, tree in trees])
    out = []
    for place, (rows, tree) in enumerate(trees):
        for at, row in enumerate(rows):
            path = siblings(tree, at) + siblings(top, place)
            text = row[4]
            if text is not None and zlib.crc32(str("-" if row[0] is None else row[0]).encode()) % 3 == 0:
                text = text.translate(plain.LOWER)
            now = own(row, text)
            for before, after in path:
                now = h(*before, now, *after)
            proof = h(*[x for before, after in path for x in before + after])
            out.append((row[0], tree[0][at], tree[-1][0], top[-1][0], proof, now, now == top[-1][0]))
    return out


DOCS = "doc_id bigint, source string, lang string, n_chars bigint, text string, tree string, at int, digest string, path string"


def manifest_rows(seed, n):
    rng = random.Random(seed)
    langs = ["en"] * 12 + [None, "", "Zz", "é", "a b"]
    return [(i, rng.choice([None, "web", "ß"]), rng.choice(langs), rng.choice([None, 3]), rng.choice([None, "", "Ab C", "ÄÖ x", f"t{i}"])) for i in rng.sample(range(5 * n), n)]


def proved(spark, docs):
    table = spark.createDataFrame([(*d, "c", 1, "c", "c") for d in docs], DOCS).repartition(3)
    made = merkle.build(merkle.document_leaves(table), "lang", "doc_id", carry=["tampered"])
    return [tuple(r) for r in merkle.proofs(made, "doc_id", "tampered").collect()], made


@pytest.mark.parametrize("n, deep", [(700, 1), (200, 2), (90, 4), (1, 4)])
def test_manifest_equals_a_plain_tree(spark, monkeypatch, n, deep):
    monkeypatch.setattr(merkle, "DEEP", deep)
    docs = manifest_rows(n, n)
    got, made = proved(spark, docs)
    expected = plain_manifest(docs)
    assert sorted(got) == sorted(expected) and made.root() == expected[0][3]
    assert n == 1 or (any(r[-1] for r in got) and not all(r[-1] for r in got))


def test_manifest_of_nothing_and_of_repeated_rows(spark):
    got, made = proved(spark, [])
    assert got == [] and made.root() is None
    docs = [(None, None, None, None, None)] * 3 + [(4, "s", None, 1, "Text")] * 9 + [(4, "s", None, 1, "Other")]
    got, _ = proved(spark, docs)
    assert sorted(map(str, got)) == sorted(map(str, plain_manifest(docs)))


def test_addresses_are_a_permutation_with_near_subtrees():
    for levels in range(1, 6):
        places = [merkle.address(levels, depth, np.arange(8**depth)) for depth in range(levels)]
        assert sorted(np.concatenate(places).tolist()) == list(range(merkle.nodes_of(levels)))
    # five levels are two above 64 bottom trees of three: each lies in one piece
    for tree in (0, 5, 63):
        own = np.concatenate([merkle.address(5, 2 + d, np.arange(8**d) + tree * 8**d) for d in range(3)])
        assert own.max() - own.min() + 1 == len(own) == merkle.nodes_of(3)


@pytest.mark.parametrize("seed, n, num, den", [(11, 5, 85, 100), (12, 2, 85, 100)])
def test_odd_sketches_find_every_component(spark, small_batches, seed, n, num, den):  # noqa: F811
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in oddsketch.near_duplicates(frame(spark, docs), n=n, num=num, den=den).collect()}
    assert got == plain.jaccard_components(docs, n, num, den)


def test_odd_sketches_link_chains_and_families(spark, small_batches):  # noqa: F811
    rng = random.Random(7)
    own, docs = [f"c{i}" for i in range(150)], []
    for i in range(60):
        own[rng.randrange(150)] = f"new{i}"
        docs.append(((i * 37) % 60 + 1, " ".join(own)))
    base = [f"b{i}" for i in range(200)]
    for i in range(80):  # around one text, from equal to too far
        text = list(base)
        for _ in range(i % 9):
            text[rng.randrange(200)] = f"x{i}"
        docs.append((1000 + i, " ".join(text)))
    rows = oddsketch.near_duplicates(frame(spark, docs)).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == plain.jaccard_components(docs, 5, 85, 100)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_odd_sketches_of_nothing_nulls_and_repeated_ids(spark):
    assert oddsketch.near_duplicates(frame(spark, [])).collect() == []
    text, other = " ".join(f"v{i}" for i in range(30)), " ".join(f"o{i}" for i in range(30))
    rows = oddsketch.near_duplicates(frame(spark, [(None, text), (5, text), (5, other), (7, other), (5, text), (3, text), (9, None), (10, " \n")])).collect()
    got = sorted((str(r["doc_id"]), r["n_shingles"], r["component_id"], r["kept"]) for r in rows)
    assert got == sorted([("None", None, None, True), ("3", 26, 3, True), ("5", 26, 3, False), ("5", 26, 3, False), ("5", 26, 5, True), ("7", 26, 5, False), ("9", 0, 9, True), ("10", 0, 10, True)])


def test_sketches_of_pairs_at_the_threshold_stay_under_the_bound(spark):
    from pyspark.sql import functions as F

    rng, rows = np.random.default_rng(4), []
    for _ in range(400):
        both = int(np.exp(rng.uniform(np.log(6), np.log(6000))))
        extra = int(both * 15 / 85)
        x = rng.integers(0, 2**52, both + extra).astype(np.uint64)
        cut = both + int(rng.integers(0, extra + 1))
        a, b = np.sort(x[:cut]), np.sort(np.concatenate((x[:both], x[cut:])))
        words, bins = oddsketch.odd_sketches(np.concatenate((a, b)), np.array([0, len(a), len(a) + len(b)]))
        rows.append((len(a), len(b), int(bins[0]), int(bins[1]), sum(int(w).bit_count() for w in words[0] ^ words[1])))
    bound = oddsketch.most_apart(*[F.col(c) for c in ("a", "b", "ba", "bb")], 85, 100)
    assert spark.createDataFrame(rows, "a int, b int, ba int, bb int, apart int").where(F.col("apart") > bound).count() == 0
