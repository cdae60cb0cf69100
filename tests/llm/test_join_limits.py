"""The n-gram join at the edges of its bands of sizes, and where hubs link no more."""

import itertools
import random
from pathlib import Path

import numpy as np
import plain
import pytest
from pyspark.sql import functions as F

from muster.llm import jaccard
from muster.llm.tables import kept
from muster.session import work_folder


@pytest.mark.parametrize("num, den", [(85, 100), (4, 5), (3, 5)])
def test_sets_on_both_sides_of_a_band_share_a_signature_when_signed_apart(num, den):
    rng = np.random.default_rng(7)
    for start in jaccard.Bands(6000, num, den).starts[1:].tolist():
        large = np.unique(rng.integers(0, 1 << 50, start + max(start // 200, 0)).astype(np.uint64))
        for size in {start - 1, start - start // 100 - 1}:
            small = np.sort(rng.permutation(large)[:size])
            if size < 1 or den * len(small) < num * len(large):
                continue
            signed = [jaccard.signatures(x, np.array([0, len(x)]), num, den)[1] for x in (small, large)]
            assert np.intersect1d(*signed).size > 0, (num, den, len(small), len(large))


def test_bands_do_not_depend_on_the_largest_set():
    for num, den in ((85, 100), (4, 5), (3, 5)):
        whole = jaccard.Bands(6000, num, den)
        for largest in (1, 2, 4, 7, 100, 906, 1064, 1065, 3000):
            some = jaccard.Bands(largest, num, den)
            assert some.parts.tolist() == whole.parts[: len(some.parts)].tolist()
            assert some.starts.tolist() == whole.starts[: len(some.starts)].tolist()


def test_join_ends_where_the_rest_of_a_family_was_already_compared_with_its_hub(spark, monkeypatch):
    rng = random.Random(2)
    docs = []
    for _ in range(40):
        own = [f"b{i}" for i in range(100)]
        for at in rng.sample(range(100), rng.randint(0, 45)):
            own[at] = f"n{rng.randrange(10**6)}"
        docs.append(" ".join(own))
    docs = list(zip(rng.sample(range(1, 400), 40), docs))
    turns, groups = [], jaccard._open_groups

    def same(*args):  # what the hub found changes nothing for the rest: groups, hubs and pairs stay as they were
        turns.append(turns[0] if turns else groups(*args))
        assert len(turns) <= 3, "the same hubs again and again"
        return turns[0]

    monkeypatch.setattr(jaccard, "CROWDED", 0)
    monkeypatch.setattr(jaccard, "_open_groups", same)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    rows = spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)
    try:
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(rows, n=1, num=60, den=100).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == plain.jaccard_components(docs, 1, 60, 100)
    assert len(turns) == 2


def test_pairs_that_were_seen_are_not_made_under_every_signature(spark):
    open_ = spark.createDataFrame([(s, d, d, 1) for s in range(10) for d in range(1, 7)], "signature bigint, doc bigint, root bigint, base bigint")
    bits = ", ".join(f"{b} bigint" for b in jaccard._BITS)
    info = spark.createDataFrame([(d, 100, *[0] * jaccard.SKETCH, [0]) for d in range(1, 7)], f"doc bigint, size bigint, {bits}, wide array<bigint>")
    pairs = sorted(itertools.combinations(range(1, 7), 2))
    made = sorted((r["a"], r["b"]) for r in jaccard._across(open_, info, 85, 100).collect())
    assert made == sorted(pairs * 10)  # not (a, b) and (b, a)
    seen = spark.createDataFrame([p for p in pairs if p != (2, 5)], "a bigint, b bigint")
    assert {(r["a"], r["b"]) for r in jaccard._across(open_, info, 85, 100, seen).collect()} >= {(2, 5)}
    assert jaccard._across(open_, info, 85, 100, seen).count() <= 10 * 3  # few more where two partners share a place


def test_pairs_are_found_however_few_signatures_are_looked_at_first(spark, monkeypatch):
    rng = random.Random(4)
    own = [f"b{i}" for i in range(60)]
    docs = [(i + 1, " ".join(w if rng.random() > 0.12 else f"n{rng.randrange(10**6)}" for w in own)) for i in range(30)]
    rows = spark.createDataFrame(docs, "doc_id bigint, text string")
    for few, partners in ((1, 1), (1 << 40, 256)):
        monkeypatch.setattr(jaccard, "FEW", few)
        monkeypatch.setattr(jaccard, "PARTNERS", partners)
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(rows, n=1, num=60, den=100).collect()}
        assert got == plain.jaccard_components(docs, 1, 60, 100)


def test_tables_of_signatures_and_files_of_shuffles_do_not_stay(spark):
    folder = Path(work_folder(spark).removeprefix("file:"))
    there = set(folder.iterdir())
    rows = spark.createDataFrame([(i, " ".join(f"w{i // 4}_{k}" for k in range(40))) for i in range(40)], "doc_id bigint, text string").repartition(4)
    found = jaccard.join_components(rows, n=4, num=85, den=100)
    left = [p for p in set(folder.iterdir()) - there if p.name.startswith(("signatures-", "open-"))]
    assert left and all(spark.read.schema("doc bigint").parquet(str(p)).isEmpty() for p in left)
    assert {r["component_id"] for r in found.collect()} == set(range(0, 40, 4))
    files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    before = files.getAllFiles().size()
    kept(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count().repartition(3, "k"), "counts")
    assert files.getAllFiles().size() <= before


def test_large_sets_that_only_a_wide_sketch_tells_apart_make_no_pairs(spark):
    rng = np.random.default_rng(5)
    base = np.unique(rng.integers(0, 1 << 50, 8000).astype(np.uint64))
    first, near, far = base[:3000], np.concatenate((base[:2900], base[6000:6100])), np.concatenate((base[:2250], base[3000:3750]))
    small, unlike = base[:300], np.concatenate((base[:150], base[4000:4150]))
    sets = [np.sort(x) for x in (first, near, far, small, unlike, np.sort(base[:290]))]
    wide = jaccard._sketches(np.concatenate(sets), np.concatenate(([0], np.cumsum([len(x) for x in sets]))))
    narrow = np.bitwise_xor.reduce(wide.reshape(len(wide), -1, jaccard.SKETCH), axis=1).view(np.int64)
    rows = [(i, len(x), *map(int, narrow[i]), [int(v) for v in wide[i].view(np.int64)]) for i, x in enumerate(sets)]
    bits = ", ".join(f"{b} bigint" for b in jaccard._BITS)
    info = spark.createDataFrame(rows, f"doc bigint, size int, {bits}, wide array<bigint>")
    open_ = spark.createDataFrame([(9, i, i, 5) for i in range(len(sets))], "signature bigint, doc bigint, root bigint, base bigint")
    assert sorted(map(tuple, jaccard._across(open_, info, 80, 100).collect())) == [(0, 1), (3, 5)]
