"""Substring dedup, the n-gram join, components and search against plain versions on random texts."""

import collections
import math
import random

import plain
import pytest
from pyspark.sql import functions as F

from muster.llm import bm25, jaccard, substring
from muster.llm.components import components

DOCS = "doc_id bigint, text string, id string, doc string, spans int"


def corpus(seed, n=120):
    """Texts with shared passages, runs, periods, near copies, copies, nulls and blanks."""
    rng = random.Random(seed)
    letters = [f"w{i}" for i in range(12)] + [f"rare{i}" for i in range(400)]
    passages = [[rng.choice(letters) for _ in range(rng.randint(8, 60))] for _ in range(6)]
    texts = []
    for i in range(n):
        kind = rng.randrange(9)
        if kind == 0 and texts:
            text = rng.choice(texts)
        elif kind == 1:
            text = " ".join(["ab"] * rng.randint(1, 60) + ["cd"] * rng.randint(0, 20) + ["ab", "cd"] * rng.randint(0, 30))
        elif kind == 2 and texts:
            own = (rng.choice(texts) or "").split()
            for _ in range(rng.randint(0, 4)):
                if own:
                    own[rng.randrange(len(own))] = rng.choice(letters)
            text = rng.choice([" ", "\n", " \t "]).join(own)
        elif kind == 3:
            text = rng.choice([None, "", "  \n", "Äb ÇÇ", "x", "one two THREE", "One two three"])
        else:
            own = []
            for _ in range(rng.randint(1, 4)):
                own += rng.choice(passages)[rng.randint(0, 5) :] if rng.random() < 0.6 else [rng.choice(letters) for _ in range(rng.randint(1, 30))]
            text = " ".join(own)
        texts.append(text)
    ids = rng.sample(range(10 * n), n)
    return list(zip(ids, texts))


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, "clash", "clash", 1) for i, t in docs], DOCS).repartition(parts)


@pytest.fixture
def small_batches(spark):
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    yield
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.mark.parametrize("seed, width", [(1, 13), (2, 5)])
def test_dedup_removes_what_a_smaller_document_has(spark, small_batches, seed, width):
    docs = corpus(seed)
    got = {r["doc_id"]: r for r in substring.dedup(frame(spark, docs), width=width, carry=("id",)).collect()}
    assert len(got) == len(docs)
    for i, n, kept in plain.deduped(docs, width):
        row = got[i]
        assert (row["n_words"], row["n_removed"], row["kept_words"]) == (n, n - len(kept), " ".join(kept))
        assert row["id"] == "clash" and plain.words(row["kept_text"]) == kept


def test_dedup_without_rows_ids_or_texts(spark):
    assert substring.dedup(frame(spark, [])).collect() == []
    text = " ".join(f"v{i}" for i in range(20))
    rows = substring.dedup(frame(spark, [(None, text), (None, text), (5, text), (5, text), (7, text), (8, None)])).collect()
    got = sorted((r["doc_id"] or 0, r["n_removed"], r["kept_text"]) for r in rows if r["doc_id"] != 8)
    assert got == [(0, 0, text), (0, 0, text), (5, 0, text), (5, 0, text), (7, 20, "")]
    assert [(r["n_words"], r["kept_words"], r["kept_text"]) for r in rows if r["doc_id"] == 8] == [(0, "", None)]


@pytest.mark.parametrize("third", ["x y z", " ".join(f"u{i}" for i in range(60))])
def test_rows_of_one_id_lose_their_own_repeats_only(spark, third):
    text = " ".join(f"v{i}" for i in range(60))
    rows = substring.dedup(frame(spark, [(1, text), (2, text), (2, third), (2, "q " + text + " r"), (3, third)])).collect()
    got = sorted((r["doc_id"], r["n_words"], r["n_removed"], r["kept_words"]) for r in rows)
    again = third if len(third) < 13 else ""
    assert got == sorted([(1, 60, 0, text), (2, 60, 60, ""), (2, len(third.split()), 0, third), (2, 62, 60, "q r"), (3, len(third.split()), 0 if again else len(third.split()), again)])


def test_dedup_of_a_very_long_text(spark):
    rng = random.Random(5)
    own = [f"t{rng.randrange(50_000)}" for _ in range(400_000)]
    docs = [(1, " ".join(own)), (2, " ".join(["start"] + own[1000:300_000] + ["end"]))]
    got = {r["doc_id"]: r for r in substring.dedup(frame(spark, docs)).collect()}
    assert got[1]["n_removed"] == 0 and got[2]["n_removed"] == 299_000 and got[2]["kept_words"] == "start end"


@pytest.mark.parametrize("seed, n, num, den", [(3, 4, 85, 100), (4, 1, 60, 100)])
def test_join_finds_every_component(spark, small_batches, seed, n, num, den):
    docs = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(frame(spark, docs), n=n, num=num, den=den).collect()}
    assert got == plain.jaccard_components(docs, n, num, den)


def test_join_links_chains_of_near_copies(spark, small_batches):
    rng = random.Random(6)
    own = [f"c{i}" for i in range(150)]
    docs = []
    for i in range(60):  # neighbours are similar, ends are not; ids in no order
        own[rng.randrange(150)] = f"new{i}"
        docs.append(((i * 37) % 60 + 1, " ".join(own)))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.join_components(frame(spark, docs), n=4, num=85, den=100).collect()}
    assert got == plain.jaccard_components(docs, 4, 85, 100)


def test_join_of_nothing_and_of_null_ids(spark):
    assert jaccard.join_components(frame(spark, [])).collect() == []
    rows = jaccard.join_components(frame(spark, [(None, "a b c d e f"), (3, "a b c d e f"), (4, "a b c d e f"), (9, None)])).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == [(3, 2, 3), (4, 2, 3), (9, 0, 9), (None, None, None)]


def test_signatures_are_shared_by_similar_sets():
    import numpy as np

    rng = np.random.default_rng(2)
    for num, den in ((85, 100), (4, 5), (3, 5)):
        for _ in range(400):
            size = int(rng.integers(1, 300))
            x = rng.choice(10**6, size, replace=False).astype(np.uint64)
            drop, add = int(rng.integers(0, size // 3 + 1)), int(rng.integers(0, size // 3 + 1))
            y = np.unique(np.concatenate((x[drop:], rng.choice(10**6, add, replace=False).astype(np.uint64) + np.uint64(10**7))))
            both = len(np.intersect1d(x, y))
            if den * both < num * (len(x) + len(y) - both):
                continue
            elements = np.concatenate((np.sort(x), y))
            text, name = jaccard.signatures(elements, np.array([0, len(x), len(x) + len(y)]), num, den)
            assert np.intersect1d(name[text == 0], name[text == 1]).size > 0


def test_components_of_a_long_chain(spark):
    links = [(i, i + 1) for i in range(0, 300)] + [(1000, 1001), (1001, 1000), (5000, 5000)]
    got = dict(components(spark.createDataFrame(links, "a bigint, b bigint")).collect())
    assert all(got[i] == 0 for i in range(301)) and got[1001] == 1000 and 5000 not in got
    assert components(spark.createDataFrame([], "a bigint, b bigint")).collect() == []


@pytest.mark.parametrize("shard_bytes, asked, cells", [(1, 300, 100), (1 << 12, 1 << 22, 1 << 20), (1 << 25, 2000, 1 << 20)])
def test_whole_text_search_equals_scoring_every_document(spark, small_batches, monkeypatch, shard_bytes, asked, cells):
    for name, value in (("SHARD_BYTES", shard_bytes), ("ASKED", asked), ("CELLS", cells), ("ADDED", 50)):
        monkeypatch.setattr(bm25, name, value)
    docs = corpus(9) + [(100_001, "w1 " * 3000), (100_020, "w1 rare5 rare6"), (100_025, " ".join(f"rare{i}" for i in range(60))), (100_030, "own W1")]
    rows = frame(spark, docs)
    shards = bm25.build_index(rows)
    df, n, average = bm25.frequencies(shards)
    chosen = [d for d in docs if d[0] % 5 == 0]
    found = bm25.search(shards, bm25.whole_queries(rows.where(F.col("doc_id") % 5 == 0), df, n), average)
    assert sorted((r["query"], r["doc"], r["rank"], r["score"]) for r in found.collect()) == sorted(whole_text(docs, chosen))


def whole_text(docs, queries, k=10):
    """The k best documents by the sum over all words of a query."""
    counts = [(i, collections.Counter(plain.words((t or "").translate(plain.LOWER)))) for i, t in docs]
    average = sum(sum(c.values()) for _, c in counts) / len(counts)
    df = collections.Counter(w for _, c in counts for w in c)
    out = []
    for q, text in queries:
        own = set(plain.words((text or "").translate(plain.LOWER)))
        found = []
        for i, c in counts:
            idf = {w: math.log(1 + (len(counts) - df[w] + 0.5) / (df[w] + 0.5)) for w in own & set(c)}
            parts = [math.floor(1e6 * idf[w] * c[w] * 2.2 / (c[w] + 1.2 * (0.25 + 0.75 * sum(c.values()) / average)) + 0.5) for w in idf]
            found += [(-sum(parts), i)] if parts else []
        out += [(q, i, rank, -score) for rank, (score, i) in enumerate(sorted(found)[:k], 1)]
    return out


def test_documents_whose_impacts_round_to_nothing_are_found():
    import numpy as np

    rows = bm25._shard_rows(0, np.array([9, 4, 6]), np.array([1, 1, 1]), np.array([0, 1, 2]), np.array([5, 5, 8], np.uint64))
    best = bm25._Best(1, 2)
    bm25._rank_shard(rows, (np.array([0, 1]), np.array([0]), np.array([5], np.uint64), np.array([1e-9])), 1.0, best)
    assert best.scores.tolist() == [[0, 0]] and best.ids.tolist() == [[4, 9]]


def test_blocks_that_cannot_reach_the_best_are_not_scored():
    import numpy as np

    rng = np.random.default_rng(1)
    for skewed in (False, True):
        n, terms, some, k = 40 * bm25.BLOCK - 5, 12, 9, 7
        table = rng.integers(0, 30, (terms, n)).astype(float)
        rare = rng.integers(0, 40, (some, n)).astype(float)
        if skewed:  # few documents have the telling terms
            rare *= 50 * (rng.random((some, n)) < 0.02)
        holds = rng.integers(0, 2, (some, terms)).astype(float)
        full = rare + holds @ table
        starts = np.arange(0, n, bm25.BLOCK)
        reach = np.maximum.reduceat(rare, starts, axis=1) + holds @ np.maximum.reduceat(table, starts, axis=1)
        ids, best = rng.permutation(n), bm25._Best(some, k)
        visited = bm25._visit_blocks(0, reach, rare.copy(), holds, table, ids, best)
        assert visited < some * len(starts) * (0.6 if skewed else 1.01)
        for q in range(some):
            order = np.lexsort((ids, -full[q]))[:k]
            assert best.ids[q].tolist() == ids[order].tolist() and best.scores[q].tolist() == full[q][order].tolist()


def test_search_of_nothing(spark):
    rows = frame(spark, [])
    index = bm25.build_index(rows)
    df, n, average = bm25.frequencies(index)
    assert (n, average) == (0, 0.0)
    assert bm25.search(index, bm25.whole_queries(rows, df, n), average).collect() == []
