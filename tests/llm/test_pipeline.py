"""The pipeline, stage by stage, against plain versions, and the registered queries."""

import collections
import random

import duckdb
import plain
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from muster.llm.queries import QUERIES, SQL

FOLDER = "/root/testdata/sf0.001"
SYLLABLES = {"en": ["the", "ing", "and", "tion"], "de": ["sch", "ung", "der", "ü"], "fr": ["eau", "que", "é", "ment"]}


def documents(seed=9):
    rng = random.Random(seed)
    word = lambda lang: "".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(2, 6)))
    rows, passage = [], " ".join(word("en") for _ in range(60))
    for i in range(90):
        lang = rng.choice(sorted(SYLLABLES))
        own = [word(lang) for _ in range(rng.randint(20, 80))]
        if i % 9 == 4:
            own[10:10] = passage.split()
        text = " ".join(own)
        if i % 10 == 7:
            text = rows[rng.randrange(len(rows))][1]  # a copy
        if i % 10 == 8:
            text = " ".join(rows[0][1].split()[:-1] + [word("en")])  # nearly the first
        rows.append((i, text, lang, f"s{i % 3}", len(text or "")))
    return rows + [(500, None, "en", "s0", 0), (501, "12 ### 34", "en", None, 9), (502, "", None, "s1", 0)]


def test_each_stage_does_its_work(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    after = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, FOLDER)
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            docs = spark.createDataFrame(docs.collect(), docs.schema)
        after[name] = docs.collect()
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "ngram_jaccard", "substring_dedup", "mixing", "packing"]
    told = {r.doc_id: r for r in after["language_id"]}
    assert set(told) == set(range(90)) and sum(told[i].lang == lang for i, _, lang, *_ in rows[:90]) > 60
    roots = plain.jaccard_components([(r.doc_id, r.text) for r in after["language_id"]], 5, 4, 5)
    assert sorted(r.doc_id for r in after["ngram_jaccard"]) == sorted(i for i, (_, root) in roots.items() if i == root)
    expected = {i: kept for i, n, kept in plain.deduped([(r.doc_id, r.text) for r in after["ngram_jaccard"]]) if kept or not n}
    assert {r.doc_id: plain.words(r.text) for r in after["substring_dedup"]} == expected
    assert all(r.n_chars == len(r.text) for r in after["substring_dedup"])
    sizes, taken = collections.Counter(), collections.Counter()
    for r in after["substring_dedup"]:
        sizes[r.source] += len(plain.words(r.text))
    for r in after["mixing"]:
        taken[r.source] += len(plain.words(r.text))
    assert max(collections.Counter(r.doc_id for r in after["mixing"]).values()) <= 2
    assert abs(sum(taken.values()) - 1.5 * sum(sizes.values())) < 0.02 * sum(sizes.values())
    assert sum(r.n_tokens for r in after["packing"]) == sum(taken.values())


def test_pipeline_of_nothing(spark, tmp_path):
    empty = spark.createDataFrame([], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    empty.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_all_operators_are_registered():
    assert {k.split("_")[0] for k in QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("key", sorted(SQL))
def test_query_equals_its_sql(spark, key):
    con = duckdb.connect()
    for table in check.TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{FOLDER}/{table}.parquet'")
    df = QUERIES[key](spark, FOLDER)
    cursor = con.execute(SQL[key])
    names = [d[0] for d in cursor.description]
    assert check.canonical([tuple(r) for r in df.collect()], df.columns) == check.canonical(cursor.fetchall(), names)


def test_held_out_languages_are_told(spark):
    rows = {r.doc_id: r for r in QUERIES["op10_language_id"](spark, FOLDER).collect()}
    own = [(r.doc_id, r.lang) for r in spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang").collect() if rows[r.doc_id].held_out]
    assert sum(rows[i].lang_pred == lang for i, lang in own) >= 0.95 * len(own) > 0
