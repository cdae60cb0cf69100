"""Ranges that differ, text filters of a table of queries, files and whole reports against plain versions."""

import collections
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from muster.operators import archive, postings, ranges, reconcile
from muster.sources import cells, media

ROWS = "k long, a string, b long"


def told(df):
    return {tuple(r) for r in df.collect()}


@pytest.mark.parametrize("width", [1, 4, 64])
def test_differing_ranges_and_their_rows(spark, width):
    rng = random.Random(width)
    left = [(k, rng.choice("abc"), rng.choice([None, 1, 2])) for k in rng.sample(range(-200, 200), 180)]
    right = [(k, a if k % 31 else "z", b) for k, a, b in left if k % 37] + [(k, "new", 0) for k in (500, -500)]
    source, candidate = spark.createDataFrame(left, ROWS), spark.createDataFrame(right, ROWS)
    found = ranges.differing_ranges(source, candidate, "k", ["k", "a", "b"], width, fan=4, levels=3).collect()
    for level in range(3):
        w = width * 4**level
        held = [{}, {}]
        for side, rows in zip(held, (left, right)):
            for row in rows:
                side.setdefault(row[0] // w * w, set()).add(row)
        want = {s for s in set(held[0]) | set(held[1]) if held[0].get(s) != held[1].get(s)}
        mine = {r["first"]: r for r in found if r["level"] == level}
        assert set(mine) == want
        assert all(r["last"] == s + w - 1 and r["source_records"] == len(held[0].get(s, ())) and r["candidate_records"] == len(held[1].get(s, ())) for s, r in mine.items())
    assert told(ranges.diff_in_ranges(source, candidate, "k", ["a", "b"], width)) == told(reconcile.diff_records(source, candidate, "k", ["a", "b"]))


def test_ranges_of_equal_empty_and_keyless_tables(spark):
    some = spark.createDataFrame([(1, "a", 1), (1, "a", 1), (None, "b", 2)], ROWS)
    none = some.limit(0)
    assert ranges.differing_ranges(some, some, "k", ["a", "b"]).isEmpty() and ranges.differing_ranges(none, none, "k", ["a", "b"]).isEmpty()
    one = ranges.differing_ranges(some, none, "k", ["a", "b"], width=8, levels=1).collect()
    assert {(r["first"], r["last"], r["source_records"], r["candidate_records"]) for r in one} == {(0, 7, 2, 0), (None, None, 1, 0)}
    again = some.union(some.filter("a = 'b'"))  # a row more often is a difference
    assert {r["first"] for r in ranges.differing_ranges(some, again, "k", ["a", "b"], width=8, levels=1).collect()} == {None}


def test_filters_of_a_table_of_queries(spark):
    rng = random.Random(5)
    letters = "abcسلم"
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(1, 6)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 12)))) for i in range(120)] + [(120, None), (121, ""), (7, "abc سلم"), (122, "ab" * 3000)]
    queries = [(i, " ".join(word()[:3] for _ in range(rng.randint(1, 3)))) for i in range(60)]
    queries += [(100, ""), (101, None), (102, "  "), (103, "zzzz"), (104, "abc  abc"), (104, "م"), (105, "ab" * 2000)]
    found = postings.text_filter_many(
        spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), F.col("text")
    ).collect()
    want = sorted((q, i) for q, query in queries for i, text in texts if not (query or "").split() or text is not None and all(w in text for w in query.split()))
    assert sorted(map(tuple, found)) == want
    plan = postings.text_filter_many(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(queries, "query_id long, query string"), F.col("text"))
    plan = plan._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_scan_of_media_files(spark, tmp_path):
    files = {
        "a.jpg": b"\xff\xd8\xff\xe0body", "b.PNG": b"\x89PNG\r\n\x1a\nbody", "c.webp": b"RIFF\x00\x01\x02\x03WEBPx", "d.png": b"\xff\xd8\xff\xe0",
        "e.jpg": b"", "f.jpg": b"\xff\xd8\xff" + bytes(media.MAX_BYTES), "g.gif": b"GIF89a", "h.jpg": b"\xff\xd8\xff" + bytes(media.MAX_BYTES - 3),
        "صورة 1+2%20.jpg": b"\xff\xd8\xff", "فارغ 1+2%20.png": b"",
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    df = media.scan_media(spark, str(tmp_path))
    rows = {r["path"].rsplit("/", 1)[1]: r for r in df.collect()}
    assert set(rows) == set(files) and all(rows[n]["length"] == len(body) for n, body in files.items())
    assert {n: r["reason"] for n, r in rows.items() if not r["valid"]} == {"d.png": "type", "e.jpg": "empty", "f.jpg": "too large", "g.gif": "type", "فارغ 1+2%20.png": "empty"}
    assert {n for n, r in rows.items() if r["sha256"] is None} == {"e.jpg", "f.jpg", "فارغ 1+2%20.png"}
    assert rows["h.jpg"]["sha256"] == hashlib.sha256(files["h.jpg"]).hexdigest()
    assert "LessThanOrEqual(length," in df._jdf.queryExecution().executedPlan().toString()  # the bound reaches the scan


def test_oversize_files_are_not_opened(spark, tmp_path):
    (tmp_path / "big.jpg").write_bytes(bytes(5000))
    before = spark.conf.get("spark.sql.sources.binaryFile.maxLength")
    spark.conf.set("spark.sql.sources.binaryFile.maxLength", "100")  # reading a longer file is an error then
    try:
        assert [r["reason"] for r in media.scan_media(spark, str(tmp_path), max_bytes=100).collect()] == ["too large"]
    finally:
        spark.conf.set("spark.sql.sources.binaryFile.maxLength", before)


def test_rows_of_an_import_report(spark):
    sheet = [(1.0, "مصباح"), (2.0, "  "), (3.0, "نافذة  كبيرة")]
    rows = [("سادس 4", i, 0, n, None) for i, (n, _) in enumerate(sheet)] + [("سادس 4", i, 1, None, s) for i, (_, s) in enumerate(sheet)]
    df = spark.createDataFrame(rows, "sheet string, row long, col int, num double, str string")
    counts = {"sheets": 1, "records": 2, "groups": 1, "skipped_blank": 1, "formatting_issues": 1}
    want = {("count", name, None, None, None, n) for name, n in counts.items()}
    want |= {("grade", None, 6, None, None, 2), ("class", None, 6, 4, None, 2), ("issue", "سادس 4", None, None, 3, None)}
    assert told(cells.import_report_rows(df, "2026")) == want
    empty = told(cells.import_report_rows(df.limit(0), "2026"))
    assert empty == {("count", name, None, None, None, 0) for name in counts}


def test_metadata_of_a_merged_archive(spark):
    rows = [("a", "2024-01-02", "added"), ("b", "2024-01-02", "enriched"), ("c", "2024-01-01", "unchanged"), ("d", None, "unchanged")]
    merged = spark.createDataFrame(rows, "id string, date string, change string").withColumn("date", F.to_date("date"))
    got = archive.archive_metadata(merged).head()
    assert (got.records, got.added, got.enriched, str(got.range_end), got.coverage, got.first_id, got.last_id) == (4, 1, 1, "2024-01-02", "partial", "b", "c")
    none = archive.archive_metadata(merged.limit(0)).head()
    assert (none.records, none.range_end, none.first_id) == (0, None, None)


def test_many_small_files_are_scanned_by_few_tasks(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"{k}.jpg").write_bytes(b"\xff\xd8\xff" + b"x" * k if k % 20 else b"")
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        for n in names:
            spark.conf.set(n, "4194304b")
        found = media.scan_media(spark, str(tmp_path), max_bytes=50)
        assert found.rdd.getNumPartitions() <= 3 * 8
        assert collections.Counter(r["reason"] for r in found.collect()) == {None: 45, "too large": 12, "empty": 3}
    finally:
        for n, value in before.items():
            spark.conf.set(n, value)
