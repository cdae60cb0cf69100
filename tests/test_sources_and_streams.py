import hashlib
import json
import random

import pytest

from pyspark.sql import functions as F

from muster.operators import quality, status
from muster.sources import cells, media, payload, sinks
from muster.streaming import incremental


def test_payload(spark, tmp_path):
    lesson = {"day": "يوم", "dayIndex": 0, "periodStart": 1, "periodEnd": 2, "subject": "فن", "classCode": "5/1", "grade": 5, "section": 1}
    document = {
        "sourceFile": "a", "periodTimes": {"1": "8:00 - 8:45"},
        "teachers": [{"id": "o-1", "fullName": "مصباح نافذة", "grades": [5], "lessons": [lesson]}, {"id": "o-2", "lessons": []}],
    }
    path = tmp_path / "payload.json"
    path.write_text(json.dumps(document, ensure_ascii=False, indent=2), encoding="utf-8")
    meta, owners = payload.read_payload(spark, str(path), "teachers", payload.OWNER, "sourceFile string, periodTimes map<string,string>")
    assert meta.head().periodTimes == {"1": "8:00 - 8:45"}
    assert [r.id for r in owners.orderBy("id").collect()] == ["o-1", "o-2"]
    (row,) = payload.flatten_lessons(owners, "id").collect()
    assert row.classCode == "5/1" and row.periodEnd == 2


def test_media_files(spark, tmp_path):
    files = {
        "a.jpg": b"\xff\xd8\xff\xe0body", "b.png": b"\x89PNG\r\n\x1a\nbody", "c.webp": b"RIFF\x00\x01\x02\x03WEBPx", "d.png": b"\xff\xd8\xff\xe0",
        "e.jpg": b"", "f.jpg": b"\xff\xd8\xff" + bytes(media.MAX_BYTES),
    }
    for name, body in files.items():
        (tmp_path / name).write_bytes(body)
    kinds = {"jpg": "image/jpeg", "png": "image/png", "webp": "image/webp"}
    name = F.regexp_extract("path", "([^/]+)$", 1)
    kind = F.create_map(*[F.lit(x) for p in kinds.items() for x in p])[F.regexp_extract("path", r"\.(\w+)$", 1)]
    df = media.fingerprint(media.validate_media(media.read_binary(spark, str(tmp_path)).withColumn("declared", kind)))
    rows = {r.name: r for r in df.select(name.alias("name"), "valid", "sha256").collect()}
    assert {n for n, r in rows.items() if r.valid} == {"a.jpg", "b.png", "c.webp"}
    assert all(r.sha256 == hashlib.sha256(files[n]).hexdigest() for n, r in rows.items())


def test_guarded_publishing(spark, tmp_path):
    data = spark.range(5).select("id", (F.col("id") % 2).alias("half"))
    issues = quality.repeated(data, "half")
    assert not sinks.publish_if_clean(data, issues, str(tmp_path / "d1"), str(tmp_path / "r1"))
    assert not (tmp_path / "d1").exists() and spark.read.json(str(tmp_path / "r1")).count() == 2
    assert sinks.publish_if_clean(data, quality.repeated(data, "id"), str(tmp_path / "d2"), str(tmp_path / "r2"))
    assert spark.read.parquet(str(tmp_path / "d2")).count() == 5
    assert not sinks.publish_if_changed(data.orderBy(F.desc("id")), data, ["id", "half"], str(tmp_path / "d3"))
    assert sinks.publish_if_changed(data.filter("id > 0"), data, ["id", "half"], str(tmp_path / "d4"))


def test_roster_cells(spark):
    sheet = [(1.0, "مصباح"), (None, "العنوان"), (2.0, "  "), (2.5, "نص"), (2.0, "نافذة  كبيرة"), (4.0, "باب")]
    rows = [("سادس 4", i, 0, n, None) for i, (n, _) in enumerate(sheet)] + [("سادس 4", i, 1, None, s) for i, (_, s) in enumerate(sheet)]
    df = spark.createDataFrame(rows, "sheet string, row long, col int, num double, str string")
    roster = cells.roster_from_cells(df, "2026").orderBy("source_row").collect()
    assert [(r.id, r.source_row) for r in roster] == [("2026-6-4-1", 1), ("2026-6-4-2", 5), ("2026-6-4-4", 6)]
    report = cells.import_report(df).head()
    assert (report.sheets, report.records, report.groups, report.skipped_blank, report.formatting_issues) == (1, 3, 1, 1, 1)
    named = cells.sheet_rows(df).filter(~cells.is_blank())
    (bad,) = quality.sequence_breaks(named, "sheet", "row", "number").collect()
    assert (bad.number, bad.expected) == (4, 3)


@pytest.mark.parametrize("late", [False, True])
def test_status_stream_equals_batch(spark, tmp_path, monkeypatch, late):
    monkeypatch.setattr(incremental, "COMPACT", 2)
    rng = random.Random(17)
    rows = [(rng.choice([1, 1, 1, 2, 3]), i, rng.choice(["success", "failure"])) for i in range(400)]
    if late:
        rows = rows[160:240] + rows[:80] + rows[320:] + rows[240:320] + rows[80:160]
    schema = "user long, at long, state string"
    source, part = str(tmp_path / "source"), 80
    last = incremental.VersionedTable(spark, str(tmp_path / "last"), schema, ["user"])
    day = F.floor(F.col("at") / 50)
    for start in range(0, 400, part):
        spark.createDataFrame(rows[start:start + part], schema).coalesce(1).write.mode("append").parquet(source)
        run = incremental.track_status(
            spark.readStream.schema(schema).parquet(source), last, str(tmp_path / "log"), ["user"], day, ["at"], "state", str(tmp_path / "checkpoint")
        )
        run.awaitTermination()
    streamed = {tuple(r) for r in incremental.change_log(spark, str(tmp_path / "log"), ["user"]).select("user", "at", "state", "previous").collect()}
    batch = status.change_points(spark.createDataFrame(rows, schema), ["user"], day, ["at"], "state")
    assert streamed == {tuple(r) for r in batch.select("user", "at", "state", "previous").collect()}


def test_a_batch_that_runs_again_after_a_compaction_finds_the_table_before_it(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(incremental, "COMPACT", 3)
    table = incremental.VersionedTable(spark, str(tmp_path / "t"), "id long, v long")
    for version in range(14):
        table.write(spark.createDataFrame([(version % 5, version), (100 + version, version)], "id long, v long"), version)
        before = {r.id: r.v for r in table.read(before=version).collect()}  # what the batch reads if it is run again
        want = {}
        for v in range(version):
            want |= {v % 5: v, 100 + v: v}
        assert before == want
    assert len(list((tmp_path / "t").iterdir())) < 14


def test_files_are_written_by_all_tasks(spark, tmp_path):
    from pyspark.sql import functions as F

    from muster.plans.q_sources import _files

    rows = spark.createDataFrame([(i % 20, "x") for i in range(40)], "id long, html string").coalesce(1)
    _files(rows, str(tmp_path / "files"), F.col("id"), F.col("html"))
    written = [p for p in (tmp_path / "files").rglob("part-*")]
    assert len(written) == 20 and {p.read_text() for p in written} == {"x\nx\n"}
    assert len({p.name.split("-")[1] for p in written}) > 1  # the numbers of the tasks
