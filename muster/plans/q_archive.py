"""Queries of the archive (T, J9, U3, U4, W2, W4), sources and sinks (S) and layout (J10-J14, W3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from muster.operators import archive as arch
from muster.operators import layout, ordering, quality, status, summaries
from muster.plans.q_quality import ORDER_FIELDS
from muster.plans.views import (
    ACCOUNT,
    ROW_ORDER,
    SYNC_START,
    VERIFIED,
    archive,
    blocks_a,
    cand_orders,
    orders,
    points,
    rulings,
    snapshots,
    statuses,
    stored_archive,
    table,
    with_views,
)
from muster.operators.sizing import settled
from muster.registry import query
from muster.session import fresh_path
from muster.sources import media, payload, sinks
from muster.sources import snapshots as snaps
from muster.streaming import incremental

HOUR = 3600


# --- posts and the archive ------------------------------------------------------------------------

def parsed(spark, folder):
    return snaps.parse_posts(snapshots(table(spark, folder, "pages")), ACCOUNT)


def records(posts):
    return arch.posts_to_records(snaps.first_posts(posts), ACCOUNT, F.lit(VERIFIED))


@query("t1_parse_posts", "snapshot_id bigint, position bigint, source_id string, stamp string, text string, images string",
       with_views("posts_v") + """
SELECT page_id AS snapshot_id, position, source_id, stamp, text, image AS images FROM posts_v, (VALUES (0), (1)) AS v(position) WHERE text <> ''""")
def t1(spark, folder):
    return parsed(spark, folder).withColumn("images", F.array_join("images", " "))


@query("w2_first_post", "source_id string, snapshot_id bigint, position bigint",
       with_views("posts_v") + "SELECT source_id, page_id AS snapshot_id, 0 AS position FROM posts_v WHERE text <> ''")
def w2(spark, folder):
    return snaps.first_posts(parsed(spark, folder))


@query("t2_post_records", "id string, source_id string, date date, description string, source_url string, media string",
       with_views("posts_v") + f"""
SELECT 'x-' || source_id AS id, source_id, date, text AS description, 'https://x.com/{ACCOUNT}/status/' || source_id AS source_url,
       'image ' || image AS media FROM posts_v""")
def t2(spark, folder):
    shown = F.array_join(F.transform("media", lambda m: F.concat_ws(" ", m["type"], m["url"])), ",")
    return records(parsed(spark, folder)).withColumn("media", shown)


@query("j9_match_by_media", "source_id string, id string", with_views("matches_v") + """
SELECT source_id, id FROM matches_v WHERE source_id NOT IN (SELECT source_id FROM stored_v WHERE source_id IS NOT NULL)""")
def j9(spark, folder):
    stored = stored_archive(spark, folder)
    fresh = records(parsed(spark, folder)).filter(F.col("date") >= SYNC_START)
    linked = stored.filter(F.col("source_id").isNotNull()).select("source_id")
    return arch.media_claims(fresh.join(linked, "source_id", "left_anti"), stored)


MERGED = "id string, source_id string, date date, title string, description string, verified_at date, media string, change string"
MERGED_SQL = with_views("merged_v") + "SELECT id, source_id, date, coalesce(title, '') AS title, description, verified_at, media, change FROM merged_v"


def shown_archive(df):
    """Media as addresses; titles of new posts are the subject of another query and left out here."""
    kept = F.when(F.col("change") == "added", "").otherwise(F.col("title"))
    return df.withColumn("media", F.array_join(F.transform("media", lambda m: m["url"]), " ")).withColumn("title", kept)


@query("t3_merge_archive", MERGED, MERGED_SQL)
def t3(spark, folder):
    return shown_archive(incremental.sync_once(stored_archive(spark, folder), records(parsed(spark, folder)), SYNC_START))


@query("t3_merge_archive_stream", MERGED.replace(", change string", ""), MERGED_SQL)
def t3_stream(spark, folder):
    stored = stored_archive(spark, folder)
    base = fresh_path(spark, "archive")
    versions = incremental.VersionedTable(spark, f"{base}/table", arch.ARCHIVE_SCHEMA)
    versions.write(stored)
    pages = spark.readStream.schema(table(spark, folder, "pages").schema).parquet(f"{folder}/pages.parq*")
    run = incremental.sync_archive(
        snapshots(pages), versions, lambda batch: records(snaps.parse_posts(batch, ACCOUNT)), SYNC_START, f"{base}/checkpoint"
    )
    run.awaitTermination()
    new = F.when(F.col("id").startswith(arch.ID_PREFIX), "added").otherwise("kept")
    return shown_archive(versions.read().withColumn("change", new))


@query("t5_idempotent_replay", "run bigint, records bigint, added bigint, enriched bigint", with_views("merged_v") + """
SELECT 1 AS run, count(*) AS records, count_if(change = 'added') AS added, count_if(change = 'enriched') AS enriched FROM merged_v
UNION ALL SELECT 2, count(*), 0, 0 FROM merged_v""")
def t5(spark, folder):
    posts = records(parsed(spark, folder))
    first = arch.merge_archive(stored_archive(spark, folder), posts, SYNC_START)
    second = arch.merge_archive(first.drop("change"), posts, SYNC_START)
    both = first.withColumn("run", F.lit(1)).unionByName(second.withColumn("run", F.lit(2)))
    return both.groupBy("run").agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col("change") == "added").alias("added"),
        F.count_if(F.col("change") == "enriched").alias("enriched"),
    )


@query("t6_unusable_snapshot", "outcome string, records bigint",
       with_views("stored_v") + "SELECT 'failed, archive kept' AS outcome, count(*) AS records FROM stored_v")
def t6(spark, folder):
    # pages that ask the reader to sign in: no article, so no posts
    pages = table(spark, folder, "pages").select(
        F.col("page_id").alias("snapshot_id"), F.regexp_replace("html", "(?s)<article>.*</article>", "Sign in").alias("html")
    )
    stored = stored_archive(spark, folder)
    try:
        incremental.sync_once(stored, records(snaps.parse_posts(pages, ACCOUNT)), SYNC_START)
        outcome = "merged"
    except ValueError:
        outcome = "failed, archive kept"
    return stored.agg(F.count(F.lit(1)).alias("records")).withColumn("outcome", F.lit(outcome))


@query("t7_backfill_media", "id string, paths string", with_views("archive_v") + """
SELECT id, array_to_string(list_transform(media, lambda u: CASE WHEN doc_id % 4 < 2 THEN '/activity-media/' || substring(sha256(u), 1, 24) || '.jpg'
       ELSE coalesce(local_path, '-') END), ' ') AS paths FROM archive_v""")
def t7(spark, folder):
    from muster.functions.posts import media_stem

    stored = archive(spark, folder)
    # half of the neighbours have a cached copy by now; the address decides, so records that share one all get it
    addresses = stored.filter(F.col("doc_id") % 4 < 2).select(F.explode("media.url").alias("url")).distinct()
    manifest = addresses.withColumn("path", F.concat(F.lit("/activity-media/"), media_stem(F.col("url")), F.lit(".jpg")))
    filled = arch.backfill_media(stored, manifest)
    return filled.withColumn("paths", F.array_join(F.transform("media", lambda m: F.coalesce(m["localPath"], F.lit("-"))), " "))


@query("u3_append_new", "id string, title string", with_views("archive_v", "stored_v") + """
SELECT id, title FROM stored_v UNION ALL SELECT replace(id, 'd-', 'r-'), title FROM archive_v WHERE replace(id, 'd-', 'r-') NOT IN (SELECT id FROM stored_v)""")
def u3(spark, folder):
    stored = stored_archive(spark, folder).select("id", "title")
    fresh = archive(spark, folder).select(F.replace("id", F.lit("d-"), F.lit("r-")).alias("id"), "title")
    return arch.append_new(stored, fresh)


@query("u4_pending_media", "url string", with_views("archive_v") + """
SELECT DISTINCT unnest(media) AS url FROM archive_v WHERE local_path IS NULL OR doc_id % 10 <> 0""")
def u4(spark, folder):
    # of the paths noted in the archive, only those of every tenth document exist
    stored = archive(spark, folder)
    paths = stored.filter(F.col("doc_id") % 10 == 0).select(F.explode("media.localPath").alias("path"))
    return arch.pending_media(stored, paths.filter(F.col("path").isNotNull()))


# --- status ---------------------------------------------------------------------------------------

STATUS = "user_id bigint, micros bigint, event_id bigint, state string, previous string"
STATUS_SQL = with_views("status_v") + """
SELECT * FROM (SELECT user_id, micros, event_id, state, lag(state) OVER (PARTITION BY user_id ORDER BY micros, event_id) AS previous FROM status_v)
WHERE previous IS DISTINCT FROM state"""
DAY_MICROS = 86_400_000_000


def status_day():
    return F.floor(F.col("micros") / DAY_MICROS)


@query("w4_status_changes", STATUS, STATUS_SQL)
def w4(spark, folder):
    return status.change_points(statuses(spark, folder), ["user_id"], status_day(), ["micros", "event_id"], "state")


@query("t4_status_stream", STATUS, STATUS_SQL)
def t4(spark, folder):
    from muster.plans.views import status_columns

    base = fresh_path(spark, "status")
    events = spark.readStream.schema(table(spark, folder, "events").schema).parquet(f"{folder}/events.parq*")
    last = incremental.VersionedTable(spark, f"{base}/last", "user_id bigint, micros bigint, event_id bigint, state string", ["user_id"])
    run = incremental.track_status(
        status_columns(events), last, f"{base}/log", ["user_id"], status_day(), ["micros", "event_id"], "state", f"{base}/checkpoint"
    )
    run.awaitTermination()
    return incremental.change_log(spark, f"{base}/log", ["user_id"])


# --- sources and sinks ----------------------------------------------------------------------------

@query("s1_read_payload", "owner bigint, document bigint, day_index bigint, period_start bigint, period_end bigint, class_code string, subject string",
       with_views("blocks_a") + f"""
SELECT owner, day_index AS document, day_index, period_start, period_end, class_code, subject FROM blocks_a""")
def s1(spark, folder):
    path = fresh_path(spark, "payload")
    nested = summaries.weekly_lessons(blocks_a(spark, folder), ROW_ORDER)
    documents = nested.select(
        F.lit("timetable").alias("sourceFile"),
        F.array(F.struct("owner", F.col("day_index").alias("document"), "lessons")).alias("teachers"),
    )
    documents.write.json(path)
    lesson = "array<struct<day_index:bigint,period_start:bigint,period_end:bigint,class_code:string,subject:string>>"
    _, found = payload.read_payload(spark, path, "teachers", f"owner bigint, document bigint, lessons {lesson}", "sourceFile string", lines=True)
    return payload.flatten_lessons(found, "owner", "document")


@query("s3_snapshots", "snapshot_id bigint, letters bigint, articles bigint", """
SELECT page_id AS snapshot_id, length(html) AS letters, len(regexp_extract_all(html, '<article')) AS articles FROM pages""")
def s3(spark, folder):
    return table(spark, folder, "pages").select(
        F.col("page_id").alias("snapshot_id"), F.length("html").alias("letters"), F.regexp_count("html", F.lit("<article")).alias("articles")
    )


@query("s4_validate_media", "page_id bigint, extension string, valid boolean", """
SELECT page_id, CASE page_id % 5 WHEN 0 THEN 'jpg' WHEN 1 THEN 'png' WHEN 2 THEN 'webp' END AS extension, page_id % 5 < 3 AS valid FROM pages""")
def s4(spark, folder):
    kind = F.col("page_id") % 5
    head = (
        F.when(kind == 0, F.unhex(F.lit("FFD8FFE0")))
        .when(kind == 1, F.unhex(F.lit("89504E470D0A1A0A")))
        .when(kind == 2, F.unhex(F.lit("524946460000000057454250")))
        .when(kind == 3, F.unhex(F.lit("FFD8FFE0")))
        .otherwise(F.unhex(F.lit("")))
    )
    # kind 3 is a JPEG that claims to be a PNG, kind 4 is empty
    declared = F.when(kind == 0, "image/jpeg").when(kind == 2, "image/webp").otherwise("image/png")
    body = F.when(kind == 4, F.unhex(F.lit(""))).otherwise(F.encode("html", "UTF-8"))
    files = table(spark, folder, "pages").select("page_id", F.concat(head, body).alias("content"), declared.alias("declared"))
    return media.validate_media(files)


@query("s5_write_report", "kind string, value string, n bigint", with_views("blocks_a") + """
SELECT 'grade' AS kind, CAST(grade AS VARCHAR) AS value, count(*) AS n FROM blocks_a GROUP BY grade
UNION ALL SELECT 'subject', subject, count(*) FROM blocks_a GROUP BY subject
UNION ALL SELECT 'class', class_code, count(*) FROM blocks_a GROUP BY class_code""")
def s5(spark, folder):
    path = fresh_path(spark, "report")
    counted = summaries.block_counts(blocks_a(spark, folder))
    # kinds are three and values are a bounded domain, so the report is one small document
    document = counted.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("value", "n"))).alias("counts"))
    sinks.write_report(document, path)
    return spark.read.schema("kind string, counts map<string,bigint>").json(path).select("kind", F.explode("counts").alias("value", "n"))


@query("s6_publish_if_clean", "kind string, published boolean, records bigint, issues bigint", with_views("blocks_a") + """
SELECT 'clean' AS kind, true AS published, count(*) AS records, 0 AS issues FROM blocks_a
UNION ALL SELECT 'overlaps', false, 0, (SELECT count(*) FROM (SELECT owner, day_index, period_start FROM blocks_a GROUP BY ALL HAVING count(*) > 1))""")
def s6(spark, folder):
    blocks = blocks_a(spark, folder)
    rules = {
        "clean": quality.bad_period_range(blocks),
        "overlaps": quality.repeated(blocks, "owner", "day_index", "period_start"),
    }
    rows = None
    for name, issues in rules.items():
        base = fresh_path(spark, f"publish-{name}")
        done = sinks.publish_if_clean(blocks, issues, f"{base}/data", f"{base}/report")
        data = spark.read.parquet(f"{base}/data") if done else blocks.limit(0)
        reported = spark.read.schema(issues.schema).json(f"{base}/report").agg(F.count(F.lit(1)).alias("issues"))
        row = data.agg(F.count(F.lit(1)).alias("records")).select(
            F.lit(name).alias("kind"), F.lit(done).alias("published"), "records", reported.scalar().alias("issues")
        )
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("s7_publish_if_changed", "kind string, published boolean, records bigint", with_views("cand_orders") + """
SELECT 'same' AS kind, false AS published, 0 AS records UNION ALL SELECT 'changed', true, count(*) FROM cand_orders""")
def s7(spark, folder):
    old, new = orders(spark, folder), cand_orders(spark, folder)
    rows = None
    for name, version in {"same": old.repartition(3), "changed": new}.items():
        path = fresh_path(spark, f"version-{name}")
        done = sinks.publish_if_changed(version, old, ["o_orderkey", *ORDER_FIELDS], path)
        data = spark.read.parquet(path) if done else old.limit(0)
        row = data.agg(F.count(F.lit(1)).alias("records")).select(F.lit(name).alias("kind"), F.lit(done).alias("published"), "records")
        rows = row if rows is None else rows.unionByName(row)
    return rows


@query("s8_fingerprint", "doc_id bigint, sha256 string, created_date date", """
SELECT doc_id, sha256(text) AS sha256, CASE WHEN doc_id % 4 <> 0 THEN DATE '2024-01-01' + CAST(doc_id % 30 AS INTEGER) END AS created_date FROM documents""")
def s8(spark, folder):
    key = F.col("doc_id")
    day = F.date_format(F.date_add(F.to_date(F.lit("2024-01-01")), (key % 30).cast("int")), "yyyyMMdd")
    stamp = F.when(key % 4 == 0, "unknown").otherwise(F.concat(F.lit("D:"), day, F.lit("120000Z")))
    files = table(spark, folder, "documents").select("doc_id", F.encode("text", "UTF-8").alias("content"), stamp.alias("stamp"))
    return media.fingerprint(files, stamp="stamp")


# --- layout ---------------------------------------------------------------------------------------

def ruled_cells(spark, folder):
    return layout.cells_from_rulings(rulings(spark, folder), ["page"], "y", 6 * HOUR, "y0", "y1")


def boxes(spark, folder):
    """Two cells side by side in each row of a page."""
    halves = F.array(F.struct(F.lit(0.0).alias("x0"), F.lit(40.0).alias("x1")), F.struct(F.lit(40.0).alias("x0"), F.lit(10000.0).alias("x1")))
    return ruled_cells(spark, folder).withColumn("h", F.explode(halves)).select("page", "y0", "y1", "h.*")


BOXES_SQL = "boxes AS (SELECT page, y0, y1, x0, x1 FROM ruling_cells_v, (VALUES (0.0::DOUBLE, 40.0::DOUBLE), (40.0, 10000.0)) AS v(x0, x1))"


@query("w3_cells_from_rulings", "page string, y0 bigint, y1 bigint", with_views("ruling_cells_v") + "SELECT page, y0, y1 FROM ruling_cells_v")
def w3(spark, folder):
    return ruled_cells(spark, folder)


@query("j10_assign_cells", "event_id bigint, page string, y0 bigint, x0 double", with_views("points_v", "ruling_cells_v") + f""", {BOXES_SQL}
SELECT event_id, p.page, y0, x0 FROM points_v p JOIN boxes b ON b.page = p.page AND y BETWEEN y0 - 1 AND y1 + 1 AND x BETWEEN x0 - 1 AND x1 + 1""")
def j10(spark, folder):
    return layout.assign_cells(points(spark, folder), boxes(spark, folder), "page", HOUR, layout.CELL_TOLERANCE)


@query("j10_assign_cells_strict", "event_id bigint, page string, y0 bigint, x0 double", with_views("points_v", "ruling_cells_v") + f""", {BOXES_SQL}
SELECT event_id, p.page, y0, x0 FROM points_v p JOIN boxes b ON b.page = p.page AND y > y0 AND y < y1 AND x > x0 AND x < x1""")
def j10_strict(spark, folder):
    return layout.assign_cells(points(spark, folder), boxes(spark, folder), "page", HOUR)


_BINS_SQL = ", ".join(f"({n}, {a}::DOUBLE, {b}::DOUBLE)" for n, a, b in layout.PERIOD_BOUNDS)


@query("j11_overlap_bins", "o_orderkey bigint, x0 bigint, x1 bigint, first_bin bigint, last_bin bigint", f"""
SELECT o_orderkey, x0, x1, min(bin) AS first_bin, max(bin) AS last_bin
FROM (SELECT o_orderkey, 60 + o_custkey % 760 AS x0, 60 + o_custkey % 760 + 15 + o_orderkey % 200 AS x1 FROM orders)
LEFT JOIN (VALUES {_BINS_SQL}) AS v(bin, a, b) ON least(x1, b) - greatest(x0, a) > 20 GROUP BY ALL""")
def j11(spark, folder):
    x0 = 60 + F.col("o_custkey") % 760
    shapes = table(spark, folder, "orders").select("o_orderkey", x0.alias("x0"), (x0 + 15 + F.col("o_orderkey") % 200).alias("x1"))
    return layout.overlap_bins(shapes, "x0", "x1")


@query("j12_bounds", "event_id bigint, page string, y bigint, below bigint, above bigint", with_views("points_v", "rulings_v") + """
SELECT event_id, p.page, p.y, (SELECT max(y) FROM rulings_v r WHERE r.page = p.page AND r.y < p.y) AS below,
       (SELECT min(y) FROM rulings_v r WHERE r.page = p.page AND r.y > p.y) AS above FROM points_v p""")
def j12(spark, folder):
    return ordering.bounds(points(spark, folder), rulings(spark, folder), ["page"], "y", 6 * HOUR, "below", "above")


@query("j13_nearest_match", "event_id bigint, page string, y bigint, nearest bigint", with_views("points_v", "rulings_v") + """
SELECT event_id, page, y, nearest FROM (
  SELECT p.event_id, p.page, p.y, arg_min(r.y, (abs(r.y - p.y), r.y)) AS nearest FROM points_v p JOIN rulings_v r ON r.page = p.page GROUP BY ALL)
WHERE abs(nearest - y) < 1800""")
def j13(spark, folder):
    return layout.nearest_match(points(spark, folder), rulings(spark, folder), ["page"], "y", 6 * HOUR, 1800)


@query("j14_unallocated", "event_id bigint, page string, y bigint", with_views("points_v", "ruling_cells_v") + f""", {BOXES_SQL}
SELECT event_id, p.page, y FROM points_v p JOIN (SELECT page, min(y0) AS top, max(y1) AS bottom, min(x0) AS edge FROM boxes GROUP BY page) e ON e.page = p.page
WHERE y > top AND y < bottom AND x > edge AND event_id NOT IN (
  SELECT event_id FROM points_v p JOIN boxes b ON b.page = p.page AND y > y0 AND y < y1 AND x > x0 AND x < x1)""")
def j14(spark, folder):
    words, cells = points(spark, folder), settled(boxes(spark, folder))
    assigned = layout.assign_cells(words, cells, "page", HOUR)
    return layout.unallocated(words, assigned, cells, "page", "event_id")
