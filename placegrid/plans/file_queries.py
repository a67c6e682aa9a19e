"""Round trips through the stored file shapes, below the cluster's shared folder."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid import schemas as S
from placegrid.operators import batches as B
from placegrid.operators import grid as G
from placegrid.operators import keys as K
from placegrid.operators import leads as L
from placegrid.operators import media as M
from placegrid.operators import state as W
from placegrid.operators.monitor import latest_heartbeat
from placegrid.plans import batch_queries, grid_queries, key_queries, lead_queries, media_queries, state_queries
from placegrid.plans.registry import query
from placegrid.plans.views import LINE_ORDER
from placegrid.session import scratch_path, stored
from placegrid.sources import readers as R
from placegrid.sources import writers as O

DOCUMENT_FILE_BYTES = 8 << 20  # a file of several documents is read whole by one task


def _path(t, name: str) -> str:
    return scratch_path(t.spark, name)


def _arrays(documents, path: str) -> None:
    """The JSON documents `value` of a `part` as one file over several lines: an array of them."""
    arrays = documents.groupBy("part").agg(
        F.concat(F.lit("[\n"), F.array_join(F.collect_list("value"), ",\n"), F.lit("\n]")).alias("value"))
    arrays.repartition("part").write.partitionBy("part").text(path)


def _documents(rows, path: str) -> None:
    """Rows as a few files that hold one JSON document each, over several lines: an array of records."""
    part = F.pmod(F.xxhash64("run_id"), F.lit(16)).alias("part")
    _arrays(rows.select(part, F.to_json(F.struct("*")).alias("value")), path)


@query("A1 B1", "SELECT DISTINCT place_id FROM v_discovered WHERE place_id <> ''")
def known_ids_file(t):
    path = _path(t, "known")
    rows = t.discovered.select(F.concat(F.lit(" "), "place_id", F.lit("  ")).alias("place_id"), "cell_id")
    O.write_locked_csv(rows, ["place_id", "cell_id"], path)
    return R.read_known_ids(t.spark, path)


@query("A2 B1", """
SELECT cell_id, query, status, '' AS last_attempted_at, place_count, 'said "no",' || chr(10) || 'twice' AS error_msg FROM v_state_cells""")
def state_file(t):
    path = _path(t, "state")
    rows = t.state_cells.withColumn("error_msg", F.lit('said "no",\ntwice'))
    O.write_locked_csv(rows, S.STATE_COLUMNS["cells"], path)
    return R.read_state(t.spark, path, "cells").drop(R.SEQ)


@query("A2", """
SELECT place_id, cell_id, query, CASE WHEN place_id LIKE 'ChIJ%' THEN 'ChIJ' ELSE 'places_api' END AS form FROM v_discovered""")
def discovered_file(t):
    path = _path(t, "discovered")
    form = F.when(F.col("place_id").startswith("ChIJ"), "ChIJ").otherwise("places_api")
    O.write_locked_csv(t.discovered.withColumn("form", form), S.DISCOVERED_COLUMNS, path)
    return R.read_discovered(t.spark, path).select("place_id", "cell_id", "query", "form")


@query("A3 B2", lead_queries._profile_sql("rich"))
def listings_file(t):
    path = _path(t, "listings") + ".gz"
    O.write_full_gz(t.listings, path)
    return R.read_listings(t.spark, path, _path(t, "lean")).drop(R.SEQ)


@query("A4", "SELECT run_id, started_at, city_name, CAST(n_queries AS BIGINT) AS asked FROM v_runs")
def run_config_files(t):
    path = _path(t, "runs")
    rows = t.runs.withColumn("queries", F.array_repeat(F.lit("cafe"), F.col("n_queries").cast("int")))
    _documents(rows.select("run_id", "started_at", "city_name", "queries"), path)
    configs = R.read_run_configs(t.spark, f"{path}/*/*")
    return configs.select("run_id", "started_at", "city_name", F.size("queries").cast("bigint").alias("asked"))


@query("A5 A6", """
SELECT run_id, discovered, scraped, elapsed_s FROM v_live QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1""")
def heartbeat_file(t):
    path = _path(t, "beats")
    rows = t.live.withColumns({"event": F.lit("heartbeat"), "ts": F.timestamp_seconds("seq")})
    rows.drop("seq").write.json(path)
    beats = R.read_heartbeats(t.spark, path).drop(R.SEQ)
    return latest_heartbeat(beats, ["ts"]).select("run_id", "discovered", "scraped", "elapsed_s")


@query("A6", "SELECT run_id, discovered, CAST(1 AS BIGINT) AS workers FROM v_live")
def live_state_file(t):
    path = _path(t, "live")
    worker = F.struct(F.lit("p1-0").alias("id"), F.lit(1).alias("phase"), F.lit("busy").alias("state"))
    _documents(t.live.withColumn("workers", F.array(worker)).drop("seq"), path)
    rows = R.read_live_state(t.spark, f"{path}/*/*")
    return rows.select("run_id", "discovered", F.size("workers").cast("bigint").alias("workers"))


@query("A8 B6", f"""WITH {grid_queries._CELLS}
SELECT boundary_id || printf('_%04d', cell_idx) AS cell_id, CAST(5 AS BIGINT) AS points FROM numbered""")
def grid_file(t):
    path = _path(t, "grid")
    O.write_features(G.cell_features(grid_queries._grid(t)), path)
    rows = R.read_grid_lines(t.spark, path)
    return rows.select("cell_id", F.size(F.col("geometry.coordinates")[0]).cast("bigint").alias("points"))


@query("A8 B6", f"""WITH {grid_queries._CELLS}
SELECT boundary_id || printf('_%04d', cell_idx) AS cell_id, CAST(5 AS BIGINT) AS points FROM numbered""")
def grid_document(t):
    """The same grid as one feature collection per boundary; small ones share a file, as the driver lists all files."""
    path = _path(t, "grid")
    features = G.cell_features(grid_queries._grid(t)).withColumn("b", F.regexp_extract("cell_id", r"^(.*)_[0-9]+$", 1))
    whole = F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(F.collect_list("value"), ","), F.lit("]}"))
    collections = stored(features.groupBy("b").agg(whole.alias("value")), "collections")
    size = collections.agg(F.sum(F.octet_length("value"))).scalar()
    files = F.greatest(F.lit(1), F.ceil(size / DOCUMENT_FILE_BYTES))
    _arrays(collections.select(F.pmod(F.xxhash64("b"), files).alias("part"), "value"), path)
    rows = R.read_grid(t.spark, f"{path}/*/*")
    return rows.select("cell_id", F.size(F.col("geometry.coordinates")[0]).cast("bigint").alias("points"))


@query("A7 B6", f"""WITH {grid_queries._POINTS}
SELECT boundary_id, count(DISTINCT ring) AS rings, count(*) + count(DISTINCT ring) AS points, round(min(lat), 6) AS south, round(max(lng), 6) AS east
FROM points GROUP BY ALL""")
def boundary_file(t):
    path = _path(t, "boundary")
    O.write_features(G.boundary_features(grid_queries.boundaries(t)), path)
    lines = t.spark.read.text(path)
    rows = R.boundary_rings(lines.withColumn("boundary_id", F.get_json_object("value", "$.properties.boundary_id")))
    points = F.flatten("rings")
    return rows.select(
        "boundary_id", F.size("rings").cast("bigint").alias("rings"), F.size(points).cast("bigint").alias("points"),
        F.round(F.array_min(F.transform(points, lambda p: p["lat"])), 6).alias("south"),
        F.round(F.array_max(F.transform(points, lambda p: p["lng"])), 6).alias("east"),
    )


@query("A9", f"""WITH {key_queries._INVENTORY}
SELECT alias, has_key, is_active, quota FROM inventory WHERE alias NOT LIKE 'csv#%'
UNION ALL SELECT 'csv#', has_key, is_active, quota FROM inventory WHERE alias LIKE 'csv#%'""")
def key_file(t):
    path = _path(t, "keys")
    rows = t.keys.select(F.col("api_key").alias("key"), F.col("alias").alias("key_alias"), "is_active", "daily_quota")
    O.write_locked_csv(rows, rows.columns, path)
    keys = K.key_inventory(R.read_csv(t.spark, path), R.SEQ)
    # part files may come in another order than the table, so a line's number is checked by tests/test_files.py
    named = F.when(F.col("alias").startswith("csv#"), "csv#").otherwise(F.col("alias"))
    return keys.select(named.alias("alias"), "has_key", "is_active", "quota")


@query("A10 B9", f"WITH {key_queries._USAGE} SELECT * FROM usage")
def ledger_file(t):
    path = _path(t, "ledger")
    O.write_ledger(key_queries._usage(t), path)
    return R.read_usage_ledger(t.spark, path)


@query("A11", "SELECT DISTINCT trim(value) AS value FROM v_logs")
def log_file(t):
    path = _path(t, "log")
    t.logs.select("value").write.text(path)
    return R.read_lines(t.spark, path).select(F.trim("value").alias("value")).distinct()


@query("A14", "SELECT key, md5(prompt) AS digest, images[2] AS second, CAST(len(optional_images) AS BIGINT) AS optional FROM v_skeleton")
def skeleton_file(t):
    path = _path(t, "skeleton")
    t.skeleton.drop("doc_id").select(F.to_json(F.struct("*")).alias("value")).write.text(path)
    return R.read_skeleton(t.spark, path).select(
        "key", F.md5("prompt").alias("digest"), F.get("images", F.lit(1)).alias("second"),
        F.size("optional_images").cast("bigint").alias("optional"),
    )


@query("A15", "SELECT j.name, j.display_name, j.state, f.size_bytes FROM v_jobs j LEFT JOIN v_job_files f ON f.name = replace(j.name, 'jobs/', 'files/')")
def job_files(t):
    jobs, files = _path(t, "jobs"), _path(t, "files")
    t.jobs.write.json(jobs)
    t.job_files.write.json(files)
    left = R.read_jobs(t.spark, jobs).select("name", "display_name", "state")
    right = R.read_job_files(t.spark, files).select(
        F.replace("name", F.lit("files/"), F.lit("jobs/")).alias("name"), "size_bytes"
    )
    return left.join(right, "name", "left")


@query("A17", "SELECT page_id, url, md5(html) AS digest FROM pages")
def page_snapshots(t):
    return R.read_pages(t.spark, f"{t.sf_dir}/pages.parquet").select("page_id", "url", F.md5("html").alias("digest"))


@query("A18", "SELECT cell_id, query, CAST(attempt AS INTEGER) AS attempt, CAST(page AS INTEGER) AS page, status, body FROM v_calls_pages")
def search_page_file(t):
    path = _path(t, "search")
    t.calls_pages.write.json(path, compression="gzip")
    return R.read_search_pages(t.spark, path)


@query("A19", "SELECT CAST(count(*) AS BIGINT) AS files, CAST(sum(bytes) AS BIGINT) AS bytes FROM (SELECT lang, sum(strlen(text) + 1) AS bytes FROM documents GROUP BY ALL)")
def media_files(t):
    path = _path(t, "media")
    t.base("documents").select("lang", F.col("text").alias("value")).write.partitionBy("lang").text(path)
    files = R.read_media(t.spark, path, "*.txt")
    by_lang = files.groupBy(F.regexp_extract("path", "lang=([^/]+)", 1).alias("lang")).agg(F.sum("length").alias("n"))
    return by_lang.agg(F.count(F.lit(1)).alias("files"), F.sum("n").alias("bytes"))


@query("B4 G9", """
SELECT place_id, status, count(*) AS n FROM v_results r JOIN (SELECT place_id AS p, status FROM v_state_places) s ON r.place_id = s.p GROUP BY ALL""")
def snapshot_table(t):
    root = _path(t, "snapshot")
    O.write_snapshot(t.state_places.limit(0), root)
    O.write_snapshot(t.state_places, root)
    state = O.read_snapshot(t.spark, root).select("place_id", "status")
    return t.results.join(state, "place_id").groupBy("place_id", "status").agg(F.count(F.lit(1)).alias("n"))


@query("B5 A2", f"""WITH {state_queries._GATE}
SELECT place_id, 'https://www.google.com/maps/place/?q=place_id:' || place_id AS url, err AS error_msg FROM gated WHERE outcome = 'failed'""")
def dead_letter_file(t):
    path = _path(t, "dead")
    O.write_dead_letter(W.scraped_gate(t.listings), path)
    return R.read_state(t.spark, path, "dead_letter").select("place_id", "url", "error_msg")


@query("B8 C9", f"""WITH {lead_queries._EXPORT}
SELECT place_id, name, address FROM e WHERE contains(lower(name || ' ' || category || ' ' || address), 'road 1')""")
def leads_csv(t):
    path = _path(t, "leads")
    O.write_leads_csv(L.export_leads(t.listings, "road 1", LINE_ORDER).select("place_id", "name", "address"), path)
    return R.read_csv(t.spark, path, ["place_id", "name", "address"]).drop(R.SEQ)


@query("B10 E13", f"""WITH {media_queries._PLAN}
SELECT place_id, '' || count(*) AS expected, '' || count(*) FILTER (length(blob) % 2 = 0) AS saved FROM plan GROUP BY ALL""")
def image_marker_file(t):
    path = _path(t, "markers")
    plan = media_queries._plan(t)
    O.write_image_markers(M.media_totals(plan, media_queries._stored(plan)), path)
    return R.read_state(t.spark, path, "images").select("place_id", "expected", "saved")


@query("B11", """
SELECT '{"run_id":"run7","place_id":"' || place_id || '","kind":"overview","attempts":' || attempts || ',"file":"' || place_id || '_overview.png"}' AS value
FROM v_results WHERE outcome = 'done'""")
def shot_manifest_file(t):
    path = _path(t, "shots")
    shots = t.results.filter("outcome = 'done'").withColumn("kind", F.lit("overview"))
    O.write_shot_manifest(M.shot_manifest(shots, "run7"), path)
    return t.spark.read.text(path)


@query("B12", f"""WITH {batch_queries._IMAGES}
SELECT printf('shard_%03d', doc_id // {batch_queries.PER_SHARD}) AS shard, count(*) AS lines FROM requests WHERE error IS NULL GROUP BY 1""")
def request_files(t):
    path = _path(t, "requests")
    sharded = B.assign_shard(batch_queries._requests(t), F.col("doc_id"), batch_queries.PER_SHARD)
    O.write_requests(B.request_lines(sharded, ["shard", "doc_id"]), path, "doc_id")
    rows = t.spark.read.text(path)
    return rows.groupBy("shard").agg(F.count(F.lit(1)).alias("lines"))


@query("B13", f"""WITH {batch_queries._NEWEST}
SELECT client, dataset, shard, state, error, model, update_time, checked_at, results_url, collected_at FROM status""")
def job_status_file(t):
    path = _path(t, "status")
    O.write_job_status(B.status_rows(batch_queries._sweep(t)), path)
    fields = "shard string, state string, error string, model string, update_time string, checked_at string, results_url string, collected_at string"
    return t.spark.read.schema(f"{fields}, client string, dataset string").json(path)


@query("E9", r"""
SELECT lang, CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS rows FROM documents GROUP BY ALL""")
def file_row_counts(t):
    """Physical lines less the header, by file."""
    path = _path(t, "rows")
    # quoted, so that the line breaks of a text stay in the file as they are; every task writes a file per language
    t.base("documents").select("lang", "text").write.partitionBy("lang").csv(path, header=True, escape='"')
    files = R.csv_row_counts(t.spark, f"{path}/*/*.csv")
    return files.groupBy(F.regexp_extract("file", "lang=([^/]+)", 1).alias("lang")).agg(F.sum("rows").alias("rows"))


@query("A2 F1", """
SELECT 'ChIJ' || p_partkey AS place_id, CASE WHEN p_partkey % 50 = 0 THEN 'done' ELSE 'queued' END AS status FROM part""")
def last_write_over_files(t):
    """A large older file and a small newer one: the last write of an id is the newer file's."""
    path = _path(t, "state")
    ids = t.base("part").select(F.concat(F.lit("ChIJ"), F.col("p_partkey").cast("string")).alias("place_id"), "p_partkey")
    O.write_locked_csv(ids.withColumn("status", F.lit("queued")).coalesce(1), S.STATE_COLUMNS["places"], path)
    newer = ids.filter("p_partkey % 50 = 0").withColumn("status", F.lit("done"))
    O.write_locked_csv(newer.coalesce(1), S.STATE_COLUMNS["places"], path)
    rows = R.read_state(t.spark, path, "places")
    return rows.groupBy("place_id").agg(F.max_by("status", R.SEQ).alias("status"))
