"""Stored forms: served leads, bucketed histories, ingested files, counts and parks kept up by streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid import schemas
from placegrid.plans import lead_queries, state_queries
from placegrid.plans.registry import query
from placegrid.plans.stream_queries import FILE_ROWS, _paths, _stream_of_files
from placegrid.plans.views import LINE_ORDER, pieces
from placegrid.sources import history as H
from placegrid.sources import ingest as N
from placegrid.sources import leadstore as LS
from placegrid.sources import readers as R
from placegrid.sources import writers as O
from placegrid.streaming import jobs as J
from placegrid.streaming import keyed as Y

ORDER = ", ".join(LINE_ORDER)


def _shuffles(t) -> int:
    return int(t.spark.conf.get("spark.sql.shuffle.partitions"))


def _store(t) -> str:
    (root,) = _paths(t, "leads")
    LS.write_lead_store(lead_queries._leads(t), root, files=_shuffles(t))
    return root


@query("C8", f"""WITH {lead_queries._LEADS}
SELECT * FROM leads WHERE contains(lower(name), 'shop 1') OR contains(lower(cat), 'shop 1') OR contains(lower(addr), 'shop 1')""")
def stored_search(t):
    return LS.stored_search(t.spark, _store(t), " Shop 1 ").select(*lead_queries.LEAD_COLUMNS)


@query("G1", f"""WITH {lead_queries._LEADS}
SELECT id, name, side, seq, (SELECT count(*) FROM leads) AS total FROM leads ORDER BY side, seq, id LIMIT 150 OFFSET 150""")
def stored_page(t):
    return LS.stored_page(t.spark, _store(t), 1, 150).select("id", "name", "side", "seq", "total")


def _history(t, *tables) -> tuple[str, str, int]:
    """A history of the ids of the tables, added one after the other."""
    (path,) = _paths(t, "ids")
    name, buckets = "ids_" + path.split("-")[-1].replace("/", "_"), _shuffles(t)
    for ids in tables:
        H.add_history(ids, name, path, buckets)
    return name, path, buckets


@query("D2 D3 F1", f"""
SELECT place_id, cell_id, query, o1 FROM v_discovered d WHERE place_id <> ''
  AND NOT EXISTS (SELECT 1 FROM v_known k WHERE k.place_id = d.place_id)
  AND NOT EXISTS (SELECT 1 FROM v_listings l WHERE l.place_id = d.place_id)
QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY {ORDER}) = 1""")
def history_survivors(t):
    """Known and scraped ids in one history, some of them added twice."""
    held = H.open_history(t.spark, *_history(t, t.known, t.listings, t.known))
    return H.new_survivors(t.discovered, LINE_ORDER, held).select("place_id", "cell_id", "query", "o1")


@query("D2 A1", """
SELECT place_id, cell_id, query, o1 FROM v_discovered WHERE place_id <> '' AND place_id NOT IN (SELECT place_id FROM v_known)""")
def history_new_rows(t):
    held = H.open_history(t.spark, *_history(t, t.known))
    return H.new_rows(t.discovered, held).select("place_id", "cell_id", "query", "o1")


@query("D6", f"""
SELECT place_id, CASE WHEN {state_queries._RESUMABLE} AND place_id IN (SELECT place_id FROM v_listings) THEN 'done' ELSE status END AS status,
  attempts FROM v_state_places""")
def history_repair(t):
    held = H.open_history(t.spark, *_history(t, t.listings))
    return H.repair_from_history(t.state_places, held).select("place_id", "status", "attempts")


@query("A2 F1", """
SELECT place_id, CASE WHEN seq % 3 = 0 THEN 'later' ELSE status END AS status FROM v_state_places""")
def ingested_state(t):
    """State files taken in two runs; the last write of an id is the later file's."""
    files, root, check = _paths(t, "files", "taken", "check")
    columns = schemas.STATE_COLUMNS["places"]
    later = t.state_places.filter("seq % 3 = 0").withColumn("status", F.lit("later"))
    for rows in (t.state_places, later):
        O.write_locked_csv(rows.repartition(3), columns, files)
        J.drain(N.ingest_csv(t.spark, files, columns, root, check, files_per_batch=4))
    taken = N.read_ingested(t.spark, root, columns)
    return taken.groupBy("place_id").agg(F.max_by("status", R.SEQ).alias("status"))


@query("A3 B2", "SELECT place_id, name, rating, image_urls FROM v_listings")
def ingested_listings(t):
    """Gzip files become Parquet that splits."""
    files, root, check = _paths(t, "files", "taken", "check")
    O.write_full_gz(t.listings, files)
    J.drain(N.ingest_csv(t.spark, files, schemas.LISTING_COLUMNS, root, check))
    return N.read_ingested(t.spark, root, schemas.LISTING_COLUMNS).select("place_id", "name", "rating", "image_urls")


@query("E1 K3", f"""
WITH s AS (SELECT place_id, status FROM v_updates
  QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY {', '.join(f'{c} DESC' for c in LINE_ORDER)}) = 1)
SELECT count(*) AS placeids_total, count(*) FILTER (status = 'done') AS placeids_done,
  count(*) FILTER (status = 'failed') AS placeids_failed, count(*) FILTER (status IN ('queued', 'scraping')) AS placeids_pending FROM s""")
def stream_place_counts(t):
    """Counts from what each batch changed; places go from done to failed and back."""
    root, check, out, seen = _paths(t, "state", "check", "counts", "seen")
    J.drain(J.stream_state(_stream_of_files(t, t.updates), root, check, ["place_id"], LINE_ORDER, every=None))
    changes = Y.changed_rows(t.spark, root, files_per_batch=_shuffles(t))
    J.drain(Y.stream_counts(changes, ["place_id"], "status", out, seen))
    return Y.counted_places(Y.counts(t.spark, out))


def _cell_changes(t) -> str:
    root, check = _paths(t, "state", "check")
    updates = _stream_of_files(t, state_queries.cell_updates(t))
    J.drain(J.stream_cells(updates, root, check, ["cell_id", "query"], ["seq"], every=None))
    return root


@query("E10 K3", f"""
SELECT CASE WHEN status IN ('done', 'failed') THEN status WHEN status IN ('in_progress', 'running') THEN 'running'
  ELSE 'queued' END AS status, count(*) AS cells FROM ({state_queries.LATEST_CELLS}) GROUP BY 1""")
def stream_cell_counts(t):
    out, seen = _paths(t, "counts", "seen")
    J.drain(Y.stream_counts(Y.changed_rows(t.spark, _cell_changes(t)), ["cell_id", "query"], "status", out, seen))
    return Y.counted_cells(Y.counts(t.spark, out))


@query("E2 K3", "SELECT count(DISTINCT cell_id) AS grid_cells_touched FROM v_state_cells WHERE cell_id <> ''")
def stream_touched_cells(t):
    """A cell counts once, whatever its queries."""
    out, seen = _paths(t, "counts", "seen")
    changes = Y.changed_rows(t.spark, _cell_changes(t)).filter("cell_id <> ''")
    J.drain(Y.stream_counts(changes, ["cell_id"], F.lit("touched"), out, seen))
    return Y.counts(t.spark, out).agg(F.coalesce(F.sum("keys"), F.lit(0)).cast("bigint").alias("grid_cells_touched"))


@query("K4", """
WITH p AS (SELECT user_key AS alias, epoch_us(ts) // 1000 AS ms FROM v_calls WHERE status = 429),
g AS (SELECT *, CASE WHEN ms - lag(ms) OVER (PARTITION BY alias ORDER BY ms) <= 30000 THEN 0 ELSE 1 END AS fresh FROM p),
i AS (SELECT *, sum(fresh) OVER (PARTITION BY alias ORDER BY ms ROWS UNBOUNDED PRECEDING) AS park FROM g),
e AS (SELECT alias, max(ms) + 30000 AS released_ms FROM i GROUP BY alias, park)
SELECT alias, released_ms FROM e WHERE released_ms <= (SELECT max(ms) - 10000 FROM p)""")
def stream_releases(t):
    """Parks end by timers; the files come in time order."""
    out, check, source = _paths(t, "out", "check", "parks")
    rows = t.calls.filter("status = 429").select(F.col("user_key").alias("alias"), F.col("ts").cast("timestamp").alias("ts"))
    ends = rows.agg(F.percentile_approx(F.unix_micros("ts"), [0.33, 0.67]).alias("c")).first().c or [0, 0]
    at = F.unix_micros("ts")
    for part in (at <= ends[0], (at > ends[0]) & (at <= ends[1]), at > ends[1]):
        # all files that a run finds are one micro-batch, however many a large part needs
        some = rows.filter(part)
        some.repartition(pieces(some, FILE_ROWS)).write.mode("append").parquet(source)
        parks = t.spark.readStream.schema(rows.schema).parquet(source)
        J.drain(O.stream_append(Y.stream_releases(parks), out, check, drain=True))
    return t.spark.read.parquet(out).select("alias", F.unix_millis("released_at").alias("released_ms"))
