"""Resumable state: selection, repair, leases, merging and counts."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from placegrid.operators import discovery as C
from placegrid.operators import state as S
from placegrid.plans.registry import query
from placegrid.plans.views import LINE_ORDER

ORDER = ", ".join(LINE_ORDER)
QUERIES_ASKED = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
_ASKED = ", ".join(f"'{q}'" for q in QUERIES_ASKED)
_RESUMABLE = "status IN ('queued', 'scraping', 'failed') AND CAST(attempts AS BIGINT) < 5"
_RANK = "CASE {0} WHEN 'in_progress' THEN 3 WHEN 'done' THEN 2 WHEN 'failed' THEN 1 ELSE 0 END"
_COUNT = "CASE WHEN place_count = 'x' THEN 0 ELSE CAST(place_count AS BIGINT) END"


@query("C6", f"SELECT place_id, status, attempts FROM v_state_places WHERE {_RESUMABLE}")
def resumable(t):
    return S.resumable(t.state_places).select("place_id", "status", "attempts")


@query("C7", "SELECT place_id FROM v_state_places WHERE status = 'done'")
def done_places(t):
    return S.done_places(t.state_places)


@query("C7", "SELECT cell_id, query FROM v_state_cells WHERE status = 'done'")
def done_cells(t):
    return S.done_cells(t.state_cells)


@query("C19", "SELECT cell_id, query, status, seq FROM v_state_cells WHERE cell_id <> '' AND status NOT IN ('', 'queued', 'pending')")
def touched_cells(t):
    return S.touched(t.state_cells).select("cell_id", "query", "status", "seq")


@query("D1", f"""
WITH done AS (SELECT DISTINCT cell_id, query FROM v_state_cells WHERE status = 'done'),
cells AS (SELECT DISTINCT cell_id FROM v_state_cells WHERE cell_id <> '')
SELECT c.cell_id, q.query, CAST(q.pos AS INTEGER) AS pos FROM cells c, (SELECT unnest([{_ASKED}]) AS query, generate_subscripts([{_ASKED}], 1) - 1 AS pos) q
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.cell_id = c.cell_id AND d.query = q.query)""")
def plan_work(t):
    cells = t.state_cells.filter("cell_id <> ''").select("cell_id").distinct()
    return C.plan_work(cells, QUERIES_ASKED, S.done_cells(t.state_cells))


@query("D1", """
WITH done AS (SELECT DISTINCT cell_id, query FROM v_state_cells WHERE status = 'done'),
cells AS (SELECT DISTINCT cell_id FROM v_state_cells WHERE cell_id <> ''),
asked AS (SELECT min(seq) AS first, query FROM v_state_cells GROUP BY query)
SELECT c.cell_id, q.query, CAST(q.pos AS INTEGER) AS pos FROM cells c, (SELECT query, row_number() OVER (ORDER BY first) - 1 AS pos FROM asked) q
WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.cell_id = c.cell_id AND d.query = q.query)""")
def plan_work_of_table(t):
    """The queries are those that the state names, in the order in which they first came."""
    cells = t.state_cells.filter("cell_id <> ''").select("cell_id").distinct()
    asked = t.state_cells.groupBy("query").agg(F.min("seq").alias("first"))
    queries = asked.select((F.row_number().over(Window.orderBy("first")) - 1).alias("pos"), "query")  # a row per query
    return C.plan_work(cells, queries, S.done_cells(t.state_cells))


@query("E3", f"""
SELECT cell_id, arg_max(status, k) AS status, arg_max(n, k) AS place_count
FROM (SELECT cell_id, coalesce(nullif(status, ''), 'pending') AS status, {_COUNT} AS n,
  {_RANK.format('status')} * 1000000000000 + seq AS k FROM v_state_cells) GROUP BY cell_id""")
def collapse_cells(t):
    return S.collapse_cells(t.state_cells, ["seq"])


@query("E3 C19", f"""
SELECT cell_id, arg_max(status, k) AS status, arg_max(n, k) AS place_count
FROM (SELECT cell_id, status, {_COUNT} AS n, {_RANK.format('status')} * 1000000000000 + seq AS k
  FROM v_state_cells WHERE cell_id <> '' AND status NOT IN ('', 'queued', 'pending')) GROUP BY cell_id""")
def collapse_touched_cells(t):
    return S.collapse_cells(t.state_cells, ["seq"], skip_untouched=True)


@query("E1", """
SELECT count(*) AS placeids_total, count(*) FILTER (status = 'done') AS placeids_done,
  count(*) FILTER (status = 'failed') AS placeids_failed, count(*) FILTER (status IN ('queued', 'scraping')) AS placeids_pending
FROM v_state_places""")
def place_status_counts(t):
    return S.place_status_counts(t.state_places)


@query("E2", """
SELECT count(*) FILTER (status = 'done') AS cells_done, count(DISTINCT nullif(cell_id, '')) AS grid_cells_touched,
  (SELECT count(*) FROM customer) AS grid_cells_total, CAST(5 AS BIGINT) AS queries_total,
  (SELECT count(*) FROM customer) * 5 AS cells_total FROM v_state_cells""")
def cell_progress(t):
    return S.cell_progress(t.state_cells, t.base("customer").select("c_custkey"), len(QUERIES_ASKED))


@query("E10", """
SELECT CASE WHEN status IN ('done', 'failed') THEN status WHEN status IN ('in_progress', 'running') THEN 'running'
  ELSE 'queued' END AS status, count(*) AS cells FROM v_state_cells GROUP BY 1""")
def cell_status_histogram(t):
    return S.cell_status_histogram(t.state_cells)


@query("D5", """
SELECT place_id, o1, image_urls FROM v_listings WHERE place_id <> '' AND image_urls NOT IN ('', 'N/A')
  AND place_id NOT IN (SELECT place_id FROM v_known)
  AND place_id IN (SELECT place_id FROM v_state_places WHERE status = 'done')""")
def images_to_repair(t):
    return S.images_to_repair(t.listings, t.known, t.state_places).select("place_id", "o1", "image_urls")


@query("C25", "SELECT place_id, o1 FROM v_listings WHERE image_urls NOT IN ('', 'N/A')")
def image_work(t):
    return S.image_work(t.listings).select("place_id", "o1")


@query("D6", f"""
SELECT place_id, CASE WHEN {_RESUMABLE} AND place_id IN (SELECT place_id FROM v_listings) THEN 'done' ELSE status END AS status,
  attempts FROM v_state_places""")
def repair_done(t):
    return S.repair_done(t.state_places, t.listings).select("place_id", "status", "attempts")


@query("G5", """
SELECT place_id, shard, 'scraping' AS status, CAST(attempts AS BIGINT) + 1 AS attempts FROM v_state_places
WHERE status = 'queued' QUALIFY row_number() OVER (PARTITION BY shard ORDER BY seq) <= 20""")
def claim_batch(t):
    return S.claim_batch(t.state_places, "shard", 20, ["seq"]).select("place_id", "shard", "status", "attempts")


@query("K7", """
SELECT place_id, CASE WHEN status = 'scraping' AND age > 30 THEN 'queued' ELSE status END AS status FROM v_state_places""")
def reclaim_leases(t):
    now = F.lit("2024-01-01 12:00:00").cast("timestamp")
    aged = t.state_places.withColumn("updated_at", F.timestamp_seconds(F.unix_timestamp(now) - F.col("age") * 60))
    return S.reclaim_leases(aged, now).select("place_id", "status")


_MERGED = """
merged AS (SELECT r.place_id, r.attempts, r.outcome, r.shard, r.o1, r.o2,
  coalesce(r.attempts = CAST(s.attempts AS BIGINT), false) AS accepted
  FROM v_results r LEFT JOIN v_state_places s ON r.place_id = s.place_id)"""


@query("D9", f"WITH {_MERGED} SELECT place_id, attempts, outcome, o1, accepted FROM merged")
def merge_results(t):
    return S.merge_results(t.state_places, t.results).select("place_id", "attempts", "outcome", "o1", "accepted")


@query("E16 D9", f"""WITH {_MERGED}
SELECT shard, count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'failed') AS failed,
  count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS stale, round(count(*) / 20.0, 6) AS rate
FROM merged GROUP BY shard""")
def flush_totals(t):
    totals = S.flush_totals(S.merge_results(t.state_places, t.results), ["shard"], F.lit(20.0))
    return totals.withColumn("rate", F.round("rate", 6))


@query("G9", f"""
SELECT u.place_id, status, attempts, coalesce(e.last_error, '') AS last_error, updated_at
FROM (SELECT place_id, status, updated_at, CAST(sum(attempts_inc) OVER (PARTITION BY place_id) AS BIGINT) AS attempts FROM v_updates
  QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY o1 DESC, o2 DESC, o3 DESC, o4 DESC, o5 DESC, o6 DESC, o7 DESC, o8 DESC) = 1) u
LEFT JOIN (SELECT place_id, last_error FROM v_updates WHERE last_error IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY o1 DESC, o2 DESC, o3 DESC, o4 DESC, o5 DESC, o6 DESC, o7 DESC, o8 DESC) = 1) e
ON u.place_id = e.place_id""")
def latest_state(t):
    return S.latest_state(t.updates, ["place_id"], LINE_ORDER)


@query("H3", """
SELECT 'kept' AS run, place_id, '' || length(place_id) AS expected, '1' AS saved, 'earlier' AS completed_at FROM v_known
UNION ALL SELECT 'first', place_id, '', '', 'seed' FROM v_state_places WHERE status = 'done'""")
def seed_markers(t):
    markers = t.known.select(
        "place_id", F.length("place_id").cast("string").alias("expected"), F.lit("1").alias("saved"),
        F.lit("earlier").alias("completed_at"),
    )
    kept = S.seed_markers(t.state_places, markers).withColumn("run", F.lit("kept"))
    return kept.unionByName(S.seed_markers(t.state_places, markers.filter("false")).withColumn("run", F.lit("first")))


_GATE = """
gated AS (SELECT *, CASE WHEN name IN ('', 'FAILED') THEN 'failed' ELSE 'done' END AS outcome,
  CASE WHEN name IN ('', 'FAILED') THEN coalesce(nullif(error, ''), 'blank result') END AS err,
  CASE WHEN name IN ('', 'FAILED') THEN CASE WHEN contains(lower(error), '404') THEN 'permanent' ELSE 'transient' END END
    AS error_class FROM v_listings)"""


@query("C11 I22", f"WITH {_GATE} SELECT place_id, o1, outcome, err AS error, error_class FROM gated")
def scraped_gate(t):
    return S.scraped_gate(t.listings).select("place_id", "o1", "outcome", "error", "error_class")


@query("B5", f"""WITH {_GATE}
SELECT place_id, 'https://www.google.com/maps/place/?q=place_id:' || place_id AS url,
  CASE error_class WHEN 'permanent' THEN 'PermanentError' ELSE 'RetryExhausted' END AS error_class,
  left(err, 500) AS error_msg, attempted_at FROM gated WHERE outcome = 'failed'""")
def dead_letters(t):
    return S.dead_letters(S.scraped_gate(t.listings))


LATEST_CELLS = """
SELECT cell_id, query, arg_max(status, seq) AS status, arg_max('t' || seq, seq) AS last_attempted_at,
  coalesce(arg_max(n, seq) FILTER (n IS NOT NULL), 0) AS place_count,
  coalesce(arg_max('err ' || seq, seq) FILTER (seq % 3 = 0), '') AS error_msg
FROM (SELECT *, try_cast(place_count AS BIGINT) AS n FROM v_state_cells) GROUP BY ALL"""


def cell_updates(t):
    return t.state_cells.withColumns({
        "place_count": F.col("place_count").try_cast("bigint"),
        "last_attempted_at": F.concat(F.lit("t"), F.col("seq").cast("string")),
        "error_msg": F.when(F.col("seq") % 3 == 0, F.concat(F.lit("err "), F.col("seq").cast("string"))),
    })


@query("G9", LATEST_CELLS)
def latest_cells(t):
    return S.latest_cells(cell_updates(t), ["cell_id", "query"], ["seq"])


# A whole lease: claim, write the claims back, merge what workers return, apply the accepted results.
@query("G5 B4 D9 G9", """
WITH due AS (SELECT *, row_number() OVER (PARTITION BY shard ORDER BY seq) AS turn FROM v_state_places WHERE status = 'queued'),
after AS (SELECT s.place_id, CASE WHEN d.turn <= 40 THEN 'scraping' ELSE s.status END AS status,
  CAST(s.attempts AS BIGINT) + CASE WHEN d.turn <= 40 THEN 1 ELSE 0 END AS attempts
  FROM v_state_places s LEFT JOIN due d ON s.place_id = d.place_id),
won AS (SELECT a.place_id, min(r.outcome) AS outcome FROM after a JOIN v_results r ON r.place_id = a.place_id AND r.attempts = a.attempts GROUP BY ALL)
SELECT a.place_id, coalesce(outcome, status) AS status, a.attempts FROM after a LEFT JOIN won w ON a.place_id = w.place_id""")
def lease_cycle(t):
    state = t.state_places.withColumn("attempts", S.attempts_of().cast("bigint"))
    held = S.with_claims(state, S.claim_batch(state, "shard", 40, ["seq"]))
    return S.apply_results(held, S.merge_results(held, t.results)).select("place_id", "status", "attempts")
