"""Run reports: heartbeats, rates, summaries and logs."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.functions.outcomes import classify_error
from placegrid.operators import monitor as M
from placegrid.plans.registry import query

COUNTERS = ", ".join(M.COUNTERS)
_LATEST = "latest AS (SELECT * EXCLUDE (seq) FROM v_live QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY seq DESC) = 1)"


def _latest(t):
    return M.latest_heartbeat(t.live, ["seq"]).drop("seq")


@query("A5", f"WITH {_LATEST} SELECT * FROM latest")
def latest_heartbeats(t):
    return _latest(t)


@query("A6 A5", f"""WITH {_LATEST}
SELECT run_id, discovered + 1000000 AS discovered, scraped FROM latest WHERE run_id LIKE '%7'
UNION ALL SELECT run_id, discovered, scraped FROM latest WHERE run_id NOT LIKE '%7'""")
def live_or_latest(t):
    latest = _latest(t).select("run_id", "discovered", "scraped")
    live = latest.filter("run_id like '%7'").withColumn("discovered", F.col("discovered") + 1000000)
    return M.live_or_latest(live, latest)


# Every sample against every earlier sample of its run that lies in the window.
@query("F4", """
WITH h AS (SELECT run_id, epoch_us(ts) AS at_us, cells_done AS v FROM v_beats),
b AS (SELECT run_id, min(at_us) AS began FROM h WHERE v > 0 GROUP BY ALL),
s AS (SELECT h.* FROM h JOIN b ON h.run_id = b.run_id WHERE at_us >= began),
c AS (SELECT * FROM (SELECT *, lag(v) OVER (PARTITION BY run_id ORDER BY at_us, v) AS p FROM s) WHERE p IS NULL OR p <> v),
n AS (SELECT *, lag(at_us) OVER w AS pat, lag(v) OVER w AS pv FROM c WINDOW w AS (PARTITION BY run_id ORDER BY at_us, v)),
f AS (SELECT n.run_id, n.at_us, n.v, any_value(n.pat) AS pat, any_value(n.pv) AS pv, count(*) AS k, min((m.at_us, m.v)) AS first
  FROM n JOIN c m ON m.run_id = n.run_id AND m.at_us BETWEEN n.at_us - 15000000 AND n.at_us GROUP BY n.run_id, n.at_us, n.v),
a AS (SELECT run_id, at_us, v, CASE WHEN k > 1 THEN first[1] ELSE pat END AS a_at, CASE WHEN k > 1 THEN first[2] ELSE pv END AS a_v FROM f)
SELECT run_id, at_us, v, round(coalesce(CASE WHEN at_us - a_at >= 3000000 AND v > a_v THEN (v - a_v) / ((at_us - a_at) / 1000000.0) ELSE 0.0 END, 0.0), 6) AS rate FROM a""")
def sliding_rate(t):
    rates = M.sliding_rate(t.beats, "run_id", "ts", "cells_done")
    return rates.withColumn("rate", F.round("rate", 6)).withColumnRenamed("at", "at_us")


@query("F5 I35", """
WITH h AS (SELECT run_id, epoch_us(ts) AS at_us, event_id FROM v_beats),
w AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY at_us, event_id) AS done, min(at_us) OVER (PARTITION BY run_id) AS began,
  count(*) OVER (PARTITION BY run_id) AS total,
  count(*) OVER (PARTITION BY run_id ORDER BY at_us RANGE BETWEEN 60000000 PRECEDING AND CURRENT ROW) AS n FROM h),
r AS (SELECT *, n / least(60.0, greatest(1.0, (at_us - began) / 1000000.0)) AS rate FROM w)
SELECT run_id, at_us, event_id, done, round(rate, 6) AS rate_1m, round((total - done) / rate, 4) AS eta_s FROM r""")
def completion_rate_1m(t):
    totals = t.beats.groupBy("run_id").agg(F.count(F.lit(1)).alias("total"))
    rows = M.completion_rate_1m(t.beats, "run_id", "ts", "event_id", totals)
    rounded = {"rate_1m": F.round("rate_1m", 6), "eta_s": F.round("eta_s", 4)}
    return rows.withColumns(rounded).withColumnRenamed("at", "at_us")


_COUNTS = """
counts AS (SELECT 'run-' || o_custkey AS run_id, count(*) AS placeids_total, count(*) FILTER (o_orderstatus = 'F') AS placeids_done,
  count(*) FILTER (o_orderstatus = 'P') AS placeids_failed, 40 * count(*) AS phase1_rows, 30 * count(*) AS phase2_rows,
  count(*) % 5 AS failure_rows FROM orders GROUP BY o_custkey)"""


def _counts(t):
    n, status = F.count(F.lit(1)), F.col("o_orderstatus")
    return t.base("orders").groupBy(F.concat(F.lit("run-"), F.col("o_custkey").cast("string")).alias("run_id")).agg(
        n.alias("placeids_total"), F.count_if(status == "F").alias("placeids_done"),
        F.count_if(status == "P").alias("placeids_failed"), (40 * n).alias("phase1_rows"),
        (30 * n).alias("phase2_rows"), (n % 5).alias("failure_rows"),
    )


@query("D10", f"""WITH {_LATEST}, {_COUNTS}
SELECT l.run_id, greatest(discovered, coalesce(placeids_total, 0)) AS discovered, greatest(scraped, coalesce(c.placeids_done, 0)) AS scraped,
  greatest(errors, coalesce(c.placeids_failed, 0)) AS errors FROM latest l LEFT JOIN counts c ON l.run_id = c.run_id""")
def reconcile_counters(t):
    counts = _counts(t).select("run_id", "placeids_total", "placeids_done", "placeids_failed")
    return M.reconcile_counters(_latest(t), counts)


_RUNS = f"""{_LATEST},
runs AS (SELECT r.run_id, started_at, city_name AS city, list_transform(range(n_queries), lambda i: 'q') AS queries,
  CAST([] AS VARCHAR[]) AS selected_columns, CAST(NULL AS BIGINT) AS osm_relation_id, coalesce(osm_type, 'relation') AS osm_type,
  coalesce(grid_size_meters, 250) AS grid_size_meters, coalesce(num_consumer_threads, 8) AS num_consumer_threads,
  coalesce(discovery_backend, 'places_api') AS discovery_backend, coalesce(places_tier, 'ESSENTIALS') AS places_tier,
  c_custkey % 5 = 1 AS active, CASE WHEN c_custkey % 5 = 2 THEN 0 END AS exit_code,
  {', '.join(f'coalesce(l.{c}, 0) AS {c}' for c in M.COUNTERS)}, {', '.join(f'coalesce(l.{c}, 0.0) AS {c}' for c in M.GAUGES)},
  coalesce(nullif(l.queries_total, 0), n_queries) AS queries_total
  FROM v_runs r LEFT JOIN latest l ON r.run_id = l.run_id)"""


def _summary(t, counts=None):
    config = t.runs.withColumn(
        "queries", F.array_repeat(F.lit("q"), F.col("n_queries").cast("int"))
    )
    active = t.runs.filter("c_custkey % 5 in (1, 2)").select(
        "run_id", F.when(F.col("c_custkey") % 5 == 2, 0).alias("exit_code")
    )
    return M.run_summary(config, _latest(t), active, counts)


@query("D11", f"WITH {_RUNS} SELECT * FROM runs")
def run_summary(t):
    return _summary(t)


@query("D11 D10", f"""WITH {_RUNS}, {_COUNTS}
SELECT r.* REPLACE (greatest(discovered, coalesce(phase1_rows, 0)) AS discovered,
    greatest(scraped, coalesce(c.placeids_done, 0), coalesce(phase2_rows, 0)) AS scraped,
    greatest(errors, coalesce(c.placeids_failed, 0), coalesce(failure_rows, 0)) AS errors,
    coalesce(c.placeids_done, 0) AS placeids_done, coalesce(c.placeids_failed, 0) AS placeids_failed),
  coalesce(c.placeids_total, 0) AS placeids_total,
  coalesce(phase1_rows, 0) AS phase1_csv_rows, coalesce(phase2_rows, 0) AS phase2_csv_rows, coalesce(failure_rows, 0) AS failures_rows
FROM runs r LEFT JOIN counts c ON r.run_id = c.run_id""")
def run_detail(t):
    return _summary(t, _counts(t))


@query("D11 A6", f"""WITH {_RUNS}
SELECT r.run_id, r.scraped, CASE WHEN l.run_id IS NULL THEN CAST([] AS VARCHAR[]) ELSE ['p1-0'] END AS workers, 0 AS api_keys
FROM runs r LEFT JOIN latest l ON r.run_id = l.run_id""")
def run_live(t):
    worker = F.struct(F.lit("p1-0").alias("id"), F.lit(1).alias("phase"), F.lit("busy").alias("state"), F.lit("").alias("task"))
    live = _latest(t).withColumns({"workers": F.array(worker), "api_keys": F.array().cast("array<struct<alias:string>>")})
    config = t.runs.withColumn("queries", F.lit(None).cast("array<string>"))
    rows = M.run_summary(config, live, t.runs.select("run_id", F.lit(0).alias("exit_code")), arrays=True)
    return rows.select("run_id", "scraped", F.transform("workers", lambda w: w["id"]).alias("workers"), F.size("api_keys").alias("api_keys"))


@query("E4 D11", f"""WITH {_RUNS}
SELECT count(*) AS total_runs, CAST(sum(scraped) AS BIGINT) AS total_places, round(sum(cost_usd), 2) AS total_spend,
  CAST(coalesce(sum(api_calls) FILTER (started_at LIKE '2024-01-03%'), 0) AS BIGINT) AS api_calls_today,
  CAST(coalesce(sum(floor(60 * scraped / greatest(1.0, elapsed_s))) FILTER (active AND elapsed_s > 0), 0) AS BIGINT) AS throughput_per_min,
  count(*) FILTER (NOT active AND scraped > 0) AS archived_count FROM runs""")
def global_stats(t):
    return M.global_stats(_summary(t), "2024-01-03")


_PROGRESS = f"""{_RUNS},
progress AS (SELECT run_id, round(CASE WHEN cells_total > 0 THEN 100.0 * cells_done / cells_total ELSE 0.0 END, 1) AS done_pct,
  round(least(100.0, CASE WHEN discovered > 0 THEN 100.0 * scraped / discovered ELSE 0.0 END), 1) AS scraped_pct,
  round(CASE WHEN placeids_done + placeids_failed > 0 THEN 100.0 * placeids_failed / (placeids_done + placeids_failed) ELSE 0.0 END, 1) AS error_pct,
  greatest(0, cells_total - cells_done - cells_in_flight) AS cells_remaining, discovered, scraped, cells_total, cells_done,
  discovery_rps, rps_inst FROM runs)"""


@query("E17", f"WITH {_PROGRESS} SELECT run_id, done_pct, scraped_pct, error_pct, cells_remaining FROM progress")
def progress_pct(t):
    return M.progress_pct(_summary(t)).select("run_id", "done_pct", "scraped_pct", "error_pct", "cells_remaining")


@query("I35 E17", f"""WITH {_PROGRESS}
SELECT run_id, round(CASE WHEN discovery_rps > 0 THEN cells_remaining / discovery_rps END, 6) AS phase1_eta,
  round(CASE WHEN rps_inst > 0 THEN greatest(0, CASE WHEN cells_done > 0
    THEN floor(discovered * (CAST(cells_total AS DOUBLE) / cells_done) + 0.5) ELSE discovered END - scraped) / rps_inst END, 6) AS phase2_eta
FROM progress""")
def progress_eta(t):
    rows = M.progress_eta(M.progress_pct(_summary(t)), "discovery_rps", "rps_inst")
    return rows.select("run_id", F.round("phase1_eta", 6).alias("phase1_eta"), F.round("phase2_eta", 6).alias("phase2_eta"))


_LOGS = """
logs AS (SELECT conv_id, turn,
  CASE turn % 3 WHEN 0 THEN '12:00:0' || turn WHEN 1 THEN '12:34:5' || turn ELSE '' END AS ts,
  CASE turn % 3 WHEN 0 THEN value ->> '$.levelname' WHEN 1 THEN regexp_extract(value, '\\[([A-Z]+)\\]', 1) ELSE 'INFO' END AS level,
  CASE turn % 3 WHEN 0 THEN value ->> '$.name' WHEN 1 THEN 'svc.worker' ELSE '' END AS name,
  CASE turn % 3 WHEN 0 THEN value ->> '$.message' WHEN 1 THEN 'fallback used ' || conv_id ELSE trim(value) END AS msg,
  CASE turn % 3 WHEN 1 THEN 'phase1' ELSE '' END AS phase,
  CASE turn % 3 WHEN 0 THEN 'C' || conv_id WHEN 1 THEN 'CELL_' || conv_id ELSE '' END AS cell_id,
  CASE turn % 3 WHEN 1 THEN 'ChIJ' || turn ELSE '' END AS place_id
  FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN CAST(value AS JSON) END AS value_json, value FROM v_logs))"""
_LOGS = _LOGS.replace("value ->> '$.", "value_json ->> '$.")


def _logs(t):
    return M.parse_log_lines(t.logs)


@query("A11", f"WITH {_LOGS} SELECT * FROM logs")
def parsed_logs(t):
    return _logs(t)


@query("C10", f"WITH {_LOGS} SELECT * FROM logs WHERE lower(level) IN ('error', 'err', 'critical', 'fatal')")
def error_logs(t):
    return M.filter_logs(_logs(t), "errors")


@query("C10", f"""WITH {_LOGS}
SELECT * FROM logs WHERE lower(level) IN ('warning', 'warn', 'error', 'err', 'critical', 'fatal')
  OR regexp_matches(msg, '(?i)\\b429\\b|rate.?limit|ratelimit|cooldown|retir|failed|crash|exception|exhausted|fallback|phase2_disabled|threadpool_start')""")
def event_logs(t):
    return M.filter_logs(_logs(t), "events")


@query("G4", f"WITH {_LOGS} SELECT * FROM logs ORDER BY conv_id DESC, turn DESC LIMIT 50")
def tail_logs(t):
    return M.tail_logs(_logs(t), ["conv_id", "turn"], 50)


@query("F10", """
WITH n AS (SELECT doc_id, ts, CASE WHEN length(msg) > 2000 THEN left(msg, 2000) || '...' ELSE msg END AS msg, level, name, phase, cell_id, place_id
  FROM v_events_log ORDER BY doc_id DESC LIMIT 500),
b AS (SELECT doc_id, msg, CAST(strlen(to_json({'id': doc_id, 'ts': ts, 'level': level, 'name': name, 'msg': msg, 'phase': phase, 'cell_id': cell_id,
  'place_id': place_id})) AS BIGINT) AS bytes FROM n),
r AS (SELECT *, CAST(sum(bytes) OVER (ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tail_bytes FROM b)
SELECT doc_id, bytes, tail_bytes, md5(msg) AS digest FROM r WHERE tail_bytes <= 262144""")
def bounded_tail(t):
    return M.bounded_tail(t.events_log, ["doc_id"], id="doc_id").select("doc_id", "bytes", "tail_bytes", F.md5("msg").alias("digest"))


@query("E9", "SELECT lang AS file, count(*) AS rows FROM documents GROUP BY ALL")
def row_counts(t):
    return M.row_counts(t.base("documents").withColumnRenamed("lang", "file"), "file")


@query("E9", "SELECT lang AS file, CAST(sum(1 + length(text) - length(replace(text, chr(10), ''))) AS BIGINT) AS rows FROM documents GROUP BY ALL")
def physical_line_counts(t):
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    return M.row_counts(t.base("documents").withColumnRenamed("lang", "file"), "file", breaks)


@query("I22", """
SELECT place_id, o1, CASE WHEN regexp_matches(lower(error), 'not found|no longer exists|invalid place_id|404|permanently closed')
  THEN 'permanent' ELSE 'transient' END AS kind FROM v_listings""")
def error_classes(t):
    return t.listings.select("place_id", "o1", classify_error("error").alias("kind"))
