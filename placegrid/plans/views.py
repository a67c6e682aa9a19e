"""The driver tables shaped into listings data, as text both engines run.

`@name` is a base table; `@arr(…)`, `@struct(k = v; …)` and `@each(col; from; to)`
stand for the array, struct and row-generating forms of the engine. `@spread(key)`
spreads rows over the cores before each becomes many, as `SPREAD` does with a base table.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
)
SPREAD = {"v_gallery": {"part": "p_partkey"}}
SPREAD_ROWS = 20_000  # of them a task makes many rows, so its work stays the same however large the table
LINE_ORDER = ("o1", "o2", "o3", "o4", "o5", "o6", "o7", "o8")
_LINE_ORDER = """l_orderkey AS o1, l_linenumber AS o2, l_partkey AS o3, l_suppkey AS o4,
  l_extendedprice AS o5, l_shipdate AS o6, l_quantity AS o7, l_returnflag AS o8"""

VIEWS = {
    "v_discovered": f"""
SELECT CASE WHEN l_partkey % 211 = 0 THEN '' ELSE 'ChIJ' || l_partkey END AS place_id,
  'CELL_' || l_suppkey AS cell_id, l_returnflag AS query,
  CASE WHEN l_partkey % 5 <> 0 THEN 10 + CAST(l_partkey % 1000 AS DOUBLE) / 64 END AS lat,
  CASE WHEN l_partkey % 5 <> 0 THEN 70 + CAST(l_partkey % 700 AS DOUBLE) / 32 END AS lng,
  {_LINE_ORDER}
FROM @lineitem""",
    "v_known": "SELECT 'ChIJ' || p_partkey AS place_id FROM @part WHERE p_size < 10",
    "v_listings": f"""
SELECT CASE WHEN l_partkey % 199 = 0 THEN '' ELSE 'ChIJ' || l_partkey END AS place_id,
  CASE WHEN l_orderkey % 13 = 0 THEN '' WHEN l_orderkey % 17 = 0 THEN 'FAILED'
    ELSE 'Shop ' || l_suppkey END AS name,
  CASE l_orderkey % 7 WHEN 0 THEN '' WHEN 1 THEN 'N/A' WHEN 2 THEN '—'
    ELSE (l_partkey % 5) || '.' || (l_orderkey % 10) END AS rating,
  CASE l_orderkey % 5 WHEN 0 THEN '' WHEN 1 THEN 'nan' ELSE (l_partkey % 900) || '.7' END AS review_count,
  l_linestatus || ' Type' AS category, 'Road ' || (l_suppkey % 40) AS address,
  CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE (l_partkey % 90) || '.25' END AS latitude,
  CASE WHEN l_orderkey % 4 = 0 THEN '' ELSE (l_partkey % 170) || '.5' END AS longitude,
  CASE l_orderkey % 6 WHEN 0 THEN 'N/A' WHEN 1 THEN ''
    WHEN 2 THEN '["http://i/' || l_partkey || '","http://j"]'
    WHEN 3 THEN 'http://i/a' || l_partkey || '=w100;http://i/a' || l_partkey || '=w900; http://i/b'
      || l_suppkey || '=s200;;'
    WHEN 4 THEN 'http://i/' || l_partkey || '|http://k' ELSE '12' || l_partkey END AS image_urls,
  'http://s/' || l_partkey AS source_url,
  CASE l_orderkey % 4 WHEN 0 THEN 'image/PNG; q=1' WHEN 1 THEN 'image/webp' WHEN 2 THEN 'text/html'
    ELSE 'image/jpeg' END AS content_type,
  CASE l_orderkey % 3 WHEN 0 THEN 'HTTP 404 timeout' WHEN 1 THEN 'Navigation Timeout' ELSE '' END AS error,
  l_linenumber AS attempts, '' || CAST(l_shipdate AS DATE) AS attempted_at,
  {_LINE_ORDER}
FROM @lineitem WHERE l_partkey % 3 <> 0""",
    "v_state_cells": """
SELECT CASE WHEN o_custkey % 89 = 7 THEN '' ELSE 'CELL_' || (o_custkey % 5000) END AS cell_id,
  o_orderpriority AS query,
  CASE WHEN o_orderkey % 31 = 0 THEN 'queued' WHEN o_orderkey % 37 = 0 THEN ''
    WHEN o_orderstatus = 'F' THEN 'done' WHEN o_orderstatus = 'O' THEN 'in_progress' ELSE 'failed' END AS status,
  CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE '' || CAST(floor(o_totalprice / 1000) AS BIGINT) END AS place_count,
  o_orderkey AS seq
FROM @orders""",
    "v_state_places": """
SELECT 'ChIJ' || p_partkey AS place_id,
  CASE p_partkey % 5 WHEN 0 THEN 'queued' WHEN 1 THEN 'scraping' WHEN 2 THEN 'failed' WHEN 3 THEN 'done'
    ELSE 'other' END AS status,
  '' || (p_size % 7) AS attempts, p_partkey % 8 AS shard, p_size AS age, p_partkey AS seq
FROM @part""",
    "v_updates": f"""
SELECT 'ChIJ' || l_partkey AS place_id, CASE l_linestatus WHEN 'F' THEN 'done' ELSE 'failed' END AS status,
  CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS attempts_inc,
  CASE WHEN l_orderkey % 4 = 0 THEN 'err ' || l_orderkey END AS last_error,
  '' || CAST(l_shipdate AS DATE) AS updated_at,
  {_LINE_ORDER}
FROM @lineitem""",
    "v_results": """
SELECT 'ChIJ' || l_partkey AS place_id, l_linenumber % 7 AS attempts,
  CASE WHEN l_returnflag = 'R' THEN 'failed' ELSE 'done' END AS outcome, l_suppkey % 16 AS shard,
  l_orderkey AS o1, l_linenumber AS o2
FROM @lineitem""",
    "v_calls": """
SELECT 'key-' || (user_id % 33) AS alias,
  CASE WHEN event_type IN ('error', 'signup') THEN 429 WHEN event_type = 'purchase' AND event_id % 7 = 0 THEN 403
    WHEN event_type = 'click' AND event_id % 3 = 0 THEN 500 ELSE 200 END AS status,
  event_type = 'purchase' AND event_id % 7 = 0 AS auth_failed,
  CASE WHEN event_id % 2 = 0 THEN 'API key not valid. Pass one' ELSE 'bad request' END AS body,
  ts, event_id, 'key-' || user_id AS user_key
FROM @events""",
    "v_keys": """
SELECT c_custkey AS pos, CASE WHEN c_custkey % 41 = 0 THEN ' ' ELSE 'secret-' || c_custkey END AS api_key,
  CASE WHEN c_custkey % 10 = 9 THEN '' ELSE 'key-' || c_custkey END AS alias,
  CASE c_custkey % 11 WHEN 0 THEN ' No ' WHEN 1 THEN '0' WHEN 2 THEN 'FALSE' WHEN 3 THEN 'n' ELSE '1' END AS is_active,
  CASE c_custkey % 8 WHEN 0 THEN '' WHEN 1 THEN '0' WHEN 2 THEN 'Unlimited' WHEN 3 THEN 'n/a' WHEN 4 THEN '-3'
    WHEN 5 THEN '0.5' WHEN 6 THEN '1e0' ELSE '' || (c_custkey % 5 + 1) END AS daily_quota
FROM @customer""",
    "v_beats": """
SELECT 'run-' || (user_id % 10) AS run_id, @ms(ts) AS ts, event_id,
  CASE WHEN event_id % 1000 > 990 THEN event_id - 500 ELSE event_id - event_id % 40 END AS cells_done
FROM @events""",
    "v_runs": """
SELECT 'run-' || c_custkey AS run_id, '2024-01-0' || (c_custkey % 9 + 1) || 'T00:00:00+00:00' AS started_at,
  c_mktsegment AS city_name, CASE WHEN c_custkey % 3 = 0 THEN 'way' END AS osm_type,
  CASE WHEN c_custkey % 4 = 0 THEN 1000 END AS grid_size_meters,
  CASE WHEN c_custkey % 5 = 0 THEN 16 END AS num_consumer_threads,
  CASE WHEN c_custkey % 7 = 0 THEN 'maps_frontend' END AS discovery_backend,
  CASE WHEN c_custkey % 6 = 0 THEN 'PRO' END AS places_tier,
  c_custkey % 4 AS n_queries, c_custkey
FROM @customer""",
    "v_live": """
SELECT 'run-' || user_id AS run_id, event_id AS seq, event_id % 900 + 100 AS discovered, event_id % 700 AS scraped,
  event_id % 13 AS errors, event_id % 50 AS queue_depth, event_id % 5000 AS api_calls, event_id % 33 AS active_keys,
  event_id % 400 AS cells_done, event_id % 7 AS cells_failed, event_id % 5 AS cells_partial,
  event_id % 9 AS cells_in_flight, event_id % 500 AS cells_total, event_id % 250 AS grid_cells_total,
  event_id % 600 AS placeids_done, event_id % 40 AS placeids_failed, event_id % 300 AS placeids_pending,
  CAST(event_id % 8 AS DOUBLE) / 4 AS rps_inst, CAST(event_id % 900 AS DOUBLE) / 2 AS elapsed_s,
  CAST(event_id % 64 AS DOUBLE) / 16 AS cost_usd, CAST(event_id % 16 AS DOUBLE) / 8 AS discovery_rps,
  event_id % 3 AS queries_total
FROM @events""",
    "v_logs": """
SELECT conv_id, turn, CASE turn % 3
  WHEN 0 THEN '{"asctime":"12:00:0' || turn || '","levelname":"' || CASE role WHEN 'user' THEN 'INFO'
    WHEN 'assistant' THEN 'ERROR' ELSE 'WARNING' END || '","name":"svc.' || role || '","message":"conv ' || conv_id
    || CASE WHEN conv_id % 5 = 0 THEN ' hit 429 twice' ELSE '' END || '","cell_id":"C' || conv_id || '"}'
  WHEN 1 THEN '12:34:5' || turn || ' [' || CASE role WHEN 'user' THEN 'INFO' ELSE 'CRITICAL' END
    || '] [run/phase1/CELL_' || conv_id || '/ChIJ' || turn || '] svc.worker: fallback used ' || conv_id
  ELSE '  plain line ' || conv_id || CASE WHEN conv_id % 2 = 0 THEN ' Rate-Limit' ELSE ' ok' END END AS value
FROM @conversations""",
    "v_events_log": """
SELECT doc_id, 'ts-' || doc_id AS ts, 'INFO' AS level, source AS name, text AS msg, 'phase1' AS phase,
  'CELL_' || (doc_id % 97) AS cell_id, '' AS place_id
FROM @documents""",
    "v_panel": """
SELECT @spread(p_partkey) 'ChIJ' || p_partkey AS place_id,
  CASE WHEN p_partkey % 4 = 0 THEN 'https://maps.app.goo.gl/' || p_partkey END AS share_link,
  @arr('Place ' || p_partkey, CASE p_partkey % 9 WHEN 0 THEN 'SAR ' || p_size || '–' || (p_size + 20) || ' per person'
    WHEN 1 THEN 'SAR 1-20' WHEN 2 THEN 'BUS ' || p_size WHEN 3 THEN 'XYZ 10 per person' WHEN 4 THEN 'USD 1,200+…'
    WHEN 5 THEN 'MPH' || p_size || '+GJ Al Road' WHEN 6 THEN 'EUR ' || p_size || ' — 9,' || (100 + p_size)
    WHEN 7 THEN 'NSK 2022' ELSE 'TOP100' END,
    CASE WHEN p_partkey % 2 = 0 THEN 'Reported by 1,' || (100 + p_size) || ' people' ELSE 'Open' END) AS lines,
  @arr('Monday, 9 am to ' || (p_size % 12 + 1) || ' pm, Copy open hours', 'Share', CASE WHEN p_partkey % 7 = 0 THEN 'Menu' ELSE 'Tuesday,  Closed.' END,
    'Monday, again', CASE WHEN p_partkey % 3 = 0 THEN 'Fridays' ELSE 'Hello' END,
    p_size || '% busy at ' || (p_size % 12 + 1) || ' PM.', 'Sundays 6 AM 20% busy.') AS aria,
  @arr('/url?q=https%3A//www.instagram.com/p' || p_partkey || '&ved=1', 'https://www.google.com/maps/x',
    'https://Site' || p_size || '.com/a?b=1&utm_source=z#f', 'ftp://x', 'https://Site' || p_size || '.com/a?b=1',
    CASE WHEN p_partkey % 3 = 0 THEN 'ftp://y' ELSE 'https://m.facebook.com/?c=~*%20d&e=' END, 'https://t.me/x' || p_size, 'https://maps.google.com/q') AS links,
  CASE WHEN p_partkey % 10 = 0 THEN @none ELSE @arr('Overview', 'Menu', 'Reviews', 'About') END AS tabs,
  CASE WHEN p_partkey % 6 = 0 THEN NULL ELSE @struct(days = @arr(
      @arr(p_size || '% busy at 6 AM.', 'Currently 80% busy, usually ' || p_size || '% busy.', '12% busy at 11 PM.',
        'Currently 1% busy.'),
      @arr('Currently 9% busy.', '7% busy at 12 am.'), @arr('x'), @arr('3% busy at 12 PM.'), @arr('4% busy at 1 pm.'),
      @arr('5% busy at 2 pm.', '6% busy'), @arr('100% busy at 3 pm.'));
    visible = CAST(p_partkey % 8 - 1 AS INT);
    selected = CASE p_partkey % 4 WHEN 0 THEN 'Mondays' WHEN 1 THEN 'Saturdays' WHEN 2 THEN 'Wednesdays' END) END AS popular,
  CASE WHEN p_partkey % 5 = 0 THEN @arr('Burger ' || p_size, 'tasty', 'SAR ' || p_size)
    ELSE @arr('Burger ' || p_size, 'tasty', 'SAR ' || p_size, 'Fries', 'SAR 5.50', 'SAR 7', 'Burger ' || p_size,
      'SAR ' || p_size, 'Cake', 'sweet', 'soft', 'SAR 1,2' || (10 + p_size % 80)) END AS menu_lines,
  '<li>nav</li>' || CASE WHEN p_partkey % 4 = 3 THEN '' ELSE '<h2 class="s">Access</h2><ul>'
    || CASE WHEN p_partkey % 4 = 2 THEN '' ELSE '<li aria-label="Has ramp"><b>x</b></li>' END || '<li>No lift</li><li>No lift</li></ul>' END
    || CASE WHEN p_partkey % 4 = 1 THEN '' ELSE '<h2>Pay ' || (p_size % 3) || '</h2><ul><li>Cash  and ' || p_size
      || '</li><li>Does not have chips</li></ul>' END AS about_html
FROM @part""",
    "v_gallery": """
SELECT 'ChIJ' || p_partkey AS place_id, step,
  CASE WHEN k = 4 THEN NULL WHEN k = 3 THEN 'https://streetviewpixels.example/' || (step % 5)
    ELSE 'https://lh3.googleusercontent.com/i' || ((p_partkey + step * (p_partkey % 4)) % 23) || '=w' || step END AS img,
  CAST(NULL AS @text) AS vid,
  CASE k WHEN 0 THEN 'Photo - Jun 2026' WHEN 1 THEN 'Video - Jul ' || (2000 + step % 6) END AS cap,
  CASE k WHEN 2 THEN 'Image capture: May 2020' END AS attr
FROM (SELECT p_partkey, step, (p_partkey * 7 + step * (p_partkey % 3)) % 5 AS k
  FROM @part @each(step; 0; p_partkey % 31)) g""",
    "v_calls_pages": """
SELECT 'CELL_' || o_orderkey AS cell_id, o_orderpriority AS query, attempt, page, status,
  CASE status WHEN 200 THEN '{"places":[' || @join(n; i; '{"id":"' || CASE WHEN i % 9 = 0 THEN '' ELSE 'ChIJ'
      || ((o_orderkey * 3 + page * 11 + i) % modn) END || '"}') || ']' || CASE WHEN page < n_pages
      THEN ',"nextPageToken":"t' || page || '"' ELSE '' END || '}'
    WHEN 403 THEN 'API key not valid' ELSE 'oops' END AS body
FROM (SELECT o_orderkey, o_orderpriority, attempt, page, n_pages,
    CASE WHEN o_custkey % 5 = 0 THEN 10 ELSE 40 + o_custkey % 60 END AS modn,
    CASE WHEN o_orderkey % 9 = 0 AND page >= 2 THEN 0 ELSE (o_orderkey + page * 5) % 20 + 1 END AS n,
    CASE WHEN page < n_pages THEN 200 WHEN attempt < n_att THEN CASE WHEN o_custkey % 2 = 0 THEN 429 ELSE 403 END
      WHEN o_orderkey % 11 = 0 THEN 500 WHEN o_orderkey % 13 = 0 THEN 429 ELSE 200 END AS status
  FROM (SELECT *, 1 + (o_custkey + attempt) % 8 AS n_pages
    FROM (SELECT @spread(o_orderkey) *, CASE WHEN o_orderkey % 50 = 0 THEN 5 ELSE 1 + o_orderkey % 3 END AS n_att FROM @orders) a
    @each(attempt; 1; n_att)) b @each(page; 1; n_pages)) c""",
    "v_chips": """
SELECT 'S' || l_suppkey AS place_id, l_linenumber AS chip_pos,
  CASE l_linenumber WHEN 1 THEN NULL WHEN 3 THEN 'Overview' ELSE 'Chip ' || l_linenumber END AS chip,
  l_linenumber IN (4, 5, 6) AND l_suppkey % 2 = 0 AS bare, 'Item ' || (l_partkey % 50) AS name,
  CAST(l_partkey % 50 % 7 AS DOUBLE) AS price_amount
FROM @lineitem""",
    "v_harvest": """
SELECT 'CELL_' || l_suppkey AS cell_id, l_returnflag AS query, l_linenumber - 1 AS round,
  'ChIJ' || CASE WHEN l_suppkey % 2 = 0 THEN l_partkey % 5 ELSE l_partkey END AS place_id
FROM @lineitem""",
    "v_jobs": """
SELECT 'jobs/' || o_orderkey AS name, CASE WHEN o_orderkey % 23 = 0 THEN 'c' || (o_custkey % 7) || '/only'
    ELSE 'c' || (o_custkey % 7) || '/ds' || (o_custkey % 3) || '/shard_' || (o_custkey % 500) END AS display_name,
  CASE o_orderstatus WHEN 'F' THEN 'JOB_STATE_SUCCEEDED' WHEN 'O' THEN 'JOB_STATE_RUNNING'
    ELSE 'JOB_STATE_FAILED' END AS state,
  '' || CAST(o_orderdate AS DATE) || 'T00:00:00Z' AS create_time, '' || CAST(o_orderdate AS DATE) || 'T01:00:00Z' AS update_time,
  'model-' || (o_custkey % 3) AS model, CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE 'files/out-' || o_orderkey END AS dest_file,
  o_orderkey % 10 AS request_count, o_custkey % 10 AS pending_request_count,
  CASE WHEN o_orderkey % 2 = 0 THEN 'boom ' || o_orderkey END AS error
FROM @orders""",
    "v_job_files": """
SELECT 'files/' || o_orderkey AS name, 'c' || (o_custkey % 7) || '_ds' || (o_custkey % 3) || '_shard_'
  || (o_custkey % 500) || '.jsonl' AS display_name, o_orderkey * 1000 AS size_bytes
FROM @orders WHERE o_orderkey % 11 = 0""",
    "v_job_results": """
SELECT DISTINCT 'c' || (o_custkey % 7) AS client, 'ds' || (o_custkey % 3) AS dataset,
  'shard_' || (o_custkey % 500) AS shard
FROM @orders WHERE o_orderkey % 7 = 0""",
    "v_skeleton": """
SELECT 'doc-' || doc_id AS key, text AS prompt, @arr('img/hot', 'img/' || (doc_id * 7 % 2500), 'img/' || doc_id) AS images,
  @arr('img/' || doc_id) AS optional_images, doc_id
FROM @documents""",
    "v_media": """
SELECT CASE WHEN p_partkey = 0 THEN 'img/hot' ELSE 'img/' || p_partkey END AS url,
  CASE WHEN p_partkey % 6 <> 1 THEN p_name || p_partkey END AS content_text,
  CASE WHEN p_partkey % 6 = 1 THEN CASE WHEN p_partkey % 4 = 1 THEN 'HTTP 404' ELSE 'HTTP 500' END END AS error
FROM @part""",
    "v_horeca": """
SELECT 'ChIJ' || p_partkey AS place_id, @arr(
  @struct(url = 'https://lh3.googleusercontent.com/m' || p_partkey || '=w100'; date = 'Photo - Jun 2026'),
  @struct(url = CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'https://x/' || p_size || '=s50-k' END; date = ''),
  @struct(url = 'https://lh3.googleusercontent.com/n' || p_size || '=s640'; date = '')) AS menu_photos,
  p_partkey % 9 = 0 AS capture_error
FROM @part""",
    "v_boundary": """
SELECT 'B' || s_suppkey AS boundary_id, CAST(s_suppkey * 7 % 120 AS DOUBLE) - 60 AS clat,
  CAST(s_suppkey * 13 % 340 AS DOUBLE) - 170.25 AS clng, 1 + CAST(s_suppkey % 3 AS DOUBLE) / 4 AS k,
  s_suppkey % 4 = 0 AS two
FROM @supplier""",
    "v_web": """
SELECT page_id, url, html || '<a class="r" href="/maps/place/P' || page_id || '/data=!4m7!1s0x3be7:a' || page_id
  || '!8m2/@19.' || page_id || ',72.5,15z">p</a><a href="/maps/place/Q/@1.5,-2.25,9z/ChIJ' || printf('%022d', page_id)
  || '">q</a><script>["ChIJ' || printf('%022d', page_id + 1) || '","ChIJ' || printf('%022d', page_id) || '"]</script>' AS html,
  '/url?q=' || replace(replace(replace(replace(replace(url, ':', '%3A'), '?', '%3F'), '&', '%26'), '=', '%3D'), '#', '%23')
  || '&ved=x&utm_source=y' AS wrapped
FROM @pages""",
}

_DUCK = {
    "@arr(": "list_value(", "@none": "CAST([] AS VARCHAR[])", "@text": "VARCHAR",
}
_SPARK = {"@arr(": "array(", "@none": "CAST(array() AS array<string>)", "@text": "string"}
_BASE = re.compile(rf"@({'|'.join(TABLES)})\b")
_EACH = re.compile(r"@each\((\w+); ([^;]+); ([^;)]+)\)")
_STRUCT = re.compile(r"@struct\(")
_JOIN = re.compile(r"@join\((\w+); (\w+); (.*?\|\| '\"}')\)", re.S)


def _structs(text: str, spark: bool) -> str:
    """Replace `@struct(k = v; …)`, honouring nested parentheses."""
    while (m := _STRUCT.search(text)) is not None:
        depth, i = 1, m.end()
        while depth:
            depth += {"(": 1, ")": -1}.get(text[i], 0)
            i += 1
        fields = [f.strip().split(" = ", 1) for f in text[m.end():i - 1].split(";")]
        if spark:
            made = "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields) + ")"
        else:
            made = "struct_pack(" + ", ".join(f"{k} := {v}" for k, v in fields) + ")"
        text = text[: m.start()] + made + text[i:]
    return text


def _joined(m: re.Match) -> str:
    """`@join` for Spark: literals at both ends of an element go into the separator, not into every element."""
    n, i, element = m.groups()
    before, middle, after = re.fullmatch(r"'([^']*)' \|\| (.*) \|\| '([^']*)'", element, re.S).groups()
    made = f"array_join(transform(sequence(1, CAST({n} AS INT)), {i} -> {middle}), '{after},{before}')"
    return f"CASE WHEN {n} > 0 THEN '{before}' || {made} || '{after}' ELSE '' END"


def _text(view: str, spark: bool, tasks: int = 1) -> str:
    text = VIEWS[view]
    for token, form in (_SPARK if spark else _DUCK).items():
        text = text.replace(token, form)
    text = _structs(text, spark)
    if spark:
        text = _EACH.sub(r"LATERAL VIEW explode(sequence(\2, \3)) AS \1", text)
        text = _JOIN.sub(_joined, text)
        many = f"{tasks}, " if tasks > 1 else ""
        text = re.sub(r"@spread\((\w+)\)", rf"/*+ REPARTITION({many}\1) */", text)
        text = re.sub(r"@ms\((\w+)\)", r"timestamp_micros(unix_micros(CAST(\1 AS TIMESTAMP)) div 1000)", text)
        return _BASE.sub(r"pg_\1", text)
    text = _EACH.sub(r", unnest(range(\2, \3 + 1)) AS t_\1(\1)", text)
    text = _JOIN.sub(r"array_to_string(list_transform(range(1, \1 + 1), lambda \2: \3), ',')", text)
    text = re.sub(r"@spread\((\w+)\)", "", text)
    text = re.sub(r"@ms\((\w+)\)", r"make_timestamp(epoch_us(\1) // 1000)", text)
    return _BASE.sub(r"\1", text)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pieces(rows: DataFrame, size: int) -> int:
    """How many pieces of about `size` rows the rows make, at least one. A table's rows are counted from its footers."""
    return max(1, math.ceil(rows.count() / size))


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tasks = 1
    for base in dict.fromkeys(_BASE.findall(VIEWS[name])):
        rows = table(spark, sf_dir, base)
        key = SPREAD.get(name, {}).get(base)
        if key or "@spread(" in VIEWS[name]:
            tasks = max(tasks, pieces(rows, SPREAD_ROWS))
        if key and tasks > 1:
            rows = rows.repartition(tasks, key)
        rows.createOrReplaceTempView(f"pg_{base}")
    return spark.sql(_text(name, spark=True, tasks=tasks))


def with_views(body: str) -> str:
    """The oracle text with the views it names in front."""
    used = [n for n in VIEWS if re.search(rf"\b{n}\b", body)]
    ctes = ",\n".join(f"{n} AS ({_text(n, spark=False)})" for n in used)
    if not ctes:
        return body
    rest = body.strip()
    if rest.upper().startswith("WITH "):
        return f"WITH {ctes},\n{rest[5:]}"
    return f"WITH {ctes}\n{rest}"
