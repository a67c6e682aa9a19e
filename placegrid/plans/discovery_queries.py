"""Stored search pages: attempts, pagination, novelty and cell outcomes."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.functions import links as K
from placegrid.functions import outcomes as O
from placegrid.functions import values as V
from placegrid.operators import discovery as C
from placegrid.operators.dedupe import anti_known, first_seen, with_id
from placegrid.operators.state import latest_cells
from placegrid.plans.registry import query
from placegrid.session import stored
from placegrid.plans.views import LINE_ORDER

ORDER = ", ".join(LINE_ORDER)

_PAGES = """
p AS (SELECT cell_id, query, attempt, page, status, body,
    status IN (400, 401, 403) AND contains(lower(body), 'api key not valid') AS auth_failed,
    CASE WHEN status = 200 THEN CAST(json_extract(body, '$.places[*].id') AS JSON[]) ELSE CAST([] AS JSON[]) END AS raw,
    status = 200 AND contains(body, 'nextPageToken') AS has_next FROM v_calls_pages),
pages AS (SELECT cell_id, query, attempt, page, status, auth_failed, CAST(len(raw) AS INTEGER) AS results,
    list_filter(list_transform(raw, lambda x: x ->> '$'), lambda x: x <> '') AS ids, has_next FROM p)
"""
_LAST = f"""{_PAGES},
last_pages AS (SELECT * FROM pages WHERE attempt <= 4
  QUALIFY attempt = max(attempt) OVER (PARTITION BY cell_id, query))
"""
# First appearance of every id in a call, found through the exploded ids.
_NOVEL = """,
flat AS (SELECT cell_id, query, attempt, page, unnest(ids) AS id FROM {0} WHERE {1}),
firsts AS (SELECT cell_id, query, attempt, id, min(page) AS page FROM flat GROUP BY ALL),
news AS (SELECT cell_id, query, attempt, page, count(*) AS n FROM firsts GROUP BY ALL),
novel AS (SELECT s.*, CAST(coalesce(n.n, 0) AS INTEGER) AS new_ids FROM {0} s LEFT JOIN news n
  ON s.cell_id = n.cell_id AND s.query = n.query AND s.attempt = n.attempt AND s.page = n.page WHERE {1})
"""
# Two pages in a row: the flag now and on the page before (a call's first page has none before).
_STOPS = """,
flags AS (SELECT *, results = 0 AS empty, new_ids < 3 AS low,
    CASE WHEN results > 0 THEN new_ids / results < 0.15 ELSE true END AS sat FROM novel),
pairs AS (SELECT *, empty AND coalesce(lag(empty) OVER w, false) AS empty2, low AND coalesce(lag(low) OVER w, false) AS low2,
    sat AND coalesce(lag(sat) OVER w, false) AS sat2 FROM flags
  WINDOW w AS (PARTITION BY cell_id, query, attempt ORDER BY page)),
whys AS (SELECT *, CASE WHEN status <> 200 THEN 'error' WHEN NOT has_next THEN 'end' WHEN page >= 6 THEN 'max_pages'
    WHEN empty2 THEN 'empty_streak' WHEN page >= 3 AND low2 THEN 'low_yield' WHEN sat2 THEN 'saturation' END AS why FROM pairs),
stops AS (SELECT cell_id, query, attempt, min(page) AS stop_page, arg_min(why, page) AS why FROM whys
  WHERE why IS NOT NULL GROUP BY ALL),
kept AS (SELECT w.* EXCLUDE (why), coalesce(s.stop_page, max(w.page) OVER (PARTITION BY w.cell_id, w.query, w.attempt)) AS stop_page,
    CASE WHEN s.why NOT IN ('end', 'error') THEN s.why END AS stop_reason
  FROM whys w LEFT JOIN stops s ON w.cell_id = s.cell_id AND w.query = s.query AND w.attempt = s.attempt
  WHERE s.stop_page IS NULL OR w.page <= s.stop_page)
"""
_KEPT = _LAST + _NOVEL.format("last_pages", "s.page <= 6").replace("WHERE s.page <= 6),", "WHERE page <= 6),") + _STOPS
_CALLS = _KEPT + """,
calls AS (SELECT cell_id, query, count(*) FILTER (status = 200) AS ok_count, min(CASE WHEN status <> 200 THEN status END) AS fail_code,
    max(stop_page) AS stop_page, max(stop_reason) AS stop_reason, CAST(sum(new_ids) AS BIGINT) AS found FROM kept GROUP BY ALL)
"""


def _last(t):
    # superseded attempts are dropped unparsed
    return C.call_pages(C.last_attempt(t.calls_pages))


@query("A18", f"""WITH {_PAGES}
SELECT cell_id, query, attempt, page, CAST(pos - 1 AS INTEGER) AS pos, ids[pos] AS place_id
FROM (SELECT *, unnest(range(1, len(ids) + 1)) AS pos FROM pages)""")
def page_ids(t):
    return C.page_ids(t.calls_pages)


@query("F17", f"WITH {_LAST} SELECT cell_id, query, attempt, page, status FROM last_pages")
def last_attempt(t):
    return _last(t).select("cell_id", "query", "attempt", "page", "status")


@query("F3", f"WITH {_PAGES}{_NOVEL.format('pages', 'true')} SELECT cell_id, query, attempt, page, results, new_ids FROM novel")
def page_novelty(t):
    return C.page_novelty(C.call_pages(t.calls_pages, gather=True)).select(
        "cell_id", "query", "attempt", "page", "results", "new_ids"
    )


@query("F2 F17", f"""WITH {_KEPT}
SELECT cell_id, query, attempt, page, results, new_ids, stop_page, stop_reason FROM kept""")
def paginate_early_stop(t):
    return C.paginate(_last(t)).select(
        "cell_id", "query", "attempt", "page", "results", "new_ids", "stop_page", "stop_reason"
    )


@query("F2", f"""WITH {_KEPT}
SELECT coalesce(stop_reason, 'none') AS stop_reason, stop_page, count(DISTINCT (cell_id, query)) AS calls FROM kept GROUP BY 1, 2""")
def stop_reasons(t):
    calls = C.call_summary(C.paginate(_last(t)))
    return calls.groupBy(F.coalesce("stop_reason", F.lit("none")).alias("stop_reason"), "stop_page").agg(
        F.count(F.lit(1)).alias("calls")
    )


_CELL_RESULTS = f"""WITH {_CALLS},
ids AS (SELECT cell_id, query, page, unnest(ids) AS place_id, unnest(range(len(ids))) AS pos FROM kept),
firsts2 AS (SELECT DISTINCT cell_id, query, place_id FROM ids),
fresh AS (SELECT * FROM firsts2 WHERE place_id NOT IN (SELECT place_id FROM v_known)
  QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY cell_id, query) = 1),
counts AS (SELECT cell_id, query, count(*) AS n FROM fresh GROUP BY ALL)
SELECT c.cell_id, c.query,
  CASE WHEN fail_code = 429 OR (fail_code IS NOT NULL AND ok_count = 0) THEN 'failed' ELSE 'done' END AS status,
  CASE WHEN fail_code IS NULL THEN 'done' WHEN fail_code = 429 OR ok_count = 0 THEN 'failed' ELSE 'partial' END AS stats_status,
  CASE WHEN fail_code <> 429 AND ok_count = 0 THEN 0 ELSE coalesce(n, 0) END AS place_count,
  CASE WHEN fail_code IS NULL THEN '' WHEN fail_code = 429 THEN 'all key attempts rate-limited (HTTP 429)'
    WHEN ok_count = 0 THEN 'No Places API coverage: HTTP ' || fail_code
    ELSE 'Partial Places API result: HTTP ' || fail_code END AS error_msg
FROM calls c LEFT JOIN counts n ON c.cell_id = n.cell_id AND c.query = n.query"""


@query("I24 F2 F17 E19", _CELL_RESULTS)
def cell_results(t):
    # read twice: the pages are parsed and shuffled once
    kept = stored(C.paginate(_last(t)), "pages")
    fresh = anti_known(first_seen(C.discovered_rows(kept), ["place_id"], ["cell_id", "query", "page", "pos"]), t.known)
    return C.cell_results(C.call_summary(kept), C.cell_place_counts(fresh))


# The whole way of a searched cell: planned, searched, paged, new ids counted, written to its state.
@query("D1 F2 F17 I24 E19 G9", f"""WITH res AS ({_CELL_RESULTS})
SELECT 'CELL_' || o_orderkey AS cell_id, o_orderpriority AS query, coalesce(r.status, 'queued') AS status,
  CASE WHEN r.cell_id IS NULL THEN 't0' ELSE 't1' END AS last_attempted_at, coalesce(place_count, 0) AS place_count, coalesce(error_msg, '') AS error_msg
FROM orders o LEFT JOIN res r ON r.cell_id = 'CELL_' || o.o_orderkey AND r.query = o.o_orderpriority""")
def discovery_to_state(t):
    planned = t.base("orders").select(
        F.concat(F.lit("CELL_"), F.col("o_orderkey").cast("string")).alias("cell_id"), F.col("o_orderpriority").alias("query"),
        F.lit("queued").alias("status"), F.lit("t0").alias("last_attempted_at"), F.lit(None).cast("bigint").alias("place_count"),
        F.lit(None).cast("string").alias("error_msg"), F.lit(0).alias("seq"),
    )
    found = cell_results(t).withColumns({"last_attempted_at": F.lit("t1"), "seq": F.lit(1)}).select(planned.columns)
    return latest_cells(planned.unionByName(found), ["cell_id", "query"], ["seq"])


@query("E7 I24", f"""WITH {_CALLS}
SELECT count(*) FILTER (s <> 'failed') AS cells_done, count(*) FILTER (s = 'failed') AS cells_failed,
  count(*) FILTER (s = 'partial') AS cells_partial
FROM (SELECT CASE WHEN fail_code IS NULL THEN 'done' WHEN fail_code = 429 OR ok_count = 0 THEN 'failed' ELSE 'partial' END AS s
  FROM calls)""")
def cell_outcomes(t):
    outcome = O.cell_outcome("fail_code", "ok_count")
    return C.outcome_totals(C.call_summary(C.paginate(_last(t))).select(outcome["stats_status"].alias("stats_status")))


@query("E19 F1", f"""
SELECT cell_id, query, count(*) AS place_count FROM (SELECT cell_id, query FROM v_discovered WHERE place_id <> ''
  QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY {ORDER}) = 1) GROUP BY ALL""")
def cell_place_counts(t):
    return C.cell_place_counts(first_seen(with_id(t.discovered), ["place_id"], LINE_ORDER))


# Brute force: seen-count per round, then the second repeat of the same count.
@query("F13", """
WITH rounds AS (SELECT cell_id, query, unnest(range(0, 8)) AS round FROM (SELECT DISTINCT cell_id, query FROM v_harvest)),
firsts AS (SELECT cell_id, query, place_id, min(round) AS round FROM v_harvest GROUP BY ALL),
seen AS (SELECT r.cell_id, r.query, r.round, count(f.place_id) AS n FROM rounds r LEFT JOIN firsts f
  ON r.cell_id = f.cell_id AND r.query = f.query AND f.round <= r.round GROUP BY ALL),
flat AS (SELECT *, n = lag(n, 1, -1) OVER w AND lag(n, 1, -1) OVER w = lag(n, 2, -1) OVER w AS stop FROM seen
  WINDOW w AS (PARTITION BY cell_id, query ORDER BY round)),
stops AS (SELECT cell_id, query, CAST(coalesce(min(round) FILTER (stop), 7) AS INTEGER) AS stop_round FROM flat GROUP BY ALL)
SELECT f.cell_id, f.query, f.place_id, f.round, s.stop_round FROM firsts f JOIN stops s
  ON f.cell_id = s.cell_id AND f.query = s.query WHERE f.round <= s.stop_round""")
def scroll_plateau(t):
    return C.scroll_plateau(t.harvest)


@query("F16", """
WITH c AS (SELECT o_custkey AS pos, count(*) AS place_count FROM orders GROUP BY ALL)
SELECT pos, place_count FROM (SELECT *, coalesce(sum(place_count) OVER (ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)
  AS before FROM c) WHERE before < 9000""")
def cap_places(t):
    cells = t.base("orders").groupBy(F.col("o_custkey").alias("pos")).agg(F.count(F.lit(1)).alias("place_count"))
    return C.cap_places(cells, 9000, "pos")


@query("C5", """
SELECT place_id, cell_id, o1, lat, lng FROM v_discovered
WHERE lat IS NULL OR lng IS NULL OR (lat BETWEEN 12 AND 18 AND lng BETWEEN 72 AND 80)""")
def in_bbox(t):
    box = {"bbox_south": 12.0, "bbox_north": 18.0, "bbox_west": 72.0, "bbox_east": 80.0}
    return C.in_bbox(t.discovered.withColumns({k: F.lit(v) for k, v in box.items()})).select(
        "place_id", "cell_id", "o1", "lat", "lng"
    )


_BOXES = """
cells AS (SELECT 'CELL_' || s_suppkey AS cell_id, 10 + CAST(s_suppkey % 9 AS DOUBLE) AS s, 15 + CAST(s_suppkey % 9 AS DOUBLE) AS n,
  70 + CAST(s_suppkey % 7 AS DOUBLE) AS w, 80 + CAST(s_suppkey % 7 AS DOUBLE) AS e FROM supplier)"""


def _cells(t):
    key = F.col("s_suppkey")
    return t.base("supplier").select(
        F.concat(F.lit("CELL_"), key.cast("string")).alias("cell_id"),
        (10 + key % 9).cast("double").alias("bbox_south"), (15 + key % 9).cast("double").alias("bbox_north"),
        (70 + key % 7).cast("double").alias("bbox_west"), (80 + key % 7).cast("double").alias("bbox_east"),
        (12 + key % 9).cast("double").alias("centroid_lat"), (75 + key % 7).cast("double").alias("centroid_lon"),
    )


@query("D17 C5", f"""WITH {_BOXES}
SELECT d.place_id, d.cell_id, d.o1 FROM v_discovered d JOIN cells c ON d.cell_id = c.cell_id
WHERE lat IS NULL OR lng IS NULL OR (lat BETWEEN s AND n AND lng BETWEEN w AND e)""")
def places_in_cell(t):
    return C.places_in_cell(t.discovered, _cells(t)).select("place_id", "cell_id", "o1")


@query("C24", f"""WITH {_BOXES},
work AS (SELECT c.*, q.query FROM cells c, (SELECT unnest(['cafe', 'gym "A"']) AS query) q)
SELECT cell_id, query, '{{"textQuery":' || to_json(query) || ',"languageCode":"en","regionCode":"IN","locationRestriction":'
  || '{{"rectangle":{{"low":{{"latitude":' || s || ',"longitude":' || w || '}},"high":{{"latitude":' || n || ',"longitude":' || e
  || '}}}}}}}}' AS body FROM work""")
def search_requests(t):
    nothing = t.spark.createDataFrame([], "cell_id string, query string")
    return C.search_requests(C.plan_work(_cells(t), ["cafe", 'gym "A"'], nothing), 1000, restrict=True)


@query("C24", f"""WITH {_BOXES}
SELECT cell_id, 'cafe' AS query, '{{"textQuery":"cafe","languageCode":"en","regionCode":"IN","locationBias":{{"circle":{{"center":'
  || '{{"latitude":' || (s + 2) || ',"longitude":' || (w + 5) || '}},"radius":1000.0}}}}}}' AS body FROM cells""")
def biased_search_requests(t):
    nothing = t.spark.createDataFrame([], "cell_id string, query string")
    return C.search_requests(C.plan_work(_cells(t), ["cafe"], nothing), 1000, restrict=False)


@query("I23", """
SELECT event_id, status IN (400, 401, 403) AND contains(lower(body), 'api key not valid') AS auth FROM v_calls""")
def auth_errors(t):
    return t.calls.select("event_id", O.is_auth_error("status", "body").alias("auth"))


@query("I28 I29", """
SELECT place_id, o1, CASE WHEN place_id LIKE 'ChIJ%' THEN 'ChIJ' ELSE 'places_api' END AS form,
  CASE WHEN lat IS NULL THEN '' ELSE printf('%.7f', lat) END AS lat FROM v_discovered""")
def id_forms(t):
    return t.discovered.select(
        "place_id", "o1", K.id_form("place_id").alias("form"), V.fmt_coord("lat").alias("lat")
    )


@query("I17", """
SELECT place_id, 'https://www.google.com/maps/place/?q=place_id:' || place_id AS place_url,
  'https://www.google.com/maps/search/' || replace(replace(url_encode('Road & ' || address), '%20', '+'), '*', '%2A')
  || '/@19,72.5,15z' AS search_url FROM v_listings""")
def built_urls(t):
    query_text = F.concat(F.lit("Road & "), F.col("address"))
    return t.listings.select(
        "place_id", K.place_url("place_id").alias("place_url"),
        K.search_url(query_text, F.lit("19"), F.lit("72.5")).alias("search_url"),
    )


@query("I21 I27 I28 I29 A17", """
WITH ids AS (SELECT page_id, '0x3be7:a' || page_id AS place_id, '0x' AS form, printf('%.7f', CAST('19.' || page_id AS DOUBLE)) AS lat, '72.5000000' AS lng FROM v_web
UNION ALL SELECT page_id, 'ChIJ' || printf('%022d', page_id), 'ChIJ', '1.5000000', '-2.2500000' FROM v_web
UNION ALL SELECT page_id, 'ChIJ' || printf('%022d', page_id + 1), 'ChIJ', '', '' FROM v_web)
SELECT * FROM ids""")
def parse_discovery(t):
    return C.parse_discovery(t.web, "page_id", "html")


@query("C5 I21 I27", """
SELECT page_id, '0x3be7:a' || page_id AS place_id, '0x' AS form, printf('%.7f', CAST('19.' || page_id AS DOUBLE)) AS lat, '72.5000000' AS lng FROM v_web
UNION ALL SELECT page_id, 'ChIJ' || printf('%022d', page_id), 'ChIJ', '', '' FROM v_web
UNION ALL SELECT page_id, 'ChIJ' || printf('%022d', page_id + 1), 'ChIJ', '', '' FROM v_web""")
def parse_discovery_in_box(t):
    box = {"bbox_south": 10.0, "bbox_north": 20.0, "bbox_west": 70.0, "bbox_east": 80.0}
    return C.parse_discovery(t.web.withColumns({k: F.lit(v) for k, v in box.items()}), "page_id", "html")


@query("I27", """
SELECT page_id, place_id FROM (SELECT page_id, unnest(list_distinct(regexp_extract_all(html, 'ChIJ[A-Za-z0-9_-]{20,}'))) AS place_id FROM v_web)""")
def long_ids(t):
    return t.web.select("page_id", F.explode(K.long_ids("html")).alias("place_id"))


