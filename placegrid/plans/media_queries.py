"""Images, galleries and media plans."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.functions import media as M
from placegrid.operators import media as G
from placegrid.operators.dedupe import first_seen, with_id
from placegrid.operators.state import scraped_gate
from placegrid.plans.registry import query
from placegrid.plans.views import LINE_ORDER
from placegrid.sources.writers import results_payload

_URLS = "list_filter(list_transform(string_split(image_urls, '{0}'), lambda x: trim(x)), lambda x: x <> '')"
_DEDUPED = f"""
pieces AS (SELECT place_id, o1, o2, o3, o4, o5, o6, o7, content_type, {_URLS.format(';')} AS urls FROM v_listings WHERE image_urls NOT IN ('', 'N/A')),
each AS (SELECT * EXCLUDE (urls), unnest(urls) AS url, generate_subscripts(urls, 1) AS i FROM pieces),
deduped AS (SELECT *, row_number() OVER (PARTITION BY place_id, o1, o2, o3, o4, o5, o6, o7 ORDER BY i) AS seq FROM (SELECT * FROM each
  QUALIFY row_number() OVER (PARTITION BY place_id, o1, o2, o3, o4, o5, o6, o7, split_part(url, '=', 1) ORDER BY i) = 1))"""


@query("I11 G8", f"WITH {_DEDUPED} SELECT place_id, o1, CAST(seq - 1 AS INTEGER) AS pos, url FROM deduped WHERE seq <= 50")
def deduped_image_urls(t):
    return t.listings.select("place_id", "o1", F.posexplode(M.dedupe_image_urls("image_urls")).alias("pos", "url"))


@query("I12", """
SELECT place_id, o1, u AS url FROM (SELECT place_id, o1, trim(unnest(string_split(replace(image_urls, ',', ';'), ';'))) AS u
  FROM v_listings WHERE image_urls <> 'N/A') WHERE u <> ''""")
def split_image_urls(t):
    return t.listings.select("place_id", "o1", F.explode(M.split_image_urls("image_urls")).alias("url"))


@query("C17", """
SELECT place_id, url FROM (SELECT place_id, unnest(list_transform(menu_photos, lambda p: p.url)) AS url FROM v_horeca)
WHERE contains(url, 'googleusercontent.com') AND TRY_CAST(regexp_extract(url, '=[ws]([0-9]+)', 1) AS INTEGER) >= 400""")
def large_images(t):
    urls = F.transform("menu_photos", lambda p: p["url"])
    return t.horeca.select("place_id", F.explode(M.large_images(urls)).alias("url"))


@query("I14 I18", """
SELECT place_id, o1, CASE WHEN content_type LIKE 'image/PNG%' THEN 'png' WHEN content_type = 'image/webp' THEN 'webp' ELSE 'jpg' END AS ext,
  regexp_replace(trim(name || '/é ' || address), '[^\\p{L}\\p{N}_-]', '_', 'g') AS safe FROM v_listings""")
def media_names(t):
    return t.listings.select(
        "place_id", "o1", M.ext_for_ctype("content_type").alias("ext"),
        M.safe_name(F.concat("name", F.lit("/é "), "address")).alias("safe"),
    )


@query("I19", "SELECT place_id, regexp_replace(category || ' ' || address || '!', '[^A-Za-z0-9_-]', '_', 'g') AS run_id FROM v_listings")
def safe_run_ids(t):
    text = F.concat("category", F.lit(" "), "address", F.lit("!"))
    return t.listings.select("place_id", M.safe_run_id(text).alias("run_id"))


_HORECA = """
cards AS (SELECT place_id, unnest(menu_photos) AS p, generate_subscripts(menu_photos, 1) - 1 AS seq FROM v_horeca),
menus AS (SELECT place_id, 'menu' AS kind, CAST(seq AS BIGINT) AS seq, split_part(p.url, '=', 1) || '=w2000' AS url,
  'run7/' || place_id || '/' || place_id || '_menu_' || seq || '.jpg' AS blob FROM cards WHERE p.url <> '')"""
_FIRST = """
firsts AS (SELECT * FROM v_listings WHERE place_id <> '' QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY o1, o2, o3, o4, o5, o6, o7, o8) = 1)"""
_PHOTOS = f"""{_FIRST},
f_pieces AS (SELECT place_id, content_type, {_URLS.format(';').replace('image_urls', "replace(image_urls, ',', ';')")} AS urls
  FROM firsts WHERE image_urls NOT IN ('', 'N/A')),
f_each AS (SELECT place_id, content_type, unnest(urls) AS url, generate_subscripts(urls, 1) AS i FROM f_pieces),
f_one AS (SELECT * FROM f_each QUALIFY row_number() OVER (PARTITION BY place_id, split_part(url, '=', 1) ORDER BY i) = 1),
f_num AS (SELECT *, row_number() OVER (PARTITION BY place_id ORDER BY i) AS seq FROM f_one),
photos AS (SELECT place_id, 'photo' AS kind, seq, url, 'run7/' || place_id || '/' || place_id || '_' || seq || '.'
  || CASE WHEN content_type LIKE 'image/PNG%' THEN 'png' WHEN content_type = 'image/webp' THEN 'webp' ELSE 'jpg' END AS blob
  FROM f_num WHERE seq <= 15)"""
_PLAN = f"{_PHOTOS}, {_HORECA}, plan AS (SELECT * FROM photos UNION ALL SELECT * FROM menus)"


def _firsts(t):
    return first_seen(with_id(t.listings), ["place_id"], LINE_ORDER)


def _plan(t):
    return G.plan_media(_firsts(t), t.horeca, "run7")


def _stored(plan):
    """Every blob but those whose name has an odd length."""
    return plan.filter(F.length("blob") % 2 == 0).select("place_id", "blob")


@query("F15 I20 I14 G8", f"WITH {_PHOTOS} SELECT * FROM photos")
def place_photos(t):
    return G.place_photos(_firsts(t), "run7")


@query("F15 I13 I20", f"WITH {_HORECA} SELECT * FROM menus")
def menu_photos(t):
    return G.menu_photos(t.horeca, "run7")


@query("D16 F15", f"WITH {_PLAN} SELECT * FROM plan WHERE length(blob) % 2 = 1")
def new_media(t):
    plan = _plan(t)
    return G.new_media(plan, _stored(plan))


@query("E13", f"""WITH {_PLAN}
SELECT place_id, count(*) AS expected, count(*) FILTER (length(blob) % 2 = 0) AS saved,
  count(*) FILTER (length(blob) % 2 = 0) < count(*) AS partial FROM plan GROUP BY ALL""")
def media_totals(t):
    plan = _plan(t)
    return G.media_totals(plan, _stored(plan))


_KIND = """CASE WHEN cap LIKE 'Video%' THEN 'video' WHEN img IS NULL THEN NULL
  WHEN contains(img, 'streetviewpixels') OR (cap IS NULL AND attr IS NOT NULL) THEN 'street_view' ELSE 'photo' END"""
# Signatures as lists of what came before; the third repeat in a row or the twelfth item ends a walk.
_WALK = f"""
g AS (SELECT place_id, step, cap, attr, CASE WHEN cap LIKE 'Video%' THEN NULL ELSE img END AS url, {_KIND} AS kind FROM v_gallery WHERE step < 24),
s AS (SELECT *, concat(coalesce(cap, '-'), '|', split_part(coalesce(url, ''), '=', 1)) AS sig FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY place_id, sig ORDER BY step) = 1 AS new FROM s),
e AS (SELECT *, NOT new AND NOT lag(new, 1, true) OVER w AND NOT lag(new, 2, true) OVER w AS stale,
    count(*) FILTER (new AND kind IS NOT NULL) OVER (PARTITION BY place_id ORDER BY step) AS emitted FROM n
  WINDOW w AS (PARTITION BY place_id ORDER BY step)),
x AS (SELECT place_id, min(step) AS last FROM e WHERE stale OR emitted >= 12 GROUP BY ALL),
walked AS (SELECT e.place_id, step, url, coalesce(cap, attr) AS date, kind FROM e LEFT JOIN x ON e.place_id = x.place_id
  WHERE new AND kind IS NOT NULL AND (last IS NULL OR step <= last))"""


@query("F8 I33", f"WITH {_WALK} SELECT * FROM walked")
def walk_gallery(t):
    return G.walk_gallery(t.gallery)


@query("E11 F8", f"""WITH {_WALK},
c AS (SELECT place_id, bool_or(kind IN ('photo', 'video')) AS real FROM walked GROUP BY ALL)
SELECT h.place_id, CASE WHEN real THEN 'photos' WHEN real IS NOT NULL THEN 'street_view_only'
  WHEN capture_error THEN 'unknown' ELSE 'none' END AS imagery FROM v_horeca h LEFT JOIN c ON h.place_id = c.place_id""")
def imagery_class(t):
    return G.imagery_class(t.horeca, G.walk_gallery(t.gallery))


@query("B11 I18", """
SELECT '{"run_id":"run7","place_id":"' || place_id || '","kind":"' || kind || '","attempts":' || attempts || ',"file":"'
  || place_id || '_' || kind || '.png"}' AS value
FROM (SELECT *, CASE WHEN shard % 2 = 0 THEN 'overview' ELSE 'reviews' END AS kind FROM v_results WHERE outcome = 'done')""")
def shot_manifest(t):
    kind = F.when(F.col("shard") % 2 == 0, "overview").otherwise("reviews")
    return G.shot_manifest(t.results.filter("outcome = 'done'").withColumn("kind", kind), "run7")


@query("B14 I39 I12 C11", """
SELECT place_id, o1, attempts, CASE WHEN bad THEN 'failed' ELSE 'done' END AS outcome, CASE WHEN NOT bad THEN
  '{"place_id":"' || place_id || '","name":"' || name || '","rating":"' || rating || '","review_count":"' || review_count
  || '","category":"' || category || '","address":"' || address || '","latitude":"' || latitude || '","longitude":"' || longitude
  || '","image_urls":' || to_json(image_urls) || ',"source_url":"' || source_url || '"}' END AS data,
  CASE WHEN NOT bad THEN len(CASE WHEN image_urls = 'N/A' THEN [] ELSE list_filter(string_split(replace(image_urls, ',', ';'), ';'),
    lambda x: trim(x) <> '') END) END AS n_urls,
  CASE WHEN bad THEN coalesce(nullif(error, ''), 'blank result') END AS error
FROM (SELECT *, name IN ('', 'FAILED') AS bad FROM v_listings)""")
def results_payloads(t):
    rows = results_payload(scraped_gate(t.listings), keep=["o1"])
    n_urls = F.when(F.col("outcome") == "done", F.size("image_urls")).cast("bigint")
    return rows.select("place_id", "o1", "attempts", "outcome", "data", n_urls.alias("n_urls"), "error")


_PLACE_JSON = """'{"place_id":"' || l.place_id || '","name":"' || name || '","category":"' || category || '","horeca":{"menu_photos":['
  || array_to_string(list_transform(menu_photos, lambda p: '{"url":"' || p.url || '","date":"' || p.date || '"}'), ',') || ']}}'"""


@query("I39", f"SELECT l.place_id, o1, {_PLACE_JSON} AS data FROM v_listings l JOIN v_horeca h ON l.place_id = h.place_id")
def place_json(t):
    rows = t.listings.select("place_id", "o1", "name", "category").join(t.horeca, "place_id")
    body = F.struct("place_id", "name", "category", F.struct("menu_photos").alias("horeca"))
    return rows.select("place_id", "o1", F.to_json(body).alias("data"))
