"""Listings, leads, search and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.functions import media as M
from placegrid.functions import values as V
from placegrid.operators import dedupe as D
from placegrid.operators import leads as L
from placegrid.operators.ordered import even_chunks
from placegrid.plans.registry import query
from placegrid.plans.views import LINE_ORDER
from placegrid.schemas import PROFILES

ORDER = ", ".join(LINE_ORDER)
LEAD_COLUMNS = (
    "id", "name", "cat", "rating", "rcount", "addr", "phone", "website", "lat", "lng",
    "image_url", "source_url", "found_via", "scraped", "side", "seq",
)

# Numbers written as text: blanks, dashes, NaN and junk are null.
_FLOAT = """CASE WHEN {0} IN ('', '—', 'N/A', 'nan') THEN NULL ELSE CAST({0} AS DOUBLE) END"""
_IMAGE = """CASE WHEN image_urls LIKE '[%' THEN replace(split_part(split_part(image_urls, '"', 2), '"', 1), '\\', '')
  WHEN contains(image_urls, ';') THEN split_part(image_urls, ';', 1)
  WHEN contains(image_urls, '|') THEN split_part(image_urls, '|', 1)
  WHEN regexp_full_match(image_urls, '[0-9]+') THEN '' ELSE image_urls END"""
_LEADS = f"""
l AS (SELECT * FROM v_listings WHERE place_id <> '' QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY {ORDER}) = 1),
d AS (SELECT * FROM v_discovered WHERE place_id <> '' QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY {ORDER}) = 1),
m AS (SELECT coalesce(l.place_id, d.place_id) AS id, l.place_id IS NOT NULL AS scraped,
    coalesce(l.name, '') AS name, coalesce(l.category, '') AS cat, coalesce(l.rating, '') AS rating,
    coalesce(l.review_count, '') AS review_count, coalesce(l.address, '') AS addr,
    nullif(l.latitude, '') AS latitude, nullif(l.longitude, '') AS longitude, d.lat AS dlat, d.lng AS dlng,
    coalesce(l.image_urls, '') AS image_urls, coalesce(l.source_url, '') AS source_url,
    coalesce(d.query, '') AS found_via, CASE WHEN l.place_id IS NULL THEN 1 ELSE 0 END AS side,
    coalesce(l.o1, d.o1) AS seq
  FROM l FULL OUTER JOIN d ON l.place_id = d.place_id),
leads AS (SELECT id, name, cat, {_FLOAT.format('rating')} AS rating,
    CAST(trunc({_FLOAT.format('review_count')}) AS BIGINT) AS rcount, addr, '' AS phone, '' AS website,
    coalesce(CAST(latitude AS DOUBLE), dlat) AS lat, coalesce(CAST(longitude AS DOUBLE), dlng) AS lng,
    {_IMAGE} AS image_url, source_url, found_via, scraped, side, seq FROM m)
"""


def _leads(t):
    return L.build_leads(t.listings, t.discovered, LINE_ORDER, LINE_ORDER)


@query("F1", f"""
SELECT place_id, cell_id, query, o1 FROM v_discovered
QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY {ORDER}) = 1""")
def first_seen(t):
    return D.first_seen(t.discovered, ["place_id"], LINE_ORDER).select("place_id", "cell_id", "query", "o1")


@query("H4", "SELECT DISTINCT place_id FROM v_discovered WHERE place_id <> ''")
def distinct_ids(t):
    return D.distinct_ids(t.discovered)


@query("D2", """
SELECT place_id, cell_id, query, o1 FROM v_discovered
WHERE place_id <> '' AND place_id NOT IN (SELECT place_id FROM v_known)""")
def anti_known(t):
    return D.anti_known(t.discovered, t.known).select("place_id", "cell_id", "query", "o1")


@query("D3 D2 F1", f"""
SELECT place_id, cell_id, query, o1 FROM v_discovered d WHERE place_id <> ''
  AND NOT EXISTS (SELECT 1 FROM v_known k WHERE k.place_id = d.place_id)
  AND NOT EXISTS (SELECT 1 FROM v_listings l WHERE l.place_id = d.place_id)
QUALIFY row_number() OVER (PARTITION BY place_id ORDER BY {ORDER}) = 1""")
def run_survivors(t):
    return D.survivors(t.discovered, t.known, t.listings, LINE_ORDER).select("place_id", "cell_id", "query", "o1")


@query("D4 C22 I15 I16 F1", f"WITH {_LEADS} SELECT * FROM leads")
def build_leads(t):
    return _leads(t).select(*LEAD_COLUMNS)


@query("H1", f"""WITH {_LEADS}
SELECT id, scraped FROM leads WHERE scraped
UNION ALL SELECT id, scraped FROM leads WHERE NOT scraped""")
def scraped_and_discovered(t):
    first = D.first_seen(D.with_id(t.listings), ["place_id"], LINE_ORDER).select(
        F.col("place_id").alias("id"), F.lit(True).alias("scraped")
    )
    rest = D.distinct_ids(t.discovered).select(F.col("place_id").alias("id"), F.lit(False).alias("scraped"))
    return first.unionByName(rest.join(first.select("id"), "id", "left_anti"))


@query("C8", f"""WITH {_LEADS}
SELECT * FROM leads WHERE contains(lower(name), 'shop 1') OR contains(lower(cat), 'shop 1')
  OR contains(lower(addr), 'shop 1')""")
def search_leads(t):
    return L.search_leads(_leads(t), " Shop 1 ").select(*LEAD_COLUMNS)


@query("G1", f"""WITH {_LEADS}
SELECT id, name, side, seq, (SELECT count(*) FROM leads) AS total FROM leads ORDER BY side, seq, id LIMIT 200 OFFSET 200""")
def lead_page(t):
    return L.lead_page(_leads(t), 1, 200).select("id", "name", "side", "seq", "total")


@query("G1", f"""
SELECT place_id, cell_id, o1, (SELECT count(*) FROM v_discovered) AS total FROM v_discovered
ORDER BY {ORDER} LIMIT 1000 OFFSET 5000""")
def deep_page(t):
    rows = t.discovered
    return L.page(rows, LINE_ORDER, 5, 1000, chunk=even_chunks(rows, "o1")).select(
        "place_id", "cell_id", "o1", "total"
    )


_EXPORT = f"""
e AS (SELECT * FROM v_listings QUALIFY place_id = '' OR row_number() OVER (PARTITION BY place_id ORDER BY {ORDER}) = 1)
"""


@query("C9 B8", f"""WITH {_EXPORT}
SELECT place_id, name, category, address, o1 FROM e
WHERE contains(lower(name || ' ' || category || ' ' || address), '5 f type road 1')""")
def export_search(t):
    return L.export_leads(t.listings, "5 f Type Road 1", LINE_ORDER).select(
        "place_id", "name", "category", "address", "o1"
    )


def _profile_sql(profile: str) -> str:
    have = {"name", "rating", "review_count", "category", "address", "latitude", "longitude", "image_urls", "source_url"}
    columns = ", ".join(f"{c}" if c in have else f"'' AS {c}" for c in PROFILES[profile])
    return f"SELECT place_id, {columns} FROM v_listings"


@query("C1 C2", _profile_sql("lean"))
def lean_profile(t):
    return L.select_profile(t.listings, "lean")


@query("C1 C2", _profile_sql("rich"))
def rich_profile(t):
    return L.select_profile(t.listings, "rich")


@query("C1", _profile_sql("reviews-only"))
def reviews_profile(t):
    return L.select_profile(t.listings, "reviews-only")


@query("C4", "SELECT place_id, name, rating FROM v_listings")
def checked_resume(t):
    have = L.selected_columns(columns=["name", "rating", "unknown"])
    rows = L.select_profile(t.listings, resume=have)
    L.check_schema(rows.columns, have)
    return rows


@query("I16", f"""
SELECT place_id, {_FLOAT.format('rating')} AS rating, CAST(trunc({_FLOAT.format('review_count')}) AS BIGINT) AS reviews
FROM v_listings""")
def coerced_numbers(t):
    return t.listings.select(
        "place_id", V.coerce_float("rating").alias("rating"), V.coerce_int("review_count").alias("reviews")
    )


@query("I15", f"SELECT place_id, o1, {_IMAGE} AS image_url FROM v_listings")
def first_images(t):
    return t.listings.select("place_id", "o1", M.first_image("image_urls").alias("image_url"))
