"""Panel snapshots: price, busy hours, opening hours, links, amenities, menus."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.functions import links as K
from placegrid.functions import panel as P
from placegrid.operators import panel as N
from placegrid.plans.registry import query

_CURRENCIES = ", ".join(f"'{c}'" for c in P.CURRENCIES)
_DAYS = "['Sunday', 'Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday']"
_USABLE = "len(tabs) > 0"

_PRICE = f"""
price AS (SELECT place_id, tabs, coalesce(
    list_filter(lines, lambda x: contains(lower(x), 'per person') AND regexp_matches(x, '[0-9]')
      AND NOT (regexp_matches(x, '^[A-Z]{{3}}') AND NOT list_contains([{_CURRENCIES}], left(x, 3))))[1],
    list_filter(lines, lambda x: regexp_matches(x, '^[A-Z]{{3}}\\s[0-9,]+(\\s*[–—-]\\s*[0-9,]+)?\\s*\\+?\\s*…?$')
      AND list_contains([{_CURRENCIES}], left(x, 3)))[1]) AS txt,
    list_filter(lines, lambda x: contains(x, 'Reported by'))[1] AS rep FROM v_panel),
price2 AS (SELECT place_id, txt AS price_range_text, left(txt, 3) AS price_currency,
    CAST(replace(regexp_extract(txt, '([0-9,]+)', 1), ',', '') AS DOUBLE) AS price_min,
    CAST(replace(coalesce(nullif(regexp_extract(txt, '[0-9,]+\\s*[–—-]\\s*([0-9,]+)', 1), ''),
      regexp_extract(txt, '([0-9,]+)', 1)), ',', '') AS DOUBLE) AS price_max,
    CAST(replace(regexp_extract(rep, 'by ([0-9,]+)', 1), ',', '') AS BIGINT) AS price_reported_by FROM price)
"""

# Bars of the day containers: unnested, the missing hours counted on from the last known one.
_BARS = f"""
days AS (SELECT place_id, popular.visible AS visible, popular.selected AS selected,
    unnest(popular.days) AS labels, generate_subscripts(popular.days, 1) - 1 AS di FROM v_panel WHERE popular IS NOT NULL),
labels AS (SELECT place_id, visible, selected, di, unnest(labels) AS label, generate_subscripts(labels, 1) AS li FROM days),
bars AS (SELECT place_id, di, visible, regexp_replace(selected, 's$', '') AS sel,
    row_number() OVER (PARTITION BY place_id, di ORDER BY li) AS bn,
    CAST(coalesce(nullif(regexp_extract(label, 'usually ([0-9]+)% busy', 1), ''), regexp_extract(label, '([0-9]+)% busy', 1)) AS INTEGER) AS busy_pct,
    CASE WHEN regexp_matches(label, '(?i)[0-9] (am|pm)') THEN CAST(regexp_extract(label, '(?i)([0-9]+) (am|pm)', 1) AS INTEGER) % 12
      + CASE WHEN regexp_matches(label, '(?i)[0-9] pm') THEN 12 ELSE 0 END END AS h
  FROM labels WHERE regexp_matches(label, '[0-9]+% busy')),
filled AS (SELECT *, last_value(h IGNORE NULLS) OVER w AS lh,
    last_value(CASE WHEN h IS NOT NULL THEN bn END IGNORE NULLS) OVER w AS la FROM bars
  WINDOW w AS (PARTITION BY place_id, di ORDER BY bn ROWS UNBOUNDED PRECEDING)),
popular AS (SELECT place_id, {_DAYS}[1 + ((di + CASE WHEN sel IS NOT NULL AND visible >= 0
      THEN list_position({_DAYS}, sel) - 1 - visible ELSE 0 END) % 7 + 7) % 7] AS dow, di, bn,
    CAST((lh + bn - la) % 24 AS INTEGER) AS hour_24, busy_pct FROM filled)
"""
_SELECTED = "CASE WHEN list_contains(aria, 'Fridays') THEN 'Friday' END"


@query("I3", f"WITH {_PRICE} SELECT * FROM price2")
def price_bands(t):
    return t.panel.select("place_id", P.parse_price("lines").alias("p")).select("place_id", "p.*")


@query("I5 F6 I4", f"WITH {_BARS} SELECT place_id, dow, hour_24, busy_pct FROM popular")
def popular_days(t):
    bars = t.panel.select("place_id", F.explode(P.popular_days("popular")).alias("b"))
    return bars.select("place_id", "b.*")


@query("F6", f"WITH {_BARS} SELECT place_id, CAST(di AS INTEGER) AS di, CAST(bn AS INTEGER) AS bn, hour_24, busy_pct FROM popular")
def filled_bar_hours(t):
    days = t.panel.select("place_id", F.posexplode("popular.days").alias("di", "labels"))
    bars = days.select(
        "place_id", "di",
        F.posexplode(F.filter(F.transform("labels", P.parse_bar), lambda b: b.isNotNull())).alias("bn", "b"),
    ).select("place_id", "di", (F.col("bn") + 1).alias("bn"), "b.hour", F.col("b.pct").alias("busy_pct"))
    return N.fill_bar_hours(bars, ["place_id", "di"], "bn").select("place_id", "di", "bn", "hour_24", "busy_pct")


@query("I4", """
SELECT place_id, label, CASE WHEN regexp_matches(label, '[0-9] PM|[0-9] AM') THEN CAST(regexp_extract(label, '([0-9]+) [AP]M', 1) AS INTEGER) % 12
  + CASE WHEN contains(label, 'PM') THEN 12 ELSE 0 END END AS hour_24, CAST(regexp_extract(label, '([0-9]+)% busy', 1) AS INTEGER) AS busy_pct
FROM (SELECT place_id, unnest(aria) AS label FROM v_panel) WHERE contains(label, 'busy')""")
def busy_bars(t):
    labels = t.panel.select("place_id", F.explode("aria").alias("label"))
    return labels.withColumn("b", P.parse_bar("label")).filter("b is not null").select(
        "place_id", "label", F.col("b.hour").alias("hour_24"), F.col("b.pct").alias("busy_pct")
    )


@query("I6 I7", f"""
SELECT place_id, CASE WHEN contains(label, 'Sunday') THEN 'Sunday' ELSE sel END AS dow,
  CAST(regexp_extract(label, '([0-9]+) [AP]M', 1) AS INTEGER) % 12 + CASE WHEN contains(label, 'PM') THEN 12 ELSE 0 END AS hour_24,
  CAST(regexp_extract(label, '([0-9]+)% busy', 1) AS INTEGER) AS busy_pct
FROM (SELECT place_id, {_SELECTED} AS sel, unnest(aria) AS label FROM v_panel) WHERE contains(label, 'busy')""")
def popular_flat(t):
    flat = t.panel.withColumn("day", P.selected_day("lines", "aria"))
    return flat.select("place_id", F.explode(P.popular_flat("aria", F.col("day"))).alias("b")).select("place_id", "b.*")


@query("I7", f"SELECT place_id, {_SELECTED} AS day FROM v_panel")
def selected_days(t):
    return t.panel.select("place_id", P.selected_day("lines", "aria").alias("day"))


@query("I8", """
SELECT place_id, 'Monday' AS dow, regexp_replace(aria[1], ', Copy open hours', '') AS text FROM v_panel
UNION ALL SELECT place_id, 'Tuesday', 'Tuesday, Closed' FROM v_panel WHERE CAST(substr(place_id, 5) AS BIGINT) % 7 <> 0
UNION ALL SELECT place_id, 'Friday', 'Fridays' FROM v_panel WHERE list_contains(aria, 'Fridays')""")
def opening_hours(t):
    return t.panel.select("place_id", F.explode(P.parse_hours("aria")).alias("h")).select("place_id", "h.*")


# The panel's links are built from parts, so their targets can be written out.
@query("C14 I1 I2", """
WITH s AS (SELECT place_id, substr(place_id, 5) AS n, regexp_extract(links[3], 'Site([0-9]+)', 1) AS size FROM v_panel)
SELECT place_id, CAST(0 AS INTEGER) AS pos, 'instagram' AS kind, 'https://www.instagram.com/p' || n AS url FROM s
UNION ALL SELECT place_id, 1, 'website', 'https://Site' || size || '.com/a?b=1' FROM s
UNION ALL SELECT place_id, 2, 'facebook', 'https://m.facebook.com/?c=~%2A+d' FROM s WHERE CAST(n AS BIGINT) % 3 <> 0
UNION ALL SELECT place_id, CASE WHEN CAST(n AS BIGINT) % 3 = 0 THEN 2 ELSE 3 END, 'telegram', 'https://t.me/x' || size FROM s""")
def outbound_links(t):
    return t.panel.select("place_id", F.posexplode(P.outbound_links("links")).alias("pos", "l")).select(
        "place_id", "pos", "l.*"
    )


_TARGET = "url_decode(regexp_extract(wrapped, 'q=([^&]*)', 1))"


@query("I1 I2", f"""
WITH u AS (SELECT page_id, regexp_extract({_TARGET}, '^([^?#]*)', 1) AS stem, regexp_extract({_TARGET}, '\\?([^#]*)', 1) AS q FROM v_web),
k AS (SELECT page_id, stem, list_filter(string_split(q, '&'), lambda x: regexp_matches(x, '^[^=]*=.')
    AND NOT regexp_matches(x, '^(fbclid|opi|sa|ved|usg|gclid|_aem|ltsid|igsh|igshid|utm_[a-z]+)=')) AS kept FROM u)
SELECT page_id, stem || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url,
  'website' AS kind FROM k""")
def unwrapped_links(t):
    return t.web.select("page_id", K.unwrap_url("wrapped").alias("url")).withColumn("kind", K.classify_link("url"))


_AMENITIES = """
about AS (SELECT place_id, tabs, CAST(substr(place_id, 5) AS BIGINT) % 4 AS k, regexp_extract(about_html, 'Pay ([0-9])', 1) AS pay, regexp_extract(about_html, 'and ([0-9]+)', 1) AS n FROM v_panel),
said AS (SELECT place_id, tabs, 0 AS rank, 'Access' AS section, 'Has ramp' AS item, true AS present FROM about WHERE k IN (0, 1)
  UNION ALL SELECT place_id, tabs, 1, 'Access', 'No lift', false FROM about WHERE k <> 3
  UNION ALL SELECT place_id, tabs, 2, 'Pay ' || pay, 'Cash and ' || n, true FROM about WHERE k <> 1
  UNION ALL SELECT place_id, tabs, 3, 'Pay ' || pay, 'Does not have chips', false FROM about WHERE k <> 1),
amenities AS (SELECT place_id, tabs, CAST(row_number() OVER (PARTITION BY place_id ORDER BY rank) - 1 AS INTEGER) AS pos, section, item, present FROM said)
"""


@query("I30", f"""WITH {_AMENITIES}
SELECT place_id, section, item AS label FROM amenities
UNION ALL SELECT place_id, section, item FROM amenities WHERE item = 'No lift'""")
def about_items(t):
    return t.panel.select("place_id", F.explode(P.about_items("about_html")).alias("a")).select("place_id", "a.*")


@query("I9 I30", f"WITH {_AMENITIES} SELECT place_id, pos, section, item, present FROM amenities")
def amenities(t):
    rows = t.panel.select(
        "place_id", F.posexplode(P.normalize_amenities(P.about_items("about_html"))).alias("pos", "a")
    )
    return rows.select("place_id", "pos", "a.*")


_MENU = """
size AS (SELECT place_id, tabs, len(menu_lines) > 3 AS long, regexp_extract(menu_lines[1], '([0-9]+)', 1) AS n, regexp_extract(menu_lines[12], '1,2([0-9]+)', 1) AS m FROM v_panel),
menu AS (SELECT place_id, tabs, CAST(0 AS INTEGER) AS pos, 'Burger ' || n AS name, 'tasty' AS description, CAST(n AS DOUBLE) AS price_amount, 'SAR ' || n AS price FROM size
  UNION ALL SELECT place_id, tabs, 1, 'Fries', NULL, 5.0, 'SAR 5.50' FROM size WHERE long
  UNION ALL SELECT place_id, tabs, 2, 'Cake', 'sweet', CAST('12' || m AS DOUBLE), 'SAR 1,2' || m FROM size WHERE long)
"""


@query("I31", f"WITH {_MENU} SELECT place_id, name, description, price FROM menu")
def menu_rows(t):
    return t.panel.select("place_id", F.explode(P.menu_rows("menu_lines")).alias("m")).select("place_id", "m.*")


@query("I10 I31", f"WITH {_MENU} SELECT place_id, pos, name, description, 'SAR' AS currency, price_amount FROM menu")
def menu_items(t):
    rows = t.panel.select(
        "place_id", F.posexplode(P.normalize_menu(P.menu_rows("menu_lines"))).alias("pos", "m")
    )
    return rows.select("place_id", "pos", "m.*")


@query("C18", f"SELECT place_id, NOT ({_USABLE}) AS degraded FROM v_panel")
def degraded_panels(t):
    return N.flag_degraded(t.panel).select("place_id", "degraded")


@query("C20 C18 I3 I5 I6 I8 C14 I9 I10", f"""WITH {_PRICE}, {_BARS}, {_AMENITIES}, {_MENU},
bar_counts AS (SELECT place_id, count(*) AS n FROM popular GROUP BY ALL),
amenity_counts AS (SELECT place_id, count(*) AS n FROM amenities GROUP BY ALL),
menu_counts AS (SELECT place_id, count(*) AS n FROM menu GROUP BY ALL)
SELECT v.place_id, CASE WHEN {_USABLE.replace('tabs', 'v.tabs')} THEN price_range_text END AS price_range_text,
  CASE WHEN len(v.tabs) > 0 THEN price_min END AS price_min, CASE WHEN len(v.tabs) > 0 THEN price_max END AS price_max,
  CASE WHEN len(v.tabs) > 0 THEN price_currency END AS price_currency,
  CASE WHEN len(v.tabs) > 0 THEN price_reported_by END AS price_reported_by, v.share_link, len(v.tabs) > 0 AS has_menu_tab,
  CAST(CASE WHEN len(v.tabs) > 0 THEN m.n ELSE 0 END AS INTEGER) AS menu_item_count, len(v.tabs) > 0 AS has_popular_times,
  len(v.tabs) > 0 AS has_web_results, len(v.tabs) > 0 AS hours_captured,
  CAST(CASE WHEN len(v.tabs) = 0 THEN 0 WHEN v.popular IS NULL THEN 2 ELSE b.n END AS BIGINT) AS bars,
  CAST(CASE WHEN len(v.tabs) > 0 THEN a.n ELSE 0 END AS BIGINT) AS amenities
FROM v_panel v JOIN price2 p ON v.place_id = p.place_id LEFT JOIN bar_counts b ON v.place_id = b.place_id
LEFT JOIN amenity_counts a ON v.place_id = a.place_id LEFT JOIN menu_counts m ON v.place_id = m.place_id""")
def attribute_rows(t):
    rows = N.attribute_rows(N.enrich_panel(t.panel))

    def some(name: str):
        return F.greatest(F.coalesce(F.size(name), F.lit(0)), F.lit(0)).cast("bigint")

    return rows.select(
        "place_id", "price_range_text", "price_min", "price_max", "price_currency", "price_reported_by",
        "share_link", "has_menu_tab", "menu_item_count", "has_popular_times", "has_web_results", "hours_captured",
        some("popular_times").alias("bars"), some("amenities").alias("amenities"),
    )


@query("C14 I10", f"""WITH {_MENU}
SELECT place_id, pos, name, description, 'SAR' AS currency, price_amount FROM menu WHERE {_USABLE}""")
def menu_child_rows(t):
    return N.child_rows(N.enrich_panel(t.panel), "menu_items")


# The walk step by step: a chip counts as empty when every (name, price) on it was seen before it.
@query("F12", """
WITH chips AS (SELECT DISTINCT place_id, chip_pos, chip FROM v_chips WHERE chip IS NULL OR chip <> 'Overview'),
items AS (SELECT DISTINCT c.place_id, c.chip_pos, c.chip, v.name, v.price_amount FROM chips c JOIN v_chips v
  ON c.place_id = v.place_id AND c.chip_pos = v.chip_pos WHERE NOT v.bare),
firsts AS (SELECT place_id, name, price_amount, min(chip_pos) AS chip_pos FROM items GROUP BY ALL),
fresh AS (SELECT c.place_id, c.chip_pos, c.chip, count(f.name) AS n FROM chips c LEFT JOIN firsts f
  ON c.place_id = f.place_id AND c.chip_pos = f.chip_pos GROUP BY ALL),
marked AS (SELECT *, n = 0 AND chip IS NOT NULL AS e FROM fresh),
runs AS (SELECT *, e AND lag(e, 1, false) OVER w AND lag(e, 2, false) OVER w AS third FROM marked
  WINDOW w AS (PARTITION BY place_id ORDER BY chip_pos)),
ends AS (SELECT place_id, min(chip_pos) AS last FROM runs WHERE third GROUP BY ALL)
SELECT f.place_id, f.chip_pos, f.name, f.price_amount, left(c.chip, 100) AS category FROM firsts f
JOIN chips c ON f.place_id = c.place_id AND f.chip_pos = c.chip_pos LEFT JOIN ends e ON f.place_id = e.place_id
WHERE e.last IS NULL OR f.chip_pos <= e.last""")
def walk_menu(t):
    item = F.struct("name", F.lit("d").alias("description"), F.lit("SAR").alias("currency"), "price_amount")
    items = F.when(~F.col("bare"), F.array(item)).otherwise(F.filter(F.array(item), lambda x: F.lit(False)))
    return N.walk_menu(t.chips.select("place_id", "chip_pos", "chip", items.alias("items"))).select(
        "place_id", "chip_pos", "name", "price_amount", "category"
    )
