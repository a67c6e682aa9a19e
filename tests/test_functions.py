"""Known texts and what they mean."""

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from placegrid.functions import geo as Z
from placegrid.functions import links as K
from placegrid.functions import media as M
from placegrid.functions import outcomes as O
from placegrid.functions import panel as P
from placegrid.functions import values as V
from placegrid.operators import grid as G
from placegrid.operators import leads as L
from placegrid.sources import readers as R


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


def texts(*values):
    return F.array(*[F.lit(v) for v in values])


@pytest.mark.parametrize("line, band", [
    # The accepted and rejected texts of the golden check, as they are.
    ("SAR 20–40 per person", (20, 40)), ("SAR 1-20 per person", (1, 20)), ("SAR 20–40", (20, 40)),
    ("SAR 120–140…", (120, 140)), ("SAR 200+…", (200, 200)),
    ("BUS 253", None), ("FOX 16", None), ("NSK 2022", None), ("MBS 1", None),
    ("MPH6+GJ Al Wizarat, Riyadh Saudi Arabia", None),
    ("HQV4+3X9, Al Aziziyah, Riyadh 14512, Saudi Arabia", None),
    ("OYO 165 Orchida Al Hamra", None), ("TOP100", None), ("BDR222", None),
    ("JHR4+RGQ, Dhahrat Laban, Riyadh 13782, Saudi Arabia", None),
    # Further cases.
    ("SAR 1,000 — 2,500", (1000, 2500)), ("XYZ 10-20 per person", None), ("from 10 – 20 per person", (10, 20)),
])
def test_price(spark, line, band):
    got = one(spark, P.parse_price(texts("Overview", line)))
    assert (got.price_min, got.price_max) == (band or (None, None))
    assert (got.price_range_text is None) == (band is None)


def test_price_prefers_the_reliable_line(spark):
    got = one(spark, P.parse_price(texts("USD 1–2", "SAR 5–9 per person", "Reported by 1,267 people")))
    assert (got.price_currency, got.price_min, got.price_reported_by) == ("SAR", 5.0, 1267)


@pytest.mark.parametrize("raw, url", [
    ("/url?q=https%3A//x.com/y&fbclid=..", "https://x.com/y"),
    ("https://www.google.com/url?q=http://a.b/c?d=1%26utm_source=z&ved=1", "http://a.b/c?d=1"),
    ("https://www.google.com/url?ved=1", None), ("mailto:x@y", None), ("  ", None),
    ("HTTP://A.com/p?b=&c=~*+d#frag", "http://A.com/p?c=~%2A+d"), ("https://a.com", "https://a.com"),
    ("https://a.com/?k=%zz", "https://a.com/?k=%25zz"),
])
def test_unwrap(spark, raw, url):
    assert one(spark, K.unwrap_url(F.lit(raw))) == url


@pytest.mark.parametrize("url, kind", [
    ("https://meta.com/x", "website"), ("https://t.me/x", "telegram"), ("https://m.facebook.com", "facebook"),
    ("https://api.whatsapp.com/send", "whatsapp"), ("https://X.com/a", "x"), ("https://notx.com", "website"),
])
def test_link_kind(spark, url, kind):
    assert one(spark, K.classify_link(F.lit(url))) == kind


@pytest.mark.parametrize("label, want", [
    ("37% busy at 4 am.", (4, 37)), ("Currently 80% busy, usually 43% busy.", (None, 43)),
    ("Tuesdays 6 PM 20% busy.", (18, 20)), ("12 AM 3% busy", (0, 3)), ("Mondays", None),
])
def test_bar(spark, label, want):
    got = one(spark, P.parse_bar(F.lit(label)))
    assert (None if got is None else (got.hour, got.pct)) == want


def test_popular_days_are_anchored_and_filled(spark):
    block = F.struct(
        F.array(texts("5% busy at 11 PM.", "Currently 9% busy.", "x"), texts("7% busy"), *[texts("z")] * 5).alias("days"),
        F.lit(1).alias("visible"), F.lit("Fridays").alias("selected"),
    )
    rows = one(spark, P.popular_days(block))
    assert [(r.dow, r.hour_24, r.busy_pct) for r in rows] == [
        ("Thursday", 23, 5), ("Thursday", 0, 9), ("Friday", None, 7)
    ]


def test_hours_and_selected_day(spark):
    labels = texts("Tuesday, 6 am to 1 am, Copy open hours", "Tuesday, again", "Fridays 6 AM 20% busy.", "Sunday, Closed.")
    rows = one(spark, P.parse_hours(labels))
    assert [(r.dow, r.text) for r in rows] == [("Tuesday", "Tuesday, 6 am to 1 am"), ("Sunday", "Sunday, Closed")]
    assert one(spark, P.selected_day(texts("Mondays"), texts("Share", " tuesdays "))) == "Tuesday"
    assert one(spark, P.selected_day(texts("x"), texts("Wednesday, open"))) is None


def test_amenities(spark):
    html = ('<li>nav</li><h2>Access</h2><ul><li aria-label="Has ramp"><b>q</b></li><li>Lift</li>'
            "<li>No  stairs</li><li>Has ramp</li></ul><h2> </h2><li>lost</li>")
    rows = one(spark, P.normalize_amenities(P.about_items(F.lit(html))))
    assert [(r.section, r.item, r.present) for r in rows] == [
        ("Access", "Has ramp", True), ("Access", "Lift", False), ("Access", "No stairs", False)
    ]


def test_icon_glyphs_carry_the_polarity(spark):
    rows = F.array(*[
        F.struct(F.lit(" Service ").alias("section"), F.lit(label).alias("label"))
        for label in ("\ue5cd Delivery", "\ue5ca\ue033 Wi-fi", "\ue5ca", "Isn't open late", "  ")
    ])
    got = one(spark, P.normalize_amenities(rows))
    assert [(r.section, r.item, r.present) for r in got] == [
        ("Service", "Delivery", False), ("Service", "Wi-fi", True), ("Service", "Isn't open late", False)
    ]


def test_no_break_spaces(spark):
    assert one(spark, P.parse_price(texts("\u00a0SAR\u00a020–40 per person"))).price_range_text == "SAR 20–40 per person"
    assert one(spark, P.clean_hours_text(F.lit("Friday, 9\u202fam to 5\u00a0pm,  Copy open hours."))) == "Friday, 9 am to 5 pm"
    assert one(spark, P.normalize_menu(F.array(F.struct(
        F.lit("SAR\u00a012").alias("price"), F.lit("Tea ").alias("name"), F.lit(" ").alias("description")
    )))) == [("Tea", None, "SAR", 12.0)]


def test_outbound_links_are_distinct_and_external(spark):
    rows = one(spark, P.outbound_links(texts(
        "https://a.com/?x=1&ved=2", "/url?q=https://a.com/%3Fx%3D1&sa=U", "https://maps.google.com/x", "https://b.com/maps/y",
        "https://www.google.co.in/", "https://linktr.ee/z",
    )))
    assert [(r.kind, r.url) for r in rows] == [("website", "https://a.com/?x=1"), ("linktree", "https://linktr.ee/z")]


def test_menu(spark):
    lines = texts("Burger", "tasty", "SAR 10", "Fries", "SAR 5.50", "SAR 6", "Burger", "SAR 10", "Bad", "USD ,")
    rows = one(spark, P.normalize_menu(P.menu_rows(lines)))
    assert [(r.name, r.description, r.price_amount) for r in rows] == [("Burger", "tasty", 10.0), ("Fries", None, 5.0)]


@pytest.mark.parametrize("text, whole, real, quota", [
    ("12.9", 12, 12.9, 12), ("—", None, None, None), ("nan", None, None, None), ("1_000", 1000, 1000.0, 1000),
    ("1d", None, None, None), (" 7 ", 7, 7.0, 7), ("1e3", 1000, 1000.0, 1000), ("-3", -3, -3.0, None),
    ("0.5", 0, 0.5, None), ("inf", None, float("inf"), None), ("unlimited", None, None, None), ("", None, None, None),
])
def test_numbers(spark, text, whole, real, quota):
    row = spark.range(1).select(
        V.coerce_int(F.lit(text)).alias("i"), V.coerce_float(F.lit(text)).alias("f"), V.parse_quota(F.lit(text)).alias("q")
    ).first()
    assert (row.i, row.f, row.q) == (whole, real, quota)


@pytest.mark.parametrize("raw, image", [
    ('["x","y"]', "x"), ("u1|u2", "u1"), ("123", ""), ("a;b", "a"), ("a,b", "a"), ("[]", ""), ("", ""), (" z ", "z"),
])
def test_first_image(spark, raw, image):
    assert one(spark, M.first_image(F.lit(raw))) == image


def test_image_urls(spark):
    assert one(spark, M.dedupe_image_urls(F.lit("a=w1;a=w2;b;;"))) == ["a=w1", "b"]
    assert one(spark, M.dedupe_image_urls(F.lit("N/A"))) == []
    assert one(spark, M.split_image_urls(F.lit("a, b;;a"))) == ["a", "b", "a"]
    assert one(spark, M.safe_name(F.lit(" é/x y-_1 "))) == "é_x_y-_1"
    assert one(spark, M.safe_name(F.lit(" "))) == "unknown_place"
    assert one(spark, M.ext_for_ctype(F.lit("image/PNG; q=1"))) == "png"


@pytest.mark.parametrize("text, kind", [("HTTP 404 timeout", "permanent"), ("weird", "transient"), (None, "transient")])
def test_error_class(spark, text, kind):
    assert one(spark, O.classify_error(F.lit(text).cast("string"))) == kind


@pytest.mark.parametrize("code, ok, want", [
    (None, 3, ("done", "done")), (429, 2, ("failed", "failed")), (500, 0, ("failed", "failed")), (500, 2, ("done", "partial")),
])
def test_cell_outcome(spark, code, ok, want):
    got = one(spark, O.cell_outcome(F.lit(code).cast("int"), F.lit(ok)))
    assert (got.state_status, got.stats_status) == want


def test_billing_day(spark):
    days = [str(one(spark, O.billing_day(F.lit(f"2026-05-22 {t}").cast("timestamp")))) for t in ("06:59:59", "07:00:00")]
    assert days == ["2026-05-21", "2026-05-22"]


def test_cancelled_job(spark):
    assert one(spark, O.effective_state(F.lit(O.SUCCEEDED), F.lit(4), F.lit(4))) == O.CANCELLED
    assert one(spark, O.effective_state(F.lit(O.SUCCEEDED), F.lit(0), F.lit(0))) == O.SUCCEEDED


def test_run_id(spark):
    assert one(spark, M.safe_run_id(F.lit(" a/b é "))) == "a_b__"
    for bad in ("  ", "x" * 65):
        with pytest.raises(PySparkException):
            one(spark, M.safe_run_id(F.lit(bad)))


def test_projection(spark):
    points = spark.createDataFrame([(0.0, 3.0), (45.0, 9.0), (-33.9, 18.4), (60.5, -3.2)], "lat double, lng double")
    rows = Z.project_utm(points.withColumn("epsg", Z.utm_zone("lat", "lng")), "lat", "lng", "epsg")
    back = Z.unproject_utm(rows, "x", "y", "epsg", "lat2", "lng2").collect()
    for r in back:
        assert abs(r.lat - r.lat2) < 1e-9 and abs(r.lng - r.lng2) < 1e-9
    assert [r.epsg for r in back] == [32631, 32632, 32734, 32630]
    assert (back[0].x, back[0].y) == (500000.0, 0.0)
    assert abs(back[1].y - 4982950.4002) < 1e-3          # meridian arc at 45 degrees times the scale


def test_profiles():
    assert L.selected_columns("lean")[:3] == ["place_id", "name", "rating"]
    assert L.selected_columns(columns=["rating", "nope"]) == ["place_id", "rating"]
    assert len(L.selected_columns()) == 22
    with pytest.raises(ValueError):
        L.selected_columns("missing")
    with pytest.raises(ValueError):
        L.check_schema(["place_id", "name"], ["name", "place_id"])


@pytest.mark.parametrize("text, rings", [
    ("[[1,2],[3,4],[5,6]]", 1), ("[[[1,2],[3,4],[5,6]],[[1,2],[3,4],[5,7]]]", 2),
    ('{"type":"Polygon","coordinates":[[[2,1],[4,3],[6,5]],[[0,0],[1,1],[2,2]]]}', 1),
    ('{"type":"MultiPolygon","coordinates":[[[[2,1],[4,3],[6,5]]],[[[2,1],[4,3],[6,5]]]]}', 2),
    ('{"type":"Feature","geometry":{"type":"Polygon","coordinates":[[[2,1],[4,3],[6,5]]]}}', 1),
    ('{"type":"FeatureCollection","features":[{"type":"Feature","geometry":{"type":"Polygon","coordinates":'
     '[[[2,1],[4,3],[6,5]]]}}]}', 1),
])
def test_boundary_shapes(spark, text, rings):
    got = R.boundary_rings(spark.createDataFrame([(text,)], "value string")).first().rings
    assert len(got) == rings and (got[0][0].lat, got[0][0].lng) == (1.0, 2.0)


@pytest.mark.parametrize("text", ["[]", '{"type":"Point","coordinates":[1,2]}', '{"type":"FeatureCollection","features":[]}'])
def test_boundary_without_polygon(spark, text):
    with pytest.raises(PySparkException):
        R.boundary_rings(spark.createDataFrame([(text,)], "value string")).collect()


def test_short_ring_is_an_error(spark):
    ring = [[(1.0, 2.0), (3.0, 4.0)]]
    rows = spark.createDataFrame([("b", ring)], "boundary_id string, rings array<array<struct<lat:double,lng:double>>>")
    with pytest.raises(PySparkException):
        G.edges(rows).collect()
    assert not G.rings_valid(rows).first().valid
