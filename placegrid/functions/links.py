"""Links: unwrapping redirects, classifying hosts, ids inside hrefs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placegrid.functions.values import col, filled, let, strip

# Query parameters that only track, and hosts with a kind of their own.
TRACKING = (
    "fbclid", "opi", "sa", "ved", "usg", "gclid", "_aem", "ltsid", "igsh", "igshid",
    "utm_source", "utm_medium", "utm_campaign", "utm_term", "utm_content",
)
HOST_KINDS = {
    "instagram.com": "instagram",
    "facebook.com": "facebook",
    "tiktok.com": "tiktok",
    "snapchat.com": "snapchat",
    "twitter.com": "x",
    "x.com": "x",
    "t.me": "telegram",
    "youtube.com": "youtube",
    "linktr.ee": "linktree",
    "wa.me": "whatsapp",
    "api.whatsapp.com": "whatsapp",
}
OWN_HOSTS = ("google.com", "google.co.in")
LINK_LIMIT = 2000
PLACE_URL = "https://www.google.com/maps/place/?q=place_id:"
SEARCH_URL = "https://www.google.com/maps/search/"
LONG_ID = r"(ChIJ[A-Za-z0-9_-]{20,})"

_URL = r"(?is)^(http[a-z0-9+.-]*):(//[^/?#]*)?([^?#]*)(\?[^#]*)?"
_QUERY = r"(?s)^[^?#]*\?([^#]*)"


def form_decode(c: Column) -> Column:
    return F.coalesce(F.try_url_decode(c), F.replace(c, F.lit("+"), F.lit(" ")))


def form_encode(c: Column) -> Column:
    """Form encoding that escapes `*` and leaves `~` alone."""
    return F.replace(F.replace(F.url_encode(c), F.lit("*"), F.lit("%2A")), F.lit("%7E"), F.lit("~"))


def query_pairs(query: Column) -> Column:
    """array<struct<k,v>> of a query string, decoded; pairs without a value are dropped."""
    whole = F.filter(F.split(query, "&"), lambda p: p.rlike(r"(?s)^[^=]*=."))
    return F.transform(
        whole,
        lambda p: F.struct(
            form_decode(F.regexp_extract(p, r"(?s)^([^=]*)=", 1)).alias("k"),
            form_decode(F.regexp_extract(p, r"(?s)^[^=]*=(.*)$", 1)).alias("v"),
        ),
    )


def unwrap_url(c: Column | str) -> Column:
    """The real http(s) target of a possibly wrapped link, without tracking or fragment."""
    def inner(raw: Column) -> Column:
        wrapped = raw.startswith("/url?") | raw.contains("google.com/url?")
        targets = F.filter(query_pairs(F.regexp_extract(raw, _QUERY, 1)), lambda p: p["k"] == "q")
        return F.when(wrapped, F.get(targets, 0)["v"]).otherwise(raw)

    def query(url: Column) -> Column:
        kept = F.filter(
            query_pairs(F.substring(F.regexp_extract(url, _URL, 4), 2, 1 << 30)),
            lambda p: ~p["k"].isin(*TRACKING),
        )
        pairs = F.transform(kept, lambda p: F.concat(form_encode(p["k"]), F.lit("="), form_encode(p["v"])))
        return F.array_join(pairs, "&")

    def rebuilt(url: Column) -> Column:
        stem = F.concat(
            F.lower(F.regexp_extract(url, _URL, 1)), F.lit(":"),
            F.regexp_extract(url, _URL, 2), F.regexp_extract(url, _URL, 3),
        )
        tail = let(query(url), lambda q: F.when(q != "", F.concat(F.lit("?"), q)).otherwise(""))
        return F.when(url.rlike(_URL), F.concat(stem, tail))

    return let(let(F.regexp_replace(strip(c), r"[\t\r\n]", ""), inner), rebuilt)


def url_host(c: Column | str) -> Column:
    """Lower-case authority part, port and user info included."""
    return F.lower(F.regexp_extract(col(c), r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1))


def classify_link(c: Column | str) -> Column:
    def kind(host: Column) -> Column:
        found = F.lit("website")
        for known, label in reversed(HOST_KINDS.items()):
            found = F.when((host == known) | host.endswith(f".{known}"), label).otherwise(found)
        return found

    return F.when(col(c).isNull(), "website").otherwise(let(url_host(c), kind))


def is_own_link(c: Column | str) -> Column:
    url, host = col(c), url_host(c)
    own = url.contains("google.com/maps") | url.contains("/maps/")
    for h in OWN_HOSTS:
        own = own | host.endswith(h)
    return own


def place_url(c: Column | str) -> Column:
    return F.concat(F.lit(PLACE_URL), col(c))


def search_url(query: Column | str, lat: Column | str, lng: Column | str) -> Column:
    return F.concat(
        F.lit(SEARCH_URL), form_encode(col(query)), F.lit("/@"),
        col(lat).cast("string"), F.lit(","), col(lng).cast("string"), F.lit(",15z"),
    )


def href_place_id(c: Column | str) -> Column:
    """Long-form id if the href holds one, else the hexadecimal `!1s` id."""
    href = col(c)
    found = F.coalesce(
        filled(F.regexp_extract(href, LONG_ID, 1)),
        filled(F.regexp_extract(href, r"/maps/place/[^/]+/data=[^\"'\s]*?!1s(0x[a-fA-F0-9:]+)", 1)),
        filled(F.regexp_extract(href, r"!1s(0x[a-fA-F0-9:]+)", 1)),
    )
    return F.when(href.contains("/maps/place/"), found)


def href_point(c: Column | str) -> Column:
    """struct<lat,lng> after the `@`, null fields when absent."""
    def part(i: int) -> Column:
        return filled(F.regexp_extract(col(c), r"@(-?\d+\.\d+),(-?\d+\.\d+)", i)).try_cast("double")

    return F.struct(part(1).alias("lat"), part(2).alias("lng"))


def long_ids(c: Column | str) -> Column:
    """Every distinct long-form id in a page, in order of appearance."""
    return F.array_distinct(F.regexp_extract_all(col(c), F.lit(LONG_ID), F.lit(1)))


def id_form(c: Column | str) -> Column:
    pid = col(c)
    return (
        F.when(pid.startswith("ChIJ"), "ChIJ").when(pid.startswith("0x"), "0x").otherwise("places_api")
    )
