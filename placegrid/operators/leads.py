"""Listings and discoveries merged into one searchable lead table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.functions.media import first_image
from placegrid.functions.values import blank, coerce_float, coerce_int, first_filled, strip
from placegrid.operators.dedupe import first_seen, with_id
from placegrid.operators.ordered import PARTS, even_chunks
from placegrid.schemas import LISTING_FIELDS, PROFILES

# Page size limits.
PAGE_DEFAULT, PAGE_MAX = 200, 1000

_FROM_DISCOVERY = ("lat", "lng", "query")


def selected_columns(profile: str | None = None, columns: Sequence[str] | None = None,
                     resume: Sequence[str] | None = None) -> list[str]:
    """Columns of a run: the resumed list, else the named ones, else a profile, else all."""
    if resume:
        return list(resume)
    if columns:
        wanted = columns
    elif profile is None:
        wanted = LISTING_FIELDS
    elif profile in PROFILES:
        wanted = PROFILES[profile]
    else:
        raise ValueError(f"unknown profile {profile!r}")
    return ["place_id", *[c for c in wanted if c in LISTING_FIELDS]]


def lock_schema(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Exactly these columns as text: others are dropped, missing ones and nulls are ''."""
    have = set(df.columns)
    return df.select(
        *[
            (F.coalesce(F.col(c).cast("string"), F.lit("")) if c in have else F.lit("")).alias(c)
            for c in columns
        ]
    )


def select_profile(df: DataFrame, profile=None, columns=None, resume=None) -> DataFrame:
    return lock_schema(df, selected_columns(profile, columns, resume))


def check_schema(existing: Sequence[str], new: Sequence[str]) -> None:
    """A run may only be resumed with the same columns in the same order."""
    if existing and list(existing) != list(new):
        raise ValueError(f"run has columns {list(existing)}, resumed with {list(new)}")


def to_lead(rows: DataFrame, scraped: Column, keep: Sequence[str] = ()) -> DataFrame:
    """Rename and coerce merged rows into the typed lead shape."""
    have = set(rows.columns)

    def text(*names: str) -> Column:
        found = [F.col(n) for n in names if n in have]
        return F.coalesce(first_filled(*found), F.lit("")) if found else F.lit("")

    return rows.select(
        F.col("place_id").alias("id"), text("name").alias("name"), text("category").alias("cat"),
        coerce_float(text("rating")).alias("rating"), coerce_int(text("review_count")).alias("rcount"),
        text("address").alias("addr"), text("phone").alias("phone"), text("website").alias("website"),
        coerce_float(text("latitude", "lat")).alias("lat"), coerce_float(text("longitude", "lng")).alias("lng"),
        first_image(text("image_urls")).alias("image_url"), text("source_url").alias("source_url"),
        text("query", "found_via").alias("found_via"), scraped.alias("scraped"), *keep,
    )


def build_leads(
    listings: DataFrame, discovered: DataFrame, listing_order: Sequence[str], discovery_order: Sequence[str]
) -> DataFrame:
    """First listing per id with gaps filled from its first discovery, then the rest.

    `side` (0 scraped, 1 only discovered) and `seq` give the order of the table.
    """
    scraped = first_seen(with_id(listings), ["place_id"], listing_order)
    found = first_seen(with_id(discovered), ["place_id"], discovery_order)
    left = scraped.select(
        "place_id", *[F.col(c).alias(f"l_{c}") for c in scraped.columns if c in LISTING_FIELDS or c in _FROM_DISCOVERY],
        F.col(listing_order[0]).alias("_lseq"), F.lit(True).alias("_scraped"),
    )
    right = found.select(
        "place_id", *[F.col(c).cast("string").alias(f"d_{c}") for c in _FROM_DISCOVERY],
        F.col(discovery_order[0]).alias("_dseq"),
    )
    both = left.join(right, "place_id", "full_outer")
    fields = [c for c in dict.fromkeys((*LISTING_FIELDS, *_FROM_DISCOVERY))]
    merged = both.select(
        "place_id",
        *[
            first_filled(*[F.col(p + c) for p in ("l_", "d_") if p + c in both.columns]).alias(c)
            for c in fields if f"l_{c}" in both.columns or f"d_{c}" in both.columns
        ],
        F.coalesce("_scraped", F.lit(False)).alias("_scraped"),
        F.when(F.col("_scraped"), 0).otherwise(1).alias("side"),
        F.when(F.col("_scraped"), F.col("_lseq")).otherwise(F.col("_dseq")).alias("seq"),
    )
    return to_lead(merged, F.col("_scraped"), keep=["side", "seq"])


def search_leads(leads: DataFrame, q: str) -> DataFrame:
    """Literal, case-insensitive search in name, category or address."""
    if not q.strip():
        return leads
    needle = F.lit(q.strip().lower())
    hit = F.lit(False)
    for c in ("name", "cat", "addr"):
        hit = hit | F.lower(blank(c)).contains(needle)
    return leads.filter(hit)


def export_search(listings: DataFrame, q: str) -> DataFrame:
    """The same search over the joined text, so a hit may span two columns."""
    if not q.strip():
        return listings
    text = F.concat(blank("name"), F.lit(" "), blank("category"), F.lit(" "), blank("address"))
    return listings.filter(F.lower(text).contains(F.lit(q.strip().lower())))


def export_leads(listings: DataFrame, q: str, order: Sequence[str]) -> DataFrame:
    """First row per id; rows without an id are all kept, unlike in the lead table."""
    ids = listings.withColumn("_id", strip(blank("place_id")))
    named = first_seen(ids.filter("_id <> ''"), ["_id"], order)
    return export_search(named.unionByName(ids.filter("_id = ''")).drop("_id"), q)


def page(
    df: DataFrame, order: Sequence[str], number: int = 0, limit: int = PAGE_DEFAULT, chunk: Column | None = None,
    max_limit: int = PAGE_MAX,
) -> DataFrame:
    """One page of an ordered table plus `total`.

    With a `chunk`, a number that grows with the order, rows are counted per chunk and only
    the chunks that the page touches are sorted, whatever its depth. Without one it is a top-n.
    """
    limit = max(1, min(int(limit), max_limit))
    start = max(0, int(number)) * limit
    if chunk is None:
        total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
        return df.orderBy(*order).offset(start).limit(limit).withColumn("total", total)
    rows = df.withColumn("_chunk", F.coalesce(chunk, F.lit(-1)))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    # the few counts give both the offsets and the total
    counts = (
        rows.groupBy("_chunk").agg(F.count(F.lit(1)).alias("_n"))
        .withColumns({"_before": F.coalesce(F.sum("_n").over(before), F.lit(0)),
                      "total": F.sum("_n").over(Window.partitionBy())})
        .filter((F.col("_before") < start + limit) & (F.col("_before") + F.col("_n") > start))
    )
    inside = Window.partitionBy("_chunk").orderBy(*order)
    return (
        rows.join(counts, "_chunk")
        .withColumn("_at", F.col("_before") + F.row_number().over(inside) - 1)
        .filter((F.col("_at") >= start) & (F.col("_at") < start + limit))
        .drop("_chunk", "_n", "_before", "_at")
    )


def lead_page(leads: DataFrame, number: int = 0, limit: int = PAGE_DEFAULT) -> DataFrame:
    """A page of the lead table in its own order: scraped rows, then the rest."""
    chunk = F.col("side") * PARTS + even_chunks(leads, "seq")
    return page(leads, ["side", "seq", "id"], number, limit, chunk)
