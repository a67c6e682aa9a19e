"""Panel snapshots to attribute rows and child tables; the menu walk."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from placegrid.functions import panel as P
from placegrid.functions.values import blank
from placegrid.schemas import ATTRIBUTE_COLUMNS

# How many empty chips end a menu walk, and the longest chip label.
EMPTY_CHIPS, CHIP_LABEL_LIMIT, CATEGORY_LIMIT = 3, 40, 100

NO_TABS = "panel: degraded (no tabs)"


def flag_degraded(panel: DataFrame) -> DataFrame:
    """A panel without a tab strip was served incomplete; its extras stay empty."""
    bare = F.coalesce(F.size("tabs") <= 0, F.lit(True))
    return panel.withColumn("degraded", bare)


def enrich_panel(panel: DataFrame) -> DataFrame:
    """Parse whole snapshots: price, busy hours, opening hours, links, menu and amenities."""
    flagged = flag_degraded(panel)
    usable = ~F.col("degraded")
    lines = F.when(usable, F.col("lines"))
    aria = F.when(usable, F.col("aria"))
    staged = (
        flagged.withColumns(
            {
                "price": P.parse_price(lines),
                "_days": P.popular_days(F.when(usable, F.col("popular"))),
                "_day": P.selected_day(lines, aria),
            }
        )
        .withColumns(
            {
                "popular_times": F.when(F.size("_days") > 0, F.col("_days")).otherwise(
                    P.popular_flat(aria, F.col("_day"))
                ),
                "popular_times_day": F.when(
                    F.size("_days") > 0, P.weekday(F.col("popular.selected"))
                ).otherwise(F.col("_day")),
            }
        )
    )
    has_tab = lambda word: F.exists("tabs", lambda t: F.lower(t).contains(word))
    return staged.select(
        "place_id", "share_link", "price.*", "popular_times", "popular_times_day",
        P.parse_hours(aria).alias("hours"),
        P.outbound_links(F.when(usable, F.col("links"))).alias("links"),
        (usable & F.coalesce(has_tab("menu"), F.lit(False))).alias("has_menu_tab"),
        P.normalize_menu(
            F.when(usable & has_tab("menu"), P.menu_rows(F.col("menu_lines")))
        ).alias("menu_items"),
        P.normalize_amenities(
            F.when(usable & has_tab("about"), P.about_items(F.col("about_html")))
        ).alias("amenities"),
        "degraded",
        F.when(F.col("degraded"), F.array(F.lit(NO_TABS)))
        .otherwise(F.array().cast("array<string>")).alias("errors"),
    )


def attribute_rows(extras: DataFrame) -> DataFrame:
    def some(name: str):
        return F.coalesce(F.size(name), F.lit(0)) > 0

    return extras.select(
        "place_id", *ATTRIBUTE_COLUMNS,
        F.greatest(F.coalesce(F.size("menu_items"), F.lit(0)), F.lit(0)).alias("menu_item_count"),
        some("popular_times").alias("has_popular_times"),
        some("links").alias("has_web_results"),
        some("hours").alias("hours_captured"),
    )


def child_rows(extras: DataFrame, name: str) -> DataFrame:
    """One row per element of a nested column, with its position."""
    return extras.select("place_id", F.posexplode(name).alias("pos", "row")).select(
        "place_id", "pos", "row.*"
    )


def fill_bar_hours(bars: DataFrame, day: list[str], position: str) -> DataFrame:
    """`fill_hours` over bars that are stored one per row (a day holds few of them)."""
    so_far = Window.partitionBy(*day).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)
    at = F.row_number().over(Window.partitionBy(*day).orderBy(position))
    hour = F.last("hour", ignorenulls=True).over(so_far)
    since = F.last(F.when(F.col("hour").isNotNull(), F.col("_at")), ignorenulls=True).over(so_far)
    return (
        bars.withColumn("_at", at)
        .withColumn("hour_24", (hour + F.col("_at") - since) % 24)
        .drop("_at")
    )


def walk_menu(chips: DataFrame) -> DataFrame:
    """Menu items in chip order, each once per (name, price), until three chips bring nothing.

    `chips` has place_id, chip_pos, chip (null for the landing page) and items. Items
    are reduced to their first chip before the walk, so only chip counts are scanned.
    """
    label = blank("chip")
    landing = F.col("chip").isNull()
    walked = chips.filter(
        landing | ((label != "") & (F.length(label) <= CHIP_LABEL_LIMIT) & ~label.isin(*P.SKIPPED_CHIPS))
    )
    items = walked.select("place_id", "chip_pos", "chip", F.posexplode("items").alias("pos", "i"))
    first = (
        items.select("place_id", "chip_pos", "chip", "pos", "i.*")
        .groupBy("place_id", "name", "price_amount")
        .agg(
            F.min_by(
                F.struct("chip_pos", "pos", "chip", "description", "currency"), F.struct("chip_pos", "pos")
            ).alias("f")
        )
        .select("place_id", "name", "price_amount", "f.*")
    )
    fresh = (
        walked.select("place_id", "chip_pos", landing.alias("landing"), F.lit(0).alias("n"))
        .unionByName(first.select("place_id", "chip_pos", landing.alias("landing"), F.lit(1).alias("n")))
        .groupBy("place_id", "chip_pos")
        .agg(F.sum("n").alias("fresh"), F.max("landing").alias("landing"))
    )
    so_far = Window.partitionBy("place_id").orderBy("chip_pos").rowsBetween(Window.unboundedPreceding, 0)
    earlier = so_far.rowsBetween(Window.unboundedPreceding, -1)
    at = F.count(F.lit(1)).over(so_far)
    brings = (F.col("fresh") > 0) | F.col("landing")
    stops = (
        fresh.withColumn("_at", at)
        .withColumn("_run", F.col("_at") - F.coalesce(F.max(F.when(brings, F.col("_at"))).over(so_far), F.lit(0)))
        .withColumn("_over", F.max(F.col("_run") >= EMPTY_CHIPS).over(earlier))
        .filter(~F.coalesce("_over", F.lit(False)))
        .select("place_id", "chip_pos")
    )
    return first.join(stops, ["place_id", "chip_pos"], "left_semi").select(
        "place_id", "chip_pos", "pos", "name", "description", "currency", "price_amount",
        F.substring("chip", 1, CATEGORY_LIMIT).alias("category"),
    )
