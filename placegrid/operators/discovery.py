"""Search planning, stored search pages, pagination stop rules and cell outcomes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.functions.links import (
    href_place_id, href_point, id_form, long_ids,
)
from placegrid.functions.outcomes import cell_outcome, is_auth_error
from placegrid.functions.values import fmt_coord, pack, unpack
from placegrid.operators.dedupe import first_seen
from placegrid.operators.ordered import even_chunks, running_sum
from placegrid.schemas import SEARCH_BODY

# The pagination stop rules, key attempts per search, scroll rounds.
MAX_PAGES = 6
EMPTY_IN_A_ROW = 2
LOW_YIELD_FROM, LOW_YIELD_BELOW, LOW_YIELD_IN_A_ROW = 3, 3, 2
SATURATED_BELOW, SATURATED_IN_A_ROW = 0.15, 2
MAX_ATTEMPTS = 4
MAX_ROUNDS = 8
CALL = ("cell_id", "query", "attempt")


def plan_work(cells: DataFrame, queries: Sequence[str] | DataFrame, done: DataFrame) -> DataFrame:
    """Every (cell, query) pair not done yet; `pos` keeps the order of the queries.

    The queries of a run are a list, or a table of `pos` and `query` that is gathered into one array.
    """
    if isinstance(queries, DataFrame):
        listed = queries.select(F.col("pos").cast("int").alias("pos"), "query").distinct().agg(
            F.array_sort(F.collect_list(F.struct("pos", "query"))).alias("q")).scalar()
        wanted = cells.withColumn("_queries", listed).select(*cells.columns, F.inline("_queries"))
    else:
        wanted = cells.select("*", F.posexplode(F.array(*[F.lit(q) for q in queries])).alias("pos", "query"))
    return wanted.join(done.select("cell_id", "query").distinct(), ["cell_id", "query"], "left_anti")


def search_requests(
    work: DataFrame, radius: float, restrict: bool, language: str = "en", region: str = "IN"
) -> DataFrame:
    """Request body per work item: a rectangle when restricted, else a circle."""
    def point(lat: str, lng: str) -> Column:
        return F.struct(F.col(lat).alias("latitude"), F.col(lng).alias("longitude"))

    rectangle = F.struct(
        F.struct(
            point("bbox_south", "bbox_west").alias("low"),
            point("bbox_north", "bbox_east").alias("high"),
        ).alias("rectangle")
    )
    circle = F.struct(
        F.struct(
            point("centroid_lat", "centroid_lon").alias("center"), F.lit(float(radius)).alias("radius")
        ).alias("circle")
    )
    where = rectangle.alias("locationRestriction") if restrict else circle.alias("locationBias")
    return work.select(
        "cell_id", "query",
        F.to_json(
            F.struct(
                F.col("query").alias("textQuery"), F.lit(language).alias("languageCode"),
                F.lit(region).alias("regionCode"), where,
            )
        ).alias("body"),
    )


def parse_pages(responses: DataFrame) -> DataFrame:
    """One row per response: its result count, its non-blank ids in order, whether more follow."""
    ok = F.col("status") == 200
    body = F.when(ok, F.from_json("body", SEARCH_BODY))
    ids = F.coalesce(F.col("_body.places.id"), F.array().cast("array<string>"))
    filled_ids = F.array_remove(ids, "")
    # a lambda per id is only needed where an id is null: without a text in common, the overlap is null then
    some_null = F.arrays_overlap(filled_ids, F.array(F.lit(""))).isNull()
    return responses.withColumn("_body", body).select(
        *CALL, "page", "status",
        is_auth_error("status", "body").alias("auth_failed"),
        F.size(ids).alias("results"),
        F.when(some_null, F.array_compact(filled_ids)).otherwise(filled_ids).alias("ids"),
        F.coalesce(F.col("_body.nextPageToken") != "", F.lit(False)).alias("has_next"),
    )


def page_ids(responses: DataFrame) -> DataFrame:
    """One row per (page, position, id)."""
    # of an inner explode Spark would ask for non-empty ids first and parse every body once more for it
    return parse_pages(responses).select(
        *CALL, "page", F.posexplode_outer("ids").alias("pos", "place_id")
    ).filter("pos IS NOT NULL")


def call_pages(responses: DataFrame, gather: bool = False) -> DataFrame:
    """Parsed pages, one of each: of a repeated page the least (status, results, ids), so good answers win.

    With `gather` the pages of a call are brought together first, the ids of each as one text, so that neither this
    nor what then looks at whole calls moves ids again. Pages that lie together by (cell, query) need none of it.
    """
    pages = parse_pages(responses)
    if gather:
        pages = pages.withColumn("ids", pack("ids")).repartition(*CALL)
    return (
        pages.groupBy(*CALL, "page")
        .agg(F.min(F.struct("status", "results", "ids", "auth_failed", "has_next")).alias("r"))
        .select(
            *CALL, "page", "r.status", "r.auth_failed", "r.results",
            unpack("r.ids").alias("ids") if gather else "r.ids", "r.has_next")
    )


def last_attempt(pages: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Only the final key's pages: a later attempt replaces the earlier ones.

    Of stored responses as well as of parsed pages; taken first, what it drops need not be parsed.
    """
    whole = Window.partitionBy("cell_id", "query")
    return (
        pages.filter(F.col("attempt") <= max_attempts)
        .withColumn("_last", F.max("attempt").over(whole))
        .filter(F.col("attempt") == F.col("_last"))
        .drop("_last")
    )


def page_novelty(pages: DataFrame) -> DataFrame:
    """Adds the number of ids not seen on an earlier page of the same call (of `call_pages`)."""
    earlier = Window.partitionBy(*CALL).orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.flatten(F.collect_list("ids").over(earlier))
    return pages.withColumn("new_ids", F.size(F.array_except("ids", seen)))


def _streak(condition: Column, position: Column, window) -> Column:
    return position - F.coalesce(F.max(F.when(~condition, position)).over(window), F.lit(0))


def paginate(pages: DataFrame, max_pages: int = MAX_PAGES) -> DataFrame:
    """Pages up to the stop of their call, with `stop_page` and `stop_reason`.

    The rules look only at the page and those before it, so the first page that
    meets one is where the call ends; page `max_pages` always does.
    """
    so_far = Window.partitionBy(*CALL).orderBy("page").rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*CALL)
    n, new, pos = F.col("results"), F.col("new_ids"), F.col("_pos")
    ratio = F.when(n > 0, new / n).otherwise(0.0)
    why = (
        F.when(F.col("status") != 200, "error")
        .when(~F.col("has_next"), "end")
        .when(F.col("page") >= max_pages, "max_pages")
        .when(F.col("_empty") >= EMPTY_IN_A_ROW, "empty_streak")
        .when((F.col("page") >= LOW_YIELD_FROM) & (F.col("_low") >= LOW_YIELD_IN_A_ROW), "low_yield")
        .when(F.col("_saturated") >= SATURATED_IN_A_ROW, "saturation")
    )
    return (
        page_novelty(pages.filter(F.col("page") <= max_pages))
        .withColumn("_pos", F.count(F.lit(1)).over(so_far))
        .withColumns(
            {
                "_empty": _streak(n == 0, pos, so_far),
                "_low": _streak(new < LOW_YIELD_BELOW, pos, so_far),
                "_saturated": _streak(ratio < SATURATED_BELOW, pos, so_far),
            }
        )
        .withColumn("_why", why)
        .withColumn(
            "_stop",
            F.min(F.when(F.col("_why").isNotNull(), F.struct("page", F.col("_why").alias("why")))).over(whole),
        )
        .withColumns(
            {
                "stop_page": F.coalesce(F.col("_stop.page"), F.max("page").over(whole)),
                "stop_reason": F.when(~F.col("_stop.why").isin("end", "error"), F.col("_stop.why")),
            }
        )
        .filter(F.col("page") <= F.col("stop_page"))
        .drop("_pos", "_empty", "_low", "_saturated", "_why", "_stop")
    )


def call_summary(kept: DataFrame) -> DataFrame:
    """Per (cell, query): good pages, the failing status if any, ids found and the stop."""
    return kept.groupBy("cell_id", "query").agg(
        F.count_if(F.col("status") == 200).alias("ok_count"),
        F.min(F.when(F.col("status") != 200, F.col("status"))).alias("fail_code"),
        F.max("stop_page").alias("stop_page"),
        F.max("stop_reason").alias("stop_reason"),
        F.sum("new_ids").alias("found"),
    )


def cell_results(calls: DataFrame, counts: DataFrame) -> DataFrame:
    """State rows of searched cells; a hard failure without a page counts no places."""
    outcome = cell_outcome("fail_code", "ok_count")
    joined = calls.join(counts, ["cell_id", "query"], "left").withColumn("o", outcome)
    uncovered = (F.col("fail_code") != 429) & (F.col("ok_count") == 0)
    return joined.select(
        "cell_id", "query", F.col("o.state_status").alias("status"), "o.stats_status",
        F.when(uncovered, 0).otherwise(F.coalesce("place_count", F.lit(0))).cast("bigint").alias("place_count"),
        "o.error_msg",
    )


def discovered_rows(kept: DataFrame) -> DataFrame:
    """The ids of kept pages, first appearance per call, as discovery rows."""
    ids = kept.select("cell_id", "query", "page", F.posexplode("ids").alias("pos", "place_id"))
    return first_seen(ids, ["cell_id", "query", "place_id"], ["page", "pos"]).withColumn(
        "form", id_form("place_id")
    )


def cell_place_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("cell_id", "query").agg(F.count(F.lit(1)).alias("place_count"))


def outcome_totals(cells: DataFrame) -> DataFrame:
    """Finished, failed and partial cells; a partial cell is also a finished one."""
    status = F.lower(F.col("stats_status"))
    return cells.agg(
        F.count_if(status != "failed").alias("cells_done"),
        F.count_if(status == "failed").alias("cells_failed"),
        F.count_if(status == "partial").alias("cells_partial"),
    )


def in_bbox(df: DataFrame, lat: str = "lat", lng: str = "lng") -> DataFrame:
    """Rows inside the closed box, and rows that have no coordinates."""
    inside = F.col(lat).between(F.col("bbox_south"), F.col("bbox_north")) & F.col(lng).between(
        F.col("bbox_west"), F.col("bbox_east")
    )
    return df.filter(F.col(lat).isNull() | F.col(lng).isNull() | inside)


def places_in_cell(places: DataFrame, cells: DataFrame) -> DataFrame:
    box = cells.select("cell_id", "bbox_south", "bbox_north", "bbox_west", "bbox_east")
    return in_bbox(places.join(box, "cell_id")).select(*places.columns)


def parse_discovery(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Discovery rows of stored result pages: anchors first, then bare ids, once per page.

    Pages that carry a box (`bbox_*`) lose what points outside it before ids are told apart,
    so an id that is also named without a point is still found.
    """
    boxed = [c for c in pages.columns if c.startswith("bbox_")]
    hrefs = F.regexp_extract_all(F.col(html), F.lit('(?i)<a [^>]*?href="([^"]*/maps/place/[^"]*)"'), F.lit(1))
    anchors = F.transform(
        hrefs,
        lambda h: F.struct(
            href_place_id(h).alias("place_id"), href_point(h)["lat"].alias("lat"),
            href_point(h)["lng"].alias("lng"),
        ),
    )
    bare = F.transform(
        long_ids(html),
        lambda i: F.struct(
            i.alias("place_id"), F.lit(None).cast("double").alias("lat"),
            F.lit(None).cast("double").alias("lng"),
        ),
    )
    rows = pages.select(
        key, *boxed, F.posexplode(F.concat(F.filter(anchors, lambda a: a["place_id"].isNotNull()), bare)).alias("pos", "p")
    ).select(key, *boxed, "pos", "p.*")
    if boxed:
        rows = in_bbox(rows)
    return first_seen(rows, [key, "place_id"], ["pos"]).select(
        key, "place_id", id_form("place_id").alias("form"),
        fmt_coord("lat").alias("lat"), fmt_coord("lng").alias("lng"),
    )


def scroll_plateau(harvest: DataFrame, max_rounds: int = MAX_ROUNDS) -> DataFrame:
    """Ids harvested before the list stopped growing twice in a row.

    Ids are first reduced to their first round; the few round counters of a
    search are then plain conditional sums. Rounds count from a search's first one.
    """
    whole = Window.partitionBy("cell_id", "query")
    first_round = (
        harvest.groupBy("cell_id", "query", "place_id").agg(F.min("round").alias("round"))
        .withColumn("_from", F.min("round").over(whole))
        .withColumn("_n", F.col("round") - F.col("_from"))
        .filter(F.col("_n") < max_rounds)
    )
    per_round = [F.count_if(F.col("_n") == r) for r in range(max_rounds)]
    grown = first_round.groupBy("cell_id", "query").agg(F.array(*per_round).alias("_new"))
    stop = F.least(
        *[
            F.when((F.get("_new", F.lit(r)) == 0) & (F.get("_new", F.lit(r - 1)) == 0), r)
            for r in range(2, max_rounds)
        ]
    )
    stops = grown.select("cell_id", "query", F.coalesce(stop, F.lit(max_rounds - 1)).alias("_stop"))
    return (
        first_round.join(stops, ["cell_id", "query"]).filter(F.col("_n") <= F.col("_stop"))
        .withColumn("stop_round", (F.col("_from") + F.col("_stop")).cast("int")).drop("_from", "_n", "_stop")
    )


def cap_places(cells: DataFrame, cap: int, position: str, chunk: Column | None = None) -> DataFrame:
    """Cells issued before the running number of places reached the cap; cells without a position come first."""
    cut = even_chunks(cells, position) if chunk is None else chunk
    rows = running_sum(cells, [], cut, [position], F.col("place_count"), "_before", before=True)
    return rows.filter(F.col("_before") < cap).drop("_before")


