"""Resumable work state: selection, repair, leases, merging, counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.functions.links import place_url
from placegrid.functions.outcomes import classify_error
from placegrid.functions.values import blank, coerce_int, filled, strip
from placegrid.operators.dedupe import distinct_ids
from placegrid.schemas import ERROR_TEXT_LIMIT

# Statuses that may be resumed and the attempts allowed.
RESUMABLE = ("queued", "scraping", "failed")
PENDING = ("queued", "scraping")
MAX_ATTEMPTS = 5
LEASE_MINUTES = 30
CELL_PRIORITY = {"in_progress": 3, "done": 2, "failed": 1}


def attempts_of(c: Column | str = "attempts") -> Column:
    return F.coalesce(coerce_int(F.col(c).cast("string") if isinstance(c, str) else c), F.lit(0))


def resumable(state: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    return state.filter(F.col("status").isin(*RESUMABLE) & (attempts_of() < max_attempts))


def done_places(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == "done").select("place_id")


def done_cells(state: DataFrame) -> DataFrame:
    return state.filter(F.col("status") == "done").select("cell_id", "query")


def touched(cells: DataFrame) -> DataFrame:
    status = strip(blank("status"))
    return cells.filter((strip(blank("cell_id")) != "") & ~status.isin("", "queued", "pending"))


def collapse_cells(cells: DataFrame, order: Sequence[str], skip_untouched: bool = False) -> DataFrame:
    """One row per cell: the busiest status, the later row on a tie."""
    rank = F.lit(0)
    for status, value in CELL_PRIORITY.items():
        rank = F.when(F.col("status") == status, value).otherwise(rank)
    rows = touched(cells) if skip_untouched else cells
    rows = rows.withColumns(
        {
            "cell_id": strip(blank("cell_id")) if skip_untouched else blank("cell_id"),
            "status": strip("status") if skip_untouched else F.coalesce(filled("status"), F.lit("pending")),
            "place_count": F.coalesce(whole_count("place_count"), F.lit(0)),
        }
    )
    return (
        rows.groupBy("cell_id")
        .agg(F.max_by(F.struct("status", "place_count"), F.struct(rank, *order)).alias("best"))
        .select("cell_id", "best.*")
    )


def whole_count(c: Column | str) -> Column:
    """A whole number written without a fraction, else null."""
    text = strip(F.col(c) if isinstance(c, str) else c)
    return F.when(text.rlike(r"^[+-]?\d+$"), text).try_cast("bigint")


def place_status_counts(state: DataFrame) -> DataFrame:
    status = F.col("status")
    return state.agg(
        F.count(F.lit(1)).alias("placeids_total"),
        F.count_if(status == "done").alias("placeids_done"),
        F.count_if(status == "failed").alias("placeids_failed"),
        F.count_if(status.isin(*PENDING)).alias("placeids_pending"),
    )


def cell_progress(state: DataFrame, grid: DataFrame, queries_total: int) -> DataFrame:
    """Done and touched cells against grid size times queries (rows when either is zero)."""
    done = state.agg(
        F.count_if(F.col("status") == "done").alias("cells_done"),
        F.count_distinct(filled("cell_id")).alias("grid_cells_touched"),
        F.count(F.lit(1)).alias("_rows"),
    )
    size = grid.agg(F.count(F.lit(1)).alias("n")).scalar()
    planned = F.col("grid_cells_total") * queries_total
    return done.withColumn("grid_cells_total", size).select(
        "cells_done", "grid_cells_touched", "grid_cells_total",
        F.lit(queries_total).cast("bigint").alias("queries_total"),
        F.when(planned > 0, planned).otherwise(F.col("_rows")).alias("cells_total"),
    )


def cell_status_histogram(cells: DataFrame) -> DataFrame:
    status = F.col("status")
    shown = (
        F.when(status.isin("done", "failed"), status)
        .when(status.isin("in_progress", "running"), "running")
        .otherwise("queued")
    )
    return cells.groupBy(shown.alias("status")).agg(F.count(F.lit(1)).alias("cells"))


def images_to_repair(listings: DataFrame, markers: DataFrame, state: DataFrame) -> DataFrame:
    """Places that are done and have image URLs but no completion marker."""
    urls = strip(blank("image_urls"))
    wanted = listings.withColumn("place_id", strip("place_id")).filter(
        (F.col("place_id") != "") & ~urls.isin("", "N/A")
    )
    return wanted.join(distinct_ids(markers), "place_id", "left_anti").join(
        done_places(state), "place_id", "left_semi"
    )


def image_work(listings: DataFrame, enabled: bool = True) -> DataFrame:
    return listings.filter(F.lit(enabled) & ~strip(blank("image_urls")).isin("", "N/A"))


def repair_done(state: DataFrame, listings: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """Resumable ids that are already in the output become done."""
    return repair_seen(state, distinct_ids(listings).withColumn("_seen", F.lit(True)), max_attempts)


def repair_seen(state: DataFrame, seen: DataFrame, max_attempts: int = MAX_ATTEMPTS) -> DataFrame:
    """The same from distinct ids marked `_seen`."""
    due = F.col("status").isin(*RESUMABLE) & (attempts_of() < max_attempts) & F.col("_seen")
    return (
        state.join(seen, "place_id", "left")
        .withColumn("status", F.when(due, "done").otherwise(F.col("status")))
        .select(*state.columns)
    )


def claim_batch(state: DataFrame, shard: str, size: int, order: Sequence[str]) -> DataFrame:
    """The next `size` queued ids of every shard, marked as being scraped."""
    turn = Window.partitionBy(shard).orderBy(*order)
    return (
        state.filter(F.col("status") == "queued")
        .withColumn("_turn", F.row_number().over(turn))
        .filter(F.col("_turn") <= size)
        .withColumns({"status": F.lit("scraping"), "attempts": attempts_of() + 1})
        .drop("_turn")
    )


def reclaim_leases(state: DataFrame, now: Column, minutes: int = LEASE_MINUTES) -> DataFrame:
    """Leases older than the limit go back to the queue."""
    late = (F.col("status") == "scraping") & (
        F.col("updated_at") < now - F.expr(f"INTERVAL {minutes} MINUTES")
    )
    return state.withColumn("status", F.when(late, "queued").otherwise(F.col("status")))


def merge_results(state: DataFrame, results: DataFrame) -> DataFrame:
    """Results with `accepted`: true only for the version that is out on lease."""
    lease = state.select("place_id", attempts_of().alias("_lease"))
    return (
        results.join(lease, "place_id", "left")
        .withColumn("accepted", F.coalesce(F.col("attempts") == F.col("_lease"), F.lit(False)))
        .drop("_lease")
    )


def with_claims(state: DataFrame, claimed: DataFrame) -> DataFrame:
    """The state after a claim: claimed ids with their new status and attempts."""
    taken = claimed.select("place_id", F.col("status").alias("_status"), F.col("attempts").alias("_attempts"))
    return state.join(taken, "place_id", "left").withColumns({
        "status": F.coalesce("_status", "status"),
        "attempts": F.coalesce("_attempts", attempts_of()).cast(state.schema["attempts"].dataType),
    }).select(*state.columns)


def apply_results(state: DataFrame, merged: DataFrame) -> DataFrame:
    """The state after a flush: accepted outcomes become statuses (done, if an id came back both ways), stale ones do nothing."""
    outcome = merged.filter("accepted").groupBy("place_id").agg(F.min("outcome").alias("_outcome"))
    return state.join(outcome, "place_id", "left").withColumn("status", F.coalesce("_outcome", "status")).select(*state.columns)


def flush_totals(merged: DataFrame, batch: Sequence[str], seconds: Column | None = None) -> DataFrame:
    done = F.count_if(F.col("outcome") == "done")
    failed = F.count_if(F.col("outcome") == "failed")
    extra = [] if seconds is None else [
        ((done + failed) / F.greatest(F.lit(0.001), seconds)).alias("rate")
    ]
    return merged.groupBy(*batch).agg(
        done.alias("done"), failed.alias("failed"),
        F.count_if("accepted").alias("accepted"), F.count_if(~F.col("accepted")).alias("stale"), *extra,
    )


def _last_given(c: str, order: Sequence[str]) -> Column:
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.struct(*order)))


def cell_columns(order: Sequence[str]) -> dict[str, Column]:
    """What a cell's updates amount to: the last write, a null place count or error text keeping the earlier value."""
    turn = F.struct(*order)
    return {
        "status": F.max_by("status", turn),
        "last_attempted_at": F.max_by("last_attempted_at", turn),
        "place_count": F.coalesce(_last_given("place_count", order), F.lit(0)),
        "error_msg": F.coalesce(F.substring(_last_given("error_msg", order), 1, ERROR_TEXT_LIMIT), F.lit("")),
    }


def place_columns(order: Sequence[str]) -> dict[str, Column]:
    """What a place's updates amount to: the last write, attempts added up, an absent error keeping the earlier one."""
    return {
        "status": F.max_by("status", F.struct(*order)),
        "attempts": F.sum("attempts_inc"),
        "last_error": F.substring(_last_given("last_error", order), 1, ERROR_TEXT_LIMIT),
    }


def latest_cells(updates: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per cell; a null place count or error text keeps the earlier value."""
    return updates.groupBy(*key).agg(*[c.alias(n) for n, c in cell_columns(order).items()])


def latest_state(updates: DataFrame, key: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Last write per key; attempts add up and an absent error keeps the earlier one."""
    found = place_columns(order)
    found["last_error"] = F.coalesce(found["last_error"], F.lit(""))
    found["updated_at"] = F.max_by("updated_at", F.struct(*order))
    return updates.groupBy(*key).agg(*[c.alias(n) for n, c in found.items()])


def seed_markers(state: DataFrame, markers: DataFrame) -> DataFrame:
    """The markers; where none were ever kept, a seed row for every id done before they were."""
    seeds = done_places(state).select(
        "place_id", F.lit("").alias("expected"), F.lit("").alias("saved"), F.lit("seed").alias("completed_at")
    )
    none_kept = markers.agg(F.count(F.lit(1)) == 0).scalar()
    return markers.select(*seeds.columns).unionByName(seeds.filter(none_kept))


def scraped_gate(rows: DataFrame) -> DataFrame:
    """Adds `outcome`, `error` and `error_class`; blank and FAILED names did not scrape."""
    name = strip(blank("name"))
    missed = name.isin("", "FAILED")
    text = F.coalesce(filled("error"), F.lit("blank result"))
    return rows.withColumns(
        {
            "outcome": F.when(missed, "failed").otherwise("done"),
            "error": F.when(missed, text),
            "error_class": F.when(missed, classify_error(text)),
        }
    )


def dead_letters(gated: DataFrame) -> DataFrame:
    """Failure rows to append, labelled by class; a transient one has used up its retries."""
    label = F.when(F.col("error_class") == "permanent", "PermanentError").otherwise("RetryExhausted")
    return gated.filter(F.col("outcome") == "failed").select(
        "place_id", place_url("place_id").alias("url"), label.alias("error_class"),
        F.substring(blank("error"), 1, ERROR_TEXT_LIMIT).alias("error_msg"), "attempted_at",
    )
