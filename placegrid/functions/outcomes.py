"""Classifying errors, cells, calls, jobs and run progress."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placegrid.functions.values import blank, col
from placegrid.schemas import ERROR_TEXT_LIMIT

# Error texts, auth markers, job states, the billing day's first hour.
PERMANENT_HINTS = (
    "not found", "no longer exists", "invalid place_id", "404", "permanently closed",
)
AUTH_STATUS = (400, 401, 403)
AUTH_MARKERS = (
    "api key expired",
    "renew the api key",
    "api key not valid",
    "api_key_invalid",
    "permission_denied",
    "permission denied",
    "the request is missing a valid api key",
)
SUCCEEDED = "JOB_STATE_SUCCEEDED"
CANCELLED = "JOB_STATE_CANCELLED"
BAD_STATES = ("JOB_STATE_FAILED", "JOB_STATE_EXPIRED", CANCELLED)
BILLING_HOUR = 7
RATE_LIMITED = "all key attempts rate-limited (HTTP 429)"
NO_COVERAGE = "No Places API coverage: HTTP "
PARTIAL = "Partial Places API result: HTTP "


def _mentions(text: Column, hints) -> Column:
    found = F.lit(False)
    for hint in hints:
        found = found | text.contains(hint)
    return found


def classify_error(c: Column | str) -> Column:
    """'permanent' when a permanent hint appears, otherwise 'transient'."""
    return F.when(_mentions(F.lower(blank(c)), PERMANENT_HINTS), "permanent").otherwise("transient")


def is_auth_error(status: Column | str, body: Column | str) -> Column:
    return F.coalesce(
        col(status).isin(*AUTH_STATUS) & _mentions(F.lower(blank(body)), AUTH_MARKERS), F.lit(False)
    )


def cell_outcome(fail_code: Column | str, ok: Column | str) -> Column:
    """struct<state_status, stats_status, error_msg> of one searched cell."""
    code, pages = col(fail_code), col(ok)
    failed = (code == 429) | (code.isNotNull() & (pages == 0))
    text = code.cast("string")
    return F.struct(
        F.when(failed, "failed").otherwise("done").alias("state_status"),
        F.when(code.isNull(), "done")
        .when((code != 429) & (pages == 0), "failed")
        .when(code == 429, "failed")
        .otherwise("partial").alias("stats_status"),
        F.when(code.isNull(), "")
        .when(code == 429, RATE_LIMITED)
        .when(pages == 0, F.concat(F.lit(NO_COVERAGE), text))
        .otherwise(F.concat(F.lit(PARTIAL), text)).alias("error_msg"),
    )


def billing_day(ts: Column | str) -> Column:
    """The UTC date of a day that begins at seven."""
    return F.to_date(col(ts) - F.expr(f"INTERVAL {BILLING_HOUR} HOURS"))


def effective_state(state, requests, pending) -> Column:
    """A success with every request still pending was really cancelled."""
    n, left = F.coalesce(col(requests), F.lit(0)), F.coalesce(col(pending), F.lit(0))
    unmet = (col(state) == SUCCEEDED) & (n > 0) & (left >= n)
    return F.when(unmet, CANCELLED).otherwise(col(state))


def job_error(state: Column, error: Column) -> Column:
    text = F.when(blank(error) == "", state).otherwise(F.substring(error, 1, ERROR_TEXT_LIMIT))
    return F.when(state.isin(*BAD_STATES), text)


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole)


def eta(remaining: Column | str, rate: Column | str) -> Column:
    return ratio(col(remaining), col(rate))


def projected_remaining(discovered, scraped, total, done) -> Column:
    """Places still to come if the untouched cells yield like the finished ones."""
    grown = F.when(
        col(done) > 0, F.floor(col(discovered) * (col(total) / F.nullif(col(done), F.lit(0))) + 0.5)
    ).otherwise(col(discovered))
    return F.greatest(F.lit(0), grown - col(scraped))
