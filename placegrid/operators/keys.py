"""API keys: inventory, daily usage, quotas and throttling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.functions.outcomes import billing_day
from placegrid.functions.values import first_filled, parse_quota, strip
from placegrid.operators.ordered import even_chunks, join_same, row_index

# Tokens of a switched-off key, its column aliases, throttle and ledger limits.
INACTIVE = ("0", "false", "no", "n")
KEY_COLUMNS = ("api_key", "key", "google_api_key")
ALIAS_COLUMNS = ("alias", "key_alias")
PARK_EVERY, PARK_SECONDS = 2, 30
KEEP_DAYS = 8
TOP_KEYS = 40
PRICE_PER_1K = 0.0


def _first_column(df: DataFrame, names) -> Column:
    found = [F.col(n) for n in names if n in df.columns]
    return first_filled(*found) if found else F.lit(None).cast("string")


def key_inventory(rows: DataFrame, position: str) -> DataFrame:
    """alias, activity, quota (null means no cap); the secret is not carried on.

    Keys without an alias are named after their 1-based line.
    """
    numbered = row_index(rows, [], even_chunks(rows, position), [position], "_line")
    active = F.lower(strip(F.coalesce("is_active", F.lit("1")))) if "is_active" in rows.columns else F.lit("1")
    quota = parse_quota("daily_quota") if "daily_quota" in rows.columns else F.lit(None).cast("bigint")
    line = F.col("_line") + 1
    return numbered.select(
        line.alias("key_id"),
        strip(F.coalesce(_first_column(rows, ALIAS_COLUMNS), F.concat(F.lit("csv#"), line))).alias("alias"),
        (strip(F.coalesce(_first_column(rows, KEY_COLUMNS), F.lit(""))) != "").alias("has_key"),
        (~active.isin(*INACTIVE)).alias("is_active"),
        quota.alias("quota"),
    ).filter("has_key or alias <> ''")


def active_keys(inventory: DataFrame) -> DataFrame:
    return inventory.filter("is_active and has_key")


def ledger_rows(ledger: DataFrame) -> DataFrame:
    """{day: {alias: n}} maps to one row per day and alias."""
    days = ledger.select(F.explode("ledger").alias("day", "m"))
    return days.select("day", F.explode("m").alias("alias", "calls"))


def usage_of(calls: DataFrame, ts: str = "ts") -> DataFrame:
    """Calls per billing day and key."""
    return calls.groupBy(F.date_format(billing_day(ts), "yyyy-MM-dd").alias("day"), "alias").agg(
        F.count(F.lit(1)).alias("calls")
    )


def usage_deltas(run_counts: DataFrame, flushed: DataFrame) -> DataFrame:
    """What each key gained since the last flush."""
    signed = run_counts.select("day", "alias", "calls").unionByName(
        flushed.select("day", "alias", (-F.col("calls")).alias("calls"))
    )
    return signed.groupBy("day", "alias").agg(F.sum("calls").alias("calls"))


def usage_add(ledger: DataFrame, deltas: DataFrame) -> DataFrame:
    """The ledger with the deltas added; a zero delta adds no row."""
    grown = ledger.select("day", "alias", "calls").unionByName(
        deltas.filter("calls <> 0").select("day", "alias", "calls")
    )
    return grown.groupBy("day", "alias").agg(F.sum("calls").alias("calls"))


def prune_ledger(ledger: DataFrame, today: Column) -> DataFrame:
    """Days within the last eight calendar days."""
    return ledger.filter(F.to_date("day") >= F.date_sub(today, KEEP_DAYS))


def key_status(inventory: DataFrame, usage: DataFrame, day: str) -> DataFrame:
    today = usage.filter(F.col("day") == day).groupBy("alias").agg(F.sum("calls").alias("_n"))
    used = F.coalesce("_n", F.lit(0))
    exhausted = F.col("is_active") & F.col("quota").isNotNull() & (used >= F.coalesce("quota", F.lit(0)))
    return inventory.join(today, "alias", "left").select(
        "key_id", "alias", "is_active", used.alias("day_count"),
        F.coalesce("quota", F.lit(0)).alias("quota"), exhausted.alias("exhausted"),
        (F.col("is_active") & ~exhausted).alias("available"),
    )


def key_totals(status: DataFrame) -> DataFrame:
    capped = F.col("is_active") & (F.col("quota") > 0)

    def total(c: str, where: Column) -> Column:
        return F.coalesce(F.sum(F.when(where, F.col(c))), F.lit(0))

    return status.agg(
        F.count(F.lit(1)).alias("configured"),
        F.count_if("is_active").alias("active"),
        F.count_if("available").alias("available"),
        F.count_if(capped).alias("capped"),
        F.count_if(F.col("is_active") & (F.col("quota") == 0)).alias("unlimited"),
        total("day_count", F.lit(True)).alias("day_calls"),
        total("quota", capped).alias("quota_total"),
        total("day_count", capped).alias("quota_used"),
    )


def top_keys(status: DataFrame, n: int = TOP_KEYS) -> DataFrame:
    return status.orderBy(
        F.col("exhausted").desc(), F.col("is_active").desc(), F.col("day_count").desc(), "key_id"
    ).limit(n)


def call_cost(calls: DataFrame, price_per_1k: float = PRICE_PER_1K) -> DataFrame:
    n = F.coalesce(F.sum("calls"), F.lit(0))
    return calls.agg(n.alias("api_calls"), (n * float(price_per_1k) / 1000).alias("cost_usd"))


def throttle_streaks(
    calls: DataFrame, order: list[str], chunk: Column | None = None, carry: DataFrame | None = None
) -> DataFrame:
    """Consecutive rate-limit answers per key; every second one parks the key.

    Any other answer ends a streak, except an auth error, which neither counts nor
    ends it. A busy key's calls are cut into chunks, even ones of the first order column
    unless `chunk` is given: each chunk reports its resets and the hits after its last
    one, and only those reports are scanned per key. Calls without a key are one key.
    `carry` (alias, streak, hits) continues from an earlier batch.
    """
    cut = even_chunks(calls, order[0]) if chunk is None else chunk
    hit = F.col("status") == 429
    reset = ~hit & ~F.col("auth_failed")
    part = Window.partitionBy("alias", "_chunk")
    so_far = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    streak_part = Window.partitionBy("alias", "_chunk", "_resets").orderBy(*order).rowsBetween(
        Window.unboundedPreceding, 0
    )
    rows = (
        calls.withColumn("_chunk", F.coalesce(cut.cast("bigint"), F.lit(-(1 << 62))))
        .withColumn("_resets", F.count_if(reset).over(so_far))
        .withColumns({"_in": F.count_if(hit).over(streak_part), "_hits": F.count_if(hit).over(so_far)})
    )
    reports = rows.groupBy("alias", "_chunk").agg(
        F.max_by(F.struct("_resets", "_in", "_hits"), F.struct(*order)).alias("r")
    ).select("alias", "_chunk", "r.*")
    by_chunk = Window.partitionBy("alias").orderBy("_chunk")
    all_before = by_chunk.rowsBetween(Window.unboundedPreceding, -1)
    run = Window.partitionBy("alias", "_group").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    begun = reports.withColumn(
        "_group", F.count_if(F.col("_resets") > 0).over(by_chunk.rowsBetween(Window.unboundedPreceding, 0))
    ).withColumn("_open", F.sum("_in").over(run))
    carried = begun.select(
        "alias", "_chunk",
        F.coalesce(F.lag("_open").over(by_chunk), F.lit(0)).alias("_from"),
        F.coalesce(F.lag("_group").over(by_chunk), F.lit(0)).alias("_since"),
        F.coalesce(F.sum("_hits").over(all_before), F.lit(0)).alias("_had"),
    )
    if carry is not None:
        carried = join_same(carried, carry, ["alias"], "left").select(
            "alias", "_chunk", "_since",
            (F.col("_from") + F.when(F.col("_since") == 0, F.coalesce("streak", F.lit(0))).otherwise(0)).alias("_from"),
            (F.col("_had") + F.coalesce("hits", F.lit(0))).alias("_had"),
        )
    streak = F.col("_in") + F.when(F.col("_resets") == 0, F.col("_from")).otherwise(0)
    return join_same(rows, carried, ["alias", "_chunk"]).select(
        *calls.columns,
        streak.alias("streak"),
        (hit & (streak % PARK_EVERY == 0)).alias("parked"),
        (F.col("_had") + F.col("_hits")).alias("rate_limit_hits"),
    )
