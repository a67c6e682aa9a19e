"""API keys: inventory, usage, quotas and throttling."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.functions.outcomes import billing_day
from placegrid.functions.values import parse_quota
from placegrid.operators import keys as K
from placegrid.plans.registry import query

DAY = "2024-01-15"

_INVENTORY = """
lines AS (SELECT *, row_number() OVER (ORDER BY pos) AS key_id FROM v_keys),
inventory AS (SELECT key_id, coalesce(nullif(alias, ''), 'csv#' || key_id) AS alias, trim(api_key) <> '' AS has_key,
  lower(trim(is_active)) NOT IN ('0', 'false', 'no', 'n') AS is_active,
  CASE lower(daily_quota) WHEN '1e0' THEN 1 WHEN '0.5' THEN NULL WHEN '-3' THEN NULL
    ELSE CASE WHEN regexp_full_match(daily_quota, '[1-9]') THEN CAST(daily_quota AS BIGINT) END END AS quota FROM lines)"""
_USAGE = """
usage AS (SELECT strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d') AS day, user_key AS alias, count(*) AS calls FROM v_calls GROUP BY ALL)"""
_STATUS = f"""{_INVENTORY}, {_USAGE},
used AS (SELECT i.*, coalesce(u.calls, 0) AS n FROM inventory i LEFT JOIN usage u ON i.alias = u.alias AND u.day = '{DAY}'),
status AS (SELECT key_id, alias, is_active, n AS day_count, coalesce(quota, 0) AS quota,
  is_active AND quota IS NOT NULL AND n >= quota AS exhausted,
  is_active AND NOT (quota IS NOT NULL AND n >= quota) AS available FROM used)"""


def _inventory(t):
    return K.key_inventory(t.keys, "pos")


def _usage(t):
    return K.usage_of(t.calls.withColumn("alias", F.col("user_key")))


def _status(t):
    return K.key_status(_inventory(t), _usage(t), DAY)


@query("A9 I25", f"WITH {_INVENTORY} SELECT * FROM inventory")
def key_inventory(t):
    return _inventory(t)


@query("C12", f"WITH {_INVENTORY} SELECT key_id, alias FROM inventory WHERE is_active AND has_key")
def active_keys(t):
    return K.active_keys(_inventory(t)).select("key_id", "alias")


@query("I25", """
SELECT pos, CASE WHEN regexp_full_match(daily_quota, '[1-9]') THEN CAST(daily_quota AS BIGINT) WHEN daily_quota = '1e0' THEN 1 END AS quota FROM v_keys""")
def parsed_quotas(t):
    return t.keys.select("pos", parse_quota("daily_quota").alias("quota"))


@query("I26", "SELECT event_id, strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d') AS day FROM v_calls")
def billing_days(t):
    return t.calls.select("event_id", F.date_format(billing_day("ts"), "yyyy-MM-dd").alias("day"))


@query("E6 I26", f"WITH {_USAGE} SELECT * FROM usage")
def key_usage(t):
    return _usage(t)


# Ledger of even users plus the growth since a flush after half of the events.
@query("E6", f"""WITH {_USAGE},
flushed AS (SELECT strftime(ts - INTERVAL 7 HOUR, '%Y-%m-%d') AS day, user_key AS alias, count(*) AS calls FROM v_calls
  WHERE event_id % 2 = 0 GROUP BY ALL),
deltas AS (SELECT u.day, u.alias, u.calls - coalesce(f.calls, 0) AS calls FROM usage u LEFT JOIN flushed f ON u.day = f.day AND u.alias = f.alias),
both_rows AS (SELECT * FROM usage WHERE alias LIKE '%4' UNION ALL SELECT * FROM deltas WHERE calls <> 0)
SELECT day, alias, CAST(sum(calls) AS BIGINT) AS calls FROM both_rows GROUP BY ALL""")
def usage_add(t):
    flushed = K.usage_of(t.calls.filter("event_id % 2 = 0").withColumn("alias", F.col("user_key")))
    ledger = _usage(t).filter("alias like '%4'")
    return K.usage_add(ledger, K.usage_deltas(_usage(t), flushed))


@query("H5", f"WITH {_USAGE} SELECT * FROM usage WHERE day >= '2024-01-12'")
def prune_ledger(t):
    return K.prune_ledger(_usage(t), F.lit("2024-01-20").cast("date"))


@query("D8", f"WITH {_STATUS} SELECT * FROM status")
def key_status(t):
    return _status(t)


@query("E5 D8", f"""WITH {_STATUS}
SELECT count(*) AS configured, count(*) FILTER (is_active) AS active, count(*) FILTER (available) AS available,
  count(*) FILTER (is_active AND quota > 0) AS capped, count(*) FILTER (is_active AND quota = 0) AS unlimited,
  CAST(sum(day_count) AS BIGINT) AS day_calls, CAST(coalesce(sum(quota) FILTER (is_active AND quota > 0), 0) AS BIGINT) AS quota_total,
  CAST(coalesce(sum(day_count) FILTER (is_active AND quota > 0), 0) AS BIGINT) AS quota_used FROM status""")
def key_totals(t):
    return K.key_totals(_status(t))


@query("G3", f"WITH {_STATUS} SELECT * FROM status ORDER BY exhausted DESC, is_active DESC, day_count DESC, key_id LIMIT 40")
def top_keys(t):
    return K.top_keys(_status(t))


@query("E8", f"""WITH {_USAGE}
SELECT CAST(sum(calls) AS BIGINT) AS api_calls, round(sum(calls) * 2.5 / 1000, 6) AS cost_usd FROM usage""")
def call_cost(t):
    return K.call_cost(_usage(t), 2.5).withColumn("cost_usd", F.round("cost_usd", 6))


_THROTTLE = """
c AS (SELECT *, status = 429 AS hit, status <> 429 AND NOT auth_failed AS reset FROM v_calls),
g AS (SELECT *, count(*) FILTER (reset) OVER (PARTITION BY alias ORDER BY ts, event_id) AS grp FROM c),
s AS (SELECT *, count(*) FILTER (hit) OVER (PARTITION BY alias, grp ORDER BY ts, event_id) AS streak,
  count(*) FILTER (hit) OVER (PARTITION BY alias ORDER BY ts, event_id) AS rate_limit_hits FROM g)"""


@query("F11", f"WITH {_THROTTLE} SELECT event_id, alias, streak, hit AND streak % 2 = 0 AS parked, rate_limit_hits FROM s")
def throttle_streaks(t):
    calls = t.calls.withColumn("ts", F.col("ts").cast("timestamp"))
    return K.throttle_streaks(calls, ["ts", "event_id"]).select(
        "event_id", "alias", "streak", "parked", "rate_limit_hits"
    )
