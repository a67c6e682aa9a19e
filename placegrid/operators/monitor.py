"""Run reports: heartbeats, rates, summaries and logs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.functions.outcomes import eta, projected_remaining
from placegrid.functions.values import blank, filled
from placegrid.operators.ordered import even_chunks, join_same, previous, row_index, trailing, trailing_count

# Rate windows in seconds, log tail limits, log levels, the anomaly pattern and the log line format.
RATE_WINDOW, RATE_MIN_SECONDS = 15, 3
COMPLETION_WINDOW = 60
TAIL_ROWS, TAIL_BYTES, MESSAGE_LIMIT = 500, 262144, 2000
ERROR_LEVELS = ("error", "err", "critical", "fatal")
WARN_LEVELS = ("warning", "warn", *ERROR_LEVELS)
ANOMALY = (
    r"(?i)\b429\b|rate.?limit|ratelimit|cooldown|retir|failed|crash|exception|exhausted|"
    r"fallback|phase2_disabled|threadpool_start"
)
# Fixed value: the format of a log line.
LOG_LINE = r"(?sU)^([\d:.\- T]+)?\s*\[([A-Z]+)\]\s*(?:\[([^\]]*)\]\s*)?([\w.]+)?:?\s*(.*)$"
RUN_DEFAULTS = {
    "osm_type": "relation",
    "grid_size_meters": 250,
    "num_consumer_threads": 8,
    "discovery_backend": "places_api",
    "places_tier": "ESSENTIALS",
}
COUNTERS = (
    "discovered", "scraped", "errors", "queue_depth", "api_calls", "active_keys",
    "cells_done", "cells_failed", "cells_partial", "cells_in_flight", "cells_total",
    "grid_cells_total", "placeids_done", "placeids_failed", "placeids_pending",
)
LIVE_ARRAYS = ("workers", "api_keys")
STATE_COUNTERS = (
    "cells_done", "cells_total", "grid_cells_touched", "grid_cells_total", "queries_total",
    "placeids_total", "placeids_done", "placeids_failed", "placeids_pending",
)
GAUGES = ("rps_inst", "elapsed_s", "cost_usd", "discovery_rps")
_MICROS = 1_000_000


def latest_heartbeat(beats: DataFrame, order: Sequence[str], key: str = "run_id") -> DataFrame:
    """The last record of every run by position; a run's clock restarts on resume."""
    rest = [c for c in beats.columns if c != key]
    return beats.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def live_or_latest(live: DataFrame, latest: DataFrame, key: str = "run_id") -> DataFrame:
    """The full snapshot of a run where one exists, else its last heartbeat."""
    missing = latest.join(live.select(key), key, "left_anti")
    return live.unionByName(missing, allowMissingColumns=True)


def _micros(ts: str) -> Column:
    return F.unix_micros(F.col(ts).cast("timestamp"))


def _time_chunk(rows: DataFrame, seconds: int | None) -> Column:
    return even_chunks(rows, "at") if seconds is None else F.floor(F.col("at") / (seconds * _MICROS))


def sliding_rate(
    beats: DataFrame, key: str, ts: str, value: str,
    window: int = RATE_WINDOW, min_seconds: int = RATE_MIN_SECONDS, chunk_seconds: int | None = None,
) -> DataFrame:
    """Growth per second at every change of `value`, over the trailing window.

    Samples before the first positive one are skipped; with nothing else in the
    window the previous change is the anchor. Long runs are cut by time, evenly over
    all samples unless `chunk_seconds` says otherwise.
    """
    samples = beats.select(key, _micros(ts).alias("at"), F.coalesce(value, F.lit(0)).alias("v"))
    began = samples.filter("v > 0").groupBy(key).agg(F.min("at").alias("_began"))
    samples = join_same(samples, began, [key]).filter("at >= _began").drop("_began")
    chunk = _time_chunk(samples, chunk_seconds)
    stepped = previous(samples, [key], chunk, ["at", "v"], F.col("v"), "_prev")
    changes = stepped.filter(F.col("_prev").isNull() | (F.col("v") != F.col("_prev"))).drop("_prev")
    anchored = previous(changes, [key], chunk, ["at", "v"], F.struct("at", "v"), "_before")
    rows, look_back, own = trailing(anchored, [key], F.col("at"), window * _MICROS)
    first = F.min(F.struct("at", "v")).over(look_back)
    anchor = F.when(F.count(F.lit(1)).over(look_back) > 1, first).otherwise(F.col("_before"))
    seconds = (F.col("at") - F.col("_anchor.at")) / _MICROS
    gain = F.col("v") - F.col("_anchor.v")
    rate = F.when((seconds >= min_seconds) & (gain > 0), gain / seconds).otherwise(0.0)
    return (
        rows.withColumn("_anchor", anchor).filter(own)
        .select(key, "at", "v", F.coalesce(rate, F.lit(0.0)).alias("rate"))
    )


def completion_rate_1m(
    events: DataFrame, key: str, ts: str, tie: str, totals: DataFrame, chunk_seconds: int | None = None
) -> DataFrame:
    """Completions in the trailing minute per second, and the time left at that rate.

    `totals` holds `total` per run.
    """
    rows = events.select(key, _micros(ts).alias("at"), tie)
    chunk = _time_chunk(rows, chunk_seconds)
    counted = row_index(rows, [key], chunk, ["at", tie], "done")
    began = join_same(rows.groupBy(key).agg(F.min("at").alias("_began")), totals, [key])
    recent = trailing_count(counted, [key], F.col("at"), COMPLETION_WINDOW * _MICROS, "_n", rows)
    recent = join_same(recent, began, [key])
    elapsed = (F.col("at") - F.col("_began")) / _MICROS
    span = F.least(F.lit(float(COMPLETION_WINDOW)), F.greatest(F.lit(1.0), elapsed))
    remaining = F.greatest(F.lit(0), F.col("total") - F.col("done") - 1)
    return recent.withColumn("rate_1m", F.col("_n") / span).select(
        key, "at", tie, (F.col("done") + 1).alias("done"), "rate_1m",
        eta(remaining, "rate_1m").alias("eta_s"),
    )


def reconcile_counters(latest: DataFrame, counts: DataFrame, key: str = "run_id") -> DataFrame:
    """Heartbeat counters raised to what the state tables show."""
    pairs = {"discovered": "placeids_total", "scraped": "placeids_done", "errors": "placeids_failed"}
    joined = latest.select(key, *pairs).join(counts, key, "left")
    return joined.select(
        key,
        *[F.greatest(F.coalesce(a, F.lit(0)), F.coalesce(b, F.lit(0))).alias(a) for a, b in pairs.items()],
    )


def run_summary(
    config: DataFrame, live: DataFrame, active: DataFrame, counts: DataFrame | None = None, arrays: bool = False
) -> DataFrame:
    """One wide row per configured run, with defaults; `arrays` adds the live arrays, `counts` the detail columns.

    counts: run_id, phase1_rows, phase2_rows, failure_rows and what the state tables show
    (any of STATE_COUNTERS), which replaces the heartbeat's counters.
    """
    shown = [c for c in LIVE_ARRAYS if arrays and c in live.columns]
    beats = live.select("run_id", *COUNTERS, *GAUGES, "queries_total", *shown)
    rows = config.join(beats, "run_id", "left").join(active.select("run_id", "exit_code", F.lit(True).alias("_managed")), "run_id", "left")
    planned = F.greatest(F.coalesce(F.size("queries"), F.lit(0)), F.lit(0)).cast("bigint")
    nothing = F.array().cast("array<string>")
    relation = F.col("osm_relation_id") if "osm_relation_id" in config.columns else F.lit(None)
    columns = {
        "run_id": F.col("run_id"), "started_at": F.col("started_at"), "city": F.col("city_name"),
        "queries": F.coalesce("queries", nothing),
        "selected_columns": F.coalesce("selected_columns", nothing) if "selected_columns" in config.columns else nothing,
        "osm_relation_id": relation.cast("bigint"),
        **{c: F.coalesce(c, F.array().cast(live.schema[c].dataType)) for c in shown},
        **{c: F.coalesce(c, F.lit(d)) for c, d in RUN_DEFAULTS.items()},
        "active": F.coalesce(F.col("_managed") & F.col("exit_code").isNull(), F.lit(False)),
        "exit_code": F.col("exit_code"),
        **{c: F.coalesce(c, F.lit(0)) for c in COUNTERS},
        **{c: F.coalesce(c, F.lit(0.0)) for c in GAUGES},
        "queries_total": F.coalesce(F.nullif(F.col("queries_total"), F.lit(0)), planned),
    }
    if counts is None:
        return rows.select(*[e.alias(n) for n, e in columns.items()])
    rows = rows.join(counts.select("run_id", *[F.col(c).alias(f"_{c}") for c in counts.columns if c != "run_id"]), "run_id", "left")

    def seen(c: str) -> Column:
        return F.coalesce(f"_{c}", F.lit(0))

    columns |= {
        "discovered": F.greatest(columns["discovered"], seen("phase1_rows")),
        "scraped": F.greatest(columns["scraped"], seen("placeids_done"), seen("phase2_rows")),
        "errors": F.greatest(columns["errors"], seen("placeids_failed"), seen("failure_rows")),
        "phase1_csv_rows": seen("phase1_rows"), "phase2_csv_rows": seen("phase2_rows"),
        "failures_rows": seen("failure_rows"),
        **{c: seen(c) for c in STATE_COUNTERS if c in counts.columns},
    }
    return rows.select(*[e.alias(n) for n, e in columns.items()])


def global_stats(runs: DataFrame, today: str) -> DataFrame:
    """All runs at once: places, spend, today's calls, current speed, finished runs."""
    started_today = F.coalesce(F.col("started_at").startswith(today), F.lit(False))
    running = F.col("active") & (F.col("elapsed_s") > 0)
    speed = F.floor(60 * F.col("scraped") / F.greatest(F.lit(1.0), F.col("elapsed_s")))
    return runs.agg(
        F.count(F.lit(1)).alias("total_runs"),
        F.coalesce(F.sum("scraped"), F.lit(0)).alias("total_places"),
        F.round(F.coalesce(F.sum("cost_usd"), F.lit(0.0)), 2).alias("total_spend"),
        F.coalesce(F.sum(F.when(started_today, F.col("api_calls"))), F.lit(0)).alias("api_calls_today"),
        F.coalesce(F.sum(F.when(running, speed)), F.lit(0)).alias("throughput_per_min"),
        F.count_if(~F.col("active") & (F.col("scraped") > 0)).alias("archived_count"),
    )


def progress_pct(summary: DataFrame) -> DataFrame:
    """Done, scraped and error percentages, and the cells still to do."""
    def pct(part: Column, whole: Column) -> Column:
        return F.when(whole > 0, 100.0 * part / whole).otherwise(0.0)

    tried = F.col("placeids_done") + F.col("placeids_failed")
    left = F.col("cells_total") - F.col("cells_done") - F.col("cells_in_flight")
    return summary.withColumns(
        {
            "done_pct": F.round(pct(F.col("cells_done"), F.col("cells_total")), 1),
            "scraped_pct": F.round(F.least(F.lit(100.0), pct(F.col("scraped"), F.col("discovered"))), 1),
            "error_pct": F.round(pct(F.col("placeids_failed"), tried), 1),
            "cells_remaining": F.greatest(F.lit(0), left),
        }
    )


def progress_eta(progress: DataFrame, cell_rate: str, scrape_rate: str) -> DataFrame:
    """Seconds left in both phases at the given rates (null while nothing moves)."""
    places = projected_remaining("discovered", "scraped", "cells_total", "cells_done")
    return progress.withColumns(
        {"phase1_eta": eta("cells_remaining", cell_rate), "phase2_eta": eta(places, scrape_rate)}
    )


def row_counts(rows: DataFrame, key: str, legacy_lines: Column | None = None) -> DataFrame:
    """Data rows per file; with `legacy_lines` (line breaks in a record) physical lines instead."""
    n = F.count(F.lit(1)) if legacy_lines is None else F.sum(legacy_lines + 1)
    return rows.groupBy(key).agg(n.alias("rows"))


def parse_log_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """JSON records, human-readable records, else the raw line at INFO."""
    text = F.trim(F.col(value))
    fields = ("asctime", "timestamp", "levelname", "level", "name", "message", "msg", "cell_id", "place_id", "phase")
    as_json = F.when(
        text.startswith("{") & text.endswith("}"),
        F.from_json(text, ", ".join(f"{f} string" for f in fields) + ", _bad string",
                    {"columnNameOfCorruptRecord": "_bad", "mode": "PERMISSIVE"}),
    )
    parsed = (
        lines.withColumns({"_t": text, "_j": as_json})
        .withColumn("_json", F.col("_j").isNotNull() & F.col("_j._bad").isNull())
        .withColumn("_human", F.col("_t").rlike(LOG_LINE))
        .withColumn("_ctx", F.split(F.regexp_extract("_t", LOG_LINE, 3), "/"))
    )

    def pick(json: Sequence[str], human: Column, raw: str | Column, default: str = "") -> Column:
        found = F.coalesce(*[filled(F.col(f"_j.{n}")) for n in json], F.lit(default))
        return F.when(F.col("_json"), found).when(F.col("_human"), human).otherwise(raw)

    def group(i: int) -> Column:
        return F.regexp_extract("_t", LOG_LINE, i)

    def context(i: int) -> Column:
        return F.coalesce(F.get("_ctx", F.lit(i)), F.lit(""))

    return parsed.filter("_t <> ''").select(
        *[c for c in lines.columns if c != value],
        pick(("asctime", "timestamp"), F.trim(group(1)), "").alias("ts"),
        pick(("levelname", "level"), group(2), "INFO", "INFO").alias("level"),
        pick(("name",), group(4), "").alias("name"),
        pick(("message", "msg"), group(5), F.col("_t")).alias("msg"),
        pick(("phase",), context(1), "").alias("phase"),
        pick(("cell_id",), context(2), "").alias("cell_id"),
        pick(("place_id",), context(3), "").alias("place_id"),
    )


def filter_logs(logs: DataFrame, mode: str = "events") -> DataFrame:
    """all, errors, or events (warnings, errors and lines that look like an anomaly)."""
    level = F.lower(blank("level"))
    if mode == "all":
        return logs
    if mode == "errors":
        return logs.filter(level.isin(*ERROR_LEVELS))
    return logs.filter(level.isin(*WARN_LEVELS) | blank("msg").rlike(ANOMALY))


def tail_logs(logs: DataFrame, order: Sequence[str], n: int) -> DataFrame:
    return logs.orderBy(*[F.col(c).desc() for c in order]).limit(n)


def bounded_tail(
    events: DataFrame, order: Sequence[str], rows: int = TAIL_ROWS, size: int = TAIL_BYTES,
    id: str = "id", within: Sequence[str] = (), message_limit: int = MESSAGE_LIMIT,
) -> DataFrame:
    """The newest events that fit both limits, long messages cut; with `within`, of each of its groups.

    The size of an event is that of its record, its `id` included.
    """
    fields = (F.col(id).alias("id"), "ts", "level", "name", "msg", "phase", "cell_id", "place_id")
    message = F.when(
        F.length("msg") > message_limit, F.concat(F.substring("msg", 1, message_limit), F.lit("..."))
    ).otherwise(F.col("msg"))
    turn = Window.partitionBy(*within).orderBy(*[F.col(c).desc() for c in order])
    newest = turn.rowsBetween(Window.unboundedPreceding, 0)
    if within:
        tail = events.withColumn("_turn", F.row_number().over(turn)).filter(F.col("_turn") <= rows).drop("_turn")
    else:
        tail = tail_logs(events, order, rows)
    return (
        tail.withColumn("msg", message)
        .withColumn("bytes", F.octet_length(F.to_json(F.struct(*fields))).cast("bigint"))
        .withColumn("tail_bytes", F.sum("bytes").over(newest))
        .filter(F.col("tail_bytes") <= size)
    )
