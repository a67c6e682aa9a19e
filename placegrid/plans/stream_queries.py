"""Streaming forms over the driver tables, drained and compared with the table forms."""

from __future__ import annotations

from pyspark.sql import functions as F

from placegrid.plans import key_queries, state_queries
from placegrid.plans.registry import query
from placegrid.plans.views import pieces
from placegrid.session import scratch_path
from placegrid.sources import writers as O
from placegrid.streaming import jobs as J

_LINE = """SELECT 'ChIJ' || l_partkey AS place_id FROM lineitem"""


def _stream(t, name: str):
    return J.stream_table(t.spark, t.sf_dir, f"{name}.parquet", files_per_batch=1)


FILE_ROWS, TEXT_FILE_ROWS = 500_000, 20_000  # a file, and so a task that reads it, holds no more of a large table


def _stream_of_files(t, table, batches: int = 3):
    """A table, or any rows, cut into micro-batches of as many files each: one, or as many as a large table needs."""
    (folder,) = _paths(t, "cut")
    rows = t.base(table) if isinstance(table, str) else table
    files = pieces(rows, batches * FILE_ROWS)
    rows.repartition(batches * files).write.parquet(folder)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _paths(t, *names: str):
    root = scratch_path(t.spark, "stream")
    return [f"{root}/{n}" for n in names]


@query("K1 A5", "SELECT run_id, seq, discovered FROM v_live")
def stream_heartbeats(t):
    source, out, check = _paths(t, "beats", "out", "check")
    rows = t.live.withColumnRenamed("seq", "queue").drop("queue_depth").withColumnRenamed("queue", "queue_depth")
    rows.write.json(source)
    beats = J.stream_heartbeats(t.spark, source)
    J.drain(O.stream_append(beats, out, check, drain=True))
    return t.spark.read.parquet(out).select("run_id", F.col("queue_depth").alias("seq"), "discovered")


@query("K2", f"SELECT DISTINCT place_id FROM ({_LINE}) WHERE place_id NOT IN (SELECT place_id FROM v_known)")
def stream_dedupe(t):
    out, check = _paths(t, "out", "check")
    ids = _stream_of_files(t, "lineitem").select(F.concat(F.lit("ChIJ"), F.col("l_partkey").cast("string")).alias("place_id"))
    J.drain(O.stream_append(J.stream_dedupe(ids, t.known, event_time=None), out, check, drain=True))
    return t.spark.read.parquet(out)


@query("K2", "SELECT DISTINCT 'u' || user_id AS place_id FROM events")
def stream_dedupe_bounded(t):
    out, check = _paths(t, "out", "check")
    ids = _stream(t, "events").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("place_id"), F.col("ts").cast("timestamp").alias("ts")
    )
    none = t.known.limit(0)
    J.drain(O.stream_append(J.stream_dedupe(ids, none, "ts", "60 days"), out, check, drain=True))
    return t.spark.read.parquet(out).select("place_id")


@query("B3", "SELECT event_id, event_type FROM events")
def stream_append(t):
    out, check = _paths(t, "out", "check")
    J.drain(O.stream_append(_stream_of_files(t, "events").select("event_id", "event_type"), out, check, drain=True))
    return t.spark.read.parquet(out)


@query("K3 G9 B4", """
SELECT user, arg_max(event_type, event_id) AS status, count(*) FILTER (event_type = 'error') AS attempts,
  arg_max('err ' || event_id, event_id) FILTER (event_type = 'error') AS last_error
FROM (SELECT user_id AS user, event_id, event_type FROM events) GROUP BY ALL""")
def stream_state(t):
    root, check = _paths(t, "state", "check")
    failed = F.col("event_type") == "error"
    updates = _stream_of_files(t, "events").select(
        F.col("user_id").alias("user"), F.col("event_type").alias("status"),
        F.when(failed, 1).otherwise(0).cast("bigint").alias("attempts_inc"),
        F.when(failed, F.concat(F.lit("err "), F.col("event_id").cast("string"))).alias("last_error"), "event_id",
    )
    J.drain(J.stream_state(updates, root, check, ["user"], ["event_id"], every=None))
    return J.current_state(t.spark, root, ["user"]).select("user", "status", "attempts", "last_error")


@query("K3 G9", state_queries.LATEST_CELLS)
def stream_cells(t):
    """The cell form, with the changes of its first files compacted away."""
    root, check, source = _paths(t, "state", "check", "cells")
    rows = state_queries.cell_updates(t)
    folders = [f"{source}/{n}" for n in ("first", "later")]
    for n, folder in enumerate(folders):
        rows.filter(F.col("seq") % 2 == n).repartition(2).write.parquet(folder)
        updates = t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(source)
        J.drain(J.stream_cells(updates, root, check, ["cell_id", "query"], ["seq"], every=None))
        if not n:
            J.compact_state(t.spark, root, ["cell_id", "query"])
    return J.current_state(t.spark, root, ["cell_id", "query"]).drop("batch")


@query("K4 F11", f"""WITH {key_queries._THROTTLE}
SELECT event_id, alias, streak, hit AND streak % 2 = 0 AS parked, rate_limit_hits FROM s""")
def stream_throttle(t):
    out, root, check = _paths(t, "out", "state", "check")
    kind, at = F.col("event_type"), F.col("event_id")
    auth = (kind == "purchase") & (at % 7 == 0)
    calls = _stream(t, "events").select(
        F.concat(F.lit("key-"), (F.col("user_id") % 33).cast("string")).alias("alias"),
        F.when(kind.isin("error", "signup"), 429).when(auth, 403).when((kind == "click") & (at % 3 == 0), 500)
        .otherwise(200).alias("status"),
        auth.alias("auth_failed"), F.col("ts").cast("timestamp").alias("ts"), "event_id",
    )
    J.drain(J.stream_throttle(calls, out, root, check, ["ts", "event_id"], every=None))
    return t.spark.read.parquet(out).select("event_id", "alias", "streak", "parked", "rate_limit_hits")


@query("K5", """
WITH e AS (SELECT user_id % 10 AS worker, epoch_us(ts) // 1000000 AS sec FROM events),
last AS (SELECT max(epoch_us(ts)) // 1000000 - 10 AS mark FROM events),
w AS (SELECT worker, sec - sec % 10 - 10 * i AS start FROM e, (SELECT unnest(range(0, 6)) AS i) x)
SELECT worker, start, count(*) AS completions, round(count(*) / 60.0, 6) AS rate FROM w, last WHERE start + 60 <= mark GROUP BY ALL""")
def stream_rates(t):
    out, check = _paths(t, "out", "check")
    events = _stream(t, "events").select(
        (F.col("user_id") % 10).alias("worker"), F.col("ts").cast("timestamp").alias("ts")
    )
    J.drain(O.stream_append(J.stream_rates(events, "worker", "ts"), out, check, drain=True))
    return t.spark.read.parquet(out).select(
        "worker", F.unix_timestamp("window_start").alias("start"), "completions", F.round("rate", 6).alias("rate")
    )


# The events held back come in a file of their own, two micro-batches after the one that moves the watermark.
_HELD = """
e AS (SELECT user_id % 10 AS worker, epoch_us(ts) // 1000000 AS sec, epoch_us(ts) // 1000 AS ms, event_id % 97 = 0 AS held, event_id FROM events),
last AS (SELECT max(ms) - 10000 AS mark FROM e WHERE NOT held),
w AS (SELECT e.*, sec - sec % 10 - 10 * i AS start, mark FROM e, last, (SELECT unnest(range(0, 6)) AS i) x)"""


def _held_back(t):
    (source,) = _paths(t, "events")
    events = t.base("events").select(
        (F.col("user_id") % 10).alias("worker"), F.col("ts").cast("timestamp").alias("ts"), "event_id")
    held, ms = F.col("event_id") % 97 == 0, F.unix_millis("ts")
    newest = events.filter(~held).agg(F.max(ms)).first()[0] or 0
    between = (ms > newest - 10_000) & (ms < newest)
    for part in (~held & ~between, ~held & between, held):
        events.filter(part).repartition(1).write.mode("append").parquet(source)
    return t.spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(source)


@query("K5", f"""WITH {_HELD}
SELECT worker, start, count(*) AS completions, round(count(*) / 60.0, 6) AS rate FROM w WHERE NOT held OR (start + 60) * 1000 > mark GROUP BY ALL""")
def stream_rate_table(t):
    """Every window, the last ones too; what came too late for a window is not in it."""
    root, check = _paths(t, "rates", "check")
    J.drain(J.stream_rate_table(_held_back(t), "worker", "ts", root, check, every=None))
    return J.current_rates(t.spark, root, "worker").select(
        "worker", F.unix_timestamp("window_start").alias("start"), "completions", F.round("rate", 6).alias("rate"))


@query("K5", f"""WITH {_HELD}
SELECT event_id, CAST(count(*) AS INTEGER) AS windows_lost FROM w WHERE held AND (start + 60) * 1000 <= mark GROUP BY event_id""")
def stream_late(t):
    out, check = _paths(t, "late", "check")
    J.drain(J.stream_late(_held_back(t), "ts", out, check, every=None))
    return t.spark.read.parquet(f"{out}/rows").select("event_id", "windows_lost")


def _streamed_results(t):
    out, totals, check = _paths(t, "out", "totals", "check")
    results = _stream_of_files(t, "lineitem").select(
        F.concat(F.lit("ChIJ"), F.col("l_partkey").cast("string")).alias("place_id"),
        (F.col("l_linenumber") % 7).alias("attempts"),
        F.when(F.col("l_returnflag") == "R", "failed").otherwise("done").alias("outcome"), F.col("l_orderkey").alias("o1"),
    )
    J.drain(J.stream_results(results, lambda spark: t.state_places, out, totals, check, every=None))
    return out, totals


@query("K6 D9", f"WITH {state_queries._MERGED} SELECT place_id, attempts, outcome, o1, accepted FROM merged")
def stream_results(t):
    out, _ = _streamed_results(t)
    rows = t.spark.read.parquet(out).withColumn("accepted", F.col("accepted").cast("boolean"))
    return rows.select("place_id", "attempts", "outcome", "o1", "accepted")


@query("K6 E16", f"""WITH {state_queries._MERGED}
SELECT count(*) FILTER (outcome = 'done') AS done, count(*) FILTER (outcome = 'failed') AS failed,
  count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS stale FROM merged""")
def stream_flush_totals(t):
    _, totals = _streamed_results(t)
    flushed = t.spark.read.parquet(totals)
    return flushed.agg(*[F.sum(c).alias(c) for c in ("done", "failed", "accepted", "stale")])


# One event in 25 ms: 1,200 fall into an interval of 30 seconds, of which the limits keep the newest.
@query("K9 F10", """
WITH m AS (SELECT doc_id, doc_id // 1200 * 30 AS interval, printf('1970-01-01T%02d:%02d:%02dZ', doc_id // 144000, doc_id // 2400 % 60, doc_id // 40 % 60) AS ts,
  CASE WHEN length(text) > 2000 THEN left(text, 2000) || '...' ELSE text END AS msg, source FROM documents
  QUALIFY row_number() OVER (PARTITION BY doc_id // 1200 ORDER BY doc_id DESC) <= 500),
b AS (SELECT doc_id, interval, CAST(strlen(to_json({'id': doc_id, 'ts': ts, 'level': 'INFO', 'name': source, 'msg': msg, 'phase': '', 'cell_id': '', 'place_id': ''})) AS BIGINT) AS bytes FROM m),
r AS (SELECT *, CAST(sum(bytes) OVER (PARTITION BY interval ORDER BY doc_id DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS tail_bytes FROM b)
SELECT doc_id, interval, bytes, tail_bytes FROM r WHERE tail_bytes <= 262144""")
def stream_log_events(t):
    out, source, check = _paths(t, "out", "logs", "check")
    # several files, so that the events of one interval come in several micro-batches
    rows = t.base("documents").select("doc_id", "text", "source")
    n = pieces(rows, 5 * TEXT_FILE_ROWS)
    (rows.repartition(5 * n) if n > 1 else rows.repartition(5, F.col("doc_id") % 7)).write.parquet(source + "/logs")
    files = t.spark.readStream.schema("doc_id bigint, text string, source string").option("maxFilesPerTrigger", 2 * n)
    logs = files.parquet(source + "/logs")
    at = F.timestamp_millis(F.col("doc_id") * 25)
    logs = logs.select(
        "doc_id", F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), F.lit("INFO").alias("level"), F.col("source").alias("name"), F.col("text").alias("msg"),
        F.lit("").alias("phase"), F.lit("").alias("cell_id"), F.lit("").alias("place_id"),
    )
    J.drain(J.stream_log_events(logs, out, check, ["doc_id"], every=None, id="doc_id"))
    return t.spark.read.parquet(out).select("doc_id", F.col("interval").cast("bigint").alias("interval"), "bytes", "tail_bytes")


