"""Streaming forms of the dataset operators.

Each builder returns a streaming DataFrame or starts a query; `drain` runs a
query over what is available and waits for it.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placegrid import schemas
from placegrid.operators.dedupe import anti_known, with_id
from placegrid.operators.keys import PARK_SECONDS, throttle_streaks
from placegrid.operators.monitor import bounded_tail
from placegrid.operators import state as S
from placegrid.operators.state import flush_totals, merge_results
from placegrid.sources.writers import read_snapshot, snapshot_version, write_snapshot

# Flush intervals, rate window and slide.
STATE_EVERY, RESULTS_EVERY = "3 seconds", "20 seconds"
RATE_WINDOW, RATE_SLIDE = "60 seconds", "10 seconds"


def stream_table(spark: SparkSession, folder: str, name: str, files_per_batch: int = 1000) -> DataFrame:
    """A Parquet table as a stream of its files."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    return (
        spark.readStream.schema(schema).option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch).parquet(folder)
    )


def stream_heartbeats(spark: SparkSession, folder: str) -> DataFrame:
    """Rolled heartbeat files, broken lines skipped."""
    return spark.readStream.schema(schemas.HEARTBEAT).option("mode", "DROPMALFORMED").json(folder)


def stream_dedupe(
    discovered: DataFrame, known: DataFrame, event_time: str | None = "ts", lateness: str = "1 day"
) -> DataFrame:
    """New ids across micro-batches. Remembered ids expire with the event time; without one they are kept for ever."""
    fresh = anti_known(with_id(discovered), known)
    if event_time is None:
        return fresh.dropDuplicates(["place_id"])
    return fresh.withWatermark(event_time, lateness).dropDuplicatesWithinWatermark(["place_id"])


def stream_rates(events: DataFrame, key: str, event_time: str, lateness: str = "10 seconds") -> DataFrame:
    """Completions per second over sliding minutes."""
    window = F.window(event_time, RATE_WINDOW, RATE_SLIDE)
    return (
        events.withWatermark(event_time, lateness).groupBy(key, window)
        .agg(F.count(F.lit(1)).alias("completions"))
        .select(key, F.col("window.start").alias("window_start"), "completions",
                (F.col("completions") / 60.0).alias("rate"))
    )


def stream_rate_table(
    events: DataFrame, key: str, event_time: str, root: str, checkpoint: str, lateness: str = "10 seconds", every: str | None = RESULTS_EVERY,
) -> StreamingQuery:
    """The same kept up in a table that `current_rates` reads: windows that are still open, and so the last ones, are in it.

    Windows behind the watermark leave the state store; what reaches them later is not counted but is among `stream_late`.
    """
    window = F.window(event_time, RATE_WINDOW, RATE_SLIDE)
    return stream_upserts(events.withWatermark(event_time, lateness), {"completions": F.count(F.lit(1))}, root, checkpoint, [key, window], every)


def current_rates(spark: SparkSession, root: str, key: str) -> DataFrame:
    """Completions per second of every window so far, in the columns of `stream_rates`."""
    return current_state(spark, root, [key, "window"]).select(
        key, F.col("window.start").alias("window_start"), "completions", (F.col("completions") / 60.0).alias("rate"))


def stream_late(
    events: DataFrame, event_time: str, out: str, checkpoint: str, lateness: str = "10 seconds", every: str | None = RESULTS_EVERY
) -> StreamingQuery:
    """Rows that came after the watermark had passed a window of theirs, with that watermark and `windows_lost`.

    `out/rows` gets them per batch; `out/marks` a row per batch with its newest event time: the watermark is the newest
    time of earlier batches less the lateness. Spark's aggregation lets go of windows a batch later, so the rates may
    still have counted a row that came in the very next batch. Take the same files per batch as the rates do.
    """
    slide, width = (F.expr(f"INTERVAL {w}") for w in (RATE_SLIDE, RATE_WINDOW))
    delay = F.expr(f"INTERVAL {lateness}")

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            marks = spark.read.schema("newest timestamp, batch bigint").parquet(f"{out}/marks")
            newest = marks.filter(F.col("batch") < batch_id).agg(F.max("newest")).first()[0]
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            newest = None
        at = F.col(event_time)
        batch.agg(F.max(at).alias("newest")).write.mode("overwrite").parquet(f"{out}/marks/batch={batch_id}")
        mark = F.timestamp_millis(F.unix_millis(F.lit(newest).cast("timestamp"))) - delay
        first = F.window(at, RATE_SLIDE)["end"]  # of the earliest window that holds the row
        lost = F.least(F.floor((F.unix_micros("watermark") - F.unix_micros("_first")) / _micros(slide)) + 1, _micros(width) / _micros(slide))
        late = batch.withColumns({"watermark": mark, "_first": first}).filter("_first <= watermark")
        late.withColumn("windows_lost", lost.cast("int")).drop("_first").write.mode("overwrite").parquet(f"{out}/rows/batch={batch_id}")

    return each_batch(events, checkpoint, apply, every)


def _micros(interval: Column) -> Column:
    epoch = F.timestamp_seconds(F.lit(0))
    return F.unix_micros(epoch + interval)


def each_batch(
    stream: DataFrame, checkpoint: str, apply: Callable[[DataFrame, int], None],
    every: str | None = None,
) -> StreamingQuery:
    """Run `apply` on every micro-batch; without an interval, on what is available now."""
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply)
    trigger = {"processingTime": every} if every else {"availableNow": True}
    return writer.trigger(**trigger).start()


def drain(query: StreamingQuery) -> None:
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()


def _stored(spark: SparkSession, root: str) -> DataFrame | None:
    version = snapshot_version(spark, root)
    return read_snapshot(spark, root, version) if version else None


def _holds(old: DataFrame | None, checkpoint: str, batch_id: int) -> bool:
    """Whether the stored state already holds this batch of this checkpoint; another checkpoint's state is an error."""
    if old is None:
        return False
    last = old.agg(F.max("batch_id").alias("batch"), F.min("checkpoint").alias("a"), F.max("checkpoint").alias("b")).first()
    if last.b is not None and (last.a, last.b) != (checkpoint, checkpoint):
        raise ValueError(f"the state was written from checkpoint {last.b}, not from {checkpoint}: use a new root")
    return last.batch is not None and last.batch >= batch_id


def _stamped(state: DataFrame, checkpoint: str, batch_id: int) -> DataFrame:
    return state.withColumns({"batch_id": F.lit(batch_id), "checkpoint": F.lit(checkpoint)})


def stream_upserts(
    updates: DataFrame, columns: dict[str, Column], root: str, checkpoint: str, key: Sequence[str | Column],
    every: str | None = STATE_EVERY,
) -> StreamingQuery:
    """Keyed state in Spark's state store; every batch writes the keys that it changed to `root`, and only these.

    `columns` are aggregates over all updates of a key, whatever batches they come in. `current_state` reads the
    table. A replayed batch overwrites its own folder. The state belongs to its checkpoint: another one on the same
    root stops instead of starting from nothing.
    """
    state = updates.groupBy(*key).agg(*[c.alias(n) for n, c in columns.items()])

    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        try:
            owners = spark.read.schema("checkpoint string").parquet(f"{root}/owner").distinct().collect()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            spark.createDataFrame([(checkpoint,)], "checkpoint string").write.parquet(f"{root}/owner")
            owners = []
        if any(r.checkpoint != checkpoint for r in owners):
            raise ValueError(f"the state was written from checkpoint {owners[0].checkpoint}, not from {checkpoint}: use a new root")
        batch.write.mode("overwrite").parquet(f"{root}/changes/batch={batch_id}")

    writer = state.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(apply)
    return writer.trigger(**({"processingTime": every} if every else {"availableNow": True})).start()


def current_state(spark: SparkSession, root: str, key: Sequence[str]) -> DataFrame:
    """The state of every key: its last change, or its row in the table that `compact_state` made."""
    changes = spark.read.parquet(f"{root}/changes")
    version = snapshot_version(spark, f"{root}/compact")
    if version:
        base = read_snapshot(spark, f"{root}/compact", version)
        upto = base.agg(F.max("batch")).first()[0]
        changes = base.unionByName(changes.filter(F.col("batch") > (-1 if upto is None else upto)))
    rest = [c for c in changes.columns if c not in key]
    last = changes.groupBy(*key).agg(F.max_by(F.struct(*rest), "batch").alias("r"))
    return last.select(*key, "r.*")


def compact_state(spark: SparkSession, root: str, key: Sequence[str]) -> int:
    """Keep the present state as one table, so that readers need only later changes beside it."""
    return write_snapshot(current_state(spark, root, key), f"{root}/compact")


def stream_state(
    updates: DataFrame, root: str, checkpoint: str, key: Sequence[str], order: Sequence[str],
    every: str | None = STATE_EVERY,
) -> StreamingQuery:
    """Upsert the state of places: the last status, attempts added up, the last error, `updated_at` where given."""
    columns = S.place_columns(order)
    if "updated_at" in updates.columns:
        columns["updated_at"] = F.max_by("updated_at", F.struct(*order))
    return stream_upserts(updates, columns, root, checkpoint, key, every)


def stream_cells(
    updates: DataFrame, root: str, checkpoint: str, key: Sequence[str], order: Sequence[str],
    every: str | None = STATE_EVERY,
) -> StreamingQuery:
    """Upsert the state of cells, every column of `latest_cells`."""
    return stream_upserts(updates, S.cell_columns(order), root, checkpoint, key, every)


def stream_throttle(
    calls: DataFrame, out: str, root: str, checkpoint: str, order: Sequence[str],
    chunk: Callable[[], Column] | None = None, every: str | None = STATE_EVERY,
) -> StreamingQuery:
    """Throttle streaks across micro-batches; `root` keeps each key's open streak and hits.

    A busy key's batch is cut into chunks as in the table form, and `parked_until`
    is thirty seconds after the answer that parked the key.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        old = _stored(spark, root)
        if _holds(old, checkpoint, batch_id):
            return
        carry = None if old is None else old.select("alias", "streak", "hits")
        rows = throttle_streaks(batch, list(order), chunk() if chunk else None, carry)
        rows = rows.withColumn(
            "parked_until",
            F.when(F.col("parked"), F.col("ts") + F.expr(f"INTERVAL {PARK_SECONDS} SECONDS")),
        )
        target = f"{out}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(target)
        written = spark.read.parquet(target)
        at = F.struct(*order)
        latest = written.groupBy("alias").agg(
            F.max_by(F.struct("streak", F.col("rate_limit_hits").alias("hits")), at).alias("r")
        ).select("alias", "r.*")
        if old is not None:
            kept = old.select("alias", "streak", "hits").join(latest.select("alias"), "alias", "left_anti")
            latest = latest.unionByName(kept)
        write_snapshot(_stamped(latest, checkpoint, batch_id), root)

    return each_batch(calls, checkpoint, apply, every)


def stream_results(
    results: DataFrame, state: Callable[[SparkSession], DataFrame], out: str, totals: str, checkpoint: str,
    every: str | None = RESULTS_EVERY,
) -> StreamingQuery:
    """Flush worker results, one folder per batch: rows below `out/accepted=true` or `=false`, counts to `totals`.

    Only what is below `accepted=true` may reach the state (`apply_results`). A failed
    flush is retried by the checkpoint and overwrites its own folder.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        merged = merge_results(state(spark), batch).withColumn("batch", F.lit(batch_id))
        merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("accepted", "batch").parquet(out)
        try:  # of all that was flushed, only this batch's folders are listed
            written = spark.read.option("basePath", out).parquet(f"{out}/accepted=*/batch={batch_id}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return  # an empty batch
        written = written.withColumn("accepted", F.col("accepted").cast("boolean"))
        flush_totals(written, ["batch"]).drop("batch").write.mode("overwrite").parquet(f"{totals}/batch_id={batch_id}")

    return each_batch(results, checkpoint, apply, every)


def stream_log_events(
    logs: DataFrame, out: str, checkpoint: str, order: Sequence[str], every: str | None = "30 seconds",
    ts: str = "ts", id: str = "id", interval: str = "30 seconds",
) -> StreamingQuery:
    """The bounded tail of every interval of event time, whatever micro-batches its events came in.

    `order` must tell events apart. An interval's stored tail is cut again together with
    what a batch adds to it, which gives the tail of all its events, replays included.
    """
    def apply(batch: DataFrame, batch_id: int) -> None:
        start = F.window(F.col(ts).cast("timestamp"), interval)["start"]
        fresh = batch.withColumn("interval", F.coalesce(F.unix_seconds(start), F.lit(-1)))
        try:
            old = batch.sparkSession.read.schema(fresh.schema).parquet(out)
            touched = fresh.select("interval").distinct()
            fresh = fresh.unionByName(old.join(touched, "interval", "left_semi").select(fresh.columns)).dropDuplicates([*order, "interval"])
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        tail = bounded_tail(fresh, order, id=id, within=["interval"])
        tail.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("interval").parquet(out)

    return each_batch(logs, checkpoint, apply, every)
