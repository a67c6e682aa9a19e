"""Streams whose keys remember something: counts by status kept up from changes, and the end of a key's park.

Both keep a small state per key in Spark's state store and write per batch what changed, never the whole. Keys are
dealt over a fixed number of groups and Python is called once per group with changes, not once per key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupStateTimeout

from placegrid.operators.keys import PARK_SECONDS
from placegrid.streaming.jobs import each_batch

GROUPS = 1 << 12  # a stream's number of groups is part of its state: never change it


def _group(*key: Column | str) -> Column:
    return F.pmod(F.xxhash64(*key), F.lit(GROUPS)).alias("_group")


def changed_rows(spark: SparkSession, root: str, files_per_batch: int = 1000) -> DataFrame:
    """What `stream_upserts` wrote to `root` as a stream: a row per changed key and batch, numbered by `batch`."""
    schema = spark.read.parquet(f"{root}/changes").schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{root}/changes")


def stream_counts(
    changes: DataFrame, key: Sequence[str], value: Column | str, out: str, checkpoint: str, at: str = "batch", every: str | None = None,
) -> StreamingQuery:
    """Keep the number of keys of every value: a key that changes counts -1 for its old value and +1 for its new one.

    `changes` are rows of `changed_rows`, already one per key and batch, so no key is hot. Each key remembers its
    value and the `at` it came with; what comes again or is older does nothing. Of one key's rows with one `at` the
    last value in order counts. A null value is counted as null. `counts` reads the sums.
    """
    rows = changes.select(
        _group(*key), F.to_json(F.struct(*key)).alias("key"), F.col(at).cast("bigint").alias("at"),
        (F.col(value) if isinstance(value, str) else value).alias("value"))

    def shift(group, frames, state):
        import pandas as pd

        known = {k: (when, name) for k, when, name in zip(*state.get)} if state.exists else {}
        best = dict(known)
        for frame in frames:
            for k, when, name in zip(frame["key"].tolist(), frame["at"].tolist(), frame["value"].tolist()):
                name, held = None if pd.isna(name) else name, best.get(k)
                if held is None or (when, name is not None, name or "") > (held[0], held[1] is not None, held[1] or ""):
                    best[k] = (when, name)
        if best != known:
            state.update((list(best), [when for when, _ in best.values()], [name for _, name in best.values()]))
        delta = {}
        for k, (_, name) in best.items():
            if k not in known or known[k][1] != name:
                delta[name] = delta.get(name, 0) + 1
                if k in known:
                    delta[known[k][1]] = delta.get(known[k][1], 0) - 1
        if delta:
            yield pd.DataFrame({"value": list(delta), "delta": list(delta.values())})

    deltas = rows.groupBy("_group").applyInPandasWithState(
        shift, "value string, delta bigint", "key array<string>, at array<bigint>, value array<string>", "append", GroupStateTimeout.NoTimeout)

    def apply(batch: DataFrame, batch_id: int) -> None:
        sums = batch.groupBy("value").agg(F.sum("delta").alias("delta")).filter("delta <> 0")
        sums.coalesce(1).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")  # a row per value

    return each_batch(deltas, checkpoint, apply, every)


def counts(spark: SparkSession, out: str) -> DataFrame:
    """value and keys: how many keys have it now, from the few rows that each batch wrote."""
    schema = "value string, delta bigint"
    try:
        deltas = spark.read.schema(schema).parquet(out)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        deltas = spark.createDataFrame([], schema)
    return deltas.groupBy("value").agg(F.sum("delta").alias("keys")).filter("keys <> 0")


def counted_places(found: DataFrame) -> DataFrame:
    """The row of `place_status_counts` from the counts."""
    def of(*names: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("value").isin(*names), F.col("keys"))), F.lit(0)).cast("bigint")

    return found.agg(
        F.coalesce(F.sum("keys"), F.lit(0)).cast("bigint").alias("placeids_total"), of("done").alias("placeids_done"),
        of("failed").alias("placeids_failed"), of("queued", "scraping").alias("placeids_pending"))


def counted_cells(found: DataFrame) -> DataFrame:
    """The rows of `cell_status_histogram` from the counts."""
    value = F.col("value")
    shown = F.when(value.isin("done", "failed"), value).when(value.isin("in_progress", "running"), "running").otherwise("queued")
    return found.groupBy(shown.alias("status")).agg(F.sum("keys").cast("bigint").alias("cells"))


def stream_releases(parks: DataFrame, key: str = "alias", lateness: str = "10 seconds", seconds: int = PARK_SECONDS) -> DataFrame:
    """The end of every park: key and `released_at`, `seconds` after the answer that last extended it.

    `parks` holds the answers that parked a key, with their time `ts`; an answer while a key is parked extends the
    park. A timer per key lets go of it when the watermark passes the end, whether or not the key is called again;
    ends that it has not passed stay open. A key remembers its open parks, at most one in `seconds` of the lateness,
    however many answers it gets.
    """
    def timer(group, frames, state):
        import pandas as pd

        wait, spans = seconds * 1000, {}
        for name, first, last in zip(*state.get) if state.exists else ():
            spans.setdefault(name, []).append((first, last))
        for frame in () if state.hasTimedOut else frames:
            found = {}
            for name, ms in zip(frame["name"].tolist(), frame["ms"].tolist()):
                found.setdefault(None if pd.isna(name) else name, set()).add(ms)
            for name, times in found.items():
                joined = []
                for first, last in sorted(spans.get(name, []) + [(ms, ms) for ms in times]):
                    if joined and first - joined[-1][1] <= wait:
                        joined[-1] = (joined[-1][0], max(last, joined[-1][1]))
                    else:
                        joined.append((first, last))
                spans[name] = joined
        mark = state.getCurrentWatermarkMs()
        ended = [(name, last + wait) for name, held in spans.items() for _, last in held if last + wait <= mark]
        still = [(name, first, last) for name, held in spans.items() for first, last in held if last + wait > mark]
        if still:
            state.update(tuple(map(list, zip(*still))))
            state.setTimeoutTimestamp(min(last for _, _, last in still) + wait)
        elif state.exists:
            state.remove()
        if ended:
            yield pd.DataFrame(ended, columns=["name", "ms"])

    rows = parks.withWatermark("ts", lateness).select(_group(key), F.col(key).alias("name"), "ts", F.unix_millis("ts").alias("ms"))
    released = rows.groupBy("_group").applyInPandasWithState(
        timer, "name string, ms bigint", "names array<string>, firsts array<bigint>, lasts array<bigint>", "append", GroupStateTimeout.EventTimeTimeout)
    return released.select(F.col("name").alias(key), F.timestamp_millis("ms").alias("released_at"))
