"""Tables to files in the stored shapes."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placegrid.functions.media import split_image_urls
from placegrid.operators.leads import lock_schema
from placegrid.operators.state import dead_letters
from placegrid.schemas import LISTING_COLUMNS, STATE_COLUMNS

APPEND_EVERY = "3 seconds"
KEEP_SECONDS = 3600.0  # for so long readers may use a version after it was replaced


def write_locked_csv(df: DataFrame, columns: Sequence[str], path: str) -> None:
    """Append exactly these columns as text, with a header in every part file."""
    lock_schema(df, columns).write.mode("append").csv(path, header=True, escape='"', emptyValue="")


def write_full_gz(df: DataFrame, path: str) -> None:
    """Append the full catalog, gzip-compressed."""
    lock_schema(df, LISTING_COLUMNS).write.mode("append").csv(
        path, header=True, escape='"', emptyValue="", compression="gzip"
    )


def stream_append(df: DataFrame, path: str, checkpoint: str, every: str = APPEND_EVERY, drain: bool = False) -> StreamingQuery:
    """Append micro-batches as Parquet; `drain` processes what is there and ends."""
    writer = df.writeStream.format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if drain else writer.trigger(processingTime=every)
    return writer.outputMode("append").start(path)


class VersionConflict(ValueError):
    """Another writer has replaced the table meanwhile."""


_COMMIT = "version bigint, data string, at double, kind string"


def _commits(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.schema(_COMMIT).parquet(f"{root}/commits")


def _say(spark: SparkSession, root: str, version: int, data: str, kind: str) -> None:
    row = spark.createDataFrame([(version, data, time.time(), kind)], _COMMIT)
    row.coalesce(1).write.mode("append").parquet(f"{root}/commits")


def _versions(spark: SparkSession, root: str) -> DataFrame:
    """(version, data, at, cleared) of the versions that count: those with one offer that was not withdrawn."""
    offers = _commits(spark, root).groupBy("version", "data").agg(
        F.max(F.when(F.col("kind") == "offer", F.col("at"))).alias("at"),
        F.bool_or(F.col("kind") == "withdrawn").alias("_out"), F.bool_or(F.col("kind") == "cleared").alias("cleared"))
    whole = offers.filter("NOT _out AND at IS NOT NULL").groupBy("version").agg(
        F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in ("data", "at", "cleared")])
    return whole.filter("_n = 1").drop("_n")


def snapshot_version(spark: SparkSession, root: str) -> int:
    """The latest version of a table; 0 where none was written."""
    try:
        return _versions(spark, root).agg(F.max("version")).first()[0] or 0
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return 0


def write_snapshot(df: DataFrame, root: str, expected: int | None = None, keep: float = KEEP_SECONDS) -> int:
    """Replace a table by a new version, made from version `expected` (the latest one unless given).

    A version's data lies in a folder of its own and is never written again, so a reader keeps to the version that
    it opened. The data come first, then the version is offered in the commit log. Who then finds another offer of
    the same version there withdraws its own and raises `VersionConflict`; of two writers at most one prevails, and
    a version with two standing offers is not read. Versions replaced more than `keep` seconds ago are emptied.
    """
    spark = df.sparkSession
    expected = snapshot_version(spark, root) if expected is None else expected
    data = f"data-{uuid.uuid4().hex[:12]}"
    df.write.mode("error").parquet(f"{root}/{data}")
    if snapshot_version(spark, root) != expected:
        raise VersionConflict(f"{root} is no longer at version {expected}")
    # a version that two crashed writers left unsettled is passed over
    version = (_commits(spark, root).agg(F.max("version")).first()[0] if expected else 0) + 1
    _say(spark, root, version, data, "offer")
    standing = _commits(spark, root).filter(F.col("version") == version).groupBy("data").agg(F.bool_or(F.col("kind") == "withdrawn").alias("out"))
    if standing.filter("NOT out").count() > 1:
        _say(spark, root, version, data, "withdrawn")
        raise VersionConflict(f"version {version} of {root} was offered twice")
    _clear(spark, root, keep)
    return version


def _clear(spark: SparkSession, root: str, keep: float) -> None:
    """Empty the folders of versions whose successor is older than `keep` seconds."""
    rows = sorted(_versions(spark, root).collect())  # one row a version
    for old, new in zip(rows, rows[1:]):
        if not old.cleared and new.at < time.time() - keep:
            path = f"{root}/{old.data}"
            spark.createDataFrame([], spark.read.parquet(path).schema).write.mode("overwrite").parquet(path)
            _say(spark, root, old.version, old.data, "cleared")


def update_snapshot(spark: SparkSession, root: str, change: Callable[[DataFrame | None], DataFrame], tries: int = 5) -> int:
    """Replace a table by `change` of its latest version (None for the first), again if another writer came first."""
    for left in reversed(range(tries)):
        version = snapshot_version(spark, root)
        try:
            return write_snapshot(change(read_snapshot(spark, root, version) if version else None), root, version)
        except VersionConflict:
            if not left:
                raise
    raise AssertionError


def read_snapshot(spark: SparkSession, root: str, version: int | None = None) -> DataFrame:
    """A version of a table written by `write_snapshot`, the latest one unless given."""
    rows = _versions(spark, root)
    found = rows.agg(F.max_by("data", "version")) if version is None else rows.filter(F.col("version") == version).select("data")
    row = found.first()
    if row is None or row[0] is None:
        raise ValueError(f"{root} has no version {version}")
    return spark.read.parquet(f"{root}/{row[0]}")


def write_dead_letter(gated: DataFrame, path: str) -> None:
    write_locked_csv(dead_letters(gated), STATE_COLUMNS["dead_letter"], path)


def write_features(features: DataFrame, path: str) -> None:
    """GeoJSON features, one per line."""
    features.select("value").write.mode("overwrite").text(path)


def write_leads_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True, escape='"', emptyValue="")


def ledger_document(ledger: DataFrame) -> DataFrame:
    """`{day: {alias: n}}` per key and day; the lines of a day add up to its document."""
    entry = F.create_map("day", F.create_map("alias", "calls"))
    return ledger.select("day", F.to_json(entry).alias("value"))


def write_ledger(ledger: DataFrame, path: str) -> None:
    """Per-day totals as JSON lines."""
    ledger_document(ledger).select("value").write.mode("overwrite").text(path)


def write_image_markers(totals: DataFrame, path: str) -> None:
    """Append completion markers with expected and saved counts."""
    rows = totals.withColumn("completed_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX"))
    write_locked_csv(rows, STATE_COLUMNS["images"], path)


def write_shot_manifest(lines: DataFrame, path: str) -> None:
    lines.select("value").write.mode("append").text(path)


def write_requests(lines: DataFrame, path: str, order: str) -> None:
    """Request lines below one folder per shard, in input order inside each file."""
    lines.repartition("shard").sortWithinPartitions("shard", order).select("shard", "value").write.mode(
        "overwrite"
    ).partitionBy("shard").text(path)


def write_job_status(status: DataFrame, path: str) -> None:
    """Status rows below client/dataset folders."""
    status.write.mode("overwrite").partitionBy("client", "dataset").json(path)


def results_payload(gated: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """What a worker submits: JSON data and image URLs when done, the error when not.

    gated: place_id, attempts, outcome, error, image_urls and the listing columns.
    """
    fields = [c for c in gated.columns if c in LISTING_COLUMNS or c == "horeca"]
    done = F.col("outcome") == "done"
    return gated.select(
        *keep, "place_id", "attempts", "outcome",
        F.when(done, F.to_json(F.struct(*fields))).alias("data"),
        F.when(done, split_image_urls("image_urls")).alias("image_urls"),
        F.when(~done, F.col("error")).alias("error"),
    )
