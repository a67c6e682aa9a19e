"""CSV files taken into Parquet once each, in the order in which they came."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from placegrid import schemas as S
from placegrid.sources.readers import FILE_BITS, SEQ, place_in_file
from placegrid.streaming.jobs import each_batch

FILES_PER_RUN = 1000


def ingest_csv(
    spark: SparkSession, folder: str, columns: Sequence[str], root: str, checkpoint: str, files_per_batch: int = FILES_PER_RUN,
    every: str | None = None,
) -> StreamingQuery:
    """Take the CSV files below `folder` that were not taken yet; Spark's checkpoint remembers which were.

    Every batch writes `root/rows/batch=N` and, a row per file, `root/files/batch=N`. A file gets the next number
    after all earlier ones (inside a batch by time and name), so that `_seq` grows from file to file and inside
    a file, as with the readers. A replayed batch overwrites its folders with the same numbers. Files of a batch
    must share one header, whose columns may stand in any order; those it lacks are ''.
    """
    source = (
        spark.readStream.schema("path string, modificationTime timestamp, length bigint, content binary")
        .format("binaryFile").option("maxFilesPerTrigger", files_per_batch).load(folder)
        .select("path", "modificationTime", F.col("_metadata.file_path").alias("uri"))  # the content is not read
    )

    def apply(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        first = _earlier(session, root, batch_id).agg(F.max("file")).first()[0] or 0
        turn = Window.orderBy("modificationTime", "path")  # one row per file of a batch, at most `files_per_batch`
        numbered = batch.withColumn("file", F.row_number().over(turn) + F.lit(first).cast("bigint"))
        numbered.coalesce(1).write.mode("overwrite").parquet(f"{root}/files/batch={batch_id}")
        taken = session.read.parquet(f"{root}/files/batch={batch_id}")
        paths = [r.path for r in taken.select("path").collect()]
        if not paths:
            return
        rows = session.read.csv(paths, header=True, multiLine=True, escape='"', inferSchema=False)
        placed = rows.select("*", F.col("_metadata.file_path").alias("_path"), place_in_file().alias("_place"))
        kept = [F.coalesce(F.col(c), F.lit("")).alias(c) if c in rows.columns else F.lit("").alias(c) for c in columns]
        seq = (F.shiftleft("file", FILE_BITS) + F.col("_place")).alias(SEQ)
        placed.join(taken.select(F.col("uri").alias("_path"), "file"), "_path").select(*kept, seq).write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")

    return each_batch(source, checkpoint, apply, every)


def _earlier(spark: SparkSession, root: str, batch_id: int) -> DataFrame:
    """The files of earlier batches."""
    kind = "path string, modificationTime timestamp, file bigint, batch bigint"
    try:
        return spark.read.schema(kind).parquet(f"{root}/files").filter(F.col("batch") < batch_id)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], kind)


def read_ingested(spark: SparkSession, root: str, columns: Sequence[str]) -> DataFrame:
    """All rows taken so far, with `_seq`; an empty table where none were."""
    try:
        return spark.read.schema(f"{', '.join(f'`{c}` string' for c in columns)}, {SEQ} bigint").parquet(f"{root}/rows").drop("batch")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], S.strings([*columns, SEQ])).withColumn(SEQ, F.col(SEQ).cast("bigint"))
