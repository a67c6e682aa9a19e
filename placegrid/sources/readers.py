"""Stored files as DataFrames. A missing file reads as an empty table."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegrid import schemas as S
from placegrid.functions.values import blank, strip
from placegrid.operators.dedupe import distinct_ids

SEQ = "_seq"
FILE_BITS = 44


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False
    return True


def place_in_file() -> Column:
    """A number that grows with the rows of a file; only in the stage that reads the file."""
    ordinal = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    return F.col("_metadata.file_block_start") + ordinal


def in_file_order(rows: DataFrame) -> DataFrame:
    """`rows` of a file read with `_seq`: by the time a file was written, its name, and the place in it.

    Spark deals files to tasks by size, so a row's number in its task says nothing about
    the order of files. Files are numbered by time and name; inside a file a row stands at
    the start of its block plus its number in the task (a block that is not a file's last
    fills its task, and a row takes a byte at least, so numbers of blocks do not cross).
    """
    placed = rows.select(
        "*", F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_modification_time").alias("_time"),
        place_in_file().alias("_place"))
    files = placed.select("_path", "_time").distinct()
    # one row per file
    numbered = files.withColumn("_file", F.row_number().over(Window.orderBy("_time", "_path")).cast("bigint")).drop("_time")
    return placed.join(numbered, "_path").withColumn(
        SEQ, F.shiftleft("_file", FILE_BITS) + F.col("_place")).drop("_path", "_time", "_file", "_place")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Text columns of a CSV whose records may hold quotes and line breaks; nulls become ''.

    Such a file is one task, so a wide reader should write it out as Parquet once.
    `_seq` grows in file order.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([], S.strings([*(columns or ()), SEQ])).withColumn(
            SEQ, F.col(SEQ).cast("bigint")
        )
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"', inferSchema=False)
    rows = in_file_order(rows).na.fill("")
    if columns is None:
        return rows
    return rows.select(
        *[(F.col(c) if c in rows.columns else F.lit("")).alias(c) for c in columns], SEQ
    )


def read_known_ids(spark: SparkSession, path: str) -> DataFrame:
    """Distinct trimmed ids; none when the file or its id column is missing."""
    rows = read_csv(spark, path)
    if "place_id" not in rows.columns:
        return spark.createDataFrame([], S.strings(["place_id"]))
    return distinct_ids(rows)


def read_discovered(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, S.DISCOVERED_COLUMNS)


def read_state(spark: SparkSession, path: str, kind: str) -> DataFrame:
    return read_csv(spark, path, S.STATE_COLUMNS[kind])


def read_listings(spark: SparkSession, full: str, lean: str, prefer: str = "full") -> DataFrame:
    """The full (gzip) or the lean listing file, whichever is preferred and present."""
    paths = (full, lean) if prefer == "full" else (lean, full)
    found = next((p for p in paths if _exists(spark, p)), paths[-1])
    rows = read_csv(spark, found)
    return rows.repartition(SEQ) if found.endswith(".gz") else rows


def read_run_configs(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per run folder; an unreadable config is a row of nulls."""
    rows = spark.read.schema(S.RUN_CONFIG).json(pattern, multiLine=True, mode="PERMISSIVE")
    folder = F.regexp_extract("_metadata.file_path", r"([^/]+)/[^/]+$", 1)
    return rows.withColumn("run_id", F.coalesce("run_id", folder))


def read_heartbeats(spark: SparkSession, path: str) -> DataFrame:
    """Heartbeat records; broken lines are skipped."""
    return in_file_order(spark.read.schema(S.HEARTBEAT).json(path, mode="DROPMALFORMED"))


def read_live_state(spark: SparkSession, pattern: str) -> DataFrame:
    return spark.read.schema(S.LIVE_STATE).json(pattern, multiLine=True)


def _rings(geometry: Column) -> Column:
    """Outer rings of a geometry variant, as array<array<struct<lat,lng>>>."""
    kind = F.try_variant_get(geometry, "$.type", "string")
    polygon = F.try_variant_get(geometry, "$.coordinates", "array<array<array<double>>>")
    several = F.try_variant_get(geometry, "$.coordinates", "array<array<array<array<double>>>>")
    outer = F.when(kind == "Polygon", F.slice(polygon, 1, 1)).when(
        kind == "MultiPolygon", F.transform(several, lambda p: F.get(p, F.lit(0)))
    )
    return F.transform(outer, lambda ring: F.transform(ring, lambda p: _point(F.get(p, F.lit(1)), F.get(p, F.lit(0)))))


def _point(lat: Column, lng: Column) -> Column:
    return F.struct(lat.alias("lat"), lng.alias("lng"))


def boundary_rings(documents: DataFrame, text: str = "value") -> DataFrame:
    """`rings` of a boundary document: GeoJSON in four shapes, or bare (lat, lng) lists.

    Holes are ignored. A document without a polygon is an error.
    """
    doc = F.parse_json(text)
    kind = F.try_variant_get(doc, "$.type", "string")
    one_ring = F.try_variant_get(doc, "$[0][0]", "double").isNotNull()
    bare = F.try_variant_get(doc, "$", "array<array<double>>")
    bare_rings = F.try_variant_get(doc, "$", "array<array<array<double>>>")
    as_points = lambda ring: F.transform(ring, lambda p: _point(F.get(p, F.lit(0)), F.get(p, F.lit(1))))
    features = F.try_variant_get(doc, "$.features", "array<variant>")
    collected = F.flatten(
        F.filter(
            F.transform(features, lambda f: _rings(F.try_variant_get(f, "$.geometry", "variant"))),
            lambda r: r.isNotNull(),
        )
    )
    rings = (
        F.when(kind == "FeatureCollection", collected)
        .when(kind == "Feature", _rings(F.try_variant_get(doc, "$.geometry", "variant")))
        .when(kind.isin("Polygon", "MultiPolygon"), _rings(doc))
        .when(one_ring, F.array(as_points(bare)))
        .otherwise(F.transform(bare_rings, as_points))
    )
    staged = documents.withColumn("rings", rings)
    usable = F.coalesce(F.size("rings"), F.lit(0)) > 0
    message = F.lit("boundary document holds no polygon")
    return staged.withColumn(
        "rings",
        F.when(usable, F.col("rings")).otherwise(
            F.raise_error(message).cast(staged.schema["rings"].dataType)
        ),
    ).drop(text)


def read_boundary(spark: SparkSession, path: str) -> DataFrame:
    """boundary_id (the file name) and rings."""
    name = F.regexp_extract("_metadata.file_path", r"([^/]+?)(\.[^./]*)?$", 1)
    files = spark.read.text(path, wholetext=True)
    return boundary_rings(files.select("value", name.alias("boundary_id")))


_FEATURE = (
    "struct<type:string,geometry:struct<type:string,coordinates:array<array<array<double>>>>,"
    "properties:struct<cell_id:string>>"
)


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """cell_id and geometry of the features that name a cell."""
    rows = spark.read.schema(f"type string, features array<{_FEATURE}>").json(path, multiLine=True)
    features = rows.select(F.inline("features"))
    return features.select(F.col("properties.cell_id").alias("cell_id"), "geometry").filter(
        blank("cell_id") != ""
    )


def read_grid_lines(spark: SparkSession, path: str) -> DataFrame:
    """The same from one feature per line, the shape large grids are written in."""
    rows = spark.read.schema(T._parse_datatype_string(_FEATURE)).json(path)
    return rows.select(F.col("properties.cell_id").alias("cell_id"), "geometry").filter(
        blank("cell_id") != ""
    )


def read_usage_ledger(spark: SparkSession, path: str) -> DataFrame:
    """day, alias and calls of {day: {alias: n}} documents: one per line, or one per file over several lines, added up.

    Files are read by line. Only those with a line that is no document by itself are read whole: their names come to
    the driver, and each must fit a task.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).filter(F.btrim("value") != "")
    parsed = lines.select("file", F.from_json("value", S.USAGE_LEDGER).alias("ledger"))
    spread = [r.file for r in parsed.filter("ledger IS NULL").select("file").distinct().collect()]
    documents = parsed.filter(~F.col("file").isin(spread)).select("ledger")
    if spread:
        whole = spark.read.text(spread, wholetext=True)
        documents = documents.unionByName(whole.select(F.from_json("value", S.USAGE_LEDGER).alias("ledger")))
    days = documents.select(F.explode("ledger").alias("day", "m"))
    return days.select("day", F.explode("m").alias("alias", "calls")).groupBy("day", "alias").agg(F.sum("calls").alias("calls"))


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with a file-order `_seq`."""
    return in_file_order(spark.read.text(path))


def csv_row_counts(spark: SparkSession, pattern: str) -> DataFrame:
    """file and rows: the physical lines of each file less its header."""
    lines = spark.read.text(pattern).groupBy(F.col("_metadata.file_path").alias("file")).agg(F.count(F.lit(1)).alias("n"))
    return lines.select("file", F.greatest(F.lit(0), F.col("n") - 1).alias("rows"))


def read_skeleton(spark: SparkSession, path: str) -> DataFrame:
    """Request skeletons, blank lines skipped; the config stays JSON text."""
    lines = spark.read.text(path).filter(strip("value") != "")
    return lines.select(F.from_json("value", S.SKELETON).alias("s")).select("s.*")


def read_jobs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.JOBS).json(path)


def read_job_files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(S.JOB_FILES).json(path)


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_search_pages(spark: SparkSession, path: str) -> DataFrame:
    """Stored search responses: cell_id, query, attempt, page, status and the body text."""
    return spark.read.schema(
        "cell_id string, query string, attempt int, page int, status int, body string"
    ).json(path)


def read_media(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """Bytes by path and file name, folders included."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern)
    return files.option("recursiveFileLookup", "true").load(path).select(
        "path", F.regexp_extract("path", r"([^/]+)$", 1).alias("name"), "length", "content"
    )


