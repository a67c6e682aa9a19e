"""A lead table stored as it is served: sorted files, a rank index for pages and posting lists for search.

Below the root lie `leads` (files in the order of the table), `ranks` (a row per file: its number, how many rows
come before it, how many it holds), `postings` (a row per three-letter piece and lead, sorted by piece) and `pieces`
(how often each piece occurs). A page reads the files that it shows, a search the files that hold a candidate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from placegrid.functions.values import blank
from placegrid.operators.leads import PAGE_DEFAULT, PAGE_MAX, search_leads

ORDER = ("side", "seq", "id")
SEARCHED = ("name", "cat", "addr")
PIECE = 3
ROWS_PER_FILE = 250_000
RAREST = 3  # pieces of a search text that are looked up; the text itself is then compared


def _pieces(text: Column) -> Column:
    """Every run of three characters, overlapping."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{PIECE}}}))"), 1)


def write_lead_store(leads: DataFrame, root: str, files: int, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Store `build_leads` rows (ids are unique and not null) in at least `files` files where there are rows enough."""
    spark = leads.sparkSession
    ordered = leads.repartitionByRange(files, *ORDER).sortWithinPartitions(*ORDER)
    ordered.write.option("maxRecordsPerFile", rows_per_file).parquet(f"{root}/leads")
    stored = spark.read.parquet(f"{root}/leads")
    per_file = stored.groupBy(F.col("_metadata.file_path").alias("path")).agg(
        F.count(F.lit(1)).alias("rows"), F.min(F.struct(*ORDER)).alias("first"))
    turn = Window.orderBy("first")  # one row per file
    ranks = per_file.select(
        "path", "rows", F.row_number().over(turn).alias("file"),
        (F.sum("rows").over(turn.rowsBetween(Window.unboundedPreceding, 0)) - F.col("rows")).alias("before"))
    ranks.coalesce(1).write.parquet(f"{root}/ranks")

    numbered = stored.select("id", *SEARCHED, F.col("_metadata.file_path").alias("path")).join(
        spark.read.parquet(f"{root}/ranks").select("path", "file"), "path")
    found = [_pieces(F.lower(blank(c))) for c in SEARCHED]
    postings = numbered.select("file", "id", F.explode(F.array_distinct(F.concat(*found))).alias("piece"))
    # by range, so that a piece of every lead is dealt over several tasks and files
    postings.repartitionByRange(files, "piece", "file", "id").sortWithinPartitions("piece", "file", "id").select(
        "piece", "file", "id").write.option("maxRecordsPerFile", 20 * rows_per_file).parquet(f"{root}/postings")
    counts = spark.read.parquet(f"{root}/postings").groupBy("piece").agg(F.count(F.lit(1)).alias("leads"))
    counts.repartitionByRange(4, "piece").sortWithinPartitions("piece").write.parquet(f"{root}/pieces")


def _files(spark: SparkSession, root: str, paths: list[str]) -> DataFrame:
    schema = spark.read.parquet(f"{root}/leads").schema
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def stored_page(
    spark: SparkSession, root: str, number: int = 0, limit: int = PAGE_DEFAULT, max_limit: int = PAGE_MAX
) -> DataFrame:
    """The rows of `lead_page`, from the files that hold them; a page behind the end is empty.

    A page touches at most as many files as it has rows, so their names are a bounded list.
    """
    limit = max(1, min(int(limit), max_limit))
    start = max(0, int(number)) * limit
    ranks = spark.read.parquet(f"{root}/ranks")
    total = ranks.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    touched = ranks.filter((F.col("before") < start + limit) & (F.col("before") + F.col("rows") > start))
    shown = touched.orderBy("before").limit(limit).select("path", "before").collect()
    skipped = start - shown[0].before if shown else 0
    rows = _files(spark, root, [r.path for r in shown])
    return rows.orderBy(*ORDER).offset(skipped).limit(limit).withColumn("total", F.lit(total).cast("bigint"))


def stored_search(spark: SparkSession, root: str, q: str) -> DataFrame:
    """The rows of `search_leads`, from the files with a lead that holds the text's rarest pieces.

    Texts of fewer than three characters have no piece: all files are read. What comes to the driver is a count for
    each piece of the search text, and the names of files.
    """
    needle = q.strip().lower()
    wanted = sorted({needle[i : i + PIECE] for i in range(len(needle) - PIECE + 1)})
    if not wanted:
        return search_leads(spark.read.parquet(f"{root}/leads"), q)
    counts = spark.read.parquet(f"{root}/pieces").filter(F.col("piece").isin(wanted)).collect()
    paths: list[str] = []
    if len(counts) == len(wanted):
        rare = [r.piece for r in sorted(counts, key=lambda r: (r.leads, r.piece))[:RAREST]]
        lists = spark.read.parquet(f"{root}/postings").filter(F.col("piece").isin(rare))
        candidates = lists.groupBy("file", "id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") == len(rare))
        ranks = spark.read.parquet(f"{root}/ranks")
        paths = [r.path for r in ranks.join(candidates, "file", "left_semi").select("path").collect()]
    return search_leads(_files(spark, root, paths), q)
