"""Known ids kept bucketed and sorted, so that a join with them shuffles the other side only."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placegrid.operators.dedupe import distinct_ids, first_seen, with_id
from placegrid.operators.state import repair_seen

ID = "place_id"


def open_history(spark: SparkSession, name: str, path: str, buckets: int) -> DataFrame:
    """The ids stored at `path`, as table `name` of this session's catalog; an empty table where nothing was stored.

    `buckets` must be the number that the table was made with. Take at least `spark.sql.shuffle.partitions`: of fewer
    the planner may shuffle both sides.
    """
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {name} ({ID} STRING) USING parquet "
        f"CLUSTERED BY ({ID}) SORTED BY ({ID}) INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(name)


def add_history(ids: DataFrame, name: str, path: str, buckets: int) -> None:
    """Append the ids that the history does not hold yet; a run that is repeated adds nothing."""
    history = open_history(ids.sparkSession, name, path, buckets)
    fresh = distinct_ids(ids).join(history, ID, "left_anti").repartition(buckets, ID)
    fresh.write.format("parquet").mode("append").bucketBy(buckets, ID).sortBy(ID).option("path", path).saveAsTable(name)
    ids.sparkSession.catalog.refreshTable(name)


def new_rows(df: DataFrame, history: DataFrame) -> DataFrame:
    """Rows whose id is neither blank nor in the history, all copies of an id.

    The distinct ids, collapsed before their shuffle, meet the buckets; the rows then meet the new ids in a join whose
    hot keys Spark may split.
    """
    ids = with_id(df.select(ID)).distinct()
    return with_id(df).join(ids.join(history, ID, "left_anti"), ID, "left_semi")


def new_survivors(df: DataFrame, order, *histories: DataFrame) -> DataFrame:
    """First discovery of each id that no history holds."""
    fresh = first_seen(with_id(df), [ID], order)
    for history in histories:
        fresh = fresh.join(history, ID, "left_anti")
    return fresh


def repair_from_history(state: DataFrame, history: DataFrame) -> DataFrame:
    """Resumable ids that the history of scraped ids holds become done; a bucketed history's ids are distinct."""
    return repair_seen(state, history.select(ID).withColumn("_seen", F.lit(True)))
