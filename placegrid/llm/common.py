"""Helpers shared by the operators: Arrow columns added per batch, and tables kept in the shared folder."""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from placegrid.session import scratch_path

BATCH_BYTES = "4m"


def bounded_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch may weigh, so a run of long texts does not fill a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def share(spark: SparkSession, value):
    """Broadcasts a model whose size the caller has bounded; the result gives it back inside a task."""
    sent = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(sent.value)


def stored(df: DataFrame, name: str) -> DataFrame:
    """`df` written to the shared folder and read again: cuts the lineage, and its size is then known to the planner."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`df` less any column that an operator is about to add under the same name (names are case-blind)."""
    taken = {n.lower() for n in names}
    kept = [i for i, n in enumerate(df.columns) if n.lower() not in taken]
    if len(kept) == len(df.columns):
        return df
    return df.select(*[df[df.columns[i]] for i in kept])


def give_back() -> None:
    """Return freed memory to the system: workers live on after a task, and what one took adds up with the next."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library
        pass


def add_columns(
    df: DataFrame, fields: Sequence[T.StructField], start: Callable[[], Callable[[pa.RecordBatch], list]],
    drop: Sequence[str] = (),
) -> DataFrame:
    """`df` with the columns `fields`, computed batch by batch.

    `start` runs once in each task and returns the function that maps a batch to one list or array per field.
    Columns of `df` that share a name with a field are replaced; those in `drop` are read but not returned.
    """
    bounded_batches(df.sparkSession)
    added = {f.name.lower() for f in fields}
    unread = [n for n in df.columns if n.lower() not in added]
    df = df.select(*[df[n] for n in unread])
    keep = [n for n in unread if n not in set(drop)]
    schema = T.StructType([*[df.schema[n] for n in keep], *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]

    def run(batches):
        made = start()
        for batch in batches:
            if batch.num_rows == 0:
                continue
            new = [a if isinstance(a, pa.Array) and a.type == k else pa.array(a, type=k)
                   for a, k in zip(made(batch), kinds, strict=True)]
            old = [batch.column(batch.schema.get_field_index(n)) for n in keep]
            yield pa.RecordBatch.from_arrays(old + new, names=[f.name for f in schema.fields])
        made = new = old = batch = None
        give_back()

    return df.mapInArrow(run, schema)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes | None]:
    """A text column as UTF-8 bytes."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit values so that every bit of the result depends on every bit of the input."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
