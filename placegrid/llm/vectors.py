"""Helpers for tables of vectors: usable rows, whole components, and arrays summed over tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.llm.common import bounded_batches, stored

#: Larger components are treated as non-finite ones: sums of their products need not fit 64 bits.
LIMIT = float(1 << 20)
GROUPS = 64  # tasks' arrays are added within so many groups first


def usable(vector: Column) -> Column:
    """Whether a vector has components, none of them null, NaN, infinite or of LIMIT or more."""
    return F.coalesce((F.size(vector) > 0) & F.forall(vector, lambda e: F.coalesce(F.abs(e) < LIMIT, F.lit(False))), F.lit(False))


def whole(vector: Column, factor: int, add: int = 0) -> Column:
    """floor(factor * component) + add, of components as doubles."""
    return F.transform(vector, lambda e: (F.floor(e.cast("double") * factor) + add).cast("int"))


def usual_length(df: DataFrame, vector: str) -> int:
    """The most common length (of ties the largest); 0 for an empty table."""
    first = df.groupBy(F.size(vector).alias("d")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    return first.d if first else 0


def integers(df: DataFrame, vector: str, factor: int, keep: dict[str, Column], add: int = 0) -> tuple[DataFrame, int]:
    """Stored rows of `keep` and `x`, the vector in whole numbers, and their length; vectors of another length are left out."""
    found = stored(df.where(usable(F.col(vector))).select(*[c.alias(n) for n, c in keep.items()], whole(F.col(vector), factor, add).alias("x")), "vectors")
    d = usual_length(found, "x")
    return found.where(F.size("x") == d), d


def matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    """A column of equally long lists as rows of long integers."""
    column = batch.column(batch.schema.get_field_index(name))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, -1)


def summed(df: DataFrame, shape: tuple[int, int], kind: str, of: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum of `of(rows)` over all batches of `df` (a column x): added up in each task, then row by row in two groupBys.

    Of an array of any shape only its sum reaches the driver; a task holds one array.
    """
    bounded_batches(df.sparkSession)

    def run(batches):
        from pyspark import TaskContext

        total = np.zeros(shape, kind)
        for batch in batches:
            if batch.num_rows:
                total += of(matrix(batch))
        n, part = shape[0], TaskContext.get().partitionId()
        yield pa.RecordBatch.from_arrays(
            [pa.array(range(n), pa.int32()), pa.array([part] * n, pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())],
            names=["i", "part", "w"])

    def add(pdf):
        import pandas as pd

        total = sum(np.frombuffer(w, kind) for w in pdf["w"])
        return pd.DataFrame({"i": [pdf["i"].iloc[0]], "part": [pdf["part"].iloc[0]], "w": [total.tobytes()]})

    schema = "i int, part int, w binary"
    parts = df.select("x").mapInArrow(run, schema).withColumn("part", F.col("part") % GROUPS)
    rows = parts.groupBy("i", "part").applyInPandas(add, schema).groupBy("i").applyInPandas(add, schema).collect()
    out = np.zeros(shape, kind)
    for r in rows:
        out[r.i] = np.frombuffer(bytes(r.w), kind)
    return out
