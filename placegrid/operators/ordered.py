"""Ordered scans that never put one key into one task.

A key's rows are cut into chunks by a number that grows with the order. Each
chunk is summarised by a partial aggregate, the few summaries are scanned per
key, and every row then needs only its own chunk plus the carried value. One
key may hold any share of the table: its rows spread over (key, chunk).
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, IntegerType, LongType, TimestampType

CHUNK = "_chunk"
PARTS = 1 << 12


def carried(
    df: DataFrame,
    keys: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    summaries: Mapping[str, Column],
    carries: Mapping[str, Callable[[WindowSpec], Column]],
) -> tuple[DataFrame, WindowSpec]:
    """Rows with the carried columns, and the window over one chunk of one key.

    `chunk` must not decrease along `order`; rows whose chunk is null come first, as nulls
    do in the order, and null keys are one key. Cut so that a key has some thousand
    chunks at most and none holds much more than its share of the rows (`even_chunks` does).
    `summaries` are aggregates over a chunk; each carry is an expression over the
    summaries of earlier chunks.
    """
    base = df.withColumn(CHUNK, F.coalesce(chunk.cast("bigint"), F.lit(-(1 << 62))))
    per_chunk = base.groupBy(*keys, CHUNK).agg(*[e.alias(n) for n, e in summaries.items()])
    earlier = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    carry = per_chunk.select(*keys, CHUNK, *[f(earlier).alias(n) for n, f in carries.items()])
    inside = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return join_same(base, carry, [*keys, CHUNK]), inside


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """A join in which null keys are equal."""
    there = {k: f"_same_{k}" for k in keys}
    named = right.withColumnsRenamed(there)
    same = reduce(and_, [F.col(k).eqNullSafe(F.col(n)) for k, n in there.items()])
    return left.join(named, same, how).drop(*there.values())


def _constant(values: Sequence, kind: DataType) -> Column:
    """An array literal, made of one text rather than of as many expressions."""
    return F.split(F.lit(",".join(map(repr, values))), ",").cast(ArrayType(kind))


def even_chunks(df: DataFrame, position: str, parts: int = PARTS) -> Column:
    """At most `parts` chunks of about as many rows each, in the order of the position, which may be a timestamp.

    The bounds are quantiles of a mergeable sketch, one partial aggregate over `df` that runs at once; only the
    bounds reach the driver. So neither a far outlier nor positions in dense clusters (file numbers above line
    numbers) fill a chunk; rows of one position share it. A row finds its chunk by bisection of the bounds.
    """
    kind = df.schema[position].dataType
    timed = isinstance(kind, TimestampType)
    at = F.unix_micros(position) if timed else F.col(position)
    cuts = _constant([i / parts for i in range(1, parts)], DoubleType())
    bounds = df.agg(F.percentile_approx(at, cuts, 4 * parts)).first()[0]
    if not bounds:
        return F.lit(None).cast("bigint")
    found = _constant(sorted(set(bounds)), LongType() if timed else kind)
    steps = _constant([1 << b for b in reversed(range(len(bounds).bit_length()))], IntegerType())

    def step(low: Column, width: Column) -> Column:
        return F.when(F.get(found, low + width - 1) <= at, low + width).otherwise(low)

    return F.when(at.isNotNull(), F.aggregate(steps, F.lit(0), step)).cast("bigint")


def running_sum(df, keys, chunk, order, value: Column, out: str, before: bool = False) -> DataFrame:
    """Running total of `value` up to the row, or up to the row before it."""
    rows, inside = carried(
        df, keys, chunk, order,
        {"_part": F.sum(value)},
        {"_carry": lambda w: F.coalesce(F.sum("_part").over(w), F.lit(0))},
    )
    last = -1 if before else Window.currentRow
    own = F.sum(value).over(inside.rowsBetween(Window.unboundedPreceding, last))
    return rows.withColumn(out, F.col("_carry") + F.coalesce(own, F.lit(0))).drop(CHUNK, "_carry")


def row_index(df, keys, chunk, order, out: str) -> DataFrame:
    """Dense 0-based position of every row within its key."""
    rows, inside = carried(
        df, keys, chunk, order,
        {"_part": F.count(F.lit(1))},
        {"_carry": lambda w: F.coalesce(F.sum("_part").over(w), F.lit(0))},
    )
    return rows.withColumn(out, F.col("_carry") + F.row_number().over(inside) - 1).drop(CHUNK, "_carry")


def previous(df, keys, chunk, order, value: Column, out: str) -> DataFrame:
    """`value` of the preceding row of the key (null for the first)."""
    rows, inside = carried(
        df, keys, chunk, order,
        {"_last": F.max_by(F.struct(value.alias("v")), F.struct(*order))},
        {"_carry": lambda w: F.last("_last").over(w)},
    )
    own = F.lag(F.struct(value.alias("v"))).over(inside)
    return rows.withColumn(out, F.coalesce(own, F.col("_carry"))["v"]).drop(CHUNK, "_carry")


def trailing(
    df: DataFrame, keys: Sequence[str], at: Column, width: int
) -> tuple[DataFrame, WindowSpec, Column]:
    """Rows placed in buckets `width` wide along the whole number `at`, and in the next bucket.

    The returned window looks back `width` inside one bucket of one key; the
    returned condition keeps the rows that belong to their bucket.
    """
    bucket = F.floor(at / width)
    slots = F.array(
        F.struct(bucket.alias("b"), F.lit(True).alias("own")),
        F.struct((bucket + 1).alias("b"), F.lit(False).alias("own")),
    )
    rows = df.withColumn("_at", at).select("*", F.explode(slots).alias("_slot"))
    look_back = (
        Window.partitionBy(*keys, F.col("_slot.b")).orderBy("_at").rangeBetween(-width, Window.currentRow)
    )
    return rows, look_back, F.col("_slot.own")


def trailing_count(df: DataFrame, keys: Sequence[str], at: Column, width: int, out: str, times: DataFrame | None = None) -> DataFrame:
    """How many rows of the key lie in the `width` before the whole number `at`, both ends and the row itself included.

    A row counts from its time on and no longer once `width` has passed: a running sum over arrivals and ends, linear
    and cut into even chunks, however many rows a window holds. Rows without a time count among themselves, twice each.
    The chunks are even ones of `times`, rows with the same times that are cheaper to read, if given.
    """
    ends = (df if times is None else times).select(F.explode(F.array(at, at + width + 1)).alias("_t"))
    chunk = even_chunks(ends, "_t")
    steps = F.array(
        F.struct(F.col("_at").alias("t"), F.lit(1).alias("d"), F.lit(True).alias("own")),
        F.struct((F.col("_at") + width + 1).alias("t"), F.lit(-1).alias("d"), F.lit(False).alias("own")),
    )
    moved = df.withColumn("_at", at).select("*", F.explode(steps).alias("_step")).select("*", "_step.t", "_step.d", "_step.own")
    rows = moved.drop("_step").withColumnsRenamed({"t": "_t", "d": "_d", "own": "_own"})
    untimed = F.col("_t").isNull()
    rows, inside = carried(
        rows, keys, chunk, ["_t"],
        {"_part": F.sum(F.when(~untimed, F.col("_d")))},
        {"_carry": lambda w: F.coalesce(F.sum("_part").over(w), F.lit(0))},
    )
    # rows of one time share a chunk, so all of them are counted
    so_far = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    alike = F.count_if(untimed).over(so_far)
    count = F.col("_carry") + F.sum(F.when(~untimed, F.col("_d"))).over(so_far)
    return rows.withColumn(out, F.when(untimed, alike).otherwise(count)).filter("_own").drop(CHUNK, "_carry", "_at", "_t", "_d", "_own")
