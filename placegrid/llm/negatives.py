"""Hard negatives by exact inner products, several candidates to one multiplication.

Components are whole numbers, floor(256 x). Biased by the smallest component of the table they are not negative, and
those of several candidates are packed side by side into one wide integer, in fields that hold any biased inner product.
One multiplication by an anchor's biased component then serves all of these candidates; the sums are unpacked field by
field and the bias is taken off. Fields that fit in the 53 bits of a double are multiplied as doubles, where such sums are
exact in any order; wider ones as 64-bit integers, and beyond that as Python's.

Anchors are the queries, candidates are all rows. Anchors are taken in blocks of at most `BLOCK`, each broadcast, searched
and released in turn, so that the driver and a task hold one block whatever their number. In a pass every task keeps the
best rows for each anchor in a bounded list; the tasks' lists are merged by anchor. A first pass finds the positives (the
rows of the anchor's label with the highest scores), a second the negatives of each positive: rows of another label whose
score lies within the given percents of the positive's. Every row is compared with every anchor, none is left out.

Defined results: rows with a null label, a null or empty vector, a null or non-finite component (or one of 2^20 or more),
or a vector of another length than the usual one take no part. Ties go to the smaller id, null ids come last and are no
anchors (an id of 2^63 - 1 comes out as null). Repeated rows are rows of their own: a copy of an anchor is one of its
positives, and copies of anchors are anchors. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.llm.common import bounded_batches, share, stored
from placegrid.llm.vectors import integers, matrix

SCALE, POSITIVES, NEGATIVES, LOW, HIGH = 256, 5, 10, 30, 90
BLOCK = 8192  # anchors
TILE = 1 << 18  # scores at a time
NO_ID = (1 << 63) - 1


@dataclass(frozen=True)
class Packing:
    """Fields of `bits` bits for components from `low` to `high` in vectors of length d."""

    low: int
    high: int
    d: int

    @property
    def bits(self) -> int:
        return max(1, (self.d * (self.high - self.low) ** 2).bit_length())

    @property
    def kind(self) -> type:
        return np.float64 if self.bits * 2 <= 53 else np.int64 if self.bits <= 62 else object

    @property
    def fields(self) -> int:
        """Candidates in one integer; Python's are as wide as needed, eight fields are enough to share the work."""
        return 8 if self.kind is object else (53 if self.kind is np.float64 else 63) // self.bits

    def biased(self, x: np.ndarray) -> np.ndarray:
        return (x - self.low).astype(self.kind)

    def packed(self, x: np.ndarray) -> np.ndarray:
        """Candidates (rows) as columns of wide integers."""
        x = self.biased(np.pad(x, ((0, -len(x) % self.fields), (0, 0)), constant_values=self.low))
        out = x[0::self.fields].copy()
        for f in range(1, self.fields):
            out += x[f::self.fields] * self.kind(2 ** (self.bits * f)) if self.kind is not object else x[f::self.fields] * 2 ** (self.bits * f)
        return out.T

    def scores(self, anchors: np.ndarray, anchor_sums: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products of biased anchors with the candidates x, exact."""
        wide = anchors @ self.packed(x)
        out = np.empty((len(anchors), wide.shape[1] * self.fields), np.int64 if self.kind is object else self.kind)
        base = 2 ** self.bits
        for f in range(self.fields):
            if f == self.fields - 1:
                field = wide
            elif self.kind is np.float64:
                rest = np.floor(wide * (1.0 / base))
                field, wide = wide - rest * base, rest
            else:
                field, wide = wide & (base - 1), wide >> self.bits
            if self.kind is object:  # unbiased before it has to fit a long
                sums = np.pad(x.sum(axis=1), (0, -len(x) % self.fields))[f::self.fields].astype(object)
                field = field + self.low * (anchor_sums.astype(object)[:, None] + sums) - self.d * self.low ** 2
            out[:, f::self.fields] = field
        out = out[:, :len(x)]
        if self.kind is not object:
            out += (self.low * anchor_sums - self.d * self.low ** 2).astype(self.kind)[:, None]
            out += (self.low * x.sum(axis=1)).astype(self.kind)
        return out


class Best:
    """The first k rows of each slot, by falling score and rising id; an anchor has `slots` slots with bounds of their own."""

    def __init__(self, anchors: int, low: np.ndarray, high: np.ndarray, k: int) -> None:
        self.low, self.high, self.k = low, high, k  # (slots, anchors)
        self.cut = low.copy()
        self.cut_id = np.full(low.shape, NO_ID)
        self.held: list[np.ndarray] = []
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.size, self.limit = 0, max(1 << 16, 4 * anchors * len(low) * k)

    def offer(self, scores: np.ndarray, ids: np.ndarray, rows: np.ndarray, allowed: np.ndarray) -> None:
        n = scores.shape[0]
        for s in range(len(self.low)):
            hit = scores >= self.cut[s][:, None]
            hit &= scores <= self.high[s][:, None]
            hit &= allowed
            a, c = np.nonzero(hit)
            if len(a):
                found = scores[a, c]
                better = (found > self.cut[s][a]) | (ids[c] <= self.cut_id[s][a])
                a, c, found = a[better], c[better], found[better]
                self.parts.append((s * n + a, found.astype(np.int64), ids[c], rows[c]))
                self.size += len(a)
            if self.size > self.limit:
                self.prune()

    def prune(self) -> tuple[np.ndarray, ...]:
        if not self.parts:
            return tuple(np.zeros(0, np.int64) for _ in range(4))
        slot, score, ids, rows = (np.concatenate(p) for p in zip(*self.parts))
        order = np.lexsort((rows, ids, -score, slot))
        slot, score, ids, rows = (x[order] for x in (slot, score, ids, rows))
        start = np.r_[0, np.flatnonzero(np.diff(slot)) + 1]
        rank = np.arange(len(slot)) - np.repeat(start, np.diff(np.r_[start, len(slot)]))
        last = rank == self.k - 1
        self.cut.reshape(-1)[slot[last]] = score[last]
        self.cut_id.reshape(-1)[slot[last]] = ids[last]
        kept = tuple(x[rank < self.k] for x in (slot, score, ids, rows))
        self.parts, self.size = [kept], len(kept[0])
        self.limit = max(self.limit, 2 * self.size)
        return kept


@dataclass(frozen=True)
class Anchors:
    packing: Packing
    rows: np.ndarray
    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray

    def searched(self, batches: Iterator[pa.RecordBatch], low: np.ndarray, high: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, ...]:
        """The best rows of the batches for each slot; `same`: rows of the anchor's label but the anchor itself, else of others."""
        anchors, sums = self.packing.biased(self.x), self.x.sum(axis=1)
        best = Best(len(self.rows), low, high, k)
        step = max(self.packing.fields, TILE // max(1, len(self.rows)))
        for batch in batches:
            x = matrix(batch)
            ids, labels, rows = (batch.column(batch.schema.get_field_index(n)).fill_null(NO_ID).to_numpy() for n in ("id", "label", "row"))
            for a in range(0, len(x), step):
                part = slice(a, a + step)
                alike = self.labels[:, None] == labels[part]
                if same:
                    alike &= self.rows[:, None] != rows[part]
                scores = self.packing.scores(anchors, sums, x[part])
                best.offer(scores, ids[part], rows[part], alike if same else ~alike)
        return best.prune()


def _search(rows: DataFrame, anchors: Anchors, low: np.ndarray, high: np.ndarray, k: int, same: bool) -> DataFrame:
    """(slot, score, id, row, rank): the first k rows of every slot, over all tasks."""
    shared = share(rows.sparkSession, (anchors, low, high))

    def run(batches):
        anchors, low, high = shared()
        slot, score, ids, at = anchors.searched((b for b in batches if b.num_rows), low, high, k, same)
        if len(slot):
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot), pa.array(score), pa.array(ids, mask=ids == NO_ID), pa.array(at)], names=["slot", "score", "id", "row"])

    found = rows.mapInArrow(run, "slot long, score long, id long, row long")
    order = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


SCHEMA = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


def hard_negatives(
    df: DataFrame, anchor: Column, label: Column | None = None, id: str = "vec_id", vector: str = "embedding",
    positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, high: int = HIGH, block: int = BLOCK,
) -> DataFrame:
    """For each anchor and positive the first `negatives` rows with low * positive <= 100 * score <= high * positive."""
    spark = df.sparkSession
    bounded_batches(spark)
    label = F.col("label") if label is None else label
    keep = {"id": F.col(id).cast("long"), "label": label.cast("long"), "anchor": F.coalesce(anchor & F.col(id).isNotNull(), F.lit(False)),
            "row": F.monotonically_increasing_id()}
    rows, d = integers(df.where(label.isNotNull()), vector, SCALE, keep)
    queries = rows.where("anchor")
    ends = rows.agg(F.min(F.array_min("x")).alias("low"), F.max(F.array_max("x")).alias("high"), F.count_if("anchor").alias("n")).first()
    if not ends.n:
        return spark.createDataFrame([], SCHEMA)
    packing, blocks, out = Packing(ends.low, ends.high, d), -(-ends.n // block), None
    for b in range(blocks):
        own = queries.where(F.pmod(F.xxhash64("row"), F.lit(blocks)) == b) if blocks > 1 else queries
        got = own.select("row", "id", "label", "x").toArrow()
        if not got.num_rows:
            continue
        got = got.combine_chunks().to_batches()[0]
        anchors = Anchors(packing, *(got.column(i).to_numpy() for i in range(3)), matrix(got))
        n, none = len(anchors.rows), np.full((1, got.num_rows), 1 << 62)
        # the best positives of a block are a table of bounded size: positives times block rows
        best = _search(rows, anchors, -none, none, positives, True).select("slot", "rank", "score", "id").collect()
        bounds = [np.full((positives, n), v, np.int64) for v in (1 << 62, -(1 << 62))]
        found = []
        for r in best:
            if r.score >= 0:  # the range below a negative score is empty
                bounds[0][r.rank - 1, r.slot], bounds[1][r.rank - 1, r.slot] = -(-low * r.score // 100), high * r.score // 100
                found.append(((r.rank - 1) * n + r.slot, int(anchors.ids[r.slot]), r.id, r.score))
        pairs = spark.createDataFrame(found, "slot long, anchor_id long, positive_id long, positive_score long")
        mined = _search(rows, anchors, *bounds, negatives, False).join(pairs, "slot").select(
            "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        mined = stored(mined, "negatives")
        out = mined if out is None else out.unionAll(mined)
    return out
