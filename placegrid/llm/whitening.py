"""Whitening of embeddings by their leading principal components.

Components are read as whole numbers x = floor(64 c) + 1,000,000, so that counts, sums and deviations are exact. The fit
list holds every distinct x vector once: copies meet in partial aggregates before the shuffle. Its size n, its sums S and
its covariance, centred by (n x - S) / n before multiplying, are added up in the tasks and then in two groupBys; only the
sums, of fixed size for a dimension, reach the driver. There the covariance is made tridiagonal by Householder
reflections, the leading eigenvalues are found by bisection on Sturm counts, and the components by inverse iteration that
keeps clusters orthogonal (`eigen`). The components (at most 16 rows) are broadcast, and rows are projected batch by batch.
A last pass over the fit list measures how far the covariance of the whitened rows is from the identity.

Defined results: rows with a null or empty vector, or with a null or non-finite component (or one of 2^20 or more), are
dropped, and so are vectors of another length than the usual one; ties and repeated rows are projected one by one and
count once in the fit. Components without variance are not returned: one distinct vector gives none. An empty table gives
an empty result. `deviation` is null where it does not fit a long. Other columns are carried along; `whitened` and
`deviation` replace columns of those names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegrid.llm import eigen
from placegrid.llm.common import add_columns, share, stored
from placegrid.llm.vectors import integers, matrix, summed

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16

FIELDS = [T.StructField("whitened", T.ArrayType(T.DoubleType())), T.StructField("deviation", T.LongType())]


@dataclass(frozen=True)
class Whitening:
    n: int  # distinct vectors
    sums: np.ndarray  # of x by dimension
    components: np.ndarray  # unit rows
    eigenvalues: np.ndarray
    explained: np.ndarray  # shares of the trace
    identity_error: float | None = None

    def offsets(self, x: np.ndarray) -> np.ndarray:
        """n x - S, exact: components are below 2^27, so up to 2^35 rows fit a long."""
        return self.n * x - self.sums

    def white(self, x: np.ndarray) -> np.ndarray:
        return (self.offsets(x) / self.n) @ self.components.T / np.sqrt(self.eigenvalues)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        off = self.offsets(x)
        if int(np.abs(off).max(initial=0)) ** 2 * off.shape[1] < 1 << 63:
            return (off * off).sum(axis=1).tolist()
        exact = (off.astype(object) ** 2).sum(axis=1)
        return [v if v < 1 << 63 else None for v in exact]


def fitted(rows: DataFrame, d: int, k: int = COMPONENTS) -> Whitening:
    """The whitening of a table with a column x of whole vectors of length d."""
    none = Whitening(0, np.zeros(d, np.int64), np.zeros((0, d)), np.zeros(0), np.zeros(0))
    if not d:
        return none
    fit = stored(rows.select("x").distinct(), "fit-list")
    totals = summed(fit, (1, d + 1), "i8", lambda x: np.append(x.sum(axis=0), len(x))[None, :])[0]
    n, sums = int(totals[d]), totals[:d]
    if not n:
        return none

    def products(x: np.ndarray) -> np.ndarray:
        z = (n * x - sums) / n
        return z.T @ z

    covariance = summed(fit, (d, d), "f8", products) / n
    covariance = (covariance + covariance.T) / 2
    trace = float(np.trace(covariance))
    values, components = eigen.leading(covariance, k)
    some = values > 16 * d * eigen.EPS * trace  # without variance there is nothing to scale
    made = Whitening(n, sums, components[some], values[some], values[some] / trace if trace else values[some])
    if not some.any():
        return made

    def again(x: np.ndarray) -> np.ndarray:
        w = made.white(x)
        return np.vstack([w.T @ w, w.sum(axis=0)])

    m = int(some.sum())
    seen = summed(fit, (m + 1, m), "f8", again) / n
    error = np.abs(seen[:m] - np.outer(seen[m], seen[m]) - np.eye(m)).max()
    return Whitening(made.n, made.sums, made.components, made.eigenvalues, made.explained, float(error))


def whitened(df: DataFrame, vector: str = "embedding", k: int = COMPONENTS) -> tuple[DataFrame, Whitening]:
    """The usable rows of `df` with `whitened` and `deviation` instead of the vector, and the whitening."""
    taken = {f.name for f in FIELDS} | {vector.lower()}
    names = [n for n in df.columns if n.lower() not in taken]
    rows, d = integers(df, vector, SCALE, {f"c{i}": df[n] for i, n in enumerate(names)}, SHIFT)
    model = fitted(rows, d, k)
    shared = share(df.sparkSession, model)

    def start():
        model = shared()

        def one(batch):
            x = matrix(batch)
            white = model.white(x)
            flat = pa.array(white.ravel())
            return [pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * white.shape[1]), flat), model.deviations(x)]

        return one

    out = add_columns(rows, FIELDS, start, drop=["x"])
    return out.select(*[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "whitened", "deviation"), model
