"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Texts are lower-cased, what is no letter becomes a space, and the n-grams of one to three characters are hashed into
`2 ** BITS` features. Term frequency is damped (log), weighted with the inverse document frequency and scaled to length
one. Document frequencies are counted over all rows that may be learned from, by a groupBy; weights are trained by
follow-the-regularised-leader (per-coordinate rates, elastic-net penalty) on at most `per_language` texts of each
language, chosen by a hash of the id, which is the documented bound of the training sample; a temperature is then fitted
to the log loss on as many other texts per language. The whole of every text is used, in training and in prediction.

Defined results: texts without a letter (null, empty) are `und` with score 0, and so is everything if nothing can be
learned; rows without a language are never learned from; repeated rows count as often as they come; all columns but
the text are returned, `lang_pred` and `score` replaced or added.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegrid.llm.common import add_columns, share, stored, texts

BITS, ORDERS = 15, (1, 2, 3)
PER_LANGUAGE = 400
EPOCHS, ALPHA, BETA, L1, L2 = 3, 0.5, 1.0, 1e-4, 1e-5
SLICE_CHARS = 1_000_000
_MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)


def _letters() -> np.ndarray:
    """By code point of the basic plane, the code point if it is a letter, else 0 (a space)."""
    return np.fromiter((c if chr(c).isalpha() else 0 for c in range(0x10000)), np.uint32, 0x10000)


def codes(text: bytes, letters: np.ndarray) -> np.ndarray:
    """Lower-cased letters of a text with single zeros between the words and around them."""
    c = np.frombuffer(text.decode(errors="replace").lower().encode("utf-32-le", "replace"), np.uint32)
    high = c >= 0x10000
    if high.any():
        above = np.array([x for x in np.unique(c[high]).tolist() if chr(x).isalpha()], np.uint32)
        c = np.where(high, np.where(np.isin(c, above), c, 0), letters[np.where(high, 0, c)]).astype(np.uint32)
    else:
        c = letters[c]
    c = np.concatenate((c, np.zeros(1, np.uint32)))
    return np.concatenate((np.zeros(1, np.uint32), c[(c != 0) | np.concatenate(([False], c[:-1] != 0))]))


def counts(text: bytes | None, letters: np.ndarray) -> np.ndarray | None:
    """Counts of the hashed n-grams of a whole text (in slices, so memory is bounded); None without a letter."""
    if not text:
        return None
    c = codes(text, letters).astype(np.uint64)
    if not c.any():
        return None
    total = np.zeros(1 << BITS, np.int64)
    shift = np.uint64(64 - BITS)
    for at in range(0, len(c), SLICE_CHARS):
        part = c[at:at + SLICE_CHARS + max(ORDERS) - 1]
        own = min(SLICE_CHARS, len(c) - at)
        key = np.zeros(len(part), np.uint64)
        for n in range(1, max(ORDERS) + 1):
            key = (key[:len(part) - n + 1] if n > 1 else key) * np.uint64(0x110000) + part[n - 1:]
            if n in ORDERS:
                h = key[:own] * np.uint64(_MULTIPLIERS[n - 1])
                h ^= h >> np.uint64(29)
                total += np.bincount((h * np.uint64(_MULTIPLIERS[0]) >> shift).astype(np.int64), minlength=1 << BITS)
    return total


def document_frequencies(docs: DataFrame) -> tuple[int, np.ndarray]:
    """Texts with a letter, and how many of them hold each feature; tasks send sums, not rows of documents."""
    def run(batches):
        letters, df, n = _letters(), np.zeros(1 << BITS, np.int64), 0
        for batch in batches:
            for text in texts(batch):
                c = counts(text, letters)
                if c is not None:
                    df += c > 0
                    n += 1
        at = np.flatnonzero(df)
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate((at, [-1])), pa.int32()), pa.array(np.concatenate((df[at], [n])), pa.int64())], names=["f", "df"])

    sums = docs.select("text").mapInArrow(run, "f int, df bigint").groupBy("f").agg(F.sum("df").alias("df")).collect()
    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in sums:  # at most 2 ** BITS + 1 rows
        if r.f < 0:
            n = r.df
        else:
            df[r.f] = r.df
    return n, df


def sample(docs: DataFrame, per_language: int, fold: Column) -> DataFrame:
    """For each language and side of `fold` (to fit, to calibrate), the texts of at most `per_language` ids, by a hash.

    An id counts once in a language, however many rows bear it; of several texts the least is taken.
    """
    w = Window.partitionBy("lang", "fit").orderBy("h", "doc_id")
    picked = (
        docs.select("doc_id", "lang", fold.alias("fit"), F.xxhash64(F.lit(7), "doc_id").alias("h")).distinct()
        .withColumn("n", F.row_number().over(w)).where(F.col("n") <= per_language).select("doc_id", "lang", "fit"))
    # stored, so that the planner knows how few they are and leaves the texts where they are
    picked = stored(picked, "picked")
    drawn = docs.select("doc_id", "lang", "text").join(picked, ["doc_id", "lang"])
    return drawn.groupBy("doc_id", "lang", "fit").agg(F.min("text").alias("text"))


class Model:
    def __init__(self, languages: list[str], idf: np.ndarray) -> None:
        self.languages, self.idf, self.temperature = languages, idf.astype(np.float32), 1.0
        self.weights = np.zeros((1 << BITS, len(languages)), np.float32)
        self.bias = np.zeros(len(languages), np.float32)

    def vector(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.flatnonzero(c)
        x = (1 + np.log(c[at].astype(np.float32))) * self.idf[at]
        return at, x / max(float(np.sqrt((x * x).sum())), 1e-12)

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """Follow the regularised leader, one example after the other."""
        k = len(self.languages)
        z, n = np.zeros((1 << BITS, k)), np.zeros((1 << BITS, k))
        zb, nb = np.zeros(k), np.zeros(k)

        def leader(z, n):
            shrunk = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
            return -shrunk / ((BETA + np.sqrt(n)) / ALPHA + L2)

        order = np.random.default_rng(11)
        for _ in range(EPOCHS):
            for j in order.permutation(len(rows)):
                at, x, y = rows[j]
                w, b = leader(z[at], n[at]), leader(zb, nb)
                s = x @ w + b
                p = np.exp(s - s.max())
                p /= p.sum()
                p[y] -= 1
                g = x[:, None] * p
                for zz, nn, gg, ww in ((z, n, g, w), (zb, nb, p, b)):
                    i = at if zz is z else slice(None)
                    old = nn[i]
                    new = old + gg * gg
                    zz[i] += gg - (np.sqrt(new) - np.sqrt(old)) / ALPHA * ww
                    nn[i] = new
        self.weights, self.bias = leader(z, n).astype(np.float32), leader(zb, nb).astype(np.float32)

    def scores(self, vectors) -> np.ndarray:
        return np.array([x @ self.weights[at] + self.bias for at, x in vectors]).reshape(len(vectors), len(self.languages))

    def calibrate(self, rows: list[tuple[np.ndarray, np.ndarray, int]]) -> None:
        """The temperature of the least log loss, by golden-section search over its logarithm."""
        if not rows:
            return
        s, y = self.scores([r[:2] for r in rows]).astype(np.float64), np.array([r[2] for r in rows])

        def loss(t):
            q = s / np.exp(t)
            q = q - q.max(axis=1, keepdims=True)
            return -(q[np.arange(len(y)), y] - np.log(np.exp(q).sum(axis=1))).mean()

        low, high, ratio = np.log(1e-2), np.log(1e2), (np.sqrt(5) - 1) / 2
        for _ in range(60):
            a, b = high - ratio * (high - low), low + ratio * (high - low)
            low, high = (low, b) if loss(a) < loss(b) else (a, high)
        self.temperature = float(np.exp((low + high) / 2))

    def predict(self, vectors) -> tuple[np.ndarray, np.ndarray]:
        s = self.scores(vectors).astype(np.float64) / self.temperature
        p = np.exp(s - s.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        best = p.argmax(axis=1)
        return best, p[np.arange(len(best)), best]


def train(docs: DataFrame, fold: Column, per_language: int = PER_LANGUAGE) -> Model | None:
    """A model of doc_id, text, lang; rows where `fold` holds are fitted to, the others set the temperature."""
    docs = docs.where("lang IS NOT NULL AND text IS NOT NULL")
    n, df = document_frequencies(docs)
    if not n:
        return None

    def run(batches):
        letters = _letters()
        for batch in batches:
            out = []
            lang, fit, ids = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("lang", "fit", "doc_id"))
            for text, *row in zip(texts(batch), lang, fit, ids):
                c = counts(text, letters)
                if c is not None:
                    at = np.flatnonzero(c)
                    out.append((*row, at, c[at]))
            if out:
                kinds = [pa.string(), pa.bool_(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64())]
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out), kinds)],
                                                 names=["lang", "fit", "doc_id", "f", "c"])

    drawn = sample(docs, per_language, fold).mapInArrow(run, "lang string, fit boolean, doc_id bigint, f array<int>, c array<bigint>")
    rows = drawn.collect()  # at most 2 * per_language texts of each language, as feature counts
    rows.sort(key=lambda r: (r.lang, r.fit, r.doc_id if r.doc_id is not None else -1, r.f))
    languages = sorted({r.lang for r in rows})
    model = Model(languages, np.log((1 + n) / (1 + df)) + 1)
    known = {name: i for i, name in enumerate(languages)}

    def example(r):
        c = np.zeros(1 << BITS, np.int64)
        c[r.f] = r.c
        return (*model.vector(c), known[r.lang])

    model.fit([example(r) for r in rows if r.fit])
    model.calibrate([example(r) for r in rows if not r.fit])
    return model


def predicted(docs: DataFrame, model: Model | None) -> DataFrame:
    """`docs` less its text, with lang_pred and score (calibrated probability)."""
    shared = share(docs.sparkSession, model)

    def start():
        model, letters = shared(), _letters()

        def one(batch):
            names, score, found = [], [], []
            for text in texts(batch):
                c = counts(text, letters) if model else None
                names.append("und")
                score.append(0.0)
                if c is not None:
                    found.append((len(names) - 1, model.vector(c)))
            if found:
                best, p = model.predict([v for _, v in found])
                for (i, _), k, q in zip(found, best, p):
                    names[i], score[i] = model.languages[k], float(q)
            return [names, score]

        return one

    return add_columns(docs, [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())], start, drop=["text"])
