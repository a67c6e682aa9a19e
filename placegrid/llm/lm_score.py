"""LM scoring by masked pseudo-likelihood: a bidirectional window network trained in numpy.

Every word of a text is predicted from the `SPAN` words before and after it; the sum of the conditional log-probabilities
is the text's score. The network maps the words around the masked one to a hidden layer and predicts in two steps, first
one of `CLASSES` classes and then a word of that class, so both are proper probabilities at a small cost. The vocabulary
is the `CLASSES ** 2 - BUCKETS` most frequent words of the whole corpus, counted by a groupBy; all other words share
`BUCKETS` hash buckets. The network gives the probability of a bucket; of it a word has the share that it has of the
bucket's words in the corpus, so conditionals add up to one over the words of the corpus. These shares come from the
whole table of word counts: each row's distinct words outside the vocabulary are stored with their counts, dealt out by
word, joined to the shares, and summed by row. Scores are thus of the words that were counted, in the same corpus.

Training is spread over the corpus: in each round every task starts from the same weights and goes over all of its own
documents with per-weight step sizes; the tasks' weights are then averaged by their number of words in two groupBys over
blocks of weights (first within `GROUPS` groups of tasks). Every document is trained on in every round, those without an
id too. What is gathered grows with the input. Of the network only the averaged weights, of fixed size (about three
megabytes), reach the driver or are broadcast.

Defined results: null texts and texts without a word have no tokens, logp 0 and no mean or perplexity; repeated rows are
scored one by one and counted as often; an empty table gives an empty result. All columns but the text are returned;
`n_tokens`, `logp`, `mean_logp` and `pseudo_perplexity` are replaced or added. Scores depend on how the input was dealt
over tasks while training, by design of averaging.
"""

from __future__ import annotations

from collections import Counter
from itertools import filterfalse
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegrid.llm.common import add_columns, bounded_batches, share, stored, texts
from placegrid.llm.decontaminate import words

SPAN, HIDDEN, CLASSES, BUCKETS = 2, 32, 64, 512
SIZE = CLASSES * CLASSES
TRAIN_SHARE, ROUNDS = 1, 2  # all documents
MINIBATCH, RATE = 512, 0.15
BLOCKS, GROUPS = 16, 64  # blocks of weights, and groups of tasks that are averaged first
SLICE = 2_048  # positions scored at a time
SORTED = 32  # minibatches that are sorted at once; their numbers, below SORTED * 4 * (SIZE + 1) * MINIBATCH, fit 32 bits
NARROW = 40.0  # logits of a minibatch within this range are all shifted alike

OFFSETS = [o for o in range(-SPAN, SPAN + 1) if o]


class Vocabulary(dict):
    """Word -> id; words outside it fall into hash buckets."""

    def __missing__(self, word: bytes) -> int:
        return SIZE - BUCKETS + crc32(word) % BUCKETS

    def ids(self, text: bytes | None) -> list[int]:
        return list(map(self.__getitem__, words(text)))

    def others(self, text: bytes | None) -> dict[bytes, int]:
        """How often the text holds each word that is not in the vocabulary."""
        return Counter(filterfalse(self.__contains__, words(text)))


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) over whole texts."""
    def run(batches):
        for batch in batches:
            c: Counter = Counter()
            for text in texts(batch):
                c.update(words(text))
            if c:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.binary()), pa.array(list(c.values()), pa.int64())], names=["word", "n"])

    return docs.select("text").mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(docs: DataFrame, counts: DataFrame | None = None) -> Vocabulary:
    # stored first: the best of each partition meet in a task, not on the driver
    counts = word_counts(docs) if counts is None else counts
    top = stored(counts.orderBy(F.desc("n"), "word").limit(SIZE - BUCKETS), "vocabulary")
    top = top.orderBy(F.desc("n"), "word").collect()
    return Vocabulary((bytes(r.word), i) for i, r in enumerate(top))


def shares(counts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """(word, log_share): of each word outside the vocabulary, the log of its share of its bucket."""
    known = counts.sparkSession.createDataFrame([(w,) for w in vocabulary], "word binary")
    rare = counts.join(F.broadcast(known), "word", "left_anti").withColumn("bucket", F.crc32("word") % BUCKETS)
    total = rare.groupBy("bucket").agg(F.sum("n").alias("total"))  # at most BUCKETS rows
    return rare.join(F.broadcast(total), "bucket").select("word", F.log(F.col("n") / F.col("total")).alias("log_share"))


class Network:
    """Weights in one flat array: tables of the words around (by offset), class and word layers."""

    SHAPES = {"around": (len(OFFSETS), SIZE + 1, HIDDEN), "hidden": (HIDDEN,), "classes": (CLASSES, HIDDEN),
              "class_bias": (CLASSES,), "words": (CLASSES, CLASSES, HIDDEN), "word_bias": (CLASSES, CLASSES)}

    def __init__(self, flat: np.ndarray | None = None) -> None:
        total = sum(int(np.prod(s)) for s in self.SHAPES.values())
        if flat is None:
            flat = np.zeros(total, np.float32)
            tables = int(np.prod(self.SHAPES["around"]))
            flat[:tables] = np.random.default_rng(5).normal(0, 0.1, tables)
        self.flat = flat
        at = 0
        for name, shape in self.SHAPES.items():
            n = int(np.prod(shape))
            setattr(self, name, flat[at:at + n].reshape(shape))
            at += n

    @staticmethod
    def padded(docs: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
        """All ids with SPAN paddings around each document, and the positions of the words."""
        pad = [SIZE] * SPAN
        flat = list(pad)
        for d in docs:
            flat += d
            flat += pad
        ids = np.array(flat, np.int32)
        return ids, np.flatnonzero(ids != SIZE)

    def hide(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        h = np.repeat(self.hidden[None, :], len(at), axis=0)
        for table, o in zip(self.around, OFFSETS):
            h += table.take(ids[at + o], axis=0)
        return np.tanh(h, out=h)

    def log_probabilities(self, ids: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Of the word at each position, given the words around it."""
        out = np.empty(len(at))
        order = np.argsort(ids[at])  # so a slice has few classes
        for a in range(0, len(at), SLICE):
            some = order[a:a + SLICE]
            part = at[some]
            h = self.hide(ids, part)
            group, within = np.divmod(ids[part], CLASSES)
            seen, first = np.unique(group, return_index=True)
            f = np.empty((len(part), CLASSES), np.float32)
            for c, i, j in zip(seen, first, [*first[1:], len(part)]):
                np.dot(h[i:j], self.words[c].T, out=f[i:j])
                f[i:j] += self.word_bias[c]
            out[some] = _picked(h @ self.classes.T + self.class_bias, group) + _picked(f, within)
        return out

    def _layers(self) -> tuple[np.ndarray, np.ndarray]:
        """Copies of the class and word layers, inputs first, each with its bias as a last input."""
        return tuple(np.ascontiguousarray(np.concatenate([w, b[..., None]], axis=-1).swapaxes(-1, -2))
                     for w, b in ((self.classes, self.class_bias), (self.words, self.word_bias)))

    def _set_layers(self, classes: np.ndarray, words: np.ndarray) -> None:
        for w, b, layer in ((self.classes, self.class_bias, classes), (self.words, self.word_bias, words)):
            w[:], b[:] = layer[..., :-1, :].swapaxes(-1, -2), layer[..., -1, :]

    def train(self, ids: np.ndarray, at: np.ndarray, squares: "Network", seed: int) -> None:
        """One pass over the positions in minibatches; `squares` holds the sums of squared gradients."""
        at = np.random.default_rng(seed).permutation(at)
        tables, table_squares = self.around.reshape(-1, HIDDEN), squares.around.reshape(-1, HIDDEN)
        (classes, words), (class_squares, word_squares) = self._layers(), squares._layers()
        grads, buffer = np.empty_like(words), np.empty_like(words)
        by_class = list(zip(words, words[:, :-1].swapaxes(1, 2), grads))
        # the units of a position, and a last one that is always 1 and has the biases as its weights
        full, full_back = np.ones((MINIBATCH, HIDDEN + 1), np.float32), np.empty((MINIBATCH, HIDDEN), np.float32)
        logits, ones = np.empty((MINIBATCH, CLASSES), np.float32), np.ones(MINIBATCH, np.float32)
        for group, within, spans, before, near, row, many, again, first in _minibatches(ids, at):
            n = len(group)
            rows, h, f, back = np.arange(n), full[:n], logits[:n], full_back[:n]
            parts = tables.take(before, axis=0, mode="clip").reshape(len(OFFSETS), n, HIDDEN)
            total = parts[0]
            total += self.hidden
            for p in parts[1:]:
                total += p
            units = np.tanh(total, out=total)
            h[:, :-1] = units
            for c, i, j in spans:
                np.dot(h[i:j], by_class[c][0], out=f[i:j])
            g, f = _softmax(h @ classes, n), _softmax(f, n)
            g[rows, group] -= 1 / n
            f[rows, within] -= 1 / n
            seen = 0
            for c, i, j in spans:
                _, weights, grad = by_class[c]
                if c > seen:
                    grads[seen:c] = 0
                seen = c + 1
                part = f[i:j]
                np.dot(part, weights, out=back[i:j])
                np.dot(h[i:j].T, part, out=grad)
            grads[seen:] = 0
            back += g @ classes[:-1].T
            units *= units
            np.subtract(1, units, out=units)
            back *= units
            _step(classes, class_squares, h.T @ g)
            _step(self.hidden, squares.hidden, ones[:n] @ back)
            _step(words, word_squares, grads, buffer)
            # most words come once: only the rows of the others are added up
            sums = back.take(row, axis=0, mode="clip")
            if len(many):
                sums[many] = np.add.reduceat(back.take(again, axis=0, mode="clip"), first, axis=0)
            weights, seen = tables.take(near, axis=0, mode="clip"), table_squares.take(near, axis=0, mode="clip")
            _step(weights, seen, sums)
            tables[near], table_squares[near] = weights, seen
        self._set_layers(classes, words)
        squares._set_layers(class_squares, word_squares)


def _minibatches(ids: np.ndarray, at: np.ndarray):
    """The minibatches of positions, each sorted by word, so the words of a class lie together.

    Of each: class of every position and place in it, spans of positions by class, rows of the tables of the words around
    (by offset, then position); these rows once each, a position of each, which of them come more than once, the
    positions of those, and where each one's begin. Many minibatches are sorted at a time, by numbers that hold the
    minibatch first and the position last, so none come twice.
    """
    tables = len(OFFSETS) * (SIZE + 1)
    offsets, starts = np.array(OFFSETS)[:, None], np.arange(len(OFFSETS), dtype=np.int32)[:, None] * (SIZE + 1)
    for a in range(0, len(at), MINIBATCH * SORTED):
        some = at[a:a + MINIBATCH * SORTED]
        ends = np.append(np.arange(0, len(some), MINIBATCH), len(some))
        number = np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(ends))
        place = np.arange(len(some), dtype=np.int32) - number * MINIBATCH
        key = np.sort((number * SIZE + ids[some]) * MINIBATCH + place)
        some = some[key - (key // MINIBATCH - number) * MINIBATCH]
        group, within = np.divmod(ids[some], CLASSES)
        begins = np.flatnonzero(np.diff(number * CLASSES + group, prepend=-1))
        around = ids[some + offsets] + starts
        key = np.sort(((number * tables + around) * MINIBATCH + place).ravel())
        used = key // MINIBATCH
        row = key - used * MINIBATCH
        first = np.flatnonzero(np.diff(used, prepend=-1))
        first_at = np.searchsorted(first, ends * len(OFFSETS))
        near = used[first] - np.repeat(np.arange(len(ends) - 1, dtype=np.int32), np.diff(first_at)) * tables
        times = np.diff(first, append=len(row))
        many = np.flatnonzero(times > 1)
        again = row[np.repeat(times > 1, times)]
        again_first = np.cumsum(times[many]) - times[many]
        row, many_at, begins_at = row[first], np.searchsorted(many, first_at), np.searchsorted(begins, ends)
        again_at = np.append(again_first, len(again))[many_at]
        for k, (i, j) in enumerate(zip(ends[:-1].tolist(), ends[1:].tolist())):
            begin = begins[begins_at[k]:begins_at[k + 1]]
            spans = list(zip(group[begin].tolist(), (begin - i).tolist(), [*(begin[1:] - i).tolist(), j - i]))
            once, more = slice(first_at[k], first_at[k + 1]), slice(many_at[k], many_at[k + 1])
            yield (group[i:j], within[i:j], spans, around[:, i:j].ravel(), near[once], row[once],
                   many[more] - first_at[k], again[again_at[k]:again_at[k + 1]], again_first[more] - again_at[k])


def _step(weights: np.ndarray, squares: np.ndarray, grad: np.ndarray, buffer: np.ndarray | None = None) -> None:
    """One step in place against the gradient, which is overwritten."""
    buffer = np.multiply(grad, grad, out=buffer)
    squares += buffer
    np.sqrt(squares, out=buffer)
    buffer += 1e-6
    grad /= buffer
    grad *= RATE
    weights -= grad


def _shift(logits: np.ndarray) -> None:
    """In place, so that exponentials fit. One shift serves all rows unless it could make those of a row vanish."""
    top = logits.max()
    logits -= top if logits.min() > top - NARROW else logits.max(axis=1, keepdims=True)


def _picked(logits: np.ndarray, column: np.ndarray) -> np.ndarray:
    _shift(logits)
    picked = logits[np.arange(len(logits)), column]
    np.exp(logits, out=logits)
    return picked - np.log(logits @ np.ones(logits.shape[1], logits.dtype))


def _softmax(logits: np.ndarray, parts: int = 1) -> np.ndarray:
    """In place; each row adds up to 1 / parts."""
    _shift(logits)
    np.exp(logits, out=logits)
    logits /= (logits @ np.full(logits.shape[1], parts, logits.dtype))[:, None]
    return logits


def _batched(docs, vocabulary, limit: int = 200_000):
    """Lists of documents' ids of about `limit` words."""
    held, n = [], 0
    for text in docs:
        ids = vocabulary.ids(text)
        held.append(ids)
        n += len(ids)
        if n >= limit:
            yield held
            held, n = [], 0
    if held:
        yield held


def train_round(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, number: int) -> np.ndarray:
    """The weights after each task has trained on its documents, averaged by words."""
    shared = share(docs.sparkSession, (vocabulary, flat))
    size = -(-len(flat) // BLOCKS)

    def run(batches):
        from pyspark import TaskContext

        vocabulary, flat = shared()
        net, squares = Network(flat.copy()), Network(np.full(len(flat), 1e-4, np.float32))
        part, seen = TaskContext.get().partitionId(), 0
        for batch in batches:
            for k, held in enumerate(_batched(texts(batch), vocabulary)):
                ids, at = Network.padded(held)
                net.train(ids, at, squares, number * 7919 + k)
                seen += len(at)
        if seen:
            blocks = [net.flat[b * size:(b + 1) * size].tobytes() for b in range(BLOCKS)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(range(BLOCKS), pa.int32()), pa.array([part] * BLOCKS, pa.int32()),
                 pa.array([float(seen)] * BLOCKS, pa.float64()), pa.array(blocks, pa.binary())], names=["block", "part", "n", "w"])

    def mean(pdf):
        import pandas as pd

        n = pdf["n"].to_numpy()
        total = sum(k * np.frombuffer(w, np.float32).astype(np.float64) for k, w in zip(n, pdf["w"]))
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "part": [pdf["part"].iloc[0]], "n": [n.sum()],
                             "w": [(total / n.sum()).astype(np.float32).tobytes()]})

    schema = "block int, part int, n double, w binary"
    trained = docs.select("text").mapInArrow(run, schema)
    halves = trained.withColumn("part", F.col("part") % GROUPS).groupBy("block", "part").applyInPandas(mean, schema)
    rows = halves.groupBy("block").applyInPandas(mean, schema).collect()
    if not rows:
        return flat
    out = np.concatenate([np.frombuffer(bytes(r.w), np.float32) for r in sorted(rows, key=lambda r: r.block)])
    return out.astype(np.float32)


def train(docs: DataFrame, vocabulary: Vocabulary, rounds: int = ROUNDS, part: float = TRAIN_SHARE) -> np.ndarray:
    bounded_batches(docs.sparkSession)
    chosen = docs.select("text")
    if part < 1:  # by a hash of the id
        chosen = docs.where(F.pmod(F.xxhash64(F.lit(29), "doc_id"), F.lit(1 << 20)) < int(part * (1 << 20))).select("text")
    flat = Network().flat
    for number in range(rounds):
        flat = train_round(chosen, vocabulary, flat, number)
    return flat


FIELDS = [T.StructField("n_tokens", T.LongType()), T.StructField("logp", T.DoubleType()),
          T.StructField("mean_logp", T.DoubleType()), T.StructField("pseudo_perplexity", T.DoubleType())]


RARE = [T.StructField("_rare", T.ArrayType(T.BinaryType())), T.StructField("_times", T.ArrayType(T.LongType()))]


def scored(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, rare: bool = False) -> DataFrame:
    """The scores of ids: words outside the vocabulary have their bucket's. `rare` adds these words and their counts."""
    shared = share(docs.sparkSession, (vocabulary, flat))

    def start():
        vocabulary, flat = shared()
        net = Network(flat)

        def one(batch):
            size, total = [], []
            blobs = texts(batch)
            for held in _batched(blobs, vocabulary):
                ids, at = Network.padded(held)
                logp = net.log_probabilities(ids, at)
                n = [len(d) for d in held]
                size += n
                total += [float(x.sum()) for x in np.split(logp, np.cumsum(n)[:-1])]
            mean = [t / n if n else None for t, n in zip(total, size)]
            out = [size, total, mean, [None if m is None else float(np.exp(-m)) for m in mean]]
            if rare:
                others = [vocabulary.others(text) for text in blobs]
                out += [[list(o) for o in others], [list(o.values()) for o in others]]
            return out

        return one

    return add_columns(docs, FIELDS + RARE if rare else FIELDS, start, drop=["text"])


def split_buckets(docs: DataFrame, vocabulary: Vocabulary, flat: np.ndarray, counts: DataFrame) -> DataFrame:
    """The scores of words: those of ids, and of each word outside the vocabulary the log of its share of its bucket."""
    taken = {f.name.lower() for f in FIELDS} | {"text"}
    names = [n for n in docs.columns if n.lower() not in taken]
    # numbered, so that no name of the input can be one of those used here
    plain = docs.select(*[docs[n].alias(f"c{i}") for i, n in enumerate(names)], "text", F.monotonically_increasing_id().alias("_row"))
    base = stored(scored(plain, vocabulary, flat, rare=True), "scores")
    words_of = base.select("_row", F.explode(F.arrays_zip("_rare", "_times")).alias("w")).select(
        "_row", F.col("w._rare").alias("word"), F.col("w._times").alias("times"))
    inside = words_of.join(shares(counts, vocabulary), "word").groupBy("_row").agg(
        F.sum(F.col("times") * F.col("log_share")).alias("_inside"))
    done = base.join(inside, "_row", "left").withColumn("logp", F.col("logp") + F.coalesce("_inside", F.lit(0.0)))
    mean = F.try_divide("logp", "n_tokens")
    return done.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(names)], "n_tokens", "logp", mean.alias("mean_logp"),
        F.exp(-mean).alias("pseudo_perplexity"))


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text, ...) less the text, with its scores by a network trained on the same documents."""
    counts = stored(word_counts(docs), "words")
    found = vocabulary(docs, counts)
    return split_buckets(docs, found, train(docs, found), counts)
