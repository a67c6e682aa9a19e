"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton takes in the words of every item; the words of a document are streamed through it while the length of
the longest match that ends at each word is tracked. A match of `window` words or more, or a whole item of fewer
words, is a hit. Spans of hits that exceed the length limit or the coverage limit are cut out of the text.

The automata are the only thing that is broadcast. One holds at most `shard_words` item words (counted first); a
larger benchmark is dealt over several automata that the documents pass one after the other, so no bound of the
benchmark is assumed and nothing is shuffled.

Defined results: a null or empty text has no words and no hits; null and empty items are ignored; items with the same
words all count; a null item_id marks words but is not listed; repeated documents are judged one by one; an empty
benchmark marks nothing. Input columns called `n_words`, `hits` or `items` are replaced, all others are carried along.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegrid.llm.common import add_columns, share, texts

WINDOW = 10
MIN_SPAN = 5  # words of the shortest span that is cut
SHARD_WORDS = 500_000

# Words are runs of ASCII letters and digits and of any character from U+0080 on; A-Z count as a-z.
_WORD_BYTES = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20
    for b in range(256)
)
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("hits", T.ArrayType(T.StructType([
        T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))),
    T.StructField("items", T.ArrayType(T.StringType())),
]


def words(text: bytes | None) -> list[bytes]:
    return text.translate(_WORD_BYTES).split() if text else []


class Automaton:
    """Suffix automaton of many word sequences, with what each state needs to know about windows and short items."""

    def __init__(self, items: Iterable[tuple[str | None, list[bytes]]], window: int = WINDOW) -> None:
        self.window = window
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        rows = [(i, w) for i, w in items if w]
        for _, seq in rows:
            last = 0
            for word in seq:
                last = self._extend(last, word)
        # The state of the last `window` words of a match lies on the match state's chain of suffix links.
        order = sorted(range(len(self.link)), key=self.length.__getitem__)
        self.base = [-1] * len(self.link)
        for v in order[1:]:
            if self.length[v] >= window:
                up = self.link[v]
                self.base[v] = self.base[up] if self.length[up] >= window else v
        self.held: dict[int, set[str]] = {}
        whole: dict[int, tuple[int, set[str]]] = {}
        for item, seq in rows:
            state = 0
            for j, word in enumerate(seq, 1):
                state = self.next[state][word]
                if j >= window and item is not None:
                    self.held.setdefault(self.base[state], set()).add(item)
            if len(seq) < window:
                found = whole.setdefault(state, (len(seq), set()))[1]
                if item is not None:
                    found.add(item)
        # Nearest state on the chain, itself included, that ends a whole short item.
        self.whole = whole
        self.near = [-1] * len(self.link)
        for v in order[1:]:
            self.near[v] = v if v in whole else self.near[self.link[v]]

    def _extend(self, last: int, word: bytes) -> int:
        q = self.next[last].get(word)
        if q is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, word, q)
        new = len(self.link)
        self.next.append({})
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        p = last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._clone(p, word, q)
        return new

    def _clone(self, p: int, word: bytes, q: int) -> int:
        copy = len(self.link)
        self.next.append(dict(self.next[q]))
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def scan(self, seq: list[bytes]) -> tuple[bytearray | None, set[str]]:
        """The hit words of a document (None if there are none) and the items whose windows it holds."""
        nexts, link, length, near, window = self.next, self.link, self.length, self.near, self.window
        mark, found = None, set()
        root, state, l = nexts[0], 0, 0
        for i, word in enumerate(seq):
            to = nexts[state].get(word)
            if to is None:
                if not state:
                    continue
                while to is None and state:
                    state = link[state]
                    l = length[state]
                    to = nexts[state].get(word)
                if to is None:
                    l = 0
                    continue
            state = to
            l += 1
            if l < window and near[state] < 0:
                continue
            if mark is None:
                mark = bytearray(len(seq))
            if l >= window:
                # a longer match only adds this word: the words before it were marked with the match they belong to
                n = window if l == window else 1
                mark[i + 1 - n:i + 1] = b"\1" * n
                found |= self.held.get(self.base[state], set())
            at = near[state]
            while at > 0:
                n, ids = self.whole[at]
                if n <= l:
                    mark[i + 1 - n:i + 1] = b"\1" * n
                    found |= ids
                at = near[link[at]]
        return (mark if mark and any(mark) else None), found


def _runs(mark: bytearray) -> list[tuple[int, int]]:
    return [m.span() for m in re.finditer(rb"\x01+", mark)]


def _shards(benchmark: DataFrame, window: int, shard_words: int) -> list[Automaton]:
    """Automata of at most about `shard_words` words each; the driver holds one shard's items at a time."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text"))
    total = items.agg(F.sum(F.size(F.split("text", "[^0-9A-Za-z\\x{80}-\\x{10FFFF}]+")))).first()[0] or 0
    n = max(1, -(-int(total) // shard_words))
    made = []
    for k in range(n):
        part = items if n == 1 else items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k)
        made.append(Automaton(((r[0], words(r[1].encode())) for r in part.toLocalIterator() if r[1]), window))
    return made


def mark(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_words: int = SHARD_WORDS,
         keep_text: bool = True) -> DataFrame:
    """`docs` with n_words, hits (runs of hit words, end exclusive, by start) and items (sorted ids)."""
    out = docs
    shards = _shards(benchmark, window, shard_words)
    for k, automaton in enumerate(shards):
        shared, again = share(docs.sparkSession, automaton), k > 0

        def start(shared=shared, again=again):
            scan = shared().scan

            def one(batch):
                before = ([batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_hits", "_items")]
                          if again else None)
                counts, hits, items = [], [], []
                for row, text in enumerate(texts(batch)):
                    seq = words(text)
                    found, ids = scan(seq)
                    if before:
                        ids |= set(before[1][row])
                        if before[0][row]:
                            found = found or bytearray(len(seq))
                            for r in before[0][row]:
                                found[r["start"]:r["end"]] = b"\1" * (r["end"] - r["start"])
                    counts.append(len(seq))
                    hits.append([{"start": a, "end": b} for a, b in _runs(found)] if found else [])
                    items.append(sorted(ids))
                return [counts, hits, items]

            return one

        if again:
            out = out.withColumnsRenamed({"hits": "_hits", "items": "_items"})
        last = k == len(shards) - 1
        out = add_columns(out, FIELDS, start, drop=(["_hits", "_items"] if again else [])
                          + ([] if keep_text or not last else ["text"]))
    return out


def clean(docs: DataFrame, benchmark: DataFrame, min_span: int = MIN_SPAN, max_coverage: float = 0.5,
          window: int = WINDOW, shard_words: int = SHARD_WORDS) -> DataFrame:
    """`docs` without benchmark spans of `min_span` words or more, and without documents that are mostly benchmark.

    A document of which more than `max_coverage` of the words are hit is dropped, and so are its remains. Whole items
    of fewer than `window` words are cut where they have `min_span` words; shorter ones are common phrases and only
    count for the coverage. The text around a cut is joined as it stands; `n_chars`, where present, is counted again.
    """
    names = docs.columns
    # under names of their own, so that no column of the input meets one of the marks
    plain = docs.select(*[docs[n].alias("text" if n == "text" else f"c{i}") for i, n in enumerate(names)])
    found = mark(plain, benchmark, window, shard_words)
    hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    cut = F.filter("hits", lambda r: r["end"] - r["start"] >= min_span)
    found = found.withColumn("_cut", cut).where((F.col("n_words") == 0) | (hit <= F.lit(max_coverage) * F.col("n_words")))

    def start():
        def one(batch):
            out = []
            cuts = batch.column(batch.schema.get_field_index("_cut")).to_pylist()
            for text, spans in zip(texts(batch), cuts):
                if spans:
                    at = [m.span() for m in _WORD.finditer(text)]
                    parts, done = [], 0
                    for r in spans:
                        parts.append(text[done:at[r["start"]][0]])
                        done = at[r["end"] - 1][1]
                    text = b"".join([*parts, text[done:]])
                out.append(None if text is None else text.decode(errors="replace"))
            return [out]

        return one

    done = add_columns(found, [T.StructField("_text", T.StringType())], start,
                       drop=["text", "n_words", "hits", "items", "_cut"])
    own = {n: F.col("_text" if n == "text" else f"c{i}") for i, n in enumerate(names)}
    if "n_chars" in names:
        own["n_chars"] = F.char_length("_text").cast(docs.schema["n_chars"].dataType)
    return done.select(*[c.alias(n) for n, c in own.items()])
