"""Near-duplicate documents: fast similarity sketches, banding, exact verification, classes.

A document is its set of distinct k-word shingles (64-bit hashes; with fewer words, the whole sequence is the one
shingle). Fast similarity sketching fills the `bands * rows` coordinates of a sketch in rounds: in round i < t every
shingle throws its hash of that round into a bin chosen by the same hash, in rounds t..2t-1 all of them into bin i - t;
a coordinate keeps the earliest, smallest value and a document is done when no bin is empty, so every coordinate is
filled and long documents need a round or two. Two sets agree in a coordinate with probability equal to their Jaccard
similarity J, concentrated as for independent hashes, and meet in a band of r rows with J^r. With the default 48 bands
of 6 rows a pair at exactly J = 0.8 is missed with probability 5e-7, at 0.85 with 1e-10.

Equal sets are collapsed first, so copies of one text cost one vertex. A band that holds many sets never makes all its
pairs. Its hub is the member that meets most others over all bands (the text that variants were made from):
  1. each member is verified against the hub on the full sets, and links are joined to classes;
  2. where members are left outside the hub's class, pairs beside the hub are found by a join on the elements in which
     members differ from the hub, under an exact bound on how many two linked members share (`beside_hub`).
Links are joined to classes by label spreading with pointer jumping on stored tables.

Defined results: texts without a word (null, empty, white space) are linked with nothing; rows without an id take the
class of the rows with the same set, else they are on their own (component null, kept); repeated rows are returned as
often as they come, each with the class of its own text; other columns of the input are not returned. Ids must be
64-bit integers.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placegrid.llm.common import add_columns, mix, stored

BANDS, ROWS = 48, 6
PERCENT = 80
SLICE_BYTES = 1_000_000  # texts are hashed in slices of about this size

# ASCII white space ends a word; A-Z count as a-z.
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_IS_WORD = np.ones(256, dtype=bool)
_IS_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_BASE = np.uint64(0x9E3779B97F4A7C55)


def word_hashes(blob: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, 64-bit hash) of every word of a byte buffer."""
    word = _IS_WORD[blob]
    edge = np.flatnonzero(np.diff(word, prepend=False, append=False))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, np.empty(0, np.uint64)
    sizes = ends - starts
    at = np.flatnonzero(word)
    place = at - np.repeat(starts, sizes)
    power = np.ones(int(sizes.max()), np.uint64)
    if len(power) > 1:
        power[1:] = _BASE
        power = np.multiply.accumulate(power)
    terms = (_LOWER[blob[at]].astype(np.uint64) + np.uint64(1)) * power[place]
    first = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    return starts, mix(np.add.reduceat(terms, first) ^ (sizes.astype(np.uint64) << np.uint64(40)))


def shingle_sets(texts: list[bytes | None], k: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    sizes = np.array([len(t) if t else 0 for t in texts])
    blob = np.frombuffer(b" ".join(t or b"" for t in texts) + b" ", np.uint8)
    offsets = np.concatenate(([0], np.cumsum(sizes + 1)))
    starts, hashes = word_hashes(blob)
    cut = np.searchsorted(starts, offsets)
    out = []
    # fold k neighbouring words at every position once, then cut by document
    n = len(hashes)
    folded = np.zeros(max(n - k + 1, 0), np.uint64)
    for j in range(k if n >= k else 0):
        folded = mix(folded * _BASE + hashes[j:n - k + 1 + j])
    for a, b in zip(cut[:-1], cut[1:]):
        if b - a >= k:
            out.append(np.unique(folded[a:b - k + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for j in range(a, b):
                short = mix(short * _BASE + hashes[j:j + 1])
            out.append(short)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def sketches(sets: list[np.ndarray], t: int) -> np.ndarray:
    """Fast similarity sketch of each set, t coordinates each; the rows of empty sets are not to be used."""
    if 2 * t > 1 << 10:
        raise ValueError("a sketch has at most 512 coordinates: ten bits hold the round")
    docs = len(sets)
    out = np.full(docs * t, np.iinfo(np.uint64).max, np.uint64)
    sizes = np.array([len(s) for s in sets])
    items = np.concatenate(sets) if docs else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(docs), sizes)
    seeds = mix(np.arange(1, 2 * t + 1, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    low = np.uint64((1 << 54) - 1)
    for i in range(2 * t):
        if not len(items):
            break
        h = mix(items ^ seeds[i])
        bins = ((h >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64) if i < t else i - t
        np.minimum.at(out, owner * t + bins, (h & low) | np.uint64(i << 54))
        empty = (out.reshape(docs, t) == np.iinfo(np.uint64).max).any(axis=1)
        going = empty[owner]
        if not going.all():
            items, owner = items[going], owner[going]
    return out.reshape(docs, t)


def _slices(blobs: list[bytes | None]):
    part, weight = [], 0
    for b in blobs:
        part.append(b)
        weight += len(b) if b else 0
        if weight >= SLICE_BYTES or len(part) >= 500:
            yield part
            part, weight = [], 0
    if part:
        yield part


def _set_key(s: np.ndarray) -> bytes | None:
    """128 bits that stand for the whole set."""
    if not len(s):
        return None
    import hashlib

    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def sketched(docs: DataFrame, k: int, bands: int, rows: int, carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text_key, what is carried, n_shingles, set_key (null for texts without a word) and the `bands` hashes of the sketch."""
    from placegrid.llm.common import texts

    t = bands * rows

    def start():
        def one(batch):
            n, keys, band = [], [], []
            for part in _slices(texts(batch)):
                sets = shingle_sets(part, k)
                grid = sketches(sets, t).reshape(len(sets), bands, rows)
                h = np.broadcast_to(np.arange(bands, dtype=np.uint64), (len(sets), bands))
                for r in range(rows):
                    h = mix(h * _BASE + grid[:, :, r])
                for s, row in zip(sets, h.view(np.int64)):
                    n.append(len(s))
                    keys.append(_set_key(s))
                    band.append(row if len(s) else [])
            return [n, keys, band]

        return one

    fields = [T.StructField("n_shingles", T.LongType()), T.StructField("set_key", T.BinaryType()),
              T.StructField("bands", T.ArrayType(T.LongType()))]
    return add_columns(docs.select("doc_id", F.xxhash64("text").alias("text_key"), *carry, "text"), fields, start, drop=["text"])


def full_sets(docs: DataFrame, k: int) -> DataFrame:
    """doc_id and its full set of shingle hashes."""
    from placegrid.llm.common import texts

    def start():
        def one(batch):
            sets = [s.view(np.int64) for part in _slices(texts(batch)) for s in shingle_sets(part, k)]
            sizes = np.cumsum([0] + [len(s) for s in sets])
            flat = np.concatenate(sets) if sets else np.empty(0, np.int64)
            return [pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int64()))]

        return one

    return add_columns(docs.select("doc_id", "text"), [T.StructField("shingles", T.ArrayType(T.LongType()))], start,
                       drop=["text"])


def with_sets(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b, ...) with the full sets of both as sa and sb."""
    left = sets.select(F.col("rep").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("b"), F.col("shingles").alias("sb"))
    return pairs.join(left, "a").join(right, "b")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of which 100 * intersection >= percent * union, on the full sets."""
    both = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - both
    return with_sets(pairs, sets).where(both * 100 >= union * percent).select("a", "b")


def beside_hub(stars: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs (a, b) among the members of a hub, of which one at least is not in the hub's class. Loses none.

    With h the hub's set, D(x) the elements in which x and h differ, and s = |x| + |y|: x and y are linked if and only
    if they differ in no more than r * s elements, r = (100 - percent) / (100 + percent), that is, if D(x) and D(y)
    share t = (|D(x)| + |D(y)| - r * s) / 2 elements or more. So, with each D in order of rarity among the hub's
    members, the first |D| - t + 1 elements of both must have one in common. As x is no link of the hub, t is at least
    (1 - r) / 2 * |D(y)|, which bounds how much of each D has to be joined at all. Variants of one text differ from it
    in elements of their own, which come first, so a band of such variants makes hardly a pair.
    """
    r = (100 - percent) / (100 + percent)
    label = labels.withColumnRenamed("label", "l")
    told = (
        stars.join(label.toDF("b", "lb"), "b", "left").join(label.toDF("a", "la"), "a", "left")
        .withColumns({"lb": F.coalesce("lb", "b"), "la": F.coalesce("la", "a")}).withColumn("stray", F.col("la") != F.col("lb")))
    mixed = told.groupBy("a").agg(F.count(F.lit(1)).alias("k"), F.bool_or("stray").alias("any")).where("k > 1 AND any").select("a")
    wide = with_sets(told.select("a", "b", "lb", "stray").join(mixed, "a", "left_semi"), sets)
    delta = stored(wide.select(
        F.col("a").alias("hub"), F.col("b").alias("rep"), F.col("lb").alias("label"), "stray",
        F.size("sa").alias("nh"), F.size("sb").alias("n"),
        F.concat(F.array_except("sb", "sa"), F.array_except("sa", "sb")).alias("d")), "delta")
    tokens = delta.select("hub", "rep", F.explode("d").alias("e"))
    shared = tokens.groupBy("hub", "e").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = tokens.join(shared, ["hub", "e"]).groupBy("hub", "rep").agg(
        F.sort_array(F.collect_list(F.struct("df", "e"))).alias("s"))
    # elements of no other member come first and need not be joined; they only count for the position
    size = F.size("d")
    least = lambda t: F.greatest(F.lit(1), F.ceil(t - 1e-9).cast("int"))
    placed = stored(
        delta.select("hub", "rep", "label", "stray", "n", size.alias("k"), least((size - r * (F.col("n") + F.col("nh"))) / 2).alias("tx"),
                     least((1 - r) / 2 * size).alias("ty"))
        .join(ranked, ["hub", "rep"]).select("*", F.posexplode("s").alias("i", "x"))
        .select("hub", "rep", "label", "stray", "n", "k", F.col("x.e").alias("e"),
                (F.col("k") - F.size("s") + F.col("i")).alias("pos"), "tx", "ty"), "placed")
    x = placed.where(F.col("stray") & (F.col("pos") <= F.col("k") - F.col("tx"))).select(
        "hub", "e", *[F.col(c).alias(f"x_{c}") for c in ("rep", "label", "n", "k", "pos")])
    y = placed.where(F.col("pos") <= F.col("k") - F.col("ty")).select(
        "hub", "e", *[F.col(c).alias(f"y_{c}") for c in ("rep", "label", "n", "k", "pos")])
    t = least((F.col("x_k") + F.col("y_k") - r * (F.col("x_n") + F.col("y_n"))) / 2)
    near = x.join(y, ["hub", "e"]).where(
        (F.col("x_label") != F.col("y_label")) & (F.col("x_pos") <= F.col("x_k") - t) & (F.col("y_pos") <= F.col("y_k") - t))
    return near.select(F.least("x_rep", "y_rep").alias("a"), F.greatest("x_rep", "y_rep").alias("b")).distinct()


def classes(edges: DataFrame, name: str) -> DataFrame:
    """(id, label): the smallest id that each end of an edge reaches. Rounds grow with the logarithm of the depth."""
    both = stored(edges.union(edges.select("b", "a")).toDF("id", "to").distinct(), f"{name}-edges")
    labels = stored(both.groupBy("id").agg(F.least(F.min("to"), F.first("id")).alias("label")), f"{name}-labels")
    while True:
        near = both.join(labels.withColumnRenamed("id", "to"), "to").groupBy("id").agg(F.min("label").alias("near"))
        step = labels.join(near, "id").select("id", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        # jump: take the label of the label
        up = step.select(F.col("id").alias("label"), F.col("label").alias("jump"))
        step = step.join(up, "label", "left").select(
            "id", F.least("label", F.coalesce("jump", "label")).alias("label"), "was")
        step = stored(step, f"{name}-labels")
        moved = step.where("label < was").limit(1).count()
        labels = step.drop("was")
        if not moved:
            return labels


def near_duplicates(docs: DataFrame, k: int = 5, percent: int = PERCENT, bands: int = BANDS, rows: int = ROWS,
                    carry: Sequence[str] = ()) -> DataFrame:
    """doc_id, text_key (hash of the text), n_shingles, component_id (smallest id reachable), kept (doc_id = component_id).

    Narrow columns named in `carry` are returned too.
    """
    table = stored(sketched(docs, k, bands, rows, carry), "sketches")
    reps = table.where("set_key IS NOT NULL AND doc_id IS NOT NULL").groupBy("set_key").agg(
        F.min("doc_id").alias("rep"), F.first("bands").alias("bands"))
    members = reps.select("rep", F.explode("bands").alias("band"))
    shared = members.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    # only members of bands that hold two sets or more go on
    met = stored(members.join(shared, "band"), "bands")

    # the hub of a band is its member that meets most others over all bands: the text that the others were made from
    ends = met.groupBy("rep").agg(F.sum("size").alias("weight"))
    hubs = stored(met.select("band", "rep").join(ends, "rep").groupBy("band").agg(
        F.max_by("rep", F.struct("weight", -F.col("rep"))).alias("hub")), "hubs")
    star = met.join(hubs, "band").where(F.col("rep") != F.col("hub"))
    star = stored(star.select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct(), "star")
    wanted = docs.join(ends.select(F.col("rep").alias("doc_id")), "doc_id", "left_semi").select("doc_id", "text")
    sets = stored(full_sets(wanted.dropDuplicates(["doc_id", "text"]), k).withColumnRenamed("doc_id", "rep"), "sets")
    links = stored(verified(star, sets, percent), "links")
    labels = classes(links, "first")

    rest = beside_hub(star, labels, sets, percent)
    more = stored(verified(rest, sets, percent), "links")
    if not more.isEmpty():
        labels = classes(links.union(more), "second")

    # stored, so that the join below deals out both of its sides itself and can split a set that very many rows share
    of_set = stored(reps.select("set_key", "rep").join(labels.withColumnRenamed("id", "rep"), "rep", "left").select(
        "set_key", F.coalesce("label", "rep").alias("component")), "classes")
    return table.drop("bands").join(of_set, "set_key", "left").select(
        "doc_id", "text_key", *carry, "n_shingles", F.coalesce("component", "doc_id").alias("component_id"),
        F.col("doc_id").eqNullSafe(F.coalesce("component", "doc_id")).alias("kept"))
