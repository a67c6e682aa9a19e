"""Mixing sources to target weights by Pareto order sampling, in DataFrame functions only.

Every source gets a target of words: sources by code point (null last) weigh `weights`, repeating, and share `share` of
all words; a target stops at `cap` times its source's words and the excess is shared again by weight until none is above.
Inside a source a document is expected `e = min(cap, k g)` times, where g is the bit length of its size, so fragments come
less often than long texts, and k is solved exactly from the words of each (source, g) so that the expected words are the
target. Of e the whole copies are certain. For the rest p, documents are ranked by random odds over inclusion odds,
(u / (1 - u)) / (p / (1 - p)) with u from a hash of id and text, and taken in that order while the words still owed to
the source last: a sample of fixed size, in words, with unequal probabilities. The first document that is too long for what is left is
passed over, and the order is followed on with those for which there is room. The rest goes to the document whose size fits
it best, and once more for what that one leaves or is too long.

The order is never sorted as a whole. Where a source's words run out is found digit by digit: words are added up by
(source, digit of the rank), at most 1024 sums a source, and only the documents behind the digit where they run out are
looked at again, until at most `LIMIT` of a source are left for a window. So a source may hold any share of the rows, and
each round reads a stored table of narrow rows. Tables by source are joined by source, left to the planner's measured
size.

Defined results: a null text has size 0, and documents of size 0 are never counted on (their words taken are 0); a null
source is a source of its own; repeated rows are documents each (told apart by their stored position only where all else
is equal, so reruns give the same rows); an empty table gives an empty result. Of the input the columns in `keep` are
returned; `size`, `source_size`, `target`, `copies` and `taken` replace columns of those names.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from placegrid.llm.common import stored

WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2
DIGIT, HASH_BITS = 10, 52
FITS = 2  # documents that may be exchanged in a source to come nearer to its target
LIMIT = 5000  # documents of a source that one window ranks
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def text_hash(id: Column, text: Column) -> Column:
    """52 bits of a hash of id and text."""
    key = F.concat(F.coalesce(id.cast("string"), F.lit("-")), F.lit(" "), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def numbered(sources: DataFrame, by: str) -> DataFrame:
    """`number`, from 0, in the order of a column, null last: by ranges, so no task sorts all."""
    ranged = stored(sources.repartitionByRange(F.asc_nulls_last(by)).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(F.asc_nulls_last(by)))
    return ranged.withColumn("_row", inside).join(starts, "_part").withColumn(
        "number", F.col("_before") + F.col("_row") - 1).drop("_part", "_row", "_before")


def targets(sources: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """`sources` (source, words) with `target`."""
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("number") % len(weights) + 1).cast("int"))
    weighed = stored(numbered(sources, "source").withColumn("weight", weight), "weights")
    total = weighed.agg(F.sum("words")).first()[0] or 0
    level, full, rest = None, 0, None
    while True:  # each round caps at least one source more, or ends
        now = F.lit(False) if level is None else F.col("words") * cap < F.col("weight") * level
        r = weighed.agg(F.sum(F.when(now, F.col("words"))).alias("full"), F.sum(F.when(~now, F.col("weight"))).alias("rest")).first()
        if r.rest is None or (level is not None and (r.full or 0, r.rest) == (full, rest)):
            break
        full, rest = r.full or 0, r.rest
        level = (share * total - cap * full) / rest
    target = F.least(F.col("words") * F.lit(float(cap)), F.col("weight") * F.lit(float(level or 0)))
    return weighed.select("source", "words", target.alias("target"))


def rates(levels: DataFrame, aimed: DataFrame, cap: float = CAP) -> DataFrame:
    """(source, words, target, rate): the rate k with the sum of min(cap, k g) times words equal to the target."""
    down = Window.partitionBy("source").orderBy(F.desc("g")).rowsBetween(Window.unboundedPreceding, -1)
    rows = aimed.withColumnRenamed("source", "_source").join(levels.where("words > 0").withColumnRenamed("words", "w"), F.col("_source").eqNullSafe(F.col("source")))
    full = F.coalesce(F.sum("w").over(down), F.lit(0))
    part = F.sum(F.col("g") * F.col("w")).over(Window.partitionBy("source")) - F.coalesce(F.sum(F.col("g") * F.col("w")).over(down), F.lit(0))
    tried = rows.withColumn("k", (F.col("target") - F.lit(float(cap)) * full) / part)
    fits = tried.groupBy("source").agg(F.max_by(F.when(F.col("k") * F.col("g") <= cap, F.col("k")), F.when(F.col("k") * F.col("g") <= cap, F.col("g"))).alias("k"))
    return aimed.join(fits.withColumnRenamed("source", "_source"), aimed["source"].eqNullSafe(F.col("_source")), "left").select(
        "source", "words", "target", F.coalesce("k", F.lit(float(cap))).alias("rate"))


def expected(g: Column, rate: Column, cap: float = CAP) -> Column:
    return F.least(F.lit(float(cap)), rate * g)


KEY = ("t", "h", "salt")  # the order of a source's documents


def _digit(number: int) -> Column:
    """The number-th digit of a document's place: of the rank, then of its hash, then of its stored position."""
    at = number % 5 + 1
    if number < 5:
        whole = F.floor(F.col("t") * float(1 << DIGIT * at)).cast("long")
        return F.least(F.lit(1023), whole - F.floor(F.col("t") * float(1 << DIGIT * (at - 1))).cast("long") * 1024)
    bits, top = ("h", HASH_BITS) if number < 10 else ("salt", 50)
    return F.shiftright(F.col(bits), top - DIGIT * at).bitwiseAND(F.lit(1023))


def _joined(rows: DataFrame, state: DataFrame) -> DataFrame:
    state = state.withColumnRenamed("source", "_source")
    return rows.join(state, rows["source"].eqNullSafe(state["_source"])).drop("_source")


def cuts(rows: DataFrame, owed: DataFrame, limit: int = LIMIT) -> DataFrame:
    """(source, cut, left): the first document, in order, that a source's owed words do not reach, and what is left there.

    `rows` are (source, size, KEY) with sizes above 0, `owed` (source, left). The cut of a source that ends before its
    words do lies behind all documents.
    """
    here, digits, number, ended = _joined(rows, owed), None, 0, None
    while number < 15:
        sums = here.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.first("left").alias("left"))
        if ended is None:
            sums = stored(sums, "mix-words")
            ended = sums.where("words <= left").select("source", *[F.lit(2.0 if k == "t" else 0).cast(t).alias(k) for k, t in here.select(*KEY).dtypes],
                                                       (F.col("left") - F.col("words")).cast("double").alias("left"))
            ended = ended.select("source", F.struct(*KEY).alias("cut"), "left")
        if (sums.where("words > left").agg(F.max("n")).first()[0] or 0) <= limit:
            break
        by_digit = here.groupBy("source", "left", *(["digits"] if number else []), _digit(number).cast("long").alias("digit")).agg(F.sum("size").alias("words"))
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("digit"))
        over = by_digit.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
        found = F.array("digit") if not number else F.concat("digits", F.array("digit"))
        digits = stored(over.groupBy("source").agg(F.min_by(F.struct(
            (F.col("left") - (F.col("upto") - F.col("words"))).alias("left"), found.alias("digits")), "digit").alias("s")).select("source", "s.*"), "mix-digits")
        number += 1
        at = F.array(*[_digit(i).cast("long") for i in range(number)])
        here = _joined(rows, digits).where(F.col("digits") == at)
    upto = F.sum("size").over(Window.partitionBy("source").orderBy(*KEY).rowsBetween(Window.unboundedPreceding, 0))
    over = here.withColumn("upto", upto).where(F.col("upto") > F.col("left"))
    return over.groupBy("source").agg(
        F.min(F.struct(*KEY)).alias("cut"),
        F.min_by(F.col("left") - (F.col("upto") - F.col("size")), F.struct(*KEY)).cast("double").alias("left")).unionAll(ended)


OPEN = "p > 0 AND size > 0"  # documents with a part to be drawn for


def _taken() -> Column:
    """Whether a document comes before its source's cut, or behind it before the second one, or is one of those changed."""
    key = F.struct(*KEY)
    return ((key < F.col("cut")) | ((F.col("size") <= F.col("room")) & (key < F.col("second")))) != F.exists("changed", lambda k: k == key)


def chosen(ranked: DataFrame, owed: DataFrame, limit: int = LIMIT, rounds: int = FITS) -> DataFrame:
    """By source what decides on its documents: cut, room, second and changed (see `_taken`)."""
    rows = ranked.where(OPEN).select("source", "size", *KEY)
    first = stored(cuts(rows, owed, limit), "cuts")
    # the document at the cut may be a long one: go on behind it with those for which there is room
    behind = _joined(rows, first).where((F.struct(*KEY) > F.col("cut")) & (F.col("size") <= F.col("left"))).select("source", "size", *KEY)
    second = cuts(behind, first.select("source", "left"), limit).toDF("_source", "second", "_left")
    none = F.array().cast(f"array<struct<{', '.join(f'{k}:{t}' for k, t in first.select('cut.*').dtypes)}>>")
    state = stored(first.join(second, first["source"].eqNullSafe(second["_source"]), "left").select(
        "source", "cut", F.col("left").alias("room"), F.coalesce("second", "cut").alias("second"),
        F.coalesce("_left", "left").alias("left"), none.alias("changed")), "cuts")
    for _ in range(rounds):
        # what is still left (or too much) goes to (or from) the document that fits it best
        gap = F.abs(F.col("size") - F.abs("left"))
        best = _joined(rows, state).where((_taken() == (F.col("left") < 0)) & (gap < F.abs("left"))).groupBy(F.col("source").alias("_source")).agg(
            F.min(F.struct(gap.alias("gap"), *KEY, "size")).alias("best"))
        state = stored(state.join(best, state["source"].eqNullSafe(best["_source"]), "left").select(
            "source", "cut", "room", "second", (F.col("left") - F.coalesce(F.signum("left") * F.col("best.size"), F.lit(0.0))).alias("left"),
            F.when(F.col("best").isNull(), F.col("changed")).otherwise(
                F.concat("changed", F.array(F.struct(*[F.col(f"best.{k}").alias(k) for k in KEY])))).alias("changed")), "fits")
    return state


def mixed(
    docs: DataFrame, keep: Sequence[str] = ("doc_id",), id: str = "doc_id", text: str = "text", source: str = "source",
    weights: Sequence[float] = WEIGHTS, share: float = SHARE, cap: int = CAP, limit: int = LIMIT,
) -> DataFrame:
    """The columns `keep` of every document with its size, source_size, target, copies and taken words."""
    added = {"size", "source_size", "target", "copies", "taken"}
    keep = [n for n in keep if n.lower() not in added]
    size = word_count(F.col(text))
    read = stored(docs.select(
        *[docs[n].alias(f"c{i}") for i, n in enumerate(keep)], docs[source].alias("source"), size.alias("size"),
        text_hash(docs[id], docs[text]).alias("h"),
        F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 50) - 1)).alias("salt"),
    ).withColumn("g", F.length(F.bin("size"))), "sizes")
    levels = stored(read.groupBy("source", "g").agg(F.sum("size").alias("words")), "levels")
    aimed = targets(levels.groupBy("source").agg(F.sum("words").alias("words")), weights, share, cap)
    rate = stored(rates(levels, aimed, cap), "rates")
    by = rate.select(F.col("source").alias("_source"), F.col("words").alias("source_size"), "target", "rate")

    e = expected(F.col("g"), F.col("rate"), cap)
    u = (F.col("h") + 0.5) / float(1 << HASH_BITS)
    odds = (u / (1 - u)) / (F.col("p") / (1 - F.col("p")))
    ranked = read.join(by, read["source"].eqNullSafe(by["_source"]), "left").withColumn("copies", F.floor(e)).withColumn(
        "p", e - F.floor(e)).withColumn("t", F.when(F.col("p") > 0, odds / (1 + odds)))
    ranked = stored(ranked.drop("_source", "rate", "g"), "ranked")

    certain = levels.withColumnRenamed("source", "_s").join(by, F.col("_s").eqNullSafe(by["_source"])).groupBy("_s").agg(
        F.sum(F.floor(e) * F.col("words")).alias("certain"), F.first("target").alias("target"))
    owed = certain.select(F.col("_s").alias("source"), (F.col("target") - F.col("certain")).cast("double").alias("left"))
    state = chosen(ranked, owed, limit).withColumnRenamed("source", "_source")
    done = ranked.join(state, ranked["source"].eqNullSafe(state["_source"]), "left")
    copies = (F.col("copies") + F.coalesce(F.expr(OPEN) & _taken(), F.lit(False)).cast("int")).cast("long")
    return done.select(
        *[F.col(f"c{i}").alias(n) for i, n in enumerate(keep)], "size", F.coalesce("source_size", F.lit(0)).cast("long").alias("source_size"),
        F.coalesce("target", F.lit(0.0)).alias("target"), copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def repeated(mix: DataFrame) -> DataFrame:
    """The documents of a mix, each as often as it is taken."""
    return mix.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
