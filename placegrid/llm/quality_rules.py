"""Quality rules with host verdicts, in DataFrame functions only.

Every document is measured by rules inside its row. Failures are added up per host and rule; each host's rate is shrunk
with a beta prior fitted to the hosts' rates by moments (per rule), so a host of a few pages is judged by what is usual
and a large host by its own pages. A host whose shrunk rate of a rule exceeds that rule's limit is rejected, and with it
its documents. The host table (one row per host) is joined back by host; the documents' rows are narrow by then.

Defined results: a null text has no words (and so fails `few_words`); a null host is a host of its own; repeated rows
are judged one by one and all count for their host; an empty table gives an empty result. Of the input only the id and
the host are returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.functions.values import let
from placegrid.llm.common import stored

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of a host's documents, after shrinking, that may fail a rule.
HOST_LIMITS = {"few_words": 0.5, "repeated": 0.5, "symbols": 0.5, "dup_lines": 0.5, "word_length": 0.5}
MAX_STRENGTH = 1000.0
BLANK = " \t\r\x0b\x0c"
WHITE = "[\\x20\\x09-\\x0D]+"
SYMBOLS = "#*$%&|<>"


def repeated_words(words: Column, n: int = WINDOW) -> Column:
    """Number of words inside windows of n words that occur more than once in the array."""
    def covered(windows: Column) -> Column:
        # only texts that repeat a window sort their windows
        by_hash = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(windows)) == F.size(windows), 0).otherwise(let(by_hash, positions))

    def positions(pairs: Column) -> Column:
        twice = F.filter(pairs, lambda p, i: p["h"].eqNullSafe(F.get(pairs, i - 1)["h"]) | p["h"].eqNullSafe(F.get(pairs, i + 1)["h"]))
        at = F.sort_array(F.transform(twice, lambda p: p["i"]))
        start = F.struct(F.lit(0).alias("n"), F.lit(-n).alias("before"))
        return F.aggregate(at, start, lambda s, i: F.struct(
            (s["n"] + F.least(F.lit(n), i - s["before"])).alias("n"), i.alias("before")), lambda s: s["n"])

    hashes = F.transform(words, lambda w: F.xxhash64(w))
    windows = let(hashes, lambda h: F.transform(
        F.sequence(F.lit(1), F.size(h) - (n - 1)), lambda i: F.xxhash64(F.slice(h, i, n))))
    return F.when(F.size(words) <= n, 0).otherwise(let(windows, covered))


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and what the rules look at: n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words."""
    text = F.coalesce(F.col("text"), F.lit(""))
    words = F.filter(F.split(text, WHITE, -1), lambda w: w != "")
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.btrim(x, F.lit(BLANK)) != "")
    per_words = let(words, lambda w: F.struct(F.size(w).alias("n_words"), repeated_words(w).alias("n_repeat_words")))
    per_lines = let(lines, lambda x: F.struct(
        F.size(x).alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).alias("n_dup_lines")))
    wide = docs.select(
        "doc_id", F.col(host).alias("host"), per_words.alias("w"), per_lines.alias("l"),
        F.char_length(F.translate(text, "\n" + BLANK, "")).alias("word_chars"),
        (F.char_length(text) - F.char_length(F.translate(text, SYMBOLS, ""))).alias("n_symbols"),
    )
    return wide.select(
        "doc_id", "host",
        *[F.col(c).cast("long").alias(c.split(".")[-1]) for c in
          ("w.n_words", "word_chars", "n_symbols", "l.n_lines", "l.n_dup_lines", "w.n_repeat_words")])


def failures() -> dict[str, Column]:
    n = F.col("n_words")
    return {
        "few_words": n < MIN_WORDS,
        "repeated": F.col("n_repeat_words") * 100 > n * MAX_REPEAT_PERCENT,
        "symbols": F.col("n_symbols") * 10 > n,
        "dup_lines": F.col("n_dup_lines") * 10 > F.col("n_lines") * 3,
        "word_length": (F.col("word_chars") < n * 2) | (F.col("word_chars") > n * 15),
    }


def host_verdicts(measured: DataFrame, limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """host, rates (shrunk failure rate by rule) and rejected."""
    failed = failures()
    sums = measured.groupBy("host").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(failed[r].cast("long")).alias(r) for r in limits])
    by_rule = sums.select("host", "n", F.explode(F.array(*[
        F.struct(F.lit(r).alias("rule"), F.col(r).alias("fails"), F.lit(x).alias("limit")) for r, x in limits.items()
    ])).alias("r")).select("host", "n", "r.*")
    mean, spread = F.avg(F.col("fails") / F.col("n")), F.var_pop(F.col("fails") / F.col("n"))
    prior = by_rule.groupBy("rule").agg(mean.alias("m"), spread.alias("v"))
    # strength of the prior in documents, by moments; hosts that all agree give a strong one
    strength = F.when(F.col("v") <= 1e-12, MAX_STRENGTH).otherwise(
        F.least(F.lit(MAX_STRENGTH), F.greatest(F.lit(1.0), F.col("m") * (1 - F.col("m")) / F.col("v") - 1)))
    prior = prior.select("rule", "m", strength.alias("s"))
    shrunk = by_rule.join(prior, "rule").withColumn("rate", (F.col("fails") + F.col("m") * F.col("s")) / (F.col("n") + F.col("s")))
    return shrunk.groupBy("host").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("rule", "rate")))).alias("rates"),
        F.bool_or(F.col("rate") > F.col("limit")).alias("rejected"))


def judged(docs: DataFrame, host: str = "source", limits: dict[str, float] = HOST_LIMITS) -> DataFrame:
    """The measures with base_failed, host_rejected and kept."""
    measured = stored(measures(docs, host), "measures")
    hosts = host_verdicts(measured, limits).select(F.col("host").alias("_host"), "rejected")
    base = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)
    out = measured.join(hosts, measured["host"].eqNullSafe(hosts["_host"]), "left")
    return out.select(*measured.columns, base.alias("base_failed"), F.coalesce("rejected", F.lit(False)).alias("host_rejected"),
                      (~base & ~F.coalesce("rejected", F.lit(False))).alias("kept"))
