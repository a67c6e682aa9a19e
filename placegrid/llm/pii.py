"""Personal data by candidate gradient boosting, in DataFrame functions only.

Fixed patterns find e-mail addresses, IP addresses, card numbers (Luhn) and phone numbers; these base spans always stay.
Beside them wide generators propose candidates that may overlap: addresses with spelled-out signs, dotted and spaced
numbers, phone numbers without a plus. Each candidate gets features of its format and of the text around it, as small
whole numbers. Boosted trees of depth two score them; a span of a kind is selected where its calibrated probability
reaches that kind's threshold.

Training is weakly supervised by the whole table: a candidate that overlaps a base span of its kind counts as positive,
one that lies in a span of another kind or that a checksum, range or format rule refutes as negative. Features take few
values, so the table of training cells (one row per distinct feature vector with its positives and negatives, summed by
a groupBy) has at most `CELLS` rows whatever the input; it is all that the driver sees, and the trees fitted to it
become one SQL expression. A kind is searched only in texts that hold the least its patterns need.

Defined results: a null text is empty; repeated rows are searched one by one; an empty table gives an empty result.
Offsets count code points, ends are exclusive. Of the input only doc_id is returned.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placegrid.functions.values import let
from placegrid.llm.common import stored

KINDS = ("email", "ip", "card", "phone")

# Base patterns; the possessive and look-behind forms find the same matches as the plain ones, in linear time.
#   email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+      ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#   card  [0-9]([\x20-]?[0-9])+                                  phone \+[0-9][\x20().0-9-]+[0-9]
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
#: Wider forms, and what a text must hold at least for either form of a kind to be tried.
WIDE = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+(?:@|\s?[(\[]at[)\]]\s?)[A-Za-z0-9-]++(?:(?:\.|\s?[(\[]dot[)\]]\s?)[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9.,])[0-9]{1,3}(?:[.,][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[ .-]?[0-9]){11,18}+(?![0-9])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})[ .-][0-9]{2,4}(?:[ .-][0-9]{2,4}){1,3}(?![0-9])",
}
GATE = {
    "email": r"@|[(\[]at[)\]]", "ip": r"[0-9][.,][0-9]+[.,][0-9]+[.,][0-9]",
    "card": r"[0-9](?:[ .-]?[0-9]){11}", "phone": r"\+[0-9]|[0-9]{2,4}\)?[ .-][0-9]{2,4}[ .-]",
}
CONTEXT = r"(?i)(?:e-?mail|mail|phone|telefon|tel|fon|call|fax|mobile|card|karte|carte|tarjeta|visa|iban|ip|host|addr|address|contact|kontakt)\W{0,3}$"
FEATURES = {"kind": 4, "digits": 20, "groups": 6, "separator": 5, "check": 2, "before": 4, "after": 3}
CELLS = math.prod(FEATURES.values())
ROUNDS, RATE, PENALTY = 20, 0.3, 1.0
PRECISION = 0.98


def matches(text: Column, pattern: str) -> Column:
    """Matches of a pattern from the left: array of (start, end, match, before, after), in code points."""
    def build(parts: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
        steps = F.transform(found, lambda m, i: F.struct(
            m.alias("m"), F.get(parts, i).alias("b"), F.get(parts, i + 1).alias("a")))
        start = F.struct(F.lit(0).alias("at"), F.array().cast(_MATCH).alias("out"))

        def merge(s, x):
            begin = s["at"] + F.char_length(x["b"])
            end = begin + F.char_length(x["m"])
            one = F.struct(begin.alias("start"), end.alias("end"), x["m"].alias("m"),
                           F.right(x["b"], F.lit(24)).alias("b"), F.left(x["a"], F.lit(1)).alias("a"))
            return F.struct(end.alias("at"), F.concat(s["out"], F.array(one)).alias("out"))

        return F.aggregate(steps, start, merge, lambda s: s["out"])

    return let(F.split(text, pattern, -1), build)


_MATCH = "array<struct<start:int,end:int,m:string,b:string,a:string>>"


def digits_of(m: Column) -> Column:
    return F.regexp_replace(m, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn sum."""
    def add(s, c, i):
        d = c.cast("int")
        twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
        return s + F.when(i % 2 == 0, d).otherwise(twice)

    reverse = F.split(F.reverse(digits), "")
    total = F.aggregate(F.transform(reverse, lambda c, i: F.struct(c.alias("c"), i.alias("i"))), F.lit(0),
                        lambda s, x: add(s, x["c"], x["i"]))
    return total % 10 == 0


def octets_ok(m: Column) -> Column:
    parts = F.split(m, "[.,]")
    return F.forall(parts, lambda p: (F.char_length(F.ltrim(p, F.lit("0"))) <= 3)
                    & (F.coalesce(F.left(F.ltrim(p, F.lit("0")), F.lit(3)).try_cast("int"), F.lit(0)) <= 255))


def valid(kind: str, m: Column) -> Column:
    """The rule that a match of the kind has to pass."""
    n = F.char_length(digits_of(m))
    return {
        "email": F.lit(True), "ip": octets_ok(m), "phone": n.between(9, 15),
        "card": F.when(n.between(12, 19), luhn(digits_of(m))).otherwise(False),
    }[kind]


def _features(kind: str, x: Column) -> Column:
    """start, end and the features of a candidate."""
    m, digits = x["m"], digits_of(x["m"])
    seps = F.regexp_replace(m, "[A-Za-z0-9+()_%@]", "")
    check = F.regexp_like(m, F.lit(r"[.)\]\s][A-Za-z]{2,10}$")) if kind == "email" else valid(kind, m)
    return F.struct(
        x["start"].alias("start"), x["end"].alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
        F.least(F.char_length(digits), F.lit(19)).alias("digits"),
        F.least(F.size(F.regexp_extract_all(m, F.lit("[0-9]+"), F.lit(0))), F.lit(5)).alias("groups"),
        F.when(seps == "", 0).when(F.regexp_like(seps, F.lit(r"^\.+$")), 1).when(F.regexp_like(seps, F.lit("^-+$")), 2)
        .when(F.regexp_like(seps, F.lit(r"^\s+$")), 3).otherwise(4).alias("separator"),
        F.when(check, 1).otherwise(0).alias("check"),
        F.when(F.regexp_like(x["b"], F.lit(CONTEXT)), 1).when(F.regexp_like(x["b"], F.lit(r"\w$")), 2)
        .when(F.regexp_like(x["b"], F.lit(r"[(:=]\s?$")), 3).otherwise(0).alias("before"),
        F.when(F.regexp_like(x["a"], F.lit(r"\w")), 2).when(F.regexp_like(x["a"], F.lit(r"\S")), 1).otherwise(0).alias("after"),
    )


def _featured(kind: str):
    return lambda x: _features(kind, x)


def candidates(docs: DataFrame) -> DataFrame:
    """doc_id, base (valid spans by start, then kind) and wide (candidates with features and weak labels)."""
    text = F.coalesce(F.col("text"), F.lit(""))
    looked = docs.select("doc_id", text.alias("text"), *[F.regexp_like(text, F.lit(GATE[k])).alias(f"g_{k}") for k in KINDS])
    empty = F.array().cast(_MATCH)
    raw = looked.select("doc_id", *[
        F.when(F.col(f"g_{k}"), matches(F.col("text"), p[k])).otherwise(empty).alias(f"{n}_{k}")
        for k in KINDS for n, p in (("base", BASE), ("wide", WIDE))])

    def good(k):
        kept = F.filter(f"base_{k}", lambda x: valid(k, x["m"]))
        return F.transform(kept, lambda x: F.struct(
            x["start"].alias("start"), F.lit(KINDS.index(k)).alias("kind"), x["end"].alias("end")))

    base = raw.select("doc_id", F.sort_array(F.concat(*[good(k) for k in KINDS])).alias("base"),
                      F.concat(*[F.transform(f"wide_{k}", _featured(k)) for k in KINDS]).alias("wide"))

    def labelled(c):
        meets = lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])
        same = F.exists("base", lambda b: meets(b) & (b["kind"] == c["kind"]))
        other = F.exists("base", lambda b: meets(b))
        label = F.when(same, 1).when(other | (c["check"] == 0), 0)
        return F.struct(*[c[n].alias(n) for n in ("start", "end", *FEATURES)], label.alias("label"), other.alias("in_base"))

    return base.select("doc_id", "base", F.transform("wide", labelled).alias("wide"))


class Boosted:
    """Boosted trees of depth two over cells (distinct feature vectors with positive and negative counts)."""

    def __init__(self, x: np.ndarray, pos: np.ndarray, neg: np.ndarray) -> None:
        self.trees: list[tuple] = []
        total = pos.sum() + neg.sum()
        self.fit_ok = len(x) > 0 and pos.sum() > 0 and neg.sum() > 0
        self.bias = float(np.log((pos.sum() + 1) / (neg.sum() + 1))) if total else 0.0
        score = np.full(len(x), self.bias)
        for _ in range(ROUNDS if self.fit_ok else 0):
            p = 1 / (1 + np.exp(-score))
            grad, hess = pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p)
            tree = self._grow(x, grad, hess, np.ones(len(x), bool), 2)
            self.trees.append(tree)
            score = score + self._apply(tree, x)
        self.scale, self.shift = self._calibrate(score, pos, neg) if self.fit_ok else (1.0, 0.0)
        self.thresholds = self._thresholds(x, 1 / (1 + np.exp(-(self.scale * score + self.shift))), pos, neg)

    def _leaf(self, grad, hess, at) -> float:
        return float(RATE * grad[at].sum() / (hess[at].sum() + PENALTY))

    def _grow(self, x, grad, hess, at, depth):
        best, worth = None, 1e-9
        whole = grad[at].sum() ** 2 / (hess[at].sum() + PENALTY)
        for f in range(x.shape[1] if depth else 0):
            for t in np.unique(x[at, f])[:-1]:
                low, high = at & (x[:, f] <= t), at & (x[:, f] > t)
                gain = (grad[low].sum() ** 2 / (hess[low].sum() + PENALTY)
                        + grad[high].sum() ** 2 / (hess[high].sum() + PENALTY) - whole)
                if gain > worth:
                    best, worth = (f, int(t), low, high), gain
        if best is None:
            return self._leaf(grad, hess, at)
        f, t, low, high = best
        return (f, t, self._grow(x, grad, hess, low, depth - 1), self._grow(x, grad, hess, high, depth - 1))

    def _apply(self, tree, x):
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        f, t, low, high = tree
        return np.where(x[:, f] <= t, self._apply(low, x), self._apply(high, x))

    @staticmethod
    def _calibrate(score, pos, neg) -> tuple[float, float]:
        """Platt scaling by damped Newton steps."""
        a, b = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * score + b)))
            g, h = pos * (1 - p) - neg * p, (pos + neg) * p * (1 - p) + 1e-9
            m = np.array([[(h * score * score).sum() + 1, (h * score).sum()], [(h * score).sum(), h.sum() + 1]])
            step = np.linalg.solve(m, [(g * score).sum() - (a - 1), g.sum() - b])
            a, b = a + step[0], b + step[1]
        return float(a), float(b)

    @staticmethod
    def _thresholds(x, p, pos, neg) -> list[float]:
        """By kind, the lowest probability down to which the share of positives stays above PRECISION (2: none).

        A kind's share is shrunk towards that of all kinds at the same probability, which weighs as much as
        1 / (1 - PRECISION) labels, so a kind with few labels is judged by the others and one with many by its own.
        All kinds together start with one negative.
        """
        order = np.argsort(-p, kind="stable")
        good, all_ = np.cumsum(pos[order]), np.cumsum((pos + neg)[order]) + 1
        upto = np.searchsorted(-p[order], -p, side="right") - 1  # the last cell of at least this probability
        pooled = good[upto] / all_[upto]
        weight, out = 1 / (1 - PRECISION), []
        for k in range(len(KINDS)):
            best, good, bad = 2.0, 0.0, 0.0
            for i in order:
                if x[i, 0] == k:
                    good, bad = good + pos[i], bad + neg[i]
                    if (good + weight * pooled[i]) / (good + bad + weight) >= PRECISION:
                        best = float(p[i])
            out.append(max(best, 0.5))
        return out

    def probability(self, c: Column) -> Column:
        names = list(FEATURES)

        def told(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            f, t, low, high = tree
            return F.when(c[names[f]] <= t, told(low)).otherwise(told(high))

        score = F.lit(self.bias)
        for tree in self.trees:
            score = score + told(tree)
        return 1 / (1 + F.exp(-(score * self.scale + self.shift)))

    def threshold(self, c: Column) -> Column:
        return F.element_at(F.array(*[F.lit(t) for t in self.thresholds]), c["kind"] + 1)


def train(found: DataFrame) -> Boosted:
    """Fits the trees to the cells of all labelled candidates; at most CELLS rows reach the driver."""
    names = list(FEATURES)
    cells = (
        found.select(F.explode("wide").alias("c")).select("c.*").where("label IS NOT NULL").groupBy(*names)
        .agg(F.sum("label").alias("pos"), F.sum(1 - F.col("label")).alias("neg")).collect())
    cells.sort(key=lambda r: [r[n] for n in names])
    x = np.array([[r[n] for n in names] for r in cells], np.int64).reshape(len(cells), len(names))
    return Boosted(x, np.array([float(r["pos"]) for r in cells]), np.array([float(r["neg"]) for r in cells]))


def redactions(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans: arrays of (start, kind, end), by start and kind."""
    found = stored(candidates(docs), "candidates")
    model = train(found)
    # a candidate is selected above its kind's threshold, outside the base spans, where no better one overlaps it
    scored = found.select("doc_id", "base", F.transform(F.filter("wide", lambda c: ~c["in_base"]), lambda c: F.struct(
        c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"),
        model.probability(c).alias("p"), model.threshold(c).alias("t"))).alias("wide"))
    able = scored.withColumn("wide", F.filter("wide", lambda c: c["p"] >= c["t"]))
    better = lambda c, d: (d["start"] < c["end"]) & (c["start"] < d["end"]) & (
        (d["p"] > c["p"]) | ((d["p"] == c["p"]) & ((d["kind"] < c["kind"]) | ((d["kind"] == c["kind"]) & (d["start"] < c["start"])))))
    chosen = F.filter("wide", lambda c: ~F.exists("wide", lambda d: better(c, d)))
    more = F.transform(chosen, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return able.select("doc_id", "base", F.sort_array(F.concat("base", more)).alias("spans"))


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == KINDS.index(kind))).cast("long")


def span_text(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted_text(text: Column, spans: Column) -> Column:
    """The text with each span replaced by its kind in brackets; spans inside an earlier one go with it."""
    names = F.array(*[F.lit(k) for k in KINDS])
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def cut(s, x):
        piece = F.concat(s["out"], F.substring(text, s["at"] + 1, x["start"] - s["at"]), F.lit("["),
                         F.element_at(names, x["kind"] + 1), F.lit("]"))
        return F.when(x["start"] >= s["at"], F.struct(x["end"].alias("at"), piece.alias("out"))).otherwise(
            F.struct(F.greatest(s["at"], x["end"]).alias("at"), s["out"].alias("out")))

    return F.aggregate(spans, start, cut, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.char_length(text))))
