import random
import re

import numpy as np
from conftest_rows import ODD
from pyspark.sql import functions as F

from placegrid.llm import pii

# the patterns as the contract writes them
PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def passes(kind, m):
    digits = [int(c) for c in m if c.isdigit()]
    if kind == "ip":
        return all(int(p) <= 255 for p in m.split("."))
    if kind == "card":
        total = sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(reversed(digits)))
        return 12 <= len(digits) <= 19 and total % 10 == 0
    return kind == "email" or 9 <= len(digits) <= 15


def brute(text):
    found = [(m.start(), k, f"{k}:{m.start()}:{m.end()}") for k in pii.KINDS for m in re.finditer(PLAIN[k], text or "") if passes(k, m[0])]
    return ",".join(s for *_, s in sorted(found, key=lambda x: (x[0], pii.KINDS.index(x[1]))))


def spans(df):
    return pii.redactions(df).select("doc_id", pii.span_text(F.col("base")).alias("base"), pii.span_text(F.col("spans")).alias("spans"))


def test_base_spans_as_by_brute_force(spark):
    rnd = random.Random(8)
    bits = ["a", "Z9", "@", ".", "-", "_", "+", "1", "12", "255", "256", " ", "(", ")", "4242424242424242", "é", "😀", "x@y.z", "1.2.3.4", "+1 234 567 890"]
    rows = [(i, "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 25)))) for i in range(1500)]
    texts = dict(rows)
    for r in spans(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert r.base == brute(texts[r.doc_id]), texts[r.doc_id]
        assert set(filter(None, r.base.split(","))) <= set(r.spans.split(","))


def test_odd_rows(odd, none):
    got = sorted((str(r.doc_id), r.base) for r in spans(odd.withColumnsRenamed({"n_chars": "base"})).collect())
    assert got == sorted((str(r[0]), brute(r[1])) for r in ODD)
    assert spans(none).count() == 0


def test_long_runs_of_digits_and_letters(spark):
    rows = [(1, "9" * 20000), (2, "a" * 20000 + "@b.cc"), (3, "1 " * 20000), (4, "1." * 20000)]
    got = {r.doc_id: r.base for r in spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: brute(t) for i, t in rows}


def test_trees_learn_and_calibrate():
    rnd = np.random.default_rng(0)
    x = np.unique(np.column_stack([rnd.integers(0, n, 400) for n in pii.FEATURES.values()]), axis=0)
    good = (x[:, 4] == 1) & (x[:, 1] > 8)
    model = pii.Boosted(x, np.where(good, 50.0, 0.0), np.where(good, 0.0, 50.0))
    assert model.fit_ok and all(0.5 <= t <= 1 for t in model.thresholds)
    nothing = pii.Boosted(x[:0], np.zeros(0), np.zeros(0))
    assert not nothing.fit_ok and min(nothing.thresholds) > 1


def test_a_kind_with_few_labels_is_judged_by_the_others():
    x = np.array([[k, f, 0, 0, 0, 0, 0] for k in range(4) for f in (0, 1)])
    p = np.tile([0.01, 0.99], 4)
    few, many = np.array([0, 3]), np.array([0, 400])
    told = lambda pos, neg: pii.Boosted._thresholds(x, p, np.concatenate(pos), np.concatenate(neg))
    none, bad = np.array([0, 0]), np.array([900, 0])
    assert told([many, few, few, few], [bad] * 4) == [0.99] * 4
    assert told([few] * 4, [bad] * 4) == [2.0] * 4  # twelve positives cannot show 0.98
    assert told([many, few, many, many], [bad, np.array([0, 2]), bad, bad]) == [0.99, 2.0, 0.99, 0.99]
    assert told([none] * 4, [bad] * 4) == [2.0] * 4


def test_selected_spans_are_added(spark):
    rows = [(i, f"write to joe{i}@mail{i}.example.com today") for i in range(60)] + [(100 + i, f"on 12-34-{10 + i} or 2024-01-{10 + i}") for i in range(60)]
    rows += [(999, "write to ann(at)mail(dot)example(dot)com today")]
    got = {r.doc_id: r for r in spans(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[999].base == "" and got[999].spans == "email:9:40"
    assert got[105].spans == ""


def test_text_is_redacted(spark):
    df = spark.createDataFrame([(1, "é x@y.zz and 1.2.3.4.")], "doc_id long, text string")
    out = df.join(pii.redactions(df), "doc_id").select(pii.redacted_text(F.col("text"), F.col("spans"))).first()[0]
    assert out == "é [email] and [ip]."


def test_plan_has_no_python(odd):
    plan = pii.candidates(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
