import numpy as np
import pytest
from pyspark.sql import functions as F

from placegrid.llm import negatives

SCHEMA = "vec_id long, embedding array<double>, label int"
NAN = float("nan")


def brute(rows, positives=5, k=10):
    rows = [(i, (lab + 1) % 10 if i is not None and i % 7 == 0 else lab, [int(np.floor(256 * c)) for c in v]) for i, v, lab in rows]
    key = lambda s: (-s[0], s[1] is None, s[1] or 0)
    out = []
    for a, (i, lab, x) in enumerate(rows):
        if i is None or i % 100:
            continue
        scores = [(sum(p * q for p, q in zip(x, y)), j, other == lab) for b, (j, other, y) in enumerate(rows) if b != a]
        same = sorted((s for s in scores if s[2]), key=key)[:positives]
        for p, pid, _ in same:
            near = sorted((s for s in scores if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=key)[:k]
            out += [(i, pid, n, j, p, s) for n, (s, j, _) in enumerate(near, 1)]
    return sorted(map(str, out))


def mined(spark, rows, **more):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("row", F.lit("x")).withColumn("X", F.lit(1)).repartition(5)
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    out = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, label, **more)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(str(tuple(r)) for r in out.collect())


def vectors(n, d, seed=1, scale=0.2):
    random = np.random.default_rng(seed)
    return [(i, (random.normal(size=d) * scale + 0.1).tolist(), int(random.integers(0, 4))) for i in range(n)]


@pytest.mark.parametrize("d,scale", [(1, 0.3), (16, 0.2), (16, 900.0), (16, 200_000.0)])  # doubles, longs, wider integers
def test_as_by_brute_force(spark, d, scale):
    rows = vectors(500, d, scale=scale)
    assert mined(spark, rows) == brute(rows)


def test_blocks_of_anchors_and_ties(spark):
    rows = [(i, [round(c, 1) for c in v], lab) for i, v, lab in vectors(900, 3)] + [(i, [0.5, 0.5, 0.5], i % 3) for i in range(2000, 2400)]
    want = brute(rows)
    assert want and mined(spark, rows, block=2) == want == mined(spark, rows)


def test_few_rows_are_kept_at_a_time(spark, monkeypatch):
    rows = vectors(600, 4)
    monkeypatch.setattr(negatives, "TILE", 64)
    assert mined(spark, rows) == brute(rows)


@pytest.mark.parametrize("low,high,d", [(-300, 290, 64), (0, 1, 3), (-(1 << 14), 1 << 14, 8), (-(1 << 27), 1 << 27, 5), (4, 4, 2)])
def test_packed_products_are_exact(low, high, d):
    packing, random = negatives.Packing(low, high, d), np.random.default_rng(2)
    anchors, x = random.integers(low, high + 1, (7, d)), random.integers(low, high + 1, (11, d))
    anchors[0], x[0], x[1], anchors[1] = high, high, low, low
    got = packing.scores(packing.biased(anchors), anchors.sum(axis=1), x)
    assert (got.astype(object) == anchors.astype(object) @ x.astype(object).T).all()
    assert packing.fields > 1 or packing.bits > 31


def test_odd_rows(spark):
    rows = vectors(130, 2) + [(0, [0.1, 0.2], 1), (0, [0.1, 0.2], 1), (None, [0.3, 0.2], 2), (None, [0.3, 0.2], 1)]
    bad = [(200, None, 1), (300, [], 1), (400, [0.1, None], 1), (500, [NAN, 0.1], 1), (600, [0.1, 0.1], None), (700, [0.1, 0.1, 0.1], 1), (800, [3e6, 0.1], 1)]
    assert mined(spark, rows + bad) == brute(rows)


def test_no_rows_no_anchor_no_positive(spark):
    assert mined(spark, []) == []
    assert mined(spark, [(1, [0.5], 1), (2, [0.4], 2)]) == []
    assert mined(spark, [(100, [0.5], 1), (2, [0.4], 2), (3, [0.2], 3)]) == []
    assert mined(spark, [(100, [-0.5], 1), (2, [0.4], 1), (3, [0.2], 3)]) == []  # a negative score has no range below it
