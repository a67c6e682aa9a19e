import numpy as np
import pytest

from placegrid.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def brute(rows, k=16):
    """(vec_id, component) -> (n, deviation, |whitened|, explained) by numpy's own eigenvectors."""
    rows = [(i, [int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for i, v in rows]
    fit = sorted({tuple(x) for _, x in rows})
    n, s = len(fit), [sum(c) for c in zip(*fit)]
    x = np.array(fit, float)
    z = x - x.mean(axis=0)
    values, vectors = np.linalg.eigh(z.T @ z / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    out = {}
    for i, row in rows:
        white = (np.array(row) - np.array(s) / n) @ vectors / np.sqrt(values)
        for c in range(len(values)):
            out.setdefault((i, c + 1), []).append((n, sum((n * a - b) ** 2 for a, b in zip(row, s)), abs(white[c]), values[c] / np.trace(z.T @ z / n)))
    return out


def table(seed=3, n=400, d=24):
    random = np.random.default_rng(seed)
    x = random.normal(size=(n, d)) @ random.normal(size=(d, d)) * 0.3
    rows = [(i, [float(c) for c in np.float32(v)]) for i, v in enumerate(x)]
    return rows + [(n + i, rows[0][1]) for i in range(200)]  # a third are copies


def test_as_by_numpy(spark):
    rows = table()
    out, model = whitening.whitened(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA))
    want = brute(rows)
    assert out.columns == ["vec_id", "label", "whitened", "deviation"]
    got = out.collect()
    assert len(got) == len(rows) and model.identity_error < 1e-9 and model.n == 400
    for r in got:
        for c, w in enumerate(r.whitened, 1):
            n, deviation, white, explained = want[r.vec_id, c][0]
            assert (model.n, r.deviation) == (n, deviation)
            assert abs(w) == pytest.approx(white, abs=1e-8) and model.explained[c - 1] == pytest.approx(explained, rel=1e-10)


def test_covariance_of_the_fit_list_is_the_identity(spark):
    out, _ = whitening.whitened(spark.createDataFrame([(i, v, 1) for i, v in table()[:400]], SCHEMA))
    w = np.array([r.whitened for r in out.collect()])
    assert np.abs(np.cov(w.T, bias=True) - np.eye(16)).max() < 1e-9


@pytest.mark.parametrize("matrix", [
    np.eye(20), np.zeros((5, 5)), np.diag([3.0, 3, 3, 2, 2, 1, 1, 0, 0]), np.ones((30, 30)), np.kron(np.eye(4), np.cov(np.arange(30.0).reshape(5, 6) % 7)),
    np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1),  # pairs of nearly equal values
    *[np.cov(np.random.default_rng(n).normal(size=(n, 90)) * s) for n, s in ((2, 1), (3, 1e6), (33, 1e-6), (64, 1))],
], ids=str)
def test_eigenpairs(matrix):
    values, rows = eigen.leading(matrix, 16)
    scale = max(np.abs(matrix).max(), 1e-300)
    want = np.linalg.eigvalsh(matrix)[::-1][:16]
    assert np.abs(values - want).max() <= 1e-13 * scale * len(matrix)
    assert np.abs(rows @ rows.T - np.eye(len(rows))).max() < 1e-12
    assert np.abs(matrix @ rows.T - rows.T * values).max() <= 1e-12 * scale * len(matrix)


def test_odd_rows(spark):
    rows = [(1, [1.0, 2.0, 0.5], 1), (1, [1.0, 2.0, 0.5], 1), (None, [0.25, -1.0, 3.0], None), (2, [-0.0, 7.0, 1.0], 3), (3, None, 1),
            (4, [], 1), (5, [1.0, None, 2.0], 1), (6, [NAN, 1.0, 1.0], 1), (7, [1.0, -INF, 1.0], 1), (8, [1.0, 2.0], 1), (9, [2e6, 1.0, 1.0], 1)]
    out, model = whitening.whitened(spark.createDataFrame(rows, SCHEMA).withColumnsRenamed({"label": "Whitened"}))
    got = out.collect()
    assert out.columns == ["vec_id", "whitened", "deviation"] and sorted(str(r.vec_id) for r in got) == ["1", "1", "2", "None"]
    # three distinct vectors span two directions
    assert model.n == 3 and len(model.components) == 2 and all(len(r.whitened) == 2 for r in got) and model.identity_error < 1e-9


def test_one_vector_and_none(spark):
    out, model = whitening.whitened(spark.createDataFrame([(i, [1.0, 2.0], 1) for i in range(5)], SCHEMA))
    assert [(r.whitened, r.deviation) for r in out.collect()] == [([], 0)] * 5 and model.identity_error is None
    out, model = whitening.whitened(spark.createDataFrame([], SCHEMA))
    assert out.collect() == [] and model.n == 0


def test_deviation_stays_exact_beyond_doubles(spark):
    rows = [(i, [float(i * 9001 % 800_000), -float(i * i % 700_000)]) for i in range(300)]
    out, _ = whitening.whitened(spark.createDataFrame([(i, v, 1) for i, v in rows], SCHEMA))
    want = brute(rows)
    for r in out.collect():
        exact = want[r.vec_id, 1][0][1]
        assert r.deviation == (exact if exact < 1 << 63 else None)


def test_registered_query(spark, sf_dir):
    from placegrid.llm.queries import QUERIES

    df = QUERIES["op11_whitening"].run(spark, sf_dir)
    assert dict(df.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double",
                               "explained": "double", "identity_error": "double"}
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()
    want = brute([(r.vec_id, r.embedding) for r in rows])
    got = df.collect()
    assert len(got) == 16 * len(rows)
    for r in got:
        n, deviation, white, explained = want[r.vec_id, r.component][0]
        assert (r.n, r.deviation) == (n, deviation) and abs(r.whitened) == pytest.approx(white, abs=1e-8)
        assert r.explained == pytest.approx(explained, rel=1e-9) and r.identity_error < 1e-9
