import numpy as np
from conftest_rows import ODD
from pyspark.sql import functions as F

from placegrid.llm import langid
from placegrid.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang")
    out = QUERIES["op5_language"].run(spark, SF).join(docs, "doc_id").where("held_out").collect()
    assert len(out) > 200
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.98
    assert all(0 <= r.score <= 1 for r in out)


def test_odd_rows(spark, odd, none):
    model = langid.train(odd, F.coalesce(F.col("doc_id"), F.lit(1)) % 2 == 0)
    out = langid.predicted(odd.withColumnsRenamed({"n_chars": "SCORE"}), model)
    assert out.columns == ["doc_id", "lang", "source", "lang_pred", "score"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r, o in zip(rows, ODD):
        if not o[1] or not any(c.isalpha() for c in o[1]):
            assert (r.lang_pred, r.score) == ("und", 0.0)
        else:
            assert r.lang_pred in ("en", "fr")
    assert langid.train(none, F.lit(True)) is None
    assert {r.lang_pred for r in langid.predicted(odd, None).collect()} == {"und"}
    assert langid.predicted(none, model).count() == 0


def test_counts_do_not_depend_on_slices(monkeypatch):
    letters, text = langid._letters(), ("Zwölf Boxkämpfer, 12 x jagen Viktor 𐐷𐐷 quer! " * 40).encode()
    whole = langid.counts(text, letters)
    monkeypatch.setattr(langid, "SLICE_CHARS", 17)
    assert (langid.counts(text, letters) == whole).all()
    assert langid.counts("12 34 !".encode(), letters) is None


def test_document_frequencies(spark):
    docs = spark.createDataFrame([("ab",), ("ab ab",), (None,), ("9",)], "text string")
    n, df = langid.document_frequencies(docs)
    own = langid.counts(b"ab", langid._letters())
    assert n == 2 and (df[own > 0] == 2).all()


def test_penalty_makes_weights_sparse():
    model = langid.Model(["a", "b"], np.ones(1 << langid.BITS))
    x = np.ones(1, np.float32)
    model.fit([(np.array([i % 2]), x, i % 2) for i in range(40)])
    assert np.count_nonzero(model.weights) == 4
    best, p = model.predict([(np.array([0]), x), (np.array([1]), x)])
    assert list(best) == [0, 1] and (p > 0.5).all()


def test_symbols_above_the_basic_plane_are_no_letters(spark):
    letters = langid._letters()
    for text in ("😀", "😀😀 🎉!", "𝟏𝟐𝟑 𝟜", "🀄 12 𐄷"):
        assert langid.counts(text.encode(), letters) is None
    assert (langid.counts("ab 😀 cd😀".encode(), letters) == langid.counts(b"ab cd ", letters)).all()
    assert langid.counts("𐐷𐐷".encode(), letters) is not None and langid.counts("𠀀😀".encode(), letters) is not None
    rows = [(i, t, g) for i, (t, g) in enumerate([("the cat and the dog", "en"), ("le chat et le chien", "fr")] * 8)]
    rows += [(100, "😀 🎉🎉", "en"), (101, "𝟏𝟐𝟑 🀄", "fr"), (102, "the dog 😀", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.train(docs.where("doc_id < 100"), F.col("doc_id") % 4 < 2)
    out = {r.doc_id: (r.lang_pred, r.score) for r in langid.predicted(docs, model).collect()}
    assert out[100] == out[101] == ("und", 0.0) and out[102][0] == "en"


def test_copies_of_a_row_are_drawn_once(spark):
    rows = [(1, "the cat", "en")] * 50 + [(i, f"le chat {i}", "fr") for i in range(2, 9)] + [(9, "b text", "en"), (9, "a text", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = sorted((r.doc_id, r.lang, r.text) for r in langid.sample(docs, 5, F.lit(True)).collect())
    assert [r for r in got if r[1] == "en"] == [(1, "en", "the cat"), (9, "en", "a text")] and len(got) == 7


def test_held_out_of_a_null_id_is_false(spark, tmp_path):
    rows = [(None, "the cat and the dog", "en", "s", 1)] + [(i, "le chat et le chien", "fr", "s", 1) for i in range(40)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op5_language"].run(spark, str(tmp_path)).collect()
    assert [r.held_out for r in out if r.doc_id is None] == [False] and {r.held_out for r in out} == {True, False}


def test_learning_as_by_plain_loops():
    """Follow the regularised leader, one weight at a time."""
    from math import exp, sqrt

    rnd = np.random.default_rng(4)
    rows = []
    for _ in range(40):
        at = np.sort(rnd.choice(30, 6, replace=False))
        rows.append((at, rnd.random(6).astype(np.float32), int(rnd.integers(0, 3))))
    model = langid.Model(["a", "b", "c"], np.ones(1 << langid.BITS))
    model.fit(rows)
    z, n = {}, {}

    def weight(f, k):
        s = z.get((f, k), 0.0)
        if f != "bias" and abs(s) <= langid.L1 or f == "bias" and abs(s) <= langid.L1:
            return 0.0
        return -(s - langid.L1 * (1 if s > 0 else -1)) / ((langid.BETA + sqrt(n.get((f, k), 0.0))) / langid.ALPHA + langid.L2)

    order = np.random.default_rng(11)
    for _ in range(langid.EPOCHS):
        for j in order.permutation(len(rows)):
            at, x, y = rows[j]
            parts = [*zip(at.tolist(), x.tolist()), ("bias", 1.0)]
            w = {(f, k): weight(f, k) for f, _ in parts for k in range(3)}
            s = [sum(v * w[f, k] for f, v in parts) for k in range(3)]
            p = [exp(v - max(s)) for v in s]
            for k in range(3):
                miss = p[k] / sum(p) - (k == y)
                for f, v in parts:
                    g, old = miss * v, n.get((f, k), 0.0)
                    n[f, k] = old + g * g
                    z[f, k] = z.get((f, k), 0.0) + g - (sqrt(n[f, k]) - sqrt(old)) / langid.ALPHA * w[f, k]
    want = np.array([[weight(f, k) for k in range(3)] for f in range(30)])
    assert np.abs(model.weights[:30] - want).max() < 1e-4 and np.abs(model.bias - [weight("bias", k) for k in range(3)]).max() < 1e-4
    assert np.abs(want).max() > 0.1
