import os
import random
import subprocess
import sys
from pathlib import Path

import numpy as np
from conftest_rows import ODD

from placegrid.llm import lm_score as lm
from placegrid.llm.decontaminate import words
from placegrid.llm.queries import QUERIES


def test_conditionals_are_probabilities():
    rnd = np.random.default_rng(1)
    net = lm.Network()
    net.flat[:] = rnd.normal(0, 0.3, len(net.flat))
    around = [5, 17, None, 900, 44]
    docs = []
    for w in range(lm.SIZE):
        docs.append([w if x is None else x for x in around])
    ids, at = lm.Network.padded(docs)
    p = np.exp(net.log_probabilities(ids, at)[2::5])
    assert abs(p.sum() - 1) < 1e-4


def test_gradient_lowers_the_loss():
    rnd = np.random.default_rng(2)
    docs = [[3, 70, 140, 210] * 30 for _ in range(20)] + [list(rnd.integers(0, lm.SIZE, 40)) for _ in range(5)]
    ids, at = lm.Network.padded(docs)
    net, squares = lm.Network(), None
    squares = lm.Network(np.full(len(net.flat), 1e-4, np.float32))
    before = net.log_probabilities(ids, at).mean()
    for k in range(6):
        net.train(ids, at, squares, k)
    assert net.log_probabilities(ids, at).mean() > before + 2


def test_slices_do_not_matter(monkeypatch):
    net = lm.Network()
    ids, at = lm.Network.padded([[1, 2, 3], [], [4] * 50])
    whole = net.log_probabilities(ids, at)
    monkeypatch.setattr(lm, "SLICE", 7)
    assert np.allclose(net.log_probabilities(ids, at), whole)


def test_training_on_the_corpus_beats_word_frequencies(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    found = lm.vocabulary(docs)
    assert len(found) == lm.SIZE - lm.BUCKETS
    flat = lm.train(docs.repartition(4), found, rounds=3, part=0.6)
    held = [r.text.encode() for r in docs.orderBy("doc_id").collect()]
    ids = [i for t in held for i in found.ids(t)]
    share = (np.bincount(ids, minlength=lm.SIZE) + 0.5) / (len(ids) + lm.SIZE / 2)
    out = lm.scored(docs, found, flat).collect()
    assert sum(r.logp for r in out) / sum(r.n_tokens for r in out) > np.log(share)[ids].mean()


def test_odd_rows(odd, none):
    found = lm.vocabulary(odd)
    out = lm.scored(odd.withColumnsRenamed({"n_chars": "logp"}), found, lm.train(odd, found))
    assert out.columns == ["doc_id", "lang", "source", *[f.name for f in lm.FIELDS]]
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r, o in zip(rows, ODD):
        assert r.n_tokens == len(words((o[1] or "").encode()))
        assert (r.mean_logp is None) == (r.n_tokens == 0) and r.logp <= 0
    assert lm.pseudo_likelihood(none).count() == 0


def test_probabilities_sum_to_one_over_words(spark):
    """One-word documents: the conditionals of all words of the corpus, given nothing around them."""
    rnd = random.Random(4)
    rows = [(i, f"w{i}") for i in range(9000) for _ in range(rnd.choice([1, 1, 2, 3]))]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = {r.doc_id: r.logp for r in lm.pseudo_likelihood(docs).collect()}
    assert len(out) == 9000 and abs(sum(np.exp(p) for p in out.values()) - 1) < 1e-3


def test_words_outside_the_vocabulary_by_brute_force(spark):
    rnd = random.Random(8)
    many = " ".join(f"r{rnd.randint(0, 1500)}" for _ in range(4000))
    texts = {1: "a b c Rare rare other zwölf r7", 2: "a b c a b c", 3: f"rare a lone word {many}", 4: None, 5: "", 6: "rare lone a rare r9"}
    rows = [(i, t, i * 10) for i, t in texts.items()] + [(1, texts[1], 10), (None, texts[3], 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _row long")
    counts = lm.word_counts(docs)
    n = {bytes(r.word): r.n for r in counts.collect()}
    found = lm.Vocabulary({b"a": 0, b"b": 1, b"c": 2})
    bucket = {}
    for w, k in n.items():
        if w not in found:
            bucket[found[w]] = bucket.get(found[w], 0) + k
    net = lm.Network()
    net.flat[:] = np.random.default_rng(3).normal(0, 0.3, len(net.flat))
    out = lm.split_buckets(docs, found, net.flat, counts)
    assert out.columns == ["doc_id", "_row", *[f.name for f in lm.FIELDS]]
    got = out.collect()
    assert sorted((r.doc_id or 0, r._row) for r in got) == sorted((r[0] or 0, r[2]) for r in rows)
    for r in got:
        text = (texts[r._row // 10] or "").encode()
        seq = words(text)
        ids, at = lm.Network.padded([found.ids(text)])
        want = net.log_probabilities(ids, at).sum() if seq else 0.0
        want += sum(np.log(n[w] / bucket[found[w]]) for w in seq if w not in found)
        assert r.n_tokens == len(seq) and abs(r.logp - want) < 1e-4 * (1 + len(seq))
        assert r.mean_logp is None if not seq else abs(r.mean_logp * len(seq) - r.logp) < 1e-6 * len(seq)


def test_all_documents_are_trained_on(spark, monkeypatch):
    rows = [(i, "some words of a text") for i in range(20)] + [(None, "a text without an id")] * 3
    held = []
    monkeypatch.setattr(lm, "train_round", lambda docs, vocabulary, flat, number: held.append(docs.count()) or flat)
    lm.pseudo_likelihood(spark.createDataFrame(rows, "doc_id long, text string"))
    assert held == [len(rows)] * lm.ROUNDS


def mean_logp(rows):
    return sum(r.logp for r in rows) / sum(r.n_tokens for r in rows)


def test_registered_query_learns_from_a_small_table(spark, tmp_path):
    rows = [(i, "the quick brown fox jumps over the lazy dog and runs on " * 10) for i in range(20)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    out = QUERIES["op10_lm_score"].run(spark, str(tmp_path)).collect()
    assert len(out) == 20 and mean_logp(out) > 1 - np.log(lm.SIZE)


def test_registered_query_beats_word_frequencies(spark):
    out = QUERIES["op10_lm_score"].run(spark, "/root/testdata/sf0.01").collect()
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    n = np.array([r.n for r in lm.word_counts(docs).collect()], float)
    assert sum(r.n_tokens for r in out) == n.sum()
    assert mean_logp(out) > (n * np.log(n / n.sum())).sum() / n.sum()


class Plain(lm.Network):
    """The step and the scores written out position by class, without regard to cost."""

    def log_probabilities(self, ids, at):
        out = np.empty(len(at))
        for a in range(0, len(at), 32_768):
            part = at[a:a + 32_768]
            h, (group, within) = self.hide(ids, part), np.divmod(ids[part], lm.CLASSES)
            logp = picked(h @ self.classes.T + self.class_bias, group)
            for c in range(lm.CLASSES):
                rows = np.flatnonzero(group == c)
                if len(rows):
                    logp[rows] += picked(h[rows] @ self.words[c].T + self.word_bias[c], within[rows])
            out[a:a + 32_768] = logp
        return out

    def train(self, ids, at, squares, seed):
        at = np.random.default_rng(seed).permutation(at)
        for a in range(0, len(at), lm.MINIBATCH):
            part = at[a:a + lm.MINIBATCH]
            n, rows = len(part), np.arange(len(part))
            h, (group, within) = self.hide(ids, part), np.divmod(ids[part], lm.CLASSES)
            g, f = softmax(h @ self.classes.T + self.class_bias), np.empty((n, lm.CLASSES), np.float32)
            spans = [(c, np.flatnonzero(group == c)) for c in np.unique(group)]
            for c, some in spans:
                f[some] = softmax(h[some] @ self.words[c].T + self.word_bias[c])
            g[rows, group] -= 1
            f[rows, within] -= 1
            back, grad = g @ self.classes, lm.Network(np.zeros_like(self.flat))
            for c, some in spans:
                back[some] += f[some] @ self.words[c]
                grad.words[c], grad.word_bias[c] = f[some].T @ h[some], f[some].sum(axis=0)
            back *= 1 - h * h
            grad.classes[:], grad.class_bias[:], grad.hidden[:] = g.T @ h, g.sum(axis=0), back.sum(axis=0)
            for table, o in zip(grad.around, lm.OFFSETS):
                np.add.at(table, ids[part + o], back)
            mean = grad.flat / n
            squares.flat += mean * mean
            self.flat -= lm.RATE * mean / (np.sqrt(squares.flat) + 1e-6)


def softmax(logits):
    e = np.exp(logits - logits.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def picked(logits, column):
    top = logits.max(axis=1)
    return logits[np.arange(len(logits)), column] - top - np.log(np.exp(logits - top[:, None]).sum(axis=1))


def drawn(seed, n, length):
    """Documents of ids, frequent ones more often."""
    rnd = np.random.default_rng(seed)
    return [(lm.SIZE * rnd.random(rnd.integers(0, 2 * length)) ** 3).astype(int).tolist() for _ in range(n)]


def test_steps_and_scores_are_those_of_the_plain_network():
    for docs in (drawn(6, 60, 400), drawn(7, 3, 20), [[5] * 700, [], [lm.SIZE - 1]], [[]]):
        ids, at = lm.Network.padded(docs)
        nets = []
        for kind in (lm.Network, Plain):
            net, squares = kind(), lm.Network(np.full(len(lm.Network().flat), 1e-4, np.float32))
            for k in range(2):
                net.train(ids, at, squares, k)
            nets.append((net.flat, squares.flat, net.log_probabilities(ids, at)))
        for got, want in zip(*nets):
            assert np.allclose(got, want, rtol=1e-4, atol=1e-4)


def test_logits_far_apart():
    logits = np.array([[200, 199, 90], [-300, -301, -299]], np.float32)
    assert np.allclose(lm._softmax(logits.copy()), softmax(logits))
    assert np.allclose(lm._softmax(logits.copy(), 4), softmax(logits) / 4)
    assert np.allclose(lm._picked(logits.copy(), np.array([2, 0])), picked(logits, np.array([2, 0])))


COST = """
import time
import numpy as np
from placegrid.llm import lm_score as lm

def best(work):
    took = []
    for _ in range(7):
        began = time.process_time()
        work()
        took.append(time.process_time() - began)
    return min(took)

rnd = np.random.default_rng(9)
ids, at = lm.Network.padded([(lm.SIZE * rnd.random(400) ** 3).astype(int).tolist() for _ in range(128)])
net, squares = lm.Network(), lm.Network(np.full(len(lm.Network().flat), 1e-4, np.float32))
grad, spare = np.full_like(net.words, 0.01), np.empty_like(net.words)
logits = rnd.normal(size=(lm.MINIBATCH, 2 * lm.CLASSES)).astype(np.float32)

def needed():  # the step of the largest layer and the exponentials of a minibatch
    for _ in range(len(at) // lm.MINIBATCH):
        np.multiply(grad, grad, out=spare)
        np.sqrt(spare, out=spare)
        np.divide(grad, spare, out=spare)
        np.subtract(grad, spare, out=spare)
        np.exp(logits)

unit = best(needed)
print(best(lambda: net.train(ids, at, squares, 1)) / unit, best(lambda: net.log_probabilities(ids, at)) / unit)
"""


def test_training_and_scoring_cost_few_passes():
    """In CPU seconds, against the passes over weights and logits that each minibatch cannot do without."""
    env = {**os.environ, "OMP_NUM_THREADS": "1", "PYTHONPATH": str(Path(__file__).resolve().parents[2])}
    out = subprocess.run([sys.executable, "-c", COST], env=env, capture_output=True, text=True, check=True, timeout=120).stdout
    training, scoring = map(float, out.split())
    assert training < 14 and scoring < 3.3, out
