import random

import numpy as np
import pytest

from placegrid.llm import neardup


def brute(rows, k, percent=80):
    """Classes by all pairs of full sets; rows of (id, text)."""
    sets = []
    for _, t in rows:
        w = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").split()
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            low[find(i)] = min(low.get(find(i), d), d)
    return [(d, len(sets[i]), low.get(find(i), d) if sets[i] else d) for i, (d, _) in enumerate(rows)]


def found(df, k):
    out = neardup.near_duplicates(df, k=k).collect()
    for r in out:
        assert r.kept == (r.doc_id == r.component_id)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


@pytest.mark.parametrize("k", [2, 5])
def test_variants_of_texts_as_by_brute_force(spark, k):
    rnd = random.Random(k)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):
        base = [rnd.choice(vocabulary) for _ in range(rnd.choice([3, 30, 120]))]
        rows.append(" ".join(base))
        for _ in range(40):
            text = list(base)
            for _ in range(rnd.randint(0, max(1, len(base) // 8))):
                text[rnd.randrange(len(text))] = rnd.choice(vocabulary)
            rows.append(" ".join(text))
    rnd.shuffle(rows)
    rows = list(enumerate(rows))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, k) == sorted(brute(rows, k), key=str)


def test_chain_reaches_its_smallest_id(spark):
    words = [f"w{i}" for i in range(200)]
    rows = [(20 - j, " ".join(words[10 * j:10 * j + 120])) for j in range(8)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert found(df, 2) == sorted(brute(rows, 2), key=str)
    assert len({c for _, _, c in found(df, 2)}) == 1


def test_odd_rows(odd):
    from conftest_rows import ODD

    rows = [(r[0], r[1]) for r in ODD]
    assert found(odd.withColumnsRenamed({"n_chars": "n_shingles"}), 2) == sorted(brute(rows, 2), key=str)


def test_empty_table(none):
    assert neardup.near_duplicates(none).count() == 0


def test_sketch_agreement_is_the_similarity():
    rnd = np.random.default_rng(1)
    a = np.unique(rnd.integers(0, 2**63, 900).astype(np.uint64))
    b = np.unique(np.concatenate((a[:800], rnd.integers(0, 2**63, 100).astype(np.uint64))))
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    s = neardup.sketches([a, b, a[:1]], 512)
    assert (s != np.iinfo(np.uint64).max).all()
    assert abs((s[0] == s[1]).mean() - want) < 0.09


def test_set_hashes_depend_on_words_only():
    one, two, three, four = neardup.shingle_sets([b"A b\tc", b"a  B c ", b"c b a", b""], 2)
    assert (one == two).all() and len(four) == 0 and not set(one) & set(three)
