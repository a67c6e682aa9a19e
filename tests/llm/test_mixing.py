import pytest
from conftest_rows import DOCS, ODD

from placegrid.llm import mixing


def aimed(words: dict, weights=(3, 1, 2), share=1.5, cap=2) -> dict:
    """Targets by sharing the excess again and again."""
    names = sorted([n for n in words if n is not None]) + [n for n in words if n is None]
    weight = {n: weights[i % len(weights)] for i, n in enumerate(names)}
    total, full = share * sum(words.values()), set()
    while True:
        rest = [n for n in names if n not in full]
        level = (total - cap * sum(words[n] for n in full)) / max(1, sum(weight[n] for n in rest))
        over = {n for n in rest if weight[n] * level > cap * words[n]}
        if not over:
            return {n: cap * words[n] if n in full else weight[n] * level for n in names}
        full |= over


def sizes(rows):
    return [(r[0], r[3], len([w for w in (r[1] or "").replace("\n", " ").split(" ") if w])) for r in rows]


def check(spark, rows, **more):
    got = mixing.mixed(spark.createDataFrame(rows, DOCS), keep=("doc_id", "source"), **more).collect()
    words, biggest = {}, {}
    for _, source, n in sizes(rows):
        words[source] = words.get(source, 0) + n
        biggest[source] = max(biggest.get(source, 0), n)
    want, taken = aimed(words), {}
    assert sorted((str(r.doc_id), str(r.source), r.size) for r in got) == sorted((str(a), str(b), c) for a, b, c in sizes(rows))
    for r in got:
        assert r.source_size == words[r.source] and r.target == pytest.approx(want[r.source]) and r.taken == r.copies * r.size
        assert 0 <= r.copies <= 2
        taken[r.source] = taken.get(r.source, 0) + r.taken
    return got, want, taken, biggest


def corpus(n=900, hot=300):
    rows = [(i, "w " * (1 + i * 37 % 90), "en", f"s{i % 7}", 1) for i in range(n)]
    return rows + [(n + i, "w " * (1 + i % 40), "en", "s3", 1) for i in range(hot)] + [(5000, "w " * 4000, "en", "s1", 1), (5001, None, "en", None, 1), (5002, "a b", "en", None, 1)]


CHOSEN = {}


@pytest.mark.parametrize("limit", [4, 5000])  # digits found in several rounds, one, or none
def test_words_come_near_their_targets(spark, limit):
    got, want, taken, _ = check(spark, corpus(), limit=limit)
    # rounds of digits change nothing
    assert sum(r.doc_id * r.copies for r in got) == CHOSEN.setdefault(0, sum(r.doc_id * r.copies for r in got))
    for source, target in want.items():
        assert abs(taken[source] - target) <= (40 if source == 's1' else 2), source  # s1 has one long text and few to fill up with


def test_copies_of_one_row_are_told_apart_and_reruns_agree(spark):
    rows = [(None, "same text of six words here", "en", "hot", 1)] * 700 + [(i, "w " * (i % 30), "en", "b", 1) for i in range(200)]
    first, want, taken, _ = check(spark, rows, limit=300)
    again = check(spark, rows[::-1], limit=300)[0]
    assert sorted(map(str, first)) == sorted(map(str, again))
    assert abs(taken["hot"] - want["hot"]) <= 6 and len({r.copies for r in first if r.source == "hot"}) == 2


def test_unequal_probabilities(spark):
    rows = [(i, "w " * (2 if i % 2 else 60), "en", f"s{i % 3 // 2}", 1) for i in range(3000)]
    got = check(spark, rows)[0]
    mean = {n: sum(r.copies for r in got if r.size == n and r.source == "s0") / sum(r.size == n and r.source == "s0" for r in got) for n in (2, 60)}
    # odds follow the bit length of the size, 2 and 6
    assert mean[60] > mean[2] > 0.1


def test_expected_copies_meet_the_target_exactly(spark):
    levels = spark.createDataFrame([("a", 1, 10), ("a", 4, 200), ("a", 9, 70), (None, 2, 8)], "source string, g int, words long")
    goal = spark.createDataFrame([("a", 280, 500.0), (None, 8, 16.0)], "source string, words long, target double")
    for r in mixing.rates(levels, goal).collect():
        by = {"a": {1: 10, 4: 200, 9: 70}, None: {2: 8}}[r.source]
        assert sum(min(2, r.rate * g) * w for g, w in by.items()) == pytest.approx(r.target)


def test_repeated_rows_of_the_mix(spark):
    mix = mixing.mixed(spark.createDataFrame(corpus(60, 0), DOCS), keep=("doc_id", "text", "source"))
    out = mixing.repeated(mix)
    assert out.groupBy().sum("size").first()[0] == mix.groupBy().sum("taken").first()[0]


def test_odd_and_empty_tables(spark, odd, none):
    clash = odd.withColumnsRenamed({"n_chars": "Target"})
    got = mixing.mixed(clash, keep=clash.columns)
    assert got.columns == ["doc_id", "text", "lang", "source", "size", "source_size", "target", "copies", "taken"]
    rows = got.collect()
    assert len(rows) == len(ODD) and all(r.taken == 0 for r in rows if r.size == 0)
    assert sorted(r.size for r in rows) == [0, 0, 0, 0, 1, 1, 7, 7, 7, 7, 7, 30000]
    assert mixing.mixed(none).collect() == []
    blank = spark.createDataFrame([(1, None, "en", "a", 0), (2, " ", "en", None, 0)], DOCS)
    assert [(r.taken, r.target) for r in mixing.mixed(blank).collect()] == [(0, 0.0)] * 2
    one = spark.createDataFrame([(1, "a b c d", "en", "a", 0)], DOCS)
    assert [(r.target, r.taken) for r in mixing.mixed(one).collect()] in ([(6.0, 4)], [(6.0, 8)])


def test_plan_has_no_python(spark, docs):
    plan = mixing.mixed(docs)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Cartesian", "NestedLoop"))
