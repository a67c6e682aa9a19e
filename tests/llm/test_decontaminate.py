import random
import re

import pytest
from conftest_rows import ODD

from placegrid.llm import decontaminate as dc

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window):
    words, hit, ids = split(text), set(), set()
    for item, t in items:
        w = split(t)
        n = min(window, len(w))
        windows = {tuple(w[i:i + n]) for i in range(len(w) - n + 1)} if n else set()
        for i in range(len(words) - n + 1 if n else 0):
            if tuple(words[i:i + n]) in windows:
                hit |= set(range(i, i + n))
                if item is not None:
                    ids.add(item)
    return len(words), sorted(hit), sorted(ids)


def marked(df, bench, **kw):
    out = {}
    for r in dc.mark(df, bench, **kw).collect():
        out[r.doc_id] = (r.n_words, [i for h in r.hits for i in range(h.start, h.end)], r["items"])
    return out


@pytest.mark.parametrize("shard_words", [500_000, 60])
def test_hits_as_by_brute_force(spark, shard_words):
    rnd = random.Random(4)
    abc = ["a", "b", "c", "É"]
    items = [(f"q{i}", " ".join(rnd.choice(abc) for _ in range(rnd.choice([0, 1, 3, 5, 6, 8])))) for i in range(25)]
    items += [("q3", "a b c a b c a"), (None, "c c c c c c"), ("dup", "a-b, C a. b c a"), ("null", None)]
    docs = [(i, "; ".join(rnd.choice(abc) for _ in range(rnd.randint(0, 40)))) for i in range(60)]
    got = marked(spark.createDataFrame(docs, "doc_id long, text string"),
                 spark.createDataFrame(items, "item_id string, text string"), window=5, shard_words=shard_words)
    for i, t in docs:
        assert got[i] == brute(t, items, 5), t


def test_odd_rows_and_clashing_columns(spark, odd):
    bench = spark.createDataFrame([("i", "Three four five six SEVEN"), ("j", "")], "item_id string, text string")
    out = dc.mark(odd.withColumnsRenamed({"n_chars": "HITS"}), bench)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_words", "hits", "items"]
    rows = out.collect()
    assert len(rows) == len(ODD)
    for r in rows:
        n, hit, ids = brute(r.text, [("i", "Three four five six SEVEN")], 10)
        assert (r.n_words, [k for h in r.hits for k in range(h.start, h.end)], r["items"]) == (n, hit, ids)


def test_empty_tables(spark, odd, none):
    bench = spark.createDataFrame([("i", "one two")], "item_id string, text string")
    assert dc.mark(none, bench).count() == 0
    assert all(r.hits == [] for r in dc.mark(odd, bench.limit(0)).collect())


def test_short_items_and_clashing_columns_of_clean(spark):
    bench = spark.createDataFrame([("s", "What is the seventh prime"), ("y", "Yes it is")], "item_id string, text string")
    prose = " ".join(f"w{i}" for i in range(12))
    docs = [(1, f"{prose} what is the seventh PRIME? {prose}", 1), (2, f"{prose} yes it is {prose}", 2), (3, f"What is the seventh prime {prose[:5]}", 3),
            (4, "yes, it is", 4)]
    df = spark.createDataFrame(docs, "doc_id long, text string, hits int").withColumnsRenamed({"hits": "Hits"})
    out = dc.clean(df, bench)
    assert out.columns == ["doc_id", "text", "Hits"]
    # 1: the whole item is cut; 2: a phrase of three words stays; 3 and 4 are mostly benchmark
    assert {r.doc_id: (r.text, r.Hits) for r in out.collect()} == {1: (f"{prose} ? {prose}", 1), 2: (docs[1][1], 2)}


def test_spans_are_cut_and_covered_documents_go(spark):
    bench = spark.createDataFrame([("i", "a b c d e f g h i j k")], "item_id string, text string")
    clean = " ".join(f"w{i}" for i in range(30))
    docs = [(1, clean, 7), (2, f"{clean}. A b, c d e f g h i j k! Rest.", 7), (3, "A B C D E F G H I J K", 7), (4, None, None)]
    out = {r.doc_id: (r.text, r.n_chars) for r in dc.clean(spark.createDataFrame(docs, "doc_id long, text string, n_chars int"), bench).collect()}
    assert out == {1: (clean, len(clean)), 2: (f"{clean}. ! Rest.", len(clean) + 9), 4: (None, None)}
