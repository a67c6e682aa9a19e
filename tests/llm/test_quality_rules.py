import random
import re

from conftest_rows import ODD

from placegrid.llm import quality_rules as qr


def repeated(words, n=8):
    seen = {}
    for i in range(len(words) - n + 1):
        seen.setdefault(tuple(words[i:i + n]), []).append(i)
    return len({j for at in seen.values() if len(at) > 1 for i in at for j in range(i, i + n)})


def measured(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), repeated(words))


def check(rows, df):
    got = sorted((str(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in qr.judged(df).collect())
    assert got == sorted((str(r[0]), *measured(r[1])) for r in rows)


def test_measures_as_by_brute_force(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice(["a ", "b ", "b\n", "#c\t", "é😀\n", "\x0b"]) for _ in range(rnd.randint(0, 80))), "s") for i in range(120)]
    check(rows, spark.createDataFrame(rows, "doc_id long, text string, source string"))


def test_odd_rows(odd, none):
    check([(r[0], r[1]) for r in ODD], odd.withColumnsRenamed({"n_chars": "n_words"}))
    assert qr.judged(none).count() == 0


def test_host_rates_are_shrunk_towards_the_usual(spark):
    good = "this is a sentence of plain words that goes on for a while and says " + " ".join(f"w{i}" for i in range(20))
    rows = [(f"g{h}", good, h) for h in range(20) for _ in range(50)]
    rows += [("bad", good + " " + "# " * 40, 90)] * 50 + [("one", good + " " + "# " * 40, 91)]
    df = spark.createDataFrame([(i, t, str(h)) for i, (_, t, h) in enumerate(rows)], "doc_id long, text string, source string")
    hosts = {r.host: r for r in qr.host_verdicts(qr.measures(df)).collect()}
    assert hosts["90"].rejected and not hosts["0"].rejected
    assert hosts["91"].rates["symbols"] < hosts["90"].rates["symbols"]
    kept = {r.doc_id: r.kept for r in qr.judged(df).collect()}
    assert kept[0] and not kept[1000]
