import random

import sentencepiece
from brute_kneser_ney import Brute
from conftest_rows import DOCS, ODD
from pyspark.sql import functions as F
from test_decontaminate import brute as hits
from test_neardup import brute as classes
from test_pieces import PATH

import corpus_pipeline
from placegrid.llm import kneser_ney


def test_stages_are_the_documented_ones():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "line_dedup", "near_dedup", "decontamination", "tokens"]


def fixture(spark, tmp_path):
    """A folder of documents, labels and benchmark with each kind of case."""
    rnd = random.Random(6)
    words = ["".join(rnd.choice("aeioulnrst") for _ in range(rnd.randint(2, 7))) for _ in range(150)]
    prose = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    passage = prose(14)
    rows = []
    for i in range(120):
        lines = [prose(25) for _ in range(3)] + (["Menu - About - Terms"] if i % 2 else [])
        if i % 10 == 3:
            lines.append(f"{prose(5)} {passage} {prose(5)}")
        rows.append((i, "\n".join(lines), "en", f"s{i % 2}", 1))
    for i in range(20):  # copies and variants
        t = rows[i][1].split(" ")
        if i % 2:
            t[3] = "other"
        rows.append((200 + i, " ".join(t), "en", "s0", 1))
    rows += [(300 + i, " ".join(rnd.choice(["#$", "%%&", "@!X"]) for _ in range(40)), "en", "s1", 1) for i in range(10)]
    rows += [(400, passage, "en", "s1", 1), (401, "Menu - About - Terms", "en", "s1", 1), (402, None, "en", "s1", 1), (403, "  ", "en", "s0", 1)]
    short, phrase = prose(7), prose(3)
    rows = [(i, f"{t}\n{prose(9)} {short} {prose(9)} {phrase}" if i % 10 == 4 and 20 <= i < 120 else t, *r) for i, t, *r in rows]
    rows.append((404, f"{passage} {prose(4)}", "en", "s1", 1))
    bench = [("b0", passage.upper()), ("b1", prose(12)), ("b2", short), ("b3", phrase)]
    labels = [(i, 1, 0) for i in range(120)] + [(300 + i, 0, 0) for i in range(10)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id string, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    return rows, bench, labels


def brute(spark, rows, bench, labels):
    import math

    crc = {r.doc_id: r.c for r in spark.createDataFrame([(r[0],) for r in rows], "doc_id long").withColumn("c", F.crc32(F.col("doc_id").cast("string"))).collect()}
    trusted = {d for d, q, t in labels if q == 1}
    model = Brute([r[1] for r in rows if r[0] in trusted and crc[r[0]] % 2 == 0], kneser_ney.ORDER)
    level, size, compare = {}, {}, [r[0] for r in rows if r[0] in trusted and crc[r[0]] % 2]
    for r in rows:
        size[r[0]] = len(" ".join((r[1] or "").split()))
        level[r[0]] = -model.logp(r[1] or "")
    usual = sum(level[d] for d in compare) / sum(size[d] for d in compare)
    k = kneser_ney.PRIOR_CHARS
    bins = {d: math.ceil((level[d] + usual * k) / (size[d] + k) * kneser_ney.BINS) for d in level}
    ordered = sorted(bins[d] for d in compare)
    limit = next(b for i, b in enumerate(ordered) if sum(x <= b for x in ordered) >= len(ordered) * kneser_ney.QUANTILE) + kneser_ney.SLACK * kneser_ney.BINS
    rows = [r for r in rows if size[r[0]] and bins[r[0]] <= limit]
    # lines
    total, pages = {}, {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + 1
        for line in {x.strip() for x in r[1].split("\n")} - {""}:
            pages[r[3], line] = pages.get((r[3], line), 0) + 1
    over = {key for key, n in pages.items() if n > (total[key[0]] + 20) * 0.1}
    rows = [(r[0], "\n".join(x for x in r[1].split("\n") if (r[3], x.strip()) not in over), *r[2:]) for r in rows]
    rows = [r for r in rows if r[1].strip()]
    # copies
    kept = {d for d, _, c in classes([(r[0], r[1]) for r in rows], 5) if d == c}
    rows = [r for r in rows if r[0] in kept]
    # benchmark
    out, library = {}, sentencepiece.SentencePieceProcessor(model_file=PATH)
    for r in rows:
        n, hit, _ = hits(r[1], bench, 10)
        if 2 * len(hit) > n:
            continue
        text = r[1]
        if hit:
            import re

            at = [m.span() for m in re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", text)]
            runs, cut = [], set(hit)
            for i in sorted(cut):
                if i - 1 in cut:
                    runs[-1][1] = i
                else:
                    runs.append([i, i])
            for a, b in reversed(runs):
                if b - a < 4:  # a phrase of fewer than five words
                    continue
                text = text[:at[a][0]] + text[at[b][1]:]
        out[r[0]] = library.encode(text)
    return out


def test_run_as_by_brute_force(spark, tmp_path):
    rows, bench, labels = fixture(spark, tmp_path)
    want = brute(spark, rows, bench, labels)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id: r.ids for r in got} == want
    assert len(got) == len(want) and all(r.round_trip and r.n_tokens == len(r.ids) for r in got)
    # the cases do what they are there for
    assert not any(300 <= d < 310 for d in want) and not {400, 401, 402, 403, 404} & set(want) and set(range(120)) <= set(want)
    assert not any(200 <= d < 220 for d in want)


def test_odd_and_empty_tables(spark, tmp_path):
    labels = spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int")
    bench = spark.createDataFrame([("b", None), (None, "")], "item_id string, text string")
    for name, rows in (("odd", ODD), ("none", [])):
        folder = f"{tmp_path}/{name}"
        df = spark.createDataFrame(rows, DOCS).withColumn("hits", F.lit(1)).withColumn("N_lines", F.lit(2))
        df.write.parquet(f"{folder}/documents.parquet")
        labels.write.parquet(f"{folder}/labels.parquet")
        bench.write.parquet(f"{folder}/benchmark.parquet")
        docs = spark.read.parquet(f"{folder}/documents.parquet")
        for step, stage in corpus_pipeline.STAGES:
            docs = stage(spark, docs, folder)
            if step != "tokens":
                assert docs.columns == corpus_pipeline.COLUMNS
        assert docs.count() <= len(rows)
