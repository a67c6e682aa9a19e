"""What must not grow with the input: rows of a task, windows read again and again, calls of Python per key."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from placegrid.functions import values as V
from placegrid.operators import discovery as C
from placegrid.operators import monitor as M
from placegrid.operators import ordered as R
from placegrid.plans import file_queries, store_queries, stream_queries, views
from placegrid.plans.registry import QUERIES, Tables
from placegrid.streaming import jobs as J
from placegrid.streaming import keyed as Y


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_trailing_counts_without_sliding_frames(spark):
    rng, start = random.Random(3), datetime(2024, 1, 1)
    rows = [(rng.choice(["a", "b", None]), start + timedelta(seconds=rng.choice([rng.randrange(300), 7, 67])), i) for i in range(400)]
    events = spark.createDataFrame(rows, "run string, ts timestamp, id long")
    totals = events.groupBy("run").agg(F.count(F.lit(1)).alias("total"))
    got = M.completion_rate_1m(events, "run", "ts", "id", totals)
    assert "specifiedwindowframe(RangeFrame, -" not in plan_of(got)
    first = {k: min(ts for r, ts, _ in rows if r == k) for k in ("a", "b", None)}
    rates = {r.id: r.rate_1m for r in got.collect()}
    assert len(rates) == len(rows)
    for run, ts, i in rows:
        n = sum(1 for r, other, _ in rows if r == run and timedelta(0) <= ts - other <= timedelta(seconds=60))
        assert rates[i] == pytest.approx(n / min(60, max(1, (ts - first[run]).total_seconds())))


def test_trailing_count_of_rows_without_a_time(spark):
    rows = spark.createDataFrame([("a", None), ("a", None), ("a", 5), ("a", 15), ("a", 16)], "k string, at long")
    got = R.trailing_count(rows, ["k"], F.col("at"), 10, "n").collect()
    assert sorted((r.at or -1, r.n) for r in got) == [(-1, 4), (-1, 4), (5, 1), (15, 2), (16, 2)]


def test_page_ids_parse_a_body_once(spark):
    bodies = ['{"places":[{"id":"x","name":"n"},{"id":""},null,{"name":"z"},{"id":"y"}],"nextPageToken":"t"}', '{"places":[]}', "{}", "oops"]
    pages = spark.createDataFrame([("c", "q", 1, n, 200, b) for n, b in enumerate(bodies)] + [("c", "q", 1, 9, 500, bodies[0])],
                                  "cell_id string, query string, attempt int, page int, status int, body string")
    got = C.page_ids(pages)
    assert [(r.page, r.pos, r.place_id) for r in got.collect()] == [(0, 0, "x"), (0, 1, "y")]
    assert plan_of(got).count("from_json(") == 1
    assert [(r.page, r.results) for r in C.parse_pages(pages).orderBy("page").collect()] == [(0, 5), (1, 0), (2, 0), (3, 0), (9, 0)]


def test_novelty_moves_ids_once(spark, sf_dir):
    text = QUERIES["page_novelty"].run(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    moves = [line for line in text.splitlines() if "Exchange hashpartitioning(cell_id" in line]
    assert len(moves) == 1 and "page" not in moves[0] and text.count("from_json(") == 1
    # what is moved is one text per page
    assert "array_join(" in text[text.index("Exchange hashpartitioning(cell_id"):]


def test_novelty_of_gathered_pages(spark):
    rng, rows, want = random.Random(5), [], {}
    letters = ["a", "b", "ab", "", None, "\0", "\1", "\0\1", "\1\0", "\1\1", "\1\2", "a\0b", "\u00e9\U0001f600", "\u00ff"]
    for call in [*map(str, range(40)), None]:
        seen = set()
        for page in rng.sample([None, 0, 1, 2, 3, 4, 9], rng.randint(1, 7)):
            copies = [(rng.choice([200, 200, 200, 500]), [rng.choice(letters) for _ in range(rng.randint(0, 6))]) for _ in range(rng.choice([1, 1, 3]))]
            rows += [(call, "q", 1, page, status, json.dumps({"places": [{"id": i} for i in ids]})) for status, ids in copies]
            # the least answer of a repeated page: by status, results, then ids
            want[call, page] = min((s, len(i) * (s == 200), [x.encode() for x in i if x] * (s == 200)) for s, i in copies)[1:]
        for page in sorted((p for c, p in want if c == call), key=lambda p: -1 if p is None else p):
            n, ids = want[call, page]
            want[call, page] = (n, len(set(ids) - seen))
            seen |= set(ids)
    rng.shuffle(rows)
    responses = spark.createDataFrame(rows, "cell_id string, query string, attempt int, page int, status int, body string").repartition(5)
    for gather in (True, False):
        got = C.page_novelty(C.call_pages(responses, gather=gather))
        assert {(r.cell_id, r.page): (r.results, r.new_ids) for r in got.collect()} == want
    plain, gathered = (sorted(map(repr, C.call_pages(responses, gather=g).collect())) for g in (False, True))
    assert plain == gathered


def test_packed_texts_compare_as_their_array(spark):
    rng = random.Random(6)
    lists = [[]] + [["".join(rng.choice("\0\1\2ab") for _ in range(rng.randint(1, 3))) for _ in range(rng.randint(0, 4))] for _ in range(300)]
    rows = spark.createDataFrame([(x,) for x in lists], "x array<string>").withColumn("p", V.pack("x"))
    assert rows.filter(V.unpack("p") != F.col("x")).count() == 0 and rows.filter("p IS NULL").count() == 0
    assert [r.x for r in rows.orderBy("x").collect()] == [r.x for r in rows.orderBy("p").collect()]


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(views, "SPREAD_ROWS", 50)
    monkeypatch.setattr(stream_queries, "FILE_ROWS", 100)
    monkeypatch.setattr(stream_queries, "TEXT_FILE_ROWS", 20)
    monkeypatch.setattr(store_queries, "FILE_ROWS", 20)


def test_views_of_large_tables_are_spread(spark, tmp_path, small_parts):
    spark.range(300).select(F.col("id").alias("p_partkey")).write.parquet(str(tmp_path / "part.parquet"))
    gallery = Tables(spark, str(tmp_path)).gallery
    assert gallery.rdd.getNumPartitions() == 6
    assert gallery.count() == sum(i % 31 + 1 for i in range(300))


def test_a_large_table_makes_more_files_not_more_batches(spark, tmp_path, small_parts):
    t = Tables(spark, str(tmp_path))
    seen = []
    stream = stream_queries._stream_of_files(t, spark.range(1500).withColumn("x", F.lit(1)))
    J.drain(J.each_batch(stream, str(tmp_path / "check"), lambda batch, n: seen.append((batch.count(), batch.select(F.input_file_name()).distinct().count()))))
    assert [files for _, files in seen] == [5, 5, 5] and sum(n for n, _ in seen) == 1500


def test_logs_and_parks_of_large_tables(spark, tmp_path, small_parts):
    spark.range(2400).select(F.col("id").alias("doc_id"), F.concat(F.lit("t"), "id").alias("text"), F.lit("s").alias("source")).write.parquet(
        str(tmp_path / "documents.parquet"))
    got = QUERIES["stream_log_events"].run(spark, str(tmp_path))
    assert {r.interval: r["count"] for r in got.groupBy("interval").count().collect()} == {0: 500, 30: 500}
    assert got.filter("doc_id % 1200 >= 700").count() == 1000
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 20)
    spark.range(300).select(F.col("id").alias("event_id"), at.alias("ts"), (F.col("id") % 10).alias("user_id"), F.lit("error").alias("event_type")).write.parquet(
        str(tmp_path / "events.parquet"))
    ends = QUERIES["stream_releases"].run(spark, str(tmp_path))
    # every key comes once in 200 seconds, so every park is one of its own
    last = 1_700_000_000 + 299 * 20
    assert ends.count() == sum(1 for i in range(300) if 1_700_000_000 + i * 20 + 30 <= last - 10)


def test_rows_of_one_language_are_not_one_task(spark, tmp_path):
    rows = spark.range(0, 400, 1, 4).select(F.lit("en").alias("lang"), F.concat(F.lit("a\n"), F.col("id").cast("string")).alias("text"))
    rows.write.parquet(str(tmp_path / "documents.parquet"))
    written = []
    real = file_queries.R.csv_row_counts
    with pytest.MonkeyPatch.context() as m:
        m.setattr(file_queries.R, "csv_row_counts", lambda s, p: written.append(len(s.read.text(p).inputFiles())) or real(s, p))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
        try:
            got = QUERIES["file_row_counts"].run(spark, str(tmp_path)).collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [(r.lang, r.rows) for r in got] == [("en", 800)] and written[0] > 1


def test_files_of_grid_documents_follow_their_size_not_the_boundaries(spark, tmp_path, monkeypatch):
    spark.range(40).select(F.col("id").alias("s_suppkey")).write.parquet(str(tmp_path / "supplier.parquet"))
    want = sorted(map(tuple, QUERIES["grid_file"].run(spark, str(tmp_path)).collect()))
    written, real = [], file_queries.R.read_grid
    monkeypatch.setattr(file_queries.R, "read_grid", lambda s, p: written.append(s.read.text(p, wholetext=True).collect()) or real(s, p))
    monkeypatch.setattr(file_queries, "DOCUMENT_FILE_BYTES", 30_000, raising=False)
    assert sorted(map(tuple, QUERIES["grid_document"].run(spark, str(tmp_path)).collect())) == want
    assert 3 < len(written[0]) < 20
    # still a collection per boundary
    collections = [c for f in written[0] for c in json.loads(f.value)]
    held = [{x["properties"]["cell_id"].rsplit("_", 1)[0] for x in c["features"]} for c in collections]
    assert all(c["type"] == "FeatureCollection" for c in collections) and sorted(held, key=min) == [{f"B{n}"} for n in sorted(map(str, range(40)))]


def test_counts_call_python_per_group_not_per_key(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(Y, "GROUPS", 3)
    root, out, seen = (str(tmp_path / n) for n in ("state", "counts", "seen"))
    for n, (a, b, status) in enumerate(((0, 500, "queued"), (100, 200, "done"), (150, 160, None))):
        rows = spark.range(a, b).select(F.when(F.col("id") != 7, F.col("id")).alias("k"), F.lit(status).cast("string").alias("status"))
        rows.write.parquet(f"{root}/changes/batch={n}")
        changes = Y.changed_rows(spark, root)
        query = Y.stream_counts(changes, ["k"], "status", out, seen)
        J.drain(query)
        assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 3
    assert {r.value: r.keys for r in Y.counts(spark, out).select("value", F.col("keys")).collect()} == {"queued": 400, "done": 90, None: 10}
