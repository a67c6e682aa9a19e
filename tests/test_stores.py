"""Stored leads, histories, ingest, and streams whose keys remember something."""

import random
import re

import pytest
from pyspark.sql import functions as F

from placegrid.operators import dedupe as D
from placegrid.operators import leads as L
from placegrid.operators import state as S
from placegrid.sources import history as H
from placegrid.sources import ingest as N
from placegrid.sources import leadstore as LS
from placegrid.sources import readers as R
from placegrid.sources import writers as O
from placegrid.streaming import jobs as J
from placegrid.streaming import keyed as Y


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


@pytest.fixture(scope="module")
def lead_store(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("leads"))
    n = F.col("id")
    leads = spark.range(4000).select(
        F.concat(F.lit("p"), n.cast("string")).alias("id"),
        F.when(n % 7 == 0, None).when(n == 2500, "Zum (alten) Löwen").when(n == 2501, "a").otherwise(F.concat(F.lit("Shop "), (n * 7919 % 4000).cast("string"))).alias("name"),
        F.when(n % 2 == 0, "Bakery").otherwise("").alias("cat"),
        F.concat(F.lit("Road "), F.floor(n / 500).cast("string"), F.when(n == 11, "\nÇelik 😀 yol").otherwise("")).alias("addr"),
        (n % 3 == 0).cast("int").alias("side"), (n * 31 % 4000).alias("seq"))
    leads = leads.cache()
    LS.write_lead_store(leads, root, files=10, rows_per_file=150)
    yield root, leads
    leads.unpersist()


def test_a_page_reads_the_files_that_it_shows(spark, lead_store):
    root, leads = lead_store
    files = len(spark.read.parquet(f"{root}/leads").inputFiles())
    assert files >= 27
    whole = [r.id for r in leads.orderBy("side", "seq", "id").collect()]
    for number, limit in ((0, 40), (7, 200), (19, 200), (3999, 1), (49, 80)):
        page = LS.stored_page(spark, root, number, limit)
        got = page.collect()
        assert [r.id for r in got] == whole[number * limit : (number + 1) * limit]
        assert {r.total for r in got} == {4000} and len(page.inputFiles()) <= 2 + limit // 50
    assert LS.stored_page(spark, root, 20, 200).collect() == []
    assert len(LS.stored_page(spark, root, 0, 999, max_limit=100).collect()) == 100


@pytest.mark.parametrize("q", ["(alten) l", "Shop 123", "çelik 😀", "😀 y", "bakery", "o", "", "  ", "zz", "nowhere", "road 3", "n\nç", "shop", "1\nç", "löw.n"])
def test_a_search_by_pieces_is_the_search(spark, lead_store, q):
    root, leads = lead_store
    assert rows_of(LS.stored_search(spark, root, q).select(*leads.columns)) == rows_of(L.search_leads(leads, q))


def test_a_rare_text_reads_few_files(spark, lead_store):
    root, _ = lead_store
    assert len(LS.stored_search(spark, root, "alten").inputFiles()) == 1
    assert LS.stored_search(spark, root, "nowhere").count() == 0


def test_an_empty_lead_store(spark, lead_store, tmp_path):
    _, leads = lead_store
    LS.write_lead_store(leads.filter("id = ''"), str(tmp_path), files=4)
    assert LS.stored_page(spark, str(tmp_path)).collect() == [] and LS.stored_search(spark, str(tmp_path), "shop").collect() == []
    assert LS.stored_search(spark, str(tmp_path), "o").collect() == []


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def above_history(df):
    """The operators above the scan of the history, up to the first join."""
    lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
    depth = lambda line: re.search(r"[A-Za-z]", line).start()
    at = next(i for i, line in enumerate(lines) if "FileScan" in line and "Bucketed: true" in line)
    found, below = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < below:
            found, below = [*found, line], depth(line)
            if "Join" in line:
                return found
    raise AssertionError("no join")


def test_history_joins_shuffle_the_other_side_only(spark, no_broadcast, tmp_path):
    found = spark.range(3000).select(
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 0, " ").otherwise(F.concat(F.lit("p"), (F.col("id") % 700).cast("string"))).alias("place_id"), F.col("id").alias("seq"))
    known = spark.range(300).select(F.concat(F.lit(" p"), F.col("id").cast("string")).alias("place_id"))
    path = str(tmp_path / "ids")
    for ids in (known.filter("length(place_id) < 4"), known, known, spark.createDataFrame([(None,), ("",)], "place_id string")):
        H.add_history(ids, "ids_plan", path, 16)
    held = H.open_history(spark, "ids_plan", path, 16)
    assert rows_of(held) == sorted((f"p{i}",) for i in range(300))
    plain = D.distinct_ids(known)
    state = spark.range(500).select(
        F.concat(F.lit("p"), F.col("id").cast("string")).alias("place_id"), F.when(F.col("id") % 2 == 0, "failed").otherwise("other").alias("status"),
        (F.col("id") % 7).cast("string").alias("attempts"))
    for got, want in (
        (H.new_survivors(found, ["seq"], held), D.survivors(found, plain, plain.limit(0), ["seq"])),
        (H.new_rows(found, held), D.anti_known(found, plain)),
        (H.repair_from_history(state, held), S.repair_done(state, known)),
    ):
        assert rows_of(got.select(sorted(got.columns))) == rows_of(want.select(sorted(got.columns)))
        path_up = above_history(got)
        assert "SortMergeJoin" in path_up[-1] and not any("Exchange" in line for line in path_up), path_up


def test_a_second_run_takes_new_files_only(spark, tmp_path):
    files, root, check = (str(tmp_path / n) for n in ("files", "taken", "check"))
    columns = ["place_id", "status", "note"]
    text = "multi\nline, \"quoted\""
    for run in range(3):
        rows = spark.range(40).select(F.concat(F.lit("p"), F.col("id").cast("string")).alias("place_id"), F.lit(f"s{run}").alias("status"))
        if run:
            rows = rows.withColumn("note", F.lit(text))
        O.write_locked_csv(rows.repartition(3), rows.columns, files)
        J.drain(N.ingest_csv(spark, files, columns, root, check, files_per_batch=2))
        taken = spark.read.parquet(f"{root}/files")
        assert taken.count() == 3 * (run + 1) and sorted(r.file for r in taken.collect()) == list(range(1, 3 * run + 4))
    got = N.read_ingested(spark, root, columns)
    assert got.count() == 120 and got.select(R.SEQ).distinct().count() == 120
    assert {tuple(r) for r in got.groupBy("status", "note").count().collect()} == {("s0", "", 40), ("s1", text, 40), ("s2", text, 40)}
    last = got.groupBy("place_id").agg(F.max_by("status", R.SEQ).alias("s"))
    assert {(r.s, r["count"]) for r in last.groupBy("s").count().collect()} == {("s2", 40)}
    before = rows_of(got)
    J.drain(N.ingest_csv(spark, files, columns, root, check))  # nothing new
    assert rows_of(N.read_ingested(spark, root, columns)) == before
    assert N.read_ingested(spark, str(tmp_path / "none"), columns).count() == 0


def test_ingested_rows_keep_the_order_of_their_file(spark, tmp_path):
    files, root, check = (str(tmp_path / n) for n in ("files", "taken", "check"))
    for run in range(2):
        spark.range(500).select(F.lit(str(run)).alias("run"), F.col("id").cast("string").alias("n")).coalesce(1).write.mode("append").csv(files, header=True)
    J.drain(N.ingest_csv(spark, files, ["run", "n"], root, check))
    assert [(int(r.run), int(r.n)) for r in N.read_ingested(spark, root, ["run", "n"]).orderBy(R.SEQ).collect()] == [(a, b) for a in range(2) for b in range(500)]


def test_counts_follow_reversals_and_replays(spark, tmp_path):
    rng, folder, root, check, out, seen = random.Random(5), *(str(tmp_path / n) for n in ("in", "state", "check", "counts", "seen"))
    schema = "k long, at long, status string, attempts_inc long, last_error string"
    at = 0
    for _ in range(4):
        rows = []
        for _ in range(300):
            at += 1
            rows.append((0 if rng.random() < 0.3 else rng.randrange(60), at, rng.choice(["done", "failed", "queued", None, ""]), 1, None))
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        J.drain(J.stream_state(stream, root, check, ["k"], ["at"], every=None))
        J.drain(Y.stream_counts(Y.changed_rows(spark, root), ["k"], "status", out, seen))
        want = J.current_state(spark, root, ["k"]).groupBy(F.col("status").alias("value")).agg(F.count(F.lit(1)).alias("keys"))
        assert rows_of(Y.counts(spark, out).select("value", "keys")) == rows_of(want)
    # a batch of changes written again (as a replay does) and an older one that comes late change nothing
    changes = spark.read.parquet(f"{root}/changes")
    for n in (3, 1):
        again = spark.createDataFrame(
            changes.filter(F.col("batch") == n).drop("batch").collect(), changes.drop("batch").schema)
        again.write.mode("append").parquet(f"{root}/changes/batch={n}")
    J.drain(Y.stream_counts(Y.changed_rows(spark, root), ["k"], "status", out, seen))
    assert rows_of(Y.counts(spark, out).select("value", "keys")) == rows_of(want)
    assert Y.counts(spark, str(tmp_path / "nothing")).count() == 0


def test_counts_write_what_changed(spark, tmp_path):
    root, out, seen = (str(tmp_path / n) for n in ("state", "counts", "seen"))
    for n, (ids, status) in enumerate((("20000", "queued"), ("5", "done"))):
        spark.range(int(ids)).select(F.col("id").alias("k"), F.lit(status).alias("status")).write.parquet(f"{root}/changes/batch={n}")
        J.drain(Y.stream_counts(Y.changed_rows(spark, root), ["k"], "status", out, seen))
    assert rows_of(spark.read.parquet(out).filter("batch = 1").select("value", "delta")) == [("done", 5), ("queued", -5)]
    found = Y.counts(spark, out)
    assert tuple(Y.counted_places(found).first()) == (20000, 5, 0, 19995)
    assert rows_of(Y.counted_cells(found)) == [("done", 5), ("queued", 19995)]


def test_an_idle_key_is_released(spark, tmp_path):
    folder, out, check = (str(tmp_path / n) for n in ("parks", "out", "check"))
    batches = [
        [("idle", 0), ("idle", 20), ("busy", 5), (None, 6)],  # extended to 50
        [("busy", 30), ("late", 31), ("late", 33)],
        [("busy", 100), ("late", 92)],  # 70 seconds on; `late` was free since 63
        [("busy", 101), ("idle", 101)],  # parked again
        [("busy", 200)],
    ]
    schema = "alias string, ts timestamp"
    for rows in batches:
        spark.createDataFrame(rows, "alias string, s long").select("alias", F.timestamp_seconds("s").alias("ts")).coalesce(1).write.mode("append").parquet(folder)
    parks = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder)
    J.drain(O.stream_append(Y.stream_releases(parks), out, check, drain=True))
    got = [(r.alias, r.s) for r in spark.read.parquet(out).select("alias", F.unix_seconds("released_at").alias("s")).collect()]
    assert sorted(got, key=repr) == sorted(
        [("idle", 50), (None, 36), ("busy", 60), ("late", 63), ("late", 122), ("busy", 131), ("idle", 131)], key=repr)


def test_ledger_files_of_lines_and_of_whole_documents(spark, tmp_path):
    (tmp_path / "lines.json").write_text('{"2024-01-01": {"a": 2}}\n\n{"2024-01-01": {"a": 1, "b": 4}}\n')
    (tmp_path / "whole.json").write_text('{\n  "2024-01-01": {\n    "a": 10\n  },\n  "2024-01-02": {"c": 5}\n}\n')
    (tmp_path / "broken.json").write_text('{"2024-01-01": {"a": ')
    got = R.read_usage_ledger(spark, str(tmp_path))
    assert rows_of(got.select("day", "alias", "calls")) == [("2024-01-01", "a", 13), ("2024-01-01", "b", 4), ("2024-01-02", "c", 5)]
    lines = R.read_usage_ledger(spark, str(tmp_path / "lines.json"))
    assert "wholetext" not in lines._jdf.queryExecution().analyzed().toString().lower() and lines.count() == 2
