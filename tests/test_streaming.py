"""Streams over many files against the table forms."""

import random

import pytest
from pyspark.sql import functions as F

from placegrid.operators import keys as K
from placegrid.operators import state as S
from placegrid.sources import writers as O
from placegrid.streaming import jobs as J


@pytest.fixture
def calls(spark, tmp_path):
    """Six files of calls in time order."""
    rng, folder = random.Random(3), str(tmp_path / "calls")
    rows = []
    for i in range(1200):
        status, auth = rng.choice([(429, False)] * 4 + [(200, False), (403, True)])
        rows.append((f"k{0 if rng.random() < 0.4 else rng.randrange(5)}", i, status, auth))
    schema = "alias string, at long, status int, auth_failed boolean"
    df = spark.createDataFrame(rows, schema)
    for part in range(6):
        df.filter(f"at div 200 = {part}").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder)
    return df, stream


def with_ts(df):
    return df.withColumn("ts", F.timestamp_seconds("at"))


def test_throttle_carries_over_batches(spark, calls, tmp_path):
    df, stream = calls
    out, root, check = (str(tmp_path / n) for n in ("out", "state", "check"))
    chunk = lambda: F.floor(F.col("at") / 17)
    J.drain(J.stream_throttle(with_ts(stream), out, root, check, ["at"], chunk, every=None))
    got = spark.read.parquet(out)
    assert got.select("batch").distinct().count() == 6
    want = K.throttle_streaks(df, ["at"], F.floor(F.col("at") / 50))
    columns = ["alias", "at", "streak", "parked", "rate_limit_hits"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    parked = got.filter("parked").select(F.col("parked_until").cast("long") - F.col("ts").cast("long")).distinct().collect()
    assert [r[0] for r in parked] == [30]


def test_state_adds_up_over_batches_and_ignores_a_replay(spark, calls, tmp_path):
    df, stream = calls
    def updates(rows):
        return rows.select(
            "alias", F.col("status").cast("string").alias("status"), F.lit(1).cast("long").alias("attempts_inc"),
            F.when(F.col("status") == 429, F.col("at").cast("string")).alias("last_error"), "at",
        )
    root, check = str(tmp_path / "state"), str(tmp_path / "check")
    J.drain(J.stream_state(updates(stream), root, check, ["alias"], ["at"], every=None))
    want = S.latest_state(updates(df).withColumn("updated_at", F.lit("")), ["alias"], ["at"])
    columns = ["alias", "status", "attempts", "last_error"]
    state = J.current_state(spark, root, ["alias"]).fillna("", ["last_error"])
    assert sorted(map(tuple, state.select(columns).collect())) == sorted(map(tuple, want.select(columns).collect()))
    # a started query finds nothing new, and adds nothing again
    J.drain(J.stream_state(updates(stream), root, check, ["alias"], ["at"], every=None))
    assert sorted(map(tuple, J.current_state(spark, root, ["alias"]).fillna("", ["last_error"]).select(columns).collect())) == sorted(
        map(tuple, want.select(columns).collect()))
    # a fresh checkpoint would count its batches from zero: it stops instead of losing rows
    with pytest.raises(Exception, match="use a new root"):
        J.drain(J.stream_state(updates(stream), root, str(tmp_path / "again"), ["alias"], ["at"], every=None))
    assert sorted(map(tuple, J.current_state(spark, root, ["alias"]).fillna("", ["last_error"]).select(columns).collect())) == sorted(
        map(tuple, state.select(columns).collect()))


def test_a_batch_writes_the_keys_that_it_changed(spark, tmp_path):
    folder, root, check = (str(tmp_path / n) for n in ("in", "state", "check"))
    schema = "k long, at long, status string, attempts_inc long, last_error string"
    first = spark.range(20_000).selectExpr("id AS k", "id AS at", "'queued' AS status", "1L AS attempts_inc", "cast(null as string) AS last_error")
    later = spark.range(7).selectExpr("id AS k", "100000 + id AS at", "'done' AS status", "1L AS attempts_inc", "'e' AS last_error")
    for rows in (first, later):
        rows.coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        J.drain(J.stream_state(stream, root, check, ["k"], ["at"], every=None))
    changes = spark.read.parquet(f"{root}/changes")
    assert {r.batch: r["count"] for r in changes.groupBy("batch").count().collect()} == {0: 20_000, 1: 7}
    size = {p: sum(f.stat().st_size for f in (tmp_path / "state" / "changes" / p).glob("*.parquet")) for p in ("batch=0", "batch=1")}
    assert size["batch=1"] * 4 < size["batch=0"]
    want = {("done", 2): 7, ("queued", 1): 19_993}
    for _ in range(2):  # from the changes, then from the compacted table
        state = J.current_state(spark, root, ["k"])
        assert {(r.status, r.attempts): r["count"] for r in state.groupBy("status", "attempts").count().collect()} == want
        J.compact_state(spark, root, ["k"])


def test_log_tail_does_not_depend_on_batches(spark, tmp_path):
    from placegrid.operators.monitor import bounded_tail

    rows = spark.range(4000).select(
        F.col("id"), F.timestamp_seconds(F.col("id") / 50).cast("string").alias("ts"), F.lit("INFO").alias("level"), F.lit("n").alias("name"),
        F.repeat(F.lit("m"), (F.col("id") % 900).cast("int")).alias("msg"), *[F.lit("").alias(c) for c in ("phase", "cell_id", "place_id")])
    whole = rows.withColumn("interval", F.floor(F.col("id") / 1500) * 30)
    want = sorted(map(tuple, bounded_tail(whole, ["id"], within=["interval"]).select("id", "tail_bytes").collect()))
    for n, files in enumerate((1, 7)):
        source, out = str(tmp_path / f"s{n}"), str(tmp_path / f"o{n}")
        rows.repartition(files, F.col("id") % 11).write.parquet(source)
        stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(source)
        J.drain(J.stream_log_events(stream, out, str(tmp_path / f"c{n}"), ["id"], every=None))
        assert sorted(map(tuple, spark.read.parquet(out).select("id", "tail_bytes").collect())) == want


def test_dedupe_over_batches(spark, calls, tmp_path):
    _, stream = calls
    known = spark.createDataFrame([("k1",)], "place_id string")
    ids = stream.select(F.col("alias").alias("place_id"))
    out = str(tmp_path / "out")
    J.drain(O.stream_append(J.stream_dedupe(ids, known, event_time=None), out, str(tmp_path / "check"), drain=True))
    assert sorted(r.place_id for r in spark.read.parquet(out).collect()) == ["k0", "k2", "k3", "k4"]
    bounded = J.stream_dedupe(with_ts(stream).withColumnRenamed("alias", "place_id"), known, "ts", "1 hour")
    out = str(tmp_path / "out2")
    J.drain(O.stream_append(bounded.select("place_id"), out, str(tmp_path / "check2"), drain=True))
    assert sorted(r.place_id for r in spark.read.parquet(out).collect()) == ["k0", "k2", "k3", "k4"]


def test_heartbeats_skip_broken_lines(spark, tmp_path):
    folder = tmp_path / "beats"
    folder.mkdir()
    (folder / "a.jsonl").write_text('{"run_id":"r","discovered":1}\n{broken\n{"run_id":"r","discovered":2}\n')
    out = str(tmp_path / "out")
    J.drain(O.stream_append(J.stream_heartbeats(spark, str(folder)), out, str(tmp_path / "check"), drain=True))
    assert sorted(r.discovered for r in spark.read.parquet(out).collect()) == [1, 2]


def test_results_flush_per_batch(spark, calls, tmp_path):
    _, stream = calls
    state = lambda s: s.createDataFrame([("k0", "3"), ("k1", "1")], "place_id string, attempts string")
    results = stream.select(
        F.col("alias").alias("place_id"), (F.col("at") % 4).alias("attempts"),
        F.when(F.col("status") == 200, "done").otherwise("failed").alias("outcome"),
    )
    out, totals = str(tmp_path / "out"), str(tmp_path / "totals")
    J.drain(J.stream_results(results, state, out, totals, str(tmp_path / "check"), every=None))
    sums = spark.read.parquet(totals).agg(F.sum("accepted").alias("a"), F.sum("stale").alias("s")).first()
    rows = spark.read.parquet(out)
    assert sums.a + sums.s == rows.count() == 1200
    assert sums.a == rows.filter("(place_id = 'k0' and attempts = 3) or (place_id = 'k1' and attempts = 1)").count()


def test_a_reader_keeps_its_version(spark, tmp_path):
    root = str(tmp_path / "t")
    assert O.snapshot_version(spark, root) == 0
    assert O.write_snapshot(spark.range(3), root) == 1
    reader = O.read_snapshot(spark, root)
    for n in range(2, 7):
        # the next version is made from the one before
        assert O.update_snapshot(spark, root, lambda old: old.union(spark.range(1))) == n
        assert O.read_snapshot(spark, root).count() == n + 2
    assert reader.count() == 3 and O.read_snapshot(spark, root, 2).count() == 4


def test_of_two_writers_one_retries(spark, tmp_path):
    root, calls = str(tmp_path / "t"), []
    O.write_snapshot(spark.range(3), root)

    def change(old):
        # another writer comes first while this one is at work
        if not calls:
            calls.append(O.write_snapshot(old.union(spark.range(10)), root, 1))
        return old.union(spark.range(1))

    assert O.update_snapshot(spark, root, change) == 3 and calls == [2]
    assert O.read_snapshot(spark, root).count() == 14
    with pytest.raises(O.VersionConflict):
        O.write_snapshot(spark.range(1), root, 2)
    assert O.read_snapshot(spark, root).count() == 14


def test_a_version_offered_twice_is_withdrawn_by_who_sees_it(spark, tmp_path, monkeypatch):
    root, said = str(tmp_path / "t"), []
    O.write_snapshot(spark.range(3), root)
    say = O._say

    def together(spark, root, version, data, kind):
        # another offer of the same version lands just before this one
        if kind == "offer" and not said:
            spark.range(9).write.parquet(f"{root}/data-other")
            said.append(say(spark, root, version, "data-other", "offer"))
        say(spark, root, version, data, kind)

    monkeypatch.setattr(O, "_say", together)
    with pytest.raises(O.VersionConflict):
        O.write_snapshot(spark.range(1), root)
    assert O.snapshot_version(spark, root) == 2 and O.read_snapshot(spark, root).count() == 9
    say(spark, root, 3, "a", "offer")
    say(spark, root, 3, "b", "offer")  # not settled: not read
    assert O.read_snapshot(spark, root).count() == 9
    assert O.write_snapshot(spark.range(5), root) == 4 and O.read_snapshot(spark, root).count() == 5


def test_old_versions_are_emptied_by_age(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(1, 4):
        O.write_snapshot(spark.range(1000 * n), root, keep=0.0)
    counts = [O.read_snapshot(spark, root, n).count() for n in (1, 2, 3)]
    assert counts == [0, 0, 3000]
