"""Plans that must hold when one key has a third of the rows."""

import re

import pytest
from pyspark.sql import functions as F

from placegrid.operators import batches as B
from placegrid.operators import dedupe as D
from placegrid.operators import leads as L
from placegrid.operators import state as S
from placegrid.plans import QUERIES
from placegrid.plans.registry import Tables
from placegrid.plans.views import LINE_ORDER


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def limited_before_shuffle(text: str) -> bool:
    """A partial group limit stands below (after, in plan text) the exchange that feeds the window."""
    return re.search(r"Exchange hashpartitioning.*WindowGroupLimit .*Partial", text, re.S) is not None


def test_first_seen_is_limited_per_map_task(spark, sf_dir):
    t = Tables(spark, sf_dir)
    assert limited_before_shuffle(plan(D.first_seen(t.discovered, ["place_id"], LINE_ORDER)))
    assert limited_before_shuffle(plan(S.claim_batch(t.state_places, "shard", 20, ["seq"])))
    assert limited_before_shuffle(plan(B.newest_job(t.jobs)))


def test_counts_are_partial(spark, sf_dir):
    t = Tables(spark, sf_dir)
    for df in (S.collapse_cells(t.state_cells, ["seq"]), S.latest_state(t.updates, ["place_id"], LINE_ORDER)):
        assert "partial_max_by" in plan(df)


def test_scans_read_only_what_they_use(spark, sf_dir):
    text = plan(QUERIES["cell_place_counts"].run(spark, sf_dir))
    assert "l_tax" not in text and "l_discount" not in text
    text = plan(QUERIES["image_work"].run(spark, sf_dir))
    assert "l_tax" not in text and "l_commitdate" not in text


def test_a_page_by_chunks_is_the_page_by_top_n(spark, sf_dir):
    t = Tables(spark, sf_dir)
    chunk = F.floor(F.col("o1") / 64)
    early = L.page(t.discovered, LINE_ORDER, 5, 1000)
    assert "TakeOrderedAndProject" in plan(early)
    deep = L.page(t.discovered, LINE_ORDER, 5, 1000, chunk=chunk)
    assert "TakeOrderedAndProject" not in plan(deep)
    assert sorted(map(tuple, early.collect())) == sorted(map(tuple, deep.collect()))


def test_deep_lead_pages_match_the_whole_order(spark, sf_dir):
    t = Tables(spark, sf_dir)
    leads = L.build_leads(t.listings, t.discovered, LINE_ORDER, LINE_ORDER).select("id", "side", "seq")
    whole = [tuple(r) for r in leads.orderBy("side", "seq", "id").collect()]
    for number in (0, 2, 4, 9):
        rows = L.lead_page(leads, number, 40).orderBy("side", "seq", "id").collect()
        assert [tuple(r)[:3] for r in rows] == whole[number * 40 : number * 40 + 40]
        assert all(r.total == len(whole) for r in rows)


def test_copies_of_one_id_keep_the_first(spark):
    rows = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string")).alias("place_id"), F.col("id").alias("seq")
    )
    got = {r.place_id: r.seq for r in D.first_seen(rows, ["place_id"], ["seq"]).collect()}
    assert got["hot"] == 0 and len(got) == 20_001


def test_rows_without_a_key_or_position_stay(spark):
    from placegrid.operators import discovery as C
    from placegrid.operators import keys as K

    cells = spark.createDataFrame([(None, 2), (1, 2), (5, 9), (9, 1)], "pos long, place_count long")
    assert sorted((r.pos or 0) for r in C.cap_places(cells, 5, "pos").collect()) == [0, 1, 5]
    calls = spark.createDataFrame([(None, 1, 429, False), (None, 2, 429, False), ("a", 3, 429, False)], "alias string, at long, status int, auth_failed boolean")
    got = {(r.alias, r["at"]): (r.streak, r.parked) for r in K.throttle_streaks(calls, ["at"]).collect()}
    assert got == {(None, 1): (1, False), (None, 2): (2, True), ("a", 3): (1, False)}


@pytest.mark.parametrize("position", [
    "timestamp_micros(1700000000000000 + id * 1000)", "if(id = 7, 1000000000000000, id)", "(id % 10) * (1L << 44) + id", "cast(id as double) * id * id",
    "if(id % 3 = 0, null, id)"], ids=["timestamps", "outlier", "files", "steep", "nulls"])
def test_chunks_hold_their_share(spark, position):
    from placegrid.operators import ordered as R

    rows = spark.range(100_000).select(F.expr(position).alias("at"))
    chunks = rows.withColumn("c", R.even_chunks(rows, "at", parts=500)).cache()
    sizes = chunks.filter("at IS NOT NULL").groupBy("c").count().agg(F.max("count"), F.count("c")).first()
    assert sizes[0] <= 2 * 100_000 / 500 and sizes[1] >= 300
    # chunks follow the order, and only nulls have none
    ends = chunks.groupBy("c").agg(F.min("at").alias("low"), F.max("at").alias("high")).orderBy("c").collect()
    known = [r for r in ends if r.c is not None]
    assert all(a.high < b.low for a, b in zip(known, known[1:])) and chunks.filter("(c IS NULL) <> (at IS NULL)").count() == 0
    chunks.unpersist()


def test_chunks_of_no_rows(spark):
    from placegrid.operators import ordered as R

    none = spark.createDataFrame([(None,)], "at long")
    assert [r.c for r in none.select(R.even_chunks(none, "at").alias("c")).collect()] == [None]


def test_a_hot_image_is_dealt_over_salts(spark):
    requests = spark.range(300).select(
        F.col("id").cast("string").alias("key"), F.array(F.lit("hot"), F.concat(F.lit("u"), F.col("id").cast("string"))).alias("images"),
        F.array().cast("array<string>").alias("optional_images"))
    media = spark.createDataFrame([("hot", bytearray(b"h"), None), ("u1", bytearray(b"1"), None)], "url string, content binary, error string")
    plain = sorted(map(str, B.attach_images(requests, media).collect()))
    assert sorted(map(str, B.attach_images(requests, media, salts=8, hot=10).collect())) == plain


def test_a_table_of_one_huge_run_needs_a_shared_folder(spark, monkeypatch):
    from placegrid import session

    class Conf:
        def get(self, key, default=None):
            return {"spark.master": "spark://host:7077"}.get(key, default)

    class Fake:
        conf = Conf()

    with pytest.raises(ValueError):
        session.shared_dir(Fake())
