"""Stored file shapes that need care."""

import gzip

from pyspark.sql import functions as F

from placegrid.sources import readers as R
from placegrid.sources import writers as O


def test_bom_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "state.csv"
    path.write_text('﻿place_id,status,attempts,last_error,updated_at\r\nA,done,1,"said ""no"",\ntwice",\r\nB,queued,,,\r\n', encoding="utf-8")
    rows = {r.place_id: r for r in R.read_state(spark, str(path), "places").collect()}
    assert rows["A"].last_error == 'said "no",\ntwice' and rows["B"].attempts == ""


def test_appended_gzip_members(spark, tmp_path):
    path = tmp_path / "full.csv.gz"
    for text in ("place_id,name\n", "A,x\n", "B,y\n"):
        with gzip.open(path, "at", encoding="utf-8") as f:
            f.write(text)
    rows = R.read_listings(spark, str(path), str(tmp_path / "none.csv"))
    assert sorted((r.place_id, r.name) for r in rows.collect()) == [("A", "x"), ("B", "y")]


def test_missing_files_and_columns_are_empty(spark, tmp_path):
    assert R.read_known_ids(spark, str(tmp_path / "none.csv")).count() == 0
    other = tmp_path / "other.csv"
    other.write_text("id\nA\n")
    assert R.read_known_ids(spark, str(other)).count() == 0
    assert R.read_state(spark, str(tmp_path / "none.csv"), "cells").columns[:2] == ["cell_id", "query"]


def test_run_configs_per_folder(spark, tmp_path):
    for run, text in (("run1", '{"run_id":"run1","queries":["a","b"]}'), ("run2", "{broken")):
        (tmp_path / run).mkdir()
        (tmp_path / run / "run_config.json").write_text(text)
    rows = {r.run_id: r.queries for r in R.read_run_configs(spark, str(tmp_path / "*" / "run_config.json")).collect()}
    assert rows == {"run1": ["a", "b"], "run2": None}


def test_boundary_and_grid_documents(spark, tmp_path):
    (tmp_path / "city.json").write_text("[[1,2],[3,4],[5,6]]")
    row = R.read_boundary(spark, str(tmp_path / "city.json")).first()
    assert row.boundary_id == "city" and len(row.rings[0]) == 3
    ring = [[[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 0.0]]]
    feature = {"type": "Feature", "geometry": {"type": "Polygon", "coordinates": ring}, "properties": {"cell_id": "A_0000"}}
    import json
    (tmp_path / "grid.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": [feature, {**feature, "properties": {}}]}))
    rows = R.read_grid(spark, str(tmp_path / "grid.geojson")).collect()
    assert [r.cell_id for r in rows] == ["A_0000"] and rows[0].geometry.coordinates == ring


def test_snapshot_keeps_the_old_version_until_the_pointer_moves(spark, tmp_path):
    root = str(tmp_path / "table")
    O.write_snapshot(spark.range(3), root)
    spark.range(9).write.parquet(f"{root}/v-unfinished")
    assert R.SEQ not in O.read_snapshot(spark, root).columns and O.read_snapshot(spark, root).count() == 3
    O.write_snapshot(spark.range(5), root)
    assert O.read_snapshot(spark, root).count() == 5


def test_locked_csv_appends_and_drops_extras(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("A", None, 1)], "place_id string, name string, extra int")
    O.write_locked_csv(rows, ["place_id", "name", "phone"], path)
    O.write_locked_csv(rows, ["place_id", "name", "phone"], path)
    back = R.read_csv(spark, path).drop(R.SEQ)
    assert back.columns == ["place_id", "name", "phone"] and [tuple(r) for r in back.collect()] == [("A", "", "")] * 2


def test_media_bytes(spark, tmp_path):
    (tmp_path / "a.jpg").write_bytes(b"\x01\x02")
    row = R.read_media(spark, str(tmp_path), "*.jpg").first()
    assert (row["name"], bytes(row["content"])) == ("a.jpg", b"\x01\x02")


def test_skeleton_skips_blank_lines(spark, tmp_path):
    path = tmp_path / "s.jsonl"
    path.write_text('{"key":"k","prompt":"p","images":["u"],"generation_config":{"t":1}}\n\n')
    rows = R.read_skeleton(spark, str(path)).collect()
    assert [(r.key, r.images, r.generation_config) for r in rows] == [("k", ["u"], '{"t":1}')]


def test_log_line_sequence(spark, tmp_path):
    (tmp_path / "run.log").write_text("a\nb\n")
    rows = R.read_lines(spark, str(tmp_path / "run.log")).orderBy(F.col(R.SEQ)).collect()
    assert [r.value for r in rows] == ["a", "b"]


def test_rows_follow_the_order_in_which_files_were_written(spark, tmp_path):
    import os

    from placegrid.operators.keys import key_inventory

    folder = tmp_path / "keys"
    folder.mkdir()
    for n, (name, ids) in enumerate((("z-old", range(400)), ("a-new", range(400, 403)), ("m-newest", range(403, 405)))):
        path = folder / f"{name}.csv"
        path.write_text("key\n" + "".join(f"secret{i}\n" for i in ids))
        os.utime(path, (1_700_000_000 + n, 1_700_000_000 + n))
    rows = R.read_csv(spark, str(folder))
    ordered = [r.key for r in rows.orderBy(R.SEQ).collect()]
    assert ordered == [f"secret{i}" for i in range(405)]
    assert sorted(r.alias for r in key_inventory(rows, R.SEQ).collect()) == sorted(f"csv#{i + 1}" for i in range(405))


def test_ledger_documents_in_both_shapes(spark, tmp_path):
    (tmp_path / "a.json").write_text('{\n  "2024-01-01": {\n    "k1": 2,\n    "k2": 3\n  }\n}')
    (tmp_path / "b.json").write_text('{"2024-01-01":{"k1":1}}\n{"2024-01-02":{"k1":5}}\n')
    got = sorted(map(tuple, R.read_usage_ledger(spark, str(tmp_path)).collect()))
    assert got == [("2024-01-01", "k1", 3), ("2024-01-01", "k2", 3), ("2024-01-02", "k1", 5)]
