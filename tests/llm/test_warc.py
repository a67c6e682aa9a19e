import hashlib

import pytest
from pyspark.sql import functions as F

from placegrid.llm import warc

PAGES = [
    (5, "http://a/", "x" * 1000), (3, "http://b/", "x" * 1000), (9, None, "x" * 1000), (3, "http://b/", "x" * 1000),
    (4, "http://c/\r\nX: y", "small"), (6, "http://d/", "small"), (7, "http://e/", ""), (8, "http://f/", None),
    (None, "http://g/", "x" * 1000), (10, "http://h/", "é" * 5000 + "\r\n\r\n"), (11, "", "y" * 256), (12, "", "y" * 512),
    (0, "http://z/", "WARC/1.1\r\n\r\n" * 40),
]


def want(rows):
    raw = [(i, (h or "").encode()) for i, _, h in rows]
    first = {}
    for i, b in raw:
        if i is not None and len(b) >= 100:
            first[b] = min(i, first.get(b, i))
    out = []
    for i, b in raw:
        again = i is not None and len(b) >= 100 and first[b] < i
        out.append((i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", first[b] if again else None, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("chunk_bytes", [64, 256, 1 << 18])
def test_archives_read_back(spark, chunk_bytes):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    archive = warc.write_archive(pages, chunk_bytes=chunk_bytes)
    rows = warc.read_archive(archive).collect()
    got = [(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.whole) for r in rows]
    assert sorted(got, key=str) == want(PAGES)
    assert archive.agg(F.max(F.octet_length("data"))).first()[0] < chunk_bytes + 1000


def test_records_are_warc(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "http://a/", "<p>" * 100)], "page_id long, url string, html string"), chunk_bytes=100)
    data = b"".join(bytes(r.data) for r in archive.orderBy("archive", "copy", "chunk").collect())
    head, http, body = data.split(b"\r\n\r\n", 2)
    assert head.startswith(b"WARC/1.1\r\nWARC-Type: response\r\n") and body == b"<p>" * 100 + b"\r\n\r\n"
    assert int(head.rsplit(b" ", 1)[1]) == len(http) + 4 + 300


def test_a_changed_chunk_is_not_whole(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "a" * 400)], "page_id long, url string, html string"), chunk_bytes=100)
    broken = archive.withColumn("data", F.when(F.col("chunk") == 2, F.lit("b" * 100).cast("binary")).otherwise(F.col("data")))
    assert [r.whole for r in warc.read_archive(broken).collect()] == [False]


def test_a_missing_chunk_is_an_error(spark):
    archive = warc.write_archive(spark.createDataFrame([(1, "u", "a" * 400)], "page_id long, url string, html string"), chunk_bytes=100)
    with pytest.raises(Exception, match="no predecessor"):
        warc.read_archive(archive.where("chunk <> 1")).collect()


@pytest.mark.parametrize("lost", [3, 2])
def test_a_record_without_its_end_is_not_whole(spark, lost):
    pages = spark.createDataFrame([(1, "u", "a" * 400), (2, "v", "b" * 400)], "page_id long, url string, html string").coalesce(1)
    archive = warc.write_archive(pages, chunk_bytes=100)
    cut = archive.where((F.col("record_id") != 1) | (F.col("chunk") < lost))
    assert sorted((r.record_id, r.whole) for r in warc.read_archive(cut).collect()) == [(1, False), (2, True)]
    cut = archive.where((F.col("record_id") != 2) | (F.col("chunk") < lost))
    assert sorted((r.record_id, r.whole) for r in warc.read_archive(cut).collect()) == [(1, True), (2, False)]


def test_empty_table(spark):
    assert warc.read_archive(warc.write_archive(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


@pytest.mark.parametrize("block", [7, 300, 1 << 18])
def test_files_hold_the_same_records(spark, tmp_path, block):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string")
    archive = warc.write_archive(pages, chunk_bytes=200)
    folder = f"file://{tmp_path}/archives"
    files = warc.export_files(archive, folder).collect()
    assert sum(f.records for f in files) == len(PAGES)
    assert sorted(p.name for p in (tmp_path / "archives").iterdir()) == sorted(f.file.rsplit("/", 1)[1] for f in files)
    got = [(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, r.whole) for r in warc.read_files(spark, folder, block).collect()]
    assert sorted(got, key=str) == want(PAGES)


def test_a_cut_file_is_not_whole(tmp_path):
    data = b"".join(warc.head(1, "u", "response", None, 50, "0" * 64)) + b"x" * 20
    source = iter([data])
    assert [r[-1] for r in warc.stream_records(lambda n: next(source, b""))] == [False]
