"""WARC archives as a table of chunked records.

An archive is a table of rows (archive, record_id, chunk, chunks, data, digest): the `data` of its rows, by record and
chunk number, are the bytes of WARC/1.1 records. A payload is never copied whole: it is cut into chunks of at most
`chunk_bytes`, each row carries the SHA-256 of the payload up to its own end, and a reader goes on with its running
digest from row to row and marks a record whose rows disagree. A record that fits one chunk is one row. `export_files`
writes the archives out as .warc files, `read_files` streams such files.

Equal payloads of at least `min_revisit` bytes are stored once: the record with the smallest id holds the payload
(`response`), the others are `revisit` records that name it and carry the HTTP header only.

Defined results: null html is an empty payload; null urls give an empty target; rows without an id are responses of
their own, never referred to, and come back with a null id; repeated rows of one id are repeated records, the same
kind each; other columns of the input are not archived. Record ids must be 64-bit integers.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from placegrid.llm.common import bounded_batches, stored

CHUNK_BYTES = 256 * 1024
FLUSH_BYTES = 4 * 1024 * 1024
MIN_REVISIT = 100
URN = "urn:record:"  # ids of records as URIs
EMPTY = hashlib.sha256(b"").hexdigest()

CHUNK_SCHEMA = T.StructType([
    T.StructField("archive", T.IntegerType()), T.StructField("record_id", T.LongType()),
    T.StructField("copy", T.IntegerType()), T.StructField("chunk", T.IntegerType()),
    T.StructField("last", T.BooleanType()), T.StructField("data", T.BinaryType()),
    T.StructField("digest", T.StringType()),
])
RECORD_SCHEMA = T.StructType([
    T.StructField("record_id", T.LongType()), T.StructField("url", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("refers_to", T.LongType()),
    T.StructField("payload_bytes", T.LongType()), T.StructField("payload_digest", T.StringType()),
    T.StructField("whole", T.BooleanType()),
])


def plan_records(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id -> refers_to, one row for each id that becomes a revisit. Narrow: digests, not payloads, are shuffled."""
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    seen = pages.where("page_id IS NOT NULL").select(
        "page_id", F.octet_length(raw).alias("n"), F.unhex(F.sha2(raw, 256)).alias("d")).where(F.col("n") >= min_revisit)
    first = seen.groupBy("d").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("_top"))
    first = first.where("_top > refers_to").drop("_top")
    again = seen.join(first, "d").where(F.col("page_id") > F.col("refers_to"))
    # an id whose rows differ in payload is told apart by its digest
    return again.select("page_id", "d", "refers_to").distinct()


def head(record_id, url: str, kind: str, refers_to, size: int, digest: str) -> tuple[bytes, bytes]:
    """The WARC header block, and the HTTP header that opens the record's content."""
    http = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
            f"Content-Length: {size}\r\n\r\n").encode()
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{'' if record_id is None else record_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
                  f"WARC-Refers-To: <{URN}{refers_to}>"]
    body = len(http) + (size if kind == "response" else 0)
    lines.append(f"Content-Length: {body}")
    return ("\r\n".join(lines) + "\r\n\r\n").encode(), http


def _one_line(url: str) -> str:
    return re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)


def record_chunks(record_id, url: str, refers_to, payload: memoryview, chunk_bytes: int) -> Iterator[tuple[bytes, str, bool]]:
    """(data, digest of the payload so far, whether it is the last) of one record; slices, no copy of the whole."""
    digest = hashlib.sha256()
    ends = range(chunk_bytes, len(payload) + chunk_bytes, chunk_bytes) or [0]
    whole = hashlib.sha256(payload).hexdigest()  # the header names it before the payload is written
    kind = "response" if refers_to is None else "revisit"
    opening = b"".join(head(record_id, url, kind, refers_to, len(payload), whole))
    if kind == "revisit":
        yield opening + b"\r\n\r\n", EMPTY, True
        return
    for end in ends:
        part = payload[end - chunk_bytes:end] if end else payload
        digest.update(part)
        last = end >= len(payload)
        yield b"".join([opening, part, b"\r\n\r\n" if last else b""]), digest.hexdigest(), last
        opening = b""


def write_archive(pages: DataFrame, name: str = "warc", min_revisit: int = MIN_REVISIT,
                  chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """Writes a record for every row of pages(page_id, url, html) to the shared folder; the chunk table, read again."""
    bounded_batches(pages.sparkSession)
    pages = pages.select("page_id", "url", "html")
    plan = plan_records(pages, min_revisit).withColumnRenamed("page_id", "_id")
    raw = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", raw.alias("payload"))
    told = rows.join(plan, (rows.page_id == plan._id) & (F.unhex(F.sha2(rows.payload, 256)) == plan.d), "left")
    told = told.select("page_id", "url", "payload", "refers_to")
    arrow = to_arrow_schema(CHUNK_SCHEMA)

    def run(batches):
        from pyspark import TaskContext

        archive, copy = TaskContext.get().partitionId(), 0
        out, weight = [], 0
        for batch in batches:
            ids, urls, refs = (batch.column(i).to_pylist() for i in (0, 1, 3))
            payloads = batch.column(2)
            for i, (rid, url, ref) in enumerate(zip(ids, urls, refs)):
                copy += 1
                view = memoryview(payloads[i].as_buffer())
                for k, (data, digest, last) in enumerate(record_chunks(rid, url or "", ref, view, chunk_bytes)):
                    out.append((archive, rid, copy, k, last, data, digest))
                    weight += len(data)
                    if weight >= FLUSH_BYTES:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                        out, weight = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    return stored(told.mapInArrow(run, CHUNK_SCHEMA), name)


_END = b"\r\n\r\n"


class RecordReader:
    """Reads one record from its chunks in order, holding no more than one chunk and a running digest."""

    def __init__(self, data: bytes) -> None:
        at = data.index(_END) + 4
        fields = dict(x.split(b": ", 1) for x in data[:at - 4].split(b"\r\n")[1:])
        self.fields = {k.decode().lower(): v.decode() for k, v in fields.items()}
        body = data.index(_END, at) + 4
        http = dict(x.split(b": ", 1) for x in data[at:body - 4].split(b"\r\n")[1:])
        self.size = int({k.lower(): v for k, v in http.items()}[b"content-length"])
        self.kind = self.fields["warc-type"]
        self.left = int(self.fields["content-length"]) - (body - at)
        self.digest = hashlib.sha256()
        self.sound = True
        self.start = body

    def feed(self, data: bytes, digest: str, last: bool) -> None:
        view = memoryview(data)[self.start:]
        self.start = 0
        part = view[:min(self.left, len(view))]
        self.digest.update(part)
        self.left -= len(part)
        self.sound &= self.digest.hexdigest() == digest and bytes(view[len(part):]) == (_END if last else b"")

    def cut(self) -> tuple:
        """The row of a record whose last chunk never came."""
        self.sound = False
        return self.row()

    def row(self) -> tuple:
        stated = self.fields["warc-payload-digest"].removeprefix("sha256:")
        number = lambda name: (x := self.fields.get(name, "").strip("<>").removeprefix(URN)) and int(x) or (0 if x else None)
        whole = self.sound and self.left == 0 and (self.kind == "revisit" or self.digest.hexdigest() == stated)
        return (number("warc-record-id"), self.fields["warc-target-uri"], self.kind, number("warc-refers-to"),
                self.size, stated, whole)


def read_archive(chunks: DataFrame) -> DataFrame:
    """One row per record of a chunk table; `whole` says that every chunk was there and every digest agreed.

    A record whose end is missing comes out as not whole. Records of one chunk are read where they lie; only chunks of longer records are brought together, by record.
    """
    bounded_batches(chunks.sparkSession)
    arrow = to_arrow_schema(RECORD_SCHEMA)
    single = (F.col("chunk") == 0) & F.col("last")

    def run(batches):
        reader, at = None, None
        for batch in batches:
            out = []
            columns = [batch.column(batch.schema.get_field_index(n)).to_pylist()
                       for n in ("archive", "copy", "chunk", "last", "data", "digest")]
            for archive, copy, chunk, last, data, digest in zip(*columns):
                if chunk == 0:
                    if reader is not None:
                        out.append(reader.cut())
                    reader, at = RecordReader(data), (archive, copy, 0)
                elif reader is None or at != (archive, copy, chunk):
                    raise ValueError(f"archive {archive}, record {copy}: chunk {chunk} has no predecessor")
                reader.feed(data, digest, last)
                at = (archive, copy, chunk + 1)
                if last:
                    out.append(reader.row())
                    reader = None
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
        if reader is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(reader.cut(), arrow.types)], schema=arrow)

    short = chunks.where(single).mapInArrow(run, RECORD_SCHEMA)
    long = (chunks.where(~single).repartition("archive", "copy").sortWithinPartitions("archive", "copy", "chunk")
            .mapInArrow(run, RECORD_SCHEMA))
    return short.unionAll(long)


FILE_SCHEMA = T.StructType([
    T.StructField("file", T.StringType()), T.StructField("bytes", T.LongType()), T.StructField("records", T.LongType()),
])


def export_files(chunks: DataFrame, folder: str) -> DataFrame:
    """Writes each archive of a chunk table as a .warc file below `folder`, a URI that all executors reach; one row per file.

    A task streams an archive's chunks to a file of its own and moves it into place when it is whole, so a lost or
    repeated task leaves no broken archive.
    """
    bounded_batches(chunks.sparkSession)
    arrow = to_arrow_schema(FILE_SCHEMA)

    def run(batches):
        from uuid import uuid4

        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        archive = out = part = None
        done, size, records = [], 0, 0

        def close():
            out.close()
            name = f"{root}/archive-{archive:05d}.warc"
            store.move(part, name)
            done.append((name, size, records))

        for batch in batches:
            for now, chunk, data in zip(*(batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("archive", "chunk", "data"))):
                if now != archive:
                    if out is not None:
                        close()
                    archive, size, records = now, 0, 0
                    part = f"{root}/.part-{now:05d}-{uuid4().hex}"
                    out = store.open_output_stream(part)
                out.write(data)
                size += len(data)
                records += chunk == 0
        if out is not None:
            close()
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*done), arrow.types)], schema=arrow)

    ordered = chunks.select("archive", "copy", "chunk", "data").repartition("archive").sortWithinPartitions("archive", "copy", "chunk")
    return ordered.mapInArrow(run, FILE_SCHEMA)


def stream_records(read, block: int = CHUNK_BYTES) -> Iterator[tuple]:
    """Rows of the records of one archive file; `read(n)` gives its next bytes. Holds no more than a block of a payload."""
    held = b""

    def until(mark: bytes) -> bytes:
        nonlocal held
        while mark not in held:
            more = read(block)
            if not more:
                raise ValueError("the archive ends inside a header")
            held += more
        at = held.index(mark) + len(mark)
        out, held = held[:at], held[at:]
        return out

    while held or (held := read(block)):
        reader = RecordReader(until(_END) + until(_END))
        while reader.left:
            if not held and not (held := read(block)):
                break
            part, held = held[:reader.left], held[reader.left:]
            reader.digest.update(part)
            reader.left -= len(part)
        while len(held) < len(_END) and (more := read(block)):
            held += more
        reader.sound = held.startswith(_END)
        held = held[len(_END):]
        yield reader.row()


def read_files(spark, folder: str, block: int = CHUNK_BYTES) -> DataFrame:
    """One row per record of the .warc files below `folder`, each file streamed by one task."""
    from pyarrow import fs

    bounded_batches(spark)
    store, root = fs.FileSystem.from_uri(folder)
    names = [i.path for i in store.get_file_info(fs.FileSelector(root)) if i.path.endswith(".warc")]
    arrow = to_arrow_schema(RECORD_SCHEMA)

    def run(batches):
        store, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                out = []
                with store.open_input_stream(name) as f:
                    for row in stream_records(f.read, block):
                        out.append(row)
                        if len(out) == 1000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)
                            out = []
                if out:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), arrow.types)], schema=arrow)

    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(max(1, len(names)))
    return files.mapInArrow(run, RECORD_SCHEMA)
