"""WARC archives through a chunked record table.

Payloads go into the archives and come out of them as rows of (record, chunk number, bytes): a payload of any length is
written, digested and read chunk by chunk, and no record is ever put together in memory. Digests grow with the chunks.

write() makes one archive a task, in the shared folder, under a name of its own for each attempt, and returns an index
row a record. read_chunks() streams archives back into the chunk table; read_records() digests it on the way.

Archives are gzip members of one record each, as the format recommends, so that each record can be read by its offset.

Defined results: a null payload is empty; of records with equal payloads of at least `least` bytes the one with the smallest
id is a response and the others are revisits of it, smaller payloads are all responses. Rows that repeat an id are records of their
own, and if it is the smallest of its payload all of them are responses; a row without an id is a response, with a null id when it
is read back. A null URL is left out of the headers; further columns are not read; an empty table makes no archive.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm.base import fresh_path, keep, qualified, small_batches

CHUNK = 1 << 16
#: Bytes of payload in a batch that the reader gives on, but for one chunk.
BATCH = 1 << 22
INDEX = "record_id long, archive string, at long, bytes long"


def _store(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def _text(digest) -> str:
    return base64.b32encode(digest.digest()).decode()


def _payloads(column):
    """Each payload of an Arrow array of binaries as a view, without a copy; nulls are empty."""
    column = column.cast(pa.large_binary())
    _, offsets, data = column.buffers()
    offsets = memoryview(offsets).cast("q")[column.offset : column.offset + len(column) + 1].tolist() if len(column) else []
    whole = memoryview(data) if data is not None else memoryview(b"")
    for begin, end in zip(offsets, offsets[1:]):
        yield whole[begin:end]


def _stamp(chunk: int, bodies: bool):
    """Columns record_id, url, body: adds n_bytes and digest (base32), worked out chunk by chunk."""

    def run(batches):
        for batch in batches:
            sizes, digests = [], []
            for payload in _payloads(batch.column(2)):
                digest = hashlib.sha1()
                for at in range(0, len(payload), chunk):
                    digest.update(payload[at : at + chunk])
                sizes.append(len(payload))
                digests.append(_text(digest))
            kept = batch.columns if bodies else batch.columns[:1]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sizes, pa.int64()), pa.array(digests, pa.string())], [*batch.schema.names[: len(kept)], "n_bytes", "digest"])

    return run


def _rows(pages: DataFrame, record_id: str, url: str, payload: str) -> DataFrame:
    return pages.select(F.col(record_id).cast("long").alias("record_id"), F.col(url).cast("string").alias("url"), F.col(payload).cast("binary").alias("body"))


def decide(pages: DataFrame, record_id: str = "page_id", payload: str = "html", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """digest, first: the digests (base32 SHA-1) of payloads of at least `least` bytes that several records have, and the smallest id of those."""
    rows = _rows(pages.withColumn("__url", F.lit(None).cast("string")), record_id, "__url", payload)
    digests = rows.mapInArrow(_stamp(chunk, False), "record_id long, n_bytes long, digest string").where(F.col("n_bytes") >= least)
    return keep(digests.groupBy("digest").agg(F.min("record_id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first"), "firsts")


def _split(chunk: int):
    """Columns record_id, url, body, n_bytes, digest, refers_to: the chunk table's rows, in batches of a bounded size."""
    schema = pa.schema([("record_id", pa.int64()), ("url", pa.string()), ("refers_to", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("body", pa.binary()), ("upto", pa.int64()), ("digest_upto", pa.string())])

    def run(batches):
        rows: list[tuple] = []
        held = 0

        def batch_of():
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

        for batch in batches:
            ids, urls, sizes, digests, refers = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            for k, payload in enumerate(_payloads(batch.column(2))):
                payload = payload if refers[k] is None else payload[:0]
                running = hashlib.sha1()
                count = max(1, -(-len(payload) // chunk))
                for c in range(count):
                    part = payload[c * chunk : (c + 1) * chunk]
                    running.update(part)
                    rows.append((ids[k], urls[k], refers[k], sizes[k], digests[k], c, c == count - 1, bytes(part), min(len(payload), (c + 1) * chunk), _text(running)))
                    held += len(part) + 200
                    if held > 1 << 22:
                        yield batch_of()
                        rows, held = [], 0
        if rows:
            yield batch_of()

    return run


CHUNKS = "record_id long, url string, refers_to long, n_bytes long, digest string, chunk int, last boolean, body binary, upto long, digest_upto string"


def chunk_table(pages: DataFrame, firsts: DataFrame, record_id: str = "page_id", url: str = "url", payload: str = "html", chunk: int = CHUNK) -> DataFrame:
    """A row for each chunk of each record: its number and bytes, and how many bytes (upto) and what SHA-1 (digest_upto, base32) the chunks make so far.

    n_bytes and digest are the whole payload's. A revisit (refers_to isn't null) has one row with an empty body; so has an empty
    payload. A record's rows follow each other in the order of chunks, in one partition.
    """
    stamped = _rows(pages, record_id, url, payload).mapInArrow(_stamp(chunk, True), "record_id long, url string, body binary, n_bytes long, digest string")
    decided = stamped.join(firsts, "digest", "left")
    decided = decided.select("record_id", "url", "body", "n_bytes", "digest", F.when(F.col("first") < F.col("record_id"), F.col("first")).alias("refers_to"))
    return decided.mapInArrow(_split(chunk), CHUNKS)


def _head(row: dict) -> bytes:
    revisit = row["refers_to"] is not None
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:record:{row['record_id']}>", "WARC-Date: 1970-01-01T00:00:00Z"]
    if row["url"] is not None:
        lines.append("WARC-Target-URI: " + " ".join(row["url"].split()))
    if revisit:
        lines += [f"WARC-Refers-To: <urn:record:{row['refers_to']}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    lines += [f"WARC-Payload-Digest: sha1:{row['digest']}", f"WARC-Payload-Bytes: {row['n_bytes']}", "Content-Type: text/html", f"Content-Length: {0 if revisit else row['n_bytes']}", "", ""]
    return "\r\n".join(lines).encode()


def _writer(folder: str):
    def run(batches):
        out = pack = None
        place = 0
        done: list[tuple] = []
        current, began = None, 0  # the record's last row so far
        name = f"{folder}/{uuid.uuid4().hex}.warc.gz"

        def put(data: bytes):
            nonlocal place
            if data:
                out.write(data)
                place += len(data)

        def end(row):
            if row["refers_to"] is None and (row["upto"], row["digest_upto"]) != (row["n_bytes"], row["digest"]):
                raise ValueError("a record's chunks don't make its payload")
            put(pack.compress(b"\r\n\r\n"))
            put(pack.flush())
            done.append((row["record_id"], name, began, place - began))

        for batch in batches:
            for row in batch.to_pylist():
                if out is None:
                    store, path = _store(folder)
                    store.create_dir(path)
                    out = store.open_output_stream(f"{path}/{name.rpartition('/')[2]}", compression=None)
                if row["chunk"] == 0:
                    if current is not None:
                        end(current)
                    began, pack = place, zlib.compressobj(3, zlib.DEFLATED, 31)
                    put(pack.compress(_head(row)))
                put(pack.compress(row["body"]))
                current = {k: v for k, v in row.items() if k != "body"}
        if current is not None:
            end(current)
            out.close()
        if done:
            ids, names, ats, sizes = zip(*done, strict=True)
            yield pa.RecordBatch.from_pydict({"record_id": pa.array(ids, pa.int64()), "archive": pa.array(names), "at": pa.array(ats, pa.int64()), "bytes": pa.array(sizes, pa.int64())})

    return run


def write(pages: DataFrame, folder: str, record_id: str = "page_id", url: str = "url", payload: str = "html", least: int = 0, chunk: int = CHUNK) -> DataFrame:
    """Write the archives into a folder given as a URI; returns their index: record_id, archive, at, bytes. A task that runs again writes another file; the index names those that count."""
    small_batches(pages.sparkSession)
    folder = qualified(pages.sparkSession, folder)
    # payloads that are too short to be revisited have no first
    chunks = chunk_table(pages, decide(pages, record_id, payload, least, chunk), record_id, url, payload, chunk)
    return keep(chunks.mapInArrow(_writer(folder), INDEX), "index")


def _stream(source, left: int, size: int):
    """The inflated bytes of one gzip member of `left` bytes, in pieces of at most `size` bytes."""
    unpack = zlib.decompressobj(31)
    while not unpack.eof:
        fed = unpack.unconsumed_tail
        if not fed and left:
            fed = source.read(min(size, left))
            left -= len(fed)
        piece = unpack.decompress(fed, size)
        if not fed and not piece and not unpack.eof:
            raise ValueError("the archive ends within a record")
        yield piece


def _records(archive: str, index: list[tuple[int, int]], size: int):
    """For each record of the archive: its headers, then its payload's chunks. index: offset and length."""
    store, path = _store(archive)
    with store.open_input_file(path) as file:
        for at, length in index:
            file.seek(at)
            held, pieces = b"", _stream(file, length, size)
            while b"\r\n\r\n" not in held:
                held += next(pieces)
            head, _, held = held.partition(b"\r\n\r\n")
            fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
            left = int(fields["Content-Length"])
            yield fields, None
            while left:
                if not held:
                    held = next(pieces)
                yield fields, held[:left]
                left, held = left - len(held[:left]), b""


def _number(urn: str | None) -> int | None:
    tail = None if urn is None else urn.strip("<>").rpartition(":")[2]
    return None if tail in (None, "None") else int(tail)


def _reader(size: int, bodies: bool):
    def run(batches):
        rows: list[dict] = []
        held = 0  # bytes of bodies in rows

        def batch_of(rows):
            schema = pa.schema([("record_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("stated_bytes", pa.int64()), ("stated_digest", pa.string()), ("chunk", pa.int32()), ("last", pa.bool_()), ("body", pa.binary()), ("n_bytes", pa.int64()), ("digest", pa.string())])
            return pa.RecordBatch.from_pylist(rows, schema=schema)

        for batch in batches:
            for group in batch.to_pylist():
                row = digest = None
                for fields, piece in _records(group["archive"], [(x["at"], x["bytes"]) for x in sorted(group["records"], key=lambda x: x["at"])], size):
                    if piece is None:
                        if row is not None:
                            rows.append(row | {"last": True, "digest": _text(digest)})
                        digest, chunk = hashlib.sha1(), 0
                        row = {"record_id": _number(fields["WARC-Record-ID"]), "record_type": fields["WARC-Type"], "refers_to": _number(fields.get("WARC-Refers-To")), "stated_bytes": int(fields["WARC-Payload-Bytes"]), "stated_digest": fields["WARC-Payload-Digest"].rpartition(":")[2], "chunk": 0, "body": b"" if bodies else None, "n_bytes": 0}
                    else:
                        if row["n_bytes"] and bodies:
                            rows.append(row | {"last": False, "digest": _text(digest)})
                            chunk += 1
                        digest.update(piece)
                        row = row | {"n_bytes": row["n_bytes"] + len(piece)} | ({"chunk": chunk, "body": piece} if bodies else {})
                        held += len(piece) if bodies else 0
                    if held >= BATCH or len(rows) >= 2000:
                        yield batch_of(rows)
                        rows, held = [], 0
                if row is not None:
                    rows.append(row | {"last": True, "digest": _text(digest)})
        if rows:
            yield batch_of(rows)

    return run


READ = "record_id long, record_type string, refers_to long, stated_bytes long, stated_digest string, chunk int, last boolean, body binary, n_bytes long, digest string"


def _blocks(index: DataFrame, block: int) -> DataFrame:
    """Records of an archive that lie within a stretch of `block` bytes are read together, each such stretch by a task of its own."""
    total = index.agg(F.sum("bytes")).first()[0] or 0
    blocks = index.groupBy("archive", F.floor(F.col("at") / block).alias("block")).agg(F.collect_list(F.struct("at", "bytes")).alias("records"))
    return blocks.repartition(1 + total // block, "archive", "block")


def read_chunks(index: DataFrame, chunk: int = CHUNK, block: int = 8 << 20) -> DataFrame:
    """The chunk table: a row for each chunk of each record; n_bytes and digest (base32 SHA-1) cover the chunks so far."""
    return _blocks(index, block).mapInArrow(_reader(chunk, True), READ)


def read_records(index: DataFrame, chunk: int = CHUNK, block: int = 8 << 20) -> DataFrame:
    """A row for each record, digested chunk by chunk, without the payloads."""
    return _blocks(index, block).mapInArrow(_reader(chunk, False), READ).drop("body", "last", "chunk")


def new_folder(spark: SparkSession) -> str:
    return fresh_path(spark, "warc")
