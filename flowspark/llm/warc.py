"""WARC archives with dictionary compression: written by Spark tasks, read back by Spark tasks.

An archive is a file of the .warc.zst form: a skippable frame (magic 0x184D2A5D) that holds a Zstandard dictionary,
then one frame per record. A task buffers its first `TRAIN_BYTES` of records, builds the dictionary from them, and
compresses every record on its own with it; an archive is closed when it has `ARCHIVE_BYTES`, so archives and what a
task holds are bounded whatever a partition holds. Too few records for a dictionary: an archive without the frame.

Of records with equal payloads of at least `LEAST_BYTES`, that with the smallest id is the response, the others are
revisits that name it; found by a partial aggregate over digests and a join on the digest, split at run time when one
payload has many copies.

Files go to a folder of their own below the cluster's shared folder, under a name of the writing attempt and moved to
the final one when complete; readers only see the archives that the successful attempts reported, so a lost executor
or a second attempt leaves no record twice.

Defined cases: a null payload is empty; a null id is written as no id, is nobody's response and comes back as null;
rows equal in id and payload are all responses or all revisits; an empty table gives no archive and an empty result;
only the named columns are read. A record's digest and length are of the full payload and stand in its header; of
responses they are computed anew from what was read, and a difference is an error.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowspark.llm.shared import ready, written
from flowspark.plans.scale import shared_folder

SKIPPABLE = 0x184D2A5D
LEAST_BYTES = 100
TRAIN_BYTES, DICTIONARY_BYTES, ARCHIVE_BYTES = 2 << 20, 64 << 10, 64 << 20
LEVEL = 3
CRLF = b"\r\n"


def typed(pages: DataFrame, key: str = "page_id", payload: str = "html", url: str = "url", least: int = LEAST_BYTES) -> DataFrame:
    """`(page_id, url, payload binary, payload_digest, record_type, refers_to)` of every row."""
    rows = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    digests = pages.select(F.col(key).cast("long").alias("page_id"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("payload"))
    firsts = digests.where(F.octet_length("payload") >= least).groupBy(F.sha2("payload", 256).alias("_digest")).agg(
        F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n")).where("_n > 1 and _first is not null").drop("_n")
    firsts = written(firsts, "repeated-payloads")
    joined = rows.join(firsts, rows["payload_digest"] == firsts["_digest"], "left")
    revisit = F.col("_first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_first"))
    return joined.select("page_id", "url", "payload", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"),
                         F.when(revisit, F.col("_first")).alias("refers_to"))


def record(page_id, url, payload: bytes, digest: str, kind: str, refers_to) -> bytes:
    """One WARC record. A revisit has no block; its header tells digest and length of the payload it stands for."""
    def uid(i) -> str:
        return f"<urn:page:{i}>"

    safe = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    block = payload if kind == "response" else b""
    fields = [("WARC-Type", kind), ("WARC-Record-ID", uid("" if page_id is None else page_id)), ("WARC-Target-URI", safe),
              ("WARC-Payload-Digest", f"sha256:{digest}"), ("Payload-Length", str(len(payload)))]
    if kind == "revisit":
        fields += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", uid(refers_to))]
    fields += [("Content-Type", "text/html"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields) + CRLF + block + CRLF + CRLF


def parsed(raw: bytes) -> tuple:
    """`(page_id, payload length, digest, type, refers_to)`; the payload of a response is checked against its header."""
    head, _, rest = raw.partition(CRLF + CRLF)
    fields = dict(line.split(b": ", 1) for line in head.split(CRLF)[1:])

    def page(value: bytes | None):
        number = (value or b"").removeprefix(b"<urn:page:").removesuffix(b">")
        return int(number) if number else None

    block = rest[:int(fields[b"Content-Length"])]
    kind, digest, size = fields[b"WARC-Type"].decode(), fields[b"WARC-Payload-Digest"].decode().removeprefix("sha256:"), int(fields[b"Payload-Length"])
    if kind == "response":
        found = hashlib.sha256(block).hexdigest()
        if (found, len(block)) != (digest, size):
            raise ValueError(f"record {fields[b'WARC-Record-ID']!r}: payload differs from its header")
    return page(fields[b"WARC-Record-ID"]), size, digest, kind, page(fields.get(b"WARC-Refers-To"))


def _store(folder: str):
    """File system and path of a folder by its URI, as the task sees it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


class Archive:
    """One file: dictionary frame, then a frame per record."""

    def __init__(self, store, folder: str, samples: list[bytes]):
        import zstandard

        name = uuid.uuid4().hex
        self.store, self.open_path, self.path = store, f"{folder}/.{name}.open", f"{folder}/{name}.warc.zst"
        self.out, self.bytes, self.records, self.dictionary = store.open_output_stream(self.open_path, compression=None), 0, 0, None
        try:
            trained = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, sum(map(len, samples)) // 8)), samples)
            self.dictionary = trained.as_bytes()
        except (zstandard.ZstdError, ValueError):
            trained = None  # too few or too short records to learn from
        if self.dictionary:
            self.write(struct.pack("<II", SKIPPABLE, len(self.dictionary)) + self.dictionary)
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_content_size=True)

    def write(self, raw: bytes) -> None:
        self.out.write(raw)
        self.bytes += len(raw)

    def add(self, raw: bytes) -> None:
        self.write(self.compressor.compress(raw))
        self.records += 1

    def close(self) -> dict:
        self.out.close()
        self.store.move(self.open_path, self.path)
        return {"archive": self.path.rsplit("/", 1)[1], "records": self.records, "bytes": self.bytes, "dictionary_bytes": len(self.dictionary or b"")}


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Write the rows of `typed` below `folder`; `(archive, records, bytes, dictionary_bytes)` of every archive.

    Evaluating the result again would write again: keep it in a table (`archived` does).
    """
    ready(rows.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        store.create_dir(path, recursive=True)
        archive, waiting, size, done = None, [], 0, []

        def opened() -> Archive:
            new = Archive(store, path, waiting)
            for raw in waiting:
                new.add(raw)
            waiting.clear()
            return new

        for batch in batches:
            for values in zip(*(c.to_pylist() for c in batch.columns)):
                raw = record(*values)
                if archive is not None:
                    archive.add(raw)
                else:
                    waiting.append(raw)
                    size += len(raw)
                    if size >= TRAIN_BYTES:
                        archive, size = opened(), 0
                if archive is not None and archive.bytes >= ARCHIVE_BYTES:
                    done.append(archive.close())
                    archive = None
        if waiting:
            archive = opened()
        if archive is not None:
            done.append(archive.close())
        yield pa.RecordBatch.from_pylist(done, schema=pa.schema([
            ("archive", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("dictionary_bytes", pa.int64())]))

    return rows.mapInArrow(run, "archive string, records long, bytes long, dictionary_bytes long")


def frames(stream) -> Iterator[bytes]:
    """Records of one archive, read from its stream frame by frame."""
    import zstandard

    head = stream.read(8)
    dictionary, pending = None, head
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        dictionary, pending = zstandard.ZstdCompressionDict(stream.read(struct.unpack("<I", head[4:])[0])), b""
    decompressor = zstandard.ZstdDecompressor(dict_data=dictionary)
    frame, parts = decompressor.decompressobj(), []
    while True:
        data = pending or stream.read(1 << 20)
        if not data:
            break
        pending = b""
        while data:
            parts.append(frame.decompress(data))
            if not frame.eof:
                break
            yield b"".join(parts)
            data, parts, frame = frame.unused_data, [], decompressor.decompressobj()


def read_archives(archives: DataFrame, folder: str) -> DataFrame:
    """One row per record of the listed archives, an archive to a task."""
    ready(archives.sparkSession)
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                        ("record_type", pa.string()), ("refers_to", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, path = _store(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows = []
                with store.open_input_stream(f"{path}/{name}", compression=None) as stream:
                    for raw in frames(stream):
                        rows.append(parsed(raw))
                        if len(rows) == 5000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                            rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return archives.select("archive").mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archived(pages: DataFrame) -> DataFrame:
    """Write all pages, then read the archives back: per page what its record says."""
    spark = ready(pages.sparkSession)
    folder = f"{shared_folder(spark)}/warc-{uuid.uuid4().hex}"
    listed = written(write_archives(typed(pages), folder), "archives")
    n = listed.count()
    return read_archives(listed.repartition(max(1, min(n, 10_000)), "archive"), folder)


ORACLE = """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""
