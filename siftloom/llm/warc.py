"""WARC archives, Zstandard-compressed: written and read back.

An archive starts with a skippable frame that holds its dictionary, itself compressed; one frame per record follows.
The first of equal payloads is a response, the others are revisits that name it and have the HTTP header only. The reader loads
the dictionary, decodes a frame per record, and checks version line, required fields, lengths and digests; whatever does
not hold raises ``ValueError``. Archives are rows of a table, ``(archive, content)``, so Spark commits what
a task wrote or nothing of it; ``save`` and ``read_files`` exchange them with files.
"""

from __future__ import annotations

import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, write_shared

LEAST_BYTES = 100
#: Payload bytes of an archive, after which the next one begins; samples of its dictionary, and their bytes.
ARCHIVE_BYTES, SAMPLES, SAMPLE_BYTES, DICT_BYTES = 8_000_000, 200, 400_000, 16_384
SKIPPABLE, ZSTD = 0x184D2A5D, 0xFD2FB528
VERSION = b"WARC/1.1"
DATE = "2000-01-01T00:00:00Z"
REQUIRED = (b"WARC-Type", b"WARC-Record-ID", b"WARC-Date", b"Content-Length", b"WARC-Payload-Digest")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """A record; ``refers_to`` makes it a revisit. Control characters and spaces of the URL are escaped."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    name = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url or "urn:no-url")
    fields = {
        "WARC-Type": "response" if refers_to is None else "revisit",
        "WARC-Record-ID": f"<urn:page:{'' if page_id is None else page_id}:{digest[:16]}>",
        "WARC-Date": DATE,
        "WARC-Target-URI": name,
        "WARC-Payload-Digest": f"sha256:{digest}",
    }
    if refers_to is not None:
        fields |= {"WARC-Profile": PROFILE, "WARC-Refers-To": f"<urn:page:{refers_to}:{digest[:16]}>"}
    fields |= {"Content-Type": "application/http; msgtype=response", "Content-Length": str(len(block))}
    lines = "".join(f"{k}: {v}\r\n" for k, v in fields.items())
    return VERSION + b"\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def dictionary(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """Trained on the samples; their own bytes where they are too few or too alike for that."""
    if len(samples) >= 16:
        try:
            return zstandard.train_dictionary(DICT_BYTES, samples)
        except zstandard.ZstdError:
            pass
    # Bytes without the mark of a trained dictionary are content that frames may refer to.
    return zstandard.ZstdCompressionDict(b"".join(samples)[-DICT_BYTES:].ljust(8, b" "))


def archive(records: list[bytes]) -> bytes:
    """The archive of the records: the dictionary's frame, then one of each."""
    samples, held = [], 0
    for r in records[:: max(1, len(records) // SAMPLES)]:
        samples.append(r[: SAMPLE_BYTES // 20])
        held += len(samples[-1])
        if held > SAMPLE_BYTES:
            break
    words = dictionary(samples)
    packed = zstandard.ZstdCompressor().compress(words.as_bytes())
    press = zstandard.ZstdCompressor(level=3, dict_data=words)
    return struct.pack("<II", SKIPPABLE, len(packed)) + packed + b"".join(map(press.compress, records))


def frames(content: bytes) -> Iterator[bytes]:
    """The records of an archive, a frame each."""
    words, at = None, 0
    if len(content) >= 8 and struct.unpack_from("<I", content)[0] == SKIPPABLE:
        size = struct.unpack_from("<I", content, 4)[0]
        raw = content[8 : 8 + size]
        if len(raw) != size:
            raise ValueError("the dictionary's frame is cut off")
        if raw[:4] == struct.pack("<I", ZSTD):
            raw = zstandard.ZstdDecompressor().decompress(raw)
        words, at = zstandard.ZstdCompressionDict(raw), 8 + size
    opener = zstandard.ZstdDecompressor(dict_data=words)
    view = memoryview(content)
    while at < len(content):
        one = opener.decompressobj()
        parts, step = [], 65_536
        while not one.eof:
            if at >= len(content):
                raise ValueError("a record's frame is cut off")
            try:
                parts.append(one.decompress(view[at : at + step]))
            except zstandard.ZstdError as e:
                raise ValueError(f"no frame at byte {at}: {e}") from e
            at += min(step, len(content) - at)
        at -= len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """``page_id, url, record_type, refers_to, payload_bytes, payload_digest, payload`` of a record, checked; revisits have no payload."""
    head, gap, block = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] not in (b"WARC/1.0", b"WARC/1.1"):
        raise ValueError("not a WARC record")
    fields = {}
    for line in lines[1:]:
        k, colon, v = line.partition(b":")
        if not colon or k in fields:
            raise ValueError(f"bad header line {line[:80]!r}")
        fields[k] = v.strip()
    if missing := [k for k in REQUIRED if k not in fields]:
        raise ValueError(f"no {missing[0].decode()}")
    if not fields[b"Content-Length"].isdigit() or len(block) != int(fields[b"Content-Length"]) + 4 or block[-4:] != b"\r\n\r\n":
        raise ValueError("the block's length is not Content-Length")
    http, gap, payload = block[:-4].partition(b"\r\n\r\n")
    length = re.search(rb"(?mi)^Content-Length:\s*([0-9]+)\r?$", http + b"\r")
    algorithm, _, digest = fields[b"WARC-Payload-Digest"].partition(b":")
    if not gap or not length or algorithm != b"sha256":
        raise ValueError("no HTTP response with a sha256 payload digest")
    kind = fields[b"WARC-Type"].decode()
    if kind == "response":
        if len(payload) != int(length[1]):
            raise ValueError("the payload's length is not its Content-Length")
        if hashlib.sha256(payload).hexdigest().encode() != digest:
            raise ValueError("the payload's digest differs")
    elif kind != "revisit" or payload or b"WARC-Refers-To" not in fields:
        raise ValueError(f"bad record of type {kind}")

    def page(field: bytes) -> int | None:
        m = re.fullmatch(rb"<urn:page:(-?[0-9]*):[0-9a-f]*>", fields.get(field, b"<urn:page::>"))
        if not m:
            raise ValueError(f"bad {field.decode()}")
        return int(m[1]) if m[1] else None

    return {
        "page_id": page(b"WARC-Record-ID"), "url": fields.get(b"WARC-Target-URI", b"").decode(), "record_type": kind, "refers_to": page(b"WARC-Refers-To"),
        "payload_bytes": int(length[1]), "payload_digest": digest.decode(), "payload": payload if kind == "response" else None,
    }


def references(pages: DataFrame) -> DataFrame:
    """``page_id, url, payload, digest, refers_to``: refers_to is the least page_id of an equal payload, null for a response.

    Copies are counted per digest before any shuffle, and only digests that occur again are joined to the pages. The join's keys are
    its sides' only partitioning, so Spark broadcasts a small side and splits the partitions of a hot digest.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.sha2("payload", 256))
    again = rows.where(F.octet_length("payload") >= LEAST_BYTES).groupBy("digest").agg(F.min("page_id").alias("least"), F.count("*").alias("n")).where("n > 1")
    again = write_shared(again.select("digest", "least"), "repeated")
    refers_to = F.when(F.col("page_id") > F.col("least"), F.col("least"))
    return rows.join(again, "digest", "left").select("page_id", "url", "payload", "digest", refers_to.alias("refers_to"))


def pack(pages: DataFrame) -> DataFrame:
    """``(archive string, content binary)``: a record of each row of pages; null html is an empty payload.

    Of rows that repeat a page_id and its payload, all are responses if it is the least; a null page_id is a response. No rows give
    no archives; further columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            content = archive(records)
            records.clear()
            name = f"{uuid.uuid5(uuid.NAMESPACE_OID, hashlib.sha256(content).hexdigest())}.warc.zst"
            return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([content], pa.binary())], ["archive", "content"])

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns)):
                records.append(record(*row))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush()
                    held = 0
        if records:
            yield flush()

    return references(pages).mapInArrow(run, "archive string, content binary")


def unpack(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """The records of ``(archive, content)`` rows; see ``parse``. Revisits have a null payload."""
    kinds = {"page_id": "long", "url": "string", "record_type": "string", "refers_to": "long", "payload_bytes": "long", "payload_digest": "string"}
    kinds |= {"payload": "binary"} if payloads else {}
    types = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1)):
                try:
                    found = [parse(raw) for raw in frames(content.as_buffer().to_pybytes())]
                except ValueError as e:
                    raise ValueError(f"{name}: {e}") from e
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], types[t]) for k, t in kinds.items()], list(kinds))

    return archives.select("archive", "content").mapInArrow(run, ", ".join(f"{k} {t}" for k, t in kinds.items()))


def unresolved(records: DataFrame) -> DataFrame:
    """Revisits of ``unpack`` that name no response with their digest: ``page_id, refers_to, payload_digest``. None, where archives are whole."""
    one = ["refers_to", "payload_digest"]
    held = records.where("record_type = 'response'").select(F.col("page_id").alias("refers_to"), "payload_digest")
    return records.where("record_type = 'revisit'").join(held, one, "left_anti").select("page_id", *one)


def save(archives: DataFrame, folder: str) -> DataFrame:
    """Write each archive as a file of ``folder``, a path or URI that all executors reach; ``(path, bytes)`` of what was written.

    A file's name is that of its content, so a task that runs again writes the same file again.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        store, base = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
        store.create_dir(base)
        for b in batches:
            for name, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                part = f"{base}/.{name}.{uuid.uuid4().hex}"
                with store.open_output_stream(part) as out:
                    out.write(content)
                store.move(part, f"{base}/{name}")
                yield pa.RecordBatch.from_arrays([pa.array([f"{base}/{name}"]), pa.array([len(content)], pa.int64())], ["path", "bytes"])

    return write_shared(archives.select("archive", "content").mapInArrow(run, "path string, bytes long"), "saved")


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """``(archive, content)`` of the .warc.zst files below a path."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").option("recursiveFileLookup", "true").load(path)
    return files.select(F.col("path").alias("archive"), "content")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    archives = write_shared(pack(table(spark, sf_dir, "pages")), "archives")
    return unpack(archives, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
digests AS (SELECT page_id, octet_length(p) AS payload_bytes, sha256(p) AS payload_digest FROM payloads),
firsts AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS least FROM digests)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id > least THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > least THEN least END AS refers_to FROM firsts
"""
