"""WARC archives with one Zstandard frame per record and the dictionary in a leading skippable frame.

Each task writes its records to archives in the shared folder, under names of its own, and returns a manifest; only archives
of the manifest are read, so what a lost attempt leaves behind is ignored. The reader loads the dictionary, decodes frame by
frame and validates headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from markspan.session import new_path, written

# Fixed values of the format.
SKIPPABLE = 0x184D2A5D
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
DATE = "1970-01-01T00:00:00Z"

DICTIONARY_BYTES = 16 << 10
SAMPLE_BYTES = 1 << 20  # of the first records of an archive, to train its dictionary
ARCHIVE_BYTES = 32 << 20  # of records before compression; then the next archive begins


class BadArchive(ValueError):
    """An archive that breaks the format."""


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page: int | None) -> str:
    return f"<urn:page:{'none' if page is None else page}>"


def record(page: int | None, url: str | None, payload: bytes, original: int | None, revisit: bool) -> bytes:
    """A response with its payload, or a revisit that names the response with the same payload."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    fields = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_id(page)),
        ("WARC-Target-URI", quote(url or "", safe="%/:?#[]@!$&'()*+,;=~-._")),
        ("WARC-Date", DATE),
        ("WARC-Payload-Digest", f"sha1:{base32_sha1(payload)}"),
        ("WARC-Block-Digest", f"sha1:{base32_sha1(block)}"),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    if revisit:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(original))]
    head = VERSION + b"\r\n" + b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return head + b"\r\n" + block + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """Records as frames behind the frame of a dictionary trained on the first of them; too few records have none."""
    samples, size = [], 0
    for r in records:
        samples.append(r[:8192])
        size += len(samples[-1])
        if size > SAMPLE_BYTES:
            break
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        trained = None
    packer = zstandard.ZstdCompressor(dict_data=trained, write_content_size=True, write_checksum=True)
    lead = b""
    if trained is not None:
        content = trained.as_bytes()
        lead = struct.pack("<II", SKIPPABLE, len(content)) + content
    return lead + b"".join(packer.compress(r) for r in records)


def frames(data: bytes) -> Iterator[bytes]:
    """The decoded frames of an archive. The dictionary frame may hold the dictionary as it is or as a frame itself."""
    at, trained = 0, None
    if data[:4] == struct.pack("<I", SKIPPABLE):
        if len(data) < 8:
            raise BadArchive("dictionary frame is cut off")
        size = struct.unpack_from("<I", data, 4)[0]
        content = data[8 : 8 + size]
        if len(content) != size:
            raise BadArchive("dictionary frame is cut off")
        if content[:4] == struct.pack("<I", 0xFD2FB528):
            content = zstandard.ZstdDecompressor().decompress(content)
        trained, at = zstandard.ZstdCompressionDict(content), 8 + size
    unpacker = zstandard.ZstdDecompressor(dict_data=trained)
    view = memoryview(data)
    while at < len(data):
        one = unpacker.decompressobj()
        try:
            parts = [one.decompress(view[at : at + (1 << 16)])]
            read = at + (1 << 16)
            while not one.eof and read < len(data):
                parts.append(one.decompress(view[read : read + (1 << 16)]))
                read += 1 << 16
        except zstandard.ZstdError as e:
            raise BadArchive(f"frame at {at}: {e}") from e
        if not one.eof:
            raise BadArchive(f"frame at {at} is cut off")
        at = min(read, len(data)) - len(one.unused_data)
        yield b"".join(parts)


def parse(raw: bytes) -> dict:
    """Fields, block and payload of a record; raises where a header or a length is wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or lines[0] != VERSION:
        raise BadArchive("no record head")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.decode().partition(": ")
        if not colon or name in fields:
            raise BadArchive(f"bad field {line!r}")
        fields[name] = value
    missing = {"WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Payload-Digest", "WARC-Block-Digest", "Content-Length"} - fields.keys()
    if missing:
        raise BadArchive(f"fields missing: {sorted(missing)}")
    length = int(fields["Content-Length"])
    block = rest[:length]
    if len(block) != length or rest[length:] != b"\r\n\r\n":
        raise BadArchive("the block is not as long as its head says")
    if fields["WARC-Block-Digest"] != f"sha1:{base32_sha1(block)}":
        raise BadArchive("the block differs from its digest")
    http, gap, payload = block.partition(b"\r\n\r\n")
    sizes = [int(line.split(b":")[1]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    if not gap or len(sizes) != 1:
        raise BadArchive("no HTTP head")
    if fields["WARC-Type"] == "response":
        if len(payload) != sizes[0] or fields["WARC-Payload-Digest"] != f"sha1:{base32_sha1(payload)}":
            raise BadArchive("the payload differs from its head")
    elif fields["WARC-Type"] != "revisit" or payload or "WARC-Refers-To" not in fields:
        raise BadArchive("neither a response nor a revisit")
    return {"fields": fields, "payload": payload, "payload_bytes": sizes[0]}


def _page(identifier: str) -> int | None:
    page = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if page == "none" else int(page)


MANIFEST = "path string, records long, bytes long"


def _writing(folder: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, place = fs.FileSystem.from_uri(folder)
        store.create_dir(place, recursive=True)
        records: list[bytes] = []
        made: list[tuple] = []

        def put() -> None:
            data = archive(records)
            name = f"part-{uuid.uuid4().hex}.warc.zst"
            with store.open_output_stream(f"{place}/{name}", compression=None) as out:
                out.write(data)
            made.append((f"{folder}/{name}", len(records), len(data)))
            records.clear()

        held = 0
        for batch in batches:
            columns = [batch.column(c) for c in ("page_id", "url", "html", "original", "revisit")]
            for page, url, html, original, revisit in zip(*columns, strict=True):
                payload = (html.as_py() or "").encode()
                records.append(record(page.as_py(), url.as_py(), payload, original.as_py(), revisit.as_py()))
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    put()
                    held = 0
        if records:
            put()
        yield pa.RecordBatch.from_arrays(
            [pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.int64()), pa.array([m[2] for m in made], pa.int64())],
            names=["path", "records", "bytes"],
        )

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Write a record per row of (page_id, url, html) to archives below `folder`; returns their manifest (path, records, bytes).

    Null html is the empty payload, a null url an empty one. Of records with equal payloads of at least `least` bytes the one
    with the largest page_id is the response, others revisit it; rows that repeat that page_id are responses too. A null
    page_id is smaller than any other. `folder` is a URI that every executor reaches (a plain path counts as file)."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").withColumn("digest", F.sha1(F.encode(F.coalesce("html", F.lit("")), "UTF-8")))
    sized = rows.filter(F.octet_length(F.coalesce("html", F.lit(""))) >= least) if least else rows
    groups = sized.groupBy("digest").agg(F.max("page_id").alias("original"), F.count(F.lit(1)).alias("copies")).filter("copies > 1")
    groups = written(groups.select("digest", "original"), "payloads")
    told = rows.join(groups, "digest", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    laid = told.select("page_id", "url", "html", "original", revisit.alias("revisit"))
    return written(laid.mapInArrow(_writing(re.sub("^file:/+", "/", folder)), MANIFEST), "manifest")


RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def _reading(payloads: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    names = [f.split(" ")[0] for f in RECORDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def made(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0
        for batch in batches:
            for content, expected in zip(batch.column("content"), batch.column("records").to_pylist(), strict=True):
                count = 0
                for raw in frames(content.as_py()):
                    found = parse(raw)
                    f = found["fields"]
                    refers = _page(f["WARC-Refers-To"]) if "WARC-Refers-To" in f else None
                    payload = found["payload"] if payloads and f["WARC-Type"] == "response" else None
                    digest = f["WARC-Payload-Digest"].removeprefix("sha1:")
                    rows.append((_page(f["WARC-Record-ID"]), f.get("WARC-Target-URI"), found["payload_bytes"], digest, f["WARC-Type"], refers, payload))
                    count += 1
                    held += len(payload or b"") + 100
                    if held > 8 << 20:
                        yield made(rows)
                        rows, held = [], 0
                if expected is not None and count != expected:
                    raise BadArchive(f"{count} records, the manifest says {expected}")
        yield made(rows)

    return run


def read_archives(spark: SparkSession, folder: str, manifest: DataFrame | None = None, payloads: bool = True) -> DataFrame:
    """Every record of the archives below `folder`, those of the manifest only where one is given."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    name = F.element_at(F.split("path", "/"), -1).alias("name")
    files = files.select(name, "content")
    if manifest is None:
        files = files.withColumn("records", F.lit(None).cast("long"))
    else:
        files = files.join(manifest.select(name, "records"), "name")
    return files.select("content", "records").mapInArrow(_reading(payloads), RECORDS)


def page_records(pages: DataFrame) -> DataFrame:
    """Pages written to archives and read back: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc")
    manifest = write_archives(pages, folder)
    if not manifest.head(1):
        return spark.createDataFrame([], RECORDS).drop("url", "payload")
    return read_archives(spark, folder, manifest, payloads=False).drop("url", "payload")
