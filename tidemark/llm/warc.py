"""WARC records in Zstandard archives: one frame per record, with the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh_dir, spool

#: Fixed values of the formats.
SKIPPABLE = 0x184D2A5D
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

CHUNK = 1 << 20
MANIFEST = pa.schema([("path", pa.string()), ("records", pa.int64())])
RECORDS = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])
PAYLOADS = RECORDS.append(pa.field("payload", pa.binary()))


class BadRecord(ValueError):
    """A record or an archive that breaks the format."""


def sha1_base32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(kind: str, page_id: int | None, digest: str) -> str:
    """Pages of one id but other payloads have other record ids."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{kind}:{page_id}:{digest}')}>"


def encode_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str) -> bytes:
    """A response record, or a revisit record whose block ends at the HTTP headers."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    kind, digest = "revisit" if revisit else "response", sha1_base32(payload)
    head = {
        "WARC-Type": kind,
        "WARC-Record-ID": record_id(kind, page_id, digest),
        "WARC-Date": date,
        "WARC-Target-URI": None if url is None else re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url),
        "WARC-Payload-Digest": f"sha1:{digest}",
        "WARC-Page-ID": page_id,
        "WARC-Refers-To": record_id("response", refers_to, digest) if revisit else None,
        "WARC-Refers-To-Page-ID": refers_to if revisit else None,
        "WARC-Profile": REVISIT_PROFILE if revisit else None,
        "Content-Type": "application/http; msgtype=response",
        "Content-Length": len(block),
    }
    lines = "".join(f"{k}: {v}\r\n" for k, v in head.items() if v is not None)
    return b"WARC/1.1\r\n" + lines.encode() + b"\r\n" + block + b"\r\n\r\n"


def decode_record(raw: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block, once version, headers and lengths are found right."""
    head, blank, rest = raw.partition(b"\r\n\r\n")
    first, *lines = head.split(b"\r\n")
    if not blank or not re.fullmatch(rb"WARC/1\.[01]", first):
        raise BadRecord(f"no WARC version line: {first[:40]!r}")
    headers = {}
    for line in lines:
        name, colon, value = line.partition(b":")
        if not colon or not name or name != name.strip():
            raise BadRecord(f"not a header: {line[:80]!r}")
        headers[name.decode().lower()] = value.strip().decode()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in headers:
            raise BadRecord(f"no {name}")
    if not headers["content-length"].isdecimal() or len(rest) != int(headers["content-length"]) + 4 or rest[-4:] != b"\r\n\r\n":
        raise BadRecord(f"content-length {headers['content-length']}, but {len(rest) - 4} bytes")
    return headers, rest[:-4]


def decode_payload(headers: dict[str, str], block: bytes) -> tuple[bytes | None, int]:
    """A response's payload and its length; for a revisit None and the length that its HTTP headers name."""
    http, blank, payload = block.partition(b"\r\n\r\n")
    named = re.search(rb"(?im)^content-length:[ \t]*(\d+)[ \t]*\r?$", http)
    if not blank or not http.startswith(b"HTTP/") or not named:
        raise BadRecord("the block has no HTTP headers with a length")
    if headers["warc-type"] == "revisit":
        if payload or "warc-refers-to" not in headers:
            raise BadRecord("a revisit with a payload or without its target")
        return None, int(named[1])
    if len(payload) != int(named[1]):
        raise BadRecord(f"a payload of {len(payload)} bytes instead of {int(named[1])}")
    if headers.get("warc-payload-digest", "").removeprefix("sha1:") not in ("", sha1_base32(payload)):
        raise BadRecord("the payload doesn't have its digest")
    return payload, len(payload)


def dictionary_frame(dictionary: bytes) -> bytes:
    body = zstandard.ZstdCompressor(level=19).compress(dictionary)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def frames(stream) -> Iterator[bytes]:
    """The content of each frame of an archive, holding one at a time."""
    rest = stream.read(8)
    dictionary = None
    if len(rest) == 8 and (found := struct.unpack("<II", rest))[0] == SKIPPABLE:
        body = stream.read(found[1])
        if len(body) != found[1]:
            raise BadRecord("the dictionary is cut off")
        dictionary = zstandard.ZstdDecompressor().decompress(body) if body[:4] == ZSTD_MAGIC else body
        rest = b""
    opened = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    while rest or (rest := stream.read(CHUNK)):
        frame, parts = opened.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                break
            if not (rest := stream.read(CHUNK)):
                raise BadRecord("the last frame is cut off")
        yield b"".join(parts)
        rest = frame.unused_data


def train(pages: DataFrame, *, id_col: str, text_col: str, samples: int, sample_bytes: int, dict_bytes: int) -> bytes:
    """A dictionary from the first sample_bytes of so many pages, drawn by a hash of the id; empty if they are too few."""
    some = pages.filter(F.col(text_col) != "")
    drawn_by = F.pmod(F.xxhash64(id_col), F.lit(1 << 30))
    near = drawn_by < int((1 << 30) * min(1.0, 1.1 * samples / max(1, some.count()) + 1e-6))  # so that partitions send few pages to the driver
    drawn = some.filter(near).select(drawn_by.alias("h"), F.substring(F.col(text_col).cast("binary"), 1, sample_bytes).alias("b")).orderBy("h").limit(samples)
    parts = [bytes(r["b"]) for r in drawn.collect()]
    try:
        return zstandard.train_dictionary(dict_bytes, parts).as_bytes() if parts else b""
    except zstandard.ZstdError:  # too few samples to train on
        return b""


def write_archives(pages: DataFrame, out_dir: str, *, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", min_bytes: int = 0, date: str = "2026-01-01T00:00:00Z", archive_bytes: int = 64 << 20, samples: int = 400, sample_bytes: int = 16 << 10, dict_bytes: int = 64 << 10) -> DataFrame:
    """Write a record per row of pages, and return the manifest (path, records) of the archives.

    The payload is the text in UTF-8, empty for null. Of rows with equal payloads of at
    least min_bytes, that with the smallest id (null ids come last) is written as response, and
    the others as revisits of it; repeated rows of that id are responses too. Each task writes archives of about
    archive_bytes of payload under names of its own; the manifest is committed by Spark, so it
    names one whole set even if a task ran twice, and what a lost task left is in no manifest.
    The dictionary is trained on samples pages at most, and its size is bounded by dict_bytes.
    An empty table gives no archives.
    """
    dictionary = train(pages, id_col=id_col, text_col=text_col, samples=samples, sample_bytes=sample_bytes, dict_bytes=dict_bytes)
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("payload")).withColumn("same", F.sha2("payload", 256))
    first = F.min(F.struct(F.col("page_id").isNull().alias("no_id"), "page_id"))["page_id"]
    groups = rows.filter(F.octet_length("payload") >= min_bytes).groupBy("same").agg(first.alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("same", "first", F.lit(True).alias("shared"))
    told = rows.join(groups, "same", "left").select("page_id", "url", "payload", "first", (F.coalesce("shared", F.lit(False)) & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))
    FileSystem.from_uri(out_dir)[0].create_dir(FileSystem.from_uri(out_dir)[1])

    def write(batches):
        store, root = FileSystem.from_uri(out_dir)
        made = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdCompressor(level=3)
        out, path, count, filled = None, "", 0, 0
        for batch in batches:
            for page, url, payload, first, revisit in zip(*(batch.column(k) for k in range(5)), strict=True):
                if out is None:
                    path = f"{root}/{uuid.uuid4().hex}.warc.zst"
                    out = store.open_output_stream(path)
                    out.write(dictionary_frame(dictionary) if dictionary else b"")
                body = payload.as_py()
                out.write(made.compress(encode_record(page.as_py(), url.as_py(), body, first.as_py(), revisit.as_py(), date)))
                count, filled = count + 1, filled + len(body)
                if filled >= archive_bytes:
                    out.close()
                    yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]}, MANIFEST)
                    out, count, filled = None, 0, 0
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [count]}, MANIFEST)

    return spool(told.mapInArrow(write, "path string, records long"), "warc-manifest")


def read_archives(manifest: DataFrame, base_dir: str, *, payloads: bool = False) -> DataFrame:
    """The records of the archives that manifest(path) names, in the store of base_dir.

    Per record: record_id, page_id, url, record_type, refers_to, payload_bytes and
    payload_digest, both of the full payload, and with payloads=True the payload (null for a revisit).
    A record that isn't valid, a frame that is cut off, or a wrong number of records stops
    the job with BadRecord and the archive's path. A task reads one archive or two, one record at a time.
    """
    schema = PAYLOADS if payloads else RECORDS

    def read(batches):
        store, _ = FileSystem.from_uri(base_dir)
        for batch in batches:
            for path, expected in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows, count, held = [], 0, 0
                try:
                    with store.open_input_stream(path) as stream:
                        for raw in frames(stream):
                            headers, block = decode_record(raw)
                            payload, length = decode_payload(headers, block)
                            number = lambda name: int(headers[name]) if name in headers else None  # noqa: B023, E731
                            rows.append((headers["warc-record-id"], number("warc-page-id"), headers.get("warc-target-uri"), headers["warc-type"], number("warc-refers-to-page-id"), length, headers.get("warc-payload-digest", "").removeprefix("sha1:") or None, payload)[: len(schema)])
                            count, held = count + 1, held + (len(payload or b"") if payloads else 0)
                            if len(rows) >= 4096 or held >= 8 << 20:
                                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)
                                rows, held = [], 0
                    if expected is not None and count != expected:
                        raise BadRecord(f"{count} records instead of {expected}")
                except (BadRecord, zstandard.ZstdError, UnicodeDecodeError) as e:
                    raise BadRecord(f"{path}: {e}") from e
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), schema.types, strict=True)], schema=schema)

    columns = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string" + ", payload binary" * payloads
    archives = manifest.select("path", "records")
    return archives.repartition(max(1, archives.count())).mapInArrow(read, columns)  # a number that is named isn't lowered by the size of the manifest


def qualified(spark: SparkSession, path: str) -> str:
    """The path with the scheme that Spark takes it to have, for stores that tasks open by themselves. An unknown scheme raises."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    uri = re.sub("^file:/+", "file:///", at.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(at).toString())
    FileSystem.from_uri(uri)
    return uri


def round_trip(pages: DataFrame, **options) -> DataFrame:
    """Write pages to archives in the shared folder and read them back."""
    out_dir = qualified(pages.sparkSession, fresh_dir(pages.sparkSession, "warc"))
    return read_archives(write_archives(pages, out_dir, **options), out_dir)
