"""Operator 2: WARC records in seekable Zstandard bundles.

Records are grouped into independent Zstandard frames; a bundle ends with a seek
table (a skippable frame, in the layout of the public seekable format), and an
index maps each record to its frame and its offset within the decompressed
frame. Any frame can be read without the ones before it, so archives are read by
frame in parallel, and one record costs one frame.

Payloads of at least ``least_bytes`` that occur more than once are stored once:
the record with the largest page_id is the response, the others revisit it.
"""

from __future__ import annotations

import base64
import hashlib
import posixpath
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planweft.llm.shared import cut, new_dir, only, parallelism, text_or_empty, tidy

#: Fixed values of the public formats.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "1970-01-01T00:00:00Z"  # the tables hold no capture time

INDEX_SCHEMA = "record_id string, file string, frame int, frame_start long, frame_bytes long, offset int, length int"
RECORD_SCHEMA = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def file_system(uri: str):
    """(file system, path) of a folder that all executors share."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier.strip("<>").rpartition(":")[2]
    return None if number == "None" else int(number)


def to_record(page_id: int | None, url: str | None, payload: bytes, digest: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record; with ``refers_to`` a revisit without block."""
    target = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url or "") or record_id(page_id).strip("<>")
    block = b"" if refers_to is not None else HTTP_HEAD + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {target}", f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}", f"X-Payload-Length: {size}",
    ]
    if refers_to is not None:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def from_frame(data: bytes, at: int = 0) -> Iterator[dict]:
    """The records of a decompressed frame from ``at`` on. Raises if a response's payload isn't what its digest says."""
    while at < len(data):
        body = data.index(b"\r\n\r\n", at) + 4
        lines = data[at : body - 4].decode().split("\r\n")
        head = dict(x.split(": ", 1) for x in lines[1:])
        block = data[body : body + int(head["Content-Length"])]
        at = body + len(block) + 4
        digest = base64.b32decode(head["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
        payload, refers = None, head.get("WARC-Refers-To")
        if head["WARC-Type"] == "response":
            payload = block[block.index(b"\r\n\r\n") + 4 :]
            if hashlib.sha1(payload).hexdigest() != digest or len(payload) != int(head["X-Payload-Length"]):
                raise ValueError(f"record {head['WARC-Record-ID']} doesn't have the payload that its digest names")
        yield {
            "page_id": page_of(head["WARC-Record-ID"]), "url": head["WARC-Target-URI"], "payload_bytes": int(head["X-Payload-Length"]), "payload_digest": digest,
            "record_type": head["WARC-Type"], "refers_to": page_of(refers) if refers else None, "payload": payload,
        }


class Bundle:
    """Writes one bundle: frames of about ``frame_bytes`` of records each, then the seek table."""

    def __init__(self, stream, frame_bytes: int, level: int):
        import zstandard

        self.stream, self.frame_bytes, self.compressor = stream, frame_bytes, zstandard.ZstdCompressor(level=level, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.waiting: list[tuple[str, int, int]] = []
        self.buffer, self.start = bytearray(), 0

    def add(self, identifier: str, record: bytes) -> list[tuple]:
        """The index rows of the records whose frame is now complete."""
        self.waiting.append((identifier, len(self.buffer), len(record)))
        self.buffer += record
        return self.flush() if len(self.buffer) >= self.frame_bytes else []

    def flush(self) -> list[tuple]:
        if not self.buffer:
            return []
        packed = self.compressor.compress(bytes(self.buffer))
        self.stream.write(packed)
        rows = [(i, len(self.frames), self.start, len(packed), at, n) for i, at, n in self.waiting]
        self.frames.append((len(packed), len(self.buffer)))
        self.start += len(packed)
        self.buffer, self.waiting = bytearray(), []
        return rows

    def close(self) -> list[tuple]:
        rows = self.flush()
        entries = b"".join(struct.pack("<II", *x) for x in self.frames)
        footer = struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(entries) + len(footer)) + entries + footer)
        self.stream.close()
        return rows


def seek_table(source, size: int) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, plain bytes) of each frame, from the end of a bundle."""
    source.seek(size - 9)
    count, _, magic = struct.unpack("<IBI", source.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("the file has no seek table")
    source.seek(size - 9 - 8 * count)
    entries = struct.iter_unpack("<II", source.read(8 * count))
    frames, start = [], 0
    for packed, plain in entries:
        frames.append((start, packed, plain))
        start += packed
    return frames


def with_roles(pages: DataFrame, least_bytes: int) -> DataFrame:
    """page_id, url, html, digest, size, refers_to: by SHA-256 and size of the payload, in one join that skewed payloads may be split in."""
    html = text_or_empty("html")
    rows = only(pages, page_id="page_id", url="url", html="html").select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha1(F.encode(html, "utf-8")).alias("digest"), F.sha2(F.encode(html, "utf-8"), 256).alias("payload"), F.octet_length(html).cast("long").alias("size"))
    shared = rows.where(F.col("size") >= least_bytes).groupBy(F.col("payload").alias("of_payload"), F.col("size").alias("of_size")).agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("n")).where("n > 1 AND keeper IS NOT NULL")
    revisits = F.col("keeper").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    joined = rows.join(shared, (F.col("payload") == F.col("of_payload")) & (F.col("size") == F.col("of_size")), "left")
    return joined.select("page_id", "url", F.when(~revisits, F.col("html")).alias("html"), "digest", "size", F.when(revisits, F.col("keeper")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, least_bytes: int = 1000, frame_bytes: int = 1 << 20, bundle_bytes: int = 256 << 20, level: int = 3) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) to bundles in ``folder``; returns the index, already computed.

    A null html has an empty payload. A null page_id never is the one that others
    revisit; rows that repeat the largest page_id are responses each. Only
    bundles that a finished task wrote are in the index: a retried task writes
    under another name. Other columns are ignored; an empty table gives no bundle.
    """

    def run(batches):
        fs, root = file_system(folder)
        fs.create_dir(root, recursive=True)
        bundle, name, written = None, None, 0
        kinds = [pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32()]
        names = ["record_id", "file", "frame", "frame_start", "frame_bytes", "offset", "length"]

        def rows(found):
            cols = list(zip(*((x[0], name, *x[1:]) for x in found), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

        for batch in batches:
            for i in range(batch.num_rows):  # one row's payload at a time
                page_id, url, html, digest, size, refers_to = (batch.column(c)[i].as_py() for c in range(6))
                if bundle is None:
                    name, written = f"{uuid.uuid4().hex}.warc.zst", 0
                    bundle = Bundle(fs.open_output_stream(posixpath.join(root, name), compression=None), frame_bytes, level)
                found = bundle.add(record_id(page_id), to_record(page_id, url, (html or "").encode(), digest, size, refers_to))
                if found:
                    yield rows(found)
                if bundle.start >= bundle_bytes:
                    if found := bundle.close():
                        yield rows(found)
                    bundle = None
        if bundle is not None and (found := bundle.close()):
            yield rows(found)

    return cut(with_roles(pages, least_bytes).mapInArrow(tidy(run), INDEX_SCHEMA))


def read_archives(spark: SparkSession, folder: str, files: DataFrame, payloads: bool = True) -> DataFrame:
    """All records of the named bundles (column ``file``): seek tables first, then frames in parallel."""

    def frames(batches):
        fs, root = file_system(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                path = posixpath.join(root, name)
                with fs.open_input_file(path) as source:
                    found = seek_table(source, fs.get_file_info(path).size)
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(found), pa.string()), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.int64())], names=["file", "start", "bytes"])

    def records(batches):
        import zstandard

        fs, root = file_system(folder)
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        plain = zstandard.ZstdDecompressor()
        for batch in batches:
            for name, start, size in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                with fs.open_input_file(posixpath.join(root, name)) as source:
                    source.seek(start)
                    data = plain.decompress(source.read(size))
                rows = list(from_frame(data))
                if not payloads:
                    for r in rows:
                        r["payload"] = None
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    named = files.select("file").distinct()
    return named.mapInArrow(tidy(frames), "file string, start long, bytes long").repartition(parallelism(spark)).mapInArrow(tidy(records), RECORD_SCHEMA)


def read_indexed(folder: str, index: DataFrame, payloads: bool = True) -> DataFrame:
    """The record of each row of ``index``, from its place in its frame; a frame is read once, by one task.

    Raises where another record than the indexed one lies there.
    """

    def run(batches):
        import zstandard

        fs, root = file_system(folder)
        plain = zstandard.ZstdDecompressor()
        kinds = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload", pa.binary())])
        last, data = None, b""
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                rows = []
                for r in batch.slice(at, 200).to_pylist():
                    if last != (r["file"], r["frame_start"]):
                        with fs.open_input_file(posixpath.join(root, r["file"])) as source:
                            source.seek(r["frame_start"])
                            last, data = (r["file"], r["frame_start"]), plain.decompress(source.read(r["frame_bytes"]))
                    found = list(from_frame(data[r["offset"] : r["offset"] + r["length"]]))
                    if [record_id(x["page_id"]) for x in found] != [r["record_id"]]:
                        raise ValueError(f"{r['file']} doesn't hold {r['record_id']} where the index says")
                    rows += found if payloads else [found[0] | {"payload": None}]
                yield pa.RecordBatch.from_pylist(rows, schema=kinds)

    places = index.select("file", "frame_start", "frame_bytes", "offset", "length", "record_id").repartition("file", "frame_start")
    return places.sortWithinPartitions("file", "frame_start", "offset").mapInArrow(tidy(run), RECORD_SCHEMA)


def read_records(spark: SparkSession, folder: str, index: DataFrame, identifiers: DataFrame) -> DataFrame:
    """Only the records of ``identifiers`` (column ``page_id``), each from its frame by the index."""
    wanted = identifiers.select(F.concat(F.lit("<urn:x-page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("None")), F.lit(">")).alias("record_id")).distinct()
    return read_indexed(folder, index.join(wanted, "record_id"))


def round_trip(pages: DataFrame, folder: str | None = None, least_bytes: int = 1000) -> DataFrame:
    """Write ``pages`` to archives and read every record back from where the index has it, without the payloads themselves."""
    folder = folder or new_dir(pages.sparkSession, "warc")
    index = write_archives(pages, folder, least_bytes)
    return read_indexed(folder, index, payloads=False).drop("payload")
