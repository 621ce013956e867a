"""Archives of web pages as dictionary-compressed WARC files, and reading them back.

A file starts with a skippable Zstandard frame that holds a dictionary; each record behind it is a
frame of its own, compressed with that dictionary.  The dictionary is built from the first records of
the file, ``DICTIONARY_SAMPLE`` bytes of them, which the writer holds back until then.  A page with the
same payload as another one becomes a revisit record that names the page with the largest id; rows that
repeat that page itself, id and payload, are the same response again.

Every write task makes its files under a name of its own attempt and renames them when they are
whole, so a repeated task leaves no half file; only files listed by the finished tasks are read.  Files
go to the shared folder through ``pyarrow.fs``, so any store it knows will do.  A file is closed after
``FILE_BYTES`` of payload.

Null html is an empty payload.  Null page ids are never referred to: with no id among equal payloads
all are responses.  Empty tables give no files and no records.  Line breaks in URLs become spaces.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.fs as fs
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import materialize, scratch_folder

# Magic number of the skippable frame, texts of the WARC format.
DICTIONARY_FRAME = 0x184D2A5D
VERSION = "WARC/1.1"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

DICTIONARY_BYTES = 32 * 1024
DICTIONARY_SAMPLE = 2 * 1024 * 1024
FILE_BYTES = 64 * 1024 * 1024
DATE = "2000-01-01T00:00:00Z"


def digest_of(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def page_of(identifier: str) -> int | None:
    number = identifier.removeprefix("<urn:page:").removesuffix(">")
    return None if number == "none" else int(number)


def build_record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit of the page ``refers_to``."""
    revisit = refers_to is not None
    block = HTTP_HEAD if revisit else HTTP_HEAD + payload
    head = [
        VERSION,
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest_of(payload)}",
        f"X-Payload-Length: {len(payload)}",
    ]
    if url is not None:
        head.append("WARC-Target-URI: " + " ".join(url.splitlines()))
    if revisit:
        head += [f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Profile: {REVISIT_PROFILE}"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode("utf-8") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Header fields and block."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    if version != VERSION:
        raise ValueError(f"not a WARC record: {version[:40]!r}")
    fields = dict(line.split(": ", 1) for line in lines)
    size = int(fields["Content-Length"])
    if len(rest) != size + 4:
        raise ValueError(f"record of {len(rest) - 4} bytes, {size} announced")
    return fields, rest[:size]


def build_dictionary(samples: list[bytes]) -> bytes:
    """A Zstandard dictionary of the records; their raw end where there are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-DICTIONARY_BYTES:]


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary


class Archive:
    """Writes one file; holds records back until the dictionary can be built."""

    def __init__(self, store: fs.FileSystem, path: str, level: int):
        self.store, self.path, self.level = store, path, level
        self.partial = f"{path}.{uuid.uuid4().hex}.partial"
        self.out = store.open_output_stream(self.partial)
        self.held: list[bytes] = []
        self.held_bytes = self.payload_bytes = self.records = 0
        self.compressor: zstandard.ZstdCompressor | None = None

    def add(self, record: bytes, payload_bytes: int) -> None:
        self.payload_bytes += payload_bytes
        self.records += 1
        if self.compressor:
            self.out.write(self.compressor.compress(record))
            return
        self.held.append(record)
        self.held_bytes += len(record)
        if self.held_bytes >= DICTIONARY_SAMPLE:
            self.start()

    def start(self) -> None:
        raw = build_dictionary(self.held)
        self.out.write(dictionary_frame(raw))
        self.compressor = zstandard.ZstdCompressor(level=self.level, dict_data=zstandard.ZstdCompressionDict(raw))
        for record in self.held:
            self.out.write(self.compressor.compress(record))
        self.held = []

    def close(self) -> None:
        if not self.compressor:
            self.start()
        self.out.close()
        self.store.move(self.partial, self.path)


def read_records(data: pa.Buffer | bytes) -> Iterator[bytes]:
    """The records of one file."""
    view = memoryview(data)
    magic, size = struct.unpack_from("<II", view)
    if magic != DICTIONARY_FRAME:
        raise ValueError("no dictionary frame")
    dictionary = zstandard.ZstdCompressionDict(bytes(view[8 : 8 + size]))
    expand = zstandard.ZstdDecompressor(dict_data=dictionary)
    rest = view[8 + size :]
    while len(rest):
        one = expand.decompressobj()
        record, at = [], 0
        while not one.eof:
            record.append(one.decompress(rest[at : at + 65536]))
            at += 65536
        yield b"".join(record)
        rest = rest[min(at, len(rest)) - len(one.unused_data) :]


def store_of(folder: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _payload(html: Column) -> Column:
    return F.coalesce(html.cast("string"), F.lit("")).cast("binary")


def with_references(
    pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", least_bytes: int = 0
) -> DataFrame:
    """page_id, url, payload and refers_to (null for responses).

    Digests are grouped without the pages; only payloads that occur twice are joined back.
    """
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).cast("string").alias("url"), _payload(F.col(html)).alias("payload")
    ).withColumn("digest", F.sha1("payload"))
    repeated = materialize(
        rows.where(F.length("payload") >= least_bytes)
        .groupBy("digest")
        .agg(F.max("page_id").alias("first_page"), F.count("*").alias("copies"))
        .where("copies > 1 and first_page is not null")
        .select("digest", "first_page"),
        "warc-repeated",
    )
    refers = F.when(F.col("page_id").eqNullSafe(F.col("first_page")), None).otherwise(F.col("first_page"))
    return rows.join(repeated, "digest", "left").select("page_id", "url", "payload", refers.alias("refers_to"))


def write_archives(
    referenced: DataFrame, folder: str, file_bytes: int = FILE_BYTES, level: int = 3, date: str = DATE
) -> DataFrame:
    """Writes the rows of ``with_references`` as files below ``folder``; returns path and records of each."""
    store, root = store_of(folder)
    store.create_dir(root, recursive=True)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, path = store_of(folder)
        task = uuid.uuid4().hex
        archive, number = None, 0
        done: list[tuple[str, int]] = []
        for batch in batches:
            for page_id, url, payload, refers_to in zip(*(column.to_pylist() for column in batch.columns)):
                if archive is None:
                    archive = Archive(own, f"{path}/pages-{task}-{number:05d}.warc.zst", level)
                    number += 1
                archive.add(build_record(page_id, url, payload, refers_to, date), len(payload))
                if archive.payload_bytes >= file_bytes:
                    archive.close()
                    done.append((archive.path, archive.records))
                    archive = None
        if archive is not None:
            archive.close()
            done.append((archive.path, archive.records))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*done)], ["path", "records"])

    return materialize(referenced.mapInArrow(run, "path string, records long"), "warc-files")


def read_archives(files: DataFrame, folder: str, batch_bytes: int = 16 * 1024 * 1024) -> DataFrame:
    """Records of the listed files: page_id, url, record_type, refers_to, payload (that of the record
    itself), payload_bytes and payload_digest (those of the full payload).  Payloads are verified."""
    schema = pa.schema(
        [
            ("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()),
            ("payload", pa.binary()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
        ]
    )

    def row(record: bytes) -> tuple:
        fields, block = parse_record(record)
        payload = block.removeprefix(HTTP_HEAD)
        kind, digest, size = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"])
        if kind == "response" and (digest_of(payload) != digest or len(payload) != size):
            raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
        refers_to = page_of(fields["WARC-Refers-To"]) if kind == "revisit" else None
        return page_of(fields["WARC-Record-ID"]), fields.get("WARC-Target-URI"), kind, refers_to, payload, size, digest

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, _ = store_of(folder)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with own.open_input_file(path) as file:
                    data = file.read_buffer()
                rows, size = [], 0
                for record in read_records(data):
                    rows.append(row(record))
                    size += len(record)
                    if size >= batch_bytes:
                        yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r)) for r in rows], schema)

    kinds = "page_id long, url string, record_type string, refers_to long, payload binary, payload_bytes long, payload_digest string"
    listed = files.select("path")
    return listed.repartition(max(1, listed.sparkSession.sparkContext.defaultParallelism), "path").mapInArrow(run, kinds)


def round_trip(spark: SparkSession, pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Writes all pages below the shared folder and reads the archives back."""
    folder = scratch_folder(spark, "warc")
    return read_archives(write_archives(with_references(pages, least_bytes=least_bytes), folder), folder)
