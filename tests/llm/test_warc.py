"""Archives: exact round trips, revisits, file format."""

import base64
import hashlib
import io
import os

import pytest
import zstandard

from sentigrade.llm import warc
from sentigrade.session import scratch_folder


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows):
    groups = {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    out = []
    for page, _, html in rows:
        payload = (html or "").encode()
        known = [p for p in groups[payload] if p is not None]
        first = max(known, default=None)
        refers = None if first is None or page == first else first
        out.append((page, len(payload), digest(payload), "response" if refers is None else "revisit", refers))
    return sorted(out, key=repr)


ROWS = [
    (1, "http://a/", "<p>one</p>"), (2, "http://b/", "<p>one</p>"), (9, None, "<p>one</p>"), (9, "http://again/", "<p>one</p>"),
    (3, "http://c/\r\nX: y", None), (4, "http://d/", ""), (5, "é", "é日🎉" * 100_000), (None, "n", "<p>one</p>"), (None, "m", "alone"),
    (None, "m", "alone"), (6, "http://e/", "WARC/1.1\r\n\r\n"), (7, "http://f/", "x"),
]


@pytest.fixture()
def pages(spark):
    return spark.createDataFrame([(*row, "z") for row in ROWS], "page_id long, url string, html string, digest string").repartition(3)


def test_round_trip(spark, pages):
    got = warc.round_trip(spark, pages)
    found = got.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()
    assert sorted(map(tuple, found), key=repr) == expected(ROWS)
    texts = {r.page_id: bytes(r.payload).decode() for r in got.where("record_type = 'response'").collect()}
    assert texts[5] == ROWS[6][2] and texts[6] == "WARC/1.1\r\n\r\n" and texts[9] == "<p>one</p>"
    assert warc.round_trip(spark, pages.limit(0)).count() == 0


def test_small_payloads_stay_responses(spark, pages):
    kinds = {(r.page_id, r.record_type) for r in warc.round_trip(spark, pages, least_bytes=20).collect()}
    assert {kind for _, kind in kinds} == {"response"}


def test_files_start_with_their_dictionary(spark, pages):
    folder = scratch_folder(spark, "warc-test")
    files = warc.write_archives(warc.with_references(pages), folder, file_bytes=1000)
    listed = files.collect()
    assert sum(f.records for f in listed) == len(ROWS) and len(listed) > 3
    _, root = warc.store_of(folder)
    assert sorted(os.path.basename(f.path) for f in listed) == sorted(os.listdir(root))
    with open(listed[0].path, "rb") as file:
        data = file.read()
    assert int.from_bytes(data[:4], "little") == 0x184D2A5D
    size = int.from_bytes(data[4:8], "little")
    dictionary = zstandard.ZstdCompressionDict(data[8 : 8 + size])
    # A plain reader that skips the frame and knows the dictionary sees whole records.
    text = zstandard.ZstdDecompressor(dict_data=dictionary).stream_reader(io.BytesIO(data[8 + size :]), read_across_frames=True).read()
    assert text.startswith(b"WARC/1.1\r\n") and text.count(b"WARC-Record-ID") == listed[0].records


def test_a_dictionary_helps():
    records = [warc.build_record(k, f"http://x/{k}", b"<html><body>%d</body></html>" % (k * k), None, warc.DATE) for k in range(3000)]
    raw = warc.build_dictionary(records)
    with_it = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(raw))
    assert sum(len(with_it.compress(r)) for r in records) * 2 < sum(len(zstandard.ZstdCompressor().compress(r)) for r in records)


def test_damage_is_found():
    record = warc.build_record(1, "u", b"abc", None, warc.DATE)
    with pytest.raises(ValueError):
        warc.parse_record(record[:-5])
    with pytest.raises(ValueError):
        list(warc.read_records(b"\0" * 20))
