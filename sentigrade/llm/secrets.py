"""Secrets in texts, also below layers of encoding: a recursive decoding worklist.

The worklist starts with the text itself.  Every layer taken from it is scanned by the three patterns and
then unwrapped: escapes of URLs and of Unicode are replaced where they stand, which gives one new layer
each; every run of base64 gives a layer of its own, and bytes that begin like a compressed stream are
decompressed first, so such a run may give many.  A layer seen before at the same place in the text is
not taken again, so streams that unpack to themselves end; the list is empty at the fixpoint.

Each character of a layer knows the range of the text it came from: the escape, the four letters of
base64 it was coded in, or the whole run where it was compressed.  A match in a layer is reported as the
range from its first to its last character's origin.  Matches of the text itself are the base spans; those
of deeper layers are added unless a span of their kind contains them.

A decompressed stream is read in pieces, cut where no pattern and no encoding can go on, so a task holds
a text, its layers waiting, and a piece.  Nested escapes of one percent sign beyond eight levels are
unwrapped at once, so that cost stays linear in the text.

Null texts count as empty and have no spans.  Repeated rows and ids are rows of their own.  Key and text are read by
name, so further columns and their names don't matter.  An empty table gives no rows.
"""

from __future__ import annotations

import base64
import binascii
import bz2
import hashlib
import lzma
import re
import zlib
from collections import deque
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Kinds in their order, with their pattern, the group whose length counts, and its least length.
KINDS = {
    "assign": (re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), 2, 12),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 18),
    "hex": (re.compile(r"[0-9a-f]+"), 0, 16),
}
NAMES = tuple(KINDS)

_URL = re.compile(r"(?:%[0-9A-Fa-f]{2})+")
_NESTED = re.compile(r"%(?:25){8,}")
_UNICODE = re.compile(
    r"\\u\{0*([0-9A-Fa-f]{1,6})\}|\\U([0-9A-Fa-f]{8})|\\u([0-9A-Fa-f]{4})|\\x([0-9A-Fa-f]{2})|&#[xX]0*([0-9A-Fa-f]{1,6});|&#0*([0-9]{1,7});"
)
_BASE64_LINE = r"[A-Za-z0-9+/_-]{16,}"
_BASE64 = re.compile(rf"{_BASE64_LINE}(?:\r?\n[A-Za-z0-9+/_-]{{4,}})*={{0,2}}")
_LINE = re.compile(rf"{_BASE64_LINE}={{0,2}}")
_BREAK = re.compile(r"""[^A-Za-z0-9+/_.=\-"' :%\\&#;{}\r\n]""")  # stands in no pattern and no encoding
PIECE = 1 << 20
_GZIP, _ZLIB, _BZ2, _XZ, _ZSTD = b"\x1f\x8b\x08", (b"\x78\x01", b"\x78\x5e", b"\x78\x9c", b"\x78\xda"), b"BZh", b"\xfd7zXZ\x00", b"\x28\xb5\x2f\xfd"


@dataclass
class Layer:
    """A text and, for each character, the range of the outermost text it comes from (None: its own place)."""

    text: str
    starts: np.ndarray | None = None
    ends: np.ndarray | None = None

    def origin(self, start: int, end: int) -> tuple[int, int]:
        if self.starts is None:
            return start, end
        return int(self.starts[start:end].min()), int(self.ends[start:end].max())

    def identity(self) -> tuple[bytes, int, int]:
        low, high = self.origin(0, len(self.text))
        return hashlib.sha256(self.text.encode("utf-8", "surrogatepass")).digest(), low, high


def scan(text: str) -> Iterator[tuple[str, int, int]]:
    """Leftmost matches of every kind, those too short dropped."""
    for kind, (pattern, group, least) in KINDS.items():
        for m in pattern.finditer(text):
            if m.end(group) - m.start(group) >= least:
                yield kind, m.start(), m.end()


def _replaced(layer: Layer, found: list[tuple[int, int, list[tuple[str, int, int]]]]) -> Layer:
    """``layer`` with ranges replaced by characters, each from a range of the layer."""
    base_starts = np.arange(len(layer.text)) if layer.starts is None else layer.starts
    base_ends = np.arange(1, len(layer.text) + 1) if layer.ends is None else layer.ends
    texts, starts, ends, at = [], [], [], 0
    for start, end, made in found:
        texts.append(layer.text[at:start])
        starts.append(base_starts[at:start])
        ends.append(base_ends[at:start])
        texts.append("".join(char for char, _, _ in made))
        starts.append(np.array([base_starts[low:high].min() for _, low, high in made], dtype=np.int64))
        ends.append(np.array([base_ends[low:high].max() for _, low, high in made], dtype=np.int64))
        at = end
    texts.append(layer.text[at:])
    return Layer("".join(texts), np.concatenate([*starts, base_starts[at:]]), np.concatenate([*ends, base_ends[at:]]))


def unwrap_url(layer: Layer) -> Layer | None:
    text, found = layer.text, []
    if "%" not in text:
        return None
    nested = [(m.start(), m.end(), [("%", m.start(), m.end())]) for m in _NESTED.finditer(text)]
    if nested:
        return _replaced(layer, nested)
    for m in _URL.finditer(text):
        raw = binascii.unhexlify(m[0].replace("%", ""))
        try:
            chars = raw.decode("utf-8")
        except UnicodeDecodeError:
            chars = raw.decode("latin-1")
            sizes = [1] * len(chars)
        else:
            sizes = [len(c.encode("utf-8")) for c in chars]
        made, at = [], m.start()
        for char, size in zip(chars, sizes):
            made.append((char, at, at + 3 * size))
            at += 3 * size
        found.append((m.start(), m.end(), made))
    return _replaced(layer, found) if found else None


def unwrap_unicode(layer: Layer) -> Layer | None:
    if "\\" not in layer.text and "&#" not in layer.text:
        return None
    found = []
    for m in _UNICODE.finditer(layer.text):
        code = int(m[m.lastindex], 10 if m.lastindex == 6 else 16)
        if code <= 0x10FFFF:
            found.append((m.start(), m.end(), [(chr(code), m.start(), m.end())]))
    return _replaced(layer, found) if found else None


def _chunks(data: bytes) -> Iterator[bytes] | None:
    """What a compressed stream holds, a bounded part at a time; None for other bytes."""
    if data.startswith(_ZSTD):
        def zstd() -> Iterator[bytes]:
            with zstandard.ZstdDecompressor(max_window_size=1 << 27).stream_reader(data) as reader:
                while part := reader.read(PIECE):
                    yield part

        return zstd()
    if data.startswith(_BZ2):
        make, ended = bz2.BZ2Decompressor(), lambda d: d.eof
    elif data.startswith(_XZ):
        make, ended = lzma.LZMADecompressor(memlimit=1 << 28), lambda d: d.eof
    elif data.startswith((_GZIP, *_ZLIB)):
        make, ended = zlib.decompressobj(47), lambda d: d.eof
    else:
        return None

    def stream() -> Iterator[bytes]:
        rest = data
        while not ended(make):
            part = make.decompress(rest, PIECE)
            rest = make.unconsumed_tail if hasattr(make, "unconsumed_tail") else b""
            if not part and not rest:
                return
            yield part

    return stream()


_FAILURES = (zlib.error, OSError, EOFError, ValueError, lzma.LZMAError, zstandard.ZstdError)


def _inflated(data: bytes) -> Iterator[str] | None:
    """Pieces of the text in a compressed stream, up to where it is damaged."""
    chunks = _chunks(data)
    if chunks is None:
        return None

    def pieces() -> Iterator[str]:
        held = bytearray()
        try:
            for chunk in chunks:
                cut = max((m.end() for m in _BREAK.finditer(chunk.decode("latin-1"))), default=0)
                if cut and len(held) + cut >= PIECE:
                    yield _plain(bytes(held) + chunk[:cut])
                    held, chunk = bytearray(), chunk[cut:]
                held += chunk
        except _FAILURES:
            pass
        if held:
            yield _plain(bytes(held))

    return pieces()


def _plain(data: bytes) -> str:
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return data.decode("latin-1")


def _from_base64(run: str) -> bytes | None:
    """The bytes of a run, without its line breaks; None where no bytes have this code."""
    letters = run.rstrip("=").replace("-", "+").replace("_", "/")
    if len(letters) % 4 == 1:
        return None
    try:
        return base64.b64decode(letters + "=" * (-len(letters) % 4))
    except binascii.Error:
        return None


def _base64_layers(layer: Layer, start: int, end: int) -> Iterator[Layer] | None:
    """Layers of one run; None where it holds neither text nor a compressed stream."""
    run = layer.text[start:end]
    letters = re.sub(r"[\r\n]", "", run)
    data = _from_base64(letters)
    if not data:
        return None
    low, high = layer.origin(start, end)
    pieces = _inflated(data)
    if pieces is not None:
        return (Layer(text, np.full(len(text), low), np.full(len(text), high)) for text in pieces if text)
    try:
        text = data.decode("utf-8")
    except UnicodeDecodeError:
        return None
    if not all(c.isprintable() or c in "\t\r\n" for c in text):
        return None
    places = np.array([start + k for k, c in enumerate(run) if c not in "\r\n"])
    begin = np.cumsum([0, *(len(c.encode("utf-8")) for c in text)])
    first, last = places[begin[:-1] // 3 * 4], places[np.minimum((begin[1:] - 1) // 3 * 4 + 3, len(places) - 1)]
    starts = first if layer.starts is None else layer.starts[first]
    ends = last + 1 if layer.ends is None else layer.ends[last]
    return iter([Layer(text, starts.astype(np.int64), ends.astype(np.int64))])


def unwrap_base64(layer: Layer) -> Iterator[Layer]:
    for m in _BASE64.finditer(layer.text):
        made = _base64_layers(layer, m.start(), m.end())
        if made is not None:
            yield from made
        elif "\n" in m[0]:  # lines that only look like one run
            for line in _LINE.finditer(layer.text, m.start(), m.end()):
                yield from _base64_layers(layer, line.start(), line.end()) or ()


def unwrap(layer: Layer) -> Iterator[Layer]:
    """The layers directly below."""
    for deeper in (unwrap_url(layer), unwrap_unicode(layer)):
        if deeper is not None and deeper.text != layer.text:
            yield deeper
    yield from unwrap_base64(layer)


def _uncovered(found: dict[str, set[tuple[int, int]]], base: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Spans of ``found`` that no base span and no other found span of their kind contains."""
    more = []
    for kind, spans in found.items():
        own = {(start, end) for k, start, end in base if k == kind}
        furthest = -1
        for start, end in sorted(spans | own, key=lambda s: (s[0], -s[1])):
            if end > furthest:
                furthest = end
                if (start, end) not in own:
                    more.append((kind, start, end))
    return more


def find(text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """Base spans and added spans (kind, start, end) of a text, by start, then kind."""
    base = list(scan(text))
    first = Layer(text)
    waiting: deque[Iterator[Layer]] = deque([unwrap(first)])
    seen: set[tuple[bytes, int, int]] = set()
    found: dict[str, set[tuple[int, int]]] = {kind: set() for kind in NAMES}
    while waiting:
        layer = next(waiting[-1], None)
        if layer is None:
            waiting.pop()
            continue
        identity = layer.identity() if layer.text else None
        if identity is None or identity in seen:
            continue
        seen.add(identity)
        for kind, start, end in scan(layer.text):
            found[kind].add(layer.origin(start, end))
        waiting.append(unwrap(layer))
    order = lambda s: (s[1], NAMES.index(s[0]), s[2])
    return sorted(base, key=order), sorted(_uncovered(found, base), key=order)


def with_secrets(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Key, base and more (arrays of kind, start, end in code points, end exclusive) of every row."""
    source = documents.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = [find(one or "") for one in batch.column(1).to_pylist()]
            columns = [
                pa.array([[dict(zip(("kind", "start", "end"), s)) for s in spans[k]] for spans in both], span) for k in range(2)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", "base", "more"])

    kind = source.schema["key"].dataType.simpleString()
    spans = "array<struct<kind:string,start:long,end:long>>"
    return source.mapInArrow(run, f"key {kind}, base {spans}, more {spans}").withColumnRenamed("key", key)


def _listed(spans) -> F.Column:
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)))


def report(spans: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts of base spans by kind, their digest, and all spans, of the rows of ``with_secrets``."""
    place = F.create_map(*(F.lit(x) for k, name in enumerate(NAMES) for x in (name, k)))
    merged = F.array_sort(
        F.transform(F.concat("base", "more"), lambda s: F.struct(s.start.alias("start"), place[s.kind].alias("place"), s.end.alias("end"), s.kind.alias("kind")))
    )
    kinds = F.transform("base", lambda s: s.kind)
    counts = [(F.size("base") - F.size(F.array_remove(kinds, name))).cast("long").alias(f"n_{name}") for name in NAMES]
    return spans.select(
        key, *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(merged).alias("spans"), F.size("more").cast("long").alias("n_decoded")
    )


def redact(documents: DataFrame, text: str = "text", mark: str = "[secret]") -> DataFrame:
    """``documents`` with every span replaced by ``mark``; overlapping spans become one, null texts stay null."""
    schema = documents.schema
    at = documents.columns.index(text)

    def cleaned(value: str | None) -> str | None:
        if not value:
            return value
        base, more = find(value)
        out, done = [], 0
        for _, start, end in sorted(base + more, key=lambda s: (s[1], s[2])):
            if start >= done:
                out += [value[done:start], mark]
            done = max(done, end)
        return "".join([*out, value[done:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([cleaned(v) for v in batch.column(at).to_pylist()], batch.column(at).type)
            columns = [texts if k == at else c for k, c in enumerate(batch.columns)]
            yield pa.RecordBatch.from_arrays(columns, schema.names)

    return documents.mapInArrow(run, schema)
