"""Merkle manifest of a dataset by time-forward processing: a digest for every row, source and the whole.

Leaves are digests of a row's fields.  The leaves of a source, in the order of their ids, form a tree
whose inner nodes hash up to three consecutive children; the roots of the sources, in the order of the
sources, form one more tree of the same kind.

1. Rows are numbered inside their source: sorted by ranges of (source, id, leaf), counted per range, and
   shifted by the counts before.  A source of any size is spread over ranges.
2. Up: nodes are cut into blocks of 3 ** ``HEIGHT`` neighbours.  A node's label is the last leaf below it,
   then its level, so children precede parents.  Rows arrive in the order of labels, each sends its digest
   as a message to its parent, and a priority queue ordered by label delivers the messages.  The queue
   holds two messages a level.  Messages that leave the block are rows of the next round, where the sorted
   shuffle is the external part of the queue; rounds end when every source has one node.
3. Down: the same in reverse.  A block gets its proof suffix, the siblings on the way from its top to the
   root, and a queue in descending order of labels delivers to each child its siblings and that suffix.
   A block is small, so its inner digests are made again instead of being stored.

What a leaf has got is its inclusion proof.  ``fold`` computes the root that leaf and proof lead to.

Null fields count as "-".  Null ids come first in their source, the null source before all others.  Rows that repeat an
id are ordered by their leaf; rows equal in all fields have equal leaves and are counted each.  Only the named columns are
read, so further columns and their names don't matter.  An empty table has no rows in its manifest.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable, Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize

FAN = 3
HEIGHT = 7
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(children: Iterable[bytes]) -> bytes:
    """SHA-256 of the children's digests as hexadecimal text."""
    return sha256(b"".join(children).hex().encode()).digest()


def wide(count: int, level: int) -> int:
    """Nodes on a level of a tree of ``count`` leaves."""
    return -(-count // FAN**level)


def height(count: int) -> int:
    level = 0
    while wide(count, level) > 1:
        level += 1
    return level


def fold(leaf: bytes, proof: bytes, path: Iterable[tuple[int, int]]) -> bytes:
    """The root that a leaf and its siblings lead to; ``path`` holds position and leaves of each tree passed."""
    at = 0
    for position, count in path:
        for level in range(height(count)):
            own = position // FAN**level
            before, size = own % FAN, min(FAN, wide(count, level) - own + own % FAN)
            siblings = [proof[at + 32 * k : at + 32 * k + 32] for k in range(size - 1)]
            leaf = digest_of([*siblings[:before], leaf, *siblings[before:]])
            at += 32 * (size - 1)
    return leaf


def climb(rows: Iterable[tuple[int, int, int, bytes]], level: int, levels: int) -> Iterator[tuple[int, int, int, bytes]]:
    """Tree, its number of leaves, position and digest of the highest node of every block.

    ``rows`` are the nodes (tree, leaves, position, digest) of whole blocks on ``level``, in order.
    """
    queue: list[tuple[int, int, int, int, bytes]] = []  # label: last position below the node, level; place, own position
    for tree, count, position, digest in rows:
        top = min(level + levels, height(count))
        last_of_tree = wide(count, level) - 1

        def send(at: int, node: int, value: bytes) -> Iterator[tuple[int, int, int, bytes]]:
            """From node ``node`` of level ``at`` to its parent, or out of the block."""
            if at >= top:
                yield tree, count, node, value
            else:
                parent = node // FAN
                label = min((parent + 1) * FAN ** (at + 1 - level) - 1, last_of_tree)
                heapq.heappush(queue, (label, at + 1, node, parent, value))

        yield from send(level, position, digest)
        while queue and queue[0][0] <= position:
            label, at, _, node, _ = queue[0]
            children = []
            while queue and queue[0][:2] == (label, at):
                children.append(heapq.heappop(queue)[4])
            yield from send(at, node, digest_of(children))


def descend(digests: list[bytes], levels: int, suffix: bytes) -> Iterator[tuple[int, bytes]]:
    """Place and proof suffix of every node of a block, last one first; ``suffix`` is that of its highest node."""
    layers = [digests]
    for _ in range(levels):
        layers.append([digest_of(layers[-1][k : k + FAN]) for k in range(0, len(layers[-1]), FAN)])
    queue = [(1 - len(digests), -levels, 0, suffix)]  # descending labels
    while queue:
        _, level, node, suffix = heapq.heappop(queue)
        if not level:
            yield node, suffix
            continue
        below = -level - 1
        run = layers[below][FAN * node : FAN * node + FAN]
        for k in range(len(run)):
            child = FAN * node + k
            last = min((child + 1) * FAN**below, len(digests)) - 1
            heapq.heappush(queue, (-last, -below, child, b"".join(run[:k] + run[k + 1 :]) + suffix))


def leaf_text(fields: Iterable[Column]) -> Column:
    parts = []
    for field in fields:
        value = field.cast("string")
        parts.append(F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-")))
    return F.concat(*parts)


def _digest(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def leaves(documents: DataFrame, fields: Iterable[str] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """key, source and leaf of every row, and changed, the leaf of its tampered text where that differs.

    Rows whose id has an even crc32 are tampered with: their text loses its line feeds.
    """
    own = [F.col(c) for c in fields]
    torn = [F.replace(F.col(c), F.lit("\n")) if c == text else F.col(c) for c in fields]
    tampered = (F.crc32(F.col(key).cast("string")) % 2 == 0) & F.col(text).contains("\n")
    return documents.select(
        F.col(key).alias("key"),
        F.col(group).alias("source"),
        _digest(leaf_text(own)).alias("leaf"),
        F.when(tampered, _digest(leaf_text(torn))).alias("changed"),
    )


def numbered(rows: DataFrame, group: str | None, order: list[Column], label: str) -> tuple[DataFrame, DataFrame]:
    """Rows with the range of the order they fall in and their place in it (span, at), and one row for each
    group of a range: its first place, rows of the group in earlier ranges (before) and in all (n)."""
    rows = rows.withColumn("_row", F.monotonically_increasing_id())  # spreads equal rows over ranges
    order = [*order, F.col("_row")]
    row = F.monotonically_increasing_id()
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order).drop("_row")
    ranged = materialize(ranged.withColumns({"span": F.shiftright(row, 33), "at": row.bitwiseAND(F.lit((1 << 33) - 1))}), label)
    keys = [group] if group else []
    counts = ranged.groupBy("span", *keys).agg(F.min("at").alias("first"), F.count("*").alias("rows"))
    here = Window.partitionBy(*keys)
    spans = counts.select(
        "span", *keys, "first", (F.sum("rows").over(here.orderBy("span")) - F.col("rows")).alias("before"), F.sum("rows").over(here).alias("n")
    )
    return ranged, spans


def _stream(nodes: DataFrame, extra: list[str]) -> DataFrame:
    block = F.floor(F.col("pos") / FAN**HEIGHT)
    return nodes.withColumn("block", block).repartition("tree", "block").sortWithinPartitions("tree", "block", *extra)


def _rounds(most: int) -> int:
    return max(1, -(-height(most) // HEIGHT))


def climb_all(nodes: DataFrame, most: int, label: str) -> list[DataFrame]:
    """Nodes (tree, n, pos, digest) and those of every further round; the last have one of each tree."""
    found = [nodes]
    for number in range(_rounds(most)):

        def run(batches: Iterator[pa.RecordBatch], level: int = number * HEIGHT) -> Iterator[pa.RecordBatch]:
            rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
            made: list[tuple] = []
            for one in climb(rows, level, HEIGHT):
                made.append(one)
                if len(made) == 10_000:
                    yield _batch(made)
                    made = []
            if made:
                yield _batch(made)

        def _batch(made: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["tree", "n", "pos", "digest"])

        rows = _stream(found[-1], ["pos"]).select("tree", "n", "pos", "digest")
        found.append(materialize(rows.mapInArrow(run, "tree long, n long, pos long, digest binary"), label))
    return found


def _blocks(nodes: DataFrame, messages: DataFrame, carried: list[str]) -> DataFrame:
    """Nodes behind the message to the top of their block, in order."""
    top = messages.select("tree", (F.col("pos") * FAN**HEIGHT).alias("pos"), F.lit(0).alias("kind"), "suffix", "subroot")
    return _stream(nodes.withColumn("kind", F.lit(1)).unionByName(top, allowMissingColumns=True), ["kind", "pos"]).select(
        "kind", "tree", "n", "pos", "digest", "suffix", "subroot", *carried
    )


def _proofs(batches: Iterator[pa.RecordBatch], level: int) -> Iterator[tuple]:
    """(row, suffix, subroot) of every node behind a message."""
    held: list[tuple] = []
    message: tuple | None = None

    def finish() -> Iterator[tuple]:
        if held:
            levels = min(HEIGHT, height(held[0][2]) - level)
            for place, suffix in descend([row[4] for row in held], max(levels, 0), message[5]):
                yield held[place], suffix, message[6]

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if row[0] == 0:
                yield from finish()
                held, message = [], row
            else:
                held.append(row)
    yield from finish()


def descend_all(rounds: list[DataFrame], messages: DataFrame, stop: int, label: str) -> DataFrame:
    """Messages (tree, pos, suffix, subroot) to the nodes of round ``stop``; ``messages`` are those to the last round's."""
    for number in range(len(rounds) - 2, stop - 1, -1):

        def run(batches: Iterator[pa.RecordBatch], level: int = number * HEIGHT) -> Iterator[pa.RecordBatch]:
            made: list[tuple] = []
            for row, suffix, subroot in _proofs(batches, level):
                made.append((row[1], row[3], suffix, subroot if subroot is not None or level else row[4]))
                if len(made) == 2_000:
                    yield _batch(made)
                    made = []
            if made:
                yield _batch(made)

        def _batch(made: list[tuple]) -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], ["tree", "pos", "suffix", "subroot"])

        made = _blocks(rounds[number], messages, []).mapInArrow(run, "tree long, pos long, suffix binary, subroot binary")
        messages = materialize(made, label)
    return messages


def manifest(documents: DataFrame, fields: Iterable[str] = FIELDS, key: str = "doc_id", group: str = "source", text: str = "text") -> DataFrame:
    """Key, leaf, subroot, root, proof_sha256, folded_root and verified of every row."""
    order = [F.col("source").asc_nulls_first(), F.col("key").asc_nulls_first(), F.col("leaf")]
    ranged, spans = numbered(leaves(documents, fields, key, group, text), "source", order, "merkle-leaves")
    spans = materialize(spans, "merkle-spans")
    sources, marks = numbered(spans.select("source", "n").distinct(), None, [F.col("source").asc_nulls_first()], "merkle-sources")
    trees = materialize(
        sources.join(marks.select("span", F.col("first"), "before", F.col("n").alias("trees")), "span").select(
            F.col("source").alias("_source"), "n", (F.col("before") + F.col("at") - F.col("first")).alias("tree"), "trees"
        ),
        "merkle-trees",
    )
    size = trees.agg(F.max("n").alias("most"), F.max("trees").alias("trees")).first()
    most, count = size.most or 1, size.trees or 1
    placed = spans.drop("n").join(trees.drop("trees"), F.col("source").eqNullSafe(F.col("_source"))).select(
        F.col("span").alias("_span"), "_source", "first", "before", "n", "tree"
    )
    nodes = materialize(
        ranged.join(placed, (F.col("span") == F.col("_span")) & F.col("source").eqNullSafe(F.col("_source"))).select(
            "tree", "n", (F.col("before") + F.col("at") - F.col("first")).alias("pos"), F.col("leaf").alias("digest"), "key", "changed"
        ),
        "merkle-nodes",
    )
    up = climb_all(nodes.drop("key", "changed"), most, "merkle-up")
    subroots = up[-1].select(F.lit(0).cast("long").alias("tree"), F.lit(count).cast("long").alias("n"), F.col("tree").alias("pos"), "digest")
    top = climb_all(subroots, count, "merkle-top")
    root = top[-1].first()
    root = bytes(root.digest) if root else b""
    empty, unknown = F.lit(b"").alias("suffix"), F.lit(None).cast("binary").alias("subroot")
    down = descend_all(top, top[-1].select("tree", "pos", empty, unknown), 0, "merkle-down")
    down = down.select(F.col("pos").alias("tree"), F.lit(0).cast("long").alias("pos"), "suffix", "subroot")
    messages = descend_all(up, down, 1, "merkle-down")

    kind = nodes.schema["key"].dataType.simpleString()
    names = ["key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        key_kinds: list[pa.DataType] = []

        def noted() -> Iterator[pa.RecordBatch]:
            for batch in batches:
                key_kinds[:] = [batch.column(7).type]
                yield batch

        def _batch() -> pa.RecordBatch:
            kinds = [key_kinds[0], *[pa.string()] * 5, pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names)

        for (_, tree, n, pos, digest, _, _, own, changed), proof, subroot in _proofs(noted(), 0):
            folded = fold(changed or digest, proof, [(pos, n), (tree, count)])
            proof_sha256 = sha256(proof.hex().encode()).hexdigest()
            made.append((own, digest.hex(), subroot.hex(), root.hex(), proof_sha256, folded.hex(), folded == root))
            if len(made) == 10_000:
                yield _batch()
                made.clear()
        if made:
            yield _batch()

    text_names = " string, ".join(names[1:-1])
    return (
        _blocks(nodes, messages, ["key", "changed"])
        .mapInArrow(run, f"key {kind}, {text_names} string, verified boolean")
        .withColumnRenamed("key", key)
    )

