"""Files into tables with declared schemas."""

from __future__ import annotations

import csv
import hashlib
import io
import re
from collections.abc import Iterator, Sequence
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas
from ..functions.values import blank_to_null, is_before_release, is_true, to_numeric, STILL_OPEN
from ..operators.relational import first_wins_union
from ..session import store

# File name endings that tell the review type.
REVIEW_FILES = {
    "early_access": "_early_access_reviews.csv",
    "post_release": "_post_release_reviews.csv",
}
_FILE_PATTERN = r"^(.*)_(early_access|post_release)_reviews\.csv$"


def _csv(spark: SparkSession, schema, path) -> DataFrame:
    """Header, quoted line breaks and doubled quotes, as the collectors write them.

    Quoted line breaks make a file one split, so parallelism comes from the number of files.
    """
    return spark.read.schema(schema).csv(
        path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False
    )


def with_file_origin(df: DataFrame) -> DataFrame:
    """Game, review type, file name and, but for streams, the position, for review files only."""
    columns = [F.col("_metadata.file_name").alias("source_file")]
    if not df.isStreaming:
        columns.append(F.monotonically_increasing_id().alias("row_id"))
    origin = df.select("*", *columns)
    return (
        origin.where(F.col("source_file").rlike(_FILE_PATTERN))
        .withColumn("game_name", F.regexp_extract("source_file", _FILE_PATTERN, 1))
        .withColumn("review_type", F.regexp_extract("source_file", _FILE_PATTERN, 2))
    )


def read_reviews(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Review files ``<game>_early_access_reviews.csv`` and ``<game>_post_release_reviews.csv``."""
    reader = spark.read.schema(schemas.REVIEW_FILE).option("pathGlobFilter", "*_reviews.csv")
    df = reader.csv(path, header=True, multiLine=True, quote='"', escape='"', enforceSchema=False)
    return with_file_origin(df)


BLOCK_BYTES = 64 * 1024 * 1024


def file_blocks(spark: SparkSession, path: str | Sequence[str], pattern: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """path, block (from 0), start and bytes of every file's blocks; no content is read.  Empty files have none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path if isinstance(path, str) else list(path))
    count = F.greatest(F.ceil(F.col("length") / block_bytes), F.lit(1))
    blocks = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    start = F.col("block") * block_bytes
    return blocks.select("path", "block", start.alias("start"), F.least(F.lit(block_bytes), F.col("length") - start).alias("bytes"))


def _open(path: str):
    """A file of any store, for reading by place."""
    if re.match("(file:)?/", path):
        return fs.LocalFileSystem().open_input_file(re.sub("^file:/*", "/", path))
    store, name = fs.FileSystem.from_uri(quote(path, safe=":/@"))
    return store.open_input_file(unquote(name))


def block_digest(path: str, start: int, size: int) -> str:
    """md5 of a part of a file."""
    digest = hashlib.md5()
    with _open(path) as file:
        file.seek(start)
        while size > 0 and (part := file.read(min(1 << 20, size))):
            digest.update(part)
            size -= len(part)
    return digest.hexdigest()


def records_in(path: str, start: int, size: int, quotes: int) -> Iterator[list[str]]:
    """The CSV records that begin in the ``size`` bytes from ``start``; ``quotes`` stand before them in the file.

    An odd number of quotes means that the block begins inside a quoted field: quotes that are doubled
    leave the parity as it is.  A record begins behind a line break at even parity.
    """
    with _open(path) as file:
        file.seek(start)
        data, inside, at = file.read(size), quotes % 2 == 1, 0
        if start:
            at = _next_record(data, 0, inside)
            # A line break that ends the block before is that block's; its record begins here.
            file.seek(start - 1)
            if not inside and file.read(1) == b"\n":
                at = 0
        if at < 0 or at >= len(data):
            return
        # The last record may go on in blocks behind.
        end, place = len(data), start + len(data)
        even = data.count(b'"') % 2 == (1 if inside else 0)
        tail = [data[at:]]
        if not (even and data.endswith(b"\n")):
            open_quote = not even
            while True:
                file.seek(place)
                more = file.read(1 << 16)
                if not more:
                    break
                end = _next_record(more, 0, open_quote)
                tail.append(more if end < 0 else more[:end])
                if end >= 0:
                    break
                open_quote ^= more.count(b'"') % 2 == 1
                place += len(more)
        csv.field_size_limit(1 << 30)
        text = io.StringIO(b"".join(tail).decode("utf-8", "replace"), newline="")
        yield from csv.reader(text)


def _next_record(data: bytes, at: int, inside: bool) -> int:
    """Place behind the first line break outside quotes, -1 if there is none."""
    while True:
        if inside:
            at = data.find(b'"', at) + 1
            if not at:
                return -1
        line, quote = data.find(b"\n", at), data.find(b'"', at)
        if line < 0:
            return -1
        if quote < 0 or line < quote:
            return line + 1
        at, inside = quote + 1, True


def _quotes_in(path: str, start: int, size: int) -> int:
    found = 0
    with _open(path) as file:
        file.seek(start)
        while size > 0 and (part := file.read(min(1 << 20, size))):
            found += part.count(b'"')
            size -= len(part)
    return found


def split_csv(
    spark: SparkSession, path: str | Sequence[str], names: Sequence[str], pattern: str = "*.csv", block_bytes: int = BLOCK_BYTES
) -> DataFrame:
    """CSV files with a header and quoted line breaks, each read by as many tasks as it has blocks.

    Columns path, block, place (of the record in its block) and, as text, those of ``names``; a column that a file lacks is
    NULL, as are blank fields.  The first pass counts quotes by block, their sum before a block tells
    whether it begins inside a field, and the second pass parses the records that begin in it.
    """
    blocks = file_blocks(spark, path, pattern, block_bytes)
    task = blocks.repartition("path", "block")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, heads = [], []
            for name, start, size in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "bytes"))):
                found.append(_quotes_in(name, start, size))
                heads.append(next(records_in(name, 0, 1 << 16, 0), []) if start == 0 else None)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.int64()), pa.array(heads, pa.list_(pa.string()))], [*batch.schema.names, "quotes", "header"]
            )

    kinds = "path string, block long, start long, bytes long"
    counted = store(task.mapInArrow(count, f"{kinds}, quotes long, header array<string>"), "csv-blocks")()
    in_file = Window.partitionBy("path").orderBy("block")
    before = F.coalesce(F.sum("quotes").over(in_file.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ready = counted.withColumns({"quotes": before, "header": F.first("header").over(in_file)}).repartition("path", "block")

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def batch_of(made: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), pa.int64(), pa.int64(), *[pa.string()] * len(names)]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made), types)], ["path", "block", "place", *names])

        for batch in batches:
            for name, number, start, size, quotes, header in zip(*(c.to_pylist() for c in batch.columns)):
                where = [header.index(n) if n in header else None for n in names]
                made: list[tuple] = []
                for place, record in enumerate(records_in(name, start, size, quotes)):
                    if not record or (start == 0 and place == 0):
                        continue
                    made.append((name, number, place, *((record[k] or None) if k is not None and k < len(record) else None for k in where)))
                    if len(made) == 10_000:
                        yield batch_of(made)
                        made = []
                if made:
                    yield batch_of(made)

    columns = ready.select("path", "block", "start", "bytes", "quotes", "header")
    return columns.mapInArrow(parse, "path string, block long, place long, " + ", ".join(f"`{n}` string" for n in names))


def read_metadata(spark: SparkSession, *paths: str) -> DataFrame:
    """Game metadata; where files share an app the first file wins."""
    return first_wins_union([_csv(spark, schemas.GAME_METADATA, p) for p in paths], "app_id")


def coerce_metrics(raw: DataFrame) -> DataFrame:
    """All-text outcome columns to their types: blank is NULL, 'true' in any case is true."""
    columns = []
    for field in schemas.SUCCESS_METRICS:
        if field.name not in raw.columns:
            continue
        kind = field.dataType.simpleString()
        if kind == "boolean":
            value = is_true(field.name)
        elif kind == "string":
            value = blank_to_null(field.name)
        else:
            value = to_numeric(field.name, kind)
        columns.append(value.alias(field.name))
    return raw.select(*columns)


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    names = schemas.SUCCESS_METRICS.fieldNames()
    text = schemas._schema(**{name: schemas._string for name in names})
    return coerce_metrics(_csv(spark, text, path))


def read_source_records(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, schemas.SOURCE_RECORD, path)


def read_preview_articles(spark: SparkSession, path: str) -> DataFrame:
    return articles_as_records(_csv(spark, schemas.PREVIEW_ARTICLE, path))


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """The two game lists of the registry file as rows, with the split they came from."""
    lists = spark.read.schema(schemas.REGISTRY_FILE).json(path, multiLine=True)
    both = F.array(
        F.struct(F.lit("training").alias("split"), F.col("training_games").alias("games")),
        F.struct(F.lit("validation").alias("split"), F.col("validation_games").alias("games")),
    )
    games = lists.select(F.inline(both)).select("split", F.inline("games"))
    return games.withColumn("still_open", F.col("end_date") == STILL_OPEN)


def _records(df: DataFrame, **columns: Column) -> DataFrame:
    kinds = {f.name: f.dataType for f in schemas.SOURCE_RECORD}
    return df.select(
        *[columns.get(name, F.lit(None)).cast(kind).alias(name) for name, kind in kinds.items()]
    )


def reviews_as_records(reviews: DataFrame) -> DataFrame:
    """Reviews in the unified text schema; the review type tells whether they precede release."""
    return _records(
        reviews,
        app_id=F.col("app_id"),
        app_name=F.col("app_name"),
        text=F.col("review_text"),
        sentiment_source=F.concat(F.lit("steam_"), F.col("review_type")),
        is_pre_release=F.col("review_type") == "early_access",
        author_type=F.lit("player"),
    )


def comments_as_records(comments: DataFrame, release: Column | None = None) -> DataFrame:
    """Video comments (app_id, app_name, text, published_at, video_url) in the unified schema."""
    before = F.lit(None) if release is None else is_before_release("published_at", release)
    return _records(
        comments,
        app_id=F.col("app_id"),
        app_name=F.col("app_name"),
        text=F.col("text"),
        sentiment_source=F.lit("youtube_comment"),
        timestamp=F.col("published_at"),
        is_pre_release=before,
        author_type=F.lit("community"),
        source_url=F.col("video_url"),
    )


def articles_as_records(articles: DataFrame, release: Column | None = None) -> DataFrame:
    """Preview articles: undated ones count as written before release."""
    before: Column = F.lit(True)
    if release is not None:
        dated = F.coalesce(F.col("date"), F.lit("")) != ""
        before = F.when(dated, is_before_release("date", release)).otherwise(True)
    return _records(
        articles,
        app_id=F.col("app_id"),
        app_name=F.col("app_name"),
        text=F.col("text"),
        sentiment_source=F.lit("preview_article"),
        timestamp=F.col("date"),
        is_pre_release=before,
        author_type=F.lit("critic"),
        source_url=F.col("source_url"),
    )


def unify(frames: Sequence[DataFrame]) -> DataFrame:
    union = frames[0]
    for frame in frames[1:]:
        union = union.unionByName(frame, allowMissingColumns=True)
    return union
