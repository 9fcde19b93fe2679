"""Fixed-width binary exports: a sink, a source whose partitions are ranges of records, and a stream of arriving files."""

import json
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    InputPartition,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)
from pyspark.sql.types import StructType

from tidemark import fixed
from tidemark.operators.digest import RECORDS
from tidemark.schemas import SERIES
from tidemark.session import sized

FORMAT = "bar_exports"
ENCODING_OF_DATASET = {d: e for e, d in fixed.DATASET_OF_ENCODING.items()}
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

# Bytes of one task and records of one Arrow batch.
SPLIT = 32 << 20
BLOCK = 1 << 16

TYPES = {"i8": ("bigint", pa.int64()), "f8": ("double", pa.float64()), "f4": ("double", pa.float64())}
ALWAYS = {"file": ("string", pa.string()), "row_no": ("bigint", pa.int64())}


def fields(encoding: str) -> dict[str, tuple[str, pa.DataType]]:
    """Types of the columns of an export: its file, the position in it, and those of the record."""
    return ALWAYS | {name: TYPES[kind[1:]] for name, kind in RECORDS[encoding]}


def ddl(encoding: str, columns: list[str] | None = None) -> str:
    known = fields(encoding)
    return ", ".join(f"{c} {known[c][0]}" for c in columns or known)


def located(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """File system and path of a URI as Spark writes it (one slash after ``file:``, nothing escaped)."""
    scheme = re.match(r"([A-Za-z][\w+.-]*):", uri)
    if not scheme or scheme.group(1) == "file":
        return pa.fs.LocalFileSystem(), re.sub(r"^(file:)?/*", "/", uri)
    root = re.match(r"[^/]*//[^/]*", uri).group(0)
    files, base = pa.fs.FileSystem.from_uri(root + "/")
    return files, f"{base.rstrip('/')}/{uri[len(root):].lstrip('/')}"


@dataclass
class Span(InputPartition):
    """Records ``first`` to ``end`` of files, worked on by one task."""

    parts: list[tuple[str, int, int]]


def spans(found: list[tuple[str, int]], width: int, split: int) -> list[Span]:
    """Cut files at multiples of the record width, and gather small ones, into spans of at most ``split`` bytes."""
    most = max(split // width, 1)
    out, room = [], 0
    for path, size in found:
        first, records = 0, size // width
        while first < records:
            if not room:
                out.append(Span([]))
                room = most
            end = min(first + room, records)
            out[-1].parts.append((path, first, end))
            room -= end - first
            first = end
    return out


def records_of(path: str, first: int, end: int, encoding: str, columns: list[str], low: int | None, high: int | None) -> Iterator[pa.RecordBatch]:
    """Records ``first`` to ``end`` of a file whose time is in [``low``, ``high``]: only ``columns``, a block at a time."""
    layout, known = np.dtype(RECORDS[encoding]), fields(encoding)
    schema = pa.schema([(c, known[c][1]) for c in columns])
    files, place = located(path)
    name = path.rsplit("/", 1)[-1]
    with files.open_input_file(place) as source:
        for at in range(first, end, BLOCK):
            n = min(BLOCK, end - at)
            data = source.read_at(n * layout.itemsize, at * layout.itemsize)
            if len(data) < n * layout.itemsize:
                raise OSError(f"{path} became shorter while it was read")
            found = np.frombuffer(data, layout)
            position = np.arange(at, at + n)
            if low is not None or high is not None:
                inside = np.ones(n, bool)
                if low is not None:
                    inside &= found["ts_ms"] >= low
                if high is not None:
                    inside &= found["ts_ms"] <= high
                found, position = found[inside], position[inside]
            if not len(found):
                continue
            values = []
            for c in columns:
                if c == "file":
                    values.append(pa.repeat(name, len(found)))
                elif c == "row_no":
                    values.append(pa.array(position))
                elif found[c].dtype.kind == "f":
                    raw = found[c].astype("f8")
                    values.append(pa.array(raw, mask=raw == fixed.NULL_PRICE))
                else:
                    values.append(pa.array(found[c]))
            yield pa.RecordBatch.from_arrays(values, schema=schema)


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``BLOCK``: many short files do not make as many batches."""
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= BLOCK:
            yield pa.concat_batches(held)
            held, rows = [], 0
    if held:
        yield pa.concat_batches(held)


class ExportReader(DataSourceReader):
    def __init__(self, options: dict, columns: list[str]):
        self.path, self.encoding = options["path"], options["encoding"]
        self.split, self.columns = int(options.get("split", SPLIT)), columns
        self.low, self.high = None, None

    def partitions(self) -> list[Span]:
        files, place = located(self.path)
        listed = files.get_file_info(pa.fs.FileSelector(place, recursive=False))
        root = self.path.rstrip("/")
        found = [(f"{root}/{f.base_name}", f.size) for f in listed if f.is_file and f.base_name[0] not in "._"]
        cut = spans(sorted(found), fixed.RECORD_BYTES[self.encoding], self.split)
        return cut or [Span([])]

    def read(self, partition: Span) -> Iterator[pa.RecordBatch]:
        parts = (records_of(*part, self.encoding, self.columns, self.low, self.high) for part in partition.parts)
        yield from gathered(chain.from_iterable(parts))


class PushingReader(ExportReader):
    """Also takes bounds of ``ts_ms``: records outside never leave the task's decoder."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            ours = isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual))
            if not ours or f.attribute != ("ts_ms",) or f.value is None:
                yield f
                continue
            if not isinstance(f, (LessThan, LessThanOrEqual)):
                low = f.value + isinstance(f, GreaterThan)
                self.low = low if self.low is None else max(self.low, low)
            if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                high = f.value - isinstance(f, LessThan)
                self.high = high if self.high is None else min(self.high, high)


@dataclass
class Written(WriterCommitMessage):
    files: int
    listed: str | None  # hidden name of the list of these files


# Lines of a list of files.
LISTED = "file string, bytes bigint"


class ExportWriter(DataSourceArrowWriter):
    """One file per value of ``file``, in the order of the rows.

    A file gets its name when it is complete, so a lost attempt leaves at most a hidden one, and a
    repeated attempt puts the same bytes in its place. The list of a task's files, if lists are wanted, gets its name
    when the whole write is committed, so that no lost or repeated attempt lists a file.
    """

    def __init__(self, options: dict):
        self.path, self.encoding, self.lists = options["path"], options["encoding"], options.get("lists")

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        layout = np.dtype(RECORDS[self.encoding])
        files, root = located(self.path)
        files.create_dir(root, recursive=True)
        count, current, sink, hidden = 0, None, None, None
        listed, listing = None, None
        if self.lists:
            shelf, place = located(self.lists)
            shelf.create_dir(place, recursive=True)

        def close() -> None:
            nonlocal listed, listing
            size = sink.tell()
            sink.close()
            files.move(hidden, f"{root}/{current}")
            if self.lists and not listing:
                listed = f".{uuid.uuid4().hex}.json"
                listing = shelf.open_output_stream(f"{place}/{listed}", buffer_size=1 << 16)
            if listing:
                listing.write(json.dumps({"file": current, "bytes": size}).encode() + b"\n")

        for batch in iterator:
            names = np.asarray(batch.column("file"))
            records = np.empty(batch.num_rows, layout)
            for name, kind in RECORDS[self.encoding]:
                values = batch.column(name)
                records[name] = values.fill_null(fixed.NULL_PRICE if kind[1] == "f" else 0)
            edges = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist(), len(names)]
            for a, b in zip(edges, edges[1:]):
                if a == b:
                    continue
                if names[a] != current:
                    if sink:
                        close()
                    current, count = names[a], count + 1
                    hidden = f"{root}/.{current}-{uuid.uuid4().hex}"
                    sink = files.open_output_stream(hidden)
                sink.write(records[a:b].tobytes())
        if sink:
            close()
        if listing:
            listing.close()
        return Written(count, listed)

    def commit(self, messages: list[Written | None]) -> None:
        for message in messages:
            if message and message.listed:
                files, place = located(self.lists)
                files.move(f"{place}/{message.listed}", f"{place}/{message.listed[1:]}")


class Exports(DataSource):
    """``spark.read`` and ``write`` format of one folder of exports of one encoding.

    Options: ``encoding``; ``split``, bytes of a task; ``pushdown``, whether filters on ``ts_ms`` are
    taken (the session must allow it). The schema names the columns that are decoded.
    """

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return ddl(self.options["encoding"])

    def reader(self, schema: StructType) -> ExportReader:
        pushing = self.options.get("pushdown", "false") == "true"
        return (PushingReader if pushing else ExportReader)(self.options, schema.names)

    def writer(self, schema: StructType, overwrite: bool) -> ExportWriter:
        return ExportWriter(self.options)


def write_exports(rows: DataFrame, path: str, encoding: str, lists: str | None = None) -> None:
    """Write rows with the columns of ``fields`` to one file for each ``file``, in the order of ``row_no``.

    A file is written by one task, row after row. NULL prices become the sentinel; other fields must not be NULL.
    A file of the same name is replaced; without rows nothing is written. In the folder ``lists``, if one is given, each
    task leaves one list of its files with their lengths, for ``stream_listed``.
    """
    rows.sparkSession.dataSource.register(Exports)
    chosen = rows.select(*[F.col(c).cast(t) for c, (t, _) in fields(encoding).items()])
    ordered = chosen.repartition("file").sortWithinPartitions("file", "row_no")
    sink = ordered.write.format(FORMAT).option("encoding", encoding)
    (sink.option("lists", lists) if lists else sink).mode("append").save(path)


def scan_exports(spark: SparkSession, path: str, encoding: str, columns: list[str] | None = None, split: int = SPLIT) -> DataFrame:
    """Rows of all exports in a folder, with file name and position; only ``columns`` are decoded.

    Tasks read ranges of records, so a long file is spread and small ones are gathered, and no content is
    shuffled. Bounds of ``ts_ms`` are applied while decoding where the session lets sources take filters. An
    incomplete last record is not read (``export_problems`` names such files).
    """
    spark.dataSource.register(Exports)
    reader = spark.read.format(FORMAT).schema(ddl(encoding, columns)).option("encoding", encoding).option("split", split)
    return reader.option("pushdown", spark.conf.get(PUSHDOWN, "false")).load(path)


def export_files(spark: SparkSession, path: str) -> DataFrame:
    """Name and length of each export file; no content is read."""
    return spark.read.format("binaryFile").load(path).select(
        F.element_at(F.split("path", "/"), -1).alias("file"), F.col("length").alias("bytes")
    )


def stream_exports(spark: SparkSession, path: str, encoding: str, columns: list[str] | None = None, split: int = SPLIT, **options: object) -> DataFrame:
    """Rows of exports as they arrive in a folder, each file once; ``options`` are those of Spark's file stream.

    The stream lists names and lengths alone, all of the folder on the driver; long files are cut into ranges that are dealt
    over the tasks.
    """
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    arriving = spark.readStream.format("binaryFile").schema(schema).options(**options).load(path)
    return _dealt_records(arriving.select("path", "length"), encoding, columns, split)


def stream_listed(
    spark: SparkSession, path: str, lists: str, encoding: str, columns: list[str] | None = None, split: int = SPLIT, **options: object
) -> DataFrame:
    """Rows of exports in a folder as lists of them arrive in ``lists``, each list once; ``options`` are those of Spark's file stream.

    Lists hold one line of ``LISTED`` for each file, as ``write_exports`` leaves them: one for each task, whatever the number of
    files. The driver knows lists alone; tasks read the names in them. A file that is written again is listed again.
    """
    arriving = spark.readStream.schema(LISTED).options(**options).json(lists)
    named = F.concat(F.lit(path.rstrip("/") + "/"), "file")
    return _dealt_records(arriving.select(named.alias("path"), F.col("bytes").alias("length")), encoding, columns, split)


def _dealt_records(arriving: DataFrame, encoding: str, columns: list[str] | None, split: int) -> DataFrame:
    """Rows of the files at ``path`` of ``length`` bytes, whose ranges are dealt over the tasks."""
    width, columns = fixed.RECORD_BYTES[encoding], columns or list(fields(encoding))
    records = F.floor(F.col("length") / width)
    step = max(split // width, 1)
    firsts = F.explode(F.when(records > 0, F.sequence(F.lit(0).cast("bigint"), records - 1, F.lit(step).cast("bigint"))))
    cut = arriving.select("path", records.alias("n"), firsts.alias("first"))
    dealt = cut.select("path", "first", F.least("n", F.col("first") + step).alias("end")).repartition("path", "first")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = (row for batch in batches for row in batch.to_pylist())
        parts = (records_of(row["path"], row["first"], row["end"], encoding, columns, None, None) for row in found)
        yield from gathered(chain.from_iterable(parts))

    return dealt.mapInArrow(run, ddl(encoding, columns))


def export_problems(files: DataFrame, entries: DataFrame) -> DataFrame:
    """Files that do not hold exactly the rows their entry declares, by name and length alone."""
    width = F.lit(None).cast("int")
    for encoding, dataset in fixed.DATASET_OF_ENCODING.items():
        width = F.when(F.col("dataset") == dataset, fixed.RECORD_BYTES[encoding]).otherwise(width)
    df = entries.join(files.select("file", "bytes"), "file", "full_outer")
    problem = (
        F.when(F.col("bytes").isNull(), "no_file")
        .when(F.col("dataset").isNull(), "no_entry")
        .when(F.pmod(F.col("bytes"), width) != 0, "length")
        .when(F.col("bytes") != F.col("row_count") * width, "row_count")
    )
    return df.withColumn("problem", problem).where("problem is not null").select("file", "bytes", "problem")


def ingest_exports(spark: SparkSession, path: str, entries: DataFrame, dataset: str, columns: list[str] | None = None) -> DataFrame:
    """Bars of the export files of one dataset, with their entry and their position in the file as ``row_no``.

    ``entries`` names the file of each catalog entry. Bad files (see ``export_problems``) give no rows.
    """
    encoding = ENCODING_OF_DATASET[dataset]
    mine = entries.where(F.col("dataset") == dataset)
    bad = export_problems(export_files(spark, path), mine).select("file")
    sound = mine.join(bad, "file", "left_anti").select("file", *SERIES, "cov_start", "cov_end")
    wanted = columns and list(dict.fromkeys(["file", *columns]))
    return scan_exports(spark, path, encoding, wanted).join(sized(sound), "file").drop("file")
