"""Ordered digests of rows, over their exact bytes.

Numbers become the hexadecimal text of their little-endian bytes, read from Arrow batches, so two prices that differ
in their last bit have different digests. ``rows_digest`` is the SHA-256 of the packed records in time
order. A hash over one sequence cannot be split, so its groups must be bounded: one
answer, or one month of one series. ``rows_digest_tree`` has no such limit; it hashes
rows, blocks of 1 024 rows, and so on up, and never gathers more than one block.
"""

import hashlib
import math
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tidemark import fixed
from tidemark.operators import ordered
from tidemark.schemas import SERIES

# Little-endian record layouts.
RECORDS = {
    fixed.ENCODING_LEGACY: [
        ("ts_ms", "<i8"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"),
        ("close", "<f4"), ("volume", "<i8"),
    ],
    fixed.ENCODING_COMPLETE: [
        ("ts_ms", "<i8"), ("open", "<f4"), ("high", "<f4"), ("low", "<f4"),
        ("close", "<f4"), ("volume", "<i8"), ("turnover", "<f8"), ("open_interest", "<i8"),
    ],
    fixed.ENCODING_NATIVE: [
        ("ts_ms", "<i8"), ("open", "<f8"), ("high", "<f8"), ("low", "<f8"),
        ("close", "<f8"), ("volume", "<i8"), ("open_oi", "<i8"), ("close_oi", "<i8"),
    ],
}


# Columns of a bar that its content covers, where present, with their widths.
CONTENT = [*RECORDS[fixed.ENCODING_NATIVE], ("turnover", "<f8"), ("open_interest", "<i8")]

# Types that have the widths, in Spark and in numpy.
TYPES = {"<f8": ("double", "<f8"), "<f4": ("float", "<f4"), "<i8": ("bigint", "<i8")}


def with_bits(df: DataFrame, layout: list[tuple[str, str]] = CONTENT) -> DataFrame:
    """Add the hexadecimal bytes of the layout's columns that ``df`` has, as ``_x_<name>``; NULL stays, any NaN is one value.

    All columns of a batch are read at once: the same digits by arithmetic on single values take twenty times as long.
    """
    present = [(n, k) for n, k in layout if n in df.columns]
    names, types = [f"_x_{n}" for n, _ in present], [TYPES[k] for _, k in present]

    def digits(*columns: pa.Array) -> pa.Array:
        texts = []
        for column, (_, kind) in zip(columns, types):
            values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            if kind != "<i8":
                values = np.where(np.isnan(values), np.array(np.nan, kind), values)
            width = 2 * values.itemsize
            starts = np.arange(len(values) + 1, dtype=np.int32) * np.int32(width)
            text = pa.StringArray.from_buffers(len(values), pa.py_buffer(starts), pa.py_buffer(values.tobytes().hex().upper().encode()))
            texts.append(pc.if_else(column.is_valid(), text, pa.scalar(None, pa.string())))
        return pa.StructArray.from_arrays(texts, names)

    read = F.arrow_udf(digits, StructType([StructField(n, StringType()) for n in names]))
    inputs = [F.col(n).cast(t) for (n, _), (t, _) in zip(present, types)]
    return df.withColumn("_x_", read(*inputs)).select("*", "_x_.*").drop("_x_")


DIGITS = np.frombuffer("".join(f"{i:02X}" for i in range(256)).encode(), np.uint16)  # both of each byte
WORDS = [f"_w{i}" for i in range(8)]


def with_words(df: DataFrame) -> DataFrame:
    """Add the eight 32-bit words of the SHA-256 of each row's content text as BIGINTs, ``WORDS``.

    The text is that of ``content_text`` after ``with_bits``. Hashed in the batch that was read: only the words return, and they are
    summed as plain numbers.
    """
    present = [(n, k) for n, k in CONTENT if n in df.columns]
    types = [TYPES[k] for _, k in present]

    def hashed(*columns: pa.Array) -> pa.Array:
        rows = len(columns[0])
        text = np.full((rows, len(columns), 17), ord("|"), np.uint8)
        for j, (column, (_, kind)) in enumerate(zip(columns, types)):
            values = column.fill_null(0).to_numpy(zero_copy_only=False).astype(kind)
            if kind != "<i8":
                values = np.where(np.isnan(values), np.array(np.nan, kind), values)
            text[:, j, :16] = DIGITS[np.ascontiguousarray(values).view(np.uint8).reshape(rows, 8)].view(np.uint8)
        width = 17 * len(columns)
        whole, digests = text.tobytes(), []
        for at in range(0, rows * width, width):
            digests.append(hashlib.sha256(whole[at : at + width - 1]).digest())
        valid = np.stack([np.asarray(c.is_valid()) for c in columns], axis=1)
        for i in np.flatnonzero(~valid.all(axis=1)).tolist():
            parts = [text[i, j, :16].tobytes() if valid[i, j] else b"-" for j in range(len(columns))]
            digests[i] = hashlib.sha256(b"|".join(parts)).digest()
        words = np.frombuffer(b"".join(digests), ">u4").reshape(rows, 8).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(words[:, i]) for i in range(8)], WORDS)

    read = F.arrow_udf(hashed, StructType([StructField(w, LongType()) for w in WORDS]))
    inputs = [F.col(n).cast(t) for (n, _), (t, _) in zip(present, types)]
    return df.withColumn("_w_", read(*inputs)).select("*", "_w_.*").drop("_w_")


def content_text(columns: list[str]) -> Column:
    """Text of a row after ``with_bits``: each value's bytes, a dash for NULL."""
    parts = [F.coalesce(F.col(f"_x_{n}"), F.lit("-")) for n, _ in CONTENT if n in columns]
    return F.concat_ws("|", *parts)


def record_hex(layout: list[tuple[str, str]]) -> Column:
    """Hexadecimal packed record after ``with_bits``; a NULL price is the sentinel."""
    null = {
        "<f8": struct.pack("<d", fixed.NULL_PRICE).hex().upper(),
        "<f4": struct.pack("<f", -math.inf).hex().upper(),
    }
    parts = [(F.col(f"_x_{n}"), k) for n, k in layout]
    return F.concat(*[F.coalesce(c, F.lit(null[k])) if k in null else c for c, k in parts])


def rows_digest(
    rows: DataFrame, keys: list[str], encoding: str, payload: bool = False
) -> DataFrame:
    """SHA-256, row count and on request the packed bytes of each bounded group.

    ``keys`` must bound a group: a request (at most its row limit) or a series month.
    """
    layout = RECORDS[encoding]
    chosen = with_bits(rows.select(*keys, *[name for name, _ in layout]), layout)
    items = F.array_sort(F.collect_list(F.struct("ts_ms", record_hex(layout).alias("r"))))
    data = F.unhex(F.array_join(F.transform(items, lambda i: i["r"]), ""))
    packed = chosen.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"), data.alias("data"))
    out = packed.withColumn("rows_sha256", F.sha2("data", 256))
    return out.select(*keys, "rows", "rows_sha256", *(["data"] if payload else []))


def series_digest(rows: DataFrame, keys: list[str], encoding: str) -> DataFrame:
    """SHA-256 and row count of each group, of any length: equal to ``rows_digest``, but never gathered.

    Rows are sorted by group and time and pass through one hash state, batch by batch, so memory does not depend on
    a group's length. One hash over one sequence cannot be split: a group is read by one task,
    as the format wants it; ``rows_digest_tree`` is the digest that spreads.
    """
    layout = RECORDS[encoding]
    names = [name for name, _ in layout]
    packed = with_bits(rows.select(*keys, *names), layout).select(*keys, "ts_ms", F.unhex(record_hex(layout)).alias("_r"))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in packed.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state, count = None, hashlib.sha256(), 0

        def told() -> pa.RecordBatch:
            values = [pa.array([v], t) for v, t in zip(current, kinds)]
            return pa.RecordBatch.from_arrays([*values, pa.array([count]), pa.array([state.hexdigest()])], [*keys, "rows", "rows_sha256"])

        for batch in batches:
            kinds = [batch.schema.field(k).type for k in keys]
            bounds = pa.table(batch.select(keys)).append_column("_at", pa.array(range(batch.num_rows)))
            starts = bounds.group_by(keys, use_threads=False).aggregate([("_at", "min")]).sort_by("_at_min")
            ends = [*starts.column("_at_min").to_pylist()[1:], batch.num_rows]
            records = batch.column("_r")
            for *key, at, end in zip(*[starts.column(k).to_pylist() for k in keys], starts.column("_at_min").to_pylist(), ends):
                if tuple(key) != current:
                    if current is not None:
                        yield told()
                    current, state, count = tuple(key), hashlib.sha256(), 0
                _, offsets, data = records.buffers()
                first = struct.unpack_from("<i", offsets, 4 * (records.offset + at))[0]
                last = struct.unpack_from("<i", offsets, 4 * (records.offset + end))[0]
                state.update(memoryview(data)[first:last])
                count += end - at
        if current is not None:
            yield told()

    return (
        packed.repartition(*keys).sortWithinPartitions(*keys, "ts_ms").select(*keys, "_r")
        .mapInArrow(run, f"{schema}, rows long, rows_sha256 string")
    )


def rows_digest_tree(
    rows: DataFrame, keys: list[str] | None = None, fanout: int = fixed.BLOCK_ROWS, levels: int | None = None
) -> DataFrame:
    """Ordered digest of each series, of any length, as a tree of digests.

    Each level hashes ``fanout`` consecutive digests. Unless given, there are as many
    levels as the longest series needs for its root to gather one block at most.
    """
    keys = keys or SERIES
    if levels is None:
        longest = rows.groupBy(*keys).count().agg(F.max("count")).first()[0] or 1
        levels = max(1, math.ceil(math.log(longest, fanout) - 1e-9) - 1)
    hashed = with_bits(rows).select(
        *keys, "ts_ms", F.sha2(content_text(rows.columns), 256).alias("d")
    )
    numbered = ordered.with_row_number(hashed, keys, ["ts_ms"])
    level = numbered.select(*keys, (F.col("rn") - 1).alias("n"), "d", F.lit(1).alias("size"))

    def gather(df: DataFrame, by: list[str]) -> DataFrame:
        items = F.array_sort(F.collect_list(F.struct("n", "d")))
        text = F.array_join(F.transform(items, lambda x: x["d"]), "")
        return df.groupBy(*by).agg(
            F.sha2(text, 256).alias("d"), F.sum("size").alias("size")
        )

    for _ in range(levels):
        grouped = level.withColumn(
            "up", F.floor(F.col("n") / fanout).cast("bigint")
        )
        level = gather(grouped, [*keys, "up"]).withColumnRenamed("up", "n")
    return gather(level, keys).select(
        *keys, F.col("size").alias("rows"), F.col("d").alias("tree_sha256")
    )


def block_stats(bars: DataFrame, block_rows: int = fixed.BLOCK_ROWS) -> DataFrame:
    """Zone map: first and last time and row count of each block of a series."""
    numbered = ordered.with_row_number(bars.select(*SERIES, "ts_ms"), SERIES, ["ts_ms"])
    block = F.floor((F.col("rn") - 1) / block_rows).cast("bigint")
    return numbered.groupBy(*SERIES, block.alias("block_no")).agg(
        F.min("ts_ms").alias("first_ms"),
        F.max("ts_ms").alias("last_ms"),
        F.count(F.lit(1)).alias("rows"),
    )
