"""Bars on disk: immutable Parquet snapshots laid out for pruning.

Layout: ``dataset=/market=/yyyymm=`` folders, files sorted by symbol and time. A
range of one series then reads the folders of its months and, by row-group
statistics, the row groups that hold its symbol and times.
"""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock
from tidemark.operators.snapshot import build_catalog
from tidemark.schemas import BARS, SERIES
from tidemark.session import materialize

PARTITIONS = ["dataset", "market", "yyyymm"]


def write_snapshot(
    bars: DataFrame, path: str, partitions: int | None = None, limit: int = fixed.SNAPSHOT_ROWS
) -> None:
    """Write bars as one sorted snapshot into a new folder.

    Range partitioning by series and time splits a large series over many tasks and
    keeps every file in one short key range; a file has at most ``limit`` rows.
    """
    month = F.coalesce(clock.month_of(F.col("ts_ms"), F.col("market")), F.lit("none"))
    keys = [*PARTITIONS, "symbol", "ts_ms"]
    rows = bars.withColumn("yyyymm", month)
    spread = (
        rows.repartitionByRange(partitions, *keys) if partitions else rows.repartitionByRange(*keys)
    )
    (
        spread.sortWithinPartitions(*keys)
        .write.mode("errorifexists")
        .option("compression", "zstd")
        .option("maxRecordsPerFile", limit)
        .partitionBy(*PARTITIONS)
        .parquet(path)
    )


def write_exact(bars: DataFrame, path: str, declared: DataFrame | None = None, limit: int = fixed.SNAPSHOT_ROWS) -> DataFrame | None:
    """Write bars as one snapshot of files with at most ``limit`` rows and one key range each.

    Every task sorts one key range and cuts it into files. With ``declared`` coverage (as in ``build_catalog``) the catalog
    of the rows that were written is returned.
    """
    write_snapshot(bars, path, limit=limit)
    if declared is None:
        return None
    stored = scan_bars(bars.sparkSession, path, schema=bars.schema.toDDL())
    return materialize(build_catalog(declared, stored.drop("yyyymm")), "catalog")


def stored_files(spark: SparkSession, path: str, schema: str = BARS) -> DataFrame:
    """Rows and key range of every file of a snapshot."""
    key = F.struct("symbol", "ts_ms")
    return scan_bars(spark, path, schema=schema).groupBy(
        *PARTITIONS, F.input_file_name().alias("file")
    ).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("first"), F.max(key).alias("last"))


def scan_bars(
    spark: SparkSession,
    path: str,
    start_ms: int | None = None,
    end_ms: int | None = None,
    symbols: list[str] | None = None,
    schema: str = BARS,
) -> DataFrame:
    """Bars of a snapshot in ``[start_ms, end_ms)`` on the stored time axis."""
    df = spark.read.schema(f"{schema}, yyyymm STRING").parquet(path)
    if start_ms is not None:
        first = clock.month_of(F.lit(start_ms).cast("bigint"), F.lit("US"))
        df = df.where((F.col("yyyymm") >= first) & (F.col("ts_ms") >= start_ms))
    if end_ms is not None:
        # One offset later is the latest local month any market can be in.
        last = clock.month_of(
            F.lit(end_ms - 1 + fixed.CN_OFFSET_MS).cast("bigint"), F.lit("US")
        )
        df = df.where((F.col("yyyymm") <= last) & (F.col("ts_ms") < end_ms))
    if symbols is not None:
        df = df.where(F.col("symbol").isin(symbols))
    return df


def scan_series(bars: DataFrame, series: DataFrame) -> DataFrame:
    """Bars of the series listed in a table."""
    return bars.join(series.select(*SERIES), SERIES, "left_semi")
