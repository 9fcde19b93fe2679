"""Deterministic bars for drills and tests."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START_MS = 1704067200000


def synthetic_bars(series: DataFrame, rows: str = "n") -> DataFrame:
    """``n`` bars for each series row, by a fixed rule of the bar number.

    Numbers are made in chunks, so that one long series spreads over many tasks.
    """
    chunk = 65536
    chunks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col(rows) - 1) / chunk))
    first = F.col("_chunk") * chunk
    last = F.least(first + chunk, F.col(rows)) - 1
    i = F.col("i")
    keys = [c for c in series.columns if c != rows]
    price = 100.0 + (i % 1000) * 0.125
    return (
        series.where(F.col(rows) > 0)
        .withColumn("_chunk", F.explode(chunks))
        .repartition(*keys, "_chunk")
        .withColumn("i", F.explode(F.sequence(first, last)))
        .withColumns(
            {
                "ts_ms": START_MS + i * 60000,
                "open": price,
                "high": price + 1.0,
                "low": price - 1.0,
                "close": price + 0.5,
                "volume": i * 17 + 1,
            }
        )
        .drop("_chunk", "i", rows)
    )
