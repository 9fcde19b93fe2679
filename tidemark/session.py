"""Session settings and shared scratch space."""

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import (
    BinaryType,
    BooleanType,
    DatetimeType,
    NumericType,
    StringType,
    StructType,
)

# A side is broadcast only when a count proves it has at most this many rows and bytes;
# sessions may set others under these names.
BROADCAST_ROWS = ("spark.tidemark.broadcastRows", 200_000)
BROADCAST_BYTES = ("spark.tidemark.broadcastBytes", 32 << 20)


def settings(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings the library is designed for; a cluster may override all of them."""
    return (
        builder.config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.parquet.compression.codec", "zstd")
    )


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder below the shared checkpoint folder of the session.

    The cluster names that folder in ``spark.checkpoint.dir``; only on a local master
    (single machine, tests) a temporary folder takes its place where it is unset.
    Folders outlive the query, as its result may still read them; the cluster's
    retention of its checkpoint folder removes them.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if not re.fullmatch(r"local(\[[^\]]*\])?", master):
            raise RuntimeError(f"spark.checkpoint.dir is unset, and {master or 'this master'} has no shared folder")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base.rstrip('/')}/tidemark/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to shared scratch and read it back: cuts lineage durably."""
    path = scratch(df.sparkSession, label)
    df.write.mode("errorifexists").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_bytes(schema: StructType) -> Column:
    """Bytes of a row: fixed widths, and the lengths of texts and nested values."""
    plain = (NumericType, BooleanType, DatetimeType)
    size = F.lit(sum(8 if isinstance(f.dataType, plain) else 24 for f in schema))
    for f in schema:
        value = F.col(f"`{f.name}`")
        if not isinstance(f.dataType, plain):
            text = value if isinstance(f.dataType, (StringType, BinaryType)) else F.to_json(F.struct(value))
            size = size + F.coalesce(F.octet_length(text), F.lit(0))
    return size


def sized(df: DataFrame, max_rows: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """Join side with a strategy chosen by its counted size.

    A table that was exploded is larger than the optimizer believes, so its estimate
    must not decide. Up to ``max_rows`` rows of ``max_bytes`` together are broadcast, which
    spares the other side its shuffle; more are joined by sort and merge. Either way
    gives the same rows.
    """
    conf = df.sparkSession.conf
    rows = max_rows if max_rows is not None else int(conf.get(*map(str, BROADCAST_ROWS)))
    size = max_bytes if max_bytes is not None else int(conf.get(*map(str, BROADCAST_BYTES)))
    counted = df.select(row_bytes(df.schema).alias("b")).limit(rows + 1)
    found = counted.agg(F.count("*").alias("n"), F.coalesce(F.sum("b"), F.lit(0)).alias("b")).first()
    if found.n <= rows and found.b <= size:
        return F.broadcast(df)
    return df.hint("merge")
