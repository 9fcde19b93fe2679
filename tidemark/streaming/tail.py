"""The intraday tail: bars arrive during the day and are appended once each."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from tidemark.functions import clock
from tidemark.operators.snapshot import build_catalog
from tidemark.schemas import SERIES
from tidemark.session import materialize


PLACE = ["market", "yyyymmdd"]


def _exists(spark: SparkSession, folder: str) -> bool:
    place = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)


def run_intraday_tail(
    stream: DataFrame,
    path: str,
    checkpoint: str,
    delay_ms: int = 7200000,
    trigger: dict | None = None,
) -> list[StreamingQuery]:
    """Append each bar of the stream once to ``path/bars``; late bars to ``path/late``.

    A bar is late when it arrives (``arrived_ms``) more than the delay after its own
    minute. Late revisions never reach the tail: like every change of published rows
    they need a new generation. Nothing is dropped for its age: a micro-batch is compared
    with the rows stored for its own (market, day) folders, and lists and reads only these, so files may come in any
    order, after a restart or a backfill too, and a month of stored days costs a micro-batch nothing. Of several arrivals of one bar
    in a micro-batch the earliest counts; equal late rows are stored once.

    A micro-batch owns one folder ``batch=`` in each of its days and overwrites it, so a batch that is repeated
    after a failure leaves the same rows.
    """
    trigger = trigger or {"availableNow": True}
    spark = stream.sparkSession
    day = clock.day_date(clock.stored_day(F.col("ts_ms"), F.col("market")))
    kept = [c for c in stream.columns if c not in PLACE]
    bar = [*SERIES, "ts_ms"]
    keys = {"bars": bar, "late": [c for c in stream.columns if c != "arrived_ms"]}
    stored = StructType([*stream.schema.fields]).add("yyyymmdd", "string").add("batch", "long")

    def write(batch: DataFrame, batch_id: int) -> None:
        dated = batch.withColumn("yyyymmdd", F.date_format(day, "yyyyMMdd"))
        late = F.col("arrived_ms") - F.col("ts_ms") > delay_ms
        for name, rows in (("bars", dated.where(~late)), ("late", dated.where(late))):
            by = [*keys[name], "yyyymmdd"]
            rest = [c for c in dated.columns if c not in by]
            first = F.min(F.struct("arrived_ms", *[c for c in rest if c != "arrived_ms"])).alias("_f")
            once = rows.groupBy(*by).agg(first).select(*by, *[F.col("_f")[c].alias(c) for c in rest])
            once = materialize(once, "arrived")
            days = [(r.market, r.yyyymmdd) for r in once.select(*PLACE).distinct().collect()]
            folders = [f"{path}/{name}/market={m}/yyyymmdd={d}" for m, d in days]
            held = [folder for folder in folders if _exists(spark, folder)]
            if held:
                read = spark.read.schema(stored).option("basePath", f"{path}/{name}")
                seen = read.parquet(*held).where(F.col("batch") != batch_id)
                same = [once[c].eqNullSafe(seen[c]) for c in by]
                once = once.join(seen.select(*by), same, "left_anti")
            (
                once.select(*kept, *PLACE, F.lit(batch_id).cast("long").alias("batch"))
                .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
                .partitionBy(*PLACE, "batch")
                .parquet(f"{path}/{name}")
            )

    query = (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )
    return [query]


def tail_catalog(bars: DataFrame, declared: DataFrame) -> DataFrame:
    """Intraday catalog entries of declared coverage (never inferred from bars)."""
    return build_catalog(declared, bars).withColumn("tier", F.lit("intraday"))
