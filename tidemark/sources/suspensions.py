"""Confirmed trading suspensions; anything unconfirmed goes to quarantine."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions.documents import strict_json_doc
from tidemark.functions.identity import full_match
from tidemark.schemas import SUSPENSION_DOC


def check_intervals(df: DataFrame) -> DataFrame:
    """Add ``problem``: NULL for an interval that may hide placeholders."""
    last = fixed.MAX_INSTANT_MS - fixed.CN_OFFSET_MS
    problem = (
        F.when(~F.coalesce(full_match(F.col("symbol"), fixed.STOCK_SYMBOL), F.lit(False)), "symbol")
        .when(
            ~F.coalesce(
                (F.col("start_ms") > 0)
                & (F.col("start_ms") < F.col("end_ms"))
                & (F.col("end_ms") <= last),
                F.lit(False),
            ),
            "bounds",
        )
        .when(~F.coalesce(F.col("evidence").rlike(r"[^ \t\n\r\f\x0B]"), F.lit(False)), "evidence")
    )
    return df.withColumn("problem", problem)


def scan_suspensions(spark: SparkSession, path: str) -> DataFrame:
    """Intervals of policy documents stored one per line, with ``problem``."""
    docs = strict_json_doc(spark.read.text(path), "value", SUSPENSION_DOC)
    bad = F.when(
        F.col("problem").isNotNull()
        | (F.col("doc.schema_version") != 1)
        | (F.col("doc.policy") != fixed.SUSPENSION_POLICY),
        F.coalesce("problem", F.lit("policy")),
    )
    rows = docs.select(bad.alias("_doc"), F.explode_outer("doc.intervals").alias("i"))
    checked = check_intervals(rows.select("_doc", "i.*"))
    return checked.withColumn("problem", F.coalesce("_doc", "problem")).drop("_doc")
