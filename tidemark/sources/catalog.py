"""Coverage catalogs: manifests as JSON documents, generations as a table."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import identity
from tidemark.functions.documents import strict_json_doc
from tidemark.schemas import CATALOG, MANIFEST_DOC

NAMESPACED = CATALOG + ", namespace STRING"


def manifest_text(catalog: DataFrame) -> DataFrame:
    """One manifest document per epoch and generation, entries in catalog order.

    A manifest is metadata: one document per publication of one namespace.
    """
    item = F.struct(
        F.struct("dataset", "market", "symbol", "period_seconds", "adjust").alias("identity"),
        "series_id",
        "data_version",
        "source_version",
        F.col("cov_start").alias("coverage_start_ms"),
        F.col("cov_end").alias("coverage_end_ms"),
        F.lit(True).alias("coverage_complete"),
        F.col("row_count").alias("rows"),
        F.when(F.col("nullable_prices"), fixed.NULL_PRICE_MARK).alias("price_null_encoding"),
        F.when(
            F.col("row_count") > 0,
            F.struct(
                (F.col("row_count") * 64).alias("bytes"),
                F.col("content_hash").alias("index_sha256"),
                identity.content_key(F.col("content_hash")).alias("key"),
                F.col("content_hash").alias("sha256"),
            ),
        ).alias("object"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("series_id", "cov_start", item.alias("e"))))
    keys = ["namespace", "epoch", "generation"]
    return catalog.groupBy(*keys).agg(
        F.to_json(
            F.struct(
                F.lit(1).alias("schema_version"),
                F.lit(fixed.KIND_MANIFEST).alias("kind"),
                F.col("epoch").alias("dataset_epoch"),
                F.transform(ordered, lambda x: x["e"]).alias("entries"),
            )
        ).alias("value")
    )


def read_manifests(docs: DataFrame, generation: str = "generation") -> DataFrame:
    """Catalog rows of manifest documents; a bad document is one row with ``problem``.

    ``docs`` has the text in ``value`` and the publication sequence in ``generation``.
    """
    parsed = strict_json_doc(
        docs, "value", MANIFEST_DOC, frozenset(["price_null_encoding", "object"])
    )
    bad = F.when(
        (F.col("doc.schema_version") != 1) | (F.col("doc.kind") != fixed.KIND_MANIFEST),
        "unsupported",
    )
    parsed = parsed.withColumn("problem", F.coalesce("problem", bad))
    rows = parsed.select(
        generation, "problem", "doc.dataset_epoch", F.explode_outer("doc.entries").alias("e")
    )
    entry_problem = F.when(
        F.col("e.series_id")
        != identity.series_id(
            F.col("e.identity.dataset"),
            F.col("e.identity.market"),
            F.col("e.identity.symbol"),
            F.col("e.identity.period_seconds"),
            F.col("e.identity.adjust"),
        ),
        "series_id",
    ).when(~F.col("e.coverage_complete"), "partial_coverage")
    return rows.select(
        "e.identity.dataset",
        "e.identity.market",
        "e.identity.symbol",
        "e.identity.period_seconds",
        "e.identity.adjust",
        "e.series_id",
        "e.data_version",
        "e.source_version",
        F.col("e.coverage_start_ms").alias("cov_start"),
        F.col("e.coverage_end_ms").alias("cov_end"),
        F.col("e.rows").alias("row_count"),
        F.col("e.object.sha256").alias("content_hash"),
        F.col("e.price_null_encoding").isNotNull().alias("nullable_prices"),
        F.col("dataset_epoch").alias("epoch"),
        F.col(generation).cast("decimal(20,0)").alias("generation"),
        F.coalesce("problem", entry_problem).alias("problem"),
    )


def scan_catalog(
    spark: SparkSession, path: str, generation: int | None = None, min_seq: int = 0
) -> DataFrame:
    """Catalog table pinned to one generation per namespace, newest unless named.

    ``refused`` marks namespaces whose generation lies below ``min_seq``; readers
    keep the snapshot they are pinned to while newer ones appear.
    """
    table = spark.read.schema(NAMESPACED).parquet(path)
    if generation is not None:
        pinned = table.where(F.col("generation") == F.lit(generation).cast("decimal(20,0)"))
    else:
        newest = table.groupBy("namespace").agg(F.max("generation").alias("generation"))
        pinned = table.join(newest, ["namespace", "generation"], "left_semi")
    return pinned.withColumn("refused", F.col("generation") < min_seq)
