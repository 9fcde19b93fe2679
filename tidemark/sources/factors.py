"""Factor documents: one set per document, its events as rows.

A set is one document with its rows, or comes in two parts: a reference with the time and proof of an observation, and
a data document, named by the SHA-256 and the length of its bytes, that all observations without a change share.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock, identity, numbers
from tidemark.functions.documents import differing_field, strict_json_doc
from tidemark.schemas import FACTOR_DATA_DOC, FACTOR_DOC, FACTOR_REFERENCE_DOC
from tidemark.session import materialize

# Events of each model use their own row fields; the field check allows either set.
ROW_FIELDS = frozenset(
    [
        "ex_date",
        "ex_factor",
        "cum_factor",
        "ex_div_date",
        "forward_adj_factorA",
        "forward_adj_factorB",
        "backward_adj_factorA",
        "backward_adj_factorB",
    ]
)


CHECK_FIELDS = frozenset(["verification"])
# What a data document shares with its references.
SHARED_FIELDS = [
    "algorithm", "symbol", "market", "model", "first_day", "end_day", "coverage_complete", "allow_empty", "source_epoch",
    "date_encoding",
]


def factor_rows(factors: DataFrame) -> DataFrame:
    """Rows of the documents of cumulative factors (one event per day and symbol)."""
    return factors.groupBy("symbol", "market").agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("day").alias("ex_date"),
                    F.col("symbol").alias("code"),
                    F.col("cum").alias("ex_factor"),
                    F.col("cum").alias("cum_factor"),
                    F.lit(0).cast("bigint").alias("update_time"),
                )
            )
        ).alias("rows")
    )


def factor_text(sets: DataFrame, factors: DataFrame) -> DataFrame:
    """Documents of cumulative factor sets with their rows."""
    rows = factor_rows(factors)
    doc = F.struct(
        F.lit(1).alias("schema_version"),
        F.lit(fixed.KIND_FACTORS).alias("kind"),
        F.lit(fixed.FACTOR_ALGORITHM).alias("algorithm"),
        "symbol",
        "market",
        "model",
        "first_day",
        "end_day",
        F.col("complete").alias("coverage_complete"),
        "allow_empty",
        "observed_at_ms",
        "valid_until_ms",
        "source_epoch",
        F.col("source_receipt_sha256").alias("source_proof_sha256"),
        F.lit(fixed.FACTOR_DATES).alias("date_encoding"),
        F.coalesce("rows", F.from_json(F.lit("[]"), rows.schema["rows"].dataType)).alias("rows"),
    )
    return sets.join(rows, ["symbol", "market"], "left").select(F.to_json(doc).alias("value"))


def scan_factors(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(factor sets with ``problem``, events) of documents stored one per line."""
    return read_factors(spark.read.text(path))


def _size_problem() -> Column:
    return F.when(F.octet_length("value") > fixed.MAX_FACTOR_BYTES, "too_large")


def _is_cumulative() -> Column:
    return F.col("doc.model") == fixed.MODEL_CUMULATIVE


def _is_checked() -> Column:
    return F.col("doc.kind").isin(fixed.KIND_FACTORS_CHECKED, fixed.KIND_FACTOR_REFERENCE_CHECKED)


def _set_problem(kinds: dict[str, int]) -> Column:
    """First problem of what a set says of itself; ``kinds`` are the documents wanted, with their schema versions."""
    model_market = (_is_cumulative() & F.col("doc.market").isin(fixed.STOCK_MARKETS)) | (
        (F.col("doc.model") == fixed.MODEL_AFFINE) & (F.col("doc.market") == "US")
    )
    version = F.coalesce(
        *[F.when(F.col("doc.kind") == k, F.col("doc.schema_version") == v) for k, v in kinds.items()], F.lit(False)
    )
    return (
        F.when(
            ~version
            | (F.col("doc.algorithm") != fixed.FACTOR_ALGORITHM)
            | (F.col("doc.date_encoding") != fixed.FACTOR_DATES),
            "unsupported",
        )
        .when(~F.col("doc.coverage_complete"), "incomplete")
        .when(~model_market, "model")
        .when(~F.length("doc.source_epoch").between(1, fixed.MAX_EPOCH), "epoch")
        .when(
            (F.col("doc.first_day") < fixed.FIRST_CIVIL_DAY)
            | (F.col("doc.first_day") >= F.col("doc.end_day"))
            | (F.col("doc.end_day") > fixed.LAST_CIVIL_DAY),
            "window",
        )
    )


def _observation_problem() -> Column:
    """First problem of the time, proof and scheduled check of an observation."""
    observed, until = F.col("doc.observed_at_ms"), F.col("doc.valid_until_ms")
    longest = F.when(_is_checked(), fixed.MAX_CHECK_GAP_DAYS * fixed.DAY_MS).otherwise(fixed.DAY_MS)
    names = {"next_day": "next_trading_day", "completed_ms": "source_completed_at_ms"}
    check = F.col("doc.verification")
    digests = ["calendar_sha256", "config_sha256", "workload_sha256", "source_receipt_sha256"]
    vouched = F.coalesce(
        F.when(check["next_check_ms"] != until, "deadline"),
        clock.check_problem(lambda n: check[names.get(n, n)], F.col("doc.market"), observed, until),
        *[F.when(~F.coalesce(identity.is_digest(check[d]), F.lit(False)), "digest") for d in digests],
    )
    return (
        F.when((observed <= 0) | (observed >= until) | (until - observed > longest), "validity")
        .when(~identity.is_digest(F.col("doc.source_proof_sha256")), "proof")
        .when(_is_checked() != check.isNotNull(), "check")
        .when(_is_checked() & vouched.isNotNull(), F.concat(F.lit("check_"), vouched))
    )


def _day(r: Column) -> Column:
    return F.when(_is_cumulative(), r["ex_date"]).otherwise(r["ex_div_date"])


def _rows_problem() -> Column:
    """First problem of the rows of a set."""
    cumulative, rows = _is_cumulative(), F.col("doc.rows")
    day = F.transform(rows, _day)
    carry_days = F.size(F.array_distinct(F.filter(day, lambda d: d < F.col("doc.first_day"))))
    # Revisions of one day follow each other in time; the last one counts.
    place = F.sequence(F.lit(1), F.greatest(F.size(rows) - 1, F.lit(1)))
    disorder = (F.size(rows) > 1) & F.exists(
        place,
        lambda i: (F.get(day, i) < F.get(day, i - 1))
        | (
            (F.get(day, i) == F.get(day, i - 1))
            & (F.get(rows, i)["update_time"] <= F.get(rows, i - 1)["update_time"])
        ),
    )

    def positive(x: Column) -> Column:
        return numbers.finite(x) & (x > 0)

    def offset(x: Column) -> Column:
        return F.coalesce(numbers.finite(x), F.lit(True))

    bad_values = F.exists(
        rows,
        lambda r: ~F.coalesce(
            F.when(
                cumulative,
                r["ex_date"].isNotNull() & positive(r["cum_factor"]) & positive(r["ex_factor"]),
            ).otherwise(
                r["ex_div_date"].isNotNull()
                & positive(r["forward_adj_factorA"])
                & positive(r["backward_adj_factorA"])
                & offset(r["forward_adj_factorB"])
                & offset(r["backward_adj_factorB"])
            ),
            F.lit(False),
        )
        | (r["code"] != F.col("doc.symbol"))
        | (r["update_time"] < 0),
    ) | F.exists(day, lambda d: ~d.between(fixed.FIRST_CIVIL_DAY, fixed.LAST_CIVIL_DAY))
    return (
        F.when((F.size(rows) == 0) & ~F.col("doc.allow_empty"), "empty")
        .when(F.size(rows) > fixed.MAX_FACTOR_EVENTS, "rows")
        .when(bad_values, "row_value")
        .when(disorder, "row_order")
        .when(
            cumulative
            & ((carry_days > 1) | F.exists(day, lambda d: d >= F.col("doc.end_day"))),
            "row_window",
        )
    )


def _events(checked: DataFrame, *keys: str) -> DataFrame:
    """Last revision of every day of the good documents."""
    rows = F.col("doc.rows")
    last = F.filter(rows, lambda r, i: (i == F.size(rows) - 1) | (_day(r) != _day(F.get(rows, i + 1))))
    return (
        checked.where("problem is null")
        .select(*keys, "doc.symbol", "doc.market", "doc.model", F.explode(last).alias("r"))
        .select(
            *keys,
            "symbol",
            "market",
            "model",
            F.coalesce("r.ex_date", "r.ex_div_date").alias("day"),
            F.col("r.cum_factor").alias("cum"),
            F.col("r.forward_adj_factorA").alias("fa"),
            F.coalesce("r.forward_adj_factorB", F.lit(0.0)).alias("fb"),
            F.col("r.backward_adj_factorA").alias("ba"),
            F.coalesce("r.backward_adj_factorB", F.lit(0.0)).alias("bb"),
            F.col("r.update_time").alias("update_ms"),
        )
    )


def read_factors(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(factor sets with ``problem``, events) of documents that hold their rows, as text in ``value``."""
    # Parsed and judged documents are written: rules, sets and events would each parse and judge them again.
    parsed = materialize(strict_json_doc(docs.select("value"), "value", FACTOR_DOC, ROW_FIELDS | CHECK_FIELDS), "documents")
    kinds = {fixed.KIND_FACTORS: 1, fixed.KIND_FACTORS_CHECKED: 3}
    problem = F.coalesce(_size_problem(), "problem", _set_problem(kinds), _observation_problem(), _rows_problem())
    checked = materialize(parsed.withColumn("problem", problem), "judged")
    sets = checked.select(
        "doc.symbol",
        "doc.market",
        "doc.model",
        "doc.first_day",
        "doc.end_day",
        "doc.allow_empty",
        "doc.observed_at_ms",
        "doc.valid_until_ms",
        "doc.source_epoch",
        F.sha2("value", 256).alias("data_hash"),
        "problem",
    )
    return sets, _events(checked)


def resolve_factors(
    references: DataFrame, data: DataFrame, now_ms: int | None = None, fresh: bool = False, published: bool = False
) -> tuple[DataFrame, DataFrame]:
    """(factor sets with ``problem``, events by ``data_hash``) of documents in two parts.

    Both tables hold documents as text in ``value``; a column ``sha256`` of the references, if there is one, is the hash under
    which each is listed. A reference meets the data document whose bytes have the hash that it names; all references
    to one document share its events, which are parsed and judged once. References keep one row each, whatever
    their problem; copies of a data document are one. ``now_ms`` refuses sets observed later, and with ``fresh`` those no longer
    valid. ``version`` is the hash of the data for scheduled or ``published`` sets, else that of the reference.
    """
    listed = F.col("sha256") if "sha256" in references.columns else F.sha2("value", 256)
    # Parsed documents are written, so that rules read their fields and do not parse them again.
    asked = strict_json_doc(
        references.select("value", listed.alias("listed")), "value", FACTOR_REFERENCE_DOC, CHECK_FIELDS
    )
    asked = materialize(asked, "references")
    kinds = {fixed.KIND_FACTOR_REFERENCE: 2, fixed.KIND_FACTOR_REFERENCE_CHECKED: 3}
    timely = F.lit(None).cast("string")
    if now_ms is not None:
        expired = F.lit(fresh) & (F.col("doc.valid_until_ms") <= now_ms)
        timely = F.when(F.col("doc.observed_at_ms") > now_ms, "future-dated").when(expired, "expired")
    named = F.when(
        ~F.coalesce(identity.is_digest(F.col("doc.factor_data_sha256")) & (F.col("doc.factor_data_bytes") > 0), F.lit(False)),
        "data_reference",
    )
    problem = F.coalesce(
        F.when(F.col("listed") != F.sha2("value", 256), "digest"), _size_problem(), "problem", _set_problem(kinds), _observation_problem(), timely, named,
    )
    asked = materialize(asked.withColumn("problem", problem), "judged").withColumn("wanted", F.col("doc.factor_data_sha256"))
    # Copies combine before their shuffle, and rows stay behind: references only meet what identifies their data.
    held = data.select(F.sha2("value", 256).alias("data_hash"), "value").groupBy("data_hash").agg(F.first("value").alias("value"))
    held = materialize(strict_json_doc(held, "value", FACTOR_DATA_DOC, ROW_FIELDS), "data").withColumn("bytes", F.octet_length("value"))
    judged = F.coalesce(_size_problem(), "problem", _set_problem({fixed.KIND_FACTOR_DATA: 2}), _rows_problem())
    held = materialize(held.withColumn("problem", judged), "judged")
    known = held.select("data_hash", "bytes", F.struct(*[F.col("doc")[n].alias(n) for n in SHARED_FIELDS]).alias("of"), F.col("problem").alias("data_problem"))
    joined = asked.join(known, F.col("wanted") == F.col("data_hash"), "left")
    differs = differing_field(F.col("doc"), F.col("of"), SHARED_FIELDS)
    problem = F.coalesce(
        "problem",
        F.when(F.col("data_hash").isNull(), "data_missing"),
        F.when(F.col("bytes") != F.col("doc.factor_data_bytes"), "data_length"),
        F.when(F.col("data_problem").isNotNull(), F.concat(F.lit("data_"), F.col("data_problem"))),
        F.when(differs.isNotNull(), F.concat(F.lit("data_differs_"), differs)),
    )
    sets = joined.select(
        "doc.symbol", "doc.market", "doc.model", "doc.first_day", "doc.end_day", "doc.allow_empty", "doc.observed_at_ms",
        "doc.valid_until_ms", "doc.source_epoch", F.col("doc.verification.source_revision").alias("source_revision"),
        F.col("listed").alias("reference"), F.col("wanted").alias("data_hash"),
        F.when(_is_checked() | F.lit(published), F.col("wanted")).otherwise(F.col("listed")).alias("version"),
        problem.alias("problem"),
    )
    return sets, _events(held, "data_hash")


def split_documents(sets: DataFrame, factors: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(references, data documents) of cumulative sets: the two parts that ``resolve_factors`` joins.

    A set with the fields of a check (a struct ``verification``, not null) gets a scheduled reference.
    """
    rows = factor_rows(factors)
    identity_of = [
        F.lit(2).alias("schema_version"), F.lit(fixed.KIND_FACTOR_DATA).alias("kind"),
        F.lit(fixed.FACTOR_ALGORITHM).alias("algorithm"), "symbol", "market", "model", "first_day", "end_day",
        F.col("complete").alias("coverage_complete"), "allow_empty", "source_epoch", F.lit(fixed.FACTOR_DATES).alias("date_encoding"),
    ]
    none = F.from_json(F.lit("[]"), rows.schema["rows"].dataType)
    whole = sets.join(rows, ["symbol", "market"], "left").withColumn("rows", F.coalesce("rows", none))
    whole = whole.withColumn("_data", F.to_json(F.struct(*identity_of, "rows")))
    checked = F.col("verification").isNotNull()
    head = [
        F.when(checked, 3).otherwise(2).alias("schema_version"),
        F.when(checked, fixed.KIND_FACTOR_REFERENCE_CHECKED).otherwise(fixed.KIND_FACTOR_REFERENCE).alias("kind"),
        *identity_of[2:], "observed_at_ms", "valid_until_ms", F.col("source_receipt_sha256").alias("source_proof_sha256"),
        F.sha2("_data", 256).alias("factor_data_sha256"), F.octet_length("_data").cast("long").alias("factor_data_bytes"),
        "verification",
    ]
    references = whole.select("symbol", F.to_json(F.struct(*head)).alias("value"))
    data = whole.select("symbol", F.col("_data").alias("value")).distinct()
    return references, data
