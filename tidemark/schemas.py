"""Declared schemas as DDL text; nothing in the library infers one."""

from pyspark.sql.types import StructType


def as_struct(schema: str | StructType) -> StructType:
    """StructType of a declared schema (parsing needs a running session)."""
    return StructType.fromDDL(schema) if isinstance(schema, str) else schema


SERIES = ["dataset", "market", "symbol"]

BARS = (
    "dataset STRING, market STRING, symbol STRING, ts_ms BIGINT, "
    "open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE, volume BIGINT, "
    "turnover DOUBLE, open_interest BIGINT, open_oi BIGINT, close_oi BIGINT"
)

CATALOG = (
    "dataset STRING, market STRING, symbol STRING, period_seconds INT, adjust STRING, "
    "series_id STRING, data_version STRING, source_version DECIMAL(20,0), "
    "cov_start BIGINT, cov_end BIGINT, row_count BIGINT, content_hash STRING, "
    "nullable_prices BOOLEAN, epoch STRING, generation DECIMAL(20,0), tier STRING"
)

# One manifest document per line; unknown fields are caught by strict_json_doc.
MANIFEST_DOC = (
    "schema_version INT, kind STRING, dataset_epoch STRING, entries ARRAY<STRUCT<"
    "identity: STRUCT<dataset: STRING, market: STRING, symbol: STRING, "
    "period_seconds: INT, adjust: STRING>, series_id: STRING, data_version: STRING, "
    "source_version: DECIMAL(20,0), coverage_start_ms: BIGINT, coverage_end_ms: BIGINT, "
    "coverage_complete: BOOLEAN, rows: BIGINT, price_null_encoding: STRING, "
    "object: STRUCT<bytes: BIGINT, index_sha256: STRING, key: STRING, sha256: STRING>>>"
)

_FACTOR_SET = (
    "schema_version INT, kind STRING, algorithm STRING, symbol STRING, market STRING, "
    "model STRING, first_day INT, end_day INT, coverage_complete BOOLEAN, allow_empty BOOLEAN, "
    "source_epoch STRING, date_encoding STRING"
)
_FACTOR_ROWS = (
    "rows ARRAY<STRUCT<code: STRING, ex_date: INT, ex_factor: DOUBLE, cum_factor: DOUBLE, "
    "ex_div_date: INT, forward_adj_factorA: DOUBLE, forward_adj_factorB: DOUBLE, "
    "backward_adj_factorA: DOUBLE, backward_adj_factorB: DOUBLE, update_time: BIGINT>>"
)
_FACTOR_CHECK = (
    "verification STRUCT<policy: STRING, exchange: STRING, calendar_sha256: STRING, trading_day: INT, "
    "next_trading_day: INT, check_minute: INT, source_revision: BIGINT, source_completed_at_ms: BIGINT, "
    "next_check_ms: BIGINT, config_sha256: STRING, workload_sha256: STRING, source_receipt_sha256: STRING>"
)
_FACTOR_OBSERVED = "observed_at_ms BIGINT, valid_until_ms BIGINT, source_proof_sha256 STRING"

# A factor set with its rows; or a reference that names its data document, and that document. Only
# documents of a scheduled check have a verification.
FACTOR_DOC = f"{_FACTOR_SET}, {_FACTOR_OBSERVED}, {_FACTOR_CHECK}, {_FACTOR_ROWS}"
FACTOR_REFERENCE_DOC = (
    f"{_FACTOR_SET}, {_FACTOR_OBSERVED}, {_FACTOR_CHECK}, factor_data_sha256 STRING, factor_data_bytes BIGINT"
)
FACTOR_DATA_DOC = f"{_FACTOR_SET}, {_FACTOR_ROWS}"

SUSPENSION_DOC = (
    "schema_version INT, policy STRING, intervals ARRAY<STRUCT<"
    "symbol: STRING, start_ms: BIGINT, end_ms: BIGINT, evidence: STRING>>"
)
