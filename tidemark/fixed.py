"""Fixed values of the archive format.

They have to be exactly these for ids, digests and documents written by other
tools to be read here with the same result.
"""

# Datasets, the row encoding each one is served in and its record width in bytes.
DATASET_LEGACY = "ddb-history-snapshot"
DATASET_COMPLETE = "ddb-history-kline48"
DATASET_NATIVE = "ddb-history-native64"
ENCODING_LEGACY = "le-i64-f32x4-i64-v1"
ENCODING_COMPLETE = "le-kline48-v1"
ENCODING_NATIVE = "le-ddb-native64-v1"
DATASET_OF_ENCODING = {
    ENCODING_LEGACY: DATASET_LEGACY,
    ENCODING_COMPLETE: DATASET_COMPLETE,
    ENCODING_NATIVE: DATASET_NATIVE,
}
RECORD_BYTES = {ENCODING_LEGACY: 32, ENCODING_COMPLETE: 48, ENCODING_NATIVE: 64}

# Identity text that is hashed into a series id.
SERIES_PREFIX = "history-series-v1\n"
PERIOD_SECONDS = 60
ADJUST_NONE = "none"
MAX_PERIOD_SECONDS = 31536000
MAX_TOKEN = 128

# Clock limits, milliseconds.
DAY_MS = 86400000
CN_OFFSET_MS = 28800000
MAX_INSTANT_MS = 32503680000000
MAX_SPAN_DAYS = 366
FIRST_CIVIL_DAY = -25567
LAST_CIVIL_DAY = 47847

# Largest answer, and rows in one block of the zone map.
MAX_ANSWER_ROWS = 5000
BLOCK_ROWS = 1024
SNAPSHOT_ROWS = 500000

# NULL price in binary records, and the largest price a client record can hold.
NULL_PRICE = -1.7976931348623157e308
FLOAT_MAX = 3.4028234663852886e38

# Markets.
STOCK_MARKETS = ["SH", "SZ", "HK"]
DERIVATIVE_MARKETS = ["SHF", "CFE", "CZC", "DCE", "INE"]
ADJUSTABLE_MARKETS = ["SH", "SZ", "HK", "US"]

# Symbol patterns (whole text must match).
OPTION_SYMBOL = r"AP[0-9]{3}[CP][0-9]{1,8}\.CZC"
STOCK_SYMBOL = r"[0-9]{6}\.(SH|SZ)"
HK_SYMBOL = r"[0-9]{5}\.HK"
FUTURE_SYMBOL = r"[A-Za-z]{1,3}[0-9]{3,4}\.(SHF|CFE|CZC|DCE|INE)"
US_SYMBOL = r"[A-Za-z][A-Za-z0-9.\-]{0,15}"
STOCK_PREFIX = r"[0-9]{5,6}"
DERIVATIVE_PREFIX = r"[A-Za-z]{1,3}[0-9]{3,4}((C|P|-C-|-P-)[0-9]{1,8})?"
TOKEN = r"[A-Za-z0-9._-]{1,128}"
UPPER_TOKEN = r"[A-Z0-9._-]{1,128}"

# Content-addressed keys.
DATA_KEY_PREFIX = "data/v1/"
DATA_KEY_SUFFIX = ".r2b"
MANIFEST_KEY_PREFIX = "manifests/v1/"
MANIFEST_KEY_SUFFIX = ".json"

# Adjustment models and the market each one serves.
MODEL_CUMULATIVE = "cumulative"
MODEL_AFFINE = "futu_ab"

# Exchange codes and check minutes of the factor calendar.
EXCHANGES = {"SH": "XSHG", "SZ": "XSHE", "HK": "XHKG", "US": "XNYS"}
POLICY_END_OF_DAY = "market-eod-check-v1"
POLICY_SOURCE = "market-source-check-v1"
MAX_CHECK_GAP_DAYS = 16

# New York: UTC offsets in use since 1970, and the end of the explicit table.
NEW_YORK = "America/New_York"
NEW_YORK_OFFSETS_MS = [-18000000, -14400000]
NEW_YORK_TABLE_END_MS = 2140668000000

# Alert delivery.
REMINDER_S = 3600
COOLDOWN_S = 300
HOURLY_CAP = 4
DAILY_CAP = 48
SOFT_CODES = ["agent_restarted", "backup_acceptance_pending", "deployment_archive_required"]
CLOCK_CODE = "monitor_clock_regressed"

# Metadata documents.
KIND_MANIFEST = "complete-interval-snapshot"
NULL_PRICE_MARK = "ddb-double-null-v1"
KIND_FACTORS = "ddb-adjustment-snapshot-v1"
KIND_FACTORS_CHECKED = "ddb-adjustment-snapshot-v3"
KIND_FACTOR_REFERENCE = "ddb-adjustment-reference-v2"
KIND_FACTOR_REFERENCE_CHECKED = "ddb-adjustment-reference-v3"
KIND_FACTOR_DATA = "ddb-adjustment-data-v2"
MAX_FACTOR_EVENTS = 20000
MAX_FACTOR_BYTES = 524288
MAX_EPOCH = 128
FACTOR_ALGORITHM = "upcloud-adjustment-v1"
FACTOR_DATES = "exchange-civil-days-since-1970"
PROOF_CONTRACT = "ddb-single-chunk-guard-v1"
DATABASE_SCHEME = "dfs://"
MAX_PARTITION_PATH = 512
SUSPENSION_POLICY = "a-share-null-placeholder-v1"
