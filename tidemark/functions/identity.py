"""Series identity, symbols, digests and content keys as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def full_match(col: Column, pattern: str) -> Column:
    return col.rlike(r"\A(?:" + pattern + r")\z")


def identity_text(
    dataset: Column, market: Column, symbol: Column, period: Column, adjust: Column
) -> Column:
    """Length-prefixed identity text; the input of ``series_id``."""
    fields = [dataset, market, symbol, period.cast("string"), adjust]
    parts = [
        F.concat(F.octet_length(f).cast("string"), F.lit(":"), f, F.lit("\n")) for f in fields
    ]
    return F.concat(F.lit(fixed.SERIES_PREFIX), *parts)


def series_id(
    dataset: Column,
    market: Column,
    symbol: Column,
    period: Column | None = None,
    adjust: Column | None = None,
) -> Column:
    """First 128 bits of the SHA-256 of the identity text, as 32 hex characters."""
    period = F.lit(fixed.PERIOD_SECONDS) if period is None else period
    adjust = F.lit(fixed.ADJUST_NONE) if adjust is None else adjust
    text = identity_text(dataset, market, symbol, period, adjust)
    return F.substring(F.sha2(text, 256), 1, 32)


def identity_problem(
    dataset: Column, market: Column, symbol: Column, period: Column, adjust: Column
) -> Column:
    """Name of the first field outside its domain, NULL for a valid identity."""

    def bad(col: Column, pattern: str) -> Column:
        return col.isNull() | ~full_match(col, pattern) | col.isin(".", "..")

    return (
        F.when(bad(dataset, fixed.TOKEN), "dataset")
        .when(bad(market, fixed.UPPER_TOKEN), "market")
        .when(bad(symbol, fixed.TOKEN), "symbol")
        .when(~F.coalesce(period.between(1, fixed.MAX_PERIOD_SECONDS), F.lit(False)), "period")
        .when(
            ~F.coalesce(adjust.isin("none", "forward", "backward"), F.lit(False)), "adjust"
        )
    )


def classify_market(symbol: Column) -> Column:
    """Market of a symbol, NULL when it belongs to none.

    A symbol with a derivative exchange suffix that fails the derivative
    patterns is unsupported; it must not fall through to the US pattern.
    """
    suffix = F.substring_index(symbol, ".", -1)
    listed = (
        full_match(symbol, fixed.STOCK_SYMBOL)
        | full_match(symbol, fixed.HK_SYMBOL)
        | full_match(symbol, fixed.FUTURE_SYMBOL)
    )
    return (
        F.when(full_match(symbol, fixed.OPTION_SYMBOL), "CZC")
        .when(listed, suffix)
        .when(suffix.isin(fixed.DERIVATIVE_MARKETS), F.lit(None).cast("string"))
        .when(full_match(symbol, fixed.US_SYMBOL), "US")
    )


def symbol_problem(symbol: Column, market: Column) -> Column:
    """Stricter rule for ingest, where the market is declared; NULL when valid."""
    suffix = F.substring_index(symbol, ".", -1)
    dotted = symbol.contains(".")
    prefix = F.when(
        dotted, F.substring(symbol, F.lit(1), F.length(symbol) - F.length(suffix) - 1)
    )
    known = market.isin(fixed.STOCK_MARKETS + fixed.DERIVATIVE_MARKETS + ["US"])
    return (
        F.when(~F.coalesce(known, F.lit(False)), "market")
        .when(
            market == "US", F.when(~full_match(symbol, fixed.US_SYMBOL), "us_symbol")
        )
        .when(~dotted | (suffix != market), "suffix")
        .when(
            market.isin(fixed.STOCK_MARKETS),
            F.when(~full_match(prefix, fixed.STOCK_PREFIX), "stock_prefix"),
        )
        .when(~full_match(prefix, fixed.DERIVATIVE_PREFIX), "derivative_prefix")
    )


def slug(symbol: Column, market: Column) -> Column:
    """Lower-case routing name of a series."""
    text = F.lower(F.regexp_replace(symbol, r"\.", ""))
    return F.when(market == "US", F.concat(text, F.lit("-us"))).otherwise(text)


def is_digest(col: Column) -> Column:
    return F.coalesce(full_match(col, "[0-9a-f]{64}"), F.lit(False))


def digest_hex(raw: Column) -> Column:
    """Lower-case hex text of a binary value."""
    return F.lower(F.hex(raw))


def digest_bytes(text: Column) -> Column:
    """Bytes of lower-case hex text, NULL when it is not canonical hex."""
    return F.when(full_match(text, "([0-9a-f]{2})*"), F.unhex(text))


def content_key(digest: Column, kind: str = "data") -> Column:
    """Content-addressed key of a digest, NULL when it is not a digest."""
    prefix, suffix = _key_parts(kind)
    return F.when(is_digest(digest), F.concat(F.lit(prefix), digest, F.lit(suffix)))


def parse_content_key(key: Column, kind: str = "data") -> Column:
    """Digest named by a key, NULL when the key is not canonical."""
    prefix, suffix = _key_parts(kind)
    pattern = r"\A" + prefix + "([0-9a-f]{64})" + suffix.replace(".", r"\.") + r"\z"
    found = F.regexp_extract(key, pattern, 1)
    return F.when(found != "", found)


def _key_parts(kind: str) -> tuple[str, str]:
    if kind == "data":
        return fixed.DATA_KEY_PREFIX, fixed.DATA_KEY_SUFFIX
    return fixed.MANIFEST_KEY_PREFIX, fixed.MANIFEST_KEY_SUFFIX
