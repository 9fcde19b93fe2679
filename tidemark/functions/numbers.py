"""Price arithmetic as column expressions."""

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark import fixed


def half_away(x: Column) -> Column:
    """Nearest integer as DOUBLE, ties away from zero.

    ``floor`` and the fraction are both exact, so the tie test is exact too, and
    the expression stays in generated code (``round`` goes through decimals).
    From 2**52 on every double already is an integer.
    """
    size = F.abs(x)
    whole = F.floor(size).cast("double")
    up = F.when(size - whole >= 0.5, whole + 1.0).otherwise(whole)
    return F.when(size >= 4503599627370496.0, x).when(x < 0, -up).otherwise(up)


def round2(x: Column) -> Column:
    """Two decimals by scaling: 1.005 becomes 1.0, as the product is 100.49999."""
    return half_away(x * 100.0) / 100.0


def finite(x: Column) -> Column:
    """False for NaN and the infinities, NULL for NULL."""
    return ~F.isnan(x) & (F.abs(x) != float("inf"))


def fits_float(x: Column) -> Column:
    return finite(x) & (F.abs(x) <= fixed.FLOAT_MAX)


def float32_price(x: Column) -> Column:
    """Single-precision price; NULL (an error to report) when it cannot fit."""
    return F.when(fits_float(x), x.cast("float"))


def client_price(x: Column) -> Column:
    """Single-precision price as clients read it: NULL is NaN."""
    return F.coalesce(float32_price(x), F.lit(float("nan")).cast("float"))


def from_sentinel(x: Column) -> Column:
    return F.nullif(x, F.lit(fixed.NULL_PRICE))


def to_sentinel(x: Column) -> Column:
    return F.coalesce(x, F.lit(fixed.NULL_PRICE))
