"""Scalar functions against independent brute force."""

import datetime as dt
import zoneinfo

from pyspark.sql import functions as F

from tidemark.functions import clock, identity

NY = zoneinfo.ZoneInfo("America/New_York")


def wall_of(utc_s):
    at = dt.datetime.fromtimestamp(utc_s, NY).replace(tzinfo=dt.timezone.utc)
    return int(at.timestamp())


def test_wall_clock_against_zoneinfo(spark):
    """Hourly instants around every change of several decades, both directions."""
    instants = []
    for year in [1970, 1974, 1975, 1986, 1987, 2006, 2007, 2024, 2026, 2037]:
        for month, day in [(1, 6), (2, 23), (3, 8), (4, 5), (4, 26), (10, 26), (11, 1)]:
            base = int(dt.datetime(year, month, day, tzinfo=dt.timezone.utc).timestamp())
            instants += range(base - 43200, base + 172800, 1800)
    instants = [i for i in instants if 86400 * 2 < i < 2140668000 - 86400]
    walls = {}
    for i in sorted(set(instants) | {i + d for i in instants for d in (-3600, 3600)}):
        walls.setdefault(wall_of(i), set()).add(i)
    df = spark.createDataFrame([(i,) for i in instants], "s long")
    got = df.select(
        "s",
        clock.utc_to_wall(F.col("s") * 1000).alias("wall"),
        clock.wall_matches(F.col("s") * 1000).alias("matches"),
        clock.wall_to_utc(F.col("s") * 1000).alias("utc"),
    ).collect()
    skipped = repeated = 0
    for row in got:
        wall = wall_of(row.s)
        same = {i for i in (row.s - 3600, row.s, row.s + 3600) if wall_of(i) == wall}
        assert row.wall == (wall * 1000 if len(same) == 1 else None)
        shown = [i for i in (row.s + 14400, row.s + 18000) if wall_of(i) == row.s]
        assert row.matches == len(shown)
        assert row.utc == (shown[0] * 1000 if len(shown) == 1 else None)
        skipped += len(shown) == 0
        repeated += len(shown) == 2
    assert skipped and repeated


def test_wall_clock_ends_with_its_table(spark):
    end = F.lit(2140668000000).cast("bigint")
    row = spark.range(1).select(
        clock.utc_to_wall(end).alias("a"), clock.utc_to_wall(end - 7200000).alias("b")
    ).first()
    assert row.a is None and row.b is not None


def test_wall_clock_ignores_session_zone(spark):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Asia/Tokyo")
    try:
        ms = F.lit(1704067200000).cast("bigint")
        row = spark.range(1).select(
            clock.utc_to_wall(ms).alias("wall"),
            F.array_join(clock.months_of(ms, ms + 86400000 * 40, F.lit("US")), ",").alias("m"),
        ).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    assert row.wall == 1704067200000 - 5 * 3600000
    assert row.m == "202401,202402"


def test_months_keep_the_last_one(spark):
    start = int(dt.datetime(2024, 1, 31, 20, tzinfo=dt.timezone.utc).timestamp()) * 1000
    end = int(dt.datetime(2024, 3, 31, 16, 1, tzinfo=dt.timezone.utc).timestamp()) * 1000
    row = spark.range(1).select(
        clock.months_of(F.lit(start), F.lit(end), F.lit("SH")).alias("m"),
        clock.months_of(F.lit(start), F.lit(end - 60000), F.lit("SH")).alias("n"),
    ).first()
    assert row.m == ["202402", "202403", "202404"] and row.n == ["202402", "202403"]


def test_markets(spark):
    cases = {
        "000001.SZ": "SZ", "600000.SH": "SH", "00700.HK": "HK", "rb2410.SHF": "SHF",
        "AP612C8000.CZC": "CZC", "AAPL": "US", "BRK.B": "US", "BRK-B": "US",
        "ABC.SHF": None, "m2409-C-3100.DCE": None, "SHF": None, "1AB": None, "": None,
        "000001.SZ\n": None, "0700.HK": None,
    }
    df = spark.createDataFrame([(s,) for s in cases], "symbol string")
    got = {r.symbol: r.m for r in df.select("symbol", identity.classify_market(F.col("symbol")).alias("m")).collect()}
    assert got == cases


def test_ingest_symbols(spark):
    cases = [
        ("000001.SZ", "SZ", None), ("00700.HK", "HK", None), ("000001.SH", "SZ", "suffix"),
        ("0001.SZ", "SZ", "stock_prefix"), ("rb2410.SHF", "SHF", None),
        ("m2409-C-3100.DCE", "DCE", None), ("AP410C8000.CZC", "CZC", None),
        ("rb.SHF", "SHF", "derivative_prefix"), ("AAPL", "US", None), ("9A", "US", "us_symbol"),
        ("000001.XX", "XX", "market"),
    ]
    df = spark.createDataFrame([(i, s, m) for i, (s, m, _) in enumerate(cases)], "i int, symbol string, market string")
    got = {r.i: r.p for r in df.select("i", identity.symbol_problem(F.col("symbol"), F.col("market")).alias("p")).collect()}
    assert got == {i: want for i, (_, _, want) in enumerate(cases)}


def test_strict_dates(spark):
    texts = {"2024-02-29": dt.date(2024, 2, 29), "2023-02-29": None, "2024-2-1": None,
             "2024-13-01": None, "": None, "2024-01-01x": None}
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: r.d for r in df.select("t", clock.strict_date(F.col("t")).alias("d")).collect()}
    assert got == texts
