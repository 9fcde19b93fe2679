"""Fixed expectations: ids, prices, rounding, alert sequences."""

import hashlib
import struct

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.functions import clock, identity, numbers
from tidemark.operators import adjust, digest
from tidemark.streaming import alerts


def one(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def test_series_id(spark):
    key = identity.series_id(F.lit("synthetic"), F.lit("TEST"), F.lit("FIXTURE"))
    assert one(spark, key) == "2f7c6a5825f44f403af4460e38a6fd00"


def test_text_digest(spark):
    text = F.sha2(F.lit("synthetic-none-1m-v1\n"), 256)
    assert one(spark, text) == "96c883a59b8c7abc36c72ecf54a1edd52e7ac7eb7bfde689d43da8cde1a2b820"


@pytest.mark.parametrize(
    ("price", "want"),
    [
        (10.00499999, 10.0),
        (1.005, 1.0),
        (10.125, 10.13),
        (-10.125, -10.13),
        (0.0, 0.0),
        (0.0049999999999999996, 0.0),
        (1e300, 1e300),
    ],
)
def test_round2(spark, price, want):
    assert one(spark, numbers.round2(F.lit(price))) == want


def test_round_just_below_half(spark):
    assert one(spark, numbers.half_away(F.lit(0.49999999999999994))) == 0.0
    assert one(spark, numbers.half_away(F.lit(-0.5))) == -1.0
    assert one(spark, numbers.half_away(F.lit(4503599627370497.0))) == 4503599627370497.0


ROW = (
    "request_id string, symbol string, ts_ms long, local_day int, last_day int, mode string, "
    "open double, high double, low double, close double"
)


def bars(spark, mode, days, price, null=False):
    rows = [
        ("r", "000001.SZ", i, day, 99, mode, None if null else price, price, price, price)
        for i, day in enumerate(days)
    ]
    return spark.createDataFrame(rows, ROW)


def cumulative(spark, events=((10, 2.0), (20, 4.0))):
    return spark.createDataFrame(
        [("000001.SZ", d, c) for d, c in events], "symbol string, day int, cum double"
    )


def prices(df, column="open"):
    return [r[column] for r in df.orderBy("ts_ms").collect()]


@pytest.mark.parametrize(
    ("mode", "days", "want"),
    [
        ("forward", [10, 20], [5.06, 10.13]),
        ("forward", [10], [10.13]),
        ("backward", [9, 20], [10.13, 40.5]),
    ],
)
def test_cumulative(spark, mode, days, want):
    rows = bars(spark, mode, days, 10.125)
    done = adjust.adjust(rows, cumulative(spark), fixed.MODEL_CUMULATIVE, ["request_id"])
    assert prices(done) == want


def test_no_events_leaves_prices_unrounded(spark):
    rows = bars(spark, "forward", [10, 20], 10.125)
    none = cumulative(spark).where("false")
    done = adjust.adjust(rows, none, fixed.MODEL_CUMULATIVE, ["request_id"])
    assert prices(done) == [10.125, 10.125]


def test_null_price_stays_null(spark):
    rows = bars(spark, "forward", [10, 20], 10.125, null=True)
    done = adjust.adjust(rows, cumulative(spark), fixed.MODEL_CUMULATIVE, ["request_id"])
    assert prices(done) == [None, None]
    assert prices(done, "high") == [5.06, 10.13]


def test_overflow_is_marked(spark):
    rows = bars(spark, "backward", [20], 3e38)
    done = adjust.adjust(rows, cumulative(spark), fixed.MODEL_CUMULATIVE, ["request_id"])
    assert not done.first()["adjust_ok"]


@pytest.mark.parametrize(
    ("mode", "want"), [("forward", [97.0, 45.0, 10.0]), ("backward", [10.0, 3.5, -0.875])]
)
def test_affine(spark, mode, want):
    events = spark.createDataFrame(
        [("000001.SZ", 10, 2.0, 3.0, 0.5, -1.5), ("000001.SZ", 20, 4.0, 5.0, 0.25, -1.25)],
        "symbol string, day int, fa double, fb double, ba double, bb double",
    )
    rows = bars(spark, mode, [9, 10, 20], 10.0)
    assert prices(adjust.adjust(rows, events, fixed.MODEL_AFFINE, ["request_id"])) == want


def decide(reports):
    state = alerts.Delivery()
    rows = [("web-1", at, seq, severity, codes, ok) for seq, (at, severity, codes, ok) in enumerate(reports)]
    out = alerts.decide(state, pd.DataFrame(rows, columns=alerts.INPUT))
    # Report by report, as small micro-batches bring them, the decisions are the same.
    single = alerts.Delivery()
    parts = [alerts.decide(single, pd.DataFrame([r], columns=alerts.INPUT)) for r in rows]
    assert single == state and pd.concat(parts, ignore_index=True).equals(out)
    return list(zip(out["delivery"], out["event"])), state


BAD = ("critical", "agent_missing")


def test_alert_sequence():
    reports = [(10000, *BAD, True), (10001, *BAD, True), (13600, *BAD, True),
               (13900, "ok", "", True), (18000, "ok", "", True)]
    got, _ = decide(reports)
    assert [g[0] for g in got] == ["sent", "suppressed", "sent", "sent", "suppressed"]
    assert got[3][1] == "recovery"


def test_failed_delivery_keeps_budget():
    got, state = decide([(10800 + i * 300, *BAD, False) for i in range(5)])
    assert [g[0] for g in got] == ["failed"] * 4 + ["suppressed"]
    assert state.told == "" and state.in_day == 4


def test_attempt_without_answer_is_not_repeated():
    got, _ = decide([(10000, *BAD, None), (10001, *BAD, True)])
    assert [g[0] for g in got] == ["failed", "suppressed"]


def test_clock_regression_freezes_state():
    reports = [(10000, *BAD, True), (9999, *BAD, True), (10001, *BAD, True)]
    got, state = decide(reports)
    assert [g[0] for g in got] == ["sent", "suppressed", "suppressed"]
    assert state.latest_s == 10001 and state.in_day == 1


def test_daily_cap():
    reports = [(86400 + h * 3600 + s * 300, *BAD, False) for h in range(12) for s in range(4)]
    got, _ = decide([*reports, (86400 + 13 * 3600, *BAD, False), (2 * 86400, *BAD, False)])
    assert [g[0] for g in got[:48]] == ["failed"] * 48
    assert [g[0] for g in got[48:]] == ["suppressed", "failed"]


def test_recovery_after_failed_alert():
    got, state = decide([(10000, *BAD, False), (10300, "ok", "", True)])
    assert got[1] == ("sent", "recovery") and state.failing is False


def synthetic(n):
    for i in range(n):
        p = 100 + (i % 1000) * 0.125
        yield (1704067200000 + i * 60000, p, p + 1, p - 1, p + 0.5, i * 17 + 1)


@pytest.mark.parametrize("n", [1, 240, 2050])
def test_digest_of_synthetic_bars(spark, n):
    from tidemark.sources.synthetic import synthetic_bars

    series = spark.createDataFrame([("S", n)], "symbol string, n long")
    got = digest.rows_digest(synthetic_bars(series), ["symbol"], fixed.ENCODING_LEGACY).first()
    data = b"".join(struct.pack("<q4fq", *row) for row in synthetic(n))
    assert got["rows"] == n
    assert got["rows_sha256"] == hashlib.sha256(data).hexdigest()


def test_ny_weekend_over_autumn_change(spark):
    friday = 1793416200000 - 1793416200000 % 86400000 + 3 * 3600000
    wall = F.lit(friday).cast("bigint")
    later = F.lit(friday + 3 * 86400000).cast("bigint")
    hours = (clock.wall_to_utc(later) - clock.wall_to_utc(wall)) / 3600000
    assert one(spark, hours) == 73
