"""Operators on small made cases: edges, skew, and laws that must hold."""

import hashlib
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import (
    coverage,
    digest,
    ops,
    ordered,
    quality,
    requests,
    scan,
    snapshot,
    visibility,
)
from tidemark.plans import adjusted, answer

DAY = fixed.DAY_MS
T = 1704067200000
V1 = hashlib.sha256(b"v1").hexdigest()
V2 = hashlib.sha256(b"v2").hexdigest()
CAT = "dataset string, market string, symbol string, tier string, cov_start long, cov_end long, data_version string"
BAR = "dataset string, market string, symbol string, tier string, ts_ms long, open double, high double, low double, close double, volume long, open_oi long, close_oi long"
REQ = "request_id string, symbol string, start_ms long, end_ms long, max_rows long, row_encoding string, include_intraday boolean, allow_partial boolean"
SUS = "symbol string, start_ms long, end_ms long, evidence string"
D = fixed.DATASET_NATIVE


def catalog(spark, *entries, symbol="000001.SZ", market="SZ"):
    rows = [(D, market, symbol, t, a, b, v) for t, a, b, v in entries]
    return spark.createDataFrame(rows, CAT)


def bars(spark, *rows, symbol="000001.SZ", market="SZ"):
    full = [
        (D, market, symbol, tier, ts, *((None, 0.0, 0.0, None) if price is None else (price,) * 4),
         0 if price is None else volume, 0, 0)
        for tier, ts, price, volume in rows
    ]
    return spark.createDataFrame(full, BAR)


def request(spark, *rows, symbol="000001.SZ"):
    full = [(i, symbol, a, b, n, fixed.ENCODING_NATIVE, intra, part) for i, a, b, n, intra, part in rows]
    return spark.createDataFrame(full, REQ)


def answers(spark, asked, cat, rows, sus=()):
    table = spark.createDataFrame(list(sus), SUS)
    got = answer.answer_requests(asked, cat, rows, table).collect()
    return {r.request_id: r for r in got}


def test_gap_ends_the_prefix(spark):
    cat = catalog(spark, ("history", T, T + DAY, V1), ("history", T + 2 * DAY, T + 3 * DAY, V1))
    rows = bars(spark, ("history", T, 1.0, 1), ("history", T + 2 * DAY, 2.0, 1))
    asked = request(
        spark,
        ("whole", T, T + 3 * DAY, 5, False, False),
        ("part", T, T + 3 * DAY, 5, False, True),
        ("hit", T, T + DAY, 5, False, False),
        ("inside_gap", T + DAY, T + 2 * DAY, 5, False, True),
        ("second", T + 2 * DAY, T + 3 * DAY, 5, False, False),
    )
    got = answers(spark, asked, cat, rows)
    assert (got["whole"].status, got["whole"].uncovered_from_ms) == ("MISS", T + DAY)
    assert (got["part"].status, got["part"].rows, got["part"].coverage_end_ms) == ("PARTIAL", 1, T + DAY)
    assert (got["hit"].status, got["hit"].rows) == ("HIT", 1)
    assert got["inside_gap"].status == "MISS"
    assert (got["second"].status, got["second"].first_ms) == ("HIT", T + 2 * DAY)


def test_empty_coverage_is_a_hit(spark):
    cat = catalog(spark, ("history", T, T + DAY, V1))
    rows = bars(spark, ("history", T + 5 * DAY, 1.0, 1))
    got = answers(spark, request(spark, ("r", T, T + DAY, 5, False, False)), cat, rows)["r"]
    assert (got.status, got.rows, got.first_ms, got.row_limit_reached) == ("HIT", 0, None, False)


def test_mixed_versions_fail_only_where_used(spark):
    cat = catalog(spark, ("history", T, T + DAY, V1), ("history", T + DAY, T + 2 * DAY, V2))
    rows = bars(spark, ("history", T, 1.0, 1))
    asked = request(
        spark, ("both", T, T + 2 * DAY, 5, False, False), ("one", T, T + DAY, 5, False, False)
    )
    got = answers(spark, asked, cat, rows)
    assert got["both"].status == "ERROR" and got["one"].status == "HIT"


# Midnight in China, so that an intraday entry is one civil day.
M = T - 8 * 3600000


def test_archive_replaces_the_intraday_tail(spark):
    day = ("intraday", M, M + DAY, V1)
    tail = [("intraday", M, 1.0, 100), ("intraday", M + 60000, 1.0, 100)]
    asked = request(spark, ("r", M, M + 180000, 5, True, True))
    first = catalog(spark, ("intraday", M, M + 120000, V1))
    got = answers(spark, asked, first, bars(spark, *tail))["r"]
    assert (got.status, got.rows, got.coverage_end_ms) == ("PARTIAL", 2, M + 120000)
    both = catalog(spark, ("history", M, M + 180000, V1), day)
    archive = [("history", M + i * 60000, 2.0, 999) for i in range(3)]
    rows = bars(spark, *tail, *archive)
    got = answers(spark, asked, both, rows)["r"]
    assert (got.status, got.rows) == ("HIT", 3)
    served = answer.merge_tiers(asked, both, rows).select("tier").distinct().collect()
    assert [r.tier for r in served] == ["history"]


def test_intraday_reaches_over_one_midnight_only(spark):
    days = [("intraday", M + i * DAY, M + (i + 1) * DAY, V1) for i in range(4)]
    cat = catalog(spark, *days)
    rows = bars(spark, *[("intraday", M + i * DAY, 1.0, 1) for i in range(4)])
    asked = request(spark, ("r", M, M + 4 * DAY, 5, True, True), ("off", M, M + DAY, 5, False, True))
    got = answers(spark, asked, cat, rows)
    assert (got["r"].status, got["r"].coverage_end_ms) == ("PARTIAL", M + 2 * DAY)
    assert got["off"].status == "MISS"


def test_placeholders_do_not_use_up_the_limit(spark):
    cat = catalog(spark, ("history", T, T + 8 * DAY, V1))
    hidden = [("history", T + i * 60000, None, 0) for i in range(5001)]
    rows = bars(spark, *hidden, ("history", T + 7 * DAY, 3.0, 1), ("history", T + 7 * DAY + 60000, None, 0))
    asked = request(spark, ("r", T, T + 8 * DAY, 1, False, False))
    sus = [("000001.SZ", T, T + 8 * DAY, "notice"), ("000001.SZ", T, T + DAY, "again")]
    got = answers(spark, asked, cat, rows, sus)["r"]
    assert (got.status, got.rows, got.omitted_rows) == ("HIT", 1, 5001)
    assert got.first_ms == T + 7 * DAY and got.row_limit_reached
    bad = answers(spark, asked, cat, rows, [("000001.SZ", T, T + DAY, "notice")])["r"]
    assert (bad.status, bad.detail) == ("ERROR", "unclassified_null")


def test_fully_suspended_range_is_an_empty_hit(spark):
    cat = catalog(spark, ("history", T, T + DAY, V1))
    rows = bars(spark, ("history", T, None, 0), ("history", T + 60000, None, 0))
    asked = request(spark, ("r", T, T + DAY, 5, False, False))
    got = answers(spark, asked, cat, rows, [("000001.SZ", T, T + DAY, "x")])["r"]
    assert (got.status, got.rows, got.omitted_rows) == ("HIT", 0, 2)


def test_us_series_is_served_in_utc(spark):
    wall = T + 9 * 3600000
    utc = wall + 5 * 3600000
    cat = catalog(spark, ("history", T, T + DAY, V1), symbol="AAPL", market="US")
    rows = bars(spark, ("history", wall, 1.0, 1), ("history", wall + 60000, 1.0, 1), symbol="AAPL", market="US")
    asked = request(spark, ("r", utc, utc + 3600000, 5, False, False), symbol="AAPL")
    got = answers(spark, asked, cat, rows)["r"]
    assert (got.status, got.rows, got.first_ms, got.coverage_end_ms) == ("HIT", 2, utc, utc + 3600000)


def test_errors_are_rows(spark):
    cat = catalog(spark, ("history", T, T + DAY, V1))
    rows = bars(spark, ("history", T, 1.0, 1))
    asked = request(spark, ("end", T, T, 5, False, False), ("rows", T, T + 1, 0, False, False),
                    ("cap", T, T + 1, 5001, False, False), ("zero", 0, T, 5, False, False),
                    ("far", T, 2**62, 5, False, False))
    got = answers(spark, asked, cat, rows)
    assert {r.status for r in got.values()} == {"ERROR"} and len(got) == 5


def test_splitting_a_range_gives_the_same_rows(spark, small):
    from tidemark.plans.fixtures import Shapes

    f = Shapes(spark, small)
    lo, mid, hi = T, T + 10 * DAY, T + 30 * DAY

    def rows(a, b):
        r = f.f_series.select("dataset", "market", "symbol", F.col("symbol").alias("request_id"),
                              F.lit(a).alias("lo"), F.lit(b).alias("hi"))
        return scan.range_scan(f.f_bars, r).select("symbol", "ts_ms", "volume")

    whole = rows(lo, hi)
    parts = rows(lo, mid).unionByName(rows(mid, hi))
    assert snapshot.exact_rows_diff(whole, parts, whole.columns).count() == 0
    assert whole.count() == f.f_bars.where((F.col("ts_ms") >= lo) & (F.col("ts_ms") < hi)).count()


@pytest.mark.parametrize("hot", [0.0, 0.9])
def test_sliced_windows_equal_plain_windows(spark, hot):
    """Also with one key holding nearly all rows, and with slices of every size."""
    rng = random.Random(7)
    rows = [
        ("hot" if rng.random() < hot else f"k{rng.randrange(5)}", t, rng.randrange(50))
        for t in rng.sample(range(0, 40000), 3000)
    ]
    df = spark.createDataFrame(rows, "k string, t long, v long")
    plain = Window.partitionBy("k").orderBy("t")
    want = df.select(
        "k", "t", "v",
        F.row_number().over(plain).cast("long").alias("rn"),
        F.lag("v").over(plain).alias("prev_v"),
        F.max("v").over(plain.rowsBetween(Window.unboundedPreceding, -1)).alias("max_before"),
    )
    for width in [1, 97, 10**6]:
        got = ordered.with_row_number(df, ["k"], ["t"], width)
        got = ordered.with_previous(got, ["k"], ["t"], ["v"], width)
        got = ordered.with_running_max(got, ["k"], ["t"], F.col("v"), width)
        cols = want.columns
        got = got.withColumn("rn", F.col("rn").cast("long"))
        assert snapshot.exact_rows_diff(got, want, cols).count() == 0


def test_previous_value_may_be_null(spark):
    df = spark.createDataFrame([("a", 1, None), ("a", 2, 5), ("a", 9, 6)], "k string, t long, v long")
    got = ordered.with_previous(df, ["k"], ["t"], ["v"], 4).orderBy("t").collect()
    assert [r.prev_v for r in got] == [None, None, 5]


def test_overlap_counts_each_pair_once(spark):
    rng = random.Random(3)
    asks = [(f"r{i}", D, "SZ", "s", a, a + rng.randrange(1, 300) * DAY) for i in range(40) for a in [rng.randrange(700) * DAY]]
    entries = [(D, "SZ", "s", a, a + rng.randrange(0, 90) * DAY) for a in [rng.randrange(900) * DAY for _ in range(60)]]
    left = spark.createDataFrame(asks, "request_id string, dataset string, market string, symbol string, start_stored long, end_stored long")
    right = spark.createDataFrame(entries, "dataset string, market string, symbol string, cov_start long, cov_end long")
    got = sorted(tuple(r) for r in coverage.overlap(left, right).select("request_id", "cov_start", "cov_end").collect())
    want = sorted((r[0], e[3], e[4]) for r in asks for e in entries if e[4] > e[3] and e[4] > r[4] and e[3] < r[5])
    assert got == want


def test_frontier_starts_from_the_request(spark):
    left = spark.createDataFrame([("r", D, "SZ", "s", 100, 200)], "request_id string, dataset string, market string, symbol string, start_stored long, end_stored long")
    cases = {((0, 150), (150, 150), (150, 200)): 200, ((101, 200),): 100, ((0, 300),): 200,
             ((50, 120), (110, 180)): 180, ((0, 120), (121, 200)): 120}
    for entries, want in cases.items():
        right = spark.createDataFrame([(D, "SZ", "s", *e) for e in entries], "dataset string, market string, symbol string, cov_start long, cov_end long")
        assert coverage.coverage_frontier(left, right).first()["frontier"] == want


def test_suspension_pieces_are_disjoint(spark):
    rng = random.Random(5)
    raw = [("000001.SZ", a, a + rng.randrange(1, 5 * DAY), "x") for a in [T + rng.randrange(20 * DAY) for _ in range(60)]]
    pieces = [(r.lo, r.hi) for r in visibility.suspension_days(spark.createDataFrame(raw, SUS)).orderBy("lo").collect()]
    assert all(a[1] <= b[0] for a, b in zip(pieces, pieces[1:]))
    points = [T + rng.randrange(26 * DAY) for _ in range(500)]
    for p in points:
        assert any(a <= p < b for a, b in pieces) == any(a <= p < b for _, a, b, _ in raw)


def test_digest_tree_depends_on_order_and_content(spark):
    rows = [("s", T + i * 60000, float(i), float(i), float(i), float(i), i, 0, 0) for i in range(5000)]
    schema = "symbol string, ts_ms long, open double, high double, low double, close double, volume long, open_oi long, close_oi long"
    df = spark.createDataFrame(rows, schema)

    def tree(d):
        return digest.rows_digest_tree(d, ["symbol"], fanout=8).first()

    base = tree(df)
    assert base["rows"] == 5000
    assert tree(df.orderBy(F.rand(1))) == base
    changed = df.withColumn("volume", F.when(F.col("ts_ms") == T + 60000 * 77, 0).otherwise(F.col("volume")))
    assert tree(changed)["tree_sha256"] != base["tree_sha256"]
    assert tree(df.where(F.col("ts_ms") > T))["tree_sha256"] != base["tree_sha256"]


def test_missing_source_column_is_an_error(spark):
    df = bars(spark, ("history", T, 1.0, 1))
    with pytest.raises(ValueError, match="turnover"):
        quality.project_rows(df, fixed.ENCODING_COMPLETE)


def test_true_hash_chain(spark):
    prev, rows = hashlib.sha256(b"intent").hexdigest(), []
    for i in range(1, 200):
        text = f"1|{i}|attempt|{prev}"
        mine = hashlib.sha256(text.encode()).hexdigest()
        rows.append((1, i, i, "attempt", prev, mine))
        prev = mine
    rows[99] = (*rows[99][:4], "0" * 64, rows[99][5])
    df = spark.createDataFrame(rows, "log long, n long, idx long, kind string, prev_hash string, hash string")
    seed = F.sha2(F.lit("intent"), 256)
    got = ops.hash_chain_breaks(df, "log", "n", ["log", "idx", "kind", "prev_hash"], seed)
    assert [(r.n, r.problem) for r in got.collect()] == [(100, "hash")]


def test_prefix_and_tail_equal_the_whole(spark):
    """Splitting an answer and merging it again gives the same adjusted prices."""
    rows = [("r", T + i * DAY, 10.0 + i, 10.0 + i, 10.0 + i, 10.0 + i, 1, 0, 0) for i in range(10)]
    schema = "request_id string, ts_ms long, open double, high double, low double, close double, volume long, open_oi long, close_oi long"
    df = spark.createDataFrame(rows, schema)
    split = T + 4 * DAY
    terms = spark.createDataFrame(
        [("r", "000001.SZ", "SZ", T, T + 20 * DAY, split, 4, "forward", 19800)],
        "request_id string, symbol string, market string, start_ms long, end_ms long, split_ms long, prefix_rows long, mode string, last_day int",
    )
    factors = spark.createDataFrame([("000001.SZ", 19725, 2.0), ("000001.SZ", 19729, 3.0)], "symbol string, day int, cum double")
    data = digest.rows_digest(df, ["request_id"], fixed.ENCODING_NATIVE).first()["rows_sha256"]
    head, tail = df.where(F.col("ts_ms") < split), df.where(F.col("ts_ms") >= split)
    good, none = adjusted.adjust_composite(head, tail, terms.withColumn("rows_sha256", F.lit(data)), factors)
    assert none.count() == 0
    empty_tail = terms.withColumn("split_ms", F.lit(T + 20 * DAY)).withColumn("prefix_rows", F.lit(10))
    whole, _ = adjusted.adjust_composite(df, df.where("false"), empty_tail, factors)
    assert snapshot.exact_rows_diff(good, whole, ["ts_ms", "open", "close"]).count() == 0
    _, wrong = adjusted.adjust_composite(head, tail, terms.withColumn("rows_sha256", F.lit("0" * 64)), factors)
    assert [r.problem for r in wrong.collect()] == ["digest"]


def test_request_defaults(spark):
    df = spark.createDataFrame([("r", "000001.SZ", T, T + 1)], "request_id string, symbol string, start_ms long, end_ms long")
    row = requests.normalize_requests(df).first()
    assert row.status is None and row.dataset == fixed.DATASET_LEGACY and row.max_rows == 5000
