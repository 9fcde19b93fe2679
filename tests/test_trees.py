"""Stored trees of digests, the streamed digest of a series, and exact cuts of a snapshot."""

import pytest
from pyspark.sql import functions as F

from tidemark import fixed
from tidemark.operators import digest, snapshot, tree
from tidemark.plans.fixtures import Shapes
from tidemark.session import scratch
from tidemark.sources import bars as bar_files

DAY = 86400000
SCHEMA = "dataset string, market string, symbol string, ts_ms long, open double, high double, low double, close double, volume long, open_oi long, close_oi long"


def bars(days, rows=3, symbols=("000001.SZ", "000002.SZ", "600000.SH")):
    return [
        ("d", s[-2:], s, (19700 + d) * DAY + 3600000 * k, 1.0 + k, 2.0, 0.5, None if k == 1 else 1.5, 10 * d + k, k, d)
        for s in symbols for d in range(days) for k in range(rows)
    ]


@pytest.fixture(scope="module")
def stored(spark):
    """Two snapshots of 70 days with few differences, and their trees."""
    old = bars(70)
    new = [r for r in old if r[3] != 19705 * DAY + 3600000 or r[2] != "000001.SZ"]
    new = [(*r[:8], r[8] + 1, *r[9:]) if r[3] == 19760 * DAY and r[2] == "600000.SH" else r for r in new]
    new.append(("d", "SZ", "000003.SZ", 19700 * DAY, 1.0, 1.0, 1.0, 1.0, 1, 1, 1))
    path = scratch(spark, "trees")
    out = []
    for name, rows in (("old", old), ("new", new)):
        df = spark.createDataFrame(rows, SCHEMA)
        df.write.parquet(f"{path}/{name}")
        df = spark.read.schema(SCHEMA).parquet(f"{path}/{name}")
        tree.build_tree(df, f"{path}/{name}-tree")
        out += [df, f"{path}/{name}-tree"]
    return out


def test_tree_finds_the_differing_days_only(spark, stored, monkeypatch):
    old, old_tree, new, new_tree = stored
    read = []
    children = tree._children
    monkeypatch.setattr(tree, "_children", lambda *a: read.append(children(*a)) or read[-1])
    days = tree.differing_days(spark, old_tree, new_tree)
    found = {(r.symbol, r.slot) for r in days.collect()}
    assert found == {("000001.SZ", 19705), ("600000.SH", 19760), ("000003.SZ", 19700)}
    # At every level the children of differing nodes were read, and of 210 days those of three months at most.
    assert sum(side.count() for side in read[-2:]) < 2 * 3 * 32
    cols = SCHEMA.replace(",", "").split()[::2]
    want = snapshot.exact_rows_diff(old, new, cols)
    got = tree.snapshot_tree_diff(old, new, old_tree, new_tree, cols)
    assert snapshot.exact_rows_diff(want, got, want.columns).count() == 0 and got.count() == 4
    assert tree.differing_days(spark, old_tree, old_tree).count() == 0


def test_a_range_is_proved_by_its_path(spark, stored):
    old, old_tree, new, _ = stored
    days = spark.createDataFrame([("d", "SZ", "000001.SZ", d) for d in range(19700, 19708)], "dataset string, market string, symbol string, slot long")
    assert tree.range_problems(old, old_tree, days).count() == 0
    wrong = tree.range_problems(new, old_tree, days).collect()
    assert [(r.level, r.slot, r.problem) for r in wrong] == [(0, 19705, "content")]
    # A stored digest that was changed does not agree with the node above it.
    path = scratch(spark, "tampered")
    for level in range(tree.LEVELS):
        nodes = tree.nodes(spark, old_tree, level)
        if level == 1:
            nodes = nodes.withColumn("digest", F.sha2("digest", 256))
        nodes.write.parquet(f"{path}/level={level}")
    levels = {(r.level, r.problem) for r in tree.range_problems(old, path, days).collect()}
    assert levels == {(1, "children"), (2, "children")}


def test_series_digest_equals_the_gathered_one(spark, small):
    rows = Shapes(spark, small).f_bars_nullable
    for encoding in (fixed.ENCODING_NATIVE, fixed.ENCODING_LEGACY):
        want = {(r.symbol, r.rows, r.rows_sha256) for r in digest.rows_digest(rows, ["symbol"], encoding).collect()}
        before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
        try:
            for size in ("7", "10000"):
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
                got = digest.series_digest(rows, ["symbol"], encoding)
                assert {(r.symbol, r.rows, r.rows_sha256) for r in got.collect()} == want
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert digest.series_digest(rows.limit(0), ["symbol"], fixed.ENCODING_NATIVE).count() == 0


@pytest.mark.parametrize("limit", [7, 50, 2])
def test_files_keep_to_their_rows_and_ranges(spark, limit):
    rows = spark.createDataFrame(bars(40), SCHEMA)
    declared = spark.createDataFrame(
        [("d", s[-2:], s, 19700 * DAY, 19740 * DAY, "v", 1) for s in ("000001.SZ", "000002.SZ", "600000.SH")],
        "dataset string, market string, symbol string, cov_start long, cov_end long, data_version string, source_version int",
    )
    path = scratch(spark, "exact")
    catalog = bar_files.write_exact(rows, path, declared, limit)
    files = bar_files.stored_files(spark, path, SCHEMA).collect()
    assert sum(f.rows for f in files) == 360 and max(f.rows for f in files) <= limit
    by_folder = {}
    for f in files:
        by_folder.setdefault((f.dataset, f.market, f.yyyymm), []).append((tuple(f["first"]), tuple(f["last"])))
    for ranges in by_folder.values():
        ranges.sort()
        assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert [r.row_count for r in catalog.collect()] == [120] * 3
    again = bar_files.scan_bars(spark, path, schema=SCHEMA).drop("yyyymm")
    assert snapshot.verify_snapshot(again, catalog).count() == 0
    assert snapshot.exact_rows_diff(rows, again, rows.columns).count() == 0
