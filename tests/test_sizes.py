"""Steps whose tables grow with the input must not be gathered on the driver."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import scan, snapshot
from tidemark.session import materialize

DAY = 86400000
SERIES_OF = ["'ddb-history-native64' as dataset", "'SZ' as market", "'000002.SZ' as symbol"]


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def written(monkeypatch):
    """Plans of the tables that the operators write, by label."""
    plans = {}

    def noted(df, label):
        plans[label] = plan(df)
        return materialize(df, label)

    for module in (scan, snapshot):
        monkeypatch.setattr(module, "materialize", noted)
    return plans


@pytest.mark.parametrize("operator", ["first_n", "bounded_export"])
def test_exploded_slices_are_not_broadcast(spark, written, operator):
    price = [f"cast(id as double) as {c}" for c in ("open", "high", "low", "close")]
    bars = spark.range(40).selectExpr(*SERIES_OF, f"id * {DAY // 4} as ts_ms", *price, "id as volume", "id as open_oi", "id as close_oi")
    asked = spark.range(2).selectExpr("concat('r', id) as request_id", *SERIES_OF, "cast(3 as bigint) as max_rows", f"id * {DAY} as lo", f"{9 * DAY} as hi")
    # A file of pieces tells the optimizer nothing about the days that they are cut into.
    pieces = materialize(asked, "pieces")
    if operator == "first_n":
        rows = scan.first_n(pieces, bars)
    else:
        rows = snapshot.bounded_export(bars, pieces, 2)
    assert "BroadcastHashJoin [request_id" not in written["slices"]
    first = rows.groupBy("request_id").agg(F.sort_array(F.collect_list("ts_ms")).alias("at"))
    step = DAY // 4
    assert {r.request_id: r["at"] for r in first.collect()} == {"r0": [0, step, 2 * step], "r1": [DAY, DAY + step, DAY + 2 * step]}


def test_counting_meets_no_suspensions(spark, written):
    from tidemark.operators import visibility

    price = [f"case when id % 4 = 1 then {v} else cast(id as double) end as {c}" for c, v in [("open", "null"), ("high", "0D"), ("low", "0D"), ("close", "null")]]
    counts = [f"case when id % 4 = 1 then 0 else id end as {c}" for c in ("volume", "open_oi", "close_oi")]
    bars = materialize(spark.range(40).selectExpr(*SERIES_OF, f"id * {DAY // 4} as ts_ms", *price, *counts), "bars")
    pieces = materialize(spark.range(2).selectExpr("concat('r', id) as request_id", *SERIES_OF, "cast(3 as bigint) as max_rows", f"id * {DAY} as lo", f"{9 * DAY} as hi"), "pieces")
    # The placeholder of the first day is confirmed, that of the second is not.
    off = spark.createDataFrame([("000002.SZ", 0, DAY, "notice")], "symbol string, start_ms bigint, end_ms bigint, evidence string")
    rows = scan.first_n(pieces, bars, off)
    # The days are counted where slices meet bars, and nothing else is joined for them.
    assert len([line for line in written["slices"].split("\n") if "Join [" in line]) == 1
    # Only placeholders look for their suspension.
    assert "Join [" not in plan(rows.where("visible = 1"))
    found = sorted((r.request_id, r.ts_ms * 4 // DAY, r.visible, r.confirmed) for r in rows.collect())
    assert found == [
        ("r0", 0, 1, False), ("r0", 1, 0, True), ("r0", 2, 1, False), ("r0", 3, 1, False),
        ("r1", 4, 1, False), ("r1", 5, 0, False), ("r1", 6, 1, False), ("r1", 7, 1, False),
    ]
    marked = visibility.mark_suspensions(bars, off)
    assert marked.where("confirmed").count() == 1


def test_factor_documents_are_parsed_once(spark):
    from tidemark.sources import factors

    sets, events = factors.read_factors(spark.createDataFrame([("{}",), ("no document",)], "value string"))
    assert "from_json" not in plan(sets) and "from_json" not in plan(events)
    assert sets.where("problem is not null").count() == 2 and events.count() == 0


def test_short_exports_share_a_batch(tmp_path):
    import numpy as np

    from tidemark import fixed
    from tidemark.operators.digest import RECORDS
    from tidemark.sources.exports import ExportReader

    for k in range(20):
        records = np.zeros(3, RECORDS[fixed.ENCODING_NATIVE])
        records["ts_ms"] = range(3 * k, 3 * k + 3)
        (tmp_path / f"f{k:02}").write_bytes(records.tobytes())
    reader = ExportReader({"path": str(tmp_path), "encoding": fixed.ENCODING_NATIVE}, ["file", "ts_ms"])
    found = [b for span in reader.partitions() for b in reader.read(span)]
    assert len(found) == 1
    assert found[0].to_pylist() == [{"file": f"f{n // 3:02}", "ts_ms": n} for n in range(60)]


def test_a_wrong_length_beside_missing_data(spark, tmp_path):
    import compare
    import duckdb

    from tidemark.plans import registry

    con = duckdb.connect()
    # 329 and 766 meet both faults.
    con.execute(f"""copy (select i as event_id, timestamp '2024-01-03 02:00:00' + to_minutes(cast(i as int)) as ts, u as user_id,
        'purchase' as event_type, cast(i as double) as value from (select unnest([7, 25, 30, 329, 766]) as u) x, range(3) r(i))
        to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    assert compare.difference(registry.queries()["factor_resolve"](spark, str(tmp_path)), con, registry.checks()["factor_resolve"]) is None


def test_factor_documents_of_many_series(spark, tmp_path):
    import compare
    import duckdb

    from tidemark.plans import registry

    con = duckdb.connect()
    # Past the deadline of a scheduled check (61 144), past the time of reading (90 000, 540 001).
    con.execute(f"""copy (select i as event_id, timestamp '2024-01-03 02:00:00' + to_minutes(cast(i as int)) as ts, u as user_id,
        'purchase' as event_type, cast(i as double) as value from (select unnest([7, 59999, 60000, 61144, 61171, 90000, 540001]) as u) x, range(3) r(i))
        to '{tmp_path}/events.parquet' (format parquet)""")
    con.execute(f"create view events as select * from read_parquet('{tmp_path}/events.parquet')")
    assert compare.difference(registry.queries()["factor_resolve"](spark, str(tmp_path)), con, registry.checks()["factor_resolve"]) is None


def minute_bars(spark, n):
    price = [f"cast(id as double) as {c}" for c in ("open", "high", "low", "close")]
    return spark.range(n).selectExpr(*SERIES_OF, "id * 60000 as ts_ms", *price, "id as volume", "id as open_oi", "id as close_oi")


def test_bars_are_verified_in_one_pass(spark):
    bars = materialize(minute_bars(spark, 3000), "bars")
    declared = spark.range(2).selectExpr(*SERIES_OF, f"id * {DAY} as cov_start", f"(id + 1) * {DAY} as cov_end", "'v' as data_version", "1 as source_version")
    catalog = materialize(snapshot.build_catalog(declared, bars), "catalog")
    found = snapshot.verify_snapshot(bars, catalog)
    assert len([line for line in plan(found).split("\n") if "FileScan" in line and "ts_ms#" in line]) == 1
    # 120 bars lie behind both entries.
    assert [(r.cov_start, r.found_rows, r.problem) for r in found.collect()] == [(None, 120, "outside_coverage")]


def test_files_share_a_task(spark):
    from tidemark.session import scratch
    from tidemark.sources import bars as bar_files

    path = scratch(spark, "exact")
    bar_files.write_exact(minute_bars(spark, 400), path, limit=10)
    names = [r.file.rsplit("/", 1)[-1] for r in bar_files.stored_files(spark, path).collect()]
    assert len(names) >= 40 and len({name[:10] for name in names}) < 20


def test_words_are_those_of_the_content(spark):
    from tidemark.operators import digest

    values = "(1L, 0.5D, double('NaN'), 7L), (-2L, cast(null as double), -0.0D, cast(null as bigint))"
    rows = spark.sql(f"select * from values {values} as t(ts_ms, open, high, volume)")
    words = [F.lpad(F.lower(F.hex(w)), 8, "0") for w in digest.WORDS]
    want = {r[0] for r in digest.with_bits(rows).select(F.sha2(digest.content_text(rows.columns), 256)).collect()}
    assert {r[0] for r in digest.with_words(rows).select(F.concat(*words)).collect()} == want
    assert digest.with_words(rows.where("ts_ms > 5")).count() == 0


@pytest.mark.parametrize("name", ["adjusted_prices", "compact_rows", "snapshot_tree_diff", "snapshot_verify", "daily_problems", "export_ingest", "adjusted_query"])
def test_bars_are_derived_once(spark, small, name):
    from tidemark.plans import registry
    from tidemark.plans.fixtures import Shapes

    registry.queries()
    shapes = Shapes(spark, small)
    registry._QUERIES[name](shapes)
    assert not [path for path in shapes.f_bars_nullable.inputFiles() if path.endswith("events.parquet")]


def test_arriving_exports_are_known_by_their_lists(spark, small, monkeypatch):
    """What the driver keeps of a stream of exports are lists of them, not their names."""
    from pathlib import Path

    from tidemark import session
    from tidemark.plans import registry
    from tidemark.plans.queries import snapshots

    paths = {}

    def scratch(spark, label):
        paths[label] = session.scratch(spark, label)
        return paths[label]

    registry.queries()
    monkeypatch.setattr(snapshots, "scratch", scratch)
    found = registry.queries()["export_arrivals"](spark, small)
    taken = [line for p in Path(f"{paths['state']}/sources/0").iterdir() if p.name.isdigit() for line in p.read_text().splitlines() if "path" in line]
    files = [p for p in Path(paths["exports"]).iterdir() if not p.name.startswith(".")]
    assert found.count() == len(files) > 2 * len(taken) > 0


def test_series_of_adjusted_answers_are_derived_once(spark, small):
    from tidemark.plans import registry
    from tidemark.plans.fixtures import Shapes

    registry.queries()
    shapes = Shapes(spark, small)
    registry._QUERIES["adjusted_query"](shapes)
    bars = set(shapes.f_bars.inputFiles())
    assert bars and not bars & set(shapes.f_factor_sets.inputFiles())
