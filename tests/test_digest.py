"""Digests cover the exact bytes of a row, and scratch folders are shared ones."""

import hashlib
import math
import random
import struct

import pytest
from pyspark.sql import functions as F

from tidemark import fixed, session
from tidemark.operators import digest

NUMBERS = [
    0.0, -0.0, 1.0, -1.0, 0.1, 1.005, 10.001, 10.004, math.nan, math.inf, -math.inf,
    5e-324, -5e-324, 2.2250738585072014e-308, 2.225073858507201e-308, 1.7976931348623157e308,
    fixed.NULL_PRICE, 3.4028234663852886e38, 1.401298464324817e-45, 1.1754943508222875e-38,
]


def test_bits_are_those_of_packed_numbers(spark):
    rng = random.Random(1)
    drawn = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(3000)]
    drawn += [2.0**k * (1 + d) for k in range(-1022, 1024, 7) for d in (0, 2**-52, 1 - 2**-52)]
    values = [v if not math.isnan(v) else math.nan for v in NUMBERS + drawn]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, open double")
    found = digest.with_bits(df, [("open", "<f8")]).collect()
    assert {r.i: r["_x_open"] for r in found} == {i: struct.pack("<d", v).hex().upper() for i, v in enumerate(values)}
    singles = [struct.unpack("<f", struct.pack("<f", v))[0] for v in values if not abs(v) > 3e38 or math.isinf(v)]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(singles)], "i int, open double")
    found = digest.with_bits(df, [("open", "<f4")]).collect()
    assert {r.i: r["_x_open"] for r in found} == {i: struct.pack("<f", v).hex().upper() for i, v in enumerate(singles)}


def test_packed_records(spark):
    rows = [(1, 60000, 1.5, None, 0.1, 2.0, 7, 8, -9), (1, 0, math.nan, 1.0, -0.0, 2.5, 0, 1, 2)]
    df = spark.createDataFrame(
        rows, "k int, ts_ms long, open double, high double, low double, close double, volume long, open_oi long, close_oi long"
    )
    got = digest.rows_digest(df, ["k"], fixed.ENCODING_NATIVE, payload=True).first()
    data = b"".join(
        struct.pack("<qddddqqq", *[fixed.NULL_PRICE if v is None else v for v in r[1:]])
        for r in sorted(rows, key=lambda r: r[1])
    )
    assert bytes(got["data"]) == data and got["rows"] == 2
    assert got["rows_sha256"] == hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize(
    "column, a, b",
    [("open", 10.001, 10.004), ("open", math.nan, 0.0), ("open", -0.0, 0.0), ("close", None, 0.0),
     ("turnover", 1.0, 1.0000001), ("open_interest", 1, 2)],
)
def test_every_change_alters_the_digests(spark, column, a, b):
    names = ["ts_ms", "open", "high", "low", "close", "volume", "open_oi", "close_oi", "turnover", "open_interest"]
    schema = ", ".join(f"{n} {'double' if n in ('open', 'high', 'low', 'close', 'turnover') else 'long'}" for n in names)
    base = dict.fromkeys(names, 1) | dict.fromkeys(["open", "high", "low", "close", "turnover"], 1.0)

    def root(value):
        row = base | {column: value}
        df = spark.createDataFrame([tuple(row[n] for n in names)], schema).withColumn("k", F.lit(1))
        return digest.rows_digest_tree(df, ["k"]).first()["tree_sha256"]

    assert root(a) != root(b)


def test_tree_goes_up_until_one_block_is_left(spark):
    df = spark.range(40).select(F.lit(1).alias("k"), F.col("id").alias("ts_ms"), F.col("id").cast("double").alias("open"))
    want = [hashlib.sha256(f"{struct.pack('<q', i).hex().upper()}|{struct.pack('<d', i).hex().upper()}".encode()).hexdigest() for i in range(40)]
    while len(want) > 1:
        want = [hashlib.sha256("".join(want[i : i + 3]).encode()).hexdigest() for i in range(0, len(want), 3)]
    got = digest.rows_digest_tree(df, ["k"], fanout=3).first()
    assert got["tree_sha256"] == want[0] and got["rows"] == 40


def test_scratch_needs_a_shared_folder_on_a_cluster(spark):
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert session.scratch(Session(**{"spark.master": "local[8]"}), "x")
    assert session.scratch(Session(**{"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://a/b"}), "x").startswith("hdfs://a/b/")
    with pytest.raises(RuntimeError):
        session.scratch(Session(**{"spark.master": "local-cluster[2,1,1024]"}), "x")


def test_join_side_is_sized_in_rows_and_bytes(spark):
    df = spark.range(10).select("id", F.repeat(F.lit("x"), 100).alias("t"))

    def broadcasts(side):
        plan = spark.range(10).join(side, "id")._jdf.queryExecution().optimizedPlan().toString()
        return "strategy=broadcast" in plan

    assert broadcasts(session.sized(df))
    assert not broadcasts(session.sized(df, max_rows=9))
    assert not broadcasts(session.sized(df, max_bytes=500))
