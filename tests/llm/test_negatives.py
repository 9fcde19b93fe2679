"""Hard negatives against a plain search over all rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, most=5, each=5, percent=80):
    """Answers of every anchor; the shorter of two vectors counts as padded."""
    held = []
    for i, v, label in rows:
        if label is None or v is None or any(x is None or not math.isfinite(x) for x in v):
            continue
        held.append((i, [math.floor(256 * x) for x in v], (label + 1) % 10 if i is not None and i % 7 == 0 else label))
    out = []
    last = lambda i: (i is None, i or 0)
    for a, va, la in held:
        if a is None or a % 100:
            continue
        scored = sorted(((-sum(x * y for x, y in zip(va, v)), last(i), i, label) for i, v, label in held if i != a), key=lambda s: s[:2])
        for s, _, p, _ in [x for x in scored if x[3] == la][:most]:
            near = [x for x in scored if x[3] != la and percent * -s <= 100 * -x[0] <= 100 * -s][:each]
            out += [(a, p, n + 1, x[2], -s, -x[0]) for n, x in enumerate(near)]
    return sorted(out, key=str)


def drawn(rng, n, centres=6, width=8, spread=0.3):
    """Rows around a few directions, with float32 components."""
    middle = [[rng.gauss(0, 1) for _ in range(width)] for _ in range(centres)]
    rows = []
    for i in range(n):
        v = [float(np.float32(x + rng.gauss(0, spread))) for x in middle[rng.randrange(centres)]]
        rows.append((i * 5, v, rng.randint(0, 3)))
    return rows


def mined(spark, rows, parts=4):
    got = negatives.mined(spark.createDataFrame(rows, SCHEMA).repartition(parts)).collect()
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted((tuple(r[c] for c in names) for r in got), key=str)


@pytest.mark.parametrize("spread", [0.05, 0.6])
def test_same_rows_as_a_plain_search(spark, monkeypatch, spread):
    monkeypatch.setattr(negatives, "TREE_ROWS", 4)
    monkeypatch.setattr(negatives, "SLICE_ROWS", 64)
    rows = drawn(random.Random(3), 500, spread=spread)
    assert mined(spark, rows) == plain(rows) != []


def test_odd_rows(spark):
    rng = random.Random(5)
    rows = drawn(rng, 200)
    nan, inf = float("nan"), float("inf")
    rows += [(100, None, 1), (200, [1.0, None], 1), (300, [nan] * 8, 1), (7000, [inf] * 8, 2), (None, rows[3][1], 2)]
    rows += [(None, rows[3][1], 3), (400, rows[80][1], None), (1100, [1.0] * 3, 2), (1200, [], 1), (1300, rows[0][1] * 2, 1)]
    rows += [rows[20]] * 3 + [(-100, rows[7][1], -1), (8000, [3e38] + [0.0] * 7, 1)] + [rows[0]] * 2
    rows += [(i, rows[40][1], 5) for i in range(5000, 5300)]  # copies of one vector, anchors among them
    held = lambda x: 2.0**20 if x == float(np.float32(3e38)) or x == 3e38 else x
    clean = [(i, v and [held(x) for x in v], y) for i, v, y in rows]
    assert mined(spark, rows) == plain(clean) != []


def test_general_operator(spark):
    rows = drawn(random.Random(8), 150)
    df = spark.createDataFrame(rows, SCHEMA).withColumn("v", F.lit("old")).withColumn("rank", F.lit("old"))
    got = negatives.hard_negatives(df, F.col("vec_id") % 100 == 0, 2, 3, 50)
    assert got.count() > 0 and all(r.rank <= 3 and 2 * r.negative_score >= r.positive_score for r in got.collect())
    empty = negatives.mined(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and len(empty.columns) == 6


def test_waves(spark, monkeypatch):
    monkeypatch.setattr(negatives, "TREE_ROWS", 3)
    monkeypatch.setattr(negatives, "WAVE_BYTES", 500)
    rows = drawn(random.Random(4), 240)
    assert mined(spark, rows) == plain(rows) != []


def test_tree_spans_and_bounds_save_scores():
    rng = np.random.default_rng(1)
    x = (rng.normal(0, 1, (40, 16)) * 3 + 60).astype(int)
    order, parent, length = negatives.spanning_tree(x)
    assert sorted(order.tolist()) == list(range(40)) and parent[0] == -1 and all(p < n for n, p in enumerate(parent))
    for n in range(1, 40):
        from_outside = np.sqrt(((x[order[:n], None] - x[None, order[n:]]) ** 2).sum(-1)).min()
        assert length[n] == pytest.approx(from_outside)
    row = {"tree": 0, "label": 0, "ids": order.tolist(), "parents": parent.tolist(), "lengths": length.tolist(),
           "width": 16, "components": x[order].astype("<i4").tobytes()}
    far = (rng.normal(0, 1, (5000, 16)) * 20).astype(int)
    far[:50] = x[:50 % 40].repeat(5, axis=0)[:50]
    tree = negatives.Tree(row, 5, 5, 80)
    scored = tree.visit(far, np.arange(1000, 6000))
    assert scored < 0.5 * 40 * 5000
    for node in range(40):
        scores = far @ x[order[node]]
        best = sorted(zip(-scores, range(1000, 6000)))[:5]
        assert [(-s, i) for s, i in best] == list(zip(tree.best[node][0].scores, tree.best[node][0].ids))
