"""Near duplicates at a similarity of 0.8 against all pairs."""

import random

import brute
import numpy as np
import pytest

from tidemark.llm import similar
from tidemark.llm.tables import components


def plain_print(text):
    """256 votes, bit by bit, over shingles of five words."""
    words = [w.lower() if w.isascii() else w for w in brute.WORD.findall(text or "")]
    if not words:
        return 0
    hashes = [brute.xxhash.xxh64_intdigest(" ".join(words[i : i + 5]).encode(), seed=42) for i in range(max(1, len(words) - 4))]
    out = 0
    for lane in range(4):
        mixed = [stirred(h ^ int(similar._LANE[lane])) if lane else h for h in hashes]
        out |= sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in mixed) > len(mixed)) << 64 * lane
    return out


def stirred(x):
    x ^= x >> 31
    x = x * 0x9E3779B97F4A7C15 % 2**64
    x ^= x >> 29
    x = x * 0xD6E8FEB86659FD93 % 2**64
    return x ^ x >> 32


def edited(rng, words, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(2)
    names = [f"word{i}" for i in range(900)]
    rows = []
    for k in range(40):
        base = rng.choices(names, k=rng.randint(60, 400))
        rows += [(len(rows) + i, " ".join(edited(rng, base, e))) for i, e in enumerate((0, 0.004, 0.02, 0.2))]
    return [*rows, (1000, ""), (1001, None), (1002, " \n"), (1003, "one two"), (1004, "ONE two"), (1005, "one two three")]


def similarity(a, b):
    sets = []
    for t in (a, b):
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def test_prints(rows):
    for _, t in rows[::5] + rows[-6:]:
        got = similar.fingerprint(t)
        assert sum(int(x) << 64 * i for i, x in enumerate(got)) == plain_print(t)


def test_groups(spark, rows):
    got = {r.doc_id: r.component_id for r in similar.near_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(got) == len(rows)
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    prints = [plain_print(t) for _, t in rows]
    near = wanted = 0
    for i, (a, t) in enumerate(rows):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= similar.MAX_BITS:
                parent[max(find(a), find(rows[j][0]))] = min(find(a), find(rows[j][0]))
            if i < len(rows) - 6 and similarity(t, rows[j][1]) >= 0.8:
                wanted += 1
                near += got[a] == got[rows[j][0]]
    # No group is larger than the links within reach allow, and those of 0.8 or more are found.
    assert all(find(d) == find(c) for d, c in got.items())
    assert wanted > 60 and near >= 0.95 * wanted
    assert sum(find(d) == c for d, c in got.items()) >= 0.97 * len(rows)
    assert {got[d] for d in (1000, 1001, 1002)} == {1000} and got[1003] == got[1004] == 1003 and got[1005] == 1005
    left = {r.doc_id for r in similar.keep_first(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == {d for d, c in got.items() if d == c}


@pytest.mark.parametrize("home_rows", [2048, 3])
def test_pairs_within_reach_of_the_blocks_are_always_found(spark, home_rows):
    rng = random.Random(7)
    values = []
    for _ in range(30):
        centre = rng.getrandbits(256)
        for _ in range(8):
            v = centre
            for b in rng.sample(range(256), rng.randint(0, 5)):
                v ^= 1 << b
            values.append(v)
    values = sorted(set(values))
    lanes = [[(v >> 64 * k & (1 << 64) - 1) for k in range(4)] for v in values]
    signed = [(i, *[x - (1 << 64) if x >> 63 else x for x in row]) for i, row in enumerate(lanes)]
    df = spark.createDataFrame(signed, "node long, " + ", ".join(f"{n} long" for n in similar._NAMES))
    roots = {r.node: r.root for r in components(similar.links(df, 10, 1, home_rows)).collect()}
    want = list(range(len(values)))
    for i, a in enumerate(values):
        for j in range(i):
            if (a ^ values[j]).bit_count() <= 10:
                x, y = sorted((want[i], want[j]))
                want = [x if w == y else w for w in want]
    assert [roots.get(i, i) for i in range(len(values))] == want
    at = similar.anchors(np.array(lanes, np.uint64))
    assert at.shape == (len(values), 48)


def test_empty(spark):
    assert similar.near_groups(spark.createDataFrame([], "doc_id long, text string")).count() == 0
