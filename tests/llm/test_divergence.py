"""Source divergence against plain counting, with small blocks and odd rows."""

import random
import re
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from tidemark.llm import divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
SCHEMA = "lang string, source string, text string"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(rows, least=10, top=10):
    docs, counts, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = TERM.findall(fold(text))
        docs[lang].update(set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        v = len(kept)
        sources = sorted(s for g, s in groups if g == lang)
        n = {s: sum(counts[lang, s][t] for t in kept) for s in sources}
        p = {s: {t: 1 + 10**9 * (counts[lang, s][t] + 2) // (n[s] + 2 * v) for t in kept} for s in sources}
        whole = {t: sum(counts[lang, s][t] for s in sources) for t in kept}
        q = {t: 1 + 10**9 * (whole[t] + 2) // (sum(n.values()) + 2 * v) for t in kept}
        f = lambda a, b: (a - b) ** 2 // (a + b)
        for s in sources:
            pairs = [(-sum(f(p[s][t], p[o][t]) for t in kept), o.encode(), o) for o in sources if o != s]
            apart = [(-f(p[s][t], q[t]), t.encode(), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(apart)[:top])):
                out += [(lang, s, part, item, -value, k + 1) for k, (value, _, item) in enumerate(found)]
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in df.collect()), key=str)


def drawn(seed, n=300):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("Wort", "mot", "été", "日本", "x", "Ü") for b in "abcdefgh"]
    rows = []
    for _ in range(n):
        own = rng.choices(words, [rng.random() ** 4 for _ in words], k=rng.randint(0, 25))
        text = "".join(w + rng.choice([" ", "1", "-", "\n", "\x7f", "", "@["]) for w in own)
        rows.append((rng.choice(["de", "fr", None, "nl"]), rng.choice(["a", "b", "c", "é", "", None, "z z"]), text))
    return rows


@pytest.mark.parametrize("block_rows", [1 << 19, 40])
@pytest.mark.parametrize("seed", [1, 2])
def test_same_rows_as_plain_counting(spark, seed, block_rows):
    rows = drawn(seed) + [("nl", "empty", None), ("one", "alone", "a b c"), ("two", "p", "x"), ("two", "q", "")]
    got = divergence.divergence(spark.createDataFrame(rows, SCHEMA).repartition(5), 10, 10, block_rows)
    assert rows_of(got) == plain(rows)


def test_small_batches(spark, monkeypatch):
    """Terms go on from batch to batch, and pairs are added up in many portions."""
    monkeypatch.setattr(divergence, "PAIR_ROWS", 30)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = drawn(3)
        assert rows_of(divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(3))) == plain(rows)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_terms(pairs):
    drawn = [t for _, t in pairs] + ["AbÄ", "Äb", "", None, "a\x00b", "tail", "head"]
    found, text = divergence.terms_of(pa.array(drawn))
    got = defaultdict(list)
    for term, t in zip(found.to_pylist(), text.tolist()):
        got[t].append(term.decode())
    assert [got[i] for i in range(len(drawn))] == [TERM.findall(fold(t)) for t in drawn]


def test_wide_shares_are_exact(spark):
    from pyspark.sql import functions as F

    df = spark.range(1).select(F.lit(10**15).alias("n"), F.lit(3 * 10**15 + 7).alias("words"), F.lit(12345).alias("terms"))
    got = df.select(divergence.share(df.n, df.words, df.terms).alias("p")).first().p
    assert got == 1 + 10**9 * (10**15 + 2) // (3 * 10**15 + 7 + 2 * 12345)
