"""Training samples: one row of each chosen content, whatever the ids, and whole texts."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import language, quality_model

SCHEMA = "doc_id long, text string, lang string"


def spelt(i: int) -> str:
    return "".join("abcdefghij"[int(c)] for c in str(i))


@pytest.mark.parametrize("hot", [None, 7])
def test_hot_ids_neither_repeat_nor_crowd_out(spark, monkeypatch, hot):
    monkeypatch.setattr(language, "TEXTS_PER_LANGUAGE", 40)
    monkeypatch.setattr(language, "TEXTS", 60)
    rows = [(hot, f"hot text {spelt(i % 80)}", lang) for i in range(1600) for lang in ("aa", "bb")]
    rows += [(i + 100, f"plain text {spelt(i)}", lang) for i in range(400) for lang in ("aa", "bb")]
    got = language.sample(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    have = [(tuple(b.tolist()), lang) for (b, _), lang in got]
    assert len(have) == 60 == len(set(have))
    kinds = Counter(kind for kind in ("hot", "plain") for b, _ in have if marks(f" {kind} ") <= set(b))
    assert kinds["plain"] > kinds["hot"] > 0


def marks(text: str) -> set[int]:
    return {int(b) for _, buckets in language.subwords(np.frombuffer(text.encode(), np.uint8)) for b in buckets}


def test_long_texts_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(language, "TEXTS_PER_LANGUAGE", 20)
    long = [(i, f"{i} " + "lange wörter " * 40_000 + "ende", "de") for i in range(60)]
    rows = long + [(i, f"{i} short words", "en") for i in range(100, 160)] + [(i, "12", "en") for i in range(200, 3000)]
    got = language.sample(spark.createDataFrame(rows, SCHEMA), F.lit(True))
    assert Counter(lang for _, lang in got) == {"de": 20, "en": 20}
    for (buckets, n), lang in got:
        assert lang == "en" or (marks(" ende ") <= set(buckets.tolist()) and n.sum() > 40_000 * 20)


def test_labelled_rows_are_bounded(spark, monkeypatch):
    """Repeated and hot labelled ids give no more rows than the bound; long texts are learned from."""
    monkeypatch.setattr(quality_model, "ROWS", 50)
    rows = [(7, f"hot text {i % 400}") for i in range(2000)] + [(i, "a plain one") for i in range(100, 140) for _ in "ab"]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1), (7, 0), *[(i, 1) for i in range(100, 140)]], "doc_id long, quality int")
    x, y = quality_model.sample(df, labels, F.lit(True))
    assert len(x) == len(y) == 50
    monkeypatch.setattr(quality_model, "ROWS", 5000)
    x, y = quality_model.sample(df, labels, F.lit(True))
    assert len(y) == 440 and y.sum() == 40
    long = spark.createDataFrame([(1, "word " * 60_000)], "doc_id long, text string")
    x, y = quality_model.sample(long, spark.createDataFrame([(1, 1)], "doc_id long, quality int"), F.lit(True))
    assert y.tolist() == [1] and x[0, 0] == np.log1p(60_000)
