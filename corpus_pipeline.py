"""Training-data pipeline: documents to packed sequences, stage by stage.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as
the next one's ``docs``. All but the last return the columns of ``documents``.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import exact, packing, quality_rules, similar, substring
from tidemark.session import materialize

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects. Null and empty texts have too few words and go; repeated rows are judged alike."""
    return quality_rules.keep_good(docs)


def distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal contents: that of the longest original text, then of the smallest id.

    Null, empty and blank texts are equal. Of a row that repeats, one stays.
    """
    return exact.drop_copies(docs)


def dissimilar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near duplicates.

    Near are texts of a similarity of about 0.8 or more over shingles of five words. Texts without words are near
    each other; rows that share an id, or have none, stay or go together.
    """
    return similar.keep_first(docs)


def fresh(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that occur elsewhere too, also in a row that repeats; null and short texts stay as they are."""
    return substring.cut_passages(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places of all tokenised pieces in sequences of fixed length. A null or empty text is its end mark alone."""
    return packing.pack_documents(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", good),
    ("exact_dedup", distinct),
    ("near_dedup", dissimilar),
    ("substring_dedup", fresh),
    ("packing", packed),
]

# Neither the fingerprints of near_dedup nor the tokenizer of packing has an SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
