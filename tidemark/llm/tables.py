"""Scratch tables, keys and connected components shared by the operators."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.session import materialize

SPACES = " \t\n\x0b\x0c\r"


def replaced(docs: DataFrame, **columns: Column) -> DataFrame:
    """Add columns; an input column of the same name, in any case, gives way."""
    lower = {c.lower() for c in columns}
    keep = [F.col(f"`{c}`") for c in docs.columns if c.lower() not in lower]
    return docs.select(*keep, *[v.alias(k) for k, v in columns.items()])


def unused(docs: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``docs`` has it in any case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge: columns ``node``, ``root``.

    Alternates large-star and small-star steps: every node tells its larger
    neighbours, then its smaller ones, of the smallest node it knows. Each step groups
    edges by node with partial aggregation, so a node of very high degree costs one
    row per task, and joins the result back; the number of edges never grows beyond
    the input. Every round is written to shared scratch, so lost executors cost one round;
    rounds go on until nothing changes, about the logarithm of the longest path.
    """
    links = (
        edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v"))
        .where(F.col("u") != F.col("v"))
        .distinct()
    )
    links = materialize(links, "links")
    settled = False
    while not settled:
        both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # Written first, so that the join is free to split a node of very many links.
        low = materialize(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), "low")
        large = (
            both.where(F.col("v") > F.col("u"))
            .join(low.hint("merge"), "u")
            .select(F.col("v").alias("u"), F.col("m").alias("v"))
            .distinct()
        )
        large = materialize(large, "large")
        low = materialize(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = (
            large.join(low.hint("merge"), "u")
            .select(F.explode(F.array(
                F.struct(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v")),
                F.struct(F.col("u").alias("u"), F.col("m").alias("v")),
            )).alias("e"))
            .select("e.*")
            .where(F.col("u") != F.col("v"))
            .distinct()
        )
        small = materialize(small, "links")
        # Done when every node points straight at one root that points at nothing.
        heads = small.groupBy("u").agg(F.count("*").alias("n"))
        open_ends = small.join(heads.select(F.col("u").alias("v")), "v", "left_semi")
        many = heads.where("n > 1")
        links = small
        settled = not (many.limit(1).count() or open_ends.limit(1).count())
    roots = links.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
