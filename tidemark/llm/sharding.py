"""Placement of documents on shards by a permutation-filled lookup table.

Every shard has its own permutation of the slots of a table of prime size. Shards take turns
and claim the first slot of their permutation that is still free, until the table is full. A
key is hashed to a slot and looks its shard up in the broadcast table, which has a fixed number of rows.
Shards get equal numbers of slots (within one), and when one leaves, few keys of the others move.
"""

from collections.abc import Sequence
from hashlib import md5

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SLOTS = 65_537
SHARDS = tuple(f"shard-{i:03d}" for i in range(64))


def _is_prime(n: int) -> bool:
    return n > 1 and all(n % k for k in range(2, int(n**0.5) + 1))


def lookup_table(shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> list[int]:
    """Index of the shard of every slot. ``slots`` must be prime and not below the shards."""
    if not _is_prime(slots):
        raise ValueError(f"the number of slots must be prime, not {slots}")
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("shards must be distinct, at least one, and no more than slots")
    digests = [md5(s.encode()).digest() for s in shards]
    at = [int.from_bytes(d[:8], "big") % slots for d in digests]
    step = [int.from_bytes(d[8:], "big") % (slots - 1) + 1 for d in digests]
    table = [-1] * slots
    for turn in range(slots):
        k = turn % len(shards)
        while table[at[k]] >= 0:
            at[k] = (at[k] + step[k]) % slots
        table[at[k]] = k
    return table


def slot_of(key: Column, slots: int = SLOTS) -> Column:
    """Slot of a key by the first 60 bits of the MD5 of its text; null counts as empty text."""
    text = F.coalesce(key.cast("string"), F.lit(""))
    return F.pmod(F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long"), F.lit(slots)).cast("int")


def table_rows(spark: SparkSession, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> DataFrame:
    """The lookup table: ``slot``, ``shard`` (name)."""
    rows = [(i, shards[k]) for i, k in enumerate(lookup_table(shards, slots))]
    return spark.createDataFrame(rows, "slot int, shard string")


def placed(
    docs: DataFrame, shards: Sequence[str] = SHARDS, slots: int = SLOTS, key: str = "doc_id"
) -> DataFrame:
    """``docs`` with ``slot`` and ``shard``; columns of these names are replaced.

    No shuffle: the table has ``slots`` rows and is broadcast. Rows of one key, repeated or
    null, share a shard. Empty input gives no rows.
    """
    names = [c for c in docs.columns if c.lower() not in ("slot", "shard")]
    keyed = docs.select(*[f"`{c}`" for c in names], slot_of(F.col(f"`{key}`"), slots).alias("slot"))
    return keyed.join(F.broadcast(table_rows(docs.sparkSession, shards, slots)), "slot", "left").select(
        *[f"`{c}`" for c in names], "slot", "shard"
    )


def assignments(docs: DataFrame) -> DataFrame:
    """Contract of the registered query: place of every document."""
    return placed(docs.select("doc_id"))


def write_shards(docs: DataFrame, folder: str, shards: Sequence[str] = SHARDS, slots: int = SLOTS) -> None:
    """Write one folder per shard; tasks write their own files, so a large shard is not one task."""
    placed(docs, shards, slots).write.partitionBy("shard").parquet(folder)


def moved(before: Sequence[int], after: Sequence[int], old: Sequence[str], new: Sequence[str]) -> float:
    """Share of slots whose shard differs between two tables of one size."""
    return sum(old[a] != new[b] for a, b in zip(before, after)) / len(before)
