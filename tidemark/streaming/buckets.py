"""Instances that share a state row of a keyed stream.

A call, a state row and a timer of their own cost milliseconds each, far more than an instance's few rows of a
micro-batch. So instances are dealt over a fixed number of buckets by hash; the state of a bucket lists what is
known of each of its instances. A micro-batch costs as many calls as buckets, however many instances there are.
"""

import json

from pyspark.sql import DataFrame, GroupedData
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState

COUNT = 1024  # a stream keeps its number as long as its checkpoint
STATE = "known STRING"


def grouped(rows: DataFrame, count: int = COUNT) -> GroupedData:
    """Rows grouped by the bucket of their instance."""
    return rows.withColumn("bucket", F.pmod(F.xxhash64("instance"), F.lit(count))).groupBy("bucket")


def load(state: GroupState) -> list[tuple[str | None, list]]:
    """Instances of a bucket and what is known of each."""
    return [tuple(item) for item in json.loads(state.get[0])] if state.exists else []


def store(state: GroupState, known: list[tuple[str | None, object]]) -> None:
    state.update((json.dumps(known, separators=(",", ":")),))
