"""Steps of a long derivation."""

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it is used.

    With plain projections the optimizer writes a derived column out again in every
    later column and filter that uses it; a chain of rules then grows beyond what can
    be compiled. A lambda variable keeps each step a step.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))
