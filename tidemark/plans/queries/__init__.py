"""All registered queries, by area."""

from tidemark.plans.queries import (  # noqa: F401
    adjusting,
    coverage,
    publishing,
    rows,
    scalars,
    snapshots,
)
