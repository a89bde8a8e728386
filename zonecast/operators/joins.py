"""Size-checked broadcast.

A side is broadcast only when its row count is known to be under a bound;
otherwise the join stays a shuffle join (sort-merge with AQE skew splitting).
Fitted lookup tables are small *by construction* (one row per zone, prefix or
category) but their size still grows with the data, so the check is explicit.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows of a lookup table that may be shipped to every executor.  At ~100 bytes
# per zone row this is ~200 MB, under the default broadcast ceiling of 8 GB
# and comfortably inside executor memory.
BROADCAST_MAX_ROWS = 2_000_000


def maybe_broadcast(df: DataFrame, n_rows: int | None = None,
                    max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Broadcast hint iff the (known or counted) row count is within the bound."""
    if n_rows is None:
        n_rows = df.count()
    return F.broadcast(df) if n_rows <= max_rows else df
