"""File heads to file contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Heads, of a few numbers each, that are broadcast at most.
MOST = 100_000


def joined(files: DataFrame, head: DataFrame, key: str) -> DataFrame:
    """files with their heads. Heads are counted and broadcast, so that contents stay where they are read; only of more than
    MOST files both sides are shuffled."""
    return files.join(F.broadcast(head) if head.count() <= MOST else head, key)
