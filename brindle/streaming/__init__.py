"""Records handed to a callback one by one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row


def each_record(df: DataFrame, call: Callable[[Row], None]) -> int:
    """Calls ``call`` with every row, a partition at a time on the driver, and returns how many there were."""
    n = 0
    for row in df.toLocalIterator(prefetchPartitions=True):
        call(row)
        n += 1
    return n
