"""Error reports as a stream: the first of each kind within a delay."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def first_errors(stream: DataFrame, ts: str = "ts", delay: str = "10 minutes") -> DataFrame:
    """Reports (message, filename, lineno, stack, ts) without repeats that come within the delay; state is bounded by the watermark."""
    seen = stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["message", "filename", "lineno"])
    return seen.withColumns({"message": F.substring("message", 1, 500), "stack": F.substring("stack", 1, 2000)})
