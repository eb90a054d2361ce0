"""Running last-digit counts of a stream of cells; detectors then run on the counts of each micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.series import clean, decimals


def running_digit_counts(cells: DataFrame) -> DataFrame:
    """(ds, digit, c) so far; state is ten rows a series."""
    return decimals(clean(cells)).where("last_digit is not null").groupBy("ds", F.col("last_digit").alias("digit")).agg(F.count("*").alias("c"))


def each_batch(cells: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands the updated counts of each micro-batch to `handle`."""
    return running_digit_counts(cells).writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(handle).trigger(availableNow=True).start()
