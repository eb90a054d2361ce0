"""Numeric series in long form: one row a cell, (ds, pos, value, raw); ds names the series, pos orders it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def clean(cells: DataFrame) -> DataFrame:
    """Without nulls, NaN and infinities."""
    v = F.col("value")
    return cells.where(v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))


def decimals(cells: DataFrame) -> DataFrame:
    """With last_digit, suffix2 and suffix3 of the displayed text; null where it is too short."""
    frac = F.regexp_extract(F.regexp_replace("raw", "[,%]", ""), r"\.(\d+)$", 1)
    digit = F.when(F.length(frac) > 0, F.right(frac, F.lit(1)).cast("int"))
    return cells.withColumns({"last_digit": digit} | {f"suffix{k}": F.when(F.length(frac) >= k, F.right(frac, F.lit(k))) for k in (2, 3)})


def arrays(cells: DataFrame) -> DataFrame:
    """(ds, n, vs): each series' values in order. A series is one row, so it must fit in one."""
    return cells.groupBy("ds").agg(F.count("*").cast("int").alias("n"), F.expr("transform(array_sort(collect_list(struct(pos, value))), x -> x.value)").alias("vs"))


def informative(series: DataFrame) -> DataFrame:
    """Without all-zero series, and those of at least 80 % zeros with under five other values."""
    zeros = F.expr("size(filter(vs, v -> abs(v) <= 1e-12))")
    return series.where((zeros < F.col("n")) & ~((zeros >= 0.8 * F.col("n")) & (F.col("n") - zeros < 5)))


def low_information(cells: DataFrame) -> DataFrame:
    """ds of the series that `informative` leaves out, from long form."""
    zero = F.abs("value") <= 1e-12
    found = cells.groupBy("ds").agg(F.count("*").alias("n"), F.count_if(zero).alias("z"))
    return found.where((F.col("z") == F.col("n")) | ((F.col("z") >= 0.8 * F.col("n")) & (F.col("n") - F.col("z") < 5))).select("ds")
