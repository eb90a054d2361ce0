"""Numbers as spreadsheets show them: coercion, decimals of a format, displayed text and its decimals."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMERIC = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?%?$"


def coerce_number(text: Column) -> Column:
    """A number typed as text, with separators and percent; null if it isn't one."""
    t = F.regexp_replace(F.trim(text), ",", "")
    number = F.regexp_replace(t, "%$", "").try_cast("double")
    return F.when(t.rlike(NUMERIC), F.when(t.endswith("%"), number / 100).otherwise(number))


def format_decimals(fmt: Column) -> Column:
    """Digits after the point in the first section of a number format; null for none and General."""
    first = F.element_at(F.split(fmt, ";"), 1)
    digits = F.regexp_extract(first, r"\.([0#?]*)", 1)
    return F.when(fmt.isNull() | (F.lower(first) == "general") | (first == ""), None).when(~first.contains("."), 0).otherwise(F.length(digits))


@F.pandas_udf(T.StringType())
def display_text(value: pd.Series, places: pd.Series, percent: pd.Series) -> pd.Series:
    """The number as a sheet shows it: fixed places if the format has them, else 15 significant digits."""

    def one(v: float, d: float, p: bool) -> str | None:
        if v is None or v != v:
            return None
        if d == d and d is not None:
            return f"{v * 100:.{int(d)}f}%" if p else f"{v:.{int(d)}f}"
        return f"{v:.15g}"

    return pd.Series([one(*r) for r in zip(value, places, percent)])


def decimal_metadata(raw: Column) -> dict[str, Column]:
    """decimal_places, last_decimal_digit and suffix_1 to 3 of a displayed number."""
    t = F.regexp_replace(raw, "[,%]", "")
    plain = F.when(t.rlike("[eE]"), F.regexp_replace(F.format_string("%.15f", t.try_cast("double")), r"0+$", "")).otherwise(t)
    frac = F.regexp_extract(plain, r"\.(\d+)$", 1)
    out = {"decimal_places": F.when(raw.isNotNull(), F.length(frac)), "last_decimal_digit": F.when(frac != "", F.right(frac, F.lit(1)).cast("int"))}
    return out | {f"suffix_{k}": F.when(F.length(frac) >= k, F.right(frac, F.lit(k))) for k in (1, 2, 3)}
