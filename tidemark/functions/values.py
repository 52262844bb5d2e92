"""Text form of feature values, and back."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_TWO_63 = float(2**63)


def to_long(number: Column) -> Column:
    """Truncate toward zero; beyond the long range the nearest long, NaN as 0."""
    return (
        F.when(F.isnan(number), F.lit(0).cast("bigint"))
        .when(number >= F.lit(_TWO_63), F.lit(2**63 - 1))
        .when(number <= F.lit(-_TWO_63), F.lit(-(2**63)))
        .otherwise(number.try_cast("bigint"))
    )


def number_text(value: Column) -> Column:
    """Whole numbers as long text (``450``), all else as double text (``0.25``)."""
    whole = ~F.isnan(value) & (value == F.rint(value)) & (F.abs(value) <= F.lit(_TWO_63))
    return F.when(whole, to_long(value).cast("string")).otherwise(value.cast("string"))


def value_text(is_integral: Column, value: Column) -> Column:
    """Counts and sums print whole numbers as longs; averages and ratios stay doubles."""
    return F.when(is_integral, number_text(value)).otherwise(value.cast("string"))


def parse_value(text: Column) -> Column:
    """Stored text as a number: double if it has ``.``/``e``/``E``, else long; null if neither."""
    is_double = text.rlike("[.eE]")
    return F.when(is_double, text.try_cast("double")).otherwise(
        F.when(text.rlike(r"^[-+]?\d+$"), text.try_cast("bigint")).cast("double")
    )
