"""Declared field filters as boolean Columns."""

from __future__ import annotations

import operator
import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.definitions import FieldFilter
from tidemark.functions.fields import ABSENT, NUMBER, TEXT, Resolver

_COMPARE = {
    "EQ": operator.eq,
    "NE": operator.ne,
    "GT": operator.gt,
    "GTE": operator.ge,
    "LT": operator.lt,
    "LTE": operator.le,
}
# Fixed value: the text of numbers, as filter values may write them.
DECIMAL_LITERAL = r"\s*([-+]?(?:NaN|Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?))[fFdD]?\s*"


@dataclass(frozen=True)
class CompiledFilter:
    """``matches`` is never null; ``unusable`` marks a number held against non-numeric text."""

    matches: Column
    unusable: Column


def _literal_number(text: str) -> float | None:
    number = re.fullmatch(DECIMAL_LITERAL, text)
    return float(number.group(1)) if number else None


def compile_filter(flt: FieldFilter | None, field: Resolver) -> CompiledFilter:
    """No filter matches everything; a missing field matches nothing, also under ``NE``."""
    if flt is None:
        return CompiledFilter(F.lit(True), F.lit(False))
    value = field(flt.field)
    if flt.operator == "EXISTS":
        return CompiledFilter(value.present, F.lit(False))
    if value.kind == ABSENT:
        return CompiledFilter(F.lit(False), F.lit(False))

    compare = _COMPARE[flt.operator]
    literal = _literal_number(flt.value)
    as_text = F.coalesce(compare(value.text, F.lit(flt.value)), F.lit(False))
    if literal is None:
        as_number, unusable = F.lit(False), value.is_number
    else:
        as_number = F.coalesce(compare(value.number, F.lit(literal)), F.lit(False))
        unusable = F.lit(False)

    if value.kind == NUMBER:
        return CompiledFilter(as_number, unusable)
    if value.kind == TEXT:
        return CompiledFilter(as_text, F.lit(False))
    matches = F.when(value.is_number, as_number).otherwise(as_text)
    return CompiledFilter(F.coalesce(matches, F.lit(False)), unusable)
