"""Text form of feature keys: ``feature:{entity type}:{entity id}:{name}[:window:{millis}]``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIX = "feature"
SEPARATOR = ":"


def key_problem(*parts: Column) -> Column:
    """Null when every part may stand in a key, else what is wrong."""
    blank = F.lit(False)
    separated = F.lit(False)
    for part in parts:
        blank = blank | F.coalesce(F.trim(part) == "", F.lit(True))
        separated = separated | F.coalesce(F.contains(part, F.lit(SEPARATOR)), F.lit(False))
    return F.when(blank, F.lit("blank_key_part")).when(separated, F.lit("bad_key"))


def feature_key(
    entity_type: Column, entity_id: Column, name: Column, window_start: Column | None = None
) -> Column:
    """Key text; null when a part is blank or holds the separator."""
    latest = F.concat_ws(SEPARATOR, F.lit(PREFIX), entity_type, entity_id, name)
    text = latest
    if window_start is not None:
        windowed = F.concat_ws(
            SEPARATOR, latest, F.lit("window"), F.unix_millis(window_start).cast("string")
        )
        text = F.when(window_start.isNull(), latest).otherwise(windowed)
    return F.when(key_problem(entity_type, entity_id, name).isNull(), text)


def parse_key(key: Column) -> Column:
    """Struct of the key's parts; null for text that is not a key of either form."""
    parts = F.split(key, SEPARATOR)
    millis = F.try_element_at(parts, F.lit(6)).try_cast("bigint")
    plain = F.size(parts) == 4
    windowed = (
        (F.size(parts) == 6)
        & (F.try_element_at(parts, F.lit(5)) == "window")
        & millis.isNotNull()
    )
    parsed = F.struct(
        F.try_element_at(parts, F.lit(2)).alias("entity_type"),
        F.try_element_at(parts, F.lit(3)).alias("entity_id"),
        F.try_element_at(parts, F.lit(4)).alias("feature_name"),
        F.when(windowed, F.timestamp_millis(millis)).alias("window_start"),
    )
    return F.when(plain | windowed, parsed)
