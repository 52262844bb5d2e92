"""Event field paths as Columns.

A path such as ``statusCode`` or ``payload.device.os`` is turned into Columns once, on the
driver. On a struct payload its type is known from the schema, so no per-row type test is
left in the plan; on a VARIANT payload the type is tested per row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

NUMBER = "number"
TEXT = "text"
MIXED = "mixed"
ABSENT = "absent"

@dataclass(frozen=True)
class FieldValue:
    """One resolved path. ``number`` is null unless the value is a number."""

    kind: str
    present: Column
    number: Column
    text: Column
    is_number: Column
    node: Column | None = None


def instant_text(ts: Column) -> Column:
    """ISO instant text: seconds always, then 0, 3 or 6 fraction digits, then ``Z``."""
    micros = F.pmod(F.unix_micros(ts), F.lit(1_000_000))
    fraction = (
        F.when(micros == 0, F.lit(""))
        .when(micros % 1000 == 0, F.date_format(ts, ".SSS"))
        .otherwise(F.date_format(ts, ".SSSSSS"))
    )
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"), fraction, F.lit("Z"))


def _text_value(column: Column) -> FieldValue:
    return FieldValue(
        TEXT, column.isNotNull(), F.lit(None).cast("double"), column, F.lit(False)
    )


def _absent() -> FieldValue:
    nothing = F.lit(None)
    return FieldValue(
        ABSENT, F.lit(False), nothing.cast("double"), nothing.cast("string"), F.lit(False)
    )


def _typed_value(column: Column, data_type: T.DataType) -> FieldValue:
    if isinstance(data_type, T.NumericType):
        return FieldValue(
            NUMBER,
            column.isNotNull(),
            column.cast("double"),
            column.cast("string"),
            column.isNotNull(),
        )
    if isinstance(data_type, T.TimestampType):
        return _text_value(instant_text(column))
    if isinstance(data_type, (T.StructType, T.MapType, T.ArrayType)):
        return _text_value(F.to_json(column))
    return _text_value(column.cast("string"))


def is_number_type(variant_type: Column) -> Column:
    """Whether the text of ``schema_of_variant`` names a number."""
    return variant_type.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(
        variant_type, F.lit("DECIMAL")
    )


def variant_node(document: Column, segments: list[str]) -> Column:
    return F.try_variant_get(document, "$." + ".".join(segments), "variant")


def _node_value(node: Column, variant_type: Column) -> FieldValue:
    """A value from its variant node and that node's type text."""
    present = F.coalesce(variant_type != "VOID", F.lit(False))
    is_number = F.coalesce(is_number_type(variant_type), F.lit(False))
    return FieldValue(
        MIXED,
        present,
        F.when(is_number, F.try_variant_get(node, "$", "double")),
        F.when(present, F.try_variant_get(node, "$", "string")),
        is_number,
    )


def _variant_value(column: Column, segments: list[str]) -> FieldValue:
    node = variant_node(column, segments) if segments else column
    value = _node_value(node, F.schema_of_variant(node))
    return replace(value, node=node)


def resolve(schema: T.StructType, path: str) -> FieldValue:
    """The Columns of ``path`` for events of this ``schema``; null counts as absent."""
    envelope = {
        "eventId": F.col("event_id"),
        "eventType": F.col("event_type"),
        "eventTime": instant_text(F.col("event_time")),
        "entity.type": F.col("entity.type"),
        "entity.id": F.col("entity.id"),
    }
    if path in envelope:
        return _text_value(envelope[path])

    segments = path.removeprefix("payload.").split(".")
    column, data_type = F.col("payload"), schema["payload"].dataType
    for depth, segment in enumerate(segments):
        if isinstance(data_type, T.VariantType):
            return _variant_value(column, segments[depth:])
        if isinstance(data_type, T.StructType):
            if segment not in data_type.names:
                return _absent()
            column, data_type = column.getField(segment), data_type[segment].dataType
        elif isinstance(data_type, T.MapType):
            column, data_type = column.getItem(segment), data_type.valueType
        else:
            return _absent()
    if isinstance(data_type, T.VariantType):
        return _variant_value(column, [])
    return _typed_value(column, data_type)


Resolver = Callable[[str], FieldValue]


def resolver(schema: T.StructType) -> Resolver:
    return lambda path: resolve(schema, path)


def compute_once(rows: DataFrame, *columns: Column) -> DataFrame:
    """Add columns that later filters do not copy below this point.

    A filter on a projected column is rewritten onto its inputs, so a parsed document would be
    parsed again for each use. A one-row ``inline`` is not looked through.
    """
    return rows.select("*", F.inline(F.array(F.struct(*columns))))


def prepare_fields(events: DataFrame, paths: Iterable[str]) -> tuple[DataFrame, Resolver]:
    """Events with every dynamic path extracted once, and a resolver that reads those columns.

    Paths whose type the schema gives are left alone: reading them costs nothing.
    """
    extracted: dict[str, FieldValue] = {}
    nodes, types = [], []
    for path in sorted(set(paths)):
        value = resolve(events.schema, path)
        if value.kind != MIXED:
            continue
        node, kind = f"_node{len(nodes)}", f"_type{len(nodes)}"
        nodes.append(value.node.alias(node))
        types.append(F.schema_of_variant(F.col(node)).alias(kind))
        extracted[path] = _node_value(F.col(node), F.col(kind))
    prepared = compute_once(compute_once(events, *nodes), *types) if nodes else events
    return prepared, lambda path: extracted.get(path) or resolve(events.schema, path)
