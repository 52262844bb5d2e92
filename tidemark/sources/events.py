"""Event messages: JSON text to event rows and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import REQUEST_COMPLETED
from tidemark.functions.fields import (
    compute_once,
    instant_text,
    is_number_type,
    variant_node,
)
from tidemark.functions.values import to_long

# The payload numbers of request.completed that are whole by contract.
WHOLE_NUMBER_FIELDS = ("count", "statusCode", "latencyMs")

_INSTANT = r"^\d{4}-\d{2}-\d{2}[Tt]\d{2}:\d{2}:\d{2}(\.\d{1,9})?([Zz]|[-+]\d{2}:\d{2})$"

def _text_in(node: Column) -> Column:
    """The text of a variant node if it is a non-blank JSON string, else null."""
    text = F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(node, "$", "string"))
    return F.when(text.rlike(r"\S"), text)


def _is_object(node: Column) -> Column:
    return F.coalesce(F.startswith(F.schema_of_variant(node), F.lit("OBJECT")), F.lit(False))


def normalize_payload(event_type: Column, payload: Column) -> Column:
    """Truncate the contractually whole numbers of ``request.completed``; leave all else.

    The object is rebuilt only for rows that carry such a number in another form.
    """

    def replacement(name: str) -> Column:
        node = variant_node(payload, [name])
        kind = F.schema_of_variant(node)
        whole = F.coalesce(
            F.try_variant_get(node, "$", "bigint"),
            to_long(F.try_variant_get(node, "$", "double")),
        )
        return F.when(is_number_type(kind) & (kind != "BIGINT"), whole)

    fixed = F.filter(
        F.array(
            *[
                F.struct(F.lit(n).alias("key"), replacement(n).cast("variant").alias("value"))
                for n in WHOLE_NUMBER_FIELDS
            ]
        ),
        lambda entry: entry["value"].isNotNull(),
    )
    needed = F.coalesce(*[replacement(n) for n in WHOLE_NUMBER_FIELDS]).isNotNull()
    untouched = F.map_filter(
        payload.cast("map<string, variant>"),
        lambda key, _: ~F.array_contains(F.transform(fixed, lambda entry: entry["key"]), key),
    )
    rebuilt = F.to_variant_object(F.map_concat(untouched, F.map_from_entries(fixed)))
    return F.when((event_type == REQUEST_COMPLETED) & needed, rebuilt).otherwise(payload)


def normalize_number(event_type: Column, number: Column) -> Column:
    """The same rule for one payload number held in a typed column."""
    whole = to_long(number.cast("double")).cast("double")
    return F.when(event_type == REQUEST_COMPLETED, whole).otherwise(number.cast("double"))


def decode_events(messages: DataFrame, value: str = "value") -> DataFrame:
    """Add event columns and ``problem`` (null when decoded) to rows holding JSON text.

    Never fails on bad input: such rows keep null event columns and say why.
    """
    parsed = compute_once(messages, F.try_parse_json(F.col(value)).alias("_doc"))
    doc = F.col("_doc")
    nodes = compute_once(
        parsed,
        F.coalesce(_is_object(doc), F.lit(False)).alias("_is_doc"),
        *[
            variant_node(doc, path.split(".")).alias("_" + path.replace(".", "_"))
            for path in (
                "entity", "entity.type", "entity.id", "payload",
                "eventId", "eventType", "eventTime",
            )
        ],
    )
    fields = compute_once(
        nodes,
        _is_object(F.col("_entity")).alias("_has_entity"),
        _is_object(F.col("_payload")).alias("_has_payload"),
        _text_in(F.col("_eventId")).alias("event_id"),
        _text_in(F.col("_eventType")).alias("event_type"),
        _text_in(F.col("_eventTime")).alias("_time_text"),
        F.struct(
            _text_in(F.col("_entity_type")).alias("type"),
            _text_in(F.col("_entity_id")).alias("id"),
        ).alias("entity"),
    )
    time_text = F.col("_time_text")
    fields = fields.withColumn(
        "event_time",
        F.when(time_text.rlike(_INSTANT), F.try_to_timestamp(F.upper(time_text))),
    )
    problem = (
        F.when(~F.col("_is_doc"), "malformed_json")
        .when(~F.col("_has_entity"), "entity_not_object")
        .when(~F.col("_has_payload"), "payload_not_object")
        .when(F.col("event_id").isNull(), "bad_event_id")
        .when(F.col("event_type").isNull(), "bad_event_type")
        .when(F.col("_time_text").isNull(), "bad_event_time")
        .when(F.col("event_time").isNull(), "unparsable_event_time")
        .when(F.col("entity.type").isNull(), "bad_entity_type")
        .when(F.col("entity.id").isNull(), "bad_entity_id")
    )
    return fields.select(
        *messages.columns,
        "event_id",
        "event_type",
        "event_time",
        "entity",
        F.when(
            F.col("_has_payload"), normalize_payload(F.col("event_type"), F.col("_payload"))
        ).alias("payload"),
        problem.alias("problem"),
    )


def encode_events(events: DataFrame) -> Column:
    """An event as JSON text, keys in the order id, type, time, entity, payload."""
    return F.to_json(
        F.struct(
            F.col("event_id").alias("eventId"),
            F.col("event_type").alias("eventType"),
            instant_text(F.col("event_time")).alias("eventTime"),
            F.struct(F.col("entity.type").alias("type"), F.col("entity.id").alias("id")).alias(
                "entity"
            ),
            F.col("payload"),
        )
    )
