"""Declarations as data: features straight from the rows of the registry table.

``tidemark.plans.features`` compiles each declaration into the plan. Here the plan is the same
whatever is declared: an event meets the declarations of its type as one array (the registry is
joined by event type, one row per type), and filters, values and windows are evaluated from that
array's entries. Each distinct path of those declarations is read once per event, and what an event
adds to its declarations is computed behind a barrier, once. Planning takes constant time, so hundreds of declarations, or ones that change
from micro-batch to micro-batch, cost nothing to plan. Per row the compiled form is faster, as it
knows types and paths beforehand.

Reasons of refused events are the first by (name, version).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.definitions import ANY_ENTITY, NEEDS_VALUE
from tidemark.functions.fields import compute_once, instant_text, is_number_type
from tidemark.functions.filters import DECIMAL_LITERAL
from tidemark.functions.keys import key_problem
from tidemark.functions.windows import floor_to
from tidemark.plans.features import ENTITY_KEYS, FEATURE_KEYS
from tidemark.sources.registry import active, duration_millis

IDENTITY = ["feature_name", "definition_version"]
# What a declaration reads of an event: the name of the value and the column with its path.
READS = {"filter": "filter_field", "numerator": "numerator_field", "value": "value_field", "weight": "weight_field"}


def _gcd(a: Column, b: Column) -> Column:
    """Euclid's algorithm; 92 divisions are enough for longs."""
    return F.aggregate(
        F.sequence(F.lit(1), F.lit(92)),
        F.struct(a.alias("a"), b.alias("b")),
        lambda x, _: F.when(x["b"] == 0, x).otherwise(
            F.struct(x["b"].alias("a"), F.try_mod(x["a"], x["b"]).alias("b"))
        ),
        lambda x: x["a"],
    )


def declaration_rows(registry: DataFrame) -> DataFrame:
    """Active declarations with lengths in millis, the pane of their windows and literal numbers."""

    def number(text: str) -> Column:
        return F.when(F.col(text).rlike(f"^(?:{DECIMAL_LITERAL})$"), F.col(text).try_cast("double"))

    size = duration_millis(F.col("window_size"))
    slide = F.coalesce(duration_millis(F.col("slide")), size)
    slides = (F.col("window_type") == "SLIDING") & (slide < size)
    return active(registry).select(
        F.col("name").alias("feature_name"),
        F.col("version").alias("definition_version"),
        "event_type",
        F.col("entity_type").alias("scope"),
        "aggregation_type",
        "value_field",
        F.when(F.col("weight_field").rlike(r"\S"), F.col("weight_field")).alias("weight_field"),
        "filter_field",
        "filter_operator",
        "filter_value",
        number("filter_value").alias("filter_number"),
        F.col("numerator_filter_field").alias("numerator_field"),
        F.col("numerator_filter_operator").alias("numerator_operator"),
        F.col("numerator_filter_value").alias("numerator_value"),
        number("numerator_filter_value").alias("numerator_number"),
        size.alias("size_ms"),
        slide.alias("slide_ms"),
        F.when(slides, _gcd(size, slide)).otherwise(size).alias("pane_ms"),
    )


def _document(events: DataFrame) -> Column:
    payload = F.col("payload")
    is_variant = isinstance(events.schema["payload"].dataType, T.VariantType)
    return payload if is_variant else F.to_variant_object(payload)


def _inside(path: Column) -> Column:
    """The path of a field within a payload."""
    return F.concat(F.lit("$."), F.regexp_replace(path, F.lit(r"^payload\."), F.lit("")))


def _nodes(paths: Column) -> Column:
    """Per path the payload's variant there, its type text and the text of an envelope field."""
    envelope = {
        "eventId": F.col("event_id"),
        "eventType": F.col("event_type"),
        "eventTime": instant_text(F.col("event_time")),
        "entity.type": F.col("entity.type"),
        "entity.id": F.col("entity.id"),
    }

    def own(path: Column) -> Column:
        text = F.lit(None).cast("string")
        for name, column in envelope.items():
            text = F.when(path == name, column).otherwise(text)
        return text

    return F.transform(
        paths,
        lambda path: F.struct(
            F.coalesce(path.isin(*envelope), F.lit(False)).alias("is_own"),
            own(path).alias("own"),
            F.try_variant_get(F.col("_document"), _inside(path), "variant").alias("node"),
        ),
    )


def _field(x: Column) -> Column:
    """What an event has at a path: (present, is_number, number, text)."""
    kind = F.schema_of_variant(x["node"])
    in_payload = F.coalesce(kind != "VOID", F.lit(False))
    is_number = ~x["is_own"] & F.coalesce(is_number_type(kind), F.lit(False))
    text = F.when(x["is_own"], x["own"]).when(in_payload, F.try_variant_get(x["node"], F.lit("$"), "string"))
    return F.struct(
        F.when(x["is_own"], x["own"].isNotNull()).otherwise(in_payload).alias("present"),
        is_number.alias("is_number"),
        F.when(is_number, F.try_variant_get(x["node"], F.lit("$"), "double")).alias("number"),
        text.alias("text"),
    )


def _compare(operator: Column, left: Column, right: Column) -> Column:
    found = (
        F.when(operator == "EQ", left == right)
        .when(operator == "NE", left != right)
        .when(operator == "GT", left > right)
        .when(operator == "GTE", left >= right)
        .when(operator == "LT", left < right)
        .when(operator == "LTE", left <= right)
    )
    return F.coalesce(found, F.lit(False))


def _filter(d: Column, prefix: str, value: Column) -> tuple[Column, Column]:
    """Whether an event passes a declared filter, and whether the filter cannot judge it."""
    operator, number = d[f"{prefix}_operator"], d[f"{prefix}_number"]
    compares = F.coalesce(operator != "EXISTS", F.lit(False))
    matches = (
        F.when(operator.isNull(), F.lit(True))
        .when(operator == "EXISTS", value["present"])
        .when(value["is_number"], _compare(operator, value["number"], number))
        .otherwise(_compare(operator, value["text"], d[f"{prefix}_value"]))
    )
    return matches, compares & value["is_number"] & number.isNull()


def _contribution(d: Column) -> Column:
    """What an event adds to declaration ``d``, or what is wrong with it."""
    value, weight, filtered, counts = (F.get("_fields", d[f"{what}_at"]) for what in ("value", "weight", "filter", "numerator"))
    kind = d["aggregation_type"]
    in_scope = F.coalesce((d["scope"] == ANY_ENTITY) | (d["scope"] == F.col("entity.type")), F.lit(False))
    passes, unusable = _filter(d, "filter", filtered)
    counted, numerator_unusable = _filter(d, "numerator", counts)
    matches = in_scope & passes
    weighted = (kind == "AVG") & d["weight_field"].isNotNull()
    numeric = kind.isin("SUM", "AVG", "RATIO")

    def missing(field: str) -> Column:
        return F.concat(F.lit("missing "), d[field])

    def not_number(field: str) -> Column:
        return F.concat(d[field], F.lit(" is not a number"))

    problem = F.when(in_scope & unusable, F.lit("filter value is not a number")).when(
        matches,
        F.when(kind.isin(*NEEDS_VALUE) & ~value["present"], missing("value_field"))
        .when(numeric & ~value["is_number"], not_number("value_field"))
        .when(weighted & ~weight["present"], missing("weight_field"))
        .when(weighted & ~weight["is_number"], not_number("weight_field"))
        .when((kind == "RATIO") & numerator_unusable, F.lit("numerator filter value is not a number")),
    )
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.struct(
        d["feature_name"].alias("feature_name"),
        d["definition_version"].alias("definition_version"),
        matches.alias("matches"),
        problem.alias("problem"),
        F.when(kind == "SUM", value["number"])
        .when(weighted, value["number"] * weight["number"])
        .when(kind == "AVG", value["number"])
        .when(kind == "RATIO", F.when(counted, value["number"]).otherwise(zero))
        .otherwise(one)
        .alias("num"),
        F.when(weighted, weight["number"])
        .when(kind == "AVG", one)
        .when(kind == "RATIO", value["number"])
        .otherwise(zero)
        .alias("den"),
        F.when(kind == "DISTINCT_COUNT", value["text"]).alias("distinct_value"),
        floor_to(F.unix_millis("event_time"), d["pane_ms"]).alias("start_ms"),
    )


def _declared_types(registry: DataFrame) -> DataFrame:
    """One row per event type: its declarations, and the distinct paths that they read.

    ``<what>_at`` is where in ``_paths`` a declaration's path is. The last path is null: where nothing
    is, for what a declaration does not name.
    """
    rows = declaration_rows(registry)
    facts = F.struct(*[c for c in rows.columns if c != "event_type"])
    types = rows.groupBy(F.col("event_type").alias("_type")).agg(F.array_sort(F.collect_list(facts)).alias("_declared"))
    named = F.flatten(F.transform("_declared", lambda d: F.array(*[d[path] for path in READS.values()])))
    paths = types.withColumn("_paths", F.array_append(F.array_compact(F.array_distinct(named)), F.lit(None)))

    def located(d: Column) -> Column:
        last = F.size("_paths")
        places = [
            (F.coalesce(F.array_position("_paths", d[path]).cast("int"), last) - 1).alias(f"{what}_at")
            for what, path in READS.items()
        ]
        return F.struct(*[d[c].alias(c) for c in rows.columns if c != "event_type"], *places)

    return paths.select("_type", "_paths", F.transform("_declared", located).alias("_declared"))


def evaluate(events: DataFrame, registry: DataFrame) -> DataFrame:
    """Events with ``supported``, ``failure`` and ``matched``: what they add to each declaration."""
    document = events.withColumn("_document", _document(events))
    met = document.join(_declared_types(registry), F.col("event_type") == F.col("_type"), "left")

    def empty(column: str) -> Column:
        return F.array().cast(met.schema[column].dataType)

    # Each step behind a barrier: later ones read it, and do not compute it again.
    known = compute_once(
        met,
        F.coalesce("_declared", empty("_declared")).alias("_all"),
        _nodes(F.coalesce("_paths", empty("_paths"))).alias("_nodes"),
    )
    read = compute_once(known, F.transform("_nodes", _field).alias("_fields"))
    judged = compute_once(read, F.transform("_all", _contribution).alias("_judged"))
    matched = F.filter("_judged", lambda c: c["matches"])
    problems = F.filter(F.transform("_judged", lambda c: c["problem"]), lambda p: p.isNotNull())
    supported = F.exists("_judged", lambda c: c["matches"])
    bad_key = F.when(supported, key_problem(F.col("entity.type"), F.col("entity.id")))
    verdict = compute_once(
        judged,
        supported.alias("supported"),
        F.coalesce(bad_key, F.try_element_at(problems, F.lit(1))).alias("failure"),
        matched.alias("matched"),
    )
    return verdict.select(*events.columns, "supported", "failure", "matched")


def match_declared(events: DataFrame, registry: DataFrame) -> DataFrame:
    """One row per (event, matching declaration)."""
    found = evaluate(events, registry).select(*events.columns, F.explode("matched").alias("m"))
    return found.select(*events.columns, *[f"m.{c}" for c in IDENTITY])


def compute_declared(events: DataFrame, registry: DataFrame, *, checked: bool = False) -> DataFrame:
    """Feature rows of every active declaration, as ``compute_features`` gives them.

    Events are reduced by (entity, declaration, pane) before sliding windows multiply them.
    """
    judged = evaluate(events, registry)
    if not checked:
        judged = judged.where(F.col("failure").isNull())
    sums = [
        F.sum("n").alias("n"),
        F.sum("num").alias("num"),
        F.sum("den").alias("den"),
        F.max("updated_at").alias("updated_at"),
    ]
    keys = [*ENTITY_KEYS, *IDENTITY]
    panes = (
        judged.select(
            F.col("entity.type").alias("entity_type"),
            F.col("entity.id").alias("entity_id"),
            F.col("arrival_time").alias("updated_at"),
            F.lit(1).cast("bigint").alias("n"),
            F.explode("matched").alias("m"),
        )
        .select(*ENTITY_KEYS, "updated_at", "n", "m.*")
        .groupBy(*keys, "start_ms", "distinct_value")
        .agg(*sums)
    )
    facts = declaration_rows(registry).select(*IDENTITY, "aggregation_type", "size_ms", "slide_ms", "pane_ms")
    pane, size, slide = F.col("start_ms"), F.col("size_ms"), F.col("slide_ms")
    one_window = F.coalesce(F.col("pane_ms") == size, F.lit(True))
    starts = F.when(one_window, F.array(pane)).otherwise(
        F.sequence(floor_to(pane - size, slide) + slide, floor_to(pane, slide), slide)
    )
    windows = (
        panes.join(facts, IDENTITY)
        .select(*keys, "distinct_value", "n", "num", "den", "updated_at", F.explode(starts).alias("start_ms"))
        .groupBy(*keys, "start_ms", "distinct_value")
        .agg(*sums)
    )
    # Distinct values are counted in a step of their own; other rows pass it one by one.
    state = (
        windows.withColumn("window_start", F.timestamp_millis("start_ms"))
        .groupBy(*FEATURE_KEYS)
        .agg(*sums, F.count("distinct_value").alias("distinct_n"))
        .join(facts, IDENTITY)
    )
    kind = F.col("aggregation_type")
    quotient = F.when(F.col("den") == 0, F.lit(0.0)).otherwise(F.try_divide("num", "den"))
    value = (
        F.when(kind.isin("AVG", "RATIO"), quotient)
        .when(kind == "DISTINCT_COUNT", F.col("distinct_n").cast("double"))
        .otherwise(F.col("num"))
    )
    expiry = F.timestamp_millis(F.unix_millis("updated_at") + size + slide)
    return state.select(
        *FEATURE_KEYS, value.alias("value"), "n", "num", "den", "updated_at", expiry.alias("expires_at")
    )
