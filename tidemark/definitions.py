"""Feature declarations: what to aggregate, over which events, in which window.

A declaration is a small driver-side value. It is checked when built, so that a plan
is only ever compiled from declarations that can run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, replace

from tidemark.functions.durations import MAX_MS, format_duration, parse_duration

ANY_ENTITY = "*"

# The domains of the declaration columns.
AGGREGATIONS = ("COUNT", "SUM", "AVG", "DISTINCT_COUNT", "RATIO")
WINDOW_TYPES = ("NONE", "TUMBLING", "SLIDING")
STATES = ("DRAFT", "ACTIVE", "INACTIVE")
FILTER_OPERATORS = ("EXISTS", "EQ", "NE", "GT", "GTE", "LT", "LTE")

NEEDS_VALUE = ("SUM", "AVG", "DISTINCT_COUNT", "RATIO")

# One path segment starts with a letter; the whole path is dot-separated segments.
FIELD_PATH = r"[A-Za-z][A-Za-z0-9_]*(\.[A-Za-z][A-Za-z0-9_]*)*"


class DefinitionError(ValueError):
    """A feature declaration that cannot be compiled."""


def is_field_path(text: str | None) -> bool:
    return text is not None and re.fullmatch(FIELD_PATH, text) is not None


def _has_text(text: str | None) -> bool:
    return text is not None and text.strip() != ""


def _require_path(text: str | None, what: str) -> None:
    if not _has_text(text):
        raise DefinitionError(f"{what} must not be blank")
    if not is_field_path(text):
        raise DefinitionError(f"{what} must be a valid field path: {text!r}")


@dataclass(frozen=True)
class FieldFilter:
    field: str
    operator: str
    value: str | None = None

    def __post_init__(self) -> None:
        _require_path(self.field, "filter field")
        if self.operator not in FILTER_OPERATORS:
            raise DefinitionError(f"unknown filter operator {self.operator!r}")
        if self.operator == "EXISTS":
            object.__setattr__(self, "value", None)
        elif not _has_text(self.value):
            raise DefinitionError("filter value must not be blank")


@dataclass(frozen=True)
class FeatureDefinition:
    """``window`` and ``slide`` accept ``PT10M`` or ``10m``; they are kept in milliseconds."""

    name: str
    event_type: str
    aggregation: str
    entity_type: str = ANY_ENTITY
    value_field: str | None = None
    weight_field: str | None = None
    filter: FieldFilter | None = None
    numerator_filter: FieldFilter | None = None
    window_type: str = "NONE"
    window: str | int | None = None
    slide: str | int | None = None
    version: int = 1
    state: str = "ACTIVE"

    def __post_init__(self) -> None:
        for what in ("name", "event_type", "entity_type"):
            if not _has_text(getattr(self, what)):
                raise DefinitionError(f"{what} must not be blank")
        if ":" in self.name:
            raise DefinitionError("name must not contain ':'")
        for what, domain in (
            ("aggregation", AGGREGATIONS),
            ("window_type", WINDOW_TYPES),
            ("state", STATES),
        ):
            if getattr(self, what) not in domain:
                raise DefinitionError(f"unknown {what} {getattr(self, what)!r}")
        if self.version < 1:
            raise DefinitionError("version must be positive")

        if self.aggregation in NEEDS_VALUE or _has_text(self.value_field):
            _require_path(self.value_field, "value_field")
        if _has_text(self.weight_field):
            _require_path(self.weight_field, "weight_field")
        if self.aggregation == "RATIO" and self.numerator_filter is None:
            raise DefinitionError("ratio definitions need a numerator filter")
        self._check_window()

    def _check_window(self) -> None:
        if self.window_type == "NONE":
            if self.window is not None or self.slide is not None:
                raise DefinitionError("unwindowed definitions must not set window or slide")
            return
        try:
            size = self._millis(self.window)
            slide = size if self.slide is None else self._millis(self.slide)
        except ValueError as error:
            raise DefinitionError(str(error)) from error
        if self.window_type == "SLIDING" and slide > size:
            raise DefinitionError("slide must not be larger than the window")
        if size + slide > MAX_MS:
            raise DefinitionError("window and slide are too long for the expiry of values")
        object.__setattr__(self, "window", size)
        object.__setattr__(self, "slide", slide)

    @staticmethod
    def _millis(length: str | int | None) -> int:
        if isinstance(length, int):
            if length < 1:
                raise ValueError("window lengths must be positive")
            return length
        return parse_duration(length)

    @property
    def ttl_ms(self) -> int | None:
        """How long a written window value stays readable; unwindowed values stay."""
        return None if self.window_type == "NONE" else self.window + self.slide

    @property
    def has_weight(self) -> bool:
        return _has_text(self.weight_field)

    def with_state(self, state: str) -> "FeatureDefinition":
        return replace(self, state=state)

    def as_row(self) -> dict:
        """The declaration as one row of the registry table."""

        def parts(prefix: str, flt: FieldFilter | None) -> dict:
            return {
                f"{prefix}_field": flt.field if flt else None,
                f"{prefix}_operator": flt.operator if flt else None,
                f"{prefix}_value": flt.value if flt else None,
            }

        return {
            "name": self.name,
            "version": self.version,
            "event_type": self.event_type,
            "entity_type": self.entity_type,
            "aggregation_type": self.aggregation,
            "value_field": self.value_field,
            "weight_field": self.weight_field,
            **parts("filter", self.filter),
            **parts("numerator_filter", self.numerator_filter),
            "window_type": self.window_type,
            "window_size": None if self.window is None else format_duration(self.window),
            "slide": None if self.slide is None else format_duration(self.slide),
            "state": self.state,
        }

    @classmethod
    def from_row(cls, row: dict) -> "FeatureDefinition":
        def flt(prefix: str) -> FieldFilter | None:
            if row[f"{prefix}_field"] is None:
                return None
            return FieldFilter(
                row[f"{prefix}_field"], row[f"{prefix}_operator"], row[f"{prefix}_value"]
            )

        return cls(
            name=row["name"],
            version=row["version"],
            event_type=row["event_type"],
            entity_type=row["entity_type"],
            aggregation=row["aggregation_type"],
            value_field=row["value_field"],
            weight_field=row["weight_field"],
            filter=flt("filter"),
            numerator_filter=flt("numerator_filter"),
            window_type=row["window_type"],
            window=row["window_size"],
            slide=row["slide"],
            state=row["state"],
        )


REQUEST_COMPLETED = "request.completed"

# The four features every installation starts with.
BUILT_IN_FEATURES = (
    FeatureDefinition(
        name="request_count_total",
        event_type=REQUEST_COMPLETED,
        entity_type="service",
        aggregation="SUM",
        value_field="count",
    ),
    FeatureDefinition(
        name="entity_event_count_10m",
        event_type=REQUEST_COMPLETED,
        entity_type="service",
        aggregation="COUNT",
        window_type="TUMBLING",
        window="PT10M",
    ),
    FeatureDefinition(
        name="entity_error_rate_10m",
        event_type=REQUEST_COMPLETED,
        entity_type="service",
        aggregation="RATIO",
        value_field="count",
        filter=FieldFilter("statusCode", "EXISTS"),
        numerator_filter=FieldFilter("statusCode", "GTE", "500"),
        window_type="TUMBLING",
        window="PT10M",
    ),
    FeatureDefinition(
        name="entity_avg_latency_ms_5m",
        event_type=REQUEST_COMPLETED,
        entity_type="service",
        aggregation="AVG",
        value_field="latencyMs",
        weight_field="count",
        filter=FieldFilter("latencyMs", "EXISTS"),
        window_type="TUMBLING",
        window="PT5M",
    ),
)
