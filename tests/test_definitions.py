import pytest
from hypothesis import given
from hypothesis import strategies as st

from tidemark.definitions import (
    BUILT_IN_FEATURES,
    DefinitionError,
    FeatureDefinition,
    FieldFilter,
    is_field_path,
)
from tidemark.functions.durations import format_duration, parse_duration


@pytest.mark.parametrize(
    "text, millis",
    [
        ("250ms", 250),
        ("30s", 30_000),
        ("10m", 600_000),
        ("2h", 7_200_000),
        ("1d", 86_400_000),
        ("PT5M", 300_000),
        (" pt1h30m ", 5_400_000),
        ("P1DT1S", 86_401_000),
        ("PT0.25S", 250),
    ],
)
def test_durations(text, millis):
    assert parse_duration(text) == millis


@pytest.mark.parametrize("text", ["0m", "ten-minutes", "", None, "PT0S", "-PT5M", "P", "PT", "5"])
def test_bad_durations(text):
    with pytest.raises(ValueError):
        parse_duration(text)


@given(st.integers(min_value=1, max_value=10**10))
def test_duration_text_round_trip(millis):
    assert parse_duration(format_duration(millis)) == millis


def test_field_paths():
    assert all(map(is_field_path, ["count", "payload.device.os", "a_1"]))
    assert not any(map(is_field_path, ["payload-count", "", ".a", "a.", "a..b", "1a", "_a", None]))


def windowed(**changes):
    base = dict(name="f", event_type="e", aggregation="COUNT", window_type="TUMBLING", window="10m")
    return FeatureDefinition(**{**base, **changes})


def test_slide_defaults_to_window():
    assert windowed().slide == 600_000
    assert windowed().ttl_ms == 1_200_000
    assert windowed(slide="15m").ttl_ms == 1_500_000


@pytest.mark.parametrize(
    "changes",
    [
        {"window": "PT0S"},
        {"window": None},
        {"aggregation": "SUM"},
        {"aggregation": "SUM", "value_field": "payload-count"},
        {"aggregation": "RATIO", "value_field": "count"},
        {"window_type": "SLIDING", "slide": "15m"},
        {"window_type": "NONE"},
        {"name": " "},
        {"name": "a:b"},
        {"version": 0},
        {"state": "RETIRED"},
        {"weight_field": "a..b"},
    ],
)
def test_refused_definitions(changes):
    with pytest.raises(DefinitionError):
        windowed(**changes)


def test_filters():
    assert FieldFilter("a", "EXISTS", "dropped").value is None
    for bad in (("a", "EQ", " "), ("a", "LIKE", "x"), ("a-b", "EQ", "x")):
        with pytest.raises(DefinitionError):
            FieldFilter(*bad)


def test_rows_round_trip():
    for d in BUILT_IN_FEATURES:
        assert FeatureDefinition.from_row(d.as_row()) == d
