"""Window lengths: text on the outside, whole milliseconds on the inside."""

from __future__ import annotations

import re

# The units of durations, in milliseconds, and the two forms of their text.
UNIT_MS = {"ms": 1, "s": 1_000, "m": 60_000, "h": 3_600_000, "d": 86_400_000}
COMPACT = r"([1-9]\d*)(MS|S|M|H|D)"
ISO = (
    r"([-+]?)P(?:([-+]?\d+)D)?"
    r"(?:T(?!$)(?:([-+]?\d+)H)?(?:([-+]?\d+)M)?(?:([-+]?\d+)(?:[.,](\d{1,9}))?S)?)?"
)
BLANKS = " \t\n\x0b\f\r"
# The longest window and slide together: about 29,000 years, well within timestamps.
MAX_MS = 1 << 53
LONG = 1 << 63


def parse_duration(text: str | None) -> int:
    """``PT10M`` / ``10m`` / ``250ms`` -> milliseconds; anything not positive is refused."""
    if text is None or not text.strip():
        raise ValueError("duration must not be blank")
    upper = text.strip(BLANKS).upper()
    if hit := re.fullmatch(COMPACT, upper, re.ASCII):
        millis = int(hit[1]) * UNIT_MS[hit[2].lower()]
    else:
        iso = re.fullmatch(ISO, upper, re.ASCII)
        if not iso or not any(iso.group(2, 3, 4, 5)):
            raise ValueError(f"not an ISO-8601 or compact duration: {text!r}")
        millis = sum(int(digits or 0) * UNIT_MS[unit] for digits, unit in zip(iso.group(2, 3, 4, 5), "dhms"))
        if iso[6]:
            fraction = int(iso[6].ljust(9, "0")[:3])
            millis += -fraction if iso[5].startswith("-") else fraction
        if iso[1] == "-":
            millis = -millis
    if not 1 <= millis < LONG:
        raise ValueError(f"duration must be at least one millisecond and fit a long: {text!r}")
    return millis


def format_duration(millis: int) -> str:
    """Milliseconds -> ISO text with hours as the largest unit (``PT24H``)."""
    hours, rest = divmod(millis, 3_600_000)
    minutes, rest = divmod(rest, 60_000)
    seconds, fraction = divmod(rest, 1_000)
    text = "PT"
    if hours:
        text += f"{hours}H"
    if minutes:
        text += f"{minutes}M"
    if seconds or fraction:
        tail = f".{fraction:03d}".rstrip("0") if fraction else ""
        text += f"{seconds}{tail}S"
    return text if len(text) > 2 else "PT0S"
