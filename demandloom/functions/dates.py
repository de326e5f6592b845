"""Date parsing and forecast horizons."""

from __future__ import annotations

import re
from datetime import date

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("D", "W", "M")

# Tried in turn after the ISO cast. Slash and hyphen dates are read month first, dotted ones day
# first; give `formats` for others.
DATE_FORMATS = (
    "M/d/yyyy", "M/d/yyyy H:mm", "M/d/yyyy H:mm:ss", "M/d/yyyy h:mm a", "M/d/yyyy h:mm:ss a", "yyyy/M/d", "yyyy/M/d H:mm",
    "M/d/yy", "M/d/yy H:mm", "M-d-yyyy", "M-d-yy", "d.M.yyyy", "d.M.yy", "yyyyMMdd", "yyyy.M.d",
    "d-MMM-yyyy", "d-MMM-yy", "d MMM yyyy", "MMM d, yyyy", "MMM d yyyy",
)
# Two-digit years above this one are of the century before.
LAST_SHORT_YEAR = 2068

_PARTS = {
    "yyyy": r"\d{4}", "yy": r"\d{2}", "MMM": "[A-Za-z]{3}", "MM": r"\d{2}", "M": r"\d{1,2}", "dd": r"\d{2}", "d": r"\d{1,2}",
    "H": r"\d{1,2}", "h": r"\d{1,2}", "mm": r"\d{2}", "ss": r"\d{2}", "a": "[AaPp][Mm]",
}


def _shape(date_format: str) -> str:
    """Regular expression of the texts a format can read."""
    pieces = re.findall("|".join(_PARTS) + "|.", date_format)
    return "^" + "".join(_PARTS.get(p, re.escape(p)) for p in pieces) + "$"


def _read(text: Column, date_format: str) -> Column:
    """Date of a text of the format's shape; NULL for days that do not exist."""
    if "MMM" in date_format:
        text = F.initcap(text)
    if "a" in date_format:
        text = F.upper(text)
    day = F.try_to_timestamp(text, F.lit(date_format)).cast("date")
    if "yy" in date_format and "yyyy" not in date_format:
        day = F.when(F.year(day) > LAST_SHORT_YEAR, F.add_months(day, -1200)).otherwise(day)
    return F.when(text.rlike(_shape(date_format)), day)


def _kind(date_format: str) -> str:
    """What parts the pieces of a format: a sign, a month's name, or nothing."""
    if "MMM" in date_format and "/" not in date_format:
        return "name"
    return next((c for c in "/.-" if c in date_format), "")


def parse_date(text: Column, formats: tuple[str, ...] = DATE_FORMATS) -> Column:
    """Date of a text; NULL when no format fits.

    One look at the text tells which formats may fit, by their separator. These are only tried on
    texts of their shape, as a failed try is slow.
    """
    trimmed = F.trim(text)
    kinds: dict[str, list[str]] = {}
    for f in formats:
        kinds.setdefault(_kind(f), []).append(f)
    read = {kind: F.coalesce(*[_read(trimmed, f) for f in group]) for kind, group in kinds.items()}
    none = F.lit(None).cast("date")
    # A time's AM or PM stands behind a slash, so slashes come before names.
    found = F.when(F.contains(trimmed, F.lit("/")), read.get("/", none))
    found = found.when(trimmed.rlike("[A-Za-z]{3}"), read.get("name", none))
    for sign in (".", "-"):
        found = found.when(F.contains(trimmed, F.lit(sign)), read.get(sign, none))
    return F.coalesce(trimmed.try_cast("date"), found.otherwise(read.get("", none)))


def horizon(start: Column | date | str, end: Column | date | str, granularity: str = "D") -> Column:
    """Ascending dates from start to end, both included: days, Sundays or month ends."""
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity must be one of {GRANULARITIES}, not {granularity!r}")
    first = (start if isinstance(start, Column) else F.lit(str(start))).cast("date")
    last = (end if isinstance(end, Column) else F.lit(str(end))).cast("date")
    # least/greatest keep `sequence` from counting down or raising on an empty range.
    days = F.when(first <= last, F.sequence(first, F.greatest(first, last))).otherwise(
        F.array().cast("array<date>")
    )
    if granularity == "W":
        return F.filter(days, lambda d: F.dayofweek(d) == 1)
    if granularity == "M":
        return F.filter(days, lambda d: d == F.last_day(d))
    return days
