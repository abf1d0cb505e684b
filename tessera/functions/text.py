"""Parsing and formatting of text cells, as column expressions.

Date patterns are those of Spark (Java letters).  A parser tries its patterns in order
and gives the first success; with ``strict`` a text that none fits raises.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

DATE_FORMAT = "yyyy-MM-dd"
_ZONE = r"(Z|[+-][0-9]{2}:?[0-9]{2})(\[.*\])?$"


def _present(col: Column) -> Column:
    """Trimmed text; null if nothing is left."""
    return F.nullif(F.trim(col), F.lit(""))


def _first(text: Column, tries: Sequence[Column], patterns: Sequence[str], kind: str, strict: bool) -> Column:
    found = F.coalesce(*tries)
    if not strict:
        return found
    said = F.concat(F.lit(f"Cannot parse {kind} '"), text, F.lit(f"' with any of: {', '.join(patterns)}"))
    return F.when(text.isNotNull() & found.isNull(), F.raise_error(said).cast("string")).otherwise(found.cast("string")).cast(
        {"date": "date", "datetime": "timestamp_ntz", "zoned": "timestamp"}[kind]
    )


def _parse_ntz(text: Column, pattern: str) -> Column:
    return F.try_to_timestamp(text, F.lit(pattern)).cast("timestamp_ntz")


def parse_date(col: Column, pattern: str = DATE_FORMAT, alternatives: Sequence[str] = (), strict: bool = False) -> Column:
    text, patterns = _present(col), [pattern, *alternatives]
    return _first(text, [F.try_to_timestamp(text, F.lit(p)).cast("date") for p in patterns], patterns, "date", strict)


def strip_timezone(col: Column) -> Column:
    """Wall-clock time of a text with an offset or zone; the offset is dropped, not applied."""
    return F.regexp_replace(_present(col), _ZONE, "").try_cast("timestamp_ntz")


def parse_datetime(
    col: Column, pattern: str = "yyyy-MM-dd HH:mm:ss", alternatives: Sequence[str] = (), strip_zone: bool = False, strict: bool = False
) -> Column:
    """A ten-character ISO date is midnight; then the patterns; then ISO date-times;
    then, if asked for, ISO with its zone stripped."""
    text, patterns = _present(col), [pattern, *alternatives]
    iso_date = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("timestamp_ntz"))
    iso = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"), text.try_cast("timestamp_ntz"))
    tries = [iso_date, *(_parse_ntz(text, p) for p in patterns), iso]
    if strip_zone:
        tries.append(strip_timezone(col))
    return _first(text, tries, patterns, "datetime", strict)


def parse_zoned(col: Column, pattern: str, alternatives: Sequence[str] = (), strict: bool = False) -> Column:
    """An instant (UTC) from text with an offset or zone: patterns, then ISO."""
    text, patterns = _present(col), [pattern, *alternatives]
    iso = F.when(text.rlike(_ZONE), F.regexp_replace(text, r"\[.*\]$", "").try_cast("timestamp"))
    return _first(text, [*(F.try_to_timestamp(text, F.lit(p)) for p in patterns), iso], patterns, "zoned", strict)


def parse_legacy_date(col: Column, pattern: str = DATE_FORMAT, alternatives: Sequence[str] = (), strict: bool = False) -> Column:
    """As :func:`parse_zoned` without the ISO step; a date is midnight of the session's zone."""
    text, patterns = _present(col), [pattern, *alternatives]
    return _first(text, [F.try_to_timestamp(text, F.lit(p)) for p in patterns], patterns, "zoned", strict)


def zone_of(col: Column) -> Column:
    """The offset or zone text that an instant loses."""
    return F.nullif(F.regexp_extract(_present(col), _ZONE, 0), F.lit(""))


def parse_value(col: Column, kind: str, required: bool = False, default=None, pattern: str = DATE_FORMAT, alternatives: Sequence[str] = ()) -> Column:
    """A typed value from a text cell.  An empty cell gives the default, or raises if it
    is required.  A boolean is true only for the word ``true``."""
    text = _present(col)
    if kind == "string":
        value = text
    elif kind == "boolean":
        value = F.lower(text) == "true"
    elif kind == "date":
        value = parse_date(col, pattern, alternatives)
    elif kind == "timestamp_ntz":
        value = parse_datetime(col, pattern, alternatives)
    else:
        value = text.try_cast(kind)
    if required:
        missing = F.raise_error(F.lit("a required value is missing")).cast(kind)
        return F.when(text.isNull(), missing).otherwise(value)
    return value if default is None else F.when(text.isNull(), F.lit(default).cast(kind)).otherwise(value)


def format_number(col: Column, pattern: str) -> Column:
    """By a decimal pattern such as ``$#,##0.00``; halves go to the even digit."""
    return F.call_function("format_number", col.cast("double"), F.lit(pattern))


def format_date(col: Column, pattern: str = DATE_FORMAT) -> Column:
    return F.date_format(col, pattern)


def format_value(col: Column, kind: str, number_pattern: str | None = None, date_pattern: str | None = None, max_length: int | None = None) -> Column:
    """Text of a cell: null is empty; a pattern applies to its own kind of value; only
    values without a pattern are cut to ``max_length``."""
    if number_pattern and kind in ("int", "bigint", "float", "double"):
        shown = format_number(col, number_pattern)
    elif date_pattern and kind in ("date", "timestamp", "timestamp_ntz"):
        shown = format_date(col, date_pattern)
    else:
        shown = col.cast("string")
        if max_length:
            shown = F.substring(shown, 1, max_length)
    return F.coalesce(shown, F.lit(""))


def write_as_string(col: Column, kind: str, number_pattern: str | None = None, date_pattern: str | None = None) -> Column:
    """Cell text for columns written as text."""
    if kind == "date":
        return F.date_format(col, date_pattern or DATE_FORMAT)
    if kind in ("timestamp", "timestamp_ntz"):
        return F.date_format(col, date_pattern or "yyyy-MM-dd HH:mm:ss")
    return format_value(col, kind, number_pattern)


def excel_serial_date(col: Column) -> Column:
    """A date from a spreadsheet's day number.  The calendar of spreadsheets has a 29
    February 1900, so numbers up to 60 lie one day later than the rest would say."""
    n = F.floor(F.trim(col.cast("string")).try_cast("double")).cast("int")
    return F.date_add(F.lit("1899-12-30").cast("date"), F.when(n <= 60, n + 1).otherwise(n))


def excel_date_format(pattern: str | None) -> str | None:
    """A spreadsheet's date pattern for one with Java letters: the half-day mark, names of
    weekdays and fractions of a second are written differently; quoted text and the other
    letters stay."""

    def swap(m: re.Match) -> str:
        got = m[0]
        if got[0] == "'":
            return got
        if got == "a":
            return "AM/PM"
        if got[0] == "E":
            return "DDDD" if len(got) > 3 else "DDD"
        return "." + "0" * got.count("S")

    return re.sub(r"'[^']*(?:'|$)|a|E+|\.?S+", swap, pattern) if pattern else pattern
