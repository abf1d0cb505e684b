"""Coercion of dynamic values, as column expressions.

Each ``as_*`` takes a column of any simple type and gives a typed column.  With
``strict`` a value that can't be coerced (null included) raises; otherwise it becomes
null.  Text is trimmed.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The words that count as true and as false.
TRUE_WORDS, FALSE_WORDS = ("true", "1", "yes"), ("false", "0", "no")

_INT = (-(1 << 31), (1 << 31) - 1)
_LONG = (-(1 << 63), (1 << 63) - 1)
_NUMBERS = ("tinyint", "smallint", "int", "bigint", "float", "double")


def _settle(value: Column, source: Column, kind: str, strict: bool) -> Column:
    if not strict:
        return value
    said = F.concat(F.lit("Cannot coerce value '"), F.coalesce(source.cast("string"), F.lit("null")), F.lit(f"' to {kind}"))
    return F.coalesce(value, F.raise_error(said).cast("void"))


def _clamped(value: Column, low: int, high: int, kind: str) -> Column:
    """A double cut to a whole number, held within the type's bounds."""
    top, bottom = F.lit(high).cast(kind), F.lit(low).cast(kind)
    cut = F.when(value >= F.lit(float(high)), top).when(value <= F.lit(float(low)), bottom)
    return cut.when(F.isnan(value), F.lit(0).cast(kind)).otherwise(value.try_cast(kind))


def _whole(col: Column, source_type: str, kind: str, bounds: tuple[int, int], strict: bool) -> Column:
    if source_type == "boolean":
        value = F.when(col, F.lit(1)).when(~col, F.lit(0)).cast(kind)
    elif source_type in ("float", "double") or source_type.startswith("decimal"):
        value = _clamped(col.cast("double"), *bounds, kind)
    elif source_type in _NUMBERS:
        # a wider whole number keeps its low bits
        low = col.cast("bigint")
        value = low if kind == "bigint" else (F.pmod(low + F.lit(1 << 31), F.lit(1 << 32)) - F.lit(1 << 31)).cast("int")
    elif source_type == "string":
        text = F.trim(col)
        plain = F.when(text.rlike(r"^[+-]?[0-9]+$"), text.try_cast(kind))
        value = F.when(F.contains(text, F.lit(".")), _clamped(text.try_cast("double"), *bounds, kind)).otherwise(plain)
    else:
        value = F.lit(None).cast(kind)
    return _settle(value, col, kind, strict)


def as_string(col: Column) -> Column:
    return col.cast("string")


def as_int(col: Column, source_type: str = "string", strict: bool = False) -> Column:
    """Doubles and text with a point are cut towards zero and held within bounds."""
    return _whole(col, source_type, "int", _INT, strict)


def as_long(col: Column, source_type: str = "string", strict: bool = False) -> Column:
    return _whole(col, source_type, "bigint", _LONG, strict)


def as_double(col: Column, source_type: str = "string", strict: bool = False) -> Column:
    if source_type == "boolean":
        value = F.when(col, F.lit(1.0)).when(~col, F.lit(0.0))
    elif source_type == "string":
        value = F.trim(col).try_cast("double")
    elif source_type in _NUMBERS or source_type.startswith("decimal"):
        value = col.cast("double")
    else:
        value = F.lit(None).cast("double")
    return _settle(value, col, "double", strict)


def as_decimal(col: Column, source_type: str = "string", scale: int = 10, strict: bool = False) -> Column:
    """Booleans are refused."""
    kind = f"decimal(38,{scale})"
    if source_type == "string":
        value = F.trim(col).try_cast(kind)
    elif source_type in _NUMBERS or source_type.startswith("decimal"):
        value = col.try_cast(kind)
    else:
        value = F.lit(None).cast(kind)
    return _settle(value, col, "decimal", strict)


def as_boolean(col: Column, source_type: str = "string", strict: bool = False) -> Column:
    """Numbers are true unless zero; of texts only the fixed words count."""
    if source_type == "boolean":
        value = col
    elif source_type == "string":
        word = F.lower(F.trim(col))
        value = F.when(word.isin(*TRUE_WORDS), F.lit(True)).when(word.isin(*FALSE_WORDS), F.lit(False))
    elif source_type in _NUMBERS or source_type.startswith("decimal"):
        value = col != 0
    else:
        value = F.lit(None).cast("boolean")
    return _settle(value, col, "boolean", strict)


def as_date(col: Column, source_type: str = "string", strict: bool = False) -> Column:
    if source_type in ("date", "timestamp", "timestamp_ntz"):
        value = col.cast("date")
    elif source_type == "string":
        text = F.trim(col)
        value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text.try_cast("date"))
    else:
        value = F.lit(None).cast("date")
    return _settle(value, col, "date", strict)


def as_datetime(col: Column, source_type: str = "string", strict: bool = False) -> Column:
    if source_type in ("date", "timestamp", "timestamp_ntz"):
        value = col.cast("timestamp_ntz")
    elif source_type == "string":
        text = F.trim(col)
        value = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?$"), text.try_cast("timestamp_ntz"))
    else:
        value = F.lit(None).cast("timestamp_ntz")
    return _settle(value, col, "datetime", strict)


def as_time(col: Column, source_type: str = "string", strict: bool = False) -> Column:
    """Time of day as text ``HH:mm:ss``."""
    if source_type in ("timestamp", "timestamp_ntz"):
        value = F.date_format(col, "HH:mm:ss")
    elif source_type == "string":
        text = F.trim(col)
        full = F.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d$"), F.concat(text, F.lit(":00")))
        value = full.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,9})?$"), text)
    else:
        value = F.lit(None).cast("string")
    return _settle(value, col, "time", strict)


def is_blank(col: Column) -> Column:
    return col.isNull()


AS = {
    "string": lambda c, t="string", strict=False: as_string(c),
    "int": as_int,
    "bigint": as_long,
    "double": as_double,
    "boolean": as_boolean,
    "date": as_date,
    "timestamp_ntz": as_datetime,
}
