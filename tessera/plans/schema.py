"""Column specifications: display names, order, defaults and formats beside the type.

A :class:`TableSpec` compiles to a ``StructType`` whose fields carry the specification
as metadata, so it travels with a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import asdict, dataclass, field, fields
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tessera.functions import coerce, text

#: Hints for the kind of a cell, for writing it, and for its alignment.
CELL_TYPES = ("AUTO", "TEXT", "NUMBER", "DATE", "BOOLEAN", "CURRENCY", "PERCENTAGE", "FORMULA")
WRITE_AS = ("AUTO", "STRING")
ALIGNMENTS = ("AUTO", "LEFT", "CENTER", "RIGHT")

#: The value of a missing primitive.
ZERO = {"tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "boolean": False}


@dataclass(frozen=True)
class ColumnSpec:
    field: str
    kind: str = "string"
    name: str | None = None
    order: int = -1
    column_index: int = -1
    required: bool = False
    ignore: bool = False
    hidden: bool = False
    description: str = ""
    default: Any = None
    primitive: bool = False
    cell_type: str = "AUTO"
    number_format: str | None = None
    date_format: str = text.DATE_FORMAT
    alternatives: tuple[str, ...] = ()
    strip_timezone: bool = False
    write_as: str = "AUTO"
    width: int | None = None
    alignment: str = "AUTO"
    bold: bool = False
    frozen: bool = False
    wrap: bool = False
    background: str | None = None
    color: str | None = None

    def __post_init__(self) -> None:
        for value, known in ((self.cell_type, CELL_TYPES), (self.write_as, WRITE_AS), (self.alignment, ALIGNMENTS)):
            if value not in known:
                raise ValueError(f"{self.field}: {value} is none of {', '.join(known)}")

    @property
    def effective_name(self) -> str:
        return self.name or self.field

    @property
    def formatted(self) -> bool:
        return bool(self.number_format) or self.date_format != text.DATE_FORMAT


@dataclass(frozen=True)
class TableSpec:
    columns: tuple[ColumnSpec, ...]
    name: str = ""

    def __init__(self, columns: Sequence[ColumnSpec], name: str = ""):
        """Columns with an index or an order come first, by it; the others follow as given."""
        kept = [c for c in columns if not c.ignore]

        def place(pair: tuple[int, ColumnSpec]) -> int:
            at, c = pair
            return c.column_index + 1 if c.column_index >= 0 else c.order if c.order >= 0 else 1000 + at

        object.__setattr__(self, "columns", tuple(c for _, c in sorted(enumerate(kept), key=place)))
        object.__setattr__(self, "name", name)

    def struct(self) -> StructType:
        out = []
        for c in self.columns:
            known = {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(c).items() if v is not None}
            known = {k: v if isinstance(v, (str, int, float, bool, list)) else str(v) for k, v in known.items()}
            out.append(StructField(c.field, StructType.fromDDL(f"x {c.kind}")["x"].dataType, not c.required, known))
        return StructType(out)

    @classmethod
    def of(cls, schema: StructType) -> TableSpec:
        """The specification that a schema's metadata holds, or a plain one."""
        names = {f.name for f in fields(ColumnSpec)}
        out = []
        for f in schema.fields:
            known = {k: tuple(v) if isinstance(v, list) else v for k, v in (f.metadata or {}).items() if k in names}
            out.append(ColumnSpec(**known | {"field": f.name, "kind": f.dataType.simpleString()}))
        return cls(out)

    def column(self, field_name: str) -> ColumnSpec:
        return next(c for c in self.columns if c.field == field_name)


@dataclass(frozen=True)
class FieldSelector:
    """Chooses columns: included ones, without the excluded, that pass all tests, in order.
    Names that aren't there are passed over."""

    spec: TableSpec
    included: tuple[str, ...] | None = None
    excluded: tuple[str, ...] = ()
    tests: tuple[Callable[[ColumnSpec], bool], ...] = field(default=())
    sort: Callable[[ColumnSpec], Any] | None = None

    def _with(self, **changes) -> FieldSelector:
        return FieldSelector(**{f.name: getattr(self, f.name) for f in fields(self)} | changes)

    def fields(self, *names: str) -> FieldSelector:
        return self._with(included=(self.included or ()) + names)

    def columns(self, *names: str) -> FieldSelector:
        """By effective (display) names."""
        found = tuple(c.field for n in names for c in self.spec.columns if c.effective_name == n)
        return self._with(included=(self.included or ()) + found)

    def exclude(self, *names: str) -> FieldSelector:
        return self._with(excluded=self.excluded + names)

    def where(self, test: Callable[[ColumnSpec], bool]) -> FieldSelector:
        return self._with(tests=(*self.tests, test))

    def required_only(self) -> FieldSelector:
        return self.where(lambda c: c.required)

    def exportable_only(self) -> FieldSelector:
        return self.where(lambda c: not c.hidden and not c.ignore)

    def of_type(self, kind: str) -> FieldSelector:
        return self.where(lambda c: c.kind == kind)

    def with_cell_type(self, cell_type: str) -> FieldSelector:
        return self.where(lambda c: c.cell_type == cell_type)

    def with_formatting(self) -> FieldSelector:
        return self.where(lambda c: c.formatted)

    def order_by(self, key: Callable[[ColumnSpec], Any]) -> FieldSelector:
        return self._with(sort=key)

    def order_by_name(self) -> FieldSelector:
        return self.order_by(lambda c: c.effective_name)

    def select(self) -> list[ColumnSpec]:
        if self.included is None:
            found = list(self.spec.columns)
        else:
            found = [c for n in dict.fromkeys(self.included) for c in self.spec.columns if c.field == n]
        out = [c for c in found if c.field not in self.excluded and c.effective_name not in self.excluded and all(t(c) for t in self.tests)]
        return sorted(out, key=self.sort) if self.sort else out

    def names(self) -> list[str]:
        return [c.field for c in self.select()]

    def count(self) -> int:
        return len(self.select())

    def has_matches(self) -> bool:
        return bool(self.select())


def default_of(column: ColumnSpec, by_field: dict[str, Any] | None = None, by_kind: dict[str, Any] | None = None) -> Any:
    """The value of a blank: of the field, else of the type, else of the specification,
    else zero for a primitive and null for the rest."""
    for given, key in ((by_field or {}, column.field), (by_kind or {}, column.kind)):
        if key in given:
            return given[key]
    if column.default is not None:
        return column.default
    return ZERO.get(column.kind) if column.primitive else None


def conform(
    df: DataFrame, spec: TableSpec, by_field: dict[str, Any] | None = None, by_kind: dict[str, Any] | None = None, strict: bool = False,
    row: Column | None = None,
) -> DataFrame:
    """``df`` brought to a specification.  Columns are matched by display name, then by
    field name (case counts); missing ones and blanks take their default, others are left
    out; text is parsed by the column's formats.  ``row`` numbers rows in errors."""
    kinds = dict(df.dtypes)
    out = []
    for c in spec.columns:
        source = next((n for n in (c.effective_name, c.field) if n in kinds), None)
        value = F.lit(None).cast(c.kind) if source is None else cell_value(F.col(f"`{source}`"), kinds[source], c, strict, row)
        default = default_of(c, by_field, by_kind)
        if default is not None:
            value = F.coalesce(value, F.lit(default).cast(c.kind))
        out.append(value.alias(c.field))
    return df.select(*out)


def cell_value(col: Column, source_kind: str, spec: ColumnSpec, strict: bool = False, row: Column | None = None) -> Column:
    """One column read as its specification says."""
    if source_kind == spec.kind:
        return col
    own = strict and row is None  # else the error here names the row
    blank_to_null = F.nullif(F.trim(col), F.lit("")) if source_kind == "string" else col
    if source_kind == "string" and spec.kind == "date":
        value = text.parse_date(col, spec.date_format, spec.alternatives, own)
    elif source_kind == "string" and spec.kind == "timestamp_ntz":
        pattern = spec.date_format if spec.date_format != text.DATE_FORMAT else "yyyy-MM-dd HH:mm:ss"
        value = text.parse_datetime(col, pattern, spec.alternatives, spec.strip_timezone, own)
    elif spec.kind in coerce.AS:
        value = coerce.AS[spec.kind](blank_to_null, source_kind)
    else:
        value = blank_to_null.try_cast(spec.kind)
    if strict:
        said = F.concat(F.lit(f"{spec.field}: cannot read '"), blank_to_null.cast("string"), F.lit(f"' as {spec.kind}"), *([F.lit(" in row "), row.cast("string")] if row is not None else []))
        value = F.when(blank_to_null.isNotNull() & value.isNull(), F.raise_error(said).cast(spec.kind)).otherwise(value)
    return value


def quarantine(df: DataFrame, spec: TableSpec, order) -> DataFrame:
    """The cells that can't be read: ``row`` (0-based), ``field``, ``column`` and the raw
    ``value``.  Empty if all can."""
    from tessera.operators.ordered import with_index

    kinds = dict(df.dtypes)
    indexed = with_index(df, order, "__row")
    found = []
    for at, c in enumerate(spec.columns):
        source = next((n for n in (c.effective_name, c.field) if n in kinds), None)
        if source is None:
            continue
        raw = F.col(f"`{source}`")
        blank = F.nullif(F.trim(raw), F.lit("")).isNull() if kinds[source] == "string" else raw.isNull()
        bad = ~blank & cell_value(raw, kinds[source], c).isNull()
        found.append(F.when(bad, F.struct(F.col("__row").alias("row"), F.lit(c.field).alias("field"), F.lit(at).alias("column"), raw.cast("string").alias("value"))))
    return indexed.select(F.explode(F.filter(F.array(*found), lambda x: x.isNotNull())).alias("e")).select("e.*")
