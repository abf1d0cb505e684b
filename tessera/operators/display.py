"""Tables as text, for consoles and logs.  Only the rows that are shown reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.types import NumericType

from tessera.operators.ordered import sort_keys
from tessera.operators.sorting import head, tail


def _shown(value) -> str:
    return "null" if value is None else str(value)


def _grid(names: list[str], rows: list[list[str]], right: list[bool], rule: str | None) -> list[str]:
    wide = [max(len(n), *(len(r[i]) for r in rows)) if rows else len(n) for i, n in enumerate(names)]

    def line(cells: list[str]) -> str:
        return "  ".join(c.rjust(w) if r else c.ljust(w) for c, w, r in zip(cells, wide, right, strict=True)).rstrip()

    out = [line(names)]
    if rule:
        out.append("  ".join(rule * w for w in wide))
    return out + [line(r) for r in rows]


def tabular(df: DataFrame, order, n: int = 20) -> str:
    """The first and last rows around ``...`` if there are more than ``n``; numbers to the
    right; a footer with the size."""
    total = df.count()
    if not total:
        return "Empty Dataset"
    if total <= n:
        rows = df.orderBy(*sort_keys(order)).collect()
        parts = [rows]
    else:
        half = max(1, n // 2)
        parts = [head(df, half, order).collect(), tail(df, n - half, order).collect()]
    right = [isinstance(f.dataType, NumericType) for f in df.schema.fields]
    texts = [[_shown(v) for v in r] for p in parts for r in p]
    grid = _grid(df.columns, texts, right, None)
    if len(parts) > 1:
        grid.insert(1 + len(parts[0]), "...")
    return "\n".join([*grid, "", f"[{total} rows x {len(df.columns)} columns]"])


def table_text(df: DataFrame, order, n: int = 20) -> str:
    """The first rows only, under a rule, with a count of those left out."""
    total = df.count()
    if not df.columns:
        return "Table[0 columns, 0 rows]"
    rows = head(df, n, order).collect()
    right = [isinstance(f.dataType, NumericType) for f in df.schema.fields]
    grid = _grid(df.columns, [["" if v is None else str(v) for v in r] for r in rows], right, "-")
    if total > n:
        grid.append(f"... {total - n} more rows")
    return "\n".join(grid)
