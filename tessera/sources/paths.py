"""Path checks that all readers and writers share."""

from __future__ import annotations

import posixpath
from urllib.parse import urlsplit


class UnsafePath(ValueError):
    """A path that climbs out of its folder."""


def guarded(path: str) -> str:
    """The path, if no part of it climbs (``..``) once normalised; ``a..b.csv`` is fine."""
    parts = urlsplit(path)
    normal = posixpath.normpath(parts.path if parts.scheme else path)
    if ".." in normal.split("/"):
        raise UnsafePath(f"path climbs out of its folder: {path}")
    return path


class ReadError(ValueError):
    """A cell that can't be read, with its place."""

    def __init__(self, message: str, row: int | None = None, column: int | None = None, sheet: str | None = None, field: str | None = None, value=None):
        self.row, self.column, self.sheet, self.field, self.value = row, column, sheet, field, value
        where = [f"sheet '{sheet}'"] if sheet else []
        if self.cell_reference:
            where.append(f"cell {self.cell_reference}")
        elif row is not None:
            where.append(f"row {row}")
        if field:
            where.append(f"field '{field}'")
        if value is not None:
            where.append(f"value '{value}'")
        super().__init__(f"{message} ({', '.join(where)})" if where else message)

    @property
    def cell_reference(self) -> str | None:
        """The place as a spreadsheet writes it: row 0, column 27 is ``AB1``."""
        if self.row is None or self.column is None:
            return None
        return f"{column_letters(self.column)}{self.row + 1}"


def column_letters(at: int) -> str:
    out, at = "", at + 1
    while at:
        at, rest = divmod(at - 1, 26)
        out = chr(65 + rest) + out
    return out
