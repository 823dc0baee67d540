"""The schema document: parsed strictly, once, on the driver."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

TYPES = ("string", "int", "decimal", "date")
DATE_FORMATS = ("ymd-dash", "dmy-slash", "mdy-slash")
#: Fraction digits of a decimal without "precision"; the most that a decimal can have.
DEFAULT_SCALE, MOST_SCALE = 2, 28


class SchemaError(ValueError):
    """The schema document is not valid."""


@dataclass(frozen=True)
class ColumnSpec:
    """One schema column. max_len counts bytes after trimming; scale is the document's "precision"."""

    name: str
    type: str
    required: bool = False
    max_len: int | None = None
    allowed: tuple[str, ...] = ()
    scale: int | None = None
    date_format: str | None = None


@dataclass(frozen=True)
class SchemaSpec:
    has_headers: bool
    delimiter: bytes = b","
    columns: tuple[ColumnSpec, ...] = field(default=())
    fail_on_extra_columns: bool = False

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]


def _fail(what: str) -> SchemaError:
    return SchemaError(f"Invalid schema JSON: {what}")


def _get(d: dict, key: str, kind: type, default=None, required: bool = False, nullable: bool = False):
    if key not in d:
        if required:
            raise _fail(f"missing field `{key}`")
        return default
    value = d[key]
    if value is None and nullable:
        return None
    if type(value) is not kind:
        raise _fail(f"`{key}` must be of type {kind.__name__}")
    return value


def _natural(d: dict, key: str, most: int) -> int | None:
    value = _get(d, key, int, nullable=True)
    if value is not None and not 0 <= value <= most:
        raise _fail(f"`{key}` is out of range")
    return value


def _one_of(d: dict, key: str, names: tuple[str, ...], **how):
    value = _get(d, key, str, **how)
    if value is not None and value not in names:
        raise _fail(f"`{key}` must be one of {', '.join(names)}")
    return value


def _delimiter(d: dict) -> bytes:
    value = d.get("delimiter", ",")
    if type(value) is int and 0 <= value <= 255:
        out = bytes([value])
    elif type(value) is str and len(value.encode()) == 1:
        out = value.encode()
    else:
        raise _fail("`delimiter` must be a number from 0 to 255 or a string of one byte")
    if out in (b'"', b"\r", b"\n"):
        raise _fail("`delimiter` cannot be a quote or a line end")
    return out


def _column(d) -> ColumnSpec:
    if type(d) is not dict:
        raise _fail("a column must be an object")
    allowed = _get(d, "allowed", list, default=[])
    if any(type(x) is not str for x in allowed):
        raise _fail("`allowed` must hold strings")
    return ColumnSpec(
        name=_get(d, "name", str, required=True),
        type=_one_of(d, "type", TYPES, required=True),
        required=_get(d, "required", bool, default=False),
        max_len=_natural(d, "maxLen", (1 << 64) - 1),
        allowed=tuple(allowed),
        scale=_natural(d, "precision", (1 << 32) - 1),
        date_format=_one_of(d, "dateFormat", DATE_FORMATS, nullable=True),
    )


def parse_schema(document: str | bytes | dict | SchemaSpec) -> SchemaSpec:
    """A schema from JSON text or its parsed form. Unknown keys are ignored; anything else out of place raises SchemaError."""
    if isinstance(document, SchemaSpec):
        return document
    if isinstance(document, (str, bytes)):
        try:
            document = json.loads(document)
        except ValueError as e:
            raise _fail(str(e)) from None
    if type(document) is not dict:
        raise _fail("it must be an object")
    return SchemaSpec(
        has_headers=_get(document, "hasHeaders", bool, required=True),
        delimiter=_delimiter(document),
        columns=tuple(_column(c) for c in _get(document, "columns", list, default=[])),
        fail_on_extra_columns=_get(document, "failOnExtraColumns", bool, default=False),
    )
