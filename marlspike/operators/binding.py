"""Header binding: which input position feeds which schema column, settled once on the driver."""

from __future__ import annotations

from dataclasses import dataclass

from ..schema import SchemaSpec

BLANKS = b" \t\n\x0c\r"
BOM = b"\xef\xbb\xbf"


@dataclass(frozen=True)
class Binding:
    """names: input header names (None for one that is not UTF-8), empty without a header. to_schema: the
    schema column of each input position. from_input: the input position that each schema column is
    emitted from (the last of duplicates). faults: (code, column) of the header, in order."""

    names: tuple[str | None, ...]
    to_schema: tuple[int | None, ...]
    from_input: tuple[int | None, ...]
    faults: tuple[tuple[int, int], ...] = ()
    header: bool = True


def bind_header(schema: SchemaSpec, fields: list[bytes]) -> Binding:
    """Binds a header record. A name goes to the first schema column that equals it; a name that is not
    UTF-8 is a fault, binds to nothing, and keeps its place."""
    names: list[str | None] = []
    faults: list[tuple[int, int]] = []
    for i, raw in enumerate(fields):
        if i == 0 and raw.startswith(BOM):
            raw = raw[len(BOM) :]
        try:
            names.append(raw.strip(BLANKS).decode())
        except UnicodeDecodeError:
            names.append(None)
            faults.append((5, 0))
    first = {}
    for i, name in enumerate(schema.names):
        first.setdefault(name, i)
    to_schema = tuple(first.get(n) if n is not None else None for n in names)
    from_input: list[int | None] = [None] * len(schema.columns)
    for i, s in enumerate(to_schema):
        if s is not None:
            from_input[s] = i
    faults += [(6, i) for i, c in enumerate(schema.columns) if c.required and c.name not in names]
    return Binding(tuple(names), to_schema, tuple(from_input), tuple(faults))


def bind_positions(schema: SchemaSpec) -> Binding:
    """Input position i is schema column i."""
    places = tuple(range(len(schema.columns)))
    return Binding((), places, places, header=False)


def bind_nothing(schema: SchemaSpec) -> Binding:
    """An empty file of a schema with headers: no header was seen, so nothing can be at fault."""
    return Binding((), (), (None,) * len(schema.columns))
