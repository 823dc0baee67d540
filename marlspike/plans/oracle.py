"""The same rules as SQL text for another engine, written on their own, for comparison."""

from __future__ import annotations

from ..operators.rules import CODES
from ..schema import ColumnSpec, SchemaSpec


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def trim(c: str) -> str:
    return f"trim({c}, ' ' || chr(9) || chr(10) || chr(12) || chr(13))"


def _decimal_ok(c: str) -> str:
    digits = f"regexp_replace({c}, '[^0-9]', '', 'g')"
    fraction = f"length(regexp_extract(replace({c}, '_', ''), '\\.([0-9]*)$', 1))"
    return f"(regexp_full_match({c}, '[+-]?(?:[0-9][0-9_]*\\.?[0-9_]*|\\.[0-9][0-9_]*)') AND {fraction} <= 28 AND coalesce(TRY_CAST({digits} AS DECIMAL(38,0)) <= 79228162514264337593543950335, false))"


def _date(c: str, how: str | None) -> str:
    """The date as text YYYY-MM-DD, NULL if it is none (years 1 to 9999 here)."""
    sep, *places = {"ymd-dash": ("-", 1, 2, 3), "dmy-slash": ("/", 3, 2, 1), "mdy-slash": ("/", 3, 1, 2)}[how or "ymd-dash"]
    pattern = f"^([0-9]+){sep}([0-9]+){sep}([0-9]+)$"
    numbers = [f"TRY_CAST(regexp_extract({c}, '{pattern}', {p}) AS INTEGER)" for p in places]
    parts = [f"CASE WHEN {n} < {10**w} THEN lpad({n}::VARCHAR, {w}, '0') END" for n, w in zip(numbers, (4, 2, 2))]
    return f"TRY_CAST({parts[0]} || '-' || {parts[1]} || '-' || {parts[2]} AS DATE)::VARCHAR"


def verdict(c: str, spec: ColumnSpec) -> str:
    rules = []
    if spec.required:
        rules.append((f"{c} = ''", 1))
    if spec.max_len is not None:
        rules.append((f"strlen({c}) > {spec.max_len}", 3))
    if spec.allowed:
        rules.append((f"{c} NOT IN ({', '.join(map(quoted, spec.allowed))})", 4))
    if spec.type == "int":
        rules.append((f"NOT regexp_full_match({c}, '[+-]?[0-9]+')", 2))
    elif spec.type == "decimal":
        rules.append((f"NOT {_decimal_ok(c)}", 2))
    elif spec.type == "date":
        rules.append((f"{_date(c, spec.date_format)} IS NULL", 2))
    return f"CASE WHEN {c} IS NULL THEN NULL {' '.join(f'WHEN {r} THEN {k}' for r, k in rules)} END" if rules else "CAST(NULL AS INTEGER)"


def normalized(c: str, spec: ColumnSpec) -> str:
    if spec.type == "decimal":
        c = f"CASE WHEN {_decimal_ok(c)} THEN TRY_CAST(replace({c}, '_', '') AS DECIMAL(38,{2 if spec.scale is None else spec.scale}))::VARCHAR END"
    elif spec.type == "date":
        c = _date(c, spec.date_format)
    return f"coalesce({c}, '')"


def error_row(row: str, code: str, index: int | str, kind: str, name: str | None) -> str:
    """The select list of one error."""
    column = "" if not name else f', column "{name}"'
    text = " ".join(f"WHEN {k} THEN {quoted(v[1])}" for k, v in CODES.items())
    names = " ".join(f"WHEN {k} THEN {quoted(v[0])}" for k, v in CODES.items())
    where = f"CASE WHEN {row} = 0 THEN 'Header' ELSE 'Row ' || {row} END"
    return (
        f"CAST({row} AS BIGINT) AS row, CAST({code} AS INTEGER) AS code, CASE {code} {names} END AS \"codeString\", CAST({index} AS INTEGER) AS \"colIndex\", "
        f"{quoted(kind)} AS \"colKind\", {quoted(name) if name is not None else 'CAST(NULL AS VARCHAR)'} AS \"columnName\", {where} || {quoted(column + ': ')} || CASE {code} {text} END AS message"
    )


def errors(source: str, schema: SchemaSpec, cells: dict[str, str], more: list[str] = ()) -> str:
    """The errors of a subquery with row and cells (schema column name: cell), one branch for each column; more: further branches."""
    at = {c.name: (i, c) for i, c in enumerate(schema.columns)}
    out = []
    for name, cell in cells.items():
        i, spec = at[name]
        out.append(f"SELECT {error_row('row', 'code', i, 'schema', name)} FROM (SELECT row, {verdict('c', spec)} AS code FROM (SELECT row, {trim(cell)} AS c FROM src)) WHERE code IS NOT NULL")
    return f"WITH src AS ({source}) " + " UNION ALL ".join([*out, *more])
