"""Rules and normalisers as Column expressions, and the errors they make."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import cells
from ..schema import ColumnSpec, SchemaSpec
from .binding import Binding

#: Error codes with their names and messages (fixed values).
CODES = {
    1: ("MissingRequired", "value is required"),
    2: ("InvalidType", "invalid type"),
    3: ("MaxLengthExceeded", "exceeds max length"),
    4: ("NotAllowed", "value not allowed"),
    5: ("InvalidUtf8", "invalid text encoding"),
    6: ("MissingRequiredColumn", "missing required column"),
    7: ("ExtraColumn", "extra column not allowed"),
}
UNKNOWN = ("Unknown", "validation error")
FOUND = "array<struct<seq:int,colIndex:int,colKind:string,code:int>>"


def verdict(c: Column, spec: ColumnSpec) -> Column:
    """The code of the first rule that a trimmed cell breaks: required, length in bytes, encoding, allowed values, type. NULL for none, and for an absent cell."""
    rules: list[tuple[Column, int]] = []
    if spec.required:
        rules.append((c == "", 1))
    if spec.max_len is not None:
        rules.append((F.octet_length(c) > F.lit(min(spec.max_len, (1 << 31) - 1)), 3))
    rules.append((~F.is_valid_utf8(c), 5))
    if spec.allowed:
        rules.append((~c.isin(list(spec.allowed)), 4))
    if spec.type == "int":
        rules.append((~cells.is_int(c), 2))
    elif spec.type == "decimal":
        rules.append((~cells.is_decimal(c), 2))
    elif spec.type == "date":
        rules.append((~cells.is_date(c, spec.date_format), 2))
    out = F.when(c.isNull(), None)
    for broken, code in rules:
        out = out.when(broken, code)
    return out.cast("int")


def normalized(c: Column, spec: ColumnSpec) -> Column:
    """A trimmed cell in its normal form: text and ints as they are, decimals and dates rewritten; '' for what is absent, not UTF-8, or no decimal or date."""
    text = c
    if spec.type == "decimal":
        text = cells.decimal_text(c, spec.scale)
    elif spec.type == "date":
        text = cells.date_text(c, spec.date_format)
    return F.coalesce(F.when(F.is_valid_utf8(c), text).otherwise(""), F.lit(""))


def typed(text: Column, spec: ColumnSpec) -> Column:
    """A normalised cell as int DECIMAL(38,0), DECIMAL(38,scale), DATE or STRING; NULL where it is none or does not fit."""
    if spec.type == "int":
        return text.try_cast("decimal(38,0)")
    if spec.type == "decimal":
        return text.try_cast(f"decimal(38,{min(2 if spec.scale is None else spec.scale, cells.MOST_SCALE)})")
    return text.try_cast("date") if spec.type == "date" else text


def _found(seq, index, kind: str, code) -> Column:
    lit = lambda x: x if isinstance(x, Column) else F.lit(x)
    return F.struct(lit(seq).cast("int").alias("seq"), lit(index).cast("int").alias("colIndex"), F.lit(kind).alias("colKind"), lit(code).cast("int").alias("code"))


def findings(schema: SchemaSpec, binding: Binding, cell, width: Column | None = None) -> Column:
    """All faults of a record as one array. cell(i) is the trimmed text of input position i, NULL if absent;
    width is the record's number of fields, where records differ in it."""
    out = [_found(i, s, "schema", verdict(cell(i), schema.columns[s])) for i, s in enumerate(binding.to_schema) if s is not None]
    beyond = None
    if schema.fail_on_extra_columns:
        out += [_found(i, i, "input", F.when(cell(i).isNotNull(), 7)) for i, s in enumerate(binding.to_schema) if s is None]
        if width is not None:
            known = len(binding.to_schema)
            extra = F.when(width > known, F.sequence(F.lit(known), width - 1)).otherwise(F.array().cast("array<int>"))
            beyond = F.transform(extra, lambda i: _found(i, i, "input", 7)).cast(FOUND)
    if not binding.header and width is not None:
        out += [_found(i, i, "schema", F.when(width <= i, 1)) for i, c in enumerate(schema.columns) if c.required]
    broken = F.filter(F.array(*out).cast(FOUND), lambda x: x["code"].isNotNull()) if out else F.array().cast(FOUND)
    return broken if beyond is None else F.concat(broken, beyond)


def header_errors(df: DataFrame, binding: Binding, files: list[str] | None = None) -> DataFrame:
    """The header's faults as (row 0, seq, colIndex, colKind, code), for each of files if given."""
    rows = [(0, i, c, "schema", code) for i, (code, c) in enumerate(binding.faults)]
    schema = "row long, seq int, colIndex int, colKind string, code int"
    if files is None:
        return df.sparkSession.createDataFrame(rows, schema)
    return df.sparkSession.createDataFrame([(f, *r) for f in files for r in rows], f"file string, {schema}")


def decoded(errors: DataFrame, schema: SchemaSpec, binding: Binding) -> DataFrame:
    """Adds codeString, columnName and message to (row, seq, colIndex, colKind, code)."""
    names = F.array(*[F.lit(n) for n in schema.names]).cast("array<string>")
    inputs = F.array(*[F.lit(n) for n in binding.names]).cast("array<string>")
    name = F.when(F.col("colKind") == "schema", F.get(names, F.col("colIndex"))).otherwise(F.get(inputs, F.col("colIndex")))
    code = code_name("code")
    rows = errors.withColumn("columnName", name)
    return rows.select("row", "code", code.alias("codeString"), "colIndex", "colKind", "columnName", message("row", "columnName", "code").alias("message"), *[c for c in errors.columns if c in ("seq", "file")])


def _by_code(code, place: int) -> Column:
    code = F.col(code) if isinstance(code, str) else code
    out = None
    for k, v in CODES.items():
        out = F.when(code == k, v[place]) if out is None else out.when(code == k, v[place])
    return out.otherwise(UNKNOWN[place])


def code_name(code) -> Column:
    return _by_code(code, 0)


def message(row: str, name: str, code: str) -> Column:
    """The text of an error: where, in which column if it has a name, and what."""
    where = F.when(F.col(row) == 0, F.lit("Header")).otherwise(F.concat(F.lit("Row "), F.col(row).cast("string")))
    column = F.when(F.coalesce(F.col(name), F.lit("")) == "", "").otherwise(F.concat(F.lit(', column "'), F.col(name), F.lit('"')))
    return F.concat(where, column, F.lit(": "), _by_code(code, 1))


def packed(errors: DataFrame) -> DataFrame:
    """(w0, w1): the row, and kind (1 for input) << 31 | column << 8 | code, both BIGINT. A column of 2^23 or more has no packed form and raises."""
    kind = F.when(F.col("colKind") == "input", 1).otherwise(0).cast("long")
    column = F.when(F.col("colIndex") < (1 << 23), F.col("colIndex").cast("long")).otherwise(F.raise_error(F.lit("the column has no packed form")).cast("long"))
    w1 = F.shiftleft(kind, 31).bitwiseOR(F.shiftleft(column, 8)).bitwiseOR(F.col("code").cast("long"))
    return errors.select(*[c for c in errors.columns if c == "file"], F.col("row").alias("w0"), w1.alias("w1"))


def unpacked(words: DataFrame, *keep: str) -> DataFrame:
    """(row, colIndex, colKind, code) of packed words, after the columns to keep."""
    w = F.col("w1")
    return words.select(
        *keep, F.col("w0").alias("row"), F.shiftright(w, 8).bitwiseAND(F.lit((1 << 23) - 1)).cast("int").alias("colIndex"),
        F.when(F.shiftright(w, 31).bitwiseAND(F.lit(1)) == 1, "input").otherwise("schema").alias("colKind"), w.bitwiseAND(F.lit(255)).cast("int").alias("code"),
    )
