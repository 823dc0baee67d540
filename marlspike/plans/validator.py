"""Validation of delimited files and of tables: errors, normalised rows and progress as lazy DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.cells import trimmed
from ..operators import rules
from ..operators.binding import Binding, bind_header, bind_nothing, bind_positions
from ..schema import SchemaSpec, parse_schema
from ..sources import delimited

#: Errors kept where no cap is given to a client.
MAX_ERRORS = 10_000


class Result:
    """What a validation found. records has row, c0, c1, ... (trimmed text of each input position, NULL where
    absent) and, where records differ in width, width; for records of several files of one header, file as well."""

    def __init__(self, schema: SchemaSpec, binding: Binding, records: DataFrame, n_inputs: int, ragged: bool, files: list[str] | None = None):
        self.schema, self.binding, self.records, self.n_inputs, self.ragged, self.files = schema, binding, records, n_inputs, ragged, files
        self.keys = ["row"] if files is None else ["file", "row"]

    @property
    def schema_columns(self) -> list[str]:
        return self.schema.names

    @property
    def input_columns(self) -> list[str]:
        """Header names, [] without a header; a name that is not UTF-8 is left out."""
        return [n for n in self.binding.names if n is not None]

    def _cell(self, i: int) -> Column:
        return F.col(f"c{i}") if i < self.n_inputs else F.lit(None).cast("string")

    def _found(self) -> DataFrame:
        """The keys and the array of a record's faults: one column of one scan."""
        return self.records.select(*self.keys, rules.findings(self.schema, self.binding, self._cell, F.col("width") if self.ragged else None).alias("found"))

    def _raw_errors(self) -> DataFrame:
        of = self._found().select(*self.keys, F.inline("found"))
        return rules.header_errors(of, self.binding, self.files).unionByName(of) if self.binding.faults else of

    def errors(self, max_errors: int | None = None) -> DataFrame:
        """row, code, codeString, colIndex, colKind, columnName, message, and seq: errors stand in the order (row, seq), row 0 is the
        header. With max_errors, the first so many in that order; the normalised rows are not affected."""
        raw = self._raw_errors()
        if max_errors is not None:
            raw = raw.orderBy(*self.keys, "seq").limit(max_errors)
        return rules.decoded(raw, self.schema, self.binding)

    def packed_errors(self, max_errors: int | None = None) -> DataFrame:
        return rules.packed(self.errors(max_errors))

    def _normal_cells(self) -> list[Column]:
        """Schema columns in schema order, by place, as names may repeat."""
        return [rules.normalized(self._cell(i), c) if i is not None else F.lit("") for i, c in zip(self.binding.from_input, self.schema.columns)]

    def normalized(self) -> DataFrame:
        """row and the schema's columns as normalised text; every row, faulty or not. A name that comes again gets its place added."""
        return self.records.select(*self.keys, *[x.alias(n) for x, n in zip(self._normal_cells(), self._unique())])

    def typed(self) -> DataFrame:
        """As normalized(), with decimals and dates as such, NULL where they are none."""
        cells = [rules.typed(x, c).alias(n) for x, c, n in zip(self._normal_cells(), self.schema.columns, self._unique())]
        return self.records.select(*self.keys, *cells)

    def _unique(self) -> list[str]:
        names = self.schema.names
        return [n if n not in names[:i] and n.lower() not in self.keys else f"{n}_{i}" for i, n in enumerate(names)]

    def lines(self) -> DataFrame:
        """row and line: the normalised row as delimited text. Without schema columns there is nothing to write."""
        cells = self.records.select(*self.keys, *[x.alias(f"n{i}") for i, x in enumerate(self._normal_cells())])
        rows = cells.select(*self.keys, delimited.rendered([F.col(f"n{i}") for i in range(len(self.schema.columns))], self.schema.delimiter).alias("line"))
        return rows if self.schema.columns else rows.limit(0)

    def write_normalized(self, path: str, one_file: bool = False) -> None:
        """Normalised rows as text files without a header, in row order over the files by name."""
        delimited.write_lines(self.lines().orderBy("row"), path, one_file)

    def progress(self) -> DataFrame:
        """One row: rowsProcessed, errorsAdded (all errors, capped or not), done; from one scan."""
        errors = F.coalesce(F.sum(F.size("found").cast("long")), F.lit(0)) + len(self.binding.faults)
        return self._found().agg(F.count("*").alias("rowsProcessed"), errors.alias("errorsAdded")).withColumn("done", F.lit(True))


class Validator:
    """A compiled schema. Calls share no state."""

    def __init__(self, schema):
        self.schema = parse_schema(schema)

    def table(self, df: DataFrame, row: Column | str, cells: dict[str, Column] | list[Column]) -> Result:
        """Validates a table: row is a unique number for each row; cells are the header names with their columns, in order, or
        just columns for a schema without headers. NULL is an absent cell."""
        named = isinstance(cells, dict)
        binding = bind_header(self.schema, [n.encode() for n in cells]) if named else bind_positions(self.schema)
        columns = list(cells.values()) if named else list(cells)
        row = F.col(row) if isinstance(row, str) else row
        records = df.select(row.cast("long").alias("row"), *[trimmed(c.cast("string")).alias(f"c{i}") for i, c in enumerate(columns)])
        if named:
            return Result(self.schema, binding, records, len(columns), False)
        width = F.lit(0)
        for i in range(len(columns)):
            width = F.when(F.col(f"c{i}").isNotNull(), i + 1).otherwise(width)
        return Result(self.schema, binding, records.withColumn("width", width), len(columns), True)

    def records(self, df: DataFrame, header: list[bytes] | None) -> Result:
        """Validates records (row, fields array<string>) of one file whose header is given, None if it has no record at all."""
        if not self.schema.has_headers:
            binding, n = bind_positions(self.schema), len(self.schema.columns)
        else:
            binding = bind_header(self.schema, header) if header is not None else bind_nothing(self.schema)
            n = len(binding.names)
        cells = [trimmed(F.get("fields", F.lit(i))).alias(f"c{i}") for i in range(n)]
        return Result(self.schema, binding, df.select("row", F.size("fields").alias("width"), *cells), n, True)

    def file(self, spark: SparkSession, path: str, splittable: bool = False) -> Result:
        """Validates one file. Its first record is read here and now, the rest with the result's frames. splittable: read in splits, for
        files without quotes and of UTF-8 only."""
        header = delimited.first_record(path, self.schema.delimiter) if self.schema.has_headers else None
        if splittable:
            rows = delimited.read_splittable(spark, path, self.schema.delimiter, self.schema.has_headers)
        else:
            rows = delimited.read_exact(spark, [path], self.schema.delimiter, int(self.schema.has_headers))
        return self.records(rows, header)

    def files(self, spark: SparkSession, path: str) -> "FileResults":
        """Validates each file of a folder by itself: rows and headers are per file."""
        return FileResults(self, spark, delimited.list_files(path))


class FileResults:
    """Results over several files, told apart by the column file, each as if it were validated alone. Files of one header are
    one scan; no files give frames without rows."""

    def __init__(self, validator: Validator, spark: SparkSession, files: list[str]):
        schema = validator.schema
        self.validator, self.spark, self.schema_columns = validator, spark, schema.names
        headers: dict[tuple | None, list[str]] = {}
        for f, header in delimited.first_records(spark, files, schema.delimiter) if schema.has_headers else [(f, ()) for f in files]:
            headers.setdefault(header, []).append(f)
        self.parts: list[Result] = []
        for header, group in headers.items() or [(None, [])]:
            if group:
                rows = delimited.read_exact(spark, group, schema.delimiter, int(schema.has_headers))
            else:
                rows = spark.createDataFrame([], "file string, row long, fields array<string>")
            result = validator.records(rows, None if header is None else list(header))
            cells = [trimmed(F.get("fields", F.lit(i))).alias(f"c{i}") for i in range(result.n_inputs)]
            records = rows.select("file", "row", F.size("fields").alias("width"), *cells)
            self.parts.append(Result(schema, result.binding, records, result.n_inputs, True, group))

    def _all(self, frame: Callable[[Result], DataFrame]) -> DataFrame:
        out = None
        for r in self.parts:
            out = frame(r) if out is None else out.unionByName(frame(r))
        return out

    def errors(self, max_errors: int | None = None) -> DataFrame:
        """As Result.errors(), in the order (file, row, seq), with file."""
        out = self._all(lambda r: r.errors(max_errors))
        return out if max_errors is None else out.orderBy("file", "row", "seq").limit(max_errors)

    def packed_errors(self, max_errors: int | None = None) -> DataFrame:
        return rules.packed(self.errors(max_errors))

    def normalized(self) -> DataFrame:
        return self._all(Result.normalized)

    def typed(self) -> DataFrame:
        return self._all(Result.typed)

    def lines(self) -> DataFrame:
        return self._all(Result.lines)

    def write_normalized(self, path: str, one_file: bool = False) -> None:
        """As Result.write_normalized(), in the order (file, row)."""
        delimited.write_lines(self.lines().orderBy("file", "row"), path, one_file)

    def rows(self) -> DataFrame:
        return self._all(lambda r: r.records.select("file", "row"))

    def progress(self) -> DataFrame:
        """For each file with rows or faults: file, rowsProcessed, errorsAdded, done; from one scan."""

        def part(r: Result) -> DataFrame:
            rows = r._found().select("file", F.lit(1).alias("n"), F.size("found").alias("errors"))
            if r.binding.faults:
                rows = rows.union(self.spark.createDataFrame([(f, 0, len(r.binding.faults)) for f in r.files], "file string, n int, errors int"))
            return rows

        return self._all(part).groupBy("file").agg(F.sum("n").alias("rowsProcessed"), F.sum("errors").alias("errorsAdded")).withColumn("done", F.lit(True))


class Client:
    """Validates files and reports by callbacks, in the order ready, progress, errors and normalized in batches, done; a failure goes to on_fatal."""

    def __init__(self, spark: SparkSession, schema, max_errors: int = MAX_ERRORS, emit_normalized: bool = False, batch: int = 256,
                 on_ready: Callable | None = None, on_progress: Callable | None = None, on_errors: Callable | None = None,
                 on_normalized: Callable | None = None, on_done: Callable | None = None, on_fatal: Callable | None = None):
        self.spark, self.max_errors, self.emit_normalized, self.batch = spark, max_errors, emit_normalized, batch
        self.on = {"ready": on_ready, "progress": on_progress, "errors": on_errors, "normalized": on_normalized, "done": on_done, "fatal": on_fatal}
        self.group = f"marlspike-{id(self)}"
        self.validator = Validator(schema)
        self._tell("ready", self.validator.schema.names)

    def _tell(self, event: str, *what) -> None:
        if self.on[event]:
            self.on[event](*what)

    def _batches(self, rows: Iterable) -> Iterable[list]:
        held: list = []
        for r in rows:
            held.append(r)
            if len(held) == self.batch:
                yield held
                held = []
        if held:
            yield held

    def validate(self, source: str | DataFrame, row: Column | str | None = None, cells: dict[str, Column] | list[Column] | None = None) -> Result | None:
        """Runs the validation of a file, or of a table as Validator.table() takes it (by default with all columns as cells but the
        one that row names), to its end; None after a failure that on_fatal was told of."""
        self.spark.sparkContext.setJobGroup(self.group, "validation", interruptOnCancel=True)
        try:
            if isinstance(source, DataFrame):
                named = {c: F.col(f"`{c}`") for c in source.columns if c != row}
                result = self.validator.table(source, row, cells or (named if self.validator.schema.has_headers else list(named.values())))
            else:
                result = self.validator.file(self.spark, source)
            self._tell("progress", result.progress().first().asDict())
            if self.on["errors"]:
                for part in self._batches(result.errors(self.max_errors).orderBy("row", "seq").toLocalIterator()):
                    self._tell("errors", [r.asDict() for r in part])
            if self.emit_normalized and self.on["normalized"]:
                for part in self._batches(result.lines().orderBy("row").toLocalIterator()):
                    self._tell("normalized", "".join(r.line + "\n" for r in part))
            self._tell("done")
            return result
        except Exception as e:
            if not self.on["fatal"]:
                raise
            self._tell("fatal", str(e))
            return None

    def terminate(self) -> None:
        """Cancels what runs."""
        self.spark.sparkContext.cancelJobGroup(self.group)


def create_validator(spark: SparkSession, schema, **options) -> Client:
    return Client(spark, schema, **options)
