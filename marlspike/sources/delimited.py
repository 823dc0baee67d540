"""Delimited text: a byte-exact source, a splittable one for files without quotes, and the sink.

The exact source reads any file system that pyarrow reaches, one partition for each file, and yields
records as arrays of bytes with their number: quotes only at the start of a field, doubled quotes,
line ends of any kind, blank lines skipped, bytes kept as they are. Memory is one batch of records, of
BATCH_BYTES or one record at most.
"""

from __future__ import annotations

import csv
import io
import json
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..storage import filesystem

BATCH, BATCH_BYTES = 8192, 8_000_000
RECORDS = pa.schema([("file", pa.string()), ("row", pa.int64()), ("fields", pa.list_(pa.binary()))])


def list_files(path: str) -> list[str]:
    """The files of a path: itself, or those in a folder, by name; hidden ones and those of writers left out."""
    from pyarrow.fs import FileSelector, FileType

    fs, inner = filesystem(path)
    info = fs.get_file_info(inner)
    if info.type == FileType.File:
        return [path]
    if info.type == FileType.NotFound:
        raise FileNotFoundError(path)
    names = sorted(x.base_name for x in fs.get_file_info(FileSelector(inner)) if x.type == FileType.File and x.base_name[0] not in "._")
    return [f"{path.rstrip('/')}/{n}" for n in names]


def raw_records(stream, delimiter: bytes) -> Iterator[list[bytes]]:
    """The records of a binary stream."""
    csv.field_size_limit(sys.maxsize)
    text = io.TextIOWrapper(stream, encoding="latin-1", newline="")
    for record in csv.reader(text, delimiter=delimiter.decode("latin-1"), quotechar='"', doublequote=True, strict=False):
        if record:
            yield [x.encode("latin-1") for x in record]


def first_record(path: str, delimiter: bytes) -> list[bytes] | None:
    """The first record of a file, None for an empty one."""
    fs, inner = filesystem(path)
    with fs.open_input_stream(inner, compression=None) as stream:
        return next(raw_records(stream, delimiter), None)


def first_records(spark: SparkSession, files: list[str], delimiter: bytes) -> list[tuple[str, tuple[bytes, ...] | None]]:
    """The first record of each file, read by tasks: a header for each file comes to the driver, which lists the files as well."""

    def f(batches):
        for batch in batches:
            names = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([first_record(x, delimiter) for x in names], pa.list_(pa.binary()))], names=["file", "fields"])

    if not files:
        return []
    rows = spark.createDataFrame([(x,) for x in files], "file string").repartition(min(len(files), 2 * spark.sparkContext.defaultParallelism))
    found = {r.file: r.fields for r in rows.mapInArrow(f, "file string, fields array<binary>").collect()}
    return [(x, None if found[x] is None else tuple(bytes(y) for y in found[x])) for x in files]


class File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.delimiter = bytes([int(options.get("delimiter", "44"))])
        self.skip = int(options.get("skip", "0"))

    def partitions(self) -> list[File]:
        return [File(x) for x in self.files]

    def read(self, partition: File) -> Iterator[pa.RecordBatch]:
        fs, inner = filesystem(partition.path)
        with fs.open_input_stream(inner, compression=None) as stream:
            held: list[list[bytes]] = []
            row, size = 1 - self.skip, 0
            for record in raw_records(stream, self.delimiter):
                held.append(record)
                size += sum(map(len, record))
                if len(held) == BATCH or size >= BATCH_BYTES:
                    yield self.batch(partition.path, row, held)
                    row, held, size = row + len(held), [], 0
            if held:
                yield self.batch(partition.path, row, held)

    @staticmethod
    def batch(path: str, row: int, held: list) -> pa.RecordBatch:
        batch = pa.RecordBatch.from_arrays([pa.array([path] * len(held), pa.string()), pa.array(range(row, row + len(held)), pa.int64()), pa.array(held, pa.list_(pa.binary()))], schema=RECORDS)
        return batch if row > 0 else batch.slice(min(1 - row, len(held)))


class ExactDelimited(DataSource):
    """Options: files (their paths as JSON), delimiter (its byte as a number), skip (records before row 1 of each file)."""

    @classmethod
    def name(cls) -> str:
        return "marlspike_delimited"

    def schema(self) -> str:
        return "file string, row long, fields array<binary>"

    def reader(self, schema) -> DataSourceReader:
        return Reader(self.options)


def read_exact(spark: SparkSession, files: list[str], delimiter: bytes = b",", skip: int = 0) -> DataFrame:
    """(file, row, fields) of the records of all files; row counts from 1 in each, after the skipped ones. A field is the text of its bytes, UTF-8 or not."""
    spark.dataSource.register(ExactDelimited)
    rows = spark.read.format(ExactDelimited.name()).option("files", json.dumps(files)).option("delimiter", str(delimiter[0])).option("skip", str(skip)).load()
    return rows.select("file", "row", F.transform("fields", lambda x: x.cast("string")).alias("fields"))


def read_splittable(spark: SparkSession, path: str, delimiter: bytes = b",", has_header: bool = False) -> DataFrame:
    """(file, row, fields) of one file without quotes, read in splits; a quote anywhere raises when that row is read, as does a line that
    is not UTF-8 (splitting would not keep its bytes): such files need read_exact. Line ends and blank lines are as there."""
    sep = delimiter.decode("latin-1")
    if not sep.isascii():
        raise ValueError("a delimiter beyond ASCII needs the exact source")
    lines = spark.read.text(path).where(F.col("value") != "").withColumn("_at", F.monotonically_increasing_id())
    # an id is the partition, then the place in it; one number for each partition goes to the driver
    part = F.shiftright("_at", 33).cast("int")
    sizes = dict(lines.groupBy(part.alias("part")).count().collect())
    before, n = [], 0 if has_header else 1
    for i in range(max(sizes, default=0) + 1):
        before.append(n)
        n += sizes.get(i, 0)
    starts, counted = F.lit(before).cast("array<long>"), F.lit([sizes.get(i, 0) for i in range(len(before))]).cast("array<long>")
    place = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    # splits other than those that were counted give a place beyond the count somewhere
    known = F.coalesce(place < F.get(counted, part), F.lit(False))
    row = F.when(known, F.get(starts, part) + place).otherwise(F.raise_error(F.lit("the file was split otherwise than when its lines were counted")).cast("long"))
    numbered = lines.select(row.alias("row"), "value")
    odd = F.col("value").contains('"') | ~F.is_valid_utf8("value")
    value = F.when(odd, F.raise_error(F.lit("the file has quotes or bytes that are not UTF-8: read it with the exact source"))).otherwise(F.col("value"))
    literal = {" ": " ", "\t": "\\t"}.get(sep, "\\" + sep if not sep.isalnum() else sep)
    rows = numbered.where("row > 0").select(F.lit(path).alias("file"), "row", F.split(value, literal, -1).alias("fields"))
    return rows


def rendered(cells: list[Column], delimiter: bytes = b",") -> Column:
    """One line of delimited text: a cell is quoted if it holds the delimiter, a quote or a line end, and only then; its quotes are doubled."""
    sep = delimiter.decode("latin-1")
    special = '["\\r\\n' + ("\\" + sep if not sep.isalnum() else sep) + "]"
    out = []
    for c in cells:
        quoted = F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))
        out.append(F.when(c.rlike(special), quoted).otherwise(c))
    return F.concat_ws(sep, *out) if out else F.lit("")


def write_lines(lines: DataFrame, path: str, one_file: bool = False) -> None:
    """Writes the column "line" in the order of its rows; into one file where the whole order must stand in one."""
    (lines.coalesce(1) if one_file else lines).select("line").write.mode("overwrite").text(path, lineSep="\n")
