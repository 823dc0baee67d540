"""Queries over the driver's tables, one or more for each operator, with SQL for comparison.

Tables hold typed, clean values; each query renders them as text and plants faults by key arithmetic,
by expressions that both engines read alike.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import cells as fn
from ..operators import rules
from ..schema import SchemaSpec, parse_schema
from ..sources import delimited
from ..storage import filesystem, shared_dir
from . import oracle
from .validator import FileResults, Result, Validator

OUT = ("row", "code", "codeString", "colIndex", "colKind", "columnName", "message")
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def schema_of(columns: list[dict], **top) -> SchemaSpec:
    return parse_schema({"hasHeaders": True, "columns": columns} | top)


class Planted:
    """A table rendered as text cells with planted faults: key is a unique integer column, row is key + 1."""

    def __init__(self, table: str, key: str, cells: dict[str, str]):
        self.table, self.key, self.cells = table, key, cells

    def frame(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        return read(spark, sf_dir, self.table).selectExpr(f"CAST({self.key} + 1 AS BIGINT) AS row", *[f"{e} AS `{n}`" for n, e in self.cells.items()])

    def sql(self) -> str:
        return f"SELECT CAST({self.key} + 1 AS BIGINT) AS row, " + ", ".join(f'{e} AS "{n}"' for n, e in self.cells.items()) + f" FROM {self.table}"

    def result(self, spark: SparkSession, sf_dir: str, schema: SchemaSpec) -> Result:
        df = self.frame(spark, sf_dir)
        return Validator(schema).table(df, "row", {n: F.col(f"`{n}`") for n in self.cells})


def errors_query(name: str, planted: Planted, schema: SchemaSpec, more: list[str] = ()) -> None:
    bound = {n: f'"{n}"' for n in planted.cells if n in schema.names}
    QUERIES[name] = lambda spark, sf_dir: planted.result(spark, sf_dir, schema).errors().select(*OUT)
    SQL[name] = oracle.errors(planted.sql(), schema, bound, more)


def normal_query(name: str, planted: Planted, schema: SchemaSpec) -> None:
    QUERIES[name] = lambda spark, sf_dir: planted.result(spark, sf_dir, schema).normalized()
    cells = ", ".join(oracle.normalized(oracle.trim(f'"{c.name}"'), c) + f' AS "{c.name}"' for c in schema.columns)
    SQL[name] = f"WITH src AS ({planted.sql()}) SELECT row, {cells} FROM src"


def lines_file(spark: SparkSession, lines: DataFrame, header: str | None, ending: str = "") -> str:
    """Writes (row, line) in row order as one delimited file in the shared folder; returns its path."""
    if header is not None:
        lines = lines.select("row", "line").union(spark.createDataFrame([(0, header)], "row long, line string"))
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    delimited.write_lines(lines.repartition(1).sortWithinPartitions("row").select(F.concat("line", F.lit(ending)).alias("line")), folder)
    return delimited.list_files(folder)[0]


def bytes_file(spark: SparkSession, data: bytes) -> str:
    folder = f"{shared_dir(spark)}/bytes-{uuid.uuid4().hex}"
    fs, inner = filesystem(folder)
    fs.create_dir(inner, recursive=True)
    with fs.open_output_stream(f"{inner}/input.csv", compression=None) as out:
        out.write(data)
    return f"{folder}/input.csv"


# --- one rule at a time -----------------------------------------------------------------------------

PAD = "chr(32) || chr(9) || {} || chr(13) || chr(12)"
ORDERS = Planted("orders", "o_orderkey", {
    "o_orderkey": PAD.format("CASE WHEN o_orderkey % 17 = 0 THEN '' WHEN o_orderkey % 13 = 0 THEN CAST(o_orderkey AS STRING) || 'x' ELSE CAST(o_orderkey AS STRING) END"),
    "o_totalprice": "CASE WHEN o_orderkey % 19 = 0 THEN '1,000' WHEN o_orderkey % 23 = 0 THEN '1e3' ELSE CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) END",
    "o_orderdate": "CASE WHEN o_orderkey % 29 = 0 THEN '2023-02-29' WHEN o_orderkey % 31 = 0 THEN '2024/01/05' WHEN o_orderkey % 7 = 0 THEN '2024-2-9' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END",
    "o_orderstatus": "o_orderstatus",
    "o_orderpriority": "o_orderpriority",
})
ORDERS_SCHEMA = schema_of([
    {"name": "o_orderkey", "type": "int", "required": True},
    {"name": "o_totalprice", "type": "decimal", "required": True, "precision": 2},
    {"name": "o_orderdate", "type": "date", "required": True, "dateFormat": "ymd-dash"},
    {"name": "o_orderstatus", "type": "string", "required": True, "allowed": ["O", "F"]},
    {"name": "o_orderpriority", "type": "string", "maxLen": 10},
])
errors_query("validate_orders_errors", ORDERS, ORDERS_SCHEMA)
errors_query("error_messages", ORDERS, ORDERS_SCHEMA)
errors_query("rule_required", Planted("orders", "o_orderkey", {"v": "CASE WHEN o_orderkey % 5 = 0 THEN ' ' || chr(9) ELSE o_orderpriority END"}), schema_of([{"name": "v", "type": "string", "required": True}]))
errors_query("rule_max_len_bytes", Planted("documents", "doc_id", {"text": "text"}), schema_of([{"name": "text", "type": "string", "maxLen": 1200}]))
errors_query("rule_allowed", Planted("customer", "c_custkey", {"c_mktsegment": "c_mktsegment"}), schema_of([{"name": "c_mktsegment", "type": "string", "allowed": ["BUILDING", "building", "MACHINERY"]}]))
INT_CELL = "CASE CAST(c_custkey AS BIGINT) % 11 WHEN 0 THEN '+' WHEN 1 THEN '-0' WHEN 2 THEN '1.0' WHEN 3 THEN '+007' WHEN 4 THEN '1_0' WHEN 5 THEN '99999999999999999999999999999999999999999999' WHEN 6 THEN '' WHEN 7 THEN '0x1' ELSE CAST(c_custkey AS STRING) END"
errors_query("rule_int", Planted("customer", "c_custkey", {"v": INT_CELL}), schema_of([{"name": "v", "type": "int"}]))
DECIMAL_CELL = (
    "CASE CAST(p_partkey AS BIGINT) % 23 WHEN 0 THEN '1.235' WHEN 1 THEN '-1.235' WHEN 2 THEN '.5' WHEN 3 THEN '5.' WHEN 4 THEN '+5' WHEN 5 THEN '1e3' WHEN 6 THEN '1_000' WHEN 7 THEN '1,000' "
    "WHEN 8 THEN '.' WHEN 9 THEN '' WHEN 10 THEN '$5' WHEN 11 THEN '1.2.3' WHEN 12 THEN '79228162514264337593543950336' WHEN 13 THEN '0.00000000000000000000000000001' WHEN 14 THEN '2.675' "
    "WHEN 15 THEN '-0.001' WHEN 16 THEN '007' WHEN 17 THEN '-' ELSE CAST(CAST(p_retailprice AS DECIMAL(18,4)) AS STRING) END"
)
PART_DECIMALS = Planted("part", "p_partkey", {"v": DECIMAL_CELL})
errors_query("rule_decimal", PART_DECIMALS, schema_of([{"name": "v", "type": "decimal"}]))
DAY, MONTH, YEAR = "CAST(day(CAST(o_orderdate AS DATE)) AS STRING)", "CAST(month(CAST(o_orderdate AS DATE)) AS STRING)", "CAST(year(CAST(o_orderdate AS DATE)) AS STRING)"
DATE_CELLS = {
    "ymd": f"CASE o_orderkey % 13 WHEN 0 THEN '2023-02-29' WHEN 1 THEN '1900-02-29' WHEN 2 THEN '2000-02-29' WHEN 3 THEN '24-1-5' WHEN 4 THEN '2024-13-01' WHEN 5 THEN '2024-01-05-' WHEN 6 THEN '2024--01' WHEN 7 THEN '10000-01-01' WHEN 8 THEN '0002024-001-05' ELSE {YEAR} || '-' || {MONTH} || '-' || {DAY} END",
    "dmy": f"CASE o_orderkey % 7 WHEN 0 THEN '29/2/2023' WHEN 1 THEN '12/31/2024' WHEN 2 THEN '2024-01-05' ELSE {DAY} || '/' || {MONTH} || '/' || {YEAR} END",
    "mdy": f"CASE o_orderkey % 7 WHEN 0 THEN '2/29/2023' WHEN 1 THEN '31/12/2024' WHEN 2 THEN '5/6/24' ELSE {MONTH} || '/' || {DAY} || '/' || {YEAR} END",
}
for _how, _cell in DATE_CELLS.items():
    _planted = Planted("orders", "o_orderkey", {"d": _cell})
    _schema = schema_of([{"name": "d", "type": "date", "dateFormat": f"{_how}-{'dash' if _how == 'ymd' else 'slash'}"}])
    errors_query(f"rule_date_{_how}", _planted, _schema)
    normal_query(f"normalize_date_{_how}", _planted, _schema)
errors_query("rule_precedence", Planted("customer", "c_custkey", {"v": "CASE CAST(c_custkey AS BIGINT) % 4 WHEN 0 THEN '' WHEN 1 THEN 'far too long a cell' WHEN 2 THEN 'abc' ELSE '7' END"}), schema_of([{"name": "v", "type": "int", "required": True, "maxLen": 5, "allowed": ["7", "abcd"]}]))
errors_query(
    "optional_empty_trap", Planted("orders", "o_orderkey", {n: f"CASE WHEN o_orderkey % {m} = 0 THEN '' ELSE {e} END" for n, m, e in (("i", 3, "'1'"), ("d", 4, "'1.5'"), ("t", 5, "'2024-01-01'"), ("a", 6, "'X'"), ("e", 7, "'X'"))}),
    schema_of([{"name": "i", "type": "int"}, {"name": "d", "type": "decimal"}, {"name": "t", "type": "date"}, {"name": "a", "type": "string", "allowed": ["X"]}, {"name": "e", "type": "string", "allowed": ["", "X"]}]),
)
TRIM = Planted("part", "p_partkey", {"v": "CASE CAST(p_partkey AS BIGINT) % 3 WHEN 0 THEN chr(11) || p_name || chr(11) WHEN 1 THEN chr(9) || chr(13) || p_name || chr(12) || chr(10) || ' ' ELSE ' ' || p_name || chr(160) END"})
normal_query("trim_ascii", TRIM, schema_of([{"name": "v", "type": "string"}]))
for _p in (0, 2, 4):
    normal_query(f"normalize_decimal_p{_p}", PART_DECIMALS, schema_of([{"name": "v", "type": "decimal", "precision": _p}]))
normal_query("normalize_int_passthrough", Planted("customer", "c_custkey", {"v": INT_CELL}), schema_of([{"name": "v", "type": "int"}]))
normal_query("normalize_full_row", ORDERS, ORDERS_SCHEMA)
normal_query("column_reorder_prune", Planted("supplier", "s_suppkey", {"s_acctbal": "CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS STRING)", "unused": "s_name", "s_name": "' ' || s_name", "s_suppkey": "CAST(s_suppkey AS STRING)"}),
             schema_of([{"name": "s_suppkey", "type": "int"}, {"name": "s_name", "type": "string"}, {"name": "s_acctbal", "type": "decimal", "precision": 1}]))


def typed_view_orders(spark, sf_dir):
    return ORDERS.result(spark, sf_dir, ORDERS_SCHEMA).typed().select("row", "o_orderkey", "o_totalprice", "o_orderdate")


QUERIES["typed_view_orders"] = typed_view_orders
_N = {c.name: oracle.normalized(oracle.trim(f'"{c.name}"'), c) for c in ORDERS_SCHEMA.columns}
SQL["typed_view_orders"] = f"WITH src AS ({ORDERS.sql()}) SELECT row, TRY_CAST({_N['o_orderkey']} AS DECIMAL(38,0)) AS o_orderkey, TRY_CAST({_N['o_totalprice']} AS DECIMAL(38,2)) AS o_totalprice, TRY_CAST({_N['o_orderdate']} AS DATE) AS o_orderdate FROM src"

# --- order, cap, packing, counts -------------------------------------------------------------------

_ALL = oracle.errors(ORDERS.sql(), ORDERS_SCHEMA, {n: f'"{n}"' for n in ORDERS.cells})
QUERIES["errors_top_k"] = lambda spark, sf_dir: ORDERS.result(spark, sf_dir, ORDERS_SCHEMA).errors(100).select(*OUT)
SQL["errors_top_k"] = f'SELECT * FROM ({_ALL}) ORDER BY row, "colIndex" LIMIT 100'


def error_pack_unpack(spark, sf_dir):
    """The packed words as they are, of faults of both kinds, with what unpacking them gives."""
    found = [ORDERS.result(spark, sf_dir, ORDERS_SCHEMA), Planted("nation", "n_nationkey", NATION).result(spark, sf_dir, _ID)]
    words = found[0].packed_errors().union(found[1].packed_errors())
    return rules.unpacked(words, "w0", "w1").drop("row")


NATION = {"id": "CAST(n_nationkey AS STRING)", "name": "n_name", "zzz": "CAST(n_regionkey AS STRING)"}
_ID = schema_of([{"name": "id", "type": "int", "required": True}], failOnExtraColumns=True)
_extra = lambda i, name, where="": f"SELECT {oracle.error_row('row', '7', i, 'input', name)} FROM src {where}"
QUERIES["error_pack_unpack"] = error_pack_unpack
_FOUND_NATION = oracle.errors(Planted("nation", "n_nationkey", NATION).sql(), _ID, {"id": '"id"'}, [_extra(1, "name"), _extra(2, "zzz")])
SQL["error_pack_unpack"] = f"""SELECT row AS w0, CAST(CASE "colKind" WHEN 'input' THEN 2147483648 ELSE 0 END + "colIndex" * 256 + code AS BIGINT) AS w1, "colIndex", "colKind", code
 FROM (SELECT row, code, "colIndex", "colKind" FROM ({_ALL}) UNION ALL SELECT row, code, "colIndex", "colKind" FROM ({_FOUND_NATION}))"""
QUERIES["progress_counts"] = lambda spark, sf_dir: ORDERS.result(spark, sf_dir, ORDERS_SCHEMA).progress()
SQL["progress_counts"] = f'SELECT (SELECT count(*) FROM orders) AS "rowsProcessed", (SELECT count(*) FROM ({_ALL})) AS "errorsAdded", true AS done'

# --- structure --------------------------------------------------------------------------------------

errors_query("extra_columns", Planted("nation", "n_nationkey", NATION), _ID, [_extra(1, "name"), _extra(2, "zzz")])
errors_query("missing_required_columns", Planted("nation", "n_nationkey", {"id": "CAST(n_nationkey AS STRING)"}),
             schema_of([{"name": "id", "type": "int"}, {"name": "name", "type": "string", "required": True}, {"name": "code", "type": "int", "required": True}, {"name": "note", "type": "string"}]),
             [f"SELECT {oracle.error_row('0', '6', i, 'schema', n)}" for i, n in ((1, "name"), (2, "code"))])


def extra_columns_beyond_header(spark, sf_dir):
    lines = read(spark, sf_dir, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS row", "CAST(r_regionkey AS STRING) || ',' || r_name || CASE WHEN r_regionkey % 2 = 0 THEN ',8,9' ELSE '' END AS line")
    return Validator(_ID).file(spark, lines_file(spark, lines, "id,zzz")).errors().select(*OUT)


QUERIES["extra_columns_beyond_header"] = extra_columns_beyond_header
SQL["extra_columns_beyond_header"] = "WITH src AS (SELECT CAST(r_regionkey + 1 AS BIGINT) AS row FROM region) " + " UNION ALL ".join([_extra(1, "zzz"), *(_extra(i, None, "WHERE (row - 1) % 2 = 0") for i in (2, 3))])

SHORT = {"a": "CAST(c_custkey AS STRING)", "b": "c_mktsegment", "c": "'3'"}
_SHORT_LINE = "CASE CAST(c_custkey AS BIGINT) % 3 WHEN 0 THEN CAST(c_custkey AS STRING) WHEN 1 THEN CAST(c_custkey AS STRING) || ',' || c_mktsegment ELSE CAST(c_custkey AS STRING) || ',' || c_mktsegment || ',x' END"
_POSITIONAL = [{"name": "a", "type": "int", "required": True}, {"name": "b", "type": "string", "required": True}, {"name": "c", "type": "int"}]


def _short(header: bool):
    def query(spark, sf_dir):
        keyed = read(spark, sf_dir, "customer").selectExpr("CAST(c_custkey AS BIGINT) AS row", f"{_SHORT_LINE} AS line")
        found = Validator(schema_of(_POSITIONAL, hasHeaders=header)).file(spark, lines_file(spark, keyed.withColumn("row", F.col("row") + 1), "a,b,c" if header else None))
        return found.errors().select(*OUT)

    return query


QUERIES["short_row_headerless"], QUERIES["short_row_with_header"] = _short(False), _short(True)
_RANKED = "SELECT CAST(row_number() OVER (ORDER BY c_custkey) AS BIGINT) AS row, CAST(c_custkey AS BIGINT) % 3 AS k FROM customer"
_BAD_C = f"SELECT {oracle.error_row('row', '2', 2, 'schema', 'c')} FROM src WHERE k = 2"
SQL["short_row_with_header"] = f"WITH src AS ({_RANKED}) {_BAD_C}"
SQL["short_row_headerless"] = f"WITH src AS ({_RANKED}) {_BAD_C} UNION ALL SELECT {oracle.error_row('row', '1', 1, 'schema', 'b')} FROM src WHERE k = 0"


def duplicate_header_last_wins(spark, sf_dir):
    df = read(spark, sf_dir, "nation").selectExpr("CAST(n_nationkey + 1 AS BIGINT) AS row", "CAST(n_nationkey AS STRING) || ',' || n_name || ',' || n_regionkey AS line")
    schema = schema_of([{"name": "id", "type": "int"}, {"name": "v", "type": "string"}])
    return Validator(schema).file(spark, lines_file(spark, df, "id,v,id")).normalized()


QUERIES["duplicate_header_last_wins"] = duplicate_header_last_wins
SQL["duplicate_header_last_wins"] = "SELECT CAST(n_nationkey + 1 AS BIGINT) AS row, n_regionkey::VARCHAR AS id, n_name AS v FROM nation"

# --- delimited files --------------------------------------------------------------------------------


def csv_roundtrip_documents(spark, sf_dir):
    """Writes documents as delimited lines, with line ends, quotes and multi-byte text within cells, and reads them by the exact source."""
    docs = read(spark, sf_dir, "documents")
    schema = schema_of([{"name": "doc_id", "type": "int"}, {"name": "text", "type": "string"}, {"name": "lang", "type": "string"}], hasHeaders=False)
    cells = [F.col("doc_id").cast("string"), F.col("text"), F.col("lang")]
    folder = f"{shared_dir(spark)}/lines-{uuid.uuid4().hex}"
    delimited.write_lines(docs.select(delimited.rendered(cells).alias("line")), folder)
    out = FileResults(Validator(schema), spark, delimited.list_files(folder)).normalized()
    return out.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")


QUERIES["csv_roundtrip_documents"] = csv_roundtrip_documents
SQL["csv_roundtrip_documents"] = f"SELECT doc_id, {oracle.trim('text')} AS text, lang FROM documents"

_PIPE = schema_of([{"name": "k", "type": "int"}, {"name": "p", "type": "decimal"}, {"name": "s", "type": "string"}], delimiter="|")
_PIPE_LINE = "CAST(o_orderkey AS STRING) || '|' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS STRING) || '|' || CASE WHEN o_orderkey % 3 = 0 THEN '\"a|b\"\"c\"' ELSE o_orderpriority || ',x' END"


def _piped(splittable: bool):
    def query(spark, sf_dir):
        text = _PIPE_LINE if not splittable else _PIPE_LINE.replace("'\"a|b\"\"c\"'", "'a b'")
        df = read(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey + 1 AS BIGINT) AS row", f"{text} AS line")
        return Validator(_PIPE).file(spark, lines_file(spark, df, "k|p|s"), splittable).normalized()

    return query


_PIPE_SQL = "SELECT CAST(row_number() OVER (ORDER BY o_orderkey) AS BIGINT) AS row, o_orderkey::VARCHAR AS k, CAST(o_totalprice AS DECIMAL(18,2))::VARCHAR AS p, CASE WHEN o_orderkey % 3 = 0 THEN '{}' ELSE o_orderpriority || ',x' END AS s FROM orders"
QUERIES["csv_custom_delimiter"], SQL["csv_custom_delimiter"] = _piped(False), _PIPE_SQL.format('a|b"c')
QUERIES["csv_splittable_tier"], SQL["csv_splittable_tier"] = _piped(True), _PIPE_SQL.format("a b")


def csv_mixed_terminators(spark, sf_dir):
    df = read(spark, sf_dir, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS row", "CAST(r_regionkey AS STRING) || ',' || r_name || CASE r_regionkey % 3 WHEN 0 THEN chr(13) WHEN 1 THEN chr(13) || chr(13) || chr(10) ELSE '' END AS line")
    return Validator(schema_of([{"name": "k", "type": "int"}, {"name": "n", "type": "string"}])).file(spark, lines_file(spark, df, "k,n\r")).normalized()


def csv_bom_header(spark, sf_dir):
    df = read(spark, sf_dir, "region").selectExpr("CAST(r_regionkey + 1 AS BIGINT) AS row", "r_name || ',' || CAST(r_regionkey AS STRING) AS line")
    return Validator(schema_of([{"name": "k", "type": "int"}, {"name": "n", "type": "string"}])).file(spark, lines_file(spark, df, "\ufeff n , k ")).normalized()


QUERIES["csv_mixed_terminators"], QUERIES["csv_bom_header"] = csv_mixed_terminators, csv_bom_header
SQL["csv_mixed_terminators"] = SQL["csv_bom_header"] = "SELECT CAST(row_number() OVER (ORDER BY r_regionkey) AS BIGINT) AS row, r_regionkey::VARCHAR AS k, r_name AS n FROM region"


def utf8_invalid_cells(spark, sf_dir):
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()  # the fixed table of nations
    data = b"k,n\n" + b"".join(b"%d,%s\n" % (r[0], b"\xff\xfe" if r[0] % 5 == 0 else r[1].encode()) for r in rows)
    schema = schema_of([{"name": "k", "type": "int"}, {"name": "n", "type": "string", "allowed": ["X"]}])
    return Validator(schema).file(spark, bytes_file(spark, data)).errors().select(*OUT)


QUERIES["utf8_invalid_cells"] = utf8_invalid_cells
SQL["utf8_invalid_cells"] = f"WITH src AS (SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS row, CASE WHEN n_nationkey % 5 = 0 THEN 5 ELSE 4 END AS code FROM nation) SELECT {oracle.error_row('row', 'code', 1, 'schema', 'n')} FROM src"


# --- bytes: what text cannot hold, and how files end --------------------------------------------------


def _nation_file(spark, sf_dir, header: bytes, line, last: bytes = b"\n") -> str:
    """The fixed table of nations in key order as a file: line(key, name) are a record's bytes, without a line end after the last if last is empty."""
    rows = read(spark, sf_dir, "nation").select("n_nationkey", "n_name").orderBy("n_nationkey").collect()
    return bytes_file(spark, header + b"\n".join(line(r[0], r[1].encode()) for r in rows) + last)


_KN = [{"name": "k", "type": "int"}, {"name": "n", "type": "string"}]
_NATION_ROWS = "SELECT CAST(row_number() OVER (ORDER BY n_nationkey) AS BIGINT) AS row, n_nationkey AS key, n_name AS name FROM nation"
QUERIES["csv_no_final_line_end"] = lambda spark, sf_dir: Validator(schema_of(_KN)).file(spark, _nation_file(spark, sf_dir, b"k,n\n", lambda k, n: b'%d,"%s"' % (k, n), b"")).normalized()
SQL["csv_no_final_line_end"] = f"SELECT row, key::VARCHAR AS k, name AS n FROM ({_NATION_ROWS})"
QUERIES["duplicate_schema_name"] = lambda spark, sf_dir: Validator(schema_of([*_KN, {"name": "k", "type": "int"}])).file(spark, _nation_file(spark, sf_dir, b"k,n\n", lambda k, n: b"%d,%s" % (k, n))).normalized()
SQL["duplicate_schema_name"] = f"SELECT row, key::VARCHAR AS k, name AS n, '' AS k_2 FROM ({_NATION_ROWS})"
QUERIES["header_not_utf8"] = lambda spark, sf_dir: Validator(schema_of([*_KN, {"name": "m", "type": "int", "required": True}])).file(spark, _nation_file(spark, sf_dir, b"k,\xff,n\n", lambda k, n: b"%d,x,%s" % (k, n) if k % 2 else b"y,x,%s" % n)).errors().select(*OUT)
SQL["header_not_utf8"] = (
    f"WITH src AS ({_NATION_ROWS}) SELECT {oracle.error_row('0', '5', 0, 'schema', 'k')} UNION ALL SELECT {oracle.error_row('0', '6', 2, 'schema', 'm')} "
    f"UNION ALL SELECT {oracle.error_row('row', '2', 0, 'schema', 'k')} FROM src WHERE key % 2 = 0"
)
QUERIES["empty_file"] = lambda spark, sf_dir: Validator(schema_of([{"name": "k", "type": "int", "required": True}])).file(spark, bytes_file(spark, b"")).progress()
SQL["empty_file"] = 'SELECT 0::BIGINT AS "rowsProcessed", 0::BIGINT AS "errorsAdded", true AS done'
QUERIES["normalize_not_utf8"] = lambda spark, sf_dir: Validator(schema_of(_KN)).file(spark, _nation_file(spark, sf_dir, b"k,n\n", lambda k, n: b"%d,%s" % (k, b"\xc3" + n if k % 3 == 0 else n))).normalized()
SQL["normalize_not_utf8"] = f"SELECT row, key::VARCHAR AS k, CASE WHEN key % 3 = 0 THEN '' ELSE name END AS n FROM ({_NATION_ROWS})"
QUERIES["normalize_absent_cell"] = lambda spark, sf_dir: Validator(schema_of(_KN, hasHeaders=False)).file(spark, _nation_file(spark, sf_dir, b"", lambda k, n: b"%d,%s" % (k, n) if k % 2 else b"%d" % k)).normalized()
SQL["normalize_absent_cell"] = f"SELECT row, key::VARCHAR AS k, CASE WHEN key % 2 = 0 THEN '' ELSE name END AS n FROM ({_NATION_ROWS})"


def folder_progress(spark, sf_dir):
    """Three files of a folder, one of them without a column that is required: counts of each."""
    base = f"{shared_dir(spark)}/folder-{uuid.uuid4().hex}"
    fs, inner = filesystem(base)
    fs.create_dir(inner, recursive=True)
    rows = [r[0] for r in read(spark, sf_dir, "nation").select("n_name").orderBy("n_nationkey").collect()]
    for i in range(3):
        with fs.open_output_stream(f"{inner}/f{i}.csv", compression=None) as out:
            out.write(("n\n" if i else "other\n").encode() + "".join(x + "\n" for x in rows[i::3]).encode())
    found = Validator(schema_of([{"name": "n", "type": "string", "required": True, "allowed": ["FRANCE", "CHINA"]}])).files(spark, base).progress()
    return found.select(F.substring_index("file", "/", -1).alias("file"), "rowsProcessed", "errorsAdded", "done")


QUERIES["folder_progress"] = folder_progress
SQL["folder_progress"] = """SELECT 'f' || (rn % 3) || '.csv' AS file, count(*) AS "rowsProcessed", CAST(CASE WHEN rn % 3 = 0 THEN 1 ELSE count_if(n_name NOT IN ('FRANCE', 'CHINA')) END AS BIGINT) AS "errorsAdded", true AS done
 FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) - 1 AS rn FROM nation) GROUP BY rn % 3"""


def normalized_lines(spark, sf_dir):
    return ORDERS.result(spark, sf_dir, ORDERS_SCHEMA).lines()


QUERIES["normalized_lines"] = normalized_lines
SQL["normalized_lines"] = f"WITH src AS ({ORDERS.sql()}) SELECT row, {' || chr(44) || '.join(_N.values())} AS line FROM src"


def stream_validate_events(spark, sf_dir):
    """Events as files of a folder, validated by the streaming query with all files available; counts by code."""
    from ..streaming.folder import validate_stream

    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    cells = [F.col("event_id").cast("string"), F.col("event_type"), F.when(F.col("event_id") % 9 == 0, "x").otherwise(F.col("value").cast("decimal(18,2)").cast("string"))]
    delimited.write_lines(read(spark, sf_dir, "events").repartition(3).select(delimited.rendered(cells).alias("line")), f"{base}/in")
    schema = schema_of([{"name": "event_id", "type": "int"}, {"name": "event_type", "type": "string", "allowed": ["click", "view"]}, {"name": "value", "type": "decimal"}], hasHeaders=False)
    validate_stream(spark, schema, f"{base}/in", f"{base}/errors", f"{base}/normalized", f"{base}/checkpoint", available_now=True).awaitTermination()
    return spark.read.parquet(f"{base}/errors").groupBy("columnName", "codeString").agg(F.count("*").alias("n"))


QUERIES["stream_validate_events"] = stream_validate_events
SQL["stream_validate_events"] = "SELECT 'event_type' AS \"columnName\", 'NotAllowed' AS \"codeString\", count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view') HAVING count(*) > 0 UNION ALL SELECT 'value', 'InvalidType', count(*) FROM events WHERE event_id % 9 = 0 HAVING count(*) > 0"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
