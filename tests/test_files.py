"""Whole files: input bytes, expected errors and normalised lines."""

import pytest

from marlspike.plans.validator import Validator, create_validator

DEMO = {"hasHeaders": True, "columns": [
    {"name": "id", "type": "int", "required": True}, {"name": "amount", "type": "decimal", "required": True, "precision": 2},
    {"name": "date", "type": "date", "required": True, "dateFormat": "ymd-dash"}, {"name": "status", "type": "string", "required": True, "allowed": ["OPEN", "CLOSED"]},
    {"name": "note", "type": "string", "maxLen": 200}]}
OPTIONAL = {"hasHeaders": True, "columns": [{"name": "k", "type": "string"}, {"name": "i", "type": "int"}, {"name": "d", "type": "decimal"}, {"name": "t", "type": "date"}, {"name": "a", "type": "string", "allowed": ["X"]}, {"name": "e", "type": "string", "allowed": ["", "X"]}]}
POSITIONAL = {"hasHeaders": False, "failOnExtraColumns": True, "columns": [{"name": "a", "type": "int", "required": True}, {"name": "b", "type": "string", "required": True}, {"name": "c", "type": "int"}]}
EXTRA = {"hasHeaders": True, "failOnExtraColumns": True, "columns": [{"name": "id", "type": "int", "required": True}]}
LENGTHS = {"hasHeaders": False, "delimiter": ";", "columns": [{"name": "s", "type": "string", "maxLen": 3}, {"name": "n", "type": "int", "required": True, "maxLen": 2}]}
TWICE = {"hasHeaders": True, "columns": [{"name": "id", "type": "int"}, {"name": "v", "type": "string"}]}
F1 = b'id,amount,date,status,note\n1,10.5,2024-01-05,OPEN,hello\n 2 , 3.14159 ,2024-2-9,CLOSED,"a, b"\nx,abc,2024-02-30,open,\n,1,2024-01-01,OPEN,ok\n5,"1,000.00",2024-01-01,OPEN,"say ""hi"""\n'
F1_ERRORS = [(3, 2, 0, "schema", "id"), (3, 2, 1, "schema", "amount"), (3, 2, 2, "schema", "date"), (3, 4, 3, "schema", "status"), (4, 1, 0, "schema", "id"), (5, 2, 1, "schema", "amount")]
F1_LINES = ["1,10.50,2024-01-05,OPEN,hello", '2,3.14,2024-02-09,CLOSED,"a, b"', "x,,,open,", ",1.00,2024-01-01,OPEN,ok", '5,,2024-01-01,OPEN,"say ""hi"""']

CASES = {
    "demo": (DEMO, F1, F1_ERRORS, F1_LINES),
    "missing_header": (DEMO, b"id,amount,note\n1,2,n\n", [(0, 6, 2, "schema", "date"), (0, 6, 3, "schema", "status")], ["1,2.00,,,n"]),
    "reorder_bom": (DEMO, b"\xef\xbb\xbf status , note,id,date,amount\r\nOPEN,n1,7,2024-03-01,-1.005\r\nCLOSED,,8,2024-12-31,.5", [], ["7,-1.01,2024-03-01,OPEN,n1", "8,0.50,2024-12-31,CLOSED,"]),
    "short_with_header": (DEMO, b"id,amount,date,status,note\n1,2\n", [], ["1,2.00,,,"]),
    "optional_empty": (OPTIONAL, b"k,i,d,t,a,e\nr,,,,,\n", [(1, 2, 1, "schema", "i"), (1, 2, 2, "schema", "d"), (1, 2, 3, "schema", "t"), (1, 4, 4, "schema", "a")], ["r,,,,,"]),
    "headerless": (POSITIONAL, b"1\n1,x\n1,x,3\n1,x,3,z\n", [(1, 1, 1, "schema", "b"), (4, 7, 3, "input", None)], ["1,,", "1,x,", "1,x,3", "1,x,3"]),
    "extra": (EXTRA, b"id,zzz\n1,9\n2,9,8\n", [(1, 7, 1, "input", "zzz"), (2, 7, 1, "input", "zzz"), (2, 7, 2, "input", None)], ["1", "2"]),
    "lengths": (LENGTHS, b'abc;12\n\xc3\xa9\xc3\xa9;1\nabcd;xyz\n"a;b"; \n\x0bx\x0b;1\n', [(2, 3, 0, "schema", "s"), (3, 3, 0, "schema", "s"), (3, 3, 1, "schema", "n"), (4, 1, 1, "schema", "n")], ["abc;12", "éé;1", "abcd;xyz", '"a;b";', "\x0bx\x0b;1"]),
    "not_utf8": (DEMO, b"id,amount,date,status,note\n1,1,2024-01-01,OPEN,\xff\xfe\n2,\xff,2024-01-01,\xff,ok\n", [(1, 5, 4, "schema", "note"), (2, 5, 1, "schema", "amount"), (2, 5, 3, "schema", "status")], ["1,1.00,2024-01-01,OPEN,", "2,,2024-01-01,,ok"]),
    "duplicate_header": (TWICE, b"id,v,id\n1,a,x\n2,b,3\n", [(1, 2, 0, "schema", "id")], ["x,a", "3,b"]),
    "line_ends": (TWICE, b'id,v\n1,"l1\nl2"\r\n\n   \r4,"abc"def\n', [(2, 2, 0, "schema", "id")], ['1,"l1\nl2"', ",", "4,abcdef"]),
    "header_not_utf8": (TWICE, b"id,\xff,v\n1,q,w\n", [(0, 5, 0, "schema", "id")], ["1,w"]),
    "empty": (DEMO, b"", [], []),
    "extra_allowed": (POSITIONAL | {"failOnExtraColumns": False}, b"1,x,3,z\n", [], ["1,x,3"]),
    "no_columns": ({"hasHeaders": True}, b"a\n1\n", [], []),
}


def put(tmp_path, data):
    path = tmp_path / "input.csv"
    path.write_bytes(data)
    return str(path)


@pytest.mark.parametrize("name", CASES)
def test_file(spark, tmp_path, name):
    schema, data, errors, lines = CASES[name]
    result = Validator(schema).file(spark, put(tmp_path, data))
    got = [(r.row, r.code, r.colIndex, r.colKind, r.columnName) for r in result.errors().orderBy("row", "seq").collect()]
    assert got == errors
    assert [r.line for r in result.lines().orderBy("row").collect()] == lines


def test_messages_cap_progress_and_packing(spark, tmp_path):
    result = Validator(DEMO).file(spark, put(tmp_path, F1))
    assert result.errors().orderBy("row", "seq").first().message == 'Row 3, column "id": invalid type'
    for k in (0, 2, 3):
        got = result.errors(k).orderBy("row", "seq").collect()
        assert [(r.row, r.code, r.colIndex, r.colKind, r.columnName) for r in got] == F1_ERRORS[:k]
    assert tuple(result.progress().first()) == (5, 6, True)
    assert sorted(map(tuple, result.packed_errors().collect()))[2] == (3, 2 << 8 | 2)
    assert result.input_columns == result.schema_columns == ["id", "amount", "date", "status", "note"]
    header = Validator(EXTRA).file(spark, put(tmp_path, b"zzz\n1\n"))
    assert [(r.message, r.codeString) for r in header.errors().orderBy("row", "seq").collect()] == [('Header, column "id": missing required column', "MissingRequiredColumn"), ('Row 1, column "zzz": extra column not allowed', "ExtraColumn")]
    assert tuple(Validator(EXTRA).file(spark, put(tmp_path, b"id,b,c,d\n,,,7\n")).packed_errors().orderBy("w0", "w1").collect()[-1]) == (1, 1 << 31 | 3 << 8 | 7)


def test_client_events(spark, tmp_path):
    seen = []
    client = create_validator(spark, DEMO, emit_normalized=True, batch=4, **{f"on_{e}": (lambda *x, e=e: seen.append((e, *x))) for e in ("ready", "progress", "errors", "normalized", "done", "fatal")})
    client.validate(put(tmp_path, F1))
    assert [x[0] for x in seen] == ["ready", "progress", "errors", "errors", "normalized", "normalized", "done"]
    assert "".join(x[1] for x in seen if x[0] == "normalized") == "".join(x + "\n" for x in F1_LINES)
    client.validate(str(tmp_path / "none.csv"))
    assert seen[-1][0] == "fatal"
    client.terminate()


def test_splittable_equals_exact(spark, tmp_path):
    data = b"id,v\n" + b"".join(b"%d,w%d\r\n" % (i, i) for i in range(500)) + b"\n\nx,y,z"
    path = put(tmp_path, data)
    for size in ("128m", "700b"):  # one split, and many
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        a, b = (Validator(TWICE).file(spark, path, splittable=s) for s in (False, True))
        assert a.lines().orderBy("row").collect() == b.lines().orderBy("row").collect()
        assert a.errors().collect() == b.errors().collect()
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")
    with pytest.raises(Exception, match="exact source"):
        Validator(TWICE).file(spark, put(tmp_path, F1), splittable=True).lines().collect()


def test_folder_and_stream(spark, tmp_path):
    from marlspike.streaming.folder import validate_stream

    folder = tmp_path / "in"
    folder.mkdir()
    for i in range(3):
        (folder / f"f{i}.csv").write_bytes(F1 if i else b"id,amount\n1,2\n")
    found = Validator(DEMO).files(spark, str(folder))
    assert found.rows().count() == 11 and found.errors().count() == 2 * 6 + 2
    first = found.errors(3).orderBy("file", "row", "seq").collect()
    assert [(r.file[-6:], r.row, r.code) for r in first] == [("f0.csv", 0, 6), ("f0.csv", 0, 6), ("f1.csv", 3, 2)] and found.errors(0).count() == 0
    assert {(r.file[-6:], r.rowsProcessed, r.errorsAdded) for r in found.progress().collect()} == {("f0.csv", 1, 2), ("f1.csv", 5, 6), ("f2.csv", 5, 6)}
    assert found.packed_errors().where("w0 = 0").count() == 2 and found.lines().where("file LIKE '%f1.csv'").count() == 5
    assert found.typed().select("amount").schema[0].dataType.simpleString() == "decimal(38,2)"
    query = validate_stream(spark, DEMO, str(folder), str(tmp_path / "e"), str(tmp_path / "n"), str(tmp_path / "c"), available_now=True)
    query.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "e")).count() == 14 and spark.read.parquet(str(tmp_path / "n")).count() == 11


def test_written_lines_read_back(spark, tmp_path):
    schema = {"hasHeaders": False, "columns": [{"name": "a", "type": "string"}, {"name": "b", "type": "string"}]}
    rows = [(1, 'q"uo,te', "l1\nl2"), (2, "", "#c"), (3, "\r", "é"), (4, None, "x")]
    df = spark.createDataFrame(rows, "row long, a string, b string")
    Validator(schema).table(df, "row", [df.a, df.b]).write_normalized(str(tmp_path / "out"), one_file=True)
    back = Validator(schema).files(spark, str(tmp_path / "out")).normalized().orderBy("row").collect()
    assert [(r.a, r.b) for r in back] == [('q"uo,te', "l1\nl2"), ("", "#c"), ("", "é"), ("", "x")]


def test_folder_without_files(spark, tmp_path):
    found = Validator(DEMO).files(spark, str(tmp_path))
    for frame in (found.errors(), found.errors(5), found.packed_errors(), found.normalized(), found.typed(), found.lines(), found.rows(), found.progress()):
        assert frame.count() == 0 and "file" in frame.columns


def test_batches_of_large_records_and_odd_names(spark, tmp_path, monkeypatch):
    from marlspike.sources import delimited

    monkeypatch.setattr(delimited, "BATCH_BYTES", 100)
    folder = tmp_path / "a\nb"
    folder.mkdir()
    (folder / "input.csv").write_bytes(b"id,v\n" + b"".join(b"%d,%s\n" % (i, b"x" * i) for i in range(60)))
    parts = list(delimited.Reader({"files": f'["{tmp_path}/a\\nb/input.csv"]', "skip": "1"}).read(delimited.File(f"{tmp_path}/a\nb/input.csv")))
    assert len(parts) > 10 and sum(p.num_rows for p in parts) == 60
    assert Validator(TWICE).files(spark, str(folder)).rows().agg({"row": "max"}).first()[0] == 60


def test_client_validates_tables(spark):
    seen = []
    df = spark.createDataFrame([(1, "1", "x"), (2, "b", "y")], "n long, id string, v string")
    result = create_validator(spark, TWICE, on_errors=seen.append, on_done=lambda: seen.append("done")).validate(df, row="n")
    assert [e["row"] for e in seen[0]] == [2] and seen[1] == "done" and result.input_columns == ["id", "v"]
