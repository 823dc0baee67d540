import json

import pytest

from marlspike.schema import SchemaError, parse_schema

C = {"name": "a", "type": "int"}


@pytest.mark.parametrize("bad", [
    "{", "[]", "{}", {"hasHeaders": 1}, {"hasHeaders": True, "columns": [{"type": "int"}]}, {"hasHeaders": True, "columns": [{"name": "a"}]},
    *({"hasHeaders": True, "columns": [{"name": "a", "type": t}]} for t in ("INT", "float", "boolean")),
    {"hasHeaders": True, "columns": [C | {"dateFormat": "ymd"}]},
    *({"hasHeaders": True, "delimiter": d} for d in ("", ";;", "é", 256, -1, 1.5, None, True, '"', "\n", 13)),
    {"hasHeaders": True, "columns": [C | {"allowed": None}]}, {"hasHeaders": True, "columns": [C | {"maxLen": -1}]}, {"hasHeaders": True, "columns": [C | {"precision": -1}]},
])
def test_rejected(bad):
    with pytest.raises(SchemaError, match="Invalid schema JSON: "):
        parse_schema(bad)


def test_accepted_and_defaults():
    s = parse_schema('{"hasHeaders": false}')
    assert (s.has_headers, s.delimiter, s.columns, s.fail_on_extra_columns) == (False, b",", (), False)
    for d, want in ((";", b";"), (59, b";"), ("\t", b"\t"), (0xA6, b"\xa6")):
        assert parse_schema({"hasHeaders": True, "delimiter": d}).delimiter == want
    s = parse_schema(json.dumps({"hasHeaders": True, "other": 1, "columns": [C | {"maxLen": None, "more": []}]}))
    assert s.columns[0].max_len is None and s.columns[0].allowed == () and s.names == ["a"]
