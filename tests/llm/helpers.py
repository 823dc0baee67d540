"""Small tables with all that operators must bear: nulls, empty and long texts, ties, repeated rows, clashing names."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def words(n: int, seed: int) -> str:
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7))) for _ in range(n))


def edited(text: str, edits: int, seed: int) -> str:
    r, w = random.Random(seed), text.split(" ")
    for _ in range(edits):
        w[r.randrange(len(w))] = "changed%d" % r.randrange(10**6)
    return " ".join(w)


def rows():
    base = [words(120, i) for i in range(8)]
    line = "A Line That Stands In Many Documents, Over And Over Again"
    out = [(1, None, "en", None, None), (2, "", "en", "s", 0), (3, base[0], "en", "s", 1), (4, base[0], "de", "t", 1), (5, edited(base[0], 8, 1), None, "s", 1), (6, base[1], "en", "s", 1), (None, base[2], "en", "s", 1), (None, base[2], "en", "s", 1)]
    out += [(20 + i, f"{line}\n{base[i % 8]}\n  {line.upper()} \n" + words(3, 100 + i), "en", f"s{i % 3}", 5) for i in range(7)]
    out += [(40, words(40_000, 7), "en", "s", 1), (41, "\x00 é   \x1c <|endoftext|> 中文!", "zh", "s", 1), (6, base[1], "en", "s", 1), (50, "  \t\n", "en", "s", 1), (51, "!!! ???", "en", "s", 1), (52, "!!! ???", "en", "s", 1)]
    return out


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def clashing(spark):
    """With extra columns named like what operators add inside."""
    from pyspark.sql import functions as F

    names = ("_row", "_text", "_id", "_key", "_nth", "doc", "text_key", "keep", "h", "class", "_slot", "_place", "_source", "n_words", "score", "ids", "html", "words", "a.b")
    return documents(spark).withColumns({n: F.lit(n) for n in names if n != "a.b"}).withColumn("a.b", F.lit(1))


def save(df, tmp_path, name="documents"):
    df.write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


def empty(spark, tmp_path, name="documents", schema=SCHEMA):
    return save(spark.createDataFrame([], schema), tmp_path, name)


def same(df, con_sql, tables):
    """Whether a frame has the rows of DuckDB SQL over folders of Parquet."""
    import duckdb

    con = duckdb.connect()
    for n, p in tables.items():
        con.execute(f"CREATE VIEW {n} AS SELECT * FROM read_parquet('{p}/{n}.parquet/*.parquet')")
    result = con.execute(con_sql)
    names, columns = [x[0] for x in result.description], sorted(df.columns)
    assert sorted(names) == columns
    key = lambda t: tuple((x is None, str(type(x)), x if x is not None else 0) for x in t)
    assert sorted((tuple(r[c] for c in columns) for r in df.collect()), key=key) == sorted((tuple(r[names.index(c)] for c in columns) for r in result.fetchall()), key=key)
