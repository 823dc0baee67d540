from decimal import ROUND_HALF_UP, Decimal

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from marlspike.functions import cells

DECIMALS = {
    "1": ("1.00", "1"), "1.235": ("1.24", "1"), "-1.235": ("-1.24", "-1"), "1.005": ("1.01", "1"), "2.675": ("2.68", "3"), "0.004": ("0.00", "0"), "0.005": ("0.01", "0"), "-0.001": ("0.00", "0"), ".5": ("0.50", "1"),
    "5.": ("5.00", "5"), "+5": ("5.00", "5"), "007": ("7.00", "7"), "1_000": ("1000.00", "1000"), "79228162514264337593543950335": ("79228162514264337593543950335.00", "79228162514264337593543950335"),
    "0.0000000000000000000000000001": ("0.00", "0"), "0.5": ("0.50", "1"), "-0.5": ("-0.50", "-1"), "0": ("0.00", "0"), "-0": ("0.00", "0"), "9.995": ("10.00", "10"),
} | dict.fromkeys(["1e3", "1,000", ".", "", "-", "$5", "1.2.3", "79228162514264337593543950336", "0.00000000000000000000000000001", "_1", "1\n"], ("", ""))
DATES = {
    "2024-01-05": ("2024-01-05", "", ""), "2024-2-9": ("2024-02-09", "", ""), "24-1-5": ("0024-01-05", "", ""), "2024-02-29": ("2024-02-29", "", ""), "2000-02-29": ("2000-02-29", "", ""), "0-1-1": ("0000-01-01", "", ""),
    "0002024-001-05": ("2024-01-05", "", ""), "31/12/2024": ("", "2024-12-31", ""), "12/31/2024": ("", "", "2024-12-31"), "5/6/2024": ("", "2024-06-05", "2024-05-06"), "5/6/24": ("", "0024-06-05", "0024-05-06"),
} | dict.fromkeys(["2023-02-29", "1900-02-29", "2024-13-01", "2024-00-10", "2024-01-32", "2024-04-31", "2024-01-05-", "2024-01", "2024--01", "+2024-01-01", "2024-01-05T00", "10000-01-01", "99999999999-01-01", "29/2/2023", ""], ("", "", ""))


def test_decimals(spark):
    df = spark.createDataFrame([(k,) for k in DECIMALS], "v string")
    got = {r[0]: r[1:] for r in df.select("v", cells.decimal_text(F.col("v"), 2), cells.decimal_text(F.col("v"), 0), cells.is_decimal(F.col("v"))).collect()}
    assert {k: v[:2] for k, v in got.items()} == DECIMALS
    assert {k: v[2] for k, v in got.items()} == {k: v[0] != "" for k, v in DECIMALS.items()}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "v string")
    kinds = ("ymd-dash", "dmy-slash", "mdy-slash")
    got = {r[0]: tuple(r[1:4]) for r in df.select("v", *[cells.date_text(F.col("v"), k) for k in kinds]).collect()}
    assert got == DATES


def test_ints_and_trim(spark):
    good, bad = ["0", "-0", "+7", "007", "9" * 44], ["", "+", "-", "1.0", "1 2", "1_0", "+-5", "0x1", "١", "1\n"]
    df = spark.createDataFrame([(v,) for v in good + bad], "v string")
    assert [r[0] for r in df.select(cells.is_int(F.col("v"))).collect()] == [True] * len(good) + [False] * len(bad)
    df = spark.createDataFrame([(" \t\n\x0c\ra b\r",), ("\x0bx\x0b",), ("\u00a0y\u3000",), (None,)], "v string")
    assert [r[0] for r in df.select(cells.trimmed(F.col("v"))).collect()] == ["a b", "\x0bx\x0b", "\u00a0y\u3000", None]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.booleans(), st.text("0123456789", min_size=1, max_size=20), st.text("0123456789", max_size=8)), min_size=1, max_size=60), st.integers(0, 28))
def test_rounding_is_half_away_from_zero(spark, values, p):
    texts = [("-" if n else "") + a + ("." + b if b else "") for n, a, b in values]
    df = spark.createDataFrame([(v,) for v in texts], "v string")
    got = [r[0] for r in df.select(cells.decimal_text(F.col("v"), p)).collect()]
    for v, g in zip(texts, got):
        d = Decimal(v).quantize(Decimal(1).scaleb(-p), rounding=ROUND_HALF_UP, context=__import__("decimal").Context(prec=60))
        assert g == f"{abs(d) if d == 0 else d:f}"
