"""Column functions over the text of one cell. NULL is an absent cell, '' an empty one; all keep NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schema import DEFAULT_SCALE, MOST_SCALE

#: What trimming strips at both ends; not the vertical tab, nor any blank beyond ASCII.
TRIMMED = " \t\n\x0c\r"
#: The largest magnitude of a decimal, all its digits taken as one integer: 2^96 - 1.
MOST_DIGITS = "79228162514264337593543950335"
DECIMAL = r"\A[+-]?(?:[0-9][0-9_]*\.?[0-9_]*|\.[0-9][0-9_]*)\z"
#: Decimals of 28 digits at most, without underscores: they break no limit of digits. What most cells hold.
SHORT_DECIMAL = r"\A[+-]?(?=[0-9.]{1,28}\z)(?:[0-9]+\.?[0-9]*|\.[0-9]+)\z"
#: The most fraction digits of which Spark's own decimals of 38 digits keep any SHORT_DECIMAL, in plain notation.
MOST_CAST = 6
#: Date formats: separator, and the places of year, month and day.
DATES = {"ymd-dash": ("-", 1, 2, 3), "dmy-slash": ("/", 3, 2, 1), "mdy-slash": ("/", 3, 1, 2)}


def bound(value: Column, f) -> Column:
    """f(value), where value is worked out once however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(TRIMMED))


def is_int(c: Column) -> Column:
    return c.rlike(r"\A[+-]?[0-9]+\z")


def _without_zeros(c: Column) -> Column:
    return F.regexp_replace(c, r"\A0+", "")


def _digits(c: Column) -> Column:
    """Digits before and after the point and all without leading zeros, of text that matches DECIMAL."""
    plain = F.replace(c, F.lit("_"), F.lit(""))
    parts = F.struct(F.regexp_extract(plain, r"\A[+-]?([0-9]*)", 1).alias("whole"), F.regexp_extract(plain, r"\.([0-9]*)\z", 1).alias("fraction"))
    return bound(parts, lambda x: F.struct(x["whole"].alias("whole"), x["fraction"].alias("fraction"), _without_zeros(F.concat(x["whole"], x["fraction"])).alias("unscaled")))


def _fits(digits: Column) -> Column:
    n = F.length(digits["unscaled"])
    return (F.length(digits["fraction"]) <= MOST_SCALE) & ((n < len(MOST_DIGITS)) | ((n == len(MOST_DIGITS)) & (digits["unscaled"] <= MOST_DIGITS)))  # of equal length, text order is number order


def is_decimal(c: Column) -> Column:
    """Text that is exactly a decimal of at most 28 fraction digits and a 96-bit magnitude. More fraction digits than a column keeps are no fault."""
    return F.when(c.isNull(), None).when(c.rlike(SHORT_DECIMAL), True).when(c.rlike(DECIMAL), bound(_digits(c), _fits)).otherwise(False)


def decimal_text(c: Column, scale: int | None) -> Column:
    """A decimal with scale fraction digits, rounded half away from zero from the source text; '' where c is none. Never a negative zero."""
    p = min(DEFAULT_SCALE if scale is None else scale, MOST_SCALE)
    out = F.when(c.isNull(), None)
    if p <= MOST_CAST:
        out = out.when(c.rlike(SHORT_DECIMAL), c.try_cast(f"decimal(38,{p})").cast("string"))
    return out.when(c.rlike(DECIMAL), bound(_digits(c), lambda x: F.when(_fits(x), _rounded(c, x, p)).otherwise(""))).otherwise("")


def _rounded(c: Column, digits: Column, p: int) -> Column:
    whole, fraction = digits["whole"], digits["fraction"]
    # in units of the last digit kept; a fraction that is cut has at most 29 digits before it, so 38 are enough
    kept = F.concat(whole, F.substring(fraction, 1, p))
    cut = (F.concat(F.lit("0"), kept).try_cast("decimal(38,0)") + F.when(F.substring(fraction, p + 1, 1) >= "5", 1).otherwise(0)).cast("decimal(38,0)").cast("string")
    units = F.when(F.length(fraction) > p, cut).otherwise(F.rpad(F.concat(whole, fraction), F.length(whole) + p, F.lit("0")))

    def text(units: Column) -> Column:
        return units if p == 0 else F.concat(F.substr(units, F.lit(1), F.length(units) - p), F.lit("."), F.substr(units, F.length(units) - p + 1))

    def signed(units: Column) -> Column:
        full = F.lpad(units, F.greatest(F.length(units), F.lit(p + 1)), F.lit("0"))
        return F.concat(F.when(c.startswith("-") & (units != ""), "-").otherwise(""), bound(full, text))

    return bound(_without_zeros(units), signed)


def _date(c: Column, date_format: str | None, f) -> Column:
    """f(year, month, day) of text that has all three as groups of digits, none with too many behind its leading zeros; NULL of other text."""
    separator, *places = DATES[date_format or "ymd-dash"]
    widths = dict(zip(places, (4, 2, 2)))
    pattern = r"\A" + separator.join(rf"0*[0-9]{{1,{widths[i]}}}" for i in (1, 2, 3)) + r"\z"
    numbers = F.transform(F.split(c, separator, -1), lambda x: x.try_cast("int"))
    return F.when(c.rlike(pattern), bound(numbers, lambda x: f(*[F.get(x, F.lit(i - 1)) for i in places])))


def _is_day(y: Column, m: Column, d: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    days = F.when(m.isin(4, 6, 9, 11), 30).when(m == 2, F.when(leap, 29).otherwise(28)).otherwise(31)
    return m.between(1, 12) & (d >= 1) & (d <= days)


def is_date(c: Column, date_format: str | None) -> Column:
    """Three groups of digits of any width that name a day of the Gregorian calendar, years 0 to 9999."""
    return F.when(c.isNull(), None).otherwise(F.coalesce(_date(c, date_format, _is_day), F.lit(False)))


def date_text(c: Column, date_format: str | None) -> Column:
    """YYYY-MM-DD; '' where c is no date."""

    def text(y: Column, m: Column, d: Column) -> Column:
        return F.when(_is_day(y, m, d), F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")))

    return F.when(c.isNull(), None).otherwise(F.coalesce(_date(c, date_format, text), F.lit("")))
