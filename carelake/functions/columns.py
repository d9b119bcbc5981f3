"""Column expressions: parsing, unit conversion, rounding and formatting. All run in the JVM."""

from __future__ import annotations

import string
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Unicode white-space characters, as characters and as a regex class.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
WS_CLASS = (
    r"[\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)
NUMBER = r"[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind ``value`` once and use it many times in ``body``."""
    return F.get(F.transform(F.array(value), body), 0)


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITESPACE))


def finite(c: Column) -> Column:
    """A number, or null where it is NaN or infinite."""
    x = c.cast("double")
    return F.when(~F.isnan(x) & (F.abs(x) != float("inf")), c)


def absent(c: Column) -> Column:
    """Null, NaN or infinite; text that is no number is present."""
    x = c.try_cast("double")
    return c.isNull() | F.coalesce(F.isnan(x) | (F.abs(x) == float("inf")), F.lit(False))


def to_number(c: Column) -> Column:
    """Text to double; anything that is not a plain number becomes null."""
    text = strip(c.cast("string"))
    return F.when(text.rlike(f"^{NUMBER}$"), text.cast("double"))


def parse_locale_number(c: Column, default: float | None = 0.0) -> Column:
    """First comma read as a decimal point, then the longest numeric prefix."""
    text = F.regexp_replace(strip(c), "^([^,]*),", "$1.")
    parsed = F.regexp_extract(text, f"^({NUMBER})", 1).try_cast("double")
    return parsed if default is None else F.coalesce(parsed, F.lit(float(default)))


def fahrenheit_to_celsius(c: Column) -> Column:
    """Two decimals, half to even."""
    return F.rint((c - 32) * 5 / 9 * 100) / 100


def celsius(c: Column, above: float) -> Column:
    """Convert only readings above the limit, which must be Fahrenheit."""
    return F.when(c > above, fahrenheit_to_celsius(c)).otherwise(c)


def tenths(c: Column, ties: str = "even") -> Column:
    """A non-negative double rounded to whole tenths by its exact binary value.

    ``e`` is 20x - (2n+1) without rounding error: 16x - (2n+1) and 4x are both exact.
    """
    x = c.cast("double")
    n = F.floor(x * 10)
    e = (x * 16 - (2 * n + 1)) + x * 4
    tie_up = F.lit(True) if ties == "up" else n % 2 == 1
    return n + F.when((e > 0) | ((e == 0) & tie_up), 1).otherwise(0)


def format_fixed(c: Column, digits: int) -> Column:
    """Fixed-point text of a non-negative number, ties to even, 0 or 1 decimals."""
    if digits == 0:
        return F.rint(c.cast("double")).cast("bigint").cast("string")
    if digits == 1:
        n = tenths(c).cast("bigint")
        return F.concat(F.floor(n / 10).cast("string"), F.lit("."), (n % 10).cast("string"))
    raise ValueError("only 0 or 1 decimals are used")


def render(template: str, values: Mapping[str, Column]) -> Column:
    """A ``str.format`` template as a concatenation of literals and formatted columns."""
    parts = []
    for literal, field, spec, _ in string.Formatter().parse(template):
        if literal:
            parts.append(F.lit(literal))
        if field is None:
            continue
        value = values[field]
        if spec in (".0f", ".1f"):
            value = format_fixed(value, int(spec[1]))
        elif spec == "d":
            value = value.cast("bigint").cast("string")
        parts.append(value)
    return F.concat(*parts)


def body_mass_index(weight_kg: Column, height_cm: Column) -> Column:
    """One decimal, ties up; 0 when either input is missing or not positive."""
    metres = height_cm.cast("double") / 100
    value = tenths(weight_kg.cast("double") / (metres * metres), ties="up") / 10
    return F.when((height_cm > 0) & (weight_kg > 0), value).otherwise(F.lit(0.0))


def code_map(c: Column, codes: Mapping[str, int]) -> Column:
    """Text to number; values that are not listed become null."""
    chain = F.lit(None).cast("int")
    for text, code in codes.items():
        chain = F.when(c == text, F.lit(code)).otherwise(chain)
    return chain


def first_integer(c: Column) -> Column:
    return F.regexp_extract(c, r"(\d+)", 1).try_cast("bigint")


def split_pair(c: Column, sep: str = "/") -> tuple[Column, Column]:
    parts = F.split(c, sep)
    return F.get(parts, 0).try_cast("int"), F.get(parts, 1).try_cast("int")


def feet_to_cm(c: Column, cm_per_foot: float) -> Column:
    """Feet with a trailing double apostrophe to whole centimetres, half to even."""
    return F.rint(to_number(F.replace(c, F.lit("''"), F.lit(""))) * cm_per_foot).cast("int")


def classify(c: Column, bands: Sequence[tuple[str, float, float]], otherwise: str) -> Column:
    """First half-open band that holds the value."""
    chain = None
    for name, lo, hi in bands:
        inside = c >= F.lit(float(lo))
        if hi != float("inf"):
            inside = inside & (c < F.lit(float(hi)))
        chain = F.when(inside, name) if chain is None else chain.when(inside, name)
    return chain.otherwise(otherwise)


def gauge_percent(c: Column, lo: float, hi: float) -> Column:
    return F.least(F.lit(100.0), F.greatest(F.lit(0.0), (c - F.lit(float(lo))) / F.lit(float(hi - lo)) * 100))
