"""Elementwise arithmetic, comparison and predicates as Spark columns.

Each function works on scalar columns; ``lists.each`` and ``lists.pairwise`` lift it to arrays of any depth.  Integers widen
to long instead of wrapping; dividing by zero gives zero; truth is 0 or 1 as int.
"""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _c(x: Column | str | float) -> Column:
    return x if isinstance(x, Column) else F.col(x) if isinstance(x, str) else F.lit(x)


def add(*xs) -> Column:
    return reduce(lambda a, b: a + b, map(_c, xs))


def sub(a, b) -> Column:
    return _c(a) - _c(b)


def mult(*xs) -> Column:
    return reduce(lambda a, b: a * b, map(_c, xs))


def div(a, b) -> Column:
    """Quotient of floats, 0 where b is 0."""
    a, b = _c(a), _c(b)
    return F.when(b == 0, F.lit(0.0)).otherwise(a / F.when(b != 0, b))


def int_div(a, b) -> Column:
    """Quotient of ints, truncated toward zero, 0 where b is 0."""
    a, b = _c(a).cast("long"), _c(b).cast("long")
    return F.coalesce(F.call_function("div", a, F.when(b != 0, b)), F.lit(0)).cast("long")


def least(*xs) -> Column:
    return F.least(*map(_c, xs))


def greatest(*xs) -> Column:
    return F.greatest(*map(_c, xs))


def power(a, b, whole: bool = False) -> Column:
    out = F.pow(_c(a), _c(b))
    return out.cast("long") if whole else out


def atan2(a, b, whole: bool = False) -> Column:
    out = F.atan2(_c(a), _c(b))
    return out.cast("long") if whole else out


def fmod(a, b) -> Column:
    """Remainder with the sign of the dividend, 0 where b is 0."""
    a, b = _c(a), _c(b)
    return F.coalesce(a % F.when(b != 0, b), F.lit(0))


mod = fmod


def absolute(x) -> Column:
    return F.abs(_c(x))


def rounded(x) -> Column:
    """Nearest integer, halves away from zero; ints stay."""
    x = _c(x)
    return F.signum(x) * F.floor(F.abs(x) + 0.5)


def recip(x) -> Column:
    return div(F.lit(1.0), x)


def sign(x) -> Column:
    return F.signum(_c(x)).cast("int")


def negate(x) -> Column:
    return -_c(x)


def log(x) -> Column:
    """Natural logarithm; -inf at 0 and NaN below."""
    x = _c(x).cast("double")
    return F.when(x > 0, F.log(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


def log10(x) -> Column:
    x = _c(x).cast("double")
    return F.when(x > 0, F.log10(x)).when(x == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan")))


#: One-argument functions by name.
UNARY = {
    "abs": absolute, "acos": lambda x: F.acos(_c(x)), "asin": lambda x: F.asin(_c(x)), "atan": lambda x: F.atan(_c(x)), "ceil": lambda x: F.ceil(_c(x)),
    "floor": lambda x: F.floor(_c(x)), "round": rounded, "cos": lambda x: F.cos(_c(x)), "sin": lambda x: F.sin(_c(x)), "tan": lambda x: F.tan(_c(x)),
    "cosh": lambda x: F.cosh(_c(x)), "sinh": lambda x: F.sinh(_c(x)), "tanh": lambda x: F.tanh(_c(x)), "exp": lambda x: F.exp(_c(x)), "log": log, "log10": log10,
    "sqrt": lambda x: F.sqrt(_c(x)), "recip": recip, "sign": sign, "negate": negate,
}


def truth(condition: Column) -> Column:
    return F.coalesce(condition, F.lit(False)).cast("int")


def eq(a, b) -> Column:
    return truth(_c(a) == _c(b))


def noteq(a, b) -> Column:
    return truth(_c(a) != _c(b))


def lt(a, b) -> Column:
    return truth(_c(a) < _c(b))


def lte(a, b) -> Column:
    return truth(_c(a) <= _c(b))


def gt(a, b) -> Column:
    return truth(_c(a) > _c(b))


def gte(a, b) -> Column:
    """Also for strings, by code point."""
    return truth(_c(a) >= _c(b))


def both(*xs) -> Column:
    """Logical and; non-zero is true."""
    return truth(reduce(lambda a, b: a & b, [_c(x) != 0 for x in xs]))


def either(*xs) -> Column:
    return truth(reduce(lambda a, b: a | b, [_c(x) != 0 for x in xs]))


def negation(x) -> Column:
    return truth(_c(x) == 0)


def between(x, lo, hi, low: bool = False, high: bool = False) -> Column:
    """Whether x lies between lo and hi; ``low`` and ``high`` make that end inclusive."""
    x, lo, hi = _c(x), _c(lo), _c(hi)
    return truth(((x >= lo) if low else (x > lo)) & ((x <= hi) if high else (x < hi)))


def closeto(x, v, eps: float = 1e-4) -> Column:
    return truth(F.abs(_c(x) - _c(v)) < eps)


def oneof(x, values: list) -> Column:
    """Membership in a short literal list; use operators.membership for tables."""
    return truth(_c(x).isin(*values))


def where(mask, yes, no) -> Column:
    return F.when(_c(mask) != 0, _c(yes)).otherwise(_c(no))


def to_char(x) -> Column:
    """Low 8 bits, signed."""
    low = _c(x).cast("long").bitwiseAND(255)
    return F.when(low > 127, low - 256).otherwise(low).cast("short")


def to_uchar(x) -> Column:
    return _c(x).cast("long").bitwiseAND(255).cast("short")


def to_uint(x) -> Column:
    """Ints read as unsigned 32 bits."""
    return _c(x).cast("long").bitwiseAND(0xFFFFFFFF)


def to_int(x) -> Column:
    """Toward zero; text by the digits that it starts with, else 0; null and NaN give 0, what is beyond 64 bits their end."""
    x = _c(x)
    digits = F.regexp_extract(x.cast("string"), r"^\s*([+-]?\d+)", 1)
    value = F.when(F.typeof(x) == "string", digits.try_cast("double")).otherwise(x.try_cast("double"))
    whole = F.when(F.typeof(x) == "string", digits.try_cast("long")).otherwise(x.try_cast("long"))
    return F.coalesce(whole, F.when(F.isnan(value), 0).when(value > 0, F.lit(2**63 - 1)).when(value < 0, F.lit(-(2**63))), F.lit(0)).cast("long")


def to_float(x) -> Column:
    """As a double; text by the number that it starts with, else 0."""
    start = F.regexp_extract(_c(x).cast("string"), r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)", 1)
    return F.coalesce(_c(x).try_cast("double"), start.try_cast("double"), F.lit(0.0))


def to_text(x) -> Column:
    return _c(x).cast("string")


@F.pandas_udf(T.DoubleType())
def lgamma(x: pd.Series) -> pd.Series:
    """Logarithm of the gamma function."""
    return x.map(lambda v: math.lgamma(v) if v > 0 or v != math.floor(v) else math.inf)


@F.pandas_udf(T.DoubleType())
def critz(p: pd.Series) -> pd.Series:
    """Inverse normal distribution function; NaN outside (0, 1)."""
    inv = NormalDist().inv_cdf
    return p.map(lambda v: inv(v) if 0 < v < 1 else math.nan)


def dprime(hits, alarms) -> Column:
    return critz(_c(hits)) - critz(_c(alarms))


def gaussian(x, amp, mean, sd) -> Column:
    """amp * exp(-((x - mean) / sd) ** 2)."""
    return _c(amp) * F.exp(-F.pow((_c(x) - _c(mean)) / _c(sd), F.lit(2.0)))


def weibull(x, t, a, b) -> Column:
    """Rises from a half to t: t - (t - 0.5) * exp(-(x / a) ** b)."""
    return _c(t) - (_c(t) - 0.5) * F.exp(-F.pow(_c(x) / _c(a), _c(b)))


def gamma_density(x, rate, shape) -> Column:
    """rate ** shape * x ** (shape - 1) * exp(-rate * x) / gamma(shape)."""
    x, rate, shape = _c(x), _c(rate), _c(shape)
    return F.exp(shape * F.log(rate) + (shape - 1) * F.log(x) - rate * x - lgamma(shape.cast("double")))


def distance(x1, y1, x2, y2) -> Column:
    return F.sqrt(F.pow(_c(x1) - _c(x2), F.lit(2)) + F.pow(_c(y1) - _c(y2), F.lit(2)))


def paste(*xs) -> Column:
    return F.concat(*(_c(x).cast("string") for x in xs))


def stringmatch(s, part) -> Column:
    return truth(F.contains(_c(s), F.lit(part)))


def regmatch(s, pattern: str) -> Column:
    return truth(_c(s).rlike(pattern))


def file_tail(s) -> Column:
    return F.element_at(F.split(_c(s), "/"), -1)


def file_dir(s) -> Column:
    """What stands before the last slash; "." if there is none, "/" for the root."""
    s = _c(s)
    head = F.regexp_extract(s, r"^(.*)/[^/]*$", 1)
    return F.when(~F.contains(s, F.lit("/")), F.lit(".")).when(head == "", F.lit("/")).otherwise(head)


def file_ext(s) -> Column:
    return F.regexp_extract(file_tail(s), r"(\.[^.]*)$", 1)


def file_root(s) -> Column:
    """Without the extension."""
    s = _c(s)
    return F.substring(s, F.lit(1), F.length(s) - F.length(file_ext(s)))


def file_base(s) -> Column:
    return file_root(file_tail(s))


def cube_of_hex(q: Column, r: Column) -> Column:
    """Axial to cube coordinates."""
    return F.struct(_c(q).alias("x"), (-_c(q) - _c(r)).alias("y"), _c(r).alias("z"))


def cube_distance(a: Column, b: Column) -> Column:
    """Steps between two cube coordinates (structs x, y, z)."""
    return ((F.abs(a["x"] - b["x"]) + F.abs(a["y"] - b["y"]) + F.abs(a["z"] - b["z"])) / 2).cast("int")
