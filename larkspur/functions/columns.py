"""Column functions whose meaning differs from Spark's own operators.

Integer division truncates, averages are doubles, money is decimal(15,2), products of money are
decimal(38,6), matching may ignore case. All are built-in expressions, so they stay in generated code.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(15,2)"
PRODUCT = "decimal(38,6)"
PARTS = ("year", "month", "day", "hour", "minute", "second")


def _column(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def int_div(a, b) -> Column:
    """Quotient of integers, truncated toward zero."""
    return F.call_function("div", _column(a), _column(b))


def money(x) -> Column:
    return _column(x).cast(MONEY)


def product(*factors) -> Column:
    """Exact product of decimals, to six digits."""
    out = _column(factors[0])
    for f in factors[1:]:
        out = out * _column(f)
    return out.cast(PRODUCT)


def avg_double(x) -> Column:
    """Average as a double, from an exact sum where the input is exact."""
    return F.sum(_column(x)).cast("double") / F.count(_column(x))


def _whole(x) -> Column:
    """Floating numbers round half to even, decimals lose their digits, integers stay exact."""
    c = _column(x)
    return F.when(F.typeof(c).isin("float", "double"), F.rint(c).cast("bigint")).otherwise(c.cast("bigint"))


def cast_int(x) -> Column:
    return _whole(x).cast("int")


def cast_long(x) -> Column:
    return _whole(x)


def cast_truncated(x, digits: int = 2) -> Column:
    """A decimal with the digits beyond ``digits`` cut off, toward zero."""
    wide = _column(x).cast(f"decimal(38,{min(18, digits + 8)})")
    scaled = wide * F.lit(10**digits)
    return (F.when(scaled < 0, F.ceil(scaled)).otherwise(F.floor(scaled)) / F.lit(10**digits)).cast(MONEY if digits == 2 else f"decimal(38,{digits})")


def starts_with(x, prefix: str) -> Column:
    return F.lower(_column(x)).startswith(prefix.lower())


def ends_with(x, suffix: str) -> Column:
    return F.lower(_column(x)).endswith(suffix.lower())


#: Characters that mean something in a regular expression.
SPECIAL = r"([\\^$.|?*+()\[\]{}])"


def loose_regex(pattern: str) -> str:
    """Regular expression of a loose pattern: unanchored, without case, ``%`` the only wildcard."""
    return "(?is)" + ".*".join(re.sub(SPECIAL, r"\\\1", p) for p in pattern.split("%"))


def like_loose(x, pattern: str) -> Column:
    """Unanchored and without case, ``%`` the only wildcard; other characters stand for themselves."""
    return _column(x).rlike(loose_regex(pattern))


def extract_part(part: str, x) -> Column:
    if part not in PARTS:
        raise ValueError(f"part must be one of {', '.join(PARTS)}")
    return getattr(F, {"day": "dayofmonth"}.get(part, part))(_column(x)).cast("int")


def date(text: str) -> Column:
    return F.to_date(F.lit(text))
