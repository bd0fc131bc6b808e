"""Small column helpers whose semantics differ between SQL engines.

All of them are built-in Catalyst expressions, so they stay inside whole-stage
codegen; none of them calls Python per row.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

# Rounding is done on a DECIMAL copy of the value: DECIMAL rounding is half away
# from zero on every engine, while DOUBLE rounding differs (1.005 -> 1.0 or 1.01).
ROUNDING_TYPE = "decimal(38,10)"


def dec(value: str | int) -> Column:
    """An exact DECIMAL literal, e.g. dec("0.1348")."""
    text = str(value)
    digits = Decimal(text).as_tuple()
    scale = max(0, -digits.exponent)
    precision = max(len(digits.digits), scale + 1)
    return F.lit(text).cast(f"decimal({precision},{scale})")


def round_half_away(x: Column, digits: int = 0) -> Column:
    """ROUND(x, digits), half away from zero, for DOUBLE input; returns DOUBLE."""
    return F.round(x.cast(ROUNDING_TYPE), digits).cast("double")


def to_int_half_away(x: Column) -> Column:
    """CAST(x AS INT64) of a float: rounds half away from zero (Spark would truncate)."""
    return F.round(x.cast(ROUNDING_TYPE), 0).cast("long")


def greatest_strict(*cols: Column) -> Column:
    """GREATEST that is NULL when any argument is NULL (Spark's skips NULLs)."""
    any_null = cols[0].isNull()
    for c in cols[1:]:
        any_null = any_null | c.isNull()
    return F.when(~any_null, F.greatest(*cols))


def floor_nonpositive(x: Column, keep: Column | None = None) -> Column:
    """CASE WHEN x <= 0 THEN 0 ELSE keep END (NULL x stays NULL)."""
    return F.when(x <= 0, F.lit(0)).otherwise(x if keep is None else keep)


def zero_if_null_or_negative(x: Column) -> Column:
    """CASE WHEN x IS NULL OR x < 0 THEN 0 ELSE x END."""
    return F.when(x.isNull() | (x < 0), F.lit(0)).otherwise(x)


def yes_no(flag: Column) -> Column:
    """'YES' when the flag is true, 'NO' otherwise (also for NULL)."""
    return F.when(flag, F.lit("YES")).otherwise(F.lit("NO"))


def safe_ratio(num: Column, den: Column) -> Column:
    """num / den in DOUBLE; NULL instead of an error when den is 0."""
    return F.when(den != 0, num.cast("double") / den.cast("double"))
