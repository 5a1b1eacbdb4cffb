"""Number rules as Column expressions: IEEE division, finite values, tolerance."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: Below this a count is no count.
TOLERANCE = 1e-9
NAN, INF = float("nan"), float("inf")


def finite(c: Column) -> Column:
    """True for numbers that are neither null, NaN nor infinite."""
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(INF))


def ieee_div(a: Column, b: Column) -> Column:
    """a / b with x/0 = +-inf and 0/0 = NaN, whatever spark.sql.ansi.enabled says."""
    return F.when(b != 0, a / F.nullif(b, F.lit(0.0))).when((a == 0) | F.isnan(a), F.lit(NAN)).when(a > 0, F.lit(INF)).otherwise(F.lit(-INF))


def rate(observed: Column, expected: Column, tol: float = TOLERANCE) -> Column:
    """observed / expected; an observed count below ``tol`` is 0, even over 0."""
    return F.when(observed < tol, F.lit(0.0)).otherwise(ieee_div(observed, expected))


def at_least(c: Column, value: float) -> Column:
    """c >= value, where null and NaN fail (Spark sorts NaN above all numbers)."""
    return F.coalesce((c >= F.lit(value)) & ~F.isnan(c), F.lit(False))


def difference(whole: Column, part: Column, tol: float = TOLERANCE) -> Column:
    """whole - part; a result within ``tol`` of 0 is 0, one below is NaN."""
    d = whole - part
    return F.when(d < -tol, F.lit(NAN)).when(F.abs(d) < tol, F.lit(0.0)).otherwise(d)


def no_nan(c: Column) -> Column:
    """Null for NaN, to write tables that other engines read."""
    return F.when(F.isnan(c), F.lit(None).cast("double")).otherwise(c)


def exact_sum(c: Column) -> Column:
    """The sum as the double next to it, whatever the order of rows: values add up as decimals of 18 places (as doubles in groups with NaN or values from 1e10)."""
    d = c.try_cast("decimal(28,18)")
    return F.when(F.count(d) == F.count(c), F.sum(d).cast("double")).otherwise(F.sum(c))


@F.pandas_udf(StringType())
def _six(x: pd.Series) -> pd.Series:
    return x.map("%.6g".__mod__)


def significant(c: Column) -> Column:
    """A number as C's %.6g writes it, rounded by its exact binary value (Java's formats round its shortest decimal form); null stays null."""
    return F.when(c.isNotNull(), _six(c.cast("double")))


@F.pandas_udf(DoubleType())
def chi2_sf(x: pd.Series) -> pd.Series:
    """Survival function of the chi-squared distribution with one degree of freedom."""
    return x.map(lambda v: math.erfc(math.sqrt(max(v, 0.0) / 2)) if pd.notna(v) else float("nan"))
