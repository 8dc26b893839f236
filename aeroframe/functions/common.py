"""Constants and small helpers of the scalar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Physical constants (SI units).
DRY_AIR_GAS_CONSTANT = 287.05
DRY_AIR_HEAT_CAPACITY = 1004.0
GRAVITY = 9.80665
REFERENCE_PRESSURE = 1.0e5
LATENT_HEAT = 2.5e6
VON_KARMAN = 0.4
EPSILON = 2.220446049250313e-16

NAN = float("nan")


def col(x) -> Column:
    """A Column from a Column, a column name or a number."""
    if isinstance(x, Column):
        return x
    return F.col(x) if isinstance(x, str) else F.lit(float(x))


def finite(x) -> Column:
    """NULL in place of NaN and infinities: aggregates skip NULL, not NaN."""
    c = col(x)
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def divide(a, b) -> Column:
    """a / b, NaN where b is 0 (ANSI division would raise)."""
    return F.coalesce(F.try_divide(col(a), col(b)), F.when(col(a).isNotNull() & col(b).isNotNull(), F.lit(NAN)))


def log(x) -> Column:
    """Natural logarithm, NaN at and below 0."""
    c = col(x)
    return F.when(c > 0, F.log(c)).when(c.isNotNull(), F.lit(NAN))
