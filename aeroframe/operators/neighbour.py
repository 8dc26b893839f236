"""Differences, gradients and events along an ordered axis, as window expressions.

``by`` are the other axes (partition keys), ``order`` the axis itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.functions.common import GRAVITY, NAN, col, divide
from aeroframe.operators.spectral import per_series


def _axis(by: list[str], order) -> Window:
    return Window.partitionBy(*by).orderBy(*([order] if isinstance(order, (str, Column)) else order))


def gradient(x, by: list[str], order, spacing: float = 1.0) -> Column:
    """Central differences inside, one-sided at the ends; NULL for a single point.

    A row's place in its line says what is an end, so a missing neighbour inside
    the line leaves the difference missing.
    """
    w = _axis(by, order)
    c, before, after = col(x), F.lag(col(x)).over(w), F.lead(col(x)).over(w)
    first, last = F.lag(F.lit(1)).over(w).isNull(), F.lead(F.lit(1)).over(w).isNull()
    return F.when(first, (after - c) / spacing).when(last, (c - before) / spacing).otherwise((after - before) / (2 * spacing))


def destagger(df: DataFrame, values: list[str], by: list[str], order: str) -> DataFrame:
    """Means of adjacent points along ``order``; the last point of each line goes.
    A line of one point has no mean and gives no row."""
    w = _axis(by, order)
    after = [((F.col(v) + F.lead(v).over(w)) / 2).alias(v) for v in values]
    more = F.lead(order).over(w).isNotNull().alias("_more")
    return df.select(*by, order, *after, more).where("_more").drop("_more")


def destagger_all(df: DataFrame, values: list[str], axes: list[str], staggered: list[str]) -> DataFrame:
    """``destagger`` along each staggered axis in turn."""
    for axis in staggered:
        df = destagger(df, values, [a for a in axes if a != axis], axis)
    return df


def interval_precipitation(x, by: list[str], order, prepend_zero: bool = False) -> Column:
    """First differences; the first is 0, or the first value with ``prepend_zero``."""
    before = F.lag(col(x)).over(_axis(by, order))
    first = F.row_number().over(_axis(by, order)) == 1
    return F.when(first, col(x) if prepend_zero else F.lit(0.0)).otherwise(col(x) - before)


def precipitation_steps(df: DataFrame, total, by: list[str], order: str, wet_threshold: float = 0.1) -> DataFrame:
    """Per step: the accumulated amount, its increment (never below 0) and whether it was wet."""
    step = F.greatest(interval_precipitation(total, by, order), F.lit(0.0))
    return df.select(*by, *([order] if isinstance(order, str) else order), col(total).alias("accumulated"), step.alias("increment")).withColumn("wet", F.col("increment") >= wet_threshold)


def precipitation_diagnostics(df: DataFrame, total, by: list[str], order, wet_threshold: float = 0.1) -> DataFrame:
    """Largest increment, their sum and the number of wet intervals per group; NaN skipped."""
    known = F.nanvl(F.col("increment"), F.lit(None).cast("double"))
    return precipitation_steps(df, total, by, order, wet_threshold).groupBy(*by).agg(
        F.max(known).alias("maximum_interval"), F.sum(known).alias("accumulated"), F.count_if(known >= wet_threshold).alias("wet_intervals"))


def diagnose_pbl_height(df: DataFrame, theta: str, height: str, by: list[str], order: str, threshold: float = 0.5) -> DataFrame:
    """Height of the first level that is ``threshold`` warmer than the lowest; NaN where none is."""
    first = F.first(theta).over(_axis(by, order).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    warm = F.col(theta) - F.col("_first") >= threshold
    found = df.select(*by, order, theta, height, first.alias("_first")).groupBy(*by).agg(F.min_by(F.when(warm, F.col(height)), F.when(warm, F.col(order))).alias("pbl_height"))
    return found.withColumn("pbl_height", F.coalesce("pbl_height", F.lit(NAN)))


def low_level_jet(df: DataFrame, speed: str, height: str, by: list[str], order: str, minimum_speed: float = 8.0, drop: float = 2.0) -> DataFrame:
    """The fastest level (the lowest of equals), detected if it is fast enough,
    inside the column, and faster than the top level by ``drop``."""
    best = F.max(F.struct(F.col(speed).alias("s"), (-F.col(order)).alias("k"), F.col(height).alias("z")))
    cut = df.groupBy(*by).agg(best.alias("b"), F.max_by(speed, order).alias("top"), F.min(order).alias("lo"), F.max(order).alias("hi"))
    inside = (-F.col("b.k") != F.col("lo")) & (-F.col("b.k") != F.col("hi"))
    return cut.select(
        *by, F.col("b.s").alias("core_speed"), F.col("b.z").alias("core_height"), (F.col("b.s") - F.col("top")).alias("drop_above"),
        (inside & (F.col("b.s") >= minimum_speed) & (F.col("b.s") - F.col("top") >= drop)).alias("detected"))


def inversion_layers(temperature, height, by: list[str], order: str, minimum_gradient: float = 0.001) -> Column:
    return divide(gradient(temperature, by, order), gradient(height, by, order)) > minimum_gradient


def brunt_vaisala_frequency(theta, height, by: list[str], order: str) -> Column:
    rise = divide(gradient(theta, by, order), gradient(height, by, order))
    return F.sqrt(F.greatest(divide(GRAVITY, theta) * rise, F.lit(0.0)))


def horizontal_kinematics(u, v, y: str, x: str, by: list[str], dx: float, dy: float) -> list[Column]:
    du_dx, du_dy = gradient(u, [*by, y], x, dx), gradient(u, [*by, x], y, dy)
    dv_dx, dv_dy = gradient(v, [*by, y], x, dx), gradient(v, [*by, x], y, dy)
    return [(du_dx + dv_dy).alias("divergence"), (dv_dx - du_dy).alias("vorticity"),
            (du_dx - dv_dy).alias("normal_strain"), (dv_dx + du_dy).alias("shear_strain")]


def q_criterion(u, v, w, z: str, y: str, x: str, by: list[str], dx: float, dy: float, dz: float) -> Column:
    """Half the squared rotation minus the squared strain of the velocity gradient."""
    axes = ((x, [*by, z, y], dx), (y, [*by, z, x], dy), (z, [*by, y, x], dz))
    g = [[gradient(c, others, axis, step) for axis, others, step in axes] for c in (u, v, w)]
    rotation = strain = F.lit(0.0)
    for i in range(3):
        for j in range(3):
            rotation = rotation + F.pow((g[i][j] - g[j][i]) / 2, F.lit(2.0))
            strain = strain + F.pow((g[i][j] + g[j][i]) / 2, F.lit(2.0))
    return 0.5 * (rotation - strain)


def terrain_metrics(z, y: str, x: str, by: list[str], dx: float, dy: float) -> list[Column]:
    sx, sy = gradient(z, [*by, y], x, dx), gradient(z, [*by, x], y, dy)
    slope = F.hypot(sx, sy)
    return [slope.alias("slope"), F.degrees(F.atan(slope)).alias("slope_degrees"), F.pmod(F.lit(270.0) - F.degrees(F.atan2(sy, sx)), F.lit(360.0)).alias("aspect")]


def unwrap(direction, by: list[str], order) -> Column:
    """Degrees without jumps of half a turn or more; a jump of exactly +180 stays +180."""
    w = _axis(by, order)
    step = col(direction) - F.lag(col(direction)).over(w)
    turned = F.pmod(step + 180.0, F.lit(360.0)) - 180.0
    turned = F.when((turned == -180.0) & (step > 0), F.lit(180.0)).otherwise(turned)
    return turned


def unwrapped(df: DataFrame, direction: str, by: list[str], order: str, out: str) -> DataFrame:
    """Adds ``out``: the first direction plus the running sum of wrapped steps."""
    w = _axis(by, order)
    stepped = df.withColumn("_step", F.coalesce(unwrap(direction, by, order), F.col(direction)))
    return stepped.withColumn(out, F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_step")


def _rises(df: DataFrame, value: str, by: list[str], order, ramp_threshold: float | None) -> DataFrame:
    """Adds _before, _rise and _limit: the value before, the increment and the ramp threshold."""
    steps = df.withColumn("_before", F.lag(value).over(_axis(by, order))).withColumn("_rise", F.col(value) - F.col("_before"))
    known = F.nanvl(F.col("_rise"), F.lit(None).cast("double"))
    limit = F.lit(float(ramp_threshold)) if ramp_threshold is not None else 2 * F.stddev_pop(known).over(Window.partitionBy(*by))
    return steps.withColumn("_limit", limit)


def temporal_events(df: DataFrame, value: str, by: list[str], order, ramp_threshold: float | None = None) -> DataFrame:
    """Per row: the anomaly from the group's mean (NaN skipped), the increment from the
    row before (NULL for the first) and whether that is a ramp."""
    keys = [*by, *([order] if isinstance(order, str) else order)]
    mean = F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).over(Window.partitionBy(*by))
    both = _rises(df.select(*keys, F.col(value).cast("double").alias(value)), value, by, order, ramp_threshold)
    ramp = (F.abs("_rise") >= F.col("_limit")) & ~F.isnan("_rise")
    return both.select(*keys, (F.col(value) - mean).alias("anomaly"), F.col("_rise").alias("increment"), ramp.alias("ramp"))


def temporal_diagnostics(df: DataFrame, value: str, by: list[str], order, ramp_threshold: float | None = None) -> DataFrame:
    """Per group: mean, ramp threshold, number of ramps (NaN skipped) and lag-1 correlation."""
    both = _rises(df.select(*by, *([order] if isinstance(order, str) else order), F.col(value).cast("double").alias(value)), value, by, order, ramp_threshold)
    paired = F.col("_before").isNotNull()
    x, y = F.when(paired, F.col("_before")), F.when(paired, F.col(value))
    return both.groupBy(*by).agg(
        F.avg(F.nanvl(F.col(value), F.lit(None).cast("double"))).alias("mean"), F.first("_limit").alias("ramp_threshold"),
        F.count_if((F.abs("_rise") >= F.col("_limit")) & ~F.isnan("_rise")).alias("ramps"),
        divide(F.covar_pop(x, y), F.stddev_pop(x) * F.stddev_pop(y)).alias("lag1_correlation"))


def zero_crossing_frequency(df: DataFrame, value: str, by: list[str], order, sample_rate: float) -> DataFrame:
    """Sign changes of the demeaned signal, times rate over twice the length."""
    centred = df.select(*by, *([order] if isinstance(order, str) else order), (F.col(value) - F.avg(value).over(Window.partitionBy(*by))).alias("_x"))
    sign = centred.select(*by, (F.col("_x") < 0).alias("_neg"), F.lag(F.col("_x") < 0).over(_axis(by, order)).alias("_was"))
    return sign.groupBy(*by).agg((F.count_if(F.col("_neg") != F.col("_was")) * sample_rate / (2.0 * F.count(F.lit(1)))).alias("frequency"))


def integral_time_scale(df: DataFrame, value: str, by: list[str], order: str, spacing: float = 1.0) -> DataFrame:
    """Trapezoid of the biased autocorrelation up to its first value at or below 0.

    All lags of a series come from one padded transform; values within 1e-12 of
    the variance count as 0. NaN for constant series and those with missing values.
    """
    def compute(x):
        n = len(x)
        r = np.fft.irfft(np.abs(np.fft.rfft(x - x.mean(), 2 * n)) ** 2, 2 * n)[:n]
        if not r[0] > 0:
            return {"time_scale": [np.nan]}
        r = r / r[0]
        below = np.flatnonzero(r < 1e-12)
        r = r[: below[0]] if len(below) else r
        return {"time_scale": [spacing * (r[1:] + r[:-1]).sum() / 2]}

    return per_series(df, by, [value], order, "time_scale double", compute)
