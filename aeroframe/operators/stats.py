"""Scores and statistics as aggregate expressions.

"Skipping" operators treat NaN as missing (they aggregate ``finite`` values);
"propagating" ones return NaN as soon as one value is NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.functions.common import NAN, col, divide, finite
from aeroframe.functions.wind import circular_error


def _number(x) -> Column:
    """NaN alone as missing; infinities stay."""
    return F.nanvl(col(x), F.lit(None).cast("double"))


def bias(model, observed) -> Column:
    return F.avg(_number(col(model) - col(observed)))


def mae(model, observed) -> Column:
    return F.avg(F.abs(_number(col(model) - col(observed))))


def rmse(model, observed) -> Column:
    d = _number(col(model) - col(observed))
    return F.sqrt(F.avg(d * d))


def circular_mae(model, observed) -> Column:
    return F.avg(F.abs(_number(circular_error(model, observed))))


def normalized_error(model, observed) -> Column:
    return divide(rmse(model, observed), F.avg(F.abs(_number(observed))))


def correlation(model, observed) -> Column:
    """Pearson; propagating, NaN where either side does not vary."""
    a, b = col(model), col(observed)
    return divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def standard_error(x) -> Column:
    """Sample standard deviation over the root of the number of values; skipping."""
    v = finite(x)
    return divide(F.stddev_samp(v), F.sqrt(F.count(v)))


def comparison_summary(model, observed) -> list[Column]:
    return [
        bias(model, observed).alias("bias"), mae(model, observed).alias("mae"),
        rmse(model, observed).alias("rmse"), correlation(model, observed).alias("correlation"),
    ]


def spatial_scores(df: DataFrame, model: str, observed: str) -> DataFrame:
    """Each row with its absolute and squared error, and the summary of all rows beside it."""
    error = F.col(model) - F.col(observed)
    # one row of sums, so its broadcast has a fixed size
    summary = df.agg(*comparison_summary(model, observed))
    return df.withColumn("absolute_error", F.abs(error)).withColumn("squared_error", error * error).crossJoin(F.broadcast(summary))


def resolution_metrics(fine, coarse) -> list[Column]:
    return comparison_summary(fine, coarse)


METRICS = {"rmse": rmse, "mae": mae, "bias": lambda m, o: F.abs(bias(m, o))}


def rank_cases(df: DataFrame, case: str, model: str, observed: str, metric: str = "rmse") -> DataFrame:
    """Cases by score, best first; equal scores by case name."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {', '.join(METRICS)}")
    scored = df.groupBy(case).agg(METRICS[metric](model, observed).alias("score"))
    # one row per case: a single ordered partition of aggregates
    return scored.withColumn("rank", F.row_number().over(Window.orderBy("score", case)))


def kantorovich_distance(df: DataFrame, first: str, second: str, by: list[str]) -> DataFrame:
    """Mean distance of the sorted values per group, by linear quantiles at the
    levels of the side with more values; NULL where a side has none.

    Each side is ranked by a window, which spills; ranks meet by an equi-join, so
    no group is ever held in one row. Of equal counts the first side gives the levels.
    """
    keys = F.struct(*[F.col(b) for b in by], F.lit(0)).alias("_g")
    ends = [(0, first), (1, second)]
    values = df.select(keys, F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(c).cast("double").alias("x")) for s, c in ends])).alias("_v"))
    values = values.select("_g", F.col("_v.side").alias("_side"), F.col("_v.x").alias("_x")).where("_x IS NOT NULL")
    sizes = df.groupBy(*by).agg(F.count(first).alias("_n0"), F.count(second).alias("_n1")).select(keys, "_n0", "_n1")
    w = Window.partitionBy("_g", "_side").orderBy("_x")
    ranked = values.select("_g", "_side", "_x", F.lead("_x").over(w).alias("_next"), (F.row_number().over(w) - 1).cast("bigint").alias("_r")).join(sizes, "_g")
    larger = F.when(F.col("_n0") >= F.col("_n1"), 0).otherwise(1)
    n, m = F.greatest("_n0", "_n1"), F.least("_n0", "_n1")
    place = F.when(n > 1, F.col("_r") * (m - 1) / F.greatest(n - 1, F.lit(1))).otherwise(F.lit(0.0))
    low = F.floor(place)
    levels = ranked.where(F.col("_side") == larger).select("_g", F.col("_x").alias("_a"), low.alias("_r"), (place - low).alias("_part"))
    knots = ranked.where(F.col("_side") != larger).select("_g", "_r", "_x", F.coalesce("_next", "_x").alias("_next"))
    gap = F.abs(F.col("_a") - (F.col("_x") + (F.col("_next") - F.col("_x")) * F.col("_part")))
    found = levels.join(knots, ["_g", "_r"]).groupBy("_g").agg(F.avg(gap).alias("distance"))
    return sizes.join(found, "_g", "left").select(*[F.col(f"_g.{b}").alias(b) for b in by], "distance")


def circular_mean(direction, weights=None) -> Column:
    """Degrees in [0, 360)."""
    w = F.lit(1.0) if weights is None else col(weights)
    a = F.radians(col(direction))
    return F.pmod(F.degrees(F.atan2(F.sum(w * F.sin(a)), F.sum(w * F.cos(a)))), F.lit(360.0))


# The Lanczos approximation of the gamma function (g = 7, n = 9).
LANCZOS = (
    0.99999999999980993, 676.5203681218851, -1259.1392167224028, 771.32342877765313, -176.61502916214059,
    12.507343278686905, -0.13857109526572012, 9.9843695780195716e-6, 1.5056327351493116e-7,
)


def gamma(x: Column) -> Column:
    """Gamma function for arguments above 0.5."""
    y = x - 1
    series = F.lit(LANCZOS[0])
    for k, c in enumerate(LANCZOS[1:], 1):
        series = series + c / (y + k)
    t = y + 7.5
    return math.sqrt(2 * math.pi) * F.pow(t, y + 0.5) * F.exp(-t) * series


def weibull_fit(df: DataFrame, speed: str, by: list[str]) -> DataFrame:
    """Shape and scale from mean and deviation of the finite positive values; NaN below two."""
    v = F.when(finite(speed) > 0, F.col(speed))
    sums = df.groupBy(*by).agg(F.count(v).alias("_n"), F.avg(v).alias("_mean"), F.stddev_pop(v).alias("_std"))
    # values that do not vary have an infinite shape, with the mean as scale
    ratio = F.col("_std") / F.col("_mean")
    shape = F.when(F.col("_n") < 2, F.lit(NAN)).when(ratio > 0, F.pow(ratio, F.lit(-1.086))).otherwise(F.lit(float("inf")))
    fitted = sums.withColumn("shape", shape)
    scale = F.when(F.col("_n") < 2, F.lit(NAN)).when(F.col("shape") < float("inf"), F.col("_mean") / gamma(1 + 1 / F.col("shape"))).otherwise(F.col("_mean"))
    return fitted.withColumn("scale", scale).drop("_n", "_mean", "_std")


def wind_power_density(speed, density=1.225) -> Column:
    return 0.5 * F.avg(_number(col(density) * F.pow(col(speed), F.lit(3.0))))


def fit_spectral_slope(frequency, spectrum, minimum: float | None = None, maximum: float | None = None) -> list[Column]:
    """Slope and intercept of log10 against log10, NaN below two points."""
    f, s = col(frequency), col(spectrum)
    used = (f > 0) & (s > 0)
    if minimum is not None:
        used &= f >= minimum
    if maximum is not None:
        used &= f <= maximum
    x, y = F.when(used, F.log10(f)), F.when(used, F.log10(s))
    enough = F.count(x) >= 2
    nan = F.lit(NAN)
    return [
        F.when(enough, F.coalesce(F.regr_slope(y, x), nan)).otherwise(nan).alias("slope"),
        F.when(enough, F.coalesce(F.regr_intercept(y, x), nan)).otherwise(nan).alias("intercept"),
    ]


def class_statistics(value) -> list[Column]:
    """Per class: count with NaN, and mean, population deviation, least and largest without."""
    v = _number(value)
    return [
        F.count(F.lit(1)).alias("count"), F.avg(v).alias("mean"), F.stddev_pop(v).alias("std"),
        F.min(v).alias("minimum"), F.max(v).alias("maximum"),
    ]


def channel_statistics(df: DataFrame, channels: list[str], by: list[str] | None = None) -> DataFrame:
    """min, mean, max, std (population) per numeric channel; propagating."""
    by = by or []
    long = df.select(*by, *[F.col(c).cast("double") for c in channels]).unpivot([F.col(c) for c in by], channels, "channel", "value")
    return long.groupBy(*by, "channel").agg(
        F.min("value").alias("minimum"), F.avg("value").alias("mean"), F.max("value").alias("maximum"), F.stddev_pop("value").alias("std"))


def compare_outputs(first: DataFrame, second: DataFrame, channels: list[str], on: str = "time") -> DataFrame:
    """comparison_summary per channel over the rows whose ``on`` is equal in both."""
    long = lambda df, name: df.select(on, *[F.col(c).cast("double") for c in channels]).unpivot([on], channels, "channel", name)
    both = long(first, "model").join(long(second, "observed"), [on, "channel"])
    return both.groupBy("channel").agg(*comparison_summary("model", "observed"))


def integral_conservation(source, target, source_area, target_area) -> list[Column]:
    before, after = F.sum(_number(col(source) * col(source_area))), F.sum(_number(col(target) * col(target_area)))
    return [before.alias("source_integral"), after.alias("target_integral"), divide(after - before, before).alias("relative_error")]


def diurnal_cycle(df: DataFrame, value: str, hour, by: list[str] | None = None) -> DataFrame:
    h = F.pmod(col(hour).cast("int"), F.lit(24))
    return df.groupBy(*(by or []), h.alias("hour")).agg(F.avg(_number(value)).alias("mean"))


def wind_rose_histogram(df: DataFrame, direction: str, speed: str, direction_bins: int = 16, speed_bins: int = 5) -> DataFrame:
    """Counts of (direction, speed) cells, empty cells too; the largest speed is in the last cell."""
    top = df.agg(F.max(finite(speed)).alias("_top"))
    # one row, so its broadcast has a fixed size
    binned = df.where(finite(direction).isNotNull() & finite(speed).isNotNull() & (F.col(speed) >= 0)).crossJoin(F.broadcast(top)).select(
        F.floor(F.pmod(F.col(direction), F.lit(360.0)) / (360.0 / direction_bins)).cast("int").alias("direction_bin"),
        F.when(F.col("_top") > 0, F.least(F.floor(F.col(speed) / F.col("_top") * speed_bins), F.lit(speed_bins - 1))).otherwise(0).cast("int").alias("speed_bin"))
    counts = binned.groupBy("direction_bin", "speed_bin").agg(F.count("*").alias("count"))
    spark = df.sparkSession
    cells = spark.range(direction_bins * speed_bins).select(
        F.floor(F.col("id") / speed_bins).cast("int").alias("direction_bin"), (F.col("id") % speed_bins).cast("int").alias("speed_bin"))
    return cells.join(counts, ["direction_bin", "speed_bin"], "left").withColumn("count", F.coalesce("count", F.lit(0)))


def cluster_profiles(df: DataFrame, id_col: str, vector: str, centres: list[list[float]], steps: int = 5) -> DataFrame:
    """Lloyd rounds from given centres; ties go to the first centre, an empty
    cluster keeps its centre, labels belong to the last assignment. Only the
    centres (clusters x width numbers) pass through the driver."""
    def distance(c: list[float]) -> Column:
        return F.aggregate(
            F.zip_with(F.col(vector), F.array(*[F.lit(float(x)) for x in c]), lambda a, b: (a - b) * (a - b)), F.lit(0.0), lambda s, x: s + x)

    def assigned(now):
        ranked = F.array(*[F.struct(distance(c).alias("d"), F.lit(k).alias("k")) for k, c in enumerate(now)])
        return df.select(id_col, vector, F.array_min(ranked)["k"].alias("cluster"))

    labels = assigned(centres)
    for step in range(steps):
        labels = assigned(centres)
        if step == steps - 1:
            break
        width = len(centres[0])
        sums = labels.groupBy("cluster").agg(*[F.avg(F.get(F.col(vector), F.lit(j))).alias(f"c{j}") for j in range(width)]).collect()
        new = {r["cluster"]: [r[f"c{j}"] for j in range(width)] for r in sums}
        centres = [new.get(k, c) for k, c in enumerate(centres)]
    return labels.select(id_col, "cluster")
