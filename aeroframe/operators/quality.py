"""Quality control: one issue row per variable and failed rule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Physical limits by variable (least, largest, unit).
LIMITS = {
    "T2": (180.0, 340.0, "K"), "PSFC": (45000.0, 110000.0, "Pa"), "Q2": (0.0, 0.05, "kg kg-1"), "QVAPOR": (0.0, 0.05, "kg kg-1"),
    "U10": (-100.0, 100.0, "m s-1"), "V10": (-100.0, 100.0, "m s-1"), "RAINC": (0.0, 100000.0, "mm"), "RAINNC": (0.0, 100000.0, "mm"),
    "PBLH": (0.0, 10000.0, "m"),
}
HYDROMETEORS = ("QCLOUD", "QRAIN", "QICE", "QSNOW", "QGRAUP")


def first_issue(value: Column, failed: Column, index: list[str]) -> Column:
    """(count, first index, first value) of the rows that fail, in row-major order."""
    at = F.min(F.when(failed, F.struct(F.array(*[F.col(c).cast("long") for c in index]).alias("i"), value.alias("v"))))
    return F.struct(F.count_if(failed).alias("count"), at["i"].alias("first_index"), at["v"].alias("first_value"))


def quality_control(
    df: DataFrame, variables: list[str], index: list[str], time: str | None = "t", clock: str | None = None,
    limits: dict | None = None, fill_values: dict | None = None, jump_sigma: float = 12.0,
) -> DataFrame:
    """Issues: severity, variable, check, count, first_index, first_value.

    All point rules of all variables are one aggregate; the jump rule works on
    one mean per time. An empty result means nothing was found.
    """
    limits, rules = LIMITS | (limits or {}), []
    for name in variables:
        v = F.col(name).cast("double")
        whole = v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
        rules.append(("ERROR", name, "non-finite", first_issue(v, ~whole, index)))
        if name in (fill_values or {}):
            rules.append(("ERROR", name, "fill-value", first_issue(v, v == fill_values[name], index)))
        if name in limits:
            low, high, _ = limits[name]
            slack = max(1e-12, abs(high - low) * 1e-12)
            rules.append(("ERROR", name, "physical-range", first_issue(v, whole & ((v < low - slack) | (v > high + slack)), index)))
        if name in HYDROMETEORS:
            rules.append(("ERROR", name, "negative-water", first_issue(v, whole & (v < -1e-12), index)))
    one = df.agg(F.array(*[F.struct(F.lit(s).alias("severity"), F.lit(n).alias("variable"), F.lit(c).alias("check"), r.alias("r")) for s, n, c, r in rules]).alias("all"))
    found = one.select(F.explode("all").alias("x")).select("x.severity", "x.variable", "x.check", "x.r.count", "x.r.first_index", "x.r.first_value")
    if time is not None:
        found = found.unionByName(_jumps(df, variables, time, jump_sigma))
    if time is not None and clock is not None:
        found = found.unionByName(_clock(df, time, clock))
    return found.where("count > 0")


def _middle(df: DataFrame, value: str, name: str) -> DataFrame:
    """``df`` with the median of ``value`` per variable; missing values do not count.

    Ranks come from a window, which spills: no series stands in one row.
    """
    own = Window.partitionBy("variable")
    ranked = df.withColumns({"_r": F.row_number().over(own.orderBy(F.col(value).asc_nulls_last())), "_n": F.count(value).over(own)})
    inner = (F.col("_r") == F.floor((F.col("_n") + 1) / 2)) | (F.col("_r") == F.floor(F.col("_n") / 2) + 1)
    return ranked.withColumn(name, F.avg(F.when(inner, F.col(value))).over(own)).drop("_r", "_n")


def _steps(series: DataFrame, value: str) -> DataFrame:
    """(variable, t, value) with the place ``n`` in time, from 0, and the step ``d`` from the time before."""
    rising = Window.partitionBy("variable").orderBy("t")
    return series.select("variable", (F.row_number().over(rising) - 1).cast("long").alias("n"), (F.col(value) - F.lag(value).over(rising)).alias("d"))


def _jumps(df: DataFrame, variables: list[str], time: str, sigma: float) -> DataFrame:
    """Domain means that jump by more than ``sigma`` robust deviations.

    A series, one mean per time step, is sorted in one task per variable: by time, by step and by deviation.
    """
    means = df.groupBy(F.col(time).alias("t")).agg(*[F.avg(F.nanvl(F.col(v).cast("double"), F.lit(None).cast("double"))).alias(v) for v in variables])
    long = _steps(means.unpivot(["t"], variables, "variable", "mean"), "mean")
    long = _middle(long.withColumn("d", F.nanvl("d", F.lit(None).cast("double"))), "d", "mid")
    long = _middle(long.withColumn("off", F.abs(F.col("d") - F.col("mid"))), "off", "mad").withColumn("scale", 1.4826 * F.col("mad"))
    bad = (F.col("off") > sigma * F.col("scale")) & (F.col("scale") > 0) & (F.col("scale") < float("inf"))
    first = F.min(F.when(bad, F.struct("n", "d")))
    told = long.groupBy("variable").agg(F.count_if(bad).alias("count"), first["n"].alias("n"), first["d"].alias("d"), F.count("*").alias("size")).where("size > 2")
    return told.select(F.lit("WARNING").alias("severity"), "variable", F.lit("temporal-jump").alias("check"), "count", F.array("n").alias("first_index"), F.col("d").alias("first_value"))


def _clock(df: DataFrame, time: str, clock: str) -> DataFrame:
    """A clock that does not rise, or not evenly."""
    series = df.groupBy(F.col(time).alias("t")).agg(F.min(F.col(clock).cast("double")).alias("c")).withColumn("variable", F.lit("XTIME"))
    d = _steps(series, "c").groupBy("variable").agg(F.min("d").alias("least"), F.max("d").alias("most"), F.min_by("d", F.when(F.col("n") > 0, F.col("n"))).alias("first"))
    slack = 1e-8 + 1e-5 * F.abs("first")
    uneven = (F.col("least") <= 0) | (F.col("most") - F.col("first") > slack) | (F.col("first") - F.col("least") > slack)
    return d.select(
        F.lit("ERROR").alias("severity"), "variable", F.lit("time-coordinate").alias("check"), F.when(uneven, 1).otherwise(0).cast("long").alias("count"),
        F.lit(None).cast("array<bigint>").alias("first_index"), F.lit(None).cast("double").alias("first_value"))


def report_text(issues: list) -> str:
    """Readable report of collected issue rows."""
    if not issues:
        return "PASS: no issue found"
    lines = [f"{sum(i['severity'] == s for i in issues)} {s}" for s in ("ERROR", "WARNING")]
    return "\n".join([", ".join(lines), *[f"{n}. {i['severity']} {i['variable']} {i['check']}: {i['count']}, first at {i['first_index']}" for n, i in enumerate(issues, 1)]])
