"""Resolved turbulence as aggregates (population moments) and anomalies; propagating."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.functions.common import GRAVITY, col, divide
from aeroframe.operators.neighbour import gradient


def fluctuations(x, by: list[str]) -> Column:
    """x minus its mean over the rows of its group."""
    return col(x) - F.avg(col(x)).over(Window.partitionBy(*by))


def resolved_tke(u, v, w) -> Column:
    return 0.5 * (F.var_pop(col(u)) + F.var_pop(col(v)) + F.var_pop(col(w)))


def reynolds_flux(a, b) -> Column:
    return F.covar_pop(col(a), col(b))


def turbulence_intensity(x, percent: bool = True) -> Column:
    return divide((100.0 if percent else 1.0) * F.stddev_pop(col(x)), F.abs(F.avg(col(x))))


def calculate_fluxes(u, v, w) -> list[Column]:
    named = {"u": u, "v": v, "w": w}
    return [reynolds_flux(named[a], named[b]).alias(a + b) for a, b in ("uu", "vv", "ww", "uv", "uw", "vw")]


def calculate_total_tke(u, v, w, subgrid=None) -> Column:
    """Resolved energy plus the mean subgrid energy, where given."""
    resolved = resolved_tke(u, v, w)
    return resolved if subgrid is None else resolved + F.avg(col(subgrid))


def sgs_tke(m11, m22, m33) -> Column:
    return 0.5 * (col(m11) + col(m22) + col(m33))


def tke_budget(df: DataFrame, u: str, v: str, w: str, theta: str, height: str, level: str, by: list[str] | None = None) -> DataFrame:
    """Per level: shear production, buoyancy and resolved energy from means over
    time; vertical gradients are ratios of index gradients."""
    by = by or []
    means = df.groupBy(*by, level).agg(
        F.covar_pop(u, w).alias("uw"), F.covar_pop(v, w).alias("vw"), F.covar_pop(w, theta).alias("wt"), F.avg(theta).alias("theta"),
        F.avg(u).alias("mu"), F.avg(v).alias("mv"), F.avg(height).alias("z"), resolved_tke(u, v, w).alias("tke"))
    g = {c: gradient(F.col(c), by, level) for c in ("mu", "mv", "z")}
    steep = means.select("*", *[x.alias(f"d_{c}") for c, x in g.items()])
    return steep.select(
        *by, level,
        (-(F.col("uw") * divide("d_mu", "d_z") + F.col("vw") * divide("d_mv", "d_z"))).alias("shear_production"),
        divide(GRAVITY * F.col("wt"), F.col("theta")).alias("buoyancy_production"), F.col("tke").alias("resolved_tke"))
