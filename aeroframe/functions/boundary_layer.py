"""Surface layer, stability and profiles. NULL in, NULL out; NaN propagates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeroframe.functions.common import EPSILON, GRAVITY, VON_KARMAN, col, divide, log


def bulk_richardson_number(theta_low, theta_high, z_low, z_high, u_low, u_high, v_low, v_high) -> Column:
    mean = (col(theta_low) + col(theta_high)) / 2
    shear = F.pow(col(u_high) - col(u_low), F.lit(2.0)) + F.pow(col(v_high) - col(v_low), F.lit(2.0))
    return divide(GRAVITY, mean) * (col(theta_high) - col(theta_low)) * (col(z_high) - col(z_low)) / F.greatest(shear, F.lit(EPSILON))


def power_law_exponent(speed_low, speed_high, z_low, z_high) -> Column:
    return divide(log(divide(speed_high, speed_low)), log(divide(z_high, z_low)))


def friction_velocity(stress, density) -> Column:
    return F.sqrt(divide(F.abs(col(stress)), density))


def monin_obukhov_length(theta, ustar, heat_flux, kappa: float = VON_KARMAN) -> Column:
    """NaN where there is no heat flux."""
    return divide(-col(theta) * F.pow(col(ustar), F.lit(3.0)), kappa * GRAVITY * col(heat_flux))


def roughness_length(speed, height, ustar, kappa: float = VON_KARMAN) -> Column:
    return col(height) * F.exp(divide(-kappa * col(speed), ustar))


def log_wind_profile(height, ustar, roughness, displacement=0.0, kappa: float = VON_KARMAN) -> Column:
    return col(ustar) / kappa * log(divide(col(height) - col(displacement), roughness))


def stability_class(length) -> Column:
    """Class name of an Obukhov length; 0, NaN and NULL are neutral."""
    x = col(length)
    return (
        F.when(x.isNull() | F.isnan(x) | (x == 0), "neutral")
        .when(x < -200, "weak unstable").when(x < -50, "unstable").when(x < 0, "very unstable")
        .when(x <= 50, "very stable").when(x <= 200, "stable").otherwise("weak stable")
    )


def convective_velocity_scale(heat_flux, depth, theta) -> Column:
    return F.cbrt(F.greatest(divide(GRAVITY * col(heat_flux), theta), F.lit(0.0)) * col(depth))


