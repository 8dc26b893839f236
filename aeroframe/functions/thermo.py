"""Thermodynamics and moisture. NULL in, NULL out; NaN propagates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeroframe.functions.common import (
    DRY_AIR_GAS_CONSTANT, DRY_AIR_HEAT_CAPACITY, GRAVITY, LATENT_HEAT, REFERENCE_PRESSURE, col, divide,
)


def potential_temperature(perturbation, base: float = 300.0) -> Column:
    return col(perturbation) + base


def temperature_from_potential(theta, pressure) -> Column:
    return col(theta) * F.pow(col(pressure) / REFERENCE_PRESSURE, F.lit(DRY_AIR_GAS_CONSTANT / DRY_AIR_HEAT_CAPACITY))


def virtual_temperature(temperature, vapour) -> Column:
    return col(temperature) * (1 + 0.61 * col(vapour))


def air_density(pressure, temperature, vapour=0.0) -> Column:
    return divide(pressure, DRY_AIR_GAS_CONSTANT * virtual_temperature(temperature, vapour))


def geopotential_height(perturbation, base=0.0) -> Column:
    return (col(perturbation) + col(base)) / GRAVITY


def mixing_ratio_to_specific_humidity(ratio) -> Column:
    return divide(ratio, 1 + col(ratio))


def relative_humidity(temperature, pressure, ratio) -> Column:
    """Percent, clipped to 0..100; saturation by the Bolton formula."""
    celsius = col(temperature) - 273.15
    saturation = 611.2 * F.exp(divide(17.67 * celsius, celsius + 243.5))
    vapour = divide(col(ratio) * col(pressure), 0.622 + col(ratio))
    return F.greatest(F.lit(0.0), F.least(F.lit(100.0), divide(100 * vapour, saturation)))


def dew_point(temperature, humidity) -> Column:
    """Kelvin, by the Magnus formula; humidity in percent, clipped to 1e-6..100."""
    celsius = col(temperature) - 273.15
    share = F.greatest(F.lit(1e-6), F.least(F.lit(100.0), col(humidity))) / 100
    gamma = F.log(share) + divide(17.625 * celsius, 243.04 + celsius)
    return divide(243.04 * gamma, 17.625 - gamma) + 273.15


def equivalent_potential_temperature(temperature, pressure, ratio) -> Column:
    t = col(temperature)
    dry = t * F.pow(divide(REFERENCE_PRESSURE, pressure), F.lit(DRY_AIR_GAS_CONSTANT / DRY_AIR_HEAT_CAPACITY))
    return dry * F.exp(divide(LATENT_HEAT * col(ratio), DRY_AIR_HEAT_CAPACITY * t))


def height_agl(height, terrain) -> Column:
    return col(height) - col(terrain)


def reflectivity_to_rain_rate(dbz, coefficient: float = 200.0, exponent: float = 1.6) -> Column:
    return F.pow(F.pow(F.lit(10.0), col(dbz) / 10) / coefficient, F.lit(1 / exponent))
