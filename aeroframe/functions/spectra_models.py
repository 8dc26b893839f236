"""Turbulence spectrum and coherence models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from aeroframe.functions.common import col, divide

# Fixed values: (a, b) of the surface-layer spectrum by component.
KAIMAL = {"u": (102.0, 33.0), "v": (17.0, 9.5), "w": (2.0, 5.3)}

# Marine boundary layer at 81.5 m, by stability bin (from, below):
# the equation, 26 or 28, and its coefficients for each component.
CHEYNET = (
    (-2.0, -1.0, {"u": (26, 206, 73, 4.2, 14), "v": (26, 374, 144, 2.8, 9.5), "w": (26, 21, 10, 0.5, 2.3)}),
    (-1.0, -0.5, {"u": (26, 122, 51, 1.5, 6.8), "v": (26, 286, 149, 1.9, 8), "w": (26, 16, 13, 0.9, 3)}),
    (-0.5, -0.3, {"u": (26, 141, 64, 1.6, 8.9), "v": (26, 306, 185, 1.9, 8.5), "w": (26, 14, 18, 1, 3.3)}),
    (-0.3, -0.1, {"u": (26, 170, 78, 2.2, 14), "v": (26, 432, 362, 3.1, 13), "w": (26, 9.4, 22, 1.1, 3.7)}),
    (-0.1, 0.1, {"u": (26, 189, 111, 9.6, 40), "v": (28, 0.007, 5.2, 12, 0.05e-5), "w": (26, 2.9, 16, 1.4, 3.7)}),
    (0.1, 0.3, {"u": (28, 0.008, 16, 33, 0), "v": (28, 0.001, 4.3, 6, 0.3e-5), "w": (26, 0.03, 1.2, 1.5, 2.6)}),
    (0.3, 0.5, {"u": (28, 0.010, 9.8, 14, 0.3e-5), "v": (28, 0.001, 3.2, 3.2, 0.9e-5), "w": (26, 0, 0, 1.2, 1.4)}),
    (0.5, 1.0, {"u": (28, 0.01, 7.6, 8.8, 0.8e-5), "v": (28, 0.006, 2.8, 2.1, 1.3e-5), "w": (26, 0.02, 0.3, 1, 1)}),
    (1.0, 2.0, {"u": (28, 0.03, 5, 4.4, 1.5e-5), "v": (28, 0.02, 2.1, 1.2, 3.3e-5), "w": (26, 1.2, 18, 0.6, 0.5)}),
)


def _need(component: str, table) -> None:
    if component not in table:
        raise ValueError(f"component must be one of {', '.join(table)}")


def kaimal_spectrum(frequency, mean_speed, height, friction_velocity, component: str = "u") -> Column:
    _need(component, KAIMAL)
    a, b = KAIMAL[component]
    ratio = divide(height, mean_speed)
    return divide(F.pow(col(friction_velocity), F.lit(2.0)) * a * ratio, F.pow(1 + b * col(frequency) * ratio, F.lit(5 / 3)))


def iec_kaimal_spectrum(frequency, mean_speed, sigma, length_scale) -> Column:
    time = divide(length_scale, mean_speed)
    return divide(4 * F.pow(col(sigma), F.lit(2.0)) * time, F.pow(1 + 6 * col(frequency) * time, F.lit(5 / 3)))


def von_karman_spectrum(frequency, mean_speed, sigma, length_scale, component: str = "u") -> Column:
    _need(component, ("u", "v", "w"))
    time = divide(length_scale, mean_speed)
    x2 = F.pow(col(frequency) * time, F.lit(2.0))
    level = 4 * F.pow(col(sigma), F.lit(2.0)) * time
    if component == "u":
        return level / F.pow(1 + 70.8 * x2, F.lit(5 / 6))
    return level * (1 + 188.4 * x2) / F.pow(1 + 70.8 * x2, F.lit(11 / 6))


def exponential_coherence(frequency, separation, mean_speed, decay: float = 12.0) -> Column:
    return F.exp(divide(-decay * col(frequency) * col(separation), mean_speed))


def cheynet_spectrum(frequency, mean_speed, height, friction_velocity, stability, component: str = "u") -> Column:
    """Raises at run time where stability is outside [-2, 2) or a scale is not positive."""
    _need(component, ("u", "v", "w"))
    f, zeta = col(frequency), col(stability)
    n = divide(height, mean_speed) * f
    shape = None
    for low, high, values in CHEYNET:
        kind, a, b, c, d = values[component]
        if kind == 26:
            form = divide(a * n, F.pow(1 + b * n, F.lit(5 / 3))) + divide(c * n, 1 + d * F.pow(n, F.lit(5 / 3)))
        else:
            form = a * F.pow(n, F.lit(-2 / 3)) + divide(b * n, 1 + c * F.pow(n, F.lit(5 / 3))) + d * F.pow(n, F.lit(-2.0))
        here = (zeta >= low) & (zeta < high)
        shape = F.when(here, form) if shape is None else shape.when(here, form)
    shape = shape.when(zeta.isNotNull(), F.raise_error(F.lit("stability must satisfy -2 <= zeta < 2")).cast("double"))
    positive = (f > 0) & (col(mean_speed) > 0) & (col(height) > 0)
    value = divide(shape * F.pow(col(friction_velocity), F.lit(2.0)), f)
    return F.when(positive, value).when(~positive, F.raise_error(F.lit("frequency, speed and height must be positive")).cast("double"))


def premultiplied_spectrum(frequency, spectrum) -> Column:
    return col(frequency) * col(spectrum)
