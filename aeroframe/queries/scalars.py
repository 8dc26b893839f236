"""Scalar functions."""

from __future__ import annotations


from pyspark.sql import functions as F

from aeroframe.functions import boundary_layer as bl
from aeroframe.functions import spectra_models as sm
from aeroframe.functions import thermo, wind
from aeroframe.queries.registry import add, scalar
from aeroframe.queries import registry as reg
from aeroframe.plans import views

# ruff: noqa: E731
c = F.col

scalar("wind_speed", "les", lambda: {"speed": wind.wind_speed("u", "v")}, {"speed": "sqrt(u * u + v * v)"})
scalar("wind_direction", "les", lambda: {"direction": wind.wind_direction("u", "v")}, {"direction": "((270 - degrees(atan2(v, u))) % 360 + 360) % 360"})
_uv = lambda: wind.wind_speed_direction_to_uv("speed", "direction")
scalar("wind_speed_direction_to_uv", "obs", lambda: {"u": _uv()[0], "v": _uv()[1]}, {"u": "-speed * sin(radians(direction))", "v": "-speed * cos(radians(direction))"})
scalar("angle_between", "les", lambda: {"angle": wind.angle_between(F.array("u", "v"), F.array("v", "w"))},
       {"angle": "degrees(acos(greatest(-1, least(1, (u * v + v * w) / nullif(sqrt(u * u + v * v) * sqrt(v * v + w * w), 0)))))"}, 5)
scalar("circular_error", "pairs", lambda: {"error": wind.circular_error("model_direction", "direction")}, {"error": "((model_direction - direction + 180) % 360 + 360) % 360 - 180"})
_turned = lambda: wind.rotate_vectors("u", "v", 33.0)
scalar("rotate_vectors", "les", lambda: {"x": _turned()[0], "y": _turned()[1]}, {"x": "u * cos(radians(33)) - v * sin(radians(33))", "y": "u * sin(radians(33)) + v * cos(radians(33))"})
_spun = lambda: wind.rotate_velocity("u", "v", "w", 20.0, 10.0)
_x = "(u * cos(radians(20)) - v * sin(radians(20)))"
scalar("rotate_velocity", "les", lambda: dict(zip("xyz", _spun())),
       {"x": f"{_x} * cos(radians(10)) + w * sin(radians(10))", "y": "u * sin(radians(20)) + v * cos(radians(20))", "z": f"-{_x} * sin(radians(10)) + w * cos(radians(10))"})
scalar("speed_up_ratio", "les", lambda: {"ratio": F.nanvl(wind.speed_up_ratio("u", "w", 0.25), F.lit(-1.0))}, {"ratio": "CASE WHEN abs(w) < 0.25 THEN -1 ELSE u / w END"})
scalar("stress_from_moment", "les", lambda: {"stress": wind.stress_from_moment("u", "v", c("sgs") + 1)}, {"stress": "u * v / (sgs + 1)"})

scalar("potential_temperature", "thermo", lambda: {"theta": thermo.potential_temperature(c("temp") - 280)}, {"theta": "temp - 280 + 300"})
scalar("temperature_from_potential", "thermo", lambda: {"t": thermo.temperature_from_potential("temp", "p")}, {"t": "temp * pow(p / 1e5, 287.05 / 1004.0)"})
scalar("virtual_temperature", "thermo", lambda: {"tv": thermo.virtual_temperature("temp", "r")}, {"tv": "temp * (1 + 0.61 * r)"})
scalar("air_density", "thermo", lambda: {"rho": thermo.air_density("p", "temp", "r")}, {"rho": "p / (287.05 * temp * (1 + 0.61 * r))"})
scalar("geopotential_height", "thermo", lambda: {"z": thermo.geopotential_height("p", "temp")}, {"z": "(p + temp) / 9.80665"})
scalar("mixing_ratio_to_specific_humidity", "thermo", lambda: {"q": thermo.mixing_ratio_to_specific_humidity("r")}, {"q": "r / (1 + r)"}, 8)
_rh = "greatest(0, least(100, 100 * (r * p / (0.622 + r)) / (611.2 * exp(17.67 * (temp - 273.15) / (temp - 273.15 + 243.5)))))"
scalar("relative_humidity", "thermo", lambda: {"rh": thermo.relative_humidity("temp", "p", "r")}, {"rh": _rh})
_g = "(ln(greatest(1e-6, least(100, u * 1.9)) / 100) + 17.625 * (temp - 273.15) / (243.04 + temp - 273.15))"
scalar("dew_point", "thermo", lambda: {"td": thermo.dew_point("temp", c("u") * 1.9)}, {"td": f"243.04 * {_g} / (17.625 - {_g}) + 273.15"})
scalar("equivalent_potential_temperature", "thermo", lambda: {"te": thermo.equivalent_potential_temperature("temp", "p", "r")},
       {"te": "temp * pow(1e5 / p, 287.05 / 1004.0) * exp(2.5e6 * r / (1004.0 * temp))"}, 5)
scalar("height_agl", "thermo", lambda: {"z": thermo.height_agl("p", "u")}, {"z": "p - u"})
scalar("reflectivity_to_rain_rate", "thermo", lambda: {"rate": thermo.reflectivity_to_rain_rate("u")}, {"rate": "pow(pow(10, u / 10) / 200, 1 / 1.6)"})

scalar("bulk_richardson_number", "thermo", lambda: {"rib": bl.bulk_richardson_number("temp", c("temp") + c("h"), F.lit(10.0), F.lit(100.0), "u", c("u") * 1.3, "v", c("v") * 1.1)},
       {"rib": "9.80665 / ((temp + (temp + h)) / 2) * ((temp + h) - temp) * 90 / greatest(pow(u * 1.3 - u, 2) + pow(v * 1.1 - v, 2), 2.220446049250313e-16)"})
scalar("power_law_exponent", "thermo", lambda: {"alpha": bl.power_law_exponent("u", c("u") + c("v"), 10.0, 80.0)}, {"alpha": "ln((u + v) / u) / ln(8)"})
scalar("friction_velocity", "thermo", lambda: {"ustar": bl.friction_velocity("h", c("r") + 1)}, {"ustar": "sqrt(abs(h) / (r + 1))"})
scalar("monin_obukhov_length", "thermo", lambda: {"length": bl.monin_obukhov_length("temp", c("r") + 0.3, "h")}, {"length": "-temp * pow(r + 0.3, 3) / (0.4 * 9.80665 * h)"}, 5)
scalar("roughness_length", "thermo", lambda: {"z0": bl.roughness_length("u", 10.0, c("r") + 3)}, {"z0": "10 * exp(-0.4 * u / (r + 3))"}, 8)
scalar("log_wind_profile", "thermo", lambda: {"speed": bl.log_wind_profile("u", 0.3, 0.1, 0.5)}, {"speed": "0.3 / 0.4 * ln((u - 0.5) / 0.1)"})
scalar("convective_velocity_scale", "thermo", lambda: {"w": bl.convective_velocity_scale("h", c("u") * 20, "temp")}, {"w": "cbrt(greatest(9.80665 * h / temp, 0) * u * 20)"})
_L = "(-temp * pow(r + 0.3, 3) / (0.4 * 9.80665 * h))"
scalar("stability_class", "thermo", lambda: {"stability": bl.stability_class(bl.monin_obukhov_length("temp", c("r") + 0.3, "h"))},
       {"stability": f"CASE WHEN {_L} < -200 THEN 'weak unstable' WHEN {_L} < -50 THEN 'unstable' WHEN {_L} < 0 THEN 'very unstable' WHEN {_L} = 0 OR {_L} IS NULL THEN 'neutral' "
                     f"WHEN {_L} <= 50 THEN 'very stable' WHEN {_L} <= 200 THEN 'stable' ELSE 'weak stable' END"}, None)

_f = lambda: (c("n") + 1) / 64
_F = "((n + 1) / 64.0::DOUBLE)"
for _k, (_a, _b) in {"u": (102, 33), "v": (17, 9.5), "w": (2, 5.3)}.items():
    scalar(f"kaimal_spectrum_{_k}", "signal", lambda k=_k: {"s": sm.kaimal_spectrum(_f(), 11.0, 90.0, c("label") * 0.05 + 0.2, k)},
           {"s": f"pow(label * 0.05 + 0.2, 2) * {_a} * (90 / 11.0::DOUBLE) / pow(1 + {_b} * {_F} * (90 / 11.0::DOUBLE), 5 / 3.0::DOUBLE)"})
scalar("iec_kaimal_spectrum", "signal", lambda: {"s": sm.iec_kaimal_spectrum(_f(), 11.0, 1.3, 340.2)}, {"s": f"4 * pow(1.3, 2) * (340.2 / 11.0::DOUBLE) / pow(1 + 6 * {_F} * (340.2 / 11.0::DOUBLE), 5 / 3.0::DOUBLE)"})
_t = f"pow({_F} * (340.2 / 11.0::DOUBLE), 2)"
scalar("von_karman_spectrum", "signal", lambda: {"u": sm.von_karman_spectrum(_f(), 11.0, 1.3, 340.2, "u"), "w": sm.von_karman_spectrum(_f(), 11.0, 1.3, 340.2, "w")},
       {"u": f"4 * pow(1.3, 2) * (340.2 / 11.0::DOUBLE) / pow(1 + 70.8 * {_t}, 5 / 6.0::DOUBLE)",
        "w": f"4 * pow(1.3, 2) * (340.2 / 11.0::DOUBLE) * (1 + 188.4 * {_t}) / pow(1 + 70.8 * {_t}, 11 / 6.0::DOUBLE)"}, 7)
scalar("exponential_coherence", "signal", lambda: {"coherence": sm.exponential_coherence(_f(), c("label") * 3 + 1, 11.0)}, {"coherence": f"exp(-12 * {_F} * (label * 3 + 1) / 11.0::DOUBLE)"})
scalar("premultiplied_spectrum", "signal", lambda: {"s": sm.premultiplied_spectrum(_f(), "x")}, {"s": f"{_F} * x"}, 7)


def _cheynet_sql(component: str, n: str) -> str:
    arms = []
    for low, high, values in sm.CHEYNET:
        kind, a, b, p, q = values[component]
        form = f"{a} * {n} / pow(1 + {b} * {n}, 5 / 3.0::DOUBLE) + {p} * {n} / (1 + {q} * pow({n}, 5 / 3.0::DOUBLE))" if kind == 26 else \
            f"{a} * pow({n}, -2 / 3.0::DOUBLE) + {b} * {n} / (1 + {p} * pow({n}, 5 / 3.0::DOUBLE)) + {q:.10f} * pow({n}, -2)"
        arms.append(f"WHEN zeta >= {low} AND zeta < {high} THEN {form}")
    return f"CASE {' '.join(arms)} END * pow(0.35, 2) / {_F}"


def _cheynet(spark, sf_dir):
    zeta = c("label") * 0.37 - 1.63
    made = [reg.rounded(sm.cheynet_spectrum(_f(), 11.0, 81.5, 0.35, zeta, k)).alias(k) for k in "uvw"]
    return views.signal(spark, sf_dir).select("vec_id", "n", *made)


_n = f"(81.5 / 11.0::DOUBLE * {_F})"
add("cheynet_spectrum", _cheynet, f"SELECT vec_id, n, {', '.join(f'round({_cheynet_sql(k, _n)}, 6) AS {k}' for k in 'uvw')} FROM (SELECT *, label * 0.37::DOUBLE - 1.63::DOUBLE AS zeta FROM ({views.SQL['signal']}))")
