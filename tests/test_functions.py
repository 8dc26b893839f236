"""Known answers of the scalar functions."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.functions import boundary_layer as bl
from aeroframe.functions import spectra_models as sm
from aeroframe.functions import thermo, wind


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()[0]


KNOWN = {
    "speed": (lambda: wind.wind_speed(3, 4), 5), "north": (lambda: wind.wind_direction(0, -1), 0), "calm": (lambda: wind.wind_direction(0, 0), 270),
    "wrap": (lambda: wind.circular_error(1, 359), 2), "theta": (lambda: thermo.potential_temperature(2), 302),
    "rain": (lambda: thermo.reflectivity_to_rain_rate(10 * math.log10(200)), 1), "ustar": (lambda: bl.friction_velocity(1, 1), 1),
    "wstar": (lambda: bl.convective_velocity_scale(-1, 500, 300), 0), "humid": (lambda: thermo.relative_humidity(300, 1e5, 1.0), 100),
    "stress": (lambda: wind.stress_from_moment(6, 2, 3), 4), "coherent": (lambda: sm.exponential_coherence(0, 5, 10), 1),
    "shear": (lambda: bl.power_law_exponent(5, 10, 10, 100), math.log(2) / math.log(10)),
}


@pytest.mark.parametrize("name", KNOWN)
def test_known_values(spark, name):
    c, expected = KNOWN[name]
    assert value(spark, c()) == pytest.approx(expected)


def test_nan_where_there_is_no_answer(spark):
    for c in (bl.monin_obukhov_length(300, 0.3, 0), wind.speed_up_ratio(1, 0.05), bl.log_wind_profile(1, 0.3, 0.1, 2), wind.angle_between(F.array(F.lit(0.0)), F.array(F.lit(1.0)))):
        assert math.isnan(value(spark, c))


def test_rotation(spark):
    x, y = wind.rotate_vectors(1, 0, 90)
    assert value(spark, x) == pytest.approx(0) and value(spark, y) == pytest.approx(1)
    u, v = wind.wind_speed_direction_to_uv(10, 90)
    assert value(spark, u) == pytest.approx(-10) and value(spark, v) == pytest.approx(0)


@pytest.mark.parametrize("length, name", [(-300, "weak unstable"), (-200, "unstable"), (-50, "very unstable"), (0, "neutral"), (50, "very stable"), (200, "stable"), (201, "weak stable"), (float("nan"), "neutral")])
def test_stability_bins(spark, length, name):
    assert value(spark, bl.stability_class(length)) == name


@pytest.mark.parametrize("component", ["u", "v", "w"])
def test_marine_spectrum_is_finite_in_every_bin(spark, component):
    zeta = [-1.5, -0.7, -0.4, -0.2, 0.0, 0.2, 0.4, 0.7, 1.5]
    df = spark.createDataFrame([(z, f) for z in zeta for f in (0.01, 0.1, 1.0)], "z double, f double")
    got = [r[0] for r in df.select(sm.cheynet_spectrum("f", 10, 80, 0.4, "z", component)).collect()]
    assert all(np.isfinite(got)) and min(got) >= 0


def test_models_reject_bad_input(spark):
    with pytest.raises(ValueError):
        sm.kaimal_spectrum(1, 1, 1, 1, "x")
    with pytest.raises(Exception, match="stability"):
        value(spark, sm.cheynet_spectrum(1, 10, 80, 0.4, 2.0))


def test_no_cell_raises(spark):
    """Zeros, NaN and NULL in any argument give a value, NaN or NULL, under ANSI arithmetic too."""
    from aeroframe.functions import boundary_layer as b
    from aeroframe.functions import spectra_models as m
    from aeroframe.functions import thermo as t

    assert spark.conf.get("spark.sql.ansi.enabled") == "true"
    made = [
        (b.bulk_richardson_number, 8), (b.power_law_exponent, 4), (b.friction_velocity, 2), (b.monin_obukhov_length, 3), (b.roughness_length, 3),
        (b.log_wind_profile, 3), (b.convective_velocity_scale, 3), (t.relative_humidity, 3), (t.dew_point, 2), (t.equivalent_potential_temperature, 3),
        (t.mixing_ratio_to_specific_humidity, 1), (m.kaimal_spectrum, 4), (m.iec_kaimal_spectrum, 4), (m.von_karman_spectrum, 4), (m.exponential_coherence, 3),
    ]
    odd = [0.0, float("nan"), None, -1.0, -243.5, 29.65, 30.11, 1.0]
    names = "abcdefgh"
    rows = [tuple(odd[(k + n * s) % len(odd)] for n in range(8)) for s in range(8) for k in range(len(odd))] + [(x,) * 8 for x in odd]
    df = spark.createDataFrame(rows, ", ".join(f"{x} double" for x in names))
    got = df.select(*[f(*names[:n]).alias(f.__name__) for f, n in made]).collect()
    assert len(got) == len(rows)


def test_synthetic_field_falls_off_with_its_length(spark):
    """Two lengths with the same noise: spectra differ by the ratio of their responses."""
    import numpy as np

    from aeroframe.operators import fields

    planes = {}
    for length in (20.0, 60.0):
        df = fields.synthetic_wind_field(spark, 0.0, 2, 16, 16, 1.0, 10.0, 10.0, length_scale=length, seed=5).orderBy("t", "k", "j").toPandas()
        planes[length] = np.fft.fft2(df["u"].to_numpy().reshape(2, 16, 16))
    k = np.hypot(np.fft.fftfreq(16, 10.0)[:, None], np.fft.fftfreq(16, 10.0)[None, :])
    ratio = np.abs(planes[60.0] / planes[20.0]) / np.exp(-0.5 * k * 40.0)
    assert np.allclose(ratio, ratio[0, 1, 1], rtol=1e-6)
