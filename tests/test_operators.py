"""Known answers of reductions, neighbours, geometry and spectra."""

import math
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from aeroframe.operators import fields, grid, neighbour, quality, relate, spectral, stats, turbulence


def rows(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


def series(spark, values, name="x"):
    return spark.createDataFrame([(0, n, float(v) if v is not None else None) for n, v in enumerate(values)], f"g int, n int, {name} double")


def test_scores_and_missing_values(spark):
    df = spark.createDataFrame([(1.0, 1.0), (3.0, 1.0), (float("nan"), 2.0)], "m double, o double")
    got = df.agg(stats.rmse("m", "o").alias("rmse"), stats.bias("m", "o").alias("bias"), stats.correlation("m", "o").alias("r")).first()
    assert got["rmse"] == pytest.approx(math.sqrt(2)) and got["bias"] == 1 and math.isnan(got["r"])
    flat = spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "m double, o double").agg(stats.correlation("m", "o")).first()[0]
    assert math.isnan(flat)


def test_tke_and_intensity(spark):
    df = spark.createDataFrame([(0.0, 0.0, 0.0), (2.0, 0.0, 0.0)], "u double, v double, w double")
    got = df.agg(turbulence.resolved_tke("u", "v", "w").alias("k"), turbulence.turbulence_intensity("u").alias("ti"), turbulence.turbulence_intensity("v").alias("none")).first()
    assert got["k"] == 0.5 and got["ti"] == 100 and math.isnan(got["none"])


def test_transport_distance(spark):
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, 1.0, 2.0), (1, 0.0, None), (1, 2.0, 1.0), (1, 4.0, 3.0)], "g int, a double, b double")
    assert rows(stats.kantorovich_distance(df, "a", "b", ["g"]), "g") == [(0, 1.0), (1, pytest.approx((1 + 0 + 1) / 3))]


def test_weibull_shape_recovered(spark):
    x = np.random.default_rng(1).weibull(2.0, 20_000) * 8
    got = stats.weibull_fit(spark.createDataFrame([(0, float(v)) for v in x], "g int, x double"), "x", ["g"]).first()
    assert got["shape"] == pytest.approx(2, abs=0.06) and got["scale"] == pytest.approx(8, abs=0.15)
    assert math.isnan(stats.weibull_fit(spark.createDataFrame([(0, 1.0)], "g int, x double"), "x", ["g"]).first()["shape"])


def test_increments(spark):
    df = series(spark, [1, 3, 6])
    got = rows(df.select("n", neighbour.interval_precipitation("x", ["g"], "n"), neighbour.interval_precipitation("x", ["g"], "n", True)), "n")
    assert got == [(0, 0.0, 1.0), (1, 2.0, 2.0), (2, 3.0, 3.0)]
    got = neighbour.precipitation_diagnostics(series(spark, [0, 1, 0.5, 3]), "x", ["g"], "n").first()
    assert (got["maximum_interval"], got["accumulated"], got["wet_intervals"]) == (2.5, 3.5, 2)


def test_gradient_matches_numpy(spark):
    x = np.random.default_rng(3).normal(size=9)
    got = [r[1] for r in rows(series(spark, x).select("n", neighbour.gradient("x", ["g"], "n", 2.0)), "n")]
    assert got == pytest.approx(np.gradient(x, 2.0))


def test_unwrap_matches_numpy(spark):
    x = np.random.default_rng(4).uniform(0, 360, 40)
    got = [r["y"] for r in neighbour.unwrapped(series(spark, x), "x", ["g"], "n", "y").orderBy("n").collect()]
    assert got == pytest.approx(np.degrees(np.unwrap(np.radians(x))))


def test_jet_and_mixed_layer(spark):
    df = spark.createDataFrame([(0, 0, 10.0, 3.0, 300.0), (0, 1, 100.0, 10.0, 300.2), (0, 2, 300.0, 6.0, 301.0)], "g int, k int, z double, s double, th double")
    jet = neighbour.low_level_jet(df, "s", "z", ["g"], "k").first()
    assert jet["detected"] and jet["core_height"] == 100
    assert neighbour.diagnose_pbl_height(df, "th", "z", ["g"], "k").first()["pbl_height"] == 300
    assert math.isnan(neighbour.diagnose_pbl_height(df, "th", "z", ["g"], "k", 5.0).first()["pbl_height"])


def test_interpolation(spark):
    df = spark.createDataFrame([(0, k, z, s) for k, (z, s) in enumerate([(0.0, 5.0), (50.0, 7.0), (100.0, 9.0), (150.0, 10.0)])], "g int, k int, z double, s double")
    got = {r["level"]: r["s"] for r in grid.interpolate_height(df, "s", "z", ["g"], [25, 125, 150, 151]).collect()}
    assert got[25] == 6 and got[125] == 9.5 and got[150] == 10 and math.isnan(got[151])
    lone = grid.interpolate_to_levels(df.where("k = 0"), "s", "z", ["g"], [0.0]).first()["s"]
    assert math.isnan(lone)


def test_plane_geometry(spark):
    plane = spark.createDataFrame([(0, j, i, float(4 * j + i)) for j in range(4) for i in range(4)], "g int, j int, i int, x double")
    assert [r[3] for r in rows(grid.top_hat_coarsen(plane, "x", 2, ["g"], (4, 4)).select("g", "j", "i", "x"), "j", "i")] == [2.5, 4.5, 10.5, 12.5]
    with pytest.raises(ValueError):
        grid.top_hat_coarsen(plane, "x", 3, ["g"], (4, 4))
    got = grid.regrid_regular(plane, "x", [0, 1, 2, 3], [0, 1, 2, 3], [-1.0, 1.5], [0.5], ["g"])
    assert [r["x"] for r in got.orderBy("i").collect()] == pytest.approx([1.0, 3.5])
    line = grid.transect(plane, "x", (0, 0), (3, 3), ["g"], (4, 4), 3)
    assert [r["x"] for r in line.orderBy("point").collect()] == pytest.approx([0, 7.5, 15])
    assert grid.boundary_discontinuity(plane, "x", (4, 4), ["g"]).first()["interior_mean"] == 7.5


def test_nearest_cell_ties_go_to_the_first(spark):
    df = spark.createDataFrame([(j, i, 50.0 + j, 3.0 + i) for j in range(2) for i in range(2)], "j int, i int, lat double, lon double")
    got = grid.nearest_grid_point(df, 51, 3.9).first()
    assert (got["j"], got["i"]) == (1, 1)
    same = df.withColumn("lat", F.lit(1.0)).withColumn("lon", F.lit(1.0))
    assert tuple(grid.nearest_grid_point(same, 5, 5).first())[:2] == (0, 0)
    assert grid.subset_by_bounds(df, 2.5, 3.5, 49.5, 50.5).count() == 1
    assert grid.point(df.withColumn("v", F.lit(1)), 51, 4).count() == 1


def test_as_of_join(spark):
    model = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2020-01-01 00:00:00', 1.0D), (TIMESTAMP_NTZ '2020-01-01 00:10:00', 2.0D) t(time, m)")
    seen = spark.sql("SELECT * FROM VALUES (TIMESTAMP_NTZ '2020-01-01 00:04:00', 'a'), (TIMESTAMP_NTZ '2020-01-01 00:05:00', 'b'), (TIMESTAMP_NTZ '2020-01-01 00:30:00', 'c'), (TIMESTAMP_NTZ '2020-01-01 00:10:00', 'd') t(time, id)")
    got = {r["id"]: r["m"] for r in relate.align(model, seen, ["m"], tolerance=600).collect()}
    assert got == {"a": 1.0, "b": 2.0, "c": None, "d": 2.0}


def test_quality_rules(spark):
    df = spark.createDataFrame([(0, 290.0, 0.0), (1, 500.0, 60.0), (2, None, 60.0)], "t int, T2 double, XTIME double")
    got = {r["check"]: r for r in quality.quality_control(df, ["T2"], ["t"], "t", "XTIME").collect()}
    assert got["physical-range"]["first_index"] == [1] and got["physical-range"]["first_value"] == 500
    assert got["non-finite"]["count"] == 1 and got["time-coordinate"]["count"] == 1
    assert "PASS" in quality.report_text([])


def _jumps_by_numpy(means, sigma):
    d = np.diff(means)
    off = np.abs(d - np.nanmedian(d))
    at = np.flatnonzero(off > sigma * 1.4826 * np.nanmedian(off))
    return len(at), [int(at[0]) + 1], float(d[at[0]])


@pytest.mark.parametrize("steps, missing", [(60, 0.4), (5000, 0.01)])
def test_jumps_of_a_series(spark, steps, missing):
    rng = np.random.default_rng(steps)
    means = np.where(rng.random(steps) < missing, np.nan, rng.normal(280, 1, steps))
    means[steps // 2 - 1 : steps // 2 + 2] = 280, 330, 281
    df = spark.createDataFrame([(t, float(x)) for t, x in enumerate(means)], "t int, T2 double")
    stop = threading.Timer(120, spark.sparkContext.cancelAllJobs)  # a long series must not take the square of its length
    stop.start()
    try:
        got = quality.quality_control(df, ["T2"], ["t"], jump_sigma=6.0).where("check = 'temporal-jump'").first()
    finally:
        stop.cancel()
    count, index, value = _jumps_by_numpy(means, 6.0)
    assert (got["count"], got["first_index"]) == (count, index) and got["first_value"] == pytest.approx(value)


def test_even_and_uneven_clocks(spark):
    for clock, found in (([0, 60, 120, 180], 0), ([0, 60, 120, 190], 1), ([0, 60, 60, 120], 1), ([5], 0), ([180, 120, 60, 0], 1)):
        df = spark.createDataFrame([(t, 290.0, float(x)) for t, x in enumerate(clock)], "t int, T2 double, XTIME double")
        assert quality.quality_control(df, ["T2"], ["t"], "t", "XTIME").where("check = 'time-coordinate'").count() == found


def test_spectra(spark):
    n = np.arange(400)
    df = series(spark, np.sin(2 * np.pi * 2 * n / 20))
    psd = spectral.welch_spectrum(df, "x", ["g"], "n", 20.0, 200, 100).toPandas()
    assert psd["frequency"][psd["power"].argmax()] == pytest.approx(2.0)
    noisy = series(spark, np.random.default_rng(0).normal(size=400))
    assert spectral.coherence(noisy, "x", "x", ["g"], "n", 20.0, 200, 100).agg(F.min("coherence")).first()[0] > 0.99
    for size in (63, 64):
        some = series(spark, np.random.default_rng(1).normal(size=size))
        a = spectral.power_spectrum(some, "x", ["g"], "n", 0.5).orderBy("bin").toPandas()
        b = spectral.power_spectrum_relational(some, "x", ["g"], "n", size, 0.5).orderBy("bin").toPandas()
        assert a["power"].to_numpy() == pytest.approx(b["power"].to_numpy(), abs=1e-9)
    slope = spark.createDataFrame([(float(f), float(f) ** (-5 / 3)) for f in range(0 + 1, 50)], "f double, s double").agg(*stats.fit_spectral_slope("f", "s")).first()
    assert slope["slope"] == pytest.approx(-5 / 3)


def test_filter_keeps_the_long_wave(spark):
    j, i = np.indices((8, 128))
    wave, noise = np.sin(2 * np.pi * i / 32), 0.5 * np.sin(np.pi * i)
    df = spark.createDataFrame([(0, int(a), int(b), float(x)) for a, b, x in zip(j.ravel(), i.ravel(), (wave + noise).ravel())], "g int, j int, i int, x double")
    low = spectral.butterworth_spatial(df, "x", ["g"], 1.0, 8.0, 4).orderBy("j", "i").toPandas()["x"].to_numpy()
    high = spectral.butterworth_spatial(df, "x", ["g"], 1.0, 8.0, 4, kind="highpass").count()
    assert np.std(low - wave.ravel()) < 0.08 and high == 8 * 128
    assert spectral.spectral_downsample(df, "x", ["g"], 2).count() == 4 * 64
    with pytest.raises(ValueError):
        spectral.butterworth_band(df, "x", ["g"], 1.0, 8.0, 4.0)


def test_rainflow():
    # the worked example of the counting standard
    x = np.array([-2, 1, -3, 5, -1, 3, -4, 4, -2], float)
    found = sorted(spectral.rainflow(x))
    assert found == sorted([(3.0, 0.5), (4.0, 0.5), (4.0, 1.0), (8.0, 0.5), (9.0, 0.5), (8.0, 0.5), (6.0, 0.5)])
    assert spectral.rainflow(np.array([1.0])) == []


def test_clusters_keep_empty_centres(spark):
    df = spark.createDataFrame([(0, [0.0, 0.1]), (1, [0.2, 0.0]), (2, [10.0, 10.0]), (3, [9.8, 10.1])], "id int, v array<double>")
    got = dict(rows(stats.cluster_profiles(df, "id", "v", [[0.0, 0.0], [9.0, 9.0], [500.0, 500.0]], 4), "id"))
    assert got == {0: 0, 1: 0, 2: 1, 3: 1}


def test_fields(spark):
    step = fields.step_field(spark, [5, 10], 1.0, 0.5, 1, 1)
    assert [r["u"] for r in step.orderBy("t").collect()] == [5, 5, 10, 10]
    meta = fields.FieldMeta(4, 1, 1, 1.0, 1.0, 0.5, 0.0, 0.0)
    both, joined = fields.concatenate_fields([(step, meta), (step, meta)])
    assert both.count() == 8 and joined.nt == 8 and joined.mean_speed == 7.5
    with pytest.raises(ValueError):
        fields.from_components(step, ("u", "v", "w"), "t", "k", "j", (4, 1, 1), ("u", "u", "w"))
    with pytest.raises(Exception, match="finite"):
        fields.check_finite(step.withColumn("u", F.lit(float("nan")))).collect()
    made = fields.synthetic_wind_field(spark, 8.0, 6, 4, 4, 0.5, 10.0, 10.0, sigma=1.5, seed=2)
    again = fields.synthetic_wind_field(spark, 8.0, 6, 4, 4, 0.5, 10.0, 10.0, sigma=1.5, seed=2)
    assert fields.max_error(made, again).first()["max_abs_error"] == 0
    assert made.agg(F.stddev_pop("v")).first()[0] == pytest.approx(1.5)


def test_as_of_join_across_buckets(spark):
    rng = np.random.default_rng(7)
    model = [(int(g), int(t), float(n)) for n, (g, t) in enumerate(zip(rng.integers(0, 3, 60), rng.integers(0, 4000, 60)))]
    seen = [(int(g), int(t), n) for n, (g, t) in enumerate(zip(rng.integers(0, 4, 200), rng.integers(0, 4000, 200)))]
    stamped = lambda rows, names: spark.createDataFrame(rows, names).withColumn("time", F.timestamp_seconds("s")).drop("s")
    m, o = stamped(model, "g int, s int, m double"), stamped(seen, "g int, s int, id int")
    want = {}
    for g, t, n in seen:
        near = sorted((abs(t - s), -s, -v) for h, s, v in model if h == g)
        want[n] = -near[0][2] if near and near[0][0] <= 300 else None
    for bucket in (10.0, 700.0, 1e9):
        assert {r["id"]: r["m"] for r in relate.align(m, o, ["m"], by=["g"], tolerance=300, bucket=bucket).collect()} == want


def test_missing_neighbour_is_not_an_end(spark):
    got = [r[1] for r in rows(series(spark, [1, None, 4, 8]).select("n", neighbour.gradient("x", ["g"], "n")), "n")]
    assert got == [None, 1.5, None, 4.0]


def test_transport_distance_by_ranks(spark):
    rng = np.random.default_rng(9)
    for n, m in ((1, 7), (7, 3), (5, 5), (2, 9)):
        a, b = rng.normal(size=n), rng.normal(size=m)
        levels = np.linspace(0, 1, max(n, m))
        want = np.abs(np.quantile(a, levels) - np.quantile(b, levels)).mean()
        df = spark.createDataFrame([(None, float(x), None) for x in a] + [(None, None, float(x)) for x in b], "g int, a double, b double")
        for by in (["g"], []):
            assert stats.kantorovich_distance(df, "a", "b", by).first()["distance"] == pytest.approx(want)
    none = spark.createDataFrame([(1, 1.0, None)], "g int, a double, b double")
    assert stats.kantorovich_distance(none, "a", "b", ["g"]).first()["distance"] is None


def test_time_scale_and_levels_with_gaps(spark):
    x = np.array([1.0, 0.0, -1.0, 0.0])
    assert neighbour.integral_time_scale(series(spark, x), "x", ["g"], "n").first()["time_scale"] == 0
    assert math.isnan(neighbour.integral_time_scale(series(spark, [2.0] * 3), "x", ["g"], "n").first()["time_scale"])
    assert math.isnan(neighbour.integral_time_scale(series(spark, [2.0, None, 3.0]), "x", ["g"], "n").first()["time_scale"])
    df = spark.createDataFrame([(0, 0.0, 1.0), (0, None, 9.0), (0, 10.0, None), (0, 20.0, 3.0), (1, None, 1.0)], "g int, z double, x double")
    got = {(r["g"], r["level"]): r["x"] for r in grid.interpolate_to_levels(df, "x", "z", ["g"], [5.0, 20.0, 30.0]).collect()}
    assert got[0, 5.0] == 1.5 and got[0, 20.0] == 3 and math.isnan(got[0, 30.0]) and math.isnan(got[1, 5.0]) and len(got) == 6
