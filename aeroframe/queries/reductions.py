"""Aggregates, scores and quality control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.operators import fields, quality, stats, turbulence
from aeroframe.operators import reports
from aeroframe.plans import views
from aeroframe.queries.registry import add, frame, grouped, rounded, scalar

c = F.col
_CORR = "coalesce(covar_pop(model, speed) / nullif(stddev_pop(model) * stddev_pop(speed), 0), 'nan'::DOUBLE)"

grouped("resolved_tke", "les", ["cell"], lambda: [turbulence.resolved_tke("u", "v", "w")], {"tke": "0.5 * (var_pop(u) + var_pop(v) + var_pop(w))"})
grouped("reynolds_flux", "les", ["cell"], lambda: [turbulence.reynolds_flux("u", "w")], {"uw": "covar_pop(u, w)"})
grouped("calculate_fluxes", "les", ["cell"], lambda: turbulence.calculate_fluxes("u", "v", "w"), {a + b: f"covar_pop({a}, {b})" for a, b in ("uu", "vv", "ww", "uv", "uw", "vw")})
grouped("calculate_total_tke", "les", ["cell"], lambda: [turbulence.calculate_total_tke("u", "v", "w", "sgs")], {"tke": "0.5 * (var_pop(u) + var_pop(v) + var_pop(w)) + avg(sgs)"})
grouped("turbulence_intensity", "les", ["cell"], lambda: [turbulence.turbulence_intensity("u"), turbulence.turbulence_intensity("v", False)],
        {"percent": "100 * stddev_pop(u) / abs(avg(u))", "share": "stddev_pop(v) / abs(avg(v))"})
scalar("sgs_tke", "les", lambda: {"tke": turbulence.sgs_tke("u", "v", "w")}, {"tke": "0.5 * (u + v + w)"})
scalar("fluctuations", "les", lambda: {"dv": turbulence.fluctuations("v", ["cell"])}, {"dv": "v - avg(v) OVER (PARTITION BY cell)"})
grouped("wind_power_density", "les", ["cell"], lambda: [stats.wind_power_density("w")], {"power": "0.5 * avg(1.225 * pow(w, 3))"})
frame("weibull_fit", "les", lambda df: stats.weibull_fit(df, "v", ["cell"]).select("cell", rounded("shape").alias("shape"), rounded("scale").alias("scale")),
      """SELECT cell, round(shape, 6) AS shape, round(mean / gamma(1 + 1 / shape), 6) AS scale
      FROM (SELECT cell, avg(v) AS mean, pow(stddev_pop(v) / avg(v), -1.086) AS shape FROM {view} WHERE v > 0 GROUP BY cell)""")

grouped("bias", "pairs", ["station"], lambda: [stats.bias("model", "speed")], {"bias": "avg(model - speed)"})
grouped("mae", "pairs", ["station"], lambda: [stats.mae("model", "speed")], {"mae": "avg(abs(model - speed))"})
grouped("rmse", "pairs", ["station"], lambda: [stats.rmse("model", "speed")], {"rmse": "sqrt(avg((model - speed) * (model - speed)))"})
grouped("correlation", "pairs", ["station"], lambda: [F.nanvl(stats.correlation("model", "speed"), F.lit(-9.0))], {"r": "coalesce(covar_pop(model, speed) / nullif(stddev_pop(model) * stddev_pop(speed), 0), -9)"})
grouped("normalized_error", "pairs", ["station"], lambda: [stats.normalized_error("model", "speed")], {"error": "sqrt(avg((model - speed) * (model - speed))) / avg(abs(speed))"})
grouped("circular_mae", "pairs", ["station"], lambda: [stats.circular_mae("model_direction", "direction")], {"mae": "avg(abs(((model_direction - direction + 180) % 360 + 360) % 360 - 180))"})
grouped("circular_mean", "obs", ["station"], lambda: [stats.circular_mean("direction", "speed")],
        {"direction": "((degrees(atan2(sum(speed * sin(radians(direction))), sum(speed * cos(radians(direction))))) % 360) + 360) % 360"})
grouped("standard_error", "obs", ["station"], lambda: [stats.standard_error("speed")], {"error": "stddev_samp(speed) / sqrt(count(speed))"})
_SUM = {"bias": "avg(model - speed)", "mae": "avg(abs(model - speed))", "rmse": "sqrt(avg((model - speed) * (model - speed)))", "correlation": _CORR}
grouped("comparison_summary", "pairs", ["kind"], lambda: stats.comparison_summary("model", "speed"), _SUM)
grouped("resolution_metrics", "pairs", [], lambda: stats.resolution_metrics("speed", "model"),
        {"bias": "avg(speed - model)", "mae": "avg(abs(model - speed))", "rmse": "sqrt(avg((model - speed) * (model - speed)))", "correlation": _CORR})


def _spatial(df: DataFrame) -> DataFrame:
    out = stats.spatial_scores(df.select("event_id", "model", "speed"), "model", "speed")
    return out.select("event_id", *[rounded(x).alias(x) for x in ("absolute_error", "squared_error", "bias", "mae", "rmse", "correlation")])


frame("spatial_scores", "pairs", _spatial, f"""SELECT event_id, round(abs(model - speed), 6) AS absolute_error, round((model - speed) * (model - speed), 6) AS squared_error,
  round(bias, 6) AS bias, round(mae, 6) AS mae, round(rmse, 6) AS rmse, round(correlation, 6) AS correlation
  FROM {{view}}, (SELECT {', '.join(f'{e} AS {k}' for k, e in _SUM.items())} FROM {{view}})""")
frame("rank_cases", "pairs", lambda df: stats.rank_cases(df, "kind", "model", "speed").select("kind", rounded("score").alias("score"), "rank"),
      "SELECT kind, round(score, 6) AS score, row_number() OVER (ORDER BY score, kind) AS rank FROM (SELECT kind, sqrt(avg((model - speed) * (model - speed))) AS score FROM {view} GROUP BY kind)")
frame("kantorovich_distance", "pairs", lambda df: stats.kantorovich_distance(df, "model", "speed", ["kind"]).select("kind", rounded("distance").alias("distance")),
      """SELECT kind, round(avg(abs(a - b)), 6) AS distance FROM (SELECT kind, model AS a, row_number() OVER (PARTITION BY kind ORDER BY model) AS n FROM {view})
      JOIN (SELECT kind, speed AS b, row_number() OVER (PARTITION BY kind ORDER BY speed) AS n FROM {view}) USING (kind, n) GROUP BY kind""")


def _compare(df: DataFrame) -> DataFrame:
    first, second = df.select(c("event_id").alias("time"), c("model").alias("a"), c("model_direction").alias("b")), df.select(c("event_id").alias("time"), c("speed").alias("a"), c("direction").alias("b"))
    out = stats.compare_outputs(first, second, ["a", "b"])
    return out.select("channel", *[rounded(x).alias(x) for x in ("bias", "mae", "rmse", "correlation")])


def _compare_sql(m: str, o: str, name: str) -> str:
    told = {k: e.replace("speed", "O_").replace("model", m).replace("O_", o) for k, e in _SUM.items()}
    return f"SELECT '{name}' AS channel, {', '.join(f'round({e}, 6) AS {k}' for k, e in told.items())} FROM {{view}}"


frame("compare_outputs", "pairs", _compare, f"{_compare_sql('model', 'speed', 'a')} UNION ALL {_compare_sql('model_direction', 'direction', 'b')}")
frame("comparison_report", "pairs", lambda df: reports.comparison_report(df, "model", "speed", "speed").select("label", "count", *[rounded(x).alias(x) for x in ("bias", "mae", "rmse", "correlation")]),
      f"SELECT 'speed' AS label, count(*) AS count, {', '.join(f'round({e}, 6) AS {k}' for k, e in _SUM.items())} FROM {{view}}")
_CH = "SELECT '{0}' AS channel, round(min({0}), 6) AS minimum, round(avg({0}), 6) AS mean, round(max({0}), 6) AS maximum, round(stddev_pop({0}), 6) AS std FROM {{view}}"
frame("channel_statistics", "les", lambda df: stats.channel_statistics(df, ["u", "v", "w"]).select("channel", *[rounded(x).alias(x) for x in ("minimum", "mean", "maximum", "std")]),
      " UNION ALL ".join(_CH.format(x) for x in "uvw"))
frame("landuse_statistics", "plane", lambda df: df.withColumn("x", F.when(c("i") != 3, c("x"))).groupBy("label").agg(*stats.class_statistics("x")).select("label", "count", *[rounded(x).alias(x) for x in ("mean", "std", "minimum", "maximum")]),
      """SELECT label, count(*) AS count, round(avg(x), 6) AS mean, round(stddev_pop(x), 6) AS std, round(min(x), 6) AS minimum, round(max(x), 6) AS maximum
      FROM (SELECT label, CASE WHEN i <> 3 THEN x END AS x FROM {view}) GROUP BY label""")
grouped("integral_conservation", "les", ["cell"], lambda: stats.integral_conservation("u", "v", F.lit(2.0), F.lit(4.0)),
        {"source_integral": "sum(u * 2)", "target_integral": "sum(v * 4)", "relative_error": "(sum(v * 4) - sum(u * 2)) / nullif(sum(u * 2), 0)"}, 5)
frame("diurnal_cycle", "obs", lambda df: stats.diurnal_cycle(df, "speed", F.hour("ts")).select("hour", rounded("mean").alias("mean")),
      "SELECT hour(ts)::INT AS hour, round(avg(speed), 6) AS mean FROM {view} GROUP BY 1")
frame("wind_rose", "obs", lambda df: stats.wind_rose_histogram(df, "direction", "speed"),
      """WITH o AS (SELECT floor(direction / 22.5)::INT AS d, least(floor(speed / max(speed) OVER () * 5), 4)::INT AS s FROM {view} WHERE speed >= 0)
      SELECT d.i::INT AS direction_bin, s.i::INT AS speed_bin, (SELECT count(*) FROM o WHERE o.d = d.i AND o.s = s.i) AS count FROM range(16) d(i), range(5) s(i)""")
grouped("fit_spectral_slope", "signal", ["vec_id"], lambda: stats.fit_spectral_slope(c("n") + 0.0, F.abs("x")),
        {"slope": "regr_slope(CASE WHEN n > 0 AND x <> 0 THEN log10(abs(x)) END, CASE WHEN n > 0 AND x <> 0 THEN log10(n) END)",
         "intercept": "regr_intercept(CASE WHEN n > 0 AND x <> 0 THEN log10(abs(x)) END, CASE WHEN n > 0 AND x <> 0 THEN log10(n) END)"}, 5)

_LIMITS = {"T2": (2.0, 300.0, "m")}


def _qc(spark, sf_dir):
    events = views.obs(spark, sf_dir).select(c("event_id").alias("t"), F.when(c("event_id") % 97 != 5, c("speed")).alias("T2"), (c("speed") - 1).alias("QRAIN"))
    found = quality.quality_control(events, ["T2", "QRAIN"], ["t"], time=None, limits=_LIMITS)
    return found.select("severity", "variable", "check", "count", F.get("first_index", F.lit(0)).alias("first_t"), rounded("first_value").alias("first_value"))


add("quality_control", _qc, """
WITH e AS (SELECT event_id AS t, CASE WHEN event_id % 97 <> 5 THEN value END AS t2, value - 1 AS q FROM events),
f AS (SELECT 'T2' AS variable, 'non-finite' AS "check", t, t2 AS v FROM e WHERE t2 IS NULL
  UNION ALL SELECT 'T2', 'physical-range', t, t2 FROM e WHERE t2 < 2 - 298e-12 OR t2 > 300 + 298e-12
  UNION ALL SELECT 'QRAIN', 'negative-water', t, q FROM e WHERE q < -1e-12)
SELECT 'ERROR' AS severity, variable, "check", count(*) AS count, min(t) AS first_t, round(min_by(v, t), 6) AS first_value FROM f GROUP BY variable, "check"
""")


def _jump(spark, sf_dir):
    daily = views.obs(spark, sf_dir).select(F.floor(c("event_id") / 100).cast("int").alias("t"), (c("speed") * F.when(F.floor(c("event_id") / 100) == 7, 9.0).otherwise(1.0)).alias("T2"))
    found = quality.quality_control(daily, ["T2"], ["t"], limits={"T2": (-1e9, 1e9, "")}, jump_sigma=3.0)
    return found.select("severity", "variable", "check", "count", F.get("first_index", F.lit(0)).alias("first_t"), rounded("first_value").alias("first_value"))


add("quality_control_jumps", _jump, """
WITH m AS (SELECT event_id // 100 AS t, avg(value * CASE WHEN event_id // 100 = 7 THEN 9 ELSE 1 END) AS m FROM events GROUP BY 1),
d AS (SELECT row_number() OVER (ORDER BY t) - 1 AS t, m - lag(m) OVER (ORDER BY t) AS d FROM m), e AS (SELECT * FROM d WHERE d IS NOT NULL),
o AS (SELECT *, abs(d - (SELECT median(d) FROM e)) AS o FROM e)
SELECT 'WARNING' AS severity, 'T2' AS variable, 'temporal-jump' AS "check", count(*) AS count, min(t) AS first_t, round(min_by(d, t), 6) AS first_value
FROM o WHERE o > 3 * 1.4826 * (SELECT median(o) FROM o) HAVING count(*) > 0
""")


def _quantised(df: DataFrame) -> DataFrame:
    field = df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "u", "v", "w")
    out = fields.quantise(field)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "cu", "cv", "cw", *[rounded(f"d{x}", 4).alias(f"d{x}") for x in "uvw"])


_S = ", ".join(f"(65535 / (max({x}) - min({x})))::FLOAT::DOUBLE AS s{x}, (-32768 - min({x}) * (65535 / (max({x}) - min({x}))))::FLOAT::DOUBLE AS o{x}" for x in "uvw")
_CODE = "greatest(-32768, least(32767, round_even({0} * s{0} + o{0}, 0)))"
frame("bts_scaling", "les", _quantised,
      "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, " + ", ".join(f"{_CODE.format(x)}::INT AS c{x}, round(({_CODE.format(x)} - o{x}) / s{x}, 4) AS d{x}" for x in "uvw") + f" FROM {{view}}, (SELECT {_S} FROM {{view}})")
frame("dataset_summary", "les", lambda df: reports.dataset_summary(df, ["cell"]).select("name", "kind", "distinct"),
      """SELECT * FROM (VALUES ('l_orderkey', 'variable', NULL::BIGINT), ('l_linenumber', 'variable', NULL), ('l_partkey', 'variable', NULL), ('l_suppkey', 'variable', NULL),
      ('u', 'variable', NULL), ('v', 'variable', NULL), ('w', 'variable', NULL), ('sgs', 'variable', NULL)) t(name, kind, "distinct") UNION ALL SELECT 'cell', 'dimension', count(DISTINCT cell) FROM {view}""")
