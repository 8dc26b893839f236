"""Window, event and time operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.operators import neighbour as nb
from aeroframe.operators import relate, turbulence
from aeroframe.plans import views
from aeroframe.queries.registry import add, frame, rounded, scalar

# ruff: noqa: E731
c = F.col


def grad(e: str, part: str, order: str, step: str = "1") -> str:
    """Central differences in SQL."""
    w = f"OVER (PARTITION BY {part} ORDER BY {order})"
    return f"coalesce((lead({e}) {w} - lag({e}) {w}) / (2 * {step}), (lead({e}) {w} - {e}) / {step}, ({e} - lag({e}) {w}) / {step})"


scalar("gradient", "signal", lambda: {"d": nb.gradient("x", ["vec_id"], "n")}, {"d": grad("x", "vec_id", "n")}, 7)
scalar("inversion_layers", "profile", lambda: {"inversion": nb.inversion_layers("x", "z", ["vec_id"], "k")}, {"inversion": f"{grad('x', 'vec_id', 'k')} / {grad('z', 'vec_id', 'k')} > 0.001"}, None)
scalar("brunt_vaisala_frequency", "profile", lambda: {"n": nb.brunt_vaisala_frequency(c("x") + 290, "z", ["vec_id"], "k")},
       {"n": f"sqrt(greatest(9.80665 / (x + 290) * ({grad('(x + 290)', 'vec_id', 'k')} / {grad('z', 'vec_id', 'k')}), 0))"})
_k = lambda: nb.horizontal_kinematics("x", c("x") * c("i"), "j", "i", ["vec_id"], 100.0, 50.0)
_ux, _uy, _vx, _vy = grad("x", "vec_id, j", "i", "100"), grad("x", "vec_id, i", "j", "50"), grad("(x * i)", "vec_id, j", "i", "100"), grad("(x * i)", "vec_id, i", "j", "50")
scalar("horizontal_kinematics", "plane", lambda: dict(zip(("divergence", "vorticity", "normal_strain", "shear_strain"), _k())),
       {"divergence": f"{_ux} + {_vy}", "vorticity": f"{_vx} - {_uy}", "normal_strain": f"{_ux} - {_vy}", "shear_strain": f"{_vx} + {_uy}"}, 8)
_t = lambda: nb.terrain_metrics(c("x") * 100, "j", "i", ["vec_id"], 30.0, 30.0)
_sx, _sy = grad("(x * 100)", "vec_id, j", "i", "30"), grad("(x * 100)", "vec_id, i", "j", "30")
scalar("terrain_metrics", "plane", lambda: dict(zip(("slope", "slope_degrees", "aspect"), _t())),
       {"slope": f"sqrt(pow({_sx}, 2) + pow({_sy}, 2))", "slope_degrees": f"degrees(atan(sqrt(pow({_sx}, 2) + pow({_sy}, 2))))", "aspect": f"((270 - degrees(atan2({_sy}, {_sx}))) % 360 + 360) % 360"}, 5)


def _q(df: DataFrame) -> DataFrame:
    box = df.select("vec_id", (c("n") % 4).alias("i"), (F.floor(c("n") / 4) % 4).alias("j"), F.floor(c("n") / 16).alias("k"), "x", (c("x") * 2 + c("n") % 4).alias("y"), (c("x") * c("x")).alias("z"))
    return box.select("vec_id", "k", "j", "i", rounded(nb.q_criterion("x", "y", "z", "k", "j", "i", ["vec_id"], 2.0, 3.0, 4.0), 7).alias("q"))


def _q_sql() -> str:
    axes = (("i", "vec_id, k, j", "2"), ("j", "vec_id, k, i", "3"), ("k", "vec_id, j, i", "4"))
    cells = ", ".join(f"{grad(v, p, o, s)} AS {v}{o}" for v in "xyz" for o, p, s in axes)
    names = [[f"{v}{o}" for o in "ijk"] for v in "xyz"]
    turn = " + ".join(f"pow(({names[a][b]} - {names[b][a]}) / 2, 2)" for a in range(3) for b in range(3))
    strain = " + ".join(f"pow(({names[a][b]} + {names[b][a]}) / 2, 2)" for a in range(3) for b in range(3))
    return f"""WITH b AS (SELECT vec_id, n % 4 AS i, n // 4 % 4 AS j, n // 16 AS k, x, x * 2 + n % 4 AS y, x * x AS z FROM {{view}}), g AS (SELECT vec_id, k, j, i, {cells} FROM b)
    SELECT vec_id, k, j, i, round(0.5 * (({turn}) - ({strain})), 7) AS q FROM g"""


frame("q_criterion", "signal", _q, _q_sql())
frame("destagger", "signal", lambda df: nb.destagger(df, ["x"], ["vec_id"], "n").select("vec_id", "n", rounded("x", 7).alias("x")),
      "SELECT vec_id, n, round((x + x2) / 2, 7) AS x FROM (SELECT vec_id, n, x, lead(x) OVER (PARTITION BY vec_id ORDER BY n) AS x2 FROM {view}) WHERE x2 IS NOT NULL")
frame("destagger_all", "plane", lambda df: nb.destagger_all(df, ["x"], ["vec_id", "j", "i"], ["j", "i"]).select("vec_id", "j", "i", rounded("x", 7).alias("x")),
      """SELECT vec_id, j, i, round(((x + xj) / 2 + lead((x + xj) / 2) OVER (PARTITION BY vec_id, j ORDER BY i)) / 2, 7) AS x
      FROM (SELECT *, lead(x) OVER (PARTITION BY vec_id, i ORDER BY j) AS xj FROM {view}) WHERE xj IS NOT NULL QUALIFY lead(i) OVER (PARTITION BY vec_id, j ORDER BY i) IS NOT NULL""")
frame("interval_precipitation", "accum", lambda df: df.select("cell", "ord", rounded(nb.interval_precipitation("acc", ["cell"], ["ts", "ord"])).alias("step"), rounded(nb.interval_precipitation("acc", ["cell"], ["ts", "ord"], True)).alias("from_zero")),
      "SELECT cell, ord, round(coalesce(acc - lag(acc) OVER w, 0), 6) AS step, round(acc - coalesce(lag(acc) OVER w, 0), 6) AS from_zero FROM {view} WINDOW w AS (PARTITION BY cell ORDER BY ts, ord)")
frame("precipitation_diagnostics", "accum", lambda df: nb.precipitation_diagnostics(df, "acc", ["cell"], ["ts", "ord"]).select("cell", rounded("maximum_interval").alias("maximum_interval"), rounded("accumulated").alias("accumulated"), "wet_intervals"),
      """SELECT cell, round(max(s), 6) AS maximum_interval, round(sum(s), 6) AS accumulated, count(*) FILTER (s >= 0.1) AS wet_intervals
      FROM (SELECT cell, greatest(coalesce(acc - lag(acc) OVER (PARTITION BY cell ORDER BY ts, ord), 0), 0) AS s FROM {view}) GROUP BY cell""")
frame("precipitation_steps", "accum", lambda df: nb.precipitation_steps(df, "acc", ["cell"], ["ts", "ord"]).select("cell", "ord", rounded("accumulated").alias("accumulated"), rounded("increment").alias("increment"), "wet"),
      """SELECT cell, ord, round(acc, 6) AS accumulated, round(s, 6) AS increment, s >= 0.1 AS wet
      FROM (SELECT cell, ord, acc, greatest(coalesce(acc - lag(acc) OVER (PARTITION BY cell ORDER BY ts, ord), 0), 0) AS s FROM {view})""")
frame("diagnose_pbl_height", "profile", lambda df: nb.diagnose_pbl_height(df, "x", "z", ["vec_id"], "k", 5.0).select("vec_id", F.nanvl("pbl_height", F.lit(-1.0)).alias("pbl_height")),
      "SELECT vec_id, coalesce(min(z) FILTER (x - x0 >= 5), -1) AS pbl_height FROM (SELECT *, first(x) OVER (PARTITION BY vec_id ORDER BY k) AS x0 FROM {view}) GROUP BY vec_id")
frame("low_level_jet", "profile", lambda df: nb.low_level_jet(df, "x", "z", ["vec_id"], "k").select("vec_id", rounded("core_speed").alias("core_speed"), "core_height", rounded("drop_above").alias("drop_above"), "detected"),
      """SELECT vec_id, round(x, 6) AS core_speed, z AS core_height, round(x - top, 6) AS drop_above, x >= 8 AND x - top >= 2 AND k > 0 AND k < 63 AS detected
      FROM (SELECT *, last(x) OVER (PARTITION BY vec_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS top FROM {view}) QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, k) = 1""")
frame("temporal_diagnostics", "obs", lambda df: nb.temporal_diagnostics(df, "speed", ["station"], ["ts", "event_id"]).select("station", rounded("mean").alias("mean"), rounded("ramp_threshold").alias("ramp_threshold"), "ramps", rounded("lag1_correlation").alias("lag1_correlation")),
      """WITH s AS (SELECT station, speed, lag(speed) OVER (PARTITION BY station ORDER BY ts, event_id) AS b FROM {view}),
      t AS (SELECT *, 2 * stddev_pop(speed - b) OVER (PARTITION BY station) AS lim FROM s)
      SELECT station, round(avg(speed), 6) AS mean, round(any_value(lim), 6) AS ramp_threshold, count(*) FILTER (abs(speed - b) >= lim) AS ramps,
      round(covar_pop(b, CASE WHEN b IS NOT NULL THEN speed END) / (stddev_pop(b) * stddev_pop(CASE WHEN b IS NOT NULL THEN speed END)), 6) AS lag1_correlation FROM t GROUP BY station""")
frame("temporal_events", "obs", lambda df: nb.temporal_events(df, "speed", ["station"], ["ts", "event_id"]).select("event_id", rounded("anomaly").alias("anomaly"), rounded("increment").alias("increment"), "ramp"),
      """WITH s AS (SELECT event_id, station, speed - avg(speed) OVER (PARTITION BY station) AS a, speed - lag(speed) OVER (PARTITION BY station ORDER BY ts, event_id) AS d FROM {view})
      SELECT event_id, round(a, 6) AS anomaly, round(d, 6) AS increment, abs(d) >= 2 * stddev_pop(d) OVER (PARTITION BY station) AS ramp FROM s""")
frame("zero_crossing_frequency", "signal", lambda df: nb.zero_crossing_frequency(df, "x", ["vec_id"], "n", 20.0).select("vec_id", rounded("frequency").alias("frequency")),
      """WITH d AS (SELECT vec_id, n, x - avg(x) OVER (PARTITION BY vec_id) < 0 AS s FROM {view}), e AS (SELECT vec_id, s <> lag(s) OVER (PARTITION BY vec_id ORDER BY n) AS x FROM d)
      SELECT vec_id, round(count(*) FILTER (x) * 20.0 / (2 * count(*)), 6) AS frequency FROM e GROUP BY vec_id""")
frame("integral_time_scale", "signal", lambda df: nb.integral_time_scale(df, "x", ["vec_id"], "n", 0.5).select("vec_id", rounded("time_scale").alias("time_scale")),
      """WITH d AS (SELECT vec_id, n, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM {view}),
      r AS (SELECT a.vec_id, b.n - a.n AS l, sum(a.x * b.x) AS r FROM d a JOIN d b ON a.vec_id = b.vec_id AND b.n >= a.n GROUP BY 1, 2),
      q AS (SELECT vec_id, l, r / first(r) OVER (PARTITION BY vec_id ORDER BY l) AS r FROM r),
      s AS (SELECT *, coalesce(min(l) FILTER (r <= 0) OVER (PARTITION BY vec_id), 64) AS stop, lead(r) OVER (PARTITION BY vec_id ORDER BY l) AS r2 FROM q)
      SELECT vec_id, round(coalesce(sum((r + r2) / 2 * 0.5) FILTER (l < stop - 1), 0), 6) AS time_scale FROM s GROUP BY vec_id""")


def _unwrap(df: DataFrame) -> DataFrame:
    return nb.unwrapped(df.withColumn("o", F.struct("ts", "event_id")), "direction", ["station"], "o", "turned").select("event_id", rounded("turned", 4).alias("turned"))


frame("unwrap", "obs", _unwrap, """WITH s AS (SELECT *, direction - lag(direction) OVER (PARTITION BY station ORDER BY ts, event_id) AS d FROM {view})
  SELECT event_id, round(sum(coalesce(((d + 180) % 360 + 360) % 360 - 180, direction)) OVER (PARTITION BY station ORDER BY ts, event_id), 4) AS turned FROM s""")
frame("tke_budget", "signal", lambda df: turbulence.tke_budget(
    df.select("label", "n", (c("x") * 10 + c("n") * 0.1).alias("u"), (c("x") * c("x") * 50).alias("v"), (c("x") * (c("vec_id") % 7)).alias("w"), (c("x") * 3 + 290 + c("n")).alias("theta"), (c("n") * 10.0 + 5).alias("z")),
    "u", "v", "w", "theta", "z", "n", ["label"]).select("label", "n", *[rounded(x).alias(x) for x in ("shear_production", "buoyancy_production", "resolved_tke")]),
    f"""WITH f AS (SELECT label, n, x * 10 + n * 0.1::DOUBLE AS u, x * x * 50 AS v, x * (vec_id % 7) AS w, x * 3 + 290 + n AS theta, n * 10.0::DOUBLE + 5 AS z FROM {{view}}),
    m AS (SELECT label, n, covar_pop(u, w) AS uw, covar_pop(v, w) AS vw, covar_pop(w, theta) AS wt, avg(theta) AS theta, avg(u) AS mu, avg(v) AS mv, avg(z) AS z, 0.5 * (var_pop(u) + var_pop(v) + var_pop(w)) AS tke FROM f GROUP BY label, n)
    SELECT label, n, round(-(uw * {grad('mu', 'label', 'n')} / {grad('z', 'label', 'n')} + vw * {grad('mv', 'label', 'n')} / {grad('z', 'label', 'n')}), 6) AS shear_production,
    round(9.80665 * wt / theta, 6) AS buoyancy_production, round(tke, 6) AS resolved_tke FROM m""")


def _align(spark, sf_dir) -> DataFrame:
    events = views.obs(spark, sf_dir)
    model = events.where("kind = 'view'").select("station", c("ts").alias("time"), c("speed").alias("model"))
    seen = events.where("kind = 'click'").select("station", c("ts").alias("time"), "event_id", "speed")
    return relate.align(model, seen, ["model"], "time", ["station"], 86400.0).select("event_id", rounded("model").alias("model"))


add("align", _align, f"""
WITH o AS ({views.SQL['obs']}), m AS (SELECT station, ts, speed AS model FROM o WHERE kind = 'view'), s AS (SELECT station, ts, event_id FROM o WHERE kind = 'click'),
b AS (SELECT s.event_id, m.ts, m.model FROM s ASOF LEFT JOIN m ON s.station = m.station AND s.ts >= m.ts),
a AS (SELECT s.event_id, m.ts, m.model FROM s ASOF LEFT JOIN m ON s.station = m.station AND s.ts <= m.ts),
g AS (SELECT s.event_id, epoch(s.ts) - epoch(b.ts) AS gb, epoch(a.ts) - epoch(s.ts) AS ga, b.model AS mb, a.model AS ma FROM s JOIN b USING (event_id) JOIN a USING (event_id))
SELECT event_id, round(CASE WHEN ga IS NULL OR gb < ga THEN CASE WHEN gb <= 86400 THEN mb END ELSE CASE WHEN ga <= 86400 THEN ma END END, 6) AS model FROM g
""")
frame("normalize_time", "obs", lambda df: relate.normalize_time(df.select("event_id", "ts"), "ts", 5.5, False), "SELECT event_id, ts - INTERVAL '5 hours 30 minutes' AS ts FROM {view}")


def _concat(spark, sf_dir) -> DataFrame:
    rows = views.obs(spark, sf_dir).select((F.row_number().over(Window.partitionBy("station").orderBy("ts", "event_id")) - 1).cast("int").alias("t"), "station", "speed")
    return relate.concatenate([rows.where("station % 2 = 0"), rows.where("station % 2 = 1")]).select("t", "station", rounded("speed").alias("speed"))


add("concatenate", _concat, f"""WITH r AS (SELECT row_number() OVER (PARTITION BY station ORDER BY ts, event_id) - 1 AS t, station, speed FROM ({views.SQL['obs']}))
SELECT t + CASE WHEN station % 2 = 1 THEN (SELECT max(t) + 1 FROM r WHERE station % 2 = 0) ELSE 0 END AS t, station, round(speed, 6) AS speed FROM r""")
