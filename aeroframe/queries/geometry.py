"""Selection, interpolation, horizontal geometry, generators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.operators import fields, grid, stats
from aeroframe.plans import domains, views
from aeroframe.queries.registry import add, frame, rounded, scratch
from aeroframe.sources import binary

c = F.col
LEVELS = [5.0, 10.0, 37.5, 121.0, 640.0, 700.0]


def _interp_sql(levels: list[float], extra: str = "x") -> str:
    listed = ", ".join(f"({x}::DOUBLE)" for x in levels)
    return f"""b AS (SELECT *, lead(z) OVER w AS z2, lead({extra}) OVER w AS x2 FROM {{view}} WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
    h AS (SELECT vec_id, level, CASE WHEN z2 IS NULL THEN {extra} ELSE {extra} + (level - z) / (z2 - z) * (x2 - {extra}) END AS x FROM b, (VALUES {listed}) l(level) WHERE (level >= z AND level < z2) OR (z2 IS NULL AND level = z)),
    i AS (SELECT v.vec_id, l.level, h.x FROM (SELECT DISTINCT vec_id FROM {{view}}) v CROSS JOIN (VALUES {listed}) l(level) LEFT JOIN h ON h.vec_id = v.vec_id AND h.level = l.level)"""


def _levels(df: DataFrame) -> DataFrame:
    holed = df.withColumn("x", F.when(c("k") % 11 != 4, c("x")))
    return grid.interpolate_to_levels(holed, "x", "z", ["vec_id"], LEVELS).select("vec_id", "level", F.nanvl(rounded("x"), F.lit(-999.0)).alias("x"))


frame("interpolate_to_levels", "profile", _levels,
      "WITH " + _interp_sql(LEVELS).replace("{view}", "(SELECT * FROM {view} WHERE k % 11 <> 4)") + " SELECT vec_id, level, coalesce(round(x, 6), -999) AS x FROM i")
frame("interpolate_height", "profile", lambda df: grid.interpolate_height(df, "x", "z", ["vec_id"], LEVELS).select("vec_id", "level", F.nanvl(rounded("x"), F.lit(-999.0)).alias("x")),
      f"WITH {_interp_sql(LEVELS)} SELECT vec_id, level, coalesce(round(x, 6), -999) AS x FROM i")
_ROTOR = [30.0 + 120.0 * k / 40 for k in range(41)]
frame("rotor_equivalent_wind_speed", "profile", lambda df: grid.rotor_equivalent_wind_speed(df.withColumn("x", c("x") + 20), "x", "z", ["vec_id"], 30.0, 150.0).select("vec_id", rounded("rews").alias("rews")),
      f"WITH {_interp_sql(_ROTOR)} SELECT vec_id, round(cbrt(avg(pow(x + 20, 3))), 6) AS rews FROM i GROUP BY vec_id")


def _veer(df: DataFrame) -> DataFrame:
    turned = df.select("vec_id", "z", "k", (c("x") + 20).alias("speed"), F.pmod(c("x") * 17.3, F.lit(360.0)).alias("direction"))
    return grid.rotor_shear_veer(turned, "speed", "direction", "z", ["vec_id"], 35.0, 155.0).select("vec_id", rounded("shear").alias("shear"), rounded("veer", 4).alias("veer"))


frame("rotor_shear_veer", "profile", _veer, """WITH d AS (SELECT vec_id, k, z, x + 20 AS s, fmod(fmod(x * 17.3, 360) + 360, 360) AS a FROM {view}),
  e AS (SELECT *, a - lag(a) OVER (PARTITION BY vec_id ORDER BY k) AS st FROM d),
  f AS (SELECT *, sum(coalesce(((st + 180) % 360 + 360) % 360 - 180, a)) OVER (PARTITION BY vec_id ORDER BY k) AS u FROM e),
  p AS (SELECT vec_id, (s2 + s3) / 2 AS s_lo, (s14 + s15) / 2 AS s_hi, radians((u14 + u15) / 2 - (u2 + u3) / 2) AS v FROM (SELECT vec_id,
    max(s) FILTER (k = 2) AS s2, max(s) FILTER (k = 3) AS s3, max(s) FILTER (k = 14) AS s14, max(s) FILTER (k = 15) AS s15,
    max(u) FILTER (k = 2) AS u2, max(u) FILTER (k = 3) AS u3, max(u) FILTER (k = 14) AS u14, max(u) FILTER (k = 15) AS u15 FROM f GROUP BY vec_id))
  SELECT vec_id, round(ln(s_hi / s_lo) / ln(155.0 / 35), 6) AS shear, round(degrees(atan2(sin(v), cos(v))), 4) AS veer FROM p""")
frame("transect", "plane", lambda df: grid.transect(df, "x", (0.5, 0.25), (6.5, 7.0), ["vec_id"], (8, 8), 10).select("vec_id", "point", rounded("x", 7).alias("x")),
      """WITH s AS (SELECT i AS point, 0.5 + 6.0 * i / 9 AS y, 0.25 + 6.75 * i / 9 AS x FROM range(10) t(i)),
      g AS (SELECT point, y, x, floor(y)::INT AS y0, floor(x)::INT AS x0 FROM s),
      n AS (SELECT point, least(y0 + dy, 7) AS j, least(x0 + dx, 7) AS i, (CASE WHEN dy = 1 THEN y - y0 ELSE 1 - y + y0 END) * (CASE WHEN dx = 1 THEN x - x0 ELSE 1 - x + x0 END) AS w FROM g, (VALUES (0), (1)) a(dy), (VALUES (0), (1)) b(dx))
      SELECT vec_id, point, round(sum(p.x * w), 7) AS x FROM {view} p JOIN n USING (j, i) GROUP BY vec_id, point""")
_TX, _TY = [-0.5, 0.3, 2.5, 7.6], [0.0, 1.25, 6.9]


def _regrid_sql() -> str:
    rows = lambda ts, n: ", ".join(f"({a}, {k}, {w}::DOUBLE), ({a}, {k + 1}, {u}::DOUBLE)" for a, _, k, u in grid._bracket_index(list(range(n)), ts) for w in [1 - u])
    return f"""SELECT vec_id, y.n AS j, x.n AS i, round(sum(p.x * y.w * x.w), 7) AS x FROM {{view}} p JOIN (VALUES {rows(_TY, 8)}) y(n, k, w) ON y.k = p.j JOIN (VALUES {rows(_TX, 8)}) x(n, k, w) ON x.k = p.i GROUP BY vec_id, y.n, x.n"""


frame("regrid_regular", "plane", lambda df: grid.regrid_regular(df, "x", [float(k) for k in range(8)], [float(k) for k in range(8)], _TX, _TY, ["vec_id"]).select("vec_id", "j", "i", rounded("x", 7).alias("x")), _regrid_sql())
frame("boundary_discontinuity", "plane", lambda df: grid.boundary_discontinuity(df, "x", (8, 8), ["vec_id"]).select("vec_id", *[rounded(x, 7).alias(x) for x in ("edge_mean", "interior_mean", "difference")]),
      """SELECT vec_id, round(avg(x) FILTER (NOT (j BETWEEN 1 AND 6 AND i BETWEEN 1 AND 6)), 7) AS edge_mean, round(avg(x) FILTER (j BETWEEN 1 AND 6 AND i BETWEEN 1 AND 6), 7) AS interior_mean,
      round(avg(x) FILTER (NOT (j BETWEEN 1 AND 6 AND i BETWEEN 1 AND 6)) - avg(x) FILTER (j BETWEEN 1 AND 6 AND i BETWEEN 1 AND 6), 7) AS difference FROM {view} GROUP BY vec_id""")
frame("top_hat_coarsen", "plane", lambda df: grid.top_hat_coarsen(df, "x", 2, ["vec_id"], (8, 8), 4).select("vec_id", "j", "i", rounded("x", 7).alias("x")),
      "SELECT vec_id, j // 2 AS j, i // 4 AS i, round(avg(x), 7) AS x FROM {view} GROUP BY 1, 2, 3")
frame("resolved_subfilter", "plane", lambda df: df.select("vec_id", "j", "i", *[rounded(x, 7).alias(n) for n, x in zip(("filtered", "rest"), grid.resolved_subfilter("x", c("x") * 0.75))]),
      "SELECT vec_id, j, i, round(x * 0.75, 7) AS filtered, round(x - x * 0.75, 7) AS rest FROM {view}")
frame("filtered_tke", "plane", lambda df: grid.filtered_tke(df.select("vec_id", "j", "i", (c("x") * 10).alias("u"), (c("x") * c("j")).alias("v"), (c("x") * c("i")).alias("w")), "u", "v", "w", ["vec_id"], "top_hat", factor=2, shape=(8, 8)).select("vec_id", rounded("tke").alias("tke")),
      """SELECT vec_id, round(0.5 * (var_pop(u) + var_pop(v) + var_pop(w)), 6) AS tke FROM (SELECT vec_id, j // 2 AS j, i // 2 AS i, avg(x * 10) AS u, avg(x * j) AS v, avg(x * i) AS w FROM {view} GROUP BY 1, 2, 3) GROUP BY vec_id""")
_geo = lambda df: df.withColumn("lat", 50 + c("j") * 0.1).withColumn("lon", 3 + c("i") * 0.1)
_D = "pow(sin((radians(50 + j * 0.1::DOUBLE) - radians(50.337)) / 2), 2) + cos(radians(50 + j * 0.1::DOUBLE)) * cos(radians(50.337)) * pow(sin((radians(3 + i * 0.1::DOUBLE) - radians(3.561)) / 2), 2)"
_CELL = f"JOIN (SELECT j, i FROM (SELECT DISTINCT j, i FROM {{view}}) ORDER BY {_D}, j, i LIMIT 1) USING (j, i)"
frame("nearest_grid_point", "plane", lambda df: grid.nearest_grid_point(_geo(df), 50.337, 3.561, by=["vec_id"]).select("vec_id", "j", "i", rounded("latitude").alias("latitude"), rounded("longitude").alias("longitude")),
      f"SELECT vec_id, j, i, round(50 + j * 0.1, 6) AS latitude, round(3 + i * 0.1, 6) AS longitude FROM {{view}} QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY {_D}, j, i) = 1")
frame("point", "plane", lambda df: grid.point(_geo(df), 50.337, 3.561).select("vec_id", "j", "i", rounded("x", 7).alias("x")), f"SELECT vec_id, j, i, round(x, 7) AS x FROM {{view}} {_CELL}")
frame("collocate_grid", "plane", lambda df: grid.collocate_grid(_geo(df), 50.337, 3.561).select("vec_id", "j", "i", rounded("cell_latitude").alias("cell_latitude"), rounded("cell_longitude").alias("cell_longitude"), rounded("x", 7).alias("x")),
      f"SELECT vec_id, j, i, round(50 + j * 0.1::DOUBLE, 6) AS cell_latitude, round(3 + i * 0.1::DOUBLE, 6) AS cell_longitude, round(x, 7) AS x FROM {{view}} {_CELL}")
frame("subset_by_bounds", "plane", lambda df: grid.subset_by_bounds(_geo(df), 3.15, 3.45, 50.05, 50.35, padding=1).select("vec_id", "j", "i", rounded("x", 7).alias("x")),
      """WITH b AS (SELECT min(j) - 1 AS j0, max(j) + 1 AS j1, min(i) - 1 AS i0, max(i) + 1 AS i1 FROM {view} WHERE 3 + i * 0.1::DOUBLE BETWEEN 3.15 AND 3.45 AND 50 + j * 0.1::DOUBLE BETWEEN 50.05 AND 50.35)
      SELECT vec_id, j, i, round(x, 7) AS x FROM {view}, b WHERE j BETWEEN j0 AND j1 AND i BETWEEN i0 AND i1""")
_grid4 = lambda df: df.select(c("vec_id").alias("t"), c("label").alias("k"), "j", "i", "x")
frame("horizontal_plane", "plane", lambda df: grid.horizontal_plane(_grid4(df), "x", 3, 7).select("j", "i", rounded("x", 7).alias("x")), "SELECT j, i, round(x, 7) AS x FROM {view} WHERE vec_id = 7 AND label = 3")
frame("vertical_profile", "plane", lambda df: grid.vertical_profile(_grid4(df), "x", 2, 5, 11).select("k", rounded("x", 7).alias("x")), "SELECT label AS k, round(x, 7) AS x FROM {view} WHERE vec_id = 11 AND i = 2 AND j = 5")
frame("get_variable", "plane", lambda df: grid.get_variable(_grid4(df), "x", ["t", "k", "j", "i"], 9, ["i"]).select("j", "i", rounded("x", 7).alias("x")),
      "SELECT j, i, round((x + x2) / 2, 7) AS x FROM (SELECT *, lead(x) OVER (PARTITION BY j ORDER BY i) AS x2 FROM {view} WHERE vec_id = 9) WHERE x2 IS NOT NULL")
frame("select_variables", "les", lambda df: grid.select_variables(df, {"eastward": "u", "northward": "v"}, ["l_orderkey", "l_linenumber", "l_partkey"]),
      "SELECT l_orderkey, l_linenumber, l_partkey, u AS eastward, v AS northward FROM {view}")


def _velocity(df: DataFrame) -> DataFrame:
    cube = df.select(c("vec_id").alias("t"), c("label").alias("k"), "j", "i", c("x").alias("U"), (c("x") * 2).alias("V"), (c("x") + c("j")).alias("W"))
    out = grid.load_velocity(cube, cube, cube, ["t", "k", "j", "i"], staggered={"u": "i", "v": "j"})
    return out.select("t", "k", "j", "i", *[rounded(x, 7).alias(x) for x in "uvw"])


frame("load_velocity", "plane", _velocity, """WITH f AS (SELECT vec_id AS t, label AS k, j, i, x, lead(x) OVER (PARTITION BY vec_id, j ORDER BY i) AS xi, lead(x) OVER (PARTITION BY vec_id, i ORDER BY j) AS xj FROM {view})
  SELECT t, k, j, i, round((x + xi) / 2, 7) AS u, round((2 * x + 2 * xj) / 2, 7) AS v, round(x + j, 7) AS w FROM f WHERE xi IS NOT NULL AND xj IS NOT NULL""")
frame("load_sgs_stress", "les", lambda df: grid.load_sgs_stress(df, ["l_orderkey", "l_linenumber", "l_partkey"], {"m11": "u", "m12": "v", "m13": "w", "m22": "sgs", "m23": "u", "m33": "v"}),
      "SELECT l_orderkey, l_linenumber, l_partkey, u AS m11, v AS m12, w AS m13, sgs AS m22, u AS m23, v AS m33 FROM {view}")
_CENTRES = [[0.02 * ((k * 7 + j * 3) % 11 - 5) for j in range(64)] for k in range(3)]


def _cluster(spark, sf_dir) -> DataFrame:
    v = views.read(spark, sf_dir, "embeddings").select("vec_id", c("embedding").cast("array<double>").alias("v"))
    return stats.cluster_profiles(v, "vec_id", "v", _CENTRES, 3).select("vec_id", c("cluster").cast("int").alias("cluster"))


def _cluster_sql() -> str:
    lists = ", ".join(f"({k}, {[float(x) for x in row]}::DOUBLE[])" for k, row in enumerate(_CENTRES))
    steps = [f"WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), c0(k, m) AS (VALUES {lists})"]
    for s in range(3):
        steps.append(f"a{s} AS (SELECT vec_id, v, arg_min(k, list_distance(v, m)) AS k FROM e, c{s} GROUP BY vec_id, v)")
        if s < 2:
            means = ", ".join(f"avg(v[{j + 1}])" for j in range(64))
            steps.append(f"m{s} AS (SELECT k, [{means}] AS m FROM a{s} GROUP BY k), c{s + 1} AS (SELECT c{s}.k, coalesce(m{s}.m, c{s}.m) AS m FROM c{s} LEFT JOIN m{s} USING (k))")
    return ", ".join(steps) + " SELECT vec_id, k::INT AS cluster FROM a2"


add("cluster_profiles", _cluster, _cluster_sql())

add("eta_levels", lambda spark, _: domains.eta_levels(spark, 41).select("level", rounded("eta", 9).alias("eta")), "SELECT i::INT AS level, round(1 - pow(i / 40.0::DOUBLE, 1.5), 9) AS eta FROM range(41) t(i)")
_NML = {"share": {"max_dom": 3}, "geogrid": {"parent_id": [1, 1, 2], "parent_grid_ratio": [1, 3, 3], "i_parent_start": [1, 10, 4], "j_parent_start": [1, 12, 5], "e_we": [100, 31, 22], "e_sn": [90, 28, 19], "dx": 9000, "dy": 9000}}
add("domain_geometries", lambda spark, _: domains.place_domains(domains.nest_table(spark, _NML), 9000.0, 9000.0), """
WITH RECURSIVE n(domain, parent, ratio, si, sj, nx, ny) AS (VALUES (1, 0, 1, 1, 1, 100, 90), (2, 1, 3, 10, 12, 31, 28), (3, 2, 3, 4, 5, 22, 19)),
g AS (SELECT domain, parent, 9000::DOUBLE AS dx, 9000::DOUBLE AS dy, nx, ny, 0::DOUBLE AS x0, 0::DOUBLE AS y0 FROM n WHERE parent = 0
  UNION ALL SELECT n.domain, n.parent, g.dx / n.ratio, g.dy / n.ratio, n.nx, n.ny, g.x0 + (n.si - 1) * g.dx, g.y0 + (n.sj - 1) * g.dy FROM n JOIN g ON n.parent = g.domain)
SELECT * FROM g
""")
add("constant_field", lambda spark, _: fields.constant_field(spark, 8.0, 10.0, 0.5, 4, 3, 30.0).select("t", "k", "j", *[rounded(x).alias(x) for x in "uvw"]),
    "SELECT t::INT AS t, k::INT AS k, j::INT AS j, round(8 * cos(radians(30)), 6) AS u, round(8 * sin(radians(30)), 6) AS v, 0::DOUBLE AS w FROM range(21) a(t), range(3) b(k), range(4) c(j)")
add("step_field", lambda spark, _: fields.step_field(spark, [5.0, 10.0, 7.0], 2.0, 0.5, 4, 3).select("t", "k", "j", *[rounded(x).alias(x) for x in "uvw"]),
    "SELECT t::INT AS t, k::INT AS k, j::INT AS j, [5.0, 10.0, 7.0][t // 4 + 1]::DOUBLE AS u, 0::DOUBLE AS v, 0::DOUBLE AS w FROM range(12) a(t), range(3) b(k), range(4) c(j)")
add("synthetic_wind_field", lambda spark, _: fields.synthetic_wind_field(spark, 9.0, 16, 8, 8, 0.5, 10.0, 10.0, seed=4))

_META = fields.FieldMeta(2000, 8, 8, 10.0, 10.0, 0.5, 55.0, 20.0)
_field = lambda df: df.select(c("vec_id").cast("int").alias("t"), c("j").alias("k"), c("i").alias("j"), "x", (c("x") * 2).alias("y"), (c("x") * c("i")).alias("z"))
_wind = lambda df: fields.from_components(_field(df), ("x", "y", "z"), "t", "k", "j", (2000, 8, 8), ("v", "u", "w"), (1.0, -1.0, 1.0), True, True)
frame("wind_field_from_components", "plane", lambda df: _wind(df).select("t", "k", "j", *[rounded(x, 7).alias(x) for x in "uvw"]),
      "SELECT vec_id::INT AS t, 7 - j AS k, 7 - i AS j, round(2 * x, 7) AS u, round(-x, 7) AS v, round(x * i, 7) AS w FROM {view}")
frame("velocity_at", "plane", lambda df: fields.velocity_at(_wind(df), _META, 5.0, 61.0).select("t", *[rounded(x, 7).alias(x) for x in "uvw"]),
      "SELECT vec_id::INT AS t, round(2 * x, 7) AS u, round(-x, 7) AS v, round(x * i, 7) AS w FROM {view} WHERE 7 - j = 4 AND 7 - i = 4")
frame("field_horizontal_plane", "plane", lambda df: fields.horizontal_plane(_wind(df), _META, 61.0).select("t", "j", *[rounded(x, 7).alias(x) for x in "uvw"]),
      "SELECT vec_id::INT AS t, 7 - i AS j, round(2 * x, 7) AS u, round(-x, 7) AS v, round(x * i, 7) AS w FROM {view} WHERE 7 - j = 4")
frame("field_vertical_profile", "plane", lambda df: fields.vertical_profile(_wind(df), _META).select("k", "height", *[rounded(x, 7).alias(x) for x in "uvw"]),
      "SELECT 7 - j AS k, (7 - j) * 10.0 + 20 AS height, round(avg(2 * x), 7) AS u, round(avg(-x), 7) AS v, round(avg(x * i), 7) AS w FROM {view} GROUP BY j")


def _joined(df: DataFrame) -> DataFrame:
    field = _wind(df)
    out, meta = fields.concatenate_fields([(field, _META), (field, _META)])
    return out.groupBy("t").agg(F.count("*").alias("cells")).withColumn("mean_speed", rounded(F.lit(meta.mean_speed), 7))


frame("concatenate_fields", "plane", _joined, """WITH f AS (SELECT vec_id::INT AS t, 7 - j AS k, 2 * x AS u FROM {view})
  SELECT t + d AS t, count(*) AS cells, (SELECT round(avg(u), 7) FROM f WHERE k = 4) AS mean_speed FROM f, (VALUES (0), (2000)) s(d) GROUP BY t + d""")


def _round_trip(spark, sf_dir) -> DataFrame:
    """Every plane written as one step of a packed file, and the file read back."""
    field = _wind(views.plane(spark, sf_dir))
    steps = field.agg(F.max("t")).first()[0] + 1
    path = f"{scratch(spark)}/aeroframe-{uuid.uuid4().hex}.bts"
    binary.write_bts(field, fields.with_mean_speed(field, fields.FieldMeta(steps, 8, 8, 10.0, 10.0, 0.5, 55.0, 20.0)), path)
    return binary.read_bts(spark, path).select("t", "k", "j", *[rounded(x, 4).alias(x) for x in "uvw"])


_PACKED = ", ".join(f"round((round_even(least(32767, greatest(-32768, {x} * s{x} + o{x})), 0) - o{x}) / s{x}, 4) AS {x}" for x in "uvw")
_SLOPES = ", ".join(f"(65535.0 / (max({x}) - min({x})))::FLOAT::DOUBLE AS s{x}, (-32768.0 - min({x}) * (65535.0 / (max({x}) - min({x}))))::FLOAT::DOUBLE AS o{x}" for x in "uvw")
add("bts_round_trip", _round_trip, f"""WITH f AS (SELECT vec_id::INT AS t, 7 - j AS k, 7 - i AS j, 2 * x AS u, -x AS v, x * i AS w FROM ({views.SQL['plane']}))
  SELECT t, k, j, {_PACKED} FROM f, (SELECT {_SLOPES} FROM f)""")
add("geographic_corners", lambda spark, _: domains.geographic_corners(domains.place_domains(domains.nest_table(spark, _NML), 9000.0, 9000.0), 51.97, 4.93, 30.0, 60.0, 5.0).select("domain", "corner", rounded("longitude").alias("longitude"), rounded("latitude").alias("latitude")))
