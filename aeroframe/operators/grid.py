"""Selection, vertical interpolation and horizontal geometry on long grid tables.

Default axis names: ``t`` time, ``k`` level, ``j`` south-north, ``i`` west-east.
"""

from __future__ import annotations

import math
from bisect import bisect_left

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from aeroframe.functions.common import NAN, col, divide, finite, log
from aeroframe.operators.neighbour import destagger, unwrapped


def select_variables(df: DataFrame, mapping: dict[str, str], keep: list[str] | None = None) -> DataFrame:
    """Project and rename by {target: source}; all missing sources are named at once."""
    missing = [s for s in mapping.values() if s not in df.columns]
    if missing:
        raise KeyError(f"missing variables: {', '.join(missing)}")
    return df.select(*(keep or []), *[F.col(s).alias(t) for t, s in mapping.items()])


def get_variable(df: DataFrame, name: str, axes: list[str], time: int | None = None, staggered: list[str] | None = None) -> DataFrame:
    """One variable, at one time where given, destaggered along the named axes.

    The time filter stands below the windows, where it reaches the scan.
    """
    if name not in df.columns:
        raise KeyError(f"{name} is not one of {', '.join(df.columns[:20])}")
    out = df.select(*axes, name)
    if time is not None:
        out = out.where(F.col("t") == time)
    for axis in staggered or []:
        out = destagger(out, [name], [a for a in axes if a != axis], axis)
    return out


def load_velocity(u: DataFrame, v: DataFrame, w: DataFrame, axes: list[str], names: dict[str, str] | None = None, staggered: dict[str, str] | None = None) -> DataFrame:
    """u, v and w from their own grids on the common one: each destaggered along
    its axis (by default i, j and k), then joined on the axes they share."""
    names = {"u": "U", "v": "V", "w": "W"} | (names or {})
    staggered = {"u": "i", "v": "j", "w": "k"} if staggered is None else staggered
    out = None
    for part, df in (("u", u), ("v", v), ("w", w)):
        one = get_variable(df, names[part], axes, staggered=[staggered[part]] if part in staggered else None).withColumnRenamed(names[part], part)
        out = one if out is None else out.join(one, axes)
    return out


def load_sgs_stress(df: DataFrame, keep: list[str], names: dict[str, str] | None = None) -> DataFrame:
    """The six subgrid stresses under their short names."""
    return select_variables(df, {m: m.upper() for m in ("m11", "m12", "m13", "m22", "m23", "m33")} | (names or {}), keep)


def vertical_profile(df: DataFrame, variable: str, x: int, y: int, time: int = 0) -> DataFrame:
    return df.where((F.col("i") == x) & (F.col("j") == y) & (F.col("t") == time)).select("k", variable)


def horizontal_plane(df: DataFrame, variable: str, level: int | None = None, time: int = 0) -> DataFrame:
    here = F.col("t") == time
    if level is None:
        return df.where(here).select("k", "j", "i", variable)
    return df.where(here & (F.col("k") == level)).select("j", "i", variable)


def great_circle_term(latitude, longitude, target_latitude: float, target_longitude: float) -> Column:
    """Haversine term: rises with the distance, is enough to order by it."""
    lat, lon = F.radians(col(latitude)), F.radians(col(longitude))
    tlat, tlon = math.radians(target_latitude), math.radians(target_longitude)
    a, b = F.sin((lat - tlat) / 2), F.sin((lon - tlon) / 2)
    return a * a + F.cos(lat) * math.cos(tlat) * b * b


def nearest_grid_point(df: DataFrame, target_latitude: float, target_longitude: float, lat: str = "lat", lon: str = "lon", by: list[str] | None = None) -> DataFrame:
    """The cell (j, i) nearest to the target; of equal distances the first in row-major order."""
    d = great_circle_term(lat, lon, target_latitude, target_longitude)
    best = F.min(F.when(finite(d).isNotNull(), F.struct(d.alias("d"), "j", "i", F.col(lat).alias("lat"), F.col(lon).alias("lon"))))
    return df.groupBy(*(by or [])).agg(best.alias("b")).select(*(by or []), "b.j", "b.i", F.col("b.lat").alias("latitude"), F.col("b.lon").alias("longitude"))


def point(df: DataFrame, target_latitude: float, target_longitude: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """All rows of the cell nearest to the target."""
    cell = nearest_grid_point(df.select("j", "i", lat, lon).distinct(), target_latitude, target_longitude, lat, lon).select("j", "i")
    # one row, so its broadcast has a fixed size
    return df.join(F.broadcast(cell), ["j", "i"], "left_semi")


def collocate_grid(df: DataFrame, target_latitude: float, target_longitude: float, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """All rows of the cell nearest to the target, with its place: j, i, cell_latitude, cell_longitude."""
    cell = nearest_grid_point(df.select("j", "i", lat, lon).distinct(), target_latitude, target_longitude, lat, lon).toDF("j", "i", "cell_latitude", "cell_longitude")
    # one row, so its broadcast has a fixed size
    return df.join(F.broadcast(cell), ["j", "i"])


def subset_by_bounds(df: DataFrame, west: float, east: float, south: float, north: float, lat: str = "lat", lon: str = "lon", padding: int = 0) -> DataFrame:
    """Rows of the smallest index rectangle that holds all cells in the box, padded."""
    if west >= east or south >= north:
        raise ValueError("bounds need west < east and south < north")
    inside = F.col(lon).between(west, east) & F.col(lat).between(south, north)
    box = df.where(inside).agg(F.min("j").alias("_j0"), F.max("j").alias("_j1"), F.min("i").alias("_i0"), F.max("i").alias("_i1"))
    # one row, so its broadcast has a fixed size
    kept = df.crossJoin(F.broadcast(box)).where(
        F.col("j").between(F.col("_j0") - padding, F.col("_j1") + padding) & F.col("i").between(F.col("_i0") - padding, F.col("_i1") + padding))
    return kept.drop("_j0", "_j1", "_i0", "_i1")


def bracket(df: DataFrame, values: list[str], height, by: list[str], levels: list[float], least: int = 1) -> DataFrame:
    """Linear interpolation of ``values`` to each level of each column (``by``).

    Each row is a bracket to the next height; the levels inside it come from an
    array literal, so no range join is planned. The first row of a column also
    stands for all levels, so that one exchange serves the window and the
    aggregate. Knots give their own value; a level outside a column, and columns
    of fewer than ``least`` finite heights, give NaN. Of equal heights the one
    last in value order counts; repeated levels count once.
    """
    w = Window.partitionBy(*by).orderBy(F.col("_z").asc_nulls_last(), *values)
    rows = df.select(*by, *values, finite(col(height).cast("double")).alias("_z"))
    if least > 1:
        known = F.count("_z").over(Window.partitionBy(*by))
        rows = rows.select(*by, *values, F.when(known >= least, F.col("_z")).alias("_z"))
    rows = rows.select(*by, "_z", F.lead("_z").over(w).alias("_z2"), (F.row_number().over(w) == 1).alias("_first"), *values, *[F.lead(v).over(w).alias(f"_{v}2") for v in values])
    array = F.array(*[F.lit(float(x)) for x in dict.fromkeys(levels)])
    # half open, but for the last knot
    inside = lambda x: ((x >= F.col("_z")) & (x < F.col("_z2"))) | (F.col("_z2").isNull() & (x == F.col("_z")))
    hit = rows.withColumn("level", F.explode(F.when(F.col("_first"), array).otherwise(F.filter(array, inside)))).withColumn("_in", inside(F.col("level")))
    share = (F.col("level") - F.col("_z")) / (F.col("_z2") - F.col("_z"))
    at = lambda v: F.when(F.col("_z2").isNull(), F.col(v)).otherwise(F.col(v) + share * (F.col(f"_{v}2") - F.col(v)))
    found = [F.max(F.when(F.col("_in"), at(v))) for v in values]
    return hit.groupBy(*by, "level").agg(*[F.coalesce(x, F.lit(NAN)).alias(v) for v, x in zip(values, found)])


def interpolate_to_levels(df: DataFrame, value: str, height: str, by: list[str], levels: list[float]) -> DataFrame:
    """``bracket`` on the finite pairs; columns with fewer than two give NaN."""
    z, v = finite(height), finite(value)
    good = df.select(*by, F.when(v.isNotNull(), z).alias(height), F.when(z.isNotNull(), v).alias(value))
    return bracket(good, [value], height, by, levels, 2)


to_levels = interpolate_to_levels


def interpolate_height(df: DataFrame, value: str, height: str, by: list[str], levels: list[float]) -> DataFrame:
    """``bracket`` on columns whose heights rise."""
    return bracket(df, [value], height, by, levels)


def rotor_equivalent_wind_speed(df: DataFrame, speed: str, height: str, by: list[str], bottom: float, top: float, points: int = 41) -> DataFrame:
    levels = [bottom + (top - bottom) * k / (points - 1) for k in range(points)]
    s = F.nanvl(F.col(speed), F.lit(None).cast("double"))
    return bracket(df, [speed], height, by, levels).groupBy(*by).agg(F.cbrt(F.avg(F.pow(s, F.lit(3.0)))).alias("rews"))


def rotor_shear_veer(df: DataFrame, speed: str, direction: str, height: str, by: list[str], bottom: float, top: float) -> DataFrame:
    """Power-law shear and veer in (-180, 180] between two heights."""
    turned = unwrapped(df.select(*by, speed, direction, height), direction, by, height, "_turned")
    at = bracket(turned, [speed, "_turned"], height, by, [bottom, top])
    pick = lambda c, z: F.max(F.when(F.col("level") == float(z), F.col(c)))
    both = at.groupBy(*by).agg(pick(speed, bottom).alias("a"), pick(speed, top).alias("b"), pick("_turned", bottom).alias("c"), pick("_turned", top).alias("d"))
    angle = F.radians(F.col("d") - F.col("c"))
    return both.select(*by, (log(divide("b", "a")) / math.log(top / bottom)).alias("shear"), F.degrees(F.atan2(F.sin(angle), F.cos(angle))).alias("veer"))


# Rows up to which a table of weights is sent to every task; larger ones are joined by a shuffle.
BROADCAST_ROWS = 200_000


def weight_table(df: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    table = df.sparkSession.createDataFrame(rows, schema)
    return F.broadcast(table) if len(rows) <= BROADCAST_ROWS else table


def transect(df: DataFrame, value: str, start: tuple[float, float], end: tuple[float, float], by: list[str], shape: tuple[int, int], points: int = 100) -> DataFrame:
    """``points`` bilinear samples on the index-space line from ``start`` to ``end`` (y, x).

    Each cell meets the samples that it neighbours by an equi-join with their
    weights; neighbours beyond the grid are its edge.
    """
    ny, nx = shape
    samples: list[tuple] = []
    for k in range(points):
        f = k / (points - 1) if points > 1 else 0.0
        y, x = float(start[0] + (end[0] - start[0]) * f), float(start[1] + (end[1] - start[1]) * f)
        fy, fx = math.floor(y), math.floor(x)
        y0, x0 = min(max(fy, 0), ny - 1), min(max(fx, 0), nx - 1)
        y1, x1 = min(max(fy + 1, 0), ny - 1), min(max(fx + 1, 0), nx - 1)
        wy, wx = y - y0, x - x0
        samples += [(k, y, x, y0, x0, (1 - wy) * (1 - wx)), (k, y, x, y0, x1, (1 - wy) * wx), (k, y, x, y1, x0, wy * (1 - wx)), (k, y, x, y1, x1, wy * wx)]
    corners = weight_table(df, samples, "point int, at_y double, at_x double, _j int, _i int, _w double")
    parts = df.select(*by, "j", "i", F.col(value).alias("_v")).join(corners, (F.col("j") == F.col("_j")) & (F.col("i") == F.col("_i")))
    return parts.groupBy(*by, "point", "at_y", "at_x").agg(F.sum(F.col("_v") * F.col("_w")).alias(value))


def _bracket_index(source: list[float], targets: list[float]) -> list[tuple[int, float, int, float]]:
    """(target index, target, source index, weight of the next one); extrapolates."""
    if any(b <= a for a, b in zip(source, source[1:])):
        raise ValueError("source coordinates must rise")
    out = []
    for n, t in enumerate(targets):
        k = min(max(bisect_left(source, t) - 1, 0), len(source) - 2)
        out.append((n, float(t), k, (t - source[k]) / (source[k + 1] - source[k])))
    return out


def regrid_regular(df: DataFrame, value: str, source_x: list[float], source_y: list[float], target_x: list[float], target_y: list[float], by: list[str]) -> DataFrame:
    """Bilinear on rising axes; linear extrapolation outside. Each axis is an
    equi-join with its weights and a sum: first along x, then along y, so the
    rows in between are those of one axis only."""
    def along(rows: DataFrame, index: str, others: list[str], source, targets) -> DataFrame:
        found = _bracket_index(source, targets)
        terms = [(n, k + d, float(w if d else 1 - w)) for n, _, k, w in found for d in (0, 1)]
        weights = weight_table(df, terms, "_n int, _k int, _w double")
        met = rows.join(weights, F.col(index) == F.col("_k"))
        return met.groupBy(*others, F.col("_n").alias(index)).agg(F.sum(F.col("_v") * F.col("_w")).alias("_v"))

    cells = df.select(*by, "j", "i", F.col(value).alias("_v"))
    out = along(along(cells, "i", [*by, "j"], source_x, target_x), "j", [*by, "i"], source_y, target_y)
    return out.select(*by, "j", "i", F.col("_v").alias(value))


def boundary_discontinuity(df: DataFrame, value: str, shape: tuple[int, int], by: list[str], width: int = 1) -> DataFrame:
    """Mean of the rim (corners once), of the interior, and their difference; skipping NaN."""
    ny, nx = shape
    inner = F.col("j").between(width, ny - 1 - width) & F.col("i").between(width, nx - 1 - width)
    v = F.nanvl(F.col(value), F.lit(None).cast("double"))
    out = df.groupBy(*by).agg(F.avg(F.when(~inner, v)).alias("edge_mean"), F.avg(F.when(inner, v)).alias("interior_mean"))
    return out.withColumn("difference", F.col("edge_mean") - F.col("interior_mean"))


def top_hat_coarsen(df: DataFrame, value: str, factor_y: int, by: list[str], shape: tuple[int, int], factor_x: int | None = None, trim: bool = False) -> DataFrame:
    """Block means; sizes that the factors do not divide raise unless ``trim`` drops the rest."""
    factor_x = factor_x or factor_y
    ny, nx = shape
    if not trim and (ny % factor_y or nx % factor_x):
        raise ValueError("factors must divide the grid; pass trim=True to drop the rest")
    kept = df.where((F.col("j") < ny // factor_y * factor_y) & (F.col("i") < nx // factor_x * factor_x))
    j, i = F.floor(F.col("j") / factor_y).cast("int"), F.floor(F.col("i") / factor_x).cast("int")
    return kept.groupBy(*by, j.alias("j"), i.alias("i")).agg(F.avg(value).alias(value))


def resolved_subfilter(value, filtered) -> tuple[Column, Column]:
    return col(filtered), col(value) - col(filtered)


def filtered_tke(df: DataFrame, u: str, v: str, w: str, by: list[str], method: str = "butterworth", **options) -> DataFrame:
    """Energy over the plane of u, v and w once filtered: by ``butterworth_plane``
    (options dx, cutoff_wavelength, order, dy, kind), or by block means (``top_hat``
    or ``honnert``; options factor and shape)."""
    from aeroframe.operators import spectral
    from aeroframe.operators.turbulence import resolved_tke

    if method == "butterworth":
        return spectral.filtered_energy(df, [u, v, w], by, **options)
    if method not in ("top_hat", "honnert"):
        raise ValueError("method must be butterworth, top_hat or honnert")
    factor, shape = options["factor"], options["shape"]
    if shape[0] % factor or shape[1] % factor:
        raise ValueError("the factor must divide the grid")
    j, i = F.floor(F.col("j") / factor).cast("int"), F.floor(F.col("i") / factor).cast("int")
    means = df.groupBy(*by, j.alias("j"), i.alias("i")).agg(*[F.avg(c).alias(c) for c in (u, v, w)])
    return means.groupBy(*by).agg(resolved_tke(u, v, w).alias("tke"))
