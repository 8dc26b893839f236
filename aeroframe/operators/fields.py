"""Turbulent wind fields: long tables (t, k, j, u, v, w) and one metadata record."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.functions.wind import rotate_velocity


@dataclass(frozen=True)
class FieldMeta:
    """Grid of a wind field: sizes, spacings (m, s) and heights (m)."""

    nt: int
    nz: int
    ny: int
    dy: float
    dz: float
    dt: float
    hub_height: float
    bottom_height: float
    description: str = ""
    mean_speed: float | None = None

    def __post_init__(self):
        if min(self.nt, self.nz, self.ny) < 1 or min(self.dy, self.dz, self.dt) <= 0:
            raise ValueError("sizes and spacings must be positive")


def check_finite(field: DataFrame) -> DataFrame:
    """The field; reading it raises at the first velocity that is not finite."""
    good = lambda c: F.when(F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf")), F.col(c)).otherwise(F.raise_error(F.lit("velocity must be finite")).cast("double"))
    return field.select("t", "k", "j", *[good(c).alias(c) for c in ("u", "v", "w")])


def with_mean_speed(field: DataFrame, meta: FieldMeta) -> FieldMeta:
    """Mean longitudinal speed at hub height, over time and the lateral axis."""
    level = min(max(round((meta.hub_height - meta.bottom_height) / meta.dz), 0), meta.nz - 1)
    return replace(meta, mean_speed=field.where(F.col("k") == level).agg(F.avg("u")).first()[0])


def from_components(
    df: DataFrame, components: tuple[str, str, str], time: str, vertical: str, lateral: str, sizes: tuple[int, int, int],
    order: tuple[str, str, str] = ("u", "v", "w"), signs: tuple[float, float, float] = (1.0, 1.0, 1.0), reverse_vertical: bool = False, reverse_lateral: bool = False,
) -> DataFrame:
    """A field from model components: ``order`` names what each of u, v, w is taken
    from, ``signs`` go with the result; sizes are (nt, nz, ny)."""
    if sorted(order) != ["u", "v", "w"]:
        raise ValueError("order must be a permutation of u, v, w")
    source = dict(zip(("u", "v", "w"), components))
    _, nz, ny = sizes
    k = F.lit(nz - 1) - F.col(vertical) if reverse_vertical else F.col(vertical)
    j = F.lit(ny - 1) - F.col(lateral) if reverse_lateral else F.col(lateral)
    made = [(F.col(source[o]).cast("double") * s).alias(c) for c, o, s in zip("uvw", order, signs)]
    return df.select(F.col(time).cast("int").alias("t"), k.cast("int").alias("k"), j.cast("int").alias("j"), *made)


def nearest_index(meta: FieldMeta, y: float = 0.0, z: float | None = None) -> tuple[int, int]:
    """(k, j) nearest to a lateral offset from the centre and a height; halves go to even."""
    j = round(y / meta.dy + (meta.ny - 1) / 2)
    k = round(((meta.hub_height if z is None else z) - meta.bottom_height) / meta.dz)
    return min(max(k, 0), meta.nz - 1), min(max(j, 0), meta.ny - 1)


def velocity_at(field: DataFrame, meta: FieldMeta, y: float = 0.0, z: float | None = None) -> DataFrame:
    k, j = nearest_index(meta, y, z)
    return field.where((F.col("k") == k) & (F.col("j") == j)).select("t", "u", "v", "w")


def horizontal_plane(field: DataFrame, meta: FieldMeta, z: float) -> DataFrame:
    k, _ = nearest_index(meta, 0.0, z)
    return field.where(F.col("k") == k).select("t", "j", "u", "v", "w")


def vertical_profile(field: DataFrame, meta: FieldMeta) -> DataFrame:
    return field.groupBy("k").agg(*[F.avg(c).alias(c) for c in "uvw"]).withColumn("height", F.col("k") * meta.dz + meta.bottom_height)


def concatenate_fields(fields: list[tuple[DataFrame, FieldMeta]]) -> tuple[DataFrame, FieldMeta]:
    """Append in time; grids must agree, the mean speed is taken anew."""
    (_, first), out, offset = fields[0], None, 0
    for df, meta in fields:
        grid = lambda m: (m.nz, m.ny, m.dy, m.dz, m.dt, m.hub_height, m.bottom_height)
        if grid(meta) != grid(first):
            raise ValueError("field grids differ")
        part = df.withColumn("t", F.col("t") + offset)
        out = part if out is None else out.unionByName(part)
        offset += meta.nt
    return out, with_mean_speed(out, replace(first, nt=offset))


def rotate_field(field: DataFrame, horizontal_degrees: float = 0.0, vertical_degrees: float = 0.0) -> DataFrame:
    u, v, w = rotate_velocity("u", "v", "w", horizontal_degrees, vertical_degrees)
    return field.select("t", "k", "j", u.alias("u"), v.alias("v"), w.alias("w"))


def _grid(spark: SparkSession, nt: int, nz: int, ny: int) -> DataFrame:
    n = spark.range(nt * nz * ny).select(F.col("id").alias("n"))
    return n.select(F.floor(F.col("n") / (nz * ny)).cast("int").alias("t"), (F.floor(F.col("n") / ny) % nz).cast("int").alias("k"), (F.col("n") % ny).cast("int").alias("j"))


def constant_field(spark: SparkSession, speed: float, duration: float, dt: float, ny: int, nz: int, direction: float = 0.0) -> DataFrame:
    return step_rows(_grid(spark, round(duration / dt) + 1, nz, ny), [speed], 1 << 60, direction)


def step_field(spark: SparkSession, speeds: list[float], step_duration: float, dt: float, ny: int, nz: int, direction: float = 0.0) -> DataFrame:
    records = max(1, round(step_duration / dt))
    return step_rows(_grid(spark, records * len(speeds), nz, ny), speeds, records, direction)


def step_rows(grid: DataFrame, speeds: list[float], records: int, direction: float) -> DataFrame:
    speed = F.get(F.array(*[F.lit(float(s)) for s in speeds]), F.floor(F.col("t") / F.lit(records)).cast("int"))
    a = math.radians(direction)
    return grid.select("t", "k", "j", (speed * math.cos(a)).alias("u"), (speed * math.sin(a)).alias("v"), F.lit(0.0).alias("w"))


def synthetic_wind_field(spark: SparkSession, mean_speed: float, nt: int, ny: int, nz: int, dt: float, dy: float, dz: float, sigma: float = 1.0, length_scale: float = 100.0, seed: int = 0) -> DataFrame:
    """Seeded noise, smoothed in each plane and scaled to ``sigma``. Demonstration
    only. Each time step has a stream of its own, so any step can be made anew."""
    def run(batches):
        k = np.hypot(np.fft.fftfreq(nz, dz)[:, None], np.fft.fftfreq(ny, dy)[None, :])
        smooth = np.exp(-0.5 * k * length_scale)
        for b in batches:
            for t in b["t"]:
                noise = np.random.default_rng([seed, int(t)]).standard_normal((3, nz, ny))
                field = np.fft.ifft2(np.fft.fft2(noise) * smooth).real
                kk, jj = np.indices((nz, ny))
                yield pd.DataFrame({"t": int(t), "k": kk.ravel(), "j": jj.ravel(), **{c: f.ravel() for c, f in zip("uvw", field)}})

    raw = spark.range(nt).select(F.col("id").cast("int").alias("t")).mapInPandas(run, "t int, k int, j int, u double, v double, w double")
    # one row of deviations, so its broadcast has a fixed size
    spread = raw.agg(*[F.stddev_pop(c).alias(f"_{c}") for c in "uvw"])
    scaled = {c: F.when(F.col(f"_{c}") > 0, F.col(c) / F.col(f"_{c}") * sigma).otherwise(0.0) for c in "uvw"}
    return raw.crossJoin(F.broadcast(spread)).select("t", "k", "j", (scaled["u"] + mean_speed).alias("u"), scaled["v"].alias("v"), scaled["w"].alias("w"))


def scaling(c: str) -> tuple[Column, Column]:
    """16-bit slope and offset of a component (single precision), from its least and largest value."""
    low, high = F.min(c), F.max(c)
    span = high - low
    slope = F.when(span > 0, F.try_divide(F.lit(65535.0), span)).otherwise(1.0)
    offset = F.when(span > 0, F.lit(-32768.0) - low * slope).otherwise(-low)
    return slope.cast("float"), offset.cast("float")


def quantise(field: DataFrame) -> DataFrame:
    """Packed codes and decoded values: adds cu, cv, cw and du, dv, dw."""
    parts = []
    for c in "uvw":
        slope, offset = scaling(c)
        parts += [slope.cast("double").alias(f"_s{c}"), offset.cast("double").alias(f"_o{c}")]
    # one row, so its broadcast has a fixed size
    rows = field.crossJoin(F.broadcast(field.agg(*parts)))
    code = {c: F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(F.col(c) * F.col(f"_s{c}") + F.col(f"_o{c}")))) for c in "uvw"}
    return rows.select(*field.columns, *[x.cast("int").alias(f"c{c}") for c, x in code.items()], *[((x - F.col(f"_o{c}")) / F.col(f"_s{c}")).alias(f"d{c}") for c, x in code.items()])


def max_error(first: DataFrame, second: DataFrame) -> DataFrame:
    """Largest difference, root mean square, and rows that only one field has."""
    both = first.toDF("t", "k", "j", "u", "v", "w").join(second.toDF("t", "k", "j", "u2", "v2", "w2"), ["t", "k", "j"], "full")
    gap = F.greatest(*[F.abs(F.col(c) - F.col(f"{c}2")) for c in "uvw"])
    square = sum((F.col(c) - F.col(f"{c}2")) * (F.col(c) - F.col(f"{c}2")) for c in "uvw")
    return both.agg(F.max(gap).alias("max_abs_error"), F.sqrt(F.avg(square) / 3).alias("rmse"), F.count_if(F.col("u").isNull() | F.col("u2").isNull()).alias("unmatched"))
