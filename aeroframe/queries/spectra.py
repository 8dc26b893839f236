"""Spectra, filters and cycles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.operators import grid, spectral
from aeroframe.queries.registry import frame, rounded

c = F.col
_DFT = """d AS (SELECT vec_id, n, x - avg(x) OVER (PARTITION BY vec_id) AS x, x * n - avg(x * n) OVER (PARTITION BY vec_id) AS y FROM {view}),
  t AS (SELECT vec_id, b::INT AS bin, sum(x * cos(2 * pi() * b * n / 64)) AS re, -sum(x * sin(2 * pi() * b * n / 64)) AS im, sum(y * cos(2 * pi() * b * n / 64)) AS re2, -sum(y * sin(2 * pi() * b * n / 64)) AS im2 FROM d, range(33) r(b) GROUP BY 1, 2)"""
_W = "CASE WHEN bin BETWEEN 1 AND 31 THEN 2 ELSE 1 END"
frame("power_spectrum", "signal", lambda df: spectral.power_spectrum(df, "x", ["vec_id"], "n", 0.5).select("vec_id", "bin", rounded("frequency").alias("frequency"), rounded("power").alias("power")),
      f"WITH {_DFT} SELECT vec_id, bin, round(bin / 32.0, 6) AS frequency, round({_W} * 0.5 / 64 * (re * re + im * im), 6) AS power FROM t")
frame("power_spectrum_relational", "signal", lambda df: spectral.power_spectrum_relational(df, "x", ["vec_id"], "n", 64, 0.5).select("vec_id", "bin", rounded("frequency").alias("frequency"), rounded("power").alias("power")),
      f"WITH {_DFT} SELECT vec_id, bin, round(bin / 32.0, 6) AS frequency, round({_W} * 0.5 / 64 * (re * re + im * im), 6) AS power FROM t")
frame("cross_spectrum", "signal", lambda df: spectral.cross_spectrum(df.withColumn("y", c("x") * c("n")), "x", "y", ["vec_id"], "n").select("vec_id", "bin", rounded("re", 5).alias("re"), rounded("im", 5).alias("im")),
      f"WITH {_DFT} SELECT vec_id, bin, round({_W} / 64.0 * (re * re2 + im * im2), 5) AS re, round({_W} / 64.0 * (im * re2 - re * im2), 5) AS im FROM t")
frame("component_spectra", "signal", lambda df: spectral.component_spectra(df.withColumn("y", c("x") * c("n")).withColumn("z", c("x") * 2), "x", "y", "z", ["vec_id"], "n").select("vec_id", "bin", *[rounded(x, 5).alias(x) for x in ("u", "v", "w", "tke")]),
      f"""WITH {_DFT}, p AS (SELECT vec_id, bin, {_W} / 64.0 * (re * re + im * im) AS u, {_W} / 64.0 * (re2 * re2 + im2 * im2) AS v FROM t)
      SELECT vec_id, bin, round(u, 5) AS u, round(v, 5) AS v, round(4 * u, 5) AS w, round(0.5 * (u + v + 4 * u), 5) AS tke FROM p""")
_SEG = """g AS (SELECT vec_id, s, n - 16 * s AS m, x, x * x AS y FROM {view}, range(3) q(s) WHERE n BETWEEN 16 * s AND 16 * s + 31),
  h AS (SELECT vec_id, s, m, (x - avg(x) OVER p) * (0.5 - 0.5 * cos(2 * pi() * m / 31)) AS x, (y - avg(y) OVER p) * (0.5 - 0.5 * cos(2 * pi() * m / 31)) AS y FROM g WINDOW p AS (PARTITION BY vec_id, s)),
  t AS (SELECT vec_id, s, b::INT AS bin, sum(x * cos(2 * pi() * b * m / 32)) AS re, -sum(x * sin(2 * pi() * b * m / 32)) AS im, sum(y * cos(2 * pi() * b * m / 32)) AS re2, -sum(y * sin(2 * pi() * b * m / 32)) AS im2 FROM h, range(17) r(b) GROUP BY 1, 2, 3)"""
frame("welch_spectrum", "signal", lambda df: spectral.welch_spectrum(df, "x", ["vec_id"], "n", 4.0, 32, 16).select("vec_id", "bin", rounded("frequency").alias("frequency"), rounded("power").alias("power")),
      f"""WITH {_SEG} SELECT vec_id, bin, round(bin / 8.0, 6) AS frequency, round(CASE WHEN bin BETWEEN 1 AND 15 THEN 2 ELSE 1 END * avg(re * re + im * im) / (4 * (SELECT sum(pow(0.5 - 0.5 * cos(2 * pi() * i / 31), 2)) FROM range(32) w(i))), 6) AS power FROM t GROUP BY vec_id, bin""")
frame("coherence", "signal", lambda df: spectral.coherence(df.withColumn("y", c("x") * c("x")), "x", "y", ["vec_id"], "n", 4.0, 32, 16).select("vec_id", "bin", rounded("coherence", 5).alias("coherence")),
      f"""WITH {_SEG}, m AS (SELECT vec_id, bin, avg(re * re2 + im * im2) AS a, avg(im * re2 - re * im2) AS b, avg(re * re + im * im) AS p, avg(re2 * re2 + im2 * im2) AS q FROM t GROUP BY vec_id, bin)
      SELECT vec_id, bin, round(least(1, greatest(0, (a * a + b * b) / (p * q))), 5) AS coherence FROM m""")
frame("log_bin", "signal", lambda df: spectral.log_bin(df.select("vec_id", (c("n") * 1.0).alias("f"), "x"), "f", "x", ["vec_id"], 7).select("vec_id", "bin", rounded("frequency").alias("frequency"), F.nanvl(rounded("power"), F.lit(-99.0)).alias("power")),
      """WITH e AS (SELECT vec_id, n AS f, x, floor(ln(n) / (ln(63) / 7))::INT AS bin FROM {view} WHERE n > 0), m AS (SELECT vec_id, bin, avg(x) AS x FROM e WHERE bin < 7 AND f < 63 GROUP BY 1, 2)
      SELECT v.vec_id, b::INT AS bin, round(exp((b + 0.5) * ln(63) / 7), 6) AS frequency, coalesce(round(m.x, 6), -99) AS power FROM (SELECT DISTINCT vec_id FROM {view}) v CROSS JOIN range(7) r(b) LEFT JOIN m ON m.vec_id = v.vec_id AND m.bin = b""")
frame("radial_wavenumber_spectrum", "plane", lambda df: spectral.radial_wavenumber_spectrum(df, "x", ["vec_id"], 1.0).select("vec_id", "bin", rounded("wavenumber").alias("wavenumber"), rounded("power").alias("power")),
      """WITH d AS (SELECT vec_id, j, i, x - avg(x) OVER (PARTITION BY vec_id) AS x FROM {view}),
      k AS (SELECT a, b, sqrt(pow((CASE WHEN a >= 4 THEN a - 8 ELSE a END) / 8.0::DOUBLE, 2) + pow((CASE WHEN b >= 4 THEN b - 8 ELSE b END) / 8.0::DOUBLE, 2)) AS r FROM range(8) p(a), range(8) q(b)),
      t AS (SELECT vec_id, a, b, r, sum(x * cos(2 * pi() * (a * j + b * i) / 8)) AS re, sum(x * sin(2 * pi() * (a * j + b * i) / 8)) AS im FROM d, k GROUP BY 1, 2, 3, 4),
      g AS (SELECT vec_id, (r >= 1 * (sqrt(0.5) / 4))::INT + (r >= 2 * (sqrt(0.5) / 4))::INT + (r >= 3 * (sqrt(0.5) / 4))::INT + (r >= sqrt(0.5))::INT AS bin, (re * re + im * im) / 64 AS p FROM t)
      SELECT vec_id, bin, round((bin + 0.5) * sqrt(0.5) / 4, 6) AS wavenumber, round(avg(p), 6) AS power FROM g WHERE bin < 4 GROUP BY vec_id, bin""")
# wavenumbers a, b of an 8 x 8 plane with their coefficients, and the response of a filter at 100 m spacing
_WAVES = """f AS (SELECT vec_id, a, b, sum(x * cos(2 * pi() * (a * j + b * i) / 8)) AS re, -sum(x * sin(2 * pi() * (a * j + b * i) / 8)) AS im FROM {view}, range(-4, 4) p(a), range(-4, 4) q(b) GROUP BY 1, 2, 3)"""
_LOW = "pow(1 + pow(sqrt(a * a + b * b) / 800.0 * {0}, 4), -0.5)"


def _inverse(response: str, size: int = 8) -> str:
    half = size // 2
    return f"""WITH {_WAVES} SELECT vec_id, j::INT AS j, i::INT AS i, 0.0::DOUBLE + round(sum({response} * (re * cos(2 * pi() * (a * j + b * i) / {size}) - im * sin(2 * pi() * (a * j + b * i) / {size}))) / 64, 6) AS x
      FROM f, range({size}) y(j), range({size}) z(i) WHERE a BETWEEN {-half} AND {half - 1} AND b BETWEEN {-half} AND {half - 1} GROUP BY 1, 2, 3"""


def _plane(df: DataFrame) -> DataFrame:
    return df.select("vec_id", "j", "i", rounded("x").alias("x"))


frame("butterworth_spatial", "plane", lambda df: _plane(spectral.butterworth_spatial(df, "x", ["vec_id"], 100.0, 400.0)), _inverse(_LOW.format("400.0")))
frame("butterworth_band", "plane", lambda df: _plane(spectral.butterworth_band(df, "x", ["vec_id"], 100.0, 300.0, 600.0)),
      _inverse(f"{_LOW.format('300.0')} * sqrt(greatest(0, 1 - pow({_LOW.format('600.0')}, 2)))"))
frame("spectral_downsample", "plane", lambda df: _plane(spectral.spectral_downsample(df, "x", ["vec_id"], 2)), _inverse("1", 4))
frame("filtered_tke_butterworth", "plane", lambda df: grid.filtered_tke(df.select("vec_id", "j", "i", (c("x") * 10).alias("u"), (c("x") * 20).alias("v"), (c("x") * 5).alias("w")), "u", "v", "w", ["vec_id"], dx=100.0, cutoff_wavelength=400.0).select("vec_id", rounded("tke").alias("tke")),
      f"WITH {_WAVES} SELECT vec_id, round(0.5 * 525 * sum((re * re + im * im) * pow({_LOW.format('400.0')}, 2)) / 4096, 6) AS tke FROM f WHERE a <> 0 OR b <> 0 GROUP BY vec_id")


def _cycles(df: DataFrame) -> DataFrame:
    return spectral.rainflow_cycles(df, "x", ["vec_id"], "n")


frame("rainflow_cycles", "signal", _cycles)
