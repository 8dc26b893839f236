"""Binary wind and channel formats: whole files through the binaryFile reader,
decoded in Arrow batches; one file must fit one executor's Python worker. Full
fields are cut there into runs of time steps, which all tasks decode."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.operators.fields import FieldMeta, scaling
from aeroframe.sources import sinks

# Series of a hub-height record, after its time.
HUB = ("u", "uh", "ut", "v", "w", "u_prime", "v_prime", "w_prime", "uw", "uv", "vw", "tke", "ctke")
CELLS = "path string, t int, k int, j int, u double, v double, w double"
# Cells of a full field that are decoded at a time, one plane at least.
RUN = 1 << 17


class _Bytes:
    """A cursor over little-endian content."""

    def __init__(self, content: bytes | memoryview):
        self.content, self.at = content, 0

    def take(self, form: str):
        form = "<" + form
        out = struct.unpack_from(form, self.content, self.at)
        self.at += struct.calcsize(form)
        return out

    def array(self, kind: str, count: int = -1) -> np.ndarray:
        out = np.frombuffer(self.content, kind, count, self.at)
        self.at += out.nbytes
        return out

    def rest(self, kind: str) -> np.ndarray:
        return self.array(kind, (len(self.content) - self.at) // np.dtype(kind).itemsize)

    def text(self, size: int) -> str:
        out = self.content[self.at : self.at + size]
        self.at += size
        return bytes(out).decode("utf-8", "replace")


def parse_bts(content: bytes | memoryview) -> tuple[FieldMeta, np.ndarray, np.ndarray, np.ndarray]:
    """Full-field wind file -> metadata, codes (t, k, j, component), slopes and offsets."""
    b = _Bytes(content)
    kind, nz, ny, tower, nt = b.take("hiiii")
    if kind not in (7, 8):
        raise ValueError(f"unknown full-field kind {kind}")
    dz, dy, dt, mean, hub, bottom = b.take("6f")
    packed = b.take("6f")
    (size,) = b.take("i")
    if not 0 <= size <= 1_000_000:
        raise ValueError("bad description length")
    description = b.text(size)
    if len(content) - b.at < 2 * nt * nz * ny * 3:
        raise ValueError("the file ends before its velocities do")
    codes = b.array("<i2", nt * nz * ny * 3).reshape(nt, nz, ny, 3)
    return FieldMeta(nt, nz, ny, dy, dz, dt, hub, bottom, description, mean), codes, np.array(packed[::2], float), np.array(packed[1::2], float)


def parse_wnd(content: bytes | memoryview) -> tuple[FieldMeta, np.ndarray, np.ndarray, np.ndarray]:
    """Newer-style full-field file with intensities -> metadata, codes, slopes and
    offsets; hub height falls back to the grid's centre."""
    b = _Bytes(content)
    kind, _ = b.take("hh")
    if kind != -99:
        raise ValueError("only the newer style is supported")
    (n,) = b.take("i")
    _, _, centre, *ti, dz, dy, dx = b.take("9f")
    half, mean = b.take("if")
    b.take("fffii")
    nz, ny = b.take("ii")
    b.at += 12 * (n - 1)
    nt = max(2 * half, 1)
    codes = b.rest("<i2")
    if len(codes) < nt * nz * ny * n:
        raise ValueError("the file ends before its velocities do")
    codes = codes[: nt * nz * ny * n].reshape(nt, nz, ny, n)
    return FieldMeta(nt, nz, ny, dy, dz, dx / mean, centre, centre - dz * (nz - 1) / 2, "", mean), codes, 1e-5 * mean * np.array(ti), np.array([mean, 0.0, 0.0])


def _files(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _fields(spark: SparkSession, path: str, parse, velocity) -> DataFrame:
    """Cells of full-field files. The task that reads a file only cuts its codes
    into runs of time steps; ``velocity(codes, slope, offset)`` is worked out where they are dealt to."""
    def cut(batches):
        for b in batches:
            for name, content in zip(b.column("path").to_pylist(), b.column("content")):
                meta, codes, slope, offset = parse(memoryview(content.as_buffer()))
                steps = max(1, RUN // (meta.nz * meta.ny))
                for t in range(0, meta.nt, steps):
                    one = {"path": [name], "t": [t], "nz": [meta.nz], "ny": [meta.ny], "slope": [slope.tolist()], "offset": [offset.tolist()]}
                    kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()))
                    made = [pa.array(x, kind) for x, kind in zip(one.values(), kinds)]
                    yield pa.RecordBatch.from_arrays([*made, pa.array([codes[t : t + steps].tobytes()], pa.binary())], names=[*one, "codes"])

    def run(batches):
        for b in batches:
            for n in range(b.num_rows):
                name, start, nz, ny, slope, offset = (b.column(c)[n].as_py() for c in ("path", "t", "nz", "ny", "slope", "offset"))
                codes = np.frombuffer(b.column("codes")[n].as_buffer(), "<i2").reshape(-1, nz, ny, len(slope))
                v = velocity(codes, np.array(slope), np.array(offset))
                at = np.indices(v.shape[:3], np.int32).reshape(3, -1)
                at[0] += start
                cells = [pa.repeat(pa.scalar(name, pa.string()), at.shape[1]), *map(pa.array, at), *(pa.array(np.ascontiguousarray(v[..., m]).ravel()) for m in range(3))]
                yield pa.RecordBatch.from_arrays(cells, names=["path", *"tkjuvw"])

    runs = _files(spark, path).mapInArrow(cut, "path string, t int, nz int, ny int, slope array<double>, offset array<double>, codes binary")
    return runs.repartition("path", "t").mapInArrow(run, CELLS)


def read_bts(spark: SparkSession, path: str) -> DataFrame:
    return _fields(spark, path, parse_bts, lambda codes, slope, offset: (codes.astype(float) - offset) / slope)


def read_bladed_wnd(spark: SparkSession, path: str, clockwise: bool = False) -> DataFrame:
    side = -1 if clockwise else 1
    return _fields(spark, path, parse_wnd, lambda codes, slope, offset: (codes * slope + offset)[:, :, ::side])


def read_meta(spark: SparkSession, path: str, kind: str = "bts", hub_height: float | None = None) -> DataFrame:
    """One metadata row per file; ``hub_height`` takes the place of a file's own."""
    parse = parse_bts if kind == "bts" else parse_wnd
    own = {"hub_height": float(hub_height)} if hub_height else {}

    def run(batches):
        for b in batches:
            yield pd.DataFrame([{"path": name, **parse(content)[0].__dict__, **own} for name, content in zip(b["path"], b["content"])])

    return _files(spark, path).mapInPandas(run, "path string, nt int, nz int, ny int, dy double, dz double, dt double, hub_height double, bottom_height double, description string, mean_speed double")


def read_coherent_points(spark: SparkSession, path: str) -> DataFrame:
    """(path, time, point, u, v, w)"""
    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                c = _Bytes(content)
                kind, n, nt = c.take("hii")
                if kind != -99 or n != 3:
                    raise ValueError("not a coherent-points file")
                dx, mean, *ti = c.take("5f")
                codes = c.rest("<i2")
                if len(codes) % (nt * 3):
                    raise ValueError("incomplete coherent-points data")
                v = codes.reshape(nt, -1, 3) * (1e-5 * mean * np.array(ti)) + np.array([mean, 0, 0])
                t, p = np.indices(v.shape[:2])
                yield pd.DataFrame({"path": name, "time": t.ravel() * dx / mean, "point": p.ravel(), **{x: v[..., m].ravel() for m, x in enumerate("uvw")}})

    return _files(spark, path).mapInPandas(run, "path string, time double, point int, u double, v double, w double")


def read_hub_height_binary(spark: SparkSession, path: str) -> DataFrame:
    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                if len(content) % 56:
                    raise ValueError("incomplete hub-height records")
                rows = np.frombuffer(content, "<f4").reshape(-1, 14).astype(float)
                yield pd.DataFrame({"path": name, "time": rows[:, 0], **{c: rows[:, k] for k, c in enumerate(HUB, 1)}})

    return _files(spark, path).mapInPandas(run, "path string, time double, " + ", ".join(f"{c} double" for c in HUB))


def read_binary_output(spark: SparkSession, path: str) -> DataFrame:
    """(path, time, channel, unit, value) of packed simulation output, with and without stored times."""
    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                c = _Bytes(content)
                kind, n, nt = c.take("hii")
                if kind not in (1, 2):
                    raise ValueError(f"unknown output kind {kind}")
                p, q = c.take("dd")
                slope, offset = c.array("<f4", n).astype(float), c.array("<f4", n).astype(float)
                c.text(*c.take("i"))
                names = [c.text(10).strip() for _ in range(n + 1)]
                units = [c.text(10).strip().strip("()[]") for _ in range(n + 1)]
                time = (c.array("<i4", nt) - q) / p if kind == 1 else p + q * np.arange(nt)
                value = (c.array("<i2", nt * n).reshape(nt, n) - offset) / slope
                for k in range(n):
                    yield pd.DataFrame({"path": name, "time": time, "channel": names[k + 1] or f"channel_{k + 1}", "unit": units[k + 1], "value": value[:, k]})

    return _files(spark, path).mapInPandas(run, "path string, time double, channel string, unit string, value double")


def _payload(field: DataFrame, codes: list) -> DataFrame:
    """Packed codes in time order, those of a batch of time steps in a row."""
    parts = ["cu", "cv", "cw"]
    steps = field.select("t", F.struct("k", "j", *codes).alias("_c")).groupBy("t").agg(F.sort_array(F.collect_list("_c")).alias("_s"))

    def run(batches):
        for b in batches:
            packed = np.stack([b.column(c).flatten().to_numpy(zero_copy_only=False) for c in parts], axis=1).astype("<i2")
            yield pa.RecordBatch.from_arrays([pa.array([packed.tobytes()], pa.binary())], names=["codes"])

    return steps.select("t", *[F.col(f"_s.{c}").alias(c) for c in parts]).orderBy("t").select(*parts).mapInArrow(run, "codes binary")


def _stream(target: str, header: bytes, payload: DataFrame) -> str:
    """The driver holds two partitions of time steps at a time, one of them under way."""
    with sinks.opened(payload.sparkSession, target) as write:
        write(header)
        for row in payload.toLocalIterator(prefetchPartitions=True):
            write(row["codes"])
    return target


def _code(x):
    return F.greatest(F.lit(-32768.0), F.least(F.lit(32767.0), F.rint(x))).cast("smallint")


def write_bts(field: DataFrame, meta: FieldMeta, path: str) -> str:
    """Scales come from one aggregate; codes are made where the rows are."""
    parts = [x.alias(f"{n}{c}") for c in "uvw" for n, x in zip("so", scaling(c))]
    s = field.agg(*parts).first()
    text = meta.description.encode("utf-8")
    header = struct.pack("<hiiii6f", 7, meta.nz, meta.ny, 0, meta.nt, meta.dz, meta.dy, meta.dt, meta.mean_speed or 0.0, meta.hub_height, meta.bottom_height)
    header += struct.pack("<6fi", *[s[f"{n}{c}"] for c in "uvw" for n in "so"], len(text)) + text
    return _stream(str(path), header, _payload(field, [_code(F.col(c) * float(s[f"s{c}"]) + float(s[f"o{c}"])).alias(f"c{c}") for c in "uvw"]))


def write_bladed_wnd(field: DataFrame, meta: FieldMeta, path: str, latitude: float = 0.0, roughness: float = 0.0, clockwise: bool = False) -> str:
    if meta.nt % 2:
        raise ValueError("an even number of time steps is needed")
    mean = float(meta.mean_speed)
    spread = field.agg(*[F.stddev_pop(c).alias(c) for c in "uvw"]).first()
    ti = [max(100 * spread[c] / max(abs(mean), 2.220446049250313e-16), 1e-6) for c in "uvw"]
    shown = field.withColumn("j", F.lit(meta.ny - 1) - F.col("j")) if clockwise else field
    codes = [_code((F.col(c) - (mean if c == "u" else 0.0)) / (1e-5 * mean * x)).alias(f"c{c}") for c, x in zip("uvw", ti)]
    centre = meta.bottom_height + meta.dz * (meta.nz - 1) / 2
    header = struct.pack("<hhi9fif", -99, 4, 3, latitude, roughness, centre, *ti, meta.dz, meta.dy, meta.dt * mean, meta.nt // 2, mean)
    header += struct.pack("<fffii", 0, 0, 0, 0, 0) + struct.pack("<8i", meta.nz, meta.ny, 0, 0, 0, 0, 0, 0)
    return _stream(str(path), header, _payload(shown, codes))


def validate_bts(spark: SparkSession, path: str, expected: DataFrame, tolerance: float = 0.01) -> DataFrame:
    """The re-read field; raises where shapes differ or an error exceeds the tolerance."""
    from aeroframe.operators.fields import max_error

    actual = read_bts(spark, path).drop("path")
    found = max_error(actual, expected.select("t", "k", "j", "u", "v", "w")).first()
    if found["unmatched"]:
        raise ValueError("field shapes differ")
    if found["max_abs_error"] is not None and found["max_abs_error"] > tolerance:
        raise ValueError(f"round-trip error {found['max_abs_error']:.6g} exceeds {tolerance}")
    return actual


def write_uniform_wind(rows: DataFrame, path: str) -> str:
    """Text table of time, speed, direction, vertical speed (a small series)."""
    with sinks.opened(rows.sparkSession, path) as write:
        write(b"! Time WindSpeed WindDir VertSpeed\n")
        for r in rows.select("time", "speed", "direction", "vertical_speed").orderBy("time").toLocalIterator():
            write((" ".join(f"{x:.6f}" for x in r) + "\n").encode())
    return str(path)
