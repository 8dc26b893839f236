"""Classic NetCDF (CDF-1, -2 and -5) files as long tables, decoded with NumPy.

Files come through the binaryFile reader; a task decodes the named variables of
one file. Axes become t, k, j, i by dimension name; other dimensions keep theirs.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.operators.grid import weight_table

# The format's type codes.
TYPES = {1: "i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: "u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
# Attributes that files of one sequence must share.
SEQUENCE_ATTRIBUTES = ("GRID_ID", "DX", "DY", "MAP_PROJ", "CEN_LAT", "CEN_LON")
HORIZONTAL = ("south_north", "west_east", "south_north_stag", "west_east_stag")


@dataclass
class Variable:
    name: str
    dims: tuple[str, ...]
    kind: str
    size: int
    begin: int
    attributes: dict = field(default_factory=dict)


class Classic:
    """Header and variables of one file's bytes."""

    def __init__(self, content: bytes):
        if content[:3] != b"CDF" or content[3] not in (1, 2, 5):
            raise ValueError("not a classic NetCDF file")
        self.content, self.at, self.version = content, 4, content[3]
        self.records = self._count()
        self.dims: list[tuple[str, int]] = [(self._name(), self._count()) for _ in range(self._list())]
        self.attributes = self._attributes()
        self.variables = {v.name: v for v in (self._variable() for _ in range(self._list()))}
        moving = [v for v in self.variables.values() if v.dims and v.dims[0] == self.record_dim]
        self.stride = sum(v.size for v in moving)
        if len(moving) == 1:
            v = moving[0]
            self.stride = np.dtype(v.kind).itemsize * int(np.prod([self.length(d) for d in v.dims[1:]], dtype=int))

    @property
    def record_dim(self) -> str | None:
        return next((n for n, size in self.dims if size == 0), None)

    def length(self, name: str) -> int:
        return self.records if name == self.record_dim else dict(self.dims)[name]

    def _int(self) -> int:
        (x,) = struct.unpack_from(">i", self.content, self.at)
        self.at += 4
        return x

    def _count(self) -> int:
        if self.version != 5:
            return self._int()
        (x,) = struct.unpack_from(">q", self.content, self.at)
        self.at += 8
        return x

    def _list(self) -> int:
        self._int()
        return self._count()

    def _name(self) -> str:
        return self._bytes(self._count()).decode("utf-8")

    def _bytes(self, n: int) -> bytes:
        out = self.content[self.at : self.at + n]
        self.at += (n + 3) // 4 * 4
        return out

    def _attributes(self) -> dict:
        out = {}
        for _ in range(self._list()):
            name, kind, n = self._name(), TYPES[self._int()], self._count()
            raw = self._bytes(n * np.dtype(kind).itemsize)
            values = np.frombuffer(raw, kind)
            out[name] = raw.decode("utf-8", "replace").rstrip("\0") if kind == "S1" else values[0].item() if n == 1 else values.tolist()
        return out

    def _variable(self) -> Variable:
        name = self._name()
        dims = tuple(self.dims[self._count()][0] for _ in range(self._count()))
        attributes = self._attributes()
        kind, size = TYPES[self._int()], self._count()
        (begin,) = struct.unpack_from(">i" if self.version == 1 else ">q", self.content, self.at)
        self.at += 4 if self.version == 1 else 8
        return Variable(name, dims, kind, size, begin, attributes)

    def read(self, name: str) -> np.ndarray:
        if name not in self.variables:
            raise KeyError(f"{name} is not one of {', '.join(list(self.variables)[:20])}")
        v = self.variables[name]
        shape = [self.length(d) for d in v.dims]
        if v.dims and v.dims[0] == self.record_dim:
            n = int(np.prod(shape[1:], dtype=int))
            rows = [np.frombuffer(self.content, v.kind, n, v.begin + r * self.stride) for r in range(self.records)]
            return np.concatenate(rows).reshape(shape) if rows else np.empty(shape, v.kind)
        return np.frombuffer(self.content, v.kind, int(np.prod(shape, dtype=int)), v.begin).reshape(shape)


def axis(dim: str) -> str:
    for prefix, name in (("Time", "t"), ("bottom_top", "k"), ("south_north", "j"), ("west_east", "i")):
        if dim.startswith(prefix):
            return name
    return dim


def column(variable: str, axes: list[str]) -> str:
    """A variable's column; names of axes are taken (in either case), and get a final underscore."""
    return f"{variable}_" if variable.lower() in {a.lower() for a in axes} else variable


def _content(spark: SparkSession, path) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _axes(spark: SparkSession, path, variables: list[str]) -> list[str]:
    """The axes that the variables share, from one file's header, read in a task."""
    one = spark.read.format("binaryFile").load(path).select("path").limit(1).first()
    if one is None:
        raise FileNotFoundError(f"no file at {path}")

    def run(batches):
        for b in batches:
            for content in b["content"]:
                data = Classic(content)
                yield pd.DataFrame({"v": [str(v) for v in variables], "dims": [[str(x) for x in (data.variables[v].dims if v in data.variables else data.read(v).shape)] for v in variables]})

    found = {tuple(r["dims"]) for r in _content(spark, one["path"]).mapInPandas(run, "v string, dims array<string>").collect()}
    if len(found) != 1:
        raise ValueError("variables on different grids need a table each")
    return [axis(d) for d in found.pop()]


def read_netcdf(spark: SparkSession, path, variables: list[str]) -> DataFrame:
    """path, axes, and one DOUBLE column per variable; the variables share their dimensions."""
    names = _axes(spark, path, variables)

    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                data = Classic(content)
                values = {v: data.read(v).astype(float) for v in variables}
                index = np.indices(next(iter(values.values())).shape)
                yield pd.DataFrame({"path": name, **{n: x.ravel() for n, x in zip(names, index)}, **{column(v, names): x.ravel() for v, x in values.items()}})

    return _content(spark, path).mapInPandas(run, ", ".join(["path string", *[f"{n} int" for n in names], *[f"`{column(v, names)}` double" for v in variables]]))


def read_file_meta(spark: SparkSession, path) -> DataFrame:
    """path, attributes (as text), sizes, and the decoded `Times` of each file."""
    def run(batches):
        for b in batches:
            for name, content in zip(b["path"], b["content"]):
                data = Classic(content)
                times = [bytes(x.tobytes()).decode() for x in data.read("Times")] if "Times" in data.variables else []
                yield pd.DataFrame([{"path": name, "attributes": {k: str(v) for k, v in data.attributes.items()}, "sizes": {d: data.length(d) for d, _ in data.dims}, "times": times}])

    return _content(spark, path).mapInPandas(run, "path string, attributes map<string,string>, sizes map<string,bigint>, times array<string>")


def open_sequence(spark: SparkSession, paths: list[str], variables: list[str]) -> DataFrame:
    """Files in the given order along one time axis. Rejects files of different
    grids, and stamps that do not rise; vertical sizes are not compared."""
    meta = {r["path"].split(":", 1)[-1].lstrip("/"): r for r in read_file_meta(spark, list(paths)).collect()}
    order = [meta[p.split(":", 1)[-1].lstrip("/")] for p in paths]
    kinds = {tuple(m["attributes"].get(a) for a in SEQUENCE_ATTRIBUTES) + tuple(m["sizes"].get(d) for d in HORIZONTAL) for m in order}
    if len(kinds) > 1:
        raise ValueError("files are of different grids")
    stamps = [t for m in order for t in m["times"]]
    if any(b <= a for a, b in zip(stamps, stamps[1:])):
        raise ValueError("times do not rise")
    # one scan of all files; each row's time moves on by the records of the files before
    starts, offset = [], 0
    for m in order:
        starts.append((m["path"], offset))
        offset += m["sizes"].get("Time", len(m["times"]))
    rows = read_netcdf(spark, list(paths), variables)
    moved = rows.join(weight_table(rows, starts, "path string, _start int"), "path")
    return moved.select("path", *[(F.col("t") + F.col("_start")).cast("int").alias("t") if c == "t" else F.col(c) for c in rows.columns if c != "path"])


def aggregate(spark: SparkSession, paths: list[str], variables: list[str], output: str | None = None) -> DataFrame:
    """``open_sequence``, written as Parquet where an output is given."""
    out = open_sequence(spark, paths, variables)
    if output:
        out.write.parquet(output)
    return out
