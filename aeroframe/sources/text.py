"""Text formats: stations, observations, channels, parameters, namelists.

Files whose lines depend on their order are read whole, one row per file.
"""

from __future__ import annotations

import re
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.sources import sinks

# Columns of a surface series, and of the station header (first, last, kind).
SURFACE = ("id", "ts_hour", "id_tsloc", "ix", "iy", "t", "q", "u", "v", "psfc", "glw", "gsw", "hfx", "lh", "tsk", "tslb", "rainc", "rainnc", "clw")
HEADER = {
    "name": (0, 25, "string"), "grid_id": (26, 29, "int"), "domain_id": (29, 32, "int"), "station_id": (33, 38, "string"), "lat": (39, 46, "double"), "lon": (47, 55, "double"),
    "ix": (58, 62, "int"), "iy": (63, 67, "int"), "grid_lat": (70, 77, "double"), "grid_lon": (78, 86, "double"), "elevation": (88, 94, "double"), "units": (95, 200, "string"),
}
PROFILE_CODES = ("UU", "VV", "WW", "PH", "TH", "QV", "PR")
STATION = r"^\s*(.{1,25}?)\s+(\S{1,7})\s+([-+]?\d+(?:\.\d*)?)\s+([-+]?\d+(?:\.\d*)?)\s*$"


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(path, n, line): lines of whole files with their numbers."""
    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.split("value", r"\r?\n").alias("lines"))
    return whole.select("path", F.posexplode("lines").alias("n", "line"))


def read_tslist(spark: SparkSession, path: str) -> DataFrame:
    """Stations of a list file."""
    return parse_tslist(spark.read.text(path))


def parse_tslist(lines: DataFrame) -> DataFrame:
    """``value`` lines -> name, id, lat, lon; comments, blank lines and lines that do not fit are skipped."""
    rows = lines.where(~F.col("value").rlike(r"^\s*([#!].*)?$") & F.col("value").rlike(STATION))
    part = lambda k: F.regexp_extract("value", STATION, k)
    return rows.select(F.trim(part(1)).alias("name"), part(2).alias("id"), part(3).cast("double").alias("lat"), part(4).cast("double").alias("lon"))


def tslist_lines(stations: DataFrame) -> DataFrame:
    """Fixed-width lines of a station list; a missing name falls back to the id."""
    name = F.substring(F.coalesce("name", "id"), 1, 25)
    return stations.select(F.format_string("%-25s %-7s %9.4f %10.4f", name, "id", "lat", "lon").alias("value"))


def write_tslist(stations: DataFrame, path: str) -> str:
    """A single small file, as the model reads it."""
    head = ["#-----------------------------------------------#", "# 24 characters for name | pfx |  LAT  |   LON  |"]
    lines = head + [r["value"] for r in tslist_lines(stations).toLocalIterator()]
    with sinks.opened(stations.sparkSession, path) as write:
        write(("\n".join(lines) + "\n").encode("utf-8"))
    return str(path)


def read_station_header(spark: SparkSession, path: str) -> DataFrame:
    """Fixed columns of the first line of each file."""
    first = _lines(spark, path).where("n = 0")
    made = [F.trim(F.substring("line", a + 1, b - a)).try_cast(kind).alias(name) for name, (a, b, kind) in HEADER.items()]
    return first.select("path", *made)


def _numbers(df: DataFrame) -> DataFrame:
    return df.where(F.trim("line") != "").select("path", "n", F.transform(F.split(F.trim("line"), r"\s+"), lambda x: x.try_cast("double")).alias("v"))


def read_station_surface(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a surface series, without the header; too few columns are an error."""
    rows = _numbers(_lines(spark, path).where("n > 0"))
    value = lambda k: F.when(F.size("v") >= len(SURFACE), F.get("v", F.lit(k))).otherwise(F.raise_error(F.lit("a surface row needs 19 columns")).cast("double"))
    return rows.select("path", *[value(k).alias(c) for k, c in enumerate(SURFACE)])


def read_station_profile(spark: SparkSession, path: str) -> DataFrame:
    """(path, code, time, level, value): a row per time and level; the code is the file's suffix."""
    rows = _numbers(_lines(spark, path))
    code = F.lower(F.element_at(F.split("path", r"\."), -1))
    return rows.select("path", code.alias("code"), F.get("v", F.lit(0)).alias("time"), F.posexplode(F.slice("v", 2, F.greatest(F.size("v") - 1, F.lit(0)))).alias("level", "value"))


def read_station_family(spark: SparkSession, surface_path: str, codes: tuple[str, ...] = PROFILE_CODES) -> tuple[DataFrame, DataFrame | None]:
    """The surface series, and one wide table of the profiles that exist beside it."""
    beside = [p for p in (Path(surface_path).with_suffix(f".{c}") for c in codes) if p.exists()]
    profiles = None
    for p in beside:
        part = read_station_profile(spark, str(p)).select("time", "level", F.col("value").alias(p.suffix[1:].lower()))
        profiles = part if profiles is None else profiles.join(part, ["time", "level"], "full")
    return read_station_surface(spark, surface_path), profiles


def read_csv(spark: SparkSession, path: str, time_column: str, columns: list[str] | None = None, delimiter: str = ",") -> DataFrame:
    """Header-driven observations with a time column, and the file of each row."""
    df = spark.read.csv(path, header=True, inferSchema=True, sep=delimiter)
    if time_column not in df.columns:
        raise ValueError(f"{time_column} is not a column of {path}")
    kept = columns if columns is not None else [c for c in df.columns if c != time_column]
    return df.select(F.col(time_column).alias("time"), *kept, F.col("_metadata.file_path").alias("source"))


def from_columns(spark: SparkSession, time, variables: dict, schema: str | None = None) -> DataFrame:
    names = ["time", *variables]
    rows = list(zip(time, *variables.values(), strict=True))
    return spark.createDataFrame(rows, schema or names)


def read_ascii_output(spark: SparkSession, path: str) -> DataFrame:
    """(path, time, channel, unit, value) of whitespace-delimited simulation output."""
    def run(batches):
        for b in batches:
            for name, text in zip(b["path"], b["value"]):
                lines = text.splitlines()
                head = next((k for k, x in enumerate(lines) if x.split()[:1] and x.split()[0].lower() == "time"), None)
                if head is None or head + 2 > len(lines):
                    raise ValueError(f"no channel header in {name}")
                channels, units = lines[head].split(), [u.strip("()[]") for u in lines[head + 1].split()]
                data = np.array([x.split() for x in lines[head + 2 :] if x.strip()], float).reshape(-1, len(channels))
                for k, channel in enumerate(channels[1:], 1):
                    yield pd.DataFrame({"path": name, "time": data[:, 0], "channel": channel, "unit": units[k] if k < len(units) else "", "value": data[:, k]})

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.mapInPandas(run, "path string, time double, channel string, unit string, value double")


def read_full_field_text(spark: SparkSession, path: str) -> DataFrame:
    """(path, t, time, k, j, z, y, u, hub_wind): the lateral axis is turned round."""
    def run(batches):
        for b in batches:
            for name, text in zip(b["path"], b["value"]):
                lines = text.split("\n")
                numbers = [float(x) for x in re.findall(r"[-+.\deE]+", lines[4])]
                if len(numbers) < 7:
                    raise ValueError(f"no grid in {name}")
                ny, nz = map(int, numbers[:2])
                heights, across = (np.array(lines[at].split()[:n], float) for at, n in ((7, nz), (10, ny)))
                # a record is its time, the wind at the hub, and the plane from the far side to the near one
                record = np.dtype([("time", "f8"), ("hub", "f8"), ("u", "f8", (nz, ny))])
                values = np.array(" ".join(lines[12:]).split(), float)
                if len(values) * 8 % record.itemsize:
                    raise ValueError(f"incomplete record in {name}")
                data = values.view(record)
                t, k, j = (x.ravel() for x in np.indices((len(data), nz, ny)))
                yield pd.DataFrame({"path": name, "t": t, "time": data["time"][t], "k": k, "j": j, "z": heights[k] + numbers[5], "y": across[j],
                                    "u": data["u"][t, k, ny - 1 - j], "hub_wind": data["hub"][t]})

    whole = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), "value")
    return whole.mapInPandas(run, "path string, t int, time double, k int, j int, z double, y double, u double, hub_wind double")


PARAMETER = r"""^\s*("[^"]*"|'[^']*'|\S+)\s+([A-Za-z_]\w*(?:\([^)]*\))?)(?:\s.*)?$"""


def read_parameters(spark: SparkSession, path: str) -> DataFrame:
    """label, value of a parameter file."""
    return parse_parameters(_lines(spark, path))


def parse_parameters(lines: DataFrame) -> DataFrame:
    """Numbered `value  Label  text` lines (n, line) -> label, value; of repeated labels the last counts."""
    rows = lines.where(F.col("line").rlike(PARAMETER)).select(
        "n", F.regexp_extract("line", PARAMETER, 2).alias("label"), F.regexp_replace(F.regexp_extract("line", PARAMETER, 1), r"^[\"']|[\"']$", "").alias("value"))
    return rows.groupBy("label").agg(F.max_by("value", "n").alias("value"))


def update_parameters(path: str, values: dict, output: str | None = None) -> Path:
    """Rewrite value tokens only; strings with blanks, or quoted before, are quoted."""
    left, out = dict(values), []
    for line in Path(path).read_text(encoding="utf-8").splitlines(keepends=True):
        m = re.match(PARAMETER, line.rstrip("\r\n"))
        if m and m[2] in values:
            old, new = m[1], str(values[m[2]])
            if isinstance(values[m[2]], str) and (old[0] in "\"'" or " " in new):
                new = f'"{new}"'
            at = line.index(old)
            line = line[:at] + new + line[at + len(old) :]
            left.pop(m[2], None)
        out.append(line)
    if left:
        raise KeyError(f"missing parameters: {', '.join(left)}")
    target = Path(output or path)
    target.write_text("".join(out), encoding="utf-8")
    return target


# One pattern for a whole control file: what to pass over, group marks, names, values.
_NAMELIST = re.compile(r"""(?P<skip>[\s,]+|!.*)|&(?P<group>\w+)|(?P<end>/)|(?P<name>[A-Za-z_][\w()]*)\s*=|'(?P<single>[^']*)'|"(?P<double>[^"]*)"|(?P<bare>[^\s,!/'"]+)""")


def _scan(text: str):
    """(kind, content) of each token; values come as (value, Python value)."""
    for m in _NAMELIST.finditer(text):
        kind = m.lastgroup
        if kind in ("single", "double"):
            yield "value", m[kind]
        elif kind == "bare":
            yield "value", _bare(m[kind])
        elif kind != "skip":
            yield kind, m[kind]


def _bare(token: str):
    """A logical, a whole or real number, or the token itself."""
    logical = {".true.": True, ".false.": False}.get(token.lower())
    if logical is not None:
        return logical
    for kind in (int, float):
        try:
            return kind(token)
        except ValueError:
            continue
    return token


def parse_value(text: str):
    """The value of a namelist entry; several make a list."""
    values = [x for kind, x in _scan(text) if kind == "value"]
    return values[0] if len(values) == 1 else values


def read_namelist(path: str) -> dict[str, dict]:
    """`&group name = values ... /` blocks of a (small) control file."""
    entries: dict[str, dict[str, list]] = {}
    here = target = None
    for kind, x in _scan(Path(path).read_text(encoding="utf-8")):
        if kind == "group":
            here, target = entries.setdefault(x, {}), None
        elif kind == "end":
            here = target = None
        elif kind == "name" and here is not None:
            target = here[x] = []
        elif kind == "value" and target is not None:
            target.append(x)
    return {g: {k: v[0] if len(v) == 1 else v for k, v in held.items()} for g, held in entries.items()}


def update_namelist_dates(path: str, start: str, end: str, domains: int, output: str | None = None) -> Path:
    """Put new dates, one per domain, in place of start_date and end_date; all else stays as it is."""
    new = {"start_date": start, "end_date": end}
    lines, left = Path(path).read_text(encoding="utf-8").splitlines(keepends=True), set(new)
    for n, line in enumerate(lines):
        entry, equals, rest = line.partition("=")
        name = entry.strip()
        if equals and name in new:
            close = rest[len(rest.rstrip("\r\n")) :]
            lines[n] = f"{entry}= " + f"'{new[name]}', " * (domains - 1) + f"'{new[name]}',{close}"
            left.discard(name)
    if left:
        raise KeyError(", ".join(sorted(left)))
    target = Path(output or path)
    target.write_text("".join(lines), encoding="utf-8")
    return target
