"""Model output files by name."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the file name format of the model.
NAME = r"^wrfout_(d\d{2})_(\d{4}-\d{2}-\d{2})_(\d{2})[:_](\d{2})[:_](\d{2})$"


def stamp(name: Column) -> Column:
    """Date and time in a file name."""
    part = lambda k: F.regexp_extract(name, NAME, k)
    text = F.concat(part(2), F.lit(" "), part(3), F.lit(":"), part(4), F.lit(":"), part(5))
    return F.when(name.rlike(NAME), F.try_to_timestamp(text).cast("timestamp_ntz"))


def discover(spark: SparkSession, directory: str, domain: str | None = None, start=None, end=None, recursive: bool = False) -> DataFrame:
    """path, name, domain, ts of the matching files, by time and name; contents are not read.

    ``domain`` is like "d02" or "2"; both ends of the time range are included.
    """
    if "://" not in directory and not Path(directory).is_dir():
        raise NotADirectoryError(directory)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(directory).select("path")
    return filter_files(files, domain, start, end)


def filter_files(files: DataFrame, domain: str | None = None, start=None, end=None) -> DataFrame:
    name = F.url_decode(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\+", "%2B"))
    found = files.select("path", name.alias("name")).where(F.col("name").rlike(NAME))
    found = found.select("path", "name", F.regexp_extract("name", NAME, 1).alias("domain"), stamp(F.col("name")).alias("ts"))
    if domain is not None:
        if not isinstance(domain, str):
            raise TypeError("domain must be a string")
        found = found.where(F.col("domain") == (domain if domain.startswith("d") else f"d{int(domain):02d}"))
    if start is not None:
        found = found.where(F.col("ts") >= F.lit(start).cast("timestamp_ntz"))
    if end is not None:
        found = found.where(F.col("ts") <= F.lit(end).cast("timestamp_ntz"))
    return found.orderBy("ts", "name")


def parse_times(text: Column) -> Column:
    """Model stamps like 2020-01-01_00:00:00."""
    return F.try_to_timestamp(F.regexp_replace(text, "_", " ")).cast("timestamp_ntz")


def validate_columns(df: DataFrame) -> DataFrame:
    """The table, if it has grid indices and coordinates."""
    if not {"j", "i"} <= set(df.columns):
        raise ValueError("j and i are missing")
    for names in (("XLAT", "XLAT_M"), ("XLONG", "XLONG_M")):
        if not set(names) & set(df.columns):
            raise ValueError(f"one of {' and '.join(names)} is needed")
    return df
