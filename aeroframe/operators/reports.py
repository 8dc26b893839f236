"""Summaries of tables, and small report files."""

from __future__ import annotations

import html
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.operators.stats import comparison_summary


def dataset_summary(df: DataFrame, dimensions: list[str]) -> DataFrame:
    """One row per column: name, kind, and for dimensions the number of distinct values."""
    spark = df.sparkSession
    rest = [(c, "variable") for c in df.columns if c not in dimensions]
    out = spark.createDataFrame(rest, "name string, kind string").withColumn("distinct", F.lit(None).cast("bigint"))
    for name in dimensions:
        out = out.unionByName(df.agg(F.count_distinct(name).alias("distinct")).select(F.lit(name).alias("name"), F.lit("dimension").alias("kind"), "distinct"))
    return out


def comparison_report(df: DataFrame, model: str, observed: str, label: str | None = None) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("count"), *comparison_summary(model, observed)).withColumn("label", F.lit(label))


def provenance(inputs: list[str], configuration: dict | None = None, software_version: str | None = None) -> dict:
    return {"inputs": [str(Path(p).resolve()) if "://" not in str(p) else str(p) for p in inputs], "configuration": configuration or {}, "software_version": software_version}


def write_json_report(report: dict, path: str) -> Path:
    target = Path(path)
    target.write_text(json.dumps(report, indent=2, default=str), encoding="utf-8")
    return target


def write_html_report(report: dict, path: str, title: str = "Case report", figures: tuple = ()) -> Path:
    """One escaped section per key, and the figures after them."""
    sections = "".join(f"<h2>{html.escape(str(k))}</h2><pre>{html.escape(json.dumps(v, indent=2, default=str))}</pre>" for k, v in report.items())
    shown = "".join(f'<figure><img src="{html.escape(str(f), quote=True)}"></figure>' for f in figures)
    target = Path(path)
    target.write_text(f"<!doctype html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>{sections}{shown}</body></html>", encoding="utf-8")
    return target
