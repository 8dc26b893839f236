"""Registration helpers for the catalogue.

Columns are given as functions, so that importing the catalogue needs no session.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from aeroframe.plans import views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

KEYS = {"les": views.LINE, "thermo": views.LINE, "obs": ["event_id"], "pairs": ["event_id"], "signal": ["vec_id", "n"], "plane": ["vec_id", "j", "i"], "profile": ["vec_id", "k"]}


def scratch(spark: SparkSession) -> str:
    """A folder that driver and executors share, for files that a query writes and reads back."""
    given = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_aeroframe_files"
    return given.rstrip("/")


def rounded(c, digits: int = 6) -> Column:
    return F.round(c, digits) + F.lit(0.0)


def add(name: str, make: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = make
    if sql is not None:
        # as in ``rounded``: no negative zero
        SQL[name] = sql.replace("round(", "0.0::DOUBLE + round(")


def frame(name: str, view: str, build: Callable[[DataFrame], DataFrame], sql: str | None = None) -> None:
    """A query ``build(view)``; ``{view}`` in the SQL stands for the view's text."""
    source = getattr(views, view)
    add(name, lambda spark, sf_dir: build(source(spark, sf_dir)), sql.replace("{view}", f"({views.SQL[view]})") if sql else None)


def scalar(name: str, view: str, columns: Callable[[], dict[str, Column]], sql: dict[str, str], digits: int = 6) -> None:
    """Expressions per row of a view; strings and booleans stay as they are with digits None."""
    keys = KEYS[view]
    source = getattr(views, view)

    def make(spark, sf_dir):
        made = [(rounded(c, digits) if digits is not None else c).alias(k) for k, c in columns().items()]
        return source(spark, sf_dir).select(*keys, *made)

    told = ", ".join((f"round({e}, {digits})" if digits is not None else e) + f" AS {k}" for k, e in sql.items())
    add(name, make, f"SELECT {', '.join(keys)}, {told} FROM ({views.SQL[view]})")


def grouped(name: str, view: str, by: list[str], columns: Callable[[], list[Column]], sql: dict[str, str], digits: int = 6) -> None:
    """Aggregates per group of a view, under the names of ``sql``."""
    source = getattr(views, view)
    names = list(sql)

    def make(spark, sf_dir):
        out = source(spark, sf_dir).groupBy(*by).agg(*[c.alias(n) for c, n in zip(columns(), names)])
        return out.select(*by, *[rounded(n, digits).alias(n) for n in names])

    told = ", ".join(f"round({e}, {digits}) AS {k}" for k, e in sql.items())
    group = f" GROUP BY {', '.join(by)}" if by else ""
    add(name, make, f"SELECT {', '.join([*by, told])} FROM ({views.SQL[view]}){group}")
