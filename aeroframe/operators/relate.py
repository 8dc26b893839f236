"""Alignment of tables in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def align(model: DataFrame, observed: DataFrame, values: list[str], time: str = "time", by: list[str] | None = None, tolerance: float | None = None, bucket: float = 86400.0) -> DataFrame:
    """As-of join: each observation row with the model row nearest in time.

    Both sides are united and each observation looks back and ahead along one
    window, so that nothing is multiplied; equal gaps go to the later row.
    Values further away than ``tolerance`` seconds, and those of groups without
    model rows, are NULL. Repeated model times count once, the last in value order.

    Windows are cut every ``bucket`` seconds, so a group of many rows is spread;
    each bucket is given the nearest model row before and after it.
    """
    by = by or []
    held = [c for c in observed.columns if c not in by and c != time]
    row = F.struct(*[F.col(c) for c in held]) if held else F.struct(F.lit(1))
    side = F.struct(F.col(time).alias("_at"), *[F.col(v) for v in values])
    kind = observed.schema[time].dataType
    since = F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast(kind), F.col(time))
    cell = F.floor(since / F.lit(bucket * 1e6)).alias("_cell")
    left = model.select(*by, time, side.alias("_m"), F.lit(None).cast(observed.select(row).schema[0].dataType).alias("_o"), F.lit(False).alias("_asks"), cell)
    right = observed.select(*by, time, F.lit(None).cast(left.schema["_m"].dataType).alias("_m"), row.alias("_o"), F.lit(True).alias("_asks"), cell)
    both = left.unionByName(right)
    # the last and the first model row of each bucket, carried over to the others
    cells = both.groupBy(*by, "_cell").agg(F.max("_m").alias("_last"), F.max_by("_m", F.when(~F.col("_asks"), F.struct(-since, "_m"))).alias("_first"))
    over = lambda order: Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    carried = F.array(F.last("_last", True).over(over(F.col("_cell"))), F.last("_first", True).over(over(F.col("_cell").desc())))
    edges = cells.select(*by, "_cell", carried.alias("_ms")).select(*by, "_cell", F.explode("_ms").alias("_m")).where("_m IS NOT NULL")
    edges = edges.select(*by, F.col("_m._at").alias(time), "_m", F.lit(None).cast(left.schema["_o"].dataType).alias("_o"), F.lit(False).alias("_asks"), "_cell")
    back = Window.partitionBy(*by, "_cell").orderBy(F.col(time), F.col("_asks"), F.col("_m")).rowsBetween(Window.unboundedPreceding, 0)
    # looking ahead, rows of the same time come first whichever side they are on
    ahead = Window.partitionBy(*by, "_cell").orderBy(F.col(time).desc(), F.col("_asks"), F.col("_m")).rowsBetween(Window.unboundedPreceding, 0)
    seen = both.unionByName(edges).select("*", F.last("_m", True).over(back).alias("_b"), F.last("_m", True).over(ahead).alias("_a")).where("_asks")
    gap = lambda c: F.abs(F.timestamp_diff("MICROSECOND", F.col(c), F.col(time)))
    use_back = F.col("_a").isNull() | (gap("_b._at") < gap("_a._at"))
    best = F.when(use_back, F.col("_b")).otherwise(F.col("_a"))
    picked = seen.withColumn("_best", best)
    if tolerance is not None:
        picked = picked.withColumn("_best", F.when(gap("_best._at") <= tolerance * 1e6, F.col("_best")))
    return picked.select(*by, time, *[F.col(f"_o.{c}") for c in held], *[F.col(f"_best.{v}").alias(v) for v in values])


def normalize_time(df: DataFrame, time: str = "time", timezone_offset_hours: float = 0.0, sort: bool = True) -> DataFrame:
    """Subtract a time-zone offset (microsecond precision)."""
    moved = df.withColumn(time, F.col(time) - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.lit(timezone_offset_hours * 3600).cast("decimal(18,6)")))
    return moved.orderBy(time) if sort else moved


def concatenate(parts: list[DataFrame], time: str = "t", by: list[str] | None = None) -> DataFrame:
    """Append tables along an integer time axis, each starting after the one before."""
    out, offset = None, None
    for part in parts:
        size = part.agg((F.max(time) + 1).alias("_n"))
        here = part if offset is None else part.crossJoin(F.broadcast(offset)).withColumn(time, F.col(time) + F.col("_n")).drop("_n")
        out = here if out is None else out.unionByName(here)
        # one row, so its broadcast has a fixed size
        offset = size if offset is None else offset.crossJoin(size.toDF("_m")).select((F.col("_n") + F.col("_m")).alias("_n"))
    return out


def open_sequence(files: DataFrame, meta: DataFrame, attributes: list[str]) -> DataFrame:
    """Rows of many files in one table; files whose attributes differ are rejected."""
    kinds = meta.select(*attributes).distinct().limit(2).count()
    if kinds > 1:
        raise ValueError(f"files differ in one of {', '.join(attributes)}")
    return files
