"""Views that stand in for gridded data: the driver's tables as cells, series, planes and profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def les(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        *LINE, F.col("l_suppkey").alias("cell"), F.col("l_quantity").alias("u"), (F.col("l_extendedprice") / 1000).alias("v"),
        (F.col("l_discount") * 10).alias("w"), F.col("l_tax").alias("sgs"))


def thermo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").select(
        *LINE, (90000 + F.col("l_quantity") * 200).alias("p"), (270 + F.col("l_discount") * 300).alias("temp"), (F.col("l_tax") / 10).alias("r"),
        (F.col("l_discount") - 0.045).alias("h"), F.col("l_quantity").alias("u"), (F.col("l_extendedprice") / 1000).alias("v"))


def obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return read(spark, sf_dir, "events").select(
        "event_id", F.col("user_id").alias("station"), "ts", F.col("value").alias("speed"), F.pmod(k * F.lit(3.65), F.lit(360.0)).alias("direction"), F.col("event_type").alias("kind"))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event with the station's event before it as its model value."""
    from pyspark.sql import Window

    w = Window.partitionBy("station").orderBy("ts", "event_id")
    return obs(spark, sf_dir).select("*", F.lag("speed").over(w).alias("model"), F.lag("direction").over(w).alias("model_direction")).where("model IS NOT NULL")


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode(F.col("embedding").cast("array<double>")).alias("n", "x"))


def plane(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("vec_id", "label", F.floor(F.col("n") / 8).cast("int").alias("j"), (F.col("n") % 8).alias("i"), "x")


def profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signal(spark, sf_dir).select("vec_id", "label", F.col("n").alias("k"), (10.0 * (F.col("n") + 1)).alias("z"), (F.col("x") * 50 + 10).alias("x"))


def accum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("cell"), F.col("o_orderdate").alias("ts"), F.col("o_orderkey").alias("ord"), (F.col("o_totalprice") / 1000).alias("acc"))


# The same views in DuckDB SQL.
SQL = {
    "les": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_suppkey AS cell, l_quantity AS u, l_extendedprice / 1000 AS v, l_discount * 10 AS w, l_tax AS sgs FROM lineitem",
    "thermo": "SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, 90000 + l_quantity * 200 AS p, 270 + l_discount * 300 AS temp, l_tax / 10 AS r, l_discount - 0.045 AS h, l_quantity AS u, l_extendedprice / 1000 AS v FROM lineitem",
    "obs": "SELECT event_id, user_id AS station, ts, value AS speed, fmod(CAST(json_extract_string(props, '$.k') AS INT) * 3.65::DOUBLE, 360) AS direction, event_type AS kind FROM events",
    "signal": "SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS n, unnest(embedding)::DOUBLE AS x FROM embeddings",
}
SQL["pairs"] = f"SELECT * FROM (SELECT *, lag(speed) OVER w AS model, lag(direction) OVER w AS model_direction FROM ({SQL['obs']}) WINDOW w AS (PARTITION BY station ORDER BY ts, event_id)) WHERE model IS NOT NULL"
SQL["plane"] = f"SELECT vec_id, label, n // 8 AS j, n % 8 AS i, x FROM ({SQL['signal']})"
SQL["profile"] = f"SELECT vec_id, label, n AS k, 10.0::DOUBLE * (n + 1) AS z, x * 50 + 10 AS x FROM ({SQL['signal']})"
SQL["accum"] = "SELECT o_custkey AS cell, o_orderdate AS ts, o_orderkey AS ord, o_totalprice / 1000 AS acc FROM orders"
