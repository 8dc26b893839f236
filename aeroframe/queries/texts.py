"""File names, text lines and provenance, on lines made from the driver's tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from aeroframe.plans import views
from aeroframe.queries.registry import add, rounded, scratch
from aeroframe.sources import discovery, text

c = F.col


def _files(spark, sf_dir) -> DataFrame:
    name = F.concat(F.lit("wrfout_d0"), (c("o_orderkey") % 4).cast("string"), F.lit("_"), F.date_format("o_orderdate", "yyyy-MM-dd"),
                    F.when(c("o_orderkey") % 5 == 0, "_06:00:00").when(c("o_orderkey") % 7 == 0, ".nc").otherwise("_06_00_00"))
    return views.read(spark, sf_dir, "orders").select(F.concat(F.lit("/data/"), name).alias("path"))


_NAMES = """SELECT 'wrfout_d0' || (o_orderkey % 4) || '_' || strftime(o_orderdate, '%Y-%m-%d') || CASE WHEN o_orderkey % 5 = 0 THEN '_06:00:00' WHEN o_orderkey % 7 = 0 THEN '.nc' ELSE '_06_00_00' END AS name,
  date_trunc('day', o_orderdate) + INTERVAL 6 HOUR AS ts, o_orderkey % 4 AS d, o_orderkey % 5 <> 0 AND o_orderkey % 7 = 0 AS other FROM orders"""
add("discover_files", lambda spark, sf_dir: discovery.filter_files(_files(spark, sf_dir), "2", "1995-01-01 00:00:00", "1997-06-30 06:00:00").select("name", "domain", "ts"),
    f"SELECT name, 'd02' AS domain, ts FROM ({_NAMES}) WHERE NOT other AND d = 2 AND ts BETWEEN TIMESTAMP '1995-01-01 00:00:00' AND TIMESTAMP '1997-06-30 06:00:00'")


def _stations(spark, sf_dir) -> DataFrame:
    return views.read(spark, sf_dir, "customer").select(
        c("c_name").alias("name"), c("c_custkey").cast("string").alias("id"), (c("c_custkey") % 90 + 0.25).alias("lat"), (c("c_custkey") % 180 - 90.5).alias("lon"))


def _listed(spark, sf_dir) -> DataFrame:
    head = spark.sql("SELECT * FROM VALUES ('# comment'), ('! other'), (''), ('no station here') t(value)")
    return text.parse_tslist(text.tslist_lines(_stations(spark, sf_dir)).unionByName(head)).select("name", "id", rounded("lat", 4).alias("lat"), rounded("lon", 4).alias("lon"))


add("read_tslist", _listed, "SELECT c_name AS name, c_custkey::VARCHAR AS id, round(c_custkey % 90 + 0.25, 4) AS lat, round(c_custkey % 180 - 90.5, 4) AS lon FROM customer")
add("write_tslist", lambda spark, sf_dir: text.tslist_lines(_stations(spark, sf_dir)),
    "SELECT printf('%-25s %-7s %9.4f %10.4f', c_name, c_custkey::VARCHAR, (c_custkey % 90 + 0.25)::DOUBLE, (c_custkey % 180 - 90.5)::DOUBLE) AS value FROM customer")


def _parameters(spark, sf_dir) -> DataFrame:
    line = F.concat_ws("", F.lit("  "), c("p_size").cast("string"), F.lit("   Part"), (c("p_partkey") % 50).cast("string"), F.lit("  - "), c("p_name"))
    return text.parse_parameters(views.read(spark, sf_dir, "part").select(c("p_partkey").alias("n"), line.alias("line")))


add("read_parameters", _parameters, "SELECT 'Part' || (p_partkey % 50) AS label, max_by(p_size, p_partkey)::VARCHAR AS value FROM part GROUP BY 1")
add("parse_times", lambda spark, sf_dir: views.obs(spark, sf_dir).select("event_id", discovery.parse_times(F.date_format("ts", "yyyy-MM-dd_HH:mm:ss")).alias("ts")),
    "SELECT event_id, date_trunc('second', ts) AS ts FROM events")


def _observed(spark, sf_dir) -> DataFrame:
    path = f"{scratch(spark)}/aeroframe-{uuid.uuid4().hex}.csv"
    views.obs(spark, sf_dir).select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("when"), "event_id", "speed", "kind").write.csv(path, header=True, sep=";")
    return text.read_csv(spark, path, "when", ["event_id", "speed"], ";").select("time", c("event_id").cast("bigint").alias("event_id"), rounded("speed").alias("speed"))


add("read_csv", _observed, f"SELECT date_trunc('second', ts) AS time, event_id, round(speed, 6) AS speed FROM ({views.SQL['obs']})")
