"""Helpers shared by the training-data operators."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def reach_workers(spark: SparkSession) -> None:
    """Python workers on this machine find the package wherever the driver was
    started (a cluster ships it with --py-files)."""
    root = str(Path(__file__).resolve().parents[2])
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    reach_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one
    under the warehouse where that is unset on a single machine (tests)."""
    given = spark.conf.get("spark.checkpoint.dir", None)
    if given:
        return given.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_aeroframe_checkpoints"


_scratch: list[list[str]] = []


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts the lineage with files that outlive any executor, and gives the
    planner true sizes. Inside ``settled`` the table goes with its step.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/aeroframe-{uuid.uuid4().hex}"
    if _scratch:
        _scratch[-1].append(path)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def settled(spark: SparkSession, step: Callable[[], DataFrame]) -> DataFrame:
    """``step()`` written as a table; whatever tables it wrote on the way are
    deleted, also when it fails."""
    own: list[str] = []
    _scratch.append(own)
    try:
        out = materialize(step())
        kept = own.pop()  # the result, written last, stays until an outer step is settled
        if len(_scratch) > 1:
            _scratch[-2].append(kept)
        return out
    finally:
        _scratch.pop()
        _delete(spark, own)


@contextmanager
def exchanges_dropped(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of a query that runs inside go when the query ends."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, before)


def _delete(spark: SparkSession, paths: list[str]) -> None:
    conf = spark._jsc.hadoopConfiguration()
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)


def connected_components(edges: DataFrame) -> DataFrame:
    """(u, v) long pairs -> (node, component): smallest node reachable.

    Each round hooks every node to its smallest neighbour, follows the hooks one
    step further, and contracts the pairs to what still differs; stars need one
    round. A hook is a minimum per node (combined map-side) and joins, never a
    gathering of a node's neighbours, so a node with very many links is no hot
    spot. Loops and repeated pairs are harmless; an empty input gives no rows.
    """
    pairs = edges.where("u != v").select("u", "v")
    known = None
    while True:
        labels = materialize(hooked(pairs))
        known = labels if known is None else materialize(
            known.join(labels.toDF("label", "next"), "label", "left").select("node", F.coalesce("next", "label").alias("label"))
        )
        pairs = materialize(
            pairs.join(labels.toDF("u", "lu"), "u").join(labels.toDF("v", "lv"), "v").where("lu != lv")
            .select(F.greatest("lu", "lv").alias("u"), F.least("lu", "lv").alias("v")).distinct()
        )
        if pairs.isEmpty():
            return known.select("node", F.col("label").alias("component"))


def hooked(pairs: DataFrame) -> DataFrame:
    """(node, label): the smallest neighbour's smallest neighbour, itself included."""
    both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
    first = both.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("m")).select("node", F.least("node", "m").alias("label"))
    return first.join(first.toDF("label", "next"), "label").select("node", F.col("next").alias("label"))


def bound_batches(spark: SparkSession, rows: int = 500, size: str = "8m") -> None:
    """Bound the Arrow batches that Python workers get, so that memory does not
    grow with the length of texts."""
    reach_workers(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def fold_of(id_col: str, folds: int):
    """crc32 of the id as text, modulo ``folds`` (a null id counts as empty text)."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds


def training_rows(docs: DataFrame, labels: DataFrame, max_rows: int, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(text, y) of at most ``max_rows`` labelled rows, those of the smallest id hashes.

    Ids are chosen before any text is touched: labels and ids alone are grouped,
    the bounded list goes to all tasks, and only the texts it names are exchanged.
    An id whose labels disagree does not train; of rows that share an id, the
    smallest text (in byte order; null counts as empty) does.
    """
    spark = docs.sparkSession
    y = F.col(label_col).cast("int")
    agreed = (
        labels.where(F.col(id_col).isNotNull() & y.isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
        .agg(F.min(y).alias("y"), F.max(y).alias("other")).where("y = other").select("id", "y")
    )
    there = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"))
    chosen = agreed.join(there, "id", "left_semi").orderBy(F.xxhash64("id"), "id").limit(max_rows).collect()
    listed = F.broadcast(spark.createDataFrame(chosen, "id long, y int"))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(listed, "id")
    return texts.groupBy("id", "y").agg(F.min("text").alias("text")).select("text", "y")
