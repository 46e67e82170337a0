"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: What this process keeps from task to task, by name; of one operator at a time.
_kept: dict[Any, Any] = {}


def kept(name: Any, make: Callable[[], Any]) -> Any:
    """What a Python worker keeps from task to task, made at first use.

    Spark hands the workers of one stage to the next, so what another operator has left in this one is dropped first.
    """
    if name not in _kept:
        forget()
        _kept[name] = make()
    return _kept[name]


def forget() -> None:
    """Drop what an operator before has left in this worker, and give its memory back."""
    if _kept:
        _kept.clear()
        pa.default_memory_pool().release_unused()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder for intermediate tables: spark.checkpoint.dir, which all executors share.

    Where it is unset (single-machine tests) a temporary folder is made and set once.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and (held := spark.sparkContext.getCheckpointDir()):
        found = held
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once under the scratch folder and read it back: lineage ends at a table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """Smallest node reachable from each node that has an edge.

    ``edges`` holds two long columns; direction, repeats, self-loops and nulls do not matter.
    Returns (node, component), one row per node with an edge to another node; an empty input gives no rows.
    Rounds of large-star and small-star rewiring run until the edge table no longer changes; each
    round is a pair of aggregations and joins whose result is written as a table, so neither the
    driver nor any task holds a component.
    """
    pairs = edges.select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).where("a < b").distinct()
    pairs = materialize(pairs, "edges")
    before = None
    while True:
        after = pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b") % (1 << 40))).first()
        if after == before or after[0] == 0:
            break
        before = after
        both = pairs.select(F.col("a").alias("u"), F.col("b").alias("v")).union(pairs.select("b", "a"))
        lowest = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(lowest, "u").where("v > u").select(F.col("m").alias("a"), F.col("v").alias("b")).distinct()
        root = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(root, "b").where("a <> m").select(F.col("m").alias("a"), F.col("a").alias("b"))
        pairs = materialize(small.union(root.select(F.col("m").alias("a"), "b")).distinct(), "edges")
    roots = pairs.select(F.col("a").alias("node"), F.col("a").alias("component")).distinct()
    return pairs.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots)
