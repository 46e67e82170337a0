"""Readers: Parquet tables by name, raw Bayer files, and synthetic inputs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def bayer_files(spark: SparkSession, path: str, width: int, height: int, stride: int, bits: int) -> DataFrame:
    """Pixels (path, y, x, v) of raw little-endian 16-bit files; rows are ``stride`` bytes, v is scaled by the bit depth.

    Files whose size is not stride * height are left out, columns beyond ``width`` are cropped. Each file is
    decoded by one task, in runs of rows.
    """

    if stride % 2 or not 0 < width <= stride // 2:
        raise ValueError("a row has an even number of bytes, two for each column at least")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                plane = np.frombuffer(content, "<u2").reshape(height, stride // 2)[:, :width]
                for y0 in range(0, height, 64):
                    part = plane[y0 : y0 + 64]
                    y, x = np.indices(part.shape)
                    values = part.astype(np.float64) / ((1 << bits) - 1)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * part.size), pa.array((y + y0).ravel().astype(np.int32)), pa.array(x.ravel().astype(np.int32)), pa.array(values.ravel())], names=["path", "y", "x", "v"])

    files = spark.read.format("binaryFile").load(path).where(F.col("length") == stride * height)
    return files.select("path", "content").mapInArrow(decode, "path string, y int, x int, v double")


def synthetic_frames(spark: SparkSession, frames: int, height: int, width: int, seed: int = 0) -> DataFrame:
    """Uniform pixels (frame_id, y, x, v) in [0, 1), made where they are needed; the same for the same arguments and partitions."""
    per = height * width
    p = F.col("id") % per
    return spark.range(frames * per).select(F.floor(F.col("id") / per).alias("frame_id"), F.floor(p / width).cast("int").alias("y"), (p % width).cast("int").alias("x"), F.rand(seed).alias("v"))


def synthetic_items(spark: SparkSession, n: int = 5) -> DataFrame:
    """Hand-off items of the demo: every even one holds a token and a frame."""
    even = F.col("id") % 2 == 0
    token = F.when(even, F.col("id") + 500)
    return spark.range(n).select((F.col("id") + 1000).alias("packet_id"), F.lit(1).alias("worker"), F.lit(1).alias("batch"), F.lit(1).alias("publish"), token.alias("token"), F.when(even, 0).alias("owner"), F.when(even, 0).alias("hw"), F.col("id").alias("slot_index"), F.lit(1).alias("cmd_type"), F.lit(1).alias("epoch"), F.lit(0).alias("diagnostics_idx"), F.when(even, F.col("id") + 200).alias("frame_id"), F.col("id").alias("alloc_ticket"), F.col("id").alias("idempotency_key"))


def preloaded_fifo(spark: SparkSession, slots: int = 64, epoch: int = 1) -> DataFrame:
    return spark.range(slots).select(F.col("id").alias("slot_index"), F.lit(epoch).cast("long").alias("epoch"), (F.col("id") + 1).alias("free_seq"))
