"""How the star-schema tables stand in for frames and control packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fotonflow.sources.tables import table

SIDE = 8


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long-form frames (frame_id, stream_id, p, y, x, v, u8): an embedding of 64 components is an 8x8 plane."""
    e = F.col("e").cast("double")
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id"), F.col("label").cast("long").alias("stream_id"), F.posexplode("embedding").alias("p", "e"))
    return rows.select("frame_id", "stream_id", "p", F.floor(F.col("p") / SIDE).cast("int").alias("y"), (F.col("p") % SIDE).alias("x"), ((e + 1) / 2).alias("v"), F.floor((e + 1) * 127.5).cast("int").alias("u8"))


def raw_coefficients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(stream_id, ts, event_id, value, scene_change, gain): coefficients as an algorithm would emit them."""
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("stream_id"), "ts", "event_id", "value", (F.col("event_type") == "error").alias("scene_change"), (1 + k % 16).cast("double").alias("gain"))


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hand-off items (packet_id, worker, batch, publish, token, owner, hw, slot_index, k and the rest of the envelope); tokens are local to a batch."""
    k = F.get_json_object("props", "$.k").cast("int")
    day = F.datediff("ts", F.lit("2024-01-01").cast("date"))
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", k.alias("k"), F.floor(day / 7).cast("long").alias("batch"))
    token = F.when(F.col("event_type") != "error", F.col("user_id") * 1000 + F.col("batch") * 20 + F.col("k") % 16)
    rows = rows.withColumn("token", token)
    return rows.select(F.col("event_id").alias("packet_id"), F.col("user_id").alias("worker"), "batch", F.when(F.col("k") % 5 == 0, 0).otherwise(1).alias("publish"), "token", F.when(F.col("token") % 23 == 0, 1).when(F.col("token").isNotNull(), 0).alias("owner"), F.when(F.col("token") % 7 == 0, 1).when(F.col("token").isNotNull(), 0).alias("hw"), F.col("event_id").alias("slot_index"), "k", (1 + F.col("k") % 3).alias("cmd_type"), (1 + F.col("k") % 4).alias("epoch"), F.col("k").alias("diagnostics_idx"), F.col("user_id").alias("frame_id"), F.col("event_id").alias("alloc_ticket"), (F.col("user_id") * 100 + F.col("k")).alias("idempotency_key"))


def control_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(event_id, ts, control_type, frame_id, alloc_ticket, epoch, idempotency_key)."""
    kind = F.when(F.col("event_type") == "purchase", "RETURN_TO_POOL").when(F.col("event_type") == "click", "RELEASE_FRAME").otherwise("OTHER")
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select("event_id", "ts", kind.alias("control_type"), F.col("user_id").alias("frame_id"), F.col("event_id").alias("alloc_ticket"), (1 + k % 4).alias("epoch"), (F.col("user_id") * 100 + k).alias("idempotency_key"))


def hw_done(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(order_id, frame_id, ts): completion notices, on days of the month that the events cover."""
    day = F.make_dt_interval((F.col("o_orderkey") % 31).cast("int"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("frame_id"), (F.lit("2024-01-01").cast("timestamp_ntz") + day).alias("ts"))
