"""Pixel kernels on long-form frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fotonflow.functions.scalar import clip, quantise

#: Which colour the top-left sample has, by mosaic pattern.
PATTERNS = {"RGGB": "RED", "BGGR": "BLUE", "GRBG": "GREEN_RED_NEXT", "GBRG": "GREEN_BLUE_NEXT"}


def demosaic_replicate(pixels: DataFrame) -> DataFrame:
    """(frame_id, idx, value): each sample as three interleaved channels."""
    return pixels.select("frame_id", "p", F.col("u8").alias("value"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("frame_id", (3 * F.col("p") + F.col("k")).alias("idx"), "value")


def denoise_box3(pixels: DataFrame) -> DataFrame:
    """(frame_id, y, x, value): truncated mean of the in-bounds 3x3 neighbours, as two one-dimensional windows."""
    along = Window.partitionBy("frame_id", "y").orderBy("x").rowsBetween(-1, 1)
    down = Window.partitionBy("frame_id", "x").orderBy("y").rowsBetween(-1, 1)
    rows = pixels.select("frame_id", "y", "x", F.sum("u8").over(along).alias("s"), F.count("u8").over(along).alias("n"))
    return rows.select("frame_id", "y", "x", F.floor(F.sum("s").over(down) / F.sum("n").over(down)).alias("value"))


def normalise_quantise(pixels: DataFrame, bits: int = 10) -> DataFrame:
    """(frame_id, p, unit, back, raw_unit): 8-bit to [0, 1], [0, 1] to 8-bit, and raw samples by their bit depth."""
    return pixels.select("frame_id", "p", (F.col("u8") / 255.0).alias("unit"), quantise(F.col("v")).cast("long").alias("back"), (F.col("u8") / float((1 << bits) - 1)).alias("raw_unit"))


def bayer_check(pixels: DataFrame, pattern: dict[int, str]) -> DataFrame:
    """Per frame: least, greatest and mean value, the top-left 2x2 block, and the colour of its first sample.

    ``pattern`` names a mosaic for each frame_id modulo its size; unknown names give ERROR.
    """
    at = lambda y, x: F.max(F.when((F.col("y") == y) & (F.col("x") == x), F.col("u8"))).cast("long")
    stats = pixels.groupBy("frame_id").agg(F.min("u8").cast("long").alias("low"), F.max("u8").cast("long").alias("high"), F.avg("u8").alias("mean"), at(0, 0).alias("b00"), at(0, 1).alias("b01"), at(1, 0).alias("b10"), at(1, 1).alias("b11"))
    colour = F.lit("ERROR")
    for k, name in pattern.items():
        colour = F.when(F.col("frame_id") % len(pattern) == k, F.lit(PATTERNS.get(name, "ERROR"))).otherwise(colour)
    return stats.withColumn("first_colour", colour)


def yuyv_to_rgb(pixels: DataFrame) -> DataFrame:
    """(frame_id, quad, k, r, g, b): samples read as (Y0, U, Y1, V) quads, two pixels each, by BT.601 video range."""
    at = lambda i: F.max(F.when(F.col("p") % 4 == i, F.col("u8"))).cast("double")
    quads = pixels.groupBy("frame_id", F.floor(F.col("p") / 4).alias("quad")).agg(at(0).alias("y0"), at(1).alias("u"), at(2).alias("y1"), at(3).alias("v"))
    two = quads.select("frame_id", "quad", "u", "v", F.posexplode(F.array("y0", "y1")).alias("k", "luma"))
    c, d, e = 1.164383 * (F.col("luma") - 16), F.col("u") - 128, F.col("v") - 128
    level = lambda x: clip(F.bround(x), 0, 255).cast("long")
    return two.select("frame_id", "quad", "k", level(c + 1.596027 * e).alias("r"), level(c - 0.391762 * d - 0.812968 * e).alias("g"), level(c + 2.017232 * d).alias("b"))


def last_frame(frames: DataFrame, order: str, image: str) -> DataFrame:
    """(order, p, value) of the frame with the highest sequence number."""
    best = frames.agg(F.max(order).alias(order), F.max_by(image, order).alias("image"))
    return best.select(order, F.posexplode("image").alias("p", "value"))
