"""Coefficients from frame statistics (exposure, white balance, gamma, noise, sharpness), and the stateful controller."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotonflow.functions.scalar import clip, safe_div


@dataclass(frozen=True)
class AlgoParams:
    """Fixed values of the adaptive model."""

    luma: tuple[float, float, float] = (0.2126, 0.7152, 0.0722)
    ae_gain: float = 0.7
    target: float = 0.18
    gamma_base: float = 1 / 2.2
    gamma_gain: float = 0.35
    gamma_min: float = 0.25
    gamma_max: float = 1.2
    noise_gain: float = 10.0
    noise_max: float = 3.0
    sharp_gain: float = 0.6


def luma(r: Column, g: Column, b: Column, weights: tuple[float, float, float] = AlgoParams.luma) -> Column:
    return weights[0] * r + weights[1] * g + weights[2] * b


def crop(pixels: DataFrame, y0: int, y1: int, x0: int, x1: int) -> DataFrame:
    """Half-open crop of rows and columns."""
    return pixels.where((F.col("y") >= y0) & (F.col("y") < y1) & (F.col("x") >= x0) & (F.col("x") < x1))


def luma_stats(pixels: DataFrame) -> DataFrame:
    """(frame_id, n_pixels, mean, var) of a plane that stands for all three channels."""
    y = luma(F.col("v"), F.col("v"), F.col("v"))
    return pixels.groupBy("frame_id").agg(F.count("*").alias("n_pixels"), F.avg(y).alias("mean"), F.var_pop(y).alias("var"), F.avg("v").alias("channel"))


def adaptive(stats: DataFrame, p: AlgoParams = AlgoParams()) -> DataFrame:
    """Per frame: stateless exposure, grey-world white balance, adaptive gamma, noise and sharpness."""
    noise = clip(p.noise_gain * F.col("var"), 0.0, p.noise_max)
    gain = safe_div(F.col("channel"), F.col("channel"))
    return stats.select(
        "frame_id",
        (p.ae_gain * (p.target - F.col("mean"))).alias("ae_gain"),
        gain.alias("awb_r"),
        F.col("channel").alias("awb_g"),
        gain.alias("awb_b"),
        clip(p.gamma_base + p.gamma_gain * (p.target - F.col("mean")), p.gamma_min, p.gamma_max).alias("gamma"),
        noise.alias("noise"),
        (1 / (1 + p.sharp_gain * noise)).alias("sharp"),
    )


def constant_model(stats: DataFrame) -> DataFrame:
    """The constant model: only exposure follows the frame."""
    one = F.lit(1.0)
    return stats.select("frame_id", (0.5 * (0.5 - F.col("mean"))).alias("ae_gain"), one.alias("awb_r"), one.alias("awb_g"), one.alias("awb_b"), F.lit(1 / 2.2).alias("gamma"), one.alias("noise"), one.alias("sharp"))


#: Outputs that do not depend on the frame: colour matrix, lens shading, contrast/saturation/hue.
STATIC_OUTPUTS = {"ccm": (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), "lens": (0.0, 0.0, 0.0, 0.0), "color": (1.0, 1.0, 0.0)}


def static_outputs(frames: DataFrame) -> DataFrame:
    """(frame_id, name, pos, value) of the static outputs of each frame."""
    cells = F.array(*[F.struct(F.lit(n).alias("name"), F.lit(i).alias("pos"), F.lit(v).alias("value")) for n, vs in STATIC_OUTPUTS.items() for i, v in enumerate(vs)])
    return frames.select("frame_id", F.explode(cells).alias("c")).select("frame_id", "c.name", "c.pos", "c.value")


def measurements(pixels: DataFrame) -> DataFrame:
    """(stream_id, frame_id, mean_y, r, g, b, af_score): channel means by phase of a red-green / green-blue mosaic, and the range of values as focus score."""
    red, blue = (F.col("y") % 2 == 0) & (F.col("x") % 2 == 0), (F.col("y") % 2 == 1) & (F.col("x") % 2 == 1)
    means = [F.avg("v").alias("mean_y"), F.avg(F.when(red, F.col("v"))).alias("r"), F.avg(F.when(~red & ~blue, F.col("v"))).alias("g"), F.avg(F.when(blue, F.col("v"))).alias("b"), (F.max("v") - F.min("v")).alias("af_score")]
    return pixels.groupBy("stream_id", "frame_id").agg(*means)


def controller_step(measured: DataFrame, gain: float = 1.0, k: float = 0.5, target: float = 0.5) -> DataFrame:
    """One step of the measurement controller from a fixed gain; all other columns (coefficients, the focus score) pass through unchanged."""
    mean = (F.col("r") + F.col("g") + F.col("b")) / 3
    carried = [c for c in measured.columns if c not in ("stream_id", "frame_id", "mean_y", "r", "g", "b")]
    return measured.select("frame_id", (gain + k * (target - F.col("mean_y"))).alias("ae_gain"), *[safe_div(mean, F.col(c)).alias(f"awb_{c}") for c in "rgb"], *carried)


def controller_feedback(measured: DataFrame, gain: float = 1.0, k: float = 0.5, target: float = 0.5) -> DataFrame:
    """The controller with its output fed back: the gain is linear in its history, so a running sum per stream gives it."""
    so_far = Window.partitionBy("stream_id").orderBy("frame_id").rowsBetween(Window.unboundedPreceding, 0)
    return measured.select("stream_id", "frame_id", (gain + F.sum(k * (target - F.col("mean_y"))).over(so_far)).alias("ae_gain"))


def routed(coefficients: DataFrame, declared: list[str]) -> DataFrame:
    """The coefficients that a consumer declares, in its order."""
    return coefficients.select(*[c for c in declared if c in coefficients.columns])


def output_index(names: Column, wanted: Column, strict: bool = False) -> Column:
    """Place of an output's name, from 0. A miss answers with the first output, or raises if ``strict``; nulls stay null."""
    place = F.array_position(names, wanted)
    miss = F.raise_error(F.concat(F.lit("no output is named "), wanted)).cast("long") if strict else F.lit(0).cast("long")
    return F.when(place == 0, miss).otherwise(place - 1)
