"""The named queries of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fotonflow.functions.scalar import byte_length
from fotonflow.operators import coeffs, pixels, routing, rules, slots
from fotonflow.plans.oracles import ORACLES as ORACLES
from fotonflow.sources import views
from fotonflow.sources.tables import preloaded_fifo, synthetic_frames, synthetic_items, table
from fotonflow.streaming import streams

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
MOSAICS = {0: "RGGB", 1: "BGGR", 2: "GRBG", 3: "GBRG", 4: "none"}
GAMMA_ENTRIES = 256


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def rounded(df: DataFrame, *names: str, digits: int = 6) -> DataFrame:
    return df.withColumns({n: F.round(n, digits) for n in names})


@query
def frame_luma_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coeffs.luma_stats(views.pixels(spark, sf_dir)).drop("channel"), "mean", "var")


@query
def coeffs_from_bayer(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coeffs.adaptive(coeffs.luma_stats(views.pixels(spark, sf_dir)))
    return rounded(found, "ae_gain", "awb_r", "awb_g", "awb_b", "gamma", "noise", "sharp")


@query
def coeffs_constant_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coeffs.constant_model(coeffs.luma_stats(views.pixels(spark, sf_dir))), "ae_gain", "gamma")


@query
def coeffs_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = coeffs.adaptive(coeffs.luma_stats(coeffs.crop(views.pixels(spark, sf_dir), 1, 7, 1, 7)))
    return rounded(found, "ae_gain", "awb_r", "awb_g", "awb_b", "gamma", "noise", "sharp")


@query
def coeff_static_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return coeffs.static_outputs(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("frame_id")))


@query
def coeff_routing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only what a consumer declares, in its order; names it does not know are not passed."""
    return coeffs.routed(coeffs_from_bayer(spark, sf_dir), ["frame_id", "sharp", "noise", "hue", "gamma"])


@query
def controller_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every coefficient that the step does not update is one frame's own, to show that it passes through."""
    measured = coeffs.measurements(views.pixels(spark, sf_dir))
    names = ["gamma", "noise", "sharp", *[f"ccm_{i}" for i in range(9)], *[f"lens_{i}" for i in range(4)], *[f"color_{i}" for i in range(3)]]
    current = measured.withColumns({n: (F.col("frame_id") * 31 + i).cast("double") for i, n in enumerate(names)})
    return rounded(coeffs.controller_step(current), "ae_gain", "awb_r", "awb_g", "awb_b", "af_score")


@query
def output_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The place of the output that each consumer asks for; an unknown name answers with the first."""
    names, asked = F.array(*map(F.lit, ("ccm", "lens", "color", "gamma"))), F.array(*map(F.lit, ("gamma", "wb_gains", "ccm", "color", "lens")))
    wanted = F.element_at(asked, (F.col("event_id") % 5 + 1).cast("int"))
    return table(spark, sf_dir, "events").select("event_id", wanted.alias("wanted"), coeffs.output_index(names, wanted).alias("place"))


@query
def controller_feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(coeffs.controller_feedback(coeffs.measurements(views.pixels(spark, sf_dir))), "ae_gain")


def micro(x: Column) -> Column:
    """Rounded to millionths by the same steps as in the SQL."""
    return F.floor(x * 1e6 + 0.5) / F.lit(1e6)


def _raw_wb(value: Column) -> list[Column]:
    return [1 + value / 1000, F.lit(1.0), 1 + value / 2000]


@query
def rule_wb_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    wb = rules.normalised(_raw_wb(F.col("value")))
    return rounded(views.raw_coefficients(spark, sf_dir).select("event_id", *[c.alias(n) for c, n in zip(wb, ("wb_r", "wb_g", "wb_b"))]), "wb_r", "wb_g", "wb_b")


def _scalar_fold(spark: SparkSession, sf_dir: str, raw: Column, channel: rules.Channel) -> DataFrame:
    found = rules.stabilise(views.raw_coefficients(spark, sf_dir), channel, F.array(raw))
    return found.select("stream_id", "event_id", micro(F.col("values")[0]).alias("value"))


def _array_fold(spark: SparkSession, sf_dir: str, raw: list[Column], channel: rules.Channel) -> DataFrame:
    found = rules.stabilise(views.raw_coefficients(spark, sf_dir), channel, F.array(*raw))
    cells = found.select("stream_id", "event_id", F.posexplode("values").alias("pos", "value"))
    return cells.withColumn("value", micro(F.col("value")))


@query
def rule_sharpness_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar_fold(spark, sf_dir, rules.sharpness_target(F.col("value") / 100, F.col("gain")), rules.PARAMS.sharpness)


@query
def rule_nr_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scalar_fold(spark, sf_dir, rules.noise_target(F.col("value") / 100, F.col("gain")), rules.PARAMS.nr)


@query
def rule_wb_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _array_fold(spark, sf_dir, rules.normalised(_raw_wb(F.col("value"))), rules.PARAMS.wb)


@query
def rule_ccm_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = [F.lit(1.0 if i % 4 == 0 else 0.0) + F.col("value") * (i + 1) / 1777 for i in range(9)]
    return _array_fold(spark, sf_dir, raw, rules.PARAMS.ccm)


@query
def rule_gamma_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 256 entries of each table, in millionths, as one text."""
    raw = [F.lit(i / (GAMMA_ENTRIES - 1)) * F.col("value") / 100 for i in range(GAMMA_ENTRIES)]
    found = rules.stabilise(views.raw_coefficients(spark, sf_dir), rules.PARAMS.gamma(GAMMA_ENTRIES), F.array(*raw))
    return found.select("stream_id", "event_id", F.array_join(F.transform("values", lambda x: F.floor(x * 1e6 + 0.5)), ",").alias("entries"))


@query
def demosaic_replicate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.demosaic_replicate(views.pixels(spark, sf_dir))


@query
def denoise_box3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.denoise_box3(views.pixels(spark, sf_dir))


@query
def pixel_quantise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.normalise_quantise(views.pixels(spark, sf_dir)), "unit", "raw_unit")


@query
def bayer_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(pixels.bayer_check(views.pixels(spark, sf_dir), MOSAICS), "mean")


@query
def yuyv_to_rgb(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels.yuyv_to_rgb(views.pixels(spark, sf_dir))


@query
def last_frame_sink(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "embeddings").withColumnRenamed("vec_id", "frame_id")
    return pixels.last_frame(frames, "frame_id", "embedding").withColumn("value", F.round(F.col("value").cast("double"), 6))


def _routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.monitored(routing.fast_forward(views.items(spark, sf_dir)))


@query
def handoff_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per batch: its size, and whether it is fast-forwarded or falls back to the monitor."""
    routed = routing.fast_forward(views.items(spark, sf_dir))
    return routed.groupBy("worker", "batch").agg(F.count("*").alias("n_items"), F.when(F.min("ff"), routing.FAST_FORWARD).otherwise(routing.FALLBACK).alias("reason"))


@query
def monitor_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _routed(spark, sf_dir).select("packet_id", "worker", "batch", "outcome", "owner_after")


@query
def handoff_control_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.control_items(_routed(spark, sf_dir))


@query
def event_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return routing.event_counts(_routed(spark, sf_dir))


def _queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.appended(views.control_items(spark, sf_dir))


@query
def slot_fifo(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queue(spark, sf_dir).select("free_seq", "slot_index", "epoch")


@query
def slot_pop_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.popped(_queue(spark, sf_dir)).select("free_seq", "slot_index", "epoch")


@query
def slot_allocate(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("request_id"), "o_orderdate")
    requests = slots.numbered(orders, F.date_trunc("day", "o_orderdate"), ["o_orderdate", "request_id"], "nth")
    return slots.allocated(requests, _queue(spark, sf_dir)).select("request_id", "nth", "slot_index")


@query
def slot_last_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.last_sequence(_queue(spark, sf_dir))


@query
def slot_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Control items, completions and an allocator's releases (views of a slot) in one queue."""
    events = table(spark, sf_dir, "events").where(F.col("event_type") == "view")
    releases = events.select(F.col("event_id").alias("id"), "ts", F.col("event_id").alias("slot_index"), F.lit(1).cast("long").alias("epoch"))
    return slots.ledger(views.control_items(spark, sf_dir), views.hw_done(spark, sf_dir), releases)


@query
def fifo_preload(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preloaded_fifo(spark)


@query
def demo_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hand-off demo: its control items."""
    return routing.control_items(routing.monitored(routing.fast_forward(synthetic_items(spark))))


@query
def synthetic_frame_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per made-up frame: its size, and whether all values lie in [0, 1)."""
    frames = synthetic_frames(spark, 5, 108, 192)
    return frames.groupBy("frame_id").agg(F.count("*").alias("n"), (F.max("y") + 1).alias("height"), (F.max("x") + 1).alias("width"), F.min((F.col("v") >= 0) & (F.col("v") < 1)).alias("in_range"))


@query
def frame_table_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.frame_table(views.control_items(spark, sf_dir))


@query
def hw_done_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.completed(views.hw_done(spark, sf_dir), views.control_items(spark, sf_dir)).drop("ts")


@query
def seq_match_timeout(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_orderdate").alias("ts"))
    found = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("seq"), F.col("l_shipdate").alias("c_ts"))
    return slots.matched_by_sequence(frames, found).withColumn("first_match", F.date_format("first_match", "yyyy-MM-dd"))


@query
def idempotent_control(spark: SparkSession, sf_dir: str) -> DataFrame:
    return slots.first_by_key(views.control_items(spark, sf_dir))


@query
def queue_depth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Depth of the waiting queue after each event: purchases and clicks wait, views leave."""
    change = F.when(F.col("event_type").isin("purchase", "click"), 1).when(F.col("event_type") == "view", -1).otherwise(0).cast("long")
    rows = table(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    return slots.running(rows, F.date_trunc("hour", "ts"), ["ts", "event_id"], change, "depth").select("event_id", "depth")


@query
def inference_stub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Micro-batches of eight items per worker; the stub model answers 0.0 for each."""
    nth = F.row_number().over(Window.partitionBy("worker").orderBy("packet_id"))
    rows = views.items(spark, sf_dir).select("packet_id", "worker", "k", F.floor((nth - 1) / 8).alias("batch_no"))
    shape = F.array(F.lit(1).cast("long"), (1 + F.col("k") % 16).cast("long"))
    return rows.select("packet_id", "worker", "batch_no", F.lit(0.0).alias("output"), F.lit(True).alias("success"), byte_length(shape, F.col("k") % 2 == 0).alias("bytes"))


@query
def stream_rule_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """rule_sharpness_fold as a stateful streaming query."""
    k = F.get_json_object("props", "$.k").cast("int")
    target = rules.sharpness_target(F.col("value") / 100, (1 + k % 16).cast("double"))
    targets = streams.event_stream(spark, sf_dir).select(F.col("user_id").alias("stream_id"), "ts", "event_id", (F.col("event_type") == "error").alias("scene_change"), F.array(target).alias("raw"))
    found = streams.drained(streams.stabilise_stream(targets, rules.PARAMS.sharpness))
    return found.select("stream_id", "event_id", micro(F.col("values")[0]).alias("value"))


@query
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct idempotency keys, deduplicated in a stream."""
    k = F.get_json_object("props", "$.k").cast("long")
    events = streams.event_stream(spark, sf_dir).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") * 100 + k).alias("idempotency_key"))
    return streams.drained(streams.dedupe_stream(events, ["idempotency_key"])).select("idempotency_key")
