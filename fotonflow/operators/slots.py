"""Slot queue, frame table and completion notices as sequence numbers, upserts and lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotonflow.functions.scalar import unsigned32


def running(rows: DataFrame, bucket: Column, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the running total of ``value`` over all rows in ``order``, without sorting them in one task.

    ``bucket`` must not fall along the order (an hour of a timestamp, say): totals run within each bucket, and the
    short table of bucket totals gives each its start.
    """
    rows = rows.withColumn("_bucket", bucket).withColumn("_value", value)
    totals = rows.groupBy("_bucket").agg(F.sum("_value").alias("_sum"))
    starts = totals.select("_bucket", (F.sum("_sum").over(Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, 0)) - F.col("_sum")).alias("_start"))
    within = Window.partitionBy("_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.join(starts, "_bucket").withColumn(name, F.sum("_value").over(within) + F.col("_start")).drop("_bucket", "_value", "_sum", "_start")


def numbered(rows: DataFrame, bucket: Column, order: list[str], name: str) -> DataFrame:
    """Adds a gapless number from 1 in ``order``."""
    return running(rows, bucket, order, F.lit(1).cast("long"), name)


def appended(control: DataFrame) -> DataFrame:
    """The queue (event_id, ts, slot_index, epoch, free_seq) that control items append to; other types are ignored."""
    rows = control.where(F.col("control_type").isin("RETURN_TO_POOL", "RELEASE_FRAME"))
    queue = rows.select("event_id", "ts", unsigned32(F.col("alloc_ticket")).alias("slot_index"), "epoch")
    return numbered(queue, F.date_trunc("hour", "ts"), ["ts", "event_id"], "free_seq")


def popped(queue: DataFrame, k: int = 32) -> DataFrame:
    """The first k entries."""
    return queue.orderBy("free_seq").limit(k)


def allocated(requests: DataFrame, queue: DataFrame, free_list: DataFrame | None = None) -> DataFrame:
    """Numbered requests with their slots: those of the free list (nth, slot_index) first, then the queue's in order; without one a request times out (null)."""
    slots = queue.select(F.col("free_seq").alias("nth"), "slot_index")
    if free_list is not None:
        held = free_list.count()
        slots = free_list.select("nth", "slot_index").unionByName(slots.withColumn("nth", F.col("nth") + held))
    return requests.join(slots, "nth", "left")


def last_sequence(queue: DataFrame) -> DataFrame:
    """(last_seq): the highest number issued, 0 before the first."""
    return queue.agg(F.coalesce(F.max("free_seq"), F.lit(0)).alias("last_seq"))


#: Reasons of queue entries that an allocator's release and a token-less packet append.
RELEASED, TOKENLESS = 0, 1


def ledger(control: DataFrame, notices: DataFrame, releases: DataFrame) -> DataFrame:
    """The queue (free_seq, source, slot_index, epoch) after all that appends to it, in order of (ts, source, id).

    Control items append their slots, completion notices the slot of their frame's latest release (nothing if there is none),
    and ``releases`` (id, ts, slot_index, epoch) what an allocator gives back.
    """
    rows = control.where(F.col("control_type").isin("RETURN_TO_POOL", "RELEASE_FRAME"))
    given = rows.select("ts", F.lit(0).alias("source"), F.col("event_id").alias("id"), unsigned32(F.col("alloc_ticket")).alias("slot_index"), "epoch")
    done = completed(notices, control).select("ts", F.lit(1).alias("source"), F.col("order_id").alias("id"), "slot_index", "epoch")
    back = releases.select("ts", F.lit(2).alias("source"), "id", "slot_index", "epoch")
    every = given.unionByName(done).unionByName(back)
    return numbered(every, F.date_trunc("hour", "ts"), ["ts", "source", "id"], "free_seq").select("free_seq", "source", "slot_index", "epoch")


def frame_table(control: DataFrame) -> DataFrame:
    """Last release of each frame: (frame_id, alloc_ticket, hw_in_use, slot_index, epoch, updated_event); a release ends the hardware's use."""
    last = F.max_by(F.struct("alloc_ticket", "epoch", "event_id"), F.struct("ts", "event_id"))
    rows = control.where(F.col("control_type") == "RELEASE_FRAME").groupBy("frame_id").agg(last.alias("last"))
    return rows.select("frame_id", F.col("last.alloc_ticket").alias("alloc_ticket"), F.lit(False).alias("hw_in_use"), unsigned32(F.col("last.alloc_ticket")).alias("slot_index"), F.col("last.epoch").alias("epoch"), F.col("last.event_id").alias("updated_event"))


def completed(notices: DataFrame, control: DataFrame) -> DataFrame:
    """Each notice with the slot and epoch of its frame's latest release by then, the hardware's use ended; notices of unknown frames give nothing.

    One pass over both, sorted by frame and time: an as-of lookup without a range join.
    """
    releases = control.where(F.col("control_type") == "RELEASE_FRAME").select("frame_id", "ts", F.lit(0).alias("kind"), F.struct(unsigned32(F.col("alloc_ticket")).alias("slot_index"), F.col("epoch").cast("long").alias("epoch")).alias("slot"), F.col("event_id").alias("id"))
    both = releases.unionByName(notices.select("frame_id", "ts", F.lit(1).alias("kind"), F.lit(None).cast("struct<slot_index: bigint, epoch: bigint>").alias("slot"), F.col("order_id").alias("id")))
    before = Window.partitionBy("frame_id").orderBy("ts", "kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("known", F.last("slot", ignorenulls=True).over(before))
    return found.where((F.col("kind") == 1) & F.col("known").isNotNull()).select(F.col("id").alias("order_id"), "frame_id", "ts", "known.slot_index", "known.epoch", F.lit(False).alias("hw_in_use"))


def matched_by_sequence(frames: DataFrame, coefficients: DataFrame, days: int = 90) -> DataFrame:
    """(seq, first_match): the first coefficient of a frame's number within the time bound, null on timeout."""
    bound = F.make_dt_interval(F.lit(days))
    pairs = frames.join(coefficients.withColumnRenamed("seq", "c_seq"), (F.col("seq") == F.col("c_seq")) & (F.col("c_ts") >= F.col("ts")) & (F.col("c_ts") <= F.col("ts") + bound), "left")
    return pairs.groupBy("seq").agg(F.min("c_ts").alias("first_match"))


def first_by_key(control: DataFrame) -> DataFrame:
    """(idempotency_key, event_id): the first item of each key."""
    return control.groupBy("idempotency_key").agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"))
