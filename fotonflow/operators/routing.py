"""Ownership rules of the hand-off: fast-forward by batch, monitor by item, as windows over a total order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Reasons of control items.
RETURNED, FALLBACK, FAST_FORWARD = 1, 2, 3
#: The event that each outcome emits.
EVENTS = {"FF": "HANDOFF_FAST_FORWARDED", "EPOCH": "PACKET_EPOCH_MISMATCH", "FAIL": "TOKEN_TRANSFER_FAIL", "FIFO": "PACKET_RETURNED_TO_FIFO", "RECLAIM": "FRAME_RECLAIM_TRIGGERED", "CTRL": "PROCESSITEM_CONVERTED_TO_CONTROL"}


def fast_forward(items: DataFrame) -> DataFrame:
    """Adds ``ff``: a batch is fast-forwarded if every token in it is unowned and met once; one failure fails the batch."""
    nth = F.row_number().over(Window.partitionBy("worker", "batch", "token").orderBy("packet_id"))
    claimed = F.col("token").isNull() | ((F.col("owner") == 0) & (nth == 1))
    batch = Window.partitionBy("worker", "batch")
    return items.withColumn("claimed", claimed).withColumn("ff", F.min("claimed").over(batch)).drop("claimed")


def monitored(items: DataFrame) -> DataFrame:
    """Adds ``outcome`` (and ``owner_after``) to items with ``ff``; batches that are not fast-forwarded go through the monitor.

    In order: unpublished packets are dropped; a token that is owned, or that an earlier published item of the batch has
    claimed, fails; items without a token return their slot; frames that hardware uses are kept; the rest become control items.
    ``owner_after`` is the token's owner when the batch is done: 2 after a fast forward, 1 once the monitor has claimed it.
    """
    earlier = Window.partitionBy("worker", "batch", "token").orderBy("packet_id").rowsBetween(Window.unboundedPreceding, 0)
    published = F.sum("publish").over(earlier)
    outcome = (
        F.when(F.col("ff"), "FF")
        .when(F.col("publish") == 0, "EPOCH")
        .when(F.col("token").isNotNull() & ((F.col("owner") != 0) | (published > 1)), "FAIL")
        .when(F.col("token").isNull(), "FIFO")
        .when(F.col("hw") == 1, "RECLAIM")
        .otherwise("CTRL")
    )
    claims = F.sum("publish").over(Window.partitionBy("worker", "batch", "token"))
    after = F.when(F.col("token").isNull(), None).when(F.col("ff"), 2).when((F.col("owner") == 0) & (claims > 0), 1).otherwise(F.col("owner"))
    return items.withColumn("outcome", outcome).withColumn("owner_after", after)


#: The envelope of an item and its names in a control item.
ENVELOPE = {"cmd_type": "control_type", "worker": "origin_worker_id", "packet_id": "packet_id", "epoch": "packet_epoch", "diagnostics_idx": "diagnostics_idx", "frame_id": "frame_id", "alloc_ticket": "alloc_ticket", "idempotency_key": "idempotency_key"}


def control_items(routed: DataFrame) -> DataFrame:
    """The eight envelope fields and the reason of the items that become control items, with their batch."""
    reason = F.when(F.col("outcome") == "FF", FAST_FORWARD).otherwise(FALLBACK)
    fields = [F.col(ours).alias(theirs) for ours, theirs in ENVELOPE.items()]
    return routed.where(F.col("outcome").isin("FF", "CTRL")).select(*fields, "batch", reason.alias("reason"))


def event_counts(routed: DataFrame) -> DataFrame:
    """(event, n) of the events that routing emits."""
    event = F.element_at(F.create_map(*[F.lit(x) for kv in EVENTS.items() for x in kv]), F.col("outcome"))
    return routed.groupBy(event.alias("event")).agg(F.count("*").alias("n"))
