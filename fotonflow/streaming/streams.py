"""Streaming forms of the rule fold and of deduplication, over file sources."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from fotonflow.operators.rules import Channel, Stepper, fold, matrix

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def scratch(spark: SparkSession) -> str:
    """A folder that all executors share, for sinks and stream checkpoints; on one machine (local masters only) a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(found)
    return f"{found.rstrip('/')}/stream-{uuid.uuid4().hex}"


def drained(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Run a streaming query over all that its source holds and read what it wrote."""
    spark, path = stream.sparkSession, scratch(stream.sparkSession)
    query = stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").outputMode(mode).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def event_stream(spark: SparkSession, sf_dir: str, files_per_trigger: int = 1) -> DataFrame:
    """The events table as a stream of files, admitted a few at a time."""
    path = f"{sf_dir}/events.parquet"
    schema = spark.read.parquet(path).schema
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(f"{path}*")


class FoldProcessor(StatefulProcessor):
    """Keeps each stream's last values; rows of a micro-batch are folded in order of (ts, event_id).

    A stream's rows of one micro-batch are held together to be sorted: bound micro-batches by files per trigger.
    Nulls and NaN keep the state, as in ``rules.stabilise``.
    """

    def __init__(self, channel: Channel):
        self.channel = channel

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.values = handle.getValueState("values", StructType([StructField("values", ArrayType(DoubleType()))]))
        self.step = Stepper(self.channel)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timer_values: object) -> Iterator[pd.DataFrame]:
        state = np.array(self.values.get()[0] if self.values.exists() else self.channel.initial, float)
        whole = pd.concat(list(rows)).sort_values(["ts", "event_id"])
        raw = matrix(pa.array(whole["raw"], pa.list_(pa.float64())), len(state))
        change = whole["scene_change"].fillna(False).to_numpy(bool)
        states = state[None].copy()
        out = fold(raw, change, np.zeros(1, np.int64), states, self.step)
        self.values.update((states[0].tolist(),))
        yield pd.DataFrame({"stream_id": key[0], "event_id": whole["event_id"].to_numpy(), "values": out.tolist()})

    def close(self) -> None:
        pass


def stabilise_stream(targets: DataFrame, channel: Channel) -> DataFrame:
    """The streaming form of ``rules.stabilise``; events of a stream must reach it in order across micro-batches."""
    schema = StructType([StructField("stream_id", LongType()), StructField("event_id", LongType()), StructField("values", ArrayType(DoubleType()))])
    targets.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    return targets.groupBy("stream_id").transformWithStateInPandas(statefulProcessor=FoldProcessor(channel), outputStructType=schema, outputMode="Append", timeMode="None")


def dedupe_stream(events: DataFrame, key: list[str], within: str | None = None) -> DataFrame:
    """The first event of each key that arrives. All keys stay in the state store, unless ``within`` bounds it: then a key comes again after that time, and rows later than it are dropped."""
    if within is None:
        events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
        return events.dropDuplicates(key)
    return events.withWatermark("ts", within).dropDuplicatesWithinWatermark(key)
