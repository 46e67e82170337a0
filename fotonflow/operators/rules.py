"""The rule engine: temporal stabilisation of coefficients by stream.

Clipping makes the recurrence non-linear, so it has no window-function form. Streams are sorted within
partitions and folded as they pass by: the streams of a batch lie side by side and take each step at once,
and the memory is that of one batch and one stream's state whatever a stream's length.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotonflow.functions.scalar import clip, safe_div


@dataclass(frozen=True)
class Channel:
    """A group of equal-shaped values: its initial state, weights, step (None: no rate limit) and limits."""

    name: str
    initial: tuple[float, ...]
    low: float
    high: float
    alpha: float = 0.2
    fast: float = 0.5
    step: float | None = None


@dataclass(frozen=True)
class RuleParams:
    """The engine's default parameters and first state."""

    gain_max: float = 16.0
    wb: Channel = field(default_factory=lambda: Channel("wb", (1.0, 1.0, 1.0), 0.5, 2.0, step=0.05))
    ccm: Channel = field(default_factory=lambda: Channel("ccm", (1.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0), -2.0, 2.0))
    sharpness: Channel = field(default_factory=lambda: Channel("sharpness", (1.0,), 0.0, 1.0, step=0.05))
    nr: Channel = field(default_factory=lambda: Channel("nr", (0.5,), 0.0, 5.0))

    def gamma(self, entries: int = 256, linear: bool = False) -> Channel:
        first = tuple(i / (entries - 1) for i in range(entries)) if linear else (0.0,) * entries
        return Channel("gamma", first, 0.0, 1.0)


PARAMS = RuleParams()


def normalised(values: list[Column]) -> list[Column]:
    """Each value over the mean of all, as IEEE doubles: a zero mean gives infinities or NaN."""
    mean = sum(values[1:], values[0]) / len(values)
    return [safe_div(v, mean) for v in values]


def sharpness_target(raw: Column, gain: Column, most: float = PARAMS.gain_max) -> Column:
    return raw / clip(gain, 1.0, most)


def noise_target(raw: Column, gain: Column, most: float = PARAMS.gain_max) -> Column:
    return raw * clip(gain, 1.0, most)


class Stepper:
    """One frame's update of the values of some streams (streams x values)."""

    def __init__(self, channel: Channel):
        self.c = channel

    def __call__(self, raw: np.ndarray, previous: np.ndarray, scene_change: np.ndarray) -> np.ndarray:
        """New values; a NaN in ``raw`` keeps the previous value."""
        c = self.c
        a = np.where(scene_change, max(c.alpha, c.fast), c.alpha)
        out = a * raw + (1 - a) * previous
        if c.step is not None:
            out = (out + previous + np.clip(raw - previous, -c.step, c.step)) / 2
        return np.where(np.isnan(raw), previous, np.clip(out, c.low, c.high))


def matrix(raw: pa.Array, size: int) -> np.ndarray:
    """A list column as rows of ``size`` doubles; null lists and null elements are NaN."""
    out = np.full((len(raw), size), np.nan)
    some = raw.is_valid().to_numpy(zero_copy_only=False)
    out[some] = raw.drop_null().flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, size)
    return out


def fold(raw: np.ndarray, change: np.ndarray, starts: np.ndarray, states: np.ndarray, step: Stepper) -> np.ndarray:
    """Values after each row. Rows are in runs that begin at ``starts``, one per stream; ``states`` (a row per run) is updated in place."""
    out, sizes = np.empty_like(raw), np.diff(np.append(starts, len(raw)))
    by_size = np.argsort(-sizes, kind="stable")
    starts, sizes = starts[by_size], sizes[by_size]
    for nth in range(int(sizes[0]) if len(sizes) else 0):
        runs = by_size[: np.searchsorted(-sizes, -nth)]
        rows = starts[: len(runs)] + nth
        states[runs] = out[rows] = step(raw[rows], states[runs], change[rows, None])
    return out


def stabilise(targets: DataFrame, channel: Channel, raw: Column | None = None) -> DataFrame:
    """Fold (stream_id, ts, event_id, scene_change, raw array) into (stream_id, event_id, values), in order of (ts, event_id).

    ``raw`` may be an expression over the rows of ``targets`` in place of their column: it is evaluated on the sorted rows, so only
    the columns that it reads are shuffled, not the arrays.
    A null array, and a null or NaN element, keeps the previous state; a null scene_change counts as false; a null stream_id is a
    stream of its own; arrays have the channel's length. Repeated rows are frames of their own; an empty table gives no rows.
    """
    first = np.array(channel.initial)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step, last, state = Stepper(channel), object(), first
        for batch in batches:
            if not batch.num_rows:
                continue
            missing = batch.column(0).is_null().to_numpy(zero_copy_only=False)
            streams = batch.column(0).fill_null(0).to_numpy()
            new = (streams[1:] != streams[:-1]) | (missing[1:] != missing[:-1])
            starts = np.flatnonzero(np.concatenate([[True], new]))
            states = np.tile(first, (len(starts), 1))
            if last == (streams[0], missing[0]):
                states[0] = state
            change = batch.column(2).fill_null(False).to_numpy(zero_copy_only=False)
            out = fold(matrix(batch.column(3), len(first)), change, starts, states, step)
            last, state = (streams[-1], missing[-1]), states[-1].copy()
            values = pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1) * len(first), pa.int32()), pa.array(out.ravel()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), values], names=["stream_id", "event_id", "values"])

    rows = targets.repartition("stream_id").sortWithinPartitions("stream_id", "ts", "event_id")
    rows = rows.select("stream_id", "event_id", "scene_change", F.col("raw") if raw is None else raw.alias("raw"))
    return rows.mapInArrow(run, "stream_id long, event_id long, values array<double>")
