"""Quality classifier: naive Bayes support vectors.

A text's features are indicators of word n-grams and of n-grams of word shapes. Each indicator is
scaled by the log ratio of its smoothed frequencies in the two classes, vectors are brought to unit
length, and a linear hinge-loss model is fitted by dual coordinate descent: one model per shard of
the training rows, averaged. Margins become probabilities by a logistic curve fitted on rows that no
shard has seen.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotonflow.llm.bpe import small_batches
from fotonflow.llm.common import kept, materialize

BITS = 18
BIAS = 0
SHAPE_ORDER = 4
WORD_CACHE = 400_000
#: Characters of text whose words are held at a time.
BLOCK = 1 << 20


class WordCodes(dict):
    """word -> (hash << 8) | shape; seven bits tell letter case, digits and how the word ends."""

    def __missing__(self, word: str) -> int:
        letters = [c for c in word if c.isalpha()]
        if not letters:
            case = 0
        elif all(c.isupper() for c in letters):
            case = 3 if len(letters) > 1 else 2
        elif letters[0].isupper() and not any(c.isupper() for c in letters[1:]):
            case = 2
        else:
            case = 4 if any(c.isupper() for c in letters) else 1
        last = word[-1]
        end = 0 if last.isalnum() else 1 + (".,!?;:|".find(last) if last in ".,!?;:|" else 7)
        code = (zlib.crc32(word.encode("utf-8", "surrogatepass")) << 8) | case | min(end, 7) << 3 | any(c.isdigit() for c in word) << 6
        if len(self) < WORD_CACHE:
            self[word] = code
        return code


def mix(x: np.ndarray, salt: int) -> np.ndarray:
    x = (x + np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return (x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - BITS)


def text_blocks(text: str) -> Iterator[str]:
    """The text in pieces that end between words."""
    at = 0
    while at < len(text):
        end = at + BLOCK
        if end < len(text) and (m := re.compile(r"\s").search(text, end)):
            end = m.start()
        elif end < len(text):
            end = len(text)
        yield text[at:end]
        at = end


def features(text: str) -> np.ndarray:
    """Sorted numbers below 2**BITS of the n-grams that a whole text holds; the bias is always among them.

    Word unigrams and bigrams, and shape n-grams up to SHAPE_ORDER, where a shape also tells whether a
    word repeats the one before it.
    """
    known = kept("word codes", WordCodes).__getitem__
    seen = [np.array([BIAS], np.uint64)]
    last = np.zeros(0, np.uint64)
    shapes = np.zeros(0, np.uint64)
    for block in text_blocks(text):
        words = block.split()
        if not words:
            continue
        codes = np.fromiter(map(known, words), np.uint64, len(words))
        h = np.concatenate([last, codes >> np.uint64(8)])
        again = np.concatenate([np.zeros(1 - len(last), bool), h[1:] == h[:-1]]).astype(np.uint64)
        shapes = np.concatenate([shapes[-(SHAPE_ORDER - 1) :], (codes & np.uint64(127)) | again << np.uint64(7)])
        found = [mix(h, 1), mix(h[:-1] * np.uint64(0x100000001B3) + h[1:], 2)]
        gram = shapes
        for n in range(SHAPE_ORDER):
            if n:
                gram = gram[:-1] << np.uint64(8) | shapes[n:]
            found.append(mix(np.unique(gram), 3 + n))
        seen.append(np.unique(np.concatenate(found)))
        last = h[-1:]
    return np.unique(np.concatenate(seen)).astype(np.uint32)


@dataclass(frozen=True)
class Model:
    """Weights per feature, already scaled by the log-count ratios, their squares for the length, and the logistic curve."""

    ratio: np.ndarray
    weight: np.ndarray
    slope: float
    offset: float

    def margin(self, ids: np.ndarray) -> float:
        r = self.ratio[ids]
        return float(r @ self.weight[ids]) / max(float(np.sqrt(r @ r)), 1e-12)

    def score(self, text: str) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.slope * self.margin(features(text)) + self.offset, -500, 500))))


def dual_coordinate_descent(rows: list[np.ndarray], values: list[np.ndarray], y: np.ndarray, cost: np.ndarray, size: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    """Weights of min |w|^2/2 + sum cost * hinge(y w.x), one dual variable at a time in random order."""
    w, alpha = np.zeros(size), np.zeros(len(y))
    squares = [float(v @ v) for v in values]
    order = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in order.permutation(len(y)).tolist():
            ids, v = rows[i], values[i]
            slope = y[i] * float(w[ids] @ v) - 1
            new = min(max(alpha[i] - slope / max(squares[i], 1e-12), 0.0), cost[i])
            if (step := new - alpha[i]) != 0:
                w[ids] += step * y[i] * v
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def logistic_curve(m: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the probability of label 1, by Newton steps against smoothed targets."""
    up, down = int((y > 0).sum()), int((y <= 0).sum())
    target = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([m, np.ones_like(m)], axis=1)
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        grad = x.T @ (p - target) + 1e-3 * (b - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        b -= np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(b[0], 0.0)), float(b[1])


def held_out(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "quality", folds: int = 5, sample: int = 12_000, shards: int = 6, cost: float = 1.0) -> Model:
    """Fit on at most ``sample`` labelled documents outside the held-out fold (a documented bound).

    The sample is the training labels with the smallest hash of doc_id; a doc_id with several labels counts
    with the smallest, null labels and ids are left out. Features are only read from the texts. With
    one class only (or none) the model answers that class for every text (or one half).
    """
    size = 1 << BITS
    chosen = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("y")).dropna().where(~held_out("doc_id", folds, 0))
    chosen = chosen.groupBy("doc_id").agg(F.min("y").alias("y")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "y")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 1):
                ids = [features(t or "").tobytes() for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(ids, pa.binary())], names=["doc_id", "y", "ids"])

    rows = materialize(texts.mapInArrow(read, "doc_id long, y int, ids binary"), "quality")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros((2, size), np.int64)
        for batch in batches:
            for y, ids in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                seen[int(y > 0), np.frombuffer(ids, np.uint32)] += 1
        some = np.flatnonzero(seen.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (some, seen[0, some], seen[1, some])], names=["id", "down", "up"])

    # at most 2**BITS rows
    counts = rows.mapInArrow(count, "id long, down long, up long").groupBy("id").agg(F.sum("down").alias("down"), F.sum("up").alias("up")).toPandas()
    down, up = np.ones(size), np.ones(size)
    down[counts["id"]] += counts["down"]
    up[counts["id"]] += counts["up"]
    n_down, n_up = down[BIAS] - 1, up[BIAS] - 1
    if not n_down or not n_up:
        return Model(np.zeros(size), np.zeros(size), 0.0, 30.0 * (n_up > 0) - 30.0 * (n_down > 0))
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    ratio[BIAS] = 1.0
    sent = rows.sparkSession.sparkContext.broadcast(ratio)
    spare = F.pmod(F.xxhash64(F.lit(7), "doc_id"), F.lit(8)) == 0

    def train(pdf: pd.DataFrame) -> pd.DataFrame:
        r = sent.value
        ids = [np.frombuffer(x, np.uint32) for x in pdf["ids"]]
        values = [r[i] / max(float(np.sqrt(r[i] @ r[i])), 1e-12) for i in ids]
        y = np.where(pdf["y"].to_numpy() > 0, 1.0, -1.0)
        weight = np.where(y > 0, len(y) / max(1, 2 * (y > 0).sum()), len(y) / max(1, 2 * (y < 0).sum()))
        w = dual_coordinate_descent(ids, values, y, cost * weight, size)
        some = np.flatnonzero(w)
        return pd.DataFrame({"id": some, "w": w[some]})

    models = rows.where(~spare).groupBy(F.pmod(F.xxhash64("doc_id"), F.lit(shards)).alias("shard")).applyInPandas(train, "id long, w double")
    found = models.groupBy("id").agg((F.sum("w") / shards).alias("w")).toPandas()
    weight = np.zeros(size)
    weight[found["id"]] = found["w"]
    linear = Model(ratio, weight, 1.0, 0.0)
    held = rows.where(spare).select("y", "ids").toPandas()  # a part of the sample
    y = held["y"].to_numpy()
    if (y > 0).any() and (y <= 0).any():
        slope, offset = logistic_curve(np.array([linear.margin(np.frombuffer(x, np.uint32)) for x in held["ids"]]), y)
    else:
        slope, offset = 3.0, 0.0
    return Model(ratio.astype(np.float32), weight.astype(np.float32), slope, offset)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, folds: int = 5) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row; null and empty texts get the score of no n-grams."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 1):
                found = [sent.value.score(t or "") for t in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], names=["doc_id", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")
    return rows.select("doc_id", held_out("doc_id", folds, 0).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep(docs: DataFrame, model: Model, threshold: float = 0.3) -> DataFrame:
    """The rows, with all columns, whose whole text scores at least ``threshold``; null texts count as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, at):
                yield batch.filter(pa.array([sent.value.score(t or "") >= threshold for t in batch.column(at).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
