"""Packing by power-of-two decomposition.

A document of L tokens is cut into full windows and then into pieces whose lengths are the binary
digits of the rest, longest first. Each piece is one sequence: its length is a power of two, so it
needs no padding and never holds two documents. Sequences of equal length form buckets, and each
bucket is cut into batches of equal token counts.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fotonflow.llm.bpe import TwoAges, byte_letters, small_batches
from fotonflow.llm.common import kept, materialize

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: White space by Unicode; str.split() also cuts at these four control characters, which are not.
CONTROLS = re.compile("[\x1c-\x1f]")
#: Entries of a young cache; about 200 bytes each.
RUNS = 400_000
#: Latin letters without the dotted capital I (its small form is two characters), and the ASCII signs that may follow a word, without the apostrophe.
WORD = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f]+)([!-&(-/:-@[-`{-~]*)")


class PieceTokenizer:
    """Ids of a tokenizer that lower-cases and drops white space, with bounded caches.

    No token spans white space, so runs of other characters are encoded apart and kept by run. Most new
    runs are a known word with a capital or a sign behind it, so words are also kept, in lower case.
    """

    def __init__(self, spec: str):
        self.inner = Tokenizer.from_str(spec)
        self.inner.no_truncation()
        self.inner.no_padding()
        self.model = self.inner.model
        self.letters = [c for c, _ in sorted(byte_letters().items(), key=lambda x: x[1])]
        self.cache = TwoAges(RUNS)
        self.words = TwoAges(RUNS)

    def _apart(self, runs: list[str]) -> list[bytes]:
        return [array("I", x.ids).tobytes() for x in self.inner.encode_batch_fast(runs, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case words, each one pre-token: the vocabulary's model is asked directly, with bytes written as its letters."""
        letters, ask = self.letters, self.model.tokenize
        return [array("I", [t.id for t in ask(w if w.isascii() else "".join([letters[b] for b in w.encode()]))]).tobytes() for w in words]

    def _learn(self, runs: list[str]) -> None:
        parts, odd = [], []
        for run in runs:
            if m := WORD.fullmatch(run):
                parts.append((run, m[1].lower(), m[2]))
            else:
                odd.append(run)
        self.words.age()
        if new := self.words.missing([word for _, word, _ in parts]):
            self.words.young.update(zip(new, self._words(new)))
        signs = list({sign for _, _, sign in parts if sign})
        tails = dict(zip(signs, self._apart(signs))) | {"": b""}
        known = self.words.young
        self.cache.young.update((run, known[word] + tails[sign]) for run, word, sign in parts)
        self.cache.young.update(zip(odd, self._apart(odd)))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids as little-endian unsigned 32-bit integers."""
        self.cache.age()
        split = [[t] if CONTROLS.search(t) else t.split() for t in texts]
        if new := self.cache.missing([p for ps in split for p in ps]):
            self._learn(new)
        known = self.cache.young.__getitem__
        return [b"".join(map(known, ps)) for ps in split]


def tokenizer(spec: str) -> PieceTokenizer:
    return kept(("tokenizer", hash(spec)), lambda: PieceTokenizer(spec))


def binary_lengths(total: int, window: int) -> list[int]:
    """Full windows, then the powers of two that make up the rest, longest first. ``window`` is a power of two."""
    full, rest = divmod(total, window)
    return [window] * full + [1 << k for k in range(rest.bit_length() - 1, -1, -1) if rest >> k & 1]


def pack(docs: DataFrame, spec: str, window: int = 2048, end_id: int = 1, batch_tokens: int = 1 << 20, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """One row per piece of every document; a piece is a whole sequence.

    ``spec`` is the JSON text of a tokenizer that drops white space; ``end_id`` closes each document.
    Returns (id_col, start, length, ids_crc32, doc_tokens, sequence_id, offset, bucket, batch_id), with
    the piece's ids (little-endian 32-bit) in ``ids`` if ``keep_ids``. ``sequence_id`` counts from 0
    without gaps, bucket by bucket (shorter first); ``batch_id`` numbers, within a bucket, batches of
    ``batch_tokens`` tokens. A null or empty text is a document of one token; rows with equal or null
    ids are packed apart; other columns are not read; an empty table gives no rows.
    Pieces are tokenised once and written; ids come from counts per task and bucket.
    """
    if window & (window - 1):
        raise ValueError("window must be a power of two")
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(spec)
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    names = [id_col, "start", "length", "ids_crc32", "doc_tokens", "bucket", "task", "nth", *["ids"] * keep_ids]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work, task, seen = tokenizer(shared.value), TaskContext.get().partitionId(), [0] * window.bit_length()
        tail = array("I", [end_id]).tobytes()
        for whole in batches:
            for batch in small_batches(whole, 1):
                owner, start, length, crc, total, bucket, nth, kept = [], [], [], [], [], [], [], []
                for i, ids in enumerate(work.ids([t or "" for t in batch.column(1).to_pylist()])):
                    ids += tail
                    at = 0
                    for n in binary_lengths(len(ids) // 4, window):
                        piece, b = ids[4 * at : 4 * (at + n)], n.bit_length() - 1
                        owner.append(i)
                        start.append(at)
                        length.append(n)
                        crc.append(zlib.crc32(piece))
                        total.append(len(ids) // 4)
                        bucket.append(b)
                        nth.append(seen[b])
                        seen[b] += 1
                        at += n
                        if keep_ids:
                            kept.append(piece)
                longs = [pa.array(x, pa.int64()) for x in (start, length, crc, total, bucket, np.full(len(owner), task), nth)]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner, pa.int64())), *longs, *[pa.array(kept, pa.binary())] * keep_ids], names=names)

    kind = rows.schema[0].dataType.simpleString()
    schema = f"`{id_col}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, bucket long, task long, nth long" + ", ids binary" * keep_ids
    pieces = materialize(rows.mapInArrow(run, schema), "pieces")
    counts = pieces.groupBy("bucket", "task").agg(F.count("*").alias("n"))
    # a row per task and bucket; running sums give each task its first id in each bucket
    within = Window.partitionBy("bucket").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    buckets = counts.groupBy("bucket").agg(F.sum("n").alias("all"))
    lower = buckets.select(F.col("bucket").alias("other"), F.col("all").alias("below"))
    firsts = buckets.join(F.broadcast(lower), F.col("other") < F.col("bucket"), "left").groupBy("bucket").agg(F.coalesce(F.sum("below"), F.lit(0)).alias("first"))
    offsets = counts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).join(F.broadcast(firsts), "bucket").select("bucket", "task", "first", "before")
    placed = pieces.join(offsets, ["bucket", "task"])
    nth = F.col("before") + F.col("nth")
    return placed.select(
        id_col, "start", "length", "ids_crc32", "doc_tokens", (F.col("first") + nth).alias("sequence_id"), F.lit(0).cast("long").alias("offset"), "bucket", F.floor(nth * F.col("length") / batch_tokens).alias("batch_id"), *["ids"] * keep_ids
    )
