"""Language-model scoring with a probabilistic suffix tree over words.

Contexts are the last 1, 2, ... ``depth`` words before a symbol. A context that training has met at least
``least`` times becomes a state of the tree when its next-symbol distribution diverges from that of its longest
suffix that is a state: the mean over its training symbols of log2(own / suffix), each symbol left out of its
own count, must reach ``divergence`` bits. A state's distribution is smoothed with its suffix's, down to the
add-one distribution of single words, and each symbol is scored by the longest suffix of its history that is a state.

Every position of the corpus (a symbol and its history) is dealt by the last words of its history, so a group
holds whole subtrees: it counts them, tests them and scores its own positions, some subtrees at a time, and the tree
is never gathered anywhere. Contexts too common for one group (hot ones) are counted by a Spark aggregation; their positions are
dealt by a longer context, and the counts that a group needs of them and of single words are joined to it.
Words are 48-bit hashes and contexts 64-bit ones; positions travel as compressed columns, one row per group and chunk.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fotonflow.llm.bpe import small_batches
from fotonflow.llm.common import materialize

#: Bytes of text whose words are held at a time, and symbols that a task deals out at a time.
BLOCK, CHUNK = 1 << 20, 1 << 20
#: Commonest words, whose hashes and counts every task holds (12 bytes each).
COMMON = 1 << 19
#: Positions of a group whose subtrees are grown at a time, about.
SLICE = 1 << 18
SPACES = re.compile(rb"[\x09-\x0d ]")


#: The symbol after the last word, and the mark before the first one.
END = xxhash.xxh64_intdigest(b" end") >> 16
#: An odd number and its inverse modulo 2**64.
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[*range(9, 14), 32]] = True
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """The first powers of ``base`` modulo 2**64, n at least."""
    if base not in _powers or len(_powers[base]) < n:
        steps = np.full(1 << max(12, n.bit_length()), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.cumprod(steps)
    return _powers[base]


def word_hashes(data: bytes) -> np.ndarray:
    """48-bit hashes of the words of lower-cased (A-Z) bytes: polynomials of their bytes, taken from running sums of the whole, then mixed."""
    x = np.frombuffer(data.lower(), np.uint8)
    edges = np.flatnonzero(np.diff(~WHITE[x], prepend=False, append=False))
    starts, stops = edges[::2], edges[1::2]
    sums = np.zeros(len(x) + 1, np.uint64)
    np.cumsum((x.astype(np.uint64) + np.uint64(1)) * powers(BASE, len(x))[: len(x)], out=sums[1:])
    h = (sums[stops] - sums[starts]) * powers(INVERSE, len(x))[starts]
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return (h >> np.uint64(16)).astype(np.int64)


def mix(a: np.ndarray, b: np.ndarray, salt: int) -> np.ndarray:
    """A hash of two 64-bit numbers; the order matters."""
    x = a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    x ^= x >> np.uint64(31)
    x = (x + b.view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return (x ^ (x >> np.uint64(32))).view(np.int64)


def longer(context: np.ndarray, older: np.ndarray) -> np.ndarray:
    """The context with an older word in front."""
    return mix(context, older, 11)


def pair(context: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    return mix(context, symbol, 23)


def symbols(text: str | None, depth: int) -> Iterator[tuple[int, np.ndarray]]:
    """Hashes of the lower-cased (A-Z) words of a whole text and of its end, in pieces.

    Each piece starts with up to ``depth`` words of the piece before (their number comes with it).
    """
    data = (text or "").encode("utf-8", "surrogatepass")
    held, at = np.zeros(0, np.int64), 0
    while True:
        cut = SPACES.search(data, at + BLOCK) if at + BLOCK < len(data) else None
        stop = cut.start() if cut else len(data)
        now = np.concatenate([held, word_hashes(data[at:stop]), np.full(0 if cut else 1, END, np.int64)])
        yield len(held), now
        if not cut:
            return
        held, at = now[max(0, len(now) - depth) :], stop


def packed(x: np.ndarray, rising: bool = False) -> bytes:
    """Compressed bytes, first bytes of all numbers first; of rising numbers the steps."""
    if not len(x):
        return b""
    x = np.diff(x, prepend=x.dtype.type(0)) if rising else x
    planes = np.ascontiguousarray(np.ascontiguousarray(x).view(np.uint8).reshape(len(x), -1).T)
    return len(x).to_bytes(8, "little") + pa.compress(planes, "zstd", asbytes=True)


def unpacked(data: bytes, kind: type, rising: bool = False) -> np.ndarray:
    if not data:
        return np.zeros(0, kind)
    n, size = int.from_bytes(data[:8], "little"), np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data[8:], n * size, "zstd", asbytes=True), np.uint8).reshape(size, n)
    x = np.ascontiguousarray(planes.T).view(kind).ravel()
    return np.cumsum(x, dtype=kind) if rising else x


def among(keys: np.ndarray, ordered: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each key is in a sorted array, and where."""
    if not len(ordered):
        return np.zeros(len(keys), bool), np.zeros(len(keys), np.int64)
    at = np.searchsorted(ordered, keys).clip(max=len(ordered) - 1)
    return ordered[at] == keys, at


@dataclass(frozen=True)
class Hot:
    """Contexts of one length that are too common for one group: sorted keys, symbols after them, distinct ones, and which are states."""

    keys: np.ndarray
    n: np.ndarray
    distinct: np.ndarray
    state: np.ndarray


@dataclass(frozen=True)
class Settings:
    """Bounds of the tree, and what is known of the whole training text."""

    depth: int
    least: int
    divergence: float
    tokens: int = 0
    words: int = 0
    hot: tuple[Hot, ...] = ()
    common: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    common_counts: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    """The commonest words by falling count."""


@dataclass
class Chunk:
    """Pieces of documents one after the other."""

    uids: np.ndarray
    train: np.ndarray
    ids: list[int | None]
    h: np.ndarray
    sizes: np.ndarray
    lead: np.ndarray

    def place(self) -> np.ndarray:
        """The place of each symbol in its piece, which starts at the document's start or holds the longest context."""
        return np.arange(len(self.h)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)

    def histories(self, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For lengths 1, 2, ...: the context of each symbol, and whether it has one (the start is the oldest word)."""
        place, context = self.place(), None
        for d in range(1, depth + 1):
            back = np.full(len(self.h), END, np.int64)
            back[d:] = self.h[:-d] if d < len(self.h) else []
            back[place < d] = END
            context = back if context is None else longer(context, back)
            yield context, place >= d - 1


def chunks(batches: Iterator[pa.RecordBatch], depth: int) -> Iterator[Chunk]:
    """Rows (uid, train, doc_id, text) as chunks of about CHUNK symbols."""
    held: list[tuple] = []
    n = 0

    def whole() -> Chunk:
        uids, train, ids, lead, hs = zip(*held)
        held.clear()
        return Chunk(np.array(uids, np.int64), np.array(train, bool), list(ids), np.concatenate(hs), np.array(list(map(len, hs))), np.array(lead))

    for large in batches:
        for batch in small_batches(large, 3):
            for uid, train, doc, text in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for lead, h in symbols(text, depth):
                    held.append((uid, train, doc, lead, h))
                    n += len(h)
                    if n >= CHUNK:
                        yield whole()
                        n = 0
    if held:
        yield whole()


def folded(id_col: str, folds: int, fold: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def _rows(docs: DataFrame, train: Column) -> DataFrame:
    """(uid, train, doc_id, text) of all documents."""
    return docs.select(F.monotonically_increasing_id().alias("uid"), train.alias("train"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _counted(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct pairs and how often each occurs."""
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.flatnonzero(np.concatenate([np.ones(min(1, len(a)), bool), (a[1:] != a[:-1]) | (b[1:] != b[:-1])]))
    return a[new], b[new], np.diff(np.append(new, len(a)))


def _word_counts(rows: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 0):
            words, c = np.unique(chunk.h, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(c)], names=["word", "c"])

    return rows.mapInArrow(run, "word long, c long").groupBy("word").agg(F.sum("c").alias("c"))


def _commonest(words: DataFrame, most: int) -> pd.DataFrame:
    """Words by falling count, at most ``most`` of them: those above a bound that a histogram of logarithms gives."""
    level = F.floor(F.log2("c") * 64)
    sizes = words.groupBy(level.alias("level")).agg(F.count("*").alias("n")).toPandas().sort_values("level", ascending=False)
    levels = sizes["level"][sizes["n"].cumsum() <= most]
    found = words.where(level >= int(levels.min())) if len(levels) else words.limit(0)
    return found.toPandas().sort_values(["c", "word"], ascending=[False, True])


def _hot_counts(rows: DataFrame, d: int, keys: np.ndarray, share: float) -> DataFrame:
    """(kind, context, other, c): kind 0 has the symbols after each context given, kind 1 the contexts that are a word longer, with their suffix.

    Of kind 1 a chunk only tells those with half of ``share`` of its symbols, so what is untold of a context is less than half of ``share``.
    """
    sent = rows.sparkSession.sparkContext.broadcast(keys)
    names = ["kind", "context", "other", "c"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, d + 1):
            new = chunk.place() >= np.repeat(chunk.lead, chunk.sizes)
            levels = list(chunk.histories(d + 1))
            context, valid = levels[d - 1]
            some = np.flatnonzero(new & valid & among(context, sent.value)[0])
            above, reaches = levels[d]
            more = some[reaches[some]]
            told = _counted(above[more], context[more])
            often = told[2] >= share / 2 * np.count_nonzero(new)
            for kind, (x, y, c) in enumerate((_counted(context[some], chunk.h[some]), tuple(x[often] for x in told))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), kind)), *map(pa.array, (x, y, c))], names=names)

    found = rows.mapInArrow(run, "kind long, context long, other long, c long")
    return found.groupBy("kind", "context", "other").agg(F.sum("c").alias("c"))


def _left_out(c: object, distinct: object, n: object, p: object, alone: object) -> object:
    """A symbol's probability at a context, with the symbol itself left out of the counts; works on columns and arrays."""
    return (c - 1 + (distinct - alone) * p) / (n - 1 + distinct - alone)


def _hot_levels(rows: DataFrame, words: DataFrame, base: Settings, most: int) -> tuple[tuple[Hot, ...], DataFrame]:
    """The hot contexts by length, tested, and (key, c): the counts of single words and of symbols after hot contexts."""
    spark = rows.sparkSession
    known = words.select(F.col("word").alias("key"), "c")
    below = words.select(F.col("word").alias("symbol"), ((F.col("c") + 1) / F.lit(float(base.tokens + base.words + 1))).alias("p"))
    candidates = words.where(F.col("c") > most).select(F.col("word").alias("context"), F.lit(None).cast("long").alias("suffix"))
    # a word is a context as often as a symbol, since each is followed by one; the mark of the start comes as often as the end
    out: list[Hot] = []
    for d in range(1, base.depth + 1):
        # at most 2 * tokens / most rows
        named = candidates.toPandas()
        keys = np.unique(named["context"].to_numpy(np.int64))
        if not len(keys):
            break
        counts = materialize(_hot_counts(rows, d, keys, most / base.tokens), f"hot{d}")
        after = counts.where("kind = 0").select("context", F.col("other").alias("symbol"), "c")
        sums = after.groupBy("context").agg(F.sum("c").alias("n"), F.count("*").alias("t")).where(F.col("n") > most)
        tested = after.join(F.broadcast(sums), "context")
        if d == 1:
            tested = tested.join(below, "symbol")
        else:
            suffixes = spark.createDataFrame(named[["context", "suffix"]], "context long, suffix long")
            tested = tested.join(F.broadcast(suffixes), "context").join(below, ["suffix", "symbol"])
        own = _left_out(F.col("c"), F.col("t"), F.col("n"), F.col("p"), (F.col("c") == 1).cast("int"))
        tested = materialize(tested.withColumn("gain", F.col("c") * F.log2(own / F.col("p"))), f"tested{d}")
        found = tested.groupBy("context").agg(F.first("n").alias("n"), F.first("t").alias("t"), (F.sum("gain") / F.first("n")).alias("bits")).toPandas().sort_values("context")
        state = found["bits"].to_numpy() >= base.divergence
        out.append(Hot(*(found[c].to_numpy(np.int64) for c in ("context", "n", "t")), state))
        known = known.union(_keyed(tested.select("context", "symbol", "c")))
        flags = F.broadcast(spark.createDataFrame(pd.DataFrame({"context": found["context"].to_numpy(np.int64), "is_state": state}), "context long, is_state boolean"))
        p = F.when(F.col("is_state"), (F.col("c") + F.col("t") * F.col("p")) / (F.col("n") + F.col("t"))).otherwise(F.col("p"))
        below = tested.join(flags, "context").select(F.col("context").alias("suffix"), "symbol", p.alias("p"))
        candidates = counts.where("kind = 1").where(F.col("c") >= most / 2).select("context", F.col("other").alias("suffix"))
    return tuple(out), known


def _keyed(after: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            context, symbol, c = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
            yield pa.RecordBatch.from_arrays([pa.array(pair(context, symbol)), pa.array(c)], names=["key", "c"])

    return after.mapInArrow(run, "key long, c long")


def _spread(spark: SparkSession, n: int) -> list[int]:
    """n numbers of which hash partitioning into n puts one into each partition."""
    place = F.pmod(F.hash("id"), F.lit(n))
    return [r[0] for r in spark.range(40 * n + 400).groupBy(place.alias("place")).agg(F.min("id").alias("id")).select("id").collect()]


DEALT = "dest long, chunk long, uids binary, ids binary, nulls binary, dictionary binary, docs binary, codes array<binary>"


def _deal(rows: DataFrame, parts: int, sent: Broadcast[Settings]) -> DataFrame:
    """All positions, as compressed columns by group and chunk; and one row per chunk that names its documents.

    Codes: 0 where a history is not that long, then the commonest words, then the row's own dictionary.
    ``docs`` holds twice the place of the document in its chunk, and one more if it is in training.
    """
    spark = rows.sparkSession
    # many small groups even out by themselves
    places = np.array(_spread(spark, parts) if parts <= 2048 else range(parts))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = sent.value
        order = np.argsort(s.common)
        common = s.common[order]
        for chunk in chunks(batches, s.depth):
            place, piece = chunk.place(), np.repeat(np.arange(len(chunk.sizes)), chunk.sizes)
            new = np.flatnonzero(place >= chunk.lead[piece])
            # where all contexts are hot, the document decides
            home = chunk.uids[piece]
            open_ = np.ones(len(home), bool)
            for d, (context, valid) in enumerate(chunk.histories(s.depth)):
                hot = among(context, s.hot[d].keys)[0] if d < len(s.hot) else np.zeros(len(home), bool)
                here = open_ & valid & ~hot
                home = np.where(here, context, home)
                open_ &= valid & hot
                if not open_.any():
                    break
            dest = (mix(home, home, 31).view(np.uint64) % np.uint64(parts)).astype(np.int64)
            words, inverse = np.unique(np.append(chunk.h, END), return_inverse=True)
            some, at = among(words, common)
            own = words[~some]
            code = np.empty(len(words), np.int32)
            code[some], code[~some] = 1 + order[at[some]], 1 + len(common) + np.arange(len(own))
            code = code[inverse]
            code, last = code[:-1], code[-1]
            table = np.zeros((s.depth + 1, len(new)), np.int32)
            table[0] = code[new]
            for d in range(1, s.depth + 1):
                table[d] = np.where(place[new] >= d, code[np.maximum(new - d, 0)], np.where(place[new] == d - 1, last, 0))
            nulls = np.array([x is None for x in chunk.ids])
            ids = np.array([x or 0 for x in chunk.ids], np.int64)
            name = chunk.uids[:1]
            docs = (2 * np.arange(len(ids)) + chunk.train)[piece[new]].astype(np.int32)
            by_group = np.argsort(dest[new], kind="stable")
            sorted_ = dest[new][by_group]
            bounds = np.flatnonzero(np.concatenate([[True], sorted_[1:] != sorted_[:-1], [True]])) if len(new) else [0]
            out = [(places[int(mix(name, name, 31).view(np.uint64)[0] % np.uint64(parts))], name[0], packed(chunk.uids, True), packed(ids), packed(nulls), b"", b"", [])]
            for i, j in zip(bounds[:-1], bounds[1:]):
                codes = table[:, by_group[i:j]]
                used, rare = np.zeros(len(own), bool), codes > len(common)
                used[codes[rare] - 1 - len(common)] = True
                codes[rare] = len(common) + np.cumsum(used)[codes[rare] - 1 - len(common)]
                out.append((places[sorted_[i]], name[0], b"", b"", b"", packed(own[used], True), packed(docs[by_group[i:j]], True), [packed(c) for c in codes]))
            columns = list(zip(*out))
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in columns[:2]), *(pa.array(c, pa.binary()) for c in columns[2:7]), pa.array(columns[7], pa.list_(pa.binary()))], names=[x.split()[0] for x in DEALT.split(", ")])

    return rows.mapInArrow(run, DEALT).repartition(parts, "dest")


def _asks(batches: Iterator[pa.RecordBatch], s: Settings) -> Iterator[pa.RecordBatch]:
    """The keys (rarer words, symbols after hot contexts) of which each group needs the counts."""
    known: dict[int, list[np.ndarray]] = {}
    first = 1 + len(s.common)
    for batch in batches:
        for dest, dictionary, codes in zip(*(batch.column(n).to_pylist() for n in ("dest", "dictionary", "codes"))):
            if not codes:
                continue
            rare, symbol = unpacked(dictionary, np.int64, True), unpacked(codes[0], np.int32)
            keys = [rare[pd.unique(symbol[symbol >= first]) - first]]
            words, live, context = np.concatenate([[0], s.common, rare]), np.arange(len(symbol)), None
            for hot, packed_codes in zip(s.hot, codes[1:]):
                past = words[unpacked(packed_codes, np.int32)[live]]
                context = past if context is None else longer(context, past)
                some = (past != 0) & among(context, hot.keys)[0]
                live, context = live[some], context[some]
                keys.append(pd.unique(pair(context, words[symbol[live]])))
            known[dest] = [pd.unique(np.concatenate([*known.get(dest, []), *keys]))]
    for dest, (keys,) in known.items():
        for at in range(0, len(keys), 1 << 16):
            part = keys[at : at + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), dest)), pa.array(part)], names=["dest", "key"])


def grow(symbol: np.ndarray, past: Callable[[int], np.ndarray], train: np.ndarray, counts: tuple[np.ndarray, np.ndarray], s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple]]:
    """The subtrees of one group and the probabilities of its positions: (known, base, p, states).

    ``past(d)`` gives the d-th last words (0 where there is none) and ``train`` marks positions that count.
    ``states`` has (length, context, n, distinct, bits) per level of the group's own contexts.
    """
    keys, cs = counts

    def found(which: np.ndarray) -> np.ndarray:
        some, at = among(which, keys)
        return np.where(some, cs[at], 0) if len(keys) else np.zeros(len(which), np.int64)

    known = found(symbol)
    base = (known + 1) / (s.tokens + s.words + 1)
    known = known > 0
    p, context, live, states = base.copy(), None, np.arange(len(symbol), dtype=np.int32), []
    for d in range(s.depth):
        word = past(d + 1)
        live = live[word[live] != 0]
        context = word if d == 0 else longer(context, word)
        del word
        hot, at = among(context[live], s.hot[d].keys) if d < len(s.hot) else (np.zeros(len(live), bool), None)
        common = live[hot]
        if len(common):
            at = at[hot]
            c, n, t = found(pair(context[common], symbol[common])), s.hot[d].n[at], s.hot[d].distinct[at]
            p[common] = np.where(s.hot[d].state[at], (c + t * p[common]) / (n + t), p[common])
        own = live[~hot]
        group, heads = pd.factorize(context[own])
        n = np.bincount(group[train[own]], minlength=len(heads))
        enough = n[group] >= s.least
        own, group = own[enough], group[enough]
        which, kinds = pd.factorize(pair(context[own], symbol[own]))
        c = np.bincount(which[train[own]], minlength=len(kinds))
        one = np.zeros(len(c), np.int64)
        one[which] = np.arange(len(own))
        of, below = group[one], p[own[one]]
        t = np.bincount(of, c > 0, len(heads))
        met = c > 0
        lone = _left_out(c[met], t[of[met]], n[of[met]], below[met], c[met] == 1)
        bits = np.bincount(of[met], c[met] * np.log2(lone / below[met]), len(heads)) / np.maximum(n, 1)
        state = (n >= s.least) & (bits >= s.divergence)
        better = np.where(state[of], (c + t[of] * below) / np.maximum(n[of] + t[of], 1), below)
        p[own] = better[which]
        states.append((np.full(int(state.sum()), d + 1), heads[state], n[state], t[state], bits[state]))
        live = np.concatenate([common, own])
    return known, base, p, states


def _slices(codes: np.ndarray, words: np.ndarray, s: Settings) -> Iterator[np.ndarray]:
    """All positions of a group, in slices of about SLICE that have no context of the group's own in common.

    Positions of equal first context that is not hot stay together; those with hot contexts only go anywhere.
    """
    n = codes.shape[1]
    parts = max(1, -(-n // SLICE))
    which = (np.arange(n) % parts).astype(np.int32)
    for at in range(0, n if parts > 1 else 0, SLICE):
        live, context = np.arange(at, min(n, at + SLICE)), None
        for d in range(s.depth):
            past = words[codes[d + 1, live]]
            some = past != 0
            live, past = live[some], past[some]
            context = past if d == 0 else longer(context[some], past)
            hot = among(context, s.hot[d].keys)[0] if d < len(s.hot) else np.zeros(len(live), bool)
            which[live[~hot]] = mix(context, context, 47)[~hot].view(np.uint64) % np.uint64(parts)
            live, context = live[hot], context[hot]
            if not len(live):
                break
    for part in range(parts):
        yield np.flatnonzero(which == part)


SUMS = ["chunk", "uids", "ids", "nulls", "docs", "n", "known", "base", "score"]
#: Log-probabilities are summed in steps of 2**-26 within a group.
STEP = 2.0**-26


def _sums(pdf: pd.DataFrame, counts: pd.DataFrame, s: Settings, states: bool) -> pd.DataFrame:
    """Per dealt row: the documents' numbers of symbols and of known ones, and the sums of both log-probabilities; or the group's states."""
    keys = np.concatenate([s.common, counts["key"].to_numpy(np.int64)])
    order = np.argsort(keys)
    answers = keys[order], np.concatenate([s.common_counts, counts["c"].to_numpy(np.int64)])[order]
    del keys, order
    docs = [unpacked(x, np.int32, True) for x in pdf["docs"]]
    stops = np.cumsum(list(map(len, docs)))
    # rarer words get codes after the common ones, row by row
    rare = [unpacked(x, np.int64, True) for x in pdf["dictionary"]]
    words, first = np.concatenate([[0], s.common, *rare]), 1 + len(s.common)
    codes = np.empty((s.depth + 1, stops[-1]), np.int32)
    for own, columns, n, stop in zip(rare, pdf["codes"], map(len, docs), stops):
        for d, column in enumerate(columns):
            part = unpacked(column, np.int32)
            codes[d, stop - n : stop] = part + np.where(part > len(s.common), np.int32(first - 1 - len(s.common)), np.int32(0))
        first += len(own)
    train = np.concatenate([d % 2 == 1 for d in docs])
    values, found = (np.empty(stops[-1], bool), np.empty(stops[-1]), np.empty(stops[-1])), []
    for some in _slices(codes, words, s):
        known, base, p, levels = grow(words[codes[0, some]], lambda d, some=some: words[codes[d, some]], train[some], answers, s)
        values[0][some], values[1][some], values[2][some] = known, np.log10(base) / STEP, np.log10(p) / STEP
        found += levels
        del known, base, p
    if states:
        return pd.DataFrame({k: np.concatenate([level[i] for level in found]) for i, k in enumerate(("length", "context", "n", "distinct_symbols", "bits"))})
    del codes, words, train
    out = []
    for chunk, uids, ids, nulls, which, stop in zip(pdf["chunk"], pdf["uids"], pdf["ids"], pdf["nulls"], docs, stops):
        if len(which):
            first = np.flatnonzero(np.concatenate([[True], which[1:] != which[:-1]]))
            sums = [np.rint(np.add.reduceat(x[stop - len(which) : stop], first, dtype=np.float64)).astype(np.int64) for x in values]
            out.append((chunk, b"", b"", b"", *map(packed, (which[first].astype(np.int64) // 2, np.diff(np.append(first, len(which))), *sums))))
        if len(uids):
            out.append((chunk, uids, ids, nulls, b"", b"", b"", b"", b""))
    return pd.DataFrame(out, columns=SUMS)


def _documents(pdf: pd.DataFrame) -> pd.DataFrame:
    """The sums of one chunk's documents over all groups; a chunk has a bounded number of symbols."""
    join = lambda name, kind, *how: np.concatenate([unpacked(x, kind, *how) for x in pdf[name]])
    uids, ids, nulls = join("uids", np.int64, True), join("ids", np.int64), join("nulls", bool)
    where = join("docs", np.int64)
    total = lambda name: np.bincount(where, join(name, np.int64), len(uids))
    doc_id = pd.array(ids, "Int64")
    doc_id[nulls] = pd.NA
    return pd.DataFrame({"uid": uids, "doc_id": doc_id, "n": total("n").astype(np.int64), "known": total("known").astype(np.int64), "base_score": total("base") * STEP, "score": total("score") * STEP})


def _grown(docs: DataFrame, train: Column, depth: int, least: int, divergence: float, most: int, group: int, common: int) -> tuple[DataFrame, DataFrame, Broadcast[Settings]]:
    """The dealt positions, the counts joined to their groups, and the settings."""
    if depth < 1 or least < 2:
        raise ValueError("contexts have at least one word and occur at least twice")
    spark = docs.sparkSession
    rows = _rows(docs, train)
    training = rows.where("train")
    words = materialize(_word_counts(training), "words")
    tokens, distinct = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    s = Settings(depth, least, divergence, int(tokens), int(distinct))
    # at most 2**20 hot contexts of each length, however large the corpus
    hot, known = _hot_levels(training, words, s, max(most, s.tokens >> 20))
    top = _commonest(words, common)
    s = replace(s, hot=hot, common=top["word"].to_numpy(np.int64), common_counts=top["c"].to_numpy(np.int64))
    del top
    # as many symbols to a document outside training as within
    all_rows, training_rows = rows.agg(F.count("*"), F.count_if("train")).first()
    size = s.tokens * all_rows // max(1, training_rows)
    # at least the session's number of partitions, so that grouping needs no second exchange
    parts = max(1, -(-size // group), int(spark.conf.get("spark.sql.shuffle.partitions")))
    sent = spark.sparkContext.broadcast(s)
    dealt = _deal(rows, parts, sent)
    asked = dealt.mapInArrow(lambda batches: _asks(batches, sent.value), "dest long, key long")
    return dealt, asked.join(known, "key").select("dest", "key", "c"), sent


def train_and_score(docs: DataFrame, folds: int = 7, fold: int = 2, depth: int = 4, least: int = 2, divergence: float = 0.01, most: int = 700_000, group: int = 1_500_000, common: int = COMMON) -> DataFrame:
    """One row per document row: (doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score); training uses all rows outside the fold.

    ``least`` and ``divergence`` decide which contexts of up to ``depth`` words are states. Contexts met more than ``most``
    times are counted apart, a group has about ``group`` positions, and the counts of ``common`` words travel as a broadcast;
    none of these changes a result. A null text counts as empty: one symbol, its end. Rows with a null doc_id belong to
    training; rows with equal or null ids are scored apart; other columns are not read; an empty table gives no rows.
    """
    dealt, answers, sent = _grown(docs, ~folded("doc_id", folds, fold), depth, least, divergence, most, group, common)
    sums = dealt.groupBy("dest").cogroup(answers.groupBy("dest")).applyInPandas(lambda a, b: _sums(a, b, sent.value, False) if len(a) else pd.DataFrame({x: [] for x in SUMS}), "chunk long, uids binary, ids binary, nulls binary, docs binary, n binary, known binary, base binary, score binary")
    parts = sums.groupBy("chunk").applyInPandas(_documents, "uid long, doc_id long, n long, known long, base_score double, score double")
    # a document cut into pieces may lie in several chunks
    rows = parts.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.sum("n").alias("n_tokens"), F.sum("known").alias("n_known"), F.sum("base_score").alias("base_score"), F.sum("score").alias("score"))
    return rows.select("doc_id", folded("doc_id", folds, fold).alias("held_out"), "n_tokens", "n_known", F.lit(sent.value.tokens).cast("long").alias("train_tokens"), "base_score", "score")


def states(docs: DataFrame, train: Column | None = None, depth: int = 4, least: int = 2, divergence: float = 0.01, most: int = 700_000, group: int = 1_500_000, common: int = COMMON) -> DataFrame:
    """The tree as a table (length, context, n, distinct_symbols, bits), one row per state that one group holds; hot contexts are not among them."""
    dealt, answers, sent = _grown(docs, F.lit(True) if train is None else train, depth, least, divergence, most, group, common)
    columns = "length long, context long, n double, distinct_symbols double, bits double"
    return dealt.groupBy("dest").cogroup(answers.groupBy("dest")).applyInPandas(lambda a, b: _sums(a, b, sent.value, True) if len(a) else pd.DataFrame({x.split()[0]: [] for x in columns.split(", ")}), columns)
