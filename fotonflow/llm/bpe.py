"""BPE encoding by speculation and verification, and decoding.

A word is first cut greedily into the longest known tokens. The cut is the true BPE result when
every token is the encoding of itself and no merge could have happened earlier across any of its
inner boundaries; that is tested for all boundaries of all new words at once with NumPy. Words that
fail are merged exactly. Results are kept per piece of text in a bounded cache.
"""

from __future__ import annotations

import heapq
import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotonflow.llm.common import kept

#: Fixed value: the characters of Unicode's White_Space.
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the pre-tokeniser pattern of byte-level BPE.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
#: No word of the pattern runs from a non-space into a space, so text may be cut there.
PIECES = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
CACHE = 150_000
NEVER = 1 << 40
NONE = (NEVER, -1)


def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable Latin-1 as itself, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class TwoAges:
    """A bounded cache: when the young half is full it becomes the old one, and what is used again moves back."""

    def __init__(self, size: int = CACHE) -> None:
        self.size = size
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def age(self) -> None:
        if len(self.young) > self.size:
            self.young, self.old = {}, self.young

    def missing(self, keys: list[str]) -> list[str]:
        """Keys that neither half holds; those of the old half move to the young one."""
        out = []
        for key in set(keys).difference(self.young):
            if (known := self.old.get(key)) is None:
                out.append(key)
            else:
                self.young[key] = known
        return out


class Codec:
    """Tables of one byte-level BPE vocabulary (the JSON of the tokenizers library) and a bounded cache."""

    def __init__(self, spec: str):
        model = json.loads(spec)
        letters = byte_letters()
        raw = lambda s: bytes(letters[c] for c in s)
        vocab = model["model"]["vocab"]
        self.ids = {raw(s): i for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in model["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes = [b""] * size
        for s, i in self.ids.items():
            self.bytes[i] = s
        for s, i in self.special.items():
            self.bytes[i] = s.encode()
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.left = np.full(size, -1, np.int64)
        self.right = np.full(size, -1, np.int64)
        self.made = np.full(size, -1, np.int64)
        for r, pair in enumerate(model["model"]["merges"]):
            x, y = pair if isinstance(pair, list) else pair.split(" ")
            i, j, k = vocab[x], vocab[y], vocab[x + y]
            self.rank.setdefault((i, j), (r, k))
            if self.made[k] < 0:
                self.left[k], self.right[k], self.made[k] = i, j, r
        keys = np.array([(i << 32) | j for i, j in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.key_ranks = np.array([r for r, _ in self.rank.values()], np.int64)[order]
        self.made_at = {r: k for r, k in self.rank.values()}
        self.byte_ids = [self.ids[bytes([b])] for b in range(256)]
        self.reach: dict[bytes, int] = {}
        for token in self.ids:
            self.reach[token[:3]] = max(len(token), self.reach.get(token[:3], 0))
        self.words = regex.compile(WORDS)
        self.stops = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.alone: dict[int, bool] = {}
        self.word_cache = TwoAges()
        self.cache = TwoAges()
        self.exact_words = 0

    def exact(self, word: bytes) -> list[int]:
        """Merge by lowest rank, leftmost first: by scanning short words, with a heap of candidates for long ones."""
        part: list[int] = [self.byte_ids[b] for b in word]
        rank = self.rank
        if len(part) <= 48:
            ranks = [rank.get(p, NONE)[0] for p in zip(part, part[1:])]
            while ranks and (lowest := min(ranks)) < NEVER:
                i = ranks.index(lowest)
                part[i : i + 2] = [self.made_at[lowest]]
                del ranks[i]
                if i:
                    ranks[i - 1] = rank.get((part[i - 1], part[i]), NONE)[0]
                if i < len(ranks):
                    ranks[i] = rank.get((part[i], part[i + 1]), NONE)[0]
            return part
        after = [*range(1, len(part)), -1]
        before = [*range(-1, len(part) - 1)]
        heap = [(*self.rank[p], i, p) for i, p in enumerate(zip(part, part[1:])) if p in self.rank]
        heapq.heapify(heap)
        while heap:
            _, made, i, pair = heapq.heappop(heap)
            j = after[i]
            if j < 0 or (part[i], part[j]) != pair:
                continue
            part[i], part[j], after[i] = made, -1, after[j]
            if after[i] >= 0:
                before[after[i]] = i
            for at in (before[i], i):
                if at >= 0 and after[at] >= 0 and (p := (part[at], part[after[at]])) in self.rank:
                    heapq.heappush(heap, (*self.rank[p], at, p))
        return [t for t in part if t >= 0]

    def stands_alone(self, token: int) -> bool:
        if (known := self.alone.get(token)) is None:
            known = self.alone[token] = self.exact(self.bytes[token]) == [token]
        return known

    def greedy(self, word: bytes) -> list[int]:
        ids = self.ids
        if (whole := ids.get(word)) is not None:
            return [whole]
        out, at, end, reach = [], 0, len(word), self.reach
        while at < end:
            to = min(end, at + reach.get(word[at : at + 3], 2))
            while (token := ids.get(word[at:to])) is None:
                to -= 1
            out.append(token)
            at = to
        return out

    def merge_rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a << 32) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.key_ranks[at], NEVER)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For token pairs: does the boundary between them survive merging?

        The merges on both sides of the boundary are undone, latest first. Each pair of parts that
        meets at the boundary on the way must not have a merge that ranks before the one just
        undone; of equal ranks, the left one happens first.
        """
        good = np.ones(len(a), bool)
        live = np.arange(len(a))
        a, b, limit = a.copy(), b.copy(), np.full(len(a), NEVER, np.int64)
        while len(live):
            clash = self.merge_rank(a, b) < limit
            good[live[clash]] = False
            made_a, made_b = self.made[a], self.made[b]
            go = ~clash & ((made_a >= 0) | (made_b >= 0))
            live, a, b, made_a, made_b = live[go], a[go], b[go], made_a[go], made_b[go]
            undo_a = made_a > made_b
            limit = np.where(undo_a, made_a, made_b + 1)
            a, b = np.where(undo_a, self.right[a], a), np.where(undo_a, b, self.left[b])
        return good

    def encode_words(self, words: list[str]) -> None:
        """Fill the word cache for new words: propose, test all boundaries at once, merge what fails."""
        raw = [w.encode() for w in words]
        cuts = [self.greedy(w) for w in raw]
        sizes = np.fromiter(map(len, cuts), np.int64, len(cuts))
        flat = np.fromiter(chain.from_iterable(cuts), np.int64, int(sizes.sum()))
        owner = np.repeat(np.arange(len(cuts)), sizes)
        inner = owner[1:] == owner[:-1]
        pairs, back = np.unique((flat[:-1][inner] << 32) | flat[1:][inner], return_inverse=True)
        fits = self.compatible(pairs >> 32, pairs & 0xFFFFFFFF)[back]
        tokens, back = np.unique(flat, return_inverse=True)
        alone = np.fromiter(map(self.stands_alone, tokens.tolist()), bool, len(tokens))[back]
        bad = np.union1d(owner[:-1][inner][~fits], owner[~alone]).tolist()
        for i in bad:
            cuts[i] = self.exact(raw[i])
        self.exact_words += len(bad)
        self.word_cache.young.update(zip(words, [array("I", cut).tobytes() for cut in cuts]))

    def encode_pieces(self, pieces: list[str]) -> None:
        split = [[p] if p[0] == " " and p[1:].isalpha() else self.words.findall(p) for p in pieces]
        if new := self.word_cache.missing(list(chain.from_iterable(split))):
            self.encode_words(new)
        known = self.word_cache.young
        for p, ws in zip(pieces, split):
            self.cache.young[p] = known[ws[0]] if len(ws) == 1 else b"".join([known[w] for w in ws])

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit integers; strings of special tokens become their ids."""
        self.cache.age()
        self.word_cache.age()
        split = [[part if i % 2 else PIECES.findall(part) for i, part in enumerate(self.stops.split(t) if self.stops else [t])] for t in texts]
        if new := self.cache.missing([p for parts in split for pieces in parts[::2] for p in pieces]):
            self.encode_pieces(new)
        known = self.cache.young.__getitem__
        return [b"".join([array("I", [self.special[part]]).tobytes() if i % 2 else b"".join(map(known, part)) for i, part in enumerate(parts)]) for parts in split]

    def decode(self, ids: bytes) -> str:
        table = self.bytes
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


def codec(spec: str) -> Codec:
    """One codec per worker process and vocabulary."""
    return kept(("codec", hash(spec)), lambda: Codec(spec))


def small_batches(batch: pa.RecordBatch, column: int, limit: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of about ``limit`` bytes of one column, so that long texts do not pile up."""
    start, held = 0, 0
    for i, n in enumerate(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_pylist()):
        held += n
        if held >= limit:
            yield batch.slice(start, i + 1 - start)
            start, held = i + 1, 0
    if start < batch.num_rows:
        yield batch.slice(start)


def encode(docs: DataFrame, spec: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Ids of every whole text: (id_col, ids), ids as little-endian unsigned 32-bit integers.

    ``spec`` is the JSON text of a byte-level BPE vocabulary; its size is fixed and it travels to the
    executors as a broadcast. A null or empty text gives no ids; rows with equal or null ids are each
    answered; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(shared.value)
        for whole in batches:
            for batch in small_batches(whole, 1):
                ids = work.encode([t or "" for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], names=[id_col, "ids"])

    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids binary")


def decode(encoded: DataFrame, spec: str, id_col: str = "doc_id") -> DataFrame:
    """Texts of ids as ``encode`` gives them: (id_col, ids, text). Null ids give an empty text."""
    shared = encoded.sparkSession.sparkContext.broadcast(spec)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = codec(shared.value)
        for whole in batches:
            for batch in small_batches(whole, 1):
                texts = [work.decode(x or b"") for x in batch.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[id_col, "ids", "text"])

    rows = encoded.select(id_col, "ids")
    return rows.mapInArrow(run, f"`{id_col}` {rows.schema[0].dataType.simpleString()}, ids binary, text string")


def sha256_of(column: Column) -> Column:
    return F.sha2(column.cast("binary"), 256)


def digests(docs: DataFrame, spec: str) -> DataFrame:
    """Per document: number of ids, digest of the ids, digest of the decoded text."""
    return decode(encode(docs, spec), spec).select("doc_id", (F.length("ids") / 4).cast("long").alias("n_tokens"), sha256_of(F.coalesce("ids", F.lit(b""))).alias("ids_sha256"), sha256_of(F.col("text")).alias("decoded_sha256"))
