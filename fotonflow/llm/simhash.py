"""SimHash near-duplicates by an inverted index on byte positions with count filtering.

Two 64-bit fingerprints that differ in at most four bits share at least four of their eight bytes at
the same position. Positional bytes are indexed in groups of three, so that posting lists stay short:
the twenty groups of a Turan system are such that any four shared positions contain one of them, so no
pair with the guaranteed number of matches is missed. Within a posting list the shared positional
bytes of each pair are tallied, pairs that reach the guaranteed minimum are kept, and their bits compared.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fotonflow.llm.bpe import small_batches
from fotonflow.llm.common import connected_components, materialize

SEED = 42
#: Shingles whose bits are counted at a time.
CHUNK = 1 << 15


def turan_triples() -> list[tuple[int, int, int]]:
    """Twenty triples of the eight positions; each set of four positions contains at least one.

    Positions fall into three classes in a ring; a triple lies in one class, or has two positions in
    a class and one in the next.
    """
    kind = lambda p: p % 3
    out = []
    for t in combinations(range(8), 3):
        ks = sorted(map(kind, t))
        double = max(set(ks), key=ks.count)
        if len(set(ks)) == 1 or len(set(ks)) == 2 and (double + 1) % 3 in ks:
            out.append(t)
    return out


def fingerprint(text: str, width: int = 4) -> bytes:
    """Big-endian fingerprint of a text: the bits set in over half of the hashes of its word shingles.

    Words are runs of characters other than space and U+0009-U+000D, with A-Z in lower case. A text of
    fewer words than ``width`` has one shingle of all its words; without words the fingerprint is zero.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return bytes(8)
    line = b" ".join(words)
    stops = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate([[0], stops[:-1]])
    n = max(1, len(words) - width + 1)
    starts, stops = starts[:n].tolist(), (stops[-n:] - 1).tolist()
    ones, digest = np.zeros(64, np.int64), xxhash.xxh64_digest
    for at in range(0, n, CHUNK):
        hashes = b"".join([digest(line[i:j], SEED) for i, j in zip(starts[at : at + CHUNK], stops[at : at + CHUNK])])
        ones += np.unpackbits(np.frombuffer(hashes, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n).tobytes()


def fingerprints(docs: DataFrame, width: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp) with fp as a signed 64-bit integer; a null text counts as empty; other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in small_batches(whole, 1):
                found = b"".join([fingerprint(t or "", width) for t in batch.column(1).to_pylist()])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.frombuffer(found, ">i8").astype(np.int64))], names=["doc_id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, fp long")


def _linked(x: np.ndarray, most_bits: int) -> np.ndarray:
    """For XORs of fingerprints: enough shared positional bytes, and then few enough bits."""
    shared = (x[..., None].view(np.uint8).reshape(*x.shape, 8) == 0).sum(axis=-1, dtype=np.int8)
    good = shared >= 8 - most_bits
    good[good] = np.bitwise_count(x[good]) <= most_bits
    return good


def _forest(fps: np.ndarray, most_bits: int, step: int = 256) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join what links within one posting list: each reached fingerprint with the start of its search."""
    left, starts, found = np.arange(len(fps)), [], []
    while len(left):
        seed, left = left[0], left[1:]
        front = np.array([seed])
        while len(front) and len(left):
            hit = np.zeros(len(left), bool)
            for at in range(0, len(front), step):
                hit |= _linked(fps[front[at : at + step], None] ^ fps[None, left], most_bits).any(axis=0)
            front, left = left[hit], left[~hit]
            starts.append(np.full(len(front), seed))
            found.append(front)
    none = np.zeros(0, np.int64)
    return fps[np.concatenate([none, *starts])], fps[np.concatenate([none, *found])]


def _links(keys: np.ndarray, fps: np.ndarray, most_bits: int, short: int = 12) -> tuple[np.ndarray, np.ndarray]:
    """Edges within runs of equal keys. Short runs are compared all at once, by distance in the run; long ones by search."""
    bounds = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
    sizes = np.diff(bounds)
    run = np.repeat(np.arange(len(sizes)), sizes)
    a, b = [], []
    few = sizes[run] <= short
    f, r = fps[few], run[few]
    for d in range(1, short):
        same = np.flatnonzero(r[d:] == r[:-d])
        if not len(same):
            break
        hit = same[_linked(f[same] ^ f[same + d], most_bits)]
        a.append(f[hit])
        b.append(f[hit + d])
    for k in np.flatnonzero(sizes > short):
        x, y = _forest(fps[bounds[k] : bounds[k + 1]], most_bits)
        a.append(x)
        b.append(y)
    none = np.zeros(0, fps.dtype)
    return np.concatenate([none, *a]), np.concatenate([none, *b])


def near_links(prints: DataFrame, most_bits: int = 4, block: int = 2048) -> DataFrame:
    """Edges (a, b) between distinct fingerprints whose connected components are those of all links.

    ``prints`` has distinct fingerprints in fp. Posting lists longer than ``block`` are split by hash and each
    pair of parts meets in a run of its own, so no run exceeds twice the block and none is cut short.
    """
    if not 0 <= most_bits <= 4:
        raise ValueError("the index of three-byte groups holds for up to four bits")
    byte = lambda p: F.shiftright("fp", 8 * (7 - p)).bitwiseAND(F.lit(255))
    keys = [(byte(t[0]) * 65536 + byte(t[1]) * 256 + byte(t[2]) + (i << 24)).cast("long") for i, t in enumerate(turan_triples())]
    posts = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    long = posts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("long"), F.ceil(F.col("n") / block).cast("int").alias("parts"))
    parts = F.coalesce("parts", F.lit(1))
    posts = posts.join(long, F.col("key") == F.col("long"), "left").select("key", "fp", parts.alias("parts"), F.pmod(F.xxhash64("fp"), parts).cast("int").alias("part"))
    others = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda o: F.least(o, "part").cast("long") * 65536 + F.greatest(o, "part"))
    meets = posts.select("key", F.explode(others).alias("meet"), "fp")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_k, held_f = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def answer(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = _links(k, f, most_bits)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            key, meet, fp = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            k = np.concatenate([held_k, (key << 34) ^ meet])
            f = np.concatenate([held_f, fp.view(np.uint64)])
            other = np.flatnonzero(k != k[-1]) if len(k) else k
            whole = int(other[-1]) + 1 if len(other) else 0
            held_k, held_f = k[whole:], f[whole:]
            if whole:
                yield answer(k[:whole], f[:whole])
        if len(held_k):
            yield answer(held_k, held_f)

    return meets.repartition("key", "meet").sortWithinPartitions("key", "meet").mapInArrow(run, "a long, b long")


def classes_of(prints: DataFrame, most_bits: int) -> DataFrame:
    """(fp, component) of distinct fingerprints in fp, the component named by one of its fingerprints."""
    parts = connected_components(near_links(prints, most_bits))
    return prints.join(parts, F.col("fp") == F.col("node"), "left").select("fp", F.coalesce("component", "fp").alias("component"))


def near_duplicates(docs: DataFrame, width: int = 4, most_bits: int = 4, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document row: (doc_id, fingerprint, component_id).

    ``fingerprint`` is 16 lower-case hex digits; ``component_id`` is the smallest doc_id reachable over
    links of at most ``most_bits`` differing bits, the document included. Equal fingerprints (copies,
    repeated rows, empty texts) meet as one node. A row with a null id is answered with a null
    component unless other rows of its class have ids, and then theirs. An empty table gives no rows.
    """
    prints = materialize(fingerprints(docs, width, id_col, text_col), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    joined = classes.join(materialize(classes_of(classes.select("fp"), most_bits), "components"), "fp")
    smallest = joined.groupBy("component").agg(F.min("least").alias("component_id"))
    named = joined.join(smallest, "component").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
