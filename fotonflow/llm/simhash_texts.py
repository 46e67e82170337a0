"""Near-duplicate texts by a similarity of word shingles: a wide SimHash, its positional bytes indexed, pairs tallied, texts compared.

A similarity of 0.8 leaves about 15 % of SimHash bits different, so no group of whole bytes is shared for certain. The
fingerprint is therefore 384 bytes wide and indexed in 128 groups of three: a pair of Jaccard similarity 0.8 meets in a
posting list with probability 0.9, of 0.85 with 0.99, of 0.9 with 0.9999. Pairs that meet are kept if they share 64 of the
384 positional bytes (at 0.8 the mean is 105, nine the deviation; unrelated texts share one or two), and those are
compared by the exact Jaccard similarity of their shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fotonflow.llm.bpe import small_batches
from fotonflow.llm.common import connected_components, forget, materialize

SEED = 42
#: Groups of three positional bytes that are indexed, of which the first ``EARLY`` are searched first.
GROUPS, EARLY = 128, 16
#: Positional bytes that are tallied, how many of them a kept pair shares, and how many a pair of the trees in long lists.
TALLIED, SHARED, SURE = 384, 64, 120
#: In lists of up to ``SHORT`` nodes all pairs are told at once, in longer ones trees of sure pairs; what these leave in two components is then compared whole.
SHORT = 16
#: Features of the signed sums from which the bits are drawn.
SUMS = 512
#: Bytes that are compared at a time.
CELLS = 1 << 22
#: A posting stays if another one of its list differs in at most ``NEAR`` of the 64 bits that follow the group; in lists longer than ``LONG`` all stay.
NEAR, LONG = 26, 64
NEXT = (3 * np.arange(GROUPS)[:, None] + 3 + np.arange(8)) % (3 * GROUPS)


def shingles(text: str, width: int = 5) -> np.ndarray:
    """Sorted distinct XXH64 hashes of the shingles of ``width`` words, one of all words if they are fewer; none without words."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    n = len(words) - width + 1 if len(words) >= width else min(len(words), 1)
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(words[i : i + width]), SEED) for i in range(n)), np.uint64, n))


@lru_cache(1)
def _signs() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 2, (SUMS, GROUPS * 24)).astype(np.float32) * 2 - 1


def wide_prints(sets: list[np.ndarray]) -> np.ndarray:
    """One row of GROUPS * 3 bytes for each set of shingles; whole numbers, so the same on every machine."""
    sums = np.stack([np.bincount((s & np.uint64(SUMS - 1)).astype(np.int64), np.where(s >> np.uint64(63), 1.0, -1.0), SUMS) for s in sets])
    return np.packbits(sums.astype(np.float32) @ _signs() > 0, axis=1)


def _tally(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a == b).sum(axis=-1, dtype=np.int16)


def _best(front: np.ndarray, left: np.ndarray, prints: np.ndarray, cells: int = CELLS) -> tuple[np.ndarray, np.ndarray]:
    """For each row in ``left`` the row in ``front`` that shares most bytes, and how many."""
    most, which = np.full(len(left), -1, np.int16), np.zeros(len(left), np.int64)
    step = max(1, cells // (len(left) * TALLIED))
    for at in range(0, len(front), step):
        t = _tally(prints[front[at : at + step], None], prints[None, left])
        top = t.argmax(axis=0)
        here = t[top, np.arange(len(left))]
        more = here > most
        most[more], which[more] = here[more], front[at + top[more]]
    return which, most


def _tree(part: np.ndarray, prints: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Trees of pairs that share much, over the rows of a long posting list; rows of one ``part`` are joined already."""
    left, out = np.arange(len(prints)), []
    while len(left):
        front = left[part[left] == part[left[0]]]
        left = left[part[left] != part[left[0]]]
        while len(front) and len(left):
            parent, most = _best(front, left, prints)
            hit = most >= SURE
            out.append((parent[hit], left[hit]))
            reached = np.isin(part[left], part[left[hit]])
            front, left = left[reached], left[~reached]
    return out


def _pairs(runs: np.ndarray, part: np.ndarray, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of pairs of unlike ``part`` within runs of equal numbers: all of short runs, trees of long ones."""
    bounds = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
    sizes = np.diff(bounds)
    run = np.repeat(np.arange(len(sizes)), sizes)
    few = np.flatnonzero(sizes[run] <= SHORT)
    out = []
    for d in range(1, SHORT):
        same = np.flatnonzero(run[few[d:]] == run[few[:-d]])
        if not len(same):
            break
        x, y = few[same], few[same + d]
        hit = (part[x] != part[y]) & (_tally(prints[x], prints[y]) >= SHARED)
        out.append((x[hit], y[hit]))
    for k in np.flatnonzero(sizes > SHORT):
        lo, hi = bounds[k], bounds[k + 1]
        out += [(x + lo, y + lo) for x, y in _tree(part[lo:hi], prints[lo:hi])]
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *[x for x, _ in out]]), np.concatenate([none, *[y for _, y in out]])


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole runs of equal values in the first ``keys`` columns of sorted batches."""
    held = None
    for batch in batches:
        if not batch.num_rows:
            continue
        rows = pa.Table.from_batches([batch])
        rows = rows if held is None else pa.concat_tables([held, rows])
        same = np.ones(rows.num_rows, bool)
        for c in range(keys):
            x = rows.column(c).to_numpy()
            same &= x == x[-1]
        cut = int(np.flatnonzero(~same)[-1]) + 1 if not same.all() else 0
        held = rows.slice(cut)
        if cut:
            yield rows.slice(0, cut)
    if held is not None:
        yield held


def _bytes(column: pa.ChunkedArray, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, width)


def _prints(docs: DataFrame, width: int) -> DataFrame:
    """(doc_id, content, node, bits) of every row; node is a hash of the set of shingles, bits the wide fingerprint."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in small_batches(whole, 1):
                for at in range(0, batch.num_rows, 256):
                    part = batch.slice(at, 256)
                    sets = [shingles(t or "", width) for t in part.column(1).to_pylist()]
                    nodes = np.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], np.uint64).view(np.int64)
                    yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(nodes), pa.array([b.tobytes() for b in wide_prints(sets)], pa.binary())], names=["doc_id", "content", "node", "bits"])

    return rows.withColumn("content", F.xxhash64("text")).mapInArrow(run, "doc_id long, content long, node long, bits binary")


def _met(classes: DataFrame) -> DataFrame:
    """(key, node) of all postings that have company in their list, which is told in sorted partitions.

    Unrelated texts share three bytes by chance, the more often the more texts there are. The 64 bits after the group part
    them: at a similarity of 0.8 ten of them differ (three the deviation), of unrelated texts 32 (four).
    """

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in (whole.slice(at, 1000) for whole in batches for at in range(0, whole.num_rows, 1000)):
            prints = _bytes(pa.chunked_array([batch.column(1)]), GROUPS * 3)
            b = prints.reshape(-1, GROUPS, 3).astype(np.int32)
            keys = (np.arange(GROUPS, dtype=np.int32) << 24) | (b[..., 0] << 16) | (b[..., 1] << 8) | b[..., 2]
            nodes = np.repeat(batch.column(0).to_numpy(), GROUPS)
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(nodes), pa.array(prints[:, NEXT].reshape(-1, 8).view(np.int64).ravel())], names=["key", "node", "next"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        held, told = None, False  # the rows of the last list, of a long one that has been told only the last
        for batch in chain(batches, [None]):
            if batch is not None and not batch.num_rows:
                continue
            rows = [c.to_numpy() for c in batch.columns] if batch is not None else None
            if held is not None:
                rows = [np.concatenate(x) for x in zip(held, rows)] if rows else held
            if rows is None:
                continue
            key, node, following = rows
            bounds = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1], [True]]))
            sizes = np.diff(bounds)
            keep = _company(np.repeat(np.arange(len(sizes)), sizes), sizes, following)
            if told:  # the first list goes on
                keep[: bounds[1]] = True
                keep[0] = False
            told = len(sizes) == 1 and told or sizes[-1] > LONG
            held = [x[bounds[-2] :] for x in rows]
            if told:
                held = [x[-1:] for x in held]
            elif batch is not None:
                keep[bounds[-2] :] = False
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep])], names=["key", "node"])

    posts = classes.select("node", "bits").mapInArrow(deal, "key int, node long, next long")
    return posts.repartition("key").sortWithinPartitions("key").mapInArrow(run, "key int, node long")


def _company(run: np.ndarray, sizes: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Which rows have another one in their run that differs in few of the following bits; in long runs all."""
    keep = sizes[run] > LONG
    few = np.flatnonzero((sizes[run] > 1) & ~keep)
    for d in range(1, LONG):
        same = np.flatnonzero(run[few[d:]] == run[few[:-d]])
        if not len(same):
            break
        x, y = few[same], few[same + d]
        near = np.bitwise_count((following[x] ^ following[y]).view(np.uint64)) <= NEAR
        keep[x[near]] = True
        keep[y[near]] = True
    return keep


def _meetings(met: DataFrame, classes: DataFrame, block: int) -> DataFrame:
    """(key, meet, node, part, bits) in sorted partitions; lists longer than ``block`` are split by hash and each pair of splits meets in a run of its own."""
    long = met.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > block).select(F.col("key").alias("long"), F.ceil(F.col("n") / block).cast("int").alias("splits"))
    splits = F.coalesce("splits", F.lit(1))
    met = met.join(long, F.col("key") == F.col("long"), "left").withColumns({"splits": splits, "split": F.pmod(F.xxhash64("node"), splits).cast("int")})
    others = F.transform(F.sequence(F.lit(0), F.col("splits") - 1), lambda o: F.least(o, "split").cast("long") * 65536 + F.greatest(o, "split"))
    met = met.withColumn("meet", F.explode(others))
    return met.join(classes.select("node", "bits"), "node").select("key", "meet", "node", "part", "bits").repartition("key", "meet").sortWithinPartitions("key", "meet", "node")


def _open_lists(met: DataFrame, joined: DataFrame) -> DataFrame:
    """(key, node, part) of the lists that hold more than one part: the components so far, or the nodes of none."""
    met = met.join(joined.withColumnRenamed("node", "known"), F.col("node") == F.col("known"), "left").select("key", "node", F.coalesce("component", "node").alias("part"))
    open_ = met.groupBy("key").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("key")
    return materialize(met.join(open_, "key", "left_semi"), "open")


def _proposed(met: DataFrame, classes: DataFrame, block: int, whole: bool = False) -> DataFrame:
    """(a, b): pairs of nodes of unlike parts that meet and share enough bytes; all of them if ``whole``, trees in long lists if not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for rows in _runs(batches, 2):
            key, meet, node, part = (rows.column(c).to_numpy() for c in range(4))
            prints = _bytes(rows.column(4), TALLIED)
            number = np.concatenate([[0], np.cumsum((key[1:] != key[:-1]) | (meet[1:] != meet[:-1]))])
            for x, y in _apart(number, part, prints, key >> 24) if whole else [_pairs(number, part, prints)]:
                a, b = node[x], node[y]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

    return _meetings(met, classes, block).mapInArrow(run, "a long, b long").distinct()


def _first(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """The first group in which rows x and y surely meet, GROUPS where there is none."""
    met = (x == y).reshape(-1, GROUPS, 3).all(axis=2) & (np.bitwise_count(x ^ y)[:, NEXT].sum(axis=2) <= NEAR)
    return np.where(met.any(axis=1), met.argmax(axis=1), GROUPS)


def _apart(runs: np.ndarray, part: np.ndarray, prints: np.ndarray, group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of all pairs of unlike ``part`` that share enough bytes, within runs: the rows outside the largest part against all.

    A pair is left to the first group in which it meets, so it is not told again by every list that holds it.
    """
    bounds = np.flatnonzero(np.concatenate([[True], runs[1:] != runs[:-1], [True]]))
    for lo, hi in zip(bounds[:-1], bounds[1:]):
        mine, those = part[lo:hi], prints[lo:hi]
        names, which, sizes = np.unique(mine, return_inverse=True, return_counts=True)
        others = np.flatnonzero(which != sizes.argmax())
        step = max(1, CELLS // (len(mine) * TALLIED))
        for at in range(0, len(others), step):
            some = others[at : at + step]
            x, y = np.nonzero((_tally(those[some, None], those[None]) >= SHARED) & (mine[some, None] != mine[None]))
            first = _first(those[some[x]], those[y]) >= group[lo]
            yield lo + some[x[first]], lo + y[first]


def _sets(docs: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, hashes) for the rows of docs that stand for the nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for whole in batches:
            for batch in small_batches(whole, 1):
                found = [shingles(t or "", width).view(np.int64) for t in batch.column(1).to_pylist()]
                stops = pa.array(np.cumsum([0, *map(len, found)]), pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(stops, pa.array(np.concatenate(found)))], names=["node", "hashes"])

    text = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text"))
    met = text.join(nodes, F.col("id").eqNullSafe(F.col("first.doc_id")) & F.xxhash64("text").eqNullSafe(F.col("first.content"))).select("node", "text")
    return met.mapInArrow(run, "node long, hashes array<long>").dropDuplicates(["node"])


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of the pairs (a, b) whose sets have a Jaccard similarity of ``least`` or more; two sets are held at a time."""
    one, two = sets.select(F.col("node").alias("a"), F.col("hashes").alias("x")), sets.select(F.col("node").alias("b"), F.col("hashes").alias("y"))
    n, m, both = F.size("x"), F.size("y"), F.size(F.array_intersect("x", "y"))
    near = (F.least(n, m) >= F.lit(least) * F.greatest(n, m)) & (both >= F.lit(least) * (n + m - both))
    return pairs.select("a", "b").join(one, "a").join(two, "b").where(near).select("a", "b")


def similar_classes(docs: DataFrame, classes: DataFrame, width: int = 5, least: float = 0.8, block: int = 8192) -> DataFrame:
    """(node, component) of the nodes that are linked with others; ``classes`` has (node, bits, first).

    Two searches: the early groups, with trees in long lists, then all groups and all pairs of their lists, but for pairs
    whose ends the first has joined. So no pair that meets and shares enough bytes stays uncompared between two components.
    """
    met = materialize(_met(classes), "met")
    joined = classes.select("node", F.col("node").alias("component")).limit(0)
    seen = joined.select(F.col("node").alias("a"), F.col("component").alias("b"))
    for some, whole in ((met.where(F.col("key") < EARLY << 24), False), (met, True)):
        pairs = _proposed(_open_lists(some, joined), classes, block, whole).join(seen, ["a", "b"], "left_anti")
        pairs = materialize(pairs, "pairs")
        if pairs.isEmpty():
            continue
        ends = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
        ends = materialize(ends.join(classes.select("node", "first"), "node"), "ends")
        found = materialize(_similar(pairs, materialize(_sets(docs, ends, width), "sets"), least), "found")
        edges = joined.select(F.col("node").alias("a"), F.col("component").alias("b")).union(found)
        joined, seen = materialize(connected_components(edges), "joined"), seen.union(pairs)
    return joined


def representatives(docs: DataFrame, width: int = 5, least: float = 0.8) -> DataFrame:
    """The document rows, with all columns, of which one stays for each component: that of the smallest doc_id.

    Documents are linked by a Jaccard similarity of ``least`` or more between their sets of ``width``-word shingles
    (A-Z in lower case); null and empty texts have none and are copies of each other. Of several rows of the smallest id
    the one with the smallest hash of its text stays, once if it is repeated; rows with a null id stay only where no
    row of the component has one. An empty table gives no rows.
    """
    prints = materialize(_prints(docs, width), "fingerprints")
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "content", "bits")
    classes = prints.groupBy("node").agg(F.min(first).alias("first")).select("node", "first.bits", F.col("first").dropFields("bits").alias("first"))
    classes = materialize(classes, "classes")
    parts = materialize(similar_classes(docs, classes, width, least), "components")
    named = classes.select("node", "first").join(parts, "node", "left").select("first", F.coalesce("component", "node").alias("component"))
    stay = named.groupBy("component").agg(F.min("first").alias("first")).select(F.col("first.doc_id").alias("stay_id"), F.col("first.content").alias("stay_content"))
    rows_of = prints.groupBy("doc_id", "content").agg(F.count("*").alias("copies"))
    stay = materialize(stay.join(rows_of, F.col("doc_id").eqNullSafe(F.col("stay_id")) & (F.col("content") == F.col("stay_content"))).select("stay_id", "stay_content", "copies"), "stay")
    content = F.xxhash64(docs["text"].cast("string"))
    kept = docs.join(stay, docs["doc_id"].cast("long").eqNullSafe(F.col("stay_id")) & (content == F.col("stay_content")))
    # only rows that are repeated need to meet again
    once = kept.where("copies = 1").select(*[docs[c] for c in docs.columns])
    repeated = kept.where("copies > 1").dropDuplicates(["stay_id", "stay_content"]).select(*[docs[c] for c in docs.columns])
    return once.union(repeated)
