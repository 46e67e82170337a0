"""Exact top-k inner products over an impact-ordered, score-at-a-time index.

Vectors become integers floor(256 x). Per block of vectors every dimension has its postings sorted by
value and cut into segments of equal quantised value. A query visits the segments of all dimensions by
falling impact and adds each posting's exact part to an accumulator. What is still unseen is bounded by
the next segment of each dimension; a query stops only when the vectors that could still enter the top
k are proven to be a few, and these are rescored from all their components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fotonflow.llm.common import materialize


def usable(embedding: Column) -> Column:
    """Vectors that are not null, not empty and hold only finite numbers."""
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce((F.size(embedding) > 0) & finite, F.lit(False))


#: Shares of the postings after which a query is tested for its proof.
SHARES = (1 / 32, 1 / 16, 1 / 8, 1 / 4, 3 / 8, 1 / 2, 4 / 7, 9 / 14, 5 / 7, 11 / 14, 6 / 7, 13 / 14, 1.0)


class ImpactIndex:
    """Postings of one block of integer vectors (rows), in segments of ``width`` consecutive values per dimension."""

    def __init__(self, vectors: np.ndarray, width: int = 32):
        self.vectors = vectors
        self.n, self.dims = vectors.shape
        self.columns = np.ascontiguousarray(vectors.T)
        order = np.argsort(vectors, axis=0, kind="stable")
        self.rows = np.ascontiguousarray(order.T)
        self.values = np.ascontiguousarray(np.take_along_axis(vectors, order, axis=0).T)
        self.low, self.high = self.values[:, 0].copy(), self.values[:, -1].copy()
        levels = self.values // width
        edge = np.ones(levels.shape, bool)
        edge[:, 1:] = levels[:, 1:] != levels[:, :-1]
        self.dim, self.start = np.nonzero(edge)
        last = np.append(self.dim[1:] != self.dim[:-1], True)
        self.stop = np.where(last, self.n, np.append(self.start[1:], 0))
        self.least, self.most = self.values[self.dim, self.start], self.values[self.dim, self.stop - 1]

    def search(self, query: np.ndarray, k: int, barred: int = -1, enough: int = 200) -> tuple[np.ndarray, np.ndarray, int]:
        """Positions and exact scores of all vectors that may be among the k best (ties included), and the segments visited.

        A part is query * value less the least such product of the dimension, so no part is negative: the
        parts seen are a lower bound, and with the next part of each dimension not yet met an upper one.
        ``barred`` is a position that takes no part (the query itself).
        """
        ends = query * self.low, query * self.high
        floor, room = np.minimum(*ends), np.maximum(*ends) - np.minimum(*ends)
        gain = np.maximum(query[self.dim] * self.least, query[self.dim] * self.most) - floor[self.dim]
        order = np.argsort(-gain, kind="stable")
        live = np.arange(self.n)
        live = live[live != barred]
        k = min(k, len(live))
        if not k:
            return live, np.zeros(0, np.int64), 0
        seen = np.zeros(self.n, np.int64)
        sizes = np.cumsum((self.stop - self.start)[order])
        stops = np.unique(np.searchsorted(sizes, np.array(SHARES) * sizes[-1]).clip(0, len(order) - 1) + 1).tolist()
        at = 0
        for stop in stops:
            for d, i, j in zip(self.dim[order[at:stop]].tolist(), self.start[order[at:stop]].tolist(), self.stop[order[at:stop]].tolist()):
                seen[self.rows[d, i:j]] += query[d] * self.values[d, i:j] - floor[d]
            at = stop
            unseen = order[at:]
            room = np.zeros(self.dims, np.int64)
            np.maximum.at(room, self.dim[unseen], gain[unseen])
            # the k-th best of the most promising vectors, scored exactly, is a bar that no member of the top k is below
            ahead = live if len(live) <= 64 + k else live[np.argpartition(-seen[live], 63 + k)[: 64 + k]]
            exact = self.vectors[ahead] @ query
            bar = np.partition(exact, len(exact) - k)[len(exact) - k] - floor.sum()
            if np.count_nonzero(seen[live] + room.sum() >= bar) > self.n // 2:
                continue
            # a dimension's segments are visited from one end, so a vector is met where its value lies beyond the next segment
            edge = np.where(query > 0, np.iinfo(np.int64).min, np.iinfo(np.int64).max)
            up = query[self.dim[unseen]] > 0
            np.maximum.at(edge, self.dim[unseen[up]], self.most[unseen[up]])
            np.minimum.at(edge, self.dim[unseen[~up]], self.least[unseen[~up]])
            most = seen[live]
            columns = self.columns if len(live) > self.n // 2 else np.ascontiguousarray(self.vectors[live].T)
            if columns is self.columns:
                most, live = seen.copy(), np.arange(self.n)
            for d in np.flatnonzero(room).tolist():
                most += room[d] * (columns[d] <= edge[d] if query[d] > 0 else columns[d] >= edge[d])
            live = live[most >= bar]
            live = live[live != barred]
            if len(live) <= max(enough, k):
                break
        return live, self.vectors[live] @ query, at


def top_inner_products(vectors: DataFrame, every: int = 50, k: int = 5, block: int = 16384, query_block: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """For each row whose id is divisible by ``every``: its k highest integer inner products with all other rows.

    Returns (query_id, rank, vec_id, score, query_row), ranks from 1, ties to the smaller vec_id, fewer rows if there are fewer
    candidates. Rows with a null id, and vectors that are null, empty or hold null or non-finite components, take no part;
    vectors meet only those of their own length. Rows of a repeated id are rows of their own: each is a candidate for the
    other and, as a query, has its own list, told apart by ``query_row``. A component of which ``dims`` squares could pass a
    long raises an error. Blocks of vectors and of queries are dealt by hash; per pair of blocks the index is
    built once and queries stream past it. Extra columns are not read; an empty table gives no rows.
    """
    wide = F.transform(vector_col, lambda x: F.floor(x.cast("double") * 256))
    safe = F.sqrt(F.lit(float(2**63 - 1)) / F.size(vector_col)) - 1
    fits = F.forall(vector_col, lambda x: F.abs(x.cast("double") * 256) < safe)
    held = vectors.where(usable(F.col(vector_col)) & F.col(id_col).isNotNull())
    held = held.select(F.col(id_col).cast("long").alias("vec_id"), F.when(fits, wide).otherwise(F.raise_error(F.lit("a component is too large for exact inner products"))).alias("v"))
    rows = materialize(held.withColumn("uid", F.monotonically_increasing_id()).withColumn("dims", F.size("v")), "vectors")
    asked = rows.where(F.col("vec_id") % every == 0)
    n, m = rows.count(), asked.count()
    parts, asks = max(1, -(-n // block)), max(1, -(-m // query_block))
    all_of = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    place = lambda count: F.pmod(F.xxhash64("uid"), F.lit(count)).cast("int")
    index = rows.select("dims", place(parts).alias("part"), all_of(asks).alias("ask"), F.lit(0).alias("kind"), "uid", "vec_id", "v")
    queries = asked.select("dims", all_of(parts).alias("part"), place(asks).alias("ask"), F.lit(1).alias("kind"), "uid", "vec_id", "v")
    keys = ["dims", "part", "ask", "kind"]
    names = ["query_row", "query_id", "vec_row", "vec_id", "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, gathered, built = None, [], None
        for batch in batches:
            dims, part, ask, kind, uid, vec = (batch.column(i).to_numpy() for i in range(6))
            flat, ends = batch.column(6).flatten().to_numpy(), np.cumsum(dims)
            groups = np.flatnonzero(np.concatenate([[True], (np.diff(dims) != 0) | (np.diff(part) != 0) | (np.diff(ask) != 0) | (np.diff(kind) != 0), [True]])) if len(dims) else [0]
            out = [np.zeros((0, 5), np.int64)]
            for i, j in zip(groups[:-1], groups[1:]):
                v = flat[ends[i] - dims[i] : ends[j - 1]].reshape(j - i, -1)
                if now != (key := (dims[i], part[i], ask[i])):
                    now, gathered, built = key, [], None
                if not kind[i]:
                    gathered.append((uid[i:j], vec[i:j], v))
                    continue
                if gathered and built is None:
                    uids, ids, whole = map(np.concatenate, zip(*gathered))
                    built = ImpactIndex(whole)
                    by_uid = np.argsort(uids)
                for u, q, row in zip(uid[i:j].tolist(), vec[i:j].tolist(), v) if built else ():
                    own = by_uid[min(np.searchsorted(uids, u, sorter=by_uid), len(uids) - 1)]
                    at, scores, _ = built.search(row, k, int(own) if uids[own] == u else -1)
                    best = np.lexsort((uids[at], ids[at], -scores))[:k]
                    at, scores = at[best], scores[best]
                    out.append(np.stack([np.full(len(at), u), np.full(len(at), q), uids[at], ids[at], scores], axis=1))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in range(5)], names=names)

    # vectors come before the queries of their group
    dealt = index.unionByName(queries).repartition("dims", "part", "ask").sortWithinPartitions(*keys)
    found = dealt.mapInArrow(run, ", ".join(f"{x} long" for x in names))
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "vec_row")
    ranked = found.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score", "query_row")
    return ranked.where(F.col("rank") <= k)
