"""Embedding near-duplicates over robust-pruned flat graphs.

Equal vectors of a label become one node. Nodes are dealt out twice by closeness to sampled centres, each time
to every centre that is nearly as close as the closest: first into cells, each of which goes to one task, then in the task's
memory into leaves, so that only the first dealing costs copies on disk. Two nodes meet in every cell and leaf that both have joined
and count in the first of them. Cells and leaves that centres would not divide (dense clusters) stay whole; a cell too large
for a task is split by hash into parts that all meet. Each leaf builds a robust-pruned graph of its nodes that have another within twice the range, and every one of them is searched
for: from its own vertex over what is in sight, and outwards from all that is in range until nothing new is met. Links
are found by cosine in double precision, and recall is audited against brute force; where widening does not
mend it, all nodes of a label are compared block by block.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from fotonflow.llm.common import connected_components, materialize
from fotonflow.llm.topk import usable

#: Nodes that a group holds, in limits of a leaf; fewer where vectors are so long that more bytes in double precision would be held.
HELD, HELD_BYTES = 48, 40 << 20

#: Centres of a label at most, whatever its size; cells that this leaves too large are split.
MOST_CENTRES = 4096

#: Products that a task holds at a time.
SLICE = 1 << 21


def _norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


def _matrices(lists: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of the lists: positions, and the unit vectors in double precision; without those that are null, zero or not finite."""
    sizes = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False)
    for dims in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dims)
        x = lists.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
        unit, fine = _units(x)
        if fine.any():
            yield at[fine], unit[fine]


def _units(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    x = x.astype(np.float64)
    with np.errstate(all="ignore"):
        norm = np.sqrt(np.einsum("nd,nd->n", x, x))
        return x / norm[:, None], np.isfinite(x).all(axis=1) & (norm > 0)


def _joined(x: np.ndarray, centres: np.ndarray, slack: float) -> Iterator[tuple[int, np.ndarray]]:
    """Slices of rows: the first row, and which centres (columns) each joins. Any two within ``slack`` in all share one."""
    step = max(1, SLICE // len(centres))
    for at in range(0, len(x), step):
        near = x[at : at + step] @ centres.T
        yield at, near >= near.max(axis=1, keepdims=True) - slack / 2


def _centres(sample: np.ndarray, most: int, slack: float) -> np.ndarray:
    """Of the first ``most`` vectors, one for each group of close ones."""
    kept = np.zeros((0, sample.shape[1]))
    for x in sample[:most]:
        if not len(kept) or (kept @ x).max() <= 1 - 2 * slack:
            kept = np.concatenate([kept, x[None]])
    return kept


def _division(sample: np.ndarray, most: int, slack: float, cost: Callable[[np.ndarray], float]) -> np.ndarray:
    """The centres, ``most`` of the sample's or a half, a quarter ... one, whose shares of the rest of the sample cost least; one: do not divide."""
    most = min(most, len(sample) // 2)
    centres, best, least = _centres(sample, most, slack), sample[:1], cost(np.ones(1))
    rest = sample[most:]
    while len(centres) > 1:
        shares = sum(x.sum(axis=0) for _, x in _joined(rest, centres, slack)) / len(rest)
        if (now := cost(shares)) < least:
            best, least = centres, now
        centres = centres[: len(centres) // 2]
    return best


def _held(limit: int, dims: int) -> int:
    """Nodes that a group holds at most."""
    return min(HELD * limit, max(64, HELD_BYTES // (8 * dims)))


def shards(nodes: DataFrame, limit: int, slack: float, levels: int = 1) -> DataFrame:
    """(shard, cell, a, b, part, node, weight, joined, v): the cells of nodes with vectors ``u``, starting from their ``shard``.

    A shard of more nodes than a group holds is divided around sampled centres, if ``levels`` is not 0, where that takes fewer copies of a
    node than parts that all meet. A node joins all centres within half of ``slack`` of its closest, so two nodes meet unless the
    differences of their closenesses come to more than ``slack``. What is still too large is split by hash into parts of half a group, and each
    two parts (a, b) make a group. ``joined`` has the centres of a node, 32 bits each, ``v`` the bytes of ``u``. Rows of a node in a batch become one.
    """
    kind = nodes.schema["u"].dataType.elementType
    bits = np.dtype("<f4" if isinstance(kind, FloatType) else "<f8")
    nodes = nodes.select("shard", "node", "weight", F.col("u").cast("array<float>" if bits.itemsize == 4 else "array<double>").alias("u"))
    sizes = nodes.groupBy("shard").agg(F.count("*").alias("n"), F.max(F.size("u")).alias("dims"))
    held = F.least(F.lit(HELD * limit), F.greatest(F.lit(64), F.floor(F.lit(HELD_BYTES) / (8 * F.col("dims")))))
    large = {r["shard"]: (r["n"], _held(limit, r["dims"])) for r in sizes.where(F.col("n") > held).collect()}  # at most one for each group's rows
    centres = _sampled(nodes, large, slack) if levels and large else {}

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        """For each batch and length: shard, node, weight, vectors; and the row, the cell and all cells of each row's copies."""
        for batch in batches:
            shard, node, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            for at, unit in _matrices(batch.column(3)):
                ids, first, same = np.unique(node[at], return_index=True, return_inverse=True)
                total = np.bincount(same, weight[at]).astype(np.int64)
                x, at = unit[first], at[first]
                values = batch.column(3).take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(bits).reshape(len(at), -1)
                rows, cells, counts = [np.arange(len(at))], [np.zeros(len(at), np.int32)], np.ones(len(at), np.int64)
                for s in set(shard[at].tolist()) & set(centres):
                    own = np.flatnonzero(shard[at] == s)
                    rows[0], cells[0] = rows[0][shard[at[rows[0]]] != s], cells[0][: len(cells[0]) - len(own)]
                    for start, joins in _joined(x[own], centres[s], slack):
                        row, cell = np.nonzero(joins)
                        rows.append(own[start + row])
                        cells.append(cell.astype(np.int32))
                        counts[own[start : start + len(joins)]] = joins.sum(axis=1)
                row, cell = np.concatenate(rows), np.concatenate(cells)
                order = np.argsort(row, kind="stable")
                yield shard[at], ids, total, values, row[order], cell[order], counts

    parts: dict[tuple[int, int], int] = {}
    if large:

        def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for shard, _, _, _, row, cell, _ in dealt(batches):
                seen, n = np.unique(np.stack([shard[row], cell.astype(np.int64)]), axis=1, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(seen[0]), pa.array(seen[1]), pa.array(n)], ["shard", "cell", "n"])

        counted = nodes.mapInArrow(tally, "shard long, cell long, n long").groupBy("shard", "cell").agg(F.sum("n").alias("n")).where(F.col("n") > min(h for _, h in large.values()))
        parts = {(r["shard"], r["cell"]): -(-2 * r["n"] // large[r["shard"]][1]) for r in counted.collect() if r["n"] > large.get(r["shard"], (0, r["n"]))[1]}

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, node, weight, values, row, cell, counts in dealt(batches):
            ends = np.cumsum(counts)
            fan = np.array([parts.get(k, 1) for k in zip(shard[row].tolist(), cell.tolist())], np.int64) if parts else np.ones(len(row), np.int64)
            part = (node[row].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % fan
            copy = np.repeat(np.arange(len(row)), fan)
            other = np.arange(len(copy)) - np.repeat(np.cumsum(fan) - fan, fan)
            own = part[copy]
            step = max(1, min(1 << 14, SLICE // values.shape[1]))
            for at in range(0, len(copy), step):
                c = copy[at : at + step]
                r, o, w = row[c], own[at : at + step], other[at : at + step]
                many = np.where(counts[r] > 1, counts[r], 0)
                lists = np.repeat((ends - counts)[r], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                columns = [shard[r], cell[c], np.minimum(o, w).astype(np.int32), np.maximum(o, w).astype(np.int32), o.astype(np.int32), node[r], weight[r]]
                blobs = [_binary(cell[lists].tobytes(), 4 * many), _binary(values[r].tobytes(), np.full(len(r), values[0].nbytes))]
                yield pa.RecordBatch.from_arrays([*map(pa.array, columns), *blobs], ["shard", "cell", "a", "b", "part", "node", "weight", "joined", "v"])

    out = nodes.mapInArrow(place, "shard long, cell int, a int, b int, part int, node long, weight long, joined binary, v binary")
    return out.withColumn("bits", F.lit(bits.itemsize))


def _binary(data: bytes, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data)])


def _sampled(nodes: DataFrame, large: dict[int, tuple[int, int]], slack: float) -> dict[int, np.ndarray]:
    """Centres of the large shards, fitted on a sample: of a shard about four vectors for each centre and 32 more, those with the smallest hashes."""
    fan = {s: min(MOST_CENTRES, -(-4 * n // held)) for s, (n, held) in large.items()}
    rates = nodes.sparkSession.createDataFrame(pa.table({"shard": list(large), "rate": [(4 * fan[s] + 32) / n for s, (n, _) in large.items()]}))
    drawn = F.pmod(F.xxhash64("node", F.lit(1)), F.lit(1 << 40)) < F.col("rate") * F.lit(float(1 << 40))
    sample = nodes.join(F.broadcast(rates), "shard").where(drawn).groupBy("node", "shard").agg(F.first("u").alias("u"))
    found = sample.orderBy(F.xxhash64("node", F.lit(2)), "node").select("shard", "u").toArrow()
    shard, lists, out = found["shard"].to_numpy(), found["u"].combine_chunks(), {}
    for at, unit in _matrices(lists):
        for s in set(shard[at].tolist()):
            n, held = large[s]
            shipped = lambda shares, n=n, held=held: float((shares * np.where(shares * n > held, np.ceil(2 * shares * n / held), 1)).sum())
            if len(centres := _division(unit[shard[at] == s], fan[s], slack, shipped)) > 1:
                out[s] = centres
    return out


def _sight(least: float) -> float:
    """Similarity at twice the distance of ``least``."""
    return 1 - 4 * (1 - least)


def _company(x: np.ndarray, sight: float) -> np.ndarray:
    """Which of n unit vectors have another one in sight."""
    x, some = x.astype(np.float32), np.zeros(len(x), bool)
    step = max(1, SLICE // len(x))
    for at in range(0, len(x), step):
        sims = x[at : at + step] @ x.T
        sims[np.arange(len(sims)), at + np.arange(len(sims))] = -2
        some[at : at + step] = sims.max(axis=1) >= sight
    return some


def robust_prune(x: np.ndarray, degree: int = 24, far: int = 8, wide: int = 48, alpha: float = 1.2, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """Edges (from, to), both ways, between n unit vectors: from each to its nearest and some random vectors, those not much nearer to one already chosen."""
    n = len(x)
    chosen = np.full((n, degree), -1)
    chosen[:, degree - far :] = np.random.default_rng(seed).integers(0, n, (n, far))
    x, k = x.astype(np.float32), min(wide, n - 1)
    step = max(1, min(SLICE // n, SLICE // (wide * x.shape[1])))
    for at in range(0, n if k else 0, step):
        sims = x[at : at + step] @ x.T
        rows = np.arange(len(sims))
        sims[rows, at + rows] = -2
        near = np.argpartition(sims, n - k, axis=1)[:, n - k :]
        near = np.take_along_axis(near, np.argsort(-np.take_along_axis(sims, near, axis=1), axis=1), axis=1)
        gap = np.maximum(0, 2 - 2 * np.take_along_axis(sims, near, axis=1))
        y = x[near]
        alive = np.ones(near.shape, bool)
        for r in range(min(degree - far, k)):
            first = alive.argmax(axis=1)
            some = alive[rows, first]
            pick = near[rows, first]
            chosen[at + rows[some], r] = pick[some]
            between = np.maximum(0, 2 - 2 * np.matmul(y, x[pick][:, :, None])[:, :, 0])
            alive &= alpha**2 * between > gap
            alive[rows, first] = False
            if not alive.any():
                break
    a, c = np.nonzero((chosen >= 0) & (chosen != np.arange(n)[:, None]))
    b = chosen[a, c]
    return np.divmod(np.unique(np.concatenate([a * n + b, b * n + a])), n)


def range_search(x: np.ndarray, edges: tuple[np.ndarray, np.ndarray], own: np.ndarray, least: float, beam: int) -> np.ndarray:
    """Hits (queries x nodes) with similarity of at least ``least`` to the nodes ``own``, by batched search from their own vertices.

    What is met within twice the distance of ``least`` is in sight: of it, what is in range is expanded whole, and up to ``beam`` others, the closest
    of each round first. Similarities are computed for visited nodes only; a query that has an eighth of the nodes in range is compared with all.
    """
    q, n = len(own), len(x)
    starts = np.searchsorted(edges[0], np.arange(n + 1))
    sight = _sight(least)
    visited, hits = np.zeros((q, n), bool), np.zeros((q, n), bool)
    last, left = np.empty(q * n, np.int32), np.full(q, beam)
    visited[np.arange(q), own] = hits[np.arange(q), own] = True
    who, node = np.arange(q), own
    whole, step = np.zeros(q, bool), max(1, SLICE // (32 * x.shape[1]))
    while len(who):
        found = []
        for at in range(0, len(who), step):
            a, v = who[at : at + step], node[at : at + step]
            sizes = starts[v + 1] - starts[v]
            new = edges[1][np.repeat(starts[v + 1] - np.cumsum(sizes), sizes) + np.arange(sizes.sum())]
            a = np.repeat(a, sizes)
            pair = a * n + new
            pair = pair[~visited.ravel()[pair]]
            last[pair] = np.arange(len(pair))  # of a pair met twice one stays
            pair = pair[last[pair] == np.arange(len(pair))]
            visited.ravel()[pair] = True
            a, new = np.divmod(pair, n)
            s = np.einsum("pd,pd->p", x[own[a]], x[new])
            hits.ravel()[pair[s >= least]] = True
            near = s >= sight
            found.append((a[near], new[near], s[near]))
        who, node, s = (np.concatenate(v) for v in zip(*found))
        dense = np.flatnonzero((8 * hits.sum(axis=1) > n) & ~whole)
        hits[dense] = x[own[dense]] @ x.T >= least
        whole[dense] = True
        order = np.lexsort((-s, who))
        who, node, s = who[order], node[order], s[order]
        beyond = s < least
        rank = np.cumsum(beyond) - np.concatenate([[0], np.cumsum(beyond)])[np.searchsorted(who, who)]
        go = ~whole[who] & (~beyond | (rank <= left[who]))
        left -= np.bincount(who[go & beyond], minlength=q)
        who, node = who[go], node[go]
    return hits


def _lowest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Smallest position that each of n reaches over the edges (a, b)."""
    root = np.arange(n)
    while True:
        before = root.copy()
        low = np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
        if (root == before).all():
            return root


def _spanning(hits: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between positions that join what the hits (queries x nodes) of the nodes ``own`` join, at most one a query and one a node."""
    lowest = np.minimum(hits.argmax(axis=1), own)
    some = np.flatnonzero(hits.any(axis=0))
    return np.concatenate([own, some]), np.concatenate([lowest, own[hits[:, some].argmax(axis=0)]])


def _leaves(x: np.ndarray, limit: int, slack: float) -> np.ndarray:
    """Which leaves (columns) each vector joins: around sampled centres, where that saves comparisons; with more overlap than cells, as it costs no disk."""
    if len(x) <= limit:
        return np.ones((len(x), 1), bool)
    order = np.random.default_rng(len(x)).permutation(len(x))
    centres = _division(x[order], -(-2 * len(x) // limit), slack, lambda shares: float((shares**2).sum()))
    if len(centres) == 1:
        return np.ones((len(x), 1), bool)
    return np.concatenate([joins for _, joins in _joined(x, centres, slack)])


def _search(x: np.ndarray, weight: np.ndarray, least: float, beam: int | None, leaves: np.ndarray, counts: Callable[[np.ndarray, np.ndarray], np.ndarray] | None) -> tuple[np.ndarray, np.ndarray]:
    """Weight of the nodes linked to each, and the smallest position that each reaches. ``counts`` says which pairs count here."""
    n = len(x)
    found, a, b = np.zeros(n, np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for leaf in range(leaves.shape[1]):
        at = np.flatnonzero(leaves[:, leaf])
        if beam:
            at = at[_company(x[at], _sight(least) - 1e-4)]  # of the others no search would get beyond the first list
        if len(at) < 2:
            continue
        y, w = x[at], weight[at].astype(np.float64)
        before = np.packbits(leaves[at, :leaf], axis=1)
        edges = robust_prune(y, seed=len(at)) if beam else None
        step = max(1, min(512, SLICE // len(at)))
        for start in range(0, len(at), step):
            own = np.arange(start, min(start + step, len(at)))
            hits = range_search(y, edges, own, least, beam) if beam else y[own] @ y.T >= least
            hits[own - start, own] = False
            some = hits.any(axis=1)
            own, hits = own[some], hits[some]
            if not len(own):
                continue
            p, q = _spanning(hits, own)
            a.append(at[p])
            b.append(at[q])
            if leaf or counts:
                i, j = np.nonzero(hits)
                keep = ~(before[own[i]] & before[j]).any(axis=1)
                keep &= counts(at[own[i]], at[j]) if counts else True
                found[at[own]] += np.bincount(i[keep], w[j[keep]], minlength=len(own)).astype(np.int64)
            else:
                found[at[own]] += (hits @ w).astype(np.int64)
    return found, _lowest(np.concatenate(a), np.concatenate(b), n)


def _links(cut: DataFrame, least: float, beam: int | None, limit: int = 1500, slack: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Found per node: (node, found) with found the weight of the nodes linked; and edges that join what links.

    Without a beam no graph is searched: the nodes of a group are all compared.
    """

    def answer(table: pa.Table) -> pa.Table:
        column = lambda name: table[name].to_numpy()
        ids, first, same = np.unique(column("node"), return_index=True, return_inverse=True)
        weight = np.bincount(same, column("weight")).astype(np.int64)
        one = table.take(pa.array(first))
        x, _ = _units(np.frombuffer(b"".join(one["v"].to_pylist()), f"<f{one['bits'][0].as_py()}").reshape(len(ids), -1))
        part, apart = one["part"].to_numpy(), one["a"][0] != one["b"][0]
        cell, joined = one["cell"][0].as_py(), [np.frombuffer(v, "<i4") for v in one["joined"].to_pylist()]
        lists = np.concatenate(joined)
        earlier = np.unique(lists[lists < cell])
        also = np.zeros((len(ids), len(earlier)), bool)
        row, known = np.repeat(np.arange(len(ids)), [len(v) for v in joined]), lists < cell
        also[row[known], np.searchsorted(earlier, lists[known])] = True
        also = np.packbits(also, axis=1)

        def counts(i: np.ndarray, j: np.ndarray) -> np.ndarray:
            """Pairs that have met in no earlier cell, and of two parts only those between them."""
            return ~(also[i] & also[j]).any(axis=1) & ((part[i] != part[j]) | (not apart))

        leaves = _leaves(x, limit, 1.5 * slack) if beam else np.ones((len(ids), 1), bool)
        found, root = _search(x, weight, least, beam, leaves, counts if apart or len(earlier) else None)
        moved, home = root != np.arange(len(ids)), np.array([len(v) == 0 or v[0] == cell for v in joined])
        told = np.flatnonzero((found > 0) | moved | (home & (not apart)))  # of all nodes once at least
        return pa.table({"node": ids[told], "found": found[told], "root": pa.array(ids[root[told]], mask=~moved[told])})

    found = materialize(cut.groupBy("shard", "cell", "a", "b").applyInArrow(answer, "node long, found long, root long"), "found")
    return found.groupBy("node").agg(F.sum("found").alias("found")), found.where("node <> root").select(F.col("node").alias("a"), F.col("root").alias("b"))


def audit(nodes: DataFrame, found: DataFrame, least: float, sample: int = 200) -> float:
    """Links found over links that brute force finds, for a fixed number of nodes (those with the smallest hash) against all of their label."""
    drawn = [r["node"] for r in found.orderBy(F.xxhash64("node"), "node").select("node").limit(sample).collect()]
    asked = nodes.where(F.col("node").isin(drawn)).groupBy("node").agg(F.first("shard").alias("shard"), F.first("u").alias("u")).toArrow()
    keys, own = asked["node"].to_numpy(), asked["shard"].to_numpy()
    queries = list(_matrices(asked["u"].combine_chunks()))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            shard, node, weight = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            true = np.zeros(len(keys), np.int64)
            for at, x in _matrices(batch.column(3)):
                for ask, v in queries:
                    for s in np.unique(own[ask]) if v.shape[1] == x.shape[1] else ():
                        mine, there = own[ask] == s, shard[at] == s
                        hits = (v[mine] @ x[there].T >= least) & (keys[ask[mine], None] != node[at[there]])
                        true[ask[mine]] += (hits @ weight[at[there]].astype(np.float64)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys[true > 0]), pa.array(true[true > 0])], ["asked", "true"])

    true = nodes.select("shard", "node", "weight", "u").mapInArrow(compare, "asked long, true long").groupBy("asked").agg(F.sum("true").alias("true"))
    got = true.join(found, F.col("asked") == F.col("node"), "left").agg(F.sum("true"), F.sum(F.least(F.coalesce("found", F.lit(0)), "true"))).first()
    return 1.0 if not got[0] else got[1] / got[0]


def near_duplicates(vectors: DataFrame, least: float = 0.93, limit: int = 1500, slack: float = 0.1, beam: int = 24, wanted_recall: float = 0.97) -> DataFrame:
    """One row per vector row: (vec_id, n_links, component_id, kept).

    Only vectors of the same non-null label and length meet. ``n_links`` counts other rows with cosine of at least ``least``
    that the search finds, ``component_id`` is the smallest vec_id reachable. Vectors that are null, empty,
    zero or hold null or non-finite components, and rows with a null id or label, link with nothing
    and are their own component. Repeated ids are rows of their own. If the audit finds recall below
    ``wanted_recall``, overlap and beam are widened and the search repeated, twice at most; then all nodes of a label are compared.
    """
    double = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding")
    takes_part = F.coalesce(usable(F.col("embedding")) & F.col("label").isNotNull() & F.col("vec_id").isNotNull() & (_norm(double) > 0), F.lit(False))
    node = F.xxhash64("label", "embedding")
    # vectors travel once, to their cells; all else goes by the node's hash
    ids = materialize(rows.select("vec_id", F.when(takes_part, node).alias("node")), "ids")
    nodes = rows.where("vec_id IS NOT NULL AND label IS NOT NULL").where(F.size("embedding") > 0)
    nodes = nodes.select(F.xxhash64("label", F.size("embedding")).alias("shard"), node.alias("node"), F.lit(1).cast("long").alias("weight"), F.col("embedding").alias("u"))
    for _ in range(3):
        found, edges = _links(shards(nodes, limit, slack), least, beam, limit, slack)
        if audit(nodes, found, least) >= wanted_recall:
            break
        slack, beam = 2 * slack, 2 * beam
    else:
        found, edges = _links(shards(nodes, limit, slack, levels=0), least, None)
    parts = connected_components(edges).withColumnRenamed("node", "member")
    classes = ids.where("node IS NOT NULL").groupBy("node").agg(F.min("vec_id").alias("least"), F.count("*").alias("weight"))
    named = classes.join(found, "node", "left").join(parts, F.col("node") == F.col("member"), "left")
    named = materialize(named.select("node", "least", (F.coalesce("found", F.lit(0)) + F.col("weight") - 1).alias("n_links"), "component"), "named")
    members = named.where("component IS NOT NULL")
    smallest = members.groupBy("component").agg(F.min("least").alias("component_id"))
    linked = members.join(smallest, "component").select("node", "component_id")
    told = named.select("node", "least", "n_links").join(linked, "node", "left").select("node", "n_links", F.coalesce("component_id", "least").alias("component_id"))
    one = ids.where("node IS NOT NULL").join(told, "node").select("vec_id", "n_links", "component_id")
    alone = ids.where("node IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return one.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
