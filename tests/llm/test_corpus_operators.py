"""SimHash, quality, suffix tree, embeddings, top-k, fixity and the pipeline against brute force on small inputs."""

import math
import random
import re
import tracemalloc
import weakref
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from compare import oracle_rows, rows_of
from conftest import SF
from pyspark.sql import functions as F

import corpus_pipeline
from fotonflow.llm import fixity, quality, registry, secret_scan, simhash, simhash_texts, suffix_tree, topk, vector_graph
from fotonflow.llm.common import connected_components, forget, kept

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def brute_fingerprint(text):
    words = WORD.findall(lowered(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(nodes, linked):
    root = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(nodes, 2):
            if root[a] != root[b] and linked(a, b):
                low, high = sorted((root[a], root[b]))
                root = {n: low if r == high else r for n, r in root.items()}
                changed = True
    return root


def test_components(spark):
    edges = [(5, 3), (3, 5), (3, 9), (9, 9), (7, 8), (None, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 25), (25, 20)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {3: 3, 5: 3, 9: 3, 7: 7, 8: 7} | {n: 20 for n in range(20, 26)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_turan_triples_miss_no_four_positions():
    triples = simhash.turan_triples()
    assert len(triples) == 20 and all(any(set(t) <= set(q) for t in triples) for q in combinations(range(8), 4))


@pytest.mark.parametrize("block", [2048, 16])
def test_links_between_fingerprints(spark, block):
    pick = random.Random(3)
    fps = {pick.getrandbits(64) for _ in range(40)}
    for centre in list(fps)[:4]:
        fps |= {centre ^ sum(1 << b for b in pick.sample(range(64), pick.randint(1, 5))) for _ in range(60)}
    fps = [f - (1 << 64) if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.component for r in connected_components(simhash.near_links(df, 4, block=block)).collect()}
    want = brute_components(fps, lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count() <= 4)
    assert {n: r for n, r in want.items() if n in got} == got and all(want[n] == n and list(want.values()).count(n) == 1 for n in fps if n not in got)


def documents(spark):
    base = ["The cat sat on the mat and looked at the %d moon for a long time %s" % (i, " ".join(f"w{i}x{j}" for j in range(60))) for i in range(6)]
    texts = [None, "", " \t ", "one two", "ONE  two", *base, base[0], base[0].upper(), base[1] + " more", base[2].replace("cat", "dog"), "word " * 20_000]
    rows = [(i, t, "en", "s", 1, "clash") for i, t in enumerate(texts)] + [(3, "one two", "en", "s", 1, "x"), (None, base[3], "en", "s", 1, "x"), (None, "alone among the null ids", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, fp string")


def test_near_duplicates_against_brute_force(spark):
    rows = documents(spark).collect()
    prints = [brute_fingerprint(r.text) for r in rows]
    root = brute_components(sorted(set(prints)), lambda a, b: (a ^ b).bit_count() <= 4)
    least = defaultdict(list)
    for r, p in zip(rows, prints):
        least[root[p]] += [r.doc_id] * (r.doc_id is not None)
    want = sorted(((r.doc_id, f"{p:016x}", min(least[root[p]], default=None)) for r, p in zip(rows, prints)), key=repr)
    got = simhash.near_duplicates(documents(spark)).collect()
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=repr) == want
    assert simhash.near_duplicates(documents(spark).limit(0)).count() == 0


def shingle_set(text):
    words = WORD.findall(lowered(text))
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def alike(a, b):
    return 10 * len(a & b) >= 8 * len(a | b)


def test_representatives_against_brute_force(spark):
    rows = documents(spark).collect()
    root = brute_components(sorted({shingle_set(r.text) for r in rows}, key=sorted), alike)
    least = defaultdict(list)
    for r in rows:
        least[root[shingle_set(r.text)]] += [r.doc_id] * (r.doc_id is not None)
    kept = simhash_texts.representatives(documents(spark))
    assert kept.columns == documents(spark).columns
    kept = kept.collect()
    assert len(kept) == len(set(root.values()))
    assert all(r.doc_id in (None, min(least[root[shingle_set(r.text)]], default=None)) for r in kept)
    assert simhash_texts.representatives(documents(spark).limit(0)).count() == 0


@pytest.mark.parametrize("block", [8192, 50])
def test_large_groups_of_near_copies(spark, block):
    """Groups of 150 near copies, whose edits leave 0.8 and more to their source, beside unrelated texts of common phrases."""
    pick = random.Random(5)
    phrase = ["it was the best of times", "all happy families are alike", "call me by my name"]
    texts = []
    for g in range(3):
        source = [f"g{g}w{pick.randrange(400)}" for _ in range(150)]
        for _ in range(150):
            copy = list(source)
            for _ in range(pick.randrange(4)):
                copy[pick.randrange(150)] = f"edit{pick.randrange(10**6)}"
            texts.append(" ".join(copy))
    texts += [" ".join(pick.choice(phrase) + f" x{pick.randrange(50)}" for _ in range(20)) for _ in range(100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    first = {}
    for i, t in enumerate(texts):
        first.setdefault(shingle_set(t), i)
    sets = {i: s for s, i in first.items()}
    root = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    prints = simhash_texts._prints(docs, 5)
    classes = prints.groupBy("node").agg(F.min(F.struct("doc_id", "content")).alias("first"), F.min("bits").alias("bits"))
    names = {r.node: r.first.doc_id for r in classes.collect()}
    got = defaultdict(set)
    for r in simhash_texts.similar_classes(docs, classes, block=block).collect():
        got[r.component].add(names[r.node])
    want = defaultdict(set)
    for i, r in root.items():
        want[r].add(i)
    # nothing is joined that should not be; a pair at 0.8 is met with probability 0.9
    assert all(any(g <= w for w in want.values()) for g in got.values())
    large = [w for w in want.values() if len(w) > 1]
    assert sum(max((len(g & w) for g in got.values()), default=0) for w in large) >= 0.95 * sum(map(len, large))


def test_pairs_of_long_texts_are_compared_two_sets_at_a_time(spark):
    """Pairs do not travel in batches of both their sets, whose size would grow with the texts; the bound itself is a link."""
    whole = list(range(1, 20_001))
    cut = {1: whole, 2: whole[:16_000], 3: whole[:15_999], 4: [*whole[:18_000], *range(-2000, 0)], 5: [7], 6: [8]}
    sets = spark.createDataFrame(list(cut.items()), "node long, hashes array<long>")
    ids = list(cut)
    pairs = spark.createDataFrame([(a, b) for a in ids for b in ids if a < b], "a long, b long")
    found = simhash_texts._similar(pairs, sets, 0.8)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" not in plan and "Python" not in plan
    got = {tuple(r) for r in found.collect()}
    assert got == {(a, b) for a in ids for b in ids if a < b and 10 * len(set(cut[a]) & set(cut[b])) >= 8 * len(set(cut[a]) | set(cut[b]))}
    assert (1, 2) in got and (1, 3) not in got


def test_pairs_between_parts_are_all_told():
    """Whatever the parts, no pair of rows of two parts that shares enough bytes is left out, and none within a part is told."""
    draw = np.random.default_rng(3)
    prints = np.repeat(draw.integers(0, 256, (1, simhash_texts.TALLIED)), 60, 0).astype(np.uint8)
    for i, row in enumerate(prints):
        row[draw.choice(simhash_texts.TALLIED, 70 + i // 2, replace=False)] = draw.integers(0, 256, 70 + i // 2)
    for parts in ([7] * 60, list(range(60)), draw.integers(0, 4, 60), [1] * 59 + [2]):
        part = np.array(parts)
        got = {tuple(sorted(p)) for x, y in simhash_texts._apart(np.zeros(60, int), part, prints) for p in zip(x.tolist(), y.tolist())}
        want = {(i, j) for i, j in combinations(range(60), 2) if part[i] != part[j] and (prints[i] == prints[j]).sum() >= simhash_texts.SHARED}
        assert got == want


@pytest.fixture(scope="module")
def model(spark):
    return quality.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet"))


def test_quality_on_held_out_rows(spark, model):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    got = quality.score(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), model).join(labels, "doc_id").where("held_out").collect()
    up, down = [r.score for r in got if r.quality == 1], [r.score for r in got if r.quality == 0]
    assert sum(a > b for a in up for b in down) > 0.95 * len(up) * len(down)
    assert sum(r.predicted == r.quality for r in got) > 0.93 * len(got)


def test_quality_edge_rows(spark, model):
    got = quality.score(documents(spark), model).collect()
    assert len(got) == documents(spark).count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    kept = quality.keep(documents(spark), model)
    assert kept.columns == documents(spark).columns and kept.count() == sum(r.predicted for r in got)
    assert quality.keep(documents(spark).limit(0), model).count() == 0


def test_quality_without_two_classes(spark):
    docs = documents(spark)
    for labels, want in (([], 0.5), ([(1, 1), (2, None), (None, 0)], 1.0), ([(2, 0), (3, 0)], 0.0)):
        got = quality.score(docs, quality.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int"))).collect()
        assert {round(r.score, 6) for r in got} == {want}


def test_features_do_not_depend_on_blocks(monkeypatch):
    text = " ".join(random.Random(2).choices(["a", "B", "Cc", "12", "!!", "x.", "x."], k=5000))
    whole = quality.features(text).tolist()
    monkeypatch.setattr(quality, "BLOCK", 97)
    assert quality.features(text).tolist() == whole


def test_dual_coordinate_descent_solves_the_hinge_problem():
    pick = np.random.default_rng(0)
    rows = [np.sort(pick.choice(20, 5, replace=False)) for _ in range(60)]
    truth = pick.normal(size=20)
    y = np.array([1.0 if truth[r].sum() > 0 else -1.0 for r in rows])
    w = quality.dual_coordinate_descent(rows, [np.ones(5)] * 60, y, np.full(60, 1.0), 20, rounds=400)
    loss = lambda w: w @ w / 2 + sum(max(0, 1 - t * w[r].sum()) for r, t in zip(rows, y))
    assert all(loss(w) <= loss(w + d) + 1e-3 for d in pick.normal(size=(200, 20)) * 0.05)


def brute_tree(rows, held, depth, least, divergence):
    """Scores of a plain suffix tree: tuples of words, one context length after the other."""
    symbols = [[*WORD.findall(lowered(text)), None] for _, text in rows]
    pairs = defaultdict(Counter)
    base = Counter()
    for (i, _), ts in zip(rows, symbols):
        if not held(i):
            base.update(ts)
            for at, t in enumerate(ts):
                for d in range(1, min(depth, at + 1) + 1):
                    pairs[tuple(["^", *ts[:at]][-d:])][t] += 1
    n, v = sum(base.values()), len(base)

    def chance(context, t, states):
        p = (base[t] + 1) / (n + v + 1)
        for d in range(1, len(context) + 1):
            if (c := context[-d:]) in states:
                after = pairs[c]
                p = (after[t] + len(after) * p) / (sum(after.values()) + len(after))
        return p

    states = set()
    for d in range(1, depth + 1):
        new = set()
        for context, after in pairs.items():
            if len(context) == d and (m := sum(after.values())) >= least:
                bits = 0
                for t, c in after.items():
                    p, kinds = chance(context, t, states), len(after) - (c == 1)
                    bits += c * math.log2((c - 1 + kinds * p) / (m - 1 + kinds) / p)
                if bits / m >= divergence:
                    new.add(context)
        states |= new
    scores = [sum(math.log10(chance(tuple(["^", *ts[:at]][-depth:]), t, states)) for at, t in enumerate(ts)) for ts in symbols]
    return base, symbols, states, scores


@pytest.mark.parametrize("least, most, group, common", [(2, 400_000, 1_000_000, 1 << 20), (2, 12, 500, 30), (5, 40, 2000, 0)])
def test_suffix_tree_against_a_plain_one(spark, least, most, group, common):
    """All depths, with and without hot contexts of every length."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", F.substring("text", 1, 900).alias("text"), F.lit("x").alias("uid"))
    odd = [(10_000, None), (10_001, ""), (None, "the of and"), (3, "repeated id"), (10_002, "a b " * 2000), *[(20_000 + i, "one line that many documents share word for word " * 2 + str(i)) for i in range(60)], (30_000, "one line that many")]
    docs = docs.union(spark.createDataFrame([(*r, "y") for r in odd], docs.schema)).coalesce(2)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 7 == 2
    c, symbols, states, scores = brute_tree(rows, held, 4, least, 0.01)
    n, v = sum(c.values()), len(c)
    want = sorted(((i, held(i), len(ts), sum(c[t] > 0 for t in ts), n, round(sum(math.log10((c[t] + 1) / (n + v + 1)) for t in ts), 5), round(x, 5)) for (i, _), ts, x in zip(rows, symbols, scores)), key=repr)
    got = suffix_tree.train_and_score(docs, least=least, most=most, group=group, common=common).collect()
    assert [r[:6] for r in sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5), r.score) for r in got), key=repr)] == [r[:6] for r in want]
    assert sorted(r.score for r in got) == pytest.approx(sorted(r[6] for r in want), abs=1e-4)
    assert {len(x) for x in states} == {1, 2, 3, 4}
    if most > 10_000:
        table = suffix_tree.states(docs, ~suffix_tree.folded("doc_id", 7, 2), least=least).groupBy("length").count().collect()
        assert dict(map(tuple, table)) == Counter(map(len, states))
    assert suffix_tree.train_and_score(docs.limit(0)).count() == 0


def test_a_group_is_grown_in_slices(monkeypatch):
    """The subtrees of a group do not lie in memory together; sums and states are those of the whole group."""
    pick = np.random.default_rng(8)
    n, words = 6000, np.sort(pick.integers(1, 1 << 48, 40))
    codes = (1 + 40 * pick.random((4, n)) ** 3).astype(np.int32)
    for d in (2, 3):  # some histories are short
        codes[d:, pick.choice(n, 200, replace=False)] = 0
    codes[3, codes[2] == 0] = 0
    top = np.sort(words[:2])
    hot = suffix_tree.Hot(top, np.array([3000, 900]), np.array([40, 40]), np.array([True, False]))
    s = suffix_tree.Settings(3, 2, 0.01, n, 40, (hot,), words, np.arange(40, 0, -1))
    rows = []
    for i, (lo, hi) in enumerate([(0, 1000), (1000, 1001), (1001, n)]):
        docs = np.sort(pick.integers(0, 60, hi - lo)).astype(np.int32)
        rows.append((i, b"", b"", b"", b"", suffix_tree.packed(docs, True), [suffix_tree.packed(c[lo:hi]) for c in codes]))
    pdf = pd.DataFrame(rows, columns=["chunk", "uids", "ids", "nulls", "dictionary", "docs", "codes"])
    keys = np.unique(suffix_tree.pair(np.repeat(top, 40), np.tile(words, 2)))
    counts = pd.DataFrame({"key": keys, "c": pick.integers(1, 30, len(keys))})
    seen, grow = [], suffix_tree.grow
    monkeypatch.setattr(suffix_tree, "grow", lambda symbol, *rest: seen.append(len(symbol)) or grow(symbol, *rest))
    whole = [suffix_tree._sums(pdf, counts, s, states) for states in (False, True)]
    assert seen == [n, n]
    seen.clear()
    monkeypatch.setattr(suffix_tree, "SLICE", 500)
    sliced = [suffix_tree._sums(pdf, counts, s, states) for states in (False, True)]
    assert len(seen) == 24 and sum(seen) == 2 * n and max(seen) < n / 2
    order = ["length", "context"]
    assert whole[0].equals(sliced[0]) and len(whole[1]) > 50
    assert whole[1].sort_values(order, ignore_index=True).equals(sliced[1].sort_values(order, ignore_index=True))


def test_equal_words_and_no_others_have_equal_hashes():
    pick = random.Random(9)
    words = [bytes(pick.choices(range(256), k=pick.randint(1, 12))) for _ in range(20_000)] + [b"a" * n for n in range(1, 400)] + [b"\0", b"\0\0", "\u00c9cole".encode()]
    data = b" \n".join(words)
    split = data.lower().split()
    names = {}
    assert len(split) == len(suffix_tree.word_hashes(data)) and all(names.setdefault(w, h) == h for w, h in zip(split, suffix_tree.word_hashes(data).tolist()))
    assert len(set(names.values())) == len(names) and len(suffix_tree.word_hashes(b"")) == len(suffix_tree.word_hashes(b" \t")) == 0


def test_symbols_do_not_depend_on_pieces(monkeypatch):
    text = " ".join(random.Random(2).choices(["a", "B", "Cc", "12", "x" * 300], k=500))
    ((_, whole),) = suffix_tree.symbols(text, 4)
    monkeypatch.setattr(suffix_tree, "BLOCK", 97)
    pieces = list(suffix_tree.symbols(text, 4))
    assert len(pieces) > 50 and np.concatenate([h[lead:] for lead, h in pieces]).tolist() == whole.tolist()
    at = 0
    for lead, h in pieces:
        assert lead == min(4, at) and h.tolist() == whole[at - lead : at - lead + len(h)].tolist()
        at += len(h) - lead


def test_suffix_tree_learns_and_sums_to_one():
    """After each state, probabilities over all known symbols and one unknown sum to one."""
    pick = np.random.default_rng(4)
    symbol, n = np.tile([5, 6, 5, 7], 100) + (pick.random(400) < 0.1), 400
    past = np.stack([np.r_[np.zeros(d, np.int64), symbol[:-d]] for d in (1, 2)])
    kinds = np.append(np.unique(symbol), 99)
    counts = kinds[:-1], np.array([(symbol == k).sum() for k in kinds[:-1]])
    s = suffix_tree.Settings(2, 2, 0.01, n, len(kinds) - 1)
    # one more position per state and symbol, which does not count
    heads = past[:, 10:200:7]
    asked = np.repeat(heads, len(kinds), axis=1), np.tile(kinds, heads.shape[1])
    whole = np.concatenate([past, asked[0]], axis=1)
    known, base, p, states = suffix_tree.grow(np.append(symbol, asked[1]), lambda d: whole[d - 1], np.arange(n + len(asked[1])) < n, counts, s)
    assert p[n:].reshape(-1, len(kinds)).sum(axis=1) == pytest.approx(1) and base[n:].reshape(-1, len(kinds)).sum(axis=1) == pytest.approx(1)
    assert all(len(x[0]) for x in states) and np.log2(p[:n] / base[:n]).mean() > 0.5


def vectors(spark, n=700, dims=16, seed=1):
    pick = np.random.default_rng(seed)
    v = pick.normal(size=(n, dims))
    v[300:420] = v[0] + pick.normal(size=(120, dims)) * 0.12
    v[420:520] = v[1]
    rows = [(i, v[i].tolist(), None if i % 97 == 5 else i % 2) for i in range(n)]
    odd = [(n, None, 0), (n + 1, [], 0), (n + 2, [0.0] * dims, 1), (n + 3, [float("nan")] * dims, 1), (n + 4, [None] * dims, 0), (n + 5, [1.0, 2.0], 1), (None, v[0].tolist(), 0), (7, v[7].tolist(), 1), (8, v[9].tolist(), 1), (50, v[50].tolist(), 0)]
    rows = [(*r, "clash", 1) for r in [*rows, *odd]]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, node string, u int")


@pytest.mark.parametrize("limit", [1500, 60])
def test_vector_graph_against_brute_force(spark, limit):
    rows = vectors(spark).collect()
    fine = [r for r in rows if r.vec_id is not None and r.label is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding) and any(r.embedding)]
    unit = [np.array(r.embedding) / np.linalg.norm(r.embedding) for r in fine]
    linked = lambda i, j: fine[i].label == fine[j].label and len(unit[i]) == len(unit[j]) and float(unit[i] @ unit[j]) >= 0.93
    root = brute_components(range(len(fine)), linked)
    least = {}
    for i, r in root.items():
        least[r] = min(least.get(r, fine[i].vec_id), fine[i].vec_id)
    links = [sum(linked(i, j) for j in range(len(fine)) if i != j) for i in range(len(fine))]
    want = Counter((fine[i].vec_id, links[i], least[root[i]], fine[i].vec_id == least[root[i]]) for i in range(len(fine)))
    want += Counter((r.vec_id, 0, r.vec_id, r.vec_id is not None) for r in rows if r not in fine)
    got = Counter(tuple(r) for r in vector_graph.near_duplicates(vectors(spark), limit=limit).select("vec_id", "n_links", "component_id", "kept").collect())
    assert sum((got & want).values()) >= 0.99 * len(rows)
    assert vector_graph.near_duplicates(vectors(spark).limit(0)).count() == 0


def test_vector_graph_passes_over_batches_without_a_usable_vector(spark):
    odd = [[0.0, 1.0], [-0.0, 1.0], [0.0, 0.0], [float("nan"), 1.0], [float("inf"), 1.0], [None, 1.0], None, [], [1.0], [2.0], [-1.0]]
    table = spark.createDataFrame([(i, v, 1) for i, v in enumerate(odd)], "vec_id long, embedding array<float>, label int")
    for df in (table.repartition(11, "vec_id"), table.coalesce(1)):
        got = {r.vec_id: (r.n_links, r.component_id) for r in vector_graph.near_duplicates(df).collect()}
        assert got == {i: (0, i) for i in range(11)} | {0: (1, 0), 1: (1, 0), 8: (1, 8), 9: (1, 8)}
    assert {r.n_links for r in vector_graph.near_duplicates(table.where("vec_id BETWEEN 2 AND 7")).collect()} == {0}


def dense_cluster(spark, n, dims=64, noise=0.02, seed=3):
    """n distinct vectors around one direction, mean cosine about 0.97, and as many around none; and the links of each."""
    pick = np.random.default_rng(seed)
    v = pick.normal(size=(2 * n, dims))
    v[:n] = v[0] / np.linalg.norm(v[0]) + pick.normal(size=(n, dims)) * noise
    u = v / np.linalg.norm(v, axis=1)[:, None]
    links = np.concatenate([(u[at : at + 1000] @ u.T >= 0.93).sum(axis=1) - 1 for at in range(0, 2 * n, 1000)])
    table = pa.table({"vec_id": pa.array(range(2 * n)), "label": pa.array([1] * (2 * n)), "embedding": pa.array(list(v))})
    return spark.createDataFrame(table).repartition(8), links


def test_vector_graph_finds_all_links_of_a_dense_cluster(spark):
    """As 12,000 vectors at the limit of 1,500: eight times the limit, around sixteen centres."""
    n = 800
    df, links = dense_cluster(spark, n)
    got = {r.vec_id: r for r in vector_graph.near_duplicates(df, limit=100).collect()}
    assert sum(links[:n]) > 0.9 * n**2
    assert sum(got[i].n_links for i in got) >= 0.999 * sum(links) and all(got[i].n_links <= k for i, k in enumerate(links))
    assert {got[i].component_id for i in range(n)} == {0}


def test_vector_graph_block_path_is_exact(spark):
    """More than one wave of parts, compared without a graph."""
    df, links = dense_cluster(spark, 60, noise=0.03)
    unit = np.array([r.embedding for r in df.orderBy("vec_id").collect()])
    rows = [(1, i, 1, x.tolist()) for i, x in enumerate(unit / np.linalg.norm(unit, axis=1)[:, None])]
    nodes = spark.createDataFrame(rows, "shard long, node long, weight long, u array<double>")
    found, _ = vector_graph._links(vector_graph.shards(nodes, 12, 0.1, levels=0), 0.93, None)
    got = {r.node: r.found for r in found.collect()}
    assert [got[i] for i in range(120)] == links.tolist()


def test_vector_graph_ships_a_node_a_few_times_whatever_the_size(spark):
    """Copies on disk do not multiply with the divisions that more nodes of a label take."""
    pick, rows = np.random.default_rng(6), {}
    for n in (1000, 4000):
        table = pa.table({"shard": [1] * n, "node": range(n), "weight": [1] * n, "u": list(pick.normal(size=(n, 64)).astype(np.float32))})
        nodes = spark.createDataFrame(table).selectExpr("shard", "node", "weight", "transform(u, x -> x / sqrt(aggregate(u, 0D, (s, y) -> s + y * y))) AS u")
        rows[n] = vector_graph.shards(nodes, 5, 0.1).count() / n
    assert rows[1000] <= 2.5 and rows[4000] <= 3 and rows[4000] <= 2 * rows[1000]


@pytest.mark.parametrize("held, limit", [(1, 60), (1, 100), (2, 40), (12, 100)])
def test_vector_graph_counts_a_pair_once_in_cells_leaves_and_parts(spark, monkeypatch, held, limit):
    """Pairs that share several cells or leaves, parts of a dense cluster, copies in several batches, two lengths, more than the first label."""
    monkeypatch.setattr(vector_graph, "HELD", held)
    pick = np.random.default_rng(8)
    v = pick.normal(size=(900, 24))
    v[:200] = v[0] + pick.normal(size=(200, 24)) * 0.1
    for i in range(200, 800, 3):
        v[i + 1 : i + 3] = v[i] + pick.normal(size=(2, 24)) * 0.15
    v[850:] = v[200:250]
    short = pick.normal(size=(100, 5))
    label = np.where(np.arange(1000) % 9 == 8, 2, 1)
    table = pa.table({"vec_id": range(1000), "label": label, "embedding": [x.astype(np.float32) for x in [*v, *short]]})
    want = np.zeros(1000, int), np.arange(1000)
    for x, at in ((v, np.arange(900)), (short, np.arange(900, 1000))):
        x = x.astype(np.float32).astype(float)
        u = x / np.linalg.norm(x, axis=1)[:, None]
        linked = (u @ u.T >= 0.93) & (label[at][:, None] == label[at])
        want[0][at] = linked.sum(axis=1) - 1
        root = brute_components(range(len(at)), lambda a, b, linked=linked: linked[a, b])
        want[1][at] = at[[root[i] for i in range(len(at))]]
    got = {r.vec_id: r for r in vector_graph.near_duplicates(spark.createDataFrame(table).repartition(7), limit=limit, wanted_recall=0.0).collect()}
    assert all(got[i].n_links <= want[0][i] for i in got)
    assert sum(got[i].n_links for i in got) >= 0.999 * want[0].sum()
    assert sum((got[i].n_links, got[i].component_id) == (want[0][i], want[1][i]) for i in range(1000)) >= 995


@pytest.mark.parametrize("block, query_block", [(16384, 16384), (90, 5)])
def test_top_k_is_exact(spark, block, query_block):
    """All lists, scores and ties, id 50 with its two rows included."""
    rows = vectors(spark).collect()
    fine = [r for r in rows if r.vec_id is not None and r.embedding and all(x is not None and math.isfinite(x) for x in r.embedding)]
    ints = [[math.floor(256 * x) for x in r.embedding] for r in fine]
    want = Counter()
    for i, q in enumerate(fine):
        if q.vec_id % 50 == 0:
            scores = sorted((-sum(a * b for a, b in zip(ints[i], ints[j])), c.vec_id) for j, c in enumerate(fine) if j != i and len(ints[j]) == len(ints[i]))
            want[(q.vec_id, tuple((v, -s) for s, v in scores[:5]))] += 1
    lists = defaultdict(list)
    for r in topk.top_inner_products(vectors(spark), block=block, query_block=query_block).collect():
        lists[(r.query_row, r.query_id)].append((r["rank"], r.vec_id, r.score))
    assert all([x[0] for x in sorted(v)] == [1, 2, 3, 4, 5] for v in lists.values())
    assert Counter((q, tuple(x[1:] for x in sorted(v))) for (_, q), v in lists.items()) == want
    assert topk.top_inner_products(vectors(spark).limit(0)).count() == 0


def test_top_k_of_repeated_query_ids(spark):
    rows = [(50, [1.0, 0.0]), (50, [0.0, 1.0]), (1, [1.0, 1.0]), (2, [2.0, 1.0]), (3, [0.5, 3.0]), (100, [4.0])]
    lists = defaultdict(list)
    for r in topk.top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), k=2).collect():
        lists[r.query_row].append((r.query_id, r["rank"], r.vec_id, r.score))
    assert sorted(sorted(v) for v in lists.values()) == [[(50, 1, 2, 2 << 16), (50, 2, 1, 1 << 16)], [(50, 1, 3, 3 << 16), (50, 2, 1, 1 << 16)]]
    with pytest.raises(Exception, match="too large"):
        topk.top_inner_products(spark.createDataFrame([(50, [1e17, 0.0]), (1, [1.0, 1.0])], "vec_id long, embedding array<double>")).collect()


def test_impact_index_against_products():
    pick = np.random.default_rng(2)
    v = pick.integers(-140, 120, (3000, 24))
    v[100:150] = v[0]
    index = topk.ImpactIndex(v)
    for q in range(0, 200, 7):
        at, scores, visits = index.search(v[q], 5, q)
        full = sorted((-int(s), i) for i, s in enumerate(v @ v[q]) if i != q)[:5]
        assert sorted(zip((-scores).tolist(), at.tolist()))[:5] == full


def test_fixity_locates_damage(spark):
    rows = [(i, f"http://x/{i}", "" if i == 4 else None if i == 5 else "p" * (i * 37 % 900)) for i in range(300)] + [(7, "http://x/7", "p" * (7 * 37 % 900)), (None, None, "no id")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    text = fixity.record(F.col("page_id"), F.col("url"), F.col("html"))
    placed = fixity.layout(pages.select("page_id", "url", F.octet_length(text).cast("long").alias("length"), fixity.digest(text).alias("sha256")), volume_bytes=20_000).cache()
    assert placed.count() == 301
    ours = placed.select("volume", "start", "sha256")
    theirs = placed.where("page_id IS NULL OR page_id <> 11").select("volume", "start", F.when(F.col("page_id") == 20, F.lit("bad")).otherwise(F.col("sha256")).alias("sha256"))
    theirs = theirs.union(spark.createDataFrame([(0, 10**6, "new")], "volume long, start long, sha256 string"))
    shape = {"range_bytes": 1 << 11, "fan": 4, "levels": 3}
    got = fixity.audit(ours, theirs, **shape).join(placed, ["volume", "start"], "left").collect()
    assert sorted((str(r.page_id), r.kind) for r in got) == [("11", "missing"), ("20", "changed"), ("None", "extra")]
    assert fixity.audit(ours, ours, **shape).count() == 0 and fixity.audit(ours.limit(0), ours.limit(0), **shape).count() == 0


def test_fixity_query_equals_oracle(spark):
    assert rows_of(registry.QUERIES["op1_merkle_fixity"](spark, SF)) == oracle_rows(registry.ORACLES["op1_merkle_fixity"], SF)


def test_pipeline_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = quality.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = [r for r in docs.collect() if model.score(r.text) >= 0.3]
    sets = {r.doc_id: shingle_set(r.text) for r in rows}
    root = brute_components(sorted(sets), lambda a, b: alike(sets[a], sets[b]))
    stay = {i for i, r in root.items() if i == r}
    forest = secret_scan.default_forest(spark)
    secrets = {(r.doc_id, r.candidate) for r in secret_scan.scan(docs, forest).where("is_secret").collect()}
    expect = {}
    for r in rows:
        if r.doc_id in stay:
            text = r.text
            for s in {s for i, s in secrets if i == r.doc_id}:
                text = text.replace(s, "[SECRET]")
            expect[r.doc_id] = text
    work = corpus_pipeline.packing.PieceTokenizer(registry.vocabulary("word_bpe_49k.json"))
    sizes = {i: len(work.ids([t])[0]) // 4 + 1 for i, t in expect.items()}
    got = corpus_pipeline.run(spark, SF).collect()
    found = defaultdict(int)
    for r in got:
        found[r.doc_id] += r.length
    assert dict(found) == sizes
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_filter", "near_duplicate_removal", "secret_redaction", "pack_sequences"]


def test_stages_take_odd_and_empty_documents(spark):
    docs = documents(spark)
    for name, stage in corpus_pipeline.STAGES:
        if name != "quality_filter":
            assert stage(spark, docs.limit(0), SF).count() == 0
            assert stage(spark, docs, SF).count() > 0
    assert corpus_pipeline.STAGES[0][1](spark, docs, SF).columns == docs.columns


def test_a_worker_keeps_one_operators_caches():
    held = weakref.ref(corpus_pipeline.packing.tokenizer(registry.vocabulary("word_bpe_49k.json")))
    quality.features("two words")
    assert held() is None
    codes = weakref.ref(kept("word codes", quality.WordCodes))
    assert codes()["two"]
    forget()
    assert codes() is None


def test_batches_of_the_pipeline_are_small(spark):
    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.nbytes]), pa.array([batch.num_rows])], names=["bytes", "rows"])

    docs = spark.range(0, 4000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 1000).alias("text"))
    for _, stage in corpus_pipeline.STAGES:
        if stage is not corpus_pipeline.secret_redaction:  # no Python there
            spark.conf.unset("spark.sql.execution.arrow.maxBytesPerBatch")
            stage(spark, docs.limit(20), SF)
            found = docs.mapInArrow(sizes, "bytes long, rows long").agg(F.max("bytes"), F.sum("rows")).first()
            assert found[0] <= 2 * corpus_pipeline.BATCH_BYTES and found[1] == 4000


def test_comparisons_take_little_memory():
    n = 3000
    prints = np.random.default_rng(1).integers(0, 256, (n, simhash_texts.TALLIED)).astype(np.uint8)
    prints[1::2] = prints[::2]
    tracemalloc.start()
    try:
        found = {(int(a), int(b)) for x, y in simhash_texts._apart(np.zeros(n, int), np.arange(n), prints, np.zeros(n, int)) for a, b in zip(x, y)}
        trees = simhash_texts._tree(np.arange(n), prints)
        assert tracemalloc.get_traced_memory()[1] < 32 << 20
    finally:
        tracemalloc.stop()
    assert {(min(p), max(p)) for p in found} == {(i, i + 1) for i in range(0, n, 2)}
    assert sorted(int(b) - int(a) for x, y in trees for a, b in zip(x, y)) == [1] * (n // 2)


def test_postings_without_company_go_and_no_other(spark):
    draw = np.random.default_rng(3)
    prints = draw.integers(0, 256, (250, simhash_texts.GROUPS * 3)).astype(np.uint8)
    prints[1, 3:11] = ~prints[0, 3:11]
    prints[:2, :3] = (5, 5, 5)  # a list of two unlike texts
    prints[40:60, :3] = (9, 9, 9)
    for i in range(40, 60, 2):  # ten pairs of near copies
        prints[i + 1] = prints[i] ^ np.packbits(draw.random(prints.shape[1] * 8) < 0.1)
        prints[i + 1, :3] = (9, 9, 9)
    prints[100:200, 3:6] = (7, 7, 7)  # a long list
    classes = spark.createDataFrame([(i, bytearray(p.tobytes())) for i, p in enumerate(prints)], "node long, bits binary")
    group = lambda g, b: g << 24 | b << 16 | b << 8 | b
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 7)
    try:
        met = [(r.key, r.node) for r in simhash_texts._met(classes).collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(set(met)) == len(met)
    assert not [n for k, n in met if k == group(0, 5)]
    assert sorted(n for k, n in met if k == group(0, 9)) == list(range(40, 60))
    assert sorted(n for k, n in met if k == group(1, 7)) == list(range(100, 200))
    shared = {tuple(sorted(p)) for p in ((i, i + 1) for i in range(40, 60, 2))}
    for i, j in shared:
        same = (prints[i] == prints[j]).reshape(-1, 3).all(axis=1)
        assert {k >> 24 for k, n in met if n == i} & {k >> 24 for k, n in met if n == j} == set(np.flatnonzero(same).tolist())
