"""Whitening, prefix trie and mixing against brute force."""

import hashlib
import math
import zlib
from collections import defaultdict
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm.common import prose
from plumbline.llm import mixing, prefix_trie, whitening


# --- whitening ------------------------------------------------------------------------------------------------------------

def eigen(a):
    values, vectors = np.linalg.eigh(a.T @ a)
    return values[::-1], vectors[:, ::-1]


def matrices():
    rng = np.random.default_rng(5)
    q = np.linalg.qr(rng.normal(size=(200, 30)))[0]
    p = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    zero = rng.normal(size=(300, 20))
    zero[:, 3], zero[:, 7] = 0, zero[:, 8]
    return {
        "random": rng.normal(size=(500, 64)), "graded": rng.normal(size=(500, 64)) * np.logspace(0, -8, 64), "equal": q, "clusters": q * (np.repeat([3, 2, 1.0], 10) * (1 + 1e-13 * np.arange(30))) @ p,
        "singular": zero, "wide": rng.normal(size=(3, 20)), "one": rng.normal(size=(9, 1)), "two": rng.normal(size=(9, 2)), "diagonal": np.eye(12) * 3, "nothing": np.zeros((5, 4)),
    }


@pytest.mark.parametrize("name", matrices())
def test_directions_against_a_library(name):
    a = matrices()[name]
    squares, way = whitening.directions(np.linalg.qr(a, mode="r"), 40)
    values, _ = eigen(a)
    rank = int((values > values[0] * 1e-20).sum()) if name == "graded" else np.linalg.matrix_rank(a)
    assert len(squares) == min(rank, 40)
    if len(squares):
        assert np.allclose(squares, values[:len(squares)], rtol=1e-10, atol=values[0] * 1e-14)
        assert np.abs(way.T @ way - np.eye(len(squares))).max() < 1e-8
        assert np.abs(a.T @ (a @ way) - way * squares).max() < 1e-12 * values[0]


def test_singular_values_keep_relative_accuracy():
    d, e = np.logspace(0, -12, 25), np.logspace(-1, -13, 24)
    exact = np.linalg.svd(np.diag(d) + np.diag(e, 1), compute_uv=False)
    got = np.sqrt(whitening.dqds(d, e))
    assert abs(math.prod(got) / math.prod(d) - 1) < 1e-10  # the determinant, which a library's small values miss
    assert np.allclose(got[:6], exact[:6], rtol=1e-12)


def embeddings(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumns({c: F.lit(1) for c in ("x", "n", "w", "component", "i")})


def test_whitening_against_brute_force(spark):
    rng = np.random.default_rng(2)
    v = (rng.normal(size=(700, 12)) @ rng.normal(size=(12, 12)) * 0.2 + 5).astype(np.float32)
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(0, v[0].tolist()), (None, v[1].tolist()), (900, v[2, :5].tolist()), (901, [])]
    bad = [(1000, None), (1001, [1.0, None]), (1002, [float("nan")] * 12), (1003, [float("inf")] + [0.0] * 11)]
    x = np.zeros((len(rows), 12))
    for i, (_, e) in enumerate(rows):
        x[i, :len(e)] = np.array(e, np.float32)
    x = np.floor(x.astype(float) * 1024).astype(np.int64) + 100_000
    n, s = len(x), x.sum(0)
    c = x - s / n
    values, vectors = eigen(c / math.sqrt(n))
    got = defaultdict(list)
    for r in whitening.digest(whitening.whiten(embeddings(spark, rows + bad).repartition(7))).collect():
        got[r.component].append(r)
    assert sorted(got) == list(range(1, 9))
    for k in got:
        w = c @ vectors[:, k - 1] / math.sqrt(values[k - 1])
        want = sorted((i if i is not None else -1, int(((n * a - s) ** 2).sum())) for (i, _), a in zip(rows, x))
        assert sorted((r.vec_id if r.vec_id is not None else -1, r.deviation) for r in got[k]) == want
        mine, theirs = {r.vec_id: r.whitened for r in got[k]}, {i: y for (i, _), y in zip(rows, w)}
        sign = np.sign(mine[5] * theirs[5])
        assert all(abs(sign * mine[i] - theirs[i]) < 1e-9 for i in theirs)
        assert all(r.n == n and abs(r.explained - values[k - 1] / values.sum()) < 1e-9 and 0 <= r.identity_error < 1e-9 for r in got[k])


def test_whitening_of_nothing_one_and_huge(spark):
    assert whitening.whiten(embeddings(spark, [])).collect() == [] and whitening.whiten(embeddings(spark, [(1, None), (2, [])])).collect() == []
    assert whitening.whiten(embeddings(spark, [(1, [1.0, 2.0])])).collect() == []
    rows = whitening.digest(whitening.whiten(embeddings(spark, [(1, [1e38, 0.0]), (2, [-1e38, 1.0]), (3, [0.5, 2.0])]))).collect()
    assert {r.component for r in rows} == {1, 2} and all(r.deviation is None for r in rows if r.vec_id != 3)
    with pytest.raises(ValueError):
        whitening.whiten(embeddings(spark, [(1, [0.0] * (whitening.MOST_DIMENSIONS + 1))]))


# --- prefix trie ----------------------------------------------------------------------------------------------------------

def tree(turns, block=20, heads=4):
    said = defaultdict(list)
    for c, t, role, text in turns:
        if c is not None:
            said[c].append((t is not None, t or 0, role or "", text or ""))
    said = {c: [x[2:] for x in sorted(v)] for c, v in said.items()}
    whole = {}
    for c, v in said.items():
        h = zlib.crc32(str(c).encode()) % heads
        whole[c] = tuple(said.get(c - int(math.fmod(c, block)), [])[:h] + v[h:])
    members, ends, children = defaultdict(list), defaultdict(list), defaultdict(set)
    for c, s in whole.items():
        ends[s].append(c)
        for d in range(len(s) + 1):
            members[s[:d]].append(c)
            if d:
                children[s[:d - 1]].add(s[:d])
    out = []
    for p in members:
        under = [v for v in members if v[:len(p)] == p]
        saved = sum((len(members[v]) - 1) * len(v[-1][1].encode().split()) for v in under if v)
        out.append((min(members[p]), len(p), min(members[p[:-1]]) if p else None, len(members[p]), len(children[p]), sum(not children[v] for v in under), saved,
                    hashlib.sha256(",".join(map(str, sorted(ends[p]))).encode()).hexdigest()))
    return sorted(out, key=str)


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(1) for c in ("depth", "rep", "k1", "weight", "h", "q", "segment")})


TALK = [(c, t, "user" if t % 2 == 0 else "assistant", f"said {c % 3 if t > 1 else 0} {t % 5} \x1c x") for c in range(45) for t in range(c % 6)]
TALK += [(100, t, "user", f"turn {t}") for t in range(300)] + [(101, t, "user", f"turn {t}") for t in range(290)] + [(102, 0, None, None), (102, None, "b", "first"), (102, 0, "a", "tie"), (102, 0, "a", "tie")]
TALK += [(-5, 0, "user", "turn 0"), (-5, 1, "user", "turn 1"), (None, 0, "user", "lost"), (None, 1, "user", "lost"), (400, 0, "user", prose(4, 30_000)), (401, 0, "user", prose(4, 30_000)), (9, 0, "user\x00said", "0 0"), (9, 9, "", "")]


@pytest.mark.parametrize("block, heads", [(20, 4), (7, 3), (20, 1)])
def test_trie_against_brute_force(spark, block, heads):
    nodes = prefix_trie.digest(prefix_trie.prefix_trie(conversations(spark, TALK), block, heads))
    assert sorted(map(tuple, nodes.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str) == tree(TALK, block, heads)


def test_conversations_over_several_segments(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "CHUNK", 3)
    was = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    spark.conf.set("spark.sql.adaptive.enabled", False)
    try:
        some = [r for r in TALK if r[0] in (100, 101, 102, 3, 4, 5, None)] + [(c, 0, "user", "hello") for c in range(500, 520)]
        marks = prefix_trie.marked(conversations(spark, some))
        assert len(prefix_trie.carried(marks)) > 3
        got = prefix_trie.digest(prefix_trie.prefix_trie(conversations(spark, some)))
        assert sorted(map(tuple, got.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256").collect()), key=str) == tree(some)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was[0])
        spark.conf.set("spark.sql.adaptive.enabled", was[1])


def test_trie_of_nothing(spark):
    assert prefix_trie.prefix_trie(conversations(spark, [])).collect() == []
    assert prefix_trie.prefix_trie(conversations(spark, [(None, 1, "a", "b")])).collect() == []


# --- mixing ---------------------------------------------------------------------------------------------------------------

def plan_by_hand(rows, quality, weights=(1, 2, 3), most=3):
    size = [len((t or "").encode().split()) for _, t, _ in rows]
    names = sorted({s for *_, s in rows}, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    have = {s: sum(n for n, r in zip(size, rows) if r[2] == s) for s in names}
    target, open_, left = {}, set(names), Fraction(sum(size))
    while open_:
        share = left / sum(w[s] for s in open_)
        full = {s for s in open_ if share * w[s] > most * have[s]}
        if not full:
            target |= {s: float(share * w[s]) for s in open_}
            break
        target |= {s: float(most * have[s]) for s in full}
        left -= sum(most * have[s] for s in full)
        open_ -= full
    out = []
    for s in names:
        epochs = int(target[s] / have[s] + 1e-12) if have[s] else 0
        budget = math.floor(target[s] - epochs * have[s] + 0.5)
        drawn = []
        for n, (d, t, of) in zip(size, rows):
            if of == s:
                u = (int(hashlib.md5(f"mix:{'' if d is None else d}:{t or ''}".encode()).hexdigest()[:13], 16) + 0.5) / 2 ** 52
                drawn.append((-math.log(u) / quality.get(d, 1.0), -1 if d is None else d, n, d))
        for _, _, n, d in sorted(drawn):
            part = max(0, min(n, budget))
            budget -= part
            out.append((d, n, have[s], epochs * n + part, round(target[s], 6)))
    return sorted(out, key=str)


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string").withColumns({c: F.lit(1) for c in ("size", "key", "target", "taken", "quality", "_place", "_w")})


MIXED = [(i, prose(i, 5 + i % 40), "abcde"[min(4, i % 9)]) for i in range(200)] + [(300 + i, prose(i, 3), "tiny") for i in range(4)] + [(400, None, "void"), (401, "", "void"), (402, "null source", None), (403, prose(9, 20_000), "b")]
MIXED += [(5, prose(5, 10), "a"), (5, prose(5, 10), "a"), (None, "no id at all", "a"), (None, None, None), (404, "x", "É"), (405, "y", "")]
LABELS = [(i, i % 2) for i in range(0, 200, 3)] + [(6, 0), (6, 1), (None, 1), (7, None)]


def test_mix_against_brute_force(spark):
    labels = spark.createDataFrame(LABELS, "doc_id bigint, quality int")
    quality = defaultdict(float)
    for d, q in LABELS:
        if d is not None and q is not None:
            quality[d] = max(quality[d], 2.0 if q else 0.5)
    plan = mixing.mix(documents(spark, MIXED), mixing.qualities(labels)).cache()
    got = [(r.doc_id, r.size, r.source_size, r.taken, round(r.target, 6)) for r in plan.collect()]
    assert sorted(got, key=str) == plan_by_hand(MIXED, dict(quality))
    assert sorted(map(tuple, mixing.mix(documents(spark, MIXED).repartition(5), mixing.qualities(labels)).collect()), key=str) == sorted(map(tuple, plan.collect()), key=str)
    for r in plan.groupBy("source").agg(F.sum("taken").alias("t"), F.max("target").alias("g")).collect():
        assert abs(r.t - r.g) <= 0.5
    assert all(0 <= r.taken <= 3 * r.size for r in plan.collect())
    texts = mixing.mixed(documents(spark, MIXED), plan).collect()
    words = defaultdict(int)
    for r in texts:
        words[r.doc_id] += r.times * len(r.text.encode().split())
    taken = defaultdict(int)
    for r in plan.collect():
        taken[r.doc_id] += r.taken
    assert {d: n for d, n in taken.items() if n} == dict(words)


def test_good_documents_are_preferred(spark):
    rows = [(i, "ten words stand here and no more than ten words", "big" if i < 2000 else "small") for i in range(2100)]
    quality = spark.createDataFrame([(i, 2.0 if i % 2 else 0.5) for i in range(2100)], "doc_id bigint, quality double")
    plan = mixing.mix(documents(spark, rows), quality, weights=(1, 1)).where("source = 'big'").groupBy((F.col("doc_id") % 2).alias("good")).agg(F.sum("taken").alias("t")).collect()
    taken = {r.good: r.t for r in plan}
    assert taken[1] > taken[0]


def test_mix_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id bigint, quality double")
    assert mixing.mix(documents(spark, []), none).collect() == []
    assert [r.taken for r in mixing.mix(documents(spark, [(1, None, "a"), (2, " ", None)]), none).collect()] == [0, 0]
    with pytest.raises(ValueError):
        mixing.mix(documents(spark, []), none, weights=(0, 1))
