import random
import re

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import Window, functions as F

from llm.common import ODD, frame, groups, prose
from plumbline.llm import components, decontaminate, similar, simhash, vectors
from plumbline.llm.common import keyed, words


def fingerprint(text):
    text = (text or "").translate({c: c + 32 for c in range(65, 91)})
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(w[i:i + 4]) for i in range(len(w) - 3)] or ([" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_copies():
    out = [(100 + i, prose(500, 300).replace("an", f"an{i}" if i % 9 == 0 else "an", 1)) for i in range(30)]
    return out + [(200 + i, prose(900 + i // 3, 60)) for i in range(12)]


def test_fingerprints():
    texts = [t for _, t in ODD if not t or len(t) < 10_000]
    assert simhash.fingerprints_of(pa.array(texts, pa.string())).view(np.uint64).tolist() == [fingerprint(t) for t in texts]


def test_long_texts_are_counted_in_parts(monkeypatch):
    texts = pa.array([prose(2, 400), None, prose(3, 200)])
    whole = simhash.fingerprints_of(texts).tolist()
    monkeypatch.setattr(simhash, "COUNTED", 37)
    assert simhash.fingerprints_of(texts).tolist() == whole


def test_near_duplicates_against_all_pairs(spark):
    rows = [r for r in ODD if r[1] is None or len(r[1]) < 10_000] + near_copies()
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in simhash.digest(simhash.near_duplicates(frame(spark, rows))).collect()}
    f = np.array([fingerprint(t) for _, t in rows], np.uint64)
    root = groups(len(rows), zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 4)))
    least = {g: min((rows[i][0] for i in range(len(rows)) if root[i] == g and rows[i][0] is not None), default=None) for g in root}
    assert got == {(rows[i][0], f"{int(f[i]):016x}", least[root[i]]) for i in range(len(rows))}
    assert simhash.near_duplicates(frame(spark, [])).collect() == []


@pytest.mark.parametrize("values", [1_000_000, 5_000])
def test_links_of_random_fingerprints(spark, monkeypatch, values):
    monkeypatch.setattr(simhash, "VALUES", values)
    rng = random.Random(4)
    centre = [rng.getrandbits(64) for _ in range(40)]
    some = {c ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for c in centre for _ in range(6)}
    f = np.array(sorted(some), np.uint64)
    df = spark.createDataFrame([(int(x),) for x in f.view(np.int64)], "fingerprint bigint")
    got = simhash.links(df).distinct().collect()
    index = {int(x): i for i, x in enumerate(f.view(np.int64))}
    want = groups(len(f), zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 4)))
    assert groups(len(f), [(index[r.a], index[r.b]) for r in got]) == want
    with pytest.raises(ValueError):
        simhash.links(df, 3)


def test_one_of_each_keeps_columns_and_clean_rows(spark):
    rows = [r for r in ODD if r[1] is None or len(r[1]) < 10_000] + near_copies()
    df = frame(spark, rows)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns
    f = np.array([fingerprint(t) for _, t in rows], np.uint64)
    assert kept.count() == len(set(groups(len(rows), zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 4)))))
    assert simhash.one_of_each(frame(spark, [])).count() == 0


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())


def edited(seed, n, changed):
    w, rng = prose(seed, n).split(), random.Random(changed)
    for i in rng.sample(range(n), changed):
        w[i] = f"edit{rng.random()}"
    return " ".join(w)


def test_pipeline_removes_copies_at_a_similarity_of_four_fifths(spark):
    import corpus_pipeline

    rows = [r for r in ODD if r[1] is None or len(r[1]) < 10_000] + near_copies()
    rows += [(1000 + 10 * g + c, edited(3000 + g, 200, c)) for g in range(25) for c in range(8)] + [(5000, "one two THREE"), (5001, "one two three"), (5002, "one two")]
    rows = [(i, t) for i, t in rows if i is not None]
    s, f = [shingles(t) for _, t in rows], np.array([fingerprint(t) for _, t in rows], np.uint64)
    jaccard = [(i, j) for i in range(len(rows)) for j in range(i) if s[i] and s[j] and 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    near = list(zip(*np.nonzero(np.bitwise_count(f[:, None] ^ f) <= 4)))
    want, fingerprints_only = groups(len(rows), near + jaccard), groups(len(rows), near)
    assert len(set(want)) < len(set(fingerprints_only)) - 25
    df = frame(spark, rows)
    kept = corpus_pipeline.remove_near_duplicates(spark, df, "")
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(min(rows[i][0] for i in range(len(rows)) if want[i] == g) for g in set(want))
    assert corpus_pipeline.remove_near_duplicates(spark, frame(spark, []), "").count() == 0


def test_prefixes_meet_at_four_fifths():
    rng, none = random.Random(6), np.empty(0, np.uint64)
    for n, frequent in ((30, none), (200, none), (200, np.sort(np.random.default_rng(2).integers(0, 1 << 63, 90).astype(np.uint64)))):
        for _ in range(60):
            common = [rng.getrandbits(63) for _ in range(n)] + frequent.tolist()
            size = len(common)
            spare = size // 4  # overlap size of size + spare different ones: just at 0.8
            x = common + [rng.getrandbits(63) for _ in range(spare // 2)]
            y = common + [rng.getrandbits(63) for _ in range(spare - spare // 2)]
            h, k = similar.distinct_shingles(np.array(x + y, np.uint64), np.array([len(x), len(y)]), frequent)
            x, y = sorted((h[:k[0]].tolist(), h[k[0]:].tolist()), key=len)
            assert set(x[:len(x) // 9 + 1]) & set(y[:len(y) // 5 + 1])


def test_bitmaps_never_part_similar_texts():
    rng = np.random.default_rng(3)
    for n in (1, 9, 40, 500, 5000):
        for _ in range(20):
            x = rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2)
            y = np.concatenate((x[: n - n // 10], rng.integers(0, 1 << 63, n // 10, dtype=np.uint64) * np.uint64(2)))
            a, b = similar.bitmaps(np.concatenate((x, y)), np.array([n, n])).view(np.uint64)
            differ = int(np.bitwise_count(a ^ b).sum())
            assert differ <= len(set(x.tolist()) ^ set(y.tolist())) and (n != 500 or differ > 40)


def test_bitmaps_grow_with_their_texts():
    rng = np.random.default_rng(4)
    n = np.array([1500, 0, 700, 2100, 1, 2000])
    h = rng.integers(0, 1 << 63, n.sum(), dtype=np.uint64) * np.uint64(2)
    blocks = similar.blocks_of(n)
    assert blocks.tolist() == [2, 1, 1, 4, 1, 2] and similar.blocks_of(np.array([10**9])).tolist() == [similar.BLOCKS]
    words, one, at = similar.bitmaps(h, n, blocks), similar.bitmaps(h, n), 0
    for i, size in enumerate(blocks * similar.BITS // 64):
        folded = words[at:at + size]
        at += size
        while len(folded) > similar.BITS // 64:
            folded = folded[:len(folded) // 2] ^ folded[len(folded) // 2:]
        assert folded.tolist() == one[i].tolist()
    assert at == len(words)


def test_bitmaps_tell_long_texts_apart(spark):
    """A bitmap of fixed size was full for these, so all pairs were compared by their shingles."""
    base = prose(70, 4200).split()
    texts = [base, base[:3900], base[:3100] + prose(71, 1000).split(), base[:2000] + prose(72, 2000).split(), prose(73, 4000).split(), prose(74, 4300).split(), prose(75, 3000).split()]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    marked = similar.marked(frame(spark, rows), np.empty(0, np.uint64)).cache()
    side = lambda x, i: marked.select(F.col("text_key").alias(x), F.col("n").alias(f"n{x}"), F.col("doc_id").alias(i))
    pairs = side("x", "a").crossJoin(side("y", "b")).where("a < b and least(nx, ny) * 5 >= greatest(nx, ny) * 4")
    met = {(r.a, r.b) for r in pairs.collect()}
    s = [shingles(t) for _, t in rows]
    want = {(i, j) for i, j in met if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])}
    assert {(0, 1)} <= want < met and len(met) > 10
    assert {(r.a, r.b) for r in similar.alike(pairs, marked.select("text_key", "bits")).collect()} == want
    marked.unpersist()


def test_texts_are_shuffled_once_for_the_row_that_stays(spark, capsys):
    rows = [(None, "same"), (None, "same"), (0, "same"), (0, "same"), (None, None), (3, None), (3, None), (4, "other"), (4, "another")]
    df = frame(spark, rows)
    found = keyed(df).withColumns({"root": F.xxhash64("text_key"), "component_id": F.min("doc_id").over(Window.partitionBy("text_key"))})
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        kept = simhash.one_of_groups(df, found)
        kept.explain()
        assert capsys.readouterr().out.count("Exchange") == 2
        assert kept.columns == df.columns and sorted((r.doc_id, r.text or "") for r in kept.collect()) == [(0, "same"), (3, ""), (4, "another"), (4, "other")]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    alone = frame(spark, [(None, "x"), (None, "x")])
    assert [r.doc_id for r in simhash.one_of_each(alone).collect()] == [None]


@pytest.mark.parametrize("share", [0.5, 0.85])
def test_families_meet_only_if_they_are_similar(spark, share, monkeypatch):
    """Texts of one template: below the least similarity they are not compared, above it they are one group."""
    monkeypatch.setattr(similar, "SAMPLE", 2)
    template, rng = prose(60, 400).split(), random.Random(9)
    rows = []
    for i in range(60):
        w = list(template)
        # an edit of one word changes five shingles of 396; two texts differ by the edits of both
        for j in rng.sample(range(80), int((1 - share) / (1 + share) * 396 / 2 / 5)):
            w[5 * j] = f"edit{i}x{j}"
        rows.append((i, " ".join(w)))
    df = frame(spark, rows)
    marked = similar.marked(df, similar.frequent_shingles(df))
    met = similar.files(marked).count()
    assert met == 0 if share < 0.8 else met > 0
    by_fingerprint = len({r.root for r in simhash.near_duplicates(df).collect()})
    assert by_fingerprint > 1 and len({r.root for r in similar.groups(df).collect()}) == (by_fingerprint if share < 0.8 else 1)


def test_components_of_paths_stars_and_loops(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(1000, 1000 + i) for i in range(1, 40)] + [(7, 7), (2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in components.connected_components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert len(got) == 61 + 40 + 2 and len(set(got.values())) == 3
    assert len({got[i] for i in range(61)}) == 1 and got[0] in range(61)
    assert components.connected_components(spark.createDataFrame([(5, 5)], "a bigint, b bigint")).collect() == []


def test_vectors_against_all_pairs(spark):
    rng = np.random.default_rng(1)
    base = rng.normal(size=(60, 16))
    x = np.concatenate([base, base[:30] + rng.normal(size=(30, 16)) * 0.12, base[:5], 3 * base[:3], np.zeros((1, 16))]).astype(np.float32)
    rows = [(i, v.tolist(), i % 3) for i, v in enumerate(x)]
    rows += [(1000, None, 0), (1001, [1.0, None], 0), (1002, [float("nan")] * 16, 0), (1003, [float("inf")] + [0.0] * 15, 0), (1004, [], 0), (1005, [1.0], 0), (None, base[0].astype(np.float32).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, kind int").withColumn("unit", F.lit(1)).withColumn("key", F.lit(2))
    got = sorted(map(tuple, vectors.near_vectors(df).collect()), key=str)
    unit = np.zeros((len(rows), 16))
    for i, (_, v, _) in enumerate(rows):
        if v and None not in v and np.isfinite(v).all() and any(v):
            unit[i, :len(v)] = v
            unit[i] /= np.linalg.norm(unit[i])
    near = unit @ unit.T >= 0.95
    np.fill_diagonal(near, False)
    root = groups(len(rows), zip(*np.nonzero(near)))
    want = []
    for i, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if root[j] == root[i] and rows[j][0] is not None]
        want.append((r[0], int(near[i].sum()), min(ids, default=None), r[0] is not None and r[0] == min(ids)))
    assert got == sorted(want, key=str)
    assert vectors.near_vectors(df.limit(0)).collect() == []


def test_large_files_are_compared_in_blocks(spark, monkeypatch):
    rng = np.random.default_rng(7)
    x = rng.normal(size=16) + rng.normal(size=(120, 16)) * 0.15
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x.astype(np.float32))], "vec_id bigint, embedding array<float>")
    was = sorted(map(tuple, vectors.near_vectors(df).collect()))
    u = x.astype(np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    assert [r[1] for r in was] == ((u @ u.T >= 0.95).sum(1) - 1).tolist()
    monkeypatch.setattr(vectors, "HOT", 16)
    monkeypatch.setattr(vectors, "PAIRS", 50)
    assert sorted(map(tuple, vectors.near_vectors(df).collect())) == was


def test_first_files_are_never_passed_over():
    rng = np.random.default_rng(8)
    random = rng.standard_normal((300, 8)).astype(np.float32)
    u = rng.normal(size=(5, 8))[rng.integers(0, 5, 80)] + rng.normal(size=(80, 8)) * 0.2
    u = (u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    tail, window = 1.5, 0.4
    p = u @ random.T
    side = np.where(np.abs(p) >= tail, np.sign(p), 0)
    want = {(i, j) for i in range(80) for j in range(i + 1, 80) if ((side[i] != 0) & (side[i] == side[j]) & (np.abs(p[i] - p[j]) <= window)).sum() >= 2}
    e = vectors.files_of(u, np.arange(80), random, tail)
    got = [(int(a), int(b)) for x, y in vectors.met(e, window) for a, b in zip(x, y)]
    assert set(got) == want and len(got) < 20 * len(want)


def test_recall_of_pairs_just_at_the_least_cosine():
    rng = np.random.default_rng(3)
    lines, tail, window = vectors.plan(50_000)
    u = rng.normal(size=(400, 64))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    o = rng.normal(size=u.shape)
    o -= (o * u).sum(1, keepdims=True) * u
    o /= np.linalg.norm(o, axis=1, keepdims=True)
    r = rng.normal(size=(64, lines))
    p, q = u @ r, (0.95 * u + np.sqrt(1 - 0.95 ** 2) * o) @ r
    together = ((np.abs(p) >= tail) & (np.abs(q) >= tail) & (np.abs(p - q) <= window)).sum(1)
    assert (together >= vectors.COUNT).mean() > 0.99


ITEMS = [(1, prose(5, 60_000)[:400]), (2, prose(70, 25)), (2, prose(71, 12)), (3, "two words"), (4, None), (5, ""), (6, prose(1, 80)), (None, prose(72, 14)), (7, prose(70, 25)), (10, "ONE")]


def contaminated(rows, items):
    out, kinds = [], []
    for i, t in items:
        w = words(t)
        kinds += [(i, w[a:a + 10]) for a in range(max(1, len(w) - 9))] if w else []
    index = {}
    for i, k in kinds:
        index.setdefault(tuple(k), set()).add(i)
    sizes = {len(k) for k in index}
    for d, t in rows:
        w, hit, found = words(t), set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in index:
                    hit |= set(range(a, a + n))
                    found |= {str(i) for i in index[tuple(w[a:a + n])] if i is not None}
        out.append((d, len(w), len(hit), len(found), ",".join(sorted(found))))
    return sorted(out, key=str)


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_contamination_against_all_windows(spark, sent):
    rows = ODD + [(20, prose(8, 30) + " " + prose(70, 25).upper() + ", " + prose(9, 30)), (21, prose(72, 14)), (22, " ".join(prose(70, 25).split()[:9])), (23, prose(71, 12) * 3)]
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string").withColumn("h", F.lit(0))
    found = decontaminate.contamination(frame(spark, rows), items, sent)
    got = sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, ",".join(r["items"])) for r in found.collect()), key=str)
    assert got == contaminated(rows, ITEMS)


def test_no_items_and_no_documents(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert all(r.n_hit == 0 for r in decontaminate.contamination(frame(spark), none).collect())
    assert decontaminate.contamination(frame(spark, []), none).collect() == []


def test_clean_keeps_clean_documents(spark):
    df = frame(spark, [(1, prose(70, 25)), (2, prose(40, 50)), (2, prose(70, 30)), (None, None)])
    kept = decontaminate.clean(df, spark.createDataFrame(ITEMS, "item_id bigint, text string"))
    assert kept.columns == df.columns and sorted((r.doc_id, r.text) for r in kept.where("doc_id is not null").collect()) == [(2, prose(40, 50))]
