"""Near-duplicate vectors by counting collisions in windows of sorted projections.

Every vector is projected on M random lines. For a unit vector a projection is normal, and those of
two vectors correlate by their cosine. On each line only the vectors far out, beyond TAIL in size,
look around themselves: sorted along the line, each takes those inside a window beside it. Far out a close pair is likely together
and a random pair is not. A pair that collides on COUNT lines is verified in double precision. M follows from the least cosine, the tail,
the window and the count, so that a pair just at the least cosine reaches the count with probability RECALL.

Single collisions are not listed: a vector is far out on a few lines only, whatever their number, so it is filed under every two of them. Vectors
that are filed together and lie in each other's window on both lines have their two collisions; of the many files of a close pair all but about the first are passed over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import write_once
from .components import connected_components

LEAST, COUNT, RECALL, SEED = 0.95, 2, 0.999, 20
#: The window reaches so many standard deviations of the difference of a pair at the least cosine.
REACH = 2.0
#: A vector shows on about TAIL_SHARE / sqrt(n) of all lines, so that as many random pairs meet per vector at every n.
TAIL_SHARE = 0.6
#: About so many filed entries to a task, so many pairs at a time.
FILED, PAIRS = 200_000, 1 << 20
#: A file of more entries is cut into blocks of half as many, and every two blocks are compared by a task of their own.
HOT = 4_096
#: An entry of a file: two lines, where the vector lies on them, and the lines it is on right before each of them.
ENTRY = np.dtype([("key", "<i8"), ("kind", "<i8"), ("at1", "<f4"), ("at2", "<f4"), ("prev1", "<i4"), ("prev2", "<i4"), ("pat1", "<f4"), ("pat2", "<f4")])


def _above(x: np.ndarray | float) -> np.ndarray:
    return 0.5 * np.vectorize(math.erfc)(np.asarray(x, float) / math.sqrt(2))


def plan(n: int, least: float = LEAST, count: int = COUNT, recall: float = RECALL) -> tuple[int, float, float]:
    """Lines, tail and window for n different vectors."""
    share = min(0.05, TAIL_SHARE / math.sqrt(max(n, 1)))
    low, high = 0.0, 9.0
    while high - low > 1e-9:
        tail = (low + high) / 2
        low, high = (tail, high) if 2 * _above(tail) > share else (low, tail)
    spread = math.sqrt(1 - least * least)
    window = REACH * math.sqrt(2 - 2 * least)
    x = np.linspace(tail, tail + 6, 4001)
    both = (_above((np.maximum(tail, x - window) - least * x) / spread) - _above((x + window - least * x) / spread)) * np.exp(-x * x / 2) / math.sqrt(2 * math.pi)
    together = 2 * float(np.sum(both) * (x[1] - x[0]))
    mean = float(count)
    while sum(math.exp(-mean) * mean ** i / math.factorial(i) for i in range(count)) > 1 - recall:
        mean *= 1.01
    return math.ceil(mean / together), tail, window


def prepared(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, key, unit): equal vectors have equal keys. Vectors that link with nothing have none."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, units = [], []
            for v in batch.column("embedding").to_pylist():
                x = np.zeros(width)
                if v is not None and None not in v:
                    x[:len(v)] = v
                fine = np.isfinite(x).all() and x.any()
                keys.append(xxhash.xxh3_128_digest((x + 0.0).tobytes()) if fine else None)
                x /= np.abs(x).max() if fine else 1
                units.append(x / np.sqrt(x @ x) if fine else None)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(keys, pa.binary()), pa.array(units, pa.list_(pa.float64()))], names=["vec_id", "key", "unit"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(mark, "vec_id bigint, key binary, unit array<double>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def files_of(u: np.ndarray, kind: np.ndarray, random: np.ndarray, tail: float) -> np.ndarray:
    """The entries of all vectors ``u``: every two lines on which one is far out. A side of a line is a line of its own."""
    lines, out = len(random), []
    step = max(1, (1 << 22) // lines)
    for a in range(0, len(u), step):
        p = u[a:a + step] @ random.T
        row, line = np.nonzero(np.abs(p) >= tail)
        p = p[row, line]
        side, at = (2 * line + (p < 0)).astype(np.int32), np.abs(p).astype(np.float32)
        n = np.bincount(row, minlength=min(step, len(u) - a))
        first = np.cumsum(n) - n
        for m in np.unique(n[n > 1]).tolist():
            who = np.flatnonzero(n == m)
            place = first[who][:, None] + np.arange(m)
            s, x = side[place], at[place]
            order = np.argsort(s, axis=1)
            s, x = np.take_along_axis(s, order, 1), np.take_along_axis(x, order, 1)
            i, j = np.triu_indices(m, 1)
            e = np.empty((len(who), len(i)), ENTRY)
            e["key"] = s[:, i].astype(np.int64) * (2 * lines) + s[:, j]
            e["kind"] = kind[a + who][:, None]
            e["at1"], e["at2"] = x[:, i], x[:, j]
            e["prev1"], e["pat1"] = np.where(i > 0, s[:, i - 1], -1), x[:, i - 1]
            e["prev2"], e["pat2"] = np.where(j > i + 1, s[:, j - 1], -1), x[:, j - 1]
            out.append(e.ravel())
    return np.concatenate(out) if out else np.empty(0, ENTRY)


def filed(kinds: DataFrame, width: int, lines: int, tail: float, units: int) -> DataFrame:
    """(unit, entries): the entries of all kinds, dealt to ``units`` by a hash of their two lines, those of a batch together."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(SEED).standard_normal((lines, width), dtype=np.float32)
        for batch in batches:
            e = files_of(matrix(batch.column("unit"), width).astype(np.float32), batch.column("kind").to_numpy(), random, tail)
            unit = (e["key"].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) % np.uint64(units)
            by = np.argsort(unit, kind="stable")
            e, unit = e[by], unit[by]
            edge = np.flatnonzero(np.diff(unit, prepend=np.uint64(units)))
            offsets = np.append(edge, len(e)) * ENTRY.itemsize
            yield pa.RecordBatch.from_arrays([pa.array(unit[edge].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(e.tobytes())])],
                                             names=["unit", "entries"])

    return kinds.select("kind", "unit").mapInArrow(look, "unit int, entries binary")


def met(e: np.ndarray, window: float, block: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs a < b that are filed together and within the window on both lines, a bounded number at a time. A pair that must have met in an earlier
    file is passed over: where the lines before are the same and close, too. Its first file is never passed over. With ``block``, only entries of different blocks."""
    by = np.lexsort((e["at1"], e["key"]))
    e, block = e[by], None if block is None else block[by]
    new = np.flatnonzero(np.diff(e["key"], prepend=-1))
    end = np.repeat(np.append(new[1:], len(e)), np.diff(np.append(new, len(e))))
    # the end of the window inside the file: files one after another on one axis
    axis = np.cumsum(np.diff(e["key"], prepend=-1) != 0) * 64.0 + e["at1"]
    reach = np.minimum(np.searchsorted(axis, axis + window, "right"), end) - np.arange(len(e)) - 1
    edges = np.concatenate(([0], np.cumsum(reach)))
    near = lambda x, y: np.abs(x - y) <= window
    i = 0
    while i < len(e):
        j = max(i + 1, int(np.searchsorted(edges, edges[i] + PAIRS, "right")) - 1)
        n = reach[i:j]
        x = np.repeat(np.arange(i, j), n)
        y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(n) - n, n)
        keep = near(e["at2"][x], e["at2"][y])
        if block is not None:
            keep &= block[x] != block[y]
        x, y = x[keep], y[keep]
        seen = (e["prev1"][x] >= 0) & (e["prev1"][x] == e["prev1"][y]) & near(e["pat1"][x], e["pat1"][y])
        seen |= (e["prev2"][x] >= 0) & (e["prev2"][x] == e["prev2"][y]) & near(e["pat2"][x], e["pat2"][y])
        a, b = e["kind"][x[~seen]], e["kind"][y[~seen]]
        pair = np.unique(np.stack((np.minimum(a, b), np.maximum(a, b)), 1), axis=0)
        yield pair[:, 0], pair[:, 1]
        i = j


def collisions(entries: DataFrame, window: float) -> DataFrame:
    """(a, b), a < b: every pair that collides on two lines. Files of more than HOT entries leave their task in blocks."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("key", pa.int64()), ("i", pa.int32()), ("j", pa.int32()), ("block", pa.int32()), ("entries", pa.binary())])

    def found(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *(pa.nulls(len(a), f.type) for f in list(schema)[2:])], schema=schema)

    def one(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = np.frombuffer(b"".join(x for batch in batches for x in batch.column("entries").to_pylist()), ENTRY)
        key, n = np.unique(e["key"], return_counts=True)
        hot = key[n > HOT]
        if len(hot):
            is_hot = np.isin(e["key"], hot)
            many, e = e[is_hot], e[~is_hot]
            for k in hot.tolist():
                some = many[many["key"] == k]
                blocks = [some[at:at + HOT // 2].tobytes() for at in range(0, len(some), HOT // 2)]
                for i in range(len(blocks)):
                    for j in range(i, len(blocks)):
                        rows = [(None, None, k, i, j, x, blocks[x]) for x in sorted({i, j})]
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
        for a, b in met(e, window):
            yield found(a, b)

    def two(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in zip(batch.column("block").to_pylist(), batch.column("entries").to_pylist())]
        e = np.frombuffer(b"".join(x for _, x in rows), ENTRY)
        block = np.repeat([k for k, _ in rows], [len(x) // ENTRY.itemsize for _, x in rows])
        for a, b in met(e, window, block if len(rows) > 1 else None):
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    first = write_once(entries.groupBy("unit").applyInArrow(one, "a bigint, b bigint, key bigint, i int, j int, block int, entries binary"), "collisions")
    pairs = first.where("key is null").select("a", "b")
    blocks = first.where("key is not null").select("key", "i", "j", "block", "entries")
    return pairs.union(blocks.groupBy("key", "i", "j").applyInArrow(two, "a bigint, b bigint")).distinct()


def verified(pairs: DataFrame, kinds: DataFrame, width: int, least: float = LEAST) -> DataFrame:
    """(a, b, copies_a, copies_b) of the pairs whose cosine is at least ``least``."""
    side = lambda x: kinds.select(F.col("kind").alias(x), F.col("unit").alias(f"unit_{x}"), F.col("copies").alias(f"copies_{x}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "copies_a", "copies_b", "unit_a", "unit_b")

    def test(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = np.einsum("ij,ij->i", matrix(batch.column("unit_a"), width), matrix(batch.column("unit_b"), width)) >= least
            yield batch.select(["a", "b", "copies_a", "copies_b"]).filter(pa.array(near))

    return both.mapInArrow(test, "a bigint, b bigint, copies_a bigint, copies_b bigint")


def near_vectors(vectors: DataFrame, least: float = LEAST) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row: vectors linked directly, the smallest
    vec_id reachable by links, and whether the row is that one.

    Equal vectors form one kind and are not compared among themselves, but count as links of each
    other. Null, zero and empty vectors and those with null or non-finite components link with
    nothing. A shorter vector is filled up with zeros. A row without an id links, names no
    component and is not kept; repeated rows are rows of a kind; other columns are not read; no rows, no rows.
    """
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = write_once(prepared(vectors, max(1, width)), "vectors")
    kinds = rows.where("key is not null").groupBy("key").agg(F.first("unit").alias("unit"), F.min("vec_id").alias("smallest"), F.count("*").alias("copies"))
    kinds = write_once(kinds.withColumn("kind", F.monotonically_increasing_id()), "kinds")
    n = kinds.count()
    lines, tail, window = plan(n, least)
    far = lines * 2 * float(_above(tail))  # lines on which a vector is far out
    entries = filed(kinds, width, lines, tail, max(1, round(n * far * far / 2 / FILED)))
    links = write_once(verified(collisions(entries, window), kinds, width, least), "links")
    degree = links.select(F.col("a").alias("kind"), F.col("copies_b").alias("n")).union(links.select("b", "copies_a")).groupBy("kind").agg(F.sum("n").alias("others"))
    roots = connected_components(links.select("a", "b"), "vectors").withColumnRenamed("node", "kind")
    placed = write_once(kinds.select("kind", "key", "smallest", "copies").join(degree, "kind", "left").join(roots, "kind", "left")
                        .select("key", "smallest", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "kind").alias("root")), "placed-kinds")
    named = write_once(placed.groupBy("root").agg(F.min("smallest").alias("component_id")), "vector-components")
    of = write_once(placed.join(named, "root").select("key", "n_links", "component_id"), "vector-kinds")
    out = rows.select("vec_id", "key").join(of, "key", "left")
    component = F.when(F.col("key").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"),
                      F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"))
