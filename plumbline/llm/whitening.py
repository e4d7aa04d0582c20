"""Whitening of embeddings by a bidiagonal qd solver.

Rows are centred and reduced to one triangle R by QR, block by block and then triangle by triangle, so the covariance is never formed. On the
driver, whose work depends on the number of dimensions alone, Householder reflections make R bidiagonal, dqds finds its singular values with high relative accuracy, and
twisted factorisations of the bidiagonal give the directions.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from ..session import write_once

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: More dimensions are refused: a triangle of R is held by a task and by the driver.
MOST_DIMENSIONS = 2048
#: Entries beyond this (either way) count as this.
MOST_ENTRY = 1 << 50
#: So many triangles are reduced to one at a time; so many rows form a block.
FAN, BLOCK = 16, 4096
EPS = float(np.finfo(float).eps)


# --- the solver -----------------------------------------------------------------------------------------------------------

def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Diagonal, superdiagonal and right reflections v (rows: original dimensions) with r = u b v.T for an orthogonal u."""
    a, n = r.astype(float).copy(), r.shape[1]
    if len(a) < n:
        a = np.vstack([a, np.zeros((n - len(a), n))])
    v = np.eye(n)

    def reflection(x: np.ndarray) -> tuple[np.ndarray, float]:
        size = np.linalg.norm(x)
        h = x.copy()
        if size:
            h[0] += math.copysign(size, x[0])
            h /= np.linalg.norm(h)
        return h, size

    for i in range(n):
        h, size = reflection(a[i:, i])
        if size:
            a[i:, i:] -= 2 * np.outer(h, h @ a[i:, i:])
        if i < n - 2:
            h, size = reflection(a[i, i + 1:])
            if size:
                a[i:, i + 1:] -= 2 * np.outer(a[i:, i + 1:] @ h, h)
                v[:, i + 1:] -= 2 * np.outer(v[:, i + 1:] @ h, h)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(diagonal: np.ndarray, above: np.ndarray) -> np.ndarray:
    """Squared singular values of an upper bidiagonal matrix, in falling order, by the differential quotient-difference algorithm with shifts."""
    q, e = [float(x) ** 2 for x in diagonal], [float(x) ** 2 for x in above]
    found: list[float] = []
    parts = [(q, e, 0.0)]
    while parts:
        q, e, sigma = parts.pop()
        n = len(q)
        while n:
            if n == 1:
                found.append(q[0] + sigma)
                break
            # a negligible entry cuts the matrix in two
            tiny = EPS * EPS
            cut = next((i for i in range(n - 2, -1, -1) if e[i] <= tiny * (sigma + q[i]) or e[i] <= tiny * (sigma + q[i + 1]) or e[i] < 1e-300), None)
            if cut is not None:
                e[cut] = 0.0
                parts.append((q[:cut + 1], e[:cut], sigma))
                q, e = q[cut + 1:n], e[cut + 1:n - 1]
                n = len(q)
                continue
            if n == 2:
                found += [x + sigma for x in two(q[0], e[0], q[1])]
                break
            # a shift from the lower corner, smaller ones if it was beyond the least value
            shift = min(two(q[n - 2], e[n - 2], q[n - 1])) * 0.999 if n > 2 else 0.0
            if e[n - 2] > q[n - 1]:
                shift *= 0.5
            for attempt in (shift, shift / 4, shift / 64, 0.0):
                new = dqds_step(q, e, attempt)
                if new is not None:
                    q, e = new
                    sigma += attempt
                    break
    return np.array(sorted(found, reverse=True))


def two(a: float, e: float, b: float) -> tuple[float, float]:
    """Both eigenvalues of the two-by-two matrix of q1, e, q2."""
    trace, product = a + b + e, a * b
    big = (trace + math.sqrt(max(0.0, (a - b + e) ** 2 + 4 * b * e))) / 2
    return big, (product / big if big else 0.0)


def dqds_step(q: list[float], e: list[float], shift: float) -> tuple[list[float], list[float]] | None:
    """One transform; None if the shift was too large."""
    n, out_q, out_e = len(q), [0.0] * len(q), [0.0] * len(e)
    d = q[0] - shift
    if d < 0:
        return None
    for i in range(n - 1):
        out_q[i] = d + e[i]
        t = q[i + 1] / out_q[i] if out_q[i] else 0.0
        out_e[i] = e[i] * t
        d = d * t - shift if out_q[i] else q[i + 1] - shift
        if d < 0:
            if shift == 0.0 or d > -1e-300:
                d = 0.0
            else:
                return None
    out_q[n - 1] = d
    return out_q, out_e


def twisted(diagonal: np.ndarray, above: np.ndarray, value: float, right: np.ndarray | None = None) -> np.ndarray:
    """An eigenvector of b.T b for the eigenvalue ``value``: the stationary transform from above and the progressive one from below meet where their gap is least, and
    the vector grows from there both ways. With ``right``, a solution of (b.T b - value) x = right by the same two transforms instead."""
    n = len(diagonal)
    d, low = diagonal ** 2, np.append(above / diagonal[:-1], 0.0)
    # b.T b = L D L.T with D = d and the subdiagonal of L = above / diagonal
    floor = EPS * EPS * max(float(np.max(d)), 1e-300)
    fix = lambda x: x if abs(x) > floor else math.copysign(floor, x)
    s, up = np.empty(n), np.empty(n)
    plus, ls = np.empty(n), np.zeros(n)
    s[0] = -value
    for i in range(n - 1):
        plus[i] = fix(s[i] + d[i])
        ls[i] = d[i] * low[i] / plus[i]
        s[i + 1] = ls[i] * low[i] * s[i] - value
    plus[n - 1] = fix(s[n - 1] + d[n - 1])
    p, minus, us = np.empty(n), np.empty(n), np.zeros(n)
    p[n - 1] = d[n - 1] - value
    for i in range(n - 2, -1, -1):
        minus[i] = fix(d[i] * low[i] * low[i] + p[i + 1])
        t = d[i] / minus[i]
        us[i] = low[i] * t
        p[i] = p[i + 1] * t - value
    gap = s + p + value
    r = int(np.argmin(np.abs(gap)))
    x = np.zeros(n)
    if right is None:
        x[r] = 1.0
    else:
        # N y = right, D z = y, N.T x = z with the twist at r
        y = right.copy()
        for i in range(r):
            y[i + 1] -= ls[i] * y[i] if i + 1 < r else 0.0
        for i in range(n - 2, r, -1):
            y[i] -= us[i] * y[i + 1]
        y[r] = right[r] - (ls[r - 1] * y[r - 1] if r else 0.0) - (us[r] * y[r + 1] if r < n - 1 else 0.0)
        z = np.empty(n)
        z[:r] = y[:r] / plus[:r]
        z[r + 1:] = y[r + 1:] / minus[r:n - 1]
        z[r] = y[r] / fix(gap[r])
        x = z
    for i in range(r - 1, -1, -1):
        x[i] = (0.0 if right is None else x[i]) - ls[i] * x[i + 1]
    for i in range(r, n - 1):
        x[i + 1] = (0.0 if right is None else x[i + 1]) - us[i] * x[i]
    size = np.linalg.norm(x)
    return x / size if size and np.isfinite(size) else np.eye(n)[r]


def directions(r: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest squared singular values of r that differ from zero, and their right directions (columns)."""
    diagonal, above, v = bidiagonalise(r)
    n = len(diagonal)
    scale = max(float(np.max(np.abs(r))) if r.size else 0.0, 1e-300)
    diagonal, above = diagonal / scale, above / scale
    top = float(np.max(np.hypot(diagonal, np.append(np.abs(above), 0.0)))) if n else 0.0
    # blocks between negligible entries are problems of their own, so equal values of different blocks keep orthogonal directions
    edges = [0, *[i + 1 for i in range(n - 1) if abs(above[i]) <= EPS * (abs(diagonal[i]) + abs(diagonal[i + 1])) or abs(above[i]) < EPS * top * 1e-3], n]
    pairs = []
    for a, b in zip(edges, edges[1:]):
        d = diagonal[a:b].copy()
        # twisted factorisations divide by the diagonal
        d[np.abs(d) < EPS * EPS * top] = EPS * EPS * top
        e = above[a:b - 1]
        done: list[tuple[float, np.ndarray]] = []
        for value in dqds(d, e) if b - a > 1 else d ** 2:
            if value <= (n * EPS * top) ** 2:
                break
            if len(done) == most:
                break
            x = twisted(d, e, value) if b - a > 1 else np.ones(1)
            close = [y for w, y in done if w - value <= 1e-3 * w]
            if close:
                # values close to each other: solve again from a fixed random start, orthogonal to those before
                basis, start = np.stack(close, 1), np.random.default_rng(len(done)).standard_normal(b - a)
                if np.max(np.abs(basis.T @ x)) > 0.5:
                    x = start
                for _ in range(4):
                    x -= basis @ (basis.T @ x)
                    x = twisted(d, e, value, x / np.linalg.norm(x))
                    for _ in range(2):
                        x -= basis @ (basis.T @ x)
                        x /= np.linalg.norm(x)
            done.append((float(value), x))
        for value, x in done:
            whole = np.zeros(n)
            whole[a:b] = x
            pairs.append((value, a, whole))
    pairs = sorted(pairs, key=lambda p: (-p[0], p[1]))[:most]
    if not pairs:
        return np.empty(0), np.empty((n, 0))
    out = v @ np.stack([x for _, _, x in pairs], 1)
    return np.array([w for w, _, _ in pairs]) * scale * scale, out / np.linalg.norm(out, axis=0)


# --- on Spark -------------------------------------------------------------------------------------------------------------

def whole_entries(vectors: DataFrame, width: int) -> DataFrame:
    """(vec_id, x): entries as whole numbers; rows that are null or hold null or non-finite entries are left out."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            size = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            flat = column.flatten()
            values = flat.to_numpy(zero_copy_only=False).astype(float)
            owner = np.repeat(np.arange(len(column)), size)
            bad = np.zeros(len(column), bool)
            bad[owner[~np.isfinite(values)]] = True
            bad |= ~column.is_valid().to_numpy(zero_copy_only=False)
            c = np.zeros((len(column), width))
            c[owner, np.arange(len(values)) - np.repeat(np.cumsum(size) - size, size)] = np.where(np.isfinite(values), values, 0)
            x = np.clip(np.floor(np.clip(c, -MOST_ENTRY, MOST_ENTRY) * SCALE), -MOST_ENTRY, MOST_ENTRY).astype(np.int64) + SHIFT
            keep = np.flatnonzero(~bad)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(keep) + 1, dtype=np.int32) * width), pa.array(x[keep].ravel()))
            yield pa.RecordBatch.from_arrays([batch.column("vec_id").take(pa.array(keep)), lists], names=["vec_id", "x"])

    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    return rows.mapInArrow(mark, "vec_id bigint, x array<bigint>")


def matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def sums(rows: DataFrame, width: int) -> tuple[int, list[int]]:
    """How many rows, and the exact sum of every dimension; a row of sums per task and dimension is shuffled."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, [0] * width
        for batch in batches:
            for a in range(0, batch.num_rows, 2048):  # 2048 entries of MOST_ENTRY fit a long
                x = matrix(batch.column("x").slice(a, 2048), width)
                n += len(x)
                total = [t + int(s) for t, s in zip(total, x.sum(0))]
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, width), pa.int32()), pa.array([str(t) for t in (n, *total)])], names=["at", "s"])

    # a row per dimension reaches the driver
    got = {r["at"]: int(r.s) for r in rows.select("x").mapInArrow(add, "at int, s string").groupBy("at").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()}
    return got.get(-1, 0), [got.get(i, 0) for i in range(width)]


def triangle(rows: DataFrame, n: int, total: list[int]) -> np.ndarray:
    """R of the centred rows: one per task, then FAN of them to one until one is left."""
    width = len(total)
    whole, rest = np.array([t // n for t in total], dtype=object).astype(np.int64), np.array([t % n / n for t in total])

    def packed(r: np.ndarray) -> bytes:
        return np.ascontiguousarray(r).tobytes()

    def fold(blocks: Iterator[np.ndarray]) -> np.ndarray:
        r = np.empty((0, width))
        for b in blocks:
            r = np.linalg.qr(np.vstack([r, b]), mode="r")
        return r

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        r = fold((matrix(batch.column("x").slice(a, BLOCK), width) - whole) - rest for batch in batches for a in range(0, batch.num_rows, BLOCK))
        if len(r):
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int64()), pa.array([packed(r)], pa.binary())], names=["task", "r"])

    def merge(key: tuple, group: pa.Table) -> pa.Table:
        parts = group.sort_by("task").column("r").to_pylist()
        r = fold(np.frombuffer(p).reshape(-1, width) for p in parts)
        return pa.table({"task": pa.array([key[0].as_py()], pa.int64()), "r": pa.array([packed(r)], pa.binary())})

    left = write_once(rows.select("x").mapInArrow(reduce, "task bigint, r binary"), "triangles")
    while left.count() > 1:
        left = write_once(left.groupBy(F.floor(F.col("task") / FAN).alias("_to")).applyInArrow(merge, "task bigint, r binary"), "triangles")
    return np.frombuffer(left.first().r).reshape(-1, width)


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for every row that is kept, and every component up to ``components``.

    ``vectors`` has vec_id and embedding. Null vectors and those with null or non-finite entries are left out; shorter vectors, and empty ones, are filled up with zeros; entries too large for whole
    numbers count as the largest ones; rows without an id and repeated rows are rows like any other; components without variance don't exist, so a single vector, or equal ones, give no rows;
    directions of equal variances are any orthogonal ones, the same for all rows; deviation is decimal(38,0), null beyond that; other columns are not read; no rows, no rows.
    """
    schema = "vec_id bigint, deviation decimal(38,0), w array<double>"
    final = "vec_id bigint, component int, n bigint, deviation decimal(38,0), whitened double, explained double, identity_error double"
    spark = vectors.sparkSession
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 0
    if width > MOST_DIMENSIONS:
        raise ValueError(f"{MOST_DIMENSIONS} dimensions at most")
    if width < 1:
        return spark.createDataFrame([], final)
    rows = write_once(whole_entries(vectors, width), "entries")
    n, total = sums(rows, width)
    if not n:
        return spark.createDataFrame([], final)
    r = triangle(rows, n, total)
    squares, way = directions(r, components)
    if not len(squares):
        return spark.createDataFrame([], final)
    whole, rest = np.array([t // n for t in total], dtype=object).astype(np.int64), np.array([t % n / n for t in total])
    by = way * np.sqrt(n / squares)
    most = 10 ** 38

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shift = np.array(total, object)
        for batch in batches:
            for a in range(0, batch.num_rows, BLOCK):
                part = batch.slice(a, BLOCK)
                x = matrix(part.column("x"), width)
                near = n * (max(abs(int(x.max())), abs(int(x.min())))) + max(map(abs, total))
                if near < 1 << 62:
                    far = n * x - shift.astype(np.int64)
                    big = int(np.abs(far).max())
                    squared = (far * far).sum(1).tolist() if width * big * big < 1 << 63 else [sum(v * v for v in f) for f in far.tolist()]
                else:
                    squared = [sum((n * v - t) ** 2 for v, t in zip(f, total)) for f in x.tolist()]
                w = ((x - whole) - rest) @ by
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1]), pa.array(w.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([s if s < most else None for s in squared], pa.decimal128(38, 0)), lists], names=["vec_id", "deviation", "w"])

    out = write_once(rows.mapInArrow(project, schema), "whitened")
    k = len(squares)
    means = out.agg(*[F.avg(F.col("w")[i]).alias(f"m{i}") for i in range(k)]).first()
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    second = out.agg(*[F.avg((F.col("w")[i] - F.lit(means[i])) * (F.col("w")[j] - F.lit(means[j]))).alias(f"c{i}_{j}") for i, j in pairs]).first()
    error = max(abs(second[p] - (i == j)) for p, (i, j) in enumerate(pairs))
    share = (squares / float(np.sum(r * r))).tolist()
    return out.select("vec_id", "deviation", F.posexplode("w").alias("i", "whitened")).select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("bigint").alias("n"), "deviation", "whitened",
        F.element_at(F.array(*map(F.lit, share)), F.col("i") + 1).alias("explained"), F.lit(float(error)).alias("identity_error"))


def digest(found: DataFrame) -> DataFrame:
    """deviation as a long, null where it does not fit one."""
    return found.withColumn("deviation", F.col("deviation").try_cast("bigint"))
