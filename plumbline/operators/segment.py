"""Segmentation of entities: aggregate, scale, sweep k against a null model,
fit, profile and compare. "No structure" is one of the possible answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import VectorAssembler
from pyspark import inheritable_thread_target
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exact_round, fixed, safe_ratio
from ..session import cut_lineage, write_once
from .selection import quantiles
from .windows import surrogate_key

AGGREGATES = {
    # an all-null sum is 0; a null in the data is skipped by every function
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg, "count": F.count, "median": F.median, "min": F.min, "max": F.max, "nunique": F.countDistinct,
}


class NotAllowed(ValueError):
    """A precondition of the segmentation does not hold."""


# --- entities and features -----------------------------------------------------------------
def to_entities(df: DataFrame, by: Sequence[str], metrics: Mapping[str, str], min_rows: int = 0) -> DataFrame:
    """One row per entity with ``<column>_<function>`` metrics and the number of
    source rows; entities with fewer than ``min_rows`` are left out."""
    bad = sorted(set(metrics.values()) - set(AGGREGATES))
    if bad:
        raise NotAllowed(f"functions {bad} are not available; use {sorted(AGGREGATES)}")
    names = [f"{c}_{fn}" for c, fn in metrics.items()]
    aggs = [AGGREGATES[fn](c).alias(f"{c}_{fn}") for c, fn in metrics.items() if fn != "median"]
    medians = {f"{c}_{fn}": (c, 0.5) for c, fn in metrics.items() if fn == "median"}
    if medians:
        df = write_once(df.select(*by, *metrics), "metrics")
    out = df.groupBy(*by).agg(*aggs, F.count(F.lit(1)).alias("_n_source_rows"))
    if medians:
        # an aggregate of its own would hold a group's values in one task
        mid = quantiles(df, by, medians).select(*[F.col(b).alias(f"_by{i}") for i, b in enumerate(by)], *medians)
        same = F.lit(True)
        for i, b in enumerate(by):
            same = same & F.col(b).eqNullSafe(F.col(f"_by{i}"))
        out = out.join(mid, same)
    out = out.select(*by, *names, "_n_source_rows")
    return out.filter(F.col("_n_source_rows") >= min_rows) if min_rows > 0 else out


def entity_name(by: Sequence[str]) -> Column:
    """One text per entity; different keys have different names, also those with missing parts or bars."""
    def part(c: str) -> Column:
        return F.coalesce(F.regexp_replace(F.col(c).cast("string"), r"([\\|])", r"\\$1"), F.lit("\\N"))
    return F.concat_ws(" | ", *map(part, by))


def dropped_entities(df: DataFrame, by: Sequence[str], min_rows: int) -> DataFrame:
    sizes = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return sizes.agg(F.count_if(F.col("n") < min_rows).alias("dropped_groups"), F.count(F.lit(1)).alias("all_groups"))


def check_features(df: DataFrame, features: Sequence[str]) -> None:
    """Features must exist, be numeric and public, and be at least two."""
    private = [f for f in features if f.startswith("_")]
    if private:
        raise NotAllowed(f"columns {private} are internal and cannot be features")
    if len(features) < fixed.MIN_FEATURES:
        raise NotAllowed(f"give at least {fixed.MIN_FEATURES} features")
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise NotAllowed(f"no columns {missing}")
    types = dict(df.dtypes)
    words = [f for f in features if types[f] in ("string", "boolean", "date", "binary") or types[f].startswith(
        ("timestamp", "array", "map", "struct"))]
    if words:
        raise NotAllowed(f"columns {words} are not numeric")


def check_entities(df: DataFrame) -> int:
    n = df.count()
    if n < fixed.MIN_ENTITIES:
        raise NotAllowed(f"{n} entities are too few; at least {fixed.MIN_ENTITIES} are needed")
    return n


def check_k(k: int, n: int, sweep: DataFrame | None) -> None:
    top = min(fixed.K_MAX, n - 1)
    if not 2 <= k <= top:
        raise NotAllowed(f"k must be between 2 and {top}")
    if sweep is None:
        raise NotAllowed("sweep k first; choosing it blindly is guessing")


def check_scaled(df: DataFrame, features: Sequence[str]) -> None:
    missing = [f for f in features if f"{f}_z" not in df.columns]
    if missing:
        raise NotAllowed(f"scale {missing} first; the widest range would decide alone")


def check_labelled(df: DataFrame, label: str = "cluster") -> None:
    if label not in df.columns:
        raise NotAllowed("fit segments before profiling them")


def check_profiled(profile: DataFrame | None) -> None:
    if profile is None:
        raise NotAllowed("profile the segments before concluding")


def standardize(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Add ``<feature>_z``: mean 0 and population deviation 1. A null feature
    stops the job; a constant feature becomes 0."""
    check_features(df, features)
    stats = df.agg(*[F.avg(F.col(f).cast("double")).alias(f"_m_{f}") for f in features],
                   *[F.stddev_pop(F.col(f).cast("double")).alias(f"_s_{f}") for f in features],
                   *[F.count_if(F.col(f).isNull() | F.isnan(F.col(f).cast("double"))).alias(f"_x_{f}") for f in features])
    row = stats.first()  # one row, three numbers per feature
    holes = [f for f in features if row[f"_x_{f}"]]
    if holes:
        raise NotAllowed(f"features {holes} have missing values; resolve them first")
    return df.withColumns({
        f"{f}_z": (F.col(f).cast("double") - F.lit(row[f"_m_{f}"])) / F.lit(row[f"_s_{f}"] or 1.0) for f in features})


def scaling_report(df: DataFrame, features: Sequence[str]) -> DataFrame:
    """Raw range and scaled mean and deviation of each feature."""
    z = [F.struct(F.lit(f).alias("feature"), exact_round(F.min(f), 2).alias("raw_min"), exact_round(F.max(f), 2).alias("raw_max"),
                  exact_round(F.avg(f"{f}_z"), 6).alias("scaled_mean"), exact_round(F.stddev_pop(f"{f}_z"), 4).alias("scaled_std")
                  ).alias(f) for f in features]
    return df.agg(*z).select(F.explode(F.array(*features)).alias("s")).select("s.*")


# --- silhouette --------------------------------------------------------------------------------
#: Blocks the points are dealt to, unless one would hold more than NUMBERS numbers (32 MB): a point moves once per block, so what moves grows with the points.
BLOCKS, NUMBERS = 24, 1 << 22
#: Rows and columns of distances that are held at once.
TILE = 512, 1024
#: Squared distances below this part of the squared lengths are computed again from differences: a product of matrices has lost their digits.
_CLOSE = 1e-4
_SUMS = "run string, pid string, label long, others array<bigint>, totals array<double>"


def _apart(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of rows that belong together."""
    return np.sqrt(((a - b) ** 2).sum(axis=1))


def _gaps(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of ``a`` to all of ``b``: one product of matrices, and differences where that would not be exact."""
    odd_a, odd_b = (~(np.abs(x).max(axis=1, initial=0) < 1e150) for x in (a, b))  # missing, infinite or too large to be squared
    centre = a[~odd_a].mean(axis=0) if not odd_a.all() else 0.0
    p, q = (np.where(odd[:, None], 0.0, x - centre) for x, odd in ((a, odd_a), (b, odd_b)))
    p_long, q_long = (p * p).sum(axis=1), (q * q).sum(axis=1)
    gap = p @ (-2.0 * q).T
    gap += p_long[:, None]
    gap += q_long
    i = j = np.empty(0, int)
    if odd_a.any() or odd_b.any() or gap.min() <= _CLOSE * (p_long.max() + q_long.max()):
        i, j = np.nonzero((gap <= _CLOSE * (p_long[:, None] + q_long)) | odd_a[:, None] | odd_b)
        np.maximum(gap, 0.0, out=gap)
    np.sqrt(gap, out=gap)
    for s in range(0, len(i), 16_384):
        k, m = i[s:s + 16_384], j[s:s + 16_384]
        gap[k, m] = _apart(a[k], b[m])
    return gap


def _block_sums(points: pa.Table) -> pa.Table:
    """Distance sums from every point of two blocks (or of one) to every label of the other one."""
    points = points.combine_chunks()
    x = points["x"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(points.num_rows, -1)
    label, own = points["label"].combine_chunks(), points["own"].to_numpy()
    label = np.ma.array(label.fill_null(0).to_numpy(), mask=label.is_null().to_numpy(zero_copy_only=False))
    one, other = points["i"][0].as_py(), points["j"][0].as_py()

    def side(block: int) -> tuple[np.ndarray, np.ndarray, int]:
        """Rows of a block by label, those without one last; its labels, and how many rows have one."""
        rows = np.flatnonzero(own == block)
        rows = rows[np.lexsort((label.data[rows], label.mask[rows]))]
        named = label.data[rows[~label.mask[rows]]]
        return rows, np.unique(named), len(named)

    def labelled(rows: np.ndarray, totals: np.ndarray, labels: np.ndarray, unknown: np.ndarray) -> pa.Table:
        n, m = len(rows), len(labels)
        others = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(np.tile(labels, n)))
        sums = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * m), pa.array(totals.ravel(), mask=np.repeat(unknown, m)))
        return points.select(["run", "pid", "label"]).take(pa.array(rows)).append_column("others", others).append_column("totals", sums)

    (a, a_labels, a_named), (b, b_labels, b_named) = side(one), side(other)
    to_b, to_a = np.zeros((len(a), len(b_labels))), np.zeros((len(b), len(a_labels)))
    a_code, b_code = np.searchsorted(a_labels, label.data[a[:a_named]]), np.searchsorted(b_labels, label.data[b[:b_named]])
    # a point with a distance that is no number has no sums over that block
    odd, unknown_a, unknown_b = not (np.abs(x) < 1e150).all(), np.zeros(len(a), bool), np.zeros(len(b), bool)
    for r in range(0, len(a), TILE[0]):
        for c in range(0, len(b), TILE[1]):
            gap = _gaps(x[a[r:r + TILE[0]]], x[b[c:c + TILE[1]]])
            if odd:
                unknown_a[r:r + TILE[0]] |= ~np.isfinite(gap).all(axis=1)
                unknown_b[c:c + TILE[1]] |= ~np.isfinite(gap).all(axis=0)
            codes = b_code[c:c + TILE[1]]
            if len(codes):
                edge = np.flatnonzero(np.diff(codes, prepend=-1))
                to_b[r:r + TILE[0], codes[edge]] += np.add.reduceat(gap[:, :len(codes)], edge, axis=1)
            codes = a_code[r:r + TILE[0]]
            if one != other and len(codes):
                edge = np.flatnonzero(np.diff(codes, prepend=-1))
                to_a[c:c + TILE[1], codes[edge]] += np.stack([gap[s:e].sum(axis=0) for s, e in zip(edge, [*edge[1:], len(codes)])], axis=1)
    found = labelled(a, to_b, b_labels, unknown_a)
    return found if one == other else pa.concat_tables([found, labelled(b, to_a, a_labels, unknown_b)])


def _blocks(rows: int, dims: int, block: int) -> int:
    """Into how many blocks points are dealt."""
    return max(1, min(-(-rows // block), BLOCKS), -(-rows * dims // NUMBERS))


def silhouette_points(df: DataFrame, features: Sequence[str], label: str, key: str, run: str | None = None,
                      block: int = 1500, largest: int | None = None) -> DataFrame:
    """Exact Euclidean silhouette of every row, for one labelling or for several
    runs at once.

    Points are dealt by the hash of their key into blocks of at least about ``block``, at most BLOCKS of them as long as
    a block fits a task, and every pair of blocks is one task that returns only distance sums per point
    and label, for both sides. Memory per task is bounded, no pair of points is ever a row, and
    nothing is sampled.
    """
    x = F.array(*[F.col(f).cast("double") for f in features])
    points = df.select((F.col(run) if run else F.lit("")).cast("string").alias("run"),
                       F.col(key).cast("string").alias("pid"), F.col(label).cast("long").alias("label"), x.alias("x"))
    if largest is None:  # rows of the largest run
        largest = points.groupBy("run").count().agg(F.max("count")).first()[0] or 0
    blocks = _blocks(largest, len(features), block)
    dealt = points.withColumn("own", F.pmod(F.xxhash64("pid"), F.lit(blocks)).cast("int"))
    dealt = dealt.withColumn("_k", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = dealt.select("run", "pid", "label", "x", "own", F.least("own", "_k").alias("i"), F.greatest("own", "_k").alias("j"))
    keys = ["run", "i", "j"]
    if blocks > 1:  # pairs of blocks are few and long, so none waits for another
        dealt = dealt.repartition(blocks * (blocks + 1) // 2, *keys)
    # what is said of one point meets as arrays
    sums = dealt.groupBy(*keys).applyInArrow(_block_sums, _SUMS).repartition("run", "pid")
    sums = sums.select("run", "pid", "label", F.explode(F.arrays_zip("others", "totals")).alias("s")).select("run", "pid", "label", F.col("s.others").alias("other"), F.col("s.totals").alias("total"))
    sizes = points.groupBy("run", F.col("label").alias("other")).agg(F.count(F.lit(1)).alias("size"))
    to_label = sums.groupBy("run", "pid", "label", "other").agg(F.sum("total").alias("total")).join(sizes, ["run", "other"])
    own = F.col("other") == F.col("label")
    per_point = to_label.groupBy("run", "pid", "label").agg(
        F.max(F.when(own, F.col("size"))).alias("n_own"),
        F.max(F.when(own & (F.col("size") > 1), F.col("total") / (F.col("size") - 1))).alias("a"),
        F.min(F.when(~own, F.col("total") / F.col("size"))).alias("b"))
    s = F.when(F.col("n_own") <= 1, F.lit(0.0)).otherwise(
        F.coalesce(F.try_divide(F.col("b") - F.col("a"), F.greatest("a", "b")), F.lit(0.0)))
    return per_point.select("run", "pid", "label", s.alias("silhouette"))


def silhouette(df: DataFrame, features: Sequence[str], label: str, key: str, run: str | None = None, **kw) -> DataFrame:
    points = silhouette_points(df, features, label, key, run, **kw)
    return points.groupBy("run").agg(F.count(F.lit(1)).alias("n"), F.avg("silhouette").alias("silhouette"))


# --- null model --------------------------------------------------------------------------------
def _mixed(x: np.ndarray, key: int) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all, differently for every key."""
    x = x + np.uint64(key)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def permuted_ids(ids: np.ndarray, n: int, keys: Sequence[int]) -> np.ndarray:
    """A permutation of 0..n-1 by formula: a Feistel network over pairs (a, b) of a square just large enough, one round per key; a number that leaves 0..n-1 is
    sent through again until it is back, which keeps it a permutation."""
    side = np.uint64(math.isqrt(max(n - 1, 0)) + 1)
    out = ids.astype(np.uint64)
    left = np.arange(len(out))
    while len(left):
        a, b = out[left] // side, out[left] % side
        for key in keys:
            a, b = b, (a + _mixed(b, key)) % side
        out[left] = a * side + b
        left = left[out[left] >= np.uint64(n)]
    return out.astype(np.int64)


def _place(n: int, keys: Sequence[int]):
    @F.pandas_udf("long")
    def place(ids: pd.Series) -> pd.Series:
        return pd.Series(permuted_ids(ids.to_numpy(), n, keys))

    return place


def permute_columns(df: DataFrame, cols: Sequence[str], key: str, seed: int, rounds: int = 4) -> DataFrame:
    """Shuffle every column on its own: single distributions stay, anything
    between columns is destroyed. The same seed gives the same result whatever
    the partitioning. Rows are numbered once; each column is then one join, from a row to the row a formula names."""
    rows = write_once(surrogate_key(df.select(key, *cols), [key, *cols], "_id"), "numbered")
    n = rows.count()
    out = rows.select(key, (F.col("_id") - 1).alias("_id"))
    for i, c in enumerate(cols):
        keys = [int(k) for k in np.random.default_rng([seed, i]).integers(0, 1 << 63, rounds)]

        donor = rows.select((F.col("_id") - 1).alias("_from"), F.col(c))
        out = out.withColumn("_from", _place(n, keys)("_id")).join(donor, "_from").drop("_from")
    return out.drop("_id")


# --- sweep and fit -----------------------------------------------------------------------------
STARTS, MOST_ITERATIONS = 10, 300


def _best_fits(frames: Mapping[str, DataFrame], ks: Sequence[int], starts: int, seed: int, most: int = MOST_ITERATIONS) -> dict:
    """The cheapest of ``starts`` fits for every frame and k. Fits are independent jobs, so as many run at
    once as there are cores; each runs to tolerance, and one that does not get there stops the work."""
    def fit(job: tuple[str, int, int]):
        name, k, start = job
        model = KMeans(k=k, seed=seed + 101 * start, maxIter=most, predictionCol="cluster").fit(frames[name])
        if model.summary.numIter >= most:
            raise RuntimeError(f"k-means with k={k} did not converge in {most} iterations")
        return (name, k), model.summary.trainingCost, start, model

    jobs = [(name, k, start) for name in frames for k in ks for start in range(starts)]
    spark = next(iter(frames.values())).sparkSession
    best: dict = {}
    with ThreadPoolExecutor(max_workers=max(2, spark.sparkContext.defaultParallelism)) as pool:
        for run, cost, start, model in pool.map(inheritable_thread_target(spark)(fit), jobs):
            if run not in best or (cost, start) < best[run][:2]:
                best[run] = (cost, start, model)
    return {run: model for run, (_, _, model) in best.items()}


def _distances(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    return np.maximum((x**2).sum(1)[:, None] - 2 * x @ centres.T + (centres**2).sum(1)[None, :], 0)


#: Seeding: passes over the points, and points picked in each for every source, as a multiple of the largest k.
PASSES, OVERSAMPLED = 4, 4


def _seed_centres(points: np.ndarray, weight: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """k-means++ over weighted points."""
    centres = points[[rng.choice(len(points), p=weight / weight.sum())]]
    while len(centres) < k:
        d = _distances(points, centres).min(1) * weight
        p = d / d.sum() if d.sum() > 0 else None
        centres = np.vstack([centres, points[rng.choice(len(points), p=p)]])
    return centres


def oversampled(points: DataFrame, k: int, seed: int) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """Candidates for the starts of every source, and how many points are nearest to each (k-means||).

    Each pass sees all points and picks some by their squared distance to those picked before (the first pass evenly): every
    point draws an exponential number divided by its distance, and the smallest stay, those of a task first and then of all. So a group far from the rest is picked
    from whatever its size. The driver gets PASSES * OVERSAMPLED * k points of a source and their counts, whatever the data."""
    want = OVERSAMPLED * k
    found: dict[str, np.ndarray] = {}

    def pick(turn: int, found: dict[str, np.ndarray]):
        def look(batches):
            best: dict[str, pd.DataFrame] = {}
            for pdf in batches:
                for source, group in pdf.groupby("source"):
                    d = _distances(np.stack(group["x"].to_numpy()), found[source]).min(1) if source in found else np.ones(len(group))
                    h = pd.util.hash_array(group["pid"].to_numpy().astype(object), hash_key=f"{(seed * 1_000 + turn) % 10 ** 16:016d}")
                    # at no distance from a picked point there is nothing to pick but rounding
                    draw = np.where(d > 1e-12, -np.log((h + 0.5) / 2.0 ** 64) / np.maximum(d, 1e-300), np.inf)
                    rows = group[["source", "pid", "x"]].assign(draw=draw)
                    best[source] = pd.concat([best[source], rows] if source in best else [rows]).query("draw < inf").nsmallest(want, "draw")
            yield from (b[["source", "draw", "pid", "x"]] for b in best.values())
        return look

    for turn in range(PASSES):
        drawn = points.mapInPandas(pick(turn, found), "source string, draw double, pid string, x array<double>")
        order = F.row_number().over(Window.partitionBy("source").orderBy("draw", "pid"))
        new: dict[str, list] = {}
        for row in drawn.withColumn("_r", order).filter(F.col("_r") <= want).orderBy("source", "_r").select("source", "x").collect():
            new.setdefault(row["source"], []).append(row["x"])
        found = {s: np.array([*found.get(s, []), *new.get(s, [])]) for s in {*found, *new}}

    def nearest(batches):
        n = {s: np.zeros(len(c)) for s, c in found.items()}
        for pdf in batches:
            for source, group in pdf.groupby("source"):
                n[source] += np.bincount(_distances(np.stack(group["x"].to_numpy()), found[source]).argmin(1), minlength=len(found[source]))
        yield pd.DataFrame([(s, i, v) for s, c in n.items() for i, v in enumerate(c) if v], columns=["source", "at", "n"])

    weight = {s: np.zeros(len(c)) for s, c in found.items()}
    for row in points.mapInPandas(nearest, "source string, at long, n double").groupBy("source", "at").agg(F.sum("n").alias("n")).collect():
        weight[row["source"]][row["at"]] = row["n"]
    return {s: (c, weight[s]) for s, c in found.items()}


def _lloyd(points: DataFrame, centres: dict[tuple, np.ndarray], max_iter: int, tol: float = 1e-4):
    """Lloyd iterations of many runs in one pass over the data per iteration.

    ``points`` has source and vector; a run is (source, k, start). What travels is
    one row per task, run and cluster: the count, the cost and the coordinate sums."""
    dims = next(iter(centres.values())).shape[1]
    coords = [f"s{j}" for j in range(dims)]
    schema = "source string, k long, start long, cluster long, n double, cost double, " + ", ".join(f"{c} double" for c in coords)

    def one_pass(active: dict[tuple, np.ndarray]):
        def partial(batches):
            sums: dict[tuple, np.ndarray] = {}
            for pdf in batches:
                for source, group in pdf.groupby("source"):
                    x = np.stack(group["x"].to_numpy())
                    for run, c in active.items():
                        if run[0] != source:
                            continue
                        d = _distances(x, c)
                        label = d.argmin(1)
                        member = np.eye(len(c))[label]
                        row = np.column_stack([member.sum(0), member.T @ d.min(1), member.T @ x])
                        sums[run] = sums.get(run, 0) + row
            if sums:
                names = pd.DataFrame([(*run, c) for run, m in sums.items() for c in range(len(m))],
                                     columns=["source", "k", "start", "cluster"])
                yield names.join(pd.DataFrame(np.vstack(list(sums.values())), columns=["n", "cost", *coords]))

        totals = points.mapInPandas(partial, schema).groupBy("source", "k", "start", "cluster").agg(
            *[F.sum(c).alias(c) for c in ("n", "cost", *coords)])
        found: dict[tuple, dict] = {}
        for t in totals.collect():  # runs x k rows, whatever the data
            found.setdefault((t["source"], t["k"], t["start"]), {})[t["cluster"]] = t
        return found

    centres, active = dict(centres), dict(centres)
    cost: dict[tuple, float] = {}
    smallest: dict[tuple, float] = {}
    for i in range(max_iter + 1):
        if i == max_iter and active:
            raise RuntimeError(f"{len(active)} fits did not converge in {max_iter} iterations")
        for run, rows in one_pass(active).items():
            cost[run] = sum(t["cost"] for t in rows.values())
            smallest[run] = min(t["n"] for t in rows.values())
            moved = centres[run].copy()
            for c, t in rows.items():
                if t["n"] > 0:
                    moved[c] = [t[s] / t["n"] for s in coords]
            if np.abs(moved - centres[run]).max() < tol:
                active.pop(run)
            else:
                centres[run] = active[run] = moved
        if not active:
            break
    return centres, cost, smallest


def sweep_models(df: DataFrame, features: Sequence[str], key: str, k_min: int = 2, k_max: int = 8, n_null: int = 5,
                 seed: int = 42, starts: int = STARTS) -> tuple[DataFrame, dict[int, np.ndarray]]:
    """Inertia, silhouette, null silhouette, gap and smallest cluster per k, and the winning centres of each k.

    ``features`` are the scaled columns. Real data and null models form one cached frame; all k, nulls
    and starts are fitted together, one pass per iteration, until every one has converged, and one more job
    scores the best labelling of each. Starts are seeded by k-means++ on weighted candidates that passes over all points pick (``oversampled``). (One library fit per source, k
    and start costs 420 times some 25 jobs for the default sweep, several times as long.)"""
    spark = df.sparkSession
    real = cut_lineage(df.select(key, *features))
    n = check_entities(real)
    ks = range(k_min, min(k_max, n - 1) + 1)
    x = F.array(*[F.col(f).cast("double") for f in features]).alias("x")
    sources = [real.select(F.lit("real").alias("source"), F.col(key).cast("string").alias("pid"), x)]
    for p in range(n_null):
        mixed = permute_columns(real, features, key, seed + p)
        sources.append(mixed.select(F.lit(f"null{p}").alias("source"), F.col(key).cast("string").alias("pid"), x))
    points = sources[0]
    for more in sources[1:]:
        points = points.unionByName(more)
    # a few thousand points to a task, but no more tasks than are worth their start
    slices = max(1, min(spark.sparkContext.defaultParallelism, n // 2_000), n // 50_000)
    points = write_once(points.repartition("source", F.pmod(F.xxhash64("pid"), F.lit(slices))), "points").persist()
    try:
        sample = oversampled(points, max(ks), seed)
        rng = np.random.default_rng(seed)
        first = {(source, k, s): _seed_centres(*sample[source], k, rng) for source in sorted(sample) for k in ks for s in range(starts)}
        centres, cost, smallest = _lloyd(points, first, MOST_ITERATIONS)
        best = {(source, k): min(((source, k, s) for s in range(starts)), key=cost.get) for source in sample for k in ks}
        chosen = {run: centres[run] for run in best.values()}

        def label(batches):
            for pdf in batches:
                for source, group in pdf.groupby("source"):
                    vectors = np.stack(group["x"].to_numpy())
                    for run, c in chosen.items():
                        if run[0] == source:
                            yield pd.DataFrame({"run": f"{source}|{run[1]}", "pid": group["pid"], "x": group["x"],
                                                "cluster": _distances(vectors, c).argmin(1)})

        labelled = write_once(points.mapInPandas(label, "run string, pid string, x array<double>, cluster long").select(
            "run", "pid", "cluster", *[F.col("x")[i].alias(f) for i, f in enumerate(features)]), "labelled")
    finally:
        points.unpersist()
    scores = silhouette(labelled, features, "cluster", "pid", "run", largest=n)
    parts = F.split("run", r"\|")
    both = scores.select(parts[1].cast("int").alias("k"), parts[0].alias("source"), "silhouette").groupBy("k").agg(
        F.max(F.when(F.col("source") == "real", F.col("silhouette"))).alias("s"),
        F.avg(F.when(F.col("source") != "real", F.col("silhouette"))).alias("s0"))
    facts = [(k, float(cost[best["real", k]]), 100.0 * smallest[best["real", k]] / n) for k in ks]
    sizes = spark.createDataFrame(facts, "k int, inertia double, smallest double")
    table = both.join(sizes, "k").select(
        "k", exact_round("inertia", 2).alias("inertia"), exact_round("s", 4).alias("silhouette"),
        exact_round("s0", 4).alias("silhouette_null"), exact_round(F.col("s") - F.col("s0"), 4).alias("gap_vs_null"),
        exact_round("smallest", 1).alias("smallest_cluster_pct"))
    return table, {k: centres[best["real", k]] for k in ks}


def sweep_k(df: DataFrame, features: Sequence[str], key: str, **kw) -> DataFrame:
    """The table of ``sweep_models``."""
    return sweep_models(df, features, key, **kw)[0]


def structure_verdict(sweep: DataFrame) -> DataFrame:
    """Is there any structure (gap), and if so how many groups (silhouette)?
    Among equal silhouettes the smaller k wins."""
    best = F.max_by("k", F.struct("silhouette", (-F.col("k")).alias("nk")))
    gap = F.col("max_gap_vs_null")
    return sweep.agg(best.alias("best_k"), F.max("silhouette").alias("best_silhouette"),
                     F.max("gap_vs_null").alias("max_gap_vs_null")).withColumn(
        "structure", F.when(gap < fixed.GAP_NONE, "ninguna").when(gap < fixed.GAP_CLEAR, "marginal").otherwise("clara")
    ).withColumn("structure_found", F.col("structure") == "clara")


def label_segments(df: DataFrame, features: Sequence[str], centres: Sequence[Sequence[float]]) -> DataFrame:
    """Every row with the nearest of ``centres``. Clusters are numbered by the first feature of their
    centre, so that numbers mean the same on every run."""
    ordered = sorted(tuple(map(float, c)) for c in centres)
    gap = [sum(((F.col(f).cast("double") - F.lit(v)) ** 2 for f, v in zip(features, c)), F.lit(0.0)) for c in ordered]
    near = F.array(*gap)
    return df.withColumn("cluster", (F.array_position(near, F.array_min(near)) - 1).cast("int"))


def fit_segments(df: DataFrame, features: Sequence[str], k: int, seed: int = 42, starts: int = STARTS) -> DataFrame:
    """The best of ``starts`` fits with k clusters, as labels."""
    train = VectorAssembler(inputCols=list(features), outputCol="features", handleInvalid="error").transform(df).select("features").persist()
    try:
        model = _best_fits({"": train}, [k], starts, seed)["", k]
    finally:
        train.unpersist()
    return label_segments(df, features, model.clusterCenters())


# --- profile -------------------------------------------------------------------------------------
def segment_means(df: DataFrame, features: Sequence[str], label: str = "cluster") -> DataFrame:
    """Feature means, size and share of entities of each segment."""
    check_labelled(df, label)
    grouped = write_once(df.groupBy(label).agg(*[exact_round(F.avg(f), 3).alias(f) for f in features],
                                               F.count(F.lit(1)).alias("n_entities")), "segment-means")
    total = grouped.agg(F.sum("n_entities").alias("n")).scalar()
    return grouped.withColumn("pct_of_entities", exact_round(safe_ratio("n_entities", total, 100), 1))


def value_concentration(df: DataFrame, value: str, label: str = "cluster") -> DataFrame:
    """Share of value against share of entities. Both shares are rounded before
    they are divided, as they are shown."""
    check_labelled(df, label)
    grouped = write_once(df.groupBy(label).agg(F.sum(value).alias("_v"), F.count(F.lit(1)).alias("_n")), "segment-values")
    whole = grouped.agg(F.sum("_v").cast("double").alias("v")).scalar()
    count = grouped.agg(F.sum("_n").alias("n")).scalar()
    shares = grouped.select(label, exact_round(safe_ratio("_n", count, 100), 1).alias("pct_of_entities"),
                            exact_round(safe_ratio("_v", whole, 100), 1).alias("pct_of_value"))
    return shares.withColumn("concentration_ratio", exact_round(safe_ratio("pct_of_value", "pct_of_entities"), 2))


def segment_examples(df: DataFrame, key: str, n: int = 4, label: str = "cluster") -> DataFrame:
    """The first ``n`` entities of each segment by key."""
    rn = F.row_number().over(Window.partitionBy(label).orderBy(key))
    few = df.select(label, key).withColumn("rn", rn).filter(F.col("rn") <= n)
    return few.groupBy(label).agg(F.array_join(F.array_sort(F.collect_list(F.col(key).cast("string"))), ", ").alias("examples"))


def profile_segments(df: DataFrame, features: Sequence[str], key: str, value: str | None = None, label: str = "cluster"
                     ) -> dict[str, DataFrame]:
    out = {"means": segment_means(df, features, label), "examples": segment_examples(df, key, label=label)}
    if value:
        out["concentration"] = value_concentration(df, value, label)
    return out


def findings(verdict: DataFrame, concentration: DataFrame, label: str = "cluster") -> DataFrame:
    """Named segments with the silhouette of the chosen k. Marginal structure is an operational partition, not a
    discovery; without structure there are no segments to name, and one row says so."""
    ratio = F.col("concentration_ratio")
    name = (F.when(ratio >= fixed.RATIO_HIGH, "value engine").when(ratio <= fixed.RATIO_LOW, "long tail")
            .otherwise("middle block"))
    said = verdict.select("structure", (F.col("structure") != "ninguna").alias("structure_found"), F.col("best_k").alias("chosen_k"), F.col("best_silhouette").alias("silhouette"))
    fact = {c: said.agg(F.first(c).alias(c)).scalar() for c in said.columns}
    named = concentration.withColumns(fact).filter("structure_found").withColumns({
        "segment": F.concat(name, F.lit(" (c"), F.col(label), F.lit(")")),
        "caveat": F.when(F.col("structure") == "marginal", "operational partition").otherwise("")})
    none = said.filter("NOT structure_found").withColumns({"chosen_k": F.lit(None).cast("int"), "caveat": F.lit("no structure: segments would be invented")})
    return named.unionByName(none, allowMissingColumns=True)


# --- agreement -------------------------------------------------------------------------------------
def adjusted_rand(df: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index of two labellings, from their contingency table."""
    cells = df.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: (F.col(n) * (F.col(n) - 1) / 2).cast("double")
    def total(d: DataFrame, name: str) -> DataFrame:
        return d.agg(F.sum(pairs("n")).alias("v"), F.sum("n").alias("n")).withColumn("part", F.lit(name))
    rows = cells.groupBy(a).agg(F.sum("n").alias("n"))
    cols = cells.groupBy(b).agg(F.sum("n").alias("n"))
    sums = total(cells, "c").unionByName(total(rows, "a")).unionByName(total(cols, "b"))
    pick = lambda p: F.max(F.when(F.col("part") == p, F.col("v")))
    one = sums.agg(pick("c").alias("c"), pick("a").alias("a"), pick("b").alias("b"), F.max("n").alias("n"))
    expected = F.col("a") * F.col("b") / (F.col("n") * (F.col("n") - 1) / 2)
    return one.select(exact_round(F.coalesce(
        F.try_divide(F.col("c") - expected, (F.col("a") + F.col("b")) / 2 - expected), F.lit(1.0)), 6).alias("adjusted_rand"))


def scaling_effect(df: DataFrame, features: Sequence[str], truth: str, k: int, seed: int = 42) -> DataFrame:
    """Agreement with known labels when fitted on scaled and on raw features."""
    scaled = fit_segments(standardize(df, features), [f"{f}_z" for f in features], k, seed)
    raw = fit_segments(df, features, k, seed)
    return adjusted_rand(scaled, "cluster", truth).withColumn("fit", F.lit("scaled")).unionByName(
        adjusted_rand(raw, "cluster", truth).withColumn("fit", F.lit("raw")))


def segment(df: DataFrame, by: Sequence[str], metrics: Mapping[str, str], features: Sequence[str], value: str,
            min_rows: int = 0, seed: int = 42, **sweep_args) -> dict[str, DataFrame]:
    """The whole path: entities, scaling, sweep, verdict and, unless there is no
    structure, labels, profile and findings."""
    entities = write_once(to_entities(df, by, metrics, min_rows).withColumn("entity", entity_name(by)), "entities")
    scaled = standardize(entities, features)
    z = [f"{f}_z" for f in features]
    sweep, models = sweep_models(scaled, z, "entity", seed=seed, **sweep_args)
    sweep = write_once(sweep, "sweep")
    verdict = structure_verdict(sweep)
    out = {"entities": entities, "sweep": sweep, "verdict": verdict}
    best = verdict.first()
    if best["structure"] == "ninguna":
        nothing = entities.sparkSession.createDataFrame([], "cluster int, pct_of_entities double, pct_of_value double, concentration_ratio double")
        return {**out, "findings": findings(verdict, nothing)}
    check_k(best["best_k"], scaled.count(), sweep)
    labelled = label_segments(scaled, z, models[best["best_k"]])
    profile = profile_segments(labelled, features, "entity", value)
    return {**out, "labelled": labelled, **profile, "findings": findings(verdict, profile["concentration"])}
