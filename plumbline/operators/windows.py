"""Ranking, numbering, shares and paging."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import safe_ratio
from ..session import cut_lineage, write_once


def _order(cols: Sequence[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in cols]


def dedup_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``. Name a total order: ties would
    otherwise be broken differently on each run. Spark turns the filter on the
    row number into a group limit before the shuffle, so a hot key is already cut
    to one row per input partition when it arrives."""
    w = Window.partitionBy(*keys).orderBy(*_order(order))
    return df.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def rank_best(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], valid: Column | None = None,
              coarse: Sequence[str | Column] = (), name: str = "rn", spread: Sequence[str] = ()) -> DataFrame:
    """Exact row number within ``keys`` for valid rows; the others get NULL.

    ``coarse`` lists columns or expressions that come first in the order (for
    example the leading counters, or a line number divided by a million). A key
    is then ranked in pieces: rows per piece are counted first, the counts give
    each piece its offset, and rows are numbered inside their piece only. No task
    holds more than one piece, however large the key. Coarse values sort upwards
    (negate a counter that ranks downwards) and may not be NULL. ``spread`` names
    the columns that tell unranked rows apart (all of them by default).
    """
    ok = F.lit(True) if valid is None else F.coalesce(valid, F.lit(False))
    names = [f"_p{i}" for i in range(len(coarse))]
    # rows that are not ranked are spread by hash instead of gathering under a NULL key
    marked = df.withColumns({
        "_ok": F.when(ok, F.lit(-1)).otherwise(F.pmod(F.xxhash64(*(spread or df.columns)), F.lit(65536))).cast("int"),
        **{n: (F.col(c) if isinstance(c, str) else c) for n, c in zip(names, coarse)}})
    piece = ["_ok", *keys, *names]
    inside = marked.withColumn("_in", F.row_number().over(Window.partitionBy(*piece).orderBy(*_order(order))))
    if not coarse:
        return inside.withColumn(name, F.when(F.col("_ok") < 0, F.col("_in"))).select(*df.columns, name)
    upto = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        df.filter(ok).select(*keys, F.lit(-1).alias("_ok"), *[(F.col(c) if isinstance(c, str) else c).alias(n)
                                                              for n, c in zip(names, coarse)])
        .groupBy(*piece).agg(F.count(F.lit(1)).alias("_n"))
        .select(*piece, F.sum("_n").over(upto).alias("_before"))
        .filter("_before IS NOT NULL")  # the first piece of a key begins at 1 and is not looked up
    )
    known = reduce(and_, [F.col(c).isNotNull() for c in piece])  # a row whose key is missing has no rank
    # same keys as the window, so the rows are not shuffled again for the join
    return inside.join(offsets, piece, "left").select(
        *df.columns, F.when((F.col("_ok") < 0) & known, F.col("_in") + F.coalesce("_before", F.lit(0))).cast("int").alias(name))


def surrogate_key(df: DataFrame, order: Sequence[str | Column], name: str) -> DataFrame:
    """Dense keys 1..n in the given total order without gathering the rows in
    one task: rows are range-partitioned and fixed by a checkpoint, numbered
    inside their partition, and shifted by the row counts of earlier partitions
    (one small row per partition)."""
    cols = _order(order)
    ranged = cut_lineage(df.repartitionByRange(*cols).withColumn("_part", F.spark_partition_id()))
    sizes = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_shift"))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*cols))
    return (
        ranged.withColumn("_in", inside).join(shifts, "_part")
        .select((F.col("_in") + F.col("_shift")).cast("long").alias(name), *df.columns)
    )


def share_of_all(df: DataFrame, metric: str, out: str = "share_pct", scale: float = 100) -> DataFrame:
    """Add each row's share of the whole. The total is a scalar subquery: one
    aggregated row, no window over everything."""
    df = write_once(df, "shares")  # read twice: what led to it is not computed again for the total
    total = df.agg(F.sum(metric).cast("double").alias("t")).scalar()
    return df.withColumn(out, safe_ratio(metric, total, scale))


def add_share(df: DataFrame, value: str, within: Sequence[str] | str, out: str) -> DataFrame:
    """100 * value / total of the group, to four digits. Totals are aggregated
    and joined back, so a hot group is combined before it moves; rows without a
    group have no total and get NULL."""
    keys = [within] if isinstance(within, str) else list(within)
    # written, so that the join shuffles both sides itself and adaptive execution can split a hot group
    totals = write_once(df.groupBy(*keys).agg(F.sum(value).alias("_total")), "totals")
    return (
        df.join(totals, keys, "left")
        .withColumn(out, F.bround(safe_ratio(value, "_total", 100), 4))
        .select(*df.columns, out)
    )


def yoy(df: DataFrame, by: Sequence[str], year: str, metrics: Sequence[str]) -> DataFrame:
    """Totals per year with the change against the previous year present."""
    totals = df.groupBy(*by, year).agg(*[F.sum(m).alias(m) for m in metrics])
    w = Window.partitionBy(*by).orderBy(year)
    out = totals
    for m in metrics:
        prev = F.lag(m).over(w)
        out = out.withColumn(f"{m}_prev", prev).withColumn(
            f"{m}_change_pct", safe_ratio(F.col(m) - F.col(f"{m}_prev"), f"{m}_prev", 100))
    return out


def top_n(df: DataFrame, order: Sequence[str | Column], n: int) -> DataFrame:
    return df.orderBy(*_order(order)).limit(n)


preview = top_n


def first_rows(df: DataFrame, n: int = 5000, order: Sequence[str | Column] = ("file", "line_no")) -> DataFrame:
    """The sample a profile works on: the first ``n`` rows in file order."""
    return top_n(df, order, n)


def page(df: DataFrame, order: Sequence[str | Column], limit: int, offset: int = 0) -> DataFrame:
    """One page, with the total, whether more follow, and the next offset."""
    total = df.agg(F.count(F.lit(1)).alias("n")).scalar()
    rows = df.orderBy(*_order(order)).offset(offset).limit(limit)
    more = F.col("total") > offset + limit
    return (
        rows.withColumn("total", total)
        .withColumn("has_more", more)
        .withColumn("next_offset", F.when(more, F.lit(offset + limit)).otherwise(F.lit(-1)))
    )
