"""Exact order statistics of all groups at once.

Equal values are counted first, so a value that makes up much of a group is one row. Counts are then dealt by range of (group, value): a group of any size
lies in as many segments as it needs. Each segment adds up its own counts, what lies before it comes from one sum per group and segment, and a rank is found where it falls between two
sums. No group is one task, nothing is guessed and nothing is read again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import write_once


def _same(a: DataFrame, b: DataFrame, cols: Sequence[str]) -> Column:
    cond = F.lit(True)
    for c in cols:
        cond = cond & a[c].eqNullSafe(b[f"_{c}"])
    return cond


def quantiles(df: DataFrame, by: Sequence[str], marks: Mapping[str, tuple[str | Column, float]], interpolate: bool = True) -> DataFrame:
    """One row per group with a column (double) per mark, a value and a share of 0 to 1. With ``interpolate`` a mark between two ranks is weighed between them, else it is the first
    value that reaches the share. Null values don't count; a group without any has nulls; a null key is a group of its own; no rows, no groups."""
    names = list(marks)
    keys = [f"g{i}" for i in range(len(by))]
    values = [F.struct(F.lit(i).alias("mark"), (F.col(v) if isinstance(v, str) else v).cast("double").alias("v")) for i, (v, _) in enumerate(marks.values())]
    # marks of one column are counted once
    columns = [str(v) for v, _ in marks.values()]
    of = {i: columns.index(c) for i, c in enumerate(columns)}
    distinct = [values[i] for i in sorted(set(of.values()))]
    rows = df.select(*[F.col(b).alias(k) for b, k in zip(by, keys)], F.explode(F.array(*distinct)).alias("x")).select(*keys, "x.mark", "x.v")
    counted = rows.groupBy(*keys, "mark", "v").agg(F.count("v").alias("c"))
    order = [*keys, "mark", "v"]
    dealt = write_once(counted.repartitionByRange(*order).withColumn("s", F.spark_partition_id()), "value-counts")
    group = [*keys, "mark"]
    parts = dealt.groupBy(*group, "s").agg(F.sum("c").alias("c"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    parts = write_once(parts.select(*[F.col(c).alias(f"_{c}") for c in (*group, "s")], F.coalesce(F.sum("c").over(before), F.lit(0)).alias("before"), F.sum("c").over(whole).alias("n")), "segment-counts")
    inside = Window.partitionBy("s", *group).orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    both = dealt.withColumn("upto", F.sum("c").over(inside))
    both = both.join(parts, _same(both, parts, [*group, "s"])).select(*group, "v", "c", "n", (F.col("before") + F.col("upto")).alias("upto"))
    found = []
    for i, (name, (_, share)) in enumerate(marks.items()):
        mine = F.col("mark") == of[i]
        at = F.lit(float(share)) * (F.col("n") - 1) if interpolate else F.greatest(F.ceil(F.lit(float(share)) * F.col("n") - F.lit(1e-9)), F.lit(1)) - 1
        here = lambda rank: F.max(F.when(mine & (F.col("c") > 0) & (rank < F.col("upto")) & (rank >= F.col("upto") - F.col("c")), F.col("v")))  # noqa: B023, E731
        found += [here(F.floor(at)).alias(f"lo_{name}"), here(F.ceil(at)).alias(f"hi_{name}"), F.max(F.when(mine, at - F.floor(at))).alias(f"w_{name}")]
    # every group has a row of counts, if only of its nulls
    wide = both.groupBy(*keys).agg(*found) if keys else both.agg(*found)
    value = lambda n: F.when(F.col(f"lo_{n}") == F.col(f"hi_{n}"), F.col(f"lo_{n}")).otherwise(F.col(f"lo_{n}") * (1 - F.col(f"w_{n}")) + F.col(f"hi_{n}") * F.col(f"w_{n}"))
    return wide.select(*[F.col(k).alias(b) for b, k in zip(by, keys)], *[value(n).alias(n) for n in names])
