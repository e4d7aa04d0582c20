"""Audit checks: row counts, duplicates, nulls, ranges, orphans, date coverage."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import blank_to_null, exact_round
from .selection import quantiles
from ..session import write_once


def _n(name: str = "n") -> Column:
    return F.count(F.lit(1)).alias(name)


def _melt(row: DataFrame, ids: Sequence[str], key: str, value: str) -> DataFrame:
    """Turn the measure columns of a narrow aggregate into rows."""
    cols = [c for c in row.columns if c not in ids]
    return row.unpivot(list(ids), cols, key, value)


def stack_checks(frames: Sequence[DataFrame]) -> DataFrame:
    """UNION ALL by column name."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def union_distinct(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.unionByName(b).distinct()


def distinct_attrs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select(*cols).distinct()


def common_keys(a: DataFrame, b: DataFrame, key: Sequence[str]) -> DataFrame:
    return a.select(*key).intersect(b.select(*key))


# --- counts ------------------------------------------------------------------------
def row_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    return stack_checks([df.agg(_n("row_count")).select(F.lit(name).alias("table_name"), "row_count")
                         for name, df in tables.items()])


def expected_counts(counts: DataFrame, expected: Mapping[str, int]) -> DataFrame:
    """Row counts against the expected ones; a table nobody listed is not checked."""
    want = F.create_map(*[F.lit(x) for kv in expected.items() for x in kv])
    return (
        counts.withColumn("expected", want[F.col("table_name")].cast("long"))
        .withColumn("status", F.when(F.col("expected").isNull(), "UNCHECKED")
                    .when(F.col("row_count") == F.col("expected"), "PASS").otherwise("FAIL"))
    )


def count_diff(a: DataFrame, b: DataFrame, names=("original_rows", "clean_rows", "difference")) -> DataFrame:
    """Two row counts and their difference, from two one-row aggregates."""
    tagged = stack_checks([a.agg(_n()).withColumn("side", F.lit(0)), b.agg(_n()).withColumn("side", F.lit(1))])
    left, right = (F.coalesce(F.sum(F.when(F.col("side") == i, F.col("n"))), F.lit(0)) for i in (0, 1))
    return tagged.agg(left.alias(names[0]), right.alias(names[1]), (left - right).alias(names[2]))


def dedup_report(raw: DataFrame, clean: DataFrame) -> DataFrame:
    return count_diff(raw, clean, ("original_rows", "clean_rows", "duplicates_removed"))


def preserves_rows(src: DataFrame, out: DataFrame) -> DataFrame:
    """Did a derived table keep the row count (no lost and no fanned-out rows)?"""
    return count_diff(src, out, ("source_rows", "derived_rows", "lost_rows")).withColumn(
        "status", F.when(F.col("lost_rows") == 0, "PASS").otherwise("FAIL"))


# --- duplicates -----------------------------------------------------------------------
def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(_n("occurrences")).filter("occurrences > 1")


def duplicate_excess(df: DataFrame, key: str, check: str) -> DataFrame:
    """COUNT(*) - COUNT(DISTINCT key); rows without a key count as excess."""
    return df.agg((F.count(F.lit(1)) - F.countDistinct(key)).alias("duplicates")).select(
        F.lit(check).alias("check_name"), "duplicates")


def exact_duplicates(df: DataFrame) -> DataFrame:
    """Groups of fully equal rows, and the rows beyond the first of each."""
    groups = df.groupBy(*df.columns).agg(_n("_copies")).filter("_copies > 1")
    return groups.agg(_n("duplicate_groups"), F.coalesce(F.sum(F.col("_copies") - 1), F.lit(0)).alias("excess_rows"))


def repeated_entities(df: DataFrame, key: str) -> DataFrame:
    """Every record of the entities (compared trimmed and lower-case) seen more
    than once."""
    keyed = df.withColumn("entity", F.lower(blank_to_null(key, ("",))))
    often = keyed.filter("entity IS NOT NULL").groupBy("entity").agg(_n("times_seen")).filter("times_seen > 1")
    return keyed.filter("entity IS NOT NULL").join(write_once(often, "often"), "entity")


# --- nulls and ranges --------------------------------------------------------------------
def null_counts(df: DataFrame, cols: Sequence[str] | None = None, only_positive: bool = False) -> DataFrame:
    """Nulls of every column in one pass over the data."""
    names = list(cols or df.columns)
    out = _melt(df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in names]), [], "column_name", "nulls")
    return out.filter("nulls > 0") if only_positive else out


def range_checks(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """How many rows break each named rule, all rules in one pass."""
    return _melt(df.agg(*[F.count_if(cond).alias(name) for name, cond in rules.items()]), [], "rule", "violations")


def unmatched(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Rows that found no partner in at least one lookup."""
    return df.filter(reduce(lambda a, b: a | b, [F.col(c).isNull() for c in cols]))


def isolate(df: DataFrame, null_col: str, status: str, except_: str) -> DataFrame:
    """Rows missing ``null_col`` though the status does not excuse it; an unknown
    status excuses nothing."""
    return df.filter(F.col(null_col).isNull() & ~F.col(status).eqNullSafe(F.lit(except_)))


# --- referential integrity ------------------------------------------------------------------
def orphans(fact: DataFrame, links: Sequence[tuple[str, DataFrame, str]]) -> DataFrame:
    """Fact rows without a partner, per (fact key, dimension, dimension key).

    Keys are counted before they are joined, so a hot key travels as one row and
    each dimension is looked up once per distinct key."""
    def one(key: str, dim: DataFrame, dim_key: str) -> DataFrame:
        counted = fact.groupBy(F.col(key).alias("_k")).agg(_n("_n"))
        present = dim.select(F.col(dim_key).alias("_k"))
        return counted.join(present, "_k", "left_anti").agg(
            F.coalesce(F.sum("_n"), F.lit(0)).alias("orphan_rows")
        ).select(F.lit(f"orphan {key}").alias("issue"), "orphan_rows")

    return stack_checks([one(*link) for link in links])


def missing_parent(child: DataFrame, parent: DataFrame, key: Sequence[str]) -> DataFrame:
    """Rows without a parent. The parents are read as they are, so that adaptive execution can split a hot key."""
    return child.join(parent.select(*key), list(key), "left_anti")


def split_by_existence(df: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flag whether each row's key exists in the target."""
    # written, so that the join shuffles both sides itself and adaptive execution can split a hot key
    known = write_once(target.select(*keys).distinct(), "known").withColumn("_hit", F.lit(True))
    return df.join(known, list(keys), "left").withColumn("exists", F.coalesce("_hit", F.lit(False))).drop("_hit")


# --- coverage and distribution ----------------------------------------------------------------
def date_range(df: DataFrame, col: str) -> DataFrame:
    """First and last date, distinct dates and years. Dates are collapsed first:
    a few thousand rows at most reach the final aggregate."""
    days = df.select(F.to_date(col).alias("d")).distinct()
    return days.agg(F.min("d").alias("earliest_date"), F.max("d").alias("latest_date"),
                    F.count("d").alias("distinct_dates"), F.countDistinct(F.year("d")).alias("distinct_years"))


def month_density(df: DataFrame, date: str, metric: str, fill_gaps: bool = False) -> DataFrame:
    """Rows and metric per calendar month; with ``fill_gaps`` the months between
    the first and the last that have no row appear with zero."""
    found = df.groupBy(F.trunc(date, "month").alias("month_start")).agg(
        _n("transactions"), F.sum(metric).alias("total"))
    if fill_gaps:
        span = found.agg(F.min("month_start").alias("a"), F.max("month_start").alias("b"))
        months = span.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month_start"))
        found = months.join(found, "month_start", "left")
    return found.select(
        F.year("month_start").alias("sale_year"), F.month("month_start").alias("sale_month"),
        F.coalesce("transactions", F.lit(0)).alias("transactions"),
        exact_round(F.coalesce("total", F.lit(0)), 0).alias("total"))


def value_stats(df: DataFrame, col: str, exact: bool = True) -> DataFrame:
    """Mean, sample deviation, percentiles and maximum.

    Without ``exact`` the percentiles come from a sketch of bounded size. With it they are selected (``selection``), and no task ever holds the column."""
    value = F.col(col).cast("double")
    marks = {"p1": 0.01, "p25": 0.25, "median": 0.5, "p75": 0.75, "p99": 0.99}
    shape = [exact_round(F.avg(value), 2).alias("mean"), exact_round(F.stddev_samp(value), 2).alias("stddev"),
             F.max(value).alias("max")]
    if not exact:
        cuts = F.percentile_approx(value, list(marks.values()), 10000)
        return df.agg(*shape, cuts.alias("q")).select(
            "mean", "stddev", *[F.col("q")[i].alias(m) for i, m in enumerate(marks)], "max")
    cuts = quantiles(df, [], {m: (col, share) for m, share in marks.items()}, interpolate=False)
    return df.agg(*shape).unionByName(cuts, allowMissingColumns=True).agg(*[F.max(c).alias(c) for c in ("mean", "stddev", *marks, "max")])


def value_counts(df: DataFrame, col: str, n: int | None = None) -> DataFrame:
    counts = df.groupBy(F.col(col).alias("value")).agg(_n())
    return counts if n is None else counts.orderBy(F.desc("n"), F.asc_nulls_last("value")).limit(n)


def attribute_counts(df: DataFrame, cols: Sequence[str], name: str = "product_count") -> DataFrame:
    return df.groupBy(*cols).agg(_n(name))


def currency_consistency(fact: DataFrame, geo: DataFrame, key: str) -> DataFrame:
    """Rows per country and currency, and whether the country uses one only."""
    per_key = fact.groupBy(key, "currency").agg(_n("_n"))
    counts = per_key.join(geo.select(key, "countrycode"), key).groupBy("countrycode", "currency").agg(
        F.sum("_n").alias("row_count"))
    kinds = counts.groupBy("countrycode").agg(F.count(F.lit(1)).alias("currencies"))
    return counts.join(kinds, "countrycode").withColumn("consistent", F.col("currencies") == 1)


def same_totals(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either side without an equal row on the other; empty when both
    paths give the same totals."""
    cols = a.columns
    tagged = stack_checks([a.select(*cols).withColumn("_w", F.lit(1)), b.select(*cols).withColumn("_w", F.lit(-1))])
    return (
        tagged.groupBy(*cols).agg(F.sum("_w").alias("balance")).filter("balance <> 0")
        .withColumn("only_in", F.when(F.col("balance") > 0, "first").otherwise("second"))
    )


# --- files ----------------------------------------------------------------------------------
def cross_file_overlap(df: DataFrame, keys: Sequence[str], file: str, payload: Sequence[str]) -> DataFrame:
    """Entities present in more than one file: the files, how many, and whether
    their records disagree. One aggregate instead of pairing rows, so a common
    entity costs one row and not the square of its copies."""
    content = F.struct(*[F.col(c) for c in payload])
    return (
        df.groupBy(*keys).agg(
            F.countDistinct(file).alias("files"), _n("records"),
            F.min(file).alias("first_file"), F.max(file).alias("last_file"),
            (F.min(content) != F.max(content)).alias("conflicting"))
        .filter("files > 1")
    )


def versions_side_by_side(df: DataFrame, keys: Sequence[str], file: str, order: Sequence[str],
                          payload: Sequence[str], left: str, right: str) -> DataFrame:
    """For entities in two named files: the last record of each, next to each other."""
    best = F.max(F.struct(*[F.col(c) for c in (*order, *payload)]))
    def side(name: str) -> DataFrame:
        rows = df.filter(F.col(file) == name).groupBy(*keys).agg(best.alias("_b"))
        return rows.select(*keys, *[F.col(f"_b.{c}").alias(f"{name}_{c}") for c in payload])
    return side(left).join(side(right), list(keys))


def empty_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str]) -> DataFrame:
    """Columns without a single value in a file, one pass for all of them."""
    filled = df.groupBy(*by).agg(*[F.count(c).alias(c) for c in cols])
    return _melt(filled, by, "campo", "filled").filter("filled = 0").drop("filled")


def residual_cr(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Values that still end in a carriage return, per column."""
    return _melt(df.agg(*[F.count_if(F.col(c).endswith("\r")).alias(c) for c in cols]), [], "column_name", "with_cr")


def date_order(df: DataFrame) -> DataFrame:
    """Records whose event dates contradict each other, or cannot be read."""
    send, opened, click = F.col("fecha_envio"), F.col("fecha_open"), F.col("fecha_click")
    def bad(text: str, parsed: Column) -> Column:
        return blank_to_null(text).isNotNull() & parsed.isNull()
    return range_checks(df, {
        "open_before_send": opened < send, "click_before_send": click < send, "click_before_open": click < opened,
        "bad_send": bad("fecha_envio_txt", send), "bad_open": bad("fecha_open_txt", opened),
        "bad_click": bad("fecha_click_txt", click),
    })


def audit(fact: DataFrame, key: str, dims: Mapping[str, tuple[DataFrame, str, str]], measures: Mapping[str, Column]
          ) -> DataFrame:
    """The whole audit as one tidy frame (check, scope, value, status). ``dims``
    maps a name to (frame, dimension key, fact key)."""
    def said(df: DataFrame, facts: dict[tuple[str, str], Column]) -> DataFrame:
        """Named aggregates of one pass, a row each."""
        flat = df.agg(*[v.cast("long").alias(f"v{i}") for i, v in enumerate(facts.values())])
        return flat.select(F.explode(F.array(*[F.struct(F.lit(c).alias("check"), F.lit(n).alias("scope"), F.col(f"v{i}").alias("value")) for i, (c, n) in enumerate(facts)])).alias("x")).select("x.*")

    def size(k: str, scope: str) -> dict[tuple[str, str], Column]:
        return {("row_count", scope): F.count(F.lit(1)), ("duplicate", scope): F.count(F.lit(1)) - F.countDistinct(k)}

    facts = size(key, "fact") | {("nulls", c): F.count_if(F.col(c).isNull()) for c in fact.columns} | {("range", n): F.count_if(cond) for n, cond in measures.items()}
    lost = orphans(fact, [(fk, d, k) for d, k, fk in dims.values()]).select(F.lit("orphan").alias("check"), F.col("issue").alias("scope"), F.col("orphan_rows").cast("long").alias("value"))
    parts = [said(fact, facts), *[said(d, size(k, n)) for n, (d, k, _) in dims.items()], lost]
    return stack_checks(parts).withColumn(
        "status", F.when(F.col("check") == "row_count", "INFO").when(F.col("value") == 0, "PASS").otherwise("FAIL"))
