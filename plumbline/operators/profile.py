"""Column profiles of text tables: presence, absence forms, types, keys.

Values are counted once per (column, value); everything else follows from those
counts. Equal values combine before the shuffle, and no column is scanned twice.
"""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import exact_round, fixed


def _texts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return df.select([F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in cols])


def column_values(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Occurrences of every value of every column (missing counts as empty)."""
    cols = list(cols or df.columns)
    pos = F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i + 1)])
    long = _texts(df, cols).unpivot([], cols, "column_name", "value")
    counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("position", pos[F.col("column_name")])


def missing_forms(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """Empty, dash, populated and distinct values per column."""
    v = F.trim("value")
    filled = ~v.isin(*fixed.BLANKS)
    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    return column_values(df, cols).groupBy("column_name").agg(
        n(v == "").alias("empty"), n(v == "-").alias("dash"), n(filled).alias("populated"),
        F.countDistinct(F.when(filled, v)).alias("distinct_values"))


def _column_facts(values: DataFrame) -> DataFrame:
    v, present = F.col("value"), ~F.col("value").isin(*fixed.ABSENT)
    def n(cond: Column) -> Column:
        return F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    def every(pattern: str) -> Column:
        return F.bool_and(F.when(present, v.rlike(pattern)))
    shapes = [every(shape).alias(f"date_{i}") for i, (_, shape, _) in enumerate(fixed.DATE_FORMATS)]
    parses = [F.bool_and(F.when(present, F.try_to_timestamp(v, F.lit(p)).isNotNull())).alias(f"parse_{i}")
              for i, (_, _, p) in enumerate(fixed.DATE_FORMATS)]
    whole = F.when(present & v.rlike(fixed.INTEGER), v.try_cast("long"))
    return values.groupBy("position", "column_name").agg(
        F.sum("n").alias("rows"), n(present).alias("present"), F.count_if(present).alias("distinct_values"),
        n(present & v.contains("@")).alias("with_at"), n(present & v.contains("@") & ~v.rlike(fixed.EMAIL)).alias("bad_email"),
        every(fixed.EMAIL).alias("is_email"), every(fixed.INTEGER).alias("is_int"),
        every(f"{fixed.INTEGER}|{fixed.DECIMAL}").alias("is_decimal"), *shapes, *parses,
        F.min(whole).alias("min_int"), F.max(whole).alias("max_int"),
        F.max(F.when(present, F.length(v))).alias("max_length"),
        *[n(v == m).alias(f"absent_{i}") for i, m in enumerate(fixed.ABSENT)])


def _type_and_format() -> tuple[Column, Column]:
    """First description that fits, from the narrowest on. A day-first and a
    month-first format share a shape; parsing decides between them."""
    fmt = F.lit(None).cast("string")
    for i, (name, _, _) in reversed(list(enumerate(fixed.DATE_FORMATS))):
        fmt = F.when(F.col(f"date_{i}") & F.col(f"parse_{i}"), F.lit(name)).otherwise(fmt)
    near_email = (F.col("bad_email") > 0) & (F.col("with_at") / F.col("present") > 0.8)
    kind = (
        F.when(F.col("present") == 0, "vacia").when(F.col("is_email") | near_email, "email")
        .when(fmt.isNotNull(), "fecha").when(F.col("is_int"), "entero").when(F.col("is_decimal"), "decimal")
        .when(F.col("distinct_values") <= 8, "categoria").otherwise("texto")
    )
    return kind, F.when(kind == "fecha", fmt)


def profile_columns(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """One row per column: presence, distinct values, absence forms, type."""
    kind, fmt = _type_and_format()
    forms = [F.struct(F.lit(m).alias("k"), F.col(f"absent_{i}").alias("v")) for i, m in enumerate(fixed.ABSENT)]
    return _column_facts(column_values(df, cols)).select(
        "position", "column_name", "rows", "present", "distinct_values",
        exact_round(F.when(F.col("rows") > 0, F.col("present") / F.col("rows") * 100).otherwise(0), 1).alias("pct_present"),
        F.map_from_entries(F.filter(F.array(*forms), lambda e: e["v"] > 0)).alias("absence_forms"),
        kind.alias("type"), fmt.alias("date_format"), "bad_email", "min_int", "max_int", "max_length")


def infer_types(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    return profile_columns(df, cols).select("position", "column_name", "type", "date_format", "present")


def column_examples(df: DataFrame, order: Sequence[str], cols: Sequence[str], n: int = 3) -> DataFrame:
    """The first ``n`` present values of each column in row order."""
    long = df.select(*order, *[F.col(c).cast("string").alias(c) for c in cols]).unpivot(
        list(order), list(cols), "column_name", "value").filter(
        F.col("value").isNotNull() & ~F.col("value").isin(*fixed.ABSENT))
    rn = F.row_number().over(Window.partitionBy("column_name").orderBy(*order))
    few = long.withColumn("rn", rn).filter(F.col("rn") <= n)
    picked = few.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("rn", "value"))).alias("e"))
    return picked.select("column_name", F.col("e.value").alias("examples"))


#: Sketches of 2**16 registers are off by 0.4 % (one deviation); pairs further than seven of these below the floor are not counted.
SKETCH, SURE = 16, 0.03


def likely_pairs(texts: DataFrame, pairs: Sequence[tuple[str, str]], floor: float) -> list[tuple[str, str]]:
    """Pairs of columns that may have more than ``floor`` distinct values a row: one sketch per pair, merged from those of the tasks, instead of all rows once per pair."""
    if not pairs:
        return []
    seen = texts.agg(F.count(F.lit(1)).alias("n"), *[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(a, b), SKETCH)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)]).first()
    return [p for i, p in enumerate(pairs) if seen[f"p{i}"] >= (floor - SURE) * seen.n]


def key_candidates(df: DataFrame, cols: Sequence[str] | None = None, top: int = 6) -> DataFrame:
    """Columns and pairs that come near to identifying a row, with uniqueness and
    duplicates. Uniqueness here is no proof of a business key.

    The columns worth pairing are read from the first pass: one small row per
    column. Absent markers are not values of a column but are values of a pair.
    """
    cols = list(cols or df.columns)
    present = ~F.col("value").isin(*fixed.ABSENT)
    stats = column_values(df, cols).groupBy("position", "column_name").agg(
        F.sum("n").alias("total"), F.count_if(present).alias("distinct_values"))
    facts = sorted(stats.collect())
    spread = [r.column_name for r in facts if r.distinct_values > r.total * 0.1][:6]
    pairs = likely_pairs(_texts(df, cols), list(combinations(spread, 2)), 0.9)
    def scored(d: DataFrame, floor: float) -> DataFrame:
        unique = F.col("distinct_values") / F.col("total")
        return d.filter(unique > floor).select("columns", "n_columns", exact_round(unique, 4).alias("uniqueness"),
                                               (F.col("total") - F.col("distinct_values")).alias("duplicates"))
    singles = stats.select(F.col("column_name").alias("columns"), F.lit(1).alias("n_columns"), "total", "distinct_values")
    out = scored(singles, 0.5)
    if pairs:
        text = _texts(df, cols)
        items = F.array(*[F.struct(F.lit(f"{a} + {b}").alias("columns"), F.col(a).alias("a"), F.col(b).alias("b"))
                          for a, b in pairs])
        met = text.select(F.explode(items).alias("p")).select("p.*").groupBy("columns", "a", "b").agg(
            F.count(F.lit(1)).alias("n"))
        both = met.groupBy("columns").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("distinct_values"))
        out = out.unionByName(scored(both.withColumn("n_columns", F.lit(2)), 0.9))
    return out.orderBy(F.desc("uniqueness"), "n_columns", "columns").limit(top)


def describe_table(df: DataFrame, max_cats: int = 8) -> DataFrame:
    """Shape of every public column: range, mean, deviation and nulls of numbers;
    distinct, most frequent values and nulls of the rest."""
    public = [f for f in df.schema.fields if not f.name.startswith("_")]
    numeric = [f.name for f in public if f.dataType.typeName() in
               ("byte", "short", "integer", "long", "float", "double", "decimal")]
    other = [f.name for f in public if f.name not in numeric]
    parts = []
    if numeric:
        aggs = []
        for c in numeric:
            v = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
            aggs.append(F.struct(
                F.lit(c).alias("column_name"), exact_round(F.min(v), 3).alias("min"), exact_round(F.max(v), 3).alias("max"),
                exact_round(F.avg(v), 3).alias("mean"), exact_round(F.stddev_samp(v), 3).alias("std"),
                (F.count(F.lit(1)) - F.count(v)).alias("nulls")).alias(c))
        parts.append(df.agg(*aggs).select(F.explode(F.array(*numeric)).alias("s")).select("s.*").select(
            "column_name", F.lit("numeric").alias("type"), "min", "max", "mean", "std", "nulls",
            F.lit(None).cast("long").alias("distinct_values"), F.lit(None).cast("string").alias("top")))
    if other:
        long = df.select([F.col(c).cast("string").alias(c) for c in other]).unpivot([], other, "column_name", "value")
        counts = long.groupBy("column_name", "value").agg(F.count(F.lit(1)).alias("n"))
        shape = counts.groupBy("column_name").agg(
            F.count("value").alias("distinct_values"),
            F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"))
        rn = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("n"), "value"))
        few = counts.filter("value IS NOT NULL").withColumn("rn", rn).filter(F.col("rn") <= max_cats)
        top = few.groupBy("column_name").agg(F.array_sort(F.collect_list(F.struct("rn", "value", "n"))).alias("t")).select(
            "column_name", F.array_join(F.transform("t", lambda e: F.concat(e["value"], F.lit("="), e["n"])), ", ").alias("top"))
        nil = F.lit(None).cast("double")
        parts.append(shape.join(top, "column_name", "left").select(
            "column_name", F.lit("categorical").alias("type"), nil.alias("min"), nil.alias("max"), nil.alias("mean"),
            nil.alias("std"), "nulls", "distinct_values", "top"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def propose_rules(profile: DataFrame) -> DataFrame:
    """Candidate validations for a new file: one per column whose type suggests
    one, rejecting only what makes a record useless."""
    kind = F.col("type")
    required = F.col("pct_present") > 95
    rule = (F.when(kind == "email", "well-formed address").when(kind == "fecha", F.concat(F.lit("date as "), "date_format"))
            .when(kind.isin("entero", "decimal"), "is a number").when(kind == "vacia", "column is empty"))
    severity = F.when((kind == "email") | ((kind == "fecha") & required), fixed.REJECT).otherwise(fixed.WARN)
    # numbering is over proposals, one row per column of the file
    order = Window.orderBy("position")
    return profile.withColumn("rule", rule).filter("rule IS NOT NULL").select(
        F.format_string("V-%02d", F.row_number().over(order) + 2).alias("code"), "column_name", "rule",
        severity.alias("severity"))


def proposed_schema(profile: DataFrame) -> str:
    """All-text staging schema for the profiled columns, as a DDL field list."""
    names = [r.column_name for r in profile.select("position", "column_name").orderBy("position").collect()]
    import re
    clean = [re.sub(r"_+", "_", re.sub(r"[^a-z0-9_]", "_", (n or "").strip().lower())).strip("_") or f"col_{i + 1}"
             for i, n in enumerate(names)]
    return ", ".join(f"{n} STRING" for n in clean)
