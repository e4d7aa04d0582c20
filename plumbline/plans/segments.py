"""Queries over entities and their segments."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import functions as fx
from ..operators import segment as s
from ..session import write_once
from .oracle import CTES, r, sql
from .registry import query

METRICS = {"revenue_usd": "sum", "margin_pct": "mean", "quantity": "median", "productkey": "nunique"}
FEATURES = ["revenue_usd_sum", "margin_pct_mean", "productkey_nunique"]
CTES["entities"] = (("fact", "product"), "SELECT brand, geokey, CAST(sum(revenue_usd) AS DOUBLE) AS revenue_usd_sum, avg(CAST(margin_pct AS DECIMAL(18,6))) AS margin_pct_mean, "
                    "CAST(median(quantity) AS DOUBLE) AS quantity_median, count(DISTINCT productkey) AS productkey_nunique, count(*) AS n FROM fact JOIN product USING (productkey) GROUP BY 1, 2")


def _entities(x, min_rows=0):
    rows = x.fact.join(x.product.select("productkey", "brand"), "productkey").withColumn("margin_pct", F.col("margin_pct").cast("decimal(18,6)"))
    out = s.to_entities(rows, ["brand", "geokey"], METRICS, min_rows)
    return out.withColumns({"revenue_usd_sum": F.col("revenue_usd_sum").cast("double"), "margin_pct_mean": F.col("margin_pct_mean").cast("double")})


@query(sql("SELECT brand, geokey, " + ", ".join(r(c, 4) + f" AS {c}" for c in ("revenue_usd_sum", "margin_pct_mean", "quantity_median")) + ", productkey_nunique, n FROM entities WHERE n >= 60", "entities"))
def entity_metrics(x):
    out = _entities(x, 60)
    return out.select("brand", "geokey", *[fx.exact_round(c, 4).alias(c) for c in ("revenue_usd_sum", "margin_pct_mean", "quantity_median")],
                      "productkey_nunique", F.col("_n_source_rows").alias("n"))


@query(sql("SELECT count(*) FILTER (WHERE n < 60) AS dropped_groups, count(*) AS all_groups FROM entities", "entities"))
def entities_below_threshold(x):
    rows = x.fact.join(x.product.select("productkey", "brand"), "productkey")
    return s.dropped_entities(rows, ["brand", "geokey"], 60)


@query(sql("SELECT brand, geokey, " + ", ".join(r(f"(CAST({c} AS DOUBLE) - avg(CAST({c} AS DOUBLE)) OVER ()) / stddev_pop(CAST({c} AS DOUBLE)) OVER ()", 6) + f" AS {c}_z" for c in FEATURES) + " FROM entities", "entities"))
def standardized_entities(x):
    z = s.standardize(_entities(x), FEATURES)
    return z.select("brand", "geokey", *[fx.exact_round(f"{c}_z", 6).alias(f"{c}_z") for c in FEATURES])


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS feature, {r(f'min({c})', 2)} AS raw_min, {r(f'max({c})', 2)} AS raw_max, CAST(0 AS DOUBLE) AS scaled_mean, CAST(1 AS DOUBLE) AS scaled_std FROM entities" for c in FEATURES), "entities"))
def scaling_report(x):
    return s.scaling_report(s.standardize(_entities(x), FEATURES), FEATURES).withColumn("scaled_mean", F.abs("scaled_mean"))


_SEG = "(geokey % 3)"


def _labelled(x):
    return _entities(x).withColumn("cluster", (F.col("geokey") % 3).cast("int"))


@query(sql(f"SELECT {_SEG} AS cluster, " + ", ".join(r(f"avg({c})", 3) + f" AS {c}" for c in FEATURES[1:]) + ", count(*) AS n_entities, "
           + r("100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()", 1) + " AS pct_of_entities FROM entities GROUP BY 1", "entities"))
def segment_means(x):
    return s.segment_means(_labelled(x), FEATURES[1:])


CTES["concentrated"] = (("entities",), f"SELECT {_SEG} AS cluster, " + r("100.0 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER ()", 1) + " AS pe, "
                        + r("100.0 * sum(revenue_usd_sum) / sum(sum(revenue_usd_sum)) OVER ()", 1) + " AS pv FROM entities GROUP BY 1")


@query(sql("SELECT cluster, pe AS pct_of_entities, pv AS pct_of_value, " + r("pv / pe", 2) + " AS concentration_ratio FROM concentrated", "concentrated"))
def value_concentration(x):
    return s.value_concentration(_labelled(x), "revenue_usd_sum")


@query(sql(f"SELECT cluster, string_agg(e, ', ' ORDER BY e) AS examples FROM (SELECT {_SEG} AS cluster, brand || ' | ' || geokey AS e, row_number() OVER (PARTITION BY {_SEG} ORDER BY brand || ' | ' || geokey) AS rn FROM entities) WHERE rn <= 4 GROUP BY 1", "entities"))
def segment_examples(x):
    return s.segment_examples(_labelled(x).withColumn("entity", s.entity_name(["brand", "geokey"])), "entity")


@query("WITH c AS (SELECT l_returnflag AS a, l_linestatus AS b, count(*) AS n FROM lineitem GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS c, "
       "(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS a, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS b, "
       "(SELECT sum(n) FROM c) AS n) SELECT " + r("(c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2))", 6) + " AS adjusted_rand FROM s")
def adjusted_rand_of_flags(x):
    return s.adjusted_rand(x.table("lineitem"), "l_returnflag", "l_linestatus")


#: Components of the vectors of the given table.
DIMS = 64


def _vectors(x):
    dims = [F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(DIMS)]
    return x.table("embeddings").select("vec_id", "label", *dims), [f"x{i}" for i in range(DIMS)]


_SIL = ("WITH p AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id, a.label, b.label AS other, sum(list_distance(a.v, b.v)) AS t FROM p a, p b GROUP BY ALL), "
        "z AS (SELECT label AS other, count(*) AS n FROM p GROUP BY 1), q AS (SELECT vec_id, label, max(CASE WHEN other = label THEN n END) AS own, max(CASE WHEN other = label AND n > 1 THEN t / (n - 1) END) AS a, "
        "min(CASE WHEN other <> label THEN t / n END) AS b FROM d JOIN z USING (other) GROUP BY ALL), s AS (SELECT vec_id, label, CASE WHEN own <= 1 THEN 0 ELSE (b - a) / greatest(a, b) END AS s FROM q) ")


@query(_SIL + "SELECT count(*) AS n, " + r("avg(s)", 6) + " AS silhouette FROM s")
def silhouette_of_labels(x):
    """Exact silhouette of the given labels over all dimensions."""
    rows, features = _vectors(x)
    return s.silhouette(rows, features, "label", "vec_id").select("n", fx.exact_round("silhouette", 6).alias("silhouette"))


@query(_SIL + "SELECT vec_id, label, " + r("s", 6) + " AS silhouette FROM s")
def silhouette_per_point(x):
    rows, features = _vectors(x)
    return s.silhouette_points(rows, features, "label", "vec_id", block=100).select(
        F.col("pid").cast("long").alias("vec_id"), F.col("label").cast("int").alias("label"), fx.exact_round("silhouette", 6).alias("silhouette"))


#: Values are compared in ten-thousandths; means of a few values lie on halves and quarters, but not on this edge.
_OFF_HALVES = 0.1234567


@query(sql(" UNION ALL ".join(f"SELECT '{c}' AS column_name, count(*) AS n, CAST(sum(CAST(floor(CAST({c} AS DOUBLE) * 10000 + {_OFF_HALVES}) AS HUGEINT)) AS BIGINT) AS total, {r(f'min({c})', 4)} AS low, {r(f'max({c})', 4)} AS high FROM entities" for c in FEATURES), "entities"))
def permuted_columns_keep_their_values(x):
    rows = _entities(x).withColumn("entity", s.entity_name(["brand", "geokey"]))
    mixed = s.permute_columns(rows, FEATURES, "entity", seed=42)
    sums = [F.struct(F.lit(c).alias("column_name"), F.count(c).alias("n"), F.sum(F.floor(F.col(c) * 10000 + _OFF_HALVES).cast("bigint")).alias("total"),
                     fx.exact_round(F.min(c), 4).alias("low"), fx.exact_round(F.max(c), 4).alias("high")).alias(c) for c in FEATURES]
    return mixed.agg(*sums).select(F.explode(F.array(*FEATURES)).alias("s")).select("s.*")


PLANTED = ["p_revenue", "p_margin", "p_products"]
CTES["planted"] = (("entities",), "SELECT *, geokey % 3 AS g, productkey_nunique % 3 AS h, revenue_usd_sum / max(revenue_usd_sum) OVER () + 10 * (geokey % 3) AS p_revenue, "
                   "margin_pct_mean / max(margin_pct_mean) OVER () + 10 * (geokey % 3) AS p_margin, CAST(productkey_nunique AS DOUBLE) / max(productkey_nunique) OVER () + 10 * ((geokey + 1) % 3) AS p_products FROM entities")
CTES["planted_z"] = (("planted",), "SELECT g, " + ", ".join(f"({c} - avg({c}) OVER ()) / stddev_pop({c}) OVER () AS {c}" for c in PLANTED) + " FROM planted")
_INERTIA = " + ".join(f"var_pop({c}) * count(*)" for c in PLANTED)


def _planted(x):
    """Real entities, moved apart by group: three groups that any good fit must find."""
    rows = write_once(_entities(x).withColumn("entity", s.entity_name(["brand", "geokey"])), "planted")
    most = rows.agg(*[F.max(c).cast("double").alias(c) for c in FEATURES]).first()  # three numbers
    g = F.col("geokey")
    move = [g % 3, g % 3, (g + 1) % 3]
    return rows.withColumns({p: F.col(c).cast("double") / F.lit(most[c]) + 10 * m for p, c, m in zip(PLANTED, FEATURES, move)})


def _planted_sweep(x):
    rows = s.standardize(_planted(x), PLANTED)
    return s.sweep_k(rows, [f"{f}_z" for f in PLANTED], "entity")


@query(sql("SELECT CAST(7 AS BIGINT) AS ks, CAST(3 AS INT) AS k, " + r("sum(i)", 2) + " AS inertia, " + r("100.0 * CAST(min(n) AS DOUBLE) / sum(n)", 1) + f" AS smallest_cluster_pct FROM (SELECT {_INERTIA} AS i, count(*) AS n FROM planted_z GROUP BY g)", "planted_z"))
def sweep_of_k(x):
    """All k, null models and starts are fitted; what is shown is the k of the best silhouette, which must be the planted one."""
    sweep = write_once(_planted_sweep(x), "sweep")
    best = sweep.agg(F.count(F.lit(1)).alias("ks"), F.max_by(F.struct("k", "inertia", "smallest_cluster_pct"), "silhouette").alias("b"))
    return best.select("ks", "b.*")


_BUCKETS = "SELECT CAST(label + 2 AS INT) AS k, " + r("avg(CAST(embedding[1] AS DOUBLE)) + 0.5", 4) + " AS silhouette, " + r("avg(CAST(embedding[2] AS DOUBLE)) + 0.05", 4) + " AS gap_vs_null FROM embeddings GROUP BY 1"


@query("SELECT CAST(arg_max(k, (silhouette, -k)) AS INT) AS best_k, max(silhouette) AS best_silhouette, max(gap_vs_null) AS max_gap_vs_null, CASE WHEN max(gap_vs_null) < 0.05 THEN 'ninguna' WHEN max(gap_vs_null) < 0.15 THEN 'marginal' "
       f"ELSE 'clara' END AS structure, max(gap_vs_null) >= 0.15 AS structure_found FROM ({_BUCKETS})")
def structure_verdict(x):
    e = x.table("embeddings").groupBy((F.col("label") + 2).cast("int").alias("k"))
    def mean(i, shift):
        return fx.exact_round(F.avg(F.col("embedding")[i].cast("double")) + shift, 4)
    return s.structure_verdict(e.agg(mean(0, 0.5).alias("silhouette"), mean(1, 0.05).alias("gap_vs_null")))


@query(sql("SELECT CAST(g AS INT) AS cluster, count(*) AS n FROM planted GROUP BY g", "planted"))
def fitted_segments(x):
    rows = s.standardize(_planted(x), PLANTED)
    return s.fit_segments(rows, [f"{f}_z" for f in PLANTED], 3).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"))


_NEAR = ("p AS (SELECT row_number() OVER () AS i, g, [" + ", ".join(PLANTED) + "] AS v FROM planted_z), d AS (SELECT a.i, a.g, b.g AS o, sum(list_distance(a.v, b.v)) AS t, count(*) AS n FROM p a, p b GROUP BY ALL), "
         "q AS (SELECT i, max(CASE WHEN o = g THEN t / (n - 1) END) AS a, min(CASE WHEN o <> g THEN t / n END) AS b FROM d GROUP BY i), s AS (SELECT avg((b - a) / greatest(a, b)) AS s FROM q)")


@query(sql(", " + _NEAR + " SELECT cluster, pe AS pct_of_entities, pv AS pct_of_value, " + r("pv / pe", 2) + " AS concentration_ratio, 'clara' AS structure, TRUE AS structure_found, CAST((SELECT count(DISTINCT g) FROM planted_z) AS INT) AS chosen_k, "
           + r("s", 4) + " AS silhouette, CASE WHEN " + r("pv / pe", 2) + " >= 1.6 THEN 'value engine' WHEN " + r("pv / pe", 2)
           + " <= 0.6 THEN 'long tail' ELSE 'middle block' END || ' (c' || cluster || ')' AS segment, '' AS caveat FROM concentrated, s", "concentrated", "planted_z"))
def named_segments(x):
    """Labels and verdict are those of a sweep over the planted groups."""
    rows, z = s.standardize(_planted(x), PLANTED), [f"{f}_z" for f in PLANTED]
    sweep, models = s.sweep_models(rows, z, "entity")
    verdict = write_once(s.structure_verdict(write_once(sweep, "sweep")), "verdict")
    labelled = s.label_segments(rows, z, models[verdict.first()["best_k"]])
    return s.findings(verdict, s.value_concentration(labelled, "revenue_usd_sum"))


@query(sql("SELECT cluster, CAST(NULL AS DOUBLE) AS pct_of_value, CAST(NULL AS VARCHAR) AS segment, 'ninguna' AS structure, FALSE AS structure_found, 'no structure: segments would be invented' AS caveat FROM (SELECT CAST(NULL AS INT) AS cluster) WHERE (SELECT count(*) FROM entities) > 0", "entities"))
def findings_without_structure(x):
    """A sweep whose gaps are those of chance names no segment."""
    sizes = _entities(x).groupBy((F.col("geokey") % 5 + 2).cast("int").alias("k")).agg(F.count(F.lit(1)).alias("n"))
    sweep = sizes.select("k", (F.col("n") / 1e6).alias("silhouette"), (F.col("n") / 1e9).alias("gap_vs_null"))
    return s.findings(s.structure_verdict(sweep), value_concentration(x)).select(F.col("cluster").cast("int").alias("cluster"), "pct_of_value", "segment", "structure", "structure_found", "caveat")


_ARI = ("WITH c AS (SELECT g AS a, h AS b, count(*) AS n FROM planted GROUP BY 1, 2), s AS (SELECT (SELECT sum(n * (n - 1) / 2) FROM c) AS c, (SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY a)) AS a, "
        "(SELECT sum(n * (n - 1) / 2) FROM (SELECT sum(n) AS n FROM c GROUP BY b)) AS b, (SELECT sum(n) FROM c) AS n) ")


@query(sql("SELECT 'scaled' AS fit, CAST(1 AS DOUBLE) AS adjusted_rand UNION ALL SELECT 'raw', adjusted_rand FROM (" + _ARI + "SELECT " + r("(c - a * b / (n * (n - 1) / 2)) / ((a + b) / 2 - a * b / (n * (n - 1) / 2))", 6)
           + " AS adjusted_rand FROM s)", "planted"))
def scaled_and_raw_fits(x):
    """A fourth feature of large numbers follows another grouping: it rules the raw fit and is outvoted in the scaled one."""
    rows = _planted(x).withColumns({"g": F.col("geokey") % 3, "trap": (F.col("productkey_nunique") % 3) * 1e6 + F.col("p_revenue") / 100})
    return s.scaling_effect(rows, [*PLANTED, "trap"], "g", 3)
