"""Tables: load, save, copy with validation, bronze append, CSV sink."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F

from ..functions import exact_round


def load_table(spark: SparkSession, path: str, schema: str | None = None, name: str | None = None) -> DataFrame:
    """Read parquet or CSV by extension and register it under ``name``. Give CSV
    a schema: inferring one reads the data an extra time."""
    if path.rstrip("/").endswith((".csv", ".txt", ".csv.gz")):
        reader = spark.read.option("header", True)
        df = (reader.schema(schema) if schema else reader.option("inferSchema", True)).csv(path)
    else:
        df = (spark.read.schema(schema) if schema else spark.read).parquet(path)
    if name:
        df.createOrReplaceTempView(name)
    return df


def load_workspace(spark: SparkSession, folder: str, names: Sequence[str]) -> dict[str, DataFrame]:
    return {n: load_table(spark, f"{folder}/{n}.parquet", name=n) for n in names}


def save_table(df: DataFrame, name: str, cluster_by: Sequence[str] = ()) -> None:
    """CREATE OR REPLACE TABLE AS SELECT; rows are sorted by ``cluster_by`` within
    each file so that readers can skip row groups."""
    (df.sortWithinPartitions(*cluster_by) if cluster_by else df).write.mode("overwrite").saveAsTable(name)


def create_view(df: DataFrame, name: str) -> None:
    df.createOrReplaceTempView(name)


def table_stats(df: DataFrame, date: str, amount: str) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("row_count"), F.min(date).alias("earliest_date"), F.max(date).alias("latest_date"),
                  exact_round(F.sum(amount), 2).alias("total_amount"))


def compare_copies(source: DataFrame, copy: DataFrame, date: str, amount: str) -> DataFrame:
    return table_stats(source, date, amount).withColumn("side", F.lit("source")).unionByName(
        table_stats(copy, date, amount).withColumn("side", F.lit("copy")))


def copy_table(df: DataFrame, path: str, date: str, amount: str) -> DataFrame:
    """Write a copy and report count, date span and total of both sides. The source is read once: its figures are taken while it is written."""
    seen, kinds = Observation(), {f.name: f.dataType for f in df.agg(F.min(date).alias("d"), F.sum(amount).alias("t")).schema}
    df.observe(seen, F.count(F.lit(1)).alias("n"), F.min(date).alias("a"), F.max(date).alias("b"), F.sum(amount).alias("t")).write.mode("overwrite").parquet(path)
    said = seen.get
    span = [F.lit(said[c]).cast(kinds["d"]).alias(n) for c, n in (("a", "earliest_date"), ("b", "latest_date"))]
    source = df.sparkSession.range(1).select(F.lit(said["n"]).cast("long").alias("row_count"), *span, exact_round(F.lit(said["t"]).cast(kinds["t"]), 2).alias("total_amount"), F.lit("source").alias("side"))
    return source.unionByName(table_stats(df.sparkSession.read.parquet(path), date, amount).withColumn("side", F.lit("copy")))


def z_value(columns: Sequence[str | Column], bits: int = 16) -> Column:
    """Interleaves the lowest ``bits`` of whole numbers, so that rows near in all of them are near in one order. Nulls count as 0."""
    out = F.lit(0).cast("long")
    for j, c in enumerate(columns):
        v = F.coalesce((F.col(c) if isinstance(c, str) else c).cast("long"), F.lit(0))
        for i in range(bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftright(v, i).bitwiseAND(F.lit(1)), i * len(columns) + j))
    return out


def save_mart(df: DataFrame, name: str, bucket_by: Sequence[str], buckets: int, path: str, near: Sequence[str | Column] = ()) -> DataFrame:
    """A table whose rows are dealt to ``buckets`` by key: tables dealt alike are joined on that key without a shuffle. Inside a bucket rows are sorted by the
    Z-order of ``near``, so a filter on any of these columns skips most row groups."""
    rows = df.repartition(buckets, *bucket_by)
    if near:
        rows = rows.withColumn("_z", z_value(near)).sortWithinPartitions("_z").drop("_z")
    rows.write.mode("overwrite").bucketBy(buckets, *bucket_by).option("path", path).saveAsTable(name)
    return df.sparkSession.table(name)


def write_bronze(df: DataFrame, path: str, load_date: str, cluster_by: Sequence[str] = ()) -> None:
    """Append one load, partitioned by its date; earlier loads are not touched."""
    rows = df.withColumn("load_date", F.lit(load_date).cast("date"))
    (rows.sortWithinPartitions(*cluster_by) if cluster_by else rows).write.mode("append").partitionBy("load_date").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def workspace_counts(tables: Mapping[str, DataFrame]) -> dict[str, int]:
    return {n: df.count() for n, df in tables.items()}
