"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import re
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

#: Runs of ASCII letters and digits and of anything beyond ASCII, after lower-casing A-Z.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
ASCII_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def words(text: str | None) -> list[str]:
    """Words of a whole text; null has none."""
    return WORD.findall(text.translate(ASCII_LOWER)) if text else []


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Makes Spark send this package to the Python workers, once per application, so that it need not be
    installed on the executors; and makes Arrow batches small, as a text can be long."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    sc = spark.sparkContext
    if sc.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parents[1]
        to = Path(tempfile.mkdtemp(prefix="spark-")) / f"{root.name}.zip"
        with zipfile.ZipFile(to, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        sc.addPyFile(str(to))
        _SHIPPED.add(sc.applicationId)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column | str = "text") -> Column:
    """Tells rows of one doc_id with different texts apart, without carrying the text."""
    return F.xxhash64(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("\0null")))


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, text and a key of the text; other columns, whatever their names, stay behind."""
    return docs.select(F.col("doc_id"), F.col("text"), text_key().alias("text_key"))


def same_document(left: DataFrame, right: DataFrame) -> Column:
    """Join condition on (doc_id, text_key); a null id equals a null id."""
    return left["doc_id"].eqNullSafe(right["doc_id"]) & (left["text_key"] == right["text_key"])
