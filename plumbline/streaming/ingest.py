"""Incremental ingest of report files with Structured Streaming.

Each micro-batch holds whole new files and is one load of ``operators.batch``: validated, ranked, audited, and committed as a whole under the name of
the batch, so a batch that is retried after a failure leaves one copy. The same content under a second name is not
loaded again. Readers fold what is committed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.errors import AnalysisException

from ..operators.batch import Store, load_text


def process_batch(text: DataFrame, batch_id: int, out: str, as_of: str) -> None:
    """One micro-batch, committed once whatever happens."""
    load_text(Store(text.sparkSession, out), text, as_of, f"batch-{batch_id}")


def opened(spark: SparkSession, out: str) -> Store:
    """The store in ``out``; an empty one if there is none."""
    store = Store(spark, out)
    try:
        store.log().isEmpty()
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        store.create()
    return store


def ingest_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, archive: str | None = None,
                  pattern: str = "report_*.txt", as_of: str = "9999-12-31", per_batch: int | None = None) -> StreamingQuery:
    """Pick up the files that are new since the last call, then stop. Files are
    remembered by the checkpoint; with ``archive`` they are moved once done; at most ``per_batch`` of them are one load."""
    opened(spark, out)
    reader = spark.readStream.option("pathGlobFilter", pattern)
    if archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    if per_batch:
        reader = reader.option("maxFilesPerTrigger", per_batch)
    text = reader.text(folder).select("value", "_metadata")
    return (text.writeStream.foreachBatch(lambda df, i: process_batch(df, i, out, as_of))
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def current(spark: SparkSession, out: str, table: str) -> DataFrame:
    """Current rows of a target."""
    return Store(spark, out).table(table)


def visitors(spark: SparkSession, out: str, as_of: str) -> DataFrame:
    return Store(spark, out).visitors(as_of)


def compact(spark: SparkSession, out: str) -> int:
    """Fold everything committed into one snapshot."""
    return Store(spark, out).compact()
