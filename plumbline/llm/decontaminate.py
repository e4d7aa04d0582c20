"""Benchmark decontamination by winnowing.

Of every GUARANTEE - K + 1 consecutive K-grams of words, the one of least hash is kept (of equals, the
last). A window of GUARANTEE words keeps the same K-gram wherever it stands, so documents and benchmark items that
share such a window share a kept K-gram. These are joined, and each match is extended to the words of the whole window
around it, which are compared as text. An item of fewer words is one window, kept whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_once
from .common import keyed, same_document, text_key
from .scan import ALNUM, Table, Words, mixed, runs, slices

GUARANTEE, K = 10, 5
#: Benchmarks of up to so many different kept hashes (8 bytes each) are sent to the tasks; larger ones are joined.
SENT = 500_000


def winnow(h: np.ndarray, found: Words, guarantee: int = GUARANTEE, k: int = K) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each window of ``guarantee`` words inside one text: its first word, the first word of
    the K-gram it keeps, and that K-gram's hash."""
    grams, width = runs(h, k), guarantee - k + 1
    total = len(grams) - width + 1
    if total <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint64)
    least, at = grams[:total].copy(), np.zeros(total, np.int64)
    for i in range(1, width):
        here = grams[i:total + i]
        lower = here <= least
        least[lower], at[lower] = here[lower], i
    inside = np.zeros(len(h), bool)
    long = np.flatnonzero(found.n >= guarantee)
    change = np.zeros(len(h) + 1, np.int64)
    np.add.at(change, found.first[:-1][long], 1)
    np.subtract.at(change, found.first[1:][long] - guarantee + 1, 1)
    inside = np.cumsum(change)[:total] > 0
    first = np.flatnonzero(inside)
    return first, first + at[first], least[first]


def short(h: np.ndarray, found: Words, length: int) -> tuple[np.ndarray, np.ndarray]:
    """First word and hash of every run of ``length`` words inside one text; lengths do not mix."""
    total = len(h) - length + 1
    if total <= 0:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    text = np.repeat(np.arange(len(found.n)), found.n)
    first = np.flatnonzero(text[:total] == text[length - 1:])
    return first, mixed(runs(h, length)[first] + np.uint64(length))


def phrase(found: Words, first: int, n: int) -> str:
    return " ".join(found.text(i) for i in range(first, first + n))


def windows(benchmark: DataFrame, guarantee: int = GUARANTEE, k: int = K) -> DataFrame:
    """(item_id, h, offset, n, phrase): every window of every item, with the hash it keeps."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                found = Words(part.column("text"), ALNUM)
                h = found.hashes()
                first, kept, least = winnow(h, found, guarantee, k)
                rows = [(f, int(x) - f, v, guarantee) for f, x, v in zip(first.tolist(), kept.tolist(), least.tolist())]
                for n in sorted(set(found.n[(found.n > 0) & (found.n < guarantee)].tolist())):
                    begin = set(found.first[:-1][found.n == n].tolist())
                    rows += [(f, 0, v, n) for f, v in zip(*(x.tolist() for x in short(h, found, n))) if f in begin]
                item = np.searchsorted(found.first, [r[0] for r in rows], "right") - 1 if rows else np.empty(0, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column("item_id").take(pa.array(item, pa.int64())), pa.array(np.array([r[2] for r in rows], np.uint64).view(np.int64)),
                     pa.array([r[1] for r in rows], pa.int32()), pa.array([r[3] for r in rows], pa.int32()),
                     pa.array([phrase(found, r[0], r[3]) for r in rows], pa.string())], names=["item_id", "h", "offset", "n", "phrase"])

    return benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut, "item_id string, h bigint, offset int, n int, phrase string")


HIT = "array<struct<h: bigint, first: int, before: int, around: string>>"


def _hits(found: Words, h: np.ndarray, lengths: list[int], guarantee: int, k: int):
    """Kept places of all texts, each once: first word, hash."""
    _, kept, least = winnow(h, found, guarantee, k)
    if len(kept):
        new = np.diff(kept, prepend=-1) != 0
        kept, least = kept[new], least[new]
    yield kept, least
    for n in lengths:
        yield short(h, found, n)


def scan_documents(docs: DataFrame, lengths: list[int], known: np.ndarray | None, guarantee: int = GUARANTEE, k: int = K) -> DataFrame:
    """(doc_id, text_key, n_words, hits, hashes). With ``known``, hits are the places whose hash is known, with
    the words around; without, hashes has all hashes kept, unless a column ``wanted`` names those to look for."""
    wanted = "wanted" in docs.columns

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = Table()
        if known is not None:
            table.add(known, np.zeros(len(known), np.int32))
        for batch in batches:
            for part in slices(batch):
                found = Words(part.column("text"), ALNUM)
                h = found.hashes()
                kept, least = (np.concatenate(x) for x in zip(*_hits(found, h, lengths, guarantee, k)))
                doc = np.searchsorted(found.first, kept, "right") - 1
                hits: list[list | None] = [[] for _ in range(part.num_rows)]
                hashes: list[np.ndarray] | None = None
                if known is not None or wanted:
                    if wanted:
                        mine = [set(x) for x in part.column("wanted").to_pylist()]
                        at = [i for i, (d, v) in enumerate(zip(doc.tolist(), least.view(np.int64).tolist())) if v in mine[d]]
                    else:
                        at = np.flatnonzero(table.find(least) >= 0).tolist()
                    for i in at:
                        d, p = int(doc[i]), int(kept[i])
                        a, b = max(int(found.first[d]), p - guarantee + 1), min(int(found.first[d + 1]), p + guarantee)
                        hits[d].append({"h": int(least[i:i + 1].view(np.int64)[0]), "first": p - int(found.first[d]), "before": p - a, "around": phrase(found, a, b - a)})
                else:
                    by = np.argsort(doc, kind="stable")
                    edge = np.searchsorted(doc[by], np.arange(part.num_rows + 1))
                    hashes = pa.ListArray.from_arrays(pa.array(edge.astype(np.int32)), pa.array(least[by].view(np.int64)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(found.n.astype(np.int64)),
                     pa.array(hits, pa.list_(pa.struct([("h", pa.int64()), ("first", pa.int32()), ("before", pa.int32()), ("around", pa.string())]))),
                     hashes if hashes is not None else pa.array([None] * part.num_rows, pa.list_(pa.int64()))],
                    names=["doc_id", "text_key", "n_words", "hits", "hashes"])

    return docs.mapInArrow(cut, f"doc_id bigint, text_key bigint, n_words bigint, hits {HIT}, hashes array<bigint>")


def covered(spans: Column) -> Column:
    """Words inside any of the (first, n) spans, sorted by first."""
    zero = F.struct(F.lit(0).cast("bigint").alias("n"), F.lit(0).alias("end"))
    step = lambda a, x: F.struct(
        (a["n"] + F.greatest(F.lit(0), x["first"] + x["n"] - F.greatest(a["end"], x["first"]))).cast("bigint").alias("n"),
        F.greatest(a["end"], x["first"] + x["n"]).alias("end"))
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def contamination(docs: DataFrame, benchmark: DataFrame, sent: int = SENT) -> DataFrame:
    """(doc_id, text_key, n_words, n_hit, n_items, items) for every row of ``docs``.

    A null or empty text has no words; repeated rows get the same result each, and rows of one doc_id with
    different texts are told apart; a null doc_id is kept. A null or empty item has no window, an
    item without an id counts as a hit but is not listed; other columns are not read. No
    items: nothing is hit. Texts of any length are read whole.
    """
    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    found = write_once(windows(benchmark), "windows").where("phrase is not null")
    lengths = [r.n for r in found.where(F.col("n") < GUARANTEE).select("n").distinct().collect()]  # at most GUARANTEE - 1 numbers
    hashes = write_once(found.select("h").distinct(), "window-hashes")
    if hashes.count() <= sent:
        known = np.array([r.h for r in hashes.collect()], np.int64).view(np.uint64)
        scanned = hit_rows = write_once(scan_documents(rows, lengths, known), "scanned")
    else:
        scanned = write_once(scan_documents(rows, lengths, None), "scanned")
        met = scanned.select("doc_id", "text_key", F.explode("hashes").alias("h")).join(hashes, "h", "left_semi")
        met = write_once(met.groupBy("doc_id", "text_key").agg(F.collect_set("h").alias("wanted")), "met")
        again = rows.join(met, same_document(rows, met)).select(rows["doc_id"], "text", rows["text_key"], "wanted")
        hit_rows = write_once(scan_documents(again, lengths, None), "scanned-again")
    hits = hit_rows.where(F.size("hits") > 0).select("doc_id", "text_key", F.explode("hits").alias("p")).select("doc_id", "text_key", "p.*").distinct()
    kinds = found.select("h", "offset", "n", "phrase").distinct()
    at = F.col("before") - F.col("offset")
    around = F.split("around", " ")
    whole = F.when((at >= 0) & (F.size(around) >= at + F.col("n")), F.array_join(F.slice(around, at + 1, F.col("n")), " "))
    spans = write_once(hits.join(kinds, "h").where(whole == F.col("phrase")).select("doc_id", "text_key", (F.col("first") - F.col("offset")).alias("first"), "n", "phrase"), "spans")
    hit = spans.groupBy("doc_id", "text_key").agg(covered(F.sort_array(F.collect_set(F.struct("first", "n")))).alias("n_hit"))
    items = found.where("item_id is not null").select("phrase", "item_id").distinct()
    listed = spans.select("doc_id", "text_key", "phrase").distinct().join(items, "phrase").groupBy("doc_id", "text_key").agg(F.sort_array(F.collect_set("item_id")).alias("items"))
    report = hit.join(listed, same_document(hit, listed), "left").select(hit["doc_id"], hit["text_key"], "n_hit", "items")
    report = write_once(report, "contamination")
    return scanned.join(report, same_document(scanned, report), "left").select(
        scanned["doc_id"], scanned["text_key"], "n_words", F.coalesce("n_hit", F.lit(0).cast("bigint")).alias("n_hit"),
        F.coalesce(F.size("items"), F.lit(0)).cast("bigint").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"))


def clean(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the documents that hold a window of an item; all columns stay."""
    hit = write_once(contamination(docs, benchmark).where("n_hit > 0").select(F.col("doc_id").alias("__hit_id"), F.col("text_key").alias("__hit_key")).distinct(), "contaminated")
    rows = docs.withColumn("__key", text_key())
    return rows.join(hit, rows["doc_id"].eqNullSafe(hit["__hit_id"]) & (rows["__key"] == hit["__hit_key"]), "left_anti").drop("__key")







def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
