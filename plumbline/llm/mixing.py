"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every source gets its share of all words by weight, up to a number of repeats of what it has; what it can't use is shared among the others.
A source's target is as many complete epochs as fit, and a selection for the rest: every document draws an exponential number divided by its quality,
documents are sorted by it within their source, and their sizes summed until the budget is full. The last one is cut.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..operators.windows import surrogate_key
from ..session import write_once
from .common import text_key
from .segments import SEGMENT, segmented

#: Weights of the sources in their order, repeating; no document is taken more often than MOST times.
WEIGHTS, MOST, SEED = (1, 2, 3), 3, "mix"
#: Quality of documents labelled good, bad and not at all.
GOOD, BAD, UNKNOWN = 2.0, 0.5, 1.0
SPACE = "[^\\x20\\x09-\\x0D]+"


def exponential(doc_id: Column, text: Column, quality: Column, seed: str = SEED) -> Column:
    """An exponential number of rate ``quality``, the same at every run."""
    h = F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(":"), F.coalesce(text, F.lit(""))))
    u = (F.conv(F.left(h, F.lit(13)), 16, 10).cast("double") + 0.5) / float(1 << 52)
    return -F.ln(u) / quality


def qualities(labels: DataFrame, good: float = GOOD, bad: float = BAD) -> DataFrame:
    """(doc_id, quality) from labels 1 and 0; of several labels of a document the better one counts. Rows without id or label say nothing."""
    best = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.max("quality").alias("q"))
    return best.select("doc_id", F.when(F.col("q") > 0, F.lit(good)).otherwise(F.lit(bad)).alias("quality"))


def measured(docs: DataFrame, quality: DataFrame, seed: str, unknown: float) -> DataFrame:
    """(doc_id, text_key, source, size, key) for every row; the texts are read once and stay behind."""
    text = F.col("text").cast("string")
    sized = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_key(text).alias("text_key"), F.col("source").cast("string").alias("source"),
                        F.coalesce(F.regexp_count(text, F.lit(SPACE)), F.lit(0)).cast("bigint").alias("size"), exponential(F.col("doc_id").cast("bigint"), text, F.lit(1.0), seed).alias("draw"))
    of = quality.select(F.col("doc_id").cast("bigint").alias("_doc"), F.col("quality").cast("double").alias("_quality"))
    both = sized.join(of, F.col("doc_id") == F.col("_doc"), "left")
    return both.select("doc_id", "text_key", "source", "size", (F.col("draw") / F.coalesce("_quality", F.lit(unknown))).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, source_size, target) from (source, source_size), a row per source.

    Sources are numbered by code point, null last, without gathering them. A round gives each open source its weight's share of what the full ones leave; those that
    would pass ``most`` times their size become full, until none does. Shares are compared as whole numbers.
    """
    numbered = surrogate_key(sizes, [F.col("source").asc_nulls_last()], "_place")
    w = F.element_at(F.array(*[F.lit(x).cast("bigint") for x in weights]), ((F.col("_place") - 1) % len(weights) + 1).cast("int"))
    rows = write_once(numbered.select("source", "source_size", w.alias("_w")), "sources")
    whole = "decimal(38,0)"
    room = F.col("source_size").cast(whole) * most
    first = rows.agg(F.sum(F.col("source_size").cast(whole)).alias("t"), F.sum("_w").alias("w")).first()
    total, left, weight = int(first.t or 0), int(first.t or 0), int(first.w or 0)
    full = F.lit(False)
    while weight:
        # decimal(38) may overflow with sizes near 2^63: such a comparison is made with doubles
        over = F.coalesce(F.try_multiply(room, F.lit(weight).cast(whole)) < F.try_multiply(F.lit(left).cast(whole), F.col("_w").cast(whole)),
                          room.cast("double") * weight < F.lit(float(left)) * F.col("_w"))
        r = rows.where(over).agg(F.sum(room).alias("t"), F.sum("_w").alias("w")).first()
        now, open_weight = total - int(r.t or 0), int(first.w) - int(r.w or 0)
        full = over
        if open_weight == weight:
            break
        left, weight = now, open_weight
    share = F.lit(float(Fraction(left, weight)) if weight else 0.0)
    cap = F.col("source_size").cast("double") * most
    return rows.select("source", "source_size", F.when(full, cap).otherwise(F.least(cap, share * F.col("_w"))).alias("target"))


def mix(docs: DataFrame, quality: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, seed: str = SEED, unknown: float = UNKNOWN) -> DataFrame:
    """(doc_id, text_key, source, size, source_size, target, epochs, part, taken) for every row: whole passes over the document, words of one more, and words in all.

    ``docs`` has doc_id, text, source; ``quality`` (doc_id, quality above 0), a row per document at most; documents without one have ``unknown``. A null or empty text has no words and is taken with none; a
    null source is the last one; repeated rows are taken each; rows of one doc_id with different texts draw numbers of their own; a null doc_id has no quality;
    ties of a draw are ordered by id and text, and only identical rows are left in any order; other columns are not read; no rows, no rows. A source of any size is spread over segments of the order, carried on by
    one sum per segment. Reruns give the same rows.
    """
    if min(weights) < 1 or most < 1:
        raise ValueError("weights and repeats are whole numbers from 1 on")
    rows = segmented(measured(docs, quality, seed, unknown), "source", "key", "doc_id", "text_key", "size", name="draws")
    parts = write_once(rows.groupBy("source", SEGMENT).agg(F.sum("size").alias("_words")), "source-segments")
    plan = write_once(targets(parts.groupBy("source").agg(F.sum("_words").alias("source_size")), weights, most), "targets")
    earlier = Window.partitionBy("source").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    upto = parts.select(F.col("source").alias("_source"), F.col(SEGMENT).alias("_segment"), F.coalesce(F.sum("_words").over(earlier), F.lit(0)).alias("_earlier"))
    upto = write_once(upto.join(plan, upto["_source"].eqNullSafe(plan["source"])).drop("source"), "source-plan")
    inside = Window.partitionBy(SEGMENT, "source").orderBy("key", "doc_id", "text_key", "size").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.withColumn("_upto", F.sum("size").over(inside) - F.col("size"))
    both = local.join(upto, local["source"].eqNullSafe(upto["_source"]) & (local[SEGMENT] == upto["_segment"]))
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("bigint")
    both = both.withColumn("epochs", epochs)
    budget = F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("bigint")
    both = both.withColumn("part", F.least(F.col("size"), F.greatest(F.lit(0).cast("bigint"), budget - F.col("_earlier") - F.col("_upto"))))
    return both.select("doc_id", "text_key", "source", "size", "source_size", "target", "epochs", "part", (F.col("epochs") * F.col("size") + F.col("part")).alias("taken"))


def mixed(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The mix itself: doc_id, source, text, and how many times it stands there: a document with its complete epochs, and the first words of its part. Repeated rows are
    one row taken more often, so a group of any size moves as one row; a text of which no word is taken is left out."""
    text = F.col("text").cast("string")
    have = docs.select(F.col("doc_id").cast("bigint").alias("_id"), text_key(text).alias("_text_key"), F.col("source").cast("string").alias("_source"), text.alias("text")).dropDuplicates(["_id", "_text_key", "_source"])
    same = ["doc_id", "text_key", "source"]
    whole = plan.where("epochs > 0 and size > 0").groupBy(*same).agg(F.sum("epochs").alias("times")).withColumn("words", F.lit(None).cast("bigint"))
    part = plan.where("part > 0").groupBy(*same, F.col("part").alias("words")).agg(F.count("*").alias("times")).select(*whole.columns)
    takes = write_once(whole.union(part), "takes")
    joined = takes.join(have, F.col("_id").eqNullSafe(F.col("doc_id")) & (F.col("_text_key") == F.col("text_key")) & F.col("_source").eqNullSafe(F.col("source")))
    first = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(SPACE), F.lit(0)), F.lit(1), F.col("words").cast("int")), " ")
    return joined.select("doc_id", "source", F.when(F.col("words").isNull(), F.col("text")).otherwise(first).alias("text"), "times")


def digest(plan: DataFrame) -> DataFrame:
    return plan.select("doc_id", "size", "source_size", "target", "taken")
