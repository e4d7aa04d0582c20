"""License scan by an exact set-similarity join.

Texts are cut into overlapping blocks of words. A template is found in a block that holds at least THRESHOLD of the
template's different words. Words are ordered by their frequency over the whole corpus, rare ones first. Two sets that
share enough words share one among the first few of both (prefix filter); blocks with too few words are left out
(length filter), as are pairs that cannot reach the count after the word they met at (positional filter).
The overlap of all others is counted. Only words of templates can overlap, so blocks are compared by those.
"""

from __future__ import annotations

from collections.abc import Iterator

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import write_once
from .common import keyed, same_document, words
from .scan import ALNUM, Table, Words, slices

THRESHOLD = 0.8
#: All templates together may have so many words; they are sent to every task.
MOST_WORDS = 100_000

#: Phrases that name a license wherever their words stand one after another.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

#: Opening words of public license notices, by label.
TEMPLATES = {
    "agpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License",
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "unlicense": "This is free and unencumbered software released into the public domain",
}

#: Words that tell a notice from its neighbours: all of the first must stand in the block, none of the second.
DISTINGUISHING = {
    "agpl-3.0": ("gnu affero general public", ""),
    "apache-2.0": ("apache 2 0", ""),
    "bsd": ("source binary conditions", ""),
    "cc-by-nc-4.0": ("cc by nc 4 0", "sa nd"),
    "gpl-3.0": ("gnu general public 3", "affero lesser library"),
    "isc": ("permission use copy modify distribute", ""),
    "mit-grant": ("permission granted free charge software", ""),
    "mpl-2.0": ("mozilla public 2 0", ""),
    "unlicense": ("unencumbered public domain", ""),
}


def word_hash(found: list[str]) -> np.ndarray:
    column = Words(pa.array(found, pa.string()), ALNUM)
    return column.hashes()[column.first[:-1]] if found else np.empty(0, np.uint64)


def frequencies(docs: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(word, n): how often each word stands in the whole corpus; a row per word and task is shuffled."""
    hashes = word_hash(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = Table(), np.zeros(len(vocabulary), np.int64)
        table.add(hashes, np.arange(len(vocabulary), dtype=np.int32))
        for batch in batches:
            for part in slices(batch):
                at = table.find(Words(part.column("text"), ALNUM).hashes())
                n += np.bincount(at[at >= 0], minlength=len(n))
        yield pa.RecordBatch.from_arrays([pa.array(vocabulary, pa.string()), pa.array(n)], names=["word", "n"])

    return docs.select("text").mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


BLOCKS = "doc_id bigint, text_key bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, blocks array<struct<start: bigint, words: array<string>>>"


def places(found: Words, h: np.ndarray, phrase: np.ndarray) -> np.ndarray:
    """First words of all runs of words with these hashes inside one text."""
    total = len(h) - len(phrase) + 1
    if total <= 0:
        return np.empty(0, np.int64)
    at = np.flatnonzero(h[:total] == phrase[0])
    for i in range(1, len(phrase)):
        at = at[h[at + i] == phrase[i]]
    return at[np.searchsorted(found.first, at, "right") == np.searchsorted(found.first, at + len(phrase) - 1, "right")]


def cut_blocks(docs: DataFrame, vocabulary: list[str], rare: list[str], size: int, phrases: dict[str, str]) -> DataFrame:
    """For every row its words, places of phrases, and the blocks that hold one of the ``rare`` words:
    where they start and which words of the vocabulary they have. Blocks start at every half of their size."""
    hashes, rare_hashes = word_hash(vocabulary), word_hash(rare)
    spelled = [(label, word_hash(words(p))) for p, label in phrases.items()]
    step = size // 2

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, marks = Table(), Table()
        table.add(hashes, np.arange(len(vocabulary), dtype=np.int32))
        marks.add(rare_hashes, np.zeros(len(rare), np.int32))
        names = np.array(vocabulary, object)
        for batch in batches:
            for part in slices(batch):
                found = Words(part.column("text"), ALNUM)
                h = found.hashes()
                n, first, last = np.zeros(part.num_rows, np.int64), np.full(part.num_rows, np.iinfo(np.int64).max), np.full(part.num_rows, -1)
                base: list[list[str]] = [[] for _ in range(part.num_rows)]
                for label, phrase in spelled:
                    at = places(found, h, phrase)
                    doc = np.searchsorted(found.first, at, "right") - 1
                    np.add.at(n, doc, 1)
                    np.minimum.at(first, doc, at - found.first[doc])
                    np.maximum.at(last, doc, at - found.first[doc])
                    for d in np.unique(doc).tolist():
                        base[d].append(label)
                at = np.flatnonzero(marks.find(h) >= 0)
                doc = np.searchsorted(found.first, at, "right") - 1
                within = at - found.first[doc]
                block = np.unique(np.concatenate([np.stack((doc, b), 1) for b in (within // step, within // step - 1)]), axis=0)
                blocks: list[list[dict]] = [[] for _ in range(part.num_rows)]
                for d, b in block[block[:, 1] >= 0].tolist():
                    begin = int(found.first[d]) + b * step
                    known = table.find(h[begin:min(begin + size, int(found.first[d + 1]))])
                    blocks[d].append({"start": b * step, "words": names[np.unique(known[known >= 0])].tolist()})
                none = n == 0
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("text_key"), pa.array(found.n.astype(np.int64)), pa.array(n), pa.array(first, mask=none), pa.array(last, mask=none),
                     pa.array(base, pa.list_(pa.string())), pa.array(blocks, pa.list_(pa.struct([("start", pa.int64()), ("words", pa.list_(pa.string()))])))],
                    names=["doc_id", "text_key", "n_words", "n_base", "first_word", "last_word", "base", "blocks"])

    return docs.mapInArrow(cut, BLOCKS)


def template_rows(spark: SparkSession, sets: dict[str, list[int]], need: dict[str, int], telling: dict[str, tuple[list[int], list[int]]]) -> DataFrame:
    """(label, t, need, must, bar), words as ranks: in SQL, so that no Python task is needed for a few constants."""
    ranks = lambda v: F.array(*map(F.lit, v)).cast("array<int>")
    rows = [F.struct(F.lit(k).alias("label"), ranks(v).alias("t"), F.lit(need[k]).alias("need"), ranks(telling[k][0]).alias("must"), ranks(telling[k][1]).alias("bar")) for k, v in sets.items()]
    return spark.range(1).select(F.explode(F.array(*rows)).alias("r")).select("r.*")


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD,
         distinguishing: dict[str, tuple[str, str]] = DISTINGUISHING) -> DataFrame:
    """(doc_id, text_key, n_words, n_base, first_word, last_word, base, labels, score) for every row.

    Of the blocks that hold enough of a template, those count that have all its ``distinguishing`` words and none of those that mark another license. score is the largest share of a template found in a block, and 1 where a phrase stands. A null or empty text has no
    words, labels or places; repeated rows get the same result each; rows of one doc_id with different texts are told apart;
    a null doc_id stays; other columns are not read; texts of any length are read whole.
    """
    if not templates:
        raise ValueError("no template")
    sets = {label: sorted(set(words(text))) for label, text in templates.items()}
    if sum(map(len, sets.values())) > MOST_WORDS or not all(sets.values()):
        raise ValueError(f"templates need words, and {MOST_WORDS} at most")
    spark = docs.sparkSession
    telling = {label: tuple(words(d) for d in distinguishing.get(label, ("", ""))) for label in sets}
    vocabulary = sorted({w for s in sets.values() for w in s} | {w for t in telling.values() for side in t for w in side})
    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # as many rows as the vocabulary has words, which is bounded above
    order = sorted((r.n or 0, r.word) for r in frequencies(rows, vocabulary).collect())
    rank = {w: i for i, (_, w) in enumerate(order)} or {w: i for i, w in enumerate(vocabulary)}
    need = {label: max(1, math.ceil(threshold * len(s) - 1e-9)) for label, s in sets.items()}
    ranked = {label: sorted(s, key=rank.__getitem__) for label, s in sets.items()}
    rare = sorted({w for label, s in ranked.items() for w in s[:len(s) - need[label] + 1]})
    size = 2 * max(len(words(t)) for t in templates.values())
    cut = write_once(cut_blocks(rows, vocabulary, rare, size, phrases), "license-blocks")

    ranks = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(w).alias("word"), F.lit(i).alias("rank")) for w, i in rank.items()])).alias("r")).select("r.*")
    block = ["doc_id", "text_key", "start"]
    in_block = cut.where(F.size("blocks") > 0).select("doc_id", "text_key", F.explode("blocks").alias("b")).select("doc_id", "text_key", "b.start", "b.words").distinct()
    least = min(need.values())
    with_ranks = in_block.where(F.size("words") >= least).select(*block, F.explode("words").alias("word")).join(F.broadcast(ranks), "word")  # at most MOST_WORDS rows
    ordered = write_once(with_ranks.groupBy(*block).agg(F.sort_array(F.collect_list("rank")).alias("b")), "license-ranks")
    wanted = template_rows(spark, {k: [rank[w] for w in v] for k, v in ranked.items()}, need, {k: tuple([rank[w] for w in side] for side in v) for k, v in telling.items()})
    wanted = wanted.select("label", "t", "need", "must", "bar", F.posexplode(F.slice("t", F.lit(1), F.size("t") - F.col("need") + 1)).alias("ti", "rank"))
    probes = ordered.select(*block, "b", F.posexplode("b").alias("bi", "rank")).where(F.col("bi") <= F.size("b") - least)
    met = probes.join(F.broadcast(wanted), "rank").where(  # at most MOST_WORDS rows
        (F.size("b") >= F.col("need")) & (F.col("bi") <= F.size("b") - F.col("need"))
        & (1 + F.least(F.size("t") - F.col("ti") - 1, F.size("b") - F.col("bi") - 1) >= F.col("need")))
    share = F.size(F.array_intersect("b", "t"))
    plain = (F.size(F.array_intersect("b", "must")) == F.size("must")) & (F.size(F.array_intersect("b", "bar")) == 0)
    hits = met.select(*block, "label", "b", "t", "need", "must", "bar").distinct().where((share >= F.col("need")) & plain).select(*block, "label", (share / F.size("t")).alias("share"))
    labels = write_once(hits.groupBy("doc_id", "text_key").agg(F.collect_set("label").alias("found"), F.max("share").alias("share")), "license-labels")
    return cut.join(labels, same_document(cut, labels), "left").select(
        cut["doc_id"], cut["text_key"], "n_words", "n_base", "first_word", "last_word", F.sort_array(F.array_distinct("base")).alias("base"),
        F.sort_array(F.array_union("base", F.coalesce("found", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("share", F.lit(0.0))).alias("score"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
