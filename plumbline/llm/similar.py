"""Near-duplicates by words: texts whose sets of five-word shingles have a Jaccard similarity of at least 0.8.

Fingerprints within four bits (``simhash``) miss most texts between 0.8 and 0.9, so texts are also joined by an exact set-similarity join: in one order of all
shingles, two similar texts share a shingle among the first fifth of the larger and the first ninth of the smaller one (prefix filter), at places and with sizes that allow
the overlap. No pair is lost, whatever the order is. The order decides only how many others meet: frequent shingles come last, so texts
that have passages in common, or are of one family but below 0.8, meet in few. What is frequent is read off a sample.

Before two texts are compared, their bitmaps are: these tell most pairs apart that share a passage only, and never one that is similar. A bitmap grows with its
text; one of a fixed size is full for a long text and tells nothing apart, and sets of long texts are most of what is moved.

Pairs in one group already are not compared: members of a file are first compared with one of them, in a few rounds, and groups joined; then
all pairs that are left are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..session import write_once
from .common import keyed
from .components import connected_components
from .scan import SPACED, Words, runs, slices
from .simhash import fingerprints_of, grouped, one_of_groups

SHINGLE = 5
#: Of one text in so many, shingles that stand in at least LEAST of these texts count as frequent; at most FREQUENT of them, the most
#: frequent ones, are sent to the tasks (8 MB). They change the order, not the result.
SAMPLE, LEAST, FREQUENT = 16, 3, 1_000_000
#: Bits of a block of the bitmap of a text: every shingle toggles one, so two texts differ in at least as many shingles as bits. A bitmap has a bit or more for each
#: shingle, in at most BLOCKS blocks (128 KB); longer texts are told apart less well by it, and compared all the same.
BITS, BLOCKS = 1024, 1024
#: Before all pairs of a file are compared, members are compared with one of them, in so many rounds at most.
STARS = 2
#: About so many entries to a task of the join.
ENTRIES = 500_000
ENTRY = np.dtype([("h", "<u8"), ("text", "<i8"), ("n", "<i4"), ("at", "<i4")])


def shingles_of(found: Words) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, in order, and how many each text has. A text of fewer than
    five words has one, of all its words."""
    h, n = found.hashes(), np.where(found.n >= SHINGLE, found.n - SHINGLE + 1, np.minimum(found.n, 1))
    out, place = np.empty(int(n.sum()), np.uint64), np.cumsum(n) - n
    long = np.repeat(found.n >= SHINGLE, n)
    first = np.repeat(found.first[:-1] - place, n) + np.arange(len(out))
    out[long] = runs(h, SHINGLE)[first[long]]
    for i in np.flatnonzero((found.n > 0) & (found.n < SHINGLE)):
        a, b = found.first[i], found.first[i + 1]
        out[place[i]] = runs(h[a:b], int(b - a))[0] + np.uint64(b - a)
    return out, n


def distinct_shingles(h: np.ndarray, n: np.ndarray, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different shingles of every text, frequent ones last, each part by hash; and how many there are."""
    text = np.repeat(np.arange(len(n)), n)
    late = np.zeros(len(h), bool)
    if len(frequent):
        late = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
    by = np.lexsort((h, late, text))
    h, text = h[by], text[by]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], np.bincount(text[new], minlength=len(n))


def blocks_of(n: np.ndarray) -> np.ndarray:
    """How many blocks the bitmap of a text of n different shingles has: a power of two."""
    blocks = np.ones(len(n), np.int64)
    while (short := (blocks * BITS < n) & (blocks < BLOCKS)).any():
        blocks[short] *= 2
    return blocks


def bitmaps(h: np.ndarray, n: np.ndarray, blocks: np.ndarray | None = None) -> np.ndarray:
    """The bitmaps of the different shingles of every text: (texts, BITS / 64) of one block each, or all words in a row of as many blocks as given. The second half of a bitmap
    XORed on the first is the bitmap of half as many blocks."""
    width = np.ones(len(n), np.int64) if blocks is None else blocks
    top = 64 - BITS.bit_length() + 1
    block = (h >> np.uint64(top - BLOCKS.bit_length() + 1)).astype(np.int64) & np.repeat(width - 1, n)
    at = (np.repeat(np.cumsum(width) - width, n) + block) * BITS + (h >> np.uint64(top)).astype(np.int64)
    odd = np.bincount(at, minlength=int(width.sum()) * BITS) & 1
    words = np.packbits(odd.astype(np.uint8)).view(np.int64)
    return words.reshape(len(n), BITS // 64) if blocks is None else words


def frequent_shingles(docs: DataFrame) -> np.ndarray:
    """Sorted hashes of frequent shingles of the sample."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                h, n = shingles_of(Words(part.column("text"), SPACED))
                h, n = distinct_shingles(h, n, np.empty(0, np.uint64))
                fresh = []
                for key in part.column("text_key").to_pylist():
                    fresh.append(key not in seen)
                    seen.add(key)
                keep = np.repeat(np.array(fresh, bool), n)
                yield pa.RecordBatch.from_arrays([pa.array(h[keep].view(np.int64))], names=["h"])

    some = keyed(docs).where(F.pmod(F.xxhash64("text_key"), F.lit(SAMPLE)) == 0).select("text_key", "text")
    # a text repeated in several tasks counts there again, which makes its shingles come late
    counted = some.mapInArrow(look, "h bigint").groupBy("h").agg(F.count("*").alias("n"))
    counted = write_once(counted.where(F.col("n") >= LEAST), "frequent-shingles")
    sizes, total, least = counted.groupBy("n").count().orderBy(F.desc("n")), 0, None
    for r in sizes.collect():  # a row per count; the most frequent ones that fit
        total += r["count"]
        if total > FREQUENT:
            break
        least = r.n
    if least is None:
        return np.empty(0, np.uint64)
    return np.sort(np.array([r.h for r in counted.where(F.col("n") >= least).select("h").collect()], np.int64).view(np.uint64))


def marked(docs: DataFrame, frequent: np.ndarray) -> DataFrame:
    """(doc_id, text_key, fingerprint, n, prefix, bits) for every row: how many different shingles, the first fifth of them (binary; empty where the task had the same text before, or
    there is none) and their bitmap (empty where the prefix is). One read of the texts for fingerprints, prefixes and bitmaps."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for part in slices(batch):
                found = Words(part.column("text"), SPACED)
                h, n = distinct_shingles(*shingles_of(found), frequent)
                fresh = []
                for key in part.column("text_key").to_pylist():
                    fresh.append(key not in seen)
                    seen.add(key)
                told = np.array(fresh, bool) & (n > 0)
                first = np.where(told, n // 5 + 1, 0)
                keep = np.arange(len(h)) - np.repeat(np.cumsum(n) - n, n) < np.repeat(first, n)
                edges = np.concatenate(([0], np.cumsum(first) * 8)).astype(np.int32)
                lists = pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(edges), pa.py_buffer(h[keep].tobytes())])
                blocks = blocks_of(n[told])
                words = np.zeros(len(n), np.int64)
                words[told] = blocks * (BITS // 64)
                bits = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(words)).astype(np.int32)), pa.array(bitmaps(h[np.repeat(told, n)], n[told], blocks)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(fingerprints_of(part.column("text"), found)), pa.array(n.astype(np.int32)), lists, bits],
                                                 names=["doc_id", "text_key", "fingerprint", "n", "prefix", "bits"])

    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(mark, "doc_id bigint, text_key bigint, fingerprint bigint, n int, prefix binary, bits array<bigint>")


def files(texts: DataFrame) -> DataFrame:
    """(h, text_key, n, at): entries of shingles in which two different texts meet, at least one of them within its first ninth. Entries of a batch move together."""
    total = texts.agg(F.sum(F.octet_length("prefix")).cast("bigint")).first()[0] or 0
    units = max(1, total // 8 // ENTRIES + 1)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("prefix").to_pylist()
            size = np.array([len(x) // 8 for x in lists], np.int64)
            e = np.empty(int(size.sum()), ENTRY)
            e["h"] = np.frombuffer(b"".join(lists), "<u8")
            e["text"], e["n"] = np.repeat(batch.column("text_key").to_numpy(), size), np.repeat(batch.column("n").to_numpy(), size)
            e["at"] = np.arange(len(e)) - np.repeat(np.cumsum(size) - size, size)
            unit = (e["h"] >> np.uint64(16)) % np.uint64(units)
            by = np.argsort(unit, kind="stable")
            e, unit = e[by], unit[by]
            edge = np.flatnonzero(np.diff(unit, prepend=np.uint64(units)))
            offsets = np.append(edge, len(e)) * ENTRY.itemsize
            yield pa.RecordBatch.from_arrays([pa.array(unit[edge].astype(np.int32)), pa.Array.from_buffers(pa.binary(), len(edge), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(e.tobytes())])],
                                             names=["unit", "entries"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = np.frombuffer(b"".join(x for batch in batches for x in batch.column("entries").to_pylist()), ENTRY)
        e = e[np.lexsort((e["text"], e["h"]))]
        if len(e):
            same = np.zeros(len(e), bool)
            same[1:] = (e["h"][1:] == e["h"][:-1]) & (e["text"][1:] == e["text"][:-1])
            e = e[~same]
            edge = np.flatnonzero(np.diff(e["h"], prepend=e["h"][0] + np.uint64(1)))
            many = np.diff(np.append(edge, len(e))) > 1
            indexed = np.maximum.reduceat(e["at"] <= e["n"] // 9, edge)
            e = e[np.repeat(many & indexed, np.diff(np.append(edge, len(e))))]
        for a in range(0, len(e), 10_000):
            p = e[a:a + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(p["h"].view(np.int64) if p["h"].flags.c_contiguous else np.ascontiguousarray(p["h"]).view(np.int64)), *(pa.array(np.ascontiguousarray(p[c])) for c in ("text", "n", "at"))],
                                             names=["h", "text_key", "n", "at"])

    dealt = texts.where("prefix is not null and octet_length(prefix) > 0").select("text_key", "n", "prefix").mapInArrow(deal, "unit int, entries binary")
    return dealt.groupBy("unit").applyInArrow(meet, "h bigint, text_key bigint, n int, at int")


def sets(docs: DataFrame) -> DataFrame:
    """(text_key, shingles): the different shingles of every row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                h, n = distinct_shingles(*shingles_of(Words(part.column("text"), SPACED)), np.empty(0, np.uint64))
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)).astype(np.int32)), pa.array(h.view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column("text_key"), lists], names=["text_key", "shingles"])

    return docs.select("text_key", "text").mapInArrow(mark, "text_key bigint, shingles array<bigint>")


def alike(pairs: DataFrame, bits: DataFrame) -> DataFrame:
    """The pairs (x, y, nx, ny, a, b) whose bitmaps differ in no more bits than texts of a similarity of 4/5 may in shingles. One text may have up to 5/4 of the other's
    shingles, so one bitmap may be twice as long as the other; it is folded then."""
    side = lambda x: bits.select(F.col("text_key").alias(x), F.col("bits").alias(f"b{x}"))
    both = pairs.join(side("x"), "x").join(side("y"), "y")
    half = F.least(F.size("bx"), F.size("by"))
    xor = lambda p, q: p.bitwiseXOR(q)
    folded = lambda c: F.when(F.size(c) > half, F.zip_with(F.slice(c, 1, half), F.slice(c, half + 1, half), xor)).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(folded("bx"), folded("by"), lambda p, q: F.bit_count(xor(p, q))), F.lit(0), lambda s, n: s + n)
    return both.where(differ * 9 <= F.col("nx") + F.col("ny")).select("x", "y", "a", "b")


def similar(pairs: DataFrame, of: DataFrame) -> DataFrame:
    """The pairs (x, y, a, b) of texts x and y with a similarity of at least 4/5, as links (a, b)."""
    one = pairs.join(of.select(F.col("text_key").alias("x"), F.col("shingles").alias("sx")), "x")
    two = one.join(of.select(F.col("text_key").alias("y"), F.col("shingles").alias("sy")), "y")
    common = F.size(F.array_intersect("sx", "sy"))
    return two.where(common * 9 >= (F.size("sx") + F.size("sy")) * 4).select("a", "b")


def sets_of(docs: DataFrame, pairs: DataFrame) -> DataFrame:
    """``sets`` of the texts in ``pairs``, each once."""
    # written, so that its size is known: a small one is sent to the texts, which then are not shuffled
    some = write_once(pairs.select(F.col("x").alias("text_key")).union(pairs.select("y")).distinct(), "some")
    return write_once(sets(keyed(docs).select("text_key", "text").join(some, "text_key", "left_semi").dropDuplicates(["text_key"])), "sets")


def groups(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, root, component_id) for every row: groups of ``simhash.near_duplicates`` joined where two of their texts
    are similar by words.

    Null, empty and blank texts have fingerprint zero, which links them, and no shingle; a text of fewer than five words has one shingle, all of it; a repeated text is
    one text; rows without an id take part; texts of any length are compared whole; other columns are not read; no rows, no rows.
    """
    all_marked = write_once(marked(docs, frequent_shingles(docs)), "marked")
    near = write_once(grouped(all_marked.select("doc_id", "text_key", "fingerprint")), "near")
    of = write_once(near.groupBy("text_key").agg(F.first("root").alias("root")), "roots-of-texts")
    met = write_once(files(all_marked), "files").join(of, "text_key")
    of_several = lambda m: m.groupBy("h").agg(F.min("root").alias("_lo"), F.max("root").alias("_hi")).where("_lo <> _hi").select("h")
    met = write_once(met, "rooted-files")
    members = write_once(met.join(write_once(of_several(met), "mixed-files"), "h"), "members")
    if members.isEmpty():
        return near
    some = write_once(members.select("text_key").distinct(), "compared")
    bits = write_once(all_marked.where(F.octet_length("prefix") > 0).join(some, "text_key", "left_semi").dropDuplicates(["text_key"]).select("text_key", "bits"), "bitmaps")
    first = of.select("root").distinct().select("root", F.col("root").alias("to"))
    fits = "least(nx, ny) * 5 >= greatest(nx, ny) * 4"
    for turn in range(STARS + 1):
        if members.isEmpty():
            break
        if turn < STARS:
            # the first by a hash of the text, which is the same in most files of like texts
            by = F.struct(F.xxhash64("text_key", F.lit(turn)).alias("hash"), F.col("text_key").alias("x"), F.col("n").alias("nx"), F.col("root").alias("a"))
            heads = write_once(members.groupBy("h").agg(F.min(by).alias("head")).select("h", "head.x", "head.nx", "head.a"), "heads")
            pairs = members.select("h", F.col("text_key").alias("y"), F.col("n").alias("ny"), F.col("root").alias("b")).join(heads, "h").where("a <> b").where(fits)
        else:
            # the smaller text within its first ninth, the larger within its first fifth, at places that leave enough shingles to share
            side = lambda x, r: members.select("h", F.col("text_key").alias(x), F.col("n").alias(f"n{x}"), F.col("at").alias(f"p{x}"), F.col("root").alias(r))
            pairs = side("x", "a").where("px <= nx div 9").join(side("y", "b"), "h").where("a <> b and (nx < ny or (nx = ny and (x < y or py > ny div 9)))").where(fits)
            pairs = pairs.where("9 * least(nx - px, ny - py) >= 4 * (nx + ny)")
        pairs = alike(write_once(pairs.select("x", "y", "nx", "ny", "a", "b").distinct(), "pairs"), bits)
        pairs = write_once(pairs, "alike-pairs")
        joined = connected_components(similar(pairs, sets_of(docs, pairs)), "similar")
        joined = write_once(joined.select(F.col("node").alias("_n"), F.col("root").alias("_r")), "joined")
        first = write_once(first.join(joined, F.col("to") == F.col("_n"), "left").select("root", F.coalesce("_r", "to").alias("to")), "moved")
        if turn < STARS:
            members = write_once(members.join(joined, F.col("root") == F.col("_n"), "left").select("h", "text_key", "n", "at", F.coalesce("_r", "root").alias("root")), "members")
            members = write_once(members.join(write_once(of_several(members), "mixed-files"), "h"), "members")
    ids = near.groupBy("root").agg(F.min("component_id").alias("smallest")).join(first, "root")
    ids = write_once(ids, "joined-ids")
    least = write_once(ids.groupBy("to").agg(F.min("smallest").alias("component_id")), "least-ids")
    ids = write_once(ids.join(least, "to").select("root", "to", "component_id"), "ids-of-roots")
    return near.drop("component_id").join(ids, "root").select("doc_id", "text_key", F.col("to").alias("root"), "component_id")


def one_of_each(docs: DataFrame) -> DataFrame:
    """``docs`` with one row of each group: the one with the smallest id; of repeated rows with it, and of texts with it, one. A group of rows without an
    id keeps one of them. All columns stay."""
    return one_of_groups(docs, groups(docs))
