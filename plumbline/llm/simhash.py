"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints differ in at most R bits exactly if some value lies within R/2 bits of both. So
every fingerprint emits all values of the ball of radius R/2 around it, and those that meet at a
value are linked. Values are shuffled by a slot: the value's 64 bits folded to a few by XOR.
Flipping at most two bits changes the slot in few ways, so a fingerprint is sent once to every slot that
one of its values falls in, and the values of a slot are made from the fingerprints there.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..session import write_once
from .common import keyed, text_key
from .components import connected_components
from .scan import SPACED, Words, slices

SEED, SHINGLE, RADIUS = 42, 4, 4
#: About so many values meet in a slot; so many are made at a time.
SLOT_VALUES, VALUES = 4_000_000, 1_000_000
#: Shingles whose bits are counted at a time.
COUNTED = 1 << 15


def shingle_hashes(found: Words, k: int = SHINGLE, seed: int = SEED) -> tuple[np.ndarray, np.ndarray]:
    """XXH64 of the shingles of all texts, in order, and how many each text has. A text of fewer than
    k words has one, of all its words."""
    data, start, end = found.data, found.start, found.end
    keep = np.append(found.inside, False)
    after = end[~keep[end]]
    data = np.append(data, 32).astype(np.uint8)
    data[after] = 32
    keep[after] = True
    place = np.cumsum(keep) - keep
    raw, start, end = data[keep].tobytes(), place[start], place[end - 1] + 1
    n = np.where(found.n >= k, found.n - k + 1, np.minimum(found.n, 1))
    first = np.repeat(found.first[:-1] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    last = np.minimum(first + k, np.repeat(found.first[1:], n)) - 1
    digest = xxhash.xxh64_intdigest
    return np.array([digest(raw[a:b], seed) for a, b in zip(start[first].tolist(), end[last].tolist())], np.uint64), n


def fingerprints_of(column: pa.Array, found: Words | None = None) -> np.ndarray:
    """A signed 64-bit number for each text; zero for no words. ``found``: the words of the column, if they are known."""
    found = found or Words(column, SPACED)
    h, n = shingle_hashes(found)
    text, ones = np.repeat(np.arange(len(n)), n), np.zeros((len(n), 64), np.int64)
    for a in range(0, len(h), COUNTED):
        part, of = h[a:a + COUNTED], text[a:a + COUNTED]
        edge = np.flatnonzero(np.diff(of, prepend=-1))
        ones[of[edge]] += np.add.reduceat(np.unpackbits(part.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1), edge, axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n[:, None], axis=1).view(">i8").ravel().astype(np.int64)


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, fingerprint) for every row."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("text_key"), pa.array(fingerprints_of(part.column("text")))],
                                                 names=["doc_id", "text_key", "fingerprint"])

    rows = keyed(docs).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    return rows.mapInArrow(mark, "doc_id bigint, text_key bigint, fingerprint bigint")


def fold(fp: np.ndarray, bits: int) -> np.ndarray:
    out, fp = np.zeros(len(fp), np.uint64), fp.astype(np.int64).view(np.uint64)
    for shift in range(0, 64, bits):
        out ^= fp >> np.uint64(shift) & np.uint64((1 << bits) - 1)
    return out.astype(np.int64)


def balls(bits: int, half: int) -> dict[int, np.ndarray]:
    """All sets of at most ``half`` flipped bits, as masks, by the change of the slot."""
    out: dict[int, list[int]] = {}
    for n in range(half + 1):
        for flipped in combinations(range(64), n):
            change, mask = 0, 0
            for b in flipped:
                change ^= 1 << b % bits
                mask |= 1 << b
            out.setdefault(change, []).append(mask)
    return {k: np.array(v, np.uint64) for k, v in out.items()}


def forest(fp: np.ndarray, slot: int, bits: int, radius: int, masks: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links a spanning forest of the fingerprints that meet in this slot: (fingerprint, root). Values
    are made in rounds of bounded size, by a hash of the value."""
    fp = np.unique(fp)
    change, word = fold(fp, bits) ^ slot, fp.view(np.uint64)
    order = [(np.flatnonzero(change == c), masks[int(c)]) for c in np.unique(change)]
    rounds = -(-sum(len(i) * len(m) for i, m in order) // VALUES)
    root = np.arange(len(fp))
    for turn in range(rounds):
        values, owners = [], []
        for who, mask in order:
            for a in range(0, len(who), max(1, VALUES // len(mask))):
                some = who[a:a + max(1, VALUES // len(mask))]
                v, o = (word[some][:, None] ^ mask).ravel(), np.repeat(some, len(mask))
                if rounds > 1:
                    mine = (v * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)) % np.uint64(rounds) == turn
                    v, o = v[mine], o[mine]
                values.append(v)
                owners.append(o)
        v, o = np.concatenate(values), np.concatenate(owners)
        by = np.argsort(v)
        met = np.flatnonzero(v[by][1:] == v[by][:-1])
        a, b = o[by[met]], o[by[met + 1]]
        near = np.bitwise_count(word[a] ^ word[b]) <= radius
        pair = np.unique(np.stack((a[near], b[near]), 1), axis=0)
        a, b = pair[:, 0], pair[:, 1]
        while True:
            low = np.minimum(root[a], root[b])
            before = root.copy()
            for end in (a, b):
                np.minimum.at(root, root[end], low)
                np.minimum.at(root, end, low)
            root = root[root]
            if (root == before).all():
                break
    linked = np.flatnonzero(root != np.arange(len(fp)))
    return fp[linked], fp[root[linked]]


def links(distinct: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b) of fingerprints, enough of them to connect all those within ``radius`` bits through
    any number of steps, and none else. ``distinct`` has a column fingerprint without repeats."""
    if radius % 2 or not 0 < radius <= 4:
        raise ValueError("the radius must be 2 or 4: both halves of the ball are equal")
    n = distinct.count()
    bits = min(32, max(8, (n * 2081 // SLOT_VALUES).bit_length()))
    masks = balls(bits, radius // 2)
    slot = F.lit(0).cast("bigint")
    for shift in range(0, 64, bits):
        slot = slot.bitwiseXOR(F.shiftrightunsigned("fingerprint", shift).bitwiseAND(F.lit((1 << bits) - 1)))
    sent = distinct.select("fingerprint", F.explode(F.transform(F.array(*[F.lit(c).cast("bigint") for c in masks]), lambda c: c.bitwiseXOR(slot))).alias("slot"))

    def meet(key: tuple, group: pa.Table) -> pa.Table:
        fp = group.column("fingerprint").to_numpy()
        a, b = forest(fp, key[0].as_py(), bits, radius, masks)
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return sent.groupBy("slot").applyInArrow(meet, "a bigint, b bigint")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_key, fingerprint, root, component_id) for every row: component_id is the smallest
    doc_id reachable through fingerprints that differ in at most ``radius`` bits, root one of these fingerprints (it
    tells groups apart where rows of one doc_id have different texts).

    A null or empty text, or white space alone, has fingerprint zero and links like any other;
    repeated rows share a component; rows without an id take part, and a component of such rows only has a null
    component_id; no rows give no rows; other columns are not read. Copies meet in their fingerprint
    and are not expanded into pairs.
    """
    return grouped(write_once(fingerprints(docs), "fingerprints"), radius)


def grouped(marked: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``near_duplicates`` of rows (doc_id, text_key, fingerprint) that are written already."""
    distinct = write_once(marked.groupBy("fingerprint").agg(F.min("doc_id").alias("smallest")), "distinct-fingerprints")
    roots = connected_components(links(distinct.select("fingerprint"), radius), "simhash").withColumnRenamed("node", "fingerprint")
    placed = write_once(distinct.join(roots, "fingerprint", "left").select("fingerprint", "smallest", F.coalesce("root", "fingerprint").alias("root")), "placed")
    ids = write_once(placed.groupBy("root").agg(F.min("smallest").alias("component_id")), "component-ids")
    of = write_once(placed.join(ids, "root").select("fingerprint", "root", "component_id"), "components-of")
    return marked.join(of, "fingerprint").select("doc_id", "text_key", "fingerprint", "root", "component_id")


def one_of_each(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates: the one whose doc_id names the group
    (of repeated rows with that doc_id, one). All columns stay."""
    return one_of_groups(docs, near_duplicates(docs, radius))


def one_of_groups(docs: DataFrame, found: DataFrame) -> DataFrame:
    """One row of each group in ``found`` (doc_id, text_key, root, component_id)."""
    keep = found.where(F.col("doc_id").eqNullSafe(F.col("component_id"))).groupBy("root") \
        .agg(F.min(F.struct("doc_id", "text_key")).alias("kept")).select("kept.*")
    # plain columns without nulls are the key of both steps, so texts are shuffled once
    key = lambda c: {"_near_id": F.coalesce(F.col(c).cast("bigint"), F.lit(0)), "_near_null": F.col(c).isNull()}
    keep = write_once(keep.select(*[v.alias(k) for k, v in key("doc_id").items()], F.col("text_key").alias("_near_key")), "kept")
    rows = docs.withColumns(key("doc_id") | {"_near_key": text_key()})
    return rows.join(keep, keep.columns, "left_semi").dropDuplicates(keep.columns).drop(*keep.columns)


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")
