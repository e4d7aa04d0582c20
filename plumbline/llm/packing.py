"""Cost-balanced packing of token sequences.

A piece costs ``linear * n + quadratic * n**2`` (projections, and attention inside its own
document). Within a shard, pieces go in descending order to the sequence of lowest cost that
still has room. As many sequences are opened as the shard's tokens fill exactly: full ones of
``size`` tokens, and powers of two for the rest, which need no padding. What fits nowhere whole
is cut to fill the room left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .scan import slices
from .tokens import pieces

SIZE, END_ID = 2048, 1
LINEAR, QUADRATIC = 1.0, 1.0 / 4096
#: About so many bytes of text share a shard, whatever the size of the corpus.
SHARD_BYTES = 2 << 20

PIECE = "doc_id bigint, doc_row bigint, start bigint, doc_tokens bigint, ids binary"
PACKED = "doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"


def tokenised(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Pieces of at most ``size`` ids of every document, its end id included."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = pieces(path)
        for batch in batches:
            for part in slices(batch):
                flat, at = book.flat(part.column("text"))
                n = np.diff(at) + 1
                ids = np.insert(flat.astype("<u4"), at[1:], end_id)
                parts = -(-n // size)
                doc = np.repeat(np.arange(len(n)), parts)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(parts) - parts, parts)) * size
                edges = np.append(np.repeat(np.cumsum(n) - n, parts) + start, len(ids)) * 4
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(doc)), part.column("doc_row").take(pa.array(doc)), pa.array(start),
                     pa.array(n[doc]),
                     pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(edges.astype(np.int32)), pa.py_buffer(ids)])],
                    names=["doc_id", "doc_row", "start", "doc_tokens", "ids"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.monotonically_increasing_id().alias("doc_row"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(cut, PIECE)


def assign(lengths: list[int], size: int = SIZE, linear: float = LINEAR, quadratic: float = QUADRATIC) -> list[tuple[int, int, int, int]]:
    """(piece, start within it, length, sequence) of every part; each token lies in exactly one."""
    total = sum(lengths)
    rest = total % size
    room = np.array([size] * (total // size) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1], np.int64)
    cost, out, left = np.zeros(len(room)), [], []
    weigh = lambda n: linear * n + quadratic * n * n
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        n = lengths[i]
        if n == 0:
            continue
        to = int(np.argmin(np.where(room >= n, cost, np.inf)))
        if room[to] < n:
            left.append(i)
            continue
        room[to] -= n
        cost[to] += weigh(n)
        out.append((i, 0, n, to))
    for i in left:
        at = 0
        while at < lengths[i]:
            to = int(np.argmin(np.where(room > 0, cost, np.inf)))
            n = min(int(room[to]), lengths[i] - at)
            room[to] -= n
            cost[to] += weigh(n)
            out.append((i, at, n, to))
            at += n
    return out


def pack(tokens: DataFrame, shards: int, size: int = SIZE) -> DataFrame:
    """Packs pieces (doc_id, doc_row, start, doc_tokens, ids). Pieces are dealt to shards by a hash
    of row and start, so neither a long document nor a common id fills one."""

    def one(key: tuple, group: pa.Table) -> pa.Table:
        group = group.sort_by([("doc_row", "ascending"), ("start", "ascending")])
        doc, begin, whole, ids = (group.column(c).to_pylist() for c in ("doc_id", "start", "doc_tokens", "ids"))
        shard, used, rows = key[0].as_py(), {}, []
        for i, at, n, to in assign([len(x) // 4 for x in ids], size):
            offset = used.get(to, 0)
            used[to] = offset + n
            rows.append((doc[i], begin[i] + at, n, whole[i], shard << 32 | to, offset, ids[i][4 * at:4 * (at + n)]))
        kinds = [pa.int64()] * 6 + [pa.binary()]
        names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    dealt = tokens.withColumn("shard", F.pmod(F.xxhash64("doc_row", "start"), F.lit(shards)))
    return dealt.groupBy("shard").applyInArrow(one, PACKED)


def pack_documents(docs: DataFrame, path: str, size: int = SIZE, end_id: int = END_ID) -> DataFrame:
    """Packs whole documents into sequences of at most ``size`` tokens.

    Returns a row per piece: doc_id, start (ids of its document before it), length, doc_tokens,
    sequence_id, offset in the sequence (gapless from 0), ids (unsigned little-endian 32-bit).
    A null or empty text is its end id alone; repeated rows are packed each; a null doc_id
    stays null; very long texts are cut; other columns are not read; no rows, no sequences.
    """
    total = docs.select(F.sum(F.octet_length(F.col("text").cast("string")).cast("bigint"))).first()[0] or 0
    return pack(tokenised(docs, path, size, end_id), max(1, -(-total // SHARD_BYTES)), size)


def sequences(packed: DataFrame) -> DataFrame:
    """One row per sequence: its ids, and the (doc_id, start, length, offset) of its parts."""
    part = F.struct("offset", "doc_id", "start", "length", "ids")
    return packed.groupBy("sequence_id").agg(F.sort_array(F.collect_list(part)).alias("p")).select(
        "sequence_id", F.aggregate("p.ids", F.lit(b""), lambda a, x: F.concat(a, x)).alias("ids"),
        F.transform("p", lambda x: F.struct(x["doc_id"].alias("doc_id"), x["start"].alias("start"), x["length"].alias("length"), x["offset"].alias("offset"))).alias("parts"))


def digest(packed: DataFrame) -> DataFrame:
    return packed.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
