"""Prefix trie of conversations by collapsing whole sequences.

Every conversation is a sequence of turns, and a prefix of it a number of two 61-bit parts (polynomials over digests of its turns), so
prefixes meet by equality and no text is moved twice. Identical conversations are grouped into one weighted sequence with the list of
those that end there. Sequences that are a proper prefix of another are found by their numbers; those left in the anti-join are the
leaves. The prefixes of the weighted sequences are then aggregated to nodes. Sums over subtrees need no walk: a node's subtree is
what its sequences still have to say, less what several of them say together, and each node is counted by the one sequence that holds its smallest
conversation.

Conversations may be rebuilt first: the opening turns are taken from the first conversation of a block.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F

from ..session import write_once

#: Numbers of prefixes are taken modulo this prime, to two bases.
PRIME = (1 << 61) - 1
BASES = (0x1B873593CC9E2D51 % PRIME, 0x165667B19E3779F9 % PRIME)
INVERSES = tuple(pow(b, -1, PRIME) for b in BASES)
#: Opening turns: fewer than HEADS come from the first conversation of a block of BLOCK.
BLOCK, HEADS = 20, 4
#: Ids of conversations joined at a time for the list of ends.
CHUNK = 10_000

KEY = ["depth", "k1", "k2"]
MARKS = "conv_id bigint, segment int, q bigint, a1 bigint, a2 bigint, x1 bigint, x2 bigint, w bigint, lw bigint"


def mark(role: str, text: str) -> tuple[int, int]:
    """Two numbers from 1 on for a turn."""
    head = role.encode("utf-8", "surrogatepass")
    d = hashlib.sha256(len(head).to_bytes(8, "little") + head + text.encode("utf-8", "surrogatepass")).digest()
    return tuple(int.from_bytes(d[i:i + 16], "little") % (PRIME - 1) + 1 for i in (0, 16))


def longer(key: tuple[int, int], more: tuple[int, int], n: int) -> tuple[int, int]:
    """The number of a sequence followed by another of n turns."""
    return tuple((k * pow(b, n, PRIME) + m) % PRIME for k, m, b in zip(key, more, BASES))


def before_last(key: tuple[int, int], last: tuple[int, int]) -> tuple[int, int]:
    """The number of a sequence without its last turn."""
    return tuple((k - a) * i % PRIME for k, a, i in zip(key, last, INVERSES))


def batch_of(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


def longs(names: str) -> pa.Schema:
    return pa.schema([(n, pa.int64()) for n in names.split()])


def marked(turns: DataFrame) -> DataFrame:
    """A row per turn: its place among the turns of its conversation in its segment (a range of the order), its digest, the number of the prefix that ends
    with it there, and words in it and up to it. Written once. The texts are shuffled once; boundaries are chosen by their beginnings, rows are sorted by all of them."""
    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text"))).where("conv_id is not null")
    dealt = rows.repartitionByRange("conv_id", "turn", F.left("role", F.lit(32)), F.left("text", F.lit(64))).sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([(n, pa.int32() if n == "segment" else pa.int64()) for n in "conv_id segment q a1 a2 x1 x2 w lw".split()])

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segment, now, q, key, said = TaskContext.get().partitionId(), None, 0, (0, 0), 0
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if conv != now:
                    now, q, key, said = conv, 0, (0, 0), 0
                a, w = mark(role, text), len(text.encode("utf-8", "surrogatepass").split())
                q, key, said = q + 1, longer(key, a, 1), said + w
                out.append((conv, segment, q, *a, *key, w, said))
            yield batch_of(out, schema)

    return write_once(dealt.mapInArrow(look, MARKS), "turn-marks")


def carried(marks: DataFrame) -> dict[int, tuple]:
    """For each segment that begins inside a conversation: that conversation, and turns, number and words of it before. One row
    per segment reaches the driver, of which there are as many as shuffle partitions."""
    last = F.max(F.struct("conv_id", "q", "x1", "x2", "lw"))
    out, carry = {}, None
    for r in marks.groupBy("segment").agg(F.min("conv_id").alias("first"), last.alias("last")).orderBy("segment").collect():
        end = (r.last.conv_id, r.last.q, (r.last.x1, r.last.x2), r.last.lw)
        if carry and r.first == carry[0]:
            out[r.segment] = carry
            if end[0] == carry[0]:
                end = (end[0], carry[1] + end[1], longer(carry[2], end[2], end[1]), carry[3] + end[3])
        carry = end
    return out


def placed(marks: DataFrame) -> DataFrame:
    """``marks`` as if every conversation lay in one segment."""
    carry = carried(marks)
    schema = pa.schema([(n, pa.int32() if n == "segment" else pa.int64()) for n in "conv_id segment q a1 a2 x1 x2 w lw".split()])

    def shift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for r in zip(*(c.to_pylist() for c in batch.columns)):
                conv, segment, q, a1, a2, x1, x2, w, lw = r
                c = carry.get(segment)
                if c and c[0] == conv:
                    r = (conv, segment, c[1] + q, a1, a2, *longer(c[2], (x1, x2), q), w, c[3] + lw)
                rows.append(r)
            yield batch_of(rows, schema)

    inside = marks.select(*schema.names)
    return inside.mapInArrow(shift, MARKS) if carry else inside


def rebuilt(rows: DataFrame, block: int, heads: int) -> DataFrame:
    """A row per conversation: how many own opening turns are left out (h) and how many of the block's first conversation stand there instead
    (heads), numbers and words at these places, and length, number and words of the whole."""
    head = F.struct("x1", "x2", "a1", "a2", "w", "lw")
    nth = [F.max(F.when(F.col("q") == i + 1, head)).alias(f"h{i + 1}") for i in range(heads - 1)]
    own = write_once(rows.groupBy("conv_id").agg(F.max(F.struct("q", "x1", "x2", "lw")).alias("last"), *nth), "conversation-heads")
    h = F.crc32(F.col("conv_id").cast("string").cast("binary")) % heads
    base = own.select(F.col("conv_id").alias("_base"), F.array_compact(F.array(*[f"h{i + 1}" for i in range(heads - 1)])).alias("opening")) if heads > 1 else None
    both = own.withColumn("h", h)
    none = F.array().cast("array<struct<x1: bigint, x2: bigint, a1: bigint, a2: bigint, w: bigint, lw: bigint>>")
    if base is not None:
        both = both.join(base, F.col("conv_id") - F.col("conv_id") % block == F.col("_base"), "left")
        opening = F.slice(F.coalesce("opening", none), F.lit(1), F.col("h").cast("int"))
        skipped = F.try_element_at(F.array(*[f"h{i + 1}" for i in range(heads - 1)]), F.when(F.col("h") > 0, F.col("h").cast("int")))
    else:
        opening, skipped = none, F.lit(None).cast("struct<x1: bigint, x2: bigint, a1: bigint, a2: bigint, w: bigint, lw: bigint>")
    zero = F.lit(0).cast("bigint")
    flat = both.select("conv_id", "h", opening.alias("opening"), skipped.alias("skipped"), "last")
    end = F.when(F.size("opening") > 0, F.element_at("opening", -1))
    flat = flat.select("conv_id", "h", "opening", F.size("opening").cast("bigint").alias("k"), *(F.coalesce(end[c], zero).alias(n) for c, n in (("x1", "s1"), ("x2", "s2"), ("lw", "sw"))),
                       *(F.coalesce(F.col("skipped")[c], zero).alias(n) for c, n in (("x1", "o1"), ("x2", "o2"), ("lw", "ow"))), F.col("last.q").alias("n"),
                       F.col("last.x1").alias("n1"), F.col("last.x2").alias("n2"), F.col("last.lw").alias("nw"))
    numbers = "conv_id h k s1 s2 sw o1 o2 ow n n1 n2 nw".split()

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = []
            for _, h, k, s1, s2, sw, o1, o2, ow, n, n1, n2, nw in zip(*(batch.column(c).to_pylist() for c in numbers)):
                ends.append((k + n - h, *moved((n1, n2), (s1, s2), (o1, o2), n - h), sw + nw - ow) if n > h else (k, s1, s2, sw))
            columns = list(zip(*ends)) or [[]] * 4
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in ("conv_id", "h", "opening", "k", "s1", "s2", "sw", "o1", "o2", "ow")] + [pa.array(c, pa.int64()) for c in columns],
                                             names="conv_id h opening k s1 s2 sw o1 o2 ow depth k1 k2 words".split())

    kinds = "conv_id bigint, h bigint, opening array<struct<x1: bigint, x2: bigint, a1: bigint, a2: bigint, w: bigint, lw: bigint>>, k bigint, s1 bigint, s2 bigint, sw bigint, o1 bigint, o2 bigint, ow bigint, depth bigint, k1 bigint, k2 bigint, words bigint"
    return write_once(flat.mapInArrow(whole, kinds), "rebuilt")


def moved(key: tuple, to: tuple, of: tuple, n: int) -> tuple[int, int]:
    """The number of a prefix whose last n turns follow ``of``, if they followed ``to`` instead."""
    return tuple((x + (s - o) * pow(b, n, PRIME)) % PRIME for x, s, o, b in zip(key, to, of, BASES))


def collapsed(whole: DataFrame) -> DataFrame:
    """Identical conversations as one weighted sequence: rep (the smallest of them), weight, and where it ends."""
    return write_once(whole.groupBy(*KEY).agg(F.count("*").alias("weight"), F.min("conv_id").alias("rep")), "sequences")


def prefixes(rows: DataFrame, whole: DataFrame, sequences: DataFrame) -> DataFrame:
    """Every prefix of every distinct sequence: rep, weight, length, depth, number, that of the prefix before, words of the last turn, and words
    from that turn to the sequence's end."""
    of = whole.join(sequences.select(F.col("rep").alias("conv_id"), "weight"), "conv_id")
    of = write_once(of.withColumnRenamed("depth", "length").drop("k1", "k2"), "weighted")
    tail = rows.select("conv_id", "q", "a1", "a2", "x1", "x2", "w", "lw").join(of.drop("opening"), "conv_id").where("q > h").select(
        F.col("conv_id").alias("rep"), "weight", "length", (F.col("k") + F.col("q") - F.col("h")).alias("depth"), (F.col("q") - F.col("h")).alias("n"), "a1", "a2", "x1", "x2", "s1", "s2", "o1", "o2", "w",
        (F.col("words") - (F.col("sw") + F.col("lw") - F.col("ow")) + F.col("w")).alias("rest"))
    opening = of.select("conv_id", "weight", "length", "words", F.posexplode("opening").alias("i", "o"))
    zero = F.lit(0).cast("bigint")
    opening = opening.select(F.col("conv_id").alias("rep"), "weight", "length", (F.col("i") + 1).cast("bigint").alias("depth"), zero.alias("n"), "o.a1", "o.a2", "o.x1", "o.x2",
                             *(zero.alias(c) for c in ("s1", "s2", "o1", "o2")), "o.w", (F.col("words") - F.col("o.lw") + F.col("o.w")).alias("rest"))
    schema = longs("rep weight length depth k1 k2 p1 p2 w rest")

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for rep, weight, length, depth, n, a1, a2, x1, x2, s1, s2, o1, o2, w, rest in zip(*(c.to_pylist() for c in batch.columns)):
                key = moved((x1, x2), (s1, s2), (o1, o2), n)
                out.append((rep, weight, length, depth, *key, *before_last(key, (a1, a2)), w, rest))
            yield batch_of(out, schema)

    root = of.select(F.col("conv_id").alias("rep"), "weight", "length", *(zero.alias(c) for c in ("depth", "k1", "k2")), *(F.lit(None).cast("bigint").alias(c) for c in ("p1", "p2")), zero.alias("w"), F.col("words").alias("rest"))
    return write_once(root.union(tail.union(opening).mapInArrow(number, ", ".join(f"{n} bigint" for n in schema.names))), "prefixes")


def ends(whole: DataFrame) -> DataFrame:
    """SHA-256 of the ascending list of the conversations that end at a node. Lists are sorted and joined in ranges of any node; what is left to one
    ordered stream (a hash can't be split) is to read the joined chunks."""
    schema = pa.schema([(c, pa.int64()) for c in (*KEY, "first")] + [("ids", pa.string())])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, rows in groupby(zip(*(batch.column(c).to_pylist() for c in (*KEY, "conv_id"))), lambda r: r[:3]):
                ids = [r[3] for r in rows]
                out += [(*key, ids[i], ",".join(map(str, ids[i:i + CHUNK]))) for i in range(0, len(ids), CHUNK)]
            yield batch_of(out, schema)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, h, kinds = None, None, pa.schema([(c, pa.int64()) for c in KEY] + [("ends_sha256", pa.string())])
        for batch in batches:
            out = []
            for *key, ids in zip(*(batch.column(c).to_pylist() for c in (*KEY, "ids"))):
                if key == now:
                    h.update(b",")
                else:
                    if now:
                        out.append((*now, h.hexdigest()))
                    now, h = key, hashlib.sha256()
                h.update(ids.encode())
            yield batch_of(out, kinds)
        if now:
            yield batch_of([(*now, h.hexdigest())], kinds)

    dealt = whole.select(*KEY, "conv_id").repartitionByRange(*KEY, "conv_id").sortWithinPartitions(*KEY, "conv_id")
    chunks = dealt.mapInArrow(join, "depth bigint, k1 bigint, k2 bigint, first bigint, ids string")
    return chunks.repartition(*KEY).sortWithinPartitions(*KEY, "first").drop("first").mapInArrow(digest, "depth bigint, k1 bigint, k2 bigint, ends_sha256 string")


def prefix_trie(turns: DataFrame, block: int = BLOCK, heads: int = HEADS) -> DataFrame:
    """A row per node: depth, conv_id (smallest member), parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256, and its number (k1, k2).

    ``turns`` has conv_id, turn, role, text. Each conversation c first swaps its opening h = crc32(c) % ``heads`` turns for the first h of
    conversation c - c % ``block`` (as many as there are; none, if it is absent); ``heads=1`` leaves all as they are. Turns of one number are ordered by role and text, null
    numbers first; repeated rows are turns of their own; null roles and texts are empty; rows without conv_id belong to no conversation; a negative c belongs to the block whose first
    is nearer to zero; texts of any length are digested whole; other columns are not read; no conversations give no rows.
    """
    if not 1 <= heads <= 64 or block < 1:
        raise ValueError("1 to 64 heads, and blocks of one or more")
    rows = placed(marked(turns))
    whole = rebuilt(rows, block, heads)
    sequences = collapsed(whole)
    every = prefixes(rows, whole, sequences)
    proper = every.where("depth < length").select(*KEY).distinct()
    leaves = sequences.join(proper, KEY, "left_anti").select("rep", F.lit(1).alias("leaf"))
    nodes = write_once(every.groupBy(*KEY).agg(F.sum("weight").alias("n_convs"), F.min("rep").alias("conv_id"), F.min("p1").alias("p1"), F.min("p2").alias("p2"), F.min("w").alias("w"),
                                               F.sum(F.col("weight") * F.col("rest")).alias("said")), "nodes")
    owned = nodes.groupBy(F.col("conv_id").alias("rep")).agg(F.min("depth").alias("from"), F.sum("w").alias("own"))
    each = write_once(sequences.select("rep").join(leaves, "rep", "left").join(owned, "rep", "left").na.fill(0, ["leaf", "own"]), "owners")
    once = F.when(F.col("depth") >= F.col("from"), F.col("rest")).otherwise(F.col("own"))
    more = write_once(every.select("rep", *KEY, "rest").join(each, "rep").groupBy(*KEY).agg(F.sum("leaf").alias("n_leaves"), F.sum(once).alias("once")), "leaves-of-nodes")
    up = [(F.col("depth") - 1).alias("depth"), F.col("p1").alias("k1"), F.col("p2").alias("k2")]
    children = nodes.where("depth > 0").groupBy(*up).agg(F.count("*").alias("n_children"))
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("p1"), F.col("k2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    out = nodes.join(more, KEY).join(children, KEY, "left").join(parents, ["depth", "p1", "p2"], "left").join(ends(whole), KEY, "left")
    return out.select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).cast("bigint").alias("n_children"), F.col("n_leaves").cast("bigint").alias("n_leaves"),
                      (F.col("said") - F.col("once")).alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"), "k1", "k2")


def digest(nodes: DataFrame) -> DataFrame:
    return nodes.drop("k1", "k2")
