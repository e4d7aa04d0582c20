"""Chat formatting in budgeted windows.

Turn by turn, a window is filled until the next turn would pass the budget; tokens are those of the turn as it is written, escapes, role and marks
included. Each window is one training text: the system turn again, a limited piece of history again, then its own turns. Only assistant texts of
its own turns lie under the loss mask, so every target counts once. Prefix sums of turn tokens cut long conversations into blocks of many budgets first, and
each block is filled by itself, so one conversation may fill many tasks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.window import Window

from ..session import write_once
from .scan import slices
from .segments import SEGMENT, segmented
from .tokens import pieces

START, END = "<|im_start|>", "<|im_end|>"
BUDGET, HISTORY = 2048, 256
#: A block begins at every multiple of so many budgets; the window before it may stay short.
BLOCK = 64
KEY = ("conv_id", "turn", "role", "text")


def escaped(text: Column) -> Column:
    """One backslash more between ``<`` and ``|``; no control string is left."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escaped_role(role: Column) -> Column:
    """A role takes one line."""
    return escaped(F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n")))


def unescaped_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescaped(role))


def written(role: Column, text: Column) -> Column:
    """A turn as it stands in a window. It begins and ends at white space, so tokens of turns add up."""
    return F.concat(F.lit(START), escaped_role(role), F.lit("\n"), escaped(text), F.lit(f"{END}\n"))


def counted(turns: DataFrame, path: str) -> DataFrame:
    """conv_id, turn, role, text (null: empty) and the tokens of the turn as it is written."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = pieces(path)
        for batch in batches:
            for part in slices(batch, "written"):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in KEY), pa.array(book.counts(part.column("written")))], names=[*KEY, "tokens"])

    rows = turns.select(F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
                        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.withColumn("written", written(F.col("role"), F.col("text")))
    return rows.mapInArrow(count, "conv_id bigint, turn bigint, role string, text string, tokens bigint")


WINDOW = "conv_id bigint, window bigint, text string, n_context int, n_turns int, tokens bigint, loss array<struct<start: bigint, length: bigint>>"


class Filling:
    """Windows of one block: turns are (place, written, tokens, start of the text, its length, under the mask)."""

    def __init__(self, budget: int, history: int):
        self.budget, self.history = budget, history
        self.system, self.recent, self.context, self.own = None, [], [], []

    def remember(self, turn: tuple) -> None:
        """The turns a window may repeat: as many of the last ones as fit the history."""
        self.recent.append(turn)
        while sum(t[2] for t in self.recent) > self.history:
            self.recent.pop(0)

    def before(self) -> list[tuple]:
        """What stands before the own turns; the system turn is not repeated next to itself."""
        shown = self.own[0][0] == 1 if self.own else False
        return ([self.system] if self.system and not shown else []) + self.context

    def add(self, turn: tuple) -> list[tuple[list[tuple], list[tuple]]]:
        """Windows that are full before this turn."""
        full = []
        if self.own and sum(t[2] for t in [*self.before(), *self.own]) + turn[2] > self.budget:
            full.append((self.before(), self.own))
            self.own = []
        if not self.own:
            used = turn[2] + (self.system[2] if self.system and turn[0] != 1 else 0)
            self.context = [t for t in self.recent if t[0] != 1 or not self.system]
            while self.context and used + sum(t[2] for t in self.context) > self.budget:
                self.context.pop(0)
        self.own.append(turn)
        self.remember(turn)
        return full

    def rest(self) -> list[tuple[list[tuple], list[tuple]]]:
        return [(self.before(), self.own)] if self.own else []


def windows(turns: DataFrame, path: str, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """One row per window: conv_id, window, text, n_context (leading turns repeated from before), n_turns (in all),
    tokens, loss (array of start and length in code points of ``text``).

    A window is cut before the turn that would pass the budget; the system turn and turns of up to ``history`` tokens before it are repeated, the latter as far as there is room, so
    only a turn too long by itself (next to the system turn) passes the budget; turns are never cut. Turns of
    one number are ordered by role and text, null numbers first; repeated rows are turns of their own;
    null roles and texts are empty; rows without conv_id are one conversation; other columns are not read.
    A conversation of any length is spread over segments and blocks.
    """
    rows = segmented(counted(turns, path), *KEY, name="turns")
    parts = rows.groupBy("conv_id", SEGMENT).agg(F.sum("tokens").alias("t"), F.count("*").alias("c"), F.min(F.struct("turn", "role", "text", "tokens")).alias("head"))
    earlier = Window.partitionBy("conv_id").orderBy(SEGMENT).rowsBetween(Window.unboundedPreceding, -1)
    first = F.first("head").over(Window.partitionBy("conv_id").orderBy(SEGMENT))
    system = F.when(F.col("head.role") == "system", F.col("head"))
    parts = write_once(parts.select("conv_id", SEGMENT, F.coalesce(F.sum("t").over(earlier), F.lit(0)).alias("t0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"), first.alias("head"))
                       .select("conv_id", SEGMENT, "t0", "c0", system.alias("system")), "turn-sums")
    inside = Window.partitionBy(SEGMENT, "conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, 0)
    local = rows.select("*", F.sum("tokens").over(inside).alias("_t"), F.count("*").over(inside).alias("_c"))
    both = local.join(parts, local["conv_id"].eqNullSafe(parts["conv_id"]) & (local[SEGMENT] == parts[SEGMENT])).select(
        local["conv_id"], "role", "text", "tokens", (F.col("t0") + F.col("_t") - F.col("tokens")).alias("begin"), (F.col("c0") + F.col("_c")).alias("place"), F.col("system").isNotNull().alias("has_system"))
    size = BLOCK * budget
    block = F.floor(F.col("begin") / size)
    both = both.withColumn("block", block)
    # turns right before the next block are shown to it
    again = F.col("begin") >= (F.col("block") + 1) * size - history
    own = F.struct(F.col("block").alias("block"), F.lit(1).alias("kind"))
    shown = both.select("conv_id", "place", "role", "text", "tokens", "has_system", F.explode(F.when(again, F.array(own, F.struct((F.col("block") + 1).alias("block"), F.lit(0).alias("kind")))).otherwise(F.array(own))).alias("w"))
    plain = shown.select("conv_id", "w.block", "w.kind", "place", "role", "text", "tokens", "has_system")
    heads = parts.where("system is not null").groupBy("conv_id").agg(F.first("system").alias("system")).select(F.col("conv_id").alias("_conv"), "system")
    later = plain.where("kind = 1 AND block > 0 AND has_system").select("conv_id", "block").distinct()
    repeated = later.join(heads, later["conv_id"].eqNullSafe(heads["_conv"])).select("conv_id", "block", F.lit(-1).alias("kind"), F.lit(1).cast("bigint").alias("place"), "system.role", "system.text", "system.tokens", F.lit(True).alias("has_system"))
    full = plain.union(repeated).select("conv_id", "block", "kind", "place", "tokens", (F.col("has_system") & (F.col("place") == 1)).alias("system"), (F.col("role") == "assistant").alias("target"),
                                        written(F.col("role"), F.col("text")).alias("written"), (F.length(escaped_role(F.col("role"))) + len(START) + 1).alias("start"), F.length(escaped(F.col("text"))).alias("length"))
    ordered = full.repartition("conv_id", "block").sortWithinPartitions("conv_id", "block", "kind", "place")

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, filling, n = None, None, 0
        for batch in batches:
            done = []
            for conv, block, kind, place, tokens, is_system, target, text, start, length in zip(*(c.to_pylist() for c in batch.columns)):
                if now != (conv, block):
                    if filling:
                        done += [row(*now, n + i, *w) for i, w in enumerate(filling.rest())]
                    now, filling, n = (conv, block), Filling(budget, history), 0
                turn = (place, text, tokens, start, length, target)
                if is_system:
                    filling.system = turn
                if kind == 0:
                    filling.remember(turn)
                elif kind == 1:
                    full = filling.add(turn)
                    done += [row(*now, n + i, *w) for i, w in enumerate(full)]
                    n += len(full)
            yield table(done)
        if filling:
            yield table([row(*now, n + i, *w) for i, w in enumerate(filling.rest())])

    def row(conv: int | None, block: int, n: int, before: list[tuple], own: list[tuple]) -> tuple:
        at, loss = sum(len(t[1]) for t in before), []
        for t in own:
            if t[5]:
                loss.append({"start": at + t[3], "length": t[4]})
            at += len(t[1])
        return conv, block << 32 | n, "".join(t[1] for t in [*before, *own]), len(before), len(before) + len(own), sum(t[2] for t in [*before, *own]), loss

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]
        names = ["conv_id", "window", "text", "n_context", "n_turns", "tokens", "loss"]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=names)

    return ordered.mapInArrow(fill, WINDOW)


def read_back(text: str) -> list[tuple[str, str]]:
    """The turns of a formatted text: role and text as they were."""
    out = []
    for part in text.split(START)[1:]:
        role, _, body = part.partition("\n")
        out.append((unescaped_role(role), unescaped(body.removesuffix(f"{END}\n"))))
    return out


DIGEST = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"


def digest(formatted: DataFrame) -> DataFrame:
    """Per conversation, from the formatted texts alone. A conversation is read as one ordered stream, a window at a time."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, now = [], None
        for batch in batches:
            for r in batch.to_pylist():
                if now is None or now[0] != r["conv_id"]:
                    if now:
                        rows.append(now)
                    now = [r["conv_id"], 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text in read_back(r["text"])[r["n_context"]:]:
                    now[1] += 1
                    now[2].update(f"{role}\n{text}\n".encode())
                for m in r["loss"]:
                    target = unescaped(r["text"][m["start"]:m["start"] + m["length"]])
                    now[3] += len(target)
                    now[4].update(target.encode())
                now[5] += len(r["text"])
            if rows:
                yield table(rows)
                rows = []
        if now:
            yield table([now])

    def table(rows: list) -> pa.RecordBatch:
        columns = list(zip(*((c, n, t.hexdigest(), k, x.hexdigest(), f) for c, n, t, k, x, f in rows)))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    ordered = formatted.select("conv_id", "window", "text", "n_context", "loss").repartition("conv_id").sortWithinPartitions("conv_id", "window")
    return ordered.mapInArrow(read, DIGEST)
