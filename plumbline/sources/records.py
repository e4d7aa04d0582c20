"""Records of delimited files, which may go over several lines.

A line break inside quotes belongs to a field, so whether a line begins a record depends on all the text before it. What a stretch of text does to that
is a small map (from "outside" or "inside quotes" at its start to either at its end), and maps can be composed. So every split of a file works out
its own map, the maps of a file's splits are composed in order, and each split, now knowing how it begins, cuts its lines into records. Only the piece of a
record that runs over the end of a split is moved, to be joined with the rest of it.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..session import write_once
from .files import one_spelling

OUTSIDE, INSIDE = 0, 1
PARTS = "file string, at bigint, first bigint, lines bigint, head boolean, tail boolean, line string"


def end_of_line(line: str, state: int, sep: str = ",") -> int:
    """The state after a line that begins in ``state``. A quote opens a field only at the field's start; in a quoted
    field two quotes stand for one; what follows a closing quote, up to the separator, is plain text."""
    pieces = line.split('"')
    start, closed = state == OUTSIDE, False
    for i, piece in enumerate(pieces):
        if state == OUTSIDE:
            if piece:
                start, closed = piece.endswith(sep), False
        if i == len(pieces) - 1:
            break
        if state == INSIDE:
            state, closed, start = OUTSIDE, True, False
        elif closed or start:
            state, closed, start = INSIDE, False, False
    return state


def _splits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.RecordBatch]]:
    """Stretches of rows of one split, in order."""
    for batch in batches:
        a = 0
        key = pc.binary_join_element_wise(batch.column("file"), pc.cast(batch.column("at"), pa.string()), "\n")
        ends = pc.run_end_encode(key).run_ends.to_pylist()
        for b in ends:
            part = batch.slice(a, b - a)
            yield part.column("file")[0].as_py(), part.column("at")[0].as_py(), part
            a = b


def _quoted(part: pa.RecordBatch) -> list[tuple[int, str]]:
    """Place and text of the lines with a quote: no other line changes the state."""
    at = pc.indices_nonzero(pc.match_substring(part.column("line"), '"'))
    return list(zip(at.to_pylist(), part.column("line").take(at).to_pylist()))


def split_maps(lines: DataFrame, sep: str = ",") -> DataFrame:
    """(file, at, first, lines, from_outside, from_inside): the first id, the number of lines and the map of every split."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, row = None, []
        for file, at, part in _splits(batches):
            if now != (file, at):
                if now:
                    yield _rows([(*now, *row)])
                now, row = (file, at), [part.column("seq")[0].as_py(), 0, OUTSIDE, INSIDE]
            row[1] += part.num_rows
            for _, line in _quoted(part):
                row[2:] = [end_of_line(line, s, sep) for s in row[2:]]
        if now:
            yield _rows([(*now, *row)])

    def _rows(rows: list) -> pa.RecordBatch:
        kinds = [pa.string(), *[pa.int64()] * 5]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["file", "at", "first", "lines", "from_outside", "from_inside"])

    return lines.mapInArrow(fold, "file string, at bigint, first bigint, lines bigint, from_outside bigint, from_inside bigint")


def composed(maps: DataFrame) -> DataFrame:
    """``maps`` with the state each split begins in, and the lines before it. A map that forgets its start fixes the state; after the last such map only those that
    swap count. One row per split."""
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("from_outside") == F.col("from_inside")
    swaps = (F.col("from_outside") > F.col("from_inside")).cast("long")
    rows = maps.withColumn("_swaps", F.sum(swaps).over(Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(fixed, F.struct(F.col("from_outside").alias("state"), F.col("_swaps").alias("swaps"))), ignorenulls=True).over(before)
    rows = rows.withColumns({"_last": last, "_upto": F.coalesce(F.max("_swaps").over(before), F.lit(0)), "shift": F.coalesce(F.sum("lines").over(before), F.lit(0))})
    state = (F.coalesce("_last.state", F.lit(OUTSIDE)) + F.col("_upto") - F.coalesce("_last.swaps", F.lit(0))) % 2
    return rows.withColumn("state", state).select(*maps.columns, "state", "shift")


def cut(lines: DataFrame, inside: set[tuple[str, int]], sep: str = ",") -> DataFrame:
    """Records, and pieces of records: ``head`` continues what the split before began, ``tail`` goes on in the next one. ``inside`` names the splits that begin inside quotes."""

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, open_ = None, OUTSIDE, None  # open_: first id, head, lines of the record that is not finished
        for file, at, part in _splits(batches):
            done: list[tuple] = []
            if now != (file, at):
                if open_:
                    done.append(_piece(*now, *open_, state == INSIDE))
                now, state = (file, at), INSIDE if (file, at) in inside else OUTSIDE
                open_ = (part.column("seq")[0].as_py(), True, []) if state == INSIDE else None
            quoted = _quoted(part)
            if open_ is None and all(end_of_line(line, OUTSIDE, sep) == OUTSIDE for _, line in quoted):
                if done:
                    yield _batch(done)
                n = part.num_rows
                no = pa.array([False]).take(pa.array([0] * n))
                yield pa.RecordBatch.from_arrays([part.column("file"), part.column("at"), part.column("seq"), pa.array([1] * n, pa.int64()), no, no, part.column("line")], names=_NAMES)
                continue
            ends = dict(quoted)
            for i, (seq, line) in enumerate(zip(part.column("seq").to_pylist(), part.column("line").to_pylist())):
                if state == OUTSIDE:
                    open_ = (seq, False, [])
                open_[2].append(line)
                if i in ends:
                    state = end_of_line(line, state, sep)
                if state == OUTSIDE:
                    done.append(_piece(file, at, *open_, False))
                    open_ = None
            yield _batch(done)
        if open_:
            yield _batch([_piece(*now, *open_, state == INSIDE)])

    def _piece(file: str, at: int, first: int, head: bool, some: list[str], tail: bool) -> tuple:
        return file, at, first, len(some), head, tail, "\n".join(some)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds], names=_NAMES)

    _NAMES = ["file", "at", "first", "lines", "head", "tail", "line"]
    return lines.mapInArrow(assemble, PARTS)


def joined(parts: DataFrame, splits: DataFrame) -> DataFrame:
    """Whole records: pieces of one record are put together, each of its splits giving one."""
    numbered = parts.join(splits.select("file", "at", F.col("first").alias("_from"), "shift"), ["file", "at"])
    numbered = numbered.select("file", "at", (F.col("first") - F.col("_from") + F.col("shift") + 1).alias("line_no"), "lines", "head", "tail", "line")
    whole = numbered.where("NOT head AND NOT tail").select("file", "line_no", "lines", "line")
    begun = F.count_if(~F.col("head")).over(Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0))
    pieces = write_once(numbered.where("head OR tail"), "record-pieces").withColumn("_record", begun)
    put = pieces.groupBy("file", "_record").agg(F.min("line_no").alias("line_no"), F.sum("lines").alias("lines"), F.sort_array(F.collect_list(F.struct("line_no", "line"))).alias("_p"))
    return whole.unionByName(put.select("file", "line_no", "lines", F.array_join("_p.line", "\n").alias("line")))


def read_records(text: DataFrame, full_path: bool = False, sep: str = ",") -> DataFrame:
    """(file, line_no, lines, line) of delimited text, read with file metadata: the physical number of a record's first line (from 1), how many lines it has, and its text with line feeds
    between them, whatever line ends the file has. A record whose quotes are never closed goes to the end of its file. A record that spans many splits is one row in the end.

    The text is read three times and not shuffled. The driver learns which splits begin inside quotes (a name and an offset each)."""
    path = F.col("_metadata.file_path")
    name: Column = one_spelling(path) if full_path else F.element_at(F.split(path, "/"), -1)
    start = F.col("_metadata.file_block_start")
    first = F.regexp_replace("value", "^﻿", "")
    lines = text.select(name.alias("file"), start.alias("at"), F.monotonically_increasing_id().alias("seq"), F.when(start == 0, first).otherwise(F.col("value")).alias("line"))
    splits = write_once(composed(split_maps(lines, sep)), "splits")
    inside = {(r["file"], r["at"]) for r in splits.where(F.col("state") == INSIDE).select("file", "at").collect()}
    return joined(cut(lines, inside, sep), splits)
