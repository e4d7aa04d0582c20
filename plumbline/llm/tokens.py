"""Token counts with a whole-token shortcut.

A vocabulary string is *proven whole* when the tokenizer itself gives exactly its
one id for it. White space never lies inside a token of the vocabulary, so a text
is split at white space first, and each piece is looked up: proven strings count
one without any merging, and only the rest goes through the tokenizer's merges.
"""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, functions as F

from .scan import PIECES, Table, Words, slices

#: When a Python worker remembers more pieces or words than this, it starts afresh with the proven ones.
REMEMBERED = 500_000
WORDS_REMEMBERED = 100_000
#: Pieces of these characters are normalised and cut alike here and in the tokenizer; any other piece is left to it whole.
PLAIN = re.compile("[!-~\u00c0-\u012f\u0131-\u024f]+")
#: The cut of the vocabulary's own file.
CUT = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")


def bytes_to_text() -> dict[str, int]:
    """The usual table of byte-level vocabularies, inverted: printable characters stand for
    themselves, the others are moved up behind 255, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    moved = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(moved)}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def grown(a: np.ndarray, n: int) -> np.ndarray:
    """Room for n values, doubled as needed."""
    return a if n <= len(a) else np.concatenate((a, np.empty(max(n, 2 * len(a)) - len(a), a.dtype)))


class Pieces:
    """Ids of white-space separated pieces, as the tokenizer gives them for whole texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.remembered = remembered
        self.specials = sorted(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.mark = self.specials[0]
        self.mark_id = self.tokenizer.token_to_id(self.mark)
        self.letter = {b: c for c, b in bytes_to_text().items()}
        self.whole = self.proven()
        self.fresh()

    def fresh(self) -> None:
        self.words: dict[str, bytes] = dict(self.whole)
        self.table, self.pool, self.start, self.count = Table(16), np.empty(1 << 16, np.uint32), np.empty(1 << 15, np.int64), np.empty(1 << 15, np.int64)
        self.known = self.filled = 0
        names = pa.array(list(self.whole), pa.string())
        found = Words(names, PIECES)
        alone = np.flatnonzero(found.n == 1)
        self.learn(found.hashes()[found.first[alone]], [self.whole[names[int(i)].as_py()] for i in alone])

    def learn(self, h: np.ndarray, ids: list[bytes]) -> None:
        """Appends new pieces to the pool of ids."""
        n = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, a, b = np.frombuffer(b"".join(ids), "<u4"), self.known, self.filled
        self.known, self.filled = a + len(ids), b + len(flat)
        self.table.add(h, np.arange(a, self.known, dtype=np.int32))
        self.pool, self.start, self.count = grown(self.pool, self.filled), grown(self.start, self.known), grown(self.count, self.known)
        self.pool[b:self.filled], self.start[a:self.known], self.count[a:self.known] = flat, b + np.cumsum(n) - n, n

    def proven(self) -> dict[str, bytes]:
        """Vocabulary strings that alone become exactly their own id."""
        back, found = bytes_to_text(), {}
        names, ids = [], []
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            token = token.removesuffix("</w>")
            if all(c in back for c in token):
                try:
                    names.append(bytes(back[c] for c in token).decode())
                    ids.append(i)
                except UnicodeDecodeError:
                    pass
        for name, i, got in zip(names, ids, self.encode(names)):
            if len(got) == 4 and int.from_bytes(got, "little") == i and name and not name.isspace():
                found[name] = got
        return found

    def encode(self, pieces: list[str]) -> list[bytes]:
        """Each piece by the tokenizer: little-endian 32-bit ids. Pieces are joined by a special
        string, at which the tokenizer cuts before anything else."""
        plain = [p for p in pieces if not any(s in p for s in self.specials)]
        out: dict[str, bytes] = {}
        if plain:
            ids = np.array(self.tokenizer.encode_batch_fast([self.mark.join(plain)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = np.flatnonzero(ids == self.mark_id)
            starts = np.concatenate(([0], ends + 1)).tolist()
            raw = ids.tobytes()
            for p, a, b in zip(plain, starts, [*ends.tolist(), len(ids)], strict=True):
                out[p] = raw[4 * a:4 * b]
        for p in pieces:
            if p not in out:
                out[p] = np.array(self.tokenizer.encode(p, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return [out[p] for p in pieces]

    def word(self, word: str) -> bytes:
        """A pre-token: proven whole, remembered, or merged."""
        got = self.words.get(word)
        if got is None:
            stands = word if word.isascii() else "".join(map(self.letter.__getitem__, word.encode()))
            got = array("I", [t.id for t in self.tokenizer.model.tokenize(stands)]).tobytes()
            if len(self.words) < WORDS_REMEMBERED + len(self.whole):
                self.words[word] = got
        return got

    def piece(self, piece: str) -> bytes:
        """What stands between white space. Most is a word, or a word and one mark."""
        if not PLAIN.fullmatch(piece) or "<|" in piece:
            got = self.encode([piece])[0]
        else:
            low = piece.lower()
            if low.isalpha():
                got = self.word(low)
            elif low[:-1].isalpha() and low[-1] in ".,;:!?":
                got = self.word(low[:-1]) + self.word(low[-1])
            else:
                got = b"".join(map(self.word, CUT.findall(low)))
        return got

    def lookup(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """For the pieces of all texts in order, their place among the remembered ones; and the
        index of each text's first piece. New pieces of the column are merged once each."""
        if self.known > self.remembered:
            self.fresh()
        found = Words(column, PIECES)
        h = found.hashes()
        at = self.table.find(h)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            new, where = np.unique(h[missing], return_index=True)
            self.learn(new, [self.piece(found.text(i)) for i in missing[where].tolist()])
            at[missing] = self.table.find(h[missing])
        return at, found.first

    def counts(self, column: pa.Array) -> np.ndarray:
        """Number of tokens of every text; null is empty."""
        at, first = self.lookup(column)
        total = np.concatenate(([0], np.cumsum(self.count[at])))
        return np.diff(total[first])

    def flat(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of all texts, and where each text's begin."""
        at, first = self.lookup(column)
        n = self.count[at]
        total = np.concatenate(([0], np.cumsum(n)))
        ids = self.pool[np.repeat(self.start[at] - total[:-1], n) + np.arange(total[-1])]
        return ids, total[first]


@lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    """One per Python worker and vocabulary."""
    return Pieces(path)


COUNTED = "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean"


def token_counts(docs: DataFrame, path: str, limit: int = 2048) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes (UTF-8), n_tokens, over_limit.

    Null and empty texts have no bytes and no tokens; repeated rows are counted each; a null
    doc_id stays null; other columns are not read. One pass without a shuffle; a worker holds
    one Arrow batch and the bounded memory of pieces.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = pieces(path)
        for batch in batches:
            for part in slices(batch):
                tokens = ids.counts(part.column("text"))
                size = pc.fill_null(pc.binary_length(part.column("text")), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(tokens), pa.array(tokens > limit)],
                                                 names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return docs.select(F.col("doc_id").cast("bigint"), "text").mapInArrow(count, COUNTED)
