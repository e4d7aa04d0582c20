from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from llm.common import ODD, frame, prose
from plumbline.llm import common, packing, scan, tokens

PATH = tokens.vocabulary_path("word_bpe_49k.json")


def library_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(), st.text("aB1'<|é \n \x1c.")), max_size=5))
def test_ids_are_those_of_the_library(texts):
    book = tokens.pieces(PATH)
    column = pa.array(texts, pa.string())
    flat, at = book.flat(column)
    assert [flat[a:b].tolist() for a, b in zip(at, at[1:])] == [library_ids(t) for t in texts]
    assert book.counts(column).tolist() == np.diff(at).tolist()


def test_remembered_pieces_do_not_change_the_ids():
    book = tokens.Pieces(PATH, remembered=10)
    for i in range(3):
        texts = pa.array([prose(i, 300)])
        assert book.flat(texts)[0].tolist() == library_ids(texts[0].as_py())


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text("aZ09 .é\t")), max_size=6))
def test_words_of_a_column(texts):
    found = scan.Words(pa.array(texts, pa.string()), scan.ALNUM)
    assert [[found.text(i) for i in range(a, b)] for a, b in zip(found.first, found.first[1:])] == [common.words(t) for t in texts]
    names = [found.text(i) for i in range(len(found.start))]
    assert len(set(found.hashes().tolist())) == len(set(names))


def test_hashes_do_not_depend_on_blocks(monkeypatch):
    text = pa.array([prose(3, 5000) + " " + "y" * 3000])
    whole = scan.Words(text, scan.ALNUM).hashes()
    monkeypatch.setattr(scan, "BLOCK", 4000)
    assert (scan.Words(text, scan.ALNUM).hashes() == whole).all()


def test_token_counts(spark):
    got = sorted(map(tuple, tokens.token_counts(frame(spark), PATH, 100).collect()), key=str)
    want = [(i, len((t or "").encode()), n := len(library_ids(t)), n > 100) for i, t in ODD]
    assert got == sorted(want, key=str)
    assert tokens.token_counts(frame(spark, []), PATH).collect() == []


def check_packing(rows, want_ids, size):
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        got = np.frombuffer(r.ids, "<u4").tolist()
        assert len(got) == r.length > 0
        docs[(r.doc_id, r.doc_tokens)].append((r.start, got))
        sequences[r.sequence_id].append((r.offset, r.length))
    assert sorted(x for parts in docs.values() for _, ids in parts for x in ids) == sorted(x for ids in want_ids for x in ids)
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at == size or at & (at - 1) == 0 and at < size
    return docs


def test_packing_keeps_every_id(spark):
    rows = packing.pack_documents(frame(spark), PATH, size=256).collect()
    want = [library_ids(t) + [1] for _, t in ODD]
    docs = check_packing(rows, want, 256)
    single = {i: ids for (i, _), ids in zip(ODD, want) if i in (2, 3, 5, 8, 9, 11)}
    for (i, n), parts in docs.items():
        if i in single:
            assert n == len(single[i]) and [x for _, ids in sorted(parts) for x in ids] == single[i]
    assert packing.pack_documents(frame(spark, []), PATH).collect() == []


def test_sequences_hold_their_parts(spark):
    packed = packing.pack_documents(frame(spark, ODD[:5]), PATH, size=64).cache()
    parts = {(r.sequence_id, r.offset): r.ids for r in packed.collect()}
    for r in packing.sequences(packed).collect():
        assert bytes(r.ids) == b"".join(parts[r.sequence_id, p.offset] for p in r.parts)


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 64), max_size=60))
def test_assignment_fills_every_sequence(lengths):
    out, used = packing.assign(lengths, 64), defaultdict(int)
    for _, _, n, to in out:
        used[to] += n
    assert all(n == 64 or n & (n - 1) == 0 for n in used.values())
    for i, n in enumerate(lengths):
        parts = sorted((a, k) for j, a, k, _ in out if j == i)
        assert sum(k for _, k in parts) == n and all(a == sum(k for _, k in parts[:x]) for x, (a, _) in enumerate(parts))


def test_costs_are_balanced():
    lengths = [(i * 37) % 500 + 20 for i in range(400)]
    cost = defaultdict(float)
    for _, _, n, to in packing.assign(lengths):
        cost[to] += n + n * n / 4096
    full = sorted(cost.values())[-(sum(lengths) // 2048):]
    assert full[0] > 0.9 * full[-1]


@pytest.mark.parametrize("rows", [[(1, "a b c")] * 500])
def test_repeated_rows_are_all_packed(spark, rows):
    got = packing.pack_documents(frame(spark, rows), PATH).collect()
    assert sum(r.length for r in got) == 500 * 4


def test_words_that_a_polynomial_takes_for_one_another(spark):
    a = "a"
    while len(a) < 2048:
        a += a.translate(str.maketrans("ab", "ba"))
    b = a.translate(str.maketrans("ab", "ba"))
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(PATH)
    for text in (a + " " + b, b + " " + a + "!", "x".join((a, b))):
        ids = library.encode(text, add_special_tokens=False).ids
        found = tokens.Pieces(PATH)
        flat, at = found.flat(pa.array([text]))
        assert flat.tolist() == ids and found.counts(pa.array([text])).tolist() == [len(ids)]
