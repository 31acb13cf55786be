"""Byte-level BPE: ids equal the reference library's, round trips, appends and edits."""

import hashlib

import public_tokenizers as P
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from cellpulse.llm import bpe
from llm_frames import awkward, nothing, shipped  # noqa: F401

PATH = P.path("byte_bpe_50k.tiktoken")
RANKS = bpe.read_ranks(PATH)
REFERENCE = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=RANKS, special_tokens={})
BPE = bpe.PrefixBPE(RANKS)
CODEC = bpe.Codec(PATH, P.PATTERN)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def test_every_row_as_the_reference(spark, awkward):
    got = bpe.encode(awkward, PATH, P.PATTERN).collect()
    rows = awkward.select("doc_id", "text").collect()
    want = sorted(((r.doc_id, REFERENCE.encode_ordinary(r.text or "")) for r in rows), key=repr)
    assert sorted(((r.doc_id, list(r.ids)) for r in got), key=repr) == want
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == sha(" ".join(map(str, r.ids)).encode()) for r in got)
    assert sorted(r.decoded_sha256 for r in got) == sorted(sha((r.text or "").encode()) for r in rows)
    assert sorted(r.decoded for r in got) == sorted(r.text or "" for r in rows)


def test_empty_table(spark, nothing):
    assert bpe.encode(nothing, PATH, P.PATTERN, with_ids=False).collect() == []


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=80))
def test_any_text_as_the_reference(text):
    text = text.encode("utf-8", "ignore").decode()
    ids, = CODEC([text])
    assert ids.tolist() == REFERENCE.encode_ordinary(text)
    assert CODEC.bpe.decode(ids.tolist()) == text.encode()
    assert CODEC.decimal(ids.tolist()) == " ".join(map(str, ids))


piece = st.text(alphabet="abcdeghilnorstu", min_size=1, max_size=40).map(str.encode)


@settings(max_examples=150, deadline=None)
@given(piece, piece, piece, st.integers(0, 40), st.integers(0, 40))
def test_appends_and_edits_equal_encoding_anew(first, more, new, a, b):
    table = bpe.PrefixTable(BPE, first)
    before = list(table.last)
    table.append(more)
    assert table.last[:len(before)] == before
    assert table.ids() == REFERENCE._core_bpe.encode_single_piece(first + more)
    start, end = sorted((min(a, len(table.data)), min(b, len(table.data))))
    table.edit(start, end, new)
    assert table.data == (first + more)[:start] + new + (first + more)[end:]
    assert table.last == bpe.PrefixTable(BPE, table.data).last
    assert table.ids() == REFERENCE._core_bpe.encode_single_piece(table.data)


def test_edit_of_a_long_piece_redoes_little():
    word = b"thtionertion" * 2_000
    table = bpe.PrefixTable(BPE, word)
    assert table.edit(100, 102, b"qz") < 1_000
    assert table.last == bpe.PrefixTable(BPE, word[:100] + b"qz" + word[102:]).last


def test_pieces_in_order_share_prefixes():
    pieces = sorted({w.encode() for w in "strengthening strength strengthen zzz a thtion thtionert".split()})
    assert list(BPE.encode_sorted(pieces)) == [BPE.encode_piece(p) for p in pieces]


def test_vocabulary_without_all_bytes_is_refused():
    with pytest.raises(ValueError):
        bpe.PrefixBPE({b"a": 0})


def test_memory_of_pieces_is_bounded_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "PIECE_MEMORY", 40_000)
    both = bpe.Codec(PATH, P.PATTERN)
    for n in range(60):
        text = " ".join(f"zq{n}x{i}vw" for i in range(40)) + " common words again"
        ids, = both([text])
        assert ids.tolist() == REFERENCE.encode_ordinary(text)
        held = sum(bpe.PIECE_EXTRA + len(p) + len(i) for known in (both.known, both.older) for p, i in known.items())
        assert held <= 40_000 + 2 * (bpe.PIECE_EXTRA + 40) * 300


def test_a_large_batch_comes_back_whole(spark):
    rows = [(i, f"text {i} " * 20) for i in range(500)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(1)
    got = {r.doc_id: r for r in bpe.encode(docs, PATH, P.PATTERN).collect()}
    assert {i: r.decoded for i, r in got.items()} == dict(rows)
    assert all(r.ids == REFERENCE.encode_ordinary(dict(rows)[i]) for i, r in got.items())
