"""Word-level BPE: ids and decoded text equal the library's, whatever the blocks."""

import hashlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cellpulse.llm import word_bpe
from llm_frames import SF_SMALL, awkward, nothing, shipped  # noqa: F401

PATH = P.path("word_bpe_49k.json")
REFERENCE = Tokenizer.from_file(PATH)
OURS = word_bpe.vocabulary(PATH)
SPECIALS = [
    (201, "a<|endoftext|>b <|startoftext|><|endoftext|> c"), (202, "<|endoftext|>"), (203, "<|ENDOFTEXT|> <|endoftext"),
    (204, "ΟΔΟΣ Σ ΑΣ İstanbul ǅ ﬁ Å ́é ́᷶ ՘x \U00011de0 Ᲊ"), (205, "it's WE'LL 'tis x'S 1234 ½ ٣"),
    (206, "thtion" * 3_000), (207, " \u0085  a\x1cb")]


def plain(text):
    ids = REFERENCE.encode(text or "", add_special_tokens=False).ids
    return ids, REFERENCE.decode(ids, skip_special_tokens=False)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@pytest.mark.parametrize("block_bytes,bucket_words", [(1, 40), (5_000, 3), (16_000_000, 250_000)])
def test_every_row_as_the_library(spark, awkward, block_bytes, bucket_words):
    more = spark.createDataFrame(SPECIALS, "doc_id bigint, text string")
    docs = awkward.select("doc_id", "text").unionByName(more)
    if block_bytes == 1:
        docs = docs.where("doc_id is null or doc_id < 20 or doc_id > 200")
    got = word_bpe.encode(docs, PATH, block_bytes=block_bytes, bucket_words=bucket_words).collect()
    want = [(r.doc_id, *plain(r.text)) for r in docs.collect()]
    assert sorted(((r.doc_id, list(r.ids), r.decoded) for r in got), key=repr) == sorted(want, key=repr)
    for r in got:
        assert r.n_tokens == len(r.ids)
        assert r.ids_sha256 == sha(np.array(r.ids, "<u4").tobytes()) and r.decoded_sha256 == sha(r.decoded.encode())


def test_empty_tables_and_texts(spark, nothing):
    assert word_bpe.encode(nothing, PATH).collect() == []
    blank = spark.createDataFrame([("a", None), ("b", ""), (None, " \n")], "doc_id string, text string")
    got = word_bpe.encode(blank, PATH, with_ids=False).collect()
    assert sorted((r.doc_id or "", r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == [
        (i, 0, sha(b""), sha(b"")) for i in ("", "a", "b")]


def test_query_over_its_table(spark):
    import __spark_entry__ as entry
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in entry.queries()["op13_word_bpe"](spark, SF_SMALL).collect()}
    want = {}
    for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "text").collect():
        ids, text = plain(r.text)
        want[r.doc_id] = (len(ids), sha(np.array(ids, "<u4").tobytes()), sha(text.encode()))
    assert got == want


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_any_text_as_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert [i for word in OURS.split(text) for i in OURS.encode(word)] == plain(text)[0]


def test_every_character_as_the_library():
    """A step of 7 keeps this short; every range of the tables is met."""
    for start in range(0, 0x110000, 7):
        if 0xD800 <= start < 0xE000:
            continue
        text = f"aB{chr(start)}c 1{chr(start)}́!'s"
        assert [i for word in OURS.split(text) for i in OURS.encode(word)] == plain(text)[0], hex(start)


@settings(max_examples=100, deadline=None)
@given(st.text(alphabet="abcdeghilnorstuy", min_size=1, max_size=60))
def test_both_ways_of_merging_agree(word):
    raw = word.encode()
    symbols = [*map(OURS.inner.__getitem__, raw[:-1]), OURS.last[raw[-1]]]
    assert OURS._short(list(symbols)) == OURS._long(list(symbols))


def test_each_distinct_word_is_encoded_once(monkeypatch):
    """A bucket's task meets a word in many blocks and encodes it once."""
    seen = []
    monkeypatch.setattr(OURS, "encode", lambda w: seen.append(w) or [len(w)])
    lists = pa.RecordBatch.from_pydict({
        "bucket": [0, 0, 0], "block": ["a", "b", "c"], "words": [word_bpe._packed(b"same\nother"), word_bpe._packed(b"same"), word_bpe._packed(b"other\nnew")],
        "steps": [word_bpe._packed_numbers(np.array([0, 1])), word_bpe._packed_numbers(np.array([4])), word_bpe._packed_numbers(np.array([1, 2]))]})
    answers = [b.to_pylist()[0] for b in word_bpe._answers(PATH)(iter([lists]))]
    assert sorted(seen) == ["new", "other", "same"]
    assert [word_bpe._unpacked_numbers(a["flat"]).tolist() for a in answers] == [[4, 5], [4], [5, 3]]


def test_a_hot_word_is_one_entry_per_block(spark):
    docs = spark.createDataFrame([(i, "same words " * 50) for i in range(200)], "doc_id bigint, text string").coalesce(1)
    ids, _ = plain("same words " * 50)
    got = word_bpe.encode(docs, PATH, block_bytes=10_000).collect()
    assert len(got) == 200 and all(r.ids == ids for r in got)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2 ** 32 - 1)))
def test_packed_numbers_come_back(numbers):
    assert word_bpe._unpacked_numbers(word_bpe._packed_numbers(np.array(numbers, np.uint32))).tolist() == numbers


def test_another_file_is_refused():
    with pytest.raises(ValueError):
        word_bpe.WordVocabulary(P.path("byte_bpe_50k.json"))
