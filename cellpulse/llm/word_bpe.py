"""Word-level BPE encoding and decoding by a table of distinct words.

1. Texts are normalised and split into words; consecutive documents form a
   *block* (``BLOCK_BYTES`` of text), which lists its distinct words once,
   frequent ones first, and keeps each document as places in that list.
2. The lists are cut by a hash of the word into buckets of about
   ``BUCKET_WORDS`` words. The task of a bucket gets its words from all blocks,
   encodes each distinct word once and answers every block.
3. A block's documents look their ids up by place. Ids are decoded by a look-up
   join with the id-to-piece table of the vocabulary, which every task holds.

What is shuffled on words is one entry per word and block, never one per
occurrence, so a word that is a third of all text is one entry per block.
Lists, places and answers are shuffled packed. A task holds one block, or the
distinct words of one bucket.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import uuid
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cellpulse.llm.common import Numbering, text_bytes, written

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 32_000_000
#: Words of all blocks' lists that share a bucket.
BUCKET_WORDS = 250_000
#: A special token's place in the word list: no word holds a space.
SPECIAL = " "
#: Letters of a word from which on merges are kept in a heap.
LONG_WORD = 100

#: Fixed value: the split pattern of the vocabulary file.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: What a vocabulary file says of its steps, besides the vocabulary.
SHAPE = {
    "normalizer": ["NFC", "Replace", "Lowercase"],
    "pre_tokenizer": [{"type": "Split", "pattern": {"Regex": SPLIT}, "behavior": "Removed", "invert": True},
                      {"type": "ByteLevel", "add_prefix_space": False, "use_regex": False}],
    "model": {"type": "BPE", "unk_token": None, "continuing_subword_prefix": None, "dropout": None, "ignore_merges": False},
    "post_processor": None, "decoder": None}
#: The same split for lower-case ASCII texts.
PLAIN_SPLIT = r"[a-z]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^ \t-\ra-z0-9]+"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: printable bytes stand for themselves, the others follow U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class WordVocabulary:
    """A word-level BPE file: how it normalises, splits, merges, and what its ids are called.

    ``path`` is a file of the ``tokenizers`` library: NFC, white space and
    lower case as normaliser, ``SPLIT`` as split pattern, byte letters, and
    merges with a mark at the end of a word. Another shape is refused.
    """

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        split = (spec["pre_tokenizer"] or {}).get("pretokenizers") or []
        shape = {
            "normalizer": [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])],
            "pre_tokenizer": [{k: v for k, v in s.items() if k != "trim_offsets"} for s in split],
            "model": {k: model.get(k) for k in ("type", "unk_token", "continuing_subword_prefix", "dropout", "ignore_merges")},
            "post_processor": spec["post_processor"], "decoder": spec["decoder"]}
        if shape != SHAPE:
            raise ValueError(f"not a word-level BPE file of the known shape: {shape}")
        self.path = path
        self.ids: dict[str, int] = model["vocab"]
        self.end: str = model["end_of_word_suffix"]
        letters = byte_letters()
        lacking = [x for c in letters for x in (c, c + self.end) if x not in self.ids]
        if lacking:
            raise ValueError(f"vocabulary lacks bytes {lacking[:5]}")
        self.byte_of = {c: b for b, c in enumerate(letters)}
        self.inner, self.last = [self.ids[c] for c in letters], [self.ids[c + self.end] for c in letters]
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.rank[self.ids[a] << 32 | self.ids[b]] = rank
            self.made.append(self.ids[a + b])
        self.special: dict[str, int] = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.pieces = {i: t for t, i in (self.ids | self.special).items()}
        # White space only separates words, so what the normaliser makes of it does not matter here.
        self.words, self.plain_words = regex.compile(SPLIT).findall, re.compile(PLAIN_SPLIT).findall
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        self._own = None

    def split(self, text: str) -> list[str]:
        """The normalised words of a text; special tokens in it are entries that start with ``SPECIAL``."""
        parts = self.marks(text) if self.marks else [text]
        if len(parts) == 1:
            return self._plain(text)
        return [w for n, part in enumerate(parts) for w in ([SPECIAL + part] if n % 2 else self._plain(part))]

    def _plain(self, text: str) -> list[str]:
        if text.isascii():
            return self.plain_words(text.lower())
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self._any(text)
        return self.words(text.lower())  # Latin-1 is composed already

    def _any(self, text: str) -> list[str]:
        """Other characters: normalised and split by the file's own tables, which differ from Python's in rare ones."""
        if self._own is None:
            whole = Tokenizer.from_file(self.path)
            self._own = whole.normalizer.normalize_str, whole.pre_tokenizer.pre_tokenize_str
        normalise, cut = self._own
        return [bytes(map(self.byte_of.__getitem__, piece)).decode() for piece, _ in cut(normalise(text))]

    def encode(self, word: str) -> list[int]:
        """Ids of one entry of ``split``: the merge of lowest rank first, the leftmost first among equals."""
        if word.startswith(SPECIAL):
            return [self.special[word[len(SPECIAL):]]]
        raw = word.encode()
        # The mark belongs to the last letter, which stands for one byte.
        symbols = [*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]]
        return self._long(symbols) if len(symbols) > LONG_WORD else self._short(symbols)

    def _short(self, symbols: list[int]) -> list[int]:
        rank, none = self.rank.get, len(self.made)
        ranks = [rank(a << 32 | b, none) for a, b in zip(symbols, symbols[1:])]
        while ranks:
            best = min(ranks)
            if best == none:
                break
            at = ranks.index(best)
            symbols[at:at + 2] = [self.made[best]]
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(symbols[at] << 32 | symbols[at + 1], none)
            if at:
                ranks[at - 1] = rank(symbols[at - 1] << 32 | symbols[at], none)
        return symbols

    def _long(self, symbols: list[int]) -> list[int]:
        """The same in n log n steps: a heap of the merges that are possible, and links between neighbours."""
        n, rank = len(symbols), self.rank.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, at, a << 32 | b) for at, (a, b) in enumerate(zip(symbols, symbols[1:])) if (r := rank(a << 32 | b)) is not None]
        heapq.heapify(waiting)
        while waiting:
            best, at, pair = heapq.heappop(waiting)
            other = after[at]
            if other >= n or symbols[at] < 0 or symbols[at] << 32 | symbols[other] != pair:
                continue  # one side was merged meanwhile
            symbols[at], symbols[other] = self.made[best], -1
            after[at] = after[other]
            if after[at] < n:
                before[after[at]] = at
            for a, b in ((before[at], at), (at, after[at])):
                if a >= 0 and b < n and (r := rank(symbols[a] << 32 | symbols[b])) is not None:
                    heapq.heappush(waiting, (r, a, symbols[a] << 32 | symbols[b]))
        return [s for s in symbols if s >= 0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> WordVocabulary:
    """One vocabulary per Python process and file."""
    return WordVocabulary(path)


def _packed(raw: bytes) -> bytes:
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), codec="zstd", asbytes=True)


def _packed_numbers(numbers: np.ndarray) -> bytes:
    """Small unsigned numbers: bytes of the same weight lie together, so the high ones cost nothing."""
    return _packed(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked_numbers(data: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(_unpacked(data), np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(path: str, block_bytes: int, id_type: pa.DataType):
    """Batches of (id, text) -> one row per block."""
    names = ["block", "ids", "counts", "places", "words", "n_words"]

    def row(ids: list, places: list[np.ndarray], words: Numbering) -> pa.RecordBatch:
        found = np.concatenate(places)
        order = np.argsort(-np.bincount(found, minlength=len(words)), kind="stable")
        rank = np.empty(len(words), np.uint32)
        rank[order] = np.arange(len(words))
        listed = list(words)
        columns = [pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(id_type)), pa.array([[len(p) for p in places]], pa.list_(pa.int32())),
                   pa.array([_packed_numbers(rank[found])], pa.binary()),
                   pa.array([_packed("\n".join([listed[i] for i in order]).encode())], pa.binary()), pa.array([len(words)], pa.int64())]
        return pa.RecordBatch.from_arrays(columns, names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = vocabulary(path).split
        ids, places, words, size = [], [], Numbering(), 0
        for batch in batches:
            for key, raw in zip(batch.column(0), text_bytes(batch.column(1))):
                if ids and size + len(raw) > block_bytes:
                    yield row(ids, places, words)
                    ids, places, words, size = [], [], Numbering(), 0
                found = split(raw.decode())
                ids.append(key.as_py())
                places.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                size += len(raw) + 64
        if ids:
            yield row(ids, places, words)

    return run


def _lists(buckets: int):
    """A block's word list -> a row per bucket: its words and their places in the block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block, data in zip(batch.column(0), batch.column(1)):
                words = _unpacked(data.as_py()).decode().split("\n")
                bucket = np.fromiter((zlib.crc32(w.encode()) * buckets >> 32 for w in words), np.int64, len(words))
                order = np.argsort(bucket, kind="stable")
                used, starts = np.unique(bucket[order], return_index=True)
                parts = np.split(order, starts[1:])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(used), pa.array([block.as_py()] * len(used)),
                     pa.array([_packed("\n".join([words[i] for i in part]).encode()) for part in parts], pa.binary()),
                     pa.array([_packed_numbers(np.diff(part, prepend=0)) for part in parts], pa.binary())],
                    ["bucket", "block", "words", "steps"])

    return run


def _answers(path: str):
    """All lists of one bucket -> the ids of their words; each distinct word is encoded once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = vocabulary(path).encode
        known: dict[str, list[int]] = {}
        for batch in batches:
            for block, words, steps in zip(*(batch.column(batch.schema.names.index(c)) for c in ("block", "words", "steps"))):
                ids = []
                for word in _unpacked(words.as_py()).decode().split("\n"):
                    found = known.get(word)
                    if found is None:
                        found = known[word] = encode(word)
                    ids.append(found)
                widths = np.fromiter(map(len, ids), np.uint32, len(ids))
                flat = np.fromiter(chain.from_iterable(ids), np.uint32, int(widths.sum()))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([block.as_py()]), pa.array([steps.as_py()], pa.binary()), pa.array([_packed_numbers(widths)], pa.binary()),
                     pa.array([_packed_numbers(flat)], pa.binary())], ["block", "steps", "widths", "flat"])

    return run


def _assembled(path: str, with_ids: bool):
    """One block and the answers to it -> its documents."""
    def run(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        pieces = vocabulary(path).pieces.__getitem__
        out = []
        for row in blocks.to_pylist():
            widths, starts = np.zeros(row["n_words"], np.int64), np.zeros(row["n_words"], np.int64)
            parts, before = [], 0
            for answer in answers.to_pylist():
                places, wide = np.cumsum(_unpacked_numbers(answer["steps"])), _unpacked_numbers(answer["widths"]).astype(np.int64)
                parts.append(_unpacked_numbers(answer["flat"]))
                widths[places], starts[places] = wide, before + np.cumsum(wide) - wide
                before += len(parts[-1])
            flat = np.concatenate(parts) if parts else np.zeros(0, "<u4")
            texts = [" ".join(map(pieces, flat[s:s + w].tolist())) for s, w in zip(starts.tolist(), widths.tolist())]
            found = _unpacked_numbers(row["places"])
            ends = np.cumsum(row["counts"])
            for key, lo, hi in zip(row["ids"], ends - row["counts"], ends):
                here = found[lo:hi]
                wide = widths[here]
                total = int(wide.sum())
                # The ids of a word lie together: the start of the word and the step inside it.
                inside = np.arange(total) - np.repeat(np.cumsum(wide) - wide, wide)
                tokens = flat[np.repeat(starts[here], wide) + inside].astype("<u4")
                decoded = " ".join(map(texts.__getitem__, here.tolist()))
                line = (key, total, hashlib.sha256(tokens.tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                out.append((*line, tokens.astype(np.int32), decoded) if with_ids else line)
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
        types = [blocks.schema.field("ids").type.value_type, pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
        columns = list(zip(*out)) or [()] * (6 if with_ids else 4)
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names[:len(columns)])

    return run


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = True,
           block_bytes: int = BLOCK_BYTES, bucket_words: int = BUCKET_WORDS) -> DataFrame:
    """Encode every text and decode its ids, one row out per row in.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256`` (of the ids as
    little-endian unsigned 32-bit integers), ``decoded_sha256`` and, with
    ``with_ids``, ``ids`` (array<int>) and ``decoded``. Special tokens in a
    text are recognised, none are added; the decoded text is the pieces with a
    space between, as the file names no decoder. A null, empty or blank text
    has no tokens and hashes of nothing. Null ids and repeated rows pass
    through, an empty table gives an empty result, other columns are ignored.
    A text longer than ``block_bytes`` is a block of its own. ``path`` must be
    readable on every executor.
    """
    typ = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    arrow = rows.select("doc_id").limit(0).toArrow().schema.field(0).type
    blocks = written(rows.mapInArrow(_blocks(path, block_bytes, arrow), (
        f"block string, ids array<{typ}>, counts array<int>, places binary, words binary, n_words bigint")), "word-blocks")
    listed = blocks.agg(F.sum("n_words")).first()[0] or 0
    lists = blocks.where("n_words > 0").select("block", "words").mapInArrow(
        _lists(1 + listed // bucket_words), "bucket bigint, block string, words binary, steps binary")
    answers = lists.groupBy("bucket").applyInArrow(_answers(path), "block string, steps binary, widths binary, flat binary")
    schema = f"doc_id {typ}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"
    return (blocks.drop("words").groupBy("block").cogroup(answers.groupBy("block"))
            .applyInArrow(_assembled(path, with_ids), schema))
