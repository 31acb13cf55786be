"""Byte-level BPE encoding and decoding by prefix dynamic programming.

Every byte prefix of a piece has one encoding, so it has one *valid last
token*: the only token that ends the prefix, follows the valid last token of
what precedes it, and forms with it a pair that BPE itself would leave as it
is. One table entry per byte therefore holds the whole encoding:

* an append extends the table and changes none of its entries;
* an edit keeps all entries before it, and stops re-encoding as soon as the
  new table runs in step with the old one again;
* reading the ids walks the table from the end.

The work is linear in the length of a piece, however long it is.
"""

from __future__ import annotations

import base64
import hashlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cellpulse.llm.common import slices, text_bytes

#: Bytes of remembered pieces and ids per Python worker. Half of them are forgotten at
#: a time: those that the latest half of the pieces did not hold.
PIECE_MEMORY = 48_000_000
#: Bytes that Python takes for a remembered piece besides its own and its ids'.
PIECE_EXTRA = 180
#: Token pairs whose test is remembered.
PAIR_MEMORY = 300_000
#: Bytes of text split at a time.
STEP_BYTES = 1_000_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a vocabulary file: one base64 token and its rank per line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class PrefixBPE:
    """Vocabulary with the pair test that the prefix tables rest on."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        # Longest token by its last four bytes: what is not in here ends no token of four or more.
        self.reach: dict[bytes, int] = {}
        for token in ranks:
            if len(token) > 3:
                self.reach[token[-4:]] = max(len(token), self.reach.get(token[-4:], 0))
        self._pairs: dict[tuple[int, int], bool] = {}
        missing = [b for b in range(256) if bytes([b]) not in ranks]
        if missing:
            raise ValueError(f"vocabulary lacks single bytes {missing[:5]}")

    def _merge(self, piece: bytes) -> list[int]:
        """Plain merging by rank, for strings as short as two tokens."""
        parts = [piece[i:i + 1] for i in range(len(piece))]
        get = self.ranks.get
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                rank = get(parts[i] + parts[i + 1])
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                break
            parts[at:at + 2] = [parts[at] + parts[at + 1]]
        return [self.ranks[p] for p in parts]

    def fits(self, before: int, token: int) -> bool:
        """True if BPE encodes the bytes of the two tokens as just these two.

        ``before`` is -1 at the start of a piece: then the token must be what
        its own bytes encode to.
        """
        if before < 0:
            return self._merge(self.bytes_of[token]) == [token]
        return self._merge(self.bytes_of[before] + self.bytes_of[token]) == [before, token]

    def extend(self, data: bytes, last: list[int], to: int | None = None) -> None:
        """Append the valid last tokens of the prefixes ``len(last) + 1`` to ``to`` (default: all) of ``data``."""
        get, pairs, reach = self.ranks.get, self._pairs, self.reach.get
        known = pairs.get
        for end in range(len(last) + 1, (len(data) if to is None else to) + 1):
            first = end - reach(data[end - 4:end], 3) if end > 3 else 0
            for start in range(first if first > 0 else 0, end):
                token = get(data[start:end])
                if token is None:
                    continue
                before = last[start - 1] if start else -1
                key = (before + 1) << 32 | token
                fits = known(key)
                if fits is None:
                    if len(pairs) >= PAIR_MEMORY:
                        pairs.clear()
                    fits = pairs[key] = self.fits(before, token)
                if fits:
                    last.append(token)
                    break

    def walk(self, last: list[int]) -> list[int]:
        """Ids of the whole prefix table, read from its end."""
        out, end, bytes_of = [], len(last), self.bytes_of
        while end:
            token = last[end - 1]
            out.append(token)
            end -= len(bytes_of[token])
        return out[::-1]

    def encode_piece(self, piece: bytes) -> list[int]:
        """Ids of one piece (one match of the split pattern)."""
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else PrefixTable(self, piece).ids()

    def encode_sorted(self, pieces: list[bytes]) -> Iterator[list[int]]:
        """Ids of each of ``pieces``, which are in order: each keeps the table of what it shares with the last."""
        data, last = b"", []
        for piece in pieces:
            whole = self.ranks.get(piece)
            if whole is not None:
                yield [whole]
                continue
            shared = 0
            for a, b in zip(data, piece):
                if a != b:
                    break
                shared += 1
            data = piece
            del last[shared:]
            self.extend(data, last)
            yield self.walk(last)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class PrefixTable:
    """Valid last token of every prefix of one piece, open to appends and edits."""

    def __init__(self, bpe: PrefixBPE, piece: bytes = b""):
        self.bpe, self.data, self.last = bpe, b"", []
        self.append(piece)

    def append(self, more: bytes) -> None:
        """Exact append: entries that exist stay as they are."""
        self.data += more
        self.bpe.extend(self.data, self.last)

    def edit(self, start: int, end: int, new: bytes) -> int:
        """Replace ``data[start:end]`` by ``new``; returns the entries computed anew.

        An entry depends on no more than the ``longest`` bytes and entries
        before it, so once that many entries after the edit agree with the old
        ones, the rest of the old table holds.
        """
        old_last, shift = self.last, len(new) - (end - start)
        self.data = self.data[:start] + new + self.data[end:]
        self.last = old_last[:start]
        agree, done = 0, 0
        for at in range(start + 1, len(self.data) + 1):
            self.bpe.extend(self.data, self.last, at)
            token = self.last[-1]
            done += 1
            old_at = at - shift
            same = at > start + len(new) and old_at > end and old_last[old_at - 1] == token
            agree = agree + 1 if same else 0
            if agree >= self.bpe.longest:
                self.last.extend(old_last[old_at:])
                break
        return done

    def ids(self) -> list[int]:
        return self.bpe.walk(self.last)


class Codec:
    """Whole texts: split pattern, remembered pieces, ids and decoded bytes."""

    def __init__(self, path: str, pattern: str):
        self.bpe = PrefixBPE(read_ranks(path))
        self.find = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.size = 0
        # By id: its number and a space, and its bytes (ids that the vocabulary lacks are never taken).
        every = range(max(self.bpe.bytes_of) + 1)
        self.numerals = pa.array([b"%d " % i for i in every], pa.large_binary())
        self.tokens = pa.array([self.bpe.bytes_of.get(i, b"") for i in every], pa.large_binary())

    def _remember(self, new: set[str]) -> None:
        """Ids of pieces, packed as 32-bit integers."""
        if self.size > PIECE_MEMORY // 2:
            self.known, self.older, self.size = {}, self.known, 0
        missing = new.difference(self.known)
        older = self.older.get
        found = {piece: ids for piece in missing if (ids := older(piece)) is not None}
        order = sorted(piece.encode() for piece in missing.difference(found))
        for piece, ids in zip(order, self.bpe.encode_sorted(order)):
            found[piece.decode()] = array("i", ids).tobytes()
        self.known.update(found)
        self.size += sum(PIECE_EXTRA + len(piece) + len(ids) for piece, ids in found.items())

    def __call__(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Ids of each text."""
        split = [self.find(text) for text in texts]
        self._remember(set().union(*split))
        known = self.known.__getitem__
        for pieces in split:
            yield np.frombuffer(b"".join(map(known, pieces)), np.int32)

    def decimal(self, ids: np.ndarray | list[int]) -> str:
        """The ids as decimal numbers with a space between."""
        return str(joined(self.numerals, ids)[:-1], "ascii")

    def decode(self, ids: np.ndarray) -> memoryview:
        """The bytes that the ids stand for."""
        return joined(self.tokens, ids)


def joined(values: pa.Array, at: np.ndarray | list[int]) -> memoryview:
    """The chosen values, one after another: taken, they lie so in Arrow's buffer."""
    taken = values.take(pa.array(at, pa.int32()))
    end = int(np.frombuffer(taken.buffers()[1], np.int64)[len(at)]) if len(at) else 0
    return memoryview(taken.buffers()[2])[:end] if end else memoryview(b"")


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """One codec per Python worker and vocabulary; its memory outlives a task."""
    if (path, pattern) not in _CODECS:
        _CODECS[path, pattern] = Codec(path, pattern)
    return _CODECS[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id",
           text_col: str = "text", with_ids: bool = True) -> DataFrame:
    """Encode every text and decode the ids again, one row out per row in.

    Returns ``doc_id``, ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and,
    with ``with_ids``, ``ids`` (array<int>) and ``decoded`` (the text that the
    ids decode to). No special tokens. A null text is empty: no tokens, hashes
    of nothing. Null ids and repeated rows pass through; other columns of the
    input are ignored. ``path`` must be readable on every executor.
    """
    typ = dict(docs.dtypes)[id_col]
    schema = f"doc_id {typ}, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    if with_ids:
        schema += ", ids array<int>, decoded string"

    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = codec(path, pattern)
        for batch in batches:
            raws = batch.column(1).cast(pa.large_binary())
            sizes = pc.fill_null(pc.binary_length(raws), 0).to_numpy(zero_copy_only=False)
            # A batch out per slice: what is held at a time does not grow with the batch that came in.
            for lo, hi in slices(sizes, STEP_BYTES):
                counts, digests, hashes, tokens, decoded = [], [], [], [], []
                for ids in both([raw.decode() for raw in text_bytes(raws[lo:hi])]):
                    text = both.decode(ids)
                    counts.append(len(ids))
                    digests.append(hashlib.sha256(both.decimal(ids).encode()).hexdigest())
                    hashes.append(hashlib.sha256(text).hexdigest())
                    if with_ids:
                        tokens.append(ids)
                        decoded.append(str(text, "utf-8", "replace"))
                arrays = [batch.column(0)[lo:hi], pa.array(counts, pa.int64()), pa.array(digests, pa.string()), pa.array(hashes, pa.string())]
                if with_ids:
                    ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
                    arrays += [pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens))), pa.array(decoded, pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names[:len(arrays)])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, schema)
