"""Byte-level BPE encoding and decoding in two tiers.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect hash. Any other is
merged from its bytes: parts form a linked list, a heap gives the pair of lowest rank, leftmost first.
Either way the ids of a pre-token are remembered in a cache of bounded size.
"""

from __future__ import annotations

import base64
import pickle
import re
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import pairwise
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from termloom.llm.common import broadcast_value, map_arrow, with_fields
from termloom.llm.perfect_hash import PerfectHash

#: Entries of a generation of the caches of pre-tokens and of spaced pieces; two generations are held.
TOKENS_KEPT = 400_000
PIECES_KEPT = 120_000
#: Longer pre-tokens and pieces aren't remembered.
LONGEST_KEPT = 64
#: Most bytes of a pickled codec that is broadcast.
CODEC_LIMIT = 64 << 20
#: Patterns whose matches hold white space alone, or one space before what holds none, and look
#: one character ahead at most. For these, a text may be cut before a space that stands between two characters
#: that aren't white space: no match reaches over such a place. Other patterns get whole texts.
SPACE_LED = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
    r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+",
)
CUT = re.compile(r"(?<=\S)(?= \S)")
#: A space beside white space (or what some library takes for it).
CROWDED = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]"


def read_ranks(data: bytes) -> dict[bytes, int]:
    """Ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


class Generations:
    """A cache of two generations: when the young one is full, it becomes the old one, which is let go."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def put(self, key: str, value: bytes) -> None:
        if len(key) <= LONGEST_KEPT:
            if len(self.young) >= self.most:
                self.young, self.old = {}, self.young
            self.young[key] = value


class Codec:
    """Encodes and decodes by a rank file's content and a pattern that splits text into pre-tokens."""

    def __init__(self, data: bytes, pattern: str):
        self.pattern, self.ranks, self.cuts = pattern, read_ranks(data), pattern in SPACE_LED
        self.whole = PerfectHash(list(self.ranks), list(self.ranks.values()))
        self.token_of = {rank: token for token, rank in self.ranks.items()}
        self.pair = [[self.ranks.get(bytes((a, b))) for b in range(256)] for a in range(256)]
        self._fresh()

    def _fresh(self) -> None:
        self.split = regex.compile(self.pattern).findall
        self.table: pa.Array | None = None
        self.tokens, self.pieces = Generations(TOKENS_KEPT), Generations(PIECES_KEPT)

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("split", "table", "tokens", "pieces")}

    def __setstate__(self, state) -> None:
        self.__dict__.update(state)
        self._fresh()

    def merge(self, word: bytes) -> list[int]:
        """Ids of a pre-token: of all pairs of neighbours the lowest rank merges first, the leftmost of equals.

        A heap entry packs rank, start and end of a pair into one integer, in this order of weight.
        """
        n, rank_of = len(word), self.ranks.get
        m = n + 1
        after, before = list(range(1, n + 2)), list(range(-1, n + 1))
        pair = self.pair
        heap = [(r * m + i) * m + i + 2 for i, (a, b) in enumerate(pairwise(word)) if (r := pair[a][b]) is not None]
        heapify(heap)
        while heap:
            x, end = divmod(heappop(heap), m)
            i = x % m
            mid = after[i]
            if mid <= i or mid >= n or after[mid] != end:
                continue  # one of the two parts has changed since
            after[i], before[end], after[mid] = end, i, -1
            if end < n and (r := rank_of(word[i : (e := after[end])])) is not None:
                heappush(heap, (r * m + i) * m + e)
            if i and (r := rank_of(word[(p := before[i]) : end])) is not None:
                heappush(heap, (r * m + p) * m + end)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[word[i : after[i]]])
            i = after[i]
        return out

    def of_token(self, token: str) -> bytes:
        """Ids of a pre-token as little-endian 32-bit integers."""
        cached = self.tokens
        if (found := cached.young.get(token)) is None:
            if (found := cached.old.get(token)) is None:
                word = token.encode()
                ids = [rank] if (rank := self.whole.get(word)) is not None else self.merge(word)
                found = pack(f"<{len(ids)}I", *ids)
            cached.put(token, found)
        return found

    def of_piece(self, piece: str) -> bytes:
        if (found := self.pieces.old.get(piece)) is None:
            found = b"".join(map(self.of_token, self.split(piece)))
        self.pieces.put(piece, found)
        return found

    def encode(self, text: str) -> bytes:
        """Ids of a text, as little-endian 32-bit integers. Pieces between cuts (see SPACE_LED) are looked up whole."""
        if not self.cuts:
            return b"".join(map(self.of_token, self.split(text)))
        pieces, of_piece = self.pieces, self.of_piece
        return b"".join([pieces.young.get(x) or of_piece(x) for x in CUT.split(text)])

    def encode_all(self, texts: pa.Array) -> pa.Array:
        """Ids of many texts: each distinct piece of the batch is encoded once, then taken for its places.

        Where no space stands beside white space, every space is a place to cut. The first piece of a text has no
        space before it, so firsts are entries of their own.
        """
        texts = pc.fill_null(texts, "")
        slow = pc.match_substring_regex(texts, CROWDED) if self.cuts else pa.array(np.ones(len(texts), bool))
        if pc.any(slow).as_py():
            out: list = [None] * len(texts)
            flags = slow.to_numpy(zero_copy_only=False)
            for i in np.flatnonzero(flags).tolist():
                out[i] = self.encode(texts[i].as_py())
            plain = np.flatnonzero(~flags)
            for i, ids in zip(plain.tolist(), self.encode_all(texts.take(pa.array(plain))).to_pylist(), strict=True):
                out[i] = ids
            return pa.array(out, pa.large_binary())
        if not len(texts):
            return pa.array([], pa.large_binary())
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        starts = split.offsets.to_numpy()
        pieces = split.flatten().dictionary_encode()
        young, of_piece = self.pieces.young, self.of_piece
        ids = []
        for word in pieces.dictionary.to_pylist():
            piece = " " + word
            ids.append(young.get(piece) or of_piece(piece))
        at = pieces.indices.to_numpy().astype(np.int64)
        firsts = starts[:-1] - starts[0]
        words = pieces.dictionary.take(pa.array(at[firsts])).to_pylist()
        at[firsts] = np.arange(len(ids), len(ids) + len(words))
        taken = pa.array([*ids, *map(of_piece, words)], pa.large_binary()).take(pa.array(at))
        offsets, data = taken.buffers()[1:]
        ends = np.frombuffer(offsets, np.int64, len(taken) + 1)[starts - starts[0]]
        return pa.Array.from_buffers(pa.large_binary(), len(texts), [None, pa.py_buffer(np.ascontiguousarray(ends)), data])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token_of.__getitem__, np.frombuffer(ids, "<u4").tolist()))

    def decode_all(self, ids: pa.Array) -> pa.Array:
        """Bytes of many texts' ids, through one table of the tokens' bytes; null stays null."""
        if self.table is None:
            self.table = pa.array([self.token_of.get(i) for i in range(max(self.token_of, default=-1) + 1)], pa.large_binary())
        ids = ids.cast(pa.large_binary())
        counts = pc.fill_null(pc.divide(pc.binary_length(ids), 4), 0).to_numpy(zero_copy_only=False)
        joined = b"".join(x for x in ids.to_pylist() if x)
        taken = self.table.take(pa.array(np.frombuffer(joined, "<u4")))
        if taken.null_count:
            raise ValueError("an id that the vocabulary lacks")
        offsets, data = taken.buffers()[1:]
        ends = np.frombuffer(offsets, np.int64, len(taken) + 1)[np.concatenate(([0], np.cumsum(counts)))]
        valid = pc.is_valid(ids)
        made = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, pa.py_buffer(np.ascontiguousarray(ends)), data])
        return pc.if_else(valid, made, pa.scalar(None, pa.large_binary()))


@cache
def _built(path: str, pattern: str) -> tuple[Codec, int]:
    with open(path, "rb") as file:
        made = Codec(file.read(), pattern)
    return made, len(pickle.dumps(made))


def shared(spark: SparkSession, path: str, pattern: str):
    """The codec, built on the driver alone and broadcast (size checked); its caches are each worker's own."""
    made, size = _built(path, pattern)
    return broadcast_value(spark, made, CODEC_LIMIT, size)


def encode(docs: DataFrame, path: str, pattern: str, *, text: str = "text", ids: str = "token_ids", decoded: str | None = None) -> DataFrame:
    """Add ``ids``: the text's token ids as little-endian unsigned 32-bit integers (binary).

    With ``decoded``, that column gets the bytes that the ids decode to, from the same pass. A null
    text counts as empty and gives no ids. Rows, order within partitions and other columns stay;
    columns of ``docs`` that have the new names are replaced. Special tokens are never produced.
    """
    names = [ids, *([decoded] if decoded else [])]
    kept = docs.drop(*names)
    own = shared(docs.sparkSession, path, pattern)
    schema = with_fields(kept, ", ".join(f"{name} binary" for name in names))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = own.value
        columns = [codec.encode_all(batch.column(text))]
        if decoded:
            columns.append(codec.decode_all(columns[0]))
        columns = [x.cast(pa.binary()) for x in columns]
        return pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, *names])

    return map_arrow(kept, schema, run)


def decode(encoded: DataFrame, path: str, pattern: str, *, ids: str = "token_ids", decoded: str = "decoded") -> DataFrame:
    """Add ``decoded``: the bytes of the tokens of ``ids``; null ids give null."""
    kept = encoded.drop(decoded)
    own = shared(encoded.sparkSession, path, pattern)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        codec = own.value
        made = codec.decode_all(batch.column(ids)).cast(pa.binary())
        return pa.RecordBatch.from_arrays([*batch.columns, made], [*batch.schema.names, decoded])

    return map_arrow(kept, with_fields(kept, f"{decoded} binary"), run)
