"""Byte-level BPE encoding and decoding.

Each pre-token is merged by a rank queue: one bucket per merge rank holds the places
(in a linked list of parts) where that merge is possible, and a bitmap of two levels
over the ranks gives the next one by find-first-set.  Entries that a
neighbouring merge has made stale are skipped.  A pre-token of n bytes takes
O(n log n) however long it is.

Ids are given as little-endian unsigned 32-bit integers in one binary value.

Defined results: null and empty texts have no ids; repeated rows are encoded each;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
import struct
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame

from footfall.llm.pretokens import CutUnsafe, Words, splitter

#: Bytes of output after which a batch is handed over.
BATCH_BYTES = 4 << 20
#: Words and other pre-tokens remembered by one worker.
REMEMBERED, OTHERS = 800_000, 100_000
#: Ranks by word of the lower bitmap.
WORD_BITS = 8
WORD_MASK = (1 << WORD_BITS) - 1


class Codec:
    def __init__(self, ranks_path: str, pattern: str):
        with open(ranks_path, "rb") as file:
            rows = [line.split() for line in file if line.strip()]
        self.ranks = {base64.b64decode(token): int(rank) for token, rank in rows}
        self.tokens = [b""] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            self.tokens[rank] = token
        #: Bit r of the words tells that rank r has a bucket; all zero between merges.
        self.low = [0] * ((len(self.tokens) >> WORD_BITS) + 1)
        self.split = splitter(pattern)
        self.seen: dict[str, bytes] = {}
        self.words = Words(self.word, REMEMBERED)

    def merge(self, piece: bytes) -> list[int]:
        """The ids of one pre-token.

        ``buckets`` hold the places of each rank as a heap, so the leftmost comes first;
        bit w of ``top`` tells that word w of the bitmap of ranks is not zero.
        """
        rank_of, low, n = self.ranks.get, self.low, len(piece)
        buckets: dict[int, list[int]] = {}
        top = 0
        pair = [rank_of(piece[i : i + 2]) for i in range(n - 1)]
        for i, rank in enumerate(pair):
            if rank in buckets:
                buckets[rank].append(i)  # places rise, so the list is a heap
            elif rank is not None:
                buckets[rank] = [i]
                word = rank >> WORD_BITS
                top |= 1 << word
                low[word] |= 1 << (rank & WORD_MASK)
        pair.append(None)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while top:
            word = (top & -top).bit_length() - 1
            bits = low[word]
            rank = (word << WORD_BITS) + (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                bits &= bits - 1
                low[word] = bits
                if not bits:
                    top &= top - 1
            if pair[i] != rank:
                continue  # stale: a neighbouring merge has changed this pair
            gone = after[i]
            end = after[i] = after[gone]
            left = before[i]
            pair[gone] = None
            if end < n:
                before[end] = i
                pair[i] = rank_of(piece[i : after[end]])
            else:
                pair[i] = None
            if left >= 0:
                pair[left] = rank_of(piece[left:end])
            for place in (i, left) if left >= 0 else (i,):
                rank = pair[place]
                if rank in buckets:
                    heappush(buckets[rank], place)
                elif rank is not None:
                    buckets[rank] = [place]
                    word = rank >> WORD_BITS
                    top |= 1 << word
                    low[word] |= 1 << (rank & WORD_MASK)
        ids, i = [], 0
        while i < n:
            end = after[i]
            ids.append(rank_of(piece[i:end]))
            i = end
        return ids

    def pre_token(self, text: str) -> bytes:
        word = text[1:]
        if text[:1] == " " and word.isalpha():
            return self.words[word]
        found = self.seen.get(text)
        if found is None:
            found = self.fresh(text)
            if len(text) <= 64:
                if len(self.seen) >= OTHERS:
                    self.seen.clear()
                self.seen[text] = found
        return found

    def fresh(self, text: str) -> bytes:
        piece = text.encode()
        rank = self.ranks.get(piece)
        ids = self.merge(piece) if rank is None else [rank]
        return struct.pack(f"<{len(ids)}I", *ids)

    def word(self, text: str) -> bytes:
        """A word with the space before it."""
        return self.fresh(text) if text[1:].isalpha() else self.encode_whole(text)

    def encode_whole(self, text: str) -> bytes:
        return b"".join(map(self.pre_token, self.split(text)))

    def encode(self, text: str) -> bytes:
        first, *words = text.split(" ")
        try:
            if words and first[-1:].isspace():
                raise CutUnsafe
            return self.encode_whole(first) + b"".join(map(self.words.__getitem__, words))
        except CutUnsafe:
            return self.encode_whole(text)

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, memoryview(ids).cast("I")))


@lru_cache(maxsize=2)
def codec(ranks_path: str, pattern: str) -> Codec:
    return Codec(ranks_path, pattern)


def encode_texts(
    docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """One row per input row: the id, ``n_tokens``, ``ids`` and ``decoded`` (bytes)."""
    key = docs.schema[id_col]
    kind = pa.int64() if key.dataType.typeName() == "long" else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = codec(ranks_path, pattern)
        for batch in batches:
            keys = batch.column(0) if kind is None else batch.column(0).cast(kind)
            start, size, counts, ids, decoded = 0, 0, [], [], []
            for at, text in enumerate(batch.column(1), 1):
                code = coder.encode(text.as_py() or "")
                counts.append(len(code) // 4)
                ids.append(code)
                decoded.append(coder.decode(code))
                size += 2 * len(code)
                if size >= BATCH_BYTES or at == batch.num_rows:
                    columns = [keys.slice(start, at - start), pa.array(counts, pa.int64())]
                    columns += [pa.array(ids, pa.binary()), pa.array(decoded, pa.binary())]
                    yield pa.RecordBatch.from_arrays(
                        columns, names=[id_col, "n_tokens", "ids", "decoded"]
                    )
                    start, size, counts, ids, decoded = at, 0, [], [], []

    schema = f"`{id_col}` {key.dataType.simpleString()}, n_tokens long, ids binary, decoded binary"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
