"""Token counts by a finite-state transducer compiled as it is used.

The transducer reads the bytes of a pre-token.  A state holds the longest suffix read
that some vocabulary token starts with, and for every place in that suffix the last
token of the merged text up to there.  Reading a byte, the last token changes to the
one vocabulary token that ends here and may follow the last token before it (two
tokens may follow each other if merging their joined bytes gives just these two); the
transition is annotated with the change in the number of tokens, one more than at the
place where that token starts.  States and transitions are made when first needed.

Texts are read in chunks.  A chunk's map from the state before it to the state after
it is kept as three parts: the text up to its first safe cut, whose reading depends on
what comes before; the tokens emitted between its cuts; and the text after its last
cut.  A safe cut is a space between two characters that are no white space; there every
state leads to the start state.  Maps compose associatively, and are composed by a scan
in pairs, so the work does not depend on how a text is cut into chunks.

Defined results: null and empty texts have no tokens; strings of special tokens count
as one token each, as the library has them; repeated rows are counted each; other
columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from footfall.llm.pretokens import CutUnsafe, Words, splitter

CHUNK_CHARS = 1 << 16
#: Bounds of one worker's memory; beyond them it starts anew.
REMEMBERED, STATES = 400_000, 150_000


def byte_letters() -> dict[str, int]:
    """The printable character that stands for each byte in the vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Transducer:
    def __init__(self, vocabulary_path: str):
        with open(vocabulary_path, encoding="utf-8") as file:
            spec = json.load(file)
        letters = byte_letters()
        raw = lambda token: bytes(letters[c] for c in token)
        special = {token["content"] for token in spec["added_tokens"]}
        self.special = sorted(special, key=len, reverse=True)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.merges = {(raw(a), raw(b)): rank for rank, (a, b) in enumerate(pairs)}
        tokens = {raw(t) for t in spec["model"]["vocab"] if t not in special}
        self.tokens = {t for t in tokens if len(t) == 1} | {a + b for a, b in self.merges}
        self.starts = {t[:n] for t in self.tokens for n in range(1, len(t))}
        self.longest = max(map(len, self.tokens))
        self.whole: dict[bytes, bool] = {}
        self.follows: dict[tuple[bytes, bytes], bool] = {}
        self.reset()

    def reset(self) -> None:
        #: Of each state: (suffix, ((last token, tokens up to there less those now), ...)).
        self.states: list[tuple[bytes, tuple]] = [(b"", ((None, 0),))]
        self.numbers = {self.states[0]: 0}
        self.steps: list[dict[int, tuple[int, int]]] = [{}]

    def merged(self, data: bytes) -> list[bytes]:
        parts = [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            ranks = [self.merges.get(two, 1 << 60) for two in zip(parts, parts[1:], strict=False)]
            least = min(ranks)
            if least == 1 << 60:
                break
            i = ranks.index(least)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def may_stand(self, token: bytes) -> bool:
        known = self.whole.get(token)
        if known is None:
            known = self.whole[token] = self.merged(token) == [token]
        return known

    def may_follow(self, first: bytes | None, token: bytes) -> bool:
        if first is None:
            return True
        known = self.follows.get((first, token))
        if known is None:
            if len(self.follows) >= REMEMBERED:
                self.follows.clear()
            known = self.merged(first + token) == [first, token]
            self.follows[first, token] = known
        return known

    def compile(self, state: int, byte: int) -> tuple[int, int]:
        suffix, history = self.states[state]
        read = suffix + bytes((byte,))
        for start in range(len(read)):
            token = read[start:]
            last, before = history[start]
            if token in self.tokens and self.may_stand(token) and self.may_follow(last, token):
                break
        emitted = before + 1
        keep = next((i for i in range(len(read)) if read[i:] in self.starts), len(read))
        places = [(last, tokens - emitted) for last, tokens in history[keep:]]
        key = (read[keep:], (*places, (token, 0)))
        number = self.numbers.get(key)
        if number is None:
            number = self.numbers[key] = len(self.states)
            self.states.append(key)
            self.steps.append({})
        self.steps[state][byte] = number, emitted
        return number, emitted

    def run(self, data: bytes) -> int:
        """Tokens of one pre-token."""
        if len(self.states) > STATES:
            self.reset()
        steps, state, total = self.steps, 0, 0
        for byte in data:
            step = steps[state].get(byte)
            if step is None:
                step = self.compile(state, byte)
            state, emitted = step
            total += emitted
        return total


class ChunkMap(NamedTuple):
    """What reading a chunk does: ``tail`` is None where it has no safe cut."""

    head: str
    tokens: int
    tail: str | None


class Counter:
    def __init__(self, vocabulary_path: str, pattern: str):
        self.transducer = Transducer(vocabulary_path)
        self.split = splitter(pattern)
        self.seen: dict[str, int] = {}
        self.words = Words(self.whole, REMEMBERED)

    def pre_token(self, text: str) -> int:
        found = self.seen.get(text)
        if found is None:
            found = self.transducer.run(text.encode())
            if len(text) <= 64:
                if len(self.seen) >= REMEMBERED:
                    self.seen.clear()
                self.seen[text] = found
        return found

    def whole(self, text: str) -> int:
        """Tokens of a text between safe cuts."""
        if text[:1] == " " and text[1:].isalpha():
            return self.pre_token(text)
        return sum(map(self.pre_token, self.split(text)))

    def chunk_map(self, chunk: str) -> ChunkMap:
        first, *rest = chunk.split(" ")
        if len(rest) < 2:
            return ChunkMap(chunk, 0, None)
        last = rest.pop()
        try:
            if not first or not last or first[-1].isspace() or last[0].isspace():
                raise CutUnsafe
            return ChunkMap(first, sum(map(self.words.__getitem__, rest)), " " + last)
        except CutUnsafe:
            return self.careful_map(chunk)

    def careful_map(self, chunk: str) -> ChunkMap:
        """The same where some of the spaces are no safe cuts."""
        cuts = [
            i
            for i in range(1, len(chunk) - 1)
            if chunk[i] == " " and not chunk[i - 1].isspace() and not chunk[i + 1].isspace()
        ]
        if not cuts:
            return ChunkMap(chunk, 0, None)
        return ChunkMap(chunk[: cuts[0]], self.whole(chunk[cuts[0] : cuts[-1]]), chunk[cuts[-1] :])

    def compose(self, a: ChunkMap, b: ChunkMap) -> ChunkMap:
        if a.tail is None:
            return ChunkMap(a.head + b.head, b.tokens, b.tail)
        if b.tail is None:
            return ChunkMap(a.head, a.tokens, a.tail + b.head)
        return ChunkMap(a.head, a.tokens + self.whole(a.tail + b.head) + b.tokens, b.tail)

    def ordinary(self, text: str) -> int:
        if len(text) <= CHUNK_CHARS:
            maps = [self.chunk_map(text)]
        else:
            starts = range(0, len(text), CHUNK_CHARS)
            maps = [self.chunk_map(text[i : i + CHUNK_CHARS]) for i in starts]
        while len(maps) > 1:
            odd = maps[len(maps) & ~1 :]
            pairs = zip(maps[::2], maps[1::2], strict=False)
            maps = [self.compose(a, b) for a, b in pairs] + odd
        head, tokens, tail = maps[0]
        return self.whole(head) + tokens + (self.whole(tail) if tail else 0)

    def count(self, text: str) -> int:
        parts, specials = [text], 0
        for string in self.transducer.special:
            if string in text:
                parts = [piece for part in parts for piece in part.split(string)]
        specials = len(parts) - 1
        return specials + sum(map(self.ordinary, parts))


@lru_cache(maxsize=2)
def counter(vocabulary_path: str, pattern: str) -> Counter:
    return Counter(vocabulary_path, pattern)


def count_tokens(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """One row per input row: the id, ``n_bytes`` (UTF-8) and ``n_tokens``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(vocabulary_path, pattern)
        for batch in batches:
            texts = [text or "" for text in batch.column(1).to_pylist()]
            columns = [
                batch.column(0),
                pa.array([len(text.encode()) for text in texts], pa.int64()),
                pa.array([counts.count(text) for text in texts], pa.int64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "n_bytes", "n_tokens"])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"`{id_col}` {kind}, n_bytes long, n_tokens long"
    return docs.select(id_col, text_col).mapInArrow(run, schema)
