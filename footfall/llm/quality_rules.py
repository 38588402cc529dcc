"""Quality rules: counting rules, then a linear-chain CRF over the lines of a text.

The CRF labels every line that has a word as content or boilerplate, from its share of
symbols, capitals, exclamation marks, repeated words, list marks and digits, its
length, its end, and whether it equals an earlier line; Viterbi decoding gives the
most likely sequence.  A text is kept if its content lines hold at least half of its
characters in words, and the counting rules do not reject it.

Weights are fitted on a bounded sample of labelled documents (``TRAIN_DOCS``, and of
each at most ``TRAIN_LINES`` lines), each line taking its document's label; everything
else covers all rows and whole texts.  Without labels the weights of ``DEFAULT`` hold.

Words are runs of characters other than the six of ASCII white space.  Defined results:
a null text has no words; texts without words fail the counting rules; repeated rows
are judged each; other columns are kept as they are; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from footfall.llm.tables import as_row, from_row

TRAIN_DOCS, TRAIN_LINES = 600, 256
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 10, 20, 0.5
WINDOW = 5
SYMBOLS = b"#*$%&|<>"
SPACE = b" \t\n\r\x0b\x0c"
N_FEATURES = 9


def _marks(chars: bytes) -> np.ndarray:
    table = np.zeros(128, np.float64)
    table[list(chars)] = 1
    return table


#: One column each for symbols, "!" and digits, by ASCII code.
MARKS = np.stack([_marks(SYMBOLS), _marks(b"!"), _marks(b"0123456789")], axis=1)


class Crf(NamedTuple):
    """Scores of content against boilerplate: by feature, and by pair of labels."""

    weights: np.ndarray
    moves: np.ndarray


#: Content unless there are many symbols, capitals, "!" or repeats.
DEFAULT = Crf(
    np.array([3.0, -12.0, -4.0, -12.0, -4.0, 0.0, -2.0, -2.0, 0.0]),
    np.array([[1.0, 0.0], [0.0, 1.0]]),
)


class Lines(NamedTuple):
    words: list[bytes]
    sizes: np.ndarray  # characters in words, of each line with a word
    features: np.ndarray
    n_dup: int


def read_lines(text: str) -> Lines:
    data = text.encode()
    words: list[bytes] = []
    seen: set[bytes] = set()
    rows, spans, n_dup, at = [], [], 0, 0
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            dup = line in seen
            seen.add(line)
            n_dup += dup
            words += own
            end = at + len(line)
            n = len(own)
            rows.append(
                (1 - len(set(own)) / n, min(np.log1p(n) / 5, 2), dup, line.rstrip(SPACE)[-1:] in b".!?")
            )
            spans += [at, end]
        at += len(line) + 1
    if not rows:
        return Lines(words, np.zeros(0), np.zeros((0, N_FEATURES)), 0)
    codes = np.frombuffer(data, np.uint8)
    first = codes < 128
    counted = np.zeros((len(codes) + 1, 5), np.int32)
    plain = np.where(first, codes, 0)
    counted[1:, :3] = MARKS[plain]
    counted[1:, 3] = _capitals(text, codes)
    counted[1:, 4] = ((codes & 0xC0) != 0x80) & (codes != 32) & ((codes < 9) | (codes > 13))
    np.cumsum(counted, axis=0, out=counted)
    ends = np.array(spans)
    per = (counted[ends[1::2]] - counted[ends[::2]]).astype(np.float64)
    size = np.maximum(per[:, 4], 1)
    shares = per[:, :4] / size[:, None]
    rest = np.array(rows, np.float64)
    features = np.column_stack([np.ones(len(rows)), shares[:, 0], shares[:, 3], shares[:, 1], rest,
                                shares[:, 2]])
    return Lines(words, per[:, 4], features, n_dup)


def _capitals(text: str, codes: np.ndarray) -> np.ndarray:
    """1 at the first byte of every character that has another lower-case form."""
    lower = text.lower()
    if len(lower) != len(text):
        lower = "".join(c.lower()[0] for c in text)
    changed = np.frombuffer(text.encode("utf-32-le"), np.uint32) != np.frombuffer(
        lower.encode("utf-32-le"), np.uint32
    )
    out = np.zeros(len(codes), np.int32)
    out[(codes & 0xC0) != 0x80] = changed
    return out


def repeated_words(words: list[bytes]) -> int:
    """Words in windows of five that occur twice or more in the text."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, len(words))
    if len(number) == len(words):
        return 0
    name = ids[:n]
    for i in range(1, WINDOW):
        # ranks of ever longer windows, so that no two different ones get one number
        name = np.unique(name * len(number) + ids[i : i + n], return_inverse=True)[1]
    twice = np.bincount(name)[name] > 1
    covered = np.zeros(len(words) + 1, np.int64)
    covered[:n] += twice
    covered[WINDOW : WINDOW + n] -= twice
    return int(np.count_nonzero(np.cumsum(covered)[:-1]))


def viterbi(scores: np.ndarray, moves: np.ndarray) -> np.ndarray:
    """The best sequence of labels (1: content) for scores of content against 0."""
    (bb, bc), (cb, cc) = moves.tolist()
    boiler, content, back = 0.0, 0.0, []
    for at, score in enumerate(scores.tolist()):
        if at:
            from_b = boiler + bb >= content + cb
            to_b = boiler + bb if from_b else content + cb
            from_c = content + cc >= boiler + bc
            to_c = content + cc if from_c else boiler + bc
            back.append((0 if from_b else 1, 1 if from_c else 0))
            boiler, content = to_b, to_c
        content += score
    label, labels = int(content >= boiler), []
    labels.append(label)
    for step in reversed(back):
        label = step[label]
        labels.append(label)
    return np.array(labels[::-1])


def fit_crf(sequences: list[tuple[np.ndarray, int]], rounds: int = 150, rate: float = 0.5) -> Crf:
    """Gradient ascent of the conditional likelihood; all lines of a text share a label."""
    sequences = [s for s in sequences if len(s[0])]
    if not sequences or len({label for _, label in sequences}) < 2:
        return DEFAULT
    longest = max(len(x) for x, _ in sequences)
    n = len(sequences)
    feats = np.zeros((n, longest, N_FEATURES))
    there = np.zeros((n, longest), bool)
    gold = np.array([label for _, label in sequences])
    for i, (x, _) in enumerate(sequences):
        feats[i, : len(x)] = x
        there[i, : len(x)] = True
    lengths = there.sum(1)
    share = 1 / np.bincount(gold, minlength=2)[gold] / 2  # both labels weigh the same
    weights, moves = DEFAULT.weights.copy(), DEFAULT.moves.copy()
    sums_w, sums_m = np.zeros_like(weights), np.zeros_like(moves)
    for _ in range(rounds):
        emit = np.stack([np.zeros((n, longest)), feats @ weights], axis=2)
        ahead, behind = np.zeros_like(emit), np.zeros_like(emit)
        ahead[:, 0] = emit[:, 0]
        for t in range(1, longest):
            step = np.logaddexp.reduce(ahead[:, t - 1, :, None] + moves, axis=1) + emit[:, t]
            ahead[:, t] = np.where(there[:, t, None], step, ahead[:, t - 1])
        for t in range(longest - 2, -1, -1):
            inner = moves + (emit[:, t + 1] + behind[:, t + 1])[:, None, :]
            behind[:, t] = np.where(there[:, t + 1, None], np.logaddexp.reduce(inner, axis=2), 0)
        total = np.logaddexp.reduce(ahead[:, -1], axis=1)
        chance = np.exp(ahead[:, :, 1] + behind[:, :, 1] - total[:, None]) * there
        scale = share / lengths
        missed = (gold[:, None] * there - chance) * scale[:, None]
        grad_w = np.einsum("nt,ntf->f", missed, feats) - 1e-3 * weights
        both = (
            ahead[:, :-1, :, None] + moves + (emit + behind)[:, 1:, None, :] - total[:, None, None, None]
        )
        pairs = np.exp(np.minimum(both, 0)) * (there[:, 1:] * scale[:, None])[:, :, None, None]
        grad_m = -pairs.sum((0, 1)) - 1e-3 * moves
        np.add.at(grad_m, (gold, gold), (lengths - 1) * scale)
        sums_w += grad_w**2
        sums_m += grad_m**2
        weights += rate * grad_w / np.sqrt(sums_w + 1e-12)
        moves += rate * grad_m / np.sqrt(sums_m + 1e-12)
    return Crf(weights, moves)


def train_lines(features: np.ndarray, digest: int) -> np.ndarray:
    """All lines, or ``TRAIN_LINES`` of them in a row from a place that the digest draws."""
    start = digest % max(len(features) - TRAIN_LINES + 1, 1)
    return features[start : start + TRAIN_LINES]


def train(docs: DataFrame, labels: DataFrame, limit: int = TRAIN_DOCS) -> Crf:
    """Fits on the ``limit`` labelled documents whose ids have the smallest hashes.

    Labels without a document take no place.  Rows of equal id are taken by a hash of
    their text.
    """
    wanted = labels.filter(F.col("quality").isNotNull()).select("doc_id", "quality")
    wanted = wanted.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    wanted = wanted.orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(limit)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [
                train_lines(read_lines(t.as_py() or "").features, d).tobytes()
                for t, d in zip(batch.column(3), batch.column(2).to_pylist(), strict=True)
            ]
            columns = [*batch.columns[:3], pa.array(found, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, names=["place", "quality", "digest", "features"])

    sample = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id")
    sample = sample.select(
        F.xxhash64("doc_id").alias("place"), "quality", F.xxhash64("text").alias("digest"), "text"
    )
    rows = sample.mapInArrow(features, "place long, quality int, digest long, features binary")
    rows = rows.orderBy("place", "quality", "digest").limit(limit)
    found = [(np.frombuffer(r.features).reshape(-1, N_FEATURES), r.quality) for r in rows.collect()]
    return fit_crf(sorted(found, key=lambda s: (s[1], s[0].tobytes())))


def judge(text: str, crf: Crf) -> tuple[int, int, int, int, int, bool, bool, float]:
    lines = read_lines(text)
    n_words = len(lines.words)
    word_chars = int(lines.sizes.sum())
    data = text.encode()
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    n_repeat = repeated_words(lines.words)
    failed = n_words < MIN_WORDS or 100 * n_repeat > MAX_REPEAT_PERCENT * n_words
    share = 0.0
    if n_words:
        labels = viterbi(lines.features @ crf.weights, crf.moves)
        share = float(lines.sizes @ labels) / word_chars
    kept = not failed and share >= MIN_CONTENT
    return n_words, word_chars, n_symbols, lines.n_dup, n_repeat, failed, kept, share


VERDICT = {
    "n_words": "long",
    "word_chars": "long",
    "n_symbols": "long",
    "n_dup_lines": "long",
    "n_repeat_words": "long",
    "base_failed": "boolean",
    "kept": "boolean",
    "content_share": "double",
}
KINDS = {
    "long": (T.LongType(), pa.int64()),
    "boolean": (T.BooleanType(), pa.bool_()),
    "double": (T.DoubleType(), pa.float64()),
}


def judge_documents(docs: DataFrame, crf: Crf) -> DataFrame:
    """Of each row: all its columns as a struct ``row``, and the struct ``verdict``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.column(0)
            found = [judge(text or "", crf) for text in rows.field("text").to_pylist()]
            each = list(zip(*found, strict=True)) if found else [[]] * len(VERDICT)
            kinds = [KINDS[k][1] for k in VERDICT.values()]
            parts = [pa.array(v, k) for v, k in zip(each, kinds, strict=True)]
            verdict = pa.StructArray.from_arrays(parts, names=list(VERDICT))
            yield pa.RecordBatch.from_arrays([rows, verdict], names=["row", "verdict"])

    verdict = T.StructType([T.StructField(n, KINDS[k][0]) for n, k in VERDICT.items()])
    schema = T.StructType([T.StructField("row", docs.schema), T.StructField("verdict", verdict)])
    return docs.select(as_row(docs)).mapInArrow(run, schema)


def keep_good(docs: DataFrame, crf: Crf) -> DataFrame:
    """The documents that are kept, with their own columns only."""
    judged = judge_documents(docs, crf).filter("verdict.kept")
    return judged.select(*from_row(judged, docs.columns))
