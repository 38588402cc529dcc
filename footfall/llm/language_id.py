"""Language identification by interpolated Kneser-Ney character models.

Texts are read as words between white space; letters become one of 127 symbols (a to z,
other letters by a hash), all else is a boundary.  Trigrams of symbols are counted over
all training rows, per language, in Spark; a trigram is a number below 2**21, so the
counts of a language, and the model made of them on the driver, have a fixed bound.
The model holds sorted arrays of trigram numbers with their log probabilities, and the
back-off tables for unseen ones.  A text goes to the language with the lowest cross
entropy per symbol.  A text whose cross entropy lies too far above what that language's
training text has, in standard errors, is marked as rejected.

Defined results: texts that are null or have no letter are ``und`` with score 0, as is
every text if nothing was learned; ties go to the language first by name; rows without
a language are not learned from; repeated rows count and are judged each; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SYMBOLS = 128
SIZE = SYMBOLS**3
UNKNOWN = "und"
#: Standard errors above the training text's cross entropy at which a text is rejected.
REJECT_AT = 8.0
#: Symbols of the stretch whose likelihood ratio gives the score.
STRETCH = 20
#: Characters of distinct words that a worker holds.
HELD_CHARS = 4 << 20


class Read(NamedTuple):
    keys: np.ndarray  # trigram numbers, last symbol predicted
    word: np.ndarray  # the word that each is in


def read_words(words: list[str]) -> Read:
    text = "\n".join(words) + "\n"
    points, where = np.unique(np.frombuffer(text.encode("utf-32-le"), np.uint32), return_inverse=True)
    table = np.zeros(len(points), np.int64)
    for i, point in enumerate(points.tolist()):
        if 97 <= point <= 122:
            table[i] = point - 96
        elif chr(point).isalpha():
            table[i] = 27 + point * 2654435761 % (1 << 32) % 101
    codes = table[where]
    ends = points[where] == 10
    word = np.cumsum(ends) - ends
    last = np.concatenate([[0], codes[:-1]])
    before = np.where(last > 0, np.concatenate([[0, 0], codes[:-2]])[: len(codes)], 0)
    used = (codes > 0) | (last > 0)
    keys = (before * SYMBOLS + last) * SYMBOLS + codes
    return Read(keys[used], word[used])


def count_trigrams(docs: DataFrame) -> DataFrame:
    """Counts by ``lang`` and ``key`` over all rows with a language."""

    def flush(lang: str, words: Counter) -> pa.RecordBatch:
        read = read_words(list(words))
        weights = np.fromiter(words.values(), np.int64, len(words))[read.word]
        keys, where = np.unique(read.keys, return_inverse=True)
        counts = np.bincount(where, weights=weights, minlength=len(keys)).astype(np.int64)
        columns = [pa.array([lang] * len(keys), pa.string()), pa.array(keys, pa.int64())]
        return pa.RecordBatch.from_arrays([*columns, pa.array(counts)], names=["lang", "key", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, Counter] = {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = held.setdefault(lang, Counter())
                words.update(text.as_py().lower().split())
                if len(words) > HELD_CHARS // 16:
                    yield flush(lang, held.pop(lang))
        for lang, words in held.items():
            if words:
                yield flush(lang, words)

    known = docs.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL")
    counted = known.mapInArrow(run, "lang string, key long, n long")
    return counted.groupBy("lang", "key").agg(F.sum("n").alias("n"))


class Model(NamedTuple):
    langs: list[str]
    keys: np.ndarray  # sorted trigram numbers seen in any language
    log_p: np.ndarray  # of each key, a column per language
    back_off: np.ndarray  # log weight of the shorter context, by its two symbols
    log_p2: np.ndarray  # log probability of the last symbol given the one before it
    mean: np.ndarray  # cross entropy of the training text
    spread: np.ndarray  # standard deviation of a symbol's


def _discount(counts: np.ndarray) -> float:
    once, twice = np.count_nonzero(counts == 1), np.count_nonzero(counts == 2)
    return once / (once + 2 * twice) if once and twice else 0.5


def _kneser_ney(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of one language: log p of its trigrams, back-off weights, log p of all bigrams."""
    context, pair = keys // SYMBOLS, keys % SYMBOLS**2
    # shorter orders count the different symbols that come before
    preceded = np.bincount(pair, minlength=SYMBOLS**2).reshape(SYMBOLS, SYMBOLS)
    ends = np.count_nonzero(preceded, axis=0)
    discount = _discount(ends)
    p1 = np.maximum(ends - discount, 0) / ends.sum()
    p1 += discount * np.count_nonzero(ends) / ends.sum() / SYMBOLS
    discount = _discount(preceded)
    total = preceded.sum(axis=1, keepdims=True)
    kinds = np.count_nonzero(preceded, axis=1)[:, None]
    with np.errstate(divide="ignore", invalid="ignore"):
        p2 = np.maximum(preceded - discount, 0) / total + discount * kinds / total * p1
    p2 = np.where(total > 0, p2, p1)
    discount = _discount(counts)
    total = np.bincount(context, weights=counts, minlength=SYMBOLS**2)
    kinds = np.bincount(context, minlength=SYMBOLS**2)
    weight = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
    p3 = np.maximum(counts - discount, 0) / total[context] + weight[context] * p2.ravel()[pair]
    return np.log(p3), np.log(weight), np.log(p2.ravel())


def build_model(lang: np.ndarray, key: np.ndarray, n: np.ndarray) -> Model:
    """From the counts as three columns of equal length."""
    langs = np.unique(lang).tolist()
    keys = np.unique(key)
    shape = (len(keys), len(langs))
    log_p, mean, spread = np.zeros(shape), np.zeros(len(langs)), np.zeros(len(langs))
    back_off, log_p2 = (np.zeros((SYMBOLS**2, len(langs))) for _ in range(2))
    for column, name in enumerate(langs):
        own = np.flatnonzero(lang == name)
        own = own[np.argsort(key[own])]
        own_keys, own_n = key[own], n[own]
        seen, back_off[:, column], log_p2[:, column] = _kneser_ney(own_keys, own_n)
        log_p[:, column] = (
            back_off[keys // SYMBOLS, column] + log_p2[keys % SYMBOLS**2, column]
        )
        log_p[np.searchsorted(keys, own_keys), column] = seen
        mean[column] = -np.average(seen, weights=own_n)
        spread[column] = np.sqrt(np.average((seen + mean[column]) ** 2, weights=own_n))
    return Model(langs, keys, log_p, back_off, log_p2, mean, spread)


def fit(docs: DataFrame) -> Model | None:
    """None if no row has a language and a letter."""
    rows = count_trigrams(docs).toArrow()
    if not rows.num_rows:
        return None
    lang = rows.column("lang").combine_chunks().dictionary_encode()
    names = np.array(lang.dictionary.to_pylist())[lang.indices.to_numpy()]
    return build_model(names, rows.column("key").to_numpy(), rows.column("n").to_numpy())


class Scorer:
    """Log probability sums of words, kept for the words met last."""

    def __init__(self, model: Model):
        self.model = model
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.new: list[str] = []
        self.chars = 0
        self.sums = np.zeros((0, len(self.model.langs) + 1))

    def numbers(self, text: str) -> np.ndarray:
        number, new = self.number, self.new
        words = text.lower().split()
        for word in words:
            if word not in number:
                number[word] = len(number)
                new.append(word)
                self.chars += len(word)
        return np.fromiter(map(number.__getitem__, words), np.int64, len(words))

    def learn(self) -> None:
        """Sums of the new words: a column per language, and the number of symbols."""
        if not self.new:
            return
        model, read = self.model, read_words(self.new)
        at = np.searchsorted(model.keys, read.keys)
        at[at == len(model.keys)] = 0
        seen = (model.keys[at] == read.keys)[:, None]
        unseen = model.back_off[read.keys // SYMBOLS] + model.log_p2[read.keys % SYMBOLS**2]
        log_p = np.where(seen, model.log_p[at], unseen)
        n = len(self.new)
        sums = [np.bincount(read.word, weights=column, minlength=n) for column in log_p.T]
        sums.append(np.bincount(read.word, minlength=n))
        self.sums = np.concatenate([self.sums, np.stack(sums, axis=1)])
        self.new = []

    def judge(self, texts: list[str]) -> list[tuple[str, float, bool]]:
        model, numbers = self.model, [self.numbers(text) for text in texts]
        self.learn()
        totals = np.array([self.sums[own].sum(axis=0) for own in numbers]).reshape(len(texts), -1)
        if self.chars > HELD_CHARS:
            self.reset()
        length = np.maximum(totals[:, -1:], 1)
        cross = -totals[:, :-1] / length
        best = np.argmin(cross, axis=1)
        least = cross[np.arange(len(texts)), best]
        score = 1 / np.exp(-STRETCH * (cross - least[:, None])).sum(axis=1)
        limit = model.mean[best] + REJECT_AT * model.spread[best] / np.sqrt(length[:, 0])
        return [
            (model.langs[b], s, r) if n else (UNKNOWN, 0.0, True)
            for b, s, r, n in zip(
                best.tolist(), score.tolist(), (least > limit).tolist(), totals[:, -1], strict=True
            )
        ]


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows' columns but ``text``, with lang_pred, score and rejected."""
    others = [c for c in docs.columns if c != "text"]
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(sent.value) if sent.value else None
        for batch in batches:
            for start in range(0, batch.num_rows, 512):
                part = batch.slice(start, 512)
                texts = [text or "" for text in part.column(len(others)).to_pylist()]
                found = scorer.judge(texts) if scorer else [(UNKNOWN, 0.0, True)] * len(texts)
                lang, score, rejected = zip(*found, strict=True)
                columns = [*part.columns[:-1], pa.array(lang), pa.array(score), pa.array(rejected)]
                names = [*others, "lang_pred", "score", "rejected"]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    schema = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in others]
    schema += ["lang_pred string", "score double", "rejected boolean"]
    return docs.select(*others, "text").mapInArrow(run, ", ".join(schema))
