"""Periodic runs of words by string synchronising sets.

A run is a stretch of consecutive words with a smallest period q (words q apart are the
same) that no neighbouring word extends, at least 24 words and three periods long.

Periods below 8 come from shifted comparisons: they are the highly periodic regions.  For
each dyadic scale s = 4, 8, 16, ... a synchronising set is taken: place i belongs to it if
the smallest hash of the windows of s words at i to i + s, windows with a period of at
most s/3 left out, is that at i or that at i + s.  Whether i belongs depends on its
context, the 2s words from i, alone, so equal contexts are chosen alike; and s places in a
row without a member lie in a region with a period of at most s/3.  So a run with a period
q from 2s to below 4s has a member within its first q + 1 places, and the member's context
comes again q words later.  Equal contexts from 2s to 4s apart propose their distance as a
period; two of them are more than s/3 apart, so a place has a few such partners at most.
Every proposal is compared word by word and extended both ways, so no result rests on
hashes.

Texts are handled some hundred thousand words at a time; memory follows these or the
longest text, whichever is more.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Least length of a run in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: The first scale; twice it is the first period found by contexts.
FIRST = 4
#: Words handled at a time.
BATCH_WORDS = 1 << 19
HIGHEST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A 64-bit number for each pair of numbers; not linear in either."""
    out = left * np.uint64(0x9E3779B97F4A7C15) + (right ^ (right >> np.uint64(29))) * np.uint64(
        0xBF58476D1CE4E5B9
    )
    out ^= out >> np.uint64(32)
    out *= np.uint64(0x94D049BB133111EB)
    out ^= out >> np.uint64(29)
    return out


def window_min(values: np.ndarray, width: int) -> np.ndarray:
    """Smallest of each ``width`` values in a row; ``width`` is a power of two."""
    size = 1
    while size < width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return values


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last + 1 places of the maximal stretches of True."""
    places = np.flatnonzero(equal)
    if not len(places):
        return places, places
    breaks = np.flatnonzero(np.diff(places) > 1)
    return places[np.r_[0, breaks + 1]], places[np.r_[breaks, len(places) - 1]] + 1


def short_periods(words: np.ndarray) -> np.ndarray:
    """(start, end, period) of regions with a period below 8, of 4 words and 3 periods or more."""
    found = [np.zeros((0, 3), np.int64)]
    for q in range(1, min(2 * FIRST, len(words))):
        first, last = stretches(words[:-q] == words[q:])
        long = last - first + q >= max(FIRST, LEAST_PERIODS * q)
        first, last = first[long], last[long]
        found.append(np.stack([first, last + q, np.full(len(first), q)], axis=1))
    return smallest(np.concatenate(found))


def smallest(runs: np.ndarray) -> np.ndarray:
    """Each (start, end) with its smallest period.

    A run's period divides every other period of it that fits three times, and the
    stretch found for such a multiple is the run itself.
    """
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    new = np.ones(len(runs), bool)
    new[1:] = (np.diff(runs[:, 0]) != 0) | (np.diff(runs[:, 1]) != 0)
    return runs[new]


def inside_periodic(regions: np.ndarray, scale: int, size: int) -> np.ndarray | None:
    """True at windows of ``scale`` words that have a period of at most a third of it."""
    start, end, period = regions.T
    fits = (period <= scale // 3) & (end - start >= scale)
    if not fits.any():
        return None
    steps = np.zeros(size + 1, np.int32)
    np.add.at(steps, start[fits], 1)
    np.add.at(steps, end[fits] - scale + 1, -1)
    return np.cumsum(steps[:-1]) > 0


def synchronising(hashes: np.ndarray, periodic: np.ndarray | None, scale: int) -> np.ndarray:
    """True at the members of the synchronising set, for places with a whole context."""
    ids = hashes
    if periodic is not None:
        ids = np.where(periodic[: len(hashes)], HIGHEST, hashes)
    least = np.minimum(window_min(ids, scale)[:-1], ids[scale:])
    return (least != HIGHEST) & ((least == ids[: len(least)]) | (least == ids[scale:]))


def proposals(places: np.ndarray, contexts: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """First places and distances of equal contexts from 2 to below 4 scales apart."""
    order = np.argsort(contexts, kind="stable")
    places, contexts = places[order], contexts[order]
    first, apart, step = [places[:0]], [places[:0]], 1
    while step < len(places):
        distance = places[step:] - places[:-step]
        near = (contexts[step:] == contexts[:-step]) & (distance < 4 * scale)
        if not near.any():
            break
        near &= distance >= 2 * scale
        first.append(places[:-step][near])
        apart.append(distance[near])
        step += 1
    return np.concatenate(first), np.concatenate(apart)


def _matching(words: np.ndarray, at: int, distance: int, way: int) -> int:
    """How many words from ``at`` on, going ``way``, equal those ``distance`` further on."""
    done, step = 0, 64
    while True:
        if way > 0:
            low, high = at + done, min(at + done + step, len(words) - distance)
        else:
            low, high = max(at - done - step + 1, 0), at - done + 1
        if high <= low:
            return done
        differ = words[low:high] != words[low + distance : high + distance]
        if way < 0:
            differ = differ[::-1]
        first = int(differ.argmax())
        if differ[first]:
            return done + first
        done, step = done + high - low, 2 * step


def extended(words: np.ndarray, first: np.ndarray, apart: np.ndarray, scale: int) -> np.ndarray:
    """The maximal stretches with the proposed periods, found by comparing words."""
    order = np.lexsort((first, apart))
    first, apart = first[order], apart[order]
    # proposals of one period whose contexts touch lie in one stretch
    new = np.ones(len(first), bool)
    new[1:] = (np.diff(apart) != 0) | (np.diff(first) > 2 * scale)
    out, period, end = [], 0, 0
    for at, q in zip(first[new].tolist(), apart[new].tolist()):
        if q == period and at < end:
            continue
        ahead = _matching(words, at, q, 1)
        if not ahead:
            continue
        begin = at - _matching(words, at - 1, q, -1)
        period, end = q, at + ahead
        if end - begin + q >= max(LEAST_WORDS, LEAST_PERIODS * q):
            out.append((begin, end + q, q))
    return np.array(out, np.int64).reshape(-1, 3)


def find_runs(words: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """(start, end, period) of all runs of texts that lie in a row, by start, then period.

    ``words`` has a number for each word and, after each text of ``sizes`` words, one that
    occurs nowhere else; so no run leaves its text.
    """
    regions = short_periods(words)
    runs = regions[regions[:, 1] - regions[:, 0] >= LEAST_WORDS]
    ends = np.cumsum(sizes + 1) - 1
    left = np.repeat(ends, sizes + 1) - np.arange(len(words))
    whole = np.repeat(sizes, sizes + 1)
    places = np.arange(len(words))
    hashes = mixed(words.astype(np.uint64), np.full(len(words), 7, np.uint64))
    width, scale = 1, FIRST
    while True:
        # a period of two scales, three times
        keep = whole >= max(LEAST_WORDS, 2 * LEAST_PERIODS * scale)
        if not keep.any():
            return runs[np.lexsort((runs[:, 2], runs[:, 0]))]
        if not keep.all():
            keep = keep[: len(hashes)]
            hashes, places = hashes[keep], places[: len(keep)][keep]
            left, whole = left[: len(keep)][keep], whole[: len(keep)][keep]
        while width < scale:
            hashes, width = mixed(hashes[:-width], hashes[width:]), 2 * width
        periodic = inside_periodic(regions, scale, len(words))
        if periodic is not None:
            periodic = periodic[places[: len(hashes)]]
        wider = mixed(hashes[:-scale], hashes[scale:])
        chosen = synchronising(hashes, periodic, scale)
        size = min(len(chosen), len(wider))
        chosen = np.flatnonzero(chosen[:size] & (left[:size] >= 2 * scale))
        first, apart = proposals(places[chosen], wider[chosen], scale)
        more = extended(words, first, apart, scale)
        runs = smallest(np.concatenate([runs, more]))
        regions = smallest(np.concatenate([regions, more]))
        hashes, width, scale = wider, 2 * scale, 2 * scale


def _of_texts(texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs, the texts' starts among all words, and which words stay."""
    sizes = np.array([len(t) for t in texts], np.int64)
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, int(sizes.sum()))
    starts = np.cumsum(sizes + 1) - sizes - 1
    words = np.empty(len(ids) + len(texts), np.int64)
    inner = np.ones(len(words), bool)
    inner[starts + sizes] = False
    words[inner] = ids
    words[~inner] = len(number) + np.arange(len(texts))
    runs = find_runs(words, sizes)
    steps = np.zeros(len(words) + 1, np.int32)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 1], -1)
    return runs, starts, np.cumsum(steps[:-1]) == 0


def _batch(keys: pa.Array, texts: list[list[str]], names: list[str]) -> pa.RecordBatch:
    runs, starts, stays = _of_texts(texts)
    begin = np.searchsorted(runs[:, 0], np.r_[starts, len(stays)])
    text_of = np.searchsorted(starts, runs[:, 0], "right") - 1
    columns = [runs[:, 0] - starts[text_of], runs[:, 1] - runs[:, 0], runs[:, 2]]
    fields = ["start", "length", "period"]
    rows = pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], fields)
    found = pa.ListArray.from_arrays(pa.array(begin, pa.int32()), rows)
    for i in np.flatnonzero(np.diff(begin)).tolist():
        keep = stays[starts[i] : starts[i] + len(texts[i])]
        texts[i] = [w for w, k in zip(texts[i], keep.tolist()) if k]
    sizes = np.diff(np.r_[starts, len(stays)]) - 1
    kept = pa.array([" ".join(t) for t in texts], pa.string())
    return pa.RecordBatch.from_arrays([keys, pa.array(sizes, pa.int64()), found, kept], names)


def collapse_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, ``n_words``, ``runs`` and ``collapsed``.

    ``runs`` are structs of start (word number), length and period, by start, then period.
    ``collapsed`` has the text's words joined by one space, without those that lie in a run
    after its first period.  A null text counts as empty: no words, no runs, ''.  Ids may be
    null or repeated; each row is handled for itself.
    """
    key = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            start, size, texts = 0, 0, []
            for at, text in enumerate(batch.column(1), 1):
                texts.append(WORD.findall(text.as_py() or ""))
                size += len(texts[-1])
                if size >= BATCH_WORDS or at == batch.num_rows:
                    yield _batch(batch.column(0).slice(start, at - start), texts, names)
                    start, size, texts = at, 0, []

    schema = (
        f"`{id_col}` {key}, n_words long, "
        "runs array<struct<start: long, length: long, period: long>>, collapsed string"
    )
    return docs.select(id_col, text_col).mapInArrow(run, schema)
