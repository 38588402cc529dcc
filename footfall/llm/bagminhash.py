"""Near-duplicates by BagMinHash signatures, banding and exact verification.

A text is a bag of runs of five words; a run's weight is how often it occurs.  For the
weighted Jaccard similarity every run has a Poisson process over weight and time.  The
weights are cut at powers of two, so a run has one process per level up to its own
weight, with a rate equal to the level's width; a point counts if its mark in the level
is not above the run's weight.  Every point falls on one register, which keeps the
earliest.  Points are made level by level in order of time, and a process stops once it
is later than all registers of its text.  Registers of two texts are equal with the
probability of their weighted Jaccard similarity.

Texts that share a band of registers are candidates; equal texts are one node.  A pair is
settled once it is known to be connected, verified by the exact overlap of its bags, or
ruled out.  In a first round every text is paired with its bands' first and last text.
Bands whose members are then still of several components go on to a second one, in which
all pairs of their members are compared by registers (a byte of each is kept), part of a
band by part, and those of different components that agree often enough by their bags.  The
components of the verified links are the groups.  No pair that shares a band is left out,
and no step makes a row for each pair of a band; comparing them takes time with the square
of the number of members of a band that the first round leaves in several components.

Defined results: texts with no word (null ones too) are never near-duplicates; those
with one to four words have that one run; repeated rows are equal texts; texts of equal
id are told apart by content; other columns are ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

import re
from collections import Counter, OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from footfall.llm.rolling import BASE, U, mixed
from footfall.llm.tables import columns_of, free_name, stage

WORDS, THRESHOLD = 5, 0.8
REGISTERS = 128
#: 25 bands of 5 find a pair at similarity 0.8 with probability 0.99995.
BANDS, BAND_ROWS = 25, 5
BATCH_BYTES = 4 << 20
#: Registers of 128 that agree at least; at similarity 0.8 fewer do with probability 2e-5.
LEAST_EQUAL = 84
#: Nodes and words of a band's part, about: a row holds two parts.
CHUNK, CHUNK_WORDS = 1024, 200_000

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


class _WordHashes(dict):
    """64-bit hashes of words; those of short words are remembered."""

    def __missing__(self, word: bytes) -> int:
        found = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 32 and len(self) < 1 << 18:
            self[word] = found
        return found


_HASHES = _WordHashes()


def bags(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and weight of every different run, by text and hash."""
    words = [list(map(_HASHES.__getitem__, WORD.findall(t))) for t in texts]
    n_words = np.array([len(w) for w in words], np.int64)
    word = np.fromiter((h for w in words for h in w), np.uint64, int(n_words.sum()))
    owner = np.repeat(np.arange(len(texts)), n_words)
    length = np.minimum(n_words, WORDS)[owner]
    position = np.arange(len(word)) - (np.cumsum(n_words) - n_words)[owner]
    first = np.flatnonzero(position + length <= n_words[owner])
    size = length[first]
    run = np.zeros(len(first), np.uint64)
    for i in range(WORDS):
        there = i < size
        run[there] = mixed(run[there] + word[first[there] + i] + U(i + 1))
    owner = owner[first]
    order = np.lexsort((run, owner))
    run, owner = run[order], owner[order]
    new = np.ones(len(run), bool)
    new[1:] = (run[1:] != run[:-1]) | (owner[1:] != owner[:-1])
    at = np.flatnonzero(new)
    return owner[at], run[at], np.diff(np.append(at, len(run)))


def signatures(n: int, owner: np.ndarray, run: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """The registers of n texts: the names of their earliest points."""
    levels = np.ceil(np.log2(weight)).astype(np.int64)  # weight w reaches level ceil(log2 w)
    part = np.repeat(np.arange(len(run)), levels + 1)
    level = np.arange(len(part)) - np.repeat(np.cumsum(levels + 1) - levels - 1, levels + 1)
    low = np.where(level > 0, 1 << np.maximum(level - 1, 0), 0)
    width = np.where(level > 0, low, 1)
    doc, top = owner[part], weight[part]
    seed = mixed(run[part] + U(BASE) * level.astype(np.uint64))
    time = np.zeros(len(part))
    earliest = np.full(n * REGISTERS, np.inf)
    names = np.zeros(n * REGISTERS, np.uint64)
    step = 0
    while len(doc):
        step += 1
        draw = mixed(seed + U(step * BASE & (2**64 - 1)))
        time = time - np.log(((draw >> U(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        name = mixed(draw ^ U(BASE))
        mark = low + 1 + (name >> U(32)).astype(np.int64) % width
        slot = doc * REGISTERS + (name % U(REGISTERS)).astype(np.int64)
        counts = np.flatnonzero((mark <= top) & (time < earliest[slot]))
        own = slot[counts]
        np.minimum.at(earliest, own, time[counts])
        won = earliest[own] == time[counts]
        names[own[won]] = name[counts[won]]
        latest = earliest.reshape(n, REGISTERS).max(axis=1)
        on = np.flatnonzero(time < latest[doc])
        doc, top, low, width = doc[on], top[on], low[on], width[on]
        seed, time = seed[on], time[on]
    return names.reshape(n, REGISTERS)


def band_keys(names: np.ndarray) -> np.ndarray:
    """A number for each band of each text."""
    used = names[:, : BANDS * BAND_ROWS].reshape(len(names), BANDS, BAND_ROWS)
    keys = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), used.shape[:2])
    for i in range(BAND_ROWS):
        keys = mixed(keys * U(BASE) + used[:, :, i])
    return keys.view(np.int64)


def bag_of(text: bytes) -> Counter:
    """The runs of a text themselves, and how often each occurs."""
    words = WORD.findall(text)
    if len(words) <= WORDS:
        return Counter([tuple(words)] if words else [])
    return Counter(zip(*(words[i:] for i in range(WORDS)), strict=False))


def overlap(a: Counter, b: Counter) -> float:
    """Weighted Jaccard similarity of two bags, exact: no hash takes part."""
    if len(a) > len(b):
        a, b = b, a
    both = sum(min(n, b[run]) for run, n in a.items() if run in b)
    return both / (a.total() + b.total() - both)


def _sub_batches(texts: pa.Array) -> Iterator[tuple[int, int]]:
    start, size = 0, 0
    for at, text in enumerate(texts, 1):
        size += text.as_buffer().size if text.is_valid else 0
        if size >= BATCH_BYTES or at == len(texts):
            yield start, at
            start, size = at, 0


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start, end in _sub_batches(batch.column(3)):
            part = batch.slice(start, end - start)
            texts = [t.encode() if t else b"" for t in part.column(3).to_pylist()]
            owner, run, weight = bags(texts)
            names = signatures(len(texts), owner, run, weight)
            keys = band_keys(names)
            total = np.bincount(owner, weight, minlength=len(texts)).astype(np.int64)
            has_words = total > 0
            sketches = (names & U(255)).astype(np.uint8)
            flat = pa.array(keys[has_words].ravel())
            offsets = pa.array(np.append(0, np.cumsum(has_words * BANDS)).astype(np.int32))
            lists = pa.ListArray.from_arrays(offsets, flat)
            columns = [*part.columns[:3], lists, pa.array(total)]
            columns.append(pa.array([sketch.tobytes() for sketch in sketches], pa.binary()))
            yield pa.RecordBatch.from_arrays(
                columns, names=["doc_id", "d1", "d2", "bands", "total", "sketch"]
            )


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: OrderedDict[int, Counter] = OrderedDict()

    def bag(node: int, text: str) -> Counter:
        found = held.get(node)
        if found is None:
            found = held[node] = bag_of(text.encode())
            if len(held) > 64:
                held.popitem(last=False)
        return found

    for batch in batches:
        similar = [
            overlap(bag(a, s), bag(b, t))
            for a, b, s, t in zip(*(c.to_pylist() for c in batch.columns), strict=True)
        ]
        columns = [batch.column(0), batch.column(1), pa.array(similar, pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["a", "b", "similarity"])


def _digested(docs: DataFrame) -> DataFrame:
    """Two hashes that name the content of a text."""
    return docs.select(
        "doc_id", F.xxhash64("text").alias("d1"), F.xxhash64("text", F.lit(1)).alias("d2"), "text"
    )


def sign(docs: DataFrame) -> DataFrame:
    """Bands of every row, written once; no bands for texts without words."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    signed = _digested(docs).mapInArrow(
        _signed, f"doc_id {kind}, d1 long, d2 long, bands array<long>, total long, sketch binary"
    )
    return stage(signed, "bags_signed")


def band_ends(nodes: DataFrame) -> DataFrame:
    """First and last node and number of nodes of each band of several, written once."""
    each = nodes.select("node", F.explode("bands").alias("band"))
    ends = each.groupBy("band").agg(
        F.min("node").alias("first"), F.max("node").alias("last"), F.count("*").alias("n_nodes")
    )
    return stage(ends.filter(F.col("first") < F.col("last")), "bag_bands")


def candidate_pairs(nodes: DataFrame, ends: DataFrame) -> DataFrame:
    """Every node (``node``, ``bands``) with the first and last node of each of its bands."""
    each = nodes.select("node", F.explode("bands").alias("band"))
    met = each.join(ends, "band").select(
        "node", F.explode(F.array("first", "last")).alias("other")
    )
    pair = met.filter(F.col("node") != F.col("other")).select(
        F.greatest("node", "other").alias("a"), F.least("node", "other").alias("b")
    )
    return stage(pair.distinct(), "bag_pairs")


def unsettled(nodes: DataFrame, ends: DataFrame, labels: DataFrame) -> DataFrame:
    """The nodes of bands in which some are not connected: band, parts, node, label.

    All pairs with an end are settled, so ends are left out, and a band of three nodes is.
    A band is to be cut into ``parts``, of bounded numbers of nodes and of words.
    """
    each = nodes.select("node", "total", F.explode("bands").alias("band"))
    inner = each.join(ends.filter(F.col("n_nodes") > 3), "band").filter(
        (F.col("node") != F.col("first")) & (F.col("node") != F.col("last"))
    )
    inner = stage(inner.join(labels, "node").select("band", "node", "label", "total"), "bag_inner")
    size = F.greatest(F.count(F.lit(1)) / CHUNK, F.sum("total") / CHUNK_WORDS)
    several = inner.groupBy("band").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.ceil(size).alias("parts")
    )
    several = several.filter(F.col("low") < F.col("high")).select("band", "parts")
    return inner.join(several, "band").select("band", "parts", "node", "label")


def _members(part: pa.Array) -> tuple[np.ndarray, ...]:
    numbers = [part.field(c).to_numpy(zero_copy_only=False) for c in ("node", "label", "total")]
    sketch = np.frombuffer(b"".join(part.field("sketch").to_pylist()), np.uint8)
    bands = part.field("bands").flatten().to_numpy(zero_copy_only=False)
    return *numbers, sketch.reshape(-1, REGISTERS), bands.reshape(-1, BANDS)


def _agreeing(
    a: tuple, b: tuple, band: int, same: bool, threshold: float
) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs whose registers agree often enough, those that agree most first.

    Only those of different labels, of weights whose ratio allows the similarity, and that
    share no band before this one: there they are compared, or settled.
    """
    low, high = np.minimum.outer(a[2], b[2]), np.maximum.outer(a[2], b[2])
    fits = (a[1][:, None] != b[1]) & (low >= threshold * high)
    left, right = np.nonzero(np.triu(fits) if same else fits)
    found = []
    for at in range(0, len(left), 1 << 15):
        x, y = left[at : at + (1 << 15)], right[at : at + (1 << 15)]
        agree = np.count_nonzero(a[3][x] == b[3][y], axis=1)
        near = np.flatnonzero(agree >= LEAST_EQUAL)
        x, y, agree = x[near], y[near], agree[near]
        shared = (a[4][x] == b[4][y]).argmax(axis=1)
        here = a[4][x, shared] == band
        found.append((x[here], y[here], agree[here]))
    if not found:
        return left, right
    x, y, agree = (np.concatenate(c) for c in zip(*found, strict=True))
    order = np.argsort(-agree, kind="stable")
    return x[order], y[order]


def _shared_runs(sides: list[pa.Array], wanted: list[np.ndarray]) -> list[tuple[dict, np.ndarray]]:
    """Of the wanted texts of each side, the runs that others of them have, and their weight.

    Runs, themselves and not their hashes, are numbered; no other run takes part in an
    overlap of two of these texts.
    """
    numbers: dict[tuple, int] = {}
    bags = [{at: bag_of(side.field("text")[at].as_py().encode()) for at in places.tolist()}
            for side, places in zip(sides, wanted, strict=True)]
    holders = Counter(run for side in bags for bag in side.values() for run in bag)
    out = []
    for side, members in zip(bags, sides, strict=True):
        kept, weight = {}, np.zeros(len(members), np.int64)
        for at, bag in side.items():
            kept[at] = {numbers.setdefault(r, len(numbers)): n for r, n in bag.items() if holders[r] > 1}
            weight[at] = sum(kept[at].values())
        out.append((kept, weight))
    return out


def _linking(threshold: float):
    """Links among the members of two parts of a band, or of one, that connect their labels."""

    def of(band: int, same: bool, sides: list[pa.Array]) -> list[tuple[int, int]]:
        members, root, links = [_members(s) for s in sides], {}, []
        a, b = members[0], members[-1]
        x, y = _agreeing(a, b, band, same, threshold)
        wanted = [np.unique(np.append(x, y))] if same else [np.unique(x), np.unique(y)]
        runs = _shared_runs(sides, wanted)
        (bags_a, shared_a), (bags_b, shared_b) = runs[0], runs[-1]
        both = a[2][x] + b[2][y]
        most = np.minimum(shared_a[x], shared_b[y])
        near = most >= threshold * (both - most)
        x, y, both = x[near].tolist(), y[near].tolist(), both[near].tolist()

        def label(found: int) -> int:
            while found in root:
                found = root[found]
            return found

        for i, k, total in zip(x, y, both, strict=True):
            one, other = label(int(a[1][i])), label(int(b[1][k]))
            if one != other:
                less, more = sorted((bags_a[i], bags_b[k]), key=len)
                common = sum(min(n, more[r]) for r, n in less.items() if r in more)
                if common / (total - common) >= threshold:
                    root[max(one, other)] = min(one, other)
                    links.append((int(a[0][i]), int(b[0][k])))
        return links

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            numbers = zip(batch.column("band").to_pylist(), batch.column("same").to_pylist(), strict=True)
            for (band, same), sides in zip(numbers, batch.column("sides"), strict=True):
                found = [side.values for side in sides.values]
                if same or len(found) == 2:
                    links = np.array(of(band, same, found), np.int64).reshape(-1, 2)
                    columns = [pa.array(links.max(axis=1)), pa.array(links.min(axis=1))]
                    yield pa.RecordBatch.from_arrays(columns, names=["a", "b"])

    return run


def second_links(left: DataFrame, nodes: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Links that connect what is similar among the nodes of the bands in ``left``.

    A band's nodes are cut into parts by hash, and every two parts of a band, and each with
    itself, meet in one row: as many rows as pairs of parts, of bounded size each, and a
    band of any size is spread.  Each pair that shares a band is compared by registers once;
    if they agree, and it is not connected yet in its row, by the exact overlap.
    """
    part = F.pmod(F.xxhash64("node", "band"), F.col("parts"))
    member = F.struct("node", "label", "total", "sketch", "bands", "text")
    cut = left.join(nodes.select("node", "total", "sketch", "bands"), "node").join(texts, "node")
    cut = cut.groupBy("band", "parts", part.alias("part")).agg(
        F.collect_list(member).alias("side"), F.min("label").alias("low"), F.max("label").alias("high")
    )
    met = cut.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    first, second = F.least("part", "other"), F.greatest("part", "other")
    met = met.groupBy("band", first.alias("first"), second.alias("second")).agg(
        F.collect_list("side").alias("sides"), F.min("low").alias("low"), F.max("high").alias("high")
    )
    met = met.filter(F.col("low") < F.col("high"))
    # small rows may be long work: they are not put together by their bytes
    n = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    met = met.repartition(n, "band", "first", "second")
    met = met.select("band", (F.col("first") == F.col("second")).alias("same"), "sides")
    return met.mapInArrow(_linking(threshold), "a long, b long")


def verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (``a``, ``b``) whose bags overlap enough."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(left, "a").join(right, "b").select("a", "b", "text_a", "text_b")
    found = both.mapInArrow(_verified, "a long, b long, similarity double")
    return found.filter(F.col("similarity") >= threshold).select("a", "b")


def components(links: DataFrame) -> DataFrame:
    """The smallest node of each linked node's component: node, label."""
    both = stage(
        links.select("a", "b").union(links.select("b", "a")).toDF("node", "other"), "bag_links"
    )
    labels = stage(
        both.groupBy("node").agg(F.min("other").alias("other")).select(
            "node", F.least("node", "other").alias("label")
        ),
        "bag_labels",
    )
    while True:
        of_other = labels.select(F.col("node").alias("other"), F.col("label").alias("theirs"))
        near = both.join(of_other, "other").groupBy("node").agg(F.min("theirs").alias("near"))
        step = labels.join(near, "node").select(
            "node", "label", F.least("label", "near").alias("lower")
        )
        # the label's own label is at least as small, and as well in the component
        of_label = labels.select(F.col("node").alias("lower"), F.col("label").alias("lowest"))
        new = stage(
            step.join(of_label, "lower").select(
                "node", F.col("lowest").alias("label"), (F.col("lowest") < F.col("label")).alias("moved")
            ),
            "bag_labels",
        )
        if new.filter("moved").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def _nodes(signed: DataFrame) -> DataFrame:
    """One row per different text with words: node, d1, d2, doc_id, bands, written once."""
    worded = signed.filter(F.size("bands") > 0)
    firsts = worded.groupBy("d1", "d2").agg(F.min("doc_id").alias("doc_id"))
    firsts = stage(firsts.withColumn("node", F.monotonically_increasing_id()), "bag_nodes")
    # of equal rows one is enough; bands only depend on the text
    same = [worded[c].eqNullSafe(firsts[c]) for c in ("doc_id", "d1", "d2")]
    rows = worded.join(firsts, same[0] & same[1] & same[2]).select(firsts["*"], *[worded[c] for c in ("bands", "total", "sketch")])
    return stage(rows.dropDuplicates(["node"]), "bag_node_bands")


def connected(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The labels (node, label) of all nodes after further links: one for each two labels."""
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        links = links.join(own, side)
    low, high = F.least("label_a", "label_b"), F.greatest("label_a", "label_b")
    between = links.filter("label_a != label_b").select(low.alias("a"), high.alias("b")).distinct()
    between = stage(between, "bag_label_links")
    if between.isEmpty():
        return labels
    lowest = components(between).select(F.col("node").alias("label"), F.col("label").alias("lowest"))
    moved = labels.join(lowest, "label", "left")
    return stage(moved.select("node", F.coalesce("lowest", "label").alias("label")), "bag_labels_all")


def linked(pairs: DataFrame, texts: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """The labels after all pairs: those that are not connected yet are verified.

    First a single pair of each node; what that connects needs no more pairs.
    """
    first = pairs.groupBy("a").agg(F.min("b").alias("b"))
    labels = connected(labels, stage(verify(first, texts, threshold), "bag_links_first"))
    rest = pairs.join(first, ["a", "b"], "left_anti")
    for side in ("a", "b"):
        own = labels.select(F.col("node").alias(side), F.col("label").alias(f"label_{side}"))
        rest = rest.join(own, side)
    rest = rest.filter("label_a != label_b").select("a", "b")
    return connected(labels, stage(verify(rest, texts, threshold), "bag_links_rest"))


def near_labels(docs: DataFrame, nodes: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The label of every node (node, label): equal for nodes that are connected."""
    ends = band_ends(nodes)
    pairs = candidate_pairs(nodes, ends)
    each = nodes.select("node", F.explode("bands").alias("band"))
    wanted = each.join(ends.select("band"), "band").select("node").distinct()
    keys = nodes.select("node", "doc_id", "d1", "d2").join(wanted, "node")
    rows = _digested(docs)
    same = [rows[c].eqNullSafe(keys[c]) for c in ("doc_id", "d1", "d2")]
    texts = rows.join(keys, same[0] & same[1] & same[2]).select("node", "text")
    texts = stage(texts.dropDuplicates(["node"]), "bag_texts")
    labels = linked(pairs, texts, nodes.select("node", F.col("node").alias("label")), threshold)
    left = unsettled(nodes, ends, labels)
    return connected(labels, stage(second_links(left, nodes, texts, threshold), "bag_links_second"))


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per input row: doc_id, class_id, copy_of.

    ``class_id`` is the smallest id of the document's group, ``copy_of`` the smallest id
    of an equal text.
    """
    docs = docs.select("doc_id", "text")
    signed = sign(docs)
    nodes = _nodes(signed)
    labels = near_labels(docs, nodes, threshold)
    known = nodes.select("node", "d1", "d2", "doc_id").join(labels, "node")
    lowest = known.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    members = stage(
        known.join(lowest, "label").select("d1", "d2", "class_id", F.col("doc_id").alias("copy_of")),
        "bag_members",
    )
    rows = signed.select("doc_id", "d1", "d2", (F.size("bands") > 0).alias("worded"))
    placed = rows.join(members, ["d1", "d2"], "left")
    own = lambda c: F.when(F.col("worded"), F.col(c)).otherwise(F.col("doc_id"))
    return placed.select("doc_id", own("class_id").alias("class_id"), own("copy_of").alias("copy_of"))


def one_of_each(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents without all but the one of smallest id of every group."""
    name = free_name(docs, "_row")
    numbered = stage(docs.withColumn(name, F.monotonically_increasing_id()), "bag_documents")
    groups = near_duplicates(numbered.select(F.col(name).alias("doc_id"), "text"), threshold)
    rows = numbered.select(F.col(name).alias("row"), F.col("doc_id").alias("id"))
    named = groups.join(rows, groups["doc_id"] == rows["row"])
    first = named.groupBy("class_id").agg(F.min(F.struct("id", "row")).alias("first"))
    kept = first.select(F.col("first.row").alias(name))
    return numbered.join(kept, name).select(*columns_of(docs))
