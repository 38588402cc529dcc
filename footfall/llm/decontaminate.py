"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds test items of which at least ``THRESHOLD`` of the distinct word shingles are in a
document, however long that is.  Items are partitioned by their number of shingles, in
powers of two.  Of each item, the shingles with the smallest hashes are its probes: as
many as make sure, for the largest size of the partition, that a document with enough
of the item's shingles has at least one of them.  So no document is missed.

The texts are read once: what is kept of a document are the hashes that occur in the
benchmark at all.  Probes alone propose pairs of document and item; only proposed pairs
are verified, each by one row per shingle of the item, looked up among the document's.
A list of the items' hashes is broadcast only if its counted rows are few enough, else
both sides are shuffled.

Words are lower-cased.  Defined results: null and empty texts, and those with fewer than
five words, have no shingles and match nothing; repeated rows of an item or a document
count once (a document is what has one ``doc_id``); other columns are ignored; empty
tables give an empty result.  Only built-in functions run on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.tables import columns_of, free_name, stage

WORDS, THRESHOLD = 5, 0.8
#: Rows of the items' side up to which it is broadcast (16 bytes each and overhead).
BROADCAST_ROWS = 200_000


def shingles(text: Column) -> Column:
    """Hashes of the distinct runs of five words."""
    found = F.array_remove(F.split(F.lower(text), r"[ \t-\r]+"), "")

    def hashed(words: Column) -> Column:
        runs = F.transform(
            F.sequence(F.lit(0), F.size(words) - WORDS),
            lambda i: F.xxhash64(*(F.get(words, i + k) for k in range(WORDS))),
        )
        return F.array_distinct(runs)

    # bound once as a lambda variable, so the words are not split again for each use
    made = F.transform(
        F.array(found),
        lambda words: F.when(F.size(words) >= WORDS, hashed(words)).otherwise(
            F.array().cast("array<long>")
        ),
    )
    return F.get(made, F.lit(0))


def probe_index(items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row per shingle of an item: shingle, item_id, n_shingles, probe."""
    each = items.select("item_id", F.explode(shingles(F.col("text"))).alias("shingle")).distinct()
    own = each.groupBy("item_id").agg(F.collect_list("shingle").alias("shingles"))
    size = F.size("shingles")
    largest = (F.pow(F.lit(2), F.floor(F.log2(size)) + 1) - 1).cast("int")
    n_probes = largest - F.ceil(largest * F.lit(threshold)).cast("int") + 1
    order = F.array_sort(
        F.transform("shingles", lambda s: F.struct(F.xxhash64(s, F.lit(1)).alias("by"), s.alias("s")))
    )
    ranked = own.select(
        "item_id",
        size.alias("n_shingles"),
        n_probes.alias("n_probes"),
        F.posexplode(order).alias("rank", "each"),
    )
    return ranked.select(
        F.col("each.s").alias("shingle"),
        "item_id",
        "n_shingles",
        (F.col("rank") < F.col("n_probes")).alias("probe"),
    )


def small(rows: DataFrame) -> DataFrame:
    """``rows`` of a written table, marked for a broadcast if their counted number allows it."""
    return F.broadcast(rows) if rows.count() <= BROADCAST_ROWS else rows


def candidates(hits: DataFrame, index: DataFrame) -> DataFrame:
    """Distinct (doc_id, item_id) of which the document has a probe of the item."""
    probes = small(index.filter("probe").select("shingle", "item_id"))
    return hits.join(probes, "shingle").select("doc_id", "item_id").distinct()


def verified(pairs: DataFrame, hits: DataFrame, index: DataFrame) -> DataFrame:
    """Of each pair, how many of the item's shingles are in the document; null ids are ids too."""
    parts = small(index.select(F.col("item_id").alias("item"), "n_shingles", "shingle"))
    needs = pairs.join(parts, F.col("item_id").eqNullSafe(F.col("item"))).drop("item")
    has = hits.select(F.col("doc_id").alias("doc"), F.col("shingle").alias("held"))
    met = needs.join(
        has, F.col("doc_id").eqNullSafe(F.col("doc")) & (F.col("shingle") == F.col("held"))
    )
    return met.groupBy("doc_id", "item_id", "n_shingles").agg(F.count(F.lit(1)).alias("n_matched"))


def find_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, n_matched, n_shingles, containment of every leaked item."""
    index = stage(probe_index(items, threshold), "benchmark_index")
    listed = stage(index.select("shingle").distinct(), "benchmark_shingles")
    each = docs.select("doc_id", F.explode(shingles(F.col("text"))).alias("shingle"))
    hits = stage(each.join(small(listed), "shingle", "left_semi").distinct(), "leak_hits")
    pairs = stage(candidates(hits, index), "leak_candidates")
    containment = F.col("n_matched") / F.col("n_shingles")
    return (
        verified(pairs, hits, index)
        .withColumn("containment", containment)
        .filter(F.col("containment") >= threshold)
        .select(
            "doc_id", "item_id", "n_matched", F.col("n_shingles").cast("long").alias("n_shingles"),
            "containment",
        )
    )


def without_leaks(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents in which no item was found; each row is judged by its own text."""
    row = free_name(docs, "_row")
    numbered = stage(docs.withColumn(row, F.monotonically_increasing_id()), "leak_documents")
    leaks = find_leaks(numbered.select(F.col(row).alias("doc_id"), "text"), items, threshold)
    leaked = leaks.select(F.col("doc_id").alias(row)).distinct()
    return numbered.join(leaked, row, "left_anti").select(*columns_of(docs))
