"""op12: periodic runs of words in all documents, some of them made periodic first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from footfall.llm.periodic_runs import WORD, collapse_runs
from footfall.llm.tables import table

#: One document in ten has its words from some place on replaced by a repetition.
EVERY = 10


def with_repeats(docs: DataFrame) -> DataFrame:
    """doc_id and text; in a tenth of the documents the text ends in a periodic stretch."""
    mark = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all("text", F.lit(WORD.pattern), F.lit(0))
    docs = docs.select("doc_id", "text", (mark % EVERY == 0).alias("marked"), F.floor(mark / EVERY).alias("g"))
    docs = docs.withColumn("words", F.when(F.col("marked"), words))
    docs = docs.withColumn("n", F.size("words")).withColumn("at", F.expr("IF(n > 0, g % n, NULL)").cast("int"))
    tail = F.col("n") - F.col("at")
    period = (1 + F.floor(tail / (3 + F.col("g") % 8))).cast("int")
    docs = docs.withColumns({"tail": tail, "period": period})
    once = F.slice("words", F.col("at") + 1, F.col("period"))
    times = F.ceil(F.col("tail") / F.col("period")).cast("int")
    again = F.slice(F.flatten(F.array_repeat(once, times)), F.lit(1), F.col("tail"))
    made = F.array_join(F.concat(F.slice("words", F.lit(1), F.col("at")), again), " ")
    return docs.select("doc_id", F.when(F.col("n") > 0, made).otherwise(F.col("text")).alias("text"))


def _densest(runs: Column) -> Column:
    """The run with most periods; of equal ones the first."""
    more = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    better = lambda a, b: F.when(a.isNull() | more(a, b), b).otherwise(a)
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(runs, none, better)


def op12_periodic_runs(spark, sf_dir):
    found = collapse_runs(with_repeats(table(spark, sf_dir, "documents")))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    found = found.withColumn("best", _densest(F.col("runs")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


QUERIES = {"op12_periodic_runs": op12_periodic_runs}

ORACLES: dict[str, str] = {}
