"""The value in force at each instant.

Values start at instants; each holds until the next one.  Finding the value in force
is a running value over time, which a window per key would gather in one task.  Here
the time is cut into slices.  The wide rows move once, to a window that sees one key's
rows of one slice; the last value of each slice is carried over by a window that sees one
row for each of a key's slices.  The same plan serves every size.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SECOND = 1_000_000


def _floor(us: Column, size: int) -> Column:
    return us - F.pmod(us, F.lit(size))


def in_force(
    asked: DataFrame,
    values: DataFrame,
    keys: list[str],
    slice_seconds: int,
    ahead: bool = False,
    opens: Column | None = None,
    runs: Sequence[Column | str] | None = None,
) -> DataFrame:
    """Add ``value`` to ``asked``: the latest of ``values`` at or before its ``us``.

    Both have ``keys`` and ``us`` (epoch microseconds); of several values at one instant
    the largest counts, by ``rank`` first where there is one.  Both are read twice, so they should be written tables or cheap to
    make from some.  ``ahead`` looks the other way: the first value at or after.
    ``opens`` is the instant before which a key has no rows: nothing is carried into its
    slice.  With ``runs`` only the first row comes out of each run of rows of a key and
    slice, alike in these columns, that have the same value.  Rows without a key or
    instant are left out.
    """
    size = slice_seconds * SECOND
    largest = ["rank", "value"] if "rank" in values.columns else ["value"]
    values = values.select(*keys, "us", *largest)
    known = F.col("value").isNotNull()
    by_time = [*keys, "_slice"]
    rows = (
        asked.withColumn("_asked", F.lit(True))
        .unionByName(values, allowMissingColumns=True)
        .filter(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, "us")))
        .withColumns(
            {"_slice": _floor(F.col("us"), size), "_order": -F.col("us") if ahead else F.col("us")}
        )
    )
    looked_up = rows if opens is None else rows.filter(known | (F.col("_slice") > _floor(opens, size)))
    ends = (
        looked_up.groupBy(*by_time)
        .agg(F.max(F.when(known, F.struct("_order", *largest)))["value"].alias("end"))
    )
    slice_order = F.col("_slice").desc() if ahead else F.col("_slice")
    before = Window.partitionBy(*keys).orderBy(slice_order)
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    entries = ends.select(
        *by_time, F.last("end", ignorenulls=True).over(before).alias("_entry")
    ).filter(F.col("_entry").isNotNull())
    # of an instant's rows the values come first, the largest of them last
    within = (
        Window.partitionBy(*by_time)
        .orderBy("_order", F.col("_asked").asc_nulls_first(), *largest)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    found = (
        rows.withColumn("_inside", F.last("value", ignorenulls=True).over(within))
        .filter("_asked")
        .join(entries, by_time, "left")
        .withColumn("value", F.coalesce("_inside", "_entry"))
    )
    if runs is not None:
        earlier = F.lag(F.struct("value")).over(Window.partitionBy(*by_time, *runs).orderBy("_order"))
        found = found.withColumn("_earlier", earlier).filter(
            F.col("_earlier").isNull() | ~F.col("_earlier")["value"].eqNullSafe(F.col("value"))
        )
    return found.drop("rank", "_asked", "_slice", "_order", "_inside", "_entry", "_earlier")
