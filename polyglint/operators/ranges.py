"""Ranges of bytes that meet, by whatever tool they were found.

A range is put into the bins that it touches, and a range that may lie inside another one into
the bin of its first byte; so rows meet by file and bin, and a file of any length is dealt over tasks.
Within a bin ranges are sorted by their starts and compared with running values, not in pairs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Bytes of a bin.
BIN = 1 << 14


def within(inner: DataFrame, outer: DataFrame, how: str = "left_semi", size: int = BIN) -> DataFrame:
    """Rows of ``inner`` (path, start, end, ...) that lie inside one of ``outer`` (path, start, end), or don't (``left_anti``).

    Equal and touching ends are inside. A null in a range lies nowhere and holds nothing.
    """
    key = "__key"
    rows = inner.withColumn(key, F.struct("path", "start", "end"))
    bins = F.sequence(F.expr(f"start div {size}"), F.expr(f"end div {size}"))
    some = "path is not null and start <= end"
    held = outer.filter(some).select("path", "start", "end", F.explode(bins).alias("__bin"), F.lit(False).alias("__asked"))
    asked = inner.filter(some).select("path", "start", "end", F.expr(f"start div {size}").alias("__bin"), F.lit(True).alias("__asked"))
    # Of the ranges that begin before a place, or at it, the one that ends last decides.
    before = Window.partitionBy("path", "__bin").orderBy("start", "__asked").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    far = F.max(F.when(~F.col("__asked"), F.col("end"))).over(before)
    hit = held.distinct().union(asked.distinct()).withColumn("__far", far).filter("__asked and end <= __far").select(F.struct("path", "start", "end").alias(key))
    return rows.join(hit, key, how).select(inner.columns)


def meeting(ranges: DataFrame, size: int = BIN, empty: bool = False) -> DataFrame:
    """The different (path, start, end) of ``ranges`` that share a byte with one of other ends.

    ``empty``: an empty range meets those that it stands inside, not at an end of.
    """
    bins = F.sequence(F.expr(f"start div {size}"), F.greatest(F.expr(f"(end - 1) div {size}"), F.expr(f"start div {size}")))
    some = ranges.filter("path is not null and start " + ("<=" if empty else "<") + " end").select("path", "start", "end").distinct()
    order = Window.partitionBy("path", "__bin").orderBy("start", "end")
    before, after = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lead("start").over(order)
    each = some.withColumn("__bin", F.explode(bins)).select("*", before.alias("__before"), after.alias("__after"))
    return each.filter("__before > start or __after < end").select("path", "start", "end").distinct()


def overlapping(ranges: DataFrame, size: int = BIN) -> DataFrame:
    """Rows of ``ranges`` (path, start, end, ...) that share a byte with another row of other ends."""
    return ranges.join(meeting(ranges, size), ["path", "start", "end"], "left_semi").select(ranges.columns)
