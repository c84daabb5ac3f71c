"""Edits: choose, merge, apply. All edits of a translation apply, or none if any two overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import EDIT, none


def merge_edits(edits: Column) -> Column:
    """Sorted edits without repeats; null if two overlap (touching is fine)."""
    ordered = F.array_sort(F.array_distinct(edits))
    clash = F.exists(F.when(F.size(ordered) > 1, F.sequence(F.lit(1), F.size(ordered) - 1)).otherwise(F.array().cast("array<int>")), lambda k: F.get(ordered, k - 1)["end"] > F.get(ordered, k)["start"])
    return F.when(~clash, ordered)


def apply_edits(value: Column, edits: Column) -> Column:
    """The text with merged edits applied; null edits leave it as it is."""
    end = lambda k: F.coalesce(F.get(edits, k)["end"], F.lit(0))  # noqa: E731  0 before the first
    pieces = F.transform(edits, lambda e, k: F.concat(F.substring(value, end(k - 1) + 1, e["start"] - end(k - 1)), e["replacement"]))
    last = end(F.size(edits) - 1)
    return F.coalesce(F.concat(F.array_join(pieces, ""), F.substring(value, last + 1, F.length(value))), value)


def fix_translations(diagnostics: DataFrame, unsafe: bool = False) -> DataFrame:
    """path, entry_idx, pair_idx, tgt, fixed, byte_start, byte_end of translations that change.

    Edits meet by translation; a translation has as many as it has findings.
    """
    some = diagnostics.filter(F.size("edits") > 0)
    if not unsafe:
        some = some.filter("safe")
    keys = ["path", "entry_idx", "pair_idx"]
    grouped = some.groupBy(*keys).agg(F.flatten(F.collect_list("edits")).alias("edits"), F.first("tgt").alias("tgt"), F.first("byte_start").alias("byte_start"), F.first("byte_end").alias("byte_end"))
    fixed = grouped.withColumn("fixed", apply_edits(F.col("tgt"), merge_edits(F.col("edits").cast(f"array<{EDIT}>"))))
    return fixed.filter("fixed <> tgt").drop("edits")


def obsolete_entries(diagnostics: DataFrame) -> DataFrame:
    """Entries that the rule ``obsolete`` would delete."""
    return diagnostics.filter("rule = 'obsolete'").select("path", "entry_idx").distinct()


def fix_summary(diagnostics: DataFrame, unsafe: bool = False) -> DataFrame:
    """path, fixable, unsafe_only, without: findings by what can be done about them."""
    has = (F.size("edits") > 0) | (F.col("rule") == "obsolete")
    safe = has & F.col("safe")
    return diagnostics.groupBy("path").agg(F.count_if(safe | (has & F.lit(unsafe))).alias("fixable"), F.count_if(has & ~safe & F.lit(not unsafe)).alias("unsafe_only"), F.count_if(~has).alias("without"))


__all__ = ["apply_edits", "fix_summary", "fix_translations", "merge_edits", "none", "obsolete_entries"]
