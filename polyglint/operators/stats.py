"""Translation progress, words and characters per file, with a grand total."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

STATES = ("translated", "fuzzy", "untranslated", "obsolete")


def state() -> Column:
    """Each entry is in one state: fuzzy before obsolete before translated."""
    return F.when(F.col("fuzzy"), "fuzzy").when(F.col("obsolete"), "obsolete").when(F.col("is_translated"), "translated").otherwise("untranslated")


def share(part: Column, whole: Column, scale: int = 100) -> Column:
    """Integer share, 0 of nothing."""
    return F.when(whole == 0, F.lit(0).cast("long")).otherwise(F.floor(part * scale / whole).cast("long"))


def stats(entries: DataFrame, words: bool = False, total: bool = True) -> DataFrame:
    """Counts per path; with ``total`` a row of path null sums all files. Header entries don't count.

    One partial and one final aggregation; with ``total`` a rollup of both levels in one pass.
    """
    rows = entries.filter(~F.col("is_header")).withColumn("state", state())
    n = lambda s: F.count_if(F.col("state") == s).alias(s)
    aggregates = [F.count("*").alias("total"), *(n(s) for s in STATES)]
    if words:
        src, tgt = F.col("msgid.value"), F.coalesce(F.get("msgstr", F.lit(0))["value"], F.lit(""))
        # Bound once: a text is stripped of its formats for both counts together.
        both = lambda s: T.let([T.without_formats(F.coalesce(T.flat(s, F.col("format_language")), s), F.col("format_language"))], lambda x: F.struct(T.count(x, T.WORD).alias("words"), F.length(F.regexp_replace(x, rf"[^{T.ALNUM}-]+", "")).alias("chars")))
        rows = rows.select("path", "state", both(src).alias("src"), both(tgt).alias("tgt"))
        rows = rows.withColumns({f"{side}_{unit}": F.col(f"{side}.{unit}") for side in ("src", "tgt") for unit in ("words", "chars")})
        for side in ("src", "tgt"):
            for unit in ("words", "chars"):
                c = f"{side}_{unit}"
                aggregates.append(F.sum(c).alias(c))
                aggregates += [F.coalesce(F.sum(F.when(F.col("state") == s, F.col(c))), F.lit(0)).alias(f"{c}_{s}") for s in (STATES if side == "src" else STATES[:2])]
    grouped = rows.rollup("path") if total else rows.groupBy("path")
    out = grouped.agg(*aggregates)
    return out.select("*", *(share(F.col(s), F.col("total")).alias(f"{s}_percent") for s in STATES))


def by_status(table: DataFrame) -> DataFrame:
    """Files by progress: most translated first, then fuzzy, untranslated, obsolete, then path."""
    ratio = lambda s: share(F.col(s), F.col("total"), 1_000_000).desc()
    return table.orderBy(*[k for s in STATES for k in (ratio(s), F.col(s).desc())], F.split("path", "/"))


def by_path(table: DataFrame) -> DataFrame:
    return table.orderBy(F.split("path", "/"))


def as_json(table: DataFrame) -> DataFrame:
    """One JSON object a row, fit for ``write.text``: path, entries, and words and chars where they were counted."""
    parts = [F.struct("total", *STATES).alias("entries")]
    if "src_words" in table.columns:
        parts += [F.struct(*(F.col(x).alias(x.replace(f"_{unit}", "")) for x in table.columns if f"_{unit}" in x)).alias(unit) for unit in ("words", "chars")]
    return table.select(F.to_json(F.struct("path", *parts)).alias("value"))
