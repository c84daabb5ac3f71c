"""Exact deduplication (native DataFrame operations).

Rows are keyed by a 128-bit hash of the normalised text. Only hashes that occur more than
once go on; inside those groups the texts themselves are the grouping key, so two texts that
merely share a hash form two groups. Partial aggregation combines copies before the shuffle:
a group of any size reaches a reducer as one row per map task.

Cases: a null text counts as empty; texts are read whole; among equal texts the one with the
most code points stays, then the smallest id, then (repeated rows) the first in table order;
a null id sorts after all others; an empty table gives an empty result; all columns beside
id and text are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, materialise, sized_join, stable

SPACES = r"[\x20\x09-\x0D]+"


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.monotonically_increasing_id().alias("pos")).select(
        "doc_id", "pos", F.length("text").alias("points"), F.regexp_replace("text", SPACES, "").alias("norm")
    )


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: doc_id, pos, keep_id, group_size, kept, text_sha256.

    ``pos`` numbers the rows of the table; ``kept`` is true for exactly one row of a group.
    """
    rows = _rows(stable(docs), id_col, text_col)
    hash128 = F.unhex(F.md5(F.col("norm").cast("binary")))
    keyed = materialise(rows.select("doc_id", "pos", hash128.alias("h"), F.unhex(F.sha2("norm", 256)).alias("sha")), "exact-keys")
    repeats = materialise(keyed.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "exact-repeats")
    # The bytes decide: within a hash, equal normalised texts are a group.
    best = F.max(F.struct("points", F.col("doc_id").isNotNull(), -F.col("doc_id"), -F.col("pos"))).alias("best")
    same = sized_join(rows.withColumn("h", hash128), repeats, ["h"], "inner")
    groups = same.groupBy("h", "norm").agg(F.count("*").alias("n"), best)
    groups = materialise(
        groups.select("h", F.unhex(F.sha2("norm", 256)).alias("sha"), "n", (-F.col("best.col3")).alias("best_id"), (-F.col("best.col4")).alias("best_pos")), "exact-groups"
    )
    out = sized_join(keyed, groups, ["h", "sha"], "left")
    alone = F.col("n").isNull()
    return out.select(
        "doc_id",
        "pos",
        F.when(alone, F.col("doc_id")).otherwise(F.col("best_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (alone | (F.col("pos") == F.col("best_pos"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    docs, place = stable(docs), free_name(docs, "__pos")
    dropped = materialise(exact_groups(docs, id_col, text_col).filter("not kept").select(F.col("pos").alias(place)), "exact-dropped")
    return sized_join(docs.withColumn(place, F.monotonically_increasing_id()), dropped, [place], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
