"""Word lists and dictionaries as tables."""

from __future__ import annotations

import os
import re
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Dictionaries of a folder; each is a plan of its own.
MAX_DICTIONARIES = 200


def word_list(spark: SparkSession, path: str) -> DataFrame:
    """Lower-cased words, one a line; blank lines and lines that begin with # don't count."""
    line = F.trim(F.col("value"))
    return spark.read.text(path).select(F.lower(line).alias("word")).filter("word <> '' and not startswith(word, '#')").distinct()


def listed_words(path: str) -> list[str]:
    """As ``word_list``, of one mounted file that a configuration names."""
    with open(path, encoding="utf-8", errors="replace") as f:
        words = (line.strip() for line in f)
        return sorted({w.lower() for w in words if w and not w.startswith("#")})


def languages_of(folder: str | None) -> list[str]:
    """The languages of a mounted folder's word lists ``<language>.dic``."""
    path = re.sub(r"^file:(?://)?", "", folder or "")
    return sorted(n.removesuffix(".dic") for n in os.listdir(path) if n.endswith(".dic")) if path and os.path.isdir(path) else []


def dictionary(spark: SparkSession, language: str, dic_path: str, aff_path: str | None = None) -> DataFrame:
    """(language, word) of a Hunspell word list, with prefixes and suffixes of its affix file applied.

    Single-character flags, PFX and SFX with strip, affix and condition are applied, and one
    prefix with one suffix; compounds and other directives are not.
    """
    entries = spark.read.text(dic_path).filter(~F.col("value").rlike(r"^[0-9]+\s*$") & (F.trim("value") != ""))
    word, flags = F.regexp_extract("value", r"^([^/\s]+)", 1), F.regexp_extract("value", r"^[^/\s]+/(\S+)", 1)
    base = entries.select(word.alias("word"), flags.alias("flags"))
    out = base.select("word")
    if aff_path:
        rules = spark.read.text(aff_path).select(F.split(F.trim("value"), r"\s+").alias("p")).filter(F.col("p")[0].isin("PFX", "SFX") & (F.size("p") >= 5))
        none = lambda c: F.when(c == "0", "").otherwise(F.substring_index(c, "/", 1))
        rules = F.broadcast(rules.select(F.col("p")[0].alias("kind"), F.col("p")[1].alias("flag"), none(F.col("p")[2]).alias("strip"), none(F.col("p")[3]).alias("affix"), F.col("p")[4].alias("cond")))  # an affix file has some hundred lines
        hit = F.col("flags").contains(F.col("flag"))
        suffixed = base.join(rules.filter("kind = 'SFX'"), hit & F.expr("endswith(word, strip) and word rlike concat('(?:', cond, ')$')"))
        suffixed = suffixed.select(F.expr("concat(substring(word, 1, length(word) - length(strip)), affix)").alias("word"), "flags")
        prefixed = base.unionByName(suffixed).join(rules.filter("kind = 'PFX'"), hit & F.expr("startswith(word, strip) and word rlike concat('^(?:', cond, ')')"))
        prefixed = prefixed.select(F.expr("concat(affix, substring(word, length(strip) + 1))").alias("word"))
        out = out.union(suffixed.select("word")).union(prefixed)
    return out.distinct().select(F.lit(language).alias("language"), "word")


def _language_of_file() -> Column:
    return F.regexp_extract(F.input_file_name(), r"([^/]+)\.dic$", 1)


def personal_words(spark: SparkSession, folder: str) -> DataFrame:
    """(language, word) of all word lists ``<language>.dic`` in a folder: one word a line, as it is."""
    lines = spark.read.option("pathGlobFilter", "*.dic").text(folder)
    return lines.select(_language_of_file().alias("language"), F.col("value").alias("word")).filter("word <> ''").distinct()


def dictionaries(spark: SparkSession, folder: str) -> DataFrame:
    """(language, word) of all Hunspell dictionaries ``<language>.dic`` with ``<language>.aff`` in a folder. One without an affix file is none."""
    names = spark.read.format("binaryFile").option("pathGlobFilter", "*.{aff,dic}").load(folder).select("path")
    stems = names.groupBy(F.regexp_replace("path", r"\.[^./]+$", "").alias("stem")).agg(F.count("*").alias("n")).filter("n = 2")
    found = [r[0] for r in stems.orderBy("stem").limit(MAX_DICTIONARIES + 1).collect()]
    if len(found) > MAX_DICTIONARIES:
        raise ValueError(f"more than {MAX_DICTIONARIES} dictionaries in {folder}")
    empty = spark.createDataFrame([], "language string, word string")
    return reduce(DataFrame.union, (dictionary(spark, stem.rpartition("/")[2], f"{stem}.dic", f"{stem}.aff") for stem in found), empty)
