"""Places of diagnostics in an editor: rows and columns, which count UTF-16 units."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

POSITION = "struct<start_row:int,start_column:int,end_row:int,end_column:int>"


def utf16_length(text: Column) -> Column:
    """UTF-16 units of a text: two for a character beyond the first 65,536."""
    return F.length(text) + F.length(F.regexp_replace(text, r"[^\x{10000}-\x{10FFFF}]", ""))


def utf16_offset(text: Column, place: Column) -> Column:
    """The UTF-16 units before a place in code points."""
    return utf16_length(F.substring(text, F.lit(1), place))


def byte_offset(text: Column, place: Column) -> Column:
    """The bytes in UTF-8 before a place in code points."""
    return F.octet_length(F.substring(text, F.lit(1), place))


def editor_ranges(diagnostics: DataFrame, buffers: DataFrame) -> DataFrame:
    """``diagnostics`` with their ``range`` (``POSITION``) in ``buffers`` (path, text), joined by path.

    The span of all marks of the translation, else of the source, where the value stands in the line as it
    is (no escapes, one line); else the whole of the last line that a diagnostic has, or the first one.
    """
    lines = buffers.select("path", F.split(F.regexp_replace("text", "\r\n", "\n"), "\n", -1).alias("__lines"))
    rows = diagnostics.join(lines, "path")
    marks = F.when(F.exists("tgt_marks", lambda m: m["end"] > m["start"]), F.struct(F.col("tgt").alias("value"), F.col("tgt_marks").alias("marks"), F.col("line_number").alias("line")))
    own = rows.withColumn("__own", marks).withColumn("__row", F.greatest(F.col("line_number") - 1, F.lit(0)))
    line = F.coalesce(F.get("__lines", F.col("__row")), F.lit(""))
    quote = F.locate('"', line)
    seen = F.filter("__own.marks", lambda m: m["end"] > m["start"])
    first, last = F.array_min(F.transform(seen, lambda m: m["start"])), F.array_max(F.transform(seen, lambda m: m["end"]))
    verbatim = F.col("__own").isNotNull() & (F.col("line_number") > 0) & (quote > 0) & F.expr('startswith(substring(coalesce(get(__lines, __row), ""), locate(\'"\', coalesce(get(__lines, __row), "")) + 1), __own.value)')
    at = lambda place: utf16_offset(line, quote + place)
    row = F.col("__row").cast("int")
    exact = F.struct(row.alias("start_row"), at(first).alias("start_column"), row.alias("end_row"), at(last).alias("end_column"))
    whole = F.struct(row.alias("start_row"), F.lit(0).alias("start_column"), row.alias("end_row"), utf16_length(line).alias("end_column"))
    return own.withColumn("range", F.when(verbatim, exact).otherwise(whole).cast(POSITION)).drop("__lines", "__own", "__row")
