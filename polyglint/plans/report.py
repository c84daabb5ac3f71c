"""Reports over diagnostics: counts, JSON, SARIF, word lists and text. Lines are rows, which Spark sorts and writes."""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

_LEVELS = {"info": "note", "warning": "warning", "error": "error"}


def in_order(diagnostics: DataFrame, by: str = "line") -> DataFrame:
    """Sorted by path and line, by the text (its source comes first) or by rule; paths by their parts."""
    first = {"line": [], "message": [F.col("src")], "rule": [F.col("rule")]}[by]
    return diagnostics.orderBy(*first, F.split("path", "/"), "line_number", "entry_idx", "pair_idx", "rule", "message")


def rule_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("rule").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "rule")


def severity_counts(diagnostics: DataFrame) -> DataFrame:
    return diagnostics.groupBy("severity").agg(F.count("*").alias("n"))


def file_counts(files: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """path, info, warning, error for every file, clean ones too."""
    n = lambda s: F.count_if(F.col("severity") == s).alias(s)
    counted = diagnostics.groupBy("path").agg(n("info"), n("warning"), n("error"))
    return files.select("path").distinct().join(counted, "path", "left").na.fill(0).orderBy(F.split("path", "/"))


def misspelled_words(diagnostics: DataFrame) -> DataFrame:
    words = F.split(F.regexp_extract("message", r"^misspelled words in \w+: (.*)$", 1), ", ")
    return diagnostics.filter(F.col("rule").startswith("spelling-")).select(F.explode(words).alias("word")).distinct().orderBy("word")


def as_json(diagnostics: DataFrame) -> DataFrame:
    """One JSON object a row, fit for ``write.text``."""
    return diagnostics.select(F.to_json(F.struct("path", "rule", "severity", "message", "line_number", "src", "tgt", "src_marks", "tgt_marks")).alias("value"))


def rule_indexes(diagnostics: DataFrame) -> DataFrame:
    """(rule, rule_index): the rules that have findings by name, from 0."""
    return diagnostics.select("rule").distinct().withColumn("rule_index", F.row_number().over(Window.orderBy("rule")) - 1)  # a row a rule


def sarif_results(diagnostics: DataFrame) -> DataFrame:
    """One SARIF result a row; the fingerprint is a hash of what identifies the finding."""
    diagnostics = diagnostics.join(F.broadcast(rule_indexes(diagnostics)), "rule")
    level = F.create_map(*[F.lit(x) for kv in _LEVELS.items() for x in kv])[F.col("severity")]
    mark = F.coalesce(F.get("src_marks", F.lit(0)), F.get("tgt_marks", F.lit(0)))
    region = F.struct(F.greatest("line_number", F.lit(1)).alias("startLine"), (mark["start"] + 1).alias("startColumn"), (mark["end"] + 1).alias("endColumn"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), region.alias("region")).alias("physicalLocation")))
    fingerprint = F.struct(F.lower(F.hex(F.xxhash64("path", "rule", "message", "src"))).alias("primaryLocationLineHash"))
    return diagnostics.select(F.to_json(F.struct(F.col("rule").alias("ruleId"), F.col("rule_index").alias("ruleIndex"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"), fingerprint.alias("partialFingerprints"))).alias("value"))


def sarif(diagnostics: DataFrame, tool: str = "polyglint") -> Iterator[str]:
    """The lines of a SARIF 2.1.0 log; results stream through the driver one at a time."""
    rules = [r[0] for r in diagnostics.select("rule").distinct().orderBy("rule").collect()]  # at most one a rule
    head = {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}
    yield '{"version":"2.1.0","runs":[{"tool":' + json.dumps(head) + ',"results":['
    comma = ""
    for row in sarif_results(in_order(diagnostics)).toLocalIterator():
        yield comma + row[0]
        comma = ","
    yield "]}]}"


def text(diagnostics: DataFrame, by: str = "line") -> Iterator[str]:
    """path:line: [severity:rule] message, then source and translation."""
    for d in in_order(diagnostics, by).toLocalIterator():
        yield f"{d.path}:{d.line_number}: [{d.severity}:{d.rule}] {d.message}"
        yield from (f"  | {x}" for x in (*d.src.split("\n"), "", *d.tgt.split("\n")))


def text_lines(diagnostics: DataFrame, by: str = "line") -> DataFrame:
    """The lines of ``text`` as rows (value), in order over partitions: ``write.text`` keeps all in Spark."""
    head = F.concat("path", F.lit(":"), F.col("line_number").cast("string"), F.lit(": ["), "severity", F.lit(":"), "rule", F.lit("] "), "message")
    block = lambda c: F.concat(F.lit("  | "), F.replace(F.col(c), F.lit("\n"), F.lit("\n  | ")))
    return in_order(diagnostics, by).select(F.concat_ws("\n", head, block("src"), F.lit("  | "), block("tgt")).alias("value"))


def write_sarif(diagnostics: DataFrame, path: str, tool: str = "polyglint") -> None:
    """A SARIF log in parts below ``path``: ``results`` (a result a line, sorted) from the executors, ``head`` with the tool and its rules."""
    in_sorted = in_order(diagnostics)
    sarif_results(in_sorted).write.text(f"{path}/results")
    rules = [r[0] for r in rule_indexes(diagnostics).orderBy("rule_index").collect()]  # at most one a rule
    head = {"version": "2.1.0", "runs": [{"tool": {"driver": {"name": tool, "rules": [{"id": r} for r in rules]}}, "columnKind": "unicodeCodePoints"}]}
    diagnostics.sparkSession.createDataFrame([(json.dumps(head),)], "value string").coalesce(1).write.text(f"{path}/head")


def summary(diagnostics: DataFrame) -> dict[str, int]:
    """Findings by severity; ``exit_code`` is 1 if there are any."""
    counts = {s: n for s, n in severity_counts(diagnostics).collect()}  # a row a severity
    out = {s: counts.get(s, 0) for s in _LEVELS}
    return out | {"exit_code": int(any(out.values()))}
