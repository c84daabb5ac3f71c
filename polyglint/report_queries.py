"""Queries over reports and whole folders, with the SQL that gives the same rows."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .operators import stats as st
from .operators.fixes import fix_summary
from .operators.rules import Options
from .plans import report
from .plans.check import barrier, check
from .plans.files import check_files
from .queries import ALL_STATES, PAIRS_SQL, WORDS_RE, entries, words_sql
from .queries import ORACLE_SQL as RULES_SQL
from .shared import cut, shared_dir
from .sources.po import local
from .sources.writer import write_entries

_SOME = ("blank", "pipes", "tabs", "unchanged")


def _found(spark: SparkSession, sf_dir: str, *rules: str, marks: bool = False, **options) -> DataFrame:
    return check(entries(spark, sf_dir), Options(select=rules, **{**ALL_STATES, **options}), marks=marks)


def json_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings written as JSON and read from it."""
    kind = "path string, rule string, severity string, message string, line_number int, src string, tgt string"
    rows = report.as_json(_found(spark, sf_dir, *_SOME)).select(F.from_json("value", kind).alias("j")).select("j.*")
    return rows.select("path", "rule", "severity", "message", "line_number", F.md5("src").alias("src"), F.md5("tgt").alias("tgt"))


def sarif_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SARIF results read back: the rule and its place in the list of rules, the level, and where the first mark is."""
    kind = "ruleId string, ruleIndex int, level string, message struct<text:string>, locations array<struct<physicalLocation:struct<artifactLocation:struct<uri:string>,region:struct<startLine:int,startColumn:int,endColumn:int>>>>, partialFingerprints struct<primaryLocationLineHash:string>"
    rows = report.sarif_results(_found(spark, sf_dir, "pipes", "tabs", "blank", marks=True)).select(F.from_json("value", kind).alias("j")).select("j.*")
    place = F.get("locations", F.lit(0))["physicalLocation"]
    return rows.select(
        F.col("ruleId").alias("rule"), F.col("ruleIndex").alias("rule_index"), "level", F.col("message.text").alias("message"), place["artifactLocation"]["uri"].alias("path"), place["region"]["startLine"].alias("line"), place["region"]["startColumn"].alias("first"),
        (F.length("partialFingerprints.primaryLocationLineHash") > 0).alias("hashed"),
    )


def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The number of each finding within its file, in the order of a report."""
    found = _found(spark, sf_dir, *_SOME)
    order = Window.partitionBy("path").orderBy("line_number", "entry_idx", "pair_idx", "rule", "message")
    return found.select("path", F.col("entry_idx").cast("long").alias("doc_id"), "rule", F.row_number().over(order).cast("long").alias("place"))


def severities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity, of two severities that are asked for."""
    return report.severity_counts(_found(spark, sf_dir, *_SOME, "newlines", "escapes", severity=("error", "info")))


def fixable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of each file by what can be done about them."""
    return fix_summary(_found(spark, sf_dir, "whitespace-start", "tabs", "emails", marks=True))


def stats_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics written as JSON and read from it."""
    part = lambda unit: f"{unit} struct<src:long,tgt:long>"
    kind = f"path string, entries struct<total:long,translated:long,fuzzy:long,untranslated:long,obsolete:long>, {part('words')}, {part('chars')}"
    j = st.as_json(st.stats(entries(spark, sf_dir), words=True)).select(F.from_json("value", kind).alias("j"))
    return j.select(F.coalesce("j.path", F.lit("(total)")).alias("path"), "j.entries.*", F.col("j.words.src").alias("src_words"), F.col("j.words.tgt").alias("tgt_words"), F.col("j.chars.src").alias("src_chars"), F.col("j.chars.tgt").alias("tgt_chars"))


def misspelled_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that translations have and no source of an even document of their language, each once."""
    rows = entries(spark, sf_dir)
    words = cut(rows.filter("entry_idx % 2 = 0 and language is not null").select("language", F.explode(T.matches(F.col("msgid.value"), T.WORD)).alias("word")).distinct())
    return report.misspelled_words(check(rows, Options(select=("spelling-str",), **ALL_STATES), dictionaries=words, marks=False))


_INDEXED = ("' %1$s of %2$d'", "CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN ' %2$d: %1$s' WHEN 1 THEN ' %1$d: %2$s' WHEN 2 THEN ' %2$d' ELSE ' %1$s %2$d' END")


def formats_indexed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inconsistent C formats whose specifications name their argument."""
    rows = entries(spark, sf_dir).withColumn("doc_id", F.col("entry_idx"))
    put = lambda c, more: F.concat(c, F.expr(more))
    rows = barrier(rows.withColumns({"msgid": F.col("msgid").withField("value", put(F.col("msgid.value"), _INDEXED[0])), "msgstr": F.transform("msgstr", lambda m: m.withField("value", F.when(m["value"] != "", put(m["value"], _INDEXED[1])).otherwise("")))}))
    found = check(rows, Options(select=("formats",), **ALL_STATES), marks=False)
    return found.select(F.col("entry_idx").cast("long").alias("doc_id"), "severity", "message")


#: Configurations of a folder of catalogues, by folder: name of the file and text.
_CONFIGS = {"": (".polyglint.toml", '[check]\nselect = ["short", "long"]\nlong_factor = 3\nnoqa = true\nfuzzy = true\nobsolete = true\n'), "de": ("polyglint.toml", '[check]\nselect = ["tabs", "pipes"]\nfuzzy = true\nobsolete = true\n'), "fr": (".polyglint/polyglint.toml", '[check]\nselect = ["blank", "pipes"]\nseverity = ["warning"]\nfuzzy = true\nobsolete = true\n')}


def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of catalogues, one for each language and 400 documents, checked under the nearest of three configurations."""
    folder = f"{shared_dir(spark)}/configured-{uuid.uuid4().hex}"
    path = F.concat(F.coalesce("language", F.lit("none")), F.lit("/"), F.expr("entry_idx div 400").cast("string"), F.lit(".po"))
    write_entries(entries(spark, sf_dir).withColumn("path", path).withColumn("language", F.coalesce("language", F.lit("none"))), folder)
    for where, (name, text) in _CONFIGS.items():
        target = os.path.join(local(folder), where, name)
        os.makedirs(os.path.dirname(target), exist_ok=True)
        with open(target, "w", encoding="utf-8") as f:
            f.write(text)
    found = check_files(spark, folder)
    return found.select(F.regexp_extract("path", r"([^/]+)/[0-9]+\.po$", 1).alias("language"), "rule", "severity", "message", F.md5("src").alias("src"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "report_json": json_rows, "report_sarif": sarif_rows, "report_order": line_order, "report_severities": severities, "report_fixable": fixable, "stats_json": stats_json, "misspelled_list": misspelled_list, "formats_indexed": formats_indexed, "configured": configured,
}


def _rules(*names: str) -> str:
    return " UNION ALL ".join(f"SELECT doc_id, rule, severity, message FROM ({RULES_SQL['rule_' + n.replace('-', '_')]})" for n in names)


_SPEC = r"%%|%[-+ #.$0-9]*(?:hh?|ll?|[qLjzZt])?[A-Za-z]?"


def _specs(c: str) -> str:
    found = f"list_filter(regexp_extract_all({c}, '{_SPEC}'), lambda m: m <> '%%')"
    placed = f"list_transform({found}, lambda m, k: {{'i': coalesce(try_cast(regexp_extract(m, '^%([0-9]+)\\$', 1) AS INTEGER), 2147483647), 'k': k, 'm': regexp_replace(m, '^%[0-9]+\\$', '%')}})"
    return f"list_transform(list_sort({placed}), lambda x: x.m)"


_FIRST = "CASE WHEN strpos(src, {c}) > 0 THEN strpos(src, {c}) ELSE nullif(strpos(tgt, {c}), 0) END"
_PAIR = f"SELECT doc_id, path, src, tgt, coalesce(language, 'none') AS language FROM ({PAIRS_SQL}) AS y"
ORACLE_SQL: dict[str, str] = {
    "report_json": f"SELECT path, rule, severity, message, 1::INTEGER AS line_number, md5(src) AS src, md5(tgt) AS tgt FROM ({_rules(*_SOME)}) AS f JOIN ({_PAIR}) AS g USING (doc_id)",
    "report_sarif": f"""WITH f AS ({_rules("pipes", "tabs", "blank")}) SELECT rule, (SELECT count(DISTINCT r.rule) FROM f r WHERE r.rule < f.rule)::INTEGER AS rule_index, CASE severity WHEN 'info' THEN 'note' ELSE severity END AS level, message, path, 1::INTEGER AS line,
        CASE rule WHEN 'pipes' THEN {_FIRST.format(c="'|'")} WHEN 'tabs' THEN {_FIRST.format(c="chr(9)")} END::INTEGER AS first, true AS hashed FROM f JOIN ({_PAIR}) AS g USING (doc_id)""",
    "report_order": f"SELECT path, doc_id, rule, row_number() OVER (PARTITION BY path ORDER BY doc_id, rule, message) AS place FROM ({_rules(*_SOME)}) AS f JOIN ({_PAIR}) AS g USING (doc_id)",
    "report_severities": f"SELECT severity, count(*) AS n FROM ({_rules(*_SOME, 'newlines', 'escapes')}) WHERE severity IN ('error', 'info') GROUP BY severity",
    "report_fixable": f"SELECT path, count(*) FILTER (rule = 'whitespace-start') AS fixable, count(*) FILTER (rule = 'emails' AND message = 'different emails') AS unsafe_only, count(*) FILTER (rule = 'tabs' OR (rule = 'emails' AND message <> 'different emails')) AS without FROM ({_rules('whitespace-start', 'tabs', 'emails')}) AS f JOIN ({_PAIR}) AS g USING (doc_id) GROUP BY path",
    "stats_json": f"SELECT path, total, translated, fuzzy, untranslated, obsolete, src_words, tgt_words, src_chars, tgt_chars FROM ({RULES_SQL['stats_entries']}) AS a JOIN ({RULES_SQL['stats_words']}) AS b USING (path)",
    "misspelled_list": f"""WITH p AS (SELECT * FROM ({PAIRS_SQL}) AS x WHERE NOT noqa AND tgt <> ''), listed AS (SELECT DISTINCT language, lower(unnest(regexp_extract_all(src, '{WORDS_RE}'))) AS word FROM ({PAIRS_SQL}) AS x WHERE doc_id % 2 = 0 AND language IS NOT NULL),
        w AS (SELECT DISTINCT language, unnest({words_sql('tgt')}) AS word FROM p)
        SELECT DISTINCT word FROM w WHERE NOT regexp_matches(word, '[0-9]') AND NOT regexp_full_match(word, '[A-Z]{{2,}}') AND language IN (SELECT language FROM listed) AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.language = w.language AND l.word = lower(w.word))""",
    "formats_indexed": f"""WITH p AS (SELECT doc_id, src || {_INDEXED[0]} AS src, tgt || {_INDEXED[1]} AS tgt FROM ({PAIRS_SQL}) AS x WHERE NOT noqa AND tgt <> '' AND flag = 'c-format')
        SELECT doc_id, 'error' AS severity, 'inconsistent format strings (C)' AS message FROM p WHERE {_specs('src')} <> {_specs('tgt')}""",
    "configured": f"""WITH g AS ({_PAIR}), f AS ({_rules("tabs", "pipes", "blank", "short")} UNION ALL SELECT doc_id, rule, severity, message FROM ({RULES_SQL['rule_long'].replace("* 8 <=", "* 3 <=")}))
        SELECT language, rule, severity, message, md5(src) AS src FROM f JOIN g USING (doc_id) WHERE CASE language WHEN 'de' THEN rule IN ('tabs', 'pipes') WHEN 'fr' THEN rule = 'blank' ELSE rule IN ('short', 'long') END""",
}
