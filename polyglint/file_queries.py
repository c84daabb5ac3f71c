"""Queries over what is read from and written to files: headers, ranges, listings, lines. With the SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text as T
from .functions.positions import editor_ranges
from .functions.wrap import message_lines
from .operators.ranges import meeting, within
from .operators.rules import HEADER_FIELDS, Options
from .plans.check import barrier, check
from .queries import ALL_STATES, PAIRS_SQL, WORDS_RE, doc_of_path, documents, entries, words_sql
from .shared import cut, shared_dir
from .sources.affixes import Lexicon
from .sources.listing import kept, rules_of
from .sources.po import parse_files, read_catalogues
from .sources.writer import escaped, write_entries

#: What a rendered header has, by the length of the document's text: (field, when, value), in SQL that both engines read.
_FIELDS = (
    ("Project-Id-Version", "n % 2 = 0", "'1.' || n"),
    ("Report-Msgid-Bugs-To", "n % 3 > 0", "CASE CAST(n % 5 AS INT) WHEN 0 THEN 'http://example.org/bugs' WHEN 1 THEN 'me AT example DOT org' WHEN 2 THEN 'a@example.org b@example.org' WHEN 3 THEN 'me (at) example (dot) org' ELSE 'me@example.org' END"),
    ("PO-Revision-Date", "n % 5 > 1", "'2026-01-01'"),
    ("Last-Translator", "n % 7 > 1", "CASE CAST(n % 3 AS INT) WHEN 0 THEN 'nobody' ELSE 'Me <me@example.org>' END"),
    ("Language", "n % 11 > 0", "CASE CAST(n % 6 AS INT) WHEN 0 THEN upper(lang) WHEN 1 THEN lang || '_XX' WHEN 2 THEN lang || '@latin' WHEN 3 THEN lang || '_XX@latin' ELSE lang END"),
    ("Language-Team", "n % 4 > 0", "CASE CAST(n % 3 AS INT) WHEN 0 THEN 'http://example.org/team' WHEN 1 THEN 'team@example.org http://example.org/team' ELSE 'team@example.org' END"),
    ("Content-Type", "n % 9 > 0", "CASE CAST(n % 7 AS INT) WHEN 0 THEN 'text/plain; charset=CHARSET' WHEN 1 THEN 'text/plain' WHEN 2 THEN 'text/html; charset=UTF-8' WHEN 3 THEN 'TEXT/plain ; charset = utf8 ' WHEN 4 THEN 'text/plain; charset=iso-8859-15' ELSE 'text/plain; charset=UTF-8' END"),
    ("Content-Transfer-Encoding", "n % 8 > 0", "'8bit'"),
    ("Plural-Forms", "n % 2 = 1", "'nplurals=' || n % 3 || '; plural=0'"),
)
_HEADER_ROWS = "SELECT doc_id, coalesce(lang, 'fr') AS lang, length(coalesce(text, '')) AS n FROM documents"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of headers that are rendered into catalogues by the lengths of texts, and parsed."""
    documents(spark, sf_dir)
    fields = " || ".join(f"CASE WHEN {when} THEN '{name}: ' || ({value}) || chr(92) || 'n' ELSE '' END" for name, when, value in _FIELDS)
    files = spark.sql(f"""SELECT 'f/' || doc_id || '.po' AS path, encode('msgid ""' || chr(10) || 'msgstr "' || {fields} || '"' || chr(10), 'UTF-8') AS content FROM ({_HEADER_ROWS}) AS d""")
    return check(parse_files(files), Options(select=("header",)), marks=False).select(doc_of_path(), "severity", "message")


def parsed_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The catalogue of PAIRS_SQL written as wrapped files of some hundred entries each, listed, and parsed by ranges of 64 KB."""
    folder = f"{shared_dir(spark)}/catalogues-{uuid.uuid4().hex}"
    path = F.concat(F.coalesce("language", F.lit("none")), F.lit("/"), F.expr("entry_idx div 400").cast("string"), F.lit(".po"))
    write_entries(entries(spark, sf_dir).withColumn("path", path), folder)
    back = cut(read_catalogues(spark, folder, size=1 << 16).filter("not is_header"))
    # The header is entry 0, and the others follow each other.
    place = F.row_number().over(Window.partitionBy("path").orderBy("entry_idx")) == F.col("entry_idx")
    last = F.get("msgstr", F.lit(0))["value"]
    return back.select("language", "fuzzy", "obsolete", "noqa", F.array_join("noqa_rules", ";").alias("noqa_rules"), place.alias("in_order"), F.md5("msgid.value").alias("source"), F.md5("msgid_plural.value").alias("plural"), F.md5(last).alias("translation"))


#: Ignore files of an inventory (folder, kind, text): a repository, and another one in its folder s5.
_IGNORE = [("", ".gitignore", "/s1/\n*.tmp.po\nbuild/*\n!build/k*.po\ns2/**/deep\nd[!0-4].po\n"), ("/s3", ".gitignore", "!*.tmp.po\n/x/\n"), ("/s3", ".ignore", "e?.po\n"), ("/s4", ".gitignore", "!d*.po\n")]
_PATH = """'/s' || length(coalesce(text, '')) % 6 || CASE CAST(length(coalesce(text, '')) % 7 AS INT) WHEN 0 THEN '/build' WHEN 1 THEN '/x/deep' WHEN 2 THEN '/x' WHEN 3 THEN '/.h' WHEN 4 THEN '/a/b/deep' ELSE '' END || '/' ||
 CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'd' || doc_id % 10 WHEN 1 THEN 'k' || doc_id || '.tmp' WHEN 2 THEN 'e' || doc_id % 10 WHEN 3 THEN '_k' || doc_id ELSE 'd' || doc_id % 7 END || '.po'"""


def listed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which paths of an inventory, one for each document, are left by ignore files and the rule for hidden names."""
    documents(spark, sf_dir)
    rules = rules_of(spark.createDataFrame(_IGNORE, "folder string, kind string, text string"))
    return kept(spark.sql(f"SELECT DISTINCT {_PATH} AS path FROM documents"), rules, spark.createDataFrame([("",), ("/s5",)], "folder string"))


def wrapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the texts' plain words as a catalogue has them: how many, and which."""
    text = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), "[^a-z]+", " "))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lines = [message_lines("msgstr", v) for v in batch.column("value").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(map(len, lines), pa.int64()), pa.array(["\n".join(x) for x in lines], pa.string())], names=["doc_id", "n_lines", "lines"])

    rows = documents(spark, sf_dir).select("doc_id", text.alias("value")).mapInArrow(run, "doc_id long, n_lines long, lines string")
    return rows.select("doc_id", "n_lines", F.md5("lines").alias("lines"))


#: Ranges from two tools: places by the lengths of texts, in SQL that both engines read.
_INNER = "SELECT coalesce(source, 'none') AS path, doc_id, CAST((doc_id * 7919 + length(coalesce(text, ''))) % 60000 AS BIGINT) AS \"start\", CAST((doc_id * 7919 + length(coalesce(text, ''))) % 60000 + doc_id % 90 AS BIGINT) AS \"end\" FROM documents"
_OUTER = "SELECT coalesce(source, 'none') AS path, CAST(doc_id * 31 % 60000 AS BIGINT) AS \"start\", CAST(doc_id * 31 % 60000 + length(coalesce(text, '')) AS BIGINT) AS \"end\" FROM documents WHERE length(coalesce(text, '')) % 5 = 0"


def ranges_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ranges that lie inside no range which is deleted, and whether they overlap others that are left."""
    documents(spark, sf_dir)
    inner, outer = (spark.sql(q.replace('"', "`")) for q in (_INNER, _OUTER))
    left = cut(within(inner, outer, "left_anti"))
    met = meeting(left, empty=True).withColumn("hit", F.lit(True))
    return left.join(met, ["path", "start", "end"], "left").select("doc_id", "path", "start", "end", F.coalesce("hit", F.lit(False)).alias("overlaps"))


def editor_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where an editor underlines tabs and pipes in buffers of one entry each: columns in UTF-16 units; a character beyond the first plane stands before some texts."""
    rows = entries(spark, sf_dir).withColumn("path", F.col("entry_idx").cast("string"))
    odd = F.when(F.col("entry_idx") % 3 == 0, "\U0001f600 ").otherwise("")
    rows = barrier(rows.withColumn("msgstr", F.transform("msgstr", lambda m: m.withField("value", F.when(m["value"] != "", F.concat(odd, m["value"])).otherwise("")))))
    found = check(rows, Options(select=("pipes", "tabs"), **ALL_STATES))
    buffers = rows.select("path", F.concat(F.lit('msgstr "'), escaped(F.get("msgstr", F.lit(0))["value"]), F.lit('"')).alias("text"))
    return editor_ranges(found, buffers).select(F.col("entry_idx").cast("long").alias("doc_id"), "rule", "range.*")


def misspelled_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations with words that are neither among those of documents with an even id nor one of these with an s behind it."""
    rows = entries(spark, sf_dir)
    words = rows.filter("entry_idx % 2 = 0 and language is not null").select("language", F.explode(T.matches(F.col("msgid.value"), T.WORD)).alias("word"))
    stems = cut(words.select("language", F.lower("word").alias("stem"), F.array(F.lit("S")).alias("flags")).distinct())
    languages = stems.select("language").distinct()
    rules = languages.select("language", F.lit("SFX").alias("kind"), F.lit("S").alias("flag"), F.lit(True).alias("both"), F.lit("").alias("strip"), F.lit("s").alias("affix"), F.lit(".\\z").alias("pattern"), F.array().cast("array<string>").alias("more"))
    none = F.lit(None).cast("string")
    traits = languages.select("language", *(none.alias(c) for c in ("needs_affix", "forbidden", "only_compound", "compound", "first", "middle", "last")), F.lit(3).alias("least"))
    found = check(rows, Options(select=("spelling-str",), **ALL_STATES), Lexicon(stems, rules, traits), marks=False)
    return found.select(F.col("entry_idx").cast("long").alias("doc_id"), "rule", "severity", "message")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "rule_header": headers, "parsed_ranges": parsed_ranges, "listed_paths": listed_paths, "wrapped": wrapped, "ranges_left": ranges_left, "editor_columns": editor_columns, "rule_spelling_forms": misspelled_forms,
}


def _headers_sql() -> str:
    base = f"WITH d AS ({_HEADER_ROWS}), h AS (SELECT doc_id, n, " + ", ".join(f"CASE WHEN {when} THEN trim({value}) END AS f{k}" for k, (_, when, value) in enumerate(_FIELDS)) + " FROM d)"
    at = {name: k for k, (name, _, _) in enumerate(_FIELDS)}
    part = lambda severity, message, where: f"SELECT doc_id, '{severity}' AS severity, {message} AS message FROM h WHERE {where}"
    parts = [part(severity, f"'missing field ''{name}'' in header'", f"f{at[name]} IS NULL" if name in at else "true") for name, severity in HEADER_FIELDS]
    wrong = {
        "Content-Type": ("error", "n % 7 IN (0, 1, 2)"), "Plural-Forms": ("error", "n % 3 = 0"), "Language": ("error", "n % 6 IN (0, 2)"),
        "Report-Msgid-Bugs-To": ("info", "n % 5 IN (0, 2, 3)"), "Last-Translator": ("info", "n % 3 = 0"), "Language-Team": ("info", "n % 3 = 1"),
    }
    parts += [part(severity, f"'invalid value ''' || f{at[name]} || ''' for field ''{name}'' in header'", f"f{at[name]} IS NOT NULL AND {where}") for name, (severity, where) in wrong.items()]
    return f"{base} " + " UNION ALL ".join(parts)


_LISTED_SQL = f"""WITH p AS (SELECT DISTINCT {_PATH} AS path FROM documents), q AS (SELECT *, regexp_extract(path, '[^/]*$') AS name FROM p)
SELECT path FROM q WHERE NOT contains(path, '/.h/') AND NOT starts_with(path, '/s1/') AND NOT (starts_with(path, '/s2/') AND contains(path, '/deep/')) AND NOT starts_with(path, '/s3/x/')
 AND CASE WHEN starts_with(path, '/s5/') THEN true
  WHEN starts_with(path, '/s3/') AND regexp_full_match(name, 'e.\\.po') THEN false WHEN starts_with(path, '/s3/') AND ends_with(name, '.tmp.po') THEN true WHEN starts_with(path, '/s4/') AND regexp_full_match(name, 'd.*\\.po') THEN true
  WHEN regexp_full_match(name, 'd[^0-4]\\.po') THEN false WHEN starts_with(name, 'k') AND regexp_matches(path, '/s[0-9]/build/') THEN NOT ends_with(name, '.tmp.po')
  WHEN ends_with(name, '.tmp.po') THEN false ELSE true END"""
def _editor_sql() -> str:
    parts = []
    for rule, sign in (("pipes", "|"), ("tabs", "\t")):
        char = f"chr({ord(sign)})"
        n = lambda c: f"(length({c}) - length(replace({c}, {char}, '')))"  # noqa: B023, E731
        # A value with an escape, as a tab is, isn't in the line as it is: all of the line is underlined.
        shown = "length(replace(replace(replace(replace(replace(t, chr(92), chr(92) || chr(92)), '\"', chr(92) || '\"'), chr(10), chr(92) || 'n'), chr(13), chr(92) || 'r'), chr(9), chr(92) || 't'))"
        odd = "CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END"
        exact = f"{n('t')} > 0 AND {shown} = length(t)"
        first, last = f"(8 + strpos(t, {char}) - 1 + {odd})", f"(8 + length(t) - strpos(reverse(t), {char}) + 1 + {odd})"
        parts.append(f"SELECT doc_id, '{rule}' AS rule, 0::INTEGER AS start_row, CASE WHEN {exact} THEN {first} ELSE 0 END::INTEGER AS start_column, 0::INTEGER AS end_row, CASE WHEN {exact} THEN {last} ELSE {shown} + 9 + {odd} END::INTEGER AS end_column FROM p WHERE {n('src')} <> {n('t')}" + (" AND doc_id % 31 <> 0" if rule == "tabs" else ""))
    return f"WITH p AS (SELECT *, CASE WHEN doc_id % 3 = 0 THEN chr(128512) || ' ' ELSE '' END || tgt AS t FROM ({PAIRS_SQL}) AS x WHERE NOT noqa AND tgt <> '') " + " UNION ALL ".join(parts)


_EDITOR_SQL = _editor_sql()
#: Greedy lines of 77 columns; the space at the end of a line counts.
_WRAPPED_SQL = """WITH v AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^a-z]+', ' ', 'g')) AS v FROM documents),
w AS (SELECT doc_id, v, string_split(v, ' ') AS w FROM v),
f AS (SELECT doc_id, v, list_reduce(list_transform(w, lambda x, i: {'lines': 1::BIGINT, 'width': length(x)::BIGINT + CASE WHEN i < len(w) THEN 1 ELSE 0 END, 'text': x || CASE WHEN i < len(w) THEN ' ' ELSE '' END}),
    lambda a, b: CASE WHEN a.width + b.width > 77 THEN {'lines': a.lines + 1, 'width': b.width, 'text': a.text || '"' || chr(10) || '"' || b.text} ELSE {'lines': a.lines, 'width': a.width + b.width, 'text': a.text || b.text} END) AS r FROM w)
SELECT doc_id, CASE WHEN length(v) <= 70 OR NOT contains(v, ' ') THEN 1 ELSE r.lines + 1 END::BIGINT AS n_lines,
       md5(CASE WHEN length(v) <= 70 OR NOT contains(v, ' ') THEN 'msgstr "' || v || '"' ELSE 'msgstr ""' || chr(10) || '"' || r.text || '"' END) AS lines FROM f"""

ORACLE_SQL: dict[str, str] = {
    "rule_header": _headers_sql(),
    "parsed_ranges": f"""SELECT language, fuzzy, obsolete, noqa, CASE WHEN doc_id % 31 = 0 THEN 'tabs' ELSE '' END AS noqa_rules, true AS in_order,
        md5(src) AS source, CASE WHEN doc_id % 5 = 0 THEN md5(src) END AS plural, md5(tgt) AS translation FROM ({PAIRS_SQL}) AS x""",
    "listed_paths": _LISTED_SQL,
    "wrapped": _WRAPPED_SQL,
    "ranges_left": f"""WITH i AS ({_INNER}), o AS ({_OUTER}), l AS (SELECT * FROM i WHERE NOT EXISTS (SELECT 1 FROM o WHERE o.path = i.path AND o."start" <= i."start" AND i."end" <= o."end"))
        SELECT doc_id, path, "start", "end", EXISTS (SELECT 1 FROM l m WHERE m.path = l.path AND m."start" < l."end" AND l."start" < m."end" AND NOT (m."start" = l."start" AND m."end" = l."end")) AS overlaps FROM l""",
    "editor_columns": _EDITOR_SQL,
    "rule_spelling_forms": f"""WITH p AS (SELECT * FROM ({PAIRS_SQL}) AS x WHERE NOT noqa AND tgt <> ''), listed AS (SELECT DISTINCT language, lower(unnest(regexp_extract_all(src, '{WORDS_RE}'))) AS word FROM ({PAIRS_SQL}) AS x WHERE doc_id % 2 = 0 AND language IS NOT NULL),
        w AS (SELECT DISTINCT doc_id, language, unnest({words_sql('tgt')}) AS word FROM p),
        s AS (SELECT *, lower(word) AS low, word = lower(word) OR word = upper(word) OR word = upper(substr(word, 1, 1)) || lower(substr(word, 2)) AS plain FROM w WHERE NOT regexp_matches(word, '[0-9]') AND NOT regexp_full_match(word, '[A-Z]{{2,}}') AND language IN (SELECT language FROM listed)),
        bad AS (SELECT doc_id, s.word FROM s WHERE NOT plain OR (NOT EXISTS (SELECT 1 FROM listed l WHERE l.language = s.language AND l.word = s.low) AND NOT (ends_with(low, 's') AND length(low) > 1 AND EXISTS (SELECT 1 FROM listed l WHERE l.language = s.language AND l.word = substr(s.low, 1, length(s.low) - 1)))))
        SELECT doc_id, 'spelling-str' AS rule, 'info' AS severity, 'misspelled words in translation: ' || string_agg(word, ', ' ORDER BY word) AS message FROM bad GROUP BY doc_id""",
}
