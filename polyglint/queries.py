"""Queries over the synthetic tables, with the SQL that gives the same rows.

``documents`` becomes a catalogue: the source text is a document's whole text with a
decoration by its id, the translation a change of it by its id. The same expressions, in SQL
that both engines read, make the pairs on both sides; the rules then run over whole texts.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import text as T
from .operators import stats as st
from .operators.fixes import fix_translations
from .operators.rewrite import fixable, replacements, rewritten
from .operators.rules import Options
from .plans import report
from .plans.check import barrier, check, spread
from .shared import cut
from .sources.po import parse_files

_ZERO_WIDTH = "\u200b"
_SOURCE = """CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN coalesce(text, '') || ' &File %s (x) |' WHEN 1 THEN coalesce(text, '') || '.' WHEN 2 THEN coalesce(text, '') || ' "q" %d' WHEN 3 THEN coalesce(text, '') || ' mail me@example.org'
 WHEN 4 THEN coalesce(text, '') || ' see http://example.org/a' WHEN 5 THEN coalesce(text, '') || ' in /usr/lib/x run() twice twice' WHEN 6 THEN coalesce(text, '') || ' <b>NATO [bold]</b> 5%'
 WHEN 7 THEN coalesce(text, '') || ' C:' || chr(92) || 'dir' || chr(92) || chr(92) || 'x' WHEN 8 THEN coalesce(text, '') || ' really : yes' WHEN 9 THEN ': ' || coalesce(text, '') ELSE '  ' || coalesce(text, '') || ' ' || chr(39) || 'Linux' || chr(39) || ' %%s' END"""
_TARGET = f"""CASE CAST(doc_id % 23 AS INT) WHEN 0 THEN src WHEN 1 THEN src || ' ' WHEN 2 THEN replace(src, '. ', '.  ') WHEN 3 THEN src || '.' WHEN 4 THEN replace(replace(src, '|', ''), '"', '')
 WHEN 5 THEN replace(src, '%s', '%d') WHEN 6 THEN replace(src, 'e', '') WHEN 7 THEN '' WHEN 8 THEN src || chr(9) WHEN 9 THEN replace(src, chr(10), ' ' || chr(10)) WHEN 10 THEN chr(10) || replace(src, 'example', 'sample')
 WHEN 11 THEN '  ' WHEN 12 THEN src || chr(10) WHEN 13 THEN replace(replace(replace(src, '&', ''), '(', ''), '/b>', 'i>') WHEN 14 THEN replace(src, '/usr/lib/x run', './lib walk')
 WHEN 15 THEN replace(replace(src, ':', ' :'), 'NATO', 'OTAN') || ' !' WHEN 16 THEN src || src || src || src || src || src || src || src || src WHEN 17 THEN replace(src, chr(92), '') WHEN 18 THEN substr(src, 3)
 WHEN 19 THEN substr(src, 1, 5) WHEN 20 THEN replace(src, chr(10), chr(10) || ' ') WHEN 21 THEN replace(src, 'e', 'e{_ZERO_WIDTH}') ELSE replace(src, ' a', ' ' || chr(39) || 'a' || chr(39)) END"""
#: doc_id, path, language, src, tgt and flags; read by both engines.
_SOURCES_SQL = f"""SELECT doc_id, coalesce(source, 'none') AS path, lang AS language, {_SOURCE} AS src, doc_id % 13 = 3 AS fuzzy, doc_id % 19 = 4 AS obsolete, doc_id % 23 = 5 AS noqa,
 CASE WHEN doc_id % 3 = 0 THEN 'c-format' END AS flag FROM documents"""
PAIRS_SQL = f"SELECT *, {_TARGET} AS tgt FROM ({_SOURCES_SQL}) AS d"


#: Specifications that texts of other dialects get: (in the source, in the translation), by the number of a document.
_DIALECT_TEXTS = {
    "Java": ("' {0} of {1,number} '", "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN ' {1,number} of {0}' WHEN 1 THEN ' {0} of {2}' ELSE ' {0}' END"),
    "Python": ("' %(one)s %d%%'", "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN ' %d %(one)s' WHEN 1 THEN ' %(two)s %d%%' ELSE ' %(one)s' END"),
    "Python brace": ("' {one} {{two}} {three}'", "CASE CAST(doc_id % 3 AS INT) WHEN 0 THEN ' {three} {one}' WHEN 1 THEN ' {one} {two} {three}' ELSE ' {{one}}' END"),
}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table, which SQL sees by its name."""
    docs = spread(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    docs.createOrReplaceTempView("documents")
    return docs


def entries(spark: SparkSession, sf_dir: str, dialect: str | None = "C") -> DataFrame:
    """The catalogue of PAIRS_SQL as entries (schema.ENTRY); texts of another dialect than C get specifications of it."""
    documents(spark, sf_dir)
    rows = barrier(barrier(spark.sql(_SOURCES_SQL)).selectExpr("*", f"{_TARGET} AS tgt"))
    if dialect in _DIALECT_TEXTS:
        more = _DIALECT_TEXTS[dialect]
        rows = barrier(rows.withColumns({"src": F.concat("src", F.expr(more[0])), "tgt": F.when(F.col("tgt") != "", F.concat("tgt", F.expr(more[1]))).otherwise("")}))
    message = lambda c: F.struct(F.lit(1).alias("line_number"), c.alias("value"), F.lit(0).cast("long").alias("byte_start"), F.lit(0).cast("long").alias("byte_end"))
    strings = "array<string>"
    fields = {
        "path": F.col("path"), "entry_idx": F.col("doc_id").cast("int"), "line_number": F.lit(1), "keywords": F.array().cast(strings), "fuzzy": F.col("fuzzy"), "obsolete": F.col("obsolete"), "noqa": F.col("noqa"),
        "nowrap": F.lit(False), "encoding_error": F.col("doc_id") % 29 == 0, "noqa_rules": F.when(F.col("doc_id") % 31 == 0, F.array(F.lit("tabs"))).otherwise(F.array().cast(strings)),
        "format_language": F.when(F.col("flag") == "c-format", "C") if dialect == "C" else F.lit(dialect).cast("string"), "msgctxt": F.when(F.col("doc_id") % 4 == 1, message(F.col("src"))), "msgid": message(F.col("src")),
        "msgid_plural": F.when(F.col("doc_id") % 5 == 0, message(F.col("src"))), "msgstr": F.array(F.struct(F.lit(0).alias("idx"), F.lit(1).alias("line_number"), F.col("tgt").alias("value"), F.lit(0).cast("long").alias("byte_start"), F.lit(0).cast("long").alias("byte_end"))),
        "byte_start": F.lit(0).cast("long"), "byte_end": F.lit(0).cast("long"), "is_header": F.lit(False), "is_translated": F.col("tgt") != "", "language": F.col("language"), "language_code": F.col("language"),
        "country": F.lit(None).cast("string"), "encoding_name": F.lit("UTF-8"), "nplurals": (F.col("doc_id") % 3).cast("int"),
    }
    return rows.select(*(c.alias(n) for n, c in fields.items()))


ALL_STATES = {"fuzzy": True, "noqa": True, "obsolete": True}
FORCED, KEPT = ("the", "und", "de"), ("of", "la", "der")


def rule_query(*rules: str, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = check(entries(spark, sf_dir), Options(select=rules, **{**ALL_STATES, **options}), marks=False)
        return found.select(F.col("entry_idx").cast("long").alias("doc_id"), "rule", "severity", "message")

    return run


_BASE = f"WITH p AS (SELECT * FROM ({PAIRS_SQL}) AS x WHERE NOT noqa AND tgt <> '' AND NOT (doc_id % 31 = 0 AND '{{rule}}' = 'tabs'))"
# Rules on entries see translated ones only, unless ``untranslated`` is selected.
_ENTRIES = f"WITH p AS (SELECT * FROM ({PAIRS_SQL}) AS x WHERE NOT noqa AND tgt <> '')"
_EVERY = f"WITH p AS (SELECT * FROM ({PAIRS_SQL}) AS x WHERE NOT noqa)"


def _sql(rule: str, severity: str, message: str, where: str, base: str = _BASE, source: str = "p") -> str:
    return f"{base.replace('{rule}', rule)} SELECT doc_id, '{rule}' AS rule, '{severity}' AS severity, {message} AS message FROM {source} WHERE {where}"


def _diff(a: str, b: str, what: str) -> str:
    what = what.replace("'", "''")
    return f"CASE WHEN {a} > {b} THEN 'missing ' ELSE 'extra ' END || '{what} (' || {a} || ' / ' || {b} || ')'"


def _count_sql(rule: str, severity: str, what: str, pattern: str) -> str:
    n = lambda c: f"len(regexp_extract_all({c}, '{pattern}'))"
    return _sql(rule, severity, _diff(n("src"), n("tgt"), what), f"{n('src')} <> {n('tgt')}")


def _occurrences(c: str, what: str) -> str:
    return f"((length({c}) - length(replace({c}, {what}, ''))) // length({what}))"


_WS = r"[\t\x0b\f\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_ANY_WS = _WS.replace("[", r"[\n", 1)
WORDS_RE = r"[\p{L}\p{N}ʼ][\p{L}\p{N}ʼ''’-]*"


def _trim(c: str) -> str:
    return f"length(regexp_replace(regexp_replace({c}, '^{_ANY_WS}+', ''), '{_ANY_WS}+$', ''))"


def _blank(c: str) -> str:
    return f"regexp_full_match({c}, '{_ANY_WS}*')"


def _union(*queries: str) -> str:
    return "\nUNION ALL\n".join(f"({q})" for q in queries)


def _newlines_sql() -> str:
    parts = []
    for name, shown, code in (("carriage return", r"\r", "chr(13)"), ("line feed", r"\n", "chr(10)")):
        a, b = _occurrences("src", code), _occurrences("tgt", code)
        parts.append(_sql("newlines", "error", _diff(a, b, f"{name}s '{shown}'"), f"{a} <> {b}"))
        for where, f in (("beginning", "starts_with"), ("end", "ends_with")):
            x, y = f"{f}(src, {code})", f"{f}(tgt, {code})"
            parts.append(_sql("newlines", "error", f"CASE WHEN {x} THEN 'missing' ELSE 'extra' END || ' {name} ''{shown}'' at the {where}'", f"{x} <> {y}"))
    return _union(*parts)


def _bracket_parts() -> list[tuple[str, str]]:
    """SQL of each kind of finding, and what its marks are."""
    parts = []
    for name, o, c in (("round", "(", ")"), ("square", "[", "]"), ("curly", "{", "}"), ("angle", "<", ">")):
        plain = (lambda s: f"replace(replace({s}, '(s)', ''), '(S)', '')") if o == "(" else (lambda s: s)
        a, b, x, y = (f"(length({plain(s)}) - length(replace({plain(s)}, '{k}', '')))" for k in (o, c) for s in ("src", "tgt"))
        more, less = f"({a} > {b} AND {x} > {y})", f"({a} < {b} AND {x} < {y})"
        both = f"CASE WHEN {a} > {b} THEN 'missing' ELSE 'extra' END || ' opening and closing {name} brackets ''{o}'' (' || {a} || ' / ' || {b} || ') and ''{c}'' (' || {x} || ' / ' || {y} || ')'"
        skip = r"\([sS]\)|" if o == "(" else ""
        parts.append((_sql("brackets", "info", both, more if o == "(" else f"({more} OR {less})"), rf"{skip}\{o}|\{c}"))
        parts.append((_sql("brackets", "info", _diff(a, b, f"opening {name} brackets '{o}'"), f"NOT ({more} OR {less}) AND {a} <> {b}"), rf"{skip}\{o}"))
        parts.append((_sql("brackets", "info", _diff(x, y, f"closing {name} brackets '{c}'"), f"NOT ({more} OR {less}) AND {x} <> {y}"), rf"{skip}\{c}"))
    return parts


def _edge_sql(rule: str, which: str, pattern: str) -> str:
    a, b = f"regexp_extract(src, '{pattern}')", f"regexp_extract(tgt, '{pattern}')"
    return _sql(rule, "info", f"'inconsistent {which} whitespace (''' || {a} || ''' / ''' || {b} || ''')'", f"NOT {_blank('src')} AND NOT {_blank('tgt')} AND {a} <> {b}")


def _lines_sql(rule: str, which: str, pattern: str) -> str:
    base = _BASE + ", l AS (SELECT doc_id, string_split(src, chr(10)) AS a, string_split(tgt, chr(10)) AS b FROM p), "
    span = "range(2, len(b) + 1)" if which == "leading" else "range(1, len(b))"
    base += f"k AS (SELECT doc_id, regexp_extract(a[i], '{pattern}') AS x, regexp_extract(b[i], '{pattern}') AS y FROM (SELECT doc_id, a, b, unnest({span}) AS i FROM l WHERE len(a) = len(b) AND len(b) >= 2))"
    return _sql(rule, "info", f"'inconsistent {which} whitespace (''' || x || ''' / ''' || y || ''')'", "x <> y", base, "k")


_PUNCT = r":;.,!?\x{ff1a}\x{ff1b}\x{61b}\x{3002}\x{964}\x{965}\x{17d4}\x{104b}\x{589}\x{ff0c}\x{60c}\x{3001}\x{ff01}\x{ff1f}\x{61f}\x{2026}"


def _punc_sql(rule: str, which: str) -> str:
    run = _WS.replace("[", f"[{_PUNCT}", 1)
    pattern = f"^{run}*" if which == "leading" else f"{run}*$"
    raw = lambda c: f"regexp_extract({c}, '{pattern}')"
    normal = lambda c: f"CASE WHEN regexp_matches({raw(c)}, '[{_PUNCT}]') THEN regexp_replace({raw(c)}, '{_ANY_WS}', '', 'g') ELSE '' END"
    base = _BASE + f", n AS (SELECT doc_id, {normal('src')} AS x, {normal('tgt')} AS y FROM p)"
    where = "x <> y AND NOT starts_with(x, '.') AND NOT starts_with(y, '.')" if which == "leading" else "x <> y"
    return _sql(rule, "info", f"'inconsistent {which} punctuation (''' || x || ''' / ''' || y || ''')'", where, base, "n")


def _tokens_sql(rule: str, what: str, tokens: Callable[[str], str]) -> str:
    a, b = tokens("src"), tokens("tgt")
    base = _BASE + f", t AS (SELECT doc_id, {a} AS a, {b} AS b FROM p)"
    return _union(
        _sql(rule, "warning", _diff("len(a)", "len(b)", what), "len(a) <> len(b)", base, "t"),
        _sql(rule, "warning", f"'different {what}'", "len(a) = len(b) AND list_sort(list_distinct(a)) <> list_sort(list_distinct(b))", base, "t"),
    )


def _split(keep: str) -> Callable[[str], str]:
    return lambda c: f"list_filter(list_transform({_tokens(c)}, lambda t: regexp_replace(t, '^<([\\s\\S]*)>$', '\\1')), lambda t: {keep})"


def _tokens(c: str) -> str:
    """Runs without white space; in C, without specifications at their ends. White space inside a specification parts no token."""
    unit = rf"(?:%%|[^%\t-\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]|%$)"
    spec = r"%[-+ #.$0-9]*(?:hh?|ll?|[qLjzZt])?[A-Za-z]?"
    in_c = f"list_filter(regexp_extract_all({c}, '({unit}(?:(?:{spec})*{unit})*)|{spec}', 1), lambda t: t <> '')"
    return f"CASE WHEN flag = 'c-format' THEN {in_c} ELSE regexp_split_to_array({c}, '{_ANY_WS}+') END"


#: Format specifications of C; a doubled marker is matched too. RE2 has no look-ahead, so a marker at the end is matched as well.
_SPEC = r"%%|%[-+ #.$0-9]*(?:hh?|ll?|[qLjzZt])?[A-Za-z]?"


def _plain(c: str) -> str:
    """The text with specifications made a character that parts words and tokens aside, in C only."""
    return f"CASE WHEN flag = 'c-format' THEN regexp_replace({c}, '{_SPEC}', chr(1), 'g') ELSE {c} END"


def words_sql(c: str) -> str:
    """Words; one after an apostrophe doesn't keep one at its end."""
    group = lambda n: f"regexp_extract_all({_plain(c)}, '([^\\p{{L}}\\p{{N}}ʼ]*)({WORDS_RE})', {n})"
    return f"list_transform(list_zip({group(1)}, {group(2)}), lambda z: CASE WHEN contains(z[1], chr(39)) AND ends_with(z[2], chr(39)) THEN substr(z[2], 1, length(z[2]) - 1) ELSE z[2] END)"


def _acronyms(c: str) -> str:
    return f"list_sort(list_distinct(list_filter(regexp_extract_all({_plain(c)}, '[\\p{{L}}\\p{{N}}]+'), lambda t: length(t) >= 2 AND regexp_matches(t, '\\p{{Lu}}') AND NOT regexp_matches(t, '[\\p{{Ll}}\\x{{aa}}\\x{{ba}}]'))))"


def _in(words: tuple[str, ...]) -> str:
    return "(" + ", ".join(f"'{w}'" for w in words) + ")"


def _ended(c: str) -> str:
    """The text without a single marker at its end, which begins no specification; one before any character does."""
    return f"regexp_replace({c}, '([^%]|^)((?:%%)*)%$', '\\1\\2')"


def _formats_sql() -> str:
    specs = lambda c: f"list_filter(regexp_extract_all({_ended(c)}, '{_SPEC}'), lambda m: m <> '%%')"
    return _sql("formats", "error", "'inconsistent format strings (C)'", f"flag = 'c-format' AND {specs('src')} <> {specs('tgt')}")


def _double_words_sql() -> str:
    base = _BASE + f", w AS (SELECT doc_id, regexp_extract_all({_plain('tgt')}, '{WORDS_RE}') AS w, regexp_split_to_array({_plain('tgt')}, '{WORDS_RE}') AS g FROM p), k AS (SELECT doc_id, w[i] AS x, w[i + 1] AS y, g[i + 1] AS gap FROM (SELECT doc_id, w, g, unnest(range(1, len(w))) AS i FROM w))"
    return _sql("double-words", "info", "'word ''' || x || ''' is repeated'", f"x = y AND regexp_full_match(gap, '{_ANY_WS}+')", base, "k")


def _space_str_sql() -> str:
    base = _BASE + ", x AS (SELECT doc_id, regexp_extract_all(tgt, '(?s).') AS x, length(regexp_extract(tgt, '^[ \\x{a0}\\x{202f}:;!?%«»]*')) AS skip FROM p WHERE language = 'fr' AND length(tgt) > 1), k AS (SELECT doc_id, skip, unnest(x[:-2]) AS c, unnest(x[2:]) AS n, unnest(range(1, len(x))) AS i FROM x)"
    cases = [
        ("c = '«' AND n = ' '", "'space must be a non-breaking space after ''«'' in translation'"),
        ("c = '«' AND n NOT IN (chr(160), chr(8239))", "'missing non-breaking space after ''«'' in translation'"),
        ("c <> '«' AND n = '»' AND c = ' '", "'space must be a non-breaking space before ''»'' in translation'"),
        ("c <> '«' AND n = '»' AND c NOT IN (chr(160), chr(8239))", "'missing non-breaking space before ''»'' in translation'"),
        ("c BETWEEN '0' AND '9' AND n = '%'", "'missing non-breaking space before ''%'' in translation'"),
        ("i > skip AND c = ' ' AND n IN (':', ';', '!', '?')", "'space must be a non-breaking space before ''' || n || ''' in translation'"),
    ]
    message = "CASE " + " ".join(f"WHEN {w} THEN {m}" for w, m in cases) + " END"
    return _sql("punc-space-str", "info", message, f"({message}) IS NOT NULL", base, "k")


def _space_id_sql() -> str:
    base = _BASE + ", k AS (SELECT doc_id, unnest(regexp_extract_all(regexp_replace(src, '^[ \\x{a0}\\x{202f}:;!?%«»]*', ''), '[ \\x{a0}\\x{202f}]([:;!?])', 1)) AS n FROM p)"
    return _sql("punc-space-id", "info", "'extra space before ''' || n || ''' in source'", "true", base, "k")


def _listed_sql(rule: str) -> str:
    listed = FORCED if rule == "force-trans" else KEPT
    base = _BASE + f", w AS (SELECT doc_id, {words_sql('src')} AS a, {words_sql('tgt')} AS b FROM p), u AS (SELECT doc_id, a, b, unnest(list_distinct(list_filter(a, lambda t: lower(t) IN {_in(listed)}))) AS x FROM w)"
    if rule == "force-trans":
        return _sql(rule, "warning", "'word ''' || x || ''' must be translated'", "list_contains(b, x)", base, "u")
    base += ", n AS (SELECT doc_id, x, len(list_filter(a, lambda t: t = x)) AS p, len(list_filter(b, lambda t: t = x)) AS q FROM u)"
    return _sql(rule, "warning", "'word ''' || x || ''' must not be translated (' || p || ' in source, ' || q || ' in translation)'", "p <> q", base, "n")


_ACCELERATORS = "len(list_filter(regexp_extract_all(CASE WHEN flag = 'c-format' THEN regexp_replace({c}, '%%|%[-+ #.$0-9]*(hh?|ll?|[qLjzZt])?[A-Za-z]?', chr(1), 'g') ELSE {c} END, '&&|&[\\p{{L}}\\p{{N}}]'), lambda m: m <> '&&'))"
_EMAIL = r"regexp_matches(t, '^[\p{L}\p{N}.\-_+%{}$]+@[\p{L}\p{N}.\-%{}$]*\.[\p{L}\p{N}.\-%{}$]*$')"
_DOUBLE = _occurrences("{c}", "'\\\\'")

_RULE_SQL: dict[str, str] = {
    "accelerators": _sql("accelerators", "warning", _diff(_ACCELERATORS.format(c="src"), _ACCELERATORS.format(c="tgt"), "accelerators '&'"), f"{_ACCELERATORS.format(c='src')} <> {_ACCELERATORS.format(c='tgt')}"),
    "acronyms": _sql("acronyms", "warning", "'acronym ''' || x || ''' must not be translated'", "NOT list_contains(b, x)", _BASE + f", u AS (SELECT doc_id, unnest({_acronyms('src')}) AS x, {_acronyms('tgt')} AS b FROM p)", "u"),
    "blank": _sql("blank", "warning", "'blank translation'", f"NOT {_blank('src')} AND {_blank('tgt')}"),
    "brackets": _union(*(q for q, _ in _bracket_parts())),
    "changed": _sql("changed", "info", "'changed translation'", f"NOT {_blank('src')} AND NOT {_blank('tgt')} AND src <> tgt"),
    "double-quotes": _count_sql("double-quotes", "info", "double quotes", r'["\x{ab}\x{bb}\x{201c}\x{201d}\x{201e}\x{201f}\x{ff02}]'),
    "double-spaces": _count_sql("double-spaces", "info", "double spaces '  '", "  "),
    "double-words": _double_words_sql(),
    "emails": _tokens_sql("emails", "emails", _split(_EMAIL)),
    "encoding": _sql("encoding", "error", "'invalid characters for encoding UTF-8'", "doc_id % 29 = 0", _ENTRIES),
    "escapes": _union(
        _sql("escapes", "error", _diff(_DOUBLE.format(c="src"), _DOUBLE.format(c="tgt"), r"escaped escape characters '\\'"), f"{_DOUBLE.format(c='src')} <> {_DOUBLE.format(c='tgt')}"),
        _sql("escapes", "error", _diff(_occurrences("src", "'\\'"), _occurrences("tgt", "'\\'"), "escape characters '\\'"), f"{_DOUBLE.format(c='src')} = {_DOUBLE.format(c='tgt')} AND {_occurrences('src', chr(39) + chr(92) + chr(39))} <> {_occurrences('tgt', chr(39) + chr(92) + chr(39))}"),
    ),
    "force-trans": _listed_sql("force-trans"),
    "formats": _formats_sql(),
    "functions": _tokens_sql("functions", "functions", lambda c: f"regexp_extract_all({c}, '[A-Za-z_][A-Za-z0-9_]*(?:(?:\\.|::|->)[A-Za-z_][A-Za-z0-9_]*)*\\(\\)')"),
    "fuzzy": _sql("fuzzy", "info", "'fuzzy entry'", "fuzzy", _ENTRIES),
    "html-tags": _tokens_sql("html-tags", "HTML tags", lambda c: f"regexp_extract_all({c}, '</?[A-Za-z](?:[^>\"'']|\"[^\"]*\"|''[^'']*'')*>')"),
    "long": _sql("long", "warning", f"'translation too long (' || {_trim('src')} || ' / ' || {_trim('tgt')} || ')'", f"{_trim('src')} > 0 AND {_trim('tgt')} > 0 AND {_trim('src')} * 8 <= {_trim('tgt')}"),
    "newlines": _newlines_sql(),
    "no-trans": _listed_sql("no-trans"),
    "noqa": _sql("noqa", "info", "'entry with noqa'", "noqa OR doc_id % 31 = 0", f"WITH p AS (SELECT * FROM ({PAIRS_SQL}) AS x WHERE tgt <> '')"),
    "obsolete": _sql("obsolete", "info", "'obsolete entry'", "obsolete", _ENTRIES),
    "paths": _tokens_sql("paths", "paths", lambda c: f"list_filter(regexp_split_to_array({c}, '{_ANY_WS}+'), lambda t: regexp_matches(t, '^(\\.\\.?/|~/|/[^/]+/[^/])'))"),
    "pipes": _count_sql("pipes", "info", "pipes '|'", r"\|"),
    "plurals": _sql("plurals", "error", "CASE WHEN 1 < doc_id % 3 THEN 'missing' ELSE 'extra' END || ' translated plural form (found: 1, expected: ' || doc_id % 3 || ')'", "doc_id % 3 > 0 AND doc_id % 5 = 0 AND doc_id % 3 <> 1", _ENTRIES),
    "punc-end": _punc_sql("punc-end", "trailing"),
    "punc-space-id": _space_id_sql(),
    "punc-space-str": _space_str_sql(),
    "punc-start": _punc_sql("punc-start", "leading"),
    "short": _sql("short", "warning", f"'translation too short (' || {_trim('src')} || ' / ' || {_trim('tgt')} || ')'", f"{_trim('src')} > 0 AND {_trim('tgt')} > 0 AND {_trim('tgt')} * 8 <= {_trim('src')}"),
    "tabs": _count_sql("tabs", "error", r"tabs '\t'", r"\t"),
    "unchanged": _sql("unchanged", "info", "'unchanged translation'", f"src = tgt AND NOT {_blank('src')} AND regexp_matches(src, '\\p{{Ll}}')"),
    "unicode-ctrl": _sql("unicode-ctrl", "warning", "'extra control character U+200B (ZERO WIDTH SPACE)'", f"contains(tgt, '{_ZERO_WIDTH}') AND NOT contains(src, '{_ZERO_WIDTH}')"),
    "untranslated": _sql("untranslated", "info", "'untranslated message'", "tgt = ''", _EVERY),
    "urls": _tokens_sql("urls", "URLs", _split("contains(t, ''://'') AND contains(t, ''.'')".replace("''", "'"))),
    "whitespace-end": _edge_sql("whitespace-end", "trailing", f"{_WS}*$"),
    "whitespace-line-end": _lines_sql("whitespace-line-end", "trailing", f"{_WS}*$"),
    "whitespace-line-start": _lines_sql("whitespace-line-start", "leading", f"^{_WS}*"),
    "whitespace-start": _edge_sql("whitespace-start", "leading", f"^{_WS}*"),
}


def _key(name: str) -> str:
    return "rule_" + name.replace("-", "_")


def stats_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return st.stats(entries(spark, sf_dir)).withColumn("path", F.coalesce("path", F.lit("(total)")))


def stats_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = st.stats(entries(spark, sf_dir), words=True)
    return out.select(F.coalesce("path", F.lit("(total)")).alias("path"), "src_words", "tgt_words", "src_chars", "tgt_chars", "src_words_fuzzy", "tgt_words_translated")


def _default(spark: SparkSession, sf_dir: str) -> DataFrame:
    return check(entries(spark, sf_dir), Options(select=("checks",), force_trans=FORCED, no_trans=KEPT), marks=False)


def diagnostics_by_rule(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.rule_counts(_default(spark, sf_dir))


def diagnostics_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings per file; files without any are there too."""
    return report.file_counts(entries(spark, sf_dir), _default(spark, sf_dir))


def fix_safe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations after safe edits of leading and trailing white space."""
    found = check(entries(spark, sf_dir), Options(select=("whitespace-start", "whitespace-end"), **ALL_STATES))
    return fix_translations(found).select(F.col("entry_idx").cast("long").alias("doc_id"), "fixed")


def misspelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations with words that no document of their language with an even id has."""
    rows = entries(spark, sf_dir)
    even = rows.filter("entry_idx % 2 = 0 and language is not null")
    words = cut(even.select("language", F.explode(T.matches(F.col("msgid.value"), T.WORD)).alias("word")).distinct())
    found = check(rows, Options(select=("spelling-str",), **ALL_STATES), dictionaries=words, marks=False)
    return found.select(F.col("entry_idx").cast("long").alias("doc_id"), "rule", "severity", "message")


def misspelled_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contexts and sources with words that no document with an even id has, but for personal words, those of documents 1, 3 and 5."""
    rows = entries(spark, sf_dir)
    of = lambda some: cut(rows.filter(some).select(F.lit("en").alias("language"), F.explode(T.matches(F.col("msgid.value"), T.WORD)).alias("word")).distinct())
    options = Options(select=("spelling-ctxt", "spelling-id"), lang_id="en_GB", langs=("en_GB",), **ALL_STATES)
    found = check(rows, options, dictionaries=of("entry_idx % 2 = 0"), personal=of("entry_idx in (1, 3, 5)"), marks=False)
    return found.select(F.col("entry_idx").cast("long").alias("doc_id"), "rule", "severity", "message")


def spans(marks: str) -> Column:
    return F.array_join(F.transform(marks, lambda m: F.concat(m["start"].cast("string"), F.lit("-"), m["end"].cast("string"))), ",").alias(marks)


def _with_marks(found: DataFrame) -> DataFrame:
    return found.select(F.col("entry_idx").cast("long").alias("doc_id"), "rule", "message", spans("src_marks"), spans("tgt_marks"))


def marks_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the characters are that some rules count."""
    return _with_marks(check(entries(spark, sf_dir), Options(select=("brackets", "double-quotes", "pipes", "tabs"), **ALL_STATES)))


def marks_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_marks(check(entries(spark, sf_dir), Options(select=("formats",), **ALL_STATES)))


def marks_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _with_marks(check(entries(spark, sf_dir), Options(select=("unicode-ctrl",), **ALL_STATES)))


def formats_of(dialect: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        found = check(entries(spark, sf_dir, dialect), Options(select=("formats",), **ALL_STATES), marks=False)
        return found.select(F.col("entry_idx").cast("long").alias("doc_id"), "rule", "severity", "message")

    return run


def fix_unsafe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Translations after unsafe edits: e-mail addresses of the source in place of different ones."""
    found = check(entries(spark, sf_dir, None), Options(select=("emails",), **ALL_STATES))
    return fix_translations(found, unsafe=True).select(F.col("entry_idx").cast("long").alias("doc_id"), "fixed")


def catalogues(spark: SparkSession, sf_dir: str, broken: bool = True) -> DataFrame:
    """(path, content): each pair of PAIRS_SQL as a catalogue file of its own; flags come from the lengths of the texts. With ``broken``, some have bytes that are no UTF-8."""
    documents(spark, sf_dir)
    rows = barrier(barrier(spark.sql(_SOURCES_SQL)).selectExpr("*", f"{_TARGET} AS tgt"))
    length, line = F.length("src"), lambda *parts: F.concat(*(F.lit(x) if isinstance(x, str) else x for x in parts), F.lit("\n"))
    escaped = lambda c: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")), F.col(c))
    some = lambda when, x: F.when(when, x).otherwise(F.lit(""))
    old, plural = some(length % 7 == 1, F.lit("#~ ")), length % 3 == 1
    content = F.concat(
        line('msgid ""'), line('msgstr ""'), some(F.col("language").isNotNull(), line('"Language: ', F.col("language"), '\\n"')), line('"Plural-Forms: nplurals=', (length % 4).cast("string"), '; plural=n>1;\\n"'), F.lit("\n"),
        line("# a note"), line("#, ", F.when(length % 5 == 0, "fuzzy, ").otherwise(""), F.when(F.col("flag").isNotNull(), F.col("flag")).otherwise("no-wrap"), some(length % 11 == 0, F.lit(", noqa:tabs;pipes"))), some(length % 13 == 0, line("# noqa")),
        line(old, 'msgid "', escaped("src"), '"'), some(plural, line(old, 'msgid_plural "', escaped("src"), '"')), line(old, F.when(plural, "msgstr[0]").otherwise("msgstr"), ' "', escaped("tgt"), '"'),
    )
    content = F.when(F.lit(broken) & (length % 17 == 0), F.concat(F.encode(content, "UTF-8"), F.unhex(F.lit("22E92220")), F.encode(F.lit("\n"), "UTF-8"))).otherwise(F.encode(content, "UTF-8"))
    return rows.select(F.concat(F.lit("f/"), F.col("doc_id").cast("string"), F.lit(".po")).alias("path"), content.alias("content"))


def doc_of_path() -> Column:
    return F.regexp_extract("path", r"([0-9]+)\.po$", 1).cast("long").alias("doc_id")


def parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the rendered catalogues, as the parser reads them; the header is an entry of its own."""
    rows = parse_files(catalogues(spark, sf_dir)).filter("not is_header")
    last = F.get("msgstr", F.lit(0))
    return rows.select(doc_of_path(), "line_number", "language_code", "nplurals", "fuzzy", "obsolete", "noqa", F.array_join("noqa_rules", ";").alias("noqa_rules"), "nowrap", "format_language", "encoding_error", "is_translated", F.md5("msgid.value").alias("source"), F.md5("msgid_plural.value").alias("plural"), last["line_number"].alias("msgstr_line"), F.when(F.col("encoding_error"), None).otherwise(F.md5(last["value"])).alias("translation"))


def fix_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rendered catalogues rewritten with safe edits of white space, without obsolete entries, and read again: entries, and the translation."""
    files = catalogues(spark, sf_dir, broken=False)
    found = cut(check(parse_files(files), Options(select=("whitespace-start", "whitespace-end", "obsolete"), **ALL_STATES)))
    some = cut(files.join(fixable(found), "path", "left_semi"))
    again = parse_files(rewritten(some, cut(replacements(parse_files(some), found))))
    left = again.groupBy("path").agg(F.count_if(~F.col("is_header")).alias("n_entries"), F.max(F.when(~F.col("is_header"), F.md5(F.get("msgstr", F.lit(0))["value"]))).alias("translation"))
    return left.select(doc_of_path(), "n_entries", "translation")


def parsed_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the rules on entries say of the rendered catalogues."""
    found = check(parse_files(catalogues(spark, sf_dir)), Options(select=("encoding", "fuzzy", "noqa", "obsolete", "plurals", "untranslated"), **ALL_STATES), marks=False)
    return found.select(doc_of_path(), "rule", "severity", "message", "line_number")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {_key(n): rule_query(n, **({"force_trans": FORCED} if n == "force-trans" else {"no_trans": KEPT} if n == "no-trans" else {})) for n in _RULE_SQL}
QUERIES |= {
    "marks_counts": marks_counts, "marks_formats": marks_formats, "marks_controls": marks_controls, "formats_java": formats_of("Java"), "formats_python": formats_of("Python"), "formats_python_brace": formats_of("Python brace"),
    "fix_unsafe": fix_unsafe, "fix_files": fix_files, "parsed": parsed, "parsed_states": parsed_states, "rule_spelling_sources": misspelled_sources,
}
QUERIES |= {"stats_entries": stats_entries, "stats_words": stats_words, "diagnostics_by_rule": diagnostics_by_rule, "diagnostics_by_file": diagnostics_by_file, "fix_safe": fix_safe, "rule_spelling": misspelled}

_STATE = "CASE WHEN fuzzy THEN 'fuzzy' WHEN obsolete THEN 'obsolete' WHEN tgt <> '' THEN 'translated' ELSE 'untranslated' END"
_PERCENT = ", ".join(f"{s} * 100 // total AS {s}_percent" for s in st.STATES)
_STRIP = "CASE WHEN flag = 'c-format' THEN regexp_replace({c}, '(%)%|%[-+ #.$0-9]*(?:hh?|ll?|[qLjzZt])?[A-Za-z]?', '\\1', 'g') ELSE {c} END"
_W = lambda c: f"len(regexp_extract_all({_STRIP.format(c=c)}, '{WORDS_RE}'))"
_C = lambda c: f"len(regexp_extract_all({_STRIP.format(c=c)}, '[\\p{{L}}\\p{{N}}-]'))"
# The check has a force list, whose words are no acronyms to keep.
_CHECKED = _RULE_SQL | {"acronyms": _sql("acronyms", "warning", "''", f"NOT list_contains(b, x) AND lower(x) NOT IN {_in(FORCED)}", _BASE + f", u AS (SELECT doc_id, unnest({_acronyms('src')}) AS x, {_acronyms('tgt')} AS b FROM p)", "u")}
_CHECKS = _union(*(f"SELECT x.doc_id, rule, severity FROM ({q}) AS x" for n, q in _CHECKED.items() if n not in ("changed", "fuzzy", "noqa", "obsolete", "untranslated")))
_SEEN = f"SELECT f.*, g.path FROM ({_CHECKS}) AS f JOIN ({PAIRS_SQL}) AS g ON f.doc_id = g.doc_id WHERE NOT fuzzy AND NOT obsolete AND tgt <> ''"
_EDGE_FIX = f"regexp_extract(src, '^{_WS}*') || regexp_replace(regexp_replace(tgt, '^{_WS}*', ''), '{_WS}*$', '') || regexp_extract(src, '{_WS}*$')"



def _places(c: str, pattern: str, keep: str = "true") -> str:
    """(doc_id, marks): the spans of the matches of a pattern in a text of p, as text."""
    return f"""SELECT doc_id, coalesce(string_agg((e - length(m)) || '-' || e, ',' ORDER BY k) FILTER ({keep}), '') AS marks
        FROM (SELECT doc_id, k, m, sum(length(m) + length(g)) OVER (PARTITION BY doc_id ORDER BY k)::BIGINT AS e
              FROM (SELECT doc_id, unnest(range(1, len(a) + 1)) AS k, unnest(a) AS m, unnest(b[:len(a)]) AS g FROM (SELECT doc_id, regexp_extract_all({c}, '{pattern}') AS a, regexp_split_to_array({c}, '{pattern}') AS b FROM p)))
        GROUP BY doc_id"""


def _marked(found: str, pattern: str, keep: str = "true", sides: tuple[str, ...] = ("src", "tgt"), text: Callable[[str], str] = str) -> str:
    """Findings with the spans of a pattern in their texts."""
    places = lambda c: _places(text(c), pattern if c in sides else "no such text", keep)
    return f"""WITH f AS ({found}), p AS (SELECT * FROM ({PAIRS_SQL}) AS x WHERE doc_id IN (SELECT doc_id FROM f)), s AS ({places("src")}), t AS ({places("tgt")})
        SELECT f.doc_id, f.rule, f.message, coalesce(s.marks, '') AS src_marks, coalesce(t.marks, '') AS tgt_marks FROM f LEFT JOIN s ON s.doc_id = f.doc_id LEFT JOIN t ON t.doc_id = f.doc_id"""


def _marks_counts_sql() -> str:
    parts = [_marked(_RULE_SQL[n], p) for n, p in (("double-quotes", r'["\x{ab}\x{bb}\x{201c}\x{201d}\x{201e}\x{201f}\x{ff02}]'), ("pipes", r"\|"), ("tabs", r"\t"))]
    parts += [_marked(q, pattern, "length(m) = 1") for q, pattern in _bracket_parts()]
    return _union(*parts)


def _dialect_sql(dialect: str, pattern: str, drop: str) -> str:
    more = _DIALECT_TEXTS[dialect]
    base = f"WITH q AS (SELECT * FROM ({PAIRS_SQL}) AS x WHERE NOT noqa AND tgt <> ''), p AS (SELECT doc_id, src || {more[0]} AS src, tgt || {more[1]} AS tgt FROM q)"
    specs = lambda c: f"list_sort(list_distinct(list_filter(regexp_extract_all({c}, '{pattern}'), lambda m: NOT ({drop}))))"
    return _sql("formats", "error", f"'inconsistent format strings ({dialect})'", f"{specs('src')} <> {specs('tgt')}", base)


_BARE = "regexp_replace(regexp_replace({t}, '^<([\\s\\S]*)>$', '\\1'), '^[\"«»“”„‟＂]([\\s\\S]*)[\"«»“”„‟＂]$', '\\1')"
_FIX_EMAILS = f"""{_BASE.replace("'{rule}'", "''")},
t AS (SELECT doc_id, regexp_split_to_array(tgt, '{_ANY_WS}+') AS w, regexp_extract_all(tgt, '{_ANY_WS}+') AS g, list_filter(list_transform(regexp_split_to_array(src, '{_ANY_WS}+'), lambda t: {_BARE.format(t='t')}), lambda t: {_EMAIL}) AS a,
      list_filter(list_transform(regexp_split_to_array(tgt, '{_ANY_WS}+'), lambda t: {_BARE.format(t='t')}), lambda t: {_EMAIL}) AS b, tgt FROM p),
u AS (SELECT doc_id, a, tgt, unnest(w) AS w, unnest(list_concat(g, [''])) AS g, unnest(range(1, len(w) + 1)) AS k FROM t WHERE len(a) = len(b) AND list_sort(list_distinct(a)) <> list_sort(list_distinct(b))),
v AS (SELECT *, {_BARE.format(t='w')} AS t FROM u),
n AS (SELECT *, {_EMAIL} AS found, sum(CASE WHEN {_EMAIL} THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY k) AS place FROM v)
SELECT doc_id, fixed FROM (SELECT doc_id, any_value(tgt) AS tgt, string_agg(CASE WHEN found THEN replace(w, t, a[place::BIGINT]) ELSE w END || g, '' ORDER BY k) AS fixed FROM n GROUP BY doc_id) WHERE fixed <> tgt"""
_FILES = f"""SELECT doc_id, language, src, tgt, flag, length(src) AS n, 6 + CASE WHEN language IS NULL THEN 0 ELSE 1 END - 1 AS first FROM ({PAIRS_SQL}) AS x"""
_PARSED = f"""SELECT doc_id, first AS line_number, language AS language_code, (n % 4)::INTEGER AS nplurals, n % 5 = 0 AS fuzzy, n % 7 = 1 AS obsolete, n % 13 = 0 AS noqa, CASE WHEN n % 11 = 0 THEN 'tabs;pipes' ELSE '' END AS noqa_rules,
 flag IS NULL AS nowrap, CASE WHEN flag IS NOT NULL THEN 'C' END AS format_language, n % 17 = 0 AS encoding_error, tgt <> '' OR n % 17 = 0 AS is_translated, md5(src) AS source, CASE WHEN n % 3 = 1 THEN md5(src) END AS plural,
 first + 3 + CASE WHEN n % 13 = 0 THEN 1 ELSE 0 END + CASE WHEN n % 3 = 1 THEN 1 ELSE 0 END AS msgstr_line, CASE WHEN n % 17 <> 0 THEN md5(tgt) END AS translation FROM ({_FILES}) AS f"""


def _states_sql() -> str:
    rows = f"WITH e AS ({_PARSED}), p AS (SELECT * FROM e WHERE NOT noqa)"
    part = lambda rule, severity, message, where, source="p": f"{rows} SELECT doc_id, '{rule}' AS rule, '{severity}' AS severity, {message} AS message, msgstr_line AS line_number FROM {source} WHERE {where}"
    return _union(
        part("encoding", "error", "'invalid characters for encoding UTF-8'", "encoding_error"), part("fuzzy", "info", "'fuzzy entry'", "fuzzy"), part("obsolete", "info", "'obsolete entry'", "obsolete"),
        part("noqa", "info", "'entry with noqa'", "noqa OR noqa_rules <> ''", "e"), part("untranslated", "info", "'untranslated message'", "NOT is_translated"),
        part("plurals", "error", "CASE WHEN nplurals > 1 THEN 'missing' ELSE 'extra' END || ' translated plural form (found: 1, expected: ' || nplurals || ')'", "nplurals > 0 AND plural IS NOT NULL AND nplurals <> 1"),
    )


def _sources_sql() -> str:
    words = lambda some: f"SELECT DISTINCT lower(unnest(regexp_extract_all(src, '{WORDS_RE}'))) AS word FROM ({PAIRS_SQL}) AS x WHERE {some}"
    base = _BASE + f", known AS ({words('doc_id % 2 = 0')} UNION {words('doc_id IN (1, 3, 5)')})"
    parts = []
    for rule, text, what, where in (("spelling-id", "src", "source", "true"), ("spelling-ctxt", "src", "context", "doc_id % 4 = 1")):
        bad = f"{base}, w AS (SELECT DISTINCT doc_id, unnest({words_sql(text)}) AS word FROM p WHERE {where}), bad AS (SELECT doc_id, word FROM w WHERE NOT regexp_matches(word, '[0-9]') AND NOT regexp_full_match(word, '[A-Z]{{2,}}') AND lower(word) NOT IN (SELECT word FROM known))"
        parts.append(f"{bad} SELECT doc_id, '{rule}' AS rule, 'info' AS severity, 'misspelled words in {what}: ' || string_agg(word, ', ' ORDER BY word) AS message FROM bad GROUP BY doc_id")
    return _union(*parts)


_QUOTED_OR_SPEC = r"''[^'']*''|\{[0-9][^{}]*\}"
ORACLE_SQL: dict[str, str] = {_key(n): q for n, q in _RULE_SQL.items()}
ORACLE_SQL |= {
    "marks_counts": _marks_counts_sql(),
    "marks_formats": _marked(_RULE_SQL["formats"], _SPEC, "m <> '%%'", text=_ended),
    "marks_controls": _marked(_RULE_SQL["unicode-ctrl"], _ZERO_WIDTH, sides=("tgt",)),
    "formats_java": _dialect_sql("Java", _QUOTED_OR_SPEC, "starts_with(m, chr(39))"),
    "formats_python": _dialect_sql("Python", r"%%|%(?:\([^)]*\))?[-+ #.0-9]*[hlL]?[A-Za-z]?", "m = '%%'"),
    "formats_python_brace": _dialect_sql("Python brace", r"\{\{|\{[^{}]*\}", "m = '{{'"),
    "fix_unsafe": _FIX_EMAILS,
    "fix_files": f"""WITH x AS (SELECT doc_id, n, src, tgt, n % 7 = 1 AND tgt <> '' AND n % 13 <> 0 AS gone, {_EDGE_FIX} AS fixed, NOT {_blank('src')} AND NOT {_blank('tgt')} AND n % 13 <> 0 AS seen FROM ({_FILES}) AS f)
        SELECT doc_id, CASE WHEN gone THEN 0 ELSE 1 END::BIGINT AS n_entries, CASE WHEN NOT gone THEN md5(fixed) END AS translation FROM x WHERE gone OR seen AND fixed <> tgt""",
    "parsed": _PARSED,
    "parsed_states": _states_sql(),
    "rule_spelling_sources": _sources_sql(),
    "stats_entries": f"""SELECT *, {_PERCENT} FROM (SELECT coalesce(path, '(total)') AS path, count(*) AS total, {", ".join(f"count(*) FILTER (s = '{s}') AS {s}" for s in st.STATES)}
        FROM (SELECT path, {_STATE} AS s FROM ({PAIRS_SQL}) AS x) GROUP BY ROLLUP (path))""",
    "stats_words": f"""SELECT coalesce(path, '(total)') AS path, sum(a)::BIGINT AS src_words, sum(b)::BIGINT AS tgt_words, sum(c)::BIGINT AS src_chars, sum(d)::BIGINT AS tgt_chars,
        coalesce(sum(a) FILTER (s = 'fuzzy'), 0)::BIGINT AS src_words_fuzzy, coalesce(sum(b) FILTER (s = 'translated'), 0)::BIGINT AS tgt_words_translated
        FROM (SELECT path, {_STATE} AS s, {_W("src")} AS a, {_W("tgt")} AS b, {_C("src")} AS c, {_C("tgt")} AS d FROM ({PAIRS_SQL}) AS x) GROUP BY ROLLUP (path)""",
    "diagnostics_by_rule": f"SELECT rule, count(*) AS n FROM ({_SEEN}) GROUP BY rule",
    "diagnostics_by_file": f"SELECT g.path, count(*) FILTER (severity = 'info') AS info, count(*) FILTER (severity = 'warning') AS warning, count(*) FILTER (severity = 'error') AS error FROM (SELECT DISTINCT path FROM ({PAIRS_SQL}) AS x) AS g LEFT JOIN ({_SEEN}) AS f ON f.path = g.path GROUP BY g.path",
    "fix_safe": f"SELECT doc_id, fixed FROM (SELECT *, {_EDGE_FIX} AS fixed FROM ({PAIRS_SQL}) AS x WHERE NOT noqa AND tgt <> '' AND NOT {_blank('src')} AND NOT {_blank('tgt')}) WHERE fixed <> tgt",
    "rule_spelling": f"""{_BASE}, listed AS (SELECT DISTINCT language, lower(unnest(regexp_extract_all(src, '{WORDS_RE}'))) AS word FROM ({PAIRS_SQL}) AS x WHERE doc_id % 2 = 0 AND language IS NOT NULL),
w AS (SELECT DISTINCT doc_id, language, unnest({words_sql('tgt')}) AS word FROM p),
bad AS (SELECT doc_id, w.word FROM w WHERE NOT regexp_matches(word, '[0-9]') AND NOT regexp_full_match(word, '[A-Z]{{2,}}') AND language IN (SELECT language FROM listed) AND NOT EXISTS (SELECT 1 FROM listed l WHERE l.language = w.language AND l.word = lower(w.word)))
SELECT doc_id, 'spelling-str' AS rule, 'info' AS severity, 'misspelled words in translation: ' || string_agg(word, ', ' ORDER BY word) AS message FROM bad GROUP BY doc_id""",
}
