import pytest
from pyspark.sql import functions as F

from polyglint.operators.fixes import apply_edits, fix_translations, merge_edits
from polyglint.operators.rules import RULES, Options, select_rules
from polyglint.operators.stats import by_path, stats
from polyglint.plans import report
from polyglint.plans.check import check, rule_catalog
from polyglint.sources.config import load
from polyglint.sources.po import escape, parse_files
from polyglint.streaming.editor import watch_events

HEADER = 'msgid ""\nmsgstr ""\n"Language: {lang}\\n"\n"Plural-Forms: nplurals=2; plural=n>1;\\n"\n\n'

# rule, source, translation, messages, options, language, flag
CASES = [
    ("accelerators", "&File && x", "Fichier", ["missing accelerators '&' (1 / 0)"], {}, "fr", ""),
    ("acronyms", "the NATO and UN", "OTAN et UN", ["acronym 'NATO' must not be translated"], {}, "fr", ""),
    ("blank", "a", "  ", ["blank translation"], {}, "fr", ""),
    ("brackets", "a (b) [c", "a b c", ["missing opening and closing round brackets '(' (1 / 0) and ')' (1 / 0)", "missing opening square brackets '[' (1 / 0)"], {}, "fr", ""),
    ("brackets", "file(s)", "fichier(s) (tous)", [], {}, "fr", ""),
    ("changed", "a", "b", ["changed translation"], {}, "fr", ""),
    ("double-quotes", 'a "b"', "a «b", ["missing double quotes (2 / 1)"], {}, "fr", ""),
    ("double-spaces", "a b", "a  b", ["extra double spaces '  ' (0 / 1)"], {}, "fr", ""),
    ("double-words", "a", "le le chat", ["word 'le' is repeated"], {}, "fr", ""),
    ("emails", "to <a@b.org>", "à c@b.org", ["different emails"], {}, "fr", ""),
    ("escapes", "a\\b", "ab", ["missing escape characters '\\' (1 / 0)"], {}, "fr", ""),
    ("force-trans", "The file", "Le file", ["word 'file' must be translated"], {"force_trans": ("file",)}, "fr", ""),
    ("formats", "%2$s %1$d", "%1$d %2$s", [], {}, "fr", "c-format"),
    ("formats", "%s", "%d", ["inconsistent format strings (C)"], {}, "fr", "c-format"),
    ("formats", "{a} {{b}}", "{b} {{b}}", ["inconsistent format strings (Python brace)"], {}, "fr", "python-brace-format"),
    ("formats", "{0,choice,1#{1}} it''s", "{0,choice,1#{2}}", ["inconsistent format strings (Java)"], {}, "fr", "java-format"),
    ("functions", "call a.b()", "appel c()", ["different functions"], {}, "fr", ""),
    ("html-tags", "<b>x</b>", "<i>x</b>", ["different HTML tags"], {}, "fr", ""),
    ("long", "ab", "x" * 16, ["translation too long (2 / 16)"], {}, "fr", ""),
    ("newlines", "a\n", "a", ["missing line feeds '\\n' (1 / 0)", "missing line feed '\\n' at the end"], {}, "fr", ""),
    ("no-trans", "use Linux", "usez Windows", ["word 'Linux' must not be translated (1 in source, 0 in translation)"], {"no_trans": ("linux",)}, "fr", ""),
    ("paths", "in /usr/lib", "dans", ["missing paths (1 / 0)"], {}, "fr", ""),
    ("pipes", "a|b", "ab", ["missing pipes '|' (1 / 0)"], {}, "fr", ""),
    ("punc-start", "- a", ": a", ["inconsistent leading punctuation ('' / ':')"], {}, "fr", ""),
    ("punc-end", "a.", "a", ["inconsistent trailing punctuation ('.' / '')"], {}, "fr", ""),
    ("punc-end", "a.", "a。", [], {}, "ja", ""),
    ("punc-space-id", "a :", "a", ["extra space before ':' in source"], {}, "fr", ""),
    ("punc-space-str", "a:", "a :", ["space must be a non-breaking space before ':' in translation"], {}, "fr", ""),
    ("punc-space-str", "a:", "a :", [], {}, "de", ""),
    ("short", "x" * 16, "ab", ["translation too short (16 / 2)"], {}, "fr", ""),
    ("tabs", "a\tb", "ab", ["missing tabs '\\t' (1 / 0)"], {}, "fr", ""),
    ("unchanged", "abc", "abc", ["unchanged translation"], {}, "fr", ""),
    ("unicode-ctrl", "a", "a​b", ["extra control character U+200B (ZERO WIDTH SPACE)"], {}, "fr", ""),
    ("unicode-ctrl", "a", "a​b", [], {}, "th", ""),
    ("untranslated", "a", "", ["untranslated message"], {}, "fr", ""),
    ("urls", "see http://a.org", "voir http://b.org", ["different URLs"], {}, "fr", ""),
    ("whitespace-start", " a", "a", ["inconsistent leading whitespace (' ' / '')"], {}, "fr", ""),
    ("whitespace-end", "a ", "a", ["inconsistent trailing whitespace (' ' / '')"], {}, "fr", ""),
    ("whitespace-line-end", "a\nb", "a \nb", ["inconsistent trailing whitespace ('' / ' ')"], {}, "fr", ""),
    ("whitespace-line-start", "a\n b", "a\nb", ["inconsistent leading whitespace (' ' / '')"], {}, "fr", ""),
]


def catalogue(src, tgt, lang="fr", flag="", comment=""):
    return (HEADER.format(lang=lang) + f'{comment}#, {flag}\nmsgid "{escape(src)}"\nmsgstr "{escape(tgt)}"\n').encode()


def entries(spark, *contents):
    return parse_files(spark.createDataFrame([(f"{k}.po", bytearray(c)) for k, c in enumerate(contents)], "path string, content binary"))


def test_every_rule_fires_or_is_silent(spark):
    for options in {tuple(sorted(c[4].items())) for c in CASES}:
        cases = [c for c in CASES if tuple(sorted(c[4].items())) == options]
        names = tuple(sorted({c[0] for c in cases}))
        # One job for all: each case is a file.
        parsed = entries(spark, *(catalogue(c[1], c[2], c[5], c[6]) for c in cases))
        found = {}
        for row in check(parsed, Options(select=names, **dict(options))).collect():
            found.setdefault((row.path, row.rule), []).append(row.message)
        for k, c in enumerate(cases):
            assert sorted(found.get((f"{k}.po", c[0]), [])) == sorted(c[3]), c


def test_registry(spark):
    assert len(RULES) == 43 and sum(r.default for r in RULES.values()) == 25 and sum(r.check for r in RULES.values()) == 38
    assert rule_catalog(spark).count() == 43
    with pytest.raises(ValueError, match="unknown rules: nothing"):
        select_rules(("nothing",))
    assert [r.name for r in select_rules(("tabs", "pipes", "blank"), ("blank",))] == ["pipes", "tabs"]


def test_gating_and_noqa(spark):
    tab = ("a\tb", "ab")
    parsed = entries(spark, catalogue(*tab), catalogue(*tab, flag="fuzzy"), catalogue(*tab, flag="noqa:tabs"), catalogue(*tab, flag="noqa"), catalogue("a", ""))
    only = lambda **o: {r.path for r in check(parsed, Options(select=("tabs",), **o)).collect()}
    assert only() == {"0.po"} and only(fuzzy=True) == {"0.po", "1.po"} and only(noqa=True) == {"0.po"} and only(severity=("info",)) == set()
    assert {(r.path, r.rule) for r in check(parsed, Options(select=("fuzzy", "untranslated", "noqa"))).collect()} == {("1.po", "fuzzy"), ("2.po", "noqa"), ("3.po", "noqa"), ("4.po", "untranslated")}


def test_header_and_plurals(spark):
    plural = HEADER.format(lang="fr") + 'msgid "a"\nmsgid_plural "b"\nmsgstr[0] "c"\n'
    found = [(r.rule, r.severity, r.message) for r in check(entries(spark, plural.encode()), Options(select=("header", "plurals"))).collect()]
    assert ("plurals", "error", "missing translated plural form (found: 1, expected: 2)") in found
    assert ("header", "warning", "missing field 'Content-Type' in header") in found and not any("'Language'" in f[2] for f in found)


def test_fixes(spark):
    parsed = entries(spark, catalogue(" a b.", "a  b"), catalogue("a", "a​"))
    fixed = {r.path: r.fixed for r in fix_translations(check(parsed)).collect()}
    assert fixed == {"0.po": " a b.", "1.po": "a"}


@pytest.mark.parametrize(
    ("edits", "expected"),
    [([(0, 1, "X"), (3, 4, "")], "Xbc"), ([(0, 2, "X"), (1, 3, "Y")], "abcd"), ([(0, 1, "X"), (0, 1, "X")], "Xbcd"), ([(1, 1, "-"), (1, 2, "")], "a-cd"), ([], "abcd")],
)
def test_edit_algebra(spark, edits, expected):
    df = spark.createDataFrame([("abcd", edits)], "v string, e array<struct<start:int,end:int,replacement:string>>")
    assert df.select(apply_edits(F.col("v"), merge_edits(F.col("e")))).first()[0] == expected


def test_stats_and_reports(spark):
    parsed = entries(spark, catalogue("one two", "un deux"), catalogue("a", "b", flag="fuzzy"))
    table = {r.path: r for r in by_path(stats(parsed, words=True)).collect()}
    assert table[None].total == 2 and table["0.po"].translated_percent == 100 and table["1.po"].fuzzy == 1 and table["0.po"].src_words == 2
    found = check(parsed, Options(select=("changed", "header")))
    assert report.rule_counts(found).first().rule == "header"
    assert "".join(report.sarif(found)).count('"ruleId"') == found.count() and report.summary(found)["exit_code"] == 1
    assert len([x for x in report.text(found) if "[info:changed]" in x]) == 1 and report.file_counts(parsed, found).count() == 2 and report.as_json(found).count() == found.count()


def test_spelling(spark):
    parsed = entries(spark, catalogue("a", "bonjour mnde"))
    words = spark.createDataFrame([("fr", "bonjour"), ("fr", "monde")], "language string, word string")
    found = check(parsed, Options(select=("spelling",)), words).collect()
    assert [(r.rule, r.message) for r in found] == [("spelling-str", "misspelled words in translation: mnde")]


def test_config():
    o = load('[check]\nselect = ["checks"]\nfuzzy = true\nunknown = 1\n', fuzzy=False, long_factor=4)
    assert o.select == ("checks",) and o.fuzzy and o.long_factor == 4
    with pytest.raises(ValueError):
        load("[check]\nshort_factor = 1\n")


def test_stream(spark, tmp_path):
    rows = [("u", "open", catalogue("a\tb", "ab").decode(), 1), ("u", "change", catalogue("a\tb", "a\tb").decode(), 2), ("v", "open", catalogue("a\tb", "ab").decode(), 3)]
    schema = "uri string, event string, text string, seq long"
    spark.createDataFrame(rows, schema).coalesce(1).write.json(str(tmp_path / "in"))
    got = []
    query = watch_events(spark.readStream.schema(schema).json(str(tmp_path / "in")), lambda uris, found, n: got.append((uris.count(), [r.path for r in found.collect()])), Options(select=("tabs",)), checkpointLocation=str(tmp_path / "ck"))
    query.processAllAvailable()
    query.stop()
    assert got == [(2, ["v"])]


def test_compilation(spark):
    from polyglint.operators.compilation import compile_files

    files = spark.createDataFrame([("a.po", bytearray(b"x"))], "path string, content binary")
    (row,) = compile_files(files, "/nowhere/msgfmt").collect()
    assert row.rule == "compilation" and "can't run" in row.message
    assert compile_files(files, "/bin/true").count() == 0
