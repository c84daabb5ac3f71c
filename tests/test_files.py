import json

from pyspark.sql import functions as F
from test_rules import catalogue, entries

from polyglint.operators.fixes import fix_summary, fix_translations, obsolete_entries
from polyglint.operators.rewrite import block, replacements, rewritten, splice
from polyglint.operators.rules import Options
from polyglint.operators.stats import as_json, by_status, stats
from polyglint.plans import report
from polyglint.plans.check import check
from polyglint.plans.files import check_files, missing_dictionaries, settings
from polyglint.shared import cut
from polyglint.sources.config import load, nearest
from polyglint.sources.po import list_files, parse, read_catalogues, read_contents
from polyglint.sources.words import dictionary, word_list
from polyglint.sources.writer import write_contents


def test_folders(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "c").mkdir()
    (tmp_path / "d").mkdir()
    (tmp_path / "polyglint.toml").write_text('[check]\nselect = ["tabs"]\n')
    (tmp_path / "a" / "polyglint.toml").write_text('[check]\nselect = ["no-trans"]\nno_trans_file = "words.txt"\n')
    (tmp_path / "a" / "words.txt").write_text("# names\n\nLINUX\n")
    (tmp_path / "c" / "polyglint.toml").write_text("[check]\nshort_factor = 1\n")
    (tmp_path / "d" / "polyglint.toml").write_text('[check]\nselect = ["nothing"]\n')
    for name in ("x.po", "a/b/y.po", "c/z.po", "d/v.po"):
        (tmp_path / name).write_bytes(catalogue("a\tb 'Linux'", "ab"))
    found = {(r.path.rsplit("/", 1)[1], r.rule, r.message) for r in check_files(spark, str(tmp_path)).collect()}
    assert {f[:2] for f in found} == {("x.po", "tabs"), ("y.po", "no-trans"), ("z.po", "config-error"), ("v.po", "rules-error")}
    assert ("y.po", "no-trans", "word 'Linux' must not be translated (1 in source, 0 in translation)") in found and ("v.po", "rules-error", "unknown rules: nothing") in found
    (tmp_path / "a" / "words.txt").unlink()
    assert any(r.rule == "no-trans" and "words file not found for rule 'no-trans'" in r.message for r in check_files(spark, str(tmp_path / "a")).collect())
    table = {r.path.rsplit("/", 1)[1]: r for r in settings(spark, str(tmp_path)).collect()}
    assert table["x.po"].rules == ["tabs"] and json.loads(table["x.po"].settings)["select"] == ["tabs"] and table["z.po"].settings is None
    assert nearest(tmp_path / "a" / "b" / "y.po") == tmp_path / "a" / "polyglint.toml"
    assert load('[check]\npath_words = "w"\n', base="/here").path_words == "/here/w"


def test_dictionaries(spark, tmp_path):
    (tmp_path / "x.dic").write_text("2\nwork/A\nplay\n")
    (tmp_path / "x.aff").write_text("SFX A Y 1\nSFX A 0 ed .\n")
    assert {r.word for r in dictionary(spark, "en", str(tmp_path / "x.dic"), str(tmp_path / "x.aff")).collect()} == {"work", "worked", "play"}
    (tmp_path / "list").write_text(" One \n# two\n\n")
    assert [r[0] for r in word_list(spark, str(tmp_path / "list")).collect()] == ["one"]
    (tmp_path / "fr_CA.dic").write_text("Mnde\n")
    from polyglint.sources.words import dictionaries, personal_words

    assert {tuple(r) for r in dictionaries(spark, str(tmp_path)).collect()} == {("x", "work"), ("x", "worked"), ("x", "play")}
    assert ("fr_CA", "Mnde") in {tuple(r) for r in personal_words(spark, str(tmp_path)).collect()}
    words = spark.createDataFrame([("fr", "bonjour"), ("pt_BR", "ola"), ("en", "word")], "language string, word string")
    own = spark.createDataFrame([("fr_CA", "mnde")], "language string, word string")
    parsed = entries(spark, catalogue("word wrod", "'bonjour' mnde", "fr_CA"), catalogue("word", "bonjour", "fr_FR"), catalogue("word", "ola olla", "pt_BR"), catalogue("word", "hallo", "de"))
    bad = lambda **o: {(r.path, r.rule, r.message.split(": ")[1]) for r in check(parsed, Options(select=("spelling",), **o), words, personal=own).collect()}
    assert bad() == bad(lang_id="en_GB") == {("0.po", "spelling-id", "wrod"), ("2.po", "spelling-str", "olla")}
    assert bad(lang_id="en", langs=("fr_CA",)) == set()
    lacking = lambda **o: {(r.path, r.rule) for r in missing_dictionaries(parsed, words, Options(select=("spelling",), **o)).collect()}
    assert lacking(lang_id="en") == {("3.po", "spelling-str")} and lacking(lang_id="it") == {("3.po", "spelling-str"), *((f"{k}.po", "spelling-ctxt-id") for k in range(4))}
    (found,) = check(parsed, Options(select=("spelling-id",), lang_id="en"), words).collect()
    assert [tuple(m) for m in found.src_marks] == [(5, 9)] and report.misspelled_words(check(parsed, Options(select=("spelling-id",), lang_id="en"), words)).first()[0] == "wrod"


# rule, source, translation, flag, translation after its unsafe or safe edits
FIXES = [
    ("emails", "to <a@b.org> x@y.org", "à <c@b.org> x@y.org", "", "à <a@b.org> x@y.org"),
    ("functions", "call a.b() and c()", "appel c() et d()", "", "appel a.b() et c()"),
    ("html-tags", "<b>x</b>", "<i>é</b>", "", "<b>é</b>"),
    ("paths", "in /usr/lib ./z/a", "dans /usr/lib ./z/b", "", "dans /usr/lib ./z/a"),
    ("urls", "see http://a.org", "voir %shttp://b.org", "c-format", "voir %shttp://a.org"),
    ("double-words", "a", "le le le chat", "", "le chat"),
    ("double-words", "a %s", "%s s", "c-format", None),
    ("double-spaces", "a b\nc", "a  b  \n  c  d", "", "a b  \n  c d"),
    ("unicode-ctrl", "a", "a\x07b", "", "ab"),
]


def test_edits(spark):
    parsed = entries(spark, *(catalogue(f[1], f[2], flag=f[3]) for f in FIXES))
    found = check(parsed, Options(select=tuple(sorted({f[0] for f in FIXES}))))
    fixed = {r.path: r.fixed for r in fix_translations(found.filter(" or ".join(f"(path = '{k}.po' and rule = '{f[0]}')" for k, f in enumerate(FIXES))), unsafe=True).collect()}
    assert fixed == {f"{k}.po": f[4] for k, f in enumerate(FIXES) if f[4]}
    summary = fix_summary(found).agg(F.sum("fixable"), F.sum("unsafe_only")).first()
    assert summary[0] >= 2 and summary[1] >= 6


def test_marks(spark):
    parsed = entries(spark, catalogue("the NATO x NATO", "OTAN"), catalogue("call a() b()", "appel a() c()"), catalogue("a(s) (b", "a(s) b"), catalogue("x", "y\x0c"))
    rows = {(r.path, r.rule): r for r in check(parsed, Options(select=("acronyms", "functions", "brackets", "unicode-ctrl"))).collect()}
    spans = lambda k, side: [tuple(m) for m in rows[k][side]]
    assert spans(("0.po", "acronyms"), "src_marks") == [(4, 8), (11, 15)] and spans(("1.po", "functions"), "src_marks") == [(9, 12)] and spans(("1.po", "functions"), "tgt_marks") == [(10, 13)]
    assert spans(("2.po", "brackets"), "src_marks") == [(5, 6)] and rows["3.po", "unicode-ctrl"].message == "extra control character U+000C (FORM FEED)"


def test_rewrite(spark, tmp_path):
    old = '\n# note\n#~ msgid "old"\n#~ msgstr "vieux  x"\n'
    (tmp_path / "x.po").write_bytes(catalogue(" two\nlines ", "deux\nlignes") + b'\nmsgid "kept"\nmsgstr "autre"\n' + old.encode())
    entries_ = read_catalogues(spark, str(tmp_path))
    files = read_contents(list_files(spark, str(tmp_path)))
    found = check(entries_, Options(select=("whitespace-start", "whitespace-end", "double-spaces", "obsolete"), obsolete=True))
    assert obsolete_entries(found).count() == 1
    new = cut(rewritten(files, replacements(entries_, found)))
    (written,) = write_contents(new).collect()
    assert written.n == 2 and written.error is None
    header, first, kept = parse((tmp_path / "x.po").read_bytes())
    assert header["is_header"] and first["msgstr"][0]["value"] == " deux\nlignes " and kept["msgstr"][0]["value"] == "autre"
    assert check(read_catalogues(spark, str(tmp_path)), Options(select=("whitespace-start", "whitespace-end"))).count() == 0
    assert block(b'#~ msgstr[1] "a"\n', "b\nc", "ISO-8859-1") == b'#~ msgstr[1] ""\n#~ "b\\n"\n#~ "c"\n'
    assert splice(b"abcd", [(0, 2, None, "utf-8"), (1, 3, None, "utf-8")]) == (b"abcd", 0) and splice(b"abcd", [(2, 9, None, "utf-8")]) == (b"abcd", 0)


def test_outputs(spark, tmp_path):
    parsed = entries(spark, catalogue("a\tb", "ab"), catalogue("a|b", "ab\t"))
    found = check(parsed, Options(select=("pipes", "tabs")))
    results = [json.loads(r[0]) for r in report.sarif_results(found).collect()]
    assert {(r["ruleId"], r["ruleIndex"]) for r in results} == {("pipes", 0), ("tabs", 1)} and any(r["locations"][0]["physicalLocation"]["region"].get("startColumn") == 2 for r in results)
    report.write_sarif(found, str(tmp_path / "s"))
    assert spark.read.text(str(tmp_path / "s" / "results")).count() == 3 and "columnKind" in spark.read.text(str(tmp_path / "s" / "head")).first()[0]
    assert "\n".join(r[0] for r in report.text_lines(found).collect()) == "\n".join(report.text(found))
    table = stats(parsed, words=True)
    rows = [json.loads(r[0]) for r in as_json(table).collect()]
    assert {r.get("path"): r["entries"]["total"] for r in rows} == {"0.po": 1, "1.po": 1, None: 2} and "src" in rows[0]["words"]
    assert [r.path for r in by_status(table.filter("path is not null")).collect()] == ["0.po", "1.po"]


def test_late_events(spark, tmp_path):
    from polyglint.streaming.editor import watch_events, watch_files

    rows = [[("u", "change", catalogue("a\tb", "ab").decode(), 5)], [("u", "change", catalogue("a", "a").decode(), 3), ("v", "open", catalogue("a\tb", "ab").decode(), 1)]]
    schema, got = "uri string, event string, text string, seq long", []
    sink = lambda uris, found, n: got.append((sorted(r[0] for r in uris.collect()), sorted(r.path for r in found.collect())))
    spark.createDataFrame([], schema).coalesce(1).write.json(str(tmp_path / "in"))
    for batch in rows:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
        query = watch_events(spark.readStream.schema(schema).json(str(tmp_path / "in")), sink, Options(select=("tabs",)), checkpointLocation=str(tmp_path / "ck"))
        query.processAllAvailable()
        query.stop()
    assert [g for g in got if g[0]] == [(["u"], ["u"]), (["v"], ["v"])]
    (tmp_path / "po").mkdir()
    (tmp_path / "po" / "x.po").write_bytes(catalogue("a\tb", "ab"))
    got.clear()
    query = watch_files(spark, str(tmp_path / "po"), sink, Options(select=("tabs",)), checkpointLocation=str(tmp_path / "ck2"))
    query.processAllAvailable()
    query.stop()
    assert len(got) == 1 and len(got[0][1]) == 1
