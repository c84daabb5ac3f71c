"""Ranges of bytes, folders and ignore files, encodings, line breaking, headers, and writing."""

import os
import random
import re
from pathlib import Path

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from test_rules import catalogue, entries

from polyglint.functions import wrap
from polyglint.operators.fixes import fix_translations
from polyglint.operators.rewrite import fix_files
from polyglint.operators.rules import Options
from polyglint.plans.check import check
from polyglint.plans.files import check_files
from polyglint.sources import encodings, listing, po, writer

TEXT = (
    b'\n\nmsgid ""\nmsgstr "Language: fr\\n"\n"Content-Type: text/plain; charset=ISO-8859-1\\n"\n\n\n\nmsgid "a"\nmsgstr "\xe9"\n\nmsgid ""\n"b"\nmsgstr "c"\n\n\n'
    b'#~ msgid ""\n#~ msgstr "Language: de\\nContent-Type: text/plain; charset=koi8-r\\nPlural-Forms: nplurals=3;\\n"\n\nmsgid "x"\nmsgstr[0] "\xc1"\nmsgstr[1] "q"\n\n\n\n'
)


@pytest.mark.parametrize("content", [TEXT, TEXT.rstrip(b"\n"), TEXT[1:], TEXT[2:], b"", b"\n", b"\n\n\n", b'msgid "a"\n', b"a"])
def test_ranges_are_the_file(tmp_path, content):
    """Cut at every offset, with headers in the middle, runs of empty lines and a file without an end of line."""
    path = str(tmp_path / "x.po")
    Path(path).write_bytes(content)
    want = list(po.parse(content))
    for size in range(1, len(content) + 2):
        got, lines, n, headers = [], 0, 0, []
        for start in range(0, max(len(content), 1), size):
            part = po.Part.read(path, start, min(start + size, len(content)), 3)
            got += part.entries(lines, n, headers)
            own = part.survey()
            lines, n, headers = lines + own[0], n + own[1], headers + own[2]
        assert got == want, size


def test_readers_of_ranges(spark, tmp_path):
    (tmp_path / "x.po").write_bytes(TEXT)
    (tmp_path / "y.po").write_bytes(catalogue("a", "b"))
    want = {(str(tmp_path / n), e["entry_idx"], e["line_number"], e["byte_start"], e["byte_end"], e["encoding_name"], e["nplurals"], str([m["value"] for m in e["msgstr"]])) for n in ("x.po", "y.po") for e in po.parse((tmp_path / n).read_bytes())}
    spark.dataSource.register(po.CatalogueSource)
    for size in (7, 50, 1 << 20):
        for rows in (po.read_catalogues(spark, str(tmp_path), size=size), spark.read.format("po").option("range", size).load(str(tmp_path))):
            assert {(r.path, r.entry_idx, r.line_number, r.byte_start, r.byte_end, r.encoding_name, r.nplurals, str([m.value for m in r.msgstr])) for r in rows.collect()} == want


def test_large_file_has_many_tasks(spark, tmp_path):
    entry = 'msgid "text {0} of the catalogue"\nmsgstr "texte {0} du catalogue"\n\n'
    (tmp_path / "x.po").write_text('msgid ""\nmsgstr "Language: fr\\n"\n\n' + "".join(entry.format(k) for k in range(40_000)))
    rows = po.read_catalogues(spark, str(tmp_path), size=100_000)
    tasks = rows.groupBy(F.spark_partition_id()).count()
    assert tasks.count() > 8 and rows.count() == 40_001
    found = rows.select(F.max("entry_idx"), F.countDistinct("entry_idx"), F.max("line_number"), F.count_if(F.col("language") == "fr"), F.count_if(F.col("entry_idx") == F.regexp_extract("msgid.value", "[0-9]+", 0).try_cast("int") + 1)).first()
    assert tuple(found) == (40_000, 40_001, 4 + 3 * 39_999, 40_001, 40_000)


TREE = {
    "a.po": "", "_x.po": "", ".h.po": "", ".hidden/b.po": "", "kept/.h.po": "", "note.txt": "", "old/c.po": "", "sub/old/d.po": "", "sub/e.po": "", "sub/deep/f.po": "", "sub/deep/g.tmp.po": "", "build/out.po": "", "sub/build/i.po": "", "docs/j.po": "", "docs/k.po": "",
    "x/y/z/l.po": "", "x/z/m.po": "", "x/q.po": "", "s p.po": "", "#n.po": "", "!o.po": "", "b1.po": "", "b2.po": "", "b3.po": "", "nested/.git/config": "", "nested/r.tmp.po": "", "un/t.po": "", "un/u.po": "",
    ".git/config": "", ".git/info/exclude": "b3.po\n",
    ".gitignore": "# a comment\n\n/build/\n*.tmp.po\n/old\ndocs/*\n!docs/k.po\nx/**/z\ns\\ p.po   \n\\#n.po\n\\!o.po\nb[!2].po\n!kept/.h.po\nun/\n",
    "sub/.gitignore": "!g.tmp.po\n/deep/f.po\n", "un/.gitignore": "!u.po\n", "x/.ignore": "!q.po\nq.po\n",
}
LISTED = {"a.po", "_x.po", "kept/.h.po", "sub/old/d.po", "sub/e.po", "sub/deep/g.tmp.po", "sub/build/i.po", "docs/k.po", "b2.po", "nested/r.tmp.po"}


def test_folders_and_ignore_files(spark, tmp_path):
    for name, text in TREE.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(text)
    os.symlink(tmp_path / "a.po", tmp_path / "link.po")
    short = lambda paths: {os.path.relpath(p, tmp_path) for p in paths}
    assert short(r.path for r in po.list_files(spark, str(tmp_path)).collect()) == LISTED
    assert short(p for p, _ in listing.walk_here(str(tmp_path))) == LISTED
    below = po.list_files(spark, str(tmp_path / "sub"), "file://" + str(tmp_path / "old" / "c.po"), str(tmp_path / "note.txt"), str(tmp_path / "none"))
    assert short(r.path for r in below.collect()) == {"sub/old/d.po", "sub/e.po", "sub/deep/g.tmp.po", "sub/build/i.po", "old/c.po"}
    files = spark.createDataFrame([("/" + n,) for n in TREE if n.endswith(".po")], "path string")
    rules = listing.rules_of(spark.createDataFrame([("/" + f if f else "", k, t) for n, t in TREE.items() for k in listing.KINDS if n == k or n.endswith("/" + k) for f in [n[: -len(k)].rstrip("/")]], "folder string, kind string, text string"))
    assert {r.path[1:] for r in listing.kept(files, rules, spark.createDataFrame([("",), ("/nested",)], "folder string")).collect()} == LISTED
    alone = {r.path[1:] for r in listing.kept(files, rules, spark.createDataFrame([], "folder string")).collect()}
    assert "b1.po" in alone and "x/q.po" not in alone and ".h.po" not in alone


def test_labels():
    assert len(encodings.labels()) == 228 and encodings.name_of(" Latin1\n") == "windows-1252" and encodings.name_of("CHARSET") is None
    for raw, label, text in (("①".encode("cp932"), "Shift_JIS", "①"), ("똠".encode("cp949"), "EUC-KR", "똠"), ("€".encode("gbk", "replace"), "GB2312", None), (b"\x80", "ISO-8859-9", "€"), (b"\xa1", "TIS-620", "ก"), (b"\x81", "latin1", "\x81"), (b"\xad\xa1", "euc-jp", "①"), (b"\xef\xbb\xbfa", "koi8-r", "a"), (b"\x80", "x-user-defined", "")):
        got, bad = encodings.decode(raw, encodings.name_of(label))
        assert not bad and (text is None or got == text), label
    assert encodings.decode(b"\xff", "windows-1253") == ("�", True) and encodings.decode(b"a", "replacement")[1] and encodings.decode(b"\xe9", "UTF-8") == ("�", True)
    assert encodings.encode("\x81€", "windows-1252") == b"\x81\x80"
    with pytest.raises(LookupError):
        encodings.encode("a", "UTF-16LE")
    header = 'msgid ""\nmsgstr "Content-Type: text/plain; charset={}\\n"\n\nmsgid "a"\nmsgstr "'
    for label, raw, name, bad in (("Shift_JIS", "①".encode("cp932"), "Shift_JIS", False), ("iso-8859-1", b"\x80", "windows-1252", False), ("CHARSET", b"\xe9", "UTF-8", True), ("tis-620", b"\xa1", "windows-874", False)):
        _, e = po.parse(header.format(label).encode() + raw + b'"\n')
        assert (e["encoding_name"], e["encoding_error"]) == (name, bad)


#: Places where a line may end, by the rules of the public algorithm.
BREAKS = [
    ("a b", "a |b"), ("foo-bar baz", "foo-|bar |baz"), ("$5.00 (ok) 50% x", "$5.00 |(ok) |50% |x"), ("see http://a.b/c/d?e=f", "see |http://|a.b/|c/|d?|e=f"), ("«a» b", "«a» |b"), ("don't stop", "don't |stop"), ("x  y", "x  |y"), ("a\xa0b c", "a\xa0b |c"),
    ("日本語。テ", "日|本|語。|テ"), ("ab日", "ab|日"), ("한국어", "한|국|어"), ("1,234.5 -6", "1,234.5 |-6"), ("a—b", "a|—|b"), ("a… b", "a… |b"), ("é x", "é |x"), ("[a] {b}", "[a] |{b}"), ("🇫🇷🇩🇪x", "🇫🇷|🇩🇪|x"), ("a​b", "a​|b"), ("שלום-x", "שלום-x"), ("a|b", "a||b"), ("(a) (b)", "(a) |(b)"), ("x!y", "x!|y"), (" a", " a"),
]


@pytest.mark.parametrize(("text", "shown"), BREAKS)
def test_breaks(text, shown):
    at = [0, *wrap.breaks(text), len(text)]
    assert "|".join(text[a:b] for a, b in zip(at, at[1:])) == shown


def test_widths_and_overrides():
    assert [wrap.width_of(x) for x in ("abc", "日本", "é", "​", "ｱ", "")] == [3, 4, 1, 0, 1, 0]
    assert wrap.allowed(r"a \"b c\n") == [2, 6] and wrap.message_lines("msgstr", "a\nb") == ['msgstr ""', '"a\\n"', '"b"'] and wrap.message_lines("msgstr", "") == ['msgstr ""']
    long = " ".join(["word"] * 30)
    assert wrap.message_lines("msgstr", long, 0) == [f'msgstr "{long}"'] and max(map(len, wrap.message_lines("msgstr", long))) == 77 and wrap.message_lines("msgstr", "x" * 100) == [f'msgstr "{"x" * 100}"']
    assert wrap.message_lines("msgstr", "x" * 100 + " y") == ['msgstr ""', f'"{"x" * 100} "', '"y"']


def plain_fill(escaped, ends, budget):
    """One character at a time: the last place before the budget is passed, else the next one."""
    out, start = [], 0
    while start < len(escaped):
        width, last, over = 0, None, False
        for k in range(start, len(escaped)):
            if width + wrap.char_width(escaped[k]) > budget:
                over = True
                break
            width += wrap.char_width(escaped[k])
            last = k + 1 if k + 1 in ends else last
        cut = None if not over else last or next((p for p in ends if p > start), None)
        out.append(escaped[start:cut])
        start = len(escaped) if cut is None else cut
    return out or [""]


@settings(deadline=None, max_examples=300)
@given(st.text(st.sampled_from("ab c-,.\n\t\"\\é日 (/$9"), max_size=150), st.sampled_from([0, 12, 20, 79]))
def test_lines_give_the_value_back(value, page):
    lines = wrap.message_lines("msgstr", value, page)
    assert po.unescape("".join(x[x.index('"') + 1 : -1] for x in lines)) == value
    (entry,) = po.parse(("msgid \"a\"\n" + "\n".join(lines)).encode())
    assert entry["msgstr"][0]["value"] == value
    shown = po.escape(value)
    assert wrap.filled(shown, 20) == plain_fill(shown, wrap.allowed(shown), 20)


FULL = "Project-Id-Version: x\nReport-Msgid-Bugs-To: a@b.org\nPOT-Creation-Date: d\nPO-Revision-Date: d\nLast-Translator: me <a@b.org>\nLanguage: fr\nLanguage-Team: a@b.org\nContent-Type: text/plain; charset=UTF-8\nContent-Transfer-Encoding: 8bit\n"
#: Changes of a header, and the field whose value is wrong then.
HEADERS = [
    (("UTF-8", "CHARSET"), "Content-Type"), (("text/plain;", "text/plainer;"), "Content-Type"), (("text/plain;", "text/plain"), "Content-Type"), (("text/plain; charset=UTF-8", "TEXT/Plain ;x=1; Charset = koi8-r "), None), (("charset=UTF-8", "charset="), "Content-Type"),
    (("To: a@b.org", "To: http://a.b.org"), "Report-Msgid-Bugs-To"), (("To: a@b.org", "To: me (at) a (dot) org"), "Report-Msgid-Bugs-To"), (("To: a@b.org", "To: me AT a DOT org"), None), (("To: a@b.org", "To: a@b.org c@d.org"), "Report-Msgid-Bugs-To"), (("Team: a@b.org", "Team: http://a.b.org"), None),
    (("Team: a@b.org", "Team: a@b.org http://a.b.org"), "Language-Team"), (("Team: a@b.org", "Team: none"), "Language-Team"), (("<a@b.org>", ""), "Last-Translator"), (("Language: fr", "Language: FR"), "Language"), (("Language: fr", "Language: fr@latin"), "Language"), (("Language: fr", "Language: sr_RS@latin"), None),
    (("POT-", "Plural-Forms: nplurals=0; plural=0\nPOT-"), "Plural-Forms"), (("POT-", "Plural-Forms: plural=0; NPLURALS = +2\nPOT-"), None), (("POT-", "Plural-Forms: nplurals=4294967296\nPOT-"), "Plural-Forms"), (("POT-", "Plural-Forms: plural=0\nPOT-"), "Plural-Forms"), (("", ""), None),
]


def header_file(text):
    return f'msgid ""\nmsgstr "{po.escape(text)}"\n'.encode()


def test_header_values(spark):
    found = check(entries(spark, *(header_file(FULL.replace(*change, 1) if change[0] else FULL) for change, _ in HEADERS)), Options(select=("header",))).collect()
    got = {r.path: re.search("field '(.*)' in", r.message)[1] for r in found if r.message.startswith("invalid value '")}
    assert got == {f"{k}.po": field for k, (_, field) in enumerate(HEADERS) if field} and len(found) == len(got)


def test_header_fix(spark):
    plain = FULL.replace("Content-Type: text/plain; charset=UTF-8\n", "")
    texts = [plain.rstrip("\n"), plain, "Language: fr", ""]
    fixed = {r.path: r.fixed for r in fix_translations(check(entries(spark, *map(header_file, texts)), Options(select=("header",)))).collect()}
    added = "Content-Type: text/plain; charset=UTF-8\n"
    assert fixed["0.po"] == fixed["1.po"] == plain + added
    assert sorted(fixed["2.po"].split("\n")) == ["", "", "Content-Transfer-Encoding: 8bit", added[:-1], "Language: fr"]
    assert sorted(fixed["3.po"].split("\n")) == ["", "Content-Transfer-Encoding: 8bit", added[:-1]]


def test_unreadable_files(spark, tmp_path):
    (tmp_path / "x.po").write_bytes(catalogue("a\tb", "ab"))
    files = po.list_files(spark, str(tmp_path)).union(spark.createDataFrame([(str(tmp_path / "gone.po"), 5), (str(tmp_path), 5)], "path string, length long"))
    assert {(os.path.basename(r.path), r.error) for r in po.unreadable(files).collect()} == {("gone.po", "No such file or directory (os error 2)"), (tmp_path.name, "Is a directory (os error 21)")}
    assert po.read_listed(files).count() == 2 and po.read_listed(files, size=3).count() == 2
    os.symlink(tmp_path / "loop.po", tmp_path / "loop.po")
    assert {r.rule for r in check_files(spark, str(tmp_path)).collect()} >= {"tabs"}


def test_problem_rows(spark, tmp_path, monkeypatch):
    (tmp_path / "x.po").write_bytes(catalogue("a\tb", "ab"))
    lost = po.list_files(spark, str(tmp_path)).union(spark.createDataFrame([(str(tmp_path / "gone.po"), 5)], "path string, length long"))
    monkeypatch.setattr(po, "list_files", lambda *_: lost)
    found = {(os.path.basename(r.path), r.rule, r.severity) for r in check_files(spark, str(tmp_path), select=("tabs",)).collect()}
    assert found == {("x.po", "tabs", "error"), ("gone.po", "read-error", "error")}
    assert ("gone.po", "read-error") in {(os.path.basename(r.path), r.rule) for r in fix_files(spark, str(tmp_path), options=Options(select=("tabs",))).collect()}


def test_fix_files(spark, tmp_path):
    long = "mot " * 40
    for name in ("x.po", "y.po", "z.po"):
        (tmp_path / name).write_bytes(catalogue(f" {long}", long) if name != "y.po" else catalogue("a|", "a"))
    chosen = Options(select=("whitespace-start", "pipes"))
    left = {(os.path.basename(r.path), r.rule) for r in fix_files(spark, str(tmp_path), options=chosen).collect()}
    assert left == {("y.po", "pipes")} and sorted(p.name for p in tmp_path.iterdir()) == ["x.po", "y.po", "z.po"]
    text = (tmp_path / "x.po").read_text()
    assert max(map(len, text[text.index("msgstr", 80) :].split("\n"))) <= 79 and list(po.parse(text.encode()))[1]["msgstr"][0]["value"] == f" {long}"
    again = (tmp_path / "x.po").stat().st_mtime_ns
    fix_files(spark, str(tmp_path), options=chosen).collect()
    assert (tmp_path / "x.po").stat().st_mtime_ns == again


def test_write_errors(spark, tmp_path):
    (tmp_path / "x.po").write_text("a")
    new = spark.createDataFrame([(str(tmp_path / "x.po"), bytearray(b"b"), 1), (str(tmp_path / "no" / "y.po"), bytearray(b"c"), 2)], "path string, content binary, n int")
    rows = {os.path.basename(r.path): (r.n, r.error) for r in writer.write_contents(new).collect()}
    assert rows == {"x.po": (1, None), "y.po": (2, "No such file or directory (os error 2)")} and (tmp_path / "x.po").read_text() == "b"


def test_writer_gives_all_or_nothing(tmp_path):
    import pyarrow as pa

    (tmp_path / "x.po").write_text("old")
    w = writer._ContentWriter()
    batch = pa.RecordBatch.from_pylist([{"path": str(tmp_path / "x.po"), "content": b"new"}])
    message = w.write(iter([batch]))
    assert (tmp_path / "x.po").read_text() == "old"
    w.abort([message, None])
    assert [p.name for p in tmp_path.iterdir()] == ["x.po"] and (tmp_path / "x.po").read_text() == "old"

    def fails():
        yield batch
        raise RuntimeError

    with pytest.raises(RuntimeError):
        w.write(fails())
    assert [p.name for p in tmp_path.iterdir()] == ["x.po"]
    w.commit([w.write(iter([batch]))])
    assert [p.name for p in tmp_path.iterdir()] == ["x.po"] and (tmp_path / "x.po").read_text() == "new"


def test_entries_written_and_read(spark, tmp_path):
    r = random.Random(2)
    text = lambda: "".join(r.choice("ab \n\t\\\"é日-") for _ in range(r.randrange(200)))
    parts = [f'#, fuzzy, no-wrap\n#~ msgctxt "c"\n#~ msgid "{po.escape(text())}x"\n#~ msgstr "{po.escape(text())}"\n', f'# noqa:tabs;pipes\n#, c-format\nmsgid "{po.escape(text())}x"\nmsgid_plural "p"\nmsgstr[0] "{po.escape(text())}"\nmsgstr[1] "z"\n', '# noqa\nmsgid "q"\nmsgstr ""\n']
    source = (catalogue("a", "b") + b"\n" + "\n".join(parts).encode(), "\n".join(parts).encode())
    rows = entries(spark, *source)
    writer.write_entries(rows, str(tmp_path / "out"))
    again = po.read_catalogues(spark, str(tmp_path / "out"))
    shown = lambda df: sorted((os.path.basename(e.path), e.fuzzy, e.obsolete, e.noqa, e.nowrap, str(e.noqa_rules), e.format_language, str(e.msgctxt and e.msgctxt.value), e.msgid.value, str(e.msgid_plural and e.msgid_plural.value), str([m.value for m in e.msgstr])) for e in df.filter("not is_header").collect())
    assert shown(again) == shown(rows) and again.filter("is_header").count() == 2
    lines = {(e.path, e.entry_idx): [tuple(x) for x in e.lines] for e in rows.select("path", "entry_idx", writer.entry_lines(rows).alias("lines")).collect()}
    assert lines["0.po", 4] == [(lines["0.po", 4][0][0], 'msgid "q"'), (lines["0.po", 4][0][0] + 1, 'msgstr ""')]
    assert [t.split(" ")[0] for _, t in lines["0.po", 3]] == ["msgid", "msgid_plural", "msgstr[0]", "msgstr[1]"] and all(t.startswith("#~ msg") for _, t in lines["0.po", 2])
    assert [r[0] for r in rows.filter("size(keywords) > 0 and entry_idx = 2").select(writer.keyword_lines(F.col("keywords"))).collect()] == [["#, fuzzy", "#, no-wrap"]]
