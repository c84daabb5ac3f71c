from hypothesis import given, settings
from hypothesis import strategies as st

from polyglint.sources.po import CatalogueSource, escape, parse, parse_files, read_catalogues, unescape

FILE = b"""# first
msgid ""
msgstr ""
"Language: fr_CA\\n"
"Content-Type: text/plain; charset=ISO-8859-15\\n"
"Plural-Forms: nplurals=2; plural=n>1;\\n"

#, fuzzy, c-format
msgctxt "menu"
msgid "one\\n"
"two"
msgstr "\xe9t\xe9"


# noqa:tabs;blank
msgid "drawer"
msgid_plural "drawers"
msgstr[0] "tiroir"
msgstr[1] "tiroirs"
msgstr[x] "no"

#~ msgid "old"
#~ msgstr "vieux\\\\n"
"""


def test_entries():
    header, first, plural, old = parse(FILE)
    assert header["is_header"] and header["language"] == "fr_CA" and header["language_code"] == "fr" and header["country"] == "CA" and header["nplurals"] == 2
    assert first["fuzzy"] and first["format_language"] == "C" and first["keywords"] == ["fuzzy", "c-format"] and first["line_number"] == 8
    assert first["msgid"]["value"] == "one\ntwo" and first["msgstr"][0]["value"] == "été" and first["msgctxt"]["value"] == "menu"
    assert plural["noqa_rules"] == ["tabs", "blank"] and not plural["noqa"] and [m["value"] for m in plural["msgstr"]] == ["tiroir", "tiroirs"]
    assert old["obsolete"] and old["msgstr"][0]["value"] == "vieux\\n" and old["is_translated"]


def test_ranges_cover_the_file():
    entries = list(parse(FILE))
    first = entries[1]
    assert FILE[first["msgstr"][0]["byte_start"] : first["msgstr"][0]["byte_end"]].startswith(b"msgstr")
    assert entries[-1]["byte_end"] == len(FILE) and entries[0]["byte_start"] == 0


def test_wrong_charset_is_marked():
    (entry,) = parse(b'msgid "a"\nmsgstr "\xe9"')
    assert entry["encoding_error"] and entry["msgstr"][0]["value"] == "�"


def test_gap_in_plurals_stops_unescaping():
    (entry,) = parse(b'msgid "a"\nmsgid_plural "b"\nmsgstr[0] "x\\n"\nmsgstr[2] "y\\n"')
    assert [m["value"] for m in entry["msgstr"]] == ["x\n", "y\\n"]


def test_repeated_keyword_and_single_quote():
    (entry,) = parse(b'msgid "a"\nmsgid "b"\nmsgstr "\n')
    assert entry["msgid"]["value"] == "b" and entry["msgstr"][0]["value"] == ""


@settings(deadline=None)
@given(st.text())
def test_escape_round_trip(s):
    assert unescape(escape(s)) == s


def test_readers_agree(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.po").write_bytes(FILE)
    (tmp_path / "y.PO").write_bytes(FILE)
    rows = read_catalogues(spark, str(tmp_path)).drop("path").collect()
    spark.dataSource.register(CatalogueSource)
    source = spark.read.format("po").load(str(tmp_path)).drop("path").collect()
    memory = parse_files(spark.createDataFrame([("x", bytearray(FILE))], "path string, content binary")).drop("path").collect()
    key = lambda r: r["entry_idx"]
    assert len(rows) == 4 and sorted(rows, key=key) == sorted(source, key=key) == sorted(memory, key=key)
