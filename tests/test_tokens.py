import re
import time

import pytest
from pyspark.sql import functions as F

from polyglint.functions import text as T

# kind, dialect, text, tokens with their places
CASES = [
    ("word", None, "use 'Linux' now, rock'n'roll", ["use 0 3", "Linux 5 10", "now 12 15", "rock'n'roll 17 28"]),
    ("word", "C", "%sAPI NATO %% s %", ["API 2 5", "NATO 6 10", "s 14 15"]),
    ("word", "Java", "{0,choice,1#{2}} B 'q r' it''s", ["B 17 18", "it''s 25 30"]),
    ("format", "C", "50%% of %1$s, %-5.2lf %", ["%1$s 8 12", "%-5.2lf 14 21"]),
    ("format", "Java", "'{0}' {1,number,{2}} {x}", ["{1,number,{2}} 6 20"]),
    ("format", "Java", "{0" + "{a" * 12 + "}" * 13, ["{0" + "{a" * 12 + "}" * 13 + " 0 39"]),
    ("format", "Python", "%(a)s %d %(b", ["%(a)s 0 5", "%d 6 8", "%(b 9 12"]),
    ("format", "Python brace", "{x} {{y}} {z", ["{x} 0 3", "{z 10 12"]),
    ("acronym", "C", "%dAPI l'HTTP MP3 Json X", ["API 2 5", "HTTP 8 12", "MP3 13 16"]),
    ("accelerator", "C", "&File && x%&y & z", ["& 0 1", "& 11 12"]),
    ("URLs", "C", "%shttp://a.org <https://b.org/%d/x> c://d", ["http://a.org 2 14", "https://b.org/%d/x 16 34"]),
    ("emails", None, "<me@x.org> „you@y.org” \"@\". a@b", ["me@x.org 1 9", "you@y.org 12 21"]),
    ("paths", None, "é /usr/lib/x ~/y ./z /a /b/", ["/usr/lib/x 2 12", "~/y 13 16", "./z 17 20"]),
    ("HTML tags", None, '<a href="x>y">t</b> < c <d', ['<a href="x>y"> 0 14', "</b> 15 19"]),
    ("functions", "C", "a.b::c() x->%sy() no( z() 1()", ["a.b::c() 0 8", "x->%sy() 9 17", "z() 22 25", "1() 26 29"]),
]


def shown(kind, s, dialect):
    if kind == "word":
        out = T.located_words(s, dialect)
    elif kind in T.ALIKE:
        out = T.located_alike(s, dialect, kind)
    else:
        out = T.located(s, dialect, T.accelerator_kind("&") if kind == "accelerator" else kind)
    out = F.filter(out, lambda t: T.is_acronym(t["s"])) if kind == "acronym" else out
    return F.transform(out, lambda t: F.concat_ws(" ", t["s"], t["start"].cast("string"), t["end"].cast("string")))


def test_tokens(spark):
    for kind in dict.fromkeys(c[0] for c in CASES):
        cases = [c for c in CASES if c[0] == kind]
        df = spark.createDataFrame([(k, c[1], c[2]) for k, c in enumerate(cases)], "k int, d string, s string")
        for r in df.select("k", shown(kind, F.col("s"), F.col("d")).alias("found")).collect():
            assert r.found == cases[r.k][3], cases[r.k]


def test_formats_leave_one_marker(spark):
    df = spark.createDataFrame([("C", "50%%off %d"), ("Java", "it''s {0} 'q'"), ("Python brace", "{{a}} {b}"), (None, "%%")], "d string, s string")
    assert [r[0] for r in df.select(T.without_formats(F.col("s"), F.col("d"))).collect()] == ["50%off ", "it's  '", "{a}} ", "%%"]


def test_positions_against_python(spark):
    texts = ["", "a", "\t", "a\tb\t\t", "é\t😀\t", "x\ty" * 300]
    df = spark.createDataFrame([(t,) for t in texts], "s string")
    for r in df.select("s", T.positions(F.col("s"), "\t+").alias("m"), T.char_positions(F.col("s"), "\ty").alias("c")).collect():
        assert [tuple(x) for x in r.m] == [m.span() for m in re.finditer("\t+", r.s)] and [tuple(x) for x in r.c] == [m.span() for m in re.finditer("[\ty]", r.s)]


def test_places_take_no_square_of_time(spark):
    def seconds(n):
        df = spark.range(1).select(F.repeat(F.lit("ab  "), n).alias("s")).select(T.positions(F.col("s"), "  ").alias("m"))
        df.write.format("noop").mode("overwrite").save()
        began = time.time()
        assert df.select(F.element_at("m", -1)["end"].alias("e")).first()[0] == 4 * n
        return time.time() - began

    seconds(2_000)
    assert seconds(64_000) < 10 * seconds(8_000) + 5


@pytest.mark.parametrize("text", ["<a " + "'" * 20_001, "%s" * 30_000, "{" * 50_000, "a" * 200_000, "((" * 30_000])
def test_long_texts(spark, text):
    df = spark.createDataFrame([(text, d) for d in (None, "C", "Java", "Python", "Python brace")], "s string, d string")
    columns = [F.size(T.alike(F.col("s"), F.col("d"), what)).alias(what.replace(" ", "")) for what in T.ALIKE] + [F.size(T.words(F.col("s"), F.col("d"))).alias("words")]
    assert len(df.select(*columns).collect()) == 5
