"""Ranges against brute force, places in an editor, fixes from other tools."""

import random

from pyspark.sql import functions as F
from test_rules import catalogue, entries

from polyglint.functions.positions import byte_offset, editor_ranges, utf16_offset
from polyglint.operators.ranges import meeting, overlapping, within
from polyglint.operators.rewrite import placed
from polyglint.operators.rules import Options
from polyglint.plans.check import check


def test_ranges(spark):
    r = random.Random(4)
    some = lambda n, most: [("ab"[r.randrange(2)], a, a + r.randrange(most)) for a in (r.randrange(300) for _ in range(n))]
    inner, outer = some(200, 12) + [("a", 0, 0), ("a", 5, 5), ("b", 16, 32), (None, 1, 2), ("a", None, 3)] * 2, some(25, 60) + [("a", 5, 5), ("a", 0, 0), ("b", 16, 32), ("b", 0, 16), ("a", None, 9)]
    table = lambda rows: spark.createDataFrame([(*x, k) for k, x in enumerate(rows)], "path string, start long, end long, k int")
    holds = lambda x: any(None not in (*x, *o) and o[0] == x[0] and o[1] <= x[1] and x[2] <= o[2] for o in outer)
    for size in (8, 16, 1 << 14):
        assert sorted(y.k for y in within(table(inner), table(outer), size=size).collect()) == [k for k, x in enumerate(inner) if holds(x)]
        assert sorted(y.k for y in within(table(inner), table(outer), "left_anti", size).collect()) == [k for k, x in enumerate(inner) if not holds(x)]
        meets = lambda x: None not in x and any(None not in y and y[0] == x[0] and y[1:] != x[1:] and y[1] < x[2] and x[1] < y[2] and y[1] < y[2] for y in inner) and x[1] < x[2]
        assert sorted(y.k for y in overlapping(table(inner), size).collect()) == [k for k, x in enumerate(inner) if meets(x)]


def test_empty_ranges_inside_others(spark):
    r = random.Random(5)
    some = {("ab"[r.randrange(2)], a, a + r.randrange(4)) for a in (r.randrange(90) for _ in range(60))} | {("c", 0, 0), ("c", 0, 3), ("c", 3, 3), ("c", 16, 16), ("c", 9, 40), ("c", 40, 40)}
    meets = lambda x: any(y[0] == x[0] and y != x and y[1] < x[2] and x[1] < y[2] for y in some)
    for size in (8, 16, 1 << 14):
        found = meeting(spark.createDataFrame([*some, *some, (None, 1, 9), (None, 2, 3)], "path string, start long, end long"), size, empty=True)
        assert sorted(map(tuple, found.collect())) == sorted(x for x in some if meets(x))


def test_ranges_left_of_repeated_and_empty_ranges(spark, tmp_path):
    import duckdb

    from polyglint import file_queries

    rows = [(k % 900, "x" * (k * 37 % 400), f"src{k % 2}") for k in range(1200)]
    spark.createDataFrame([(d, t, "en", s, len(t)) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.sql(file_queries.ORACLE_SQL["ranges_left"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert any(s == e and hit for _, _, s, e, hit in want)
    assert sorted(map(tuple, file_queries.ranges_left(spark, str(tmp_path)).collect())) == sorted(want)


def test_fixes_of_other_tools(spark):
    parsed = entries(spark, catalogue("a", "b") + b'\nmsgid "c"\nmsgstr "d"\n')
    spans = {m.value: (m.byte_start, m.byte_end) for e in parsed.collect() for m in e.msgstr}
    table = lambda rows, columns: spark.createDataFrame(rows, columns)
    fixed = table([("0.po", *spans["b"], "B"), ("0.po", *spans["d"], "D"), ("0.po", 1, 2, "no place"), ("9.po", 0, 9, "no file")], "path string, start long, end long, value string")
    gone = table([("0.po", spans["d"][0] - 11, spans["d"][1])], "path string, start long, end long")
    assert {(r.start, r.value) for r in placed(parsed, fixed, gone).collect()} == {(spans["b"][0], "B"), (spans["d"][0] - 11, None)}


def test_offsets(spark):
    row = spark.createDataFrame([("a\U0001f600é€b",)], "t string").select(*(f(F.col("t"), F.lit(k)) for k in range(6) for f in (utf16_offset, byte_offset))).first()
    assert list(row) == [0, 0, 1, 1, 3, 5, 4, 7, 5, 10, 6, 11]


def test_editor_places(spark):
    texts = [("a|b", "\U0001f600 x||y"), ("a", 'q"|'), ("a|", "none"), ("a", "two\n|"), ("a|", "é|é|")]
    files = [catalogue(s, t) for s, t in texts]
    found = check(entries(spark, *files), Options(select=("pipes",)))
    buffers = spark.createDataFrame([(f"{k}.po", f.decode()) for k, f in enumerate(files)], "path string, text string")
    got = {r.path: tuple(r.range) for r in editor_ranges(found, buffers).collect()}
    lines = [f.decode().split("\n") for f in files]
    at = {k: next(n for n, x in enumerate(x) if x.startswith("msgstr") and n > 1) for k, x in enumerate(lines)}
    whole = lambda k: (at[k], 0, at[k], len(lines[k][at[k]].encode("utf-16-le")) // 2)
    assert got == {"0.po": (at[0], 12, at[0], 14), "1.po": whole(1), "2.po": whole(2), "3.po": whole(3), "4.po": (at[4], 9, at[4], 12)}
