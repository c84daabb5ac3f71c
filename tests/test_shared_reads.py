"""What several rules read of a text is read once, and says the same as each rule alone."""

from pyspark.sql import functions as F
from test_rules import catalogue, entries

from polyglint.functions import text as T
from polyglint.operators.rules import Options
from polyglint.plans.check import check

RULES = ("brackets", "escapes", "tabs", "force-trans", "no-trans", "double-words")


def test_rules_together_and_alone(spark):
    some = [("(s) (S) () x", "(x) \\\\\\\\ y"), ("the \\\\\\\\ of \\\\ [a] {b}", "The \\\\ of of the"), ("the of, 'la' the", "the the of «la»\t"), ("été de THE", "é é ÉTÉ the DE DE")]
    rows = entries(spark, *(catalogue(a, b) for a, b in some)).cache()
    options = {"force_trans": ("the",), "no_trans": ("of", "la", "de")}
    of = lambda *names: check(rows, Options(select=names, **options), marks=False)
    keys = ("path", "rule", "severity", "message")
    together = of(*RULES)
    alone = [tuple(r) for name in RULES for r in of(name).select(*keys).collect()]
    assert sorted(map(tuple, together.select(*keys).collect())) == sorted(alone) and len({r[1] for r in alone}) == len(RULES)
    plan = together._jdf.queryExecution().optimizedPlan().toString()
    assert "src_signs" in plan and "tgt_words" in plan


def test_white_space_and_controls(spark):
    white = "\t\n\x0b\f\r \x85\xa0        　"
    texts = [white + "a" + white + "é" + white, white, "", "\x1c a ​", "a\x00", "é﻿", "\U0001f600 é ‐", "a­b", "plain\n\r\t text"]
    s = F.col("s")
    rows = spark.createDataFrame([(x,) for x in texts], "s string").select(T.trim(s), F.regexp_replace(s, r"(?U)^\s+|\s+\z", ""), T.has_control(s), s.rlike(f"[{T.CONTROL}]")).collect()
    assert [r[0] for r in rows] == [r[1] for r in rows] and [r[2] for r in rows] == [r[3] for r in rows]
