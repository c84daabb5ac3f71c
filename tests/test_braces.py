"""Specifications with any number of levels, against a scanner of one character at a time."""

import random

import pytest
from pyspark.sql import functions as F
from test_rules import catalogue, entries

from polyglint.functions import text as T
from polyglint.operators.rules import Options
from polyglint.plans.check import check


def specs(s, java):
    out, k = [], 0
    while k < len(s):
        if not java and s.startswith("{{", k):
            k += 2
        elif java and s[k] == "'":
            end = s.find("'", k + 1)
            k = k + 1 if end < 0 else end + 1
        elif s[k] == "{" and (s[k + 1 : k + 2].isdigit() if java else k + 1 < len(s)):
            begin, depth, k = k, 1, k + 1
            while k < len(s) and depth:
                if java and s[k] == "'":
                    end = s.find("'", k + 1)
                    k = len(s) if end < 0 else end + 1
                    continue
                depth += {"{": 1, "}": -1}.get(s[k], 0)
                k += 1
            out.append(s[begin:k])
        else:
            k += 1
    return out


@pytest.mark.parametrize("dialect", ["Java", "Python brace"])
def test_levels(spark, dialect):
    r = random.Random(9)
    texts = ["{1," * 1000 + "x" + "}" * 1000 + " {2}", "{1" * 40 + "}" * 39, "a {0}" + "{1 {2}} " * 30 + "{", "{1 '}" + "{" * 30 + "' } {3}", "it's {0} " + "{{" * 20 + "{4}"]
    texts += ["".join(r.choice("{{{}}}'1a ") for _ in range(r.randrange(60, 160))) for _ in range(150)] + ["{1'{'" * 30 + "}" * 31, "plain", "{0}"]
    rows = spark.createDataFrame([(k, t, dialect) for k, t in enumerate(texts)], "k int, s string, d string")
    read = T.format_specs(F.coalesce(T.flat(F.col("s"), F.col("d")), F.col("s")), dialect)
    got = {x.k: x.specs for x in rows.select("k", F.transform(read, T.unflat).alias("specs")).collect()}
    for k, t in enumerate(texts):
        assert got[k] == specs(t, dialect == "Java"), t
    assert sum(t.count("{") > T.NESTING for t in texts) > 20


def test_rules_on_deep_texts(spark):
    deep = "{1," * 50 + "{}" + "}" * 50
    rows = entries(spark, catalogue(f"x {deep} http://a.org/{deep}", f"x {deep} http://b.org/{deep}", flag="java-format"), catalogue(f"a {deep}", "a " + deep.replace("{}", "{ }"), flag="java-format"), catalogue(f"a {deep} b b", f"a {deep} b b", flag="java-format"))
    found = check(rows, Options(select=("formats", "urls", "double-words")))
    got = {(r.path, r.rule): r for r in found.collect()}
    assert set(got) == {("0.po", "urls"), ("1.po", "formats"), ("2.po", "double-words")}
    assert [tuple(m) for m in got["1.po", "formats"].src_marks] == [(2, 2 + len(deep))] and got["0.po", "urls"].edits[0].replacement.startswith("http://a.org/") and "" not in str(got)
