"""Options as columns: what rows with options of their own get is what a check with those options gives."""

import dataclasses
import os
from collections import Counter

from pyspark.sql import functions as F
from test_rules import catalogue, entries

from polyglint.operators.rules import OPTIONS, Options, select_rules
from polyglint.plans.check import check, check_by_row
from polyglint.plans.files import check_files, settings
from polyglint.sources import config

TEXTS = [("&File NATO linux... (s)", "_Datei NATO Linux…: x x", "fr_FR"), ("a b", "a b" * 9, "de"), ("Open the file", "open Open the wrod", "fr_CA"), ("x|\ty", "", "fr"), ("%s _a", "%d &a", "fr")]
CHOICES = [
    Options(select=("accelerators", "acronyms", "force-trans", "no-trans", "tabs"), accelerator="_", force_trans=("linux", "open"), no_trans=("nato", "file")), Options(select=("long", "short", "punc-end", "accelerators"), long_factor=20, short_factor=2, punc_ignore_ellipsis=True, obsolete=True, noqa=True),
    Options(select=("punc-end", "fuzzy", "untranslated", "tabs"), severity=("info",), fuzzy=True), Options(select=("spelling-str", "spelling-id", "acronyms"), ignore=("acronyms",), lang_id="de", langs=("fr_CA", "fr", "de")),
]


def row_of(o):
    values = config.as_dict(o)
    lower = lambda v: [w.lower() for w in v]
    return tuple(lower(values[f.name]) if f.name in ("force_trans", "no_trans") else list(values[f.name]) if isinstance(values[f.name], tuple) else values[f.name] for f in dataclasses.fields(Options))


def test_options_of_rows(spark):
    parsed = entries(spark, *(catalogue(s, t, lang) + b'\n#, fuzzy\nmsgid "f"\nmsgstr "f."\n\n# noqa\nmsgid "n"\nmsgstr "n n."\n\n#~ msgid "o"\n#~ msgstr "o:"\n' for s, t, lang in TEXTS)).cache()
    words = spark.createDataFrame([("fr", "open"), ("fr", "the"), ("de", "open"), ("de", "file")], "language string, word string")
    table = spark.createDataFrame([(k, row_of(o), [r.name for r in select_rules(o.select, o.ignore)]) for k, o in enumerate(CHOICES)], f"k int, options {OPTIONS}, rules array<string>")
    rows = parsed.crossJoin(F.broadcast(table)).withColumn("path", F.concat(F.col("k").cast("string"), F.lit("/"), "path"))
    found = check_by_row(rows, {r.name for o in CHOICES for r in select_rules(o.select, o.ignore)}, words)
    columns = ["entry_idx", "pair_idx", "rule", "severity", "message", "line_number", "src_marks", "tgt_marks", "edits"]
    got = Counter(str((r.path, *(r[c] for c in columns))) for r in found.collect())
    want = Counter(str((f"{k}/{r.path}", *(r[c] for c in columns))) for k, o in enumerate(CHOICES) for r in check(parsed, o, words).collect())
    assert got == want and len(want) > 20


def test_many_configurations_are_one_plan(spark, tmp_path):
    for k in range(60):
        (tmp_path / f"d{k}").mkdir()
        (tmp_path / f"d{k}" / ".polyglint.toml").write_text(f'[check]\nselect = ["tabs", "long"]\nlong_factor = {2 + k % 7}\nseverity = {["[]", chr(34).join(["[", "error", "]"])][k % 2]}\n')
        (tmp_path / f"d{k}" / "x.po").write_bytes(catalogue("a\tb", "ab" * 6))
    found = check_files(spark, str(tmp_path))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") <= 8
    got = Counter((int(os.path.basename(os.path.dirname(r.path))[1:]), r.rule) for r in found.collect())
    assert got == Counter([(k, "tabs") for k in range(60)] + [(k, "long") for k in range(60) if 3 * (2 + k % 7) <= 12 and k % 2 == 0])
    assert settings(spark, str(tmp_path)).filter("settings is not null").count() == 60


def test_personal_words_by_configuration(spark, tmp_path):
    for name, words in (("a", "wrod\n"), ("b", "")):
        (tmp_path / name / "words").mkdir(parents=True)
        (tmp_path / name / "words" / "fr.dic").write_text(words)
        (tmp_path / name / "polyglint.toml").write_text('[check]\nselect = ["spelling-str"]\npath_words = "words"\n')
        (tmp_path / name / "x.po").write_bytes(catalogue("a", "mot wrod", "fr_FR"))
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.po").write_bytes(catalogue("a", "mot", "xx"))
    (tmp_path / "c" / "polyglint.toml").write_text('[check]\nselect = ["spelling-str"]\n')
    words = spark.createDataFrame([("fr", "mot")], "language string, word string")
    found = {(os.path.basename(os.path.dirname(r.path)), r.rule, r.message.split(" (")[0]) for r in check_files(spark, str(tmp_path), dictionaries=words).collect()}
    assert found == {("b", "spelling-str", "misspelled words in translation: wrod"), ("c", "spelling-str", "dictionary not found for language 'xx'")}
