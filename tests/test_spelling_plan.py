"""How often a spelling check reads its texts, and what it finds."""

from test_rules import catalogue, entries

from polyglint.operators.rules import Options
from polyglint.plans.check import check


def test_texts_are_read_once_for_words(spark, tmp_path):
    entries(spark, catalogue("a", "known Word 2nd NATO wrong"), catalogue("b", "wrong wrong other")).write.parquet(f"{tmp_path}/entries")
    rows = spark.read.parquet(f"{tmp_path}/entries")
    spark.createDataFrame([(lang, w) for lang in ("fr", "en", "de") for w in ("KNOWN", "word", "other")], "language string, word string").write.parquet(f"{tmp_path}/words")
    found = check(rows.filter("not is_header").withColumn("language", rows["language_code"].substr(1, 0).cast("string")).fillna("fr", ["language"]).replace("", "fr", ["language"]), Options(select=("spelling-str",)), spark.read.parquet(f"{tmp_path}/words"), marks=False)
    assert sorted(r.message for r in found.collect()) == ["misspelled words in translation: wrong"] * 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("msgstr#") > 0 and plan.count("Relation [path") == 2  # for words, and for the rows that have some
