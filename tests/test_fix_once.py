"""How often fixing parses files."""

from polyglint import queries


def test_only_files_with_fixable_findings_are_parsed_again(spark, tmp_path, monkeypatch):
    spark.createDataFrame([(k, f"Some text {k}. ", "en", "s", 12) for k in range(60)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    parsed, parse = [], queries.parse_files
    monkeypatch.setattr(queries, "parse_files", lambda files: parsed.append(files.count()) or parse(files))
    fixed = queries.fix_files(spark, str(tmp_path)).count()
    assert parsed[0] == 60 and len(parsed) == 3 and 0 < fixed <= min(parsed[1:]) and max(parsed[1:]) < 40
