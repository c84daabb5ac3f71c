"""The pipeline against brute force, stage by stage, on a small table."""

import re
from collections import Counter

import corpus_pipeline
from test_operators import PASSAGE, components, norm, prose

from polyglint.llm import source_mixing


def test_pipeline(spark, tmp_path):
    import random

    texts = {k: prose(60 + k % 9, 1000 + k) for k in range(80)}
    texts |= {100: texts[3], 101: texts[3].replace(" ", "  "), 102: texts[4] + " x", 103: "...", 104: None, 105: PASSAGE + " " + prose(30, 5), 106: ""}
    rows = [(k, t, "en" if random.Random(k).random() < 0.9 else None, f"s{k % 3}", len(t or ""), 7) for k, t in texts.items()]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, kept long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))

    kept = {k: t for k, t in texts.items() if re.search(r"[^\W\d_]", t or "")}
    groups = {}
    for k in sorted(kept, key=lambda k: (-len(kept[k]), k)):
        groups.setdefault(norm(kept[k]), k)
    exact = {k: kept[k] for k in groups.values()}
    _, component = components(exact)
    near = {k: t for k, t in exact.items() if component[k] == k}
    clean = {k: t for k, t in near.items() if PASSAGE not in t}

    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for (_, stage), want in zip(corpus_pipeline.STAGES[:-1], (kept, exact, near, clean)):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        assert {r.doc_id: r.text for r in out.collect()} == want
        docs = spark.createDataFrame(out.collect(), docs.schema)
    mixed = corpus_pipeline.run(spark, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} <= set(clean) and mixed.count() > 0.8 * len(clean)
    # The last stage alone is held against brute force in test_cases.
    assert Counter(map(tuple, mixed.collect())) == Counter(map(tuple, source_mixing.mix_sources(docs).collect()))
