"""Clashing columns, inputs in no fixed order, empty tables, long values, and plain versions of what SQL can't express."""

import math
import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import BASE, PASSAGE, ROWS, SCHEMA, prose

from polyglint.llm import common, decontamination, exact_dedup, language_id, minhash_dedup, source_mixing, substring_dedup, toxicity, url_filter, warc


@pytest.fixture(scope="module")
def clashing(spark, tmp_path_factory):
    """A table whose columns have the names that operators would like to use."""
    path = str(tmp_path_factory.mktemp("c") / "docs")
    rows = [(k, t, 7, [8], 0.5, "x") for k, t in enumerate([BASE, BASE, BASE + " tail", PASSAGE + " " + prose(20, 4), None, "", prose(90, 5)])]
    spark.createDataFrame(rows, "doc_id long, text string, __pos int, __spans array<int>, Score double, Lang_Pred string").coalesce(1).write.parquet(path)
    return spark.read.parquet(path)


def test_clashing_columns(spark, clashing):
    benchmark = spark.createDataFrame([(1, PASSAGE)], "item_id long, text string")
    for out, n in (
        (exact_dedup.exact_dedup(clashing), 5), (minhash_dedup.near_dedup(clashing), 5), (substring_dedup.remove_passages(clashing), 7),
        (decontamination.remove_spans(clashing, benchmark), 6), (decontamination.remove_spans(clashing, benchmark, whole=False), 7),
    ):
        assert out.columns == clashing.columns
        got = out.collect()
        assert len(got) == n and {(r["__pos"], tuple(r["__spans"]), r.Score) for r in got} == {(7, (8,), 0.5)}
    model = language_id.train(clashing.select("doc_id", "text", F.lit("en").alias("lang")))
    assert {r.lang_pred for r in language_id.identify(clashing, model).collect()} == {"en", "und"}


def test_rows_in_no_fixed_order(spark, clashing):
    shuffled = clashing.select("doc_id", "text").repartition(3).filter(F.rand() >= 0)
    assert {r.doc_id for r in exact_dedup.exact_dedup(shuffled).collect()} == {0, 2, 3, 4, 6}
    assert common.stable(clashing) is clashing and common.stable(shuffled) is not shuffled


def test_helpers(spark):
    with pytest.raises(ValueError, match="more than 1 values"):
        language_id.sample_rates(spark.createDataFrame([("a",), ("b",)], "lang string"), "lang", 5, 1)
    path = common.materialise(spark.range(3), "scratch").inputFiles()[0].rsplit("/", 1)[0]
    assert any(path.endswith(p.rsplit("/", 1)[1]) for p in common._WRITTEN)
    common.clean_up(spark)
    assert not common._WRITTEN
    hot = (np.array([8192], np.int64), np.array([50], np.int64))
    keys = common.deal(np.full(5000, 8192 + 5 * 8), np.arange(5000), hot)
    assert len(set(keys.tolist())) == 50 and {k & ~common.PART_BITS for k in keys.tolist()} == {8192} and common.deal(np.array([24576]), np.array([1]), hot)[0] == 24576


def test_learning_against_plain_ftrl():
    """The vectorised learner against one number at a time."""
    r = random.Random(4)
    rows = [np.array(sorted({1, *(r.randrange(2, 40) for _ in range(6))}), np.int64) for _ in range(300)]
    labels = np.array([int(bool({3, 5} & set(x.tolist()))) for x in rows])
    z, n, counts = defaultdict(float), defaultdict(float), Counter(f for x in rows for f in x.tolist())

    def weight(f):
        if abs(z[f]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[f]) - z[f]) / ((toxicity.BETA + math.sqrt(n[f])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for x, y in zip(rows, labels):
            known = [f for f in x.tolist() if counts[f] >= toxicity.MIN_ROWS]
            w = {f: weight(f) for f in known}
            g = 1 / (1 + math.exp(-max(-35.0, min(35.0, sum(w.values()))))) - y
            for f in known:
                z[f] += g - (math.sqrt(n[f] + g * g) - math.sqrt(n[f])) / toxicity.ALPHA * w[f]
                n[f] += g * g
    names, weights = toxicity.learn(rows, labels)
    want = {f: weight(f) for f in z if weight(f)}
    assert dict(zip(names.tolist(), weights.round(9).tolist())) == {f: round(w, 9) for f, w in want.items()} and want


def test_language_against_plain_backoff(spark):
    texts = {"en": "the cat sat on the mat", "de": "der hund und die katze", "fr": "le chat et la souris", "xx": "zzz"}
    rows = [(k, texts[lang], lang) for k, lang in enumerate(texts)] + [(9, None, "en"), (10, "the", None)]
    model = language_id.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    words = {lang: Counter(t.split()) for lang, t in texts.items()}
    grams = {lang: [Counter(f"_{w}_"[j : j + size] for w, n in words[lang].items() for _ in range(n) for j in range(len(w) + 3 - size)) for size in range(1, 5)] for lang in texts}

    def cost(counts, term):
        return min(language_id.PENALTY, -math.log10(counts[term] / sum(counts.values()))) if counts[term] else language_id.PENALTY

    def word_costs(w):
        if any(words[lang][w] for lang in texts):
            return {lang: cost(words[lang], w) for lang in texts}
        for size in range(4, 0, -1):
            known = [g for g in (f"_{w}_"[j : j + size] for j in range(len(w) + 3 - size)) if any(grams[lang][size - 1][g] for lang in texts)]
            if known:
                return {lang: sum(cost(grams[lang][size - 1], g) for g in known) / len(known) for lang in texts}
        return dict.fromkeys(texts, language_id.PENALTY)

    asked = ["the dog", "katzen", "souris souris", "qqq", "zzzz hund the", "Le Chat!", "x1y"]
    got = {r.text: (r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame([(t,) for t in asked], "text string"), model).collect()}
    for t in asked:
        found = ["".join(c if c.isalpha() else " " for c in t).lower().split()][0]
        mean = {lang: sum(word_costs(w)[lang] for w in found) / len(found) for lang in texts}
        best = min(sorted(mean), key=lambda lang: mean[lang])
        score = 1 / sum(10 ** ((mean[best] - c) * min(len(found), 10)) for c in mean.values())
        assert got[t][1] == pytest.approx(score, rel=1e-4) and mean[got[t][0]] == pytest.approx(mean[best], rel=1e-5), t


def test_edited_passages_are_found_in_a_large_group(spark, tmp_path):
    """Recall of passages with edits, around a line that all documents hold and in documents of their own."""
    r = random.Random(31)
    fresh = lambda n: [f"w{r.getrandbits(50):x}" for _ in range(n)]
    line, texts, pairs = fresh(30), [], []
    for k in range(400):
        common_line = line if k % 2 else fresh(30)
        passage = fresh(30) + common_line + fresh(30)
        edited = list(passage)
        for _ in range(r.choice([1, 1, 2])):
            edited[r.randrange(5, 85)] = f"edit{k}"
        shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
        a, b = shingles(passage), shingles(edited)
        if len(a & b) / len(a | b) >= 0.75:
            pairs.append((len(texts), len(texts) + 1))
        texts += [fresh(20) + passage + fresh(20), fresh(25) + edited + fresh(25)]
    r.shuffle(pairs)
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = {(x.match_doc_id, x.doc_id) for x in substring_dedup.repeated_passages(spark.read.parquet(str(tmp_path / "d"))).collect()}
    recall = {odd: np.mean([p in got for p in pairs if (p[0] // 2) % 2 == odd]) for odd in (0, 1)}
    assert min(recall.values()) >= 0.9 and got <= {(k, k + 1) for k in range(0, 800, 2)}, recall


def test_inserted_and_deleted_words_in_large_groups(spark, tmp_path):
    """Recall of passages of 52 to 90 words with one word more, less or changed, around each of ten lines that many documents hold."""
    r = random.Random(5)
    fresh = lambda n: [f"w{r.getrandbits(50):x}" for _ in range(n)]
    shingles = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    texts, pairs = [], {}
    for number in range(10):
        line = fresh(30)
        for k in range(60):
            size = r.choice([52, 56, 60, 70, 90])
            passage = fresh((size - 30) // 2) + line + fresh(size - 30 - (size - 30) // 2)
            edited, at = list(passage), r.randrange(5, size - 5)
            edited[at : at + (k % 3 > 0)] = [] if k % 3 == 2 else fresh(1)
            a, b = shingles(passage), shingles(edited)
            assert len(a & b) / len(a | b) >= 0.75
            pairs[len(texts), len(texts) + 1] = number, k % 3
            texts += [fresh(20) + passage + fresh(20), fresh(25) + edited + fresh(25)]
    order = r.sample(range(len(texts)), len(texts))
    spark.createDataFrame([(k, " ".join(texts[k])) for k in order], "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    found = substring_dedup.repeated_passages(spark.read.parquet(str(tmp_path / "d"))).select("doc_id", "match_doc_id").collect()
    got = {(min(x), max(x)) for x in found}
    for which in (0, 1):
        recall = {g: np.mean([p in got for p, v in pairs.items() if v[which] == g]) for g in {v[which] for v in pairs.values()}}
        assert min(recall.values()) >= 0.9, recall
    assert got <= set(pairs)


def test_repeated_rows_have_repeated_passages(spark, tmp_path):
    spark.createDataFrame([(1, PASSAGE), (1, PASSAGE), (None, PASSAGE)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    got = substring_dedup.repeated_passages(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert Counter((x.doc_id, x.match_doc_id, x.n_words, x.similarity) for x in got) == Counter([(1, 1, 70, 1.0), (None, 1, 70, 1.0)])


def test_mixing_of_ties_nulls_and_repeats(spark):
    """Against brute force: every use stands where the running sum of its source has it."""
    rows = [(None if k % 11 == 0 else k % 40, "x" * (4 * (k % 3)), [None, "a", "b"][k % 3]) for k in range(120)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    tokens = lambda t: max(1, -(-len(t) // 4))
    weights = {w.source: w for w in source_mixing.source_weights(spark.createDataFrame(list(Counter({s: 0 for _, _, s in rows}).keys() and {s: sum(tokens(t) for _, t, x in rows if x == s) for _, _, s in rows}.items()), "source string, tokens long")).collect()}
    got = source_mixing.mix_sources(table).collect()
    for source, w in weights.items():
        own, spent = Counter((d, tokens(t)) for d, t, s in rows if s == source), Counter()
        for r in (r for r in got if r.source == source):
            spent[r.epoch] += r.n_tokens
            assert own[r.doc_id, r.n_tokens]
        whole = sum(n * c for (_, n), c in own.items())
        assert all(spent[e] == whole for e in range(max(spent))) and sum(spent.values()) >= w.budget > sum(spent.values()) - 3


def test_ranks_reach_far_hosts(spark):
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [(k, f"http://h{k}.org/", link(f"h{k + 1}.org")) for k in range(15)] + [(15, "http://h15.org/", None), (None, "http://bad.org/", link("x.org")), (20, "http://far.org/" + "y" * 200_000, ""), (21, "http://pre.org/", link("bad.org"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"host": F.lit(1), "rule": F.lit(2), "fit": F.lit(3)})
    rules = [("h15.org", "/", "block"), ("bad.org", "/", "block")]
    got = {r.page_id: (r.host, r.verdict) for r in url_filter.judge_urls(pages, rules).collect()}
    assert all(got[k] == (f"h{k}.org", "block") for k in range(16)) and got[None] == ("bad.org", "block") and got[20] == ("far.org", "allow") and got[21][1] == "block"
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    many = [*rules, *((f"z{k}.net", f"/{k}", "allow") for k in range(300)), ("net", "/", "block"), ("", "/", "allow"), ("org", "/y", "allow"), ("far.org", "/yy", "block")]
    odd = pages.union(spark.createDataFrame([(30 + k, u, None, 1, 2, 3) for k, u in enumerate(["http://a.z7.net/7/x", "http://z7.net/8", None, "nothing", "http://..net/"])], pages.schema))
    rows_ = odd.select(url_filter.host_of(F.col("url")).alias("host"), url_filter.path_of(F.col("url")).alias("path"))
    joined = url_filter.join_rules(rows_, spark.createDataFrame(many, "host string, path string, verdict string")).select("host", "path", "fit")
    planned = rows_.withColumn("fit", url_filter.match_rule(F.col("host"), F.col("path"), many))
    assert Counter(map(str, joined.collect())) == Counter(map(str, planned.collect()))


def test_long_payloads(spark):
    rows = [(1, "u", "x" * 3_000_000), (2, "u", "x" * 3_000_000), (3, "v", "é" * 1_000_000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"record_type": F.lit("r"), "payload": F.lit("p"), "pos": F.lit(0)})
    got = {warc_id: (t, n) for warc_id, t, n in warc.archive(pages).select(warc.record_key(F.col("record_id")), "record_type", "payload_bytes").collect()}
    assert got == {"1": ("revisit", 3_000_000), "2": ("response", 3_000_000), "3": ("response", 2_000_000)}


def test_archives_of_unlike_payloads_are_cut_by_bytes(spark, tmp_path, monkeypatch):
    """One partition, a few payloads a thousand times the mean: no file is longer than its bound or its one record."""
    monkeypatch.setattr(warc, "BYTES_PER_FILE", 1 << 17)
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 100)
    r = random.Random(3)
    sizes = {k: r.choice([10, 10, 10, 2_000, 30_000, 300_000]) for k in range(300)}
    pages = spark.createDataFrame([(k, "u", f"{k:09}" + "x" * n) for k, n in sizes.items()], "page_id long, url string, html string").coalesce(1)
    got = {int(key): (t, n) for key, t, n in warc.archive(pages, str(tmp_path / "w")).select(warc.record_key(F.col("record_id")), "record_type", "payload_bytes").collect()}
    assert got == {k: ("response", n + 9) for k, n in sizes.items()}
    for path in (tmp_path / "w").rglob("part-*"):
        lengths = [len(row[5]) for row in warc._records(path.read_bytes())]
        assert len(lengths) <= 100 and (sum(lengths) <= 1 << 17 or len(lengths) == 1), (path, lengths)


def test_empty_pipeline(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, PASSAGE)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert ROWS
