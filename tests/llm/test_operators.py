"""Small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from polyglint.llm import common, decontamination, exact_dedup, language_id, minhash_dedup, source_mixing, substring_dedup, token_counts, toxicity, url_filter, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, pos long, score double, kept string, n long"
_R = random.Random(3)
WORDS = ["".join(_R.choice("abcdefgh") for _ in range(_R.randint(2, 7))) for _ in range(400)]


def prose(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


BASE = prose(300, 1)
PASSAGE = prose(70, 2)
TEXTS = [
    None, "", " \n\t", "one", "One", "two words", BASE, BASE, BASE.replace(" ", "\n"), BASE + " tail", "head " + BASE, prose(200, 3) + " " + PASSAGE + " " + prose(100, 4), prose(150, 5) + " " + PASSAGE,
    PASSAGE, "same " * 400, "same " * 300 + prose(60, 6), prose(20_000, 7), "é€😀 ß \x85   x", prose(12, 8), prose(13, 9), "a" * 5000,
]
ROWS = [(k, t, None if k % 5 == 0 else ("en" if k % 2 else "fr"), None if k % 7 == 0 else "s", k, 1, 0.5, "x", 2) for k, t in enumerate(TEXTS)]
ROWS += [(None, BASE, "en", "s", 0, 1, 0.5, "x", 2), (None, None, None, None, 0, 1, 0.5, "x", 2), ROWS[9], ROWS[9]]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("t") / "docs")
    spark.createDataFrame(ROWS, SCHEMA).coalesce(2).write.parquet(path)
    return spark.read.parquet(path)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]", "", t or "")


def test_exact(docs, empty):
    got = exact_dedup.exact_groups(docs).collect()
    groups = defaultdict(list)
    for r in ROWS:
        groups[norm(r[1])].append(r)
    assert len(got) == len(ROWS) and sum(g.kept for g in got) == len(groups)
    by_sha = {hashlib.sha256(n.encode()).hexdigest(): rows for n, rows in groups.items()}
    for g in got:
        rows = by_sha[g.text_sha256]
        best = min(rows, key=lambda r: (-len(r[1] or ""), r[0] is None, r[0] or 0))
        assert g.keep_id == best[0] and g.group_size == len(rows)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.exact_dedup(empty).columns == empty.columns
    stay = exact_dedup.exact_dedup(docs)
    assert stay.columns == docs.columns and stay.count() == len(groups)


def shingles(t):
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if x]
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def components(texts):
    """Least id reachable over links, per id."""
    sets = {k: shingles(t) for k, t in texts.items()}
    parent = {k: k for k in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in texts:
        for b in texts:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return sets, {k: find(k) for k in texts}


def test_near(spark, docs, empty):
    rows = minhash_dedup.near_duplicates(docs).collect()
    sets, want = components({r[0]: r[1] for r in ROWS if r[0] is not None})
    assert len(rows) == len(ROWS)
    for r in rows:
        if r.doc_id is not None:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id), r
    assert {(r.n_shingles, r.component_id) for r in rows if r.doc_id is None} == {(len(shingles(BASE)), 6), (0, None)}
    assert minhash_dedup.near_duplicates(empty).count() == 0 and minhash_dedup.near_dedup(docs).columns == docs.columns


def test_near_dense_region(spark, tmp_path, monkeypatch):
    """Many copies of one text with edits: regions above SMALL and several blocks."""
    monkeypatch.setattr(minhash_dedup, "SMALL", 4)
    monkeypatch.setattr(minhash_dedup, "BLOCK", 16)
    base, texts = prose(120, 11).split(), {}
    for k in range(90):
        w = list(base)
        for _ in range(k % 7):
            w[random.Random(k * 31 + _).randrange(len(w))] = f"edit{k}"
        texts[k] = " ".join(w)
    texts |= {100 + k: prose(50, 50 + k) for k in range(20)}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "d"))
    got = {r.doc_id: r.component_id for r in minhash_dedup.near_duplicates(spark.read.parquet(str(tmp_path / "d"))).collect()}
    assert got == components(texts)[1]


def test_passages(spark, docs, empty):
    rows = substring_dedup.repeated_passages(docs).collect()
    pairs = {frozenset((r.doc_id, r.match_doc_id)) for r in rows}
    assert frozenset((11, 12)) in pairs and (frozenset((13, 11)) in pairs or frozenset((13, 12)) in pairs)
    linked = {x for p in pairs for x in p}
    assert {6, 7, 8, 9, 10, 14, 15} <= linked and not linked & {0, 1, 2, 3, 4, 5, 16, 17, 18, 19, 20}
    for r in rows:
        assert r.n_words >= 50 and r.similarity >= 0.75
    assert substring_dedup.repeated_passages(empty).count() == 0
    cut = {r.doc_id: r.text for r in substring_dedup.remove_passages(docs).filter("doc_id is not null").collect()}
    # Which row is the earlier one depends on the order of the table's files.
    assert cut[0] is None and sum(PASSAGE in cut[k] for k in (11, 12, 13)) == 1 and prose(150, 5) in cut[12] and prose(200, 3) in cut[11] and cut[16] == TEXTS[16]


def test_passages_around_a_common_line(spark, tmp_path):
    """A line with over 5,000 surroundings: passages of 50 to 57 words that hold it are found, each with its own copy."""
    r = random.Random(23)
    fresh = lambda n: [f"w{r.getrandbits(50):x}" for _ in range(n)]
    line, texts = fresh(40), []
    passages = []
    for k in range(48):
        n = 10 + k % 8
        before = r.randint(0, n)
        passages.append(fresh(before) + line + fresh(n - before))
    for k in range(5300):
        middle = passages[(k - 2650) % 48] if 2650 <= k < 2698 or k >= 5252 else line
        texts.append(fresh(30) + middle + fresh(30))
    spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(texts)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "d"))
    seen, want = {}, set()
    for k, w in enumerate(texts):
        for i in range(len(w) - 49):
            first = seen.setdefault(hash(tuple(w[i : i + 50])), k)
            if first != k:
                want.add((k, first))
    rows = substring_dedup.repeated_passages(spark.read.parquet(str(tmp_path / "d"))).collect()
    assert len(want) == 48 and {(max(x.doc_id, x.match_doc_id), min(x.doc_id, x.match_doc_id)) for x in rows} == want


def brute_alike(x, y, width):
    """Whether any spans of x and y, of width shingles or more, have a Jaccard similarity of 0.75 or more (all members distinct)."""
    shared = np.array([[a == b for b in y] for a in x])
    sums = np.pad(shared.astype(int).cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    for i in range(len(x) - width + 1):
        for j in range(i + width, len(x) + 1):
            row = sums[j] - sums[i]
            k = row[None, :] - row[:, None]  # [lo, hi]
            n = np.arange(len(row))[None, :] - np.arange(len(row))[:, None]
            if ((n >= width) & (4 * k >= 3 * (n + j - i - k))).any():
                return True
    return False


def test_insertions(spark, tmp_path):
    """Words inserted in the earlier or in the later row, or the row cut in stretches, against brute force."""
    r = random.Random(5)
    cases = []
    for k in range(60):
        base, pool = list(range(r.randint(55, 80))), iter(range(1000, 9000))
        x, y = list(base), list(base)
        for _ in range(r.randint(1, 4)):
            at, n = r.randrange(5, len(x) - 5), r.randint(1, 12)
            x[at:at] = [next(pool) for _ in range(n)]
        if k % 3 == 0:
            y[20:20] = [next(pool) for _ in range(r.randint(1, 6))]
        x, y = [next(pool) for _ in range(k % 7)] + x, y + [next(pool) for _ in range(k % 5)]
        cases += [(x, y), (y, x)]
    runs = lambda *v: [z for a, n, gap in v for z in [*range(a, a + n), *range(5000 + 100 * a, 5000 + 100 * a + gap)]]
    cases += [(runs((0, 10, 13), (10, 30, 14), (40, 20, 0)), list(range(60))), (list(range(76)), runs((0, 36, 19), (36, 40, 0))), (runs((0, 36, 19), (40, 36, 0)), list(range(76)))]
    outcomes = set()
    for x, y in cases:
        found = substring_dedup.matching_stretches(np.array(x, np.uint64), np.array(y, np.uint64), 46)
        for s, e, lo, hi, similarity in found:
            p, q = set(x[s:e]), set(y[lo:hi])
            assert similarity == len(p & q) / len(p | q) >= 0.75 and e - s >= 46 and hi - lo >= 46
        outcomes.add(bool(found))
        assert bool(found) == brute_alike(x, y, 46), (x, y)
    assert outcomes == {True, False}
    passage = prose(80, 61).split()
    longer = passage[:40] + prose(15, 62).split() + passage[40:]
    for name, texts in (("later", [passage, longer]), ("earlier", [longer, passage])):
        rows = [(k, " ".join([*prose(60, 70 + k).split(), *w, *prose(60, 80 + k).split()])) for k, w in enumerate(texts)]
        spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / name))
        assert substring_dedup.repeated_passages(spark.read.parquet(str(tmp_path / name))).count() == 1, name


def test_compact_windows():
    """Each window of the width lies in exactly one span whose least value is its own."""
    r = np.random.default_rng(1)
    h = np.concatenate([[0], r.integers(1, 30, 60), [0], r.integers(1, 1000, 40), [0]]).astype(np.uint32)
    left, c, right, _ = substring_dedup.compact_windows(h, 8)
    for i in range(len(h) - 7):
        window = h[i : i + 8]
        if window.min() > 0:
            holders = [k for k in range(len(c)) if left[k] <= i and i + 7 <= right[k] and h[c[k]] == window.min()]
            assert len(holders) == 1


def test_language(spark, docs, empty):
    rows = [(k, prose(40, k) if k % 2 else prose(40, k).upper().replace("A", "ö"), "en" if k % 2 else "de", k) for k in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string, lang string, score long")
    model = language_id.train(table.filter(~common.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    got = language_id.identify(table, model).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got) and [r[0] for r in got] == list(range(200))
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs.select("doc_id", "text"), model).filter("doc_id is not null").collect()}
    assert odd[0] == odd[1] == odd[2] == ("und", 0.0) and odd[3][0] in ("en", "de")
    assert language_id.identify(empty, model).count() == 0
    nothing = language_id.train(empty.select("doc_id", "text", "lang"))
    assert {r.lang_pred for r in language_id.identify(docs, nothing).collect()} == {"und"}
    held = spark.range(50).select("id", common.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 5 == 0) for r in held)


def test_toxicity(spark, docs, empty):
    rows = [(k, prose(30, k) + (" vilebad stuff" if k % 4 == 0 else ""), int(k % 4 == 0)) for k in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, label int")
    train = table.filter(~common.held_out(F.col("doc_id")))
    model = toxicity.train(table, train.select("doc_id", "label"))
    got = toxicity.score(table, model).join(table, "doc_id").collect()
    assert all(r.predicted == r.label for r in got) and len(model[0]) < 5_000
    odd = toxicity.score(docs, model).collect()
    assert len(odd) == len(ROWS) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in odd)
    assert toxicity.score(empty, model).count() == 0
    none = toxicity.train(table, train.select("doc_id", "label").limit(0))
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.5}


def test_toxicity_share_is_alike_at_any_size(spark):
    """A table above the sample's bound predicts the share that it predicts below it."""
    r = random.Random(9)
    rows = []
    for k in range(6000):
        label = int(r.random() < 0.1)
        marks = sum(r.random() < (0.6 if label else 0.25) for _ in range(4))  # labels overlap
        rows.append((k, prose(12, k) + " vilemark" * bool(marks > 1) + " worsemark" * bool(marks > 2), label))
    table = spark.createDataFrame(rows, "doc_id long, text string, label int").repartition(4).cache()
    mean = lambda sample: toxicity.score(table, toxicity.train(table, table.select("doc_id", "label"), sample=sample)).agg(F.avg("score"), F.avg("predicted")).first()
    whole, bounded = mean(40_000), mean(1000)
    assert abs(whole[0] - bounded[0]) < 0.05 and abs(whole[1] - bounded[1]) < 0.05, (whole, bounded)


def test_tokens(spark, docs, empty):
    P = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    library = Tokenizer.from_file(path)
    more = [(50, "a<|endoftext|> b <|endoftext|>"), (51, "it's  two\n\n spaces 123,456"), (52, "x " * 70_000)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in token_counts.count_tokens(table, path).collect())
    count = lambda t: len(library.encode(t or "", add_special_tokens=False).ids)
    assert got == Counter((k, len((t or "").encode()), count(t), count(t) > 512) for k, t in [(r[0], r[1]) for r in ROWS] + more)
    assert token_counts.count_tokens(empty, path).count() == 0


def brute_contamination(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, found = split(text), set(), set()
    for item, t in items:
        v = split(t)
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if v else 0):
            for i in range(len(w) - n + 1):
                if w[i : i + n] == v[k : k + n]:
                    hit |= set(range(i, i + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("bound", [decontamination.MAX_ITEM_WORDS, 15])
def test_decontamination(spark, docs, empty, bound):
    items = [(1, PASSAGE), (2, "two words"), (3, None), (4, ""), (10, "ONE!"), (11, prose(13, 9).upper()), (12, prose(12, 8) + " more")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    small = docs.filter("doc_id is null or doc_id not in (16)")
    got = decontamination.digest(decontamination.find_contamination(small, benchmark, max_item_words=bound)).collect()
    assert Counter((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == Counter((r[0], *brute_contamination(r[1], items)) for r in ROWS if r[0] != 16)
    assert decontamination.find_contamination(empty, benchmark).count() == 0
    assert decontamination.digest(decontamination.find_contamination(small, benchmark.limit(0))).filter("contaminated").count() == 0
    whole = decontamination.remove_spans(small, benchmark)
    assert whole.columns == small.columns and not {3, 4, 5, 11, 12, 13, 19} & {r.doc_id for r in whole.collect()}
    cut = {r.doc_id: r.text for r in decontamination.remove_spans(small, benchmark, whole=False).filter("doc_id is not null").collect()}
    assert cut[3] == "" and PASSAGE not in cut[11] and cut[20] == TEXTS[20]


def test_mixing(spark, docs, empty):
    rows = [(k, "x" * 40, "big" if k % 10 else "small") for k in range(1000)]
    table = spark.createDataFrame(rows, "doc_id long, text string, source string")
    used = source_mixing.mix_sources(table, entropy=0.9, block_tokens=1000).collect()
    tokens = Counter()
    for r in used:
        tokens[r.source] += r.n_tokens
    p = np.array(list(tokens.values())) / sum(tokens.values())
    assert abs(-(p * np.log(p)).sum() / np.log(2) - 0.9) < 0.01 and abs(sum(tokens.values()) - 10_000) <= 20
    blocks = Counter((r.block, r.source) for r in used)
    assert max(blocks[b, "small"] for b in range(10)) - min(blocks[b, "small"] for b in range(10)) <= 1
    assert max(Counter(r.doc_id for r in used).values()) <= 4
    limited = Counter(r.doc_id for r in source_mixing.mix_sources(table, entropy=1.0, max_repeats=2.0).collect())
    assert max(limited.values()) <= 2 + 1
    assert source_mixing.mix_sources(empty).count() == 0
    odd = source_mixing.mix_sources(docs).collect()
    assert {r.source for r in odd} == {None, "s"}


def test_mixing_keeps_small_sources(spark):
    """Sources under half a millionth stay, at their weight, in blocks of their own."""
    rows = spark.range(20).select(F.concat(F.lit("big"), "id").alias("source"), F.lit(375_000_000).cast("long").alias("tokens"))
    tail = spark.createDataFrame([("tiny", 3000), (None, 2500), ("least", 1), ("few", 11_000)], "source string, tokens long")
    got = {w.source: w for w in source_mixing.source_weights(rows.union(tail), entropy=0.9).collect()}
    assert got["tiny"].ppm == 0 and {s: got[s].budget for s in ("tiny", None, "least")} == {"tiny": 3000, None: 2500, "least": 1}
    assert abs(got["few"].budget - 11_000) <= 1 and abs(sum(w.budget for w in got.values()) / 7.5e9 - 1) < 1e-3
    docs = spark.createDataFrame([(k, "x" * 40_000, "big") for k in range(250)] + [(1000 + k, "y", f"tail{k}") for k in range(40)], "doc_id long, text string, source string")
    used = source_mixing.mix_sources(docs, entropy=0.0, block_tokens=100_000).collect()
    assert {r.source for r in used} == {"big", *(f"tail{k}" for k in range(40))}
    assert len({r.block for r in used if r.source != "big"}) > 5


def test_warc(spark, empty, tmp_path):
    rows = [(1, "http://a/", "x"), (2, None, "x"), (3, "http://b/\r\nX", None), (4, "u", ""), (5, "u", "é\r\n\r\nWARC/1.1\r\n"), (None, "u", "y"), (6, "u", "x"), (6, "u", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("n", F.lit(1)).coalesce(1)
    path = str(tmp_path / "w")
    got = warc.archive(pages, path).select(warc.record_key(F.col("record_id")).alias("id"), "record_type", "payload_bytes", "payload_digest", warc.record_key(F.col("refers_to")).alias("to")).collect()
    from base64 import b32encode

    sha = lambda t: b32encode(hashlib.sha1((t or "").encode()).digest()).decode()
    assert Counter((r.id, r.payload_bytes, r.payload_digest) for r in got) == Counter((None if i is None else str(i), len((h or "").encode()), sha(h)) for i, _, h in rows)
    assert Counter((r.id, r.record_type, r.to) for r in got) == Counter([("1", "revisit", "6"), ("2", "revisit", "6"), ("6", "revisit", "6"), ("6", "response", None), ("3", "revisit", "4"), ("4", "response", None), ("5", "response", None), (None, "response", None)])
    assert warc.archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_urls(spark):
    rules = [("com", "/", "allow"), ("bad.com", "/x/", "block"), ("net", "/", "block")]
    link = lambda h: f'<a href="http://{h}/">x</a>'
    rows = [
        (1, "http://A.com/x?q", link("good.org")), (2, "http://bad.com/x/1", link("worse.org")), (3, "http://spam.net/", None), (4, None, "x"), (5, "nothing", None), (6, "http://good.org/p#f", None),
        (7, "http://linker.org/", link("spam.net") + "<a href='//spam.net/b'>"), (8, "http://xcom/", None), (9, "http://a.com", None), (9, "http://a.com", None),
    ]
    got = [tuple(r)[:5] for r in url_filter.judge_urls(spark.createDataFrame(rows, "page_id long, url string, html string"), rules).collect()]
    assert Counter(got) == Counter([
        (1, "a.com", "/x", "com/", "allow"), (2, "bad.com", "/x/1", "bad.com/x/", "block"), (3, "spam.net", "/", "net/", "block"), (4, "", "", None, "allow"), (5, "", "", None, "allow"), (6, "good.org", "/p", None, "allow"),
        (7, "linker.org", "/", None, "block"), (8, "xcom", "/", None, "allow"), (9, "a.com", "", None, "allow"), (9, "a.com", "", None, "allow"),
    ])


def test_repeated(spark):
    rows = [(k % 7 if k < 3000 else k, k) for k in range(5000)]
    got = common.repeated(spark.createDataFrame(rows, "key long, v long"), "key", "v").collect()
    assert Counter(tuple(r) for r in got) == Counter(r for r in rows if r[0] < 7)
