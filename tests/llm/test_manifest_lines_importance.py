"""The Merkle manifest, line dedup and importance resampling against plain versions."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import ROWS, SCHEMA, prose

from polyglint.llm import common, importance, line_dedup, merkle, queries

SHORT = "doc_id long, text string, lang string, source string, n_chars long, pos long, score double, __id string, idx int, tree int, n long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def leaf(row):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], row[1])))


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([sha("".join(out[-1][k : k + 8])) for k in range(0, len(out[-1]), 8)])
    return out


def plain_manifest(rows):
    """(doc_id, leaf, subroot, root, proof, folded root) of rows, by lists."""
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append(r)
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for name in names:
        trees[name].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    lower_levels = {name: levels_of([leaf(r) for r in trees[name]]) for name in names}
    upper = levels_of([lower_levels[name][-1][0] for name in names])
    out = []
    for place, name in enumerate(names):
        for k, r in enumerate(trees[name]):
            changed = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 0 and r[1] is not None
            now, proof = leaf((r[0], lower(r[1]), *r[2:])) if changed else leaf(r), ""
            for at, levels in ((k, lower_levels[name]), (place, upper)):
                for level in levels[:-1]:
                    first = at - at % 8
                    left, right = "".join(level[first:at]), "".join(level[at + 1 : first + 8])
                    now, proof, at = sha(left + now + right), proof + left + right, at // 8
            out.append((r[0], leaf(r), lower_levels[name][-1][0], upper[-1][0], sha(proof), now))
    return Counter(out)


def found_manifest(df):
    return Counter((r.doc_id, r.leaf, r.subroot, r.root, r.proof_sha256, r.folded_root) for r in df.collect())


def save(spark, rows, tmp_path, schema=SCHEMA, parts=2):
    spark.createDataFrame(rows, schema).repartition(parts).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_manifest_of_odd_rows(spark, tmp_path):
    got = queries.op11_merkle_manifest(spark, save(spark, ROWS, tmp_path))
    assert found_manifest(got) == plain_manifest(ROWS)
    assert all(r.verified == (r.folded_root == r.root) for r in got.collect())


def test_manifest_over_several_blocks(spark, tmp_path):
    """Trees of 600, 4,700 and one leaf: one to three rounds of blocks, last runs of one node."""
    rows = [(k, f"Text {k}", "de" if k < 600 else "en" if k < 5300 else None, "s", k) for k in range(5301)]
    rows += [(9000 + k, "One", f"l{k:02}", None, None) for k in range(20)]
    assert found_manifest(queries.op11_merkle_manifest(spark, save(spark, rows, tmp_path, "doc_id long, text string, lang string, source string, n_chars long", 5))) == plain_manifest(rows)


def test_versions_copy_only_ancestors(spark):
    rows = [(k, f"T{k}", "en", "s", 1) for k in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r for r in merkle.manifest(docs, {"text": F.lit("other")}, F.col("doc_id") == 77).collect()}
    base = levels_of([leaf(r) for r in rows])
    changed = levels_of([leaf(r) if r[0] != 77 else leaf((77, "other", *r[2:])) for r in rows])
    assert got[77].copied == [changed[1][9], changed[2][1], changed[3][0]] and got[77].new_leaf == changed[0][77] and got[77].folded_root == changed[3][0]
    assert all(r.copied is None and r.new_leaf is None and r.folded_root == base[3][0] for k, r in got.items() if k != 77)


def test_manifest_of_little(spark, tmp_path):
    assert queries.op11_merkle_manifest(spark, save(spark, [], tmp_path / "a")).count() == 0
    one = [(6, "AB", "en", None, None, 1, 0.5, "x", 2)]
    assert found_manifest(queries.op11_merkle_manifest(spark, save(spark, one, tmp_path / "b"))) == plain_manifest(one)
    clash = [(k, "A" * 300_000 if k == 3 else None, None, "é", 5, 1, 0.5, "i", 1, 2, 3) for k in (3, 3, 5, None)]
    assert found_manifest(queries.op11_merkle_manifest(spark, save(spark, clash, tmp_path / "c", SHORT))) == plain_manifest([r[:5] for r in clash])


LINE = "A line that many documents share, word for word"
LINES = [
    (1, f"{LINE}\nown one\n{LINE}"), (2, f"  {LINE.lower()} \t\r\nown two"), (3, f"first\n{LINE.upper()}\v\nlast\n"), (4, LINE), (5, f"x\n{LINE}\ny\n{LINE} "), (6, None), (7, ""), (8, "\n\n"),
    (9, "short shared line"), (10, "short shared line"), (11, "short shared line"), (12, "é" * 20 + "\nnineteen characters"), (13, "É" * 20 + "\n" + "é" * 20), (14, "é" * 20), (15, "é" * 20 + "\n" + "a" * 19), (16, "a" * 19), (17, "a" * 19), (18, "a" * 19 + " "),
    (19, "b" * 300_000), (20, "b" * 300_000), (None, "b" * 300_000), (None, LINE), (21, "twice here, twice there\n" * 5), (22, "twice here, twice there"), (23, "x " + "Twice here, twice there"), (4, LINE),
]


def plain_lines(rows):
    key = lambda line: lower(line.strip(" \t\n\v\f\r"))
    holders = defaultdict(list)
    for k, (_, t) in enumerate(rows):
        for x in {key(line) for line in (t or "").split("\n")}:
            holders[x].append(k)
    rank = lambda k: -math.inf if rows[k][0] is None else rows[k][0]
    out = []
    for k, (doc_id, t) in enumerate(rows):
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (len(key(x)) >= 20 and len(holders[key(x)]) >= 3 and rank(k) != max(map(rank, holders[key(x)])))]
        out.append((doc_id, len(lines), len(lines) - len(stay), sha("\n".join(stay))))
    return Counter(out)


@pytest.mark.parametrize("max_keys", [1000, 0])
def test_lines(spark, tmp_path, max_keys, monkeypatch):
    r = random.Random(5)
    shared = [prose(6, 100 + k) for k in range(60)]
    rows = LINES + [(100 + k, "\n".join(r.choice(shared) + (f" {r.random()}" if r.random() < 0.3 else "") for _ in range(r.randrange(8)))) for k in range(150)]
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 8)
    monkeypatch.setattr(line_dedup, "TASK_ROWS", 40)
    docs = spark.createDataFrame([(*x, 7, "y", "z") for x in rows], "doc_id long, text string, __pos int, __id string, __drop string").repartition(3)
    got = line_dedup.drop_lines(docs, max_keys=max_keys)
    assert got.columns == [*docs.columns, "n_lines", "n_dropped"]
    found = got.collect()
    assert Counter((x.doc_id, x.n_lines, x.n_dropped, sha(x.text or "")) for x in found) == plain_lines(rows)
    assert {(x["__pos"], x["__id"], x["__drop"]) for x in found} == {(7, "y", "z")} and [x.text for x in found if x.doc_id == 6] == [None]
    assert line_dedup.drop_lines(docs.limit(0), max_keys=max_keys).count() == 0


def test_lines_query(spark, tmp_path):
    path = save(spark, ROWS, tmp_path)
    got = Counter((x.doc_id, x.n_lines, x.n_dropped, x.kept_sha256) for x in queries.op12_line_dedup(spark, path).collect())
    assert got == plain_lines([r[:2] for r in ROWS])


def test_perfect_hash_is_minimal():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 63, 64, 65, 5000):
        hi, lo = rng.integers(0, 1 << 64, (2, n), np.uint64)
        hi[: n // 3] = 5  # keys that differ in their lower half only
        made = line_dedup.PerfectHash.of(hi, lo)
        assert sorted(made.numbers(hi, lo).tolist()) == list(range(n))
        assert sum(len(x) for x in made.levels) * 64 <= 4 * n + 64 * 12
    shards = line_dedup.Shards([], 0)
    assert shards.ask(hi, lo)[0].sum() == 0


def words_of(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))


def plain_resampling(rows, target, percent, longest=1):
    feats = lambda t: [" ".join(w[k : k + size]) for w in [words_of(t)] for size in range(1, longest + 1) for k in range(len(w) - size + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = Counter(bucket(f) for r in rows for f in feats(r[1])), Counter(bucket(f) for x in target for f in feats(x))
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000))))
    out = []
    for doc_id, text in rows:
        f = feats(text)
        h = int(sha(f"2024:{'' if doc_id is None else doc_id}")[:8], 16)
        weight = sum(map(gain, map(bucket, f))) // len(f) if f else 0
        out.append([doc_id, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None])
    able = sorted((o for o, r in zip(out, rows) if len(words_of(r[1])) >= 20), key=lambda o: (-o[3], o[0] is None, o[0] or 0))
    for k, o in enumerate(able[: len(able) * percent // 100]):
        o[4] = k + 1
    return Counter(map(tuple, out))


TARGET = [prose(30, 8), prose(12, 1), None, "", "é€ Zebra"]


@pytest.mark.parametrize(("percent", "longest"), [(10, 1), (60, 2), (100, 1), (0, 1)])
def test_resampling(spark, percent, longest):
    rows = [r[:2] for r in ROWS] + [(100 + k, prose(20 + k % 7, k % 11)) for k in range(80)] + [(77, prose(25, 1))] * 3
    docs = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, score string, number int, rank int").repartition(3)
    got = importance.resample(docs, spark.createDataFrame([(x,) for x in TARGET], "text string"), percent=percent, longest=longest)
    assert Counter(map(tuple, got.select("doc_id", "n_features", "weight", "score", "rank").collect())) == plain_resampling(rows, TARGET, percent, longest)


def test_resampling_of_nothing(spark):
    nothing = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, prose(40, 1)), (2, "x " * 60_000)], "doc_id long, text string")
    assert importance.resample(nothing, some).count() == 0
    assert Counter(map(tuple, importance.resample(some, nothing, percent=50).select("doc_id", "n_features", "weight", "score", "rank").collect())) == plain_resampling([tuple(r) for r in some.collect()], [], 50)


def test_sums_over_planes():
    rng = np.random.default_rng(2)
    gains = rng.integers(-9000, 9000, 130)
    row, found = np.sort(rng.integers(0, 40, 30_000)), rng.integers(0, 130, 30_000) ** 2 // 130
    want = np.zeros(41, np.int64)
    np.add.at(want, row, gains[found])
    assert (importance.sliced_sums(row, found, 41, importance.gain_planes(gains)) == want).all()
    assert (importance.sliced_sums(row, found, 41, importance.gain_planes(gains * 0)) == 0).all()


def test_numbered(spark):
    rows = common.materialise(spark.range(1000).withColumn("x", F.col("id") % 7), "n")
    got = common.numbered(rows, [F.col("x").desc(), F.col("id")]).collect()
    assert [r.id for r in sorted(got, key=lambda r: r.number)] == sorted(range(1000), key=lambda k: (-(k % 7), k)) and sorted(r.number for r in got) == list(range(1000))
    assert common.numbered(rows.limit(0), [F.col("id")]).count() == 0


def test_samples_of_any_rate(spark):
    rows = spark.range(200_000).withColumnRenamed("id", "doc_id")
    assert [rows.filter(common.in_sample("doc_id", rate)).count() for rate in (1.0, 2.0**-39)] == [200_000, 0]
    assert abs(rows.filter(common.in_sample("doc_id", 0.01)).count() - 2000) < 300
