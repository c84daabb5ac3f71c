"""One query per operator over the synthetic tables, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, exact_dedup, importance, language_id, line_dedup, merkle, minhash_dedup, source_mixing, substring_dedup, token_counts, toxicity, url_filter, warc
from .common import ascii_lower, held_out, ship

#: (host, path, verdict)
URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
TOKENIZER = "byte_bpe_50k.json"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("toxic").cast("int").alias("label"))
    scored = toxicity.score(docs, toxicity.train(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


def op2_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.repeated_passages(table(spark, sf_dir, "documents")).drop("pos", "match_pos")


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = language_id.train(docs.filter(~held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    found = language_id.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.near_duplicates(table(spark, sf_dir, "documents")).drop("pos")


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_mixing.mix_sources(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("pos")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.archive(table(spark, sf_dir, "pages"))
    return records.select(
        warc.record_key(F.col("record_id")).cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.record_key(F.col("refers_to")).cast("long").alias("refers_to")
    )


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path(TOKENIZER))


def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return decontamination.digest(found).drop("pos")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    found = merkle.manifest(docs, {"text": ascii_lower(F.col("text"))}, tampered)
    return found.select("doc_id", "leaf", "subroot", "root", F.col("proof").alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return line_dedup.drop_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_substring_dedup": op2_substring_dedup,
    "op3_language_id": op3_language_id,
    "op4_minhash_dedup": op4_minhash_dedup,
    "op5_source_mixing": op5_source_mixing,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_warc": op7_warc,
    "op8_token_counts": op8_token_counts,
    "op9_url_filters": op9_url_filters,
    "op10_decontamination": op10_decontamination,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_line_dedup": op12_line_dedup,
    "op13_importance_resampling": op13_importance_resampling,
}

_WS = r"[\x20\x09-\x0D]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: As many as pass before a round moves less than a ten-thousandth of the seeds' weight, whatever the graph.
_ROUNDS = 57


def _propagation_sql() -> str:
    rounds = [
        f"""r{k} AS (SELECT kind, host, sum(rank) AS rank FROM (
            SELECT * FROM seeds UNION ALL
            SELECT e.kind, e.dst, {url_filter.DAMPING} * r.rank * e.share FROM {"seeds" if k == 1 else f"r{k - 1}"} r JOIN edges e ON r.kind = e.kind AND r.host = e.src
        ) GROUP BY kind, host)"""
        for k in range(1, _ROUNDS + 1)
    ]
    return ", ".join(rounds)


def _rule_sql(column: str) -> str:
    rules = sorted(URL_RULES, key=lambda r: (-len(r[0] + r[1]), -len(r[0]), r))
    fits = " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h + p if column == 'rule' else v}'" for h, p, v in rules)
    return f"CASE {fits} END"


_URL_SQL = f"""
WITH p AS (
    SELECT page_id, coalesce(html, '') AS html,
           translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
           regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)([^?#]*)', 2) AS path
    FROM pages),
j AS (SELECT *, {_rule_sql("rule")} AS rule, {_rule_sql("verdict")} AS given FROM p),
links AS (
    SELECT host AS src, unnest(regexp_extract_all(html, '(?i)\\bhref\\s*=\\s*["'']?\\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS url FROM j),
pairs AS (SELECT src, translate(regexp_extract(CASE WHEN starts_with(url, '//') THEN 'http:' || url ELSE url END, '^(?s:.*?)://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS dst FROM links),
counted AS (SELECT src, dst, count(*) AS n FROM pairs WHERE src <> dst AND src <> '' AND dst <> '' GROUP BY 1, 2),
both_ways AS (SELECT 'trust' AS kind, src, dst, n FROM counted UNION ALL SELECT 'distrust', dst, src, n FROM counted),
edges AS (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM both_ways),
hosts AS (SELECT host, avg(CASE WHEN given = 'allow' THEN 1 ELSE 0 END) AS trust, avg(CASE WHEN given = 'block' THEN 1 ELSE 0 END) AS distrust FROM j WHERE host <> '' GROUP BY host),
w AS (SELECT 'trust' AS kind, host, trust AS weight FROM hosts UNION ALL SELECT 'distrust', host, distrust FROM hosts),
seeds AS (SELECT kind, host, (1 - {url_filter.DAMPING}) * weight / sum(weight) OVER (PARTITION BY kind) AS rank FROM w WHERE weight > 0),
{_propagation_sql()},
scores AS (SELECT host, sum(CASE WHEN kind = 'trust' THEN rank ELSE 0 END) AS trust, sum(CASE WHEN kind = 'distrust' THEN rank ELSE 0 END) AS distrust FROM r{_ROUNDS} GROUP BY host)
SELECT page_id, j.host, path, rule,
       coalesce(given, CASE WHEN coalesce(distrust, 0) > {url_filter.THRESHOLD} * (coalesce(trust, 0) + coalesce(distrust, 0)) THEN 'block' ELSE 'allow' END) AS verdict
FROM j LEFT JOIN scores ON j.host = scores.host
"""

_QUAD = "('0x' || substr(sha1(body), {i}, 5))::INTEGER"
_BASE32 = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((({_QUAD.format(i=i)}) >> {s}) & 31) + 1, 1)" for i in range(1, 40, 5) for s in (15, 10, 5, 0))

_MIX = source_mixing
_ENTROPY_SQL = "ln(list_sum(list_transform(shares, lambda x: pow(x, {a})))) - {a} * list_sum(list_transform(shares, lambda x: pow(x, {a}) * ln(x))) / list_sum(list_transform(shares, lambda x: pow(x, {a})))"
_REPEATS_SQL = "list_max(list_transform(shares, lambda x: pow(x, {a} - 1))) / list_sum(list_transform(shares, lambda x: pow(x, {a})))"


def _crc32_sql(raw: str) -> str:
    """The unsigned crc32 of the bytes whose hexadecimal form is ``raw``: bit by bit, over a list of bytes."""
    octets = f"list_transform(range(1, length({raw}) // 2 + 1), lambda i: ('0x' || substr({raw}, 2 * i - 1, 2))::BIGINT)"
    step = "list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda a, z: xor(a >> 1, 3988292384 * (a & 1)))"
    return f"xor(list_reduce(list_concat([4294967295], {octets}), lambda c, b: {step}), 4294967295)"


def _field_sql(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen({value}::VARCHAR) || ':' || {value}::VARCHAR END"


#: Levels of runs of 8 in the SQL: enough for 8 ** 8 documents of a language.
_LEVELS = 8


def _runs_sql(name: str, key: str) -> str:
    """Tables {name}0 ... of nodes (key, idx, n, h) with what stands left and right of each in its run."""
    beside = f"""SELECT *, coalesce(string_agg(h, '') OVER (PARTITION BY {key}, idx // 8 ORDER BY idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lft,
        coalesce(string_agg(h, '') OVER (PARTITION BY {key}, idx // 8 ORDER BY idx ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rgt FROM"""
    out = [f"{name}0 AS ({beside} {name})"]
    for k in range(1, _LEVELS + 1):
        up = f"SELECT {key}, idx // 8 AS idx, (any_value(n) + 7) // 8 AS n, CASE WHEN any_value(n) > 1 THEN sha256(string_agg(h, '' ORDER BY idx)) ELSE any_value(h) END AS h FROM {name}{k - 1} GROUP BY {key}, idx // 8"
        out.append(f"{name}{k} AS ({beside} ({up}))")
    return ",\n".join(out)


def _folded_sql(first: str, levels: list[str]) -> str:
    for at in levels:
        first = f"CASE WHEN {at}.n > 1 THEN sha256({at}.lft || {first} || {at}.rgt) ELSE {first} END"
    return first


_AT = [*(f"a{k}" for k in range(_LEVELS)), *(f"b{k}" for k in range(_LEVELS))]
_MERKLE_SQL = f"""
WITH d AS (
    SELECT doc_id, coalesce('=' || lang, '') AS tree, row_number() OVER (PARTITION BY lang ORDER BY doc_id) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n,
           sha256({" || ".join(map(_field_sql, merkle.FIELDS))}) AS h,
           CASE WHEN {_crc32_sql("hex(doc_id::VARCHAR)")} % 3 = 0 THEN sha256({" || ".join(map(_field_sql, merkle.FIELDS[:-1]))} || {_field_sql(f"translate(text, '{_UPPER}', '{_LOWER}')")}) END AS other
    FROM documents),
a AS (SELECT tree, idx, n, h FROM d),
{_runs_sql("a", "tree")},
b AS (SELECT 0 AS one, tree, row_number() OVER (ORDER BY tree) - 1 AS idx, count(*) OVER () AS n, h FROM a{_LEVELS}),
{_runs_sql("b", "one")},
{", ".join(f"f{k} AS MATERIALIZED (SELECT f.* EXCLUDE (now, proof), {_folded_sql('now', ['x'])} AS now, proof || CASE WHEN x.n > 1 THEN x.lft || x.rgt ELSE '' END AS proof FROM {'f' + str(k - 1) if k else '(SELECT *, coalesce(other, h) AS now, chr(32)[2:] AS proof FROM d)'} f JOIN a{k} x ON x.tree = f.tree AND x.idx = f.idx // {8**k})" for k in range(_LEVELS))},
g AS (SELECT f.*, b.idx AS place, b.h AS subroot FROM f{_LEVELS - 1} f JOIN b ON b.tree = f.tree),
{", ".join(f"g{k} AS MATERIALIZED (SELECT g.* EXCLUDE (now, proof), {_folded_sql('now', ['x'])} AS now, proof || CASE WHEN x.n > 1 THEN x.lft || x.rgt ELSE '' END AS proof FROM {'g' + str(k - 1) if k else 'g'} g JOIN b{k} x ON x.idx = g.place // {8**k})" for k in range(_LEVELS))}
SELECT doc_id, g.h AS leaf, subroot, r.h AS root, sha256(proof) AS proof_sha256, now AS folded_root, now = r.h AS verified
FROM g{_LEVELS - 1} g, b{_LEVELS} r
"""

ORACLE_SQL: dict[str, str] = {
    "op4_minhash_dedup": f"""
WITH RECURSIVE words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingles AS (
    SELECT DISTINCT doc_id, array_to_string(w[k:k + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS k FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS common FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
links AS (SELECT a, b FROM shared JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 100 * common >= 75 * (p.n + q.n - common)),
reach(a, b) AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
least_id AS (SELECT a, min(b) AS m FROM reach GROUP BY a)
SELECT w.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, least(coalesce(m, w.doc_id), w.doc_id) AS component_id, least(coalesce(m, w.doc_id), w.doc_id) = w.doc_id AS kept
FROM words w LEFT JOIN sizes ON sizes.doc_id = w.doc_id LEFT JOIN least_id ON least_id.a = w.doc_id
""",
    "op5_source_mixing": f"""
WITH RECURSIVE d AS (SELECT doc_id, source, greatest(ceil(strlen(coalesce(text, '')) / 4), 1)::BIGINT AS n_tokens FROM documents),
t AS (SELECT source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY source),
one AS (SELECT list(tokens / total ORDER BY tokens) AS shares, any_value(total) AS total FROM (SELECT tokens, sum(tokens) OVER ()::BIGINT AS total FROM t)),
e(k, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
    SELECT k + 1, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END
    FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m, {_ENTROPY_SQL.format(a="((lo + hi) / 2)")} >= {_MIX.ENTROPY} * ln(len(shares)) AS up FROM e, one WHERE k < {_MIX.STEPS})),
r(k, lo, hi) AS (
    SELECT 0, 0.0::DOUBLE, 1.0::DOUBLE UNION ALL
    SELECT k + 1, CASE WHEN up THEN m ELSE lo END, CASE WHEN up THEN hi ELSE m END
    FROM (SELECT k, lo, hi, (lo + hi) / 2 AS m, {_REPEATS_SQL.format(a="((lo + hi) / 2)")} > {_MIX.MAX_REPEATS} AS up FROM r, one WHERE k < {_MIX.STEPS})),
a AS (SELECT greatest(
        CASE WHEN {_ENTROPY_SQL.format(a="1.0::DOUBLE")} >= {_MIX.ENTROPY} * ln(len(shares)) THEN 1.0 ELSE (SELECT lo FROM e WHERE k = {_MIX.STEPS}) END,
        CASE WHEN {_REPEATS_SQL.format(a="0.0::DOUBLE")} <= {_MIX.MAX_REPEATS} THEN 0.0 ELSE (SELECT hi FROM r WHERE k = {_MIX.STEPS}) END) AS alpha, shares, total FROM one),
w AS (SELECT source, tokens, total, floor(pow(tokens / total, alpha) / list_sum(list_transform(shares, lambda x: pow(x, alpha))) * 1000000 + 0.5)::BIGINT AS ppm FROM t, a),
p AS (SELECT source, tokens, ppm, total * ppm // 1000000 AS budget, greatest(total // {_MIX.BLOCK_TOKENS}, 1) AS blocks FROM w),
u AS (
    SELECT d.doc_id, d.source, n_tokens, tokens, ppm, budget, blocks, unnest(range(0, (budget + tokens - 1) // tokens)) AS epoch
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source WHERE budget > 0),
h AS (SELECT *, ('0x' || substr(md5('{_MIX.SEED}:' || epoch || ':' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h FROM u),
s AS (SELECT *, epoch * tokens + coalesce(sum(n_tokens) OVER (PARTITION BY source, epoch ORDER BY h, doc_id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS offs FROM h)
SELECT doc_id, source, n_tokens, epoch, (offs * blocks // budget)::BIGINT AS block, h AS block_order, ppm AS weight_ppm FROM s WHERE offs < budget
""",
    "op6_exact_dedup": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS body, regexp_replace(coalesce(text, ''), '{_WS}', '', 'g') AS norm FROM documents),
k AS (SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(body) DESC, doc_id) AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM k
""",
    "op7_warc": f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
m AS (SELECT page_id, body, max(page_id) OVER (PARTITION BY body) AS first_id FROM p)
SELECT page_id, strlen(body)::BIGINT AS payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM m
""",
    "op9_url_filters": _URL_SQL,
    "op10_decontamination": rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
    SELECT DISTINCT item_id, n, array_to_string(w[k:k + n - 1], ' ') AS window_text
    FROM (SELECT item_id, w, least(len(w), {decontamination.N}) AS n, unnest(range(1, len(w) - least(len(w), {decontamination.N}) + 2)) AS k FROM items WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM words, lengths WHERE len(w) >= n),
found AS (
    SELECT doc_id, k, p.n, item_id FROM (SELECT doc_id, k, n, array_to_string(w[k:k + n - 1], ' ') AS window_text FROM places) p JOIN windows v ON p.window_text = v.window_text AND p.n = v.n),
hit AS (SELECT doc_id, count(DISTINCT word_no) AS n_hit FROM (SELECT doc_id, unnest(range(k, k + n)) AS word_no FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM found) GROUP BY doc_id)
SELECT words.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hit ON words.doc_id = hit.doc_id LEFT JOIN named ON words.doc_id = named.doc_id
""",
    "op11_merkle_manifest": _MERKLE_SQL,
    "op12_line_dedup": rf"""
WITH lines AS (SELECT doc_id, unnest(generate_series(1, len(l))) AS k, unnest(l) AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keys AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''), '{_UPPER}', '{_LOWER}') AS key FROM lines),
often AS (SELECT key, max(doc_id) AS keeper FROM keys WHERE length(key) >= {line_dedup.MIN_CHARS} GROUP BY key HAVING count(DISTINCT doc_id) >= {line_dedup.MIN_DOCS}),
marked AS (SELECT doc_id, k, line, keeper IS NOT NULL AND keeper <> doc_id AS dropped FROM keys LEFT JOIN often ON keys.key = often.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
    "op13_importance_resampling": rf"""
WITH words AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
used AS (SELECT doc_id, word, count(*) AS n FROM (SELECT doc_id, unnest(w) AS word FROM words) GROUP BY doc_id, word),
aims AS (SELECT word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM benchmark) GROUP BY word),
buckets AS (SELECT word, {_crc32_sql("hex(word)")} % {importance.BUCKETS} AS bucket FROM (SELECT word FROM used UNION SELECT word FROM aims)),
s AS (SELECT bucket, sum(n)::BIGINT AS n FROM used JOIN buckets USING (word) GROUP BY bucket),
t AS (SELECT bucket, sum(n)::BIGINT AS n FROM aims JOIN buckets USING (word) GROUP BY bucket),
totals AS (SELECT coalesce((SELECT sum(n) FROM s), 0)::DOUBLE AS s_all, coalesce((SELECT sum(n) FROM t), 0)::DOUBLE AS t_all),
gains AS (
    SELECT s.bucket, floor(1000 * ln((coalesce(t.n, 0) + 1)::DOUBLE * (s_all + {importance.BUCKETS}) / ((s.n + 1)::DOUBLE * (t_all + {importance.BUCKETS}))))::BIGINT AS gain
    FROM s LEFT JOIN t ON s.bucket = t.bucket, totals),
sums AS (SELECT doc_id, sum(n * gain)::BIGINT AS total FROM used JOIN buckets USING (word) JOIN gains USING (bucket) GROUP BY doc_id),
scored AS (
    SELECT words.doc_id, len(w)::BIGINT AS n_features, coalesce(floor(total::DOUBLE / len(w)), 0)::BIGINT AS weight,
           ('0x' || substr(sha256('{importance.SEED}:' || words.doc_id), 1, 8))::BIGINT AS h
    FROM words LEFT JOIN sums ON words.doc_id = sums.doc_id),
noisy AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score, n_features >= {importance.MIN_WORDS} AS able FROM scored),
placed AS (SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place, count(*) OVER (PARTITION BY able) AS n FROM noisy)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= n * {importance.PERCENT} // 100 THEN place END AS rank FROM placed
""",
}
