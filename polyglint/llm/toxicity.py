"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text is the set of its hashed features: words, word beginnings (4 and 6 bytes), word pairs
and pairs with a word between. Hashes have 62 bits, so features don't share weights.

Training takes a bounded sample of the labelled rows (``SAMPLE`` expected, drawn by a hash of
the id at a rate per label), dealt into parts of about ``PART_ROWS``. Each part is learnt
by one task with rates per coordinate and an L1 term, and the parts' weights are averaged per
feature in Spark. A label drawn at a lower rate than the other is too rare in the sample by
the ratio of the rates, so its logarithm goes back to the bias: scores mean the same whatever
the size of the table. L1 leaves few weights; the largest ``MAX_WEIGHTS`` are broadcast.

Cases: a null or empty text has the score of the bias alone; a null label teaches nothing, a
label of an id that isn't there is ignored, and of several labels of an id the largest holds;
without labelled rows every score is 0.5; a null id is kept and never learnt from; repeated
rows are scored each; texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_sample, materialise, ship
from .language_id import sample_rates

SAMPLE, PART_ROWS, EPOCHS, MAX_WEIGHTS = 40_000, 5_000, 3, 200_000
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1.5, 1.0
#: Features of fewer rows of a part are left out.
MIN_ROWS = 5
#: Bytes of a word that count as its beginning.
BEGINNINGS = (4, 6)
_BIAS = np.int64(1)
# ASCII letters and digits, the apostrophe and all bytes of non-ASCII characters are word bytes.
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 or c == 39 else 32 for c in range(256))


def _mix(a: np.ndarray, b: np.ndarray | int, salt: int) -> np.ndarray:
    h = a * np.uint64(0x9E3779B97F4A7C15) + np.uint64(salt)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + b
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(30))


def features(text: str | None) -> np.ndarray:
    """The distinct features of a text, sorted, the bias among them."""
    words = (text or "").lower().encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return np.array([_BIAS])
    n = len(words)
    # Two 32-bit hashes of a word make one of 64.
    w = np.fromiter(map(crc32, words), np.uint64, n) << np.uint64(32) | np.fromiter(map(hash_low, words), np.uint64, n)
    parts = [_mix(w, np.uint64(0), 11)]
    parts += [_mix(np.fromiter(map(crc32, [x[:k] for x in words]), np.uint64, n), np.uint64(0), k) for k in BEGINNINGS]
    if n > 1:
        parts.append(_mix(w[:-1], w[1:], 13))
    if n > 2:
        parts.append(_mix(w[:-2], w[2:], 14))
    return np.concatenate([[_BIAS], np.unique(np.concatenate(parts) >> np.uint64(2)).astype(np.int64)])


def hash_low(word: bytes) -> int:
    return crc32(word, 0x5EED)


def _positions(names: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Where the members of x that are in the sorted names stand."""
    at = np.searchsorted(names, x)
    at[at == len(names)] = 0
    return at[names[at] == x] if len(names) else at[:0]


def learn(rows: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS) -> tuple[np.ndarray, np.ndarray]:
    """FTRL-proximal over the rows in turn: (features, weights), zeros left out."""
    names, counts = np.unique(np.concatenate(rows), return_counts=True)
    names = names[counts >= min(MIN_ROWS, len(rows))]
    z, n = np.zeros(len(names)), np.zeros(len(names))
    index = [_positions(names, r) for r in rows]

    def weights(at: np.ndarray | slice) -> np.ndarray:
        zi = z[at]
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(n[at])) / ALPHA + L2))

    for _ in range(epochs):
        for at, y in zip(index, labels):
            w = weights(at)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
            grown = n[at] + g * g
            z[at] += g - (np.sqrt(grown) - np.sqrt(n[at])) / ALPHA * w
            n[at] = grown
    w = weights(slice(None))
    return names[w != 0], w[w != 0]


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, part_rows: int = PART_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Weights from docs (doc_id, text) and labels (doc_id, label 0/1): (features, weights), sorted."""
    ship(docs.sparkSession)
    labels = labels.filter("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    labels = materialise(labels, "toxic-labels")
    rates = sample_rates(labels, "label", sample // 2, 2)
    if not rates:
        return np.zeros(0, np.int64), np.zeros(0)
    rate = F.create_map(*[F.lit(x) for k, v in rates.items() for x in (k, float(v))])[F.col("label")]
    drawn = labels.filter(in_sample("doc_id", rate))
    shards = max(1, round(drawn.count() / part_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(drawn), "doc_id")  # about ``sample`` rows

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array([features(t.as_py()) for t in batch.column("text")], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("label"), x], names=["doc_id", "label", "x"])

    def fit(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        x = table.column("x").combine_chunks()
        ends, flat = np.cumsum(x.value_lengths().to_numpy()), x.flatten().to_numpy()
        rows, labels = np.split(flat, ends[:-1]), table.column("label").to_numpy()
        order = np.random.default_rng(0).permutation(np.argsort(table.column("doc_id").to_numpy(), kind="stable"))
        names, w = learn([rows[k] for k in order], labels[order])
        return pa.table({"feature": names, "weight": w})

    x = rows.mapInArrow(extract, "doc_id long, label int, x array<long>").withColumn("shard", F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(shards)))
    fitted = x.groupBy("shard").applyInArrow(lambda t: fit(t), "feature long, weight double")
    mean = fitted.groupBy("feature").agg((F.sum("weight") / shards).alias("weight"))
    best = mean.orderBy(F.desc(F.abs("weight")), "feature").limit(MAX_WEIGHTS).collect()  # bounded
    names, w = np.array([r[0] for r in best], np.int64), np.array([r[1] for r in best])
    shift = float(np.log(rates.get(0, 1.0) / rates.get(1, 1.0))) if len(rates) == 2 else 0.0  # log odds that the sample has too few
    if shift and not (names == _BIAS).any():
        names, w = np.append(names, _BIAS), np.append(w, 0.0)
    w[names == _BIAS] += shift
    order = np.argsort(names)
    return names[order], w[order]


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted for every row."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, weights = shared.value
        for batch in batches:
            logits = np.zeros(batch.num_rows)
            for k, text in enumerate(batch.column("text")) if len(names) else ():
                logits[k] = weights[_positions(names, features(text.as_py()))].sum()
            p = 1 / (1 + np.exp(-np.clip(logits, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, score double, predicted int")
