"""Importance resampling towards a target distribution, by bit-sliced sums of hashed features.

Features are runs of one to ``longest`` words, each in the bucket crc32 mod ``buckets``. The gain
of a bucket is the logarithm, in thousandths and floored, of the ratio of its smoothed shares in the
target and in the corpus; a document's weight is the floored mean of the gains of its features.

The sum behind the mean is taken over bit planes. Plane i of a document has the bits of those
buckets whose count has bit i; the gains are planes of their own, positive and negative ones apart.
Then the sum is that of 2 ** (i + j) * popcount(plane i AND gain plane j), exact in integers.
Planes of documents hold their non-zero words of 64 buckets only.

The draw takes the highest of weight plus Gumbel noise from a hash of the id, which is a sample
without replacement in proportion to exp(weight / 1000). The lowest score that can be drawn comes
from a histogram of scores (integers in a range of some 100,000 values, whatever the corpus); rows
from there on are ordered by ranges of (score, id).

Cases: a null or wordless text has no features and weight 0; a null id is hashed as empty and
ties after all others; repeated rows score alike, tie and are each drawn; fewer rows with
``min_words`` words than make one draw nothing; empty tables give an empty result, an empty target
has no counts; very long texts are read whole, in pieces of bounded size; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, ship

BUCKETS, LONGEST, MIN_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Features that are put into planes at a time, and distinct ones whose bucket a worker remembers.
PIECE, KNOWN = 500_000, 500_000
#: ASCII letters are lower-cased, digits and all bytes of non-ASCII characters stay, the rest separates words.
_WORD_BYTES = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


class Buckets(dict):
    """The bucket of a feature."""

    def __init__(self, buckets: int) -> None:
        self.buckets = buckets

    def __missing__(self, feature: bytes) -> int:
        if len(self) >= KNOWN:
            self.clear()
        found = self[feature] = zlib.crc32(feature) % self.buckets
        return found

    def of(self, words: list[bytes], longest: int) -> np.ndarray:
        """The buckets of a text's features."""
        runs = [words] + [[b" ".join(words[k : k + size]) for k in range(len(words) - size + 1)] for size in range(2, longest + 1)]
        return np.concatenate([np.fromiter(map(self.__getitem__, run), np.int64, len(run)) for run in runs])


def pieces(batch: pa.RecordBatch, known: Buckets, longest: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(row, number of words, row of each feature, bucket of each feature) of runs of a batch's rows, the first two as arrays."""
    rows, sizes, found, held = [], [], [], 0
    for row, text in enumerate(batch.column("text").cast(pa.binary()).to_pylist()):
        words = (text or b"").translate(_WORD_BYTES).split()
        rows.append(row)
        sizes.append(len(words))
        found.append(known.of(words, longest))
        held += len(found[-1])
        if held >= PIECE:
            yield np.array(rows), np.array(sizes), np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.concatenate(found)
            rows, sizes, found, held = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(sizes), np.repeat(np.arange(len(rows)), [len(f) for f in found]), np.concatenate(found)


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST) -> np.ndarray:
    """How many features each bucket holds; a task sends one row a bucket at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, total = Buckets(buckets), np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, _, found in pieces(batch, known, longest):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["bucket", "n"])

    rows = texts.mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # at most a row a bucket
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r.bucket] = r.n
    return out


def gains_of(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The gain of each bucket, in floored thousandths."""
    s_all, t_all, m = float(corpus.sum()), float(target.sum()), float(len(corpus))
    return np.array([math.floor(1000 * math.log((t + 1.0) * (s_all + m) / ((s + 1.0) * (t_all + m)))) for s, t in zip(corpus.tolist(), target.tolist())], np.int64)


def gain_planes(gains: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(signed power of two, words of 64 buckets) of each plane of the gains."""
    out, padded = [], np.zeros(-(-len(gains) // 64) * 64, np.int64)
    padded[: len(gains)] = gains
    for sign in (1, -1):
        size = np.maximum(padded * sign, 0)
        for j in range(int(size.max()).bit_length()):
            out.append((sign * (1 << j), np.packbits((size >> j & 1).astype(bool), bitorder="little").view("<u8").astype(np.uint64)))
    return out


def sliced_sums(rows: np.ndarray, found: np.ndarray, n_rows: int, planes: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """The sum of gains over the features of each row. ``rows`` ascends."""
    out = np.zeros(n_rows, np.int64)
    if not planes:
        return out
    words = len(planes[0][1])
    keys, counts = np.unique(rows * (words * 64) + found, return_counts=True)
    for i in range(int(counts.max(initial=0)).bit_length()):
        set_here = keys[(counts >> i & 1).astype(bool)]
        if not len(set_here):
            continue
        slots, bits = set_here >> 6, np.uint64(1) << (set_here & 63).astype(np.uint64)
        begins = np.flatnonzero(np.concatenate(([True], slots[1:] != slots[:-1])))
        plane, slots = np.bitwise_or.reduceat(bits, begins), slots[begins]
        word, row = slots % words, slots // words
        total = np.zeros(len(plane), np.int64)
        for power, gain in planes:
            total += np.bitwise_count(plane & gain[word]).astype(np.int64) * power
        firsts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[firsts]] += np.add.reduceat(total, firsts) << i
    return out


def weigh(docs: DataFrame, gains: np.ndarray, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of each row."""
    planes, buckets = gain_planes(gains), len(gains)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Buckets(buckets)
        for batch in batches:
            for at, sizes, row, found in pieces(batch, known, longest):
                n = np.bincount(row, minlength=len(at))
                sums = sliced_sums(row, found, len(at), planes)
                columns = [batch.column("doc_id").take(pa.array(at)), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array(sums // np.maximum(n, 1), pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, "doc_id long, n_words long, n_features long, weight long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise of an id, in floored thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def draw(scored: DataFrame, min_words: int = MIN_WORDS, percent: int = PERCENT) -> DataFrame:
    """``scored`` (doc_id, n_words, score; a written table) with the rank of drawn rows."""
    able = F.col("n_words") >= min_words
    counts = sorted(((r.score, r.n) for r in scored.filter(able).groupBy("score").agg(F.count("*").alias("n")).collect()), reverse=True)  # bounded by the range of scores
    n = sum(c for _, c in counts) * percent // 100
    higher = np.cumsum([c for _, c in counts])
    if not n:
        return scored.withColumn("rank", F.lit(None).cast("long"))
    least = counts[int(np.searchsorted(higher, n))][0]
    near = scored.filter(able & (F.col("score") >= least)).withColumn("__pos", F.monotonically_increasing_id())
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("__pos").asc()]
    ranked = numbered(near, order).drop("__pos").withColumn("rank", F.when(F.col("number") < n, F.col("number") + 1)).drop("number")
    return ranked.unionByName(scored.filter(~(able & (F.col("score") >= least))).withColumn("rank", F.lit(None).cast("long")))


def resample(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight, score, rank (null where not drawn) of each row of ``docs``."""
    ship(docs.sparkSession)
    text = lambda df, c: df.select(F.col(c).cast("string").alias("text"))
    gains = gains_of(bucket_counts(text(docs, text_col), buckets, longest), bucket_counts(text(target, target_col), buckets, longest))
    weights = weigh(docs, gains, longest, id_col, text_col)
    return draw(materialise(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights"), min_words, percent)
