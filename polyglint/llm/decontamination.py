"""Benchmark decontamination by a broadcast set of normalised test n-grams.

Benchmark items become windows of ``n`` words (an item with fewer words is one window). The
set is broadcast after a check of its size. Above ``MAX_ITEM_WORDS`` words a bit per window hash is
broadcast instead (at most 2 ** ``MOST_BITS`` bits): one scan of the documents finds windows whose
bit is set, and these are joined to the benchmark's by their words. Every item is always compared.

Documents are scanned where they are. Each word becomes its number in the benchmark's
vocabulary (or -1); only runs of known words can hold a window, and there rolling hashes are
looked up and the words then compared, so a hash collision is no hit.

Cases: a null text has no words and no hits; a null id is kept; repeated rows are scanned
each; items without words have no window; repeated items are hit together, and a null item id
is written as ``null``; empty tables give an empty result or no hits; other columns are
ignored. Very long texts take memory in proportion to one text.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import free_name, materialise, ship, sized_join, stable
from .minhash_dedup import word_hashes

N = 13
#: Words of benchmark items in the broadcast set: about 100 bytes each when held as windows.
MAX_ITEM_WORDS = 500_000
#: Bits of the broadcast table for larger benchmarks: 128 for each window, up to so many powers of two (128 MB).
MOST_BITS = 30
# ASCII letters are lower-cased, digits and all bytes of non-ASCII characters stay, the rest separates.
_FOLD = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(256))
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[bytes]:
    """Lower-cased runs of ASCII letters, digits and non-ASCII characters, in UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()


def _rolling(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash of each window of n numbers."""
    h = np.zeros(len(ids) - n + 1, np.uint64)
    for k in range(n):
        h = (h ^ (h >> np.uint64(31))) * _MULTIPLIER + ids[k : len(ids) - n + 1 + k].astype(np.uint64)
    return h


class WindowSet:
    """The windows of some benchmark items, ready to be looked up."""

    def __init__(self, items: list[tuple[str, str | None]], n: int = N) -> None:
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        for item, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words_of(text)]
            for k in range(max(1, len(ids) - n + 1) if ids else 0):
                owners[tuple(ids[k : k + n])].add(item)
        self.owners = dict(owners)
        self.hashes = {m: np.unique(_rolling(np.array([w for w in owners if len(w) == m]).ravel(), m)[::m] if m == 1 else np.array([_rolling(np.array(w), m)[0] for w in owners if len(w) == m], np.uint64)) for m in sorted({len(w) for w in owners})}

    def hits(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str]]]:
        """(start, end, items) of each window of the set that occurs."""
        ids = np.fromiter(map(self.vocabulary.get, words, repeat(-1)), np.int64, len(words))
        known = ids >= 0
        if not known.any():
            return
        edges = np.flatnonzero(np.diff(np.concatenate(([False], known, [False])).astype(np.int8)))
        starts, ends = edges[::2], edges[1::2]
        for m, hashes in self.hashes.items():
            for a, b in zip(starts[ends - starts >= m], ends[ends - starts >= m]):
                h = _rolling(ids[a:b], m)
                at = np.searchsorted(hashes, h)
                at[at == len(hashes)] = 0
                for k in np.flatnonzero(hashes[at] == h):
                    if found := self.owners.get(tuple(ids[a + k : a + k + m].tolist())):
                        yield int(a + k), int(a + k + m), found


_LAST: dict[str, WindowSet] = {}


def _window_set(key: str, shared: Broadcast, n: int) -> WindowSet:
    """One per worker process: it is built by the first of the tasks that a process runs."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = WindowSet(shared.value, n)
    return _LAST[key]


def _merge(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_SCHEMA = pa.schema([("pos", pa.int64()), ("doc_id", pa.int64()), ("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _scan(rows: DataFrame, items: list[tuple[str, str | None]], n: int) -> DataFrame:
    shared, key = rows.sparkSession.sparkContext.broadcast(items), uuid.uuid4().hex

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = _window_set(key, shared, n)
        for batch in batches:
            counts, spans, found = [], [], []
            for text in batch.column("text"):
                words = words_of(text.as_py())
                hits = list(windows.hits(words))
                counts.append(len(words))
                spans.append([{"start": a, "end": b} for a, b in _merge([(a, b) for a, b, _ in hits])])
                found.append(sorted(set().union(*(x for _, _, x in hits))))
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(spans, _SCHEMA.field("spans").type), pa.array(found, _SCHEMA.field("items").type)], schema=_SCHEMA)

    return rows.mapInArrow(scan, "pos long, doc_id long, n_words long, spans array<struct<start:long,end:long>>, items array<string>")


def _union(spans: Column) -> Column:
    """Overlapping or touching spans made one."""
    empty = F.array().cast("array<struct<start:bigint,end:bigint>>")
    def add(acc: Column, s: Column) -> Column:
        last = F.element_at(acc, -1)
        grown = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"))))
        return F.when((F.size(acc) > 0) & (s["start"] <= F.try_element_at(acc, F.lit(-1))["end"]), grown).otherwise(F.concat(acc, F.array(s)))

    return F.aggregate(F.array_sort(spans), empty, add)


def _scan_for_many(rows: DataFrame, items: DataFrame, n: int) -> DataFrame:
    """As ``_scan``, for a benchmark of any size."""

    def windows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                words = words_of(text)
                size = min(n, len(words))
                hashes = _rolling(word_hashes(words), size).view(np.int64).tolist() if words else []
                out += [(h, size, b" ".join(words[k : k + size]), item) for k, h in enumerate(hashes)]
            columns = list(zip(*out)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, (pa.int64(), pa.int32(), pa.binary(), pa.string()))], names=["h", "size", "words", "item"])

    windows = materialise(items.mapInArrow(windows_of, "h long, size int, words binary, item string").distinct(), "benchmark-windows")
    sizes = sorted(r[0] for r in windows.select("size").distinct().collect())  # at most n
    bits = min(MOST_BITS, max(20, windows.count().bit_length() + 7))
    slots = windows.select(F.shiftrightunsigned("h", 64 - bits).alias("slot"))
    table = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()  # at most 2 ** (bits - 6) rows
    known = np.zeros(1 << (bits - 6), np.uint64)
    known[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row for each document (size 0), and one for each window whose bit is set."""
        for batch in batches:
            out = []
            for pos, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("pos", "doc_id", "text"))):
                words = words_of(text)
                out.append((pos, doc_id, len(words), 0, 0, None, None))
                hashes = word_hashes(words)
                for size in sizes:
                    if len(words) >= size:
                        h = _rolling(hashes, size)
                        slot = h >> np.uint64(64 - bits)
                        for k in np.flatnonzero((shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63))) & np.uint64(1)).tolist():
                            out.append((pos, doc_id, None, k, size, int(h[k : k + 1].view(np.int64)[0]), b" ".join(words[k : k + size])))
            columns = list(zip(*out)) or [()] * 7
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(columns, types)], names=["pos", "doc_id", "n_words", "start", "size", "h", "words"])

    found = materialise(rows.mapInArrow(scan, "pos long, doc_id long, n_words long, start long, size int, h long, words binary"), "benchmark-candidates")
    hits = found.filter("size > 0").select("pos", "start", "size", "h", "words").join(windows, ["h", "size", "words"])
    span = F.struct("start", (F.col("start") + F.col("size")).alias("end"))
    of_doc = hits.groupBy("pos").agg(F.collect_set(span).alias("spans"), F.collect_set("item").alias("items"))  # a document's own windows
    out = found.filter("size = 0").select("pos", "doc_id", "n_words").join(of_doc, "pos", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(kind))
    return out.select("pos", "doc_id", "n_words", _union(empty("spans", "array<struct<start:bigint,end:bigint>>")).alias("spans"), F.array_sort(empty("items", "array<string>")).alias("items"))


def find_contamination(docs: DataFrame, benchmark: DataFrame, n: int = N, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", max_item_words: int = MAX_ITEM_WORDS) -> DataFrame:
    """Per document: pos, doc_id, n_words, spans (hit word ranges, disjoint), items (item ids, sorted)."""
    spark = docs.sparkSession
    ship(spark)
    rows = stable(docs).select(F.monotonically_increasing_id().alias("pos"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = benchmark.select(F.coalesce(F.col(item_col).cast("string"), F.lit("null")).alias("item"), F.col(item_text_col).cast("string").alias("text"))
    words = items.agg(F.coalesce(F.sum(F.octet_length("text") / 2 + 1), F.lit(0.0))).first()[0]  # at most so many
    if words <= max_item_words:
        return _scan(rows, [tuple(r) for r in items.toLocalIterator()], n)  # bounded by max_item_words
    return _scan_for_many(rows, items, n)


def digest(found: DataFrame) -> DataFrame:
    """Counts and the verdict: contaminated when hit words are a twentieth of all words or more."""
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda s, x: s + x["end"] - x["start"])
    out = found.select("pos", "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def remove_spans(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", whole: bool = True, **options) -> DataFrame:
    """``docs`` without contaminated documents (``whole``), or with the hit words cut out of their texts.

    Cutting keeps the text outside the spans as it is; a document that loses all its words stays, empty.
    """
    docs, place, spans = stable(docs), free_name(docs, "__pos"), free_name(docs, "__spans")
    found = find_contamination(docs, benchmark, id_col=id_col, text_col=text_col, **options)
    bad = digest(found).filter("contaminated") if whole else found.filter(F.size("spans") > 0)
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rows = docs.withColumn(place, F.monotonically_increasing_id())
    if whole:
        return sized_join(rows, materialise(bad.select(F.col("pos").alias(place)), "contaminated"), [place], "left_anti").select(columns)
    cut = F.udf(cut_words, StringType())
    rows = sized_join(rows, materialise(bad.select(F.col("pos").alias(place), F.col("spans").alias(spans)), "contaminated"), [place], "left")
    return rows.withColumn(text_col, cut(F.col(f"`{text_col}`"), F.col(spans))).select(columns)


def cut_words(text: str | None, spans: list | None) -> str | None:
    """``text`` without the words of the spans (numbers as ``words_of`` counts them) and what lies between these."""
    if text is None or not spans:
        return text
    raw = text.encode("utf-8", "surrogatepass")
    folded = raw.translate(_FOLD)
    begins, ends, inside = [], [], False
    for k, c in enumerate(folded):
        if (c != 32) != inside:
            (ends if inside else begins).append(k)
            inside = not inside
    if inside:
        ends.append(len(raw))
    out, at = [], 0
    for span in spans:
        out.append(raw[at : begins[span["start"]]])
        at = ends[span["end"] - 1]
    return b"".join([*out, raw[at:]]).decode("utf-8", "surrogatepass")
