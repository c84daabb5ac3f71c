"""Lines that many documents share, found by arrays behind a sharded minimal perfect hash.

1. Each document gives the 128-bit hashes of its distinct long lines; they are counted by hash, with
   the largest id that holds them (one shuffle, combined before it).
2. Hashes of enough documents are dealt into shards by their first bits. A task makes the shard's
   minimal perfect hash (levels of bits, each with the places that one key alone fell on; a key's
   number is how many bits are set before its own) and, in the order of the numbers, arrays of
   fingerprints (64 bits of the hash that places no key), counts and largest ids.
3. Documents probe the arrays line by line. A line that isn't in the index meets another line's
   fingerprint with probability 2 ** -64.

Up to ``MAX_KEYS`` lines the shards are broadcast, and documents are scanned where they are. Beyond,
a table of bits is broadcast, hashes whose bit is set go to the shards (a shard of hot lines over as
many tasks as its counts ask for), and what the arrays say of them goes back to the documents.

Cases: a null text is one empty line and stays null; lines are told apart by ``\\n`` alone; a line
within one document counts once, and all its copies stay in the document that keeps it; rows are
documents, so repeated rows count each, and all rows with the largest id keep a line; a null id is
below all others; an empty table gives an empty result; very long lines and texts are read whole;
other columns stay as they are.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import free_name, materialise, ship, sized_join, stable

MIN_CHARS, MIN_DOCS = 20, 3
#: Lines in shards that are broadcast (some 25 bytes each); keys of a shard; rows of hashes that a task gets; bits of the table for more lines.
MAX_KEYS, SHARD_KEYS, TASK_ROWS, MOST_BITS = 1_000_000, 1 << 16, 1 << 20, 30
_STRIP = " \t\n\v\f\r"
_ODD, _ODD2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_LEAST = -(1 << 63)  # stands for a null id
_SHARD = "shard long, n long, uses long, levels array<binary>, prints binary, counts binary, largest binary"


def line_hashes(text: str, min_chars: int) -> tuple[list[str], list[bytes]]:
    """The lines of a text and the hash of each one's key (stripped, A-Z lower-cased), empty if the key is too short."""
    lines = text.split("\n")
    keys = (line.strip(_STRIP) for line in lines)
    return lines, [xxhash.xxh3_128_digest(k.encode("utf-8", "surrogatepass").lower()) if len(k) >= min_chars else b"" for k in keys]


def halves(hashes: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The upper and the lower 64 bits."""
    raw = np.frombuffer(b"".join(hashes), ">u8").astype(np.uint64).reshape(-1, 2)
    return np.ascontiguousarray(raw[:, 0]), np.ascontiguousarray(raw[:, 1])


class PerfectHash:
    """Numbers 0 to n - 1 for n different 128-bit keys, in some 3 bits a key."""

    def __init__(self, levels: list[np.ndarray]) -> None:
        self.levels, self.before, first = levels, [], 0
        for bits in levels:
            ends = first + np.cumsum(np.bitwise_count(bits).astype(np.int64))
            self.before.append(np.concatenate(([first], ends[:-1])))
            first = int(ends[-1])

    @classmethod
    def of(cls, hi: np.ndarray, lo: np.ndarray) -> PerfectHash:
        levels: list[np.ndarray] = []
        while len(hi):
            words = -(-len(hi) // 64)
            at = _place(hi, lo, len(levels), words)
            alone = np.bincount(at.astype(np.int64), minlength=words * 64) == 1
            levels.append(np.packbits(alone, bitorder="little").view("<u8").astype(np.uint64))
            hi, lo = hi[~alone[at]], lo[~alone[at]]
        return cls(levels)

    def numbers(self, hi: np.ndarray, lo: np.ndarray) -> np.ndarray:
        """The number of each key; any number, or -1, for what is no key."""
        out, left = np.full(len(hi), -1, np.int64), np.arange(len(hi))
        for level, (bits, before) in enumerate(zip(self.levels, self.before)):
            at = _place(hi[left], lo[left], level, len(bits))
            word, bit = at >> np.uint64(6), at & np.uint64(63)
            mine = (bits[word] >> bit & np.uint64(1)).astype(bool)
            smaller = bits[word] & ((np.uint64(1) << bit) - np.uint64(1))
            out[left[mine]] = (before[word] + np.bitwise_count(smaller))[mine]
            left = left[~mine]
        return out


def _place(hi: np.ndarray, lo: np.ndarray, level: int, words: int) -> np.ndarray:
    """The bit that a key falls on; keys that meet on one level are apart on others."""
    own = np.uint64((level + 1) * 0xC2B2AE3D27D4EB4F % (1 << 64))
    h = (hi + (lo ^ own) * _ODD) * _ODD2
    h = (h ^ (h >> np.uint64(32))) * _ODD
    return (h ^ (h >> np.uint64(29))) % np.uint64(words * 64)


class Shards:
    """Shards read from their rows, to be asked for lines."""

    def __init__(self, rows: list[dict], bits: int) -> None:
        array = lambda raw, kind: np.frombuffer(raw, kind)
        self.bits = bits
        self.parts = {r["shard"]: (PerfectHash([array(x, np.uint64) for x in r["levels"]]), array(r["prints"], np.uint64), array(r["counts"], np.int64), array(r["largest"], np.int64)) for r in rows}

    def ask(self, hi: np.ndarray, lo: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """How many documents hold each line, and the largest id among them; (0, 0) for other lines."""
        counts, largest = np.zeros(len(hi), np.int64), np.zeros(len(hi), np.int64)
        shard = (hi >> np.uint64(64 - self.bits) if self.bits else hi & np.uint64(0)).astype(np.int64)
        for part in np.unique(shard).tolist():
            if part in self.parts:
                hash_, prints, n, last = self.parts[part]
                mine = np.flatnonzero(shard == part)
                number = hash_.numbers(hi[mine], lo[mine])
                known = (number >= 0) & (prints[number] == lo[mine])
                counts[mine[known]], largest[mine[known]] = n[number[known]], last[number[known]]
        return counts, largest


def count_lines(docs: DataFrame, min_chars: int = MIN_CHARS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """hi, lo (hash of a line's key), n (rows that hold it), last (the largest id; the least number for null)."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, found = [], []
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").to_pylist()):
                own = set(line_hashes(text or "", min_chars)[1])
                own.discard(b"")
                found += own
                ids += [doc_id] * len(own)
            hi, lo = halves(found)
            yield pa.RecordBatch.from_arrays([pa.array(hi.view(np.int64)), pa.array(lo.view(np.int64)), pa.array(ids, pa.int64())], names=["hi", "lo", "id"])

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(emit, "hi long, lo long, id long").groupBy("hi", "lo").agg(F.count("*").alias("n"), F.max("id").alias("last"))


def index_lines(lines: DataFrame, bits: int) -> DataFrame:
    """The shards of (hi, lo, n, last) rows, by the first ``bits`` bits: a row each."""

    def build(rows: pa.Table) -> pa.Table:
        hi, lo = (rows.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        hash_ = PerfectHash.of(hi, lo)
        order = np.argsort(hash_.numbers(hi, lo))
        raw = lambda a: pa.array([a.tobytes()], pa.binary())
        n = rows.column("n").to_numpy()
        columns = [rows.column("shard")[:1], pa.array([len(rows)], pa.int64()), pa.array([int(n.sum())], pa.int64()), pa.array([[x.tobytes() for x in hash_.levels]], pa.list_(pa.binary())), raw(lo[order]), raw(n[order]), raw(rows.column("last").to_numpy()[order])]
        return pa.table(dict(zip(("shard", "n", "uses", "levels", "prints", "counts", "largest"), columns)))

    shard = F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0).cast("long")
    return lines.withColumn("shard", shard).groupBy("shard").applyInArrow(build, _SHARD)


_LAST: dict[str, Shards] = {}


def _shards(key: str, shared, bits: int) -> Shards:
    """One per worker process."""
    if key not in _LAST:
        _LAST.clear()
        _LAST[key] = Shards(shared.value, bits)
    return _LAST[key]


def _cut(rows: DataFrame, text_col: str, min_chars: int, kept: list[str], n_lines: str, n_dropped: str, bad_in: Callable[[], Callable[[pa.RecordBatch, list[bytes], list[int]], np.ndarray]]) -> DataFrame:
    """``rows`` without bad lines. ``bad_in`` makes, in a task, a test of a batch's hashes (with the row of each)."""
    counts = [StructField(c, LongType()) for c in (n_lines, n_dropped)]
    out = StructType([rows.schema[c] for c in kept] + counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = bad_in()
        for batch in batches:
            texts = batch.column(text_col).to_pylist()
            split = [line_hashes(t or "", min_chars) for t in texts]
            bad = np.zeros(sum(len(lines) for lines, _ in split), bool)
            flat = [h for _, hashes in split for h in hashes]
            asked = np.flatnonzero(np.fromiter(map(len, flat), np.int64, len(flat)))
            row_of = np.repeat(np.arange(len(split)), [len(lines) for lines, _ in split])
            if len(asked):
                bad[asked] = test(batch, [flat[k] for k in asked.tolist()], row_of[asked])
            texts_out, dropped, at = [], [], 0
            for text, (lines, _) in zip(texts, split):
                own = bad[at : at + len(lines)]
                at += len(lines)
                dropped.append(int(own.sum()))
                texts_out.append("\n".join(x for x, b in zip(lines, own.tolist()) if not b) if dropped[-1] else text)
            columns = {c: batch.column(c) for c in kept} | {text_col: pa.array(texts_out, batch.schema.field(text_col).type), n_lines: pa.array([len(lines) for lines, _ in split], pa.int64()), n_dropped: pa.array(dropped, pa.int64())}
            yield pa.RecordBatch.from_arrays([columns[c] for c in (*kept, n_lines, n_dropped)], names=[*kept, n_lines, n_dropped])

    return rows.mapInArrow(run, out)


def drop_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, id_col: str = "doc_id", text_col: str = "text", n_lines: str = "n_lines", n_dropped: str = "n_dropped", max_keys: int = MAX_KEYS) -> DataFrame:
    """``docs`` with lines that ``min_docs`` or more rows hold left in the one with the largest id only, and two counts of lines."""
    spark = docs.sparkSession
    ship(spark)
    docs = stable(docs).withColumn(text_col, F.col(text_col).cast("string"))
    lines = materialise(count_lines(docs, min_chars, id_col, text_col).filter(F.col("n") >= min_docs), "lines")
    n = lines.count()
    bits = max(0, (n // SHARD_KEYS).bit_length())
    index = materialise(index_lines(lines, bits), "line-shards")
    id_name = free_name(docs, "__id")
    rows = docs.withColumn(id_name, F.coalesce(F.col(id_col).cast("long"), F.lit(_LEAST)))
    if n > max_keys:
        return _drop_many(rows, index, n, bits, min_chars, min_docs, id_name, text_col, docs.columns, n_lines, n_dropped)
    shared, key = spark.sparkContext.broadcast([r.asDict() for r in index.toLocalIterator()]), uuid.uuid4().hex  # bounded by max_keys

    def bad_in():
        shards = _shards(key, shared, bits)

        def test(batch: pa.RecordBatch, hashes: list[bytes], row: np.ndarray) -> np.ndarray:
            counts, largest = shards.ask(*halves(hashes))
            return (counts >= min_docs) & (largest != batch.column(id_name).to_numpy()[row])

        return test

    return _cut(rows, text_col, min_chars, docs.columns, n_lines, n_dropped, bad_in)


def _drop_many(rows: DataFrame, index: DataFrame, n: int, bits: int, min_chars: int, min_docs: int, id_name: str, text_col: str, kept: list[str], n_lines: str, n_dropped: str) -> DataFrame:
    """As ``drop_lines``, for an index of any size."""
    place, drop = free_name(rows, "__pos"), free_name(rows, "__drop")
    rows = rows.withColumn(place, F.monotonically_increasing_id())
    wide = min(MOST_BITS, max(20, n.bit_length() + 4))

    def slots_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column("prints").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array((np.frombuffer(raw, np.uint64) >> np.uint64(64 - wide)).astype(np.int64))], names=["slot"])

    slots = index.select("prints").mapInArrow(slots_of, "slot long")
    table = slots.groupBy(F.shiftright("slot", 6).alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(slot & 63 as int)))").alias("bits")).toArrow()  # at most 2 ** (MOST_BITS - 6) rows
    known = np.zeros(1 << (wide - 6), np.uint64)
    known[table.column("at").to_numpy()] = table.column("bits").to_numpy().view(np.uint64)
    shared = rows.sparkSession.sparkContext.broadcast(known)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, at = [], []
            for k, text in enumerate(batch.column(text_col).to_pylist()):
                own = set(line_hashes(text or "", min_chars)[1])
                own.discard(b"")
                found += own
                at += [k] * len(own)
            hi, lo = halves(found)
            slot = lo >> np.uint64(64 - wide)
            maybe = (shared.value[slot >> np.uint64(6)] >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)
            of = pa.array(np.array(at, np.int64)[maybe])
            yield pa.RecordBatch.from_arrays([batch.column(place).take(of), batch.column(id_name).take(of), pa.array(hi[maybe].view(np.int64)), pa.array(lo[maybe].view(np.int64))], names=["pos", "id", "hi", "lo"])

    asked = rows.select(place, id_name, text_col).mapInArrow(emit, "pos long, id long, hi long, lo long").withColumn("shard", F.shiftrightunsigned("hi", 64 - bits) if bits else F.lit(0).cast("long"))
    parts = F.expr(f"1 + uses div {TASK_ROWS}")  # a shard's uses are counted, so its rows are dealt evenly
    dealt = sized_join(asked, index.select("shard", parts.alias("parts")), ["shard"], "inner").withColumn("part", F.pmod(F.xxhash64("pos"), F.col("parts"))).drop("parts")
    shards = index.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))

    def ask(group: pa.Table, shard: pa.Table) -> pa.Table:
        hi, lo = (group.column(c).to_numpy().view(np.uint64) for c in ("hi", "lo"))
        counts, largest = Shards(shard.to_pylist(), bits).ask(hi, lo)
        bad = pa.array((counts >= min_docs) & (largest != group.column("id").to_numpy()))
        return group.select(["pos", "hi", "lo"]).filter(bad)

    bad = dealt.groupBy("shard", "part").cogroup(shards.groupBy("shard", "part")).applyInArrow(ask, "pos long, hi long, lo long")
    of_doc = bad.groupBy("pos").agg(F.collect_list(F.struct("hi", "lo")).alias(drop))  # a document's own lines
    rows = rows.join(of_doc.withColumnRenamed("pos", place), place, "left")

    def bad_in():
        def test(batch: pa.RecordBatch, hashes: list[bytes], row: np.ndarray) -> np.ndarray:
            of_row = [{(x["hi"], x["lo"]) for x in found or ()} for found in batch.column(drop).to_pylist()]
            hi, lo = (x.view(np.int64).tolist() for x in halves(hashes))
            return np.fromiter(((h, x) in of_row[r] for h, x, r in zip(hi, lo, row.tolist())), bool, len(hashes))

        return test

    return _cut(rows, text_col, min_chars, kept, n_lines, n_dropped, bad_in)
