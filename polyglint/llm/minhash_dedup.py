"""Near-duplicate documents by an LSH forest over MinHash signatures.

1. A text becomes its set of word shingles and a signature of ``TREES * DEPTH`` minima. Texts
   with the same set are one class from here on, so exact copies cost one row.
2. Each tree orders classes by its own rotation of the signature. Classes that agree on the
   first ``DEPTH`` minima form a region; a region of one class ends there.
3. Depth adapts to the region: up to ``SMALL`` classes, all its pairs are candidates; a larger
   one is sorted by the further minima, and a class is paired with its neighbours, those of the
   longest common prefix at whatever depth, and with the region's best connected class (the one
   found in the largest regions over all trees).
4. Candidates whose signatures agree too little, or whose sizes differ too much, can't be
   links. Of the rest each class first verifies its best partner, then all pairs that are
   still in different components. Links are confirmed on the full shingle sets.
5. What is left of large regions is done exactly. Sets of similarity 0.75 share one of the rarest
   quarter of the shingles of each, so the classes of regions with several components meet by
   these shingles; what only many texts of a template have in common is not among them. Groups
   of up to ``SMALL`` classes give pairs of different components; in a larger group, classes
   outside its main component are compared, in blocks of bounded size, with the others.

No pair is dropped for the size of its region; pairs inside a component already found add
nothing to the components. Sets are held as 64-bit hashes of shingles, and equal sets are found
by a 128-bit hash of these. Regions that many classes of a sample share are dealt over tasks by
class. A pair of similarity 0.75 shares no region of any of 25 trees with
probability (1 - 0.75 ** 4) ** 25 < 1e-4, and agrees on fewer than 55 of 100 minima with
probability below 1e-5.

Cases: a text without words (or null) has no shingles, no links, and is its own component;
fewer words than a shingle make one shingle; a null id is allowed and sorts after all others
(a component of null ids alone has a null component_id and is kept); repeated rows share a
component, and all rows with its least id are kept; an empty table gives an empty result; very
long texts are read whole; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import deal, free_name, hot_keys, materialise, repeated, sample_of, ship, sized_join, stable, whole_keys
from .components import connected_components, merge_components

SHINGLE, TREES, DEPTH, SMALL, BLOCK = 5, 25, 4, 24, 256
#: Classes expected in the sample that tells which regions are dealt over several tasks.
SAMPLE_CLASSES = 4_000
#: Bits of a shingle that count its frequency among the classes that step 5 looks at.
FREQUENCY_BITS = 20
#: A link needs 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Signatures of a link agree on at least so many minima (see above).
AGREE = 55
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_RNG = np.random.default_rng(20_240_229)
_A = _RNG.integers(1, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 1 << 32, TREES * DEPTH, dtype=np.uint64).astype(np.uint32)


def words_of(text: str | None) -> list[bytes]:
    """A-Z lower-cased, cut at ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def shingle_hashes(words: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """A 64-bit hash of each run of ``size`` words in turn; of the whole text if it is shorter."""
    if not words:
        return np.zeros(0, np.uint64)
    h = word_hashes(words)
    size, n = min(size, len(h)), max(1, len(h) - size + 1)
    out = np.full(n, size, np.uint64)
    for k in range(size):
        out = (out ^ (out >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + h[k : k + n]
    out = (out ^ (out >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def signature(shingles: np.ndarray) -> np.ndarray:
    """The least value of each hash function over the shingles."""
    x = (shingles >> np.uint64(16)).astype(np.uint32)
    out = np.full(len(_A), 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 2048):
        h = x[k : k + 2048, None] * _A + _B
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x85EBCA6B)
        np.minimum(out, h.min(axis=0), out=out)
    return out


def _signatures(rows: DataFrame) -> DataFrame:
    """pos, doc_id, n, set (hash of the shingle set), sig."""
    schema = pa.schema([("pos", pa.int64()), ("doc_id", pa.int64()), ("n", pa.int64()), ("set", pa.binary()), ("sig", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, nodes, sigs = [], [], []
            for text in batch.column("text"):
                s = np.unique(shingle_hashes(words_of(text.as_py())))
                sizes.append(len(s))
                nodes.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                sigs.append(signature(s).view(np.int32) if len(s) else None)
            yield pa.RecordBatch.from_arrays([batch.column("pos"), batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(nodes, pa.binary()), pa.array(sigs, pa.list_(pa.int32()))], schema=schema)

    return rows.mapInArrow(run, "pos long, doc_id long, n long, set binary, sig array<int>")


def _trees(classes: DataFrame, hot: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """key (tree and first minima; hot ones with the number of a part), deep (eight further minima of the tree's order, a byte each), node."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sig = batch.column("sig").flatten().to_numpy().view(np.uint32).reshape(-1, TREES * DEPTH).astype(np.uint64)
            for t in range(TREES):
                order = np.roll(sig, -t * DEPTH, axis=1)
                key = np.full(len(sig), t, np.uint64)
                for k in range(DEPTH):
                    key = (key ^ (key >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15) + order[:, k]
                deep = np.zeros(len(sig), np.uint64)
                for k in range(DEPTH, DEPTH + 8):
                    deep = deep << np.uint64(8) | (order[:, k] & np.uint64(255))
                key = deal((key ^ (key >> np.uint64(29))).view(np.int64), batch.column("node").to_numpy(), hot)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(deep.view(np.int64)), batch.column("node")], names=["key", "deep", "node"])

    return classes.select("node", "sig").mapInArrow(run, "key long, deep long, node long")


def _neighbours(members: DataFrame) -> DataFrame:
    """Pairs of classes next to each other in a tree's order; regions of any size are dealt over tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, int] | None = None
        for batch in batches:
            a, b = [], []
            for key, node in zip(batch.column("key").to_pylist(), batch.column("node").to_pylist()):
                if last and last[0] == key:
                    a.append(min(node, last[1]))
                    b.append(max(node, last[1]))
                last = key, node
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return members.select("key", "deep", "node").repartitionByRange("key", "deep", "node").sortWithinPartitions("key", "deep", "node").mapInArrow(run, "a long, b long")


def _agreement(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)


def is_link(x: np.ndarray, y: np.ndarray, common: int) -> bool:
    return 100 * common >= PERCENT * (len(x) + len(y) - common)


def _verify(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                keep.append(is_link(x, y, len(np.intersect1d(x, y, assume_unique=True))))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    both = pairs.select("a", "b").join(sets.select(F.col("node").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("shingles").alias("y")), "b")
    return both.select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def _links_of_block(table: pa.Table) -> pa.Table:
    """Links between the asking classes and the others of a block, of different components; one per asker and component."""
    nodes, labels = table.column("node").to_pylist(), table.column("label").to_pylist()
    sets = [np.frombuffer(s, np.uint64) for s in table.column("shingles").to_pylist()]
    asks = table.column("asks").to_pylist()
    base = [k for k, q in enumerate(asks) if not q]
    out: set[tuple[int, int]] = set()
    if base:
        owner = np.repeat(base, [len(sets[k]) for k in base])
        values = np.concatenate([sets[k] for k in base])
        order = np.argsort(values, kind="stable")
        values, owner = values[order], owner[order]
        for q in (k for k, asking in enumerate(asks) if asking):
            lo, hi = np.searchsorted(values, sets[q]), np.searchsorted(values, sets[q], "right")
            hits = hi > lo
            spans = np.concatenate([owner[a:b] for a, b in zip(lo[hits], hi[hits])]) if hits.any() else np.zeros(0, int)
            found, common = np.unique(spans, return_counts=True)
            linked: set[int] = set()
            for k, c in zip(found.tolist(), common.tolist()):
                if labels[k] != labels[q] and labels[k] not in linked and is_link(sets[q], sets[k], c):
                    linked.add(labels[k])
                    out.add((min(nodes[q], nodes[k]), max(nodes[q], nodes[k])))
    pairs = sorted(out)
    return pa.table({"a": pa.array([p[0] for p in pairs], pa.int64()), "b": pa.array([p[1] for p in pairs], pa.int64())})


def _open(members: DataFrame, name: str) -> DataFrame:
    """From (key, node, label): key, main (the label of most classes), n, outside (classes of other labels) of keys with several labels."""
    parts = members.groupBy("key", "label").agg(F.count("*").alias("n")).groupBy("key")
    mains = parts.agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside"))
    return materialise(mains.filter("outside > 0"), name)  # written, so that the join with a hot key's rows can be split


def _rare_shingles(classes: DataFrame) -> DataFrame:
    """From (node, label, shingles): key, node, label for each of the rarest shingles of a class, of which sets alike to PERCENT share one."""
    shift = np.uint64(64 - FREQUENCY_BITS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.frombuffer(b"".join(batch.column("shingles").to_pylist()), np.uint64)
            slots, n = np.unique(x >> shift, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(slots.astype(np.int32)), pa.array(n)], names=["slot", "n"])

    # A table of fixed size: how frequent shingles are, by the first bits of their hashes.
    counts = classes.mapInArrow(count, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    level = np.zeros(1 << FREQUENCY_BITS, np.uint8)
    level[counts.column("slot").to_numpy()] = np.log2(counts.column("n").to_numpy())
    shared = classes.sparkSession.sparkContext.broadcast(level)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes = [], []
            for x in batch.column("shingles"):
                x = np.frombuffer(x.as_py(), np.uint64)
                n = len(x) - -(-PERCENT * len(x) // 100) + 1
                keys.append(x[np.lexsort((x, shared.value[(x >> shift).astype(np.int64)]))[:n]])
                sizes.append(n)
            if keys:
                own = [np.repeat(batch.column(c).to_numpy(), sizes) for c in ("node", "label")]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), *map(pa.array, own)], names=["key", "node", "label"])

    return classes.mapInArrow(choose, "key long, node long, label long")


def _rest(large: DataFrame, labels: DataFrame, sets: DataFrame, scored: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links between classes of large regions that are in different components."""
    labelled = materialise(large.join(labels, "node", "left").select("key", "node", F.coalesce("label", "node").alias("label")), "forest-rest")
    among = sized_join(labelled, _open(labelled, "forest-open").select("key"), ["key"], "left_semi").select("node", "label").distinct()
    classes = materialise(among.join(sets, "node"), "forest-rest-sets")
    # A shingle of one class links nothing.
    met = materialise(_rare_shingles(classes), "forest-rare")
    mains = _open(met, "forest-rare-open")
    rows = materialise(sized_join(met, mains, ["key"], "inner"), "forest-rare-shared")
    few = rows.filter(F.col("n") <= SMALL).select("key", "node", "label")
    other = few.withColumnsRenamed({"node": "b", "label": "label_b"})
    pairs = few.join(other, "key").filter("node < b and label <> label_b").select(F.col("node").alias("a"), "b").distinct()
    links = _verify(scored(pairs), sets)
    ceil = lambda c: F.expr(f"({c} + {BLOCK - 1}) div {BLOCK}")
    many = rows.filter(F.col("n") > SMALL).withColumns({"blocks": ceil("n"), "asking": ceil("outside")})
    place = F.xxhash64("node")
    asks = many.filter("label <> main").select("key", F.pmod(place, F.col("asking")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("j"), "node", "label", F.lit(True).alias("asks"))
    base = many.select("key", F.explode(F.sequence(F.lit(0).cast("long"), F.col("asking") - 1)).alias("i"), F.pmod(place, F.col("blocks")).alias("j"), "node", "label", F.lit(False).alias("asks"))
    blocks = asks.union(base).join(sets, "node").groupBy("key", "i", "j").applyInArrow(lambda t: _links_of_block(t), "a long, b long")
    # Written apart: the two have little in common, and tasks of both would be one stage.
    return materialise(links, "forest-rare-links").union(materialise(blocks, "forest-block-links")).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """pos, doc_id, n_shingles, component_id, kept for every row; ``pos`` numbers the rows."""
    ship(docs.sparkSession)
    rows = stable(docs).select(F.monotonically_increasing_id().alias("pos"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    signed = materialise(_signatures(rows), "forest-signatures")
    # A class goes by the position of its first row.
    some = signed.filter("set is not null").groupBy("set").agg(F.min("pos").alias("node"), F.min("doc_id").alias("doc_id"), F.count("*").alias("size"), F.first("n").alias("n"), F.first("sig").alias("sig"))
    classes = materialise(some, "forest-classes")

    signatures = classes.select("node", "sig")
    hot = hot_keys(_trees(sample_of(signatures, "node", SAMPLE_CLASSES), (np.zeros(0, np.int64),) * 2), "key")
    members = materialise(whole_keys(repeated(_trees(signatures, hot), "key", "deep", "node", parts=True)), "forest-members")
    sizes = materialise(members.groupBy("key").agg(F.count("*").alias("size")), "forest-sizes")
    members = materialise(sized_join(members, sizes, ["key"], "inner"), "forest-regions")
    large, small = members.filter(F.col("size") > SMALL), members.filter(F.col("size") <= SMALL)
    degree = members.groupBy("node").agg(F.sum("size").alias("degree"))
    hubs = materialise(large.join(degree, "node").groupBy("key").agg(F.max_by("node", F.struct("degree", "node")).alias("hub")), "forest-hubs")
    other = small.select("key", F.col("node").alias("b"))
    pairs = small.select("key", F.col("node").alias("a")).join(other, "key").filter("a < b").select("a", "b")
    to_hub = sized_join(large, hubs, ["key"], "inner").filter("node <> hub").select(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"))
    pairs = pairs.union(to_hub).union(_neighbours(large)).distinct()

    near = materialise(sized_join(classes, materialise(degree.select("node"), "forest-near"), ["node"], "left_semi").select("node", "n", "sig"), "forest-candidates")
    side = lambda x: near.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}"))

    def alike(pairs: DataFrame) -> DataFrame:
        both = pairs.join(side("a"), "a").join(side("b"), "b").filter(f"100 * least(n_a, n_b) >= {PERCENT} * greatest(n_a, n_b)")
        return both.withColumn("agree", _agreement(F.col("sig_a"), F.col("sig_b"))).filter(F.col("agree") >= AGREE).select("a", "b", "agree")

    scored = materialise(alike(pairs), "forest-pairs")

    needed = scored.select(F.col("a").alias("node")).union(scored.select("b")).union(large.select("node")).distinct()
    needed = materialise(needed.select(F.col("node").alias("pos")), "forest-needed")

    def shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(words_of(t.as_py()))).tobytes() for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("pos"), pa.array(sets, pa.binary())], names=["node", "shingles"])

    sets = materialise(sized_join(rows.select("pos", "text"), needed, ["pos"], "left_semi").mapInArrow(shingles, "node long, shingles binary"), "forest-sets")

    ends = scored.select(F.col("a").alias("node"), F.struct("agree", F.col("b").alias("other")).alias("best")).union(scored.select(F.col("b").alias("node"), F.struct("agree", F.col("a").alias("other"))))
    first = ends.groupBy("node").agg(F.max("best").alias("best")).select(F.least("node", "best.other").alias("a"), F.greatest("node", "best.other").alias("b")).distinct()
    links = materialise(_verify(first, sets), "forest-first-links")
    labels = connected_components(links)
    label = lambda x: labels.select(F.col("node").alias(x), F.col("label").alias(f"label_{x}"))
    apart = scored.select("a", "b").join(label("a"), "a", "left").join(label("b"), "b", "left").filter("coalesce(label_a, a) <> coalesce(label_b, b)").select("a", "b")
    labels = merge_components(labels, materialise(_verify(apart, sets), "forest-links"))
    labels = merge_components(labels, materialise(_rest(large.select("key", "node"), labels, sets, alike), "forest-rest-links"))

    linked = labels.join(classes.select("node", "set", "doc_id"), "node")
    least = linked.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    grouped = linked.join(least, "label").select("set", "component_id")
    alone = classes.filter("size > 1").join(labels, "node", "left_anti").select("set", F.col("doc_id").alias("component_id"))
    out = sized_join(signed.select("pos", "doc_id", "n", "set"), materialise(grouped.union(alone), "forest-components"), ["set"], "left")
    found = F.when(F.col("component_id").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("pos", "doc_id", F.col("n").alias("n_shingles"), found.alias("component_id"), F.col("doc_id").eqNullSafe(found).alias("kept"))


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns."""
    docs, place = stable(docs), free_name(docs, "__pos")
    dropped = materialise(near_duplicates(docs, id_col, text_col).filter("not kept").select(F.col("pos").alias(place)), "forest-dropped")
    return sized_join(docs.withColumn(place, F.monotonically_increasing_id()), dropped, [place], "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
