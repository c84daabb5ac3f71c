"""Helpers that several operators share: shared-folder tables, size-checked joins, repeated keys."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side with at most this many (narrow) rows may be broadcast; beyond it the join shuffles both sides.
MAX_BROADCAST_ROWS = 100_000

#: Rows and bytes that a Python worker gets at a time.
ARROW_ROWS, ARROW_BYTES = 2_000, 64 << 20

#: Spark's setting by which a query's shuffle files are deleted when it ends.
TIDY = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_ROOT = str(Path(__file__).resolve().parents[2])
#: Intermediate tables written by this process, for ``clean_up``.
_WRITTEN: list[str] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from where the driver found it, and bound their batches.

    On a cluster the package is installed or passed with ``--py-files``; this only adds a path.
    Documents are long: batches of 10,000 rows, Spark's default, would take most of a worker's
    memory. A session whose batches are smaller already is left as it is.
    """
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", ARROW_BYTES)):
        given = _bytes(spark.conf.get(key, None) or "0")
        if not 0 < given <= most:
            spark.conf.set(key, str(most))
    env = spark.sparkContext.environment
    if _ROOT not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (_ROOT, env.get("PYTHONPATH", "")) if x)


def _bytes(value: str) -> int:
    """A number as Spark's settings give it, with or without a unit of size."""
    digits = value.rstrip("bBkKmMgGtT")
    unit = value[len(digits) :].lower().rstrip("b")
    return int(digits or 0) << {"": 0, "k": 10, "m": 20, "g": 30, "t": 40}[unit]


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where it is unset, local sessions (tests) get a temporary folder; on a cluster executors
    would write to disks that others can't read, so that is an error.
    """
    path = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not (spark.sparkContext.master or "").startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = "file://" + tempfile.mkdtemp(prefix="spark-shared-", dir="/tmp")
        spark.sparkContext.setCheckpointDir(path)
    return path.rstrip("/")


def shared_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    _WRITTEN.append(path)
    return path


def clean_up(spark: SparkSession, keep: tuple[str, ...] = ()) -> None:
    """Delete the intermediate tables that this process has written, but for those at ``keep``.

    For when results have been written: DataFrames that still read the tables can't be used afterwards.
    """
    jvm, conf = spark._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p in _WRITTEN if p not in keep]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        _WRITTEN.remove(path)


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once all that was made of them is written."""
    for table in tables:
        names = {file.rsplit("/", 2)[-2] for file in table.inputFiles()}
        conf = table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in [p for p in _WRITTEN if p.rpartition("/")[2] in names]:
            at = table.sparkSession._jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(conf).delete(at, True)
            _WRITTEN.remove(path)


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write a DataFrame as a table in the shared folder and read it again.

    It cuts the lineage, so a lost executor costs a task and not the whole plan, and it
    lets several consumers read what was computed once. The shuffle files of the step go when it ends:
    else they stay until the driver collects its garbage, which on a large heap is after all steps.
    """
    path, conf = shared_path(df.sparkSession, name), df.sparkSession.conf
    before = conf.get(TIDY, None)
    conf.set(TIDY, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.unset(TIDY) if before is None else conf.set(TIDY, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stable(docs: DataFrame) -> DataFrame:
    """``docs``, or a written copy where its rows could come in another order when they are read again.

    Operators number rows by their place and meet the numbers in a later job. Tables in files
    are read in the same order each time; what was shuffled or computed by Python isn't sure to be.
    """
    todo = [docs._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if node.nodeName().split()[0] not in ("Project", "Filter", "LocalRelation", "Range", "Relation", "LogicalRelation") or not node.deterministic():
            return materialise(docs, "rows")
        children = node.children()
        todo += [children.apply(k) for k in range(children.size())]
    return docs


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores before it until no column of ``docs`` has it (case doesn't count)."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def sized_join(left: DataFrame, right: DataFrame, on: list[str], how: str, max_rows: int = MAX_BROADCAST_ROWS) -> DataFrame:
    """Join with a narrow table written before: broadcast if its row count is small, else shuffle.

    The shuffled form is a sort-merge join whose large partitions adaptive execution splits.
    """
    if right.limit(max_rows + 1).count() <= max_rows:
        right = F.broadcast(right)
    return left.join(right, on, how)


def numbered(rows: DataFrame, order: list[Column], name: str = "number") -> DataFrame:
    """``rows`` with their number, from 0, in the given order; ``rows`` should be a written table, as it is read twice.

    Ranges of the order are dealt over tasks, sorted and written there; only the size of each range
    is summed up. Give an order whose last column tells equal rows apart, so that no range is large.
    """
    at = free_name(rows, "__at")
    placed = materialise(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn(at, F.monotonically_increasing_id()), "numbered")
    part = F.shiftright(at, 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.count("*").alias("n")).orderBy("part").collect()  # a row for each partition
    firsts = [0, *np.cumsum([r.n for r in sizes]).tolist()]
    first = F.element_at(F.map_from_arrays(F.array(*(F.lit(r.part) for r in sizes)), F.array(*map(F.lit, firsts[:-1]))), part) if sizes else F.lit(0)
    return placed.withColumn(name, (first + F.col(at).bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop(at)


def held_out(doc_id: Column) -> Column:
    """Whether a document is outside the training fold: crc32 of its id as text is a multiple of 5.

    A null id is never in the fold that labels are learnt from.
    """
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and leave all other characters alone."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys are hashes whose bits 3 to 12 are free for the number of a part; the three last ones are the caller's.
MOST_PARTS, PART_BITS = 1023, 1023 << 3
PLAIN = np.uint64((1 << 64) - 1 ^ PART_BITS)


def repeated(df: DataFrame, key: str, *order: str, parts: bool = False) -> DataFrame:
    """The rows whose integer key occurs in two or more rows, sorted by key and order within partitions.

    One shuffle by key, a sort, and a stream that holds one batch: a key of any number of
    rows needs no memory of its own, and rows with unique keys go no further. All rows of a key
    go to one task: callers ``deal`` hot keys out before, and with ``parts`` rows of such a part are all kept.
    """

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: pa.RecordBatch | None = None  # the last row, not yet known to repeat
        last_key, last_out = None, False
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(key).to_numpy()
            same = keys[1:] == keys[:-1]
            joined = last is not None and last_key == keys[0]
            if last is not None and (joined or last_out):
                yield last
            keep = np.concatenate(([joined], same)) | np.concatenate((same, [False])) | ((keys & PART_BITS) != 0 if parts else False)
            last_key, last_out = keys[-1], bool(keep[-1])
            last = batch.slice(batch.num_rows - 1)
            keep[-1] = False
            if keep.any():
                yield batch.filter(pa.array(keep))
        if last is not None and last_out:
            yield last

    return df.repartition(F.col(key)).sortWithinPartitions(key, *order).mapInArrow(stream, df.schema)


def in_sample(key: str, rate: Column | float) -> Column:
    """Whether a row is drawn at a rate, by a hash of a column: one of 2 ** 40 slots, so that small rates hold as well."""
    return F.pmod(F.xxhash64(key), F.lit(1 << 40)) < rate * float(1 << 40)


def sample_of(rows: DataFrame, key: str, expected: int) -> DataFrame:
    """About ``expected`` rows, drawn by a hash of a column."""
    rate = expected / max(1, rows.count())
    return rows if rate >= 1 else rows.filter(F.pmod(F.xxhash64(key), F.lit(1 << 40)) < int(rate * (1 << 40)) + 1)


def hot_keys(sampled: DataFrame, key: str, least: int = 32, per_part: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """(keys, parts), sorted by key, of keys in ``least`` or more sampled rows; a part gets about ``per_part`` of them.

    It decides only over how many tasks the rows of a key are dealt, no result depends on it. At
    most a row per ``least`` sampled ones is gathered, so the bound is the sample's.
    """
    found = sampled.groupBy(key).agg(F.count("*").alias("n")).filter(F.col("n") >= least).orderBy(key).collect()
    return np.array([r[0] for r in found], np.int64), np.array([r[1] // per_part for r in found], np.int64)


def deal(keys: np.ndarray, rows: np.ndarray, hot: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The keys with the number of a part, by ``rows``, in their free bits; 0 if they aren't hot."""
    keys = (keys.view(np.uint64) & PLAIN).view(np.int64)
    names, parts = hot
    if not len(names):
        return keys
    at = np.searchsorted(names, keys)
    at[at == len(names)] = 0
    n = np.where(names[at] == keys, np.minimum(parts[at], MOST_PARTS), 0).astype(np.uint64)
    part = ((rows.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(20)) % np.maximum(n, np.uint64(1)) + np.uint64(1)
    return keys | np.where(n > 1, part << np.uint64(3), np.uint64(0)).view(np.int64)


def whole_keys(rows: DataFrame, key: str = "key") -> DataFrame:
    """Rows with the keys as they were before ``deal``."""
    return rows.withColumn(key, F.col(key).bitwiseAND(F.lit(~PART_BITS).cast("long")))
