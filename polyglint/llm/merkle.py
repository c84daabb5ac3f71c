"""A Merkle manifest of a table: a persistent tree whose versions copy only what a change touches.

A leaf is the hash of a row's fields. The leaves of a language, by id, are the bottom of its tree,
runs of ``FAN`` nodes have a node above them, and the trees' roots are the leaves of one more tree.

Trees are cut into aligned blocks of ``FAN ** BLOCK_LEVELS`` nodes, each a group of bounded size:

1. Going up, each block gives one node; the nodes of all blocks are the level that the next round
   cuts into blocks, until each tree has one node.
2. Going down, each block gets the path of its top to the root (the runs' other nodes on the way)
   and gives one to each of its nodes.
3. In the lowest blocks a changed leaf makes a version: copies of its ancestors inside the block,
   while all other nodes are shared with the first version, and then of those on the block's path
   above. Versions never meet in one task: what they share comes down to them.

Cases: a null field is hashed as such, so null and empty differ; a null id is the first of its
language, and rows of one id (or none) are ordered by their leaves; repeated rows have a leaf
each; a row whose condition is null isn't changed; an empty table gives an empty result; a table
of one row has its leaf as root; long texts are hashed by the JVM and go no further; other
columns are ignored.
"""

from __future__ import annotations

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, numbered, ship, sized_join

FAN, BLOCK_LEVELS = 8, 3
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
_NODES = "tree long, idx long, n long, digest string"
_PATH = pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())]))
_PATHS = "tree long, idx long, tree_root string, path array<struct<left:string,right:string>>"


def _block() -> Column:
    return F.expr(f"idx div {FAN**BLOCK_LEVELS}").alias("block")


def digest_of(text: str) -> str:
    return sha256(text.encode("ascii")).hexdigest()


def leaf_of(values: list[Column]) -> Column:
    """The hash of a row's values: each ``-`` if null, else its bytes in UTF-8, ``:`` and itself."""
    shown = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(v.isNull(), "-").otherwise(F.concat(F.octet_length(v).cast("string"), F.lit(":"), v)) for v in shown)), 256)


class Block:
    """The nodes of an aligned block: its own leaves and what stands above them, inside the block."""

    def __init__(self, digests: list[str], n: int) -> None:
        """``n``: how many nodes the whole level has, which tells how far up the tree goes."""
        self.levels = [digests]
        while n > 1 and len(self.levels) <= BLOCK_LEVELS:
            below, n = self.levels[-1], -(-n // FAN)
            self.levels.append([digest_of("".join(below[k : k + FAN])) for k in range(0, len(below), FAN)])
        self.top, self.n = self.levels[-1][0], n

    def path(self, at: int) -> list[dict[str, str]]:
        """The other nodes of the runs from a leaf up to the top."""
        out = []
        for level in self.levels[:-1]:
            first = at - at % FAN
            out.append({"left": "".join(level[first:at]), "right": "".join(level[at + 1 : first + FAN])})
            at //= FAN
        return out


def copies(digest: str, path: list[dict[str, str]]) -> list[str]:
    """The ancestors that a version with another leaf has of its own."""
    out = []
    for run in path:
        digest = digest_of(run["left"] + digest + run["right"])
        out.append(digest)
    return out


def _sorted(nodes: pa.Table) -> tuple[pa.Table, Block]:
    nodes = nodes.take(np.argsort(nodes.column("idx").to_numpy(), kind="stable"))
    return nodes, Block(nodes.column("digest").to_pylist(), nodes.column("n")[0].as_py())


def _climb(nodes: DataFrame) -> DataFrame:
    """The tops of all blocks: the nodes of the level that far above."""

    def top(rows: pa.Table) -> pa.Table:
        _, block = _sorted(rows)
        return pa.table({"tree": rows.column("tree")[:1], "idx": pa.array([rows.column("idx")[0].as_py() // FAN**BLOCK_LEVELS], pa.int64()), "n": pa.array([block.n], pa.int64()), "digest": pa.array([block.top])})

    return nodes.select("tree", "idx", "n", "digest").groupBy("tree", _block()).applyInArrow(top, _NODES)


def _to_tops(nodes: DataFrame, most: int) -> list[DataFrame]:
    """The given nodes (the largest tree has ``most``) and the tops of blocks, round by round, until each tree has one."""
    rounds = [nodes]
    while most > 1:
        rounds.append(materialise(_climb(rounds[-1]), "merkle-nodes"))
        most = -(-most // FAN**BLOCK_LEVELS)
    return rounds


def _descend(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """The path of each node to the root, from that of its block's top."""

    def paths(rows: pa.Table, tops: pa.Table) -> pa.Table:
        rows, block = _sorted(rows)
        rest = tops.column("path")[0].as_py()
        found = [block.path(k) + rest for k in range(len(rows))]
        return pa.table({"tree": rows.column("tree"), "idx": rows.column("idx"), "tree_root": pa.array([tops.column("tree_root")[0].as_py()] * len(rows), pa.string()), "path": pa.array(found, _PATH)})

    return _with_tops(nodes.select("tree", "idx", "n", "digest"), above).applyInArrow(paths, _PATHS)


def _with_tops(nodes: DataFrame, above: DataFrame):
    tops = above.withColumnRenamed("idx", "block")
    return nodes.groupBy("tree", _block()).cogroup(tops.groupBy("tree", "block"))


def _paths_of(rounds: list[DataFrame], tops: DataFrame) -> DataFrame:
    """Paths of the tops of the lowest blocks of ``rounds``, from those of the trees' roots."""
    for nodes in rounds[-2:0:-1]:
        tops = materialise(_descend(nodes, tops), "merkle-paths")
    return tops


def manifest(docs: DataFrame, changed: dict[str, Column] | None = None, where: Column | None = None, fields: tuple[str, ...] = FIELDS, tree_col: str = "lang", id_col: str = "doc_id") -> DataFrame:
    """doc_id, tree_name, leaf, subroot, root, proof (hash of the other nodes on the way), new_leaf, copied, folded_root of each row.

    ``changed`` gives values that fields would have, in rows for which ``where`` holds: such a row
    has a version of the tree with ``new_leaf`` and the ``copied`` nodes, the leaf's parent first.
    ``folded_root`` is the root of a row's version, or what its own leaf gives without one.
    """
    spark = docs.sparkSession
    ship(spark)
    value = {c: F.col(f"`{c}`") for c in fields}
    other = leaf_of([(changed or {}).get(c, value[c]) for c in fields])
    leaves = docs.select(
        F.monotonically_increasing_id().alias("pos"), F.col(id_col).cast("long").alias("doc_id"), F.col(tree_col).cast("string").alias("tree_name"), leaf_of(list(value.values())).alias("digest"),
        F.when(F.lit(False) if where is None else where, other).alias("new_leaf"),
    )
    ordered = numbered(materialise(leaves, "merkle-leaves"), [F.col("tree_name").asc_nulls_first(), F.col("doc_id").asc_nulls_first(), F.col("digest"), F.col("pos")])
    trees = materialise(ordered.groupBy("tree_name").agg(F.min("number").alias("tree"), F.count("*").alias("n")), "merkle-trees")  # the trees' order is that of their first leaves
    key = F.coalesce(F.concat(F.lit("="), "tree_name"), F.lit("")).alias("key")
    leaves = sized_join(ordered.select("*", key), trees.select(key, "tree", "n"), ["key"], "inner").select("doc_id", "tree_name", "digest", "new_leaf", "tree", (F.col("number") - F.col("tree")).alias("idx"), "n")
    rounds = _to_tops(leaves, trees.agg(F.max("n")).first()[0] or 0)

    roots = materialise(numbered(rounds[-1].select("tree", "digest"), [F.col("tree")], "idx"), "merkle-roots")
    n_trees = roots.count()
    upper = _to_tops(roots.select(F.lit(0).cast("long").alias("tree"), "idx", F.lit(n_trees).cast("long").alias("n"), "digest"), n_trees)
    root = upper[-1].first()
    whole = spark.createDataFrame([(0, 0, root.digest, [])] if root else [], _PATHS)
    subpaths = _descend(upper[0], _paths_of(upper, whole)) if n_trees > 1 else whole
    above = roots.join(subpaths.select("idx", "path"), "idx").select("tree", F.lit(0).cast("long").alias("idx"), F.col("digest").alias("tree_root"), "path")
    tops = _paths_of(rounds, materialise(above, "merkle-paths"))
    return _versions(leaves, tops, root.digest if root else "")


_OUT = "doc_id long, tree_name string, leaf string, subroot string, root string, proof string, new_leaf string, copied array<string>, folded_root string"


def _versions(leaves: DataFrame, tops: DataFrame, root: str) -> DataFrame:
    def run(rows: pa.Table, top: pa.Table) -> pa.Table:
        rows, block = _sorted(rows)
        subroot, rest = top.column("tree_root")[0].as_py(), top.column("path")[0].as_py()
        proofs, copied, folded = [], [], []
        for k, (own, new) in enumerate(zip(rows.column("digest").to_pylist(), rows.column("new_leaf").to_pylist())):
            path = block.path(k) + rest
            proofs.append(digest_of("".join(run["left"] + run["right"] for run in path)))
            made = copies(new or own, path)
            copied.append(made if new else None)
            folded.append(made[-1] if made else new or own)
        same = lambda value: pa.array([value] * len(rows), pa.string())
        columns = [rows.column("doc_id"), rows.column("tree_name"), rows.column("digest"), same(subroot), same(root), pa.array(proofs), rows.column("new_leaf"), pa.array(copied, pa.list_(pa.string())), pa.array(folded)]
        return pa.table(dict(zip((f.split(" ")[0] for f in _OUT.split(", ")), columns)))

    return _with_tops(leaves, tops).applyInArrow(run, _OUT)
