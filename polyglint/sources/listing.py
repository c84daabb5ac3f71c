"""Catalogue files below folders, without hidden and ignored ones.

Folders are walked level by level: tasks list the folders of a level, ignore files are read where
they lie, and what they say of the level's names is a join of names with the patterns of all
folders above, of which the last that fits holds. Folders that are ignored are never listed.

``kept`` is that join for any table of paths, so that an inventory of a store can be filtered too.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..shared import cut

#: Files with patterns and their rank: a higher one holds over lower ones of any folder. The lower two count inside a repository only.
KINDS = {".git/info/exclude": 0, ".gitignore": 1, ".ignore": 2}
RULES = "folder string, rank int, line int, negated boolean, folders_only boolean, pattern string"
_FOUND = pa.schema([("folder", pa.string()), ("kind", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("text", pa.string())])
_FOUND_SQL = "folder string, kind string, path string, length long, text string"


def is_mounted(root: str) -> bool:
    """Whether tasks can open a root as a file: it has no scheme but ``file:``."""
    return root.startswith("file:") or not re.match(r"[A-Za-z][A-Za-z0-9+.-]*:", root)


def _class(body: str) -> str:
    no = body[:1] in ("!", "^")
    return "(?!/)[" + ("^" if no else "") + re.sub(r"([\[&~^\\])", r"\\\1", body[no:]) + "]"


def _glob(text: str) -> str:
    """A pattern as a regular expression over the path below its folder."""
    out, k = [], 0
    while k < len(text):
        c = text[k]
        if text.startswith("**/", k) and (k == 0 or text[k - 1] == "/"):
            out.append("(?:.*/)?")
            k += 3
            continue
        if text[k:] == "**" and k and text[k - 1] == "/":
            out.append(".+")
            break
        end = text.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif end > 0:
            out.append(_class(text[k + 1 : end]))
            k = end
        else:
            if c == "\\" and k + 1 < len(text):
                k += 1
            out.append(re.sub(r"([^A-Za-z0-9_/ \x80-\U0010ffff])", r"\\\1", text[k]))
        k += 1
    return "".join(out)


def rule_of(line: str) -> tuple[bool, bool, str] | None:
    """(negated, folders only, regular expression) of a line of an ignore file; null for comments and empty lines."""
    line = line.rstrip("\r\n")
    while line.endswith(" ") and not line.endswith("\\ "):
        line = line[:-1]
    if not line or line.startswith("#"):
        return None
    negated = line.startswith("!")
    line = line[negated:]
    if line[:2] in ("\\!", "\\#"):
        line = line[1:]
    folders_only = line.endswith("/")
    line = line[:-1] if folders_only else line
    anchored = "/" in line
    line = line.removeprefix("/")
    if not line:
        return None
    return negated, folders_only, "^" + ("" if anchored else "(?:.*/)?") + _glob(line) + r"\z"


def rules_of(files: DataFrame) -> DataFrame:
    """The patterns (``RULES``) of ignore files (folder, kind, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for folder, kind, text in zip(*(batch.column(c).to_pylist() for c in ("folder", "kind", "text"))):
                for n, line in enumerate((text or "").removeprefix("﻿").split("\n")):
                    if found := rule_of(line):
                        out.append({"folder": folder, "rank": KINDS[kind], "line": n} | dict(zip(("negated", "folders_only", "pattern"), found)))
            yield pa.RecordBatch.from_pylist(out, pa.schema([("folder", pa.string()), ("rank", pa.int32()), ("line", pa.int32()), ("negated", pa.bool_()), ("folders_only", pa.bool_()), ("pattern", pa.string())]))

    return files.select("folder", "kind", "text").mapInArrow(run, RULES)


def _above(path: Column) -> Column:
    """The folders above a path, the root (an empty text) first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def judged(names: DataFrame, rules: DataFrame, repositories: DataFrame) -> DataFrame:
    """``names`` (path, is_folder, ...) that are neither ignored nor hidden, by patterns of the folders above each.

    What is said of a name alone: a name below an ignored folder is another matter, see ``kept``.
    ``repositories`` has the folders that hold a repository; patterns of its kind reach no further up.
    """
    above = names.select("path", "is_folder", F.explode(_above(F.col("path"))).alias("folder"))
    nearest = above.join(repositories.select("folder").distinct(), "folder").groupBy("path").agg(F.max(F.length("folder")).alias("repository"))
    below = F.expr("substring(path, length(folder) + 2)")
    fits = (F.col("is_folder") | ~F.col("folders_only")) & F.rlike(below, F.col("pattern"))
    fitting = above.join(rules, "folder").filter(fits).join(nearest, "path", "left").filter((F.col("rank") == KINDS[".ignore"]) | (F.length("folder") >= F.col("repository")))
    last = fitting.groupBy("path").agg(F.max_by("negated", F.struct("rank", F.length("folder"), "line")).alias("negated"))
    return names.join(last, "path", "left").filter(F.coalesce("negated", ~_is_hidden())).drop("negated")


def _is_hidden() -> Column:
    return F.element_at(F.split("path", "/"), -1).startswith(".")


def kept(paths: DataFrame, rules: DataFrame, repositories: DataFrame) -> DataFrame:
    """``paths`` (path) of files that neither they nor a folder above them are ignored or hidden."""
    steps = paths.select("path", F.explode(F.concat(F.transform(F.slice(_above(F.col("path")), F.lit(2), F.size(_above(F.col("path")))), lambda p: F.struct(p.alias("step"), F.lit(True).alias("is_folder"))), F.array(F.struct(F.col("path").alias("step"), F.lit(False).alias("is_folder"))))).alias("s"))
    names = steps.select(F.col("s.step").alias("path"), F.col("s.is_folder").alias("is_folder")).distinct()
    gone = names.join(judged(names, rules, repositories), ["path", "is_folder"], "left_anti").select(F.col("path").alias("step"), "is_folder")
    lost = steps.select("path", "s.step", "s.is_folder").join(gone, ["step", "is_folder"], "left_semi").select("path").distinct()
    return paths.join(lost, "path", "left_anti")


def _scan(folder: str) -> Iterator[dict]:
    """What a folder holds: files, folders, the text of ignore files, and whether it is a repository."""
    try:
        entries = sorted(os.scandir(folder), key=lambda e: e.name)
    except OSError:
        return
    row = lambda kind, path, length=None, text=None: {"folder": folder.rstrip("/"), "kind": kind, "path": path, "length": length, "text": text}
    for e in entries:
        if e.is_dir(follow_symlinks=False):
            yield row("folder", e.path)
        elif e.is_file(follow_symlinks=False) and e.name.endswith(".po") and e.name != ".po":
            yield row("file", e.path, e.stat(follow_symlinks=False).st_size)
    yield from _patterns(folder, row)


def _patterns(folder: str, row) -> Iterator[dict]:
    if os.path.exists(os.path.join(folder, ".git")):
        yield row("repository", folder)
    for name in KINDS:
        path = os.path.join(folder, name)
        if os.path.isfile(path):
            try:
                with open(path, encoding="utf-8", errors="replace") as f:
                    yield row(name, path, text=f.read())
            except OSError:
                continue


def _start(root: str) -> Iterator[dict]:
    """A root itself, and the ignore files of the folders above it."""
    row = lambda kind, path, length=None, text=None: {"folder": os.path.dirname(path) if kind in ("file", "folder") else folder.rstrip("/"), "kind": kind, "path": path, "length": length, "text": text}
    if os.path.isfile(root):
        if root.endswith(".po"):
            yield row("file", root, os.path.getsize(root))
        return
    if os.path.isdir(root):
        yield row("folder", root)
    folder = os.path.dirname(root)
    while folder != "/":
        yield from _patterns(folder, row)
        folder = os.path.dirname(folder)


def _list(folders: DataFrame, scan) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                yield pa.RecordBatch.from_pylist(list(scan(path)), _FOUND)

    return cut(folders.select("path").mapInArrow(run, _FOUND_SQL))


def walk(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, length) of *.po files below mounted roots, or of roots that are such files (whatever ignore files say of them)."""
    asked = sorted({os.path.abspath(r) for r in roots})
    found = _list(spark.createDataFrame([(r,) for r in asked], "path string").coalesce(1), _start)
    files, seen = [found.filter("kind = 'file'").select("path", "length")], [found]
    level = found.filter("kind = 'folder'").select("path").distinct()
    most = spark.sparkContext.defaultParallelism * 4
    while n := level.count():
        found = _list(level.repartition(min(most, n)), _scan)
        seen.append(found)
        patterns = reduce(DataFrame.union, (x.filter("text is not null") for x in seen))
        names = found.filter("kind in ('file', 'folder')").select("path", "length", (F.col("kind") == "folder").alias("is_folder"))
        if patterns.isEmpty():
            good = names.filter(~_is_hidden())
        else:
            good = cut(judged(names, rules_of(patterns), reduce(DataFrame.union, (x.filter("kind = 'repository'") for x in seen))))
        files.append(good.filter("not is_folder").select("path", "length"))
        level = good.filter("is_folder").select("path")
    return reduce(DataFrame.union, files).distinct()


def walk_here(root: str) -> list[tuple[str, int]]:
    """As ``walk``, by one process, without ignore files of repositories further up: for the ``po`` data source, which plans on the driver."""
    out: list[tuple[str, int]] = []

    def visit(folder: str, rules: list[tuple[str, int, list[tuple[bool, bool, str]]]], repository: int) -> None:
        found = list(_scan(folder))
        if any(f["kind"] == "repository" for f in found):
            repository = len(folder)
        rules = rules + [(f["folder"], KINDS[f["kind"]], [r for line in f["text"].removeprefix("﻿").split("\n") if (r := rule_of(line))]) for f in found if f["text"] is not None]

        def fits(path: str, is_folder: bool) -> bool:
            best = (-1, -1)
            good = not os.path.basename(path).startswith(".")
            for base, rank, lines in rules:
                if (rank, len(base)) < best or (rank < 2 and (repository < 0 or len(base) < repository)):
                    continue
                for negated, folders_only, pattern in lines:
                    if (is_folder or not folders_only) and re.match(pattern.replace(r"\z", r"\Z"), path[len(base) + 1 :], re.DOTALL):
                        best, good = (rank, len(base)), negated
            return good

        for f in found:
            if f["kind"] == "file" and fits(f["path"], False):
                out.append((f["path"], f["length"]))
            elif f["kind"] == "folder" and fits(f["path"], True):
                visit(f["path"], rules, repository)

    root = os.path.abspath(root)
    if os.path.isfile(root):
        return [(root, os.path.getsize(root))] if root.endswith(".po") else []
    visit(root, [], -1)
    return sorted(out)
