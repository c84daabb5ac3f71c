"""Rewritten catalogue files: fixed translations put in place, obsolete entries taken out.

Replacements are rows of byte ranges, found by joins; each file is spliced where it is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.wrap import PAGE_WIDTH, message_lines
from ..plans.check import check, problem
from ..shared import cut
from ..sources import encodings, po
from ..sources.writer import write_contents
from .fixes import fix_translations, obsolete_entries
from .ranges import within
from .rules import Options


def replacements(entries: DataFrame, diagnostics: DataFrame, unsafe: bool = False) -> DataFrame:
    """(path, start, end, value, encoding): translations that change, and entries (value null) that go.

    A translation inside an entry that goes is left alone. Entries are read once, without their texts; those of files
    without ``fixable`` findings are not needed.
    """
    entries = cut(entries.select("path", "entry_idx", "byte_start", "byte_end", "encoding_name", F.transform("msgstr", lambda m: F.struct(m["byte_start"].alias("byte_start"), m["byte_end"].alias("byte_end"))).alias("msgstr")))
    gone = entries.join(obsolete_entries(diagnostics), ["path", "entry_idx"], "left_semi").select("path", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"))
    fixed = fix_translations(diagnostics, unsafe).select("path", F.col("byte_start").alias("start"), F.col("byte_end").alias("end"), F.col("fixed").alias("value"))
    return placed(entries, fixed, gone)


def fixable(diagnostics: DataFrame) -> DataFrame:
    """(path) of files that may change, each once."""
    return diagnostics.filter((F.size("edits") > 0) | (F.col("rule") == "obsolete")).select("path").distinct()


def placed(entries: DataFrame, fixed: DataFrame, gone: DataFrame) -> DataFrame:
    """As ``replacements``, from ranges that any tool may have found: new values of translations (path, start, end, value), and what goes (path, start, end).

    A value goes where a translation of the entries stands exactly; others, and those inside a range that goes, are left out.
    """
    texts = entries.select("path", F.explode("msgstr").alias("m"), F.col("encoding_name").alias("encoding")).select("path", F.col("m.byte_start").alias("start"), F.col("m.byte_end").alias("end"), "encoding")
    changed = within(fixed, gone, "left_anti").join(texts, ["path", "start", "end"]).select("path", "start", "end", "value", "encoding")
    return changed.union(gone.distinct().select("path", "start", "end", F.lit(None).cast("string"), F.lit(encodings.UTF_8)))


def block(original: bytes, value: str, encoding: str, page: int = PAGE_WIDTH) -> bytes:
    """A translation as lines of a catalogue, with the keyword of the original block, at most ``page`` columns wide (0: on one line)."""
    head = original[: original.find(b'"')].rstrip(b" \t").decode("utf-8", "replace")
    old = "#~ " if head.startswith("#~ ") else ""
    lines = message_lines(head, value, page)
    return "".join(f"{old if k else ''}{x}\n" for k, x in enumerate(lines)).encode("ascii") if "".join(lines).isascii() else b"".join(encodings.encode(f"{old if k else ''}{x}\n", encoding) for k, x in enumerate(lines))


def splice(content: bytes, changes: list[tuple[int, int, str | None, str]], page: int = PAGE_WIDTH) -> tuple[bytes, int]:
    """The content with byte ranges replaced, and how many; none if any two overlap, reach beyond the file or can't be encoded."""
    out, at = [], 0
    for start, end, value, encoding in sorted(changes, key=lambda c: (c[0], c[1])):
        if start < at or end > len(content):
            return content, 0
        try:
            new = b"" if value is None else block(content[start:end], value, encoding, page)
        except (UnicodeEncodeError, LookupError):
            return content, 0
        out += [content[at:start], new]
        at = end
    return b"".join([*out, content[at:]]), len(changes)


def rewritten(files: DataFrame, changes: DataFrame, page: int = PAGE_WIDTH) -> DataFrame:
    """(path, content, n) of files (path, content) that change; n replacements each. Texts are wrapped at ``page`` columns (0: not at all)."""
    of_file = changes.groupBy("path").agg(F.collect_list(F.struct("start", "end", "value", "encoding")).alias("changes"))  # a file's own

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths, contents, counts = [], [], []
            for path, content, some in zip(*(batch.column(c).to_pylist() for c in ("path", "content", "changes"))):
                new, n = splice(content, [(c["start"], c["end"], c["value"], c["encoding"]) for c in some], page)
                if n:
                    paths.append(path)
                    contents.append(new)
                    counts.append(n)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(contents, pa.binary()), pa.array(counts, pa.int32())], names=["path", "content", "n"])

    return files.select("path", "content").join(of_file, "path").mapInArrow(run, "path string, content binary, n int")


def fix_files(spark: SparkSession, *roots: str, options: Options | None = None, **more) -> DataFrame:
    """Fix the catalogues below mounted roots, and give the diagnostics of what is there then (``check`` arguments in ``more``).

    Edits are those of one check (safe ones, or all with ``unsafe_fixes``); a file is rewritten once and
    checked once more. A file that can't be written keeps its diagnostics and has a fix-write-error.
    """
    options = options or Options()
    files = cut(po.list_files(spark, *roots))
    bad = cut(po.unreadable(files))
    files = files.join(bad, "path", "left_anti")
    before = cut(check(po.read_listed(files), options, **more))
    some = po.read_listed(files.join(fixable(before), "path", "left_semi"))
    changes = cut(replacements(some, before, options.unsafe_fixes))
    new = cut(rewritten(po.read_contents(files.join(changes.select("path"), "path", "left_semi")), changes, options.width))
    written = cut(write_contents(new))
    done, failed = written.filter("error is null").select("path"), written.filter("error is not null")
    after = check(po.read_listed(files.join(done, "path", "left_semi")), options, **more)
    return before.join(done, "path", "left_anti").unionByName(after).union(problem(failed, "fix-write-error", "error", F.col("error"))).union(problem(bad, "read-error", "error", F.col("error")))
