"""Catalogues written by tasks: entries as files, and files put in place of others, each seen whole or not at all.

Tasks write beside the target, under a name of their own; the commit of the job renames. A task
that fails or is run twice leaves nothing behind, and neither does a job that is given up.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from ..functions.text import DIALECT_OF_FLAG
from ..functions.wrap import PAGE_WIDTH, message_lines
from .po import CatalogueSource, local


def escaped(text: Column) -> Column:
    """A text as it stands between quotes."""
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        text = F.replace(text, F.lit(raw), F.lit(shown))
    return text


def keyword_lines(keywords: Column) -> Column:
    """A line for each keyword of an entry."""
    return F.transform(keywords, lambda k: F.concat(F.lit("#, "), k))


def entry_lines(entries: DataFrame) -> Column:
    """The messages of an entry as (line_number, text): context, source, plural, and translations up to the first gap."""
    old = F.when(F.col("obsolete"), "#~ ").otherwise("")
    line = lambda m, *head: F.struct(m["line_number"].alias("line_number"), F.concat(old, *(F.lit(x) if isinstance(x, str) else x for x in head), F.lit(' "'), escaped(m["value"]), F.lit('"')).alias("text"))
    some = [F.when(F.col(c).isNotNull(), line(F.col(c), c)) for c in ("msgctxt", "msgid", "msgid_plural")]
    many = F.col("msgid_plural").isNotNull() | (F.size("msgstr") > 1)
    own = F.filter("msgstr", lambda m, k: m["idx"] == k)
    strs = F.transform(own, lambda m: F.when(many, line(m, "msgstr[", m["idx"].cast("string"), "]")).otherwise(line(m, "msgstr")))
    return F.concat(F.filter(F.array(*some), lambda x: x.isNotNull()), strs)


def entry_text(e: dict, page: int = PAGE_WIDTH) -> str:
    """An entry (schema.ENTRY) as it stands in a catalogue, wrapped, with the empty line behind it."""
    old, out = "#~ " if e["obsolete"] else "", []
    if e["noqa_rules"] and not any((k or "").startswith("noqa:") for k in e["keywords"]):
        out.append("# noqa:" + ";".join(e["noqa_rules"]))
    if e["noqa"] and "noqa" not in e["keywords"]:
        out.append("# noqa")
    kind = next((flag for flag, name in DIALECT_OF_FLAG.items() if name == e["format_language"]), None)
    flags = {"fuzzy": e["fuzzy"], "no-wrap": e["nowrap"], kind: kind and not any((k or "").endswith("-format") for k in e["keywords"])}
    words = [*e["keywords"], *(k for k, on in flags.items() if on and k not in e["keywords"])]
    if words:
        out.append("#, " + ", ".join(words))
    page = 0 if e["nowrap"] else page
    for c in ("msgctxt", "msgid", "msgid_plural"):
        if e[c] is not None:
            out += _prefixed(old, message_lines(old + c, e[c]["value"], page))
    many = e["msgid_plural"] is not None or len(e["msgstr"]) > 1
    for m in e["msgstr"]:
        out += _prefixed(old, message_lines(f"{old}msgstr[{m['idx']}]" if many else f"{old}msgstr", m["value"], page))
    return "\n".join(out) + "\n\n"


def _prefixed(old: str, lines: list[str]) -> list[str]:
    return [x if k == 0 else old + x for k, x in enumerate(lines)]


def header_text(e: dict) -> str:
    """A header that tells a reader what the entry's columns say."""
    fields = {"Language": e["language"], "Content-Type": "text/plain; charset=UTF-8", "Content-Transfer-Encoding": "8bit", "Plural-Forms": f"nplurals={e['nplurals']}; plural=0;" if e["nplurals"] else None}
    return "\n".join(['msgid ""', *message_lines("msgstr", "".join(f"{k}: {v}\n" for k, v in fields.items() if v))]) + "\n\n"


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[str, str]]  # (own name, target)


class _Files(DataSourceArrowWriter):
    """Renames at commit, deletes at abort."""

    def commit(self, messages: list[Written | None]) -> None:
        for m in messages:
            for own, target in m.files if m else ():
                os.replace(own, target)

    def abort(self, messages: list[Written | None]) -> None:
        for m in messages:
            _drop(own for own, _ in (m.files if m else ()))


def _drop(names) -> None:
    for name in names:
        if os.path.exists(name):
            os.remove(name)


def _beside(target: str) -> str:
    folder, name = os.path.split(target)
    return os.path.join(folder, f".{name}.{uuid.uuid4().hex}")


class _EntryWriter(_Files):
    """Entries, all of a path together, as the files of these paths below a folder."""

    def __init__(self, root: str, page: int) -> None:
        self.root, self.page = local(root), page

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done, out, path = [], None, None
        try:
            for batch in iterator:
                for e in batch.to_pylist():
                    if e["path"] != path or out is None:
                        if out:
                            out.close()
                        path, target = e["path"], os.path.join(self.root, e["path"])
                        os.makedirs(os.path.dirname(target), exist_ok=True)
                        done.append((_beside(target), target))
                        out = open(done[-1][0], "w", encoding="utf-8", newline="")  # noqa: SIM115  closed when the next file begins
                        if not e["is_header"]:
                            out.write(header_text(e))
                    out.write(entry_text(e, self.page))
            if out:
                out.close()
        except BaseException:
            _drop(own for own, _ in done)
            raise
        return Written(done)


class WritableCatalogues(CatalogueSource):
    """``po`` with a writer: ``entries.write.format("po").mode("append").save(folder)`` after ``spark.dataSource.register``; see ``write_entries``."""

    def writer(self, schema, overwrite: bool) -> _EntryWriter:  # noqa: ARG002
        return _EntryWriter(self.options["path"], int(self.options.get("width", PAGE_WIDTH)))


def write_entries(entries: DataFrame, folder: str, page: int = PAGE_WIDTH) -> None:
    """Entries as catalogues below a mounted folder, one for each path (relative), in UTF-8; entries without a header get one."""
    spark = entries.sparkSession
    spark.dataSource.register(WritableCatalogues)
    # Wrapping costs far more than moving texts: tasks are not to be put together by their bytes.
    tasks = max(spark.sparkContext.defaultParallelism * 4, int(spark.conf.get("spark.sql.shuffle.partitions")))
    entries.repartition(tasks, "path").sortWithinPartitions("path", "entry_idx").write.format("po").option("width", page).mode("append").save(folder)


class _ContentWriter(_Files):
    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        done = []
        try:
            for batch in iterator:
                for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                    target = os.path.realpath(local(path))
                    own = _beside(target)
                    try:
                        if os.path.exists(target) and not os.access(target, os.W_OK):
                            continue  # found by ``unwritten``
                        with open(own, "wb") as f:
                            done.append((own, target))
                            f.write(content)
                        if os.path.exists(target):
                            os.chmod(own, os.stat(target).st_mode & 0o7777)
                    except OSError:
                        _drop([own])
                        done = [d for d in done if d[0] != own]
        except BaseException:
            _drop(own for own, _ in done)
            raise
        return Written(done)


class ContentSink(DataSource):
    """``po-content``: (path, content) rows put in place of files."""

    @classmethod
    def name(cls) -> str:
        return "po-content"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> _ContentWriter:  # noqa: ARG002
        return _ContentWriter()


def write_contents(files: DataFrame) -> DataFrame:
    """Put (path, content, n) in place of mounted files; (path, n, error) of each, error null where the file is what it should be.

    Give a written table: it is read again for the comparison.
    """
    files.sparkSession.dataSource.register(ContentSink)
    files.select("path", "content").write.format("po-content").mode("append").save()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            errors = []
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                try:
                    with open(local(path), "rb") as f:
                        same = f.read() == content
                    if not same:
                        open(local(path), "ab").close()
                    errors.append(None if same else "the file could not be replaced")
                except OSError as e:
                    errors.append(f"{e.strerror} (os error {e.errno})")
            yield pa.RecordBatch.from_arrays([batch.column("path"), batch.column("n"), pa.array(errors, pa.string())], names=["path", "n", "error"])

    return files.select("path", "content", "n").mapInArrow(compare, "path string, n int, error string")

