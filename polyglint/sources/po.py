"""Catalogue files (gettext PO): one row per entry.

Files are read by ranges of bytes. A range has the entries that begin in it, after an empty line;
lines, entries and headers of the ranges before it are summed up in a first pass, as headers
decide how later entries are decoded. Rules run on entries anywhere.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .. import schema
from . import encodings
from .listing import is_mounted, walk

_ESCAPES = {"n": "\n", "r": "\r", "t": "\t", '"': '"', "\\": "\\"}
_DIALECTS = {"c": "C", "java": "Java", "python": "Python", "python-brace": "Python brace"}
_FIELDS = ("msgctxt", "msgid_plural", "msgid", "msgstr[", "msgstr")
_ESCAPED = re.compile(r"\\([nrt\"\\])")


def unescape(s: str) -> str:
    """Left to right; an unknown escape keeps its backslash."""
    return _ESCAPED.sub(lambda m: _ESCAPES[m[1]], s) if "\\" in s else s


def escape(s: str) -> str:
    for raw, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        s = s.replace(raw, shown)
    return s


@dataclass
class State:
    """What the headers so far tell about the entries after them."""

    encoding: str = encodings.UTF_8
    language: str | None = None
    language_code: str | None = None
    country: str | None = None
    nplurals: int = 0

    def read(self, header: str) -> None:
        for line in header.split("\n"):
            key, colon, value = line.partition(":")
            key = key.strip().lower() if colon else ""
            if key == "language":
                self.language = value.strip()
                code, joint, country = value.partition("_")
                self.language_code = code.strip()
                self.country = country.strip() if joint else self.country
            elif key == "content-type" and "charset=" in value:
                name = encodings.name_of(re.match(r"[^\s;]*", value.partition("charset=")[2])[0])
                if name and name != encodings.UTF_8:
                    self.encoding = name
            elif key == "plural-forms" and "nplurals=" in value:
                digits = re.match(r"[0-9]*", value.partition("nplurals=")[2])[0]
                if digits and int(digits) < 1 << 31:
                    self.nplurals = int(digits)


@dataclass
class _Block:
    start: int
    line: int
    end: int
    keywords: list[str] = field(default_factory=list)
    flags: dict = field(default_factory=lambda: dict.fromkeys(("fuzzy", "obsolete", "noqa", "nowrap", "encoding_error"), False))
    noqa_rules: list[str] = field(default_factory=list)
    dialect: str | None = None
    messages: dict = field(default_factory=dict)  # field or plural index -> [line, text, start, end]
    current: object = None

    def words(self, text: str) -> None:
        """A list of keywords after #, or #=."""
        for word in (w.strip() for w in text.split(",")):
            self.keywords.append(word)
            if word == "fuzzy":
                self.flags["fuzzy"] = True
            elif word == "no-wrap":
                self.flags["nowrap"] = True
            elif word == "noqa":
                self.flags["noqa"] = True
            elif word.startswith("noqa:"):
                self.noqa_rules = [r.strip() for r in word[5:].split(";")]
            elif word.endswith("-format"):
                self.dialect = _DIALECTS.get(word[: -len("-format")])

    def message(self, raw: bytes, state: State, line: int, start: int, end: int) -> None:
        if raw[:1] == b'"':
            if self.current is not None:
                held = self.messages[self.current]
                held[1].append(self.text(raw, state))
                held[3] = end
            return
        name = next((f for f in _FIELDS if raw.startswith(f.encode())), None)
        if name is None:
            return
        key: object = name
        if name == "msgstr[":
            digits = re.match(rb"\+?([0-9]+)\]", raw[len(name) :])
            if not digits or int(digits[1]) >= 1 << 31:
                return
            key = int(digits[1])
        elif name == "msgstr":
            key = 0
        self.current = key
        self.messages[key] = [line, [self.text(raw, state)], start, end]

    def text(self, raw: bytes, state: State) -> str:
        first, last = raw.find(b'"'), raw.rfind(b'"')
        if first == last:
            return ""
        text, bad = encodings.decode(raw[first + 1 : last], state.encoding)
        self.flags["encoding_error"] |= bad
        return text

    def read(self, lines: list[bytes], state: State) -> None:
        at = self.start
        for number, line in enumerate(lines, self.line):
            raw, end = line, at + len(line) + 1
            if line.startswith((b"#,", b"#=")):
                self.words(line[2:].decode("utf-8", "replace"))
            elif line.startswith(b"#~ "):
                self.flags["obsolete"] = True
                raw = line[3:]
            elif line.startswith(b"# noqa:"):
                self.noqa_rules = [r.strip() for r in line[7:].decode("utf-8", "replace").split(";")]
            elif line.startswith(b"# noqa"):
                self.flags["noqa"] = True
            if raw[:1] in (b"m", b'"'):
                self.message(raw, state, number, at, min(end, self.end))
            at = end


def _blocks(data: bytes, at: int, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """(first line feed before, start, stop, end) of the runs of lines that aren't empty and begin before ``limit``."""
    while True:
        before = at
        while data[at : at + 1] == b"\n":
            at += 1
        if at >= limit:
            return
        stop = data.find(b"\n\n", at)
        end = len(data) if stop < 0 else stop + 2
        yield before, at, (len(data) - data.endswith(b"\n") if stop < 0 else stop), end
        at = end


def parse(content: bytes, state: State | None = None, at: int = 0, limit: int | None = None, base: int = 0, line: int = 1, index: int = 0) -> Iterator[dict]:
    """The entries of a catalogue, as schema.ENTRY without the path.

    Of a part of a file: those that begin from ``at`` on and before ``limit``; ``base`` is the place of
    ``content`` in the file, ``line`` the number of the line at ``at``, ``index`` that of the first entry.
    """
    state, limit = state or State(), len(content) if limit is None else limit
    for before, start, stop, end in _blocks(content, at, limit):
        line += start - before
        lines = content[start:stop].split(b"\n")
        block = _Block(base + start, line, base + end)
        block.read(lines, state)
        yield _entry(block, state, index)
        line, index = line + len(lines) + 1, index + 1


def _entry(block: _Block, state: State, index: int) -> dict:
    get = lambda key, text=unescape: None if key not in block.messages else (lambda m: {"line_number": m[0], "value": text("".join(m[1])), "byte_start": m[2], "byte_end": m[3]})(block.messages[key])
    plurals = sorted(k for k in block.messages if isinstance(k, int))
    whole = next((n for n, k in enumerate(plurals) if n != k), len(plurals))  # text is unescaped up to the first gap
    msgstr = [{"idx": k, **get(k, unescape if n < whole else str)} for n, k in enumerate(plurals)]
    msgid = get("msgid")
    is_header = msgid is not None and msgid["value"] == ""
    # The header itself is decoded with what was known before it.
    if is_header and plurals[:1] == [0] and msgstr[0]["value"]:
        state.read(msgstr[0]["value"])
    return {
        "entry_idx": index, "line_number": block.line, "keywords": block.keywords, **block.flags, "noqa_rules": block.noqa_rules, "format_language": block.dialect,
        "msgctxt": get("msgctxt"), "msgid": msgid, "msgid_plural": get("msgid_plural"), "msgstr": msgstr, "byte_start": block.start, "byte_end": block.end,
        "is_header": is_header, "is_translated": any(m["value"] for m in msgstr), "language": state.language, "language_code": state.language_code, "country": state.country, "encoding_name": state.encoding, "nplurals": state.nplurals,
    }


_MESSAGE = pa.struct([("line_number", pa.int32()), ("value", pa.string()), ("byte_start", pa.int64()), ("byte_end", pa.int64())])
_PLURAL = pa.struct([("idx", pa.int32()), *((f.name, f.type) for f in _MESSAGE)])
_ARROW = pa.schema([
    ("path", pa.string()), ("entry_idx", pa.int32()), ("line_number", pa.int32()), ("keywords", pa.list_(pa.string())), *((c, pa.bool_()) for c in ("fuzzy", "obsolete", "noqa", "nowrap", "encoding_error")),
    ("noqa_rules", pa.list_(pa.string())), ("format_language", pa.string()), *((c, _MESSAGE) for c in ("msgctxt", "msgid", "msgid_plural")), ("msgstr", pa.list_(_PLURAL)), ("byte_start", pa.int64()), ("byte_end", pa.int64()),
    ("is_header", pa.bool_()), ("is_translated", pa.bool_()), *((c, pa.string()) for c in ("language", "language_code", "country", "encoding_name")), ("nplurals", pa.int32()),
])
#: Entries, and bytes of catalogues, that go into a batch.
BATCH_ROWS, BATCH_BYTES = 2_000, 8 << 20


def _batches(entries: Iterator[tuple[dict, dict]], schema_: pa.Schema = _ARROW) -> Iterator[pa.RecordBatch]:
    """Entries of any number of files, gathered; with each, what else its row has."""
    rows, size = [], 0
    for more, e in entries:
        rows.append(more | e)
        size += e["byte_end"] - e["byte_start"]
        if len(rows) >= BATCH_ROWS or size >= BATCH_BYTES:
            yield pa.RecordBatch.from_pylist(rows, schema_)
            rows, size = [], 0
    if rows:
        yield pa.RecordBatch.from_pylist(rows, schema_)


def parse_files(files: DataFrame) -> DataFrame:
    """Entries of (path, content) rows: files read before, or buffers that were never on disk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches(({"path": path}, e) for batch in batches for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()) for e in parse(content or b""))

    return files.select("path", "content").mapInArrow(run, schema.ENTRY)


#: Bytes of a file that one task parses.
RANGE = 16 << 20
#: A source without text, whose next line doesn't begin with any that surely stays one when it is decoded.
_EMPTY_ID = re.compile(rb'msgid(?!_plural)[^"\n]*+(?:""?+)?+[^"\n]*+(?:\Z|(?=\n)(?!\n(?:#~ )?"[A-Za-z0-9 ][^\n]*"))')


def _may_be_header(data: bytes, start: int, stop: int) -> bool:
    at = start
    while (at := data.find(b"msgid", at, stop)) >= 0:
        line = at - 3 if data[at - 3 : at] == b"#~ " and at - 3 >= start else at
        if (line == start or data[line - 1 : line] == b"\n") and _EMPTY_ID.match(data, at, stop):
            return True
        at += 5
    return False


@dataclass
class Part:
    """A range of a file's bytes: the entries that begin in it, and as much behind it as the last of them needs."""

    data: bytes
    base: int  # place of data in the file
    at: int  # where the first entry may begin, in data
    limit: int  # the range's end, in data
    lines: int  # line feeds of the range
    skipped: int  # those before ``at``

    @classmethod
    def read(cls, path: str, start: int, end: int, step: int = 1 << 16) -> Part:
        base = max(0, start - 2)
        with open(path, "rb") as f:
            f.seek(base)
            data = f.read(end - base)
            while data.find(b"\n\n", max(0, end - base - 1)) < 0:
                more = f.read(step)
                if not more:
                    break
                data += more
                step *= 2
        own = start - base
        if start == 0 or (start == 1 and data[:1] == b"\n"):
            at = own
        else:
            found = data.find(b"\n\n")
            at = len(data) if found < 0 else found + 2
        at = min(at, max(own, end - base))
        return cls(data, base, at, end - base, data.count(b"\n", own, end - base), data.count(b"\n", own, at))

    def survey(self) -> tuple[int, int, list[bytes]]:
        """Line feeds, entries, and the headers among them as they stand in the file."""
        blocks = [(a, b) for _, a, b, _ in _blocks(self.data, self.at, self.limit)]
        some = (self.data[a:b] for a, b in blocks if _may_be_header(self.data, a, b))
        return self.lines, len(blocks), [x for x in some if next(parse(x))["is_header"]]

    def entries(self, lines: int, index: int, headers: list[bytes]) -> Iterator[dict]:
        """The entries, from what the ranges before have: line feeds, entries and headers."""
        state = State()
        for x in headers:
            for _ in parse(x, state):
                pass
        return parse(self.data, state, self.at, self.limit, self.base, lines + self.skipped + 1, index)


def ranges_of(files: DataFrame, size: int = RANGE) -> DataFrame:
    """(path, start, end, lines, n, headers) of mounted files (path, length): ranges of bytes and what stands before each.

    Only files of several ranges are read for that, in one pass; sums of ranges are taken by file.
    """
    some = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("length") - 1, F.lit(0)), F.lit(size).cast("long"))).alias("start"))
    some = some.withColumn("end", F.least(F.col("start") + size, "length"))
    one, many = (some.filter(when).select("path", "start", "end") for when in (F.col("length") <= size, F.col("length") > size))

    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start, end in zip(*(batch.column(c).to_pylist() for c in ("path", "start", "end"))):
                try:
                    lines, n, headers = Part.read(local(path), start, end).survey()
                except OSError:  # a row of unreadable()
                    continue
                yield pa.RecordBatch.from_pylist([{"path": path, "start": start, "end": end, "lines": lines, "n": n, "headers": headers}], pa.schema([("path", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("lines", pa.int64()), ("n", pa.int64()), ("headers", pa.list_(pa.binary()))]))

    kind = "path string, start long, end long, lines long, n long, headers array<binary>"
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    of = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0).cast("long")).alias(c)
    # Rows are small and each stands for much reading: adaptive execution, which goes by bytes, would put them into one task.
    surveyed = many.repartition(files.sparkSession.sparkContext.defaultParallelism * 4, "path", "start").mapInArrow(survey, kind)
    placed = surveyed.select("path", "start", "end", of("lines"), of("n"), F.flatten(F.collect_list("headers").over(before)).alias("headers"))
    zero = F.lit(0).cast("long")
    return one.select("path", "start", "end", zero.alias("lines"), zero.alias("n"), F.array().cast("array<binary>").alias("headers")).union(placed)


def parse_ranges(ranges: DataFrame, carry: str | None = None) -> DataFrame:
    """Entries of ranges (see ``ranges_of``), each parsed where its row is. Files that can't be read have none; see ``unreadable``.

    ``carry``: a column of strings that the entries of a range keep.
    """
    arrow = _ARROW.append(pa.field(carry, pa.string())) if carry else _ARROW

    def of_row(row: dict) -> Iterator[tuple[dict, dict]]:
        try:
            part = Part.read(local(row["path"]), row["start"], row["end"])
        except OSError:
            return
        more = {"path": row["path"]} | ({carry: row[carry]} if carry else {})
        for e in part.entries(row["lines"], row["n"], row["headers"]):
            yield more, e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _batches((pair for batch in batches for row in batch.to_pylist() for pair in of_row(row)), arrow)

    return ranges.mapInArrow(run, schema.ENTRY + (f", {carry} string" if carry else ""))


def local(path: str) -> str:
    """The path of a mounted file, with or without ``file:``."""
    return re.sub(r"^file:(?://)?", "", path)


def _files(spark: SparkSession, roots: tuple[str, ...], names: str) -> DataFrame:
    # A file that can't be read is left out, not the end of the job.
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", names).option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True).load(list(roots))


def read_texts(spark: SparkSession, *roots: str, names: tuple[str, ...]) -> DataFrame:
    """(path, toml) of files of the given names below roots in stores that only Spark reads. Spark lists no hidden files, so only visible names are found."""
    last = ",".join(sorted({n.rpartition("/")[2] for n in names}))
    return _files(spark, roots, "{" + last + "}").select("path", F.decode("content", "UTF-8").alias("toml"))


_MOUNTED = "startswith(path, '/') or startswith(path, 'file:')"
#: Bytes that a row can hold; a longer file in a store that only Spark reads is a read-error.
MOST_BYTES = (1 << 31) - 64


def list_files(spark: SparkSession, *roots: str) -> DataFrame:
    """(path, length) of all *.po files below the roots, or of the roots that are such files. Nothing is read but ignore files.

    Mounted roots are walked by tasks (see ``listing.walk``). In other stores Spark's lister is used, which
    has no ignore files and skips names that begin with a dot or an underscore.
    """
    mounted, others = [r for r in roots if is_mounted(r)], [r for r in roots if not is_mounted(r)]
    out = walk(spark, *map(local, mounted)).select("path", "length")
    return out.union(_files(spark, tuple(others), "*.po").select("path", "length")).distinct() if others else out


def read_catalogues(spark: SparkSession, *roots: str, size: int = RANGE) -> DataFrame:
    """Entries of all *.po files below the roots."""
    return read_listed(list_files(spark, *roots), roots, size)


def read_listed(files: DataFrame, roots: tuple[str, ...] = (), size: int = RANGE, carry: str | None = None) -> DataFrame:
    """Entries of files (path, length) that ``list_files`` gave for ``roots``: mounted ones by ranges of bytes, those of other stores whole.

    ``carry``: a column of ``files`` (strings) that entries keep.
    """
    spark = files.sparkSession
    more = [carry] if carry else []
    ranges = ranges_of(files.filter(_MOUNTED), size)
    ranges = ranges.join(files.select("path", carry), "path") if carry else ranges  # paths only
    entries = parse_ranges(ranges.repartition(spark.sparkContext.defaultParallelism * 4, "path", "start"), carry)
    others = tuple(r for r in roots if not is_mounted(r))
    if not others:
        return entries
    found = _files(spark, others, "*.po").filter(F.col("length") < MOST_BYTES).select("path", "content").join(files.select("path"), "path", "left_semi")
    far = parse_files(found)
    return entries.union(far.join(files.select("path", *more), "path").select(entries.columns) if carry else far)


def read_contents(files: DataFrame) -> DataFrame:
    """(path, content) of mounted files (path, length), which tasks open; those that can't be read or held in a row are left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                try:
                    with open(local(path), "rb") as f:
                        content = f.read()
                except OSError:
                    continue
                yield pa.RecordBatch.from_pylist([{"path": path, "content": content}], pa.schema([("path", pa.string()), ("content", pa.binary())]))

    return files.filter(F.col("length") < MOST_BYTES).select("path").mapInArrow(run, "path string, content binary")


def unreadable(files: DataFrame) -> DataFrame:
    """(path, error) of files (path, length) that can't be opened and read."""

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bad = []
            for path, length in zip(batch.column("path").to_pylist(), batch.column("length").to_pylist()):
                try:
                    with open(local(path), "rb") as f:
                        f.read(1)
                        f.seek(max(0, (length or 0) - 1))
                        f.read(1)
                except OSError as e:
                    bad.append({"path": path, "error": f"{e.strerror} (os error {e.errno})"})
            yield pa.RecordBatch.from_pylist(bad, pa.schema([("path", pa.string()), ("error", pa.string())]))

    long = files.filter(f"not ({_MOUNTED})").filter(F.col("length") >= MOST_BYTES).select("path", F.lit("the file is too long for a row").alias("error"))
    return files.filter(_MOUNTED).select("path", "length").mapInArrow(probe, "path string, error string").union(long)


class CatalogueSource(DataSource):
    """``spark.read.format("po").load(path)`` after ``spark.dataSource.register(CatalogueSource)``; for folders that every executor mounts.

    Files are read by ranges of bytes (option ``range``). A range's task skims what stands before it
    in the file, some hundred times as fast as parsing; ``read_catalogues`` does that once a file.
    """

    @classmethod
    def name(cls) -> str:
        return "po"

    def schema(self) -> str:
        return schema.ENTRY

    def reader(self, schema) -> DataSourceReader:  # noqa: ARG002
        return _Reader(self.options["path"], int(self.options.get("range", RANGE)))


    def streamReader(self, schema) -> DataSourceStreamReader:  # noqa: ARG002, N802  name of the interface
        return _StreamReader(self.options["path"], int(self.options.get("range", RANGE)))


class _StreamReader(DataSourceStreamReader):
    """New and changed files, in the order of their time of change and path; an offset is the last of them.

    A file should get its name when it is whole, and no time of change before that of files already read.
    """

    def __init__(self, root: str, size: int) -> None:
        self.root, self.size = local(root), size

    def _listed(self) -> list[tuple[int, str, int]]:
        from .listing import walk_here

        return sorted((os.stat(path).st_mtime_ns, path, length) for path, length in walk_here(self.root))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"time": 0, "path": ""}

    def latestOffset(self) -> dict:  # noqa: N802
        found = self._listed()
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, last = ((o["time"], o["path"]) for o in (start, end))
        return [InputPartition((path, at)) for time, path, length in self._listed() if after < (time, path) <= last for at in range(0, max(length, 1), self.size)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return _Reader(self.root, self.size).read(partition)

    def commit(self, end: dict) -> None:
        pass


class _Reader(DataSourceReader):
    def __init__(self, root: str, size: int) -> None:
        self.root, self.size = local(root), size

    def partitions(self) -> list[InputPartition]:
        from .listing import walk_here

        return [InputPartition((path, start)) for path, length in walk_here(self.root) for start in range(0, max(length, 1), self.size)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        path, start = partition.value
        length, lines, n, headers = os.path.getsize(path), 0, 0, []
        for k in range(0, start, self.size):
            found = Part.read(path, k, min(k + self.size, length)).survey()
            lines, n, headers = lines + found[0], n + found[1], headers + found[2]
        yield from _batches(({"path": path}, e) for e in Part.read(path, start, min(start + self.size, length)).entries(lines, n, headers))
