"""Checks of a stream of editor events and of a stream of files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..functions.positions import editor_ranges
from ..operators.rules import Options
from ..plans.check import check, check_by_row, problem
from ..plans.files import load_configs, nearest_configs, read_configs
from ..shared import cut
from ..sources import config
from ..sources.po import parse_files

Sink = Callable[[DataFrame, DataFrame, int], None]


def latest(events: DataFrame) -> DataFrame:
    """The last event of each uri: (uri, event, text, seq) with the largest seq."""
    return events.groupBy("uri").agg(F.max_by(F.struct("event", "text"), "seq").alias("e"), F.max("seq").alias("seq")).select("uri", "e.event", "e.text", "seq")


def check_buffers(events: DataFrame, options: Options | None = None) -> DataFrame:
    """Diagnostics of the buffers that are open after these events."""
    open_ones = latest(events).filter("event <> 'close'")
    return check(parse_files(open_ones.select(F.col("uri").alias("path"), F.encode("text", "UTF-8").alias("content"))), options)


_STATE = "seq long"
_EVENT = "uri string, event string, text string, seq long"


def newest(events: DataFrame) -> DataFrame:
    """A stream of (uri, event, text, seq): the last event of each uri in each micro-batch, if it is newer than all before.

    The state of a uri is the largest sequence number seen, so an event that arrives late changes nothing.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen, best = (state.get[0] if state.exists else None), None
        for frame in frames:
            row = frame.loc[frame["seq"].idxmax()]
            if (seen is None or row["seq"] > seen) and (best is None or row["seq"] > best["seq"]):
                best = row
        if best is not None:
            state.update((int(best["seq"]),))
            yield pd.DataFrame([[key[0], best["event"], best["text"], int(best["seq"])]], columns=["uri", "event", "text", "seq"])

    return events.select("uri", "event", "text", "seq").groupBy("uri").applyInPandasWithState(step, _EVENT, _STATE, "update", GroupStateTimeout.NoTimeout)


def watch_events(events: DataFrame, sink: Sink, options: Options | None = None, **writer) -> StreamingQuery:
    """Each micro-batch gives (uris touched, their diagnostics); a closed uri has none, so sinks replace per uri.

    Rules that need the file on disk look at no buffer. Events that are older than one seen before are left out.
    """

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        sink(batch.select("uri").distinct(), check_buffers(batch, options), number)
        batch.unpersist()

    return _start(newest(events), run, {"outputMode": "update"} | writer)


def watch_files(spark: SparkSession, root: str, sink: Sink, options: Options | None = None, **writer) -> StreamingQuery:
    """New *.po files below ``root`` are checked as they arrive."""
    files = spark.readStream.format("binaryFile").option("pathGlobFilter", "*.po").option("recursiveFileLookup", True).schema("path string, modificationTime timestamp, length long, content binary").load(root)

    def run(batch: DataFrame, number: int) -> None:
        sink(batch.select(F.col("path").alias("uri")).distinct(), check(parse_files(batch.select("path", "content")), options), number)

    return _start(files, run, writer)


class _Buffer(StatefulProcessor):
    """The text of a buffer and the number of its last event; a closed one keeps the number only, so that late events don't open it again."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "seq long, text string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: ARG002, N802, N803  names of the interface
        seen = self.last.get() if self.last.exists() else None
        seq, text, event = (seen[0], seen[1], None) if seen else (None, None, None)
        for r in sorted(rows, key=lambda r: r.seq):
            if seq is None or r.seq > seq:
                seq, event = r.seq, r.event
                text = None if event == "close" else text if r.text is None else r.text
        if event is not None:
            self.last.update((seq, text))
            yield Row(uri=key[0], event=event, text=text, seq=seq)

    def close(self) -> None:
        pass


def buffers(events: DataFrame) -> DataFrame:
    """A stream of (uri, event, text, seq): the state of each uri that a micro-batch changes. An event without a text, like a save, has the one before.

    Needs the RocksDB state store. Late and repeated events, by ``seq``, change nothing, over restarts too.
    """
    return events.select("uri", "event", "text", "seq").groupBy("uri").transformWithState(_Buffer(), outputStructType=_EVENT, outputMode="Update", timeMode="None")


_PUBLISHED = "array<struct<rule:string,severity:string,message:string,range:struct<start_row:int,start_column:int,end_row:int,end_column:int>>>"


def published(events: DataFrame, dictionaries: DataFrame | None = None, names: tuple[str, ...] = config.NAMES, **overrides) -> DataFrame:
    """(uri, seq, event, on_disk, diagnostics) of buffers (uri, event, text, seq): a row each, with all that is to be shown; none after a close.

    A buffer is checked under the configuration nearest to its path; an invalid one is the only
    diagnostic, on the first line. ``on_disk`` tells whether the buffer is what the file has (open and save).
    """
    open_ones = events.filter("event <> 'close'").select(F.col("uri").alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    paths = open_ones.select("path", F.regexp_replace("path", "^file://", "").alias("place"))
    places = paths.select(F.col("place").alias("path")).distinct()
    near = nearest_configs(places, read_configs(places, names), names).withColumn("config", F.coalesce("config_path", F.lit("")))
    configs = cut(load_configs(near.select("config_path", "toml").distinct(), **overrides))
    of_uri = paths.join(near.select(F.col("path").alias("place"), "config"), "place").select("path", "config")
    good = configs.filter("options is not null")
    selected = {r[0] for r in good.select(F.explode("rules")).distinct().collect()}  # rules there are
    told = problem(of_uri.join(configs.select("config", F.explode("problems").alias("p")), "config").select("path", "p.*"), F.col("rule"), F.col("severity"), F.col("message"))
    entries = parse_files(open_ones.join(of_uri.join(good.select("config"), "config", "left_semi"), "path", "left_semi").select("path", F.encode("text", "UTF-8").alias("content")))
    entries = entries.join(of_uri, "path").join(good.select("config", "options", "rules"), "config")
    found = told.union(check_by_row(entries, selected, dictionaries)) if selected else told
    shown = editor_ranges(found, open_ones).groupBy("path").agg(F.collect_list(F.struct("rule", "severity", "message", "range")).cast(_PUBLISHED).alias("found"))  # a buffer's own
    rows = events.join(shown.withColumnRenamed("path", "uri"), "uri", "left")
    return rows.select("uri", "seq", "event", F.col("event").isin("open", "save").alias("on_disk"), F.coalesce(F.array_sort("found"), F.array().cast(_PUBLISHED)).alias("diagnostics"))


def watch_buffers(events: DataFrame, sink: Callable[[DataFrame, int], None], dictionaries: DataFrame | None = None, names: tuple[str, ...] = config.NAMES, overrides: dict | None = None, **writer) -> StreamingQuery:
    """``published`` of each micro-batch of editor events."""

    def run(batch: DataFrame, number: int) -> None:
        batch.persist()
        sink(published(batch, dictionaries, names, **(overrides or {})), number)
        batch.unpersist()

    return _start(buffers(events), run, {"outputMode": "update"} | writer)


def _start(stream: DataFrame, run: Callable[[DataFrame, int], None], options: dict) -> StreamingQuery:
    out = stream.writeStream.foreachBatch(run)
    for k, v in options.items():
        out = out.trigger(**v) if k == "trigger" else out.outputMode(v) if k == "outputMode" else out.option(k, v)
    return out.start()
