"""Checks of whole folders: configuration of the nearest folder, unreadable files, what is missing.

Problems with files and settings are rows like any diagnostic, so one bad file ends no job.
"""

from __future__ import annotations

import dataclasses
import tomllib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rules import OPTIONS, Options, RowOptions, select_rules
from ..shared import cut
from ..sources import config, po
from ..sources.listing import is_mounted
from ..sources.words import languages_of, listed_words
from .check import check_by_row, checked_language, list_languages, problem, resolve_language

def folders(path: Column) -> Column:
    """The folders above a path, the nearest first."""
    parts = F.split(path, "/")
    return F.transform(F.reverse(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1)))), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def nearest_configs(files: DataFrame, configs: DataFrame, names: tuple[str, ...] = config.NAMES) -> DataFrame:
    """(path, config_path, toml) of files (path) and configurations (path, toml); null where no folder above has one.

    A folder's names are tried in their order. Only paths are shuffled.
    """
    order = F.array_position(F.array(*map(F.lit, names)), F.element_at(F.split("path", "/"), -1))
    placed = configs.select(F.regexp_replace("path", r"(?:/\.[^/]+)?/[^/]+$", "").alias("folder"), order.alias("place"), F.col("path").alias("config_path"), "toml").filter("place > 0")
    first = placed.groupBy("folder").agg(F.min_by(F.struct("config_path", "toml"), "place").alias("found"))
    above = files.select("path", F.posexplode(folders(F.col("path"))).alias("distance", "folder"))
    near = above.join(first, "folder").groupBy("path").agg(F.min_by("found", "distance").alias("found"))
    return files.select("path").join(near, "path", "left").select("path", "found.config_path", "found.toml")


def missing_dictionaries(entries: DataFrame, dictionaries: DataFrame, options: Options | None = None) -> DataFrame:
    """A warning per file whose spelling can't be checked because no word list serves its language.

    Without ``options``, entries have their own (see ``check.check_by_row``).
    """
    own = RowOptions(F.col("options")) if options is None else options
    value = lambda v: v if options is None else F.lit(v)
    names = None if options is None else {r.name for r in select_rules(options.select, options.ignore)}
    on = lambda *rules: F.arrays_overlap("rules", F.array(*map(F.lit, rules))) if names is None else F.lit(bool(names & set(rules)))
    listed = list_languages(dictionaries)
    headers = entries.filter("is_header")
    asked = [("spelling-ctxt-id", on("spelling-ctxt", "spelling-id"), checked_language(value(own.lang_id), own)), ("spelling-str", on("spelling-str"), checked_language(F.col("language"), own))]
    lacking = []
    for rule, selected, language in asked:
        rows = headers.filter(selected).select("path", language.alias("wanted"), value(own.path_dicts).alias("folder")).distinct()
        rows = rows.filter(F.col("wanted").isNotNull() & resolve_language(F.col("wanted"), listed).isNull())
        lacking.append(problem(rows, rule, "warning", F.concat(F.lit("dictionary not found for language '"), "wanted", F.lit("' (path: "), "folder", F.lit("), spelling rule ignored"))))
    return reduce(DataFrame.union, lacking)


def read_configs(files: DataFrame, names: tuple[str, ...] = config.NAMES) -> DataFrame:
    """(path, toml) of the configurations in the folders above files (path); mounted folders, hidden names too, are read by tasks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for folder in batch.column("folder").to_pylist():
                for name in names:
                    try:
                        with open(f"{po.local(folder)}/{name}", encoding="utf-8") as f:
                            out.append({"path": f"{folder}/{name}", "toml": f.read()})
                    except (OSError, UnicodeDecodeError):
                        continue
            yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("toml", pa.string())]))

    above = files.select(F.explode(folders(F.col("path"))).alias("folder")).distinct()
    return above.filter(F.col("folder").startswith("/") | F.col("folder").startswith("file:") | (F.col("folder") == "")).mapInArrow(run, "path string, toml string")


_LOADED = f"config string, options {OPTIONS}, rules array<string>, json string, own_languages array<string>, problems array<struct<rule:string,severity:string,message:string>>"


def load_configs(configs: DataFrame, **overrides) -> DataFrame:
    """Configurations (config_path, toml) as a dimension: config, options (rules.OPTIONS), rules, json, own_languages, problems.

    A row each, whatever their number; files of words that they name are read by the same task. Of an invalid one
    only ``problems`` is there.
    """
    fields = [f.name for f in dataclasses.fields(Options)]

    def load(where: str | None, toml: str | None) -> dict:
        row = {"config": where or "", "problems": []}
        try:
            options = config.load(toml or "", base=where and where.rpartition("/")[0], **overrides)
        except (ValueError, TypeError, tomllib.TOMLDecodeError) as e:
            row["problems"].append({"rule": "config-error", "severity": "error", "message": f"invalid config file (path: {where}): {e}"})
            return row
        try:
            rules = [r.name for r in select_rules(options.select, options.ignore)]
        except ValueError as e:
            row["problems"].append({"rule": "rules-error", "severity": "error", "message": str(e)})
            return row
        values = config.as_dict(options)
        for rule, field in (("force-trans", "force_trans"), ("no-trans", "no_trans")):
            values[field] = [w.lower() for w in values[field]]
            path = values[f"{field}_file"]
            if path is not None and rule in rules:
                try:
                    values[field] += listed_words(po.local(path))
                except OSError as e:
                    row["problems"].append({"rule": rule, "severity": "warning", "message": f"words file not found for rule '{rule}' (path: {path}): {e.strerror}, {rule} rule ignored"})
        return row | {"options": {k: list(v) if isinstance(v, tuple) else v for k, v in values.items()}, "rules": rules, "json": config.as_json(options), "own_languages": languages_of(options.path_words)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {f.name: pa.list_(pa.string()) if f.type.startswith("tuple") else {"bool": pa.bool_(), "int": pa.int32()}.get(f.type, pa.string()) for f in dataclasses.fields(Options)}
        strings = pa.list_(pa.string())
        arrow = pa.schema([("config", pa.string()), ("options", pa.struct([(n, kinds[n]) for n in fields])), ("rules", strings), ("json", pa.string()), ("own_languages", strings), ("problems", pa.list_(pa.struct([(n, pa.string()) for n in ("rule", "severity", "message")])))])
        for batch in batches:
            yield pa.RecordBatch.from_pylist([load(r["config_path"], r["toml"]) for r in batch.to_pylist()], arrow)

    return configs.select("config_path", "toml").mapInArrow(run, _LOADED)


def _personal(configs: DataFrame) -> DataFrame:
    """(language, word) of the folders of personal words that options name; a language is named folder, line feed, language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for folder in batch.column("folder").to_pylist():
                for language in languages_of(folder):
                    with open(f"{po.local(folder)}/{language}.dic", encoding="utf-8", errors="replace") as f:
                        words = [w for line in f if (w := line.rstrip("\r\n"))]
                    yield pa.RecordBatch.from_pylist([{"language": f"{folder}\n{language}", "word": w} for w in words], pa.schema([("language", pa.string()), ("word", pa.string())]))

    return configs.select(F.col("options.path_words").alias("folder")).filter("folder is not null").distinct().mapInArrow(run, "language string, word string")


def _configured(spark: SparkSession, roots: tuple[str, ...], names: tuple[str, ...], overrides: dict) -> tuple[DataFrame, DataFrame]:
    """(files with their config, configurations), both written."""
    files = cut(po.list_files(spark, *roots))
    configs = read_configs(files, names)
    stores = [r for r in roots if not is_mounted(r)]
    configs = configs.union(po.read_texts(spark, *stores, names=names)) if stores else configs
    of_file = cut(files.join(nearest_configs(files, configs, names), "path").withColumn("config", F.coalesce("config_path", F.lit(""))))
    return of_file, cut(load_configs(of_file.select("config_path", "toml").distinct(), **overrides))


def check_files(spark: SparkSession, *roots: str, dictionaries: DataFrame | None = None, personal: DataFrame | None = None, names: tuple[str, ...] = config.NAMES, **overrides) -> DataFrame:
    """Diagnostics of all catalogues below the roots, each under the configuration of its nearest folder.

    Options are a dimension: whatever the number of configurations, files are read once, in one plan.
    Unreadable files, invalid configurations and unknown rules give rows (read-error, config-error,
    rules-error), as do word lists and dictionaries that are missing.
    """
    files, configs = _configured(spark, roots, names, overrides)
    bad = cut(po.unreadable(files))
    told = files.join(configs.select("config", F.explode("problems").alias("p")), "config").select("path", "p.*")
    out = [problem(bad, "read-error", "error", F.col("error"))]
    out.append(problem(told, F.col("rule"), F.col("severity"), F.col("message")))
    good = configs.filter("options is not null")
    selected = {r[0] for r in good.select(F.explode("rules")).distinct().collect()}  # rules there are
    if not selected:
        return reduce(DataFrame.union, out)
    entries = po.read_listed(files.join(bad, "path", "left_anti").join(good.select("config"), "config", "left_semi"), roots, carry="config")
    entries = entries.join(good.select("config", "options", "rules", "own_languages"), "config")
    if personal is None:
        personal = _personal(good)
    else:
        entries = entries.drop("own_languages")
    out.append(check_by_row(entries, selected, dictionaries, personal=personal))
    if dictionaries is not None:
        out.append(missing_dictionaries(entries, dictionaries))
    return reduce(DataFrame.union, out)


def settings(spark: SparkSession, *roots: str, names: tuple[str, ...] = config.NAMES, **overrides) -> DataFrame:
    """path, config_path, settings (JSON), rules of every file: what ``check_files`` would use; null where the configuration is invalid."""
    files, configs = _configured(spark, roots, names, overrides)
    return files.join(configs.select("config", F.col("json").alias("settings"), "rules"), "config", "left").select("path", "config_path", "settings", "rules")


__all__ = ["check_files", "load_configs", "missing_dictionaries", "nearest_configs", "settings"]
