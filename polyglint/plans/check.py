"""Checks: gate entries, make pairs, run the selected rules in a few projections, explode once."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.rules import FINDING, RULES, SHARED, Options, Pair, RowOptions, Rule, select_rules
from ..shared import cut
from ..sources.affixes import Lexicon

#: Languages that may have a dictionary.
MAX_LANGUAGES = 1_000
#: Rules per projection; generated code of more would pass the size that the JVM compiles.
FAMILY = 6
DIAGNOSTIC_COLUMNS = ("path", "entry_idx", "pair_idx", "rule", "severity", "message", "line_number", "src", "tgt", "src_marks", "tgt_marks", "edits", "safe", "byte_start", "byte_end")


def barrier(rows: DataFrame) -> DataFrame:
    """Keep filters above from being pushed below, where the expressions of columns would be evaluated once more for each use."""
    return rows.withColumn("__row", F.monotonically_increasing_id()).filter("__row >= 0")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores, if they come in fewer partitions: rules cost far more than moving texts once. A larger table stays where it is."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def gate(entries: DataFrame, options: Options | RowOptions, rules: list[Rule]) -> DataFrame:
    """Entries that rules see: an entry state is skipped unless its option or its rule is on."""
    names = {r.name for r in rules}
    on = lambda name: F.array_contains("rules", name) if isinstance(options, RowOptions) else F.lit(name in names)
    body = on("untranslated") | F.col("is_translated")
    for state in ("fuzzy", "noqa", "obsolete"):
        asked = getattr(options, state)
        body &= (asked if isinstance(options, RowOptions) else F.lit(asked)) | on(state) | ~F.col(state)
    return entries.filter(F.col("is_header") | body)


def pairs(entries: DataFrame) -> DataFrame:
    """One row per translation: (msgid, msgstr[0]) and (msgid_plural, msgstr[n])."""
    one = F.explode(F.when(F.size("msgstr") > 0, F.col("msgstr")).otherwise(F.array(F.struct(F.lit(0).alias("idx"), F.col("line_number"), F.lit("").alias("value"), F.col("byte_start"), F.col("byte_end"))).cast(entries.schema["msgstr"].dataType)))
    rows = barrier(entries).withColumn("part", one)
    src = F.when((F.col("part.idx") > 0) & F.col("msgid_plural").isNotNull(), F.col("msgid_plural.value")).otherwise(F.col("msgid.value"))
    return rows.withColumns({"pair_idx": F.col("part.idx"), "src": src, "tgt": F.col("part.value"), "pair_line": F.col("part.line_number"), "pair_start": F.col("part.byte_start"), "pair_end": F.col("part.byte_end"), **{f"{n}_flat": T.flat(c, F.col("format_language")) for n, c in (("src", src), ("tgt", F.col("part.value")))}}).drop("part")


def _applies(r: Rule, by_row: bool) -> Column:
    """Whether a rule looks at a row: its hook, what noqa says, and whether the row's options have it."""
    allowed = F.lit(True) if r.name == "noqa" else ~(F.col("noqa") | F.array_contains("noqa_rules", r.name))
    allowed = allowed & F.array_contains("rules", r.name) if by_row else allowed
    first = F.col("pair_idx") == 0
    if r.hook == "header":
        return allowed & F.col("is_header") & first
    if r.hook == "entry":
        return allowed & ~F.col("is_header") & first
    if r.name == "spelling-ctxt":
        return allowed & ~F.col("is_header") & first & F.col("msgctxt").isNotNull()
    full = F.col("tgt") != ""
    return allowed & ~F.col("is_header") & (full | F.lit(r.name == "untranslated"))


def list_languages(dictionaries: DataFrame | Lexicon) -> list[str]:
    """The languages of a table of (language, word): configuration, so they are few."""
    found = [r[0] for r in (dictionaries.languages if isinstance(dictionaries, Lexicon) else dictionaries).select("language").distinct().limit(MAX_LANGUAGES + 1).collect()]
    if len(found) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages have a dictionary")
    return sorted(x for x in found if x)


def resolve_language(language: Column, listed: list[str]) -> Column:
    """The list that a language uses: its own, else that of the language without the country, else none (null)."""
    short = F.substring_index(language, "_", 1)
    return F.when(language.isin(listed), language).when(short.isin(listed), short)


def checked_language(language: Column, options: Options | RowOptions) -> Column:
    """The language, or null where the options leave it out."""
    if isinstance(options, RowOptions):
        return F.when((F.size(options.langs) == 0) | F.array_contains(options.langs, language), language)
    return F.when(language.isin(list(options.langs)), language) if options.langs else language


def _misspelled(rows: DataFrame, dictionaries: DataFrame, personal: DataFrame | None, where: str, options: Options) -> DataFrame:
    """The rows with words that the language's lists lack, which are added as misspelled_<where>.

    ``dictionaries`` and ``personal`` have (language, word); words are matched as they are or
    lower-cased. Texts of a language without a dictionary have no misspelled words. Only ids and
    words are shuffled: words once for each table of lists; a ``Lexicon`` looks up distinct words, from
    words that are written once. Rows are joined with the words found, with no more of their texts than is asked for.
    """
    by_row = isinstance(options, RowOptions)
    of_source = options.lang_id if by_row else F.lit(options.lang_id)
    text, language = {"ctxt": (F.col("msgctxt.value"), of_source), "id": (F.coalesce("src_flat", "src"), of_source), "str": (F.coalesce("tgt_flat", "tgt"), F.col("language"))}[where]
    language, keys = checked_language(language, options), ["path", "entry_idx", "pair_idx"]
    own = F.lit(None).cast("string")
    if personal is not None and "own_languages" in rows.columns:
        # Personal words of a row's folder are named by folder and language.
        short = F.substring_index(language, "_", 1)
        own = F.when(F.array_contains("own_languages", language), language).when(F.array_contains("own_languages", short), short)
        own = F.concat(options.path_words, F.lit("\n"), own)
    elif personal is not None:
        own = resolve_language(language, list_languages(personal))
    found = F.array_distinct(T.words(F.coalesce(text, F.lit("")), F.col("format_language")))
    words = rows.select(*keys, resolve_language(language, list_languages(dictionaries)).alias("listed"), own.alias("own"), found.alias("words")).filter("listed is not null")
    words = words.select(*keys, "listed", "own", F.explode("words").alias("word")).withColumn("low", F.lower("word"))
    if isinstance(dictionaries, Lexicon):
        words = cut(words)
        known = dictionaries.known(words.select(F.col("listed").alias("language"), "word").distinct())
        words = words.join(known.select(F.col("language").alias("listed"), "word"), ["listed", "word"], "left_anti")
    for name, lists in (("listed", dictionaries), ("own", personal)):
        if lists is not None and not isinstance(lists, Lexicon):
            known = lists.select(F.col("language").alias(name), F.lower("word").alias("low")).distinct()
            words = words.join(known, [name, "low"], "left_anti")
    words = barrier(words).filter(~F.rlike("word", F.lit("[0-9]")) & ~F.rlike("word", F.lit(r"^[A-Z]{2,}\z")))  # few are left
    of_row = words.groupBy(*keys).agg(F.collect_set("word").alias(f"misspelled_{where}"))  # a text's own words
    return rows.join(of_row, keys)


def check(entries: DataFrame, options: Options | None = None, dictionaries: DataFrame | None = None, marks: bool = True, personal: DataFrame | None = None) -> DataFrame:
    """Diagnostics of entries (see schema.ENTRY), one row each, unsorted; DIAGNOSTIC_COLUMNS.

    ``dictionaries`` and ``personal`` words are tables of (language, word), the first also a ``Lexicon``; without it, spelling rules are left out.

    A rule runs over whole texts in the JVM. The plan has no shuffle unless a spelling rule is on.
    Without ``marks`` findings have no marks, and edits are not to be relied on: for counts.
    """
    options = options or Options()
    return _check(entries, options, select_rules(options.select, options.ignore), dictionaries, marks, personal)


def check_by_row(entries: DataFrame, names: set[str], dictionaries: DataFrame | None = None, marks: bool = True, personal: DataFrame | None = None) -> DataFrame:
    """As ``check``, for entries with options of their own: columns ``options`` (see rules.OPTIONS) and ``rules`` (the selected ones, all of them in ``names``).

    With ``personal``, entries may have ``own_languages``: those that their folder of personal
    words (option ``path_words``) has; ``personal`` then names its lists folder, line feed, language.
    """
    return _check(entries, RowOptions(F.col("options")), [RULES[n] for n in sorted(names)], dictionaries, marks, personal)


def _check(entries: DataFrame, options: Options | RowOptions, rules: list[Rule], dictionaries: DataFrame | None, marks: bool, personal: DataFrame | None) -> DataFrame:
    rules = [r for r in rules if r.hook != "file"]
    if dictionaries is None:
        rules = [r for r in rules if not r.name.startswith("spelling-")]
    rows = barrier(pairs(gate(entries, options, rules)))
    out = run_rules(rows, [r for r in rules if not r.name.startswith("spelling-")], options, marks)
    for r in rules:
        if r.name.startswith("spelling-"):
            seen = rows.filter(_applies(r, isinstance(options, RowOptions)))
            found = _misspelled(seen, dictionaries, personal, r.name.removeprefix("spelling-"), options)
            out = out.union(run_rules(barrier(found), [r], options, marks, seen=True))
    return out


def _labelled(r: Rule) -> Callable[[Column], Column]:
    return lambda f: F.struct(F.lit(r.name).alias("rule"), F.lit(r.safe).cast("boolean").alias("safe"), f.alias("finding"))


def run_rules(rows: DataFrame, rules: list[Rule], options: Options | RowOptions, marks: bool = True, seen: bool = False) -> DataFrame:
    """Diagnostics of pairs; ``seen``: of none but rows that the rules look at."""
    names = {r.name for r in rules}
    shared = frozenset(name for name, (readers, _) in SHARED.items() if len(readers & names) > 1 or "brackets" in readers & names)  # brackets alone are counted ten times
    shared -= {"words"} if marks else set()  # rules with marks read words with their places
    pair = Pair(F.col("src"), F.col("tgt"), F.col, options, marks, shared)
    by_row = isinstance(options, RowOptions)
    if not rules:
        return rows.select(*_columns(F.lit(None).cast(f"struct<rule:string,safe:boolean,finding:{FINDING}>"))).limit(0)
    if shared:
        read = {"signs": (pair.src, pair.tgt), "words": pair.texts}
        rows = barrier(rows.withColumns({f"{side}_{name}": SHARED[name][1](s, F.col("format_language")) for name in sorted(shared) for side, s in zip(("src", "tgt"), read[name])}))
    groups = [rules[k : k + FAMILY] for k in range(0, len(rules), FAMILY)]
    for k, group in enumerate(groups):
        parts = []
        for r in group:
            result = r.build(pair) if seen else F.when(_applies(r, by_row), r.build(pair)).otherwise(T.none(FINDING))
            result = result.cast(f"array<{FINDING}>")
            parts.append(F.transform(result, _labelled(r)))
        rows = rows.withColumn(f"__found_{k}", reduce(F.concat, parts) if len(parts) > 1 else parts[0])
    everything = F.concat(*[F.col(f"__found_{k}") for k in range(len(groups))])
    out = barrier(rows.withColumn("__all", everything)).withColumn("__one", F.explode("__all")).select(*_columns(F.col("__one")), *([options.severity.alias("__severity")] if by_row else []))
    if by_row:
        return out.filter((F.size("__severity") == 0) | F.array_contains("__severity", F.col("severity"))).drop("__severity")
    return out.filter(F.col("severity").isin(*options.severity)) if options.severity else out


def _columns(one: Column) -> list[Column]:
    f = one["finding"]
    return [
        F.col("path"), F.col("entry_idx"), F.col("pair_idx"), one["rule"].alias("rule"), f["severity"].alias("severity"), f["message"].alias("message"), F.col("pair_line").alias("line_number"),
        F.col("src"), F.col("tgt"), f["src_marks"].alias("src_marks"), f["tgt_marks"].alias("tgt_marks"), f["edits"].alias("edits"), one["safe"].alias("safe"), F.col("pair_start").alias("byte_start"), F.col("pair_end").alias("byte_end"),
    ]


def problem(rows: DataFrame, rule: str | Column, severity: str | Column, message: Column) -> DataFrame:
    """A diagnostic of a file as a whole for each row with a path."""
    empty = {"entry_idx": F.lit(-1), "pair_idx": F.lit(0), "rule": F.lit(rule), "severity": F.lit(severity), "message": message, "line_number": F.lit(0), "src": F.lit(""), "tgt": F.lit("")}
    empty |= {"src_marks": T.none(T.MARK), "tgt_marks": T.none(T.MARK), "edits": T.none(T.EDIT), "safe": F.lit(None).cast("boolean"), "byte_start": F.lit(0).cast("long"), "byte_end": F.lit(0).cast("long")}
    return rows.select("path", *(c.alias(n) for n, c in empty.items())).select(*DIAGNOSTIC_COLUMNS)


def rule_catalog(spark) -> DataFrame:
    """name, is_default, is_check, hook, has_edits, safe of every rule."""
    return spark.createDataFrame([(r.name, r.default, r.check, r.hook, r.safe is not None, bool(r.safe)) for r in RULES.values()], "name string, is_default boolean, is_check boolean, hook string, has_edits boolean, safe boolean")
