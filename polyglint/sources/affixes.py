"""Hunspell dictionaries as tables, and words looked up in them by taking affixes off.

A word's forms are found by joins: its last letters meet the suffixes of its language (twice, as a
suffix may carry another one), its first letters the prefixes; what is left, with what was stripped put
back, meets the stems, whose flags must have the affixes taken off. So the cost is that of the words
asked for, and no dictionary is expanded. Parts of compounds are looked up likewise, and a word is cut
into them by a small dynamic program over its own parts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .encodings import decode, name_of

STEMS = "language string, stem string, flags array<string>"
RULES = "language string, kind string, flag string, both boolean, strip string, affix string, pattern string, more array<string>"
TRAITS = "language string, needs_affix string, forbidden string, only_compound string, compound string, first string, middle string, last string, least int"
_TRAIT_OF = {"NEEDAFFIX": "needs_affix", "PSEUDOROOT": "needs_affix", "FORBIDDENWORD": "forbidden", "ONLYINCOMPOUND": "only_compound", "COMPOUNDFLAG": "compound", "COMPOUNDBEGIN": "first", "COMPOUNDMIDDLE": "middle", "COMPOUNDEND": "last"}
_STRINGS = pa.list_(pa.string())


def flags_of(text: str, kind: str, aliases: list[str] = ()) -> list[str]:
    """The flags of a word: single characters, pairs (``long``) or numbers between commas (``num``); a number may stand for a listed set."""
    if aliases and text.isdigit():
        text = aliases[int(text) - 1] if 0 < int(text) <= len(aliases) else ""
    if kind == "num":
        return [x.strip() for x in text.split(",") if x.strip()]
    return [text[k : k + 2] for k in range(0, len(text), 2)] if kind == "long" else list(text)


def _condition(text: str, suffix: bool) -> str:
    plain = re.sub(r"([\\^$*+?(){}|])", r"\\\1", text.replace("[^", "[\0")).replace("[\0", "[^")
    return f"(?:{plain})\\z" if suffix else f"^(?:{plain})"


def parse_affixes(language: str, text: str) -> tuple[list[dict], dict, str, list[str]]:
    """(rules, traits, kind of flags, aliases of flag sets) of an affix file."""
    kind, aliases, rules, seen = "char", None, [], {}
    traits: dict = {"language": language, "least": 3} | dict.fromkeys(_TRAIT_OF.values())
    lines = [line.split() for line in text.removeprefix("﻿").splitlines() if line.strip() and not line.lstrip().startswith("#")]
    for p in lines:
        if p[0] == "FLAG" and len(p) > 1:
            kind = {"long": "long", "num": "num"}.get(p[1].lower(), "char")
        elif p[0] == "AF" and len(p) > 1:
            aliases = [] if aliases is None else [*aliases, p[1]]
    for p in lines:
        if p[0] in _TRAIT_OF and len(p) > 1:
            traits[_TRAIT_OF[p[0]]] = p[1]
        elif p[0] == "COMPOUNDMIN" and len(p) > 1:
            traits["least"] = max(1, int(p[1]))
        elif p[0] in ("PFX", "SFX") and len(p) >= 4:
            if (p[0], p[1]) not in seen:
                seen[p[0], p[1]] = p[2] == "Y"  # the line that counts the rules
                continue
            affix, _, more = p[3].partition("/")
            rules.append({
                "language": language, "kind": p[0], "flag": p[1], "both": seen[p[0], p[1]], "strip": "" if p[2] == "0" else p[2], "affix": "" if affix == "0" else affix,
                "pattern": _condition(p[4] if len(p) > 4 else ".", p[0] == "SFX"), "more": flags_of(more, kind, aliases or []),
            })
    return rules, traits, kind, aliases or []


def parse_stems(language: str, text: str, kind: str, aliases: list[str]) -> Iterator[dict]:
    """(language, stem, flags) of a word list; its first line is a count, and a slash after a backslash is part of a word."""
    for n, line in enumerate(text.removeprefix("﻿").splitlines()):
        line = re.split(r"\t|\s+(?=[a-z]{2}:)", line.strip())[0]
        if not line or (n == 0 and line.isdigit()):
            continue
        stem, _, flags = line.replace("\\/", "\0").partition("/")
        yield {"language": language, "stem": stem.replace("\0", "/").strip(), "flags": flags_of(flags.strip(), kind, aliases)}


@dataclass(frozen=True)
class Lexicon:
    """Dictionaries of several languages: stems, affix rules and traits."""

    stems: DataFrame
    rules: DataFrame
    traits: DataFrame

    @property
    def languages(self) -> DataFrame:
        return self.traits.select("language")

    def known(self, words: DataFrame) -> DataFrame:
        """The rows of ``words`` (language, word; distinct) that a dictionary has, as they are or with a case that their spelling allows."""
        word, low = F.col("word"), F.lower("word")
        title = F.concat(F.upper(F.substring("word", 1, 1)), F.lower(F.expr("substring(word, 2)")))
        upper = (word == F.upper("word")) & (word != low)
        shapes = F.when(upper, F.array(word, low, title)).when((word == title) & (word != low), F.array(word, low)).otherwise(F.array(word))
        asked = words.select("language", "word", F.explode(F.array_distinct(shapes)).alias("shape"))
        shapes = asked.select("language", F.col("shape").alias("word")).distinct()
        good = self._forms(shapes).select("language", "word")
        good = good.union(self._compounds(shapes.join(good.distinct(), ["language", "word"], "left_anti"))).distinct()
        bad = self.stems.join(self.traits.select("language", "forbidden"), "language").filter(F.array_contains("flags", F.col("forbidden"))).select("language", F.col("stem").alias("shape"))
        return asked.join(good.withColumnRenamed("word", "shape"), ["language", "shape"], "left_semi").join(bad, ["language", "shape"], "left_anti").select("language", "word").distinct()

    def _strip(self, forms: DataFrame, kind: str) -> DataFrame:
        """Forms with an affix taken off, and the rule's columns beside them."""
        rules = self.rules.filter(F.col("kind") == kind).drop("kind")
        end = kind == "SFX"
        # A word meets the affixes that are its own last or first letters.
        lengths = rules.groupBy("language").agg(F.array_sort(F.collect_set(F.length("affix"))).alias("lengths"))  # a handful
        cut = F.expr("right(form, n)" if end else "left(form, n)")
        asked = forms.join(lengths, "language").select(*forms.columns, F.explode("lengths").alias("n")).filter("n < length(form)").withColumn("affix", F.when(F.col("n") == 0, "").otherwise(cut))
        hit = asked.join(rules, ["language", "affix"])
        rest = F.expr("concat(left(form, length(form) - n), strip)" if end else "concat(strip, substring(form, n + 1))")
        return hit.withColumn("form", rest).filter(F.rlike("form", F.col("pattern"))).drop("n", "affix", "strip", "pattern")

    def _forms(self, words: DataFrame) -> DataFrame:
        """(language, word, flags) of words that are stems or come from one by affixes."""
        none = F.array().cast("array<string>")
        traits = self.traits.select("language", "needs_affix", "only_compound")
        base = words.select("language", "word", F.col("word").alias("form"), none.alias("needed"), none.alias("given"), F.lit(True).alias("pairs"), F.lit(False).alias("open"), F.lit(0).alias("n_suffixes"))
        open_ = lambda: F.coalesce(F.array_contains("more", F.col("needs_affix")), F.lit(False))  # noqa: E731  the form needs one more affix
        shape = lambda df, **c: df.select("language", "word", "form", *(v.alias(k) for k, v in c.items()))
        first = shape(self._strip(base.select("language", "word", "form"), "SFX").join(traits, "language"), needed=F.array("flag"), given=F.col("more"), pairs=F.col("both"), open=open_(), n_suffixes=F.lit(1))
        outer = first.select("language", "word", "form", F.get("needed", F.lit(0)).alias("outer"), F.col("pairs").alias("outer_pairs"), F.col("open"))
        second = self._strip(outer, "SFX").filter(F.array_contains("more", F.col("outer")))
        second = shape(second, needed=F.array("flag"), given=F.col("more"), pairs=F.col("both") & F.col("outer_pairs"), open=F.col("open"), n_suffixes=F.lit(2))
        suffixed = base.unionByName(first).unionByName(second)
        # A prefix is one of the stem's, or of those that the innermost suffix brings; beside a suffix both must allow it.
        prefixed = self._strip(suffixed.withColumnRenamed("needed", "before"), "PFX").join(traits, "language").filter((F.col("n_suffixes") == 0) | (F.col("pairs") & F.col("both")))
        brought = F.array_contains("given", F.col("flag"))
        # A suffix may also be one that the prefix brings.
        suffix = F.when(F.array_contains("more", F.get("before", F.lit(0))), none).otherwise(F.col("before"))
        prefixed = shape(prefixed, needed=F.when(brought, F.col("before")).otherwise(F.array_append(suffix, F.col("flag"))), open=F.when(F.col("n_suffixes") == 0, open_()).otherwise(F.col("open") & open_()))
        every = suffixed.select("language", "word", "form", "needed", "open").unionByName(prefixed)
        found = every.filter("not open").join(self.stems.withColumnRenamed("stem", "form"), ["language", "form"]).join(traits, "language")
        bare = F.size("needed") == 0
        lacks = F.coalesce(F.array_contains("flags", F.col("needs_affix")), F.lit(False)) & bare
        part = F.coalesce(F.array_contains("flags", F.col("only_compound")), F.lit(False))
        return found.filter(F.forall("needed", lambda f: F.array_contains("flags", f)) & ~lacks).select("language", "word", "flags", bare.alias("bare"), part.alias("part")).filter("not part")

    def _compounds(self, words: DataFrame) -> DataFrame:
        """(language, word) of words that are two or more stems which may stand beside each other."""
        traits = self.traits.filter("coalesce(compound, first, middle, last) is not null").select("language", "compound", "first", "middle", "last", "least")
        asked = words.join(traits, "language").filter("length(word) >= 2 * least")
        spans = F.expr("flatten(transform(sequence(1, length(word) - least + 1), a -> transform(sequence(least, length(word) - a + 1), n -> struct(a as at, n as n))))")
        parts = asked.withColumn("s", F.explode(spans)).select("language", "word", "least", "compound", "first", "middle", "last", F.col("s.at").alias("at"), F.col("s.n").alias("n"), F.expr("substring(word, s.at, s.n)").alias("stem"))
        may = lambda flag: F.coalesce(F.array_contains("flags", F.col("compound")), F.lit(False)) | F.coalesce(F.array_contains("flags", F.col(flag)), F.lit(False))
        hits = parts.join(self.stems, ["language", "stem"]).select("language", "word", F.struct("at", "n", may("first").alias("first"), may("middle").alias("middle"), may("last").alias("last")).alias("part"))
        of_word = hits.groupBy("language", "word").agg(F.collect_set("part").alias("parts"))  # a word's own parts

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                good = [_cut(len(w), parts) for w, parts in zip(batch.column("word").to_pylist(), batch.column("parts").to_pylist())]
                yield batch.select(["language", "word"]).filter(pa.array(good, pa.bool_()))

        return of_word.mapInArrow(run, "language string, word string")


def _cut(length: int, parts: list[dict]) -> bool:
    """Whether parts cover a word from its first to its last letter, two or more of them."""
    reached = {1}
    for p in sorted(parts, key=lambda p: p["at"]):
        end = p["at"] + p["n"]
        if p["at"] in reached and end <= length and p["first" if p["at"] == 1 else "middle"]:
            reached.add(end)
    return any(p["last"] and p["at"] > 1 and p["at"] in reached and p["at"] + p["n"] == length + 1 for p in parts)


def lexicon(spark: SparkSession, folder: str) -> Lexicon:
    """The dictionaries ``<language>.aff`` with ``<language>.dic`` of a folder, read by tasks; one without either file is none."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.{aff,dic}").load(folder)
    name = lambda n: F.regexp_extract("path", r"([^/]+)\.(aff|dic)$", n)
    both = files.select(name(1).alias("language"), name(2).alias("kind"), "content").groupBy("language").pivot("kind", ["aff", "dic"]).agg(F.first("content")).filter("aff is not null and dic is not null")

    def read(what: str, columns: str, arrow: pa.Schema) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for language, aff, dic in zip(*(batch.column(c).to_pylist() for c in ("language", "aff", "dic"))):
                    coding = re.search(rb"^SET\s+(\S+)", aff, re.MULTILINE)
                    text = lambda raw, name=(coding[1].decode("ascii", "replace") if coding else "ISO-8859-1"): decoded(raw, name)
                    rules, traits, kind, aliases = parse_affixes(language, text(aff))
                    rows = {"rules": rules, "traits": [traits], "stems": parse_stems(language, text(dic), kind, aliases) if what == "stems" else ()}[what]
                    rows = list(rows)
                    for k in range(0, len(rows), 10_000):
                        yield pa.RecordBatch.from_pylist(rows[k : k + 10_000], arrow)

        return both.mapInArrow(run, columns)

    text = lambda *names: [(n, pa.string()) for n in names]
    return Lexicon(
        read("stems", STEMS, pa.schema([*text("language", "stem"), ("flags", _STRINGS)])),
        read("rules", RULES, pa.schema([*text("language", "kind", "flag"), ("both", pa.bool_()), *text("strip", "affix", "pattern"), ("more", _STRINGS)])),
        read("traits", TRAITS, pa.schema([*text("language", "needs_affix", "forbidden", "only_compound", "compound", "first", "middle", "last"), ("least", pa.int32())])),
    )


def decoded(raw: bytes, label: str) -> str:
    return decode(raw, name_of(label) or "UTF-8")[0]
