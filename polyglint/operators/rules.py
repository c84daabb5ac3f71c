"""The rule registry: each rule builds an array of findings from a source/translation pair.

A finding is struct(severity, message, src_marks, tgt_marks, edits). Marks and edits are in
code points; edits change the translation. All rules are Column expressions, so a check is one
projection per family of rules and one explode, whatever the number of rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field, fields
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.encodings import labels

FINDING = f"struct<severity:string,message:string,src_marks:array<{T.MARK}>,tgt_marks:array<{T.MARK}>,edits:array<{T.EDIT}>>"


@dataclass(frozen=True)
class Options:
    """Options of a check; the defaults are those of the command line."""

    select: tuple[str, ...] = ("default",)
    ignore: tuple[str, ...] = ()
    severity: tuple[str, ...] = ()
    fuzzy: bool = False
    noqa: bool = False
    obsolete: bool = False
    short_factor: int = 8
    long_factor: int = 8
    accelerator: str = "&"
    punc_ignore_ellipsis: bool = False
    force_trans: tuple[str, ...] = ()
    no_trans: tuple[str, ...] = ()
    langs: tuple[str, ...] = ()
    lang_id: str = "en_US"
    path_dicts: str = "/usr/share/hunspell"
    path_words: str | None = None
    force_trans_file: str | None = None
    no_trans_file: str | None = None
    width: int = 79
    unsafe_fixes: bool = False

    def __post_init__(self) -> None:
        if self.short_factor < 2 or self.long_factor < 2:
            raise ValueError("short_factor and long_factor must be 2 or more")
        if len(self.accelerator) != 1:
            raise ValueError("accelerator must be one character")


#: The options as a struct of columns.
OPTIONS = "struct<" + ",".join(f"{f.name}:{'array<string>' if f.type.startswith('tuple') else {'bool': 'boolean', 'int': 'int'}.get(f.type, 'string')}" for f in fields(Options)) + ">"


class RowOptions:
    """Options that each row has of its own, in a struct column (``OPTIONS``); lists of words are lower-cased."""

    def __init__(self, struct: Column) -> None:
        self._struct = struct

    def __getattr__(self, name: str) -> Column:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._struct[name]


def is_listed(word: Column, words: tuple[str, ...] | Column) -> Column:
    """Whether a list has a word, case aside."""
    if isinstance(words, Column):
        return F.array_contains(words, F.lower(word))
    # A lower-cased word has no fewer characters.
    return (F.length(word) <= max(map(len, words), default=0)) & F.lower(word).isin([w.lower() for w in words])


def given(value: tuple | bool | Column) -> bool:
    """Whether an option may be set: one that a row has may be."""
    return isinstance(value, Column) or bool(value)


@dataclass(frozen=True)
class Pair:
    """The columns that a rule may use."""

    src: Column
    tgt: Column
    row: Callable[[str], Column]
    options: Options | RowOptions
    with_marks: bool = True  # counts of findings need no marks and edits
    shared: frozenset[str] = frozenset()  # what rows have for all rules: see SHARED

    @property
    def dialect(self) -> Column:
        return self.row("format_language")

    @property
    def texts(self) -> tuple[Column, Column]:
        """Both texts as tokens are read from them: flattened where their specifications are deep."""
        return F.coalesce(self.row("src_flat"), self.src), F.coalesce(self.row("tgt_flat"), self.tgt)

    @property
    def signs(self) -> tuple[Column, Column]:
        """Texts that have all the characters of both texts that rules count."""
        return (self.row("src_signs"), self.row("tgt_signs")) if "signs" in self.shared else (self.src, self.tgt)

    @property
    def words(self) -> tuple[Column, Column]:
        return (self.row("src_words"), self.row("tgt_words")) if "words" in self.shared else tuple(T.words(s, self.dialect) for s in self.texts)


#: What several rules read of a text: computed once if more than one of them is selected.
SHARED: dict[str, tuple[frozenset[str], Callable[[Column, Column], Column]]] = {
    "signs": (frozenset(("brackets", "escapes", "newlines", "pipes", "tabs")), lambda s, dialect: T.signs(s)),
    "words": (frozenset(("double-words", "force-trans", "no-trans")), T.words),
}


@dataclass(frozen=True)
class Rule:
    name: str
    hook: str  # file, header, entry or pair
    default: bool
    check: bool
    safe: bool | None  # whether its edits are safe; None: it has none
    build: Callable[[Pair], Column] = field(repr=False)


RULES: dict[str, Rule] = {}


def rule(name: str, default: bool = True, check: bool = True, hook: str = "pair", safe: bool | None = None):
    def add(build: Callable[[Pair], Column]) -> Callable[[Pair], Column]:
        RULES[name] = Rule(name, hook, default, check, safe, build)
        return build

    return add


def select_rules(select: tuple[str, ...], ignore: tuple[str, ...] = ()) -> list[Rule]:
    """Rules by name or group (all, checks, default, spelling), without the ignored, sorted by name."""
    groups = {
        "all": set(RULES),
        "checks": {r.name for r in RULES.values() if r.check},
        "default": {r.name for r in RULES.values() if r.default},
        "spelling": {n for n in RULES if n.startswith("spelling-")},
    }
    unknown = sorted({*select, *ignore} - set(RULES) - set(groups))
    if unknown:
        raise ValueError(f"unknown rules: {', '.join(unknown)}")
    expand = lambda names: set().union(*(groups.get(n, {n}) for n in names))
    return [RULES[n] for n in sorted(expand(select) - expand(ignore))]


def findings(*parts: Column) -> Column:
    return parts[0] if len(parts) == 1 else F.concat(*parts)


def found(when: Column, severity: str | Column, message: Column | str, src: Column | None = None, tgt: Column | None = None, edits: Column | None = None) -> Column:
    """One finding if ``when`` holds, else none."""
    severity = F.lit(severity) if isinstance(severity, str) else severity
    message = F.lit(message) if isinstance(message, str) else message
    empty = T.none(T.MARK)
    one = F.struct(severity.alias("severity"), message.alias("message"), (empty if src is None else src).alias("src_marks"), (empty if tgt is None else tgt).alias("tgt_marks"), (T.none(T.EDIT) if edits is None else edits).alias("edits"))
    return F.when(when, F.array(one)).otherwise(T.none(FINDING))


def each(items: Column, severity: str, message: Callable[[Column], Column], src: Callable[[Column], Column] | None = None, tgt: Callable[[Column], Column] | None = None, edits: Callable[[Column], Column] | None = None) -> Column:
    """A finding for every item of an array."""
    part = lambda build, x, kind: build(x) if build else T.none(kind)
    return F.transform(items, lambda x: F.struct(F.lit(severity).alias("severity"), message(x).alias("message"), part(src, x, T.MARK).alias("src_marks"), part(tgt, x, T.MARK).alias("tgt_marks"), part(edits, x, T.EDIT).alias("edits")))


def edit(start: Column, end: Column, replacement: Column) -> Column:
    return F.array(F.struct(start.cast("int").alias("start"), end.cast("int").alias("end"), replacement.alias("replacement")))


def missing_or_extra(a: Column, b: Column, what: str | Column) -> Column:
    return F.concat(F.when(a > b, "missing ").otherwise("extra "), F.lit(what), F.lit(" ("), a.cast("string"), F.lit(" / "), b.cast("string"), F.lit(")"))


def compared(p: Pair, counts: tuple[Column, Column], severity: str, what: str | Column, src: Callable[[], Column], tgt: Callable[[], Column], edits: Column | None = None) -> Column:
    """A finding if the counts of both texts differ. They are bound once, and marks are built for findings only."""
    marks = (lambda f: f()) if p.with_marks else (lambda f: None)
    return T.let(list(counts), lambda a, b: found(a != b, severity, missing_or_extra(a, b, what), marks(src), marks(tgt), edits))


def counted(p: Pair, severity: str, what: str, text: str | None = None, chars: str = "", edits: Column | None = None) -> Column:
    """Occurrences of a text, or of any of some characters, are counted."""
    if text and len(text) > 1:
        n, spans = lambda s: T.occurrences(s, text), lambda s: T.positions(s, re.escape(text))
    else:
        n, spans = (lambda s: T.occurrences(s, text)) if text else (lambda s: T.count(s, f"[{chars}]")), lambda s: T.char_positions(s, text or chars)
    src, tgt = p.signs if text and text in T.SIGNS else (p.src, p.tgt)
    return compared(p, (n(src), n(tgt)), severity, what, lambda: spans(p.src), lambda: spans(p.tgt), edits)


def _of(words: Callable[[], Column], w: Column) -> Column:
    """The spans of a word among located ones."""
    return T.marks(F.filter(words(), lambda t: t["s"] == w))


@rule("accelerators")
def _(p: Pair) -> Column:
    marker = p.options.accelerator
    kind, own = (T.accelerator_kind(), marker) if isinstance(marker, Column) else (T.accelerator_kind(marker), None)
    n = lambda s: F.when(s.contains(marker), F.size(T.tokens(s, p.dialect, kind, marker=own))).otherwise(0)
    spans = lambda s: T.marks(T.located(s, p.dialect, kind, own))
    what = F.concat(F.lit("accelerators '"), marker if isinstance(marker, Column) else F.lit(marker), F.lit("'"))
    src, tgt = p.texts
    return compared(p, (n(src), n(tgt)), "warning", what, lambda: spans(src), lambda: spans(tgt))


@rule("acronyms", default=False)
def _(p: Pair) -> Column:
    src, tgt = p.texts
    kept = T.let([T.acronyms(src, p.dialect)], lambda a: F.when(F.size(a) > 0, F.array_except(a, T.acronyms(tgt, p.dialect))).otherwise(a))
    if given(p.options.force_trans):
        kept = F.filter(kept, lambda a: ~is_listed(a, p.options.force_trans))
    where = (lambda a: _of(lambda: T.located(src, p.dialect, "acronym"), a)) if p.with_marks else None
    return each(F.array_sort(kept), "warning", lambda a: F.concat(F.lit("acronym '"), a, F.lit("' must not be translated")), where)


@rule("blank")
def _(p: Pair) -> Column:
    return found(T.not_blank(p.src) & (p.tgt != "") & ~T.not_blank(p.tgt), "warning", "blank translation")


def _bracket(name: str, o: str, c: str) -> Callable[[Pair], Column]:
    # "(s)" is a plural mark, no pair of brackets: another character stands for its brackets where places are worked out.
    plain = lambda s: F.regexp_replace(s, r"\(([sS])\)", "_$1_") if o == "(" else s

    def counts(s: Column, signs: Column, shared: bool) -> list[Column]:
        if o != "(":
            return [T.occurrences(signs, o), T.occurrences(signs, c)]
        plurals = T.occurrences(s, "(s)") + T.occurrences(s, "(S)")
        return [T.occurrences(signs, o), T.occurrences(signs, c), F.when(signs.contains("()"), plurals).otherwise(0) if shared else plurals]

    def build(p: Pair) -> Column:
        def findings_of(a: Column, x: Column, b: Column, y: Column) -> Column:
            more, less = (a > b) & (x > y), (a < b) & (x < y)
            n = lambda k: k.cast("string")
            both = F.concat(F.when(a > b, "missing").otherwise("extra"), F.lit(f" opening and closing {name} brackets '{o}' ("), n(a), F.lit(" / "), n(b), F.lit(f") and '{c}' ("), n(x), F.lit(" / "), n(y), F.lit(")"))
            # Extra parentheses often explain a word of the translation.
            apart, paired = ~(more | less), more if o == "(" else more | less
            marks = lambda chars: (T.char_positions(plain(p.src), chars), T.char_positions(plain(p.tgt), chars)) if p.with_marks else ()
            return F.when((a == b) & (x == y), T.none(FINDING)).otherwise(findings(
                found(paired, "info", both, *marks(o + c)),
                found(apart & (a != b), "info", missing_or_extra(a, b, f"opening {name} brackets '{o}'"), *marks(o)),
                found(apart & (x != y), "info", missing_or_extra(x, y, f"closing {name} brackets '{c}'"), *marks(c)),
            ))

        shared = "signs" in p.shared
        bound = [*counts(p.src, p.signs[0], shared), *counts(p.tgt, p.signs[1], shared)]
        if o == "(":
            return T.let(bound, lambda a, x, s, b, y, t: T.let([a - s, x - s, b - t, y - t], findings_of))
        return T.let(bound, findings_of)

    return build


@rule("brackets")
def _(p: Pair) -> Column:
    return findings(*(_bracket(n, o, c)(p) for n, o, c in (("round", "(", ")"), ("square", "[", "]"), ("curly", "{", "}"), ("angle", "<", ">"))))


@rule("changed", default=False, check=False)
def _(p: Pair) -> Column:
    return found(T.not_blank(p.src) & T.not_blank(p.tgt) & (p.src != p.tgt), "info", "changed translation")


@rule("compilation", default=False, hook="file")
def _(p: Pair) -> Column:
    """Looks at files, not entries: see operators.compilation."""
    return T.none(FINDING)


@rule("double-quotes")
def _(p: Pair) -> Column:
    return counted(p, "info", "double quotes", chars=T.DOUBLE_QUOTES)


@rule("double-spaces", safe=True)
def _(p: Pair) -> Column:
    # Runs inside a line collapse, if the source has none; those at its ends are left to the rules for white space.
    runs = T.positions(p.tgt, r"(?<=[^ \n]) {2,}(?=[^ \n])")
    edits = F.when(~p.src.contains("  "), F.transform(runs, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit(" ").alias("replacement")))).otherwise(T.none(T.EDIT))
    return counted(p, "info", "double spaces '  '", "  ", edits=edits if p.with_marks else None)


@rule("double-words", default=False, safe=False)
def _(p: Pair) -> Column:
    numbers = lambda w: F.when(F.size(w) > 1, F.sequence(F.lit(1), F.size(w) - 1)).otherwise(F.array().cast("array<int>"))

    def pairs(gaps: Column, w: Column) -> Column:
        # White space only, and no apostrophe that was cut from the word before.
        blank = lambda k: F.get(gaps, k).rlike(r"(?U)^\s+\z") & (F.get(w, k)["start"] - F.get(w, k - 1)["end"] == F.length(F.get(gaps, k)))
        again = F.filter(numbers(w), lambda k: (F.get(w, k)["s"] == F.get(w, k - 1)["s"]) & blank(k))
        span = lambda k: F.array(F.struct(F.get(w, k - 1)["start"].alias("start"), F.get(w, k)["end"].alias("end")))
        gone = lambda k: edit(F.get(w, k - 1)["end"], F.get(w, k)["end"], F.lit(""))
        return each(again, "info", lambda k: F.concat(F.lit("word '"), F.get(w, k)["s"], F.lit("' is repeated")), tgt=span, edits=gone)

    def plain(gaps: Column, w: Column) -> Column:
        # A word that lost its apostrophe is not next to the gap after it.
        again = F.filter(numbers(w), lambda k: (F.get(w, k) == F.get(w, k - 1)) & F.get(gaps, k).rlike(r"(?U)^\s+\z"))
        return each(again, "info", lambda k: F.concat(F.lit("word '"), F.get(w, k), F.lit("' is repeated")))

    # A text needs a word, white space and the same word; the few that have them are cut into words. A specification may end inside a run of letters.
    some = p.tgt.rlike(rf"(?U)(?<![{T.ALNUM}ʼ])([{T.ALNUM}ʼ][{T.ALNUM}ʼ'’-]*+)\s+\1(?![{T.ALNUM}ʼ’-])") | (p.dialect.isNotNull() & p.tgt.rlike("[%{']"))
    _, tgt = p.texts
    if p.with_marks:
        return F.when(some, T.let([T.gaps(tgt, p.dialect), T.located_words(tgt, p.dialect)], pairs)).otherwise(T.none(FINDING))
    return F.when(some, T.let([T.gaps(tgt, p.dialect), p.words[1]], plain)).otherwise(T.none(FINDING))


def _same_tokens(what: str, differing: bool = False, strip: bool = True) -> Callable[[Pair], Column]:
    """``differing``: only tokens that the other text lacks are marked; ``strip``: quotes around a token don't count."""
    key = T.unquoted if strip else (lambda t: t)

    def build(p: Pair) -> Column:
        def one(kind: Column, a: Column, b: Column, x: Column, y: Column) -> Column:
            """a, b: the keys of the tokens; x, y: the tokens with their places."""
            count = kind == "count"
            only = lambda mine, keys, others: T.marks(F.filter(mine, lambda t, k: count | ~F.array_contains(others, F.get(keys, k))) if differing else mine)
            places = F.filter(F.sequence(F.lit(0), F.size(a) - 1), lambda k: F.get(a, k) != F.get(b, k))
            edits = F.when(~count, F.transform(places, lambda k: F.struct(F.get(y, k)["start"].alias("start"), F.get(y, k)["end"].alias("end"), T.unflat(F.get(x, k)["s"]).alias("replacement"))))
            message = F.when(count, missing_or_extra(F.size(a), F.size(b), what)).otherwise(f"different {what}")
            return found(F.lit(True), "warning", message, only(x, a, b), only(y, b, a), F.coalesce(edits, T.none(T.EDIT)))

        def compare(a: Column, b: Column) -> Column:
            same = F.array_sort(F.array_distinct(a)) == F.array_sort(F.array_distinct(b))
            kind = F.when(F.size(a) != F.size(b), "count").when(~same, "different")
            if not p.with_marks:
                return F.when(kind.isNotNull(), found(F.lit(True), "warning", F.when(kind == "count", missing_or_extra(F.size(a), F.size(b), what)).otherwise(f"different {what}"))).otherwise(T.none(FINDING))
            places = [T.located_alike(s, p.dialect, what) for s in p.texts]
            return F.when(kind.isNotNull(), T.let([kind, a, b, *places], one)).otherwise(T.none(FINDING))

        return T.let([F.transform(T.alike(s, p.dialect, what), key) for s in p.texts], compare)

    return build


rule("emails", safe=False)(_same_tokens("emails"))
rule("functions", default=False, safe=False)(_same_tokens("functions", differing=True))
rule("html-tags", default=False, safe=False)(_same_tokens("HTML tags", differing=True, strip=False))
rule("paths", default=False, safe=False)(_same_tokens("paths"))
rule("urls", default=False, safe=False)(_same_tokens("URLs"))


@rule("encoding", hook="entry")
def _(p: Pair) -> Column:
    return found(p.row("encoding_error"), "error", F.concat(F.lit("invalid characters for encoding "), p.row("encoding_name")))


@rule("escapes")
def _(p: Pair) -> Column:
    double = r"\\\\"
    marks = lambda spans: (spans(p.src), spans(p.tgt)) if p.with_marks else ()

    def build(a: Column, b: Column, x: Column, y: Column) -> Column:
        return findings(
            found(a != b, "error", missing_or_extra(a, b, r"escaped escape characters '\\'"), *marks(lambda s: T.positions(s, double))),
            found((a == b) & (x != y), "error", missing_or_extra(x, y, "escape characters '\\'"), *marks(lambda s: T.char_positions(s, "\\"))),
        )

    # Two in a row are two in a row of the signs, too.
    doubled = [F.when(signs.contains("\\\\"), T.occurrences(s, "\\\\")).otherwise(0) for s, signs in zip((p.src, p.tgt), p.signs)]
    return T.let([*doubled, *(T.occurrences(s, "\\") for s in p.signs)], build)


@rule("force-trans", default=False)
def _(p: Pair) -> Column:
    if not given(p.options.force_trans):
        return T.none(FINDING)
    src, tgt = p.texts
    mine, others = p.words
    own = F.array_distinct(F.filter(mine, lambda w: is_listed(w, p.options.force_trans)))
    kept = T.let([own], lambda own: F.when(F.size(own) > 0, F.array_intersect(others, own)).otherwise(own))
    where = [(lambda w, s=s: _of(lambda: T.located_words(s, p.dialect), w)) if p.with_marks else None for s in (src, tgt)]
    return each(kept, "warning", lambda w: F.concat(F.lit("word '"), w, F.lit("' must be translated")), *where)


def specs_key(s: Column, dialect: str) -> Column:
    """What must be equal in both texts: C specifications in order of their index, else the set."""
    specs = T.format_specs(s, dialect)
    if dialect != "C":
        return F.array_sort(F.array_distinct(specs))
    ranked = F.transform(specs, lambda m, k: F.struct(F.coalesce(F.nullif(F.regexp_extract(m, r"^%([0-9]+)\$", 1), F.lit("")).cast("int"), F.lit(2**31 - 1)).alias("i"), k.alias("k"), F.regexp_replace(m, r"^%[0-9]+\$", "%").alias("m")))
    return F.transform(F.array_sort(ranked), lambda r: r["m"])


@rule("formats")
def _(p: Pair) -> Column:
    src, tgt = p.texts
    differ = lambda d: (p.dialect == d) & (specs_key(src, d) != specs_key(tgt, d))
    some = F.when(differ("C"), "C")
    for d in list(T.FORMATS)[1:]:
        some = some.when(differ(d), d)
    marks = [T.marks(T.located(s, p.dialect, "format")) if p.with_marks else None for s in (src, tgt)]
    return T.let([some], lambda d: found(d.isNotNull(), "error", F.concat(F.lit("inconsistent format strings ("), d, F.lit(")")), *marks))


@rule("fuzzy", default=False, check=False, hook="entry")
def _(p: Pair) -> Column:
    return found(p.row("fuzzy"), "info", "fuzzy entry")


#: Required header fields and the severity of their absence, in order (fixed values).
HEADER_FIELDS = (
    ("Project-Id-Version", "info"), ("Report-Msgid-Bugs-To", "info"), ("POT-Creation-Date", "info"), ("PO-Revision-Date", "info"), ("Last-Translator", "info"),
    ("Language", "error"), ("Language-Team", "info"), ("Content-Type", "warning"), ("Content-Transfer-Encoding", "warning"),
)
#: Lines that can be added to a header (fixed values).
HEADER_DEFAULTS = {"Content-Type": "text/plain; charset=UTF-8", "Content-Transfer-Encoding": "8bit"}


def header_field(text: Column, name: str) -> Column:
    """The first value of a header field; null if it isn't there."""
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.contains(":") & (F.lower(T.trim(F.substring_index(x, ":", 1))) == name.lower()))
    return T.trim(F.regexp_replace(F.get(lines, F.lit(0)), r"^[^:]*:", ""))


def _parameter(value: Column, name: str) -> Column:
    """The first parameter of a name among those that a semicolon parts; null if there is none."""
    own = F.filter(F.split(value, ";", -1), lambda x: x.contains("=") & (F.lower(T.trim(F.substring_index(x, "=", 1))) == name))
    return T.trim(F.regexp_replace(F.get(own, F.lit(0)), r"^[^=]*=", ""))


def _is_content_type(v: Column) -> Column:
    charset = F.lower(_parameter(F.regexp_replace(v, r"^[^;]*;?", ""), "charset"))
    return v.contains(";") & (F.lower(T.trim(F.substring_index(v, ";", 1))) == "text/plain") & F.coalesce(charset.isin(sorted(labels())), F.lit(False))


def _is_plural_forms(v: Column) -> Column:
    digits = F.ltrim(F.regexp_extract(_parameter(v, "nplurals"), r"^\+?([0-9]+)\z", 1), F.lit("0"))
    return F.coalesce((digits != "") & (F.length(digits) <= 10) & (F.substring(digits, 1, 10).try_cast("long") < 1 << 32), F.lit(False))


#: How addresses are disguised, and what is meant (fixed values, in this order).
_DISGUISES = ((" at ", "@"), (" AT ", "@"), (" dot ", "."), (" DOT ", "."))


@rule("header", hook="header", safe=True)
def _(p: Pair) -> Column:
    get = {name: header_field(p.tgt, name) for name, _ in HEADER_FIELDS} | {"Plural-Forms": header_field(p.tgt, "Plural-Forms")}
    end = F.length(p.tgt)
    # A line of its own, whatever the header ends with.
    parted = lambda line: F.concat(F.when((p.tgt != "") & ~p.tgt.endswith("\n"), "\n").otherwise(""), F.lit(line))
    absent = []
    for name, severity in HEADER_FIELDS:
        add = edit(end, end, parted(f"{name}: {HEADER_DEFAULTS[name]}\n")) if name in HEADER_DEFAULTS else None
        absent.append(found(get[name].isNull(), severity, f"missing field '{name}' in header", edits=add))
    clear = lambda v: reduce(lambda x, kv: F.replace(x, F.lit(kv[0]), F.lit(kv[1])), _DISGUISES, v)
    mails, links = (lambda v, f=f, what=what: F.size(T.alike(f(v), F.lit(None).cast("string"), what)) for f, what in ((clear, "emails"), (lambda v: v, "URLs")))
    valid = [
        ("Content-Type", "error", _is_content_type),
        ("Plural-Forms", "error", _is_plural_forms),
        ("Language", "error", lambda v: v.rlike(r"^[a-z]{2,3}(?:_[A-Z]{2}(?:@[a-z]+)?)?\z")),
        ("Report-Msgid-Bugs-To", "info", lambda v: mails(v) == 1),
        ("Last-Translator", "info", lambda v: mails(v) == 1),
        ("Language-Team", "info", lambda v: mails(v) + links(v) == 1),
    ]
    wrong = [found(get[n].isNotNull() & ~ok(get[n]), severity, F.concat(F.lit("invalid value '"), get[n], F.lit(f"' for field '{n}' in header"))) for n, severity, ok in valid]
    return findings(*absent, *wrong)


def _lengths(p: Pair, build: Callable[[Column, Column], Column]) -> Column:
    """``build`` of the lengths of both texts without white space at their ends, each counted once."""
    return T.let([F.length(T.trim(p.src)), F.length(T.trim(p.tgt))], build)


@rule("long")
def _(p: Pair) -> Column:
    return _lengths(p, lambda a, b: found((a > 0) & (b > 0) & (a * p.options.long_factor <= b), "warning", F.concat(F.lit("translation too long ("), a, F.lit(" / "), b, F.lit(")"))))


@rule("newlines", safe=True)
def _(p: Pair) -> Column:
    out = [counted(p, "error", r"carriage returns '\r'", "\r"), counted(p, "error", r"line feeds '\n'", "\n")]
    head, tail = r"^[\r\n]*", r"((?<![\r\n])[\r\n]*\z)"
    lead = edit(F.lit(0), F.length(F.regexp_extract(p.tgt, head, 0)), F.regexp_extract(p.src, head, 0))
    end = F.length(p.tgt)
    trail = edit(end - F.length(F.regexp_extract(p.tgt, tail, 1)), end, F.regexp_extract(p.src, tail, 1))
    for where, has, fix in (("beginning", lambda s, c: s.startswith(c), lead), ("end", lambda s, c: s.endswith(c), trail)):
        for name, shown, c in (("carriage return", r"\r", "\r"), ("line feed", r"\n", "\n")):
            a, b = has(p.src, c), has(p.tgt, c)
            out.append(found(a != b, "error", F.concat(F.when(a, "missing").otherwise("extra"), F.lit(f" {name} '{shown}' at the {where}")), edits=fix))
    return findings(*out)


@rule("no-trans", default=False)
def _(p: Pair) -> Column:
    if not given(p.options.no_trans):
        return T.none(FINDING)
    n = lambda words, w: F.size(F.filter(words, lambda x: x == w))

    def build(a: Column, b: Column) -> Column:
        own = F.array_sort(F.array_distinct(a))
        bad = F.filter(own, lambda w: n(a, w) != n(b, w))
        where = [(lambda w, s=s: _of(lambda: T.located_words(s, p.dialect), w)) if p.with_marks else None for s in p.texts]
        return each(bad, "warning", lambda w: F.concat(F.lit("word '"), w, F.lit("' must not be translated ("), n(a, w), F.lit(" in source, "), n(b, w), F.lit(" in translation)")), *where)

    only = lambda words: F.filter(words, lambda w: is_listed(w, p.options.no_trans))
    return T.let([only(words) for words in p.words], build)


@rule("noqa", default=False, check=False, hook="entry")
def _(p: Pair) -> Column:
    return found(p.row("noqa") | (F.size(p.row("noqa_rules")) > 0), "info", "entry with noqa")


@rule("obsolete", default=False, check=False, hook="entry", safe=True)
def _(p: Pair) -> Column:
    return found(p.row("obsolete"), "info", "obsolete entry")


@rule("pipes")
def _(p: Pair) -> Column:
    return counted(p, "info", "pipes '|'", "|")


@rule("plurals", hook="entry")
def _(p: Pair) -> Column:
    n, wanted = F.size(p.row("msgstr")), p.row("nplurals")
    message = F.concat(F.when(n < wanted, "missing").otherwise("extra"), F.lit(" translated plural form (found: "), n, F.lit(", expected: "), wanted, F.lit(")"))
    return found((wanted > 0) & p.row("msgid_plural").isNotNull() & (n != wanted), "error", message)


_MARKS = f"[{T.PUNCTUATION}]"
_RUN = rf"(?:{_MARKS}|(?U:[\s&&[^\n]]))"


def _normal_punctuation(p: Pair, run: Column) -> Column:
    out = F.regexp_replace(run, r"(?U)\s+", "")
    out = F.translate(out, "\uff1a\uff1b\u061b\u3002\u0964\u0965\u17d4\u104b\u0589\uff0c\u060c\u3001\uff01\uff1f\u061f", ":;;......,,,!??")
    out = F.when(p.row("language_code") == "el", F.translate(out, "?", ";")).otherwise(out)
    alike = F.replace(out, F.lit("..."), F.lit("\u2026"))
    ignored = p.options.punc_ignore_ellipsis
    return F.when(ignored, alike).otherwise(out) if isinstance(ignored, Column) else alike if ignored else out


def _punctuation(p: Pair, edge: Callable[[Column], Column], build: Callable[..., Column]) -> Column:
    """``build`` of the runs of both texts, as they are and normalised; a run without a punctuation mark is none."""
    run = lambda s: F.when(s.rlike(_MARKS), s).otherwise("")
    return T.let([edge(p.src), edge(p.tgt)], lambda a, b: T.let([run(a), run(b)], lambda a, b: T.let([a, b, _normal_punctuation(p, a), _normal_punctuation(p, b)], build)))


@rule("punc-start", safe=True)
def _(p: Pair) -> Column:
    def build(a: Column, b: Column, x: Column, y: Column) -> Column:
        message = F.concat(F.lit("inconsistent leading punctuation ('"), x, F.lit("' / '"), y, F.lit("')"))
        return found((x != y) & ~x.startswith(".") & ~y.startswith("."), "info", message, edits=edit(F.lit(0), F.length(b), a))

    return _punctuation(p, lambda s: F.regexp_extract(s, f"^{_RUN}*+", 0), build)


@rule("punc-end", safe=True)
def _(p: Pair) -> Column:
    end = F.length(p.tgt)

    def build(a: Column, b: Column, x: Column, y: Column) -> Column:
        message = F.concat(F.lit("inconsistent trailing punctuation ('"), x, F.lit("' / '"), y, F.lit("')"))
        return found(x != y, "info", message, edits=edit(end - F.length(b), end, a))

    return _punctuation(p, lambda s: T.at_end(s, _RUN), build)


_SPACES = "[ \u00a0\u202f]"
_SIGNS = "[ \u00a0\u202f:;!?%\u00ab\u00bb]"


@rule("punc-space-id")
def _(p: Pair) -> Column:
    # A space before a sign counts once something else than spaces and signs has been seen.
    body = F.regexp_replace(p.src, f"^{_SIGNS}*", "")
    return each(T.matches(body, f"{_SPACES}(?=[:;!?])[:;!?]"), "info", lambda m: F.concat(F.lit("extra space before '"), F.substring(m, 2, 1), F.lit("' in source")))


@rule("punc-space-str", safe=True)
def _(p: Pair) -> Column:
    french, finnish = p.row("language_code") == "fr", p.row("language_code") == "fi"

    def one(i: Column, chars: Column, content: Column) -> Column:
        c, n = F.get(chars, i - 1), F.get(chars, i)
        hard = F.lit(T.NBSP)
        say = lambda m, lo, hi, new: F.struct(F.lit("info").alias("severity"), F.lit(m).alias("message") if isinstance(m, str) else m.alias("message"), T.none(T.MARK).alias("src_marks"), F.array(F.struct((i - 1).alias("start"), (i + 1).alias("end"))).alias("tgt_marks"), edit(lo, hi, new).alias("edits"))
        solid = lambda x: x.isin("\u00a0", "\u202f")
        return (
            F.when(french & (c == "«") & (n == " "), say("space must be a non-breaking space after '«' in translation", i, i + 1, hard))
            .when(french & (c == "«") & ~solid(n), say("missing non-breaking space after '«' in translation", i, i, hard))
            .when(french & (c != "«") & (n == "»") & (c == " "), say("space must be a non-breaking space before '»' in translation", i - 1, i, hard))
            .when(french & (c != "«") & (n == "»") & ~solid(c), say("missing non-breaking space before '»' in translation", i, i, hard))
            .when(french & c.rlike("^[0-9]") & (n == "%"), say("missing non-breaking space before '%' in translation", i, i, hard))
            .when(finnish & c.rlike("^[0-9]") & (n == "%"), say("missing space before '%' in translation", i, i, F.lit(" ")))
            .when(french & (i > content) & (c == " ") & n.isin(":", ";", "!", "?"), say(F.concat(F.lit("space must be a non-breaking space before '"), n, F.lit("' in translation")), i - 1, i, hard))
        )

    # The signs that matter are few: texts without them are not walked.
    some = p.tgt.rlike("[«»]|[0-9]%| [:;!?]")
    walk = lambda chars, content: F.filter(F.transform(F.sequence(F.lit(1), F.size(chars) - 1), lambda i: one(i, chars, content)), lambda x: x.isNotNull())
    walked = T.let([F.split(p.tgt, ""), F.length(F.regexp_extract(p.tgt, f"^{_SIGNS}*", 0))], walk)
    return F.when((french | finnish) & some & (F.length(p.tgt) > 1), walked).otherwise(T.none(FINDING))


@rule("short")
def _(p: Pair) -> Column:
    return _lengths(p, lambda a, b: found((a > 0) & (b > 0) & (b * p.options.short_factor <= a), "warning", F.concat(F.lit("translation too short ("), a, F.lit(" / "), b, F.lit(")"))))


def _spelling(where: str) -> Callable[[Pair], Column]:
    def build(p: Pair) -> Column:
        """The words are looked up by a join before; see plans.check."""
        bad = p.row(f"misspelled_{where}")
        label = {"ctxt": "context", "id": "source", "str": "translation"}[where]
        text = {"ctxt": F.coalesce(p.row("msgctxt.value"), F.lit("")), "id": p.texts[0], "str": p.texts[1]}[where]
        spans = T.marks(F.filter(T.located_words(text, p.dialect), lambda t: F.array_contains(bad, t["s"]))) if p.with_marks else None
        marks = (None, spans) if where == "str" else (spans, None)
        return found(F.size(bad) > 0, "info", F.concat(F.lit(f"misspelled words in {label}: "), F.array_join(F.array_sort(bad), ", ")), *marks)

    return build


for _where in ("ctxt", "id", "str"):
    rule(f"spelling-{_where}", default=False)(_spelling(_where))


@rule("tabs")
def _(p: Pair) -> Column:
    return counted(p, "error", r"tabs '\t'", "\t")


@rule("unchanged", default=False)
def _(p: Pair) -> Column:
    return found((p.src == p.tgt) & T.not_blank(p.src) & p.src.rlike(r"\p{IsLowercase}"), "info", "unchanged translation")


#: Languages whose script needs a control character (fixed values).
INDIC = "hi mr ne sa kok bn as ta te kn ml si gu or pa"
CONTROL_EXEMPT = (
    ("\u200b", f"km my lo th bo jv shn {INDIC}"),
    ("\u200c", f"ar fa ur ps ckb yi {INDIC}"),
    ("\u200d", f"ar fa ur ps ckb {INDIC}"),
    ("\u200e\u200f\u202a\u202b\u202c\u2066\u2067\u2068\u2069", "ar he fa ur yi ckb ps ug dv"),
)
#: Names of control characters (fixed values), and of ranges of the others.
CONTROL_NAMES = {
    "\u0000": "NULL", "\u0007": "BELL", "\u0008": "BACKSPACE", "\u000b": "VERTICAL TAB", "\u000c": "FORM FEED", "\u001b": "ESCAPE", "\u007f": "DELETE", "\u00ad": "SOFT HYPHEN",
    "\u200b": "ZERO WIDTH SPACE", "\u200c": "ZERO WIDTH NON-JOINER", "\u200d": "ZERO WIDTH JOINER", "\u200e": "LEFT-TO-RIGHT MARK", "\u200f": "RIGHT-TO-LEFT MARK",
    "\u2028": "LINE SEPARATOR", "\u2029": "PARAGRAPH SEPARATOR", "\u202a": "LEFT-TO-RIGHT EMBEDDING", "\u202b": "RIGHT-TO-LEFT EMBEDDING", "\u202c": "POP DIRECTIONAL FORMATTING", "\u202d": "LEFT-TO-RIGHT OVERRIDE",
    "\u202e": "RIGHT-TO-LEFT OVERRIDE", "\u2060": "WORD JOINER", "\u2061": "FUNCTION APPLICATION", "\u2062": "INVISIBLE TIMES", "\u2063": "INVISIBLE SEPARATOR", "\u2064": "INVISIBLE PLUS",
    "\u2066": "LEFT-TO-RIGHT ISOLATE", "\u2067": "RIGHT-TO-LEFT ISOLATE", "\u2068": "FIRST STRONG ISOLATE", "\u2069": "POP DIRECTIONAL ISOLATE", "\ufeff": "ZERO WIDTH NO-BREAK SPACE",
    "\ufff9": "INTERLINEAR ANNOTATION ANCHOR", "\ufffa": "INTERLINEAR ANNOTATION SEPARATOR", "\ufffb": "INTERLINEAR ANNOTATION TERMINATOR", "\ufffd": "REPLACEMENT CHARACTER",
}
CONTROL_RANGES = ((0x1F, "C0 CONTROL"), (0x9F, "C1 CONTROL"))


@rule("unicode-ctrl", safe=True)
def _(p: Pair) -> Column:
    chars = lambda s: F.array_sort(F.array_distinct(T.matches(s, f"[{T.CONTROL}]")))
    stray = F.array_except(chars(p.tgt), chars(p.src))
    for exempt, languages in CONTROL_EXEMPT:
        stray = F.when(p.row("language_code").isin(languages.split()), F.filter(stray, lambda c: ~c.isin(list(exempt)))).otherwise(stray)  # noqa: B023
    names = F.create_map(*[F.lit(x) for kv in CONTROL_NAMES.items() for x in kv])

    def name(c: Column) -> Column:
        others = F.lit("FORMAT CHARACTER")
        for most, shown in reversed(CONTROL_RANGES):
            others = F.when(F.ascii(c) <= most, shown).otherwise(others)
        return F.coalesce(names[c], others)

    # ascii() gives the code point of the first character.
    message = lambda c: F.concat(F.lit("extra control character U+"), F.lpad(F.hex(F.ascii(c)), 4, "0"), F.lit(" ("), name(c), F.lit(")"))

    def one(c: Column) -> Column:
        if not p.with_marks:
            return F.struct(F.when(c == "\u0000", "error").otherwise("warning").alias("severity"), message(c).alias("message"), T.none(T.MARK).alias("src_marks"), T.none(T.MARK).alias("tgt_marks"), T.none(T.EDIT).alias("edits"))
        at = F.transform(F.split(p.tgt, ""), lambda x, i: F.when(x == c, F.struct(i.alias("start"), (i + 1).alias("end"))))
        own = F.filter(at, lambda m: m.isNotNull())
        edits = F.transform(own, lambda m: F.struct(m["start"].alias("start"), m["end"].alias("end"), F.lit("").alias("replacement")))
        return F.struct(F.when(c == "\u0000", "error").otherwise("warning").alias("severity"), message(c).alias("message"), T.none(T.MARK).alias("src_marks"), own.alias("tgt_marks"), edits.alias("edits"))

    # Few texts have such a character: the others are not looked at further.
    return F.when(T.has_control(p.tgt), F.transform(F.array_sort(stray), one)).otherwise(T.none(FINDING))


@rule("untranslated", default=False, check=False)
def _(p: Pair) -> Column:
    return found(p.tgt == "", "info", "untranslated message")


def _edge(p: Pair, a: Column, b: Column, which: str, start: Column) -> Column:
    message = F.concat(F.lit(f"inconsistent {which} whitespace ('"), a, F.lit("' / '"), b, F.lit("')"))
    return found(T.not_blank(p.src) & T.not_blank(p.tgt) & (a != b), "info", message, edits=edit(start, start + F.length(b), a))


@rule("whitespace-start", safe=True)
def _(p: Pair) -> Column:
    return _edge(p, T.leading_space(p.src), T.leading_space(p.tgt), "leading", F.lit(0))


@rule("whitespace-end", safe=True)
def _(p: Pair) -> Column:
    b = T.trailing_space(p.tgt)
    return _edge(p, T.trailing_space(p.src), b, "trailing", F.length(p.tgt) - F.length(b))


def _line_edges(which: str) -> Callable[[Pair], Column]:
    space = T.leading_space if which == "leading" else T.trailing_space

    def build(p: Pair) -> Column:
        def lines(a: Column, b: Column) -> Column:
            n = F.size(b)
            inner = F.sequence(F.lit(1), n - 1) if which == "leading" else F.sequence(F.lit(0), n - 2)
            differ = F.filter(inner, lambda k: space(F.get(a, k)) != space(F.get(b, k)))

            def one(k: Column, ends: Column) -> Column:
                x, y, line = space(F.get(a, k)), space(F.get(b, k)), F.get(b, k)
                start = F.get(ends, k) - 1 - F.length(line) + (F.lit(0) if which == "leading" else F.length(line) - F.length(y))
                message = F.concat(F.lit(f"inconsistent {which} whitespace ('"), x, F.lit("' / '"), y, F.lit("')"))
                return F.struct(F.lit("info").alias("severity"), message.alias("message"), T.none(T.MARK).alias("src_marks"), T.none(T.MARK).alias("tgt_marks"), edit(start, start + F.length(y), x).alias("edits"))

            def found_in(differ: Column) -> Column:
                if not p.with_marks:
                    return each(differ, "info", lambda k: F.concat(F.lit(f"inconsistent {which} whitespace ('"), space(F.get(a, k)), F.lit("' / '"), space(F.get(b, k)), F.lit("')")))
                ends = T.running(F.transform(b, lambda t: F.length(t) + 1))
                return F.when(F.size(differ) > 0, T.let([ends], lambda ends: F.transform(differ, lambda k: one(k, ends)))).otherwise(T.none(FINDING))

            return F.when((F.size(a) == n) & (n >= 2), T.let([differ], found_in)).otherwise(T.none(FINDING))

        return T.let([F.split(p.src, "\n", -1), F.split(p.tgt, "\n", -1)], lines)

    return build


rule("whitespace-line-start", safe=True)(_line_edges("leading"))
rule("whitespace-line-end", safe=True)(_line_edges("trailing"))
