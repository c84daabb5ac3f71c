"""Column helpers over strings: counts, positions, edges and tokens. All of them stay in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "struct<start:int,end:int>"
TOKEN = "struct<s:string,start:int,end:int>"
EDIT = "struct<start:int,end:int,replacement:string>"

# Fixed values of the rules.
DOUBLE_QUOTES = "\"\u00ab\u00bb\u201c\u201d\u201e\u201f\uff02"
PUNCTUATION = ":;.,!?\uff1a\uff1b\u061b\u3002\u0964\u0965\u17d4\u104b\u0589\uff0c\u060c\u3001\uff01\uff1f\u061f\u2026"
CONTROL = r"\x00-\x08\x0B\x0C\x0E-\x1F\x7F-\x9F\u00AD\u200B-\u200F\u2028\u2029\u202A-\u202E\u2060-\u2064\u2066-\u2069\uFFF9-\uFFFB\uFFFD\uFEFF"
#: All other characters, the most frequent ones first: a text is told to have no control characters by few comparisons.
NO_CONTROL = r"\x20-\x7E\xA0-\u00AC\u00AE-\u200A\t\n\r\u2010-\u2027\u202F-\u205F\u2065\u206A-\uFEFE\uFF00-\uFFF8\uFFFC\uFFFE-\x{10FFFF}"
NBSP = "\u00a0"

ALNUM = r"\p{IsAlphabetic}\p{N}"
#: Characters one by one, which the JVM's patterns hold as bits: classes of ranges and properties are far slower, so runs of these are read first.
_BITS = "".join(rf"\x{c:02x}" for c in b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789")
_SHOWN = "".join(rf"\x{c:02x}" for c in (*range(0x20, 0x7F), 9, 10, 13))
WORD = rf"[{ALNUM}ʼ][{ALNUM}ʼ'’-]*"
#: White space other than a line feed, at the ends of a string.
LEADING, TRAILING = r"^(?U)[\s&&[^\n]]*", r"(?U)[\s&&[^\n]]*\z"

#: Levels of nested braces that the patterns read; texts that may have more are flattened first (see ``flat``).
NESTING = 24
#: What stands for braces inside a specification in flattened texts.
_INNER = "\ue001\ue002"


def _nested(inside: str, first: str = "") -> str:
    """A brace, what follows up to its partner or, without one, to the end of the text."""
    out = r"(?!)"
    for _ in range(NESTING):
        out = rf"\{{(?:{inside}|{out})*+(?:\}}|\z)"
    return out.replace(r"\{", r"\{" + first, 1)


@dataclass(frozen=True)
class Dialect:
    """Regular expressions of a format dialect. All repetitions of groups are possessive: they run as loops and can't overflow the stack on long texts."""

    spec: str  # a format specification
    one: str  # units that count as one character and begin with the one in the group, like a doubled marker
    marks: str  # characters that either of them begins with, for use inside brackets


FORMATS = {
    "C": Dialect(r"%(?!%|\z)[-+ #.$0-9]*+(?:hh?|ll?|[qLjzZt])?+[A-Za-z]?+", "(%)%", "%"),
    "Java": Dialect(_nested(r"[^{}']++|''|'[^']*+(?:'|\z)", "(?=[0-9])"), "(')(?:'|[^']*+')", r"\{'"),
    "Python": Dialect(r"%(?!%|\z)(?:\([^)]*+(?:\)|\z))?+[-+ #.0-9]*+[hlL]?+[A-Za-z]?+", "(%)%", "%"),
    "Python brace": Dialect(_nested(r"[^{}]++", r"(?!\{|\z)"), r"(\{)\{", r"\{"),
}
_PLAIN = Dialect("(?!)", "(?!)", r"￿")  # a character that no text has; patterns read it like any other
DIALECT_OF_FLAG = {"c-format": "C", "java-format": "Java", "python-format": "Python", "python-brace-format": "Python brace"}

#: What tokens are made of: a function of the dialect gives (what may stand before a token, the token).
_KINDS: dict[str, Callable[[Dialect], tuple[str, str]]] = {}


def _kind(name: str):
    def add(build: Callable[[Dialect, str, str], tuple[str, str]]):
        # Inside patterns of tokens, groups of their own would shift the numbers of those that are read.
        _KINDS[name] = lambda d: build(d, d.spec, d.one.replace("(", "(?:", 1) if d.one != "(?!)" else d.one)
        return build

    return add


@_kind("format")
def _(d: Dialect, spec: str, one: str) -> tuple[str, str]:
    return rf"{one}|[^{d.marks}]++|(?!{spec})[{d.marks}]", spec


@_kind("word")
def _(d: Dialect, spec: str, one: str) -> tuple[str, str]:
    more = rf"[{ALNUM}ʼ’-]|{one}|'" if d is FORMATS["Java"] else rf"[{ALNUM}ʼ'’-]"
    return rf"{spec}|{one}|[ \n,.]++|[^{ALNUM}ʼ{d.marks}]++|[{d.marks}]", rf"(?:[{_BITS}]|[{ALNUM}ʼ])(?:[{_BITS}]++|{more})*+"


@_kind("acronym")
def _(d: Dialect, spec: str, one: str) -> tuple[str, str]:
    return rf"{spec}|{one}|[ \n,.]++|[^{ALNUM}{d.marks}]++|[{d.marks}]", rf"(?:[{_BITS}]++|[{ALNUM}])++"


@_kind("token")
def _(d: Dialect, spec: str, one: str) -> tuple[str, str]:
    """Runs without white space; specifications at either end don't belong to one."""
    unit = rf"(?:{one}|[^\s{d.marks}]++|(?!{spec})[{d.marks}])"
    return rf"{spec}|\s++", rf"{unit}(?:(?:{spec})*+{unit})*+"


@_kind("html")
def _(d: Dialect, spec: str, one: str) -> tuple[str, str]:
    tag = r"<(?=[A-Za-z/])(?:[^>\"']++|\"[^\"]*+(?:\"|\z)|'[^']*+(?:'|\z))*+>"
    return rf"{spec}|{one}|[^<{d.marks}]++|[{d.marks}]|(?!{tag})<", tag


@_kind("function")
def _(d: Dialect, spec: str, one: str) -> tuple[str, str]:
    name = rf"[A-Za-z0-9_](?:::|->|{spec}|[A-Za-z0-9_.]++)*+"
    return rf"{spec}|{one}|{name}(?!\(\))|[^A-Za-z0-9_{d.marks}]++|[{d.marks}]", rf"{name}\(\)"


#: Stands for a marker that a row has.
ROW_MARKER = "\ue000"


def accelerator_kind(marker: str = ROW_MARKER) -> str:
    """The kind of token that is one accelerator marker: before a letter or digit, and not doubled."""
    m, name = "\\" + marker, "accelerator " + marker

    @_kind(name)
    def _(d: Dialect, spec: str, one: str) -> tuple[str, str]:
        return rf"{spec}|{one}|{m}{m}|{m}(?![{ALNUM}])|[^{m}{d.marks}]++|(?!{m})[{d.marks}]", rf"{m}(?=[{ALNUM}])"

    return name


def by_dialect(dialect: Column, build: Callable[[Dialect], Column]) -> Column:
    """``build`` for the row's dialect. Patterns inside are literals: Spark compiles one that isn't whenever it differs from the last row's."""
    out = build(_PLAIN)
    for name, d in FORMATS.items():
        out = F.when(dialect == name, build(d)).otherwise(out)
    return out


def _pattern(d: Dialect, kind: str) -> str:
    """Group 1: what stands before a token, group 2: the token. Matches follow each other without gaps."""
    return r"(?U)\G((?:{})*+)({})".format(*_KINDS[kind](d))


def _extract(s: Column, dialect: Column, kind: str, group: int, marker: Column | None = None) -> Column:
    pattern = lambda d: F.lit(_pattern(d, kind)) if marker is None else F.replace(F.lit(_pattern(d, kind)), F.lit(ROW_MARKER), marker)
    return by_dialect(dialect, lambda d: F.regexp_extract_all(s, pattern(d), F.lit(group)))


def flat(s: Column, dialect: Column) -> Column:
    """Null, or the text with other signs for the braces inside a specification, where it may have more levels than patterns read.

    Braces are matched by a running depth over braces and quotes, at any depth; lengths stay, so places do.
    """
    java, end = dialect == "Java", F.lit(None).cast("string")

    def walk(t: Column, last: Column) -> Column:
        def step(a: Column, k: Column) -> Column:
            x, after = F.get(t, k), F.coalesce(F.get(t, k + 1), end)
            deep, quote = a["depth"] > 0, java & (x == "'")
            begins = F.when(java, after.rlike("^[0-9]")).otherwise(after != "{")
            opens = (x == "{") & ~a["quoted"] & ~a["doubled"] & (deep | F.coalesce(begins, F.lit(False)))
            closes = (x == "}") & ~a["quoted"] & deep
            # Outside a specification a quote needs its partner.
            quoted = F.when(~quote, a["quoted"]).when(a["quoted"], False).otherwise(deep | (k < last))
            doubled = ~java & (x == "{") & ~deep & ~a["doubled"] & F.coalesce(after == "{", F.lit(False))
            inner = F.when(a["quoted"] | (x == "{"), deep).otherwise(a["depth"] > 1)
            out = F.array_append(a["out"], F.when(inner, F.translate(x, "{}", _INNER)).otherwise(x))
            return F.struct((a["depth"] + F.when(opens, 1).when(closes, -1).otherwise(0)).alias("depth"), quoted.alias("quoted"), doubled.alias("doubled"), out.alias("out"))

        start = F.struct(F.lit(0).alias("depth"), F.lit(False).alias("quoted"), F.lit(False).alias("doubled"), F.array().cast("array<string>").alias("out"))
        return F.aggregate(F.sequence(F.lit(0), F.size(t) - 1), start, step, lambda a: F.array_join(a["out"], ""))

    parts = F.regexp_extract_all(s, F.lit("[{}']|[^{}']+"), F.lit(0))
    walked = let([parts], lambda t: let([t, F.size(t) - F.array_position(F.reverse(t), "'").cast("int")], walk))
    return F.when(dialect.isin("Java", "Python brace") & (F.length(s) - F.length(F.replace(s, F.lit("{"))) > NESTING), walked)


def unflat(s: Column) -> Column:
    return F.translate(s, _INNER, "{}")


def none(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def let(values: list[Column], build: Callable[..., Column]) -> Column:
    """``build(*values)`` with each value computed once; inside a lambda it would be computed for every element."""
    names = [f"v{k}" for k in range(len(values))]
    one = F.array(F.struct(*(v.alias(n) for v, n in zip(values, names))))
    return F.get(F.transform(one, lambda s: build(*(s[n] for n in names))), F.lit(0))


def count(s: Column, pattern: str) -> Column:
    return F.regexp_count(s, F.lit(pattern))


def occurrences(s: Column, text: str) -> Column:
    """How often a text occurs. Bytes are counted, which needs no pass over the text."""
    return F.floor((F.octet_length(s) - F.octet_length(F.replace(s, F.lit(text), F.lit("")))) / len(text.encode())).cast("int")


#: Characters that rules count.
SIGNS = "()[]{}<>|\\\t\r\n"


def signs(s: Column) -> Column:
    """What is left of a text without other characters than ``SIGNS``: one pass for all rules that count some."""
    return F.regexp_replace(s, r"[^()\[\]{}<>|\\\t\r\n]+", "")


def matches(s: Column, pattern: str) -> Column:
    return F.regexp_extract_all(s, F.lit(f"({pattern})"), F.lit(1))


def _sum(xs: Column, start: Column, n: Column) -> Column:
    return F.aggregate(F.slice(xs, start, n), F.lit(0), lambda s, x: s + x)


def _chunks(xs: Column, size: Column, build: Callable[[Column], Column]) -> Column:
    """``build`` of the number of each chunk of ``size``."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(xs) - 1) / size).cast("int")), build)


def _from(before: Column, xs: Column, size: Column) -> Column:
    """Running sums, from the sum before each chunk."""
    return F.flatten(F.transform(before, lambda b, j: F.transform(F.slice(xs, j * size + 1, size), lambda _, i: b + _sum(xs, j * size + 1, i + 1))))


def running(lengths: Column) -> Column:
    """Running sums of an array of numbers.

    Spark has no such function, and an array that grows inside ``aggregate`` is copied at each
    step. Sums are made in chunks of the cube root of the length, and those of the chunks in
    chunks of the square root of their number, so n numbers take about n ** (4 / 3) additions.
    """
    root = lambda xs, power: F.greatest(F.ceil(F.pow(F.size(xs), F.lit(power))).cast("int"), F.lit(1))

    def chunked(xs: Column, size: Column) -> Column:
        def ends(sums: Column, wide: Column) -> Column:
            every = _from(_chunks(sums, wide, lambda j: _sum(sums, F.lit(1), j * wide)), sums, wide)
            return _from(F.zip_with(every, sums, lambda end, own: end - own), xs, size)

        sums = _chunks(xs, size, lambda j: _sum(xs, j * size + 1, size))
        return let([sums, root(_chunks(xs, size, lambda j: j), 0.5)], ends)

    return let([lengths, root(lengths, 1 / 3)], chunked)


def _laid(before: Column, own: Column) -> Column:
    """Structs (s, start, end) of texts that each follow what stands before them."""

    def spans(own: Column, ends: Column) -> Column:
        return F.transform(own, lambda x, i: F.struct(x.alias("s"), (F.get(ends, i) - F.length(x)).alias("start"), F.get(ends, i).alias("end")))

    ends = running(F.zip_with(before, own, lambda x, y: F.length(x) + F.length(y)))
    return F.when(F.size(own) > 0, let([own, ends], spans)).otherwise(none(TOKEN))


def marks(tokens: Column) -> Column:
    """The spans of tokens."""
    return F.transform(tokens, lambda t: F.struct(t["start"].alias("start"), t["end"].alias("end")))


def positions(s: Column, pattern: str) -> Column:
    """Code-point spans of all matches."""
    return F.when(F.regexp_count(s, F.lit(pattern)) > 0, let([F.split(s, pattern, -1), F.regexp_extract_all(s, F.lit(pattern), F.lit(0))], lambda parts, own: marks(_laid(F.slice(parts, F.lit(1), F.size(own)), own)))).otherwise(none(MARK))


def char_positions(s: Column, chars: str) -> Column:
    """Spans of all occurrences of some characters."""
    at = F.transform(F.split(s, ""), lambda c, i: F.when(c.isin(list(chars)), F.struct(i.alias("start"), (i + 1).alias("end"))))
    return F.filter(at, lambda m: m.isNotNull())


def located(s: Column, dialect: Column, kind: str, marker: Column | None = None) -> Column:
    """Tokens of a kind with their code-point spans: structs (s, start, end)."""
    return let([_extract(s, dialect, kind, 1, marker), _extract(s, dialect, kind, 2, marker)], _laid)


def has_control(s: Column) -> Column:
    return s.rlike(f"^(?:[{_SHOWN}]++|[{NO_CONTROL}])*+[{CONTROL}]")


def not_blank(s: Column) -> Column:
    return s.rlike(r"(?U)\S")


#: White space, as patterns with (?U) have it.
_WHITE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def trim(s: Column) -> Column:
    """Without white space at the ends, which are looked at alone."""
    return F.btrim(s, F.lit(_WHITE))


def leading_space(s: Column) -> Column:
    return F.regexp_extract(s, LEADING, 0)


def at_end(s: Column, unit: str) -> Column:
    """The longest run of single characters of a pattern at the end; the text is read from there."""
    return F.reverse(F.regexp_extract(F.reverse(s), f"^(?:{unit})*+", 0))


def trailing_space(s: Column) -> Column:
    return at_end(s, r"(?U:[\s&&[^\n]])")


def format_specs(s: Column, dialect: str) -> Column:
    """The format specifications of one dialect, in order. Each has the dialect's sign, which most texts lack."""
    sign = "%" if FORMATS[dialect].marks == "%" else "{"
    return F.when(s.contains(sign), F.regexp_extract_all(s, F.lit(_pattern(FORMATS[dialect], "format")), F.lit(2))).otherwise(none("string"))


def without_formats(s: Column, dialect: Column) -> Column:
    """The text without format specifications; a doubled marker leaves one."""
    return by_dialect(dialect, lambda d: s if d is _PLAIN else F.regexp_replace(s, F.lit(f"{d.one}|{d.spec}"), F.lit("$1")))


def _opened(before: Column, dialect: Column) -> Column:
    """Whether an apostrophe stands before a word."""
    return before.contains("'") & by_dialect(dialect, lambda d: F.lit(True) if d is _PLAIN else F.regexp_replace(before, F.lit(d.spec), F.lit("")).contains("'"))


def _uncut(s: Column, dialect: Column, build: Callable[[Column, Column], Column]) -> Column:
    return let([_extract(s, dialect, "word", 1), _extract(s, dialect, "word", 2)], build)


def words(s: Column, dialect: Column) -> Column:
    """Words; a format specification ends one, and a word after an apostrophe doesn't keep one at its end."""
    cut = lambda before, w: F.when(w.endswith("'") & _opened(before, dialect), F.substring(w, F.lit(1), F.length(w) - 1)).otherwise(w)
    # Only where a word may end with an apostrophe must what stands before it be known.
    return F.when(s.rlike(rf"'(?![{ALNUM}ʼ’-])"), _uncut(s, dialect, lambda before, own: F.zip_with(before, own, cut))).otherwise(_extract(s, dialect, "word", 2))


def gaps(s: Column, dialect: Column) -> Column:
    """What stands before each word."""
    return tokens(s, dialect, "word", 1)


def located_words(s: Column, dialect: Column) -> Column:
    """Words with their code-point spans."""

    def cut(t: Column, before: Column) -> Column:
        shorter = F.struct(F.substring(t["s"], F.lit(1), F.length(t["s"]) - 1).alias("s"), t["start"].alias("start"), (t["end"] - 1).alias("end"))
        return F.when(t["s"].endswith("'") & _opened(before, dialect), shorter).otherwise(t)

    return _uncut(s, dialect, lambda before, own: F.zip_with(_laid(before, own), before, cut))


def is_acronym(r: Column) -> Column:
    return (F.length(r) >= 2) & r.rlike(r"\p{IsUppercase}") & ~r.rlike(r"\p{IsLowercase}")


def acronyms(s: Column, dialect: Column) -> Column:
    # A text needs two of these side by side; many have none.
    big = rf"[{_BITS[26 * 4:]}\x80-\x{{10FFFF}}]"
    own = F.array_sort(F.array_distinct(F.filter(_extract(s, dialect, "acronym", 2), is_acronym)))
    return F.when(s.rlike(f"{big}{big}"), own).otherwise(none("string"))


def tokens(s: Column, dialect: Column, kind: str = "token", group: int = 2, marker: Column | None = None) -> Column:
    return _extract(s, dialect, kind, group, marker)


def unquoted(t: Column) -> Column:
    """Without one pair of quotes around."""
    quote = f"[{DOUBLE_QUOTES}]"
    return F.regexp_replace(t, f"^{quote}([\\s\\S]*){quote}\\z", "$1")


def _bare(t: Column) -> Column:
    return F.regexp_replace(t, r"^<([\s\S]*)>\z", "$1")


def is_url(t: Column) -> Column:
    return t.contains("://") & t.contains(".")


def is_email(t: Column) -> Column:
    local, domain = rf"[{ALNUM}.\-_+%{{}}$]++", rf"[{ALNUM}.\-%{{}}$]"
    return t.rlike(rf"^{local}@(?=[^.]*+\.){domain}++\z")


def is_path(t: Column) -> Column:
    return t.rlike(r"^(?:\.\.?/|~/|/[^/]+/[\s\S])")


#: Tokens that must be alike in both texts: kind, what a text needs to hold any, what is stripped, the test.
ALIKE: dict[str, tuple[str, str, Callable[[Column], Column] | None, Callable[[Column], Column] | None]] = {
    "emails": ("token", "@", lambda t: unquoted(_bare(t)), is_email),
    "functions": ("function", "()", None, None),
    "HTML tags": ("html", "<", None, None),
    "paths": ("token", "/", None, is_path),
    "URLs": ("token", "://", _bare, is_url),
}


def alike(s: Column, dialect: Column, what: str) -> Column:
    """The texts of the tokens of ``ALIKE``."""
    kind, sign, strip, test = ALIKE[what]
    # Most texts lack the sign, and are not cut into tokens at all.
    out = tokens(s, dialect, kind)
    out = F.transform(out, strip) if strip else out
    out = F.filter(out, test) if test else out
    return F.when(s.contains(sign), out).otherwise(none("string"))


def located_alike(s: Column, dialect: Column, what: str) -> Column:
    """The same tokens with their spans."""
    kind, sign, strip, test = ALIKE[what]

    def stripped(t: Column) -> Column:
        # As much is stripped at either end.
        x = strip(t["s"])
        cut = F.floor((F.length(t["s"]) - F.length(x)) / 2).cast("int")
        return F.struct(x.alias("s"), (t["start"] + cut).alias("start"), (t["end"] - cut).alias("end"))

    out = located(s, dialect, kind)
    out = F.transform(out, stripped) if strip else out
    out = F.filter(out, lambda t: test(t["s"])) if test else out
    return F.when(s.contains(sign), out).otherwise(none(TOKEN))
