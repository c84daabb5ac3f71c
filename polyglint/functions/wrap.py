"""Line breaking of catalogue texts: break classes and widths of characters, pair rules, greedy filling.

The rules are those of Unicode's line breaking algorithm (LB2 to LB31, by number below), on classes
that follow from Unicode's categories, widths and names, with the characters that differ from these
listed. A text is scanned once; a break before a character depends on the class before it, the
last class that isn't a space, and how many regional indicators stand before it.
"""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

from ..sources.po import escape

#: Width of a page that tools of the format use.
PAGE_WIDTH = 79
#: Classes of characters that don't follow from their category; fixed values.
_LISTED = {
    "BK": "\v\f  ", "CR": "\r", "LF": "\n", "NL": "\x85", "SP": " ", "ZW": "​", "ZWJ": "‍", "WJ": "⁠﻿", "GL": "\xa0  ‑͏͜༈༌༒᠎",
    "BA": "\t|\xad֊־।॥‐‒–‧⁖⁘⁙⁚⁛⁝⁞។៕၊။፡", "B2": "—⸺⸻", "BB": "\xb4ˈˌ˟´", "HY": "-", "CB": "￼",
    "EX": "!?׆؛؞؟۔！？❢❣", "IS": ",.:;;։،؍߸⁄", "SY": "/", "IN": "․‥…︙", "QU": "\"'\xab\xbb❛❜❝❞",
    "OP": "\xa1\xbf⸘", "CP": ")]", "CL": "}、。︑︒﹐﹒，．｡､",
    "NS": "៖‼‽⁇⁈⁉々〜〻〼゛゜ゝゞ゠・ーヽヾ﹔﹕：；･ｰﾞﾟぁぃぅぇぉっゃゅょゎゕゖァィゥェォッャュョヮヵヶ",
    "PR": "+\\\xb1№−∓", "PO": "%\xa2\xb0؉؊؋٪‰‱′″‴‵‶‷₧₶₻₾℃℉﷼﹪％￠",
}
_CLASS_OF = {c: name for name, chars in _LISTED.items() for c in chars}
#: Ranges of code points whose class doesn't follow from the category; fixed values.
_RANGES = (
    (0x1100, 0x115F, "JL"), (0xA960, 0xA97C, "JL"), (0x1160, 0x11A7, "JV"), (0xD7B0, 0xD7C6, "JV"), (0x11A8, 0x11FF, "JT"), (0xD7CB, 0xD7FB, "JT"), (0x05D0, 0x05F2, "HL"), (0xFB1D, 0xFB4F, "HL"), (0x1F1E6, 0x1F1FF, "RI"), (0x1F3FB, 0x1F3FF, "EM"),
    (0x31F0, 0x31FF, "NS"), (0xFF67, 0xFF6F, "NS"), (0x1F466, 0x1F478, "EB"), (0x1F918, 0x1F91F, "EB"), (0x1F440 + 2, 0x1F443, "EB"), (0x1F446, 0x1F450, "EB"), (0x1F645, 0x1F647, "EB"), (0x270A, 0x270D, "EB"),
)
#: Scripts without spaces, whose letters are broken by dictionaries only: letters here, marks combine.
_WIDE_BLOCKS = ((0x2E80, 0x2FFF), (0x3003, 0x4DBF), (0x4E00, 0x9FFF), (0xA000, 0xA4CF), (0xF900, 0xFAFF), (0xFE30, 0xFE4F), (0xFF00, 0xFF60), (0x1F000, 0x1FAFF), (0x20000, 0x3FFFD))


@lru_cache(1 << 16)
def break_class(c: str) -> str:
    if c in _CLASS_OF:
        return _CLASS_OF[c]
    n, category = ord(c), unicodedata.category(c)
    for first, last, name in _RANGES:
        if first <= n <= last and category != "Mn":
            return name
    if 0xAC00 <= n <= 0xD7A3:
        return "H3" if (n - 0xAC00) % 28 else "H2"
    if category in ("Mn", "Mc", "Me", "Cc", "Cf"):
        return "CM"
    if category == "Zs":
        return "BA"
    if category in ("Ps", "Pe"):
        return "OP" if category == "Ps" else "CL"
    if category in ("Pi", "Pf"):
        return "QU"
    if category == "Pd":
        return "BA"
    if category == "Sc":
        return "PR"
    wide = unicodedata.east_asian_width(c) in "WF"
    if category == "Nd" and not wide:
        return "NU"
    if wide or any(a <= n <= b for a, b in _WIDE_BLOCKS):
        return "ID"
    return "AL"


@lru_cache(1 << 16)
def char_width(c: str) -> int:
    """Columns of a character: none for controls and marks that combine, two for wide ones."""
    if unicodedata.category(c) in ("Mn", "Me", "Cc", "Cf", "Zl", "Zp") and c != "\xad" or 0x1160 <= ord(c) <= 0x11FF:
        return 0
    return 2 if unicodedata.east_asian_width(c) in "WF" else 1


#: Characters that may take other than one column.
_ODD = re.compile(r"[^\x20-\x7e\xa0-\u02ff]")


def width_of(text: str) -> int:
    return sum(map(char_width, text)) if _ODD.search(text) else len(text)


_LETTERS, _HANGUL = {"AL", "HL"}, {"JL", "JV", "JT", "H2", "H3"}
_ENDS = {"BK", "CR", "LF", "NL"}


def _pairs(*rules: tuple[str, str]) -> set[tuple[str, str]]:
    return {(a, b) for left, right in rules for a in left.split() for b in right.split()}


#: Pairs that stay together, after the rules that come first (LB21 to LB30b).
_TOGETHER = _pairs(
    ("SY", "HL"), ("AL HL", "NU"), ("NU", "AL HL"), ("PR", "ID EB EM"), ("ID EB EM", "PO"), ("PR PO", "AL HL"), ("AL HL", "PR PO"),  # 21b, 23, 23a, 24
    ("CL CP NU", "PO PR"), ("PO PR", "OP NU"), ("HY IS NU SY", "NU"),  # 25
    ("JL", "JL JV H2 H3"), ("JV H2", "JV JT"), ("JT H3", "JT"), ("JL JV JT H2 H3", "PO"), ("PR", "JL JV JT H2 H3"),  # 26, 27
    ("AL HL", "AL HL"), ("IS", "AL HL"), ("EB", "EM"),  # 28, 29, 30b
)


@lru_cache(1 << 16)
def _is_wide(c: str) -> bool:
    return c != "" and unicodedata.east_asian_width(c) in "FWH"


@lru_cache(1 << 16)
def _stays(before: str, after: str, solid: str, spaced: bool, older: str, flags: int, wide: tuple[bool, bool]) -> bool:
    """Whether no break is between two characters: the class before and after, the last class that is no space and the one before that."""
    if after in ("CL", "CP", "EX", "IS", "SY"):  # 13
        return True
    if solid == "OP" or (solid == "QU" and after == "OP") or (solid in ("CL", "CP") and after == "NS") or (solid == after == "B2"):  # 14 to 17
        return True
    if spaced:  # 18
        return False
    if after == "QU" or before == "QU":  # 19
        return True
    if "CB" in (before, after):  # 20
        return False
    if after in ("BA", "HY", "NS", "IN") or before == "BB":  # 21, 22
        return True
    if older == "HL" and before in ("HY", "BA"):  # 21a
        return True
    if (before, after) in _TOGETHER:
        return True
    if before in ("AL", "HL", "NU") and after == "OP":  # 30
        return not wide[1]
    if before == "CP" and after in ("AL", "HL", "NU"):
        return not wide[0]
    return before == after == "RI" and flags == 1  # 30a


#: A run of plain letters is as one letter.
_UNITS = re.compile(r"[A-Za-z]+|.", re.DOTALL)


def breaks(text: str) -> list[int]:
    """Places where a line may end, after a character and before the end of the text. Forced ends are none of them."""
    out: list[int] = []
    before = solid = older = ""
    spaced, flags, last, joined = False, 0, "", False
    for m in _UNITS.finditer(text):
        k, c = m.start(), m[0]
        after = "AL" if len(c) > 1 else break_class(c)
        c = c[-1]
        if before and before not in _ENDS:
            if after == "CM" or after == "ZWJ":
                if before not in ("SP", "ZW"):  # 9: it belongs to the character before
                    joined = after == "ZWJ"
                    continue
                after = "AL"  # 10
            if after in _ENDS or after in ("SP", "ZW"):  # 6, 7
                stays = True
            elif solid == "ZW":  # 8
                stays = False
            elif joined or (not spaced and "WJ" in (before, after)) or after == "WJ" or (not spaced and before == "GL"):  # 8a, 11, 12
                stays = True
            elif after == "GL" and before not in ("SP", "BA", "HY"):  # 12a
                stays = True
            else:
                stays = _stays(before, after, solid, spaced, older, flags % 2, (_is_wide(last), _is_wide(c)))
            if not stays:
                out.append(k)
        elif after in ("CM", "ZWJ"):
            after = "AL"
        joined = False
        if after == "SP":
            spaced = True
        else:
            older, solid, spaced, last = ("" if spaced else solid), after, False, c
            flags = flags + 1 if after == "RI" else 0
        if before in _ENDS:
            older = ""
        before = after
    return out


def allowed(escaped: str) -> list[int]:
    """Places where a line of an escaped text may end: not inside an escape, and not before a line feed at the end."""
    inside, k = set(), 0
    while (k := escaped.find("\\", k)) >= 0 and k + 1 < len(escaped):
        inside.add(k + 1)
        k += 2
    if escaped.endswith("\\n"):
        inside.add(len(escaped) - 2)
    return [p for p in breaks(escaped) if p not in inside]


_LETTER = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff0-9"
#: Signs that are broken like letters.
_SIGNS = "#&*<=>@^_`~"
#: Words of letters of one column, each with a space and another one behind it: lines may end after the spaces and nowhere else.
_PLAIN = re.compile(rf"(?<![^ ])((?:[{_LETTER}][{_LETTER}{_SIGNS},.;:']*+[!?]*+ (?=[{_LETTER}]))++)")


#: Where words can be looked at one by one: before a letter, behind a space and a sign that a line may end after.
_APART = re.compile(rf"(?<=[{_LETTER}{_SIGNS}.,;:!?%$] )(?=[{_LETTER}])")


def _of_word(word: str, follows: bool) -> list[tuple[int, int]] | None:
    ends = allowed(word + "a") if follows else [*allowed(word), len(word)]
    if ends[-1:] != [len(word)]:
        return None
    return [(j - i, width_of(word[i:j])) for i, j in zip([0, *ends], ends)]


_of_short_word = lru_cache(1 << 14)(_of_word)  # short ones come again


def _pieces(escaped: str, follows: bool) -> list[tuple[int, int]] | None:
    """(characters, columns) between places where a line may end; none if it may not before a plain word that ``follows``."""
    words, out = _APART.split(escaped), []
    for k, word in enumerate(words, 1):
        some = (_of_short_word if len(word) <= 40 else _of_word)(word, follows or k < len(words))
        if some is None:
            return None
        out += some
    return out


def breakable(escaped: str) -> bool:
    """Whether a line of the text may end before the text does."""
    first = _PLAIN.match(escaped)  # a place is behind each of its words
    return bool(first or allowed(escaped))


def filled(escaped: str, budget: int) -> list[str]:
    """The text in lines of at most so many columns, each ending at the last place that fits, else at the next one."""
    parts = _PLAIN.split(escaped)
    between = [_pieces(x, k < len(parts) // 2) if x else [] for k, x in enumerate(parts[::2])]
    if None in between:
        parts, between = [escaped], [_pieces(escaped, False)]
    out, start, at, width = [], 0, 0, 0
    for k, group in enumerate(between):
        for n, columns in group:
            width += columns
            if width > budget and at > start:
                out.append(escaped[start:at])
                start, width = at, columns
            at += n
        if 2 * k + 1 >= len(parts):
            break
        end = at + len(parts[2 * k + 1])
        while end - at > budget - width:  # of plain words
            fits = escaped.rfind(" ", at, at + max(0, budget - width)) + 1
            if not fits and at == start:  # a word that fits nowhere
                fits = escaped.index(" ", at) + 1
            if fits == end:
                break
            out.append(escaped[start : fits or at])
            start = at = fits or at
            width = 0
        width, at = width + end - at, end
    return [*out, escaped[start:]]


def message_lines(head: str, value: str, page: int = PAGE_WIDTH) -> list[str]:
    """A message as lines of a catalogue: ``head`` (the keyword), then the value in quotes, on one line if it fits.

    A value of several lines, or too wide with a place to break, begins below an empty string;
    its lines are filled one by one. A page of 0 columns has all of it on one line.
    """
    escaped = escape(value)
    lines = re.findall(r"[^\n]*\n|[^\n]+", value)
    whole = page == 0 or (len(lines) < 2 and (width_of(escaped) <= max(0, page - width_of(head) - 3) or not breakable(escaped)))
    if whole:
        return [f'{head} "{escaped}"']
    return [f'{head} ""', *_body(value, page)]


@lru_cache(4)
def _body(value: str, page: int) -> tuple[str, ...]:
    """The lines of a value below an empty string; an entry often has the same text in several places."""
    return tuple(f'"{x}"' for line in re.findall(r"[^\n]*\n|[^\n]+", value) for x in filled(escape(line), max(0, page - 2)))
