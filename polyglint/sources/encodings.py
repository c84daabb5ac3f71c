"""Encoding labels as the web reads them: label, name, decoder. Used by the parser, the header rule and the writer.

Labels mean what browsers take them for: a superset where one is in use (Latin-1 is
windows-1252, GB2312 is GBK, EUC-KR has the characters of windows-949, and so on), and the bytes 80
to 9F that a single-byte table leaves open are control characters.
"""

from __future__ import annotations

import codecs
from functools import cache

UTF_8 = "UTF-8"
#: Name: (decoder here, labels that follow from no rule); fixed values.
_NAMES = {
    UTF_8: ("utf-8", "utf-8 utf8 unicode-1-1-utf-8 unicode11utf8 unicode20utf8 x-unicode20utf8"),
    "IBM866": ("cp866", "866 cp866 csibm866 ibm866"),
    "ISO-8859-2": ("iso8859-2", "csisolatin2 iso-ir-101 iso_8859-2:1987 l2 latin2"),
    "ISO-8859-3": ("iso8859-3", "csisolatin3 iso-ir-109 iso_8859-3:1988 l3 latin3"),
    "ISO-8859-4": ("iso8859-4", "csisolatin4 iso-ir-110 iso_8859-4:1988 l4 latin4"),
    "ISO-8859-5": ("iso8859-5", "csisolatincyrillic cyrillic iso-ir-144 iso_8859-5:1988"),
    "ISO-8859-6": ("iso8859-6", "arabic asmo-708 csiso88596e csiso88596i csisolatinarabic ecma-114 iso-8859-6-e iso-8859-6-i iso-ir-127 iso_8859-6:1987"),
    "ISO-8859-7": ("iso8859-7", "csisolatingreek ecma-118 elot_928 greek greek8 iso-ir-126 iso_8859-7:1987 sun_eu_greek"),
    "ISO-8859-8": ("iso8859-8", "csiso88598e csisolatinhebrew hebrew iso-8859-8-e iso-ir-138 iso_8859-8:1988 visual"),
    "ISO-8859-8-I": ("iso8859-8", "csiso88598i iso-8859-8-i logical"),
    "ISO-8859-10": ("iso8859-10", "csisolatin6 iso-ir-157 l6 latin6"),
    "ISO-8859-13": ("iso8859-13", ""),
    "ISO-8859-14": ("iso8859-14", ""),
    "ISO-8859-15": ("iso8859-15", "csisolatin9 iso_8859-15 l9"),
    "ISO-8859-16": ("iso8859-16", "iso-8859-16"),
    "KOI8-R": ("koi8-r", "cskoi8r koi koi8 koi8-r koi8_r"),
    "KOI8-U": ("koi8-u", "koi8-ru koi8-u"),
    "macintosh": ("mac-roman", "csmacintosh mac macintosh x-mac-roman"),
    "windows-874": ("cp874", "dos-874 iso-8859-11 iso8859-11 iso885911 tis-620 windows-874"),
    "windows-1250": ("cp1250", ""),
    "windows-1251": ("cp1251", ""),
    "windows-1252": ("cp1252", "ansi_x3.4-1968 ascii cp819 csisolatin1 ibm819 iso-8859-1 iso-ir-100 iso8859-1 iso88591 iso_8859-1 iso_8859-1:1987 l1 latin1 us-ascii"),
    "windows-1253": ("cp1253", ""),
    "windows-1254": ("cp1254", "csisolatin5 iso-8859-9 iso-ir-148 iso8859-9 iso88599 iso_8859-9 iso_8859-9:1989 l5 latin5"),
    "windows-1255": ("cp1255", ""),
    "windows-1256": ("cp1256", ""),
    "windows-1257": ("cp1257", ""),
    "windows-1258": ("cp1258", ""),
    "x-mac-cyrillic": ("mac-cyrillic", "x-mac-cyrillic x-mac-ukrainian"),
    "GBK": ("gb18030", "chinese csgb2312 csiso58gb231280 gb2312 gb_2312 gb_2312-80 gbk iso-ir-58 x-gbk"),
    "gb18030": ("gb18030", "gb18030"),
    "Big5": ("big5hkscs", "big5 big5-hkscs cn-big5 csbig5 x-x-big5"),
    "EUC-JP": ("euc-jp", "cseucpkdfmtjapanese euc-jp x-euc-jp"),
    "ISO-2022-JP": ("iso2022-jp", "csiso2022jp iso-2022-jp"),
    "Shift_JIS": ("cp932", "csshiftjis ms932 ms_kanji shift-jis shift_jis sjis windows-31j x-sjis"),
    "EUC-KR": ("cp949", "cseuckr csksc56011987 euc-kr iso-ir-149 korean ks_c_5601-1987 ks_c_5601-1989 ksc5601 ksc_5601 windows-949"),
    "UTF-16BE": ("utf-16-be", "unicodefffe utf-16be"),
    "UTF-16LE": ("utf-16-le", "csunicode iso-10646-ucs-2 ucs-2 unicode unicodefeff utf-16 utf-16le"),
    "replacement": ("", "csiso2022kr hz-gb-2312 iso-2022-cn iso-2022-cn-ext iso-2022-kr replacement"),
    "x-user-defined": ("", "x-user-defined"),
}
_MARKS = ((b"\xef\xbb\xbf", "utf-8"), (b"\xfe\xff", "utf-16-be"), (b"\xff\xfe", "utf-16-le"))


@cache
def labels() -> dict[str, str]:
    """The name of each label, in lower case."""
    out = {}
    for name, (_, listed) in _NAMES.items():
        out |= dict.fromkeys(listed.split(), name)
        kind, _, number = name.lower().rpartition("-")
        if kind == "windows" and len(number) == 4:
            out |= dict.fromkeys((f"cp{number}", f"windows-{number}", f"x-cp{number}"), name)
        if kind == "iso-8859" and number.isdigit() and name != "ISO-8859-16":
            out |= dict.fromkeys((f"iso-8859-{number}", f"iso8859-{number}", f"iso8859{number}"), name)
            if len(number) == 1:
                out[f"iso_8859-{number}"] = name
    return out


def name_of(label: str) -> str | None:
    """The encoding that a label stands for; null if there is none."""
    return labels().get(label.strip("\t\n\f\r ").lower())


def _open_bytes(e: UnicodeError) -> tuple[str | bytes, int]:
    """80 to 9F where a single-byte table has nothing, and the vendor's rows of Japanese, which the plain decoder lacks."""
    part = e.object[e.start : e.start + 2]
    if isinstance(e, UnicodeEncodeError):
        if e.encoding == "charmap" and "\x80" <= part[0] <= "\x9f":
            return bytes([ord(part[0])]), e.start + 1
        raise e
    if e.encoding == "charmap" and 0x80 <= part[0] <= 0x9F:
        return chr(part[0]), e.start + 1
    if e.encoding == "euc_jp" and len(part) == 2 and min(part) > 0xA0:
        row, cell = part[0] - 0xA0, part[1] - 0xA0
        lead = (row - 1) // 2 + (0x81 if row < 63 else 0xC1)
        trail = cell + (0x9E if row % 2 == 0 else 0x3F if cell < 64 else 0x40)
        try:
            return bytes([lead, trail]).decode("cp932"), e.start + 2
        except UnicodeDecodeError:
            pass
    raise e


def _replace(e: UnicodeError) -> tuple[str | bytes, int]:
    try:
        return _open_bytes(e)
    except UnicodeError:
        return codecs.replace_errors(e)


codecs.register_error("open-bytes", _open_bytes)
codecs.register_error("open-bytes-or-replace", _replace)


def decode(raw: bytes, name: str) -> tuple[str, bool]:
    """The text, and whether it had bytes that the encoding doesn't have."""
    codec = _NAMES[name][0]
    if name != UTF_8:
        for mark, marked in _MARKS:
            if raw.startswith(mark):
                raw, codec = raw[len(mark) :], marked
                break
    if not codec:
        return ("�" if raw else "", bool(raw)) if name == "replacement" else ("".join(chr(b if b < 128 else 0xF700 + b) for b in raw), False)
    try:
        return raw.decode(codec, "strict" if name == UTF_8 else "open-bytes"), False
    except UnicodeDecodeError:
        return raw.decode(codec, "open-bytes-or-replace"), True


def encode(text: str, name: str) -> bytes:
    """UnicodeEncodeError if the encoding has no such character, LookupError if catalogues aren't written in it."""
    codec = _NAMES[name][0] if name in _NAMES else ""
    if not codec or codec.startswith("utf-16"):
        raise LookupError(name)
    return text.encode(codec, "strict" if name == UTF_8 else "open-bytes")
