"""Words looked up by taking affixes off, against all forms that a made dictionary has."""

import itertools
import re

import pytest
from test_rules import catalogue, entries

from polyglint.operators.rules import Options
from polyglint.plans.check import check
from polyglint.sources.affixes import flags_of, lexicon, parse_affixes, parse_stems

AFF = """SET UTF-8
# a comment
FLAG {kind}
NEEDAFFIX {N}
FORBIDDENWORD {F}
ONLYINCOMPOUND {O}
COMPOUNDFLAG {C}
COMPOUNDBEGIN {B}
COMPOUNDEND {E}
COMPOUNDMIN 2

SFX {S} Y 4
SFX {S} y ies [^aeiou]y
SFX {S} 0 s [^y]
SFX {S} 0 s [aeiou]y
SFX {S} 0 'x/{T} .
SFX {T} Y 1
SFX {T} 0 ly .
SFX {M} N 1
SFX {M} e ing e
SFX {G} Y 1
SFX {G} 0 ga/{N}{sep}{T} .
PFX {P} Y 2
PFX {P} 0 re .
PFX {P} i ini i
PFX {Q} N 1
PFX {Q} 0 un/{S} [a-m]
"""
DIC = """99
play/{S}{sep}{P}
try/{S}{sep}{P}
fly/{S}
make/{M}{sep}{P}
ink/{P}{sep}{S}
able/{Q}
need/{N}{sep}{S}
bad/{F}
bads/{F}
open\\/close
Paris
hand/{B}
bag/{E}{sep}{S}
tea/{C}
cup/{C}
inner/{O}{sep}{C}
god/{G}
œuf/{S}\tpo:noun
"""
LETTERS = "SPMQNFOCBEGT"
KINDS = {"UTF-8": ({c: c for c in LETTERS} | {"T": "é"}, ""), "long": ({c: c + c.lower() for c in LETTERS}, ""), "num": ({c: str(k + 10) for k, c in enumerate(LETTERS)}, ",")}


def forms(rules, traits, stems):
    """Every form, made from the stems up."""
    out, forbidden = set(), set()
    for s in stems:
        flags = set(s["flags"])
        if traits["forbidden"] in flags:
            forbidden.add(s["stem"])
            continue
        if traits["only_compound"] in flags:
            continue
        put = lambda r, w: (w.removesuffix(r["strip"]) + r["affix"] if r["kind"] == "SFX" else r["affix"] + w.removeprefix(r["strip"])) if re.search(r["pattern"].replace(r"\z", r"\Z"), w) and (w.endswith(r["strip"]) if r["kind"] == "SFX" else w.startswith(r["strip"])) else None
        of = lambda kind, have: [r for r in rules if r["kind"] == kind and r["flag"] in have]
        chains = [(s["stem"], [], set())]
        for r in of("SFX", flags):
            if (w := put(r, s["stem"])) is not None:
                chains.append((w, [r], set(r["more"])))
                chains += [(x, [r, q], set(r["more"])) for q in of("SFX", set(r["more"])) if (x := put(q, w)) is not None]
        for w, used, brought in chains:
            if not (used and traits["needs_affix"] in used[-1]["more"]) and (used or traits["needs_affix"] not in flags):
                out.add(w)
            for r in of("PFX", flags | brought):
                if used and not (r["both"] and all(u["both"] for u in used)):
                    continue
                if (x := put(r, w)) is not None and not (used and traits["needs_affix"] in used[-1]["more"]):
                    out.add(x)
                    if not used:
                        out |= {y for q in of("SFX", set(r["more"])) if r["both"] and q["both"] and (y := put(q, x)) is not None}
    parts = {k: [s["stem"] for s in stems if {traits["compound"], traits[k]} & set(s["flags"])] for k in ("first", "middle", "last")}
    for n in (2, 3):
        for some in itertools.product(*([parts["first"]] + [parts["middle"]] * (n - 2) + [parts["last"]])):
            out.add("".join(some))
    return out, forbidden


@pytest.mark.parametrize("kind", list(KINDS))
def test_forms(spark, tmp_path, kind):
    names, sep = KINDS[kind]
    aff, dic = AFF.format(kind=kind, sep=sep, **names), DIC.format(sep=sep, **names)
    (tmp_path / "en.aff").write_text(aff)
    (tmp_path / "en.dic").write_text(dic)
    (tmp_path / "xx.dic").write_text("1\nalone\n")
    rules, traits, flags, aliases = parse_affixes("en", aff)
    good, forbidden = forms(rules, traits, list(parse_stems("en", dic, flags, aliases)))
    assert {"plays", "replay", "replays", "play'xly", "making", "tries", "inink", "flies", "needs", "open/close", "handbag", "teacup", "teainnercup", "œufs", "godgaly", "unable"} <= good and not {"need", "inner", "bad", "godga"} & good
    pool = sorted(good | forbidden | {"need", "inner", "remaking", "flys", "trys", "bagtea", "handcup", "teatea", "teabag", "handhand", "cup", "reable", "unink", "paris", "ly", "s", "unables", "handteabag"})
    asked = {x for w in pool for x in (w, w.capitalize(), w.upper(), w + "q")}
    low = {w: {w} if w not in (w.upper(), w.capitalize()) or w == w.lower() else {w, w.lower(), w.capitalize()} if w == w.upper() else {w, w.lower()} for w in asked}
    want = {w for w in asked if any(x in good and x not in forbidden for x in low[w])}
    words = spark.createDataFrame([("en", w) for w in asked] + [("xx", "alone")], "language string, word string")
    assert {(r.language, r.word) for r in lexicon(spark, str(tmp_path)).known(words).collect()} == {("en", w) for w in want}


def test_flags():
    assert flags_of("AbC", "char") == ["A", "b", "C"] and flags_of("AbCd", "long") == ["Ab", "Cd"] and flags_of("1,22", "num") == ["1", "22"] and flags_of("2", "char", ["AB", "CD"]) == ["C", "D"]


def test_spelling_with_a_lexicon(spark, tmp_path):
    (tmp_path / "fr.aff").write_text("SET UTF-8\nSFX S Y 1\nSFX S 0 s .\n")
    (tmp_path / "fr.dic").write_text("2\nchat/S\nParis\n")
    parsed = entries(spark, catalogue("x", "Chats chat CHATS Paris paris chatz", "fr_FR"))
    (found,) = check(parsed, Options(select=("spelling-str",)), lexicon(spark, str(tmp_path))).collect()
    assert found.message == "misspelled words in translation: chatz, paris"
