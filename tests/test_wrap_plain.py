"""Lines of plain words, which are filled without looking at each character: the same lines, and how much is scanned."""

import random
from bisect import bisect_right
from itertools import accumulate

from polyglint.functions import wrap
from polyglint.sources.po import escape


def filled_by_places(text, budget):
    out, start, ends = [], 0, wrap.allowed(text)
    before = [0, *accumulate(map(wrap.char_width, text))]
    while before[-1] - before[start] > budget:
        k = bisect_right([before[e] for e in ends], before[start] + budget)
        if not k or ends[k - 1] <= start:
            k = bisect_right(ends, start) + 1
        if k > len(ends):
            break
        out.append(text[start : ends[k - 1]])
        start = ends[k - 1]
    return [*out, text[start:]]


def test_lines_are_those_of_all_places():
    r = random.Random(1)
    signs = [*"aeiou     " * 3, *"bXYZ-.,;:!?()[]{}'«»“”éßñ一ｱא한0123%$/|~\\\"\n\t\r", "́", "​", "⁠", "\xa0", "\xad", "\U0001f600", "\U0001f1e6", " don't ", " 1,000 ", " é! ", " (  word ", " word "]
    for _ in range(4000):
        text = escape("".join(r.choice(signs) for _ in range(r.randrange(120))))
        for budget in (0, 1, 12, 77):
            assert wrap.filled(text, budget) == filled_by_places(text, budget), (text, budget)


def test_plain_words_are_not_scanned(monkeypatch):
    scanned, breaks = [], wrap.breaks
    monkeypatch.setattr(wrap, "breaks", lambda text: scanned.append(len(text)) or breaks(text))
    text = "Some words, d'été 1,000; " * 4000
    lines = wrap.message_lines("msgid", text)
    assert "".join(x[1:-1] for x in lines[1:]) == text and max(map(len, lines)) <= 79
    assert sum(scanned) < 100
