"""Words between signs, of which each is looked at by itself: the same lines, and how much is scanned."""

import random

from polyglint.functions import wrap
from polyglint.sources.po import escape
from test_wrap_plain import filled_by_places


def test_lines_are_those_of_all_places():
    r = random.Random(3)
    ends = [*"#&*<=>@^_`~%$.,;:!?|/-([{)]}'\"\\«—+", "%%%", "$$$", "***", "\n", "́", "​", "⁠", "\U0001f1e6", "ｱ", "é", " ", ""]
    for _ in range(4000):
        text = escape("".join(r.choice(["word", "a", "Été", "10"]) + r.choice(ends) + r.choice(["", " ", " ", " ", "  "]) for _ in range(r.randrange(25))))
        for budget in (0, 1, 12, 77):
            assert wrap.filled(text, budget) == filled_by_places(text, budget), (text, budget)


def test_words_with_signs_are_scanned_once(monkeypatch):
    scanned, breaks = [], wrap.breaks
    monkeypatch.setattr(wrap, "breaks", lambda text: scanned.append(len(text)) or breaks(text))
    text = "of### an&&& one*** it%%% the$$$ " * 2000
    for head in ("msgid", "msgid_plural"):
        lines = wrap.message_lines(head, text)
        assert "".join(x[1:-1] for x in lines[1:]) == text and max(map(len, lines)) <= 79
    assert sum(scanned) < 200
