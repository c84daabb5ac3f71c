"""The pass over files of several ranges: spread over tasks, and entries parsed only where they may be headers."""

import random

from polyglint.sources import po


def test_ranges_are_surveyed_by_many_tasks(spark, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.po").write_text("\n\n".join(f'msgid "{n}"\nmsgstr "x"' for n in range(300)))
    ranges = po.ranges_of(po.list_files(spark, str(tmp_path)), 512)
    assert "REPARTITION_BY_NUM" in ranges._jdf.queryExecution().executedPlan().toString()
    assert ranges.count() > 20


def test_wrapped_entries_are_no_headers(monkeypatch):
    parsed, parse = [], po.parse
    monkeypatch.setattr(po, "parse", lambda *a: parsed.append(a) or parse(*a))
    data = "\n\n".join(['msgid ""\nmsgstr "Language: fr\\n"'] + ['msgid ""\n"some words msgid "\n"more"\nmsgstr "x"'] * 50).encode()
    lines, n, headers = po.Part(data, 0, 0, len(data), data.count(b"\n"), 0).survey()
    assert (n, headers, len(parsed)) == (51, [data[: data.index(b"\n\n")]], 1)


def test_survey_finds_all_headers():
    r = random.Random(2)
    some = ["msgid", 'msgid ""', 'msgid "a"', "#~ msgid \"\"", '"', '""', '"\\n"', '"b c"', '#~ "d"', '#~ ""', "# note", 'msgstr "x: y\\n"', 'msgstr ""', 'msgid_plural ""', 'msgid """', " msgid \"\"", '"é"', '"e']
    for _ in range(3000):
        data = "\n".join(r.choice(some) if r.randrange(4) else "" for _ in range(r.randrange(12))).encode()
        wanted = [e["byte_start"] for e in po.parse(data) if e["is_header"]]
        blocks = [(a, b) for _, a, b, _ in po._blocks(data, 0, len(data))]
        found = po.Part(data, 0, 0, len(data), 0, 0).survey()[2]
        assert found == [data[a:b] for a, b in blocks if a in wanted], data
