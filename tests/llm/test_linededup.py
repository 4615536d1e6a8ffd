import random

from palimpsest.llm import linededup as d

from .conftest import EN, FR, ODD


def line(k, n=9):
    r = random.Random(k)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(5)) for _ in range(n))


def result(df):
    return {r.doc_id: (r.text, r.n_removed) for r in df.collect()}


def test_shared_passages_go_and_the_rest_stays(make):
    passage = [line(k, 13) for k in range(4)]
    texts = {
        1: "\n".join([line(10), *passage, line(11)]),
        2: "\n".join([line(20), *passage, line(21)]),
        3: "\n".join([line(30), "", passage[1], "Of.", line(31)]),
        4: "\n".join([line(40), "Of.", line(41)]),
        5: "\n".join([line(10), *passage, line(11)]),
        6: line(60, 4) + "\n" + line(61),
        7: line(60, 4) + "\n" + line(71),
    }
    got = result(d.deduplicated_lines(make([(i, t, "en", "s") for i, t in texts.items()], {"place": "1", "found": "2", "n_lines": "3"})))
    assert got[1] == (texts[1], 0) and got[4] == (texts[4], 0) and got[6] == (texts[6], 0) and got[7] == (texts[7], 0)
    assert got[2] == ("\n".join([line(20), line(21)]), 4)
    assert got[3] == ("\n".join([line(30), "", "Of.", line(31)]), 1)
    assert got[5] == ("", 6)


def test_copies_with_short_lines_go_whole(make):
    text = "\n".join(["As.", line(1), "The end.", "", line(2), "As.", "As.", line(3, 6), "Of the."])
    got = result(d.deduplicated_lines(make([(3, text, "en", "s"), (9, text, "en", "s"), (4, "As.\n" + line(5), "en", "s"), (5, "As.", "en", "s")])))
    assert got[3] == (text, 0) and got[9][0] == "" and got[4][0] == "As.\n" + line(5)


def test_order_matters_to_the_alignment():
    shared = [(0, 10, True, 2, 9), (1, 11, True, 2, 9), (2, 3, True, 2, 9), (3, 12, True, 2, 9), (4, 13, False, 500, 2)]
    blocks = d.aligned_blocks(shared, 64)
    assert [b[0] for b in blocks] == [0, 1, 3, 4] and [b[2] for b in blocks] == [18, 18, 11, 11]
    assert d.aligned_blocks([], 64) == []
    common = [(k, k, False, 9999, 3) for k in range(5)]
    assert [b[2] for b in d.aligned_blocks(common, 64)] == [15] * 5


def brute(rows, least=10, copied=0.8):
    """The same by comparing every document with the owners of its lines, in plain loops."""
    docs = [(i, t) for i, t in rows if i is not None and t is not None]
    keyed = {i: d.line_keys(t) for i, t in docs}
    owner, count = {}, {}
    for i in sorted(keyed):
        for place, (key, single, _) in enumerate(keyed[i]):
            owner.setdefault(key, (i, place, single))
            count[key] = count.get(key, 0) + 1
    out = {}
    for i, t in docs:
        by_owner = {}
        for place, (key, single, n) in enumerate(keyed[i]):
            o = owner[key]
            if o[0] < i:
                by_owner.setdefault(o[0], []).append((place, o[1], single and o[2], count[key], n))
        found = [b for s in by_owner.values() if sum(x[4] for x in s) >= d.SHORT for b in d.aligned_blocks(s, 64)]
        out[i] = d.without_lines(t, found, least, copied)[0]
    return out


def test_against_plain_loops(make):
    r = random.Random(5)
    pool = [line(k, r.choice([1, 2, 6, 12, 20])) for k in range(60)]
    hot = "\n".join(pool[:3])
    rows = []
    for i in range(120):
        lines = [r.choice(pool) for _ in range(r.randint(0, 12))]
        at = r.randrange(len(lines) + 1)
        text = "\n".join([*lines[:at], *([hot] if i % 3 == 0 else []), *lines[at:]])
        rows.append((i * 3 % 127, text))
    rows += [(500 + k, t) for k, t in enumerate(ODD)] + [(None, hot)]
    got = {r.doc_id: r.text for r in d.deduplicated_lines(make([(i, t, "en", "s") for i, t in rows])).collect()}
    expected = brute(rows)
    assert {i: t for i, t in got.items() if i is not None} == expected | {i: None for i, t in rows if t is None and i is not None} and got[None] == hot


def test_stage_and_odd_tables(make):
    docs = make([(1, EN + "\n" + FR, "en", "s"), (2, EN + "\n" + FR, "en", "s"), (3, FR + "\n" + line(1), "en", "s"), (4, "", "en", "s"), (5, None, "en", "s")])
    kept = d.without_repeated_lines(docs)
    assert kept.columns == docs.columns and kept.schema["n_chars"].dataType == docs.schema["n_chars"].dataType
    assert {r.doc_id: (r.text, r.n_chars) for r in kept.collect()} == {1: (EN + "\n" + FR, len(EN + FR) + 1), 3: (line(1), len(line(1))), 4: ("", 0), 5: (None, None)}
    assert d.deduplicated_lines(make([])).collect() == [] and d.without_repeated_lines(make([])).count() == 0
