import random

from palimpsest.llm import linededup as d

from .test_linededup import line, result


def test_a_block_whose_lines_first_occur_elsewhere(make):
    one, two = line(1, 7), line(2, 7)
    texts = {1: f"{one}\n{line(3)}", 2: f"{line(4)}\n{one}\n{two}\n{line(5)}", 3: f"{line(6)}\n{one}\n{two}\n{line(7)}", 4: f"{line(8)}\n{two}\n{line(9)}"}
    got = result(d.deduplicated_lines(make([(i, t, "en", "s") for i, t in texts.items()]), runs=True))
    assert got == {1: (texts[1], 0), 2: (texts[2], 0), 3: (f"{line(6)}\n{line(7)}", 2), 4: (texts[4], 0)}


def in_shared_runs(lines, earlier, least):
    """Places of ``lines`` in runs of ``least`` words or more that one of the earlier documents has, by trying all runs."""
    out, known = set(), {tuple(x[a:z]) for x in earlier for a in range(len(x)) for z in range(a + 1, len(x) + 1)}
    for a in range(len(lines)):
        for z in range(a + 1, len(lines) + 1):
            if tuple(lines[a:z]) in known and sum(len(x.split()) for x in lines[a:z]) >= least:
                out |= set(range(a, z))
    return out


def test_runs_against_all_earlier_documents(make):
    r = random.Random(8)
    pool = [line(k, r.choice([1, 2, 3, 4, 6, 7, 12])) for k in range(9)]
    docs = {i: [r.choice(pool) for _ in range(r.randint(0, 9))] for i in range(90)}
    found = {x.doc_id: {k for place, n in x.runs for k in range(place, place + n)} for x in d.repeated_runs(make([(i, "\n\n".join(t), "en", "s") for i, t in docs.items()])).collect()}
    for i, lines in docs.items():
        assert found.get(i, set()) == in_shared_runs(lines, [docs[k] for k in range(i)], 10), i


def test_short_lines_after_different_lines_are_met(make):
    verse = [line(100 + k, 3) for k in range(20)]
    texts = {1: "\n".join([line(1), *verse, line(2)]), 2: "\n".join([line(3), *verse, line(4)])}
    assert [k for k, _, _ in d.line_keys(texts[1])][2:-1] == [k for k, _, _ in d.line_keys(texts[2])][2:-1]
    for runs, left in ((True, [line(3), line(4)]), (False, [line(3), verse[0], line(4)])):
        got = result(d.deduplicated_lines(make([(i, t, "en", "s") for i, t in texts.items()]), runs=runs))
        assert got[2] == ("\n".join(left), 22 - len(left))


def test_lines_of_scripts_without_spaces(make):
    own = ["\u6625\u306e\u6d77\u7d42\u65e5\u306e\u305f\u308a\u304b\u306a", "\u53e4\u6c60\u3084\u86d9\u98db\u3073\u8fbc\u3080\u6c34\u306e\u97f3"]
    assert [d.line_words(x) for x in (*own, "a b", "\u00e9" * 40, "  ")] == [10, 11, 2, 1, 0]
    got = result(d.deduplicated_lines(make([(1, own[0] + "\n" + own[1], "ja", "s"), (2, line(1) + "\n" + own[1], "ja", "s")])))
    assert got[2] == (line(1), 1)


def test_own_text_beside_passages_of_several_documents_stays(make):
    parts = [[line(10 * k + j, 13) for j in range(4)] for k in range(3)]
    own = line(99, 20)
    texts = {k: "\n".join(p) for k, p in enumerate(parts)}
    texts[7] = "\n".join([*parts[0], *parts[1], own, *parts[2]])
    texts[8] = "\n".join([*parts[2], line(98, 6)])
    kept = d.without_repeated_lines(make([(i, t, "en", "s") for i, t in texts.items()]))
    assert {r.doc_id: r.text for r in kept.collect()} == {0: texts[0], 1: texts[1], 2: texts[2], 7: own}


def test_rows_of_one_id_lose_their_own_places_only(make):
    texts = [(1, f"{line(1)}\n{line(2)}"), (5, f"{line(3)}\n{line(4)}\n{line(5)}"), (5, f"{line(1)}\n{line(2)}\n{line(6)}")]
    for runs in (False, True):
        got = sorted((r.doc_id, r.text) for r in d.deduplicated_lines(make([(i, t, "en", "s") for i, t in texts]), runs=runs).collect())
        assert got == sorted([texts[0], texts[1], (5, line(6))])


def test_short_copies(make):
    got = result(d.deduplicated_lines(make([(1, "As. The\nend.", "en", "s"), (2, "As. The\n\nend.", "en", "s"), (3, "As. The\nend. No.", "en", "s"), (4, f"As. The\nend.\n{line(1)}", "en", "s")]), runs=True))
    assert [got[i][1] for i in (1, 2, 3, 4)] == [0, 2, 0, 0] and got[2][0] == ""


def test_patience_piles_align_all_shared_runs():
    """Piles rise in both documents, and together they hold every run."""
    import random

    from palimpsest.llm.linededup import aligned_runs

    r = random.Random(4)
    for _ in range(200):
        shared = [(r.randrange(30), r.randrange(30), r.randint(1, 4)) for _ in range(r.randint(1, 20))]
        got = aligned_runs(shared)
        assert {p + i for p, _, n in shared for i in range(n)} == {p + i for p, n in got for i in range(n)}
    assert aligned_runs([(0, 10, 3), (1, 11, 3), (4, 14, 2)]) == [(0, 6)]  # one diagonal, one block
    assert aligned_runs([(0, 10, 3), (5, 0, 3)]) == [(0, 3), (5, 3)]  # the other order
    assert aligned_runs([(0, 10, 3), (5, 10, 3)]) == [(0, 3), (5, 3)]  # a block twice
    assert len(aligned_runs([(k, 50_000 - k, 1) for k in range(20_000)])) == 20_000


def test_runs_come_through_the_alignment(spark, make, monkeypatch):
    """Without what the alignment returns no run is deleted."""
    from palimpsest.llm import linededup

    lines = [f"line {k} of the passage that both have" for k in range(6)]
    docs = make(["\n".join(lines[:2]), "\n".join(["own words at the top of it", *lines, "and the end"]), "\n".join(["another begin for this one", *lines[3:], *lines[:3]])])
    got = {r.doc_id: r.text for r in linededup.deduplicated_lines(docs, runs=True).collect()}
    assert got[2] == "another begin for this one" and got[1].split("\n")[0] == "own words at the top of it" and lines[2] in got[1]
    none = linededup.repeated_runs(docs).selectExpr("doc_id", "row", "filter(runs, x -> false) AS runs")
    monkeypatch.setattr(linededup, "repeated_runs", lambda *args, **kwargs: none)
    left = {r.doc_id: r.text for r in linededup.deduplicated_lines(docs, runs=True).collect()}
    assert left[2] != got[2]
